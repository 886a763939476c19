"""Compositing two pixel relations by position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.color import from_float, to_float
from tessella.operators.geometry import KEY, crop
from tessella.operators.resample import resize

ARGB = ("a", "r", "g", "b")
FACTORS = ("zero", "one", "src_alpha", "one_minus_src_alpha", "dst_alpha", "one_minus_dst_alpha", "src_color", "one_minus_src_color", "dst_color", "one_minus_dst_color")


def laid(source: DataFrame, target: DataFrame, at: tuple[int, int], f) -> DataFrame:
    """target with f(source channel fractions, target's) where source lies over it."""
    part = source.select("image_id", (F.col("x") + at[0]).alias("x"), (F.col("y") + at[1]).alias("y"), *(to_float(c).alias(f"_{c}") for c in ARGB))
    both = target.join(part, KEY, "left")
    new = f({c: F.col(f"_{c}") for c in ARGB}, {c: to_float(c) for c in ARGB})
    # rounded to nine places first, so that a half is one on any engine
    return both.select(*KEY, *(F.when(F.col("_a").isNull(), F.col(c)).otherwise(from_float(F.round(new[c] * 255, 9) / 255)).alias(c) for c in ARGB))


def factor(name: str, channel: str, s: dict[str, Column], d: dict[str, Column]) -> Column:
    if name.startswith("one_minus_"):
        return 1 - factor(name.removeprefix("one_minus_"), channel, s, d)
    return {"zero": F.lit(0.0), "one": F.lit(1.0), "src_alpha": s["a"], "dst_alpha": d["a"], "src_color": s[channel], "dst_color": d[channel]}[name]


def blend(source: DataFrame, target: DataFrame, src: str, dst: str, at: tuple[int, int] = (0, 0)) -> DataFrame:
    """Source times its factor plus target times its own. Colours of the source are no source factor, nor those of the target
    a target factor."""
    if src.endswith("src_color") or dst.endswith("dst_color") or not {src, dst} <= set(FACTORS):
        raise ValueError(f"{src} and {dst} can't be blended")
    return laid(source, target, at, lambda s, d: {c: s[c] * factor(src, c, s, d) + d[c] * factor(dst, c, s, d) for c in ARGB})


def over(source: DataFrame, target: DataFrame, at: tuple[int, int] = (0, 0)) -> DataFrame:
    """Source over target; colours aren't premultiplied."""

    def mixed(s: dict, d: dict) -> dict:
        a = s["a"] + d["a"] - s["a"] * d["a"]
        share = F.coalesce(s["a"] / F.nullif(a, F.lit(0.0)), F.lit(0.0))
        return {"a": a} | {c: s[c] * share + d[c] * (1 - share) for c in "rgb"}

    return laid(source, target, at, mixed)


def over_fast(source: DataFrame, target: DataFrame, at: tuple[int, int] = (0, 0)) -> DataFrame:
    """Source over target by whole numbers in 256ths; its rounding differs from that of `over`."""
    part = source.select("image_id", (F.col("x") + at[0]).alias("x"), (F.col("y") + at[1]).alias("y"), *(F.col(c).alias(f"_{c}") for c in ARGB))
    both = target.join(part, KEY, "left").withColumn("_total", F.col("_a") + 1 + F.shiftright((F.col("a") * (256 - F.col("_a"))).cast("int"), 8))
    share = F.floor(F.col("_a") * 256 / F.col("_total")).cast("int")
    mixed = {c: F.shiftright((F.col(f"_{c}") * share + F.col(c) * (256 - share)).cast("int"), 8) for c in "rgb"} | {"a": F.least(F.lit(255), F.col("_total"))}
    return both.select(*KEY, *(F.when(F.col("_a").isNull(), F.col(c)).otherwise(mixed[c]).cast("int").alias(c) for c in ARGB))


def add(source: DataFrame, target: DataFrame, at: tuple[int, int] = (0, 0)) -> DataFrame:
    return laid(source, target, at, lambda s, d: {c: s[c] + d[c] for c in ARGB})


def stretched(source: DataFrame, target: DataFrame, rect: tuple[int, int, int, int], to: tuple[int, int, int, int], how: str = "bilinear", draw: Callable[..., DataFrame] = over, **more) -> DataFrame:
    """A rectangle of source, resampled to the size of one of target and drawn there: by `over`, `over_fast`, `add`, or `blend`
    with its factors."""
    x, y, w, h = rect
    part = resize(crop(source, x, y, w, h), (w, h), (to[2], to[3]), how)
    return draw(part, target, at=(to[0], to[1]), **more)
