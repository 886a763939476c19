"""Named options of loading, saving and converting, with defaults and ranges.

They stand in the session's configuration under `tessella.`, so that every part of a job sees the same values; readers and
writers also take them as arguments, which win.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession

PREFIX, DEPTH = "tessella.", 8


@dataclass(frozen=True)
class Option:
    name: str
    default: int
    low: int = 0
    high: int = 1
    clamp: bool = False


#: Names, defaults and ranges.
OPTIONS = {o.name: o for o in (
    Option("jpeg.quality", 90, 1, 100), Option("jpeg.progressive", 0), Option("bitmap.rle", 1), Option("targa.rle", 0),
    Option("dds.mipmaps", 1, 1, 32), Option("dds.depth", 1, 1, 65536), Option("dds.cubemap", 0), Option("dds.volume", 0),
    Option("png.filter", 5, 0, 6), Option("png.level", 5, 0, 9), Option("png.animated", 1), Option("png.strategy", 1, 0, 2),
    Option("pgm.binary", 1), Option("ppm.binary", 1), Option("gif.animated", 1), Option("tiff.compression", 1, 0, 5), Option("psd.layer", 1),
    Option("reduction.mask", 255, 0, 255, True), Option("mipmap.filter", 1, 0, 9, True), Option("binary.threshold", 128, 0, 255, True),
)}


def register(option: Option) -> None:
    OPTIONS[option.name] = option


def checked(name: str, value: int) -> int:
    """The value as it is kept: clamped for the options that say so. Out of range for the others, or unknown: an error."""
    if name not in OPTIONS:
        raise KeyError(f"there is no option {name}")
    o = OPTIONS[name]
    if o.clamp:
        return max(o.low, min(o.high, value))
    if not o.low <= value <= o.high:
        raise ValueError(f"{name} is {o.low} to {o.high}")
    return value


def set_option(spark: SparkSession, name: str, value: int) -> None:
    spark.conf.set(PREFIX + name, str(checked(name, value)))


def option(spark: SparkSession, name: str) -> int:
    if name not in OPTIONS:
        raise KeyError(f"there is no option {name}")
    return int(spark.conf.get(PREFIX + name, str(OPTIONS[name].default)))


_saved: list[dict[str, str | None]] = []


def push(spark: SparkSession) -> bool:
    """Keeps all values for `pop`; False if DEPTH are kept already."""
    if len(_saved) >= DEPTH:
        return False
    _saved.append({n: spark.conf.get(PREFIX + n, None) for n in OPTIONS})
    return True


def pop(spark: SparkSession) -> bool:
    if not _saved:
        return False
    for name, value in _saved.pop().items():
        spark.conf.unset(PREFIX + name) if value is None else spark.conf.set(PREFIX + name, value)
    return True


@contextmanager
def options(spark: SparkSession, **values: int) -> Iterator[None]:
    """Options within a block; a dot in a name is written as two underscores."""
    if not push(spark):
        raise RuntimeError("too many options are kept")
    try:
        for name, value in values.items():
            set_option(spark, name.replace("__", "."), value)
        yield
    finally:
        pop(spark)
