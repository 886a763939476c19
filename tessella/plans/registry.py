"""Where queries and the DuckDB SQL that they are checked against are registered.

Whole numbers are returned as bigint and fractions rounded to six places, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.fixtures import DUCK, pixels

XY = ["image_id", "x", "y"]
ARGB = ["a", "r", "g", "b"]
S8 = {"width": 8, "height": 8}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, fixture: str, f: Callable, sql: str | None, ints: list[str], floats: list[str] = (), second: str | None = None, sized: bool = False) -> None:
    """f gets the fixture's pixels (and the second fixture's); sql selects from p (and q). sized: pixels come with their image's size
    where the fixture knows it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = [pixels(spark, sf_dir, x, sized) for x in (fixture, second) if x]
        return f(*given).select(*(F.col(c).cast("long").alias(c) for c in ints), *(F.round(F.col(c).cast("double"), 6).alias(c) for c in floats))

    QUERIES[name] = run
    if sql:
        made = ", ".join([f"cast({c} as bigint) as {c}" for c in ints] + [f"round(cast({c} as double), 6) as {c}" for c in floats])
        more = f", q as materialized ({DUCK[second]})" if second else ""
        # materialised, as many join the fixture with itself
        SQL[name] = f"with p as materialized ({DUCK[fixture]}){more} select {made} from ({sql})"
    if fixture == "doc":  # the same by its other name
        QUERIES[f"{name}_whole"] = run


def c8(e: str, top: int = 255) -> str:
    return f"cast(greatest(0, least({top}, round_even({e}, 0))) as int)"


def each(f: str, channels: str = "rgb") -> str:
    """f with {c} for each channel."""
    return ", ".join(f"{f.format(c=c)} as {c}" for c in channels)


def over_table(name: str, table: str, f: Callable, sql: str, ints: list[str], floats: list[str] = (), texts: list[str] = ()) -> None:
    """A query over a test table itself."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        return made.select(*(F.col(c).cast("long").alias(c) for c in ints), *(F.round(F.col(c).cast("double"), 6).alias(c) for c in floats), *texts)

    QUERIES[name] = run
    SQL[name] = "select " + ", ".join([f"cast({c} as bigint) as {c}" for c in ints] + [f"round(cast({c} as double), 6) as {c}" for c in floats] + list(texts)) + f" from ({sql})"


# blocks of 4 x 4 pixels, written and read again, in SQL
BLOCK = "(partition by image_id, x // 4, y // 4)"


def level_sql(v: str, source: str, out: str) -> str:
    """source with `out`: the nearest of a block's eight levels between the extremes of v; the first of equally near ones."""
    levels = ", ".join(["hi", "lo", *(f"(hi * {7 - k} + lo * {k} + 3) // 7" for k in range(1, 7))])
    return f"""(select * exclude (hi, lo, levels), levels[list_min([abs({v} - levels[i]) * 16 + i for i in range(1, 9)]) % 16] as {out} from (
      select *, [{levels}] as levels from (select *, max({v}) over {BLOCK} as hi, min({v}) over {BLOCK} as lo from {source})))"""


def btc_sql(v: str, source: str) -> str:
    """source with w: the mean of the block's values up to its mean, or of those above it."""
    return f"""(select *, case when {v} > m then above // greatest(1, n) else below // greatest(1, 16 - n) end as w from (
      select *, sum(case when {v} > m then {v} else 0 end) over {BLOCK} as above, sum(case when {v} > m then 0 else {v} end) over {BLOCK} as below, sum(({v} > m)::int) over {BLOCK} as n from (
        select *, sum({v}) over {BLOCK} // 16 as m from {source})))"""


def color_block_sql(clear: bool, source: str = "p") -> str:
    """image_id, x, y, a, r, g, b: colours between the block's two that lie farthest apart. clear: pixels with alpha under 128 become
    transparent black, in blocks that have any."""
    square = lambda c, i, j: f"(c[{i}].{c} - c[{j}].{c}) * (c[{i}].{c} - c[{j}].{c})"
    apart = " + ".join(square(c, "(t // 16 + 1)", "(t % 16 + 1)") for c in "rgb")
    pack = lambda k: f"(((c[{k}].r >> 3) << 11) | ((c[{k}].g >> 2) << 5) | (c[{k}].b >> 3))"
    parts = {"r": "({} >> 11) * 255 // 31", "g": "(({} >> 5) & 63) * 255 // 63", "b": "({} & 31) * 255 // 31"}
    opened = ", ".join(f"{f.format(e)} as {e}_{c}" for c, f in parts.items() for e in ("e0", "e1"))
    ramp = lambda c: f"[e0_{c}, e1_{c}, case when three then (e0_{c} + e1_{c}) // 2 else (2 * e0_{c} + e1_{c} + 1) // 3 end, case when three then 0 else (e0_{c} + 2 * e1_{c} + 1) // 3 end]"
    far = " + ".join(f"(p.{c} - ramp_{c}[i]) * (p.{c} - ramp_{c}[i])" for c in "rgb")
    return f"""(with blocks as (select image_id, x // 4 as bx, y // 4 as by_, list({{'r': r, 'g': g, 'b': b}} order by y, x) as c, {"bool_or(a < 128)" if clear else "false"} as three from {source} group by all),
    ends as (select *, list_max([({apart}) * 256 + 255 - t for t in range(256)]) % 256 as far from blocks),
    pairs as (select *, {pack("((255 - far) // 16 + 1)")} as one, {pack("((255 - far) % 16 + 1)")} as two from ends),
    put as (select image_id, bx, by_, three, case when three then least(one, two) else greatest(one, two) end as e0, case when three then greatest(one, two) else least(one, two) end as e1 from pairs),
    opened as (select *, {opened} from put),
    ramps as (select *, {", ".join(f"{ramp(c)} as ramp_{c}" for c in "rgb")} from opened),
    chosen as (select p.*, o.three, o.ramp_r, o.ramp_g, o.ramp_b, case when o.three and p.a < 128 then 4 when o.e0 = o.e1 and not o.three then 1
      else list_min([case when o.three and i = 4 then 1 << 30 else ({far}) * 8 + i end for i in range(1, 5)]) % 8 end as k
      from {source} p join ramps o on o.image_id = p.image_id and o.bx = p.x // 4 and o.by_ = p.y // 4)
    select image_id, x, y, {"case when three and k = 4 then 0 else 255 end" if clear else "a"} as a, {", ".join(f"ramp_{c}[k] as {c}" for c in "rgb")} from chosen)"""


def block_sql(kind: str) -> str:
    """What a block format gives back for the pixels of p."""
    if kind == "DXT1":
        return "select * from " + color_block_sql(True)
    if kind in ("DXT3", "DXT5"):
        alpha = "(select image_id, x, y, (a >> 4) * 17 as w from p)" if kind == "DXT3" else level_sql("a", "p", "w")
        return f"select image_id, x, y, w as a, c.r as r, c.g as g, c.b as b from {color_block_sql(False)} c join (select image_id, x, y, w from {alpha}) using (image_id, x, y)"
    if kind == "ATI1N":
        return f"select image_id, x, y, 255 as a, w as r, w as g, w as b from {level_sql('r', 'p', 'w')}"
    return f"select image_id, x, y, 255 as a, w as r, u as g, 0 as b from {level_sql('g', level_sql('r', 'p', 'w'), 'u')}"
