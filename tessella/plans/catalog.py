"""Registry of the library's queries over the derived images and of the DuckDB SQL that they are checked against.

Whole numbers are returned as bigint and fractions rounded to six places, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import model
from tessella.functions import color, helpers
from tessella.operators import analysis, blocks, compose, drawing, frames, geometry, neighborhood, palette, point, resample
from tessella.plans import formats_catalog
from tessella.plans.fixtures import DUCK
from tessella.plans.registry import ARGB, S8, QUERIES, SQL, XY, add, block_sql, c8, each, over_table

FLAGSHIP = "convolve_gauss3"
def size_join(select: str, where: str = "") -> str:
    return f"select {select} from p join (select image_id, max(x) + 1 as w, max(y) + 1 as h from p group by image_id) s using (image_id) {where}"


# coordinates
for fixture in ("doc", "events"):
    add(f"flip_{fixture}", fixture, geometry.flip, size_join("image_id, x, h - 1 - y as y, a, r, g, b"), XY + ARGB, sized=True)
    add(f"mirror_{fixture}", fixture, geometry.mirror, size_join("image_id, w - 1 - x as x, y, a, r, g, b"), XY + ARGB, sized=True)
    for q, to in ((1, "y as x, w - 1 - x as y"), (2, "w - 1 - x as x, h - 1 - y as y"), (3, "h - 1 - y as x, x as y")):
        add(f"rotate{90 * q}_{fixture}", fixture, lambda p, q=q: geometry.rotate90(p, q), size_join(f"image_id, {to}, a, r, g, b"), XY + ARGB, sized=True)
add("flip_known_size", "rgba", lambda p: geometry.flip(p, **S8), "select image_id, x, 7 - y as y, a, r, g, b from p", XY + ARGB)
add("crop", "events", lambda p: geometry.crop(p, 10, 2, 50, 30), "select image_id, x - 10 as x, y - 2 as y, a, r, g, b from p where x between 10 and 59 and y between 2 and 31", XY + ARGB)
add("copy_rect", "rgba", lambda p: geometry.copy_rect(p, p, 0, 4, 4, 4, 6, -2),
    "select p.image_id, p.x, p.y, " + each("case when s.a is null then p.{c} else s.{c} end", "argb") + " from p left join p s on s.image_id = p.image_id and s.x = p.x - 6 and s.y = p.y + 6 and s.x between 0 and 3 and s.y between 4 and 7", XY + ARGB)
add("fill_rect", "events", lambda p: geometry.fill_rect(p, 20, 5, 30, 40, {"a": 255, "r": 255, "g": 0, "b": 0}),
    "select image_id, x, y, " + ", ".join(f"case when x between 20 and 49 and y between 5 and 44 then {v} else {c} end as {c}" for c, v in zip("argb", (255, 255, 0, 0))) + " from p", XY + ARGB)
add("replace_color", "doc", lambda p: geometry.replace_color(p, {"a": 255, "r": 32, "g": 0, "b": 0}, {"r": 0, "g": 204, "b": 255}, (0, 0, 16, 16)),
    "select image_id, x, y, a, " + ", ".join(f"case when x < 16 and y < 16 and a = 255 and r = 32 and g = 0 and b = 0 then {v} else {c} end as {c}" for c, v in zip("rgb", (0, 204, 255))) + " from p", XY + ARGB)
add("swap_channels", "rgba", lambda p: geometry.swap_channels(p, "r", "g"), "select image_id, x, y, a, g as r, r as g, b from p", XY + ARGB)
add("split", "events", lambda p: geometry.split(p, 30, 30), "select image_id, x // 30 as chunk_x, y // 30 as chunk_y, x % 30 as x, y % 30 as y, a, r, g, b from p", [*XY, "chunk_x", "chunk_y", *ARGB])
add("split_filled", "doc", lambda p: geometry.split_filled(p, 24, 24, {"a": 255, "r": 1, "g": 2, "b": 3}),
    "select g.image_id, g.chunk_x, g.chunk_y, i as x, j as y, " + ", ".join(f"coalesce(p.{c}, {v}) as {c}" for c, v in zip("argb", (255, 1, 2, 3)))
    + " from (select distinct image_id, x // 24 as chunk_x, y // 24 as chunk_y from p) g cross join range(24) s(i) cross join range(24) t(j) left join p on p.image_id = g.image_id and p.x = g.chunk_x * 24 + i and p.y = g.chunk_y * 24 + j", [*XY, "chunk_x", "chunk_y", *ARGB])
add("image_sizes", "doc", geometry.sizes, "select image_id, max(x) + 1 as width, max(y) + 1 as height from p group by image_id", ["image_id", "width", "height"])

# point transforms
P = "select image_id, x, y, a, {} from p"
add("gray", "rgba", point.to_gray, f"select image_id, x, y, {c8('0.299e0 * r + 0.587e0 * g + 0.114e0 * b')} as gray from p", [*XY, "gray"])
add("invert", "rgba", point.invert, P.format(each("255 - {c}")), XY + ARGB)
add("contrast_brightness", "rgba", lambda p: point.contrast_brightness(p, 25, -10), P.format(each(c8("({c} / 255e0 * 1.25e0 + -10e0 / 100e0) * 255e0"))), XY + ARGB)
add("gamma", "rgba", lambda p: point.gamma(p, {"r": 2.2, "g": 1.8, "b": 0.5}), P.format(", ".join(f"{c8(f'power({c} / 255e0, 1e0 / {g}e0) * 255e0')} as {c}" for c, g in zip("rgb", (2.2, 1.8, 0.5)))), XY + ARGB)
add("threshold", "rgba", lambda p: point.threshold(p, {"r": 0.5, "g": 0.25, "b": 0.75}), P.format(", ".join(f"case when {c} / 255e0 >= {t}e0 then 255 else 0 end as {c}" for c, t in zip("rgb", (0.5, 0.25, 0.75)))), XY + ARGB)
add("levels", "rgba", lambda p: point.levels(p, 0.1, 0.9, 1.4), P.format(each("case when {c} / 255e0 > 0.1e0 then " + c8("power(({c} / 255e0 - 0.1e0) / (0.9e0 - 0.1e0), 1e0 / 1.4e0) * 255e0") + " else 0 end")), XY + ARGB)
add("premultiply", "rgba", point.premultiply, P.format(each(c8("{c} / 255e0 * (a / 255e0) * 255e0"))), XY + ARGB)
add("unpremultiply", "rgba", lambda p: point.unpremultiply(point.premultiply(p)),
    "select image_id, x, y, a, " + each("case when a > 0 then " + c8("{c} / 255e0 / (a / 255e0) * 255e0") + " else 0 end") + f" from (select image_id, x, y, a, {each(c8('{c} / 255e0 * (a / 255e0) * 255e0'))} from p)", XY + ARGB)
add("fill_channel", "rgba", lambda p: point.fill_channel(point.fill_channel(p, "a", 128), "b", 0.25), "select image_id, x, y, 128 as a, r, g, 64 as b from p", XY + ARGB)

# colour spaces
RGB = ["r", "g", "b"]


def space(name: str, there: Callable, back: Callable, sql: dict[str, str], inverse: dict[str, str], wide: bool = False) -> None:
    cols, scale = list(sql), "p" if not wide else "(select image_id, x, y, r * 257 as r, g * 257 as g, b * 257 as b from p)"
    widened = (lambda p: p.withColumns({c: F.col(c) * 257 for c in RGB})) if wide else (lambda p: p)
    add(f"rgb_to_{name}", "rgba", lambda p: widened(p).select(*XY, *(v.alias(k) for k, v in there().items())), f"select image_id, x, y, {', '.join(f'{e} as {k}' for k, e in sql.items())} from {scale}", XY + cols)
    made = f"(select image_id, x, y, {', '.join(f'{e} as {k}' for k, e in sql.items())} from {scale})"
    add(f"{name}_to_rgb", "rgba", lambda p: widened(p).select(*XY, *(v.alias(k) for k, v in there().items())).select(*XY, *(v.alias(k) for k, v in back().items())), f"select image_id, x, y, {', '.join(f'{e} as {k}' for k, e in inverse.items())} from {made}", XY + RGB)


def cut(e: str, top: int = 255) -> str:
    return f"greatest(0, least({top}, {e}))"


space("yuv", color.rgb_to_yuv, color.yuv_to_rgb,
      {"y_": cut("round_even(0.257e0*r + 0.504e0*g + 0.098e0*b, 0) + 16"), "u": cut("round_even(-0.148e0*r - 0.291e0*g + 0.439e0*b, 0) + 128"), "v": cut("round_even(0.439e0*r - 0.368e0*g - 0.071e0*b, 0) + 128")},
      {"r": c8("1.164e0*(y_-16) - 0.002e0*(u-128) + 1.596e0*(v-128)"), "g": c8("1.164e0*(y_-16) - 0.391e0*(u-128) - 0.813e0*(v-128)"), "b": c8("1.164e0*(y_-16) + 2.018e0*(u-128) - 0.001e0*(v-128)")})
for bits, suffix in ((8, ""), (16, "16")):
    mid, top = 1 << (bits - 1), (1 << bits) - 1
    space(f"ycbcr{suffix}", lambda bits=bits: color.rgb_to_ycbcr(bits=bits), lambda bits=bits: color.ycbcr_to_rgb(bits=bits),
          {"y_": c8("0.299e0*r + 0.587e0*g + 0.114e0*b", top), "cb": c8(f"-0.16874e0*r - 0.33126e0*g + 0.5e0*b + {mid}", top), "cr": c8(f"0.5e0*r - 0.41869e0*g - 0.08131e0*b + {mid}", top)},
          {"r": c8(f"y_ + 1.402e0*(cr-{mid})", top), "g": c8(f"y_ - 0.34414e0*(cb-{mid}) - 0.71414e0*(cr-{mid})", top), "b": c8(f"y_ + 1.772e0*(cb-{mid})", top)}, bits == 16)
    space(f"cmy{suffix}", lambda bits=bits: {"c": color.rgb_to_cmy(bits=bits)["c"], "m": color.rgb_to_cmy(bits=bits)["m"], "y_": color.rgb_to_cmy(bits=bits)["y"]}, lambda bits=bits: color.cmy_to_rgb(bits=bits),
          {"c": f"{top} - r", "m": f"{top} - g", "y_": f"{top} - b"}, {"r": f"{top} - c", "g": f"{top} - m", "b": f"{top} - y_"}, bits == 16)
    k = f"least({top}-r, {top}-g, {top}-b)"
    space(f"cmyk{suffix}", lambda bits=bits: color.rgb_to_cmyk(bits=bits), lambda bits=bits: color.cmyk_to_rgb(bits=bits),
          {n: f"case when {k} = {top} then 0 else {c8(f'(({top}-{c}) - {k})::double / nullif({top} - {k}, 0) * {top}', top)} end" for n, c in zip(("c", "m", "y_"), "rgb")} | {"k": k},
          {c: f"{top} - ({n} - ({n}::bigint * k) // {top} + k)" for n, c in zip(("c", "m", "y_"), "rgb")}, bits == 16)
space("ycocg", color.rgb_to_ycocg, color.ycocg_to_rgb,
      {"y_": cut("trunc((r + 2*g + b + 2) / 4e0)"), "co": cut("trunc((2*r - 2*b + 2) / 4e0) + 128"), "cg": cut("trunc((-r + 2*g - b + 2) / 4e0) + 128")},
      {"r": cut("y_ + (co-128) - (cg-128)"), "g": cut("y_ + (cg-128)"), "b": cut("y_ - (co-128) - (cg-128)")})

# packed pixels
for name, bits in color.PACKED.items():
    parts, at, back = [], 0, {}
    for n, c in reversed(list(zip(bits, "argb"))):
        back[c] = f"(((pixel >> {at}) & {(1 << n) - 1}) * 255) // {(1 << n) - 1}" if n else "255"
        if n:
            parts.append(f"(({c} >> {8 - n}) << {at})")
            at += n
    packed = f"select image_id, x, y, {' + '.join(parts)} as pixel from p"
    add(f"pack_{name.lower()}", "rgba", lambda p, name=name: p.select(*XY, color.pack(name).alias("pixel")), packed, [*XY, "pixel"])
    add(f"unpack_{name.lower()}", "rgba", lambda p, name=name: p.select(*XY, color.pack(name).alias("pixel")).select(*XY, *(v.alias(k) for k, v in color.unpack(name).items())), f"select image_id, x, y, {', '.join(f'{back[c]} as {c}' for c in 'argb')} from ({packed})", XY + ARGB)
add("widen_narrow", "rgba", lambda p: p.select(*XY, color.widen("r").alias("r16"), color.widen("g", gray=True).alias("g16"), color.narrow(color.widen("r")).alias("r8"), color.narrow(color.widen("g", gray=True), gray=True).alias("g8")),
    "select image_id, x, y, r * 257 as r16, g * 256 as g16, r as r8, g as g8 from p", [*XY, "r16", "g16", "r8", "g8"])
add("float_round_trip", "rgba", lambda p: p.select(*XY, color.to_float("r").alias("f"), color.from_float(color.to_float("r")).alias("r")), "select image_id, x, y, r / 255e0 as f, r from p", [*XY, "r"], ["f"])
add("half_to_float", "rgba", lambda p: p.select(*XY, color.half_to_float(F.col("r") * 64 + F.col("g")).alias("f")),
    "select image_id, x, y, case when h >> 10 = 0 then (h & 1023) * power(2e0, -24) else power(2e0, (h >> 10) - 15) * (1 + (h & 1023) / 1024e0) end as f from (select *, r * 64 + g as h from p)", XY, ["f"])

# neighbourhoods
AROUND = "q.image_id = p.image_id and q.x = greatest(0, least(7, p.x + k.dx)) and q.y = greatest(0, least(7, p.y + k.dy))"
for name, (kernel, divisor, bias) in neighborhood.KERNELS.items():
    half = len(kernel) // 2
    values = ", ".join(f"({j - half}, {i - half}, {w})" for i, row in enumerate(kernel) for j, w in enumerate(row))
    one = c8(f"sum(k.w * q.g)::double / {divisor} + {bias!r}::double * 255")
    add(f"convolve_{name}", "gray", lambda p, name=name: neighborhood.filtered(p, name, ("g",)), f"select p.image_id, p.x, p.y, {one} as g from p cross join (values {values}) k(dx, dy, w) join p q on {AROUND} group by all", [*XY, "g"])
add("convolve_rgb", "rgba", lambda p: neighborhood.filtered(p, "gauss3"),
    "select p.image_id, p.x, p.y, p.a, " + each(c8("sum(k.w * q.{c})::double / 16")) + " from p cross join (values (-1,-1,1),(0,-1,2),(1,-1,1),(-1,0,2),(0,0,4),(1,0,2),(-1,1,1),(0,1,2),(1,1,1)) k(dx, dy, w) join p q on " + AROUND + " group by all", XY + ARGB)
SQUARE = {n: ", ".join(f"({x}, {y})" for y in range(-(n // 2), n // 2 + 1) for x in range(-(n // 2), n // 2 + 1)) for n in (3, 5)}
for n in (3, 5):
    source = f"from p cross join (values {SQUARE[n]}) k(dx, dy) join p q on {AROUND} group by all"
    add(f"min_{n}", "gray", lambda p, n=n: neighborhood.rank(p, "min", n, ("g",)), f"select p.image_id, p.x, p.y, min(q.g) as g {source}", [*XY, "g"])
    add(f"max_{n}", "gray", lambda p, n=n: neighborhood.rank(p, "max", n, ("g",)), f"select p.image_id, p.x, p.y, max(q.g) as g {source}", [*XY, "g"])
    add(f"median_{n}", "gray", lambda p, n=n: neighborhood.rank(p, "median", n, ("g",)), f"select p.image_id, p.x, p.y, list_sort(list(q.g))[{n * n // 2 + 1}] as g {source}", [*XY, "g"])
light = "0.0e0 + q.r * 0.299e0 + q.g * 0.587e0 + q.b * 0.114e0"
for which, sign in (("min", ""), ("max", "-")):
    add(f"{which}_rgb", "rgba", lambda p, which=which: neighborhood.rank(p, which, 3),
        f"select image_id, x, y, a, m.r as r, m.g as g, m.b as b from (select p.image_id, p.x, p.y, p.a, min({{'l': {sign}({light}), 'i': k.i, 'r': q.r, 'g': q.g, 'b': q.b}}) as m from p cross join (values "
        + ", ".join(f"({x}, {y}, {(y + 1) * 3 + x + 1})" for y in (-1, 0, 1) for x in (-1, 0, 1)) + f") k(dx, dy, i) join p q on {AROUND} group by p.image_id, p.x, p.y, p.a)", XY + ARGB)
CROSS, CELLS = [[0, 1, 0], [1, 1, 1], [0, 1, 0]], "(values (0,-1),(-1,0),(0,0),(1,0),(0,1)) k(dx, dy)"
BLACK = "(select image_id, x, y, case when g >= 128 then 255 else 0 end as g from p)"


def morph(source: str, erode: bool) -> str:
    return f"(select p.image_id, p.x, p.y, case when {'min' if erode else 'max'}(q.g) > 0 then 255 else 0 end as g from {source} p cross join {CELLS} join {source} q on {AROUND} group by p.image_id, p.x, p.y)"


black = lambda p: p.withColumn("g", F.when(F.col("g") >= 128, 255).otherwise(0))
add("erode", "gray", lambda p: neighborhood.morphology(black(p), CROSS, True), f"from {morph(BLACK, True)}", [*XY, "g"])
add("dilate", "gray", lambda p: neighborhood.morphology(black(p), CROSS, False), f"from {morph(BLACK, False)}", [*XY, "g"])
add("open", "gray", lambda p: neighborhood.opened(black(p), CROSS), f"from {morph(morph(BLACK, True), False)}", [*XY, "g"])
add("close", "gray", lambda p: neighborhood.closed(black(p), CROSS), f"from {morph(morph(BLACK, False), True)}", [*XY, "g"])

# aggregates
HIST = " union all ".join(f"select image_id, '{i}' as c, {e} as bin from p" for i, e in (("1", "r"), ("2", "g"), ("3", "b"), ("4", "a"), ("5", c8("0.299e0*r + 0.587e0*g + 0.114e0*b"))))
number = lambda: F.when(F.col("channel") == "r", 1).when(F.col("channel") == "g", 2).when(F.col("channel") == "b", 3).when(F.col("channel") == "a", 4).otherwise(5)
add("histogram", "rgba", lambda p: analysis.histogram(p).withColumn("c", number()), f"select image_id, c, bin, count(*) as n from ({HIST}) group by all", ["image_id", "c", "bin", "n"])
OTSU = """select image_id, coalesce(min(case when v > 0 and v = best then i end), 0) as level from (
  select *, max(v) over (partition by image_id) as best from (
    select image_id, i, case when w > 0 and w < total then round((s1 * w - s * total)::double * (s1 * w - s * total)::double / (w * (total - w))::double, 6) else 0 end as v from (
      select t.image_id, t.total, t.s1, i, (select coalesce(sum(n), 0) from h where h.image_id = t.image_id and h.g < i) as w, (select coalesce(sum((g + 1) * n), 0) from h where h.image_id = t.image_id and h.g < i) as s
      from (select image_id, sum(n) as total, sum((g + 1) * n) as s1 from h group by image_id) t cross join range(256) r(i)))) group by image_id"""
H = "with h as (select image_id, g, count(*) as n from p group by all) "
add("otsu_level", "gray", analysis.otsu, H + OTSU, ["image_id", "level"])
add("otsu_binarize", "gray", lambda p: analysis.binarize(p, analysis.otsu(p)), f"select image_id, x, y, case when g >= level then 255 else 0 end as g from p join ({H}{OTSU}) using (image_id)", [*XY, "g"])
METRIC = "select image_id, mae, pae, mse, sqrt(mse) as rmse, case when sqrt(mse) < 0.0001e0 then 1e6 else 20 * log10(255 / sqrt(mse)) end as psnr from (select p.image_id, sum(d.s) / (count(*) * 4e0) as mae, max(d.m) as pae, sum(d.q) / (count(*) * 4e0) as mse from p join {} using (image_id, x, y), lateral (select {} as s, {} as q, greatest({}) as m) d group by p.image_id)"
GAP = [f"abs(p.{c} - o.{c})" for c in ARGB]
add("error_metrics", "rgba", lambda p: analysis.error_metrics(p, geometry.flip(p, **S8)), METRIC.format("(select image_id, x, 7 - y as y, a, r, g, b from p) o", " + ".join(GAP), " + ".join(f"{g} * {g}" for g in GAP), ", ".join(GAP)), ["image_id"], ["mae", "pae", "mse", "rmse", "psnr"])
add("distinct_colors", "doc", analysis.distinct_colors, "select image_id, count(*) as n_colors from (select distinct image_id, a, r, g, b from p) group by image_id", ["image_id", "n_colors"])
add("skew_angle", "gray", lambda p: analysis.skew_angle(p, 10), """select image_id, sum(i) / count(*)::double * 0.1e0 - 10 as angle from (
  select image_id, i, d, row_number() over (partition by image_id order by count(*) desc, i, d) as k from (
    select image_id, i, floor(round(y * cos(radians(i * 0.1e0 - 10)) - x * sin(radians(i * 0.1e0 - 10)), 6)) as d from (
      select *, lead(g) over (partition by image_id, x order by y) as u from p) cross join range(201) t(i) where g < 128 and coalesce(u, 255) >= 128) group by image_id, i, d) where k <= 20 group by image_id""", ["image_id"], ["angle"])

# resizing
SQL_FILTERS = {
    "nearest": "case when t > -0.5e0 and t <= 0.5e0 then 1e0 else 0e0 end", "linear": "greatest(0e0, 1 - abs(t))", "cosine": "case when abs(t) < 1 then (cos(pi() * t) + 1) / 2 else 0e0 end",
    "hermite": "case when abs(t) < 1 then (2 * abs(t) - 3) * t * t + 1 else 0e0 end", "quadratic": "case when abs(t) < 0.5e0 then 0.75e0 - t * t when abs(t) < 1.5e0 then power(abs(t) - 1.5e0, 2) / 2 else 0e0 end",
    "gaussian": "exp(-2 * t * t) * sqrt(2 / pi())", "spline": "case when abs(t) < 1 then power(abs(t), 3) / 2 - t * t + 2e0 / 3 when abs(t) < 2 then power(2 - abs(t), 3) / 6 else 0e0 end",
    "lanczos": "case when abs(t) >= 3 then 0e0 when t = 0 then 1e0 else sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) end",
    "mitchell": "case when abs(t) < 1 then (7 * power(abs(t), 3) - 12 * t * t + 16e0 / 3) / 6 when abs(t) < 2 then (-7e0 / 3 * power(abs(t), 3) + 12 * t * t - 20 * abs(t) + 32e0 / 3) / 6 else 0e0 end",
    "catmullrom": "case when abs(t) < 1 then (2 + t * t * (3 * abs(t) - 5)) / 2 when abs(t) < 2 then (4 + abs(t) * (-8 + abs(t) * (5 - abs(t)))) / 2 else 0e0 end",
}


def weight_sql(src: int, dst: int, kind: str) -> str:
    shrink, radius = f"least(1e0, {dst} / {src}e0)", resample.FILTERS[kind][1]
    return f"""(select i, greatest(0, least({src - 1}, j)) as j, w from (select i, j, ({SQL_FILTERS[kind]}) * {shrink} as w from (
      select i, j, (c - j) * {shrink} as t from (select i, -0.5e0 + (i + 0.5e0) * {src} / {dst} as c from range({dst}) a(i)) cross join range(-40, {src + 40}) b(j)
      where j between floor(c - {radius} / {shrink}) and ceil(c + {radius} / {shrink}))) where w <> 0)"""


def resized_sql(source: str, size: tuple[int, int], to: tuple[int, int], kind: str, channels: str) -> str:
    down = f"(select image_id, x, v.i as y, {each('round(sum({c} * w), 9)', channels)} from {source} s join {weight_sql(size[1], to[1], kind)} v on s.y = v.j group by image_id, x, v.i)"
    return f"(select image_id, v.i as x, y, {each(c8('round(sum({c} * w), 6)'), channels)} from {down} s join {weight_sql(size[0], to[0], kind)} v on s.x = v.j group by image_id, v.i, y)"


for kind in resample.FILTERS:
    add(f"resample_{kind}", "gray", lambda p, kind=kind: resample.resample(p, (8, 8), (13, 5), kind, ("g",)), "from " + resized_sql("p", (8, 8), (13, 5), kind, "g"), [*XY, "g"])
for how, kind in resample.RESIZE.items():
    add(f"resize_{how}", "rgba", lambda p, how=how: resample.resize(p, (8, 8), (12, 12), how), "from " + resized_sql("p", (8, 8), (12, 12), kind, "argb"), XY + ARGB)


def nearest_sql(size: tuple[int, int], to: tuple[int, int]) -> str:
    place = lambda n, src, dst: f"(select i, (i * (({src} << 16) // {dst})) >> 16 as j from range({dst}) t(i)) {n}"
    return f"select image_id, u.i as x, v.i as y, a, r, g, b from p join {place('u', size[0], to[0])} on p.x = u.j join {place('v', size[1], to[1])} on p.y = v.j"


add("resize_nearest", "rgba", lambda p: resample.resize(p, (8, 8), (13, 6), "nearest"), nearest_sql((8, 8), (13, 6)), XY + ARGB)
add("resize_to_fit", "rgba", lambda p: resample.resize_to_fit(p, (8, 8), (20, 6), "bilinear"), "from " + resized_sql("p", (8, 8), (6, 6), "linear", "argb"), XY + ARGB)
LEVELS = [f"select *, {i} as level from {resized_sql('p', (8, 8), (8 >> i, 8 >> i), 'linear', 'argb')}" for i in (1, 2, 3)]
add("mipmaps", "rgba", lambda p: resample.mipmaps(p, (8, 8)), "select image_id, x, y, a, r, g, b, 0 as level from p union all by name " + " union all by name ".join(LEVELS), [*XY, "level", *ARGB])
add("stretch_rect", "rgba", lambda p: resample.stretch_rect(p, p, (0, 0, 4, 4), (1, 2, 6, 6), "bilinear"),
    "select p.image_id, p.x, p.y, " + each("coalesce(s.{c}, p.{c})", "argb") + " from p left join " + resized_sql("(select * from p where x < 4 and y < 4)", (4, 4), (6, 6), "linear", "argb") + " s on s.image_id = p.image_id and s.x = p.x - 1 and s.y = p.y - 2", XY + ARGB)

# palettes
add("palette_gray", "palette", lambda p: palette.gray_palette(p.sparkSession), "select i as idx, 255 as a, i as r, i as g, i as b from range(256) t(i)", ["idx", *ARGB])
add("palette_custom_332", "palette", lambda p: palette.custom_palette(p.sparkSession, (3, 3, 2)), "select i as idx, 255 as a, ((i >> 4) & 7) * 255 // 7 as r, ((i >> 1) & 7) * 255 // 7 as g, (i & 3) * 255 // 3 as b from range(256) t(i)", ["idx", *ARGB])
add("map_to_palette", "rgba", palette.map_to_palette,
    "select image_id, x, y, m.idx as idx from (select p.image_id, p.x, p.y, min({'d': " + " + ".join(f"abs(p.{c} - q.{c})" for c in ARGB) + ", 'idx': q.idx}) as m from p cross join q group by all)", [*XY, "idx"], second="palette")
add("palette_has_alpha", "palette", lambda p: palette.has_alpha(p), "select max(a <> 255)::int as has_alpha from p", ["has_alpha"])
add("palette_is_gray", "palette", lambda p: palette.is_gray(p), "select min(r = g and g = b)::int as is_gray from p", ["is_gray"])
add("palette_swap", "palette", lambda p: geometry.swap_channels(p, "r", "b"), "select idx, a, b as r, g, r as b from p", ["idx", *ARGB])
add("median_cut", "rgba", lambda p: palette.palettes(p, 16), None, ["image_id", "idx", *ARGB])
add("reduce_colors", "rgba", lambda p: palette.reduce_colors(p, 8), None, XY + ARGB)

# compositing: the image shifted over its mirror image
LAID = " from (select image_id, 7 - x as x, y, a, r, g, b from p) d left join (select image_id, x + 2 as x, y - 1 as y, a / 255e0 as a, r / 255e0 as r, g / 255e0 as g, b / 255e0 as b from p) s using (image_id, x, y)"


def laid_sql(f: dict[str, str]) -> str:
    return "select image_id, x, y, " + ", ".join(f"case when s.a is null then d.{c} else {c8(f'round(({e}) * 255, 9)')} end as {c}" for c, e in f.items()) + LAID


AT = (2, -1)
da = "d.a / 255e0"
share = f"coalesce(s.a / nullif(s.a + {da} - s.a * ({da}), 0), 0)"
add("draw_alpha", "rgba", lambda p: compose.over(p, geometry.mirror(p, **S8), AT), laid_sql({"a": f"s.a + {da} - s.a * ({da})"} | {c: f"s.{c} * {share} + d.{c} / 255e0 * (1 - {share})" for c in RGB}), XY + ARGB)
add("draw_add", "rgba", lambda p: compose.add(p, geometry.mirror(p, **S8), AT), laid_sql({c: f"s.{c} + d.{c} / 255e0" for c in ARGB}), XY + ARGB)
FACTOR = {"zero": "0", "one": "1", "src_alpha": "s.a", "one_minus_src_alpha": "(1 - s.a)", "dst_alpha": f"({da})", "one_minus_dst_alpha": f"(1 - {da})", "src_color": "s.{c}", "one_minus_src_color": "(1 - s.{c})", "dst_color": "(d.{c} / 255e0)", "one_minus_dst_color": "(1 - d.{c} / 255e0)"}
for s, d in (("one", "zero"), ("zero", "src_color"), ("src_alpha", "one_minus_src_alpha"), ("dst_alpha", "one"), ("one_minus_dst_alpha", "dst_alpha"), ("dst_color", "one_minus_src_color"), ("one_minus_dst_color", "one")):
    add(f"draw_blend_{s}_{d}", "rgba", lambda p, s=s, d=d: compose.blend(p, geometry.mirror(p, **S8), s, d, AT), laid_sql({c: f"s.{c} * {FACTOR[s].format(c=c)} + d.{c} / 255e0 * {FACTOR[d].format(c=c)}" for c in ARGB}), XY + ARGB)

FAST = "(select *, sa + 1 + ((a * (256 - sa)) >> 8) as total from (select d.image_id, d.x, d.y, d.a, d.r, d.g, d.b, s.a as sa, s.r as sr, s.g as sg, s.b as sb from (select image_id, 7 - x as x, y, a, r, g, b from p) d left join (select image_id, x + 2 as x, y - 1 as y, a, r, g, b from p) s using (image_id, x, y)))"
add("draw_alpha_fast", "rgba", lambda p: compose.over_fast(p, geometry.mirror(p, **S8), AT), "select image_id, x, y, case when sa is null then a else least(255, total) end as a, "
    + ", ".join(f"case when sa is null then {c} else (s{c} * ((sa * 256) // total) + {c} * (256 - (sa * 256) // total)) >> 8 end as {c}" for c in RGB) + f" from {FAST}", XY + ARGB)


over_table("text_helpers", "part", lambda t: t.select(
    "p_partkey", helpers.mask_match("p_name", "*a?e*").alias("m1"), helpers.mask_match("p_name", "").alias("m2"), helpers.mask_match("p_brand", "brand#1*", True).alias("m3"), helpers.position("p_name", "E", 2, False).alias("place"),
    helpers.contains_any("p_type", ["STEEL", "TIN"]).alias("has_any"), F.size(helpers.tokens("p_type", " ")).alias("n"), helpers.substring("p_name", 2, 5).alias("part"), helpers.trim_set("p_name", "aeiou").alias("trimmed"),
    helpers.thousands(F.col("p_partkey") * 1000).alias("number"), helpers.file_extension(F.concat(F.lit("dir/sub/"), "p_name", F.lit(".tar.gz"))).alias("ext"), helpers.file_name(F.concat(F.lit("dir/sub/"), F.col("p_partkey").cast("string"))).alias("base"), helpers.file_folder(F.concat(F.lit("dir/sub/"), F.col("p_partkey").cast("string"))).alias("folder")),
    """select p_partkey, regexp_matches(p_name, 'a.e', 'i') as m1, true as m2, p_brand like 'brand#1%' as m3, case when strpos(substr(lower(p_name), 2), 'e') > 0 then strpos(substr(lower(p_name), 2), 'e') + 1 else 0 end as place,
    contains(p_type, 'STEEL') or contains(p_type, 'TIN') as has_any, len(string_split(p_type, ' ')) as n, substr(p_name, 2, 3) as part, trim(p_name, 'aeiou') as trimmed, format('{:,}', p_partkey * 1000) as number, 'gz' as ext, p_partkey::varchar as base, 'dir/sub/' as folder from part""",
    ["p_partkey", "m1", "m2", "m3", "place", "has_any", "n"], texts=["part", "trimmed", "number", "ext", "base", "folder"])
over_table("number_helpers", "part", lambda t: t.where("p_partkey > 0").select(
    "p_partkey", helpers.clamp("p_size", 10, 40).alias("clamped"), helpers.is_power_of_two("p_partkey").alias("is2"), helpers.next_power_of_two("p_partkey").alias("next2"), helpers.floor_log2("p_partkey").alias("log"), helpers.mul_div("p_partkey", F.lit(255), F.lit(7)).alias("md"),
    helpers.swap_bytes("p_partkey", 2).alias("s2"), helpers.swap_bytes("p_partkey", 4).alias("s4"), helpers.mip_levels("p_partkey", "p_size").alias("mips"), helpers.volume_slices(F.col("p_size").cast("int"), 4).alias("slices"), helpers.same("p_retailprice", F.round("p_retailprice", 3), 0.01).alias("same"), helpers.pixel_size_to_dpi("p_size").alias("dpi")),
    """select p_partkey, greatest(10, least(40, p_size)) as clamped, bit_count(p_partkey) = 1 as is2, power(2, ceil(log2(p_partkey))) as next2, floor(log2(p_partkey)) as log, p_partkey * 255 // 7 as md,
    ((p_partkey & 255) << 8) + ((p_partkey >> 8) & 255) as s2, ((p_partkey & 255) << 24) + (((p_partkey >> 8) & 255) << 16) + (((p_partkey >> 16) & 255) << 8) + ((p_partkey >> 24) & 255) as s4,
    floor(log2(greatest(p_partkey, p_size))) + 1 as mips, p_size + greatest(1, p_size >> 1) + greatest(1, p_size >> 2) + greatest(1, p_size >> 3) as slices, true as same, 25400e0 / p_size as dpi from part where p_partkey > 0""",
    ["p_partkey", "clamped", "is2", "next2", "log", "md", "s2", "s4", "mips", "slices", "same"], ["dpi"])


def rects(t: DataFrame) -> DataFrame:
    r, by = (F.col("event_id") % 50, F.col("user_id") % 40, F.col("event_id") % 70, F.col("user_id") % 90), (F.lit(10), F.lit(10), F.lit(45), F.lit(60))
    n = helpers.normalised(r)
    c, s = helpers.clipped(n, by), helpers.scaled_into(F.col("event_id") % 50 + 1, F.col("user_id") % 40 + 1, F.lit(64), F.lit(48))
    return t.select("event_id", *(v.alias(k) for k, v in zip(("n1", "n2", "n3", "n4", "c1", "c2", "c3", "c4"), (*n, *c))), helpers.within(n, by).alias("inside"), helpers.touches(n, by).alias("touch"), s[0].alias("w"), s[1].alias("h"))


over_table("rect_helpers", "events", rects, """select event_id, n1, n2, n3, n4, greatest(n1, 10) as c1, greatest(n2, 10) as c2, greatest(n1, 10, least(n3, 45)) as c3, greatest(n2, 10, least(n4, 60)) as c4,
    n1 >= 10 and n2 >= 10 and n3 <= 45 and n4 <= 60 as inside, n1 <= 45 and n3 >= 10 and n2 <= 60 and n4 >= 10 as touch,
    case when 64 * b < 48 * a then 64 else (48 * a) // b end as w, case when 64 * b < 48 * a then (64 * b) // a else 48 end as h
    from (select event_id, least(event_id % 50, event_id % 70) as n1, least(user_id % 40, user_id % 90) as n2, greatest(event_id % 50, event_id % 70) as n3, greatest(user_id % 40, user_id % 90) as n4, event_id % 50 + 1 as a, user_id % 40 + 1 as b from events)""",
    ["event_id", "n1", "n2", "n3", "n4", "c1", "c2", "c3", "c4", "inside", "touch", "w", "h"])
SIZES = ", ".join(f"('{n}', '{k}', {b})" for n, k, b, _, _ in model.FORMATS)
over_table("format_sizes", "nation", lambda t: model.pixels_size(model.formats(t.sparkSession).crossJoin(t.select((F.col("n_nationkey") + 1).alias("width"), (F.col("n_nationkey") * 3 + 2).alias("height")))).withColumnRenamed("size", "n"),
    f"select f as name, width, height, case k when 'block' then ((width + 3) // 4) * ((height + 3) // 4) * b when 'bits' then ((width + 7) // 8) * height else width * height * b end as n from (values {SIZES}) v(f, k, b) cross join (select n_nationkey + 1 as width, n_nationkey * 3 + 2 as height from nation)", ["width", "height", "n"], texts=["name"])

# frames
FRAMES = "(select image_id // 5 as image_id, image_id % 5 as frame_idx, x, y, g from p)"
FR = ["image_id", "frame_idx", "x", "y", "g"]


def framed(p: DataFrame) -> DataFrame:
    return p.select(F.floor(F.col("image_id") / 5).alias("image_id"), (F.col("image_id") % 5).alias("frame_idx"), "x", "y", "g")


add("frames_reverse", "gray", lambda p: frames.reverse(framed(p)), f"select f.image_id, n - f.frame_idx as frame_idx, x, y, g from {FRAMES} f join (select image_id, max(frame_idx) as n from {FRAMES} group by image_id) using (image_id)", FR)
add("frames_delete", "gray", lambda p: frames.delete(framed(p), 2), f"select image_id, case when frame_idx > 2 then frame_idx - 1 else frame_idx end as frame_idx, x, y, g from {FRAMES} where frame_idx <> 2", FR)
add("frames_insert", "gray", lambda p: frames.insert(framed(p), 1, framed(p).where("frame_idx = 0").withColumn("g", 255 - F.col("g"))),
    f"select image_id, case when frame_idx >= 1 then frame_idx + 1 else frame_idx end as frame_idx, x, y, g from {FRAMES} union all select image_id, 1, x, y, 255 - g from {FRAMES} where frame_idx = 0", FR)
add("frames_exchange", "gray", lambda p: frames.exchange(framed(p), 1, 3), f"select image_id, case frame_idx when 1 then 3 when 3 then 1 else frame_idx end as frame_idx, x, y, g from {FRAMES}", FR)
add("frames_count", "gray", lambda p: frames.counts(framed(p)), f"select image_id, max(frame_idx) + 1 as n_frames from {FRAMES} group by image_id", ["image_id", "n_frames"])


# blocks
BTC = "select image_id, bx, by_, case when n > 0 then u // n else 0 end as high, l // (16 - n) as low, mask from (select image_id, bx, by_, cast(sum(case when g > m then g else 0 end) as bigint) as u, cast(sum(case when g <= m then g else 0 end) as bigint) as l, cast(sum((g > m)::int) as bigint) as n, cast(sum(case when g > m then 1::bigint << k else 0 end) as bigint) as mask from (select image_id, x // 4 as bx, y // 4 as by_, (y % 4) * 4 + x % 4 as k, g, sum(g) over (partition by image_id, x // 4, y // 4) // 16 as m from p) group by image_id, bx, by_)"
add("btc_encode", "gray", lambda p: blocks.btc_encode(p).withColumnsRenamed({"upper": "high", "lower": "low", "by": "by_"}), f"from ({BTC})", ["image_id", "bx", "by_", "high", "low", "mask"])
add("btc_decode", "gray", lambda p: blocks.btc_decode(blocks.btc_encode(p)), f"select image_id, bx * 4 + k % 4 as x, by_ * 4 + k // 4 as y, case when (mask >> k) & 1 = 1 then high else low end as g from ({BTC}) cross join range(16) t(k)", [*XY, "g"])
add("binary_pack", "gray", blocks.binary_pack, "select image_id, y, x // 8 as byte, sum(case when g > 128 then 1 << (7 - x % 8)::int else 0 end) as bits from p group by image_id, y, x // 8", ["image_id", "y", "byte", "bits"])
add("binary_unpack", "gray", lambda p: blocks.binary_unpack(blocks.binary_pack(p)), "select image_id, x, y, case when g > 128 then 255 else 0 end as g from p", [*XY, "g"])


def through(kind: str) -> Callable:
    from tessella.sources import images

    def run(p: DataFrame) -> DataFrame:
        packed = images.from_pixels(p)
        return images.to_pixels_fast(blocks.decompress(blocks.compress(packed, kind), kind), ["image_id"])

    return run


for kind in blocks.FORMATS:
    add(f"block_{kind.lower()}", "rgba", through(kind), block_sql(kind), XY + ARGB)

# stretched, then drawn over the mirror image: the upper left quarter over 6 x 6 pixels from (1, 2) on
PART = resized_sql("(select * from p where x < 4 and y < 4)", (4, 4), (6, 6), "linear", "argb")
MIRRORED = "(select image_id, 7 - x as x, y, a, r, g, b from p)"
STRETCHED = f" from {MIRRORED} d left join (select image_id, x + 1 as x, y + 2 as y, a / 255e0 as a, r / 255e0 as r, g / 255e0 as g, b / 255e0 as b from {PART}) s using (image_id, x, y)"


def stretched_sql(f: dict[str, str]) -> str:
    return laid_sql(f).replace(LAID, STRETCHED)


def stretched(draw: Callable, **more) -> Callable:
    return lambda p: compose.stretched(p, geometry.mirror(p, **S8), (0, 0, 4, 4), (1, 2, 6, 6), "bilinear", draw, **more)


add("stretch_draw_alpha", "rgba", stretched(compose.over), stretched_sql({"a": f"s.a + {da} - s.a * ({da})"} | {c: f"s.{c} * {share} + d.{c} / 255e0 * (1 - {share})" for c in RGB}), XY + ARGB)
add("stretch_draw_add", "rgba", stretched(compose.add), stretched_sql({c: f"s.{c} + d.{c} / 255e0" for c in ARGB}), XY + ARGB)
add("stretch_draw_blend", "rgba", stretched(compose.blend, src="src_alpha", dst="one_minus_src_alpha"),
    stretched_sql({c: f"s.{c} * {FACTOR['src_alpha']} + d.{c} / 255e0 * {FACTOR['one_minus_src_alpha']}" for c in ARGB}), XY + ARGB)
add("stretch_draw_alpha_fast", "rgba", stretched(compose.over_fast), "select image_id, x, y, case when sa is null then a else least(255, total) end as a, "
    + ", ".join(f"case when sa is null then {c} else (s{c} * ((sa * 256) // total) + {c} * (256 - (sa * 256) // total)) >> 8 end as {c}" for c in RGB)
    + f" from (select *, sa + 1 + ((a * (256 - sa)) >> 8) as total from (select d.image_id, d.x, d.y, d.a, d.r, d.g, d.b, s.a as sa, s.r as sr, s.g as sg, s.b as sb from {MIRRORED} d left join (select image_id, x + 1 as x, y + 2 as y, a, r, g, b from {PART}) s using (image_id, x, y)))", XY + ARGB)

# drawing
RED, GREEN = {"a": 255, "r": 255, "g": 0, "b": 0}, {"a": 255, "r": 0, "g": 200, "b": 10}


def paint_sql(where: str, color: dict[str, int], source: str = "p") -> str:
    return "(select image_id, x, y, " + ", ".join(f"case when {where} then {color[c]} else {c} end as {c}" for c in ARGB) + f" from {source})"


add("draw_line", "events", lambda p: drawing.line(p, 5, 2, 90, 8, RED), "from " + paint_sql("x between 5 and 90 and y = 2 + (2 * 6 * (x - 5) + 85) // 170", RED), XY + ARGB)
add("draw_line_steep", "rgba", lambda p: drawing.line(p, 6, 0, 2, 7, RED, 2), "from " + paint_sql("y between 0 and 7 and (x = 6 - (2 * 4 * y + 7) // 14 or x = 7 - (2 * 4 * y + 7) // 14)", RED), XY + ARGB)
add("draw_frame_rect", "events", lambda p: drawing.frame_rect(p, 3, 1, 40, 8, RED), "from " + paint_sql("x between 3 and 42 and y between 1 and 8 and (x in (3, 42) or y in (1, 8))", RED), XY + ARGB)
add("draw_rectangle", "events", lambda p: drawing.rectangle(p, 3, 1, 40, 8, GREEN, RED), "from " + paint_sql("x between 3 and 42 and y between 1 and 8 and (x in (3, 42) or y in (1, 8))", RED, paint_sql("x between 3 and 42 and y between 1 and 8", GREEN)), XY + ARGB)
add("draw_ellipse", "events", lambda p: drawing.ellipse(p, 10, 1, 41, 7, GREEN), "from " + paint_sql("power((x - 30) / 20.5e0, 2) + power((y - 4) / 3.5e0, 2) <= 1", GREEN), XY + ARGB)
HALF = "case when x between 2 and 6 and y between 1 and 5 then {} else {} end as {}"
add("fill_rect_blend", "rgba", lambda p: drawing.fill_rect_blend(p, 2, 1, 5, 5, {"a": 100, "r": 250, "g": 20, "b": 90}),
    "select image_id, x, y, " + HALF.format(c8("round((100 / 255e0 + a / 255e0 - 100 / 255e0 * (a / 255e0)) * 255, 9)"), "a", "a") + ", "
    + ", ".join(HALF.format(c8(f"round(({v} / 255e0 * (100 / 255e0) + {c} / 255e0 * (1 - 100 / 255e0)) * 255, 9)"), c, c) for c, v in zip("rgb", (250, 20, 90))) + " from p", XY + ARGB)
add("rotate_any", "rgba", lambda p: drawing.rotate(p, 30.0), None, XY + ARGB)
add("rotate_any_quarter", "rgba", lambda p: drawing.rotate(p, 90.0), "select image_id, y as x, 7 - x as y, a, r, g, b from p", XY + ARGB)


assert formats_catalog  # registers its queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
