"""Column functions for names, numbers, rectangles and texture sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.color import col


def mask_match(subject, mask: str, case_sensitive: bool = False) -> Column:
    """`*` and `?` wildcards; an empty mask matches everything."""
    if not mask:
        return F.lit(True)
    pattern = "".join(".*" if c == "*" else "." if c == "?" else f"\\Q{c}\\E" for c in mask)
    return col(subject).rlike(f"(?s{'' if case_sensitive else 'iu'})^{pattern}$")


def position(text, part: str, start: int = 1, case_sensitive: bool = True) -> Column:
    """Place of the first occurrence from `start` on, counted from 1; 0 if there is none."""
    t = col(text) if case_sensitive else F.lower(col(text))
    return F.locate(part if case_sensitive else part.lower(), t, start)


def tokens(text, mark: str) -> Column:
    """The parts between marks, without an empty one at the end."""
    parts = F.split(col(text), f"\\Q{mark}\\E", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def contains_any(text, parts: list[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | col(text).contains(p)
    return found


def substring(text, start: int, end: int) -> Column:
    """From `start` up to before `end`, counted from 1."""
    return F.substring(col(text), start, max(0, end - start))


def trim_set(text, chars: str, right: bool = True) -> Column:
    return (F.btrim if right else F.ltrim)(col(text), F.lit(chars))


def thousands(number, places: int = 0) -> Column:
    return F.format_number(col(number), places)


def file_name(path) -> Column:
    return F.regexp_extract(col(path), r"([^/\\]*)$", 1)


def file_extension(path) -> Column:
    return F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)


def file_folder(path) -> Column:
    return F.regexp_extract(col(path), r"^(.*[/\\])?[^/\\]*$", 1)


def clamp(x, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(x)))


def is_power_of_two(n) -> Column:
    return (col(n) > 0) & (F.bit_count(col(n)) == 1)


def next_power_of_two(n) -> Column:
    """The smallest power that isn't smaller; 1 at least."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(col(n), F.lit(1))))).cast("long")


def floor_log2(n) -> Column:
    return (F.length(F.bin(col(n).cast("long"))) - 1).cast("int")


def mul_div(a, b, c) -> Column:
    return F.floor(col(a).cast("long") * col(b).cast("long") / col(c)).cast("long")


def same(a, b, delta: float = 1e-4) -> Column:
    return F.abs(col(a) - col(b)) <= delta


def swap_bytes(n, size: int) -> Column:
    """Bytes of an unsigned number of 2 or 4 bytes in the other order."""
    out = F.lit(0).cast("long")
    for k in range(size):
        out = out + F.shiftleft(F.shiftright(col(n).cast("long"), 8 * k).bitwiseAND(255), 8 * (size - 1 - k))
    return out


def checksum(data) -> Column:
    return F.crc32(col(data).cast("binary"))


def mip_levels(width, height) -> Column:
    """How many levels there are down to one pixel."""
    return floor_log2(F.greatest(col(width), col(height))) + 1


def volume_slices(depth, levels: int) -> Column:
    """Slices of all levels of a volume."""
    return sum((F.greatest(F.lit(1), F.shiftright(col(depth), i)) for i in range(1, levels)), col(depth))


def pixel_size_to_dpi(size) -> Column:
    """Micrometres to dots per inch, and back by the same."""
    return 25400.0 / col(size)


Rect = tuple  # left, top, right, bottom: columns or names


def normalised(r: Rect) -> tuple[Column, ...]:
    a, b, c, d = map(col, r)
    return F.least(a, c), F.least(b, d), F.greatest(a, c), F.greatest(b, d)


def clipped(r: Rect, by: Rect) -> tuple[Column, ...]:
    """The common part; empty where there is none."""
    a, b, c, d = map(col, r)
    e, f, g, h = map(col, by)
    left, top = F.greatest(a, e), F.greatest(b, f)
    return left, top, F.greatest(left, F.least(c, g)), F.greatest(top, F.least(d, h))


def within(r: Rect, by: Rect) -> Column:
    a, b, c, d = map(col, r)
    e, f, g, h = map(col, by)
    return (a >= e) & (b >= f) & (c <= g) & (d <= h)


def touches(r: Rect, by: Rect) -> Column:
    """Whether they share a point; edges count."""
    a, b, c, d = map(col, r)
    e, f, g, h = map(col, by)
    return (a <= g) & (c >= e) & (b <= h) & (d >= f)


def scaled_into(width, height, box_width, box_height) -> tuple[Column, Column]:
    """The largest size of the same proportions in a box, rounded down."""
    w, h, bw, bh = map(col, (width, height, box_width, box_height))
    wide = bw * h < bh * w
    return F.when(wide, bw).otherwise(F.floor(bh * w / h)), F.when(wide, F.floor(bw * h / w)).otherwise(bh)


def dpi_to_pixel_size(dpi) -> Column:
    """Dots per inch to micrometres."""
    return 1e3 / (col(dpi) / 25.4)


def left_trimmed(text, chars: str) -> Column:
    return F.ltrim(col(text), F.lit(chars))


def decimals(number, places: int) -> Column:
    """With thousands separators and a fixed number of decimals."""
    return F.format_number(col(number).cast("double"), places)


def first_token(text, separator: str) -> tuple[Column, Column]:
    """(first token, what is left); without a separator the whole text and nothing."""
    t = col(text)
    found = F.instr(t, separator) > 0
    return F.substring_index(t, separator, 1), F.when(found, F.substr(t, F.instr(t, separator) + 1)).otherwise("")


def last_token(text, separator: str) -> tuple[Column, Column]:
    """(last token, what is left); without a separator the whole text and nothing."""
    t = col(text)
    last = F.substring_index(t, separator, -1)
    return last, F.when(F.instr(t, separator) > 0, F.substr(t, F.lit(1), F.length(t) - F.length(last) - 1)).otherwise("")


def copy_bounds(src: tuple, size: tuple, to: tuple, limits: tuple, by: Rect) -> dict[str, Column]:
    """src_x, src_y, width, height, dst_x, dst_y of a copy clipped to a rectangle of the target, then to the source's limits (width,
    height). A width or height below 1 means that nothing is left. A target place below 0 isn't counted against a source place
    that is still below 0."""
    (sx, sy), (w, h), (dx, dy), (lw, lh), (left, top, right, bottom) = (tuple(map(col, t)) for t in (src, size, to, limits, by))
    out = {}
    for n, s, length, d, limit, low, high in (("x", sx, w, dx, lw, left, right), ("y", sy, h, dy, lh, top, bottom)):
        front, below = F.greatest(F.lit(0), low - d), F.least(F.lit(0), d)
        s, d, length = s + front, d + front, length - front
        lacking = F.when(s < 0, s - below).otherwise(0)
        s, d, length = F.greatest(F.lit(0), s), d - lacking, length + lacking
        length = F.least(length, limit - s)
        out |= {f"src_{n}": s, f"dst_{n}": d, "width" if n == "x" else "height": F.least(length, high - d)}
    return out


def stretch_bounds(src: tuple, size: tuple, to: tuple, to_size: tuple, limits: tuple, by: Rect) -> dict[str, Column]:
    """src_x, src_width, dst_x, dst_width and the same down of a copy that stretches: what is cut off one side is cut off the other
    by their scale, rounded half to even, in the order of the target's front, the source's front, the source's end, the target's end."""
    (sx, sy), (w, h), (dx, dy), (dw, dh), (lw, lh), (left, top, right, bottom) = (tuple(map(col, t)) for t in (src, size, to, to_size, limits, by))
    whole = lambda x: F.bround(x).cast("int")
    out = {}
    for n, name, s, length, d, far, limit, low, high in (("x", "width", sx, w, dx, dw, lw, left, right), ("y", "height", sy, h, dy, dh, lh, top, bottom)):
        scale, front = far / length, F.greatest(F.lit(0), low - d)
        s, length, d, far = s + whole(front / scale), length - whole(front / scale), d + front, far - front
        lacking = F.least(F.lit(0), s)
        s, length, d, far = F.greatest(F.lit(0), s), length + lacking, d - whole(lacking * scale), far + whole(lacking * scale)
        kept = F.least(length, limit - s)
        length, far = kept, F.when(kept < length, whole(far * (kept / length))).otherwise(far)
        kept = F.least(far, high - d)
        out |= {f"src_{n}": s, f"src_{name}": F.when(kept < far, whole(length * (kept / far))).otherwise(length), f"dst_{n}": d, f"dst_{name}": kept}
    return out
