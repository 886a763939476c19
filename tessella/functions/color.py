"""Colour expressions: columns in, columns out, all inside whole-stage code generation.

Channels are integers, 0..255 (or 0..65535 for the functions with bits=16). Rounding is half to even, then clamped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of red, green and blue in a gray value.
GRAY = (0.299, 0.587, 0.114)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(x: Column, bits: int = 8) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), x)).cast("int")


def rounded(x: Column, bits: int = 8) -> Column:
    return clamp(F.bround(x), bits)


def gray(r="r", g="g", b="b", bits: int = 8) -> Column:
    r, g, b = map(col, (r, g, b))
    return rounded(GRAY[0] * r + GRAY[1] * g + GRAY[2] * b, bits)


def rgb_to_yuv(r="r", g="g", b="b") -> dict[str, Column]:
    r, g, b = map(col, (r, g, b))
    return {
        "y_": clamp(F.bround(0.257 * r + 0.504 * g + 0.098 * b) + 16),
        "u": clamp(F.bround(-0.148 * r - 0.291 * g + 0.439 * b) + 128),
        "v": clamp(F.bround(0.439 * r - 0.368 * g - 0.071 * b) + 128),
    }


def yuv_to_rgb(y="y_", u="u", v="v") -> dict[str, Column]:
    y, u, v = col(y) - 16, col(u) - 128, col(v) - 128
    return {"r": rounded(1.164 * y - 0.002 * u + 1.596 * v), "g": rounded(1.164 * y - 0.391 * u - 0.813 * v), "b": rounded(1.164 * y + 2.018 * u - 0.001 * v)}


def rgb_to_ycbcr(r="r", g="g", b="b", bits: int = 8) -> dict[str, Column]:
    r, g, b, mid = *map(col, (r, g, b)), 1 << (bits - 1)
    return {
        "y_": rounded(0.299 * r + 0.587 * g + 0.114 * b, bits),
        "cb": rounded(-0.16874 * r - 0.33126 * g + 0.5 * b + mid, bits),
        "cr": rounded(0.5 * r - 0.41869 * g - 0.08131 * b + mid, bits),
    }


def ycbcr_to_rgb(y="y_", cb="cb", cr="cr", bits: int = 8) -> dict[str, Column]:
    mid = 1 << (bits - 1)
    y, cb, cr = col(y), col(cb) - mid, col(cr) - mid
    return {"r": rounded(y + 1.402 * cr, bits), "g": rounded(y - 0.34414 * cb - 0.71414 * cr, bits), "b": rounded(y + 1.772 * cb, bits)}


def rgb_to_cmy(r="r", g="g", b="b", bits: int = 8) -> dict[str, Column]:
    top = (1 << bits) - 1
    return {n: (F.lit(top) - col(x)).cast("int") for n, x in zip("cmy", (r, g, b))}


def cmy_to_rgb(c="c", m="m", y="y_", bits: int = 8) -> dict[str, Column]:
    top = (1 << bits) - 1
    return {n: (F.lit(top) - col(x)).cast("int") for n, x in zip("rgb", (c, m, y))}


def rgb_to_cmyk(r="r", g="g", b="b", bits: int = 8) -> dict[str, Column]:
    top, cmy = (1 << bits) - 1, rgb_to_cmy(r, g, b, bits)
    k = F.least(*cmy.values())
    out = {n: F.when(k == top, 0).otherwise(rounded((x - k) / (top - k) * top, bits)).cast("int") for n, x in cmy.items()}
    return {"c": out["c"], "m": out["m"], "y_": out["y"], "k": k.cast("int")}


def cmyk_to_rgb(c="c", m="m", y="y_", k="k", bits: int = 8) -> dict[str, Column]:
    top, k = (1 << bits) - 1, col(k).cast("long")
    return {n: (top - (col(x) - F.floor(col(x) * k / top) + k)).cast("int") for n, x in zip("rgb", (c, m, y))}


def rgb_to_ycocg(r="r", g="g", b="b") -> dict[str, Column]:
    r, g, b = map(col, (r, g, b))
    quarter = lambda x: F.when(x >= 0, F.floor(x / 4)).otherwise(F.ceil(x / 4))
    return {"y_": clamp(quarter(r + 2 * g + b + 2)), "co": clamp(quarter(2 * r - 2 * b + 2) + 128), "cg": clamp(quarter(-r + 2 * g - b + 2) + 128)}


def ycocg_to_rgb(y="y_", co="co", cg="cg") -> dict[str, Column]:
    y, co, cg = col(y), col(co) - 128, col(cg) - 128
    return {"r": clamp(y + co - cg), "g": clamp(y + cg), "b": clamp(y - co - cg)}


#: Bits of alpha, red, green and blue of the packed pixel formats, highest first.
PACKED = {
    "X5R1G1B1": (0, 1, 1, 1), "R3G3B2": (0, 3, 3, 2), "R5G6B5": (0, 5, 6, 5), "A1R5G5B5": (1, 5, 5, 5),
    "A4R4G4B4": (4, 4, 4, 4), "X1R5G5B5": (0, 5, 5, 5), "X4R4G4B4": (0, 4, 4, 4),
}


def pack(name: str, a="a", r="r", g="g", b="b") -> Column:
    """8-bit channels cut to the format's bits and put together."""
    out, at = F.lit(0), 0
    for bits, c in reversed(list(zip(PACKED[name], (a, r, g, b)))):
        if bits:
            out = out.bitwiseOR(F.shiftleft(F.shiftright(col(c).cast("int"), 8 - bits), at))
            at += bits
    return out


def unpack(name: str, pixel="pixel") -> dict[str, Column]:
    """8-bit channels of a packed pixel, each scaled to 0..255 by integer division; 255 for alpha without bits."""
    out, at = {}, 0
    for bits, c in reversed(list(zip(PACKED[name], "argb"))):
        if bits:
            value = F.shiftright(col(pixel), at).bitwiseAND((1 << bits) - 1)
            out[c] = F.floor(value * 255 / ((1 << bits) - 1)).cast("int")
            at += bits
        else:
            out[c] = F.lit(255)
    return {c: out[c] for c in "argb"}


def widen(c, to: int = 16, gray: bool = False) -> Column:
    """8 to 16 bits: times 257, or for gray formats shifted."""
    return (col(c) * (256 if gray else 257)).cast("int")


def narrow(c, gray: bool = False) -> Column:
    """16 to 8 bits: scaled and truncated, or for gray formats shifted."""
    return F.shiftright(col(c), 8) if gray else F.floor(col(c) * 255 / 65535).cast("int")


def to_float(c, bits: int = 8) -> Column:
    return col(c) / ((1 << bits) - 1)


def from_float(c, bits: int = 8) -> Column:
    return rounded(col(c) * ((1 << bits) - 1), bits)


def half_to_float(c) -> Column:
    """IEEE half precision bits (0..65535) to a number; nulls stay null."""
    h = col(c)
    sign = F.when(h >= 32768, -1.0).otherwise(1.0)
    exponent, fraction = F.shiftright(h, 10).bitwiseAND(31), h.bitwiseAND(1023).cast("double")
    normal = F.pow(F.lit(2.0), exponent - 15) * (1 + fraction / 1024)
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(exponent == 0, fraction * 2.0**-24).when(exponent == 31, special).otherwise(normal)


def float_to_half(c) -> Column:
    """IEEE half precision bits (0..65535) of a number; ties go to the larger magnitude, what is too large to infinity, magnitudes
    below 2^-25 to 0; not a number is 32256. Nulls stay null."""
    x = col(c).cast("double")
    size, sign = F.abs(x), F.when((x < 0) | (x.cast("string") == "-Infinity"), 32768).otherwise(0)
    guess = F.floor(F.log2(F.greatest(size, F.lit(2.0**-30)))).cast("int")
    # the logarithm may round over a power of two
    exponent = F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).otherwise(guess)
    step = F.greatest(exponent, F.lit(-14))
    units = F.floor(size / F.pow(F.lit(2.0), step - 10) + 0.5).cast("int")
    bits = F.when(exponent < -14, units).otherwise((step + 14) * 1024 + units)
    value = F.when(F.isnan(x), 32256).when(size >= 65520.0, sign + 31744).when(size < 2.0**-25, 0).otherwise(sign + bits)
    return F.when(x.isNull(), None).otherwise(value).cast("int")
