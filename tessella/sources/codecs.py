"""Image file codecs in numpy: bytes to frames and back.

A frame is (pixels uint8 [height, width, 4] as alpha, red, green, blue). Each codec has a signature test, a decoder that
gives all frames and, where the format can be written, an encoder. They run inside Arrow batches on executors, a
file at a time; malformed files raise CodecError.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessella.functions.color import GRAY
from tessella.sources import jpeg


class CodecError(ValueError):
    pass


def argb(h: int, w: int) -> np.ndarray:
    out = np.zeros((h, w, 4), np.uint8)
    out[..., 0] = 255
    return out


def from_rgb(rgb: np.ndarray, alpha: np.ndarray | None = None) -> np.ndarray:
    out = argb(*rgb.shape[:2])
    out[..., 1:] = rgb
    if alpha is not None:
        out[..., 0] = alpha
    return out


def from_gray(g: np.ndarray, alpha: np.ndarray | None = None) -> np.ndarray:
    return from_rgb(np.repeat(g[..., None], 3, 2), alpha)


def need(ok: bool, what: str) -> None:
    if not ok:
        raise CodecError(what)


def bits_of(rows: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Values of 1, 2, 4 or 8 bits, highest first, from rows of bytes."""
    if bits == 8:
        return rows[:, :width]
    per = 8 // bits
    shifts = np.arange(per - 1, -1, -1) * bits
    return ((rows[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(len(rows), -1)[:, :width].astype(np.uint8)


# portable maps: P1..P6, P7 (arbitrary maps) and PF, Pf (floats)


def pnm_samples(raw: bytes) -> tuple[np.ndarray, int]:
    """(whole numbers [h, w, channels] as the file has them, the largest that it allows). Floats have no such."""
    kind, at = raw[:2], 2
    if kind == b"P7":
        end = raw.index(b"ENDHDR\n") + 7
        head = dict(line.split(None, 1) for line in raw[:end].decode("latin-1").splitlines()[1:-1] if line and not line.startswith("#"))
        w, h, depth, top = (int(head[k]) for k in ("WIDTH", "HEIGHT", "DEPTH", "MAXVAL"))
        data, at = raw, end
    else:
        fields = []
        count = 2 if kind in (b"P1", b"P4") else 3
        while len(fields) < count:
            m = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\S+)").match(raw, at)
            need(bool(m), "header ends early")
            fields.append(m[1])
            at = m.end()
        w, h = int(fields[0]), int(fields[1])
        at += 1
        data, depth = raw, 3 if kind in (b"P3", b"P6") else 1
        top = 1 if count == 2 else int(fields[2])
    if kind in (b"P1", b"P2", b"P3"):
        text = re.sub(rb"#[^\n]*", b"", data[at - 1 :])
        values = np.array(re.findall(rb"[01]" if kind == b"P1" else rb"\d+", text)[: w * h * depth], np.int64)
    elif kind == b"P4":
        line = -(-w // 8)
        need(len(raw) >= at + line * h, "pixels end early")
        values = bits_of(np.frombuffer(raw, np.uint8, line * h, at).reshape(h, line), 1, w).ravel()
    else:
        need(len(raw) >= at + w * h * depth * (2 if top > 255 else 1), "pixels end early")
        values = np.frombuffer(raw, ">u2" if top > 255 else np.uint8, w * h * depth, at).astype(np.int64)
    need(values.size == w * h * depth, "pixels end early")
    return values.reshape(h, w, depth), top


def pnm_decode(raw: bytes) -> list[np.ndarray]:
    """8-bit frames; `deep` reads the same files at their own depth."""
    if raw[:2] in (b"PF", b"Pf"):
        m = re.compile(rb"P[Ff]\s+(\d+)\s+(\d+)\s+(\S+)\s").match(raw)
        need(bool(m), "header ends early")
        w, h, depth = int(m[1]), int(m[2]), 3 if raw[:2] == b"PF" else 1
        v = np.frombuffer(raw, "<f4" if float(m[3]) < 0 else ">f4", w * h * depth, m.end()).reshape(h, w, depth)[::-1]
        v8 = np.rint(np.clip(v, 0, 1) * 255).astype(np.uint8)
        return [from_rgb(v8) if depth == 3 else from_gray(v8[..., 0])]
    v, top = pnm_samples(raw)
    depth = v.shape[2]
    if raw[:2] in (b"P1", b"P4"):
        return [from_gray(((1 - v[..., 0]) * 255).astype(np.uint8))]
    v = (v * 255 // top).astype(np.uint8) if top != 255 else v.astype(np.uint8)
    if depth in (1, 2):
        return [from_gray(v[..., 0], v[..., 1] if depth == 2 else None)]
    return [from_rgb(v[..., :3], v[..., 3] if depth == 4 else None)]


def ppm_encode(frames: list[np.ndarray]) -> bytes:
    p = frames[0]
    return b"P6\n%d %d\n255\n" % (p.shape[1], p.shape[0]) + p[..., 1:].tobytes()


def pgm_encode(frames: list[np.ndarray]) -> bytes:
    p = frames[0]
    gray = np.rint(GRAY[0] * p[..., 1] + GRAY[1] * p[..., 2] + GRAY[2] * p[..., 3]).astype(np.uint8)
    return b"P5\n%d %d\n255\n" % (p.shape[1], p.shape[0]) + gray.tobytes()


def pam_encode(frames: list[np.ndarray]) -> bytes:
    p = frames[0]
    return b"P7\nWIDTH %d\nHEIGHT %d\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n" % (p.shape[1], p.shape[0]) + p[..., [1, 2, 3, 0]].tobytes()


def pfm_encode(frames: list[np.ndarray]) -> bytes:
    p = frames[0]
    return b"PF\n%d %d\n-1.0\n" % (p.shape[1], p.shape[0]) + (p[::-1, :, 1:] / np.float32(255)).astype("<f4").tobytes()


# Windows bitmaps


def mask_channel(v: np.ndarray, mask: int) -> np.ndarray:
    if not mask:
        return np.zeros(v.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    return ((v & mask) >> low).astype(np.uint64) * 255 // (mask >> low)


def bmp_runs(raw: bytes, at: int, w: int, h: int, bits: int) -> np.ndarray:
    out, x, y = np.zeros((h, w), np.uint8), 0, 0
    while at + 1 < len(raw) and y < h:
        n, v = raw[at], raw[at + 1]
        at += 2
        if n:
            run = [v] * n if bits == 8 else [(v >> 4, v & 15)[i & 1] for i in range(n)]
        elif v == 0:
            x, y = 0, y + 1
            continue
        elif v == 1:
            break
        elif v == 2:
            x, y, at = x + raw[at], y + raw[at + 1], at + 2
            continue
        else:
            size = v if bits == 8 else (v + 1) // 2
            part = raw[at : at + size]
            run = list(part) if bits == 8 else [(part[i // 2] >> 4, part[i // 2] & 15)[i & 1] for i in range(v)]
            at += size + size % 2
        run = run[: max(0, w - x)]
        out[y, x : x + len(run)] = run
        x += len(run)
    return out


def bmp_decode(raw: bytes) -> list[np.ndarray]:
    start, size = struct.unpack_from("<I", raw, 10)[0], struct.unpack_from("<I", raw, 14)[0]
    if size == 12:
        w, h, _, bits = struct.unpack_from("<HHHH", raw, 18)
        packing, used, entry = 0, 0, 3
    else:
        w, h, _, bits, packing, _, _, _, used = struct.unpack_from("<iiHHIIiiI", raw, 18)
        entry = 4
    up, h = h > 0, abs(h)
    need(0 < w < 1 << 20 and 0 < h < 1 << 20, "bad size")
    if bits <= 8:
        colors = used or 1 << bits
        table = np.frombuffer(raw, np.uint8, colors * entry, 14 + size).reshape(-1, entry)[:, 2::-1] if entry == 4 else np.frombuffer(raw, np.uint8, colors * 3, 14 + size).reshape(-1, 3)[:, ::-1]
        if packing in (1, 2):
            index = bmp_runs(raw, start, w, h, bits)
        else:
            line = (w * bits + 31) // 32 * 4
            need(len(raw) >= start + line * h, "pixels end early")
            index = bits_of(np.frombuffer(raw, np.uint8, line * h, start).reshape(h, line), bits, w)
        out = from_rgb(table[np.minimum(index, len(table) - 1)])
    else:
        line = (w * bits + 31) // 32 * 4
        need(len(raw) >= start + line * h, "pixels end early")
        rows = np.frombuffer(raw, np.uint8, line * h, start).reshape(h, line)[:, : w * bits // 8]
        if bits == 24:
            out = from_rgb(rows.reshape(h, w, 3)[..., ::-1])
        else:
            v = np.ascontiguousarray(rows).view("<u2" if bits == 16 else "<u4").astype(np.int64).reshape(h, w)
            if packing == 3:
                masks = struct.unpack_from("<III", raw, 54)
                alpha = struct.unpack_from("<I", raw, 66)[0] if size >= 56 else 0
            else:
                masks, alpha = ((0x7C00, 0x3E0, 0x1F), 0) if bits == 16 else ((0xFF0000, 0xFF00, 0xFF), 0xFF000000)
            a = mask_channel(v, alpha)
            if not alpha or not a.any():  # no alpha is stored
                a = np.full(v.shape, 255)
            out = from_rgb(np.stack([mask_channel(v, m) for m in masks], 2), a)
    return [out[::-1].copy() if up else out]


def bmp_encode(frames: list[np.ndarray]) -> bytes:
    """32 bits a pixel with masks, or 24 without any alpha."""
    p = frames[0]
    h, w = p.shape[:2]
    if (p[..., 0] == 255).all():
        line = (w * 3 + 3) // 4 * 4
        rows = np.zeros((h, line), np.uint8)
        rows[:, : w * 3] = p[::-1, :, :0:-1].reshape(h, -1)
        return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 0, 0, 0, 0) + rows.tobytes()
    body = p[::-1, :, ::-1].tobytes()
    head = struct.pack("<IiiHHIIiiII", 108, w, h, 1, 32, 3, len(body), 0, 0, 0, 0) + struct.pack("<IIII", 0xFF0000, 0xFF00, 0xFF, 0xFF000000) + b"BGRs" + bytes(48)
    return struct.pack("<2sIHHI", b"BM", 14 + len(head) + len(body), 0, 0, 14 + len(head)) + head + body


# Targa


def run_packets(raw: bytes, at: int, count: int, step: int) -> np.ndarray:
    """Run-length packets of `step` bytes a pixel: a byte with the top bit repeats the next pixel."""
    out, n = [], 0
    while n < count:
        need(at < len(raw), "runs end early")
        c = raw[at]
        size = (c & 127) + 1
        if c & 128:
            out.append(raw[at + 1 : at + 1 + step] * size)
            at += 1 + step
        else:
            out.append(raw[at + 1 : at + 1 + step * size])
            at += 1 + step * size
        n += size
    found = b"".join(out)[: count * step]
    need(len(found) == count * step, "runs end early")
    return np.frombuffer(found, np.uint8)


def tga_decode(raw: bytes) -> list[np.ndarray]:
    skip, mapped, kind, first, colors, entry, _, _, w, h, bits, flags = struct.unpack_from("<BBBHHBHHHHBB", raw, 0)
    at = 18 + skip
    need(kind & 7 in (1, 2, 3) and w > 0 and h > 0, "unknown kind")

    def colors_of(v: np.ndarray, bits: int) -> np.ndarray:
        n = v.size // (bits // 8 if bits > 8 else 1) if bits != 15 else v.size // 2
        if bits in (15, 16):
            x = v.view("<u2").astype(np.int64)
            return from_rgb(np.stack([mask_channel(x, m) for m in (0x7C00, 0x3E0, 0x1F)], 1)[None])[0]
        v = v.reshape(n, bits // 8)
        return from_rgb(v[None, :, 2::-1], v[None, :, 3] if bits == 32 else None)[0]

    table = None
    if mapped:
        size = colors * ((entry + 7) // 8)
        table = colors_of(np.frombuffer(raw, np.uint8, size, at), entry)
        at += size
    step = (bits + 7) // 8
    need(kind & 8 or len(raw) >= at + w * h * step, "pixels end early")
    data = run_packets(raw, at, w * h, step) if kind & 8 else np.frombuffer(raw, np.uint8, w * h * step, at)
    if kind & 7 == 1:
        out = table[np.clip(data.astype(int) - first, 0, len(table) - 1)]
    elif kind & 7 == 3:
        gray = data.reshape(-1, step)
        out = from_gray(gray[None, :, 0], gray[None, :, 1] if step == 2 else None)[0]
    else:
        out = colors_of(data, bits)
    out = out.reshape(h, w, 4)
    out = out if flags & 32 else out[::-1]
    return [out[:, ::-1].copy() if flags & 16 else out.copy()]


def tga_encode(frames: list[np.ndarray], runs: bool = False) -> bytes:
    p = frames[0]
    h, w = p.shape[:2]
    step = 3 if (p[..., 0] == 255).all() else 4
    body = p[..., [3, 2, 1, 0][:step]].reshape(-1, step)
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, 10 if runs else 2, 0, 0, 0, 0, 0, w, h, step * 8, 32 | (8 if step == 4 else 0))
    if not runs:
        return head + body.tobytes()
    out = []
    for y in range(h):
        row = body[y * w : (y + 1) * w]
        edges = np.flatnonzero((row[1:] != row[:-1]).any(1)) + 1
        for a, b in zip([0, *edges], [*edges, w]):
            for k in range(a, b, 128):
                out.append(bytes([127 + min(128, b - k)]) + row[k].tobytes())
    return head + b"".join(out)


# QOI


def qoi_decode(raw: bytes) -> list[np.ndarray]:
    w, h, _, _ = struct.unpack_from(">IIBB", raw, 4)
    need(0 < w * h <= 1 << 28, "bad size")
    seen, r, g, b, a, at, n, total = [(0, 0, 0, 0)] * 64, 0, 0, 0, 255, 14, 0, w * h
    out = bytearray()
    while n < total:
        need(at < len(raw), "pixels end early")
        c, times = raw[at], 1
        at += 1
        if c == 254:
            r, g, b = raw[at : at + 3]
            at += 3
        elif c == 255:
            r, g, b, a = raw[at : at + 4]
            at += 4
        elif c < 64:
            r, g, b, a = seen[c]
        elif c < 128:
            r, g, b = r + (c >> 4 & 3) - 2 & 255, g + (c >> 2 & 3) - 2 & 255, b + (c & 3) - 2 & 255
        elif c < 192:
            d, e = (c & 63) - 32, raw[at]
            at += 1
            r, g, b = r + d - 8 + (e >> 4) & 255, g + d & 255, b + d - 8 + (e & 15) & 255
        else:
            times = (c & 63) + 1
        seen[(r * 3 + g * 5 + b * 7 + a * 11) % 64] = (r, g, b, a)
        out += bytes((a, r, g, b)) * times
        n += times
    return [np.frombuffer(bytes(out[: total * 4]), np.uint8).reshape(h, w, 4)]


def qoi_encode(frames: list[np.ndarray]) -> bytes:
    p = frames[0]
    h, w = p.shape[:2]
    seen, before, run, out = [None] * 64, (255, 0, 0, 0), 0, bytearray()
    for px in map(tuple, p.reshape(-1, 4).tolist()):
        if px == before:
            run += 1
            if run == 62:
                out.append(0xC0 | 61)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        a, r, g, b = px
        slot = (r * 3 + g * 5 + b * 7 + a * 11) % 64
        if seen[slot] == px:
            out.append(slot)
        else:
            seen[slot] = px
            dr, dg, db = ((x - y + 128 & 255) - 128 for x, y in zip((r, g, b), before[1:]))
            if a != before[0]:
                out += bytes((255, r, g, b, a))
            elif max(dr, dg, db) < 2 and min(dr, dg, db) > -3:
                out.append(64 | dr + 2 << 4 | dg + 2 << 2 | db + 2)
            elif -33 < dg < 32 and -9 < dr - dg < 8 and -9 < db - dg < 8:
                out += bytes((128 | dg + 32, dr - dg + 8 << 4 | db - dg + 8))
            else:
                out += bytes((254, r, g, b))
        before = px
    if run:
        out.append(0xC0 | run - 1)
    return b"qoif" + struct.pack(">IIBB", w, h, 4, 0) + bytes(out) + bytes(7) + b"\1"


# PNG with frames


def png_unfilter(data: bytes, h: int, line: int, step: int) -> np.ndarray:
    out, before = np.zeros((h, line), np.uint8), np.zeros(line, np.uint8)
    need(len(data) >= h * (line + 1), "pixels end early")
    for y in range(h):
        at = y * (line + 1)
        kind, row = data[at], np.frombuffer(data, np.uint8, line, at + 1)
        if kind == 0:
            cur = row.copy()
        elif kind == 2:
            cur = row + before
        elif kind == 1:
            cur = row.copy()
            for k in range(step):
                cur[k::step] = np.cumsum(row[k::step], dtype=np.uint64).astype(np.uint8)
        else:
            cur, up, r = [0] * line, before.tolist(), row.tolist()
            for i in range(line):
                left = cur[i - step] if i >= step else 0
                if kind == 3:
                    guess = left + up[i] >> 1
                else:
                    corner = up[i - step] if i >= step else 0
                    pa, pb, pc = abs(up[i] - corner), abs(left - corner), abs(left + up[i] - 2 * corner)
                    guess = left if pa <= pb and pa <= pc else up[i] if pb <= pc else corner
                cur[i] = r[i] + guess & 255
            cur = np.array(cur, np.uint8)
        out[y] = before = cur
    return out


#: First column and row and steps of the seven interlacing passes.
ADAM7 = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def png_samples(data: bytes, w: int, h: int, bits: int, kind: int, laced: int) -> np.ndarray:
    """[h, w, channels] as the file has them."""
    parts = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    step = max(1, parts * bits // 8)
    raw, out, at = zlib.decompress(data), np.zeros((h, w, parts), np.uint16), 0
    for x0, y0, dx, dy in ADAM7 if laced else [(0, 0, 1, 1)]:
        pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if pw <= 0 or ph <= 0:
            continue
        line = (pw * parts * bits + 7) // 8
        rows = png_unfilter(raw[at : at + ph * (line + 1)], ph, line, step)
        at += ph * (line + 1)
        v = rows.view(">u2")[:, : pw * parts] if bits == 16 else bits_of(rows, bits, pw * parts)
        out[y0::dy, x0::dx] = v.reshape(ph, pw, parts)
    return out


def png_pixels(data: bytes, w: int, h: int, bits: int, kind: int, laced: int, palette: np.ndarray | None, clear: bytes | None) -> np.ndarray:
    out = png_samples(data, w, h, bits, kind, laced)
    parts = out.shape[2]
    to8 = lambda v: (v >> 8 if bits == 16 else v.astype(int) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    if kind == 3:
        need(palette is not None, "no palette")
        index = np.minimum(out[..., 0], len(palette) - 1)
        alpha = np.full(len(palette), 255, np.uint8)
        if clear:
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
        return from_rgb(palette[index], alpha[index])
    alpha = None
    if kind in (4, 6):
        alpha = to8(out[..., -1])
    elif clear:
        key = np.frombuffer(clear, ">u2")[:parts]
        alpha = np.where((out == key).all(2), 0, 255)
    return from_gray(to8(out[..., 0]), alpha) if kind in (0, 4) else from_rgb(to8(out[..., :3]), alpha)


def png_decode(raw: bytes) -> list[np.ndarray]:
    """All frames, those of an animation composed onto each other by its disposal and blending."""
    at, palette, clear, main, frames, current = 8, None, None, b"", [], None
    head = None
    while at + 8 <= len(raw):
        size, name = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        at += 12 + size
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = body
        elif name == b"fcTL":
            _, fw, fh, fx, fy, _, _, dispose, blend = struct.unpack(">IIIIIHHBB", body)
            current = [fw, fh, fx, fy, dispose, blend, b""]
            frames.append(current)
        elif name == b"IDAT":
            main += body
            if current is not None:
                current[-1] += body
        elif name == b"fdAT":
            current[-1] += body[4:]
        elif name == b"IEND":
            break
    need(head is not None, "no header")
    w, h, bits, kind, _, _, laced = head
    if not frames:
        return [png_pixels(main, w, h, bits, kind, laced, palette, clear)]
    canvas, out = np.zeros((h, w, 4), np.uint8), []
    for fw, fh, fx, fy, dispose, blend, data in frames:
        new, saved = png_pixels(data, fw, fh, bits, kind, laced, palette, clear), canvas.copy()
        area = canvas[fy : fy + fh, fx : fx + fw]
        if blend:
            s, d = new.astype(float) / 255, area.astype(float) / 255
            a = s[..., :1] + d[..., :1] * (1 - s[..., :1])
            rgb = (s[..., 1:] * s[..., :1] + d[..., 1:] * d[..., :1] * (1 - s[..., :1])) / np.where(a, a, 1)
            new = np.rint(np.concatenate([a, rgb], 2) * 255).astype(np.uint8)
        area[:] = new
        out.append(canvas.copy())
        if dispose == 1:
            area[:] = 0
        elif dispose == 2:
            canvas = saved
    return out


def chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png_rows(p: np.ndarray) -> bytes:
    """Filtered by the difference to the row above, which numpy does at once."""
    rows = p[..., [1, 2, 3, 0]].reshape(len(p), -1)
    lines = np.zeros((len(p), rows.shape[1] + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = 2, rows
    lines[1:, 1:] -= rows[:-1]
    return zlib.compress(lines.tobytes(), 6)


def png_encode(frames: list[np.ndarray], delay: int = 100) -> bytes:
    h, w = frames[0].shape[:2]
    out = [b"\x89PNG\r\n\x1a\n", chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0))]
    if len(frames) == 1:
        out.append(chunk(b"IDAT", png_rows(frames[0])))
    else:
        out.append(chunk(b"acTL", struct.pack(">II", len(frames), 0)))
        number = 0
        for i, p in enumerate(frames):
            need(p.shape == frames[0].shape, "frames differ in size")
            out.append(chunk(b"fcTL", struct.pack(">IIIIIHHBB", number, w, h, 0, 0, delay, 1000, 0, 0)))
            number += 1
            if i:
                out.append(chunk(b"fdAT", struct.pack(">I", number) + png_rows(p)))
                number += 1
            else:
                out.append(chunk(b"IDAT", png_rows(p)))
    return b"".join(out) + chunk(b"IEND", b"")


# XPM text pixmaps


def xpm_decode(raw: bytes) -> list[np.ndarray]:
    strings = re.findall(r'"([^"]*)"', raw.decode("latin-1"))
    need(bool(strings), "no strings")
    w, h, colors, size = map(int, strings[0].split()[:4])
    table = {}
    for s in strings[1 : 1 + colors]:
        fields = s[size:].split()
        value = fields[fields.index("c") + 1] if "c" in fields else fields[-1]
        if value.lower() == "none":
            table[s[:size]] = (0, 0, 0, 0)
        elif value.startswith("#"):
            n = (len(value) - 1) // 3
            table[s[:size]] = (255, *(int(value[1 + i * n : 1 + i * n + n][:2].ljust(2, "0"), 16) for i in range(3)))
        else:
            table[s[:size]] = {"black": (255, 0, 0, 0), "white": (255, 255, 255, 255), "red": (255, 255, 0, 0), "green": (255, 0, 255, 0), "blue": (255, 0, 0, 255)}.get(value.lower(), (255, 0, 0, 0))
    rows = strings[1 + colors : 1 + colors + h]
    need(len(rows) == h, "rows end early")
    return [np.array([[table[r[i * size : (i + 1) * size]] for i in range(w)] for r in rows], np.uint8)]


def xpm_encode(frames: list[np.ndarray]) -> bytes:
    p = frames[0]
    h, w = p.shape[:2]
    colors, index = np.unique(p.reshape(-1, 4), axis=0, return_inverse=True)
    size, letters = 1, [chr(c) for c in range(35, 127) if chr(c) not in '"\\']
    while len(letters) ** size < len(colors):
        size += 1
    name = lambda i: "".join(letters[i // len(letters) ** k % len(letters)] for k in range(size))
    names = [name(i) for i in range(len(colors))]
    lines = [f"{w} {h} {len(colors)} {size}"] + [f"{n} c {'None' if c[0] == 0 else '#%02X%02X%02X' % tuple(c[1:])}" for n, c in zip(names, colors.tolist())]
    lines += ["".join(names[i] for i in row) for row in index.reshape(h, w).tolist()]
    return ("/* XPM */\nstatic char *image[] = {\n" + ",\n".join(f'"{x}"' for x in lines) + "\n};\n").encode()


# PCX


def pcx_decode(raw: bytes) -> list[np.ndarray]:
    _, _, runs, bits, x0, y0, x1, y1 = struct.unpack_from("<BBBBHHHH", raw, 0)
    planes, line = raw[65], struct.unpack_from("<H", raw, 66)[0]
    w, h = x1 - x0 + 1, y1 - y0 + 1
    total, out, at = line * planes * h, bytearray(), 128
    while len(out) < total:
        need(at < len(raw), "pixels end early")
        c = raw[at]
        at += 1
        if runs and c >= 192:
            out += raw[at : at + 1] * (c & 63)
            at += 1
        else:
            out.append(c)
    data = np.frombuffer(bytes(out[:total]), np.uint8).reshape(h, planes, line)
    if bits == 8 and planes == 1:
        table = np.frombuffer(raw, np.uint8, 768, len(raw) - 768).reshape(256, 3)
        return [from_rgb(table[data[:, 0, :w]])]
    if bits == 8:
        rgb = data[:, :3, :w].transpose(0, 2, 1)
        return [from_rgb(rgb, data[:, 3, :w] if planes == 4 else None)]
    index = sum(bits_of(np.ascontiguousarray(data[:, k]), bits, w).astype(int) << (bits * k) for k in range(planes))
    table = np.frombuffer(raw, np.uint8, 48, 16).reshape(16, 3)
    return [from_rgb(table[np.minimum(index, 15)]) if bits * planes > 1 else from_gray((index * 255).astype(np.uint8))]


# Radiance


def hdr_floats(raw: bytes) -> np.ndarray:
    """[h, w, 3] red, green, blue."""
    end = raw.index(b"\n\n") + 2
    m = re.compile(rb"-Y (\d+) \+X (\d+)\n").match(raw, end)
    need(bool(m), "unknown orientation")
    h, w, at = int(m[1]), int(m[2]), m.end()
    out = np.zeros((h, w, 4), np.uint8)
    for y in range(h):
        if 8 <= w < 32768 and raw[at : at + 2] == b"\2\2":
            at += 4
            for c in range(4):
                row = bytearray()
                while len(row) < w:
                    n = raw[at]
                    row += raw[at + 1 : at + 2] * (n - 128) if n > 128 else raw[at + 1 : at + 1 + n]
                    at += 2 if n > 128 else 1 + n
                out[y, :, c] = np.frombuffer(bytes(row[:w]), np.uint8)
        else:
            out[y] = np.frombuffer(raw, np.uint8, w * 4, at).reshape(w, 4)
            at += w * 4
    scale = np.where(out[..., 3:] > 0, np.ldexp(1.0, out[..., 3:].astype(int) - 136), 0)
    return out[..., :3] * scale


def hdr_decode(raw: bytes) -> list[np.ndarray]:
    """8-bit frames; `deep` reads the same files as floats."""
    return [from_rgb(np.rint(np.clip(hdr_floats(raw), 0, 1) * 255).astype(np.uint8))]


def hdr_encode(frames: list[np.ndarray]) -> bytes:
    return hdr_bytes(frames[0][..., 1:] / 255)


def hdr_bytes(v: np.ndarray) -> bytes:
    """A file of [h, w, 3] red, green, blue, none below 0."""
    mantissa, exponent = np.frexp(v.max(2))
    scale = np.where(v.max(2) > 0, mantissa * 256 / np.where(v.max(2) > 0, v.max(2), 1), 0)
    rgbe = np.concatenate([np.minimum(255, np.rint(v * scale[..., None])), np.where(v.max(2) > 0, exponent + 128, 0)[..., None]], 2).astype(np.uint8)
    return b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y %d +X %d\n" % v.shape[:2] + rgbe.tobytes()


@dataclass(frozen=True)
class Codec:
    name: str
    extensions: tuple[str, ...]
    matches: Callable[[bytes], bool]
    decode: Callable[[bytes], list[np.ndarray]]
    encode: Callable[[list[np.ndarray]], bytes] | None = None
    many: bool = False
    #: an encoder whose files don't give back the same pixels
    lossy: Callable[[list[np.ndarray]], bytes] | None = None

    @property
    def writes(self) -> Callable[..., bytes] | None:
        return self.encode or self.lossy

    @property
    def masks(self) -> list[str]:
        return [f"*.{e}" for e in self.extensions]


#: In the order of detection.
CODECS = [
    Codec("png", ("png", "apng"), lambda b: b[:8] == b"\x89PNG\r\n\x1a\n", png_decode, png_encode, True),
    Codec("bmp", ("bmp", "dib"), lambda b: b[:2] == b"BM", bmp_decode, bmp_encode),
    Codec("qoi", ("qoi",), lambda b: b[:4] == b"qoif", qoi_decode, qoi_encode),
    Codec("ppm", ("ppm", "pnm", "pbm"), lambda b: b[:2] in (b"P6", b"P3", b"P1", b"P4"), pnm_decode, ppm_encode),
    Codec("pgm", ("pgm",), lambda b: b[:2] in (b"P5", b"P2"), pnm_decode, pgm_encode),
    Codec("pam", ("pam",), lambda b: b[:3] == b"P7\n", pnm_decode, pam_encode),
    Codec("pfm", ("pfm",), lambda b: b[:3] in (b"PF\n", b"Pf\n"), pnm_decode, pfm_encode),
    Codec("hdr", ("hdr",), lambda b: b[:10] in (b"#?RADIANCE"[:10],) or b[:6] == b"#?RGBE", hdr_decode, hdr_encode),
    Codec("xpm", ("xpm",), lambda b: b[:9] == b"/* XPM */", xpm_decode, xpm_encode),
    Codec("pcx", ("pcx",), lambda b: len(b) > 128 and b[0] == 10 and b[1] in (0, 2, 3, 4, 5) and b[2] < 2 and b[3] in (1, 2, 4, 8), pcx_decode),
    Codec("tga", ("tga",), lambda b: len(b) > 18 and b[1] < 2 and b[2] in (1, 2, 3, 9, 10, 11) and b[16] in (8, 15, 16, 24, 32), tga_decode, tga_encode),
]


def detect(raw: bytes, name: str = "") -> Codec | None:
    """The first codec whose extension and signature fit, else the first whose signature fits."""
    extension = name.rpartition(".")[2].lower()
    return next((c for c in CODECS if extension in c.extensions and c.matches(raw)), None) or next((c for c in CODECS if c.matches(raw)), None)


def by_extension(name: str) -> Codec | None:
    """The last codec registered for a file name's extension; upper and lower case are alike."""
    extension = name.rpartition(".")[2].lower()
    return next((c for c in reversed(CODECS) if extension in c.extensions), None)


def register(codec: Codec) -> None:
    CODECS.append(codec)


# GIF


def lzw_decode(data: bytes, bits: int, total: int) -> bytes:
    """Codes of growing width, lowest bit first."""
    clear, out = 1 << bits, bytearray()
    table, width, last = [], bits + 1, b""
    hold = held = at = 0
    while len(out) < total:
        while held < width:
            if at >= len(data):
                return bytes(out)
            hold |= data[at] << held
            held, at = held + 8, at + 1
        code = hold & ((1 << width) - 1)
        hold, held = hold >> width, held - width
        if code == clear:
            table, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, b""
            continue
        if code == clear + 1:
            break
        need(code < len(table) or (code == len(table) and bool(last)), "bad code")
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        if len(table) >= 1 << width and width < 12:
            width += 1
        last = entry
    return bytes(out)


def lzw_encode(data: bytes, bits: int) -> bytes:
    clear, out, hold, held = 1 << bits, bytearray(), 0, 0
    table, width, count, code = {}, bits + 1, clear + 2, -1

    def put(value: int) -> None:
        nonlocal hold, held
        hold |= value << held
        held += width
        while held >= 8:
            out.append(hold & 255)
            hold >>= 8
            held -= 8

    put(clear)
    for byte in data:
        if code < 0:
            code = byte
        elif (code, byte) in table:
            code = table[code, byte]
        else:
            put(code)
            if count < 4096:
                table[code, byte] = count
                if count >= 1 << width:
                    width += 1
                count += 1
            else:
                put(clear)
                table, width, count = {}, bits + 1, clear + 2
            code = byte
    if code >= 0:
        put(code)
    put(clear + 1)
    if held:
        out.append(hold & 255)
    return bytes(out)


def gif_blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    out = bytearray()
    while raw[at]:
        out += raw[at + 1 : at + 1 + raw[at]]
        at += 1 + raw[at]
    return bytes(out), at + 1


def gif_decode(raw: bytes) -> list[np.ndarray]:
    """All frames as shown: each laid over the one before, after its disposal."""
    w, h, flags = struct.unpack_from("<HHB", raw, 6)
    need(w * h > 0, "bad size")
    at = 13
    common = None
    if flags & 128:
        n = 2 << (flags & 7)
        common = np.frombuffer(raw, np.uint8, n * 3, at).reshape(n, 3)
        at += n * 3
    canvas, frames, clear, dispose = np.zeros((h, w, 4), np.uint8), [], None, 0
    while at < len(raw) and raw[at] != 0x3B:
        if raw[at] == 0x21:
            kind = raw[at + 1]
            body, at = gif_blocks(raw, at + 2)
            if kind == 0xF9:
                clear, dispose = body[3] if body[0] & 1 else None, body[0] >> 2 & 7
            continue
        need(raw[at] == 0x2C, "unknown block")
        fx, fy, fw, fh, flags = struct.unpack_from("<HHHHB", raw, at + 1)
        at += 10
        table = common
        if flags & 128:
            n = 2 << (flags & 7)
            table = np.frombuffer(raw, np.uint8, n * 3, at).reshape(n, 3)
            at += n * 3
        need(table is not None, "no palette")
        bits = raw[at]
        data, at = gif_blocks(raw, at + 1)
        index = lzw_decode(data, bits, fw * fh)
        rows = np.frombuffer(index.ljust(fw * fh, b"\0"), np.uint8).reshape(fh, fw)
        if flags & 64:  # four passes: every eighth row, the rows between, and so on
            order = np.concatenate([np.arange(a, fh, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            rows = rows[np.argsort(order)]
        new, before = from_rgb(table[np.minimum(rows, len(table) - 1)]), canvas.copy()
        area = canvas[fy : fy + fh, fx : fx + fw]
        new, rows = new[: area.shape[0], : area.shape[1]], rows[: area.shape[0], : area.shape[1]]
        shown = np.ones(rows.shape, bool) if clear is None else rows != clear
        area[shown] = new[shown]
        frames.append(canvas.copy())
        if dispose == 2:
            area[:] = 0
        elif dispose == 3:
            canvas = before
        clear, dispose = None, 0
    need(bool(frames), "no frames")
    return frames


def gif_encode(frames: list[np.ndarray], delay: int = 10) -> bytes:
    """A palette for each frame; colours beyond 255 go to their nearest by the highest bits, and alpha is all or nothing."""
    h, w = frames[0].shape[:2]
    out = [b"GIF89a" + struct.pack("<HHBBB", w, h, 0, 0, 0), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for p in frames:
        need(p.shape == frames[0].shape, "frames differ in size")
        rgb, drop = p[..., 1:].reshape(-1, 3), 0
        while len(np.unique(rgb >> drop, axis=0)) > 255:
            drop += 1
        colors, index = np.unique(rgb >> drop << drop, axis=0, return_inverse=True)
        index = np.where(p[..., 0].ravel() < 128, 255, index.ravel())
        table = np.zeros((256, 3), np.uint8)
        table[: len(colors)] = colors
        data = lzw_encode(index.astype(np.uint8).tobytes(), 8)
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 | 2 << 2, delay, 255, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, w, h, 128 | 7) + table.tobytes() + b"\x08")
        out += [bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)] + [b"\0"]
    return b"".join(out) + b"\x3b"


# DDS textures

#: Four-character codes of the block formats and bytes of their blocks.
DDS_BLOCKS = {b"DXT1": ("DXT1", 8), b"DXT3": ("DXT3", 16), b"DXT5": ("DXT5", 16), b"ATI1": ("ATI1N", 8), b"ATI2": ("ATI2N", 16), b"BC4U": ("ATI1N", 8), b"BC5U": ("ATI2N", 16)}


def dds_sizes(w: int, h: int, depth: int, levels: int, faces: int) -> list[tuple[int, int]]:
    """Widths and heights of all images in their order: by face then level, or by level then slice of a volume."""
    levels = max(1, levels)
    sizes = [(max(1, w >> i), max(1, h >> i)) for i in range(levels)]
    if depth > 1:
        return [s for i, s in enumerate(sizes) for _ in range(max(1, depth >> i))]
    return sizes * max(1, faces)


def dds_decode(raw: bytes) -> list[np.ndarray]:
    """All mip levels, cube faces and slices, the first being the full image."""
    from tessella.operators.blocks import FORMATS, from_blocks

    _, flags, h, w, _, depth, levels = struct.unpack_from("<IIIIIII", raw, 4)
    _, kind, code, bits, *masks = struct.unpack_from("<II4sIIIII", raw, 76)
    caps2 = struct.unpack_from("<I", raw, 112)[0]
    need(0 < w < 1 << 16 and 0 < h < 1 << 16, "bad size")
    at, out = 128, []
    faces = bin(caps2 >> 10 & 63).count("1") if caps2 & 0x200 else 1
    depth = depth if caps2 & 0x200000 else 1
    for sw, sh in dds_sizes(w, h, depth, levels if flags & 0x20000 else 1, faces):
        if kind & 4:
            need(code in DDS_BLOCKS, "unknown block format")
            name, size = DDS_BLOCKS[code]
            n = -(-sw // 4) * -(-sh // 4) * size
            need(len(raw) >= at + n, "pixels end early")
            out.append(from_blocks(FORMATS[name][2](np.frombuffer(raw, np.uint8, n, at).reshape(-1, size)), sw, sh))
        else:
            need(bits in (8, 16, 24, 32), "unknown pixel size")
            step = bits // 8
            n = sw * sh * step
            need(len(raw) >= at + n, "pixels end early")
            v = np.frombuffer(raw, np.uint8, n, at).reshape(sh, sw, step).astype(np.int64)
            v = sum(v[..., k] << (8 * k) for k in range(step))
            if kind & 0x20000:
                out.append(from_gray(mask_channel(v, masks[0] or 255).astype(np.uint8)))
            else:
                rgb = np.stack([mask_channel(v, m) for m in masks[:3]], 2)
                out.append(from_rgb(rgb, mask_channel(v, masks[3]) if kind & 1 else None))
        at += n
    return out


def dds_encode(frames: list[np.ndarray], kind: str | None = None) -> bytes:
    """Frames as mip levels if each is half the one before, else the first alone. kind: a block format, or plain 32 bits."""
    from tessella.operators.blocks import FORMATS, to_blocks

    h, w = frames[0].shape[:2]
    chain = [f for i, f in enumerate(frames) if f.shape[:2] == (max(1, h >> i), max(1, w >> i))]
    chain = chain if len(chain) == len(frames) else frames[:1]
    flags = 0x1007 | (0x20000 if len(chain) > 1 else 0)
    if kind:
        code = next(c for c, (n, _) in DDS_BLOCKS.items() if n == kind)
        pixel = struct.pack("<II4sIIIII", 32, 4, code, 0, 0, 0, 0, 0)
        body = b"".join(FORMATS[kind][1](to_blocks(p)).astype(np.uint8).tobytes() for p in chain)
    else:
        pixel = struct.pack("<II4sIIIII", 32, 0x41, bytes(4), 32, 0xFF0000, 0xFF00, 0xFF, 0xFF000000)
        body = b"".join(p[..., [3, 2, 1, 0]].tobytes() for p in chain)
    head = struct.pack("<4sIIIIIII", b"DDS ", 124, flags, h, w, 0, 0, len(chain)) + bytes(44) + pixel
    return head + struct.pack("<IIIII", 0x1000 | (0x400008 if len(chain) > 1 else 0), 0, 0, 0, 0) + body


# PSD: the flattened picture


def packbits(raw: bytes, at: int, size: int) -> bytes:
    end, out = at + size, bytearray()
    while at < end:
        n = raw[at]
        at += 1
        if n < 128:
            out += raw[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += raw[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def psd_decode(raw: bytes) -> list[np.ndarray]:
    channels, h, w, bits, mode = struct.unpack_from(">HIIHH", raw, 12)
    need(bits in (8, 16) and mode in (1, 2, 3, 4), "unknown mode")
    at, table = 26, None
    for k in range(3):
        size = struct.unpack_from(">I", raw, at)[0]
        if k == 0 and mode == 2:
            table = np.frombuffer(raw, np.uint8, 768, at + 4).reshape(3, 256).T
        at += 4 + size
    packing, at, line = struct.unpack_from(">H", raw, at)[0], at + 2, w * bits // 8
    if packing == 1:
        sizes = struct.unpack_from(f">{channels * h}H", raw, at)
        at += 2 * channels * h
        rows = []
        for n in sizes:
            rows.append(packbits(raw, at, n)[:line].ljust(line, b"\0"))
            at += n
        data = np.frombuffer(b"".join(rows), np.uint8)
    else:
        need(packing == 0 and len(raw) >= at + channels * h * line, "pixels end early")
        data = np.frombuffer(raw, np.uint8, channels * h * line, at)
    v = data.reshape(channels, h, line)
    v = v[:, :, ::2] if bits == 16 else v  # the high bytes
    if mode == 2:
        return [from_rgb(table[v[0]])]
    if mode == 1:
        return [from_gray(v[0], v[1] if channels > 1 else None)]
    if mode == 3:
        return [from_rgb(v[:3].transpose(1, 2, 0), v[3] if channels > 3 else None)]
    ink = 255 - v[:4].astype(int)  # stored inverted
    rgb = 255 - np.minimum(255, ink[:3] - ink[:3] * ink[3] // 255 + ink[3])
    return [from_rgb(rgb.transpose(1, 2, 0), v[4] if channels > 4 else None)]


def psd_encode(frames: list[np.ndarray]) -> bytes:
    p = frames[0]
    h, w = p.shape[:2]
    return b"8BPS" + struct.pack(">H6xHIIHH", 1, 4, h, w, 8, 3) + bytes(12) + b"\0\0" + p[..., [1, 2, 3, 0]].transpose(2, 0, 1).tobytes()


# TIFF: baseline strips, plain or packed


def tiff_lzw_decode(data: bytes, total: int) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, that grow one code early."""
    table, width, last, out = [], 9, b"", bytearray()
    hold = held = at = 0
    while len(out) < total:
        while held < width:
            if at >= len(data):
                return bytes(out)
            hold = (hold & 0xFFFF) << 8 | data[at]
            held, at = held + 8, at + 1
        code = hold >> (held - width) & ((1 << width) - 1)
        held -= width
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        need(code < len(table) or (code == len(table) and bool(last)), "bad code")
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        width = min(12, max(9, (len(table) + 1).bit_length()))
        last = entry
    return bytes(out)


def tiff_lzw_encode(data: bytes) -> bytes:
    table, out, hold, held = {}, bytearray(), 0, 0

    def put(code: int) -> None:
        nonlocal hold, held
        width = max(9, (len(table) + 258).bit_length()) if table else 9
        hold, held = hold << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(hold >> held & 255)
        hold &= (1 << held) - 1

    put(256)
    word = b""
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        put(word[0] if len(word) == 1 else table[word])
        table[longer] = len(table) + 258
        word = data[k : k + 1]
        if len(table) >= 4093 - 258:
            put(word[0])
            put(256)
            table, word = {}, b""
    if word:
        put(word[0] if len(word) == 1 else table[word])
        table[None] = 0  # the reader's table grows with every code
    put(257)
    if held:
        out.append(hold << (8 - held) & 255)
    return bytes(out)


def tiff_unpacked(raw: bytes, at: int, size: int, packing: int, total: int) -> bytes:
    part = raw[at : at + size]
    if packing == 1:
        return part
    if packing == 5:
        return tiff_lzw_decode(part, total)
    return packbits(raw, at, size) if packing == 32773 else zlib.decompress(part)


def tiff_rows(data: bytes, order: str, w: int, h: int, parts: int, bits: int, differences: bool) -> np.ndarray:
    """[h, w, channels] of whole rows."""
    line = (w * parts * bits + 7) // 8
    need(len(data) >= line * h, "pixels end early")
    rows = np.frombuffer(data, np.uint8, line * h).reshape(h, line)
    v = bits_of(rows, bits, w * parts) if bits <= 8 else np.ascontiguousarray(rows).view(f"{order}u{bits // 8}")
    v = v.reshape(h, w, parts)
    return np.cumsum(v, 1, dtype=v.dtype) if differences and bits in (8, 16) else v


def tiff_pages(raw: bytes) -> list[tuple[np.ndarray, int, int, bool, np.ndarray | None]]:
    """(samples [h, w, channels], bits, what they mean, whether they are floats, palette) of each page, in strips or tiles."""
    order = "<" if raw[:2] == b"II" else ">"
    kinds = {1: "B", 2: "c", 3: "H", 4: "I"}
    at, out = struct.unpack_from(f"{order}I", raw, 4)[0], []
    while at:
        count = struct.unpack_from(f"{order}H", raw, at)[0]
        tags = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(f"{order}HHI", raw, at + 2 + 12 * k)
            if kind in kinds:
                size = n * struct.calcsize(kinds[kind])
                place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(f"{order}I", raw, at + 10 + 12 * k)[0]
                tags[tag] = struct.unpack_from(f"{order}{n}{kinds[kind]}", raw, place)
        at = struct.unpack_from(f"{order}I", raw, at + 2 + 12 * count)[0]
        get = lambda t, d, tags=tags: tags.get(t, (d,))[0]
        w, h, bits, packing, meaning, parts = (get(t, d) for t, d in ((256, 0), (257, 0), (258, 1), (259, 1), (262, 1), (277, 1)))
        floats, differences = get(339, 1) == 3, get(317, 1) == 2
        need(packing in (1, 5, 8, 32946, 32773) and bits in (1, 4, 8, 16, 32) and w * h > 0 and (bits < 32 or floats) and get(284, 1) == 1, "unknown kind of strips")
        if 322 in tags:
            tw, th = get(322, 0), get(323, 0)
            need(tw * th > 0, "tiles without a size")
            v, across = np.zeros((-(-h // th) * th, -(-w // tw) * tw, parts), f"u{max(1, bits // 8)}"), -(-w // tw)
            total = th * ((tw * parts * bits + 7) // 8)
            for i, (o, n) in enumerate(zip(tags[324], tags[325])):
                y, x = i // across * th, i % across * tw
                v[y : y + th, x : x + tw] = tiff_rows(tiff_unpacked(raw, o, n, packing, total), order, tw, th, parts, bits, differences)
            v = v[:h, :w]
        else:
            line, rows = (w * parts * bits + 7) // 8, min(h, get(278, h))
            strips = [tiff_unpacked(raw, o, n, packing, line * min(rows, h - i * rows)) for i, (o, n) in enumerate(zip(tags[273], tags[279]))]
            v = tiff_rows(b"".join(strips), order, w, h, parts, bits, differences)
        table = (np.array(tags[320]).reshape(3, -1).T >> 8).astype(np.uint8) if 320 in tags else None
        out.append((v, bits, meaning, floats, table))
    need(bool(out), "no pages")
    return out


def tiff_decode(raw: bytes) -> list[np.ndarray]:
    """8-bit frames; `deep` reads the same files at their own depth."""
    out = []
    for v, bits, meaning, floats, table in tiff_pages(raw):
        parts = v.shape[2]
        if floats:
            need(bits == 32, "floats of a size that isn't read")
            v = np.rint(np.clip(np.nan_to_num(np.ascontiguousarray(v).astype("<u4").view("<f4")), 0, 1) * 255).astype(np.uint8)
        elif bits == 16:
            v = (v >> 8).astype(np.uint8)
        if meaning == 3:
            need(table is not None, "no palette")
            out.append(from_rgb(table[v[..., 0]]))
        elif parts >= 3:
            out.append(from_rgb(v[..., :3], v[..., 3] if parts > 3 else None))
        else:
            g = v[..., 0] if bits >= 8 else (v[..., 0].astype(int) * 255 // ((1 << bits) - 1)).astype(np.uint8)
            out.append(from_gray(255 - g if meaning == 0 else g, v[..., 1] if parts == 2 and bits >= 8 else None))
    return out


#: How strips are packed, by name.
TIFF_PACKING = {"none": 1, "lzw": 5, "zlib": 8}


def tiff_bytes(pages: list[np.ndarray], packing: str = "zlib", tile: int = 0) -> bytes:
    """A file of samples [h, w, channels] of 8 or 16 bits or floats, in the order gray or red, green, blue, then alpha. tile: the side of
    tiles, a multiple of 16; 0 for one strip a page."""
    need(packing in TIFF_PACKING and tile % 16 == 0, "unknown packing or tiles")
    out, before = bytearray(b"II*\0" + bytes(4)), 4
    for v in pages:
        h, w, parts = v.shape
        floats, bits = v.dtype.kind == "f", 8 * v.dtype.itemsize
        v = v.astype(f"<{v.dtype.kind}{v.dtype.itemsize}")
        if tile:
            v = np.pad(v, ((0, -h % tile), (0, -w % tile), (0, 0)))
            cut = [v[y : y + tile, x : x + tile].tobytes() for y in range(0, v.shape[0], tile) for x in range(0, v.shape[1], tile)]
        else:
            cut = [v.tobytes()]
        coded = [zlib.compress(c, 6) if packing == "zlib" else tiff_lzw_encode(c) if packing == "lzw" else c for c in cut]
        places = []
        for c in coded:
            places.append(len(out))
            out += c + bytes(len(c) % 2)

        def kept(values: list[int], kind: str) -> int:
            """The values themselves if they fit into four bytes, else where they stand."""
            raw = struct.pack(f"<{len(values)}{kind}", *values)
            if len(raw) <= 4:
                return int.from_bytes(raw.ljust(4, b"\0"), "little")
            at = len(out)
            out.extend(raw + bytes(len(raw) % 2))
            return at

        tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, parts, kept([bits] * parts, "H")), (259, 3, 1, TIFF_PACKING[packing]), (262, 3, 1, 2 if parts > 2 else 1), (277, 3, 1, parts)]
        where, sizes = kept(places, "I"), kept([len(c) for c in coded], "I")
        tags += [(322, 4, 1, tile), (323, 4, 1, tile), (324, 4, len(coded), where), (325, 4, len(coded), sizes)] if tile else [(273, 4, 1, where), (278, 4, 1, h), (279, 4, 1, sizes)]
        if parts in (2, 4):
            tags.append((338, 3, 1, 2))
        if floats:
            tags.append((339, 3, parts, kept([3] * parts, "H")))
        struct.pack_into("<I", out, before, len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in sorted(tags)) + bytes(4)
        before = len(out) - 4
    return bytes(out)


def tiff_encode(frames: list[np.ndarray], packing: str = "zlib", tile: int = 0) -> bytes:
    """A page for each frame, 32 bits a pixel."""
    return tiff_bytes([p[..., [1, 2, 3, 0]] for p in frames], packing, tile)


CODECS[3:3] = [
    Codec("gif", ("gif",), lambda b: b[:6] in (b"GIF87a", b"GIF89a"), gif_decode, gif_encode, True),
    Codec("dds", ("dds",), lambda b: b[:4] == b"DDS ", dds_decode, dds_encode, True),
    Codec("psd", ("psd", "pdd"), lambda b: b[:4] == b"8BPS", psd_decode, psd_encode),
    Codec("tiff", ("tif", "tiff"), lambda b: b[:4] in (b"II*\0", b"MM\0*"), tiff_decode, tiff_encode, True),
]


register(Codec("jpeg", ("jpg", "jpeg", "jfif", "jpe", "jif"), lambda b: b[:3] == b"\xff\xd8\xff", jpeg.decode, lossy=jpeg.encode))


# the registry as a table


def supported(name: str) -> bool:
    """Whether some codec's masks fit a file's name; the file needn't exist."""
    return by_extension(name) is not None


def by_name(kind: str) -> Codec | None:
    """The first codec registered under a name."""
    return next((c for c in CODECS if c.name == kind), None)


def listing(spark: SparkSession) -> DataFrame:
    """(place, name, extension, masks, can_save, many) of all codecs, in the order of their registration."""
    rows = [(i, c.name, c.extensions[0], ";".join(c.masks), c.writes is not None, c.many) for i, c in enumerate(CODECS)]
    return spark.createDataFrame(rows, "place int, name string, extension string, masks string, can_save boolean, many boolean")


def dialog_filter(opening: bool = True) -> str:
    """`All Images (...)|...|name (masks)|masks|...` for a file dialog; saving has the formats that can be written, and no first entry."""
    some = [c for c in CODECS if opening or c.writes]
    entries = [(c.name, ";".join(c.masks)) for c in some]
    if opening:
        entries.insert(0, ("All Images", ";".join(m for _, m in entries)))
    return "|".join(f"{name} ({masks})|{masks}" for name, masks in entries)


def filter_extension(index: int, opening: bool = True) -> str:
    """The first extension of the filter's entry (from 1 on); empty for that of all images, and for what isn't there."""
    some = [c for c in CODECS if opening or c.writes]
    at = index - 1 - opening
    return some[at].extensions[0] if 0 <= at < len(some) else ""


def filter_index(name: str, opening: bool = True) -> int:
    """The filter's entry (from 1 on) for a file's name, 0 if none fits."""
    extension = name.rpartition(".")[2].lower()
    some = [c for c in CODECS if opening or c.writes]
    return next((i + 1 + opening for i, c in enumerate(some) if extension in c.extensions), 0)
