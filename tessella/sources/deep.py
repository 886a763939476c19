"""Files to typed frames and back without loss of depth: samples of 16 bits, floats, palettes.

Formats that hold 8-bit colours only come as A8R8G8B8, by their codec. Writing takes the pixel formats that a file format has
(WRITES) as they are and converts others to the nearest of them first.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.functions import arrow
from tessella.sources import codecs, formats
from tessella.sources.codecs import CodecError, chunk, need

Frame = tuple[int, int, str, bytes, bytes | None]  # width, height, pixel format, bits, palette

#: By channels: the formats of 8 and 16 bits.
DEEP = {1: ("Gray8", "Gray16"), 2: ("A8Gray8", "A16Gray16"), 3: ("R8G8B8", "R16G16B16"), 4: ("A8R8G8B8", "A16R16G16B16")}
#: The pixel formats that each file format is written with; the first one takes all the others.
WRITES = {
    "png": ("A8R8G8B8", "R8G8B8", "Gray8", "A8Gray8", "Gray16", "A16Gray16", "R16G16B16", "A16R16G16B16", "Index8"),
    "pgm": ("Gray8", "Gray16"), "ppm": ("R8G8B8", "R16G16B16"), "pam": ("A8R8G8B8", "R8G8B8", "Gray8", "A8Gray8", "Gray16", "A16Gray16", "R16G16B16", "A16R16G16B16"),
    "pfm": ("R32G32B32F", "R32F"), "hdr": ("R32G32B32F",),
    "tiff": ("A8R8G8B8", "R8G8B8", "Gray8", "A8Gray8", "Gray16", "A16Gray16", "R16G16B16", "A16R16G16B16", "R32F", "R32G32B32F", "A32R32G32B32F"),
}


def samples_bits(v: np.ndarray, bits: int) -> tuple[str, bytes]:
    """(pixel format, bits) of samples [h, w, channels] in the order gray or red, green, blue, then alpha."""
    count = v.shape[2]
    order = {1: [0], 2: [0, 1], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[count]
    return DEEP[count][bits > 8], np.ascontiguousarray(v[..., order]).astype("<u2" if bits > 8 else np.uint8).tobytes()


def bits_samples(name: str, w: int, h: int, raw: bytes) -> tuple[np.ndarray, int]:
    """(samples [h, w, channels], bits) of one of those formats."""
    count, deep = next((n, d) for n, pair in DEEP.items() for d, f in enumerate(pair) if f == name)
    v = np.frombuffer(raw, "<u2" if deep else np.uint8).reshape(h, w, count)
    return v[..., {1: [0], 2: [0, 1], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[count]], 16 if deep else 8


def png_read(raw: bytes) -> list[Frame]:
    """Still images at their own depth; animated ones and those with a transparent colour at 8 bits by the codec."""
    at, palette, clear, data, head = 8, None, None, b"", None
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
        elif name == b"IDAT":
            data += body
        elif name == b"fcTL":
            return plain_frames(codecs.png_decode(raw))
    need(head is not None, "no header")
    w, h, bits, kind, _, _, laced = head
    if clear and kind != 3:
        return plain_frames(codecs.png_decode(raw))
    v = codecs.png_samples(data, w, h, bits, kind, laced)
    if kind == 3:
        need(palette is not None, "no palette")
        entries = np.zeros((256, 4), np.uint8)
        entries[:, 3] = 255
        entries[: len(palette), :3] = palette[:, ::-1]
        if clear:
            entries[: len(clear), 3] = np.frombuffer(clear, np.uint8)[:256]
        return [(w, h, "Index8", v[..., 0].astype(np.uint8).tobytes(), entries.tobytes())]
    if bits < 8:
        v = v.astype(int) * 255 // ((1 << bits) - 1)
    return [(w, h, *samples_bits(v, bits), None)]


def png_write(w: int, h: int, name: str, raw: bytes, palette: bytes | None) -> bytes:
    more = b""
    if name == "Index8":
        v, bits, kind = np.frombuffer(raw, np.uint8).reshape(h, w, 1), 8, 3
        entries = np.frombuffer(palette, np.uint8).reshape(256, 4) if palette else formats.gray_palette()
        more = chunk(b"PLTE", entries[:, 2::-1].tobytes()) + chunk(b"tRNS", entries[:, 3].tobytes())
    else:
        v, bits = bits_samples(name, w, h, raw)
        kind = {1: 0, 2: 4, 3: 2, 4: 6}[v.shape[2]]
    rows = v.astype(">u2" if bits > 8 else np.uint8).tobytes()
    rows = np.frombuffer(rows, np.uint8).reshape(h, -1)
    lines = np.zeros((h, rows.shape[1] + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = 2, rows
    lines[1:, 1:] -= rows[:-1]
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, kind, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + more + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def pnm_read(raw: bytes) -> list[Frame]:
    if raw[:2] in (b"PF", b"Pf"):
        m = re.compile(rb"P[Ff]\s+(\d+)\s+(\d+)\s+(\S+)\s").match(raw)
        need(bool(m), "header ends early")
        w, h, count = int(m[1]), int(m[2]), 3 if raw[:2] == b"PF" else 1
        v = np.frombuffer(raw, "<f4" if float(m[3]) < 0 else ">f4", w * h * count, m.end()).reshape(h, w, count)[::-1]
        return [(w, h, "R32G32B32F" if count == 3 else "R32F", np.ascontiguousarray(v[..., ::-1]).astype("<f4").tobytes(), None)]
    v, top = codecs.pnm_samples(raw)
    if top == 1 and raw[:2] in (b"P1", b"P4"):
        v, top = (1 - v), 1
    bits = 16 if top > 255 else 8
    most = (1 << bits) - 1
    h, w = v.shape[:2]
    return [(w, h, *samples_bits(v if top == most else v * most // top, bits), None)]


def pnm_write(w: int, h: int, name: str, raw: bytes, palette: bytes | None) -> bytes:
    v, bits = bits_samples(name, w, h, raw)
    head = b"P%d\n%d %d\n%d\n" % (5 if v.shape[2] == 1 else 6, w, h, (1 << bits) - 1)
    return head + v.astype(">u2" if bits > 8 else np.uint8).tobytes()


def pam_write(w: int, h: int, name: str, raw: bytes, palette: bytes | None) -> bytes:
    v, bits = bits_samples(name, w, h, raw)
    kind = {1: b"GRAYSCALE", 2: b"GRAYSCALE_ALPHA", 3: b"RGB", 4: b"RGB_ALPHA"}[v.shape[2]]
    head = b"P7\nWIDTH %d\nHEIGHT %d\nDEPTH %d\nMAXVAL %d\nTUPLTYPE %s\nENDHDR\n" % (w, h, v.shape[2], (1 << bits) - 1, kind)
    return head + v.astype(">u2" if bits > 8 else np.uint8).tobytes()


def pfm_write(w: int, h: int, name: str, raw: bytes, palette: bytes | None) -> bytes:
    count = 1 if name == "R32F" else 3
    v = np.frombuffer(raw, "<f4").reshape(h, w, count)[::-1, :, ::-1]
    return b"%s\n%d %d\n-1.0\n" % (b"Pf" if count == 1 else b"PF", w, h) + np.ascontiguousarray(v).tobytes()


def hdr_read(raw: bytes) -> list[Frame]:
    v = codecs.hdr_floats(raw)
    return [(v.shape[1], v.shape[0], "R32G32B32F", np.ascontiguousarray(v[..., ::-1]).astype("<f4").tobytes(), None)]


def hdr_write(w: int, h: int, name: str, raw: bytes, palette: bytes | None) -> bytes:
    v = np.maximum(0, np.frombuffer(raw, "<f4").reshape(h, w, 3)[..., ::-1].astype(float))
    return codecs.hdr_bytes(v)


def tiff_read(raw: bytes) -> list[Frame]:
    """Pages of 8 and 16 bits and of floats at their own depth; palettes, inverted gray and fewer bits by the codec."""
    out = []
    for (v, bits, meaning, floats, _), p in zip(codecs.tiff_pages(raw), codecs.tiff_decode(raw)):
        h, w, parts = v.shape
        if floats and parts in (1, 3, 4):
            x = np.ascontiguousarray(v[..., {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[parts]]).astype("<u4")
            out.append((w, h, {1: "R32F", 3: "R32G32B32F", 4: "A32R32G32B32F"}[parts], x.tobytes(), None))
        elif not floats and bits in (8, 16) and meaning in (1, 2) and parts <= 4:
            out.append((w, h, *samples_bits(v, bits), None))
        else:
            out += plain_frames([p])
    return out


def tiff_write(w: int, h: int, name: str, raw: bytes, palette: bytes | None) -> bytes:
    if formats.named(name).kind == "float":
        count = formats.named(name).size // 4
        v = np.frombuffer(raw, "<f4").reshape(h, w, count)[..., {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[count]]
    else:
        v = bits_samples(name, w, h, raw)[0]
    return codecs.tiff_bytes([np.ascontiguousarray(v)])


def plain_frames(frames: list[np.ndarray]) -> list[Frame]:
    return [(p.shape[1], p.shape[0], "A8R8G8B8", p[..., ::-1].tobytes(), None) for p in frames]


READERS: dict[str, Callable[[bytes], list[Frame]]] = {"png": png_read, "ppm": pnm_read, "pgm": pnm_read, "pam": pnm_read, "pfm": pnm_read, "hdr": hdr_read, "tiff": tiff_read}
WRITERS: dict[str, Callable[..., bytes]] = {"png": png_write, "pgm": pnm_write, "ppm": pnm_write, "pam": pam_write, "pfm": pfm_write, "hdr": hdr_write, "tiff": tiff_write}


def compatible(kind: str, pixel_format: str) -> str:
    """The pixel format that a frame is written with in a file format: its own if there is such, else one of its depth and class
    if there is, else the file format's first."""
    known = WRITES.get(kind, ("A8R8G8B8",))
    if pixel_format in known:
        return pixel_format
    f = formats.named(pixel_format)
    deep = f.kind == "float" or f.size >= 6 or pixel_format in ("Gray32", "Gray64")
    if f.kind not in ("argb", "gray", "float"):
        return compatible(kind, formats.NEAREST[pixel_format]) if pixel_format in formats.NEAREST else known[0]
    gray = f.kind == "gray"
    wishes = ["A32R32G32B32F" if f.alpha else "R32G32B32F"] if f.kind == "float" else []
    wishes += [DEEP[(1 if gray else 3) + f.alpha][deep], DEEP[1 if gray else 3][deep], DEEP[1][deep]]
    return next((w for w in wishes if w in known), known[0])


def decode(table: DataFrame, load_as: str | None = None) -> DataFrame:
    """Typed frames (path, frame_idx, width, height, pixel_format, bits, palette, error) of (path, content). A file that can't be
    decoded gives a row with its error. load_as: a pixel format that all frames are converted to."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in arrow.parts(batches, "content"):
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                raw = raw or b""
                codec = codecs.detect(raw, path or "")
                try:
                    need(codec is not None, "unknown format")
                    read = READERS.get(codec.name)
                    made = [(path, i, *f, None) for i, f in enumerate(read(raw) if read else plain_frames(codec.decode(raw)))]
                except Exception as e:  # a broken file is a row, not a failed job
                    made = [(path, 0, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield from made

    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.string()]
    names = ["path", "frame_idx", *formats.TYPED, "error"]
    schema = "path string, frame_idx int, width int, height int, pixel_format string, bits binary, palette binary, error string"
    found = arrow.through(arrow.narrowed(table, "path", "content"), lambda batches: arrow.gathered(rows(batches), names, types), schema)
    return formats.convert(found, load_as) if load_as else found


def encode(frames: DataFrame, kind: str, key: str = "image_id", save_as: str | None = None) -> DataFrame:
    """(key, content): a file for each typed frame. save_as: a pixel format that frames are converted to first."""
    codec = codecs.by_name(kind)
    if codec is None or codec.writes is None:
        raise ValueError(f"{kind} can't be written")
    make = WRITERS.get(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow.parts(batches, "bits"):
            b, made = b.filter(b.column("bits").is_valid()), []
            for row in zip(*(b.column(c).to_pylist() for c in ("width", "height", "pixel_format", "bits", "palette"))):
                w, h, name, raw, palette = row
                for to in (save_as or name, compatible(kind, save_as or name)):
                    w, h, raw, palette = formats.converted(w, h, name, raw, palette, to)
                    name = to
                made.append(make(w, h, name, raw, palette) if make else codec.writes([np.frombuffer(raw, np.uint8).reshape(h, w, 4)[..., ::-1]]))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(made, pa.binary())], names=[key, "content"])

    return arrow.through(arrow.narrowed(frames, key, *formats.TYPED), run, f"{key} {frames.schema[key].dataType.simpleString()}, content binary")
