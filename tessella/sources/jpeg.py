"""JPEG: baseline and progressive files are read, baseline and progressive ones written.

Decoding reads the entropy-coded bits of a scan one symbol at a time (nothing else can), through a table of 16-bit prefixes; dequantising,
the inverse cosine transform, scaling of the colour components and conversion are numpy over all blocks at once. Encoding is
numpy throughout but for joining the codes of a scan.
"""

from __future__ import annotations

import struct

import numpy as np

#: The order of a block's coefficients in a file.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: The standard's example quantisation tables, row by row.
LUMA = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
        18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
CHROMA = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32

#: The cosine transform of eight values, orthonormal.
DCT = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class JpegError(ValueError):
    pass


# Huffman codes


def lengths_of(counts: np.ndarray) -> np.ndarray:
    """Code lengths, 16 at most, of symbols by their numbers; the code of only ones is left free."""
    import heapq

    used = np.flatnonzero(counts)
    heap = [(int(counts[s]), i, (int(s),)) for i, s in enumerate(used)] + [(0, len(used), (-1,))]  # -1: the code left free
    heapq.heapify(heap)
    depth, serial = dict.fromkeys([*map(int, used), -1], 0), len(heap)
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            depth[s] += 1
        heapq.heappush(heap, (n + m, serial, a + b))
        serial += 1
    per = np.zeros(max(max(depth.values()), 16) + 1, int)
    for d in depth.values():
        per[d] += 1
    for d in range(len(per) - 1, 16, -1):  # too long codes move up in pairs
        while per[d]:
            k = d - 2
            while not per[k]:
                k -= 1
            per[d] -= 2
            per[d - 1] += 1
            per[k + 1] += 2
            per[k] -= 1
    last = max(np.flatnonzero(per))
    per[last] -= 1
    return per[1:17]


def table_for(symbols: np.ndarray) -> tuple[list[int], list[int]]:
    """(number of codes by length, symbols in the order of their codes) for what a scan holds."""
    counts = np.bincount(symbols, minlength=256)
    per = lengths_of(counts) if counts.any() else np.array([1] + [0] * 15)
    order = sorted(np.flatnonzero(counts).tolist(), key=lambda s: (-counts[s], s)) or [0]
    return per.tolist(), order


def codes_of(per: list[int], order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) by symbol."""
    code, size, at, value = np.zeros(256, np.uint64), np.zeros(256, np.int64), 0, 0
    for length, n in enumerate(per, 1):
        for s in order[at : at + n]:
            code[s], size[s] = value, length
            value += 1
        at += n
        value <<= 1
    return code, size


def prefixes(per: list[int], order: list[int]) -> list[int]:
    """For each 16 bits what they begin with: length * 256 + symbol, 0 if nothing."""
    table, at, value = np.zeros(1 << 16, np.int64), 0, 0
    for length, n in enumerate(per, 1):
        for s in order[at : at + n]:
            low = value << (16 - length)
            table[low : low + (1 << (16 - length))] = length << 8 | s
            value += 1
        at += n
        value <<= 1
    return table.tolist()


class Bits:
    """The bits of one interval between restart marks."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.held, self.count = raw, 0, 0, 0

    def fill(self) -> None:
        part = self.raw[self.at : self.at + 8]
        self.at += 8
        self.held = (self.held & ((1 << self.count) - 1)) << 64 | int.from_bytes(part.ljust(8, b"\0"), "big")
        self.count += 64
        if self.at > len(self.raw) + 64:
            raise JpegError("pixels end early")

    def symbol(self, table: list[int]) -> int:
        if self.count < 16:
            self.fill()
        found = table[self.held >> (self.count - 16) & 0xFFFF]
        if not found:
            raise JpegError("unknown code")
        self.count -= found >> 8
        return found & 255

    def take(self, n: int) -> int:
        if not n:
            return 0
        if self.count < n:
            self.fill()
        self.count -= n
        return self.held >> self.count & ((1 << n) - 1)

    def number(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


class Part:
    """A colour component: its number, factors, quantisation table and coefficients [rows, columns, 64] in zigzag order."""

    def __init__(self, number: int, across: int, down: int, table: int):
        self.number, self.across, self.down, self.table = number, across, down, table
        self.coefficients, self.blocks, self.wide = [], (0, 0), 0  # wide: blocks in a row, whole units


def scan_intervals(raw: bytes, at: int) -> tuple[list[bytes], int]:
    """(the scan's intervals without stuffed bytes, where the next mark stands)."""
    out, start = [], at
    while True:
        at = raw.find(b"\xff", at)
        if at < 0 or at + 1 >= len(raw):
            out.append(raw[start:].replace(b"\xff\0", b"\xff"))
            return out, len(raw)
        mark = raw[at + 1]
        if mark == 0 or mark == 0xFF:
            at += 2 if mark == 0 else 1
        elif 0xD0 <= mark <= 0xD7:
            out.append(raw[start:at].replace(b"\xff\0", b"\xff"))
            at = start = at + 2
        else:
            out.append(raw[start:at].replace(b"\xff\0", b"\xff"))
            return out, at


def read_block(bits: Bits, block: list[int], part: Part, dc: list[int] | None, ac: list[int] | None, low: int, high: int, above: int, shift: int, state: list[int]) -> None:
    """One block of a scan. state: [the component's last DC, blocks left of a run of ended ones]."""
    if low == 0:
        if above:  # a further bit of what is known
            block[0] |= bits.take(1) << shift
        else:
            state[0] += bits.number(bits.symbol(dc))
            block[0] = state[0] << shift if state[0] >= 0 else -(-state[0] << shift)
        low = 1
        if high == 0:
            return
    if above:
        refine_block(bits, block, ac, low, high, 1 << shift, state)
        return
    if state[1]:
        state[1] -= 1
        return
    k = low
    while k <= high:
        found = bits.symbol(ac)
        run, size = found >> 4, found & 15
        if size:
            k += run
            if k > 63:
                raise JpegError("a run is too long")
            v = bits.number(size)
            block[k] = v << shift if v >= 0 else -(-v << shift)
            k += 1
        elif run == 15:
            k += 16
        else:
            state[1] = (1 << run) - 1 + bits.take(run)
            return


def refine_block(bits: Bits, block: list[int], ac: list[int], low: int, high: int, one: int, state: list[int]) -> None:
    def more(k: int) -> None:
        if bits.take(1) and not abs(block[k]) & one:
            block[k] += one if block[k] > 0 else -one

    k = low
    if not state[1]:
        while k <= high:
            found = bits.symbol(ac)
            run, size = found >> 4, found & 15
            new = 0
            if size:
                new = one if bits.take(1) else -one
            elif run < 15:
                state[1] = (1 << run) + bits.take(run)
                break
            while k <= high:
                if block[k]:
                    more(k)
                elif run:
                    run -= 1
                else:
                    break
                k += 1
            if new and k <= high:
                block[k] = new
            k += 1
    if state[1]:
        while k <= high:
            if block[k]:
                more(k)
            k += 1
        state[1] -= 1


def decode(raw: bytes) -> list[np.ndarray]:
    """One frame [h, w, 4] of alpha, red, green, blue. Gray, YCbCr, RGB, CMYK and YCCK files of 8 bits."""
    at, tables, dc, ac, parts, restart, adobe = 2, {}, {}, {}, [], 0, None
    size = None
    while at + 4 <= len(raw):
        if raw[at] != 0xFF:
            at += 1
            continue
        mark = raw[at + 1]
        if mark in (0xFF, 0x01) or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
            continue
        if mark == 0xD9:
            break
        (length,) = struct.unpack_from(">H", raw, at + 2)
        body, at = raw[at + 4 : at + 2 + length], at + 2 + length
        if mark == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                tables[number] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[1 + n :]
        elif mark == 0xC4:
            while body:
                per = list(body[1:17])
                n = sum(per)
                (ac if body[0] >> 4 else dc)[body[0] & 15] = prefixes(per, list(body[17 : 17 + n]))
                body = body[17 + n :]
        elif mark == 0xDD:
            (restart,) = struct.unpack(">H", body[:2])
        elif mark == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif mark in (0xC0, 0xC1, 0xC2):
            if body[0] != 8:
                raise JpegError("not 8 bits a sample")
            h, w = struct.unpack_from(">HH", body, 1)
            size = h, w
            parts = [Part(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            most = max(p.across for p in parts), max(p.down for p in parts)
            units = -(-w // (8 * most[0])), -(-h // (8 * most[1]))
            for p in parts:
                p.blocks = (-(-(-(-w * p.across // most[0])) // 8), -(-(-(-h * p.down // most[1])) // 8))
                p.wide = units[0] * p.across
                p.coefficients = [[0] * 64 for _ in range(p.wide * units[1] * p.down)]
        elif 0xC3 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise JpegError("a kind that isn't read")
        elif mark == 0xDA:
            if size is None:
                raise JpegError("no frame")
            n = body[0]
            used = [(next(p for p in parts if p.number == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
            low, high, approx = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
            intervals, at = scan_intervals(raw, at)
            read_scan(intervals, used, dc, ac, low, high, approx >> 4, approx & 15, restart, units)
    if size is None or not parts:
        raise JpegError("no frame")
    return [picture(parts, tables, size, adobe)]


def read_scan(intervals: list[bytes], used: list, dc: dict, ac: dict, low: int, high: int, above: int, shift: int, restart: int, units: tuple[int, int]) -> None:
    if len(used) == 1:
        p = used[0][0]
        order = [[(p, used[0][1], y * p.wide + x)] for y in range(p.blocks[1]) for x in range(p.blocks[0])]
    else:
        order = [[(p, t, (my * p.down + y) * p.wide + mx * p.across + x) for p, t in used for y in range(p.down) for x in range(p.across)] for my in range(units[1]) for mx in range(units[0])]
    step = restart or len(order)
    for i, data in enumerate(intervals[: -(-len(order) // step)]):
        bits, states = Bits(data), {p.number: [0, 0] for p, _ in used}
        for unit in order[i * step : (i + 1) * step]:
            for p, t, k in unit:
                read_block(bits, p.coefficients[k], p, dc.get(t >> 4), ac.get(t & 15), low, high, above, shift, states[p.number])


def picture(parts: list[Part], tables: dict, size: tuple[int, int], adobe: int | None) -> np.ndarray:
    h, w = size
    most = max(p.across for p in parts), max(p.down for p in parts)
    planes = []
    for p in parts:
        c = np.zeros((len(p.coefficients), 64))
        c[:, ZIGZAG] = np.array(p.coefficients, np.int64) * tables[p.table]
        v = np.einsum("ux,nuv,vy->nxy", DCT, c.reshape(-1, 8, 8), DCT) + 128
        v = np.clip(np.rint(v), 0, 255).reshape(-1, p.wide, 8, 8).transpose(0, 2, 1, 3).reshape(-1, p.wide * 8)
        planes.append(grown(grown(v, most[0] // p.across, 1, -(-w * p.across // most[0])), most[1] // p.down, 0, -(-h * p.down // most[1]))[:h, :w])
    out = np.zeros((h, w, 4), np.uint8)
    out[..., 0] = 255
    if len(planes) == 1:
        out[..., 1:] = planes[0][..., None]
        return out
    names = bytes(p.number for p in parts)
    if adobe in (1, 2) or (adobe is None and len(parts) == 3 and names != b"RGB"):
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        planes[:3] = [y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb]
    rgb = np.clip(np.rint(np.stack(planes[:3], 2)), 0, 255)
    if len(planes) == 4:  # inks, written inverted
        rgb = np.floor(rgb * planes[3][..., None] / 255)
    out[..., 1:] = rgb
    return out


def grown(v: np.ndarray, times: int, axis: int, used: int) -> np.ndarray:
    """Twice as many samples by weights of 3/4 and 1/4 of the nearer and the farther one, with the rounding that alternates; other
    factors by repetition."""
    v = np.moveaxis(v, axis, -1)[..., :used]
    if times == 2 and used > 2:
        before = np.concatenate([v[..., :1], v[..., :-1]], -1)
        after = np.concatenate([v[..., 1:], v[..., -1:]], -1)
        out = np.empty((*v.shape[:-1], 2 * used))
        out[..., 0::2] = np.floor((3 * v + before + 1) / 4)
        out[..., 1::2] = np.floor((3 * v + after + 2) / 4)
        v = out
    elif times > 1:
        v = np.repeat(v, times, -1)
    return np.moveaxis(v, -1, axis)


# encoding


def quantisers(quality: int) -> list[np.ndarray]:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMA, CHROMA)]


def blocks_of(plane: np.ndarray, across: int, down: int) -> np.ndarray:
    """[rows, columns, 64] in zigzag order, transformed; the plane is filled up at its edges to whole units."""
    h, w = plane.shape
    plane = np.pad(plane, ((0, -h % (8 * down)), (0, -w % (8 * across))), "edge") - 128
    rows, columns = plane.shape[0] // 8, plane.shape[1] // 8
    b = plane.reshape(rows, 8, columns, 8).transpose(0, 2, 1, 3)
    c = np.einsum("ux,rcxy,vy->rcuv", DCT, b, DCT)
    return c.reshape(rows, columns, 64)


def bit_sizes(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(float))[1].astype(np.int64)


def amplitude(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)


def symbols_of(c: np.ndarray, low: int, high: int) -> tuple[np.ndarray, ...]:
    """(block, place in it, symbol, its further bits, their number, whether DC) of coefficients [n, 64] in coding order; DC as
    differences already."""
    n = len(c)
    found = []
    if low == 0:
        size = bit_sizes(c[:, 0])
        found.append((np.arange(n), np.zeros(n, int), size, amplitude(c[:, 0], size), size, np.ones(n, bool)))
    if high:
        first = max(1, low)
        rows, places = np.nonzero(c[:, first : high + 1])
        places = places + first
        new = np.ones(rows.size, bool)
        new[1:] = rows[1:] != rows[:-1]
        before = np.where(new, first - 1, np.concatenate([[0], places[:-1]]))
        run, v = places - before - 1, c[rows, places]
        size = bit_sizes(v)
        found.append((rows, places * 2, (run % 16) << 4 | size, amplitude(v, size), size, np.zeros(rows.size, bool)))
        skips = run // 16
        r = np.repeat(rows, skips)
        found.append((r, np.repeat(places * 2 - 1, skips), np.full(r.size, 0xF0), np.zeros(r.size, np.uint64), np.zeros(r.size, int), np.zeros(r.size, bool)))
        last = np.full(n, first - 1)
        last[rows] = places  # the last place of a row is written last
        ended = np.flatnonzero(last < high)
        found.append((ended, np.full(ended.size, 200), np.zeros(ended.size, int), np.zeros(ended.size, np.uint64), np.zeros(ended.size, int), np.zeros(ended.size, bool)))
    joined = [np.concatenate(x) for x in zip(*found)]
    order = np.lexsort((joined[1], joined[0]))
    return tuple(x[order] for x in joined)


def joined_bits(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Values of up to 48 bits put one after the other, the last byte filled with ones, and a zero after each byte of ones."""
    total = int(sizes.sum())
    owner = np.repeat(np.arange(sizes.size), sizes)
    place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    bits = (values[owner] >> (sizes[owner] - 1 - place).astype(np.uint64) & np.uint64(1)).astype(np.uint8)
    return np.packbits(np.concatenate([bits, np.ones(-total % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\0")


def marker(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def scan(parts: list[tuple[int, np.ndarray]], low: int, high: int) -> bytes:
    """Tables and data of a scan over components (number, coefficients [n, 64] in coding order for all that the scan interleaves).

    parts: (component, units [u, k, 64]): k blocks of the component in each unit."""
    kinds = [0 if number == 1 else 1 for number, _ in parts]
    coded = []
    for (number, units), kind in zip(parts, kinds):
        u, k = units.shape[:2]
        c = units.reshape(u * k, 64).copy()
        if low == 0:
            c[1:, 0] -= units.reshape(u * k, 64)[:-1, 0]
        block, place, symbol, extra, size, is_dc = symbols_of(c, low, high)
        coded.append((block // k, np.full(block.size, len(coded)), block, place, symbol, extra, size, is_dc, np.full(block.size, kind)))
    unit, part, block, place, symbol, extra, size, is_dc, kind = (np.concatenate(x) for x in zip(*coded))
    order = np.lexsort((place, block, part, unit))
    symbol, extra, size, is_dc, kind = (x[order] for x in (symbol, extra, size, is_dc, kind))
    value, length, head = np.zeros(symbol.size, np.uint64), np.zeros(symbol.size, np.int64), b""
    for k in sorted(set(kinds)):
        for dc in (True, False):
            mine = (kind == k) & (is_dc == dc)
            if mine.any() or (dc and low == 0) or (not dc and high):
                per, names = table_for(symbol[mine])
                head += marker(0xC4, bytes([(0 if dc else 16) | k, *per, *names]))
                code, bits = codes_of(per, names)
                value[mine] = code[symbol[mine]] << size[mine].astype(np.uint64) | extra[mine]
                length[mine] = bits[symbol[mine]] + size[mine]
    head += marker(0xDA, bytes([len(parts), *(x for (n, _), k in zip(parts, kinds) for x in (n, k << 4 | k)), low, high, 0]))
    return head + joined_bits(value, length)


def encode(frames: list[np.ndarray], quality: int = 90, progressive: bool = False, gray: bool = False) -> bytes:
    """The first frame as YCbCr with colour at half the size each way, or its gray values. progressive: DC first, then bands of AC."""
    p = frames[0].astype(float)
    h, w = p.shape[:2]
    r, g, b = p[..., 1], p[..., 2], p[..., 3]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    tables = quantisers(max(1, min(100, quality)))
    planes = [(1, y, 2 if not gray else 1, 0)]
    if not gray:
        for n, c in ((2, -0.168735892 * r - 0.331264108 * g + 0.5 * b + 128), (3, 0.5 * r - 0.418687589 * g - 0.081312411 * b + 128)):
            c = np.pad(c, ((0, h % 2), (0, w % 2)), "edge")
            planes.append((n, c.reshape(c.shape[0] // 2, 2, c.shape[1] // 2, 2).mean((1, 3)), 1, 1))
    units, alone = [], []
    for n, plane, factor, t in planes:
        # all components have as many units, so the smaller ones are filled up to those of the first
        q = np.rint(blocks_of(np.rint(plane), factor, factor)[..., ZIGZAG] / tables[t][ZIGZAG]).astype(np.int64)
        rows, columns = q.shape[0] // factor, q.shape[1] // factor
        units.append((n, q.reshape(rows, factor, columns, factor, 64).transpose(0, 2, 1, 3, 4).reshape(rows * columns, factor * factor, 64)))
        alone.append((n, q[: -(-plane.shape[0] // 8), : -(-plane.shape[1] // 8)].reshape(-1, 1, 64)))
    out = b"\xff\xd8" + marker(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for t in range(1 if gray else 2):
        out += marker(0xDB, bytes([t, *tables[t][ZIGZAG].tolist()]))
    out += marker(0xC2 if progressive else 0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + bytes(x for n, _, f, t in planes for x in (n, f * 16 + f, t)))
    if progressive:
        out += scan(units, 0, 0)
        for low, high in ((1, 5), (6, 63)):
            for one in alone:
                out += scan([one], low, high)
    else:
        out += scan(units, 0, 63)
    return out + b"\xff\xd9"
