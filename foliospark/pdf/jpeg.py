"""JPEG with numpy: an encoder of baseline and progressive files with fitted Huffman tables, and a decoder.

The encoder's pixels can be had without its bytes (`Scan.pixels`), so that a search for a quality decodes what it would write
without writing it. The decoder reads sequential and progressive files of 8 bits with Huffman codes, and says no to others.
"""

from __future__ import annotations

import heapq

import numpy as np

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: The quantisation tables of ITU-T T.81, annex K.1.
LUMA = np.array([
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
])
CHROMA = np.array([
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
])
_K = np.arange(8)
DCT = np.sqrt(np.where(_K == 0, 1, 2) / 8)[:, None] * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)
MOST_ENDED = 0x7FFF  # blocks that one symbol can end
BANDS = [(1, 5), (6, 63)]  # of a progressive file's scans after the mean values
FULL_CHROMA = 90  # the quality from which colour isn't subsampled


class Unreadable(ValueError):
    """No JPEG of a kind that is read here, or a damaged one."""


def quantisers(quality: int) -> tuple[np.ndarray, np.ndarray]:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return tuple(np.clip((t * scale + 50) // 100, 1, 255) for t in (LUMA, CHROMA))


def _blocks(plane: np.ndarray, across: int, down: int) -> np.ndarray:
    """(rows, columns, 8, 8) blocks of a plane, its edge repeated to multiples of 8*down by 8*across."""
    h, w = plane.shape
    padded = np.pad(plane, ((0, -h % (8 * down)), (0, -w % (8 * across))), mode="edge")
    return padded.reshape(padded.shape[0] // 8, 8, padded.shape[1] // 8, 8).transpose(0, 2, 1, 3)


def _plane(blocks: np.ndarray) -> np.ndarray:
    r, c = blocks.shape[:2]
    return blocks.transpose(0, 2, 1, 3).reshape(r * 8, c * 8)


def to_ycc(rgb: np.ndarray) -> list[np.ndarray]:
    r, g, b = (rgb[..., k].astype(float) for k in range(3))
    return [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]


def to_rgb(y, cb, cr) -> np.ndarray:
    cb, cr = cb - 128, cr - 128
    return np.clip(np.round(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)), 0, 255).astype(np.uint8)


class Scan:
    """An image's transformed blocks, for any quality on its side of FULL_CHROMA."""

    def __init__(self, image: np.ndarray, full: bool):
        self.shape, self.grey = image.shape[:2], image.ndim == 2
        self.step = 1 if full or self.grey else 2
        planes = [image.astype(float)] if self.grey else to_ycc(image)
        s = self.step
        if s == 2:
            halved = []
            for p in planes[1:]:
                p = np.pad(p, ((0, p.shape[0] % 2), (0, p.shape[1] % 2)), mode="edge")
                halved.append((p[::2, ::2] + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2]) / 4)
            planes[1:] = halved
        self.blocks = [DCT @ (_blocks(p, s if k == 0 else 1, s if k == 0 else 1) - 128) @ DCT.T for k, p in enumerate(planes)]
        rows, cols = self.blocks[0].shape[0] // s, self.blocks[0].shape[1] // s
        self.blocks[1:] = [b[:rows, :cols] for b in self.blocks[1:]]

    def quantised(self, quality: int) -> list[np.ndarray]:
        tables = quantisers(quality)
        return [np.round(b / tables[min(k, 1)].reshape(8, 8)).astype(np.int64) for k, b in enumerate(self.blocks)]

    def pixels(self, quality: int) -> np.ndarray:
        """What a decoder makes of it."""
        tables = quantisers(quality)
        return _restore([q * tables[min(k, 1)].reshape(8, 8) for k, q in enumerate(self.quantised(quality))], self.shape, [self.step] + [1] * (len(self.blocks) - 1))

    def encode(self, quality: int, progressive: bool = False) -> bytes:
        s, found = self.step, []
        rows, cols = self.blocks[0].shape[0] // s, self.blocks[0].shape[1] // s
        unit = s * s + (0 if self.grey else 2)
        blocks = self.quantised(quality)
        for k, q in enumerate(blocks):
            r, c = np.divmod(np.arange(q.shape[0] * q.shape[1]), q.shape[1])
            place = ((r // s) * cols + c // s) * unit + (r % s) * s + c % s if k == 0 else (r * cols + c) * unit + s * s + k - 1
            order = np.argsort(place, kind="stable")
            found.append((place[order], q.reshape(-1, 64)[order][:, ZIGZAG]))
        assert rows * cols * unit == sum(len(p) for p, _ in found)
        h, w = self.shape
        tables = quantisers(quality)[: 1 if self.grey else 2]
        out = b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"
        out += b"".join(b"\xff\xdb\x00\x43" + bytes([i]) + t[ZIGZAG].astype(np.uint8).tobytes() for i, t in enumerate(tables))
        parts = b"".join(bytes([k + 1, 0x11 * (s if k == 0 else 1), min(k, 1)]) for k in range(len(found)))
        out += (b"\xff\xc2" if progressive else b"\xff\xc0") + (8 + len(parts)).to_bytes(2, "big") + b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([len(found)]) + parts
        symbols = [_symbols(place, q, k) for k, (place, q) in enumerate(found)]
        if progressive:
            return out + self._dc_scan(symbols) + b"".join(self._ac_scan(k, q, *band) for band in BANDS for k, q in enumerate(blocks)) + b"\xff\xd9"
        codes = {}
        for table in range(len(tables)):
            for kind in (0, 1):
                used = np.concatenate([sy[(kd == kind)] for k, (_, kd, sy, _, _) in enumerate(symbols) if min(k, 1) == table])
                counts, values = _code_lengths(np.bincount(used, minlength=256))
                codes[table, kind] = _codes(counts, values)
                out += _huffman(kind, table, counts, values)
        out += b"\xff\xda" + (6 + 2 * len(found)).to_bytes(2, "big") + bytes([len(found)])
        out += b"".join(bytes([k + 1, 0x11 * min(k, 1)]) for k in range(len(found))) + b"\x00\x3f\x00"
        place, value, length = [], [], []
        for k, (at, kind, symbol, extra, size) in enumerate(symbols):
            code, bits = (np.where(kind == 0, codes[min(k, 1), 0][i][symbol], codes[min(k, 1), 1][i][symbol]) for i in (0, 1))
            place.append(at)
            value.append(code << size | extra)
            length.append(bits + size)
        place, value, length = (np.concatenate(x) for x in (place, value, length))
        order = np.argsort(place, kind="stable")
        return out + _pack(value[order], length[order]) + b"\xff\xd9"

    def _dc_scan(self, symbols) -> bytes:
        """The mean values of all components, interleaved."""
        out, place, value, length = b"", [], [], []
        for k, (at, kind, symbol, extra, size) in enumerate(symbols):
            if k < 2:
                counts, values = _code_lengths(np.bincount(np.concatenate([x[2][x[1] == 0] for x in symbols[k : (1, 3)[k]]]), minlength=256))
                code, bits = _codes(counts, values)
                out += _huffman(0, k, counts, values)
            dc = kind == 0
            place.append(at[dc])
            value.append(code[symbol[dc]] << size[dc] | extra[dc])
            length.append(bits[symbol[dc]] + size[dc])
        place, value, length = (np.concatenate(x) for x in (place, value, length))
        order = np.argsort(place, kind="stable")
        out += b"\xff\xda" + (6 + 2 * len(symbols)).to_bytes(2, "big") + bytes([len(symbols)])
        out += b"".join(bytes([k + 1, 0x10 * min(k, 1)]) for k in range(len(symbols))) + b"\x00\x00\x00"
        return out + _pack(value[order], length[order])

    def _ac_scan(self, k: int, q: np.ndarray, first: int, last: int) -> bytes:
        """One band of one component, of the blocks that the image reaches."""
        h, w = (-(-n // (1 if k == 0 else self.step)) for n in self.shape)
        q = q[: -(-h // 8), : -(-w // 8)].reshape(-1, 64)[:, ZIGZAG[first : last + 1]]
        at, symbol, extra, size = _band_symbols(q)
        order = np.argsort(at, kind="stable")
        symbol, extra, size = symbol[order], extra[order], size[order]
        counts, values = _code_lengths(np.bincount(symbol, minlength=256))
        code, bits = _codes(counts, values)
        out = _huffman(1, min(k, 1), counts, values) + b"\xff\xda\x00\x08\x01" + bytes([k + 1, min(k, 1), first, last, 0])
        return out + _pack(code[symbol] << size | extra, bits[symbol] + size)


def _restore(blocks, shape, steps) -> np.ndarray:
    planes = []
    h, w = shape
    for b, _ in zip(blocks, steps, strict=True):
        planes.append(np.clip(_plane(DCT.T @ b @ DCT) + 128, 0, 255))
    if len(planes) == 1:
        return np.round(planes[0][:h, :w]).astype(np.uint8)
    full = []
    for p in planes:
        down, across = -(-planes[0].shape[0] // p.shape[0]), -(-planes[0].shape[1] // p.shape[1])
        full.append(np.repeat(np.repeat(p, down, 0), across, 1)[:h, :w])
    return to_rgb(*full)


def _size(v: np.ndarray) -> np.ndarray:
    return np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)


def _symbols(place: np.ndarray, q: np.ndarray, component: int):
    """(sort key, kind 0 DC or 1 AC, symbol, extra bits, their number) of a component's blocks in scan order."""
    dc = np.diff(q[:, 0], prepend=0)
    size = _size(dc)
    parts = [(place * 256, np.zeros(len(dc), np.int64), size, np.where(dc < 0, dc + (1 << size) - 1, dc), size)]
    block, at = np.nonzero(q[:, 1:])
    v, at = q[block, at + 1], at + 1
    before = np.where(np.concatenate([[True], block[1:] != block[:-1]]) if len(block) else np.zeros(0, bool), 0, np.concatenate([[0], at[:-1]]) if len(at) else at)
    run = at - before - 1
    size = _size(v)
    one = np.ones(len(v), np.int64)
    parts.append((place[block] * 256 + at * 4 + 3, one, (run % 16) << 4 | size, np.where(v < 0, v + (1 << size) - 1, v), size))
    long = run // 16
    again = np.repeat(np.arange(len(v)), long)
    zero = np.zeros(len(again), np.int64)
    parts.append((place[block[again]] * 256 + at[again] * 4, zero + 1, zero + 0xF0, zero, zero))
    last = np.zeros(len(q), np.int64)
    np.maximum.at(last, block, at)
    ends = np.flatnonzero(last < 63)
    zero = np.zeros(len(ends), np.int64)
    parts.append((place[ends] * 256 + 255, zero + 1, zero, zero, zero))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _band_symbols(q: np.ndarray):
    """(sort key, symbol, extra bits, their number) of a band of blocks in scan order; runs of ended blocks share a symbol."""
    n, width = q.shape
    block, at = np.nonzero(q)
    v = q[block, at]
    fresh = np.concatenate([[True], block[1:] != block[:-1]]) if len(block) else np.zeros(0, bool)
    run = at - np.where(fresh, -1, np.concatenate([[-1], at[:-1]])[: len(at)]) - 1
    size = _size(v)
    parts = [(block * 256 + at * 2 + 1, (run % 16) << 4 | size, np.where(v < 0, v + (1 << size) - 1, v), size)]
    again = np.repeat(np.arange(len(v)), run // 16)
    zero = np.zeros(len(again), np.int64)
    parts.append((block[again] * 256 + at[again] * 2, zero + 0xF0, zero, zero))
    last = np.full(n, -1)
    np.maximum.at(last, block, at)
    ended, empty = last < width - 1, last < 0
    follows = np.concatenate([[False], ended[:-1]])
    heads = np.flatnonzero(ended & ~(empty & follows))
    upto = np.flatnonzero(ended & ~np.concatenate([(empty & ended)[1:], [False]])) + 1
    pieces = -(-(upto - heads) // MOST_ENDED)
    which = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(heads, pieces) + which * MOST_ENDED
    length = np.minimum(np.repeat(upto, pieces) - start, MOST_ENDED)
    size = _size(length) - 1
    parts.append((start * 256 + 255, size << 4, length - (1 << size), size))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _huffman(kind: int, table: int, counts: list[int], values: list[int]) -> bytes:
    return b"\xff\xc4" + (19 + len(values)).to_bytes(2, "big") + bytes([kind << 4 | table]) + bytes(counts) + bytes(values)


def _code_lengths(freq: np.ndarray) -> tuple[list[int], list[int]]:
    """(number of codes of 1 to 16 bits, symbols by length): a prefix code that leaves all-ones unused."""
    used = [int(s) for s in np.flatnonzero(freq)] or [0]
    heap = [(int(max(freq[s], 1)), s, (s,)) for s in used] + [(0, 256, (256,))]
    heapq.heapify(heap)
    depth = dict.fromkeys([*used, 256], 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], max(a[1], b[1]), a[2] + b[2]))
    counts = [0] * 258
    for d in depth.values():
        counts[max(d, 1)] += 1
    for i in range(257, 16, -1):  # shorten codes of over 16 bits
        while counts[i]:
            j = i - 2
            while not counts[j]:
                j -= 1
            counts[i] -= 2
            counts[i - 1] += 1
            counts[j + 1] += 2
            counts[j] -= 1
    longest = max(i for i in range(1, 17) if counts[i])
    counts[longest] -= 1  # the reserved code
    return counts[1:17], sorted(used, key=lambda s: (depth[s], s))


def _codes(counts: list[int], values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    code, at, out, bits = 0, 0, np.zeros(256, np.int64), np.zeros(256, np.int64)
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[values[at]], bits[values[at]] = code, length
            code, at = code + 1, at + 1
        code <<= 1
    return out, bits


def _pack(value: np.ndarray, length: np.ndarray) -> bytes:
    ends = np.cumsum(length)
    item = np.repeat(np.arange(len(length)), length)
    shift = np.repeat(ends, length) - 1 - np.arange(ends[-1] if len(ends) else 0)
    bits = (value[item] >> shift & 1).astype(np.uint8)
    bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


# -- decoding -------------------------------------------------------------------------------------------------------------------


def decode(data: bytes) -> np.ndarray:
    """Grey (h, w) or RGB (h, w, 3) samples; of four components, (h, w, 4) as stored."""
    if data[:2] != b"\xff\xd8":
        raise Unreadable("no JPEG")
    at, quant, huffman, frame, restart, adobe = 2, {}, {}, None, 0, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker in (0xFF, 0x00, 0x01) or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0] >> 4, body[0] & 15] = _lookup(list(body[1:17]), list(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1, 0xC2):
            if body[0] != 8:
                raise Unreadable("not 8 bits")
            h, w = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            frame = _Frame(h, w, parts, marker == 0xC2)
        elif 0xC3 <= marker <= 0xCF and marker != 0xC8:
            raise Unreadable("neither sequential nor progressive with Huffman codes")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker == 0xDA:
            if frame is None:
                raise Unreadable("a scan before its frame")
            names = [p[0] for p in frame.parts]
            chosen = [(names.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            first, last, approximation = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            end = at
            while end + 1 < len(data) and not (data[end] == 0xFF and data[end + 1] not in (0x00, 0xFF) and not 0xD0 <= data[end + 1] <= 0xD7):
                end += 1
            frame.scan(_Bits(data[at:end]), huffman, chosen, first, last, approximation >> 4, approximation & 15, restart)
            at = end
    if frame is None or not frame.scans:
        raise Unreadable("no scan")
    return frame.samples(quant, adobe)


def _lookup(counts: list[int], values: list[int]) -> dict[tuple[int, int], int]:
    code, at, out = 0, 0, {}
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = values[at]
            code, at = code + 1, at + 1
        code <<= 1
    table = np.zeros((1 << 16, 2), np.int32)
    for (length, code), v in out.items():
        table[code << (16 - length) : (code + 1) << (16 - length)] = (length, v)
    return table[:, 0].tolist(), table[:, 1].tolist()


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def fill(self, n: int) -> None:
        while self.n < n:
            b = self.data[self.at] if self.at < len(self.data) else 0
            if b == 0xFF:
                follow = self.data[self.at + 1] if self.at + 1 < len(self.data) else 0xD9
                if follow:
                    self.held, self.n = self.held << 8, self.n + 8  # a marker: zeros from here on
                    continue
                self.at += 1
            self.at += 1
            self.held, self.n = (self.held << 8 | b) & 0xFFFFFFFFFFFF, self.n + 8

    def symbol(self, table) -> int:
        self.fill(16)
        top = self.held >> (self.n - 16) & 0xFFFF
        length = table[0][top]
        if not length:
            raise Unreadable("no such code")
        self.n -= length
        return table[1][top]

    def signed(self, size: int) -> int:
        if not size:
            return 0
        self.fill(size)
        self.n -= size
        v = self.held >> self.n & ((1 << size) - 1)
        return v if v >> (size - 1) else v - (1 << size) + 1

    def take(self, size: int) -> int:
        self.fill(size)
        self.n -= size
        return self.held >> self.n & ((1 << size) - 1)

    def restart(self) -> None:
        self.held = self.n = 0
        while self.at + 1 < len(self.data) and not (self.data[self.at] == 0xFF and 0xD0 <= self.data[self.at + 1] <= 0xD7):
            self.at += 1
        self.at += 2


class _Frame:
    """The coefficients of a file, which its scans fill."""

    def __init__(self, h: int, w: int, parts: list[tuple[int, int, int, int]], progressive: bool):
        if len(parts) == 1:
            parts = [(parts[0][0], 1, 1, parts[0][3])]
        self.h, self.w, self.parts, self.progressive, self.scans = h, w, parts, progressive, 0
        self.across, self.down = max(p[1] for p in parts), max(p[2] for p in parts)
        self.cols, self.rows = -(-w // (8 * self.across)), -(-h // (8 * self.down))
        self.blocks = [np.zeros((self.rows * v, self.cols * u, 64), np.int64) for _, u, v, _ in parts]

    def units(self, components: list[int]):
        """(component, block) of each coded unit in order; a scan of one component has only blocks that the image reaches."""
        if len(components) == 1:
            k = components[0]
            _, u, v, _ = self.parts[k]
            h, w = -(-self.h * v // self.down), -(-self.w * u // self.across)
            for row in self.blocks[k][: -(-h // 8), : -(-w // 8)]:
                for block in row:
                    yield [(k, block)]
            return
        for r in range(self.rows):
            for c in range(self.cols):
                unit = []
                for k in components:
                    _, u, v, _ = self.parts[k]
                    unit += [(k, self.blocks[k][r * v + y, c * u + x]) for y in range(v) for x in range(u)]
                yield unit

    def scan(self, bits: _Bits, huffman, chosen, first: int, last: int, high: int, low: int, restart: int) -> None:
        self.scans += 1
        tables = {k: (huffman.get((0, dc)), huffman.get((1, ac))) for k, dc, ac in chosen}
        before, ended, zig = dict.fromkeys(tables, 0), 0, ZIGZAG.tolist()
        for n, unit in enumerate(self.units(list(tables))):
            if restart and n and n % restart == 0:
                bits.restart()
                before, ended = dict.fromkeys(tables, 0), 0
            for k, block in unit:
                dc, ac = tables[k]
                if not self.progressive:
                    before[k] += bits.signed(bits.symbol(dc))
                    block[0] = before[k]
                    _first_pass(bits, ac, block, zig, 1, 63, 0, 0)
                elif not first:
                    if not high:
                        before[k] += bits.signed(bits.symbol(dc))
                        block[0] = before[k] << low
                    elif bits.take(1):
                        block[0] |= 1 << low
                elif not high:
                    ended = _first_pass(bits, ac, block, zig, first, last, low, ended)
                else:
                    ended = _next_pass(bits, ac, block, zig, first, last, 1 << low, ended)

    def samples(self, quant, adobe) -> np.ndarray:
        planes = []
        for (_, u, v, q), blocks in zip(self.parts, self.blocks, strict=True):
            table = np.zeros(64, np.int64)
            table[ZIGZAG] = quant[q]
            p = np.clip(_plane(DCT.T @ (blocks * table).reshape(*blocks.shape[:2], 8, 8) @ DCT) + 128, 0, 255)
            planes.append(np.repeat(np.repeat(p, self.down // v, 0), self.across // u, 1)[: self.h, : self.w])
        if len(planes) == 1:
            return np.round(planes[0]).astype(np.uint8)
        if len(planes) == 3 and adobe != 0:
            return to_rgb(*planes)
        if len(planes) == 4 and adobe == 2:
            planes[:3] = list(np.moveaxis(to_rgb(*planes[:3]).astype(float), -1, 0))
        return np.round(np.stack(planes, -1)).astype(np.uint8)


def _first_pass(bits: _Bits, table, block, zig, first: int, last: int, low: int, ended: int) -> int:
    """Read a band of a block; returns how many blocks after it have none."""
    if ended:
        return ended - 1
    i = first
    while i <= last:
        s = bits.symbol(table)
        run, size = s >> 4, s & 15
        if not size:
            if run < 15:
                return (1 << run) - 1 + bits.take(run)
            i += 16
            continue
        i += run
        if i > last:
            raise Unreadable("too long a run")
        block[zig[i]] = bits.signed(size) * (1 << low)
        i += 1
    return 0


def _next_pass(bits: _Bits, table, block, zig, first: int, last: int, one: int, ended: int) -> int:
    """Read one more bit of a band's values; returns how many blocks after it have no new ones."""

    def passed(i: int, zeros: int) -> int:
        """The place of the zero after so many others, having read a bit of each value before it."""
        while i <= last:
            old = int(block[zig[i]])
            if old:
                if bits.take(1):
                    block[zig[i]] = old + (one if old > 0 else -one)
            elif not zeros:
                break
            else:
                zeros -= 1
            i += 1
        return i

    i = first
    while not ended and i <= last:
        s = bits.symbol(table)
        run, size = s >> 4, s & 15
        if not size and run < 15:
            ended = (1 << run) + bits.take(run)
            break
        new = (one if bits.take(1) else -one) if size else 0
        i = passed(i, run)
        if new and i <= last:
            block[zig[i]] = new
        i += 1
    if ended:
        passed(i, 64)
        ended -= 1
    return ended
