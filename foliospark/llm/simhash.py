"""Operator 2: SimHash near-duplicate groups by bit-sliced comparison.

1. A Python stage makes each text's fingerprint: XXH64 of every word shingle, and for each bit whether over half have it.
2. Rows with one fingerprint become one class (pre-aggregated, so that copies cost nothing later).
3. Each class gets a few candidate keys. `blocks`: fingerprints at most 3 bits apart agree in two of five blocks of bits, so
   ten keys find every pair without exception. `anchors`: the least shingle hashes under six permutations, for wide radii
   which no block key serves (texts of Jaccard similarity 0.8 miss each other with probability 0.2 ** 6). Fingerprints
   are then of distinct shingles, and only filter: the links that count are confirmed, see 6.
4. Rows are range-partitioned by (key, fingerprint); a frequent key is thus cut into blocks over many tasks. Within a task,
   fingerprints lie as vertical bit planes; a row meets 64 candidates a word, distances grow in carry-save bit counters, and
   words whose 64 distances all exceed the radius are abandoned. Blocks of one key from different tasks meet in a join of
   block pairs. A comparison emits no pairs but a spanning forest of them.
5. Components are found by star contraction over written tables; the smallest id of each is its name.
6. With `anchors`, the shingle sets of each such loose component are compared exactly, and only pairs of the asked-for
   Jaccard similarity link. A set meets those that share one of its rarest shingles. A component is cut into blocks by a hash;
   each is searched breadth first on its own and with the first one. What these have not joined to the largest part is then
   compared with all blocks.

Edge cases: null text is empty; a text without words has fingerprint zero and links like any other; a row with a null id is
returned with its fingerprint and a null component, and links nothing; repeated rows share a component; different texts
under one id are different documents, each in the component of its text; an empty table gives no rows; further columns, of
whatever names, are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import common
from foliospark.llm.components import components

SEED = 42
WINDOW = 1 << 16  # shingles hashed at once
BLOCK = 4096  # fingerprints compared at once
SLAB = 1 << 16  # (row, word of 64 candidates) comparisons held at once
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd multipliers, each a permutation of the 64-bit hashes, for the anchors.
PERMUTATIONS = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
#: Added to a shingle's hash before it is mixed into the hashes of further words.
STEPS = np.arange(1, 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
SET_ROWS, SET_SHINGLES = 4096, 1 << 20  # rows, and shingles of them, of a block that is compared exactly
FEW = 512  # hashes whose bits are summed as they are


def _differ(both: int, one: int, other: int) -> float:
    """The probability that a bit differs for sets with `both` common shingles and `one` and `other` of their own."""

    def chance(n: int, least: int) -> float:  # of `least` or more of n
        return sum(math.comb(n, k) for k in range(max(least, 0), n + 1)) / 2**n

    total = 0.0
    for k in range(both + 1):
        a, b = (chance(n, (both + n) // 2 + 1 - k) for n in (one, other))
        total += math.comb(both, k) / 2**both * (a * (1 - b) + b * (1 - a))
    return total


@lru_cache
def radius_for(similarity: float, bits: int) -> int:
    """A distance that sets of that Jaccard similarity keep to but for six standard deviations.

    Large sets with similarity s have a cosine of 2s/(1+s) at least; each bit differs with probability acos(cosine)/pi at
    most. Small ones, whose counts are often tied, differ more: of those the greatest probability is counted out.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for both in range(1, 33):
        for own in range(1, math.floor(both / similarity - both + 1e-9) + 1):
            p = max(p, *(_differ(both, one, own - one) for one in range(own // 2 + 1)))
    return math.floor(bits * p + 6 * math.sqrt(bits * p * (1 - p)))


# -- fingerprints ----------------------------------------------------------------------------------------------------


def shingle_hashes(raw: bytes, size: int):
    """Windows of the XXH64 values of a text's word shingles; A-Z are lower-cased, words are joined by one space."""
    joined = b" ".join(raw.lower().split())
    if not joined:
        return
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.append(gaps, len(joined))
    n = max(1, len(starts) - size + 1)
    ends = ends[min(size, len(starts)) - 1 :]
    for i in range(0, n, WINDOW):
        cut = map(slice, starts[i : min(n, i + WINDOW)].tolist(), ends[i : i + WINDOW].tolist())
        digests = map(xxhash.xxh64_digest, map(joined.__getitem__, cut), repeat(SEED))
        yield np.frombuffer(b"".join(digests), ">u8").astype(np.uint64)


def distinct_shingles(raw: bytes, size: int) -> np.ndarray:
    """A text's shingle set, ascending."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(raw, size)]))


def _counts(hashes: np.ndarray) -> np.ndarray:
    """(words, 64) numbers of set bits, the highest first, in each row of (words, n) hashes.

    Three hashes at a time become a sum and a carry of twice the weight, until few are left of each weight.
    """
    total, weight, few = np.zeros((len(hashes), 64), np.int64), 1, max(8, FEW // len(hashes))
    while hashes.shape[1]:
        carries = []
        while hashes.shape[1] > few:
            m = hashes.shape[1] // 3
            x, y, z = hashes[:, :m], hashes[:, m : 2 * m], hashes[:, 2 * m : 3 * m]
            either = x ^ y
            carries.append((x & y) | (either & z))
            hashes = np.concatenate([either ^ z, hashes[:, 3 * m :]], axis=1)
        bits = np.unpackbits(np.ascontiguousarray(hashes).astype(">u8").view(np.uint8), axis=1)
        total += weight * bits.reshape(len(hashes), -1, 64).sum(axis=1, dtype=np.int64)
        hashes, weight = np.concatenate([hashes[:, :0], *carries], axis=1), weight * 2
    return total


def signature(raw: bytes, size: int, words: int, anchors: bool) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of `words` 64-bit words, least hash under each permutation) of a text; with anchors, of its distinct shingles."""
    counts = np.zeros((words, 64), np.int64)
    least = np.full(len(PERMUTATIONS) if anchors else 0, ONES)
    n, step = 0, max(1, WINDOW // words)
    for h in [distinct_shingles(raw, size)] if anchors else shingle_hashes(raw, size):
        n += len(h)
        for i in range(0, len(h), step):
            part = h[None, i : i + step]
            counts += _counts(np.concatenate([part, common.mix64(part + STEPS[: words - 1, None])]))
        for k in range(len(least)):
            least[k] = np.minimum(least[k], (h * PERMUTATIONS[k]).min(initial=ONES))
    return np.packbits(counts * 2 > n, axis=1).view(">u8").astype(np.uint64)[:, 0], least


def fingerprints(text: Column, size: int = 3, words: int = 1, anchors: bool = False) -> Column:
    """struct<fp: array<bigint>, anchors: array<bigint>> of a text column."""

    @F.arrow_udf("struct<fp:array<bigint>,anchors:array<bigint>>")
    def make(texts: pa.Array) -> pa.Array:
        fps, leasts = [], []
        data, offsets = common.buffer(texts)
        raw = memoryview(data)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            fp, least = signature(bytes(raw[a:b]), size, words, anchors)
            fps.append(fp)
            leasts.append(least)
        return pa.StructArray.from_arrays([_lists(fps), _lists(leasts)], names=["fp", "anchors"])

    return make(common.text_of(text))


def shingle_sets(text: Column, size: int) -> Column:
    """array<bigint> of a text column: the distinct shingles' hashes."""

    @F.arrow_udf("array<bigint>")
    def make(texts: pa.Array) -> pa.Array:
        data, offsets = common.buffer(texts)
        raw = memoryview(data)
        return _lists([distinct_shingles(bytes(raw[a:b]), size) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])

    return make(common.text_of(text))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


# -- bit-sliced comparison ---------------------------------------------------------------------------------------------


def _bits(fps: np.ndarray) -> np.ndarray:
    """(64 * words, n) bits of (n, words) fingerprints, the highest first."""
    return np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(len(fps), -1), axis=1).T


def planes(fps: np.ndarray) -> np.ndarray:
    """Vertical bit planes: a row for each bit, with fingerprint i at bit i % 64 of word i // 64."""
    bits = _bits(fps)
    padded = np.zeros((len(bits), -(-len(fps) // 64) * 64), np.uint8)
    padded[:, : len(fps)] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def _span(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Words with bits lo to hi - 1 set (hi > lo)."""
    return (ONES >> (np.uint64(64) - (hi - lo).astype(np.uint64))) << lo.astype(np.uint64)


def near(vertical: np.ndarray, masks: np.ndarray, row: np.ndarray, word: np.ndarray, valid: np.ndarray, radius: int):
    """(row, candidate) of all valid bits within the radius, from comparisons of a row with a word of 64 candidates.

    Counters start so that a carry leaves the highest one at distance radius + 1.
    """
    width = radius.bit_length()
    start = (1 << width) - radius - 1
    counters = [np.full(len(row), ONES if start >> i & 1 else 0, np.uint64) for i in range(width)]
    over = ~valid
    for j in range(0, len(vertical), 2):
        x = vertical[j][word] ^ masks[j][row]
        y = vertical[j + 1][word] ^ masks[j + 1][row]
        if width:
            either = x ^ y
            carry = (x & y) | (either & counters[0])
            counters[0] ^= either
            for i in range(1, width):
                counters[i], carry = counters[i] ^ carry, counters[i] & carry
            over |= carry
        else:
            over |= x | y
        if j % 8 == 6:
            live = over != ONES
            if np.count_nonzero(live) < 0.8 * len(live):
                row, word, over = row[live], word[live], over[live]
                counters = [c[live] for c in counters]
                if not len(row):
                    break
    hit = ~over
    some = np.flatnonzero(hit)
    at, bit = np.nonzero(np.unpackbits(hit[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return row[some[at]], word[some[at]] * 64 + bit


class Forest:
    """Labels of rows that links have joined, each the least row of its tree."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            low = np.minimum(label[a], label[b])
            split = np.flatnonzero(label[a] != label[b])
            if not len(split):
                break
            a, b, low = a[split], b[split], low[split]
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while True:
                jump = label[label]
                if np.array_equal(jump, label):
                    break
                label = jump
        self.label = label


def _masks(fps: np.ndarray) -> np.ndarray:
    return np.uint64(0) - _bits(fps).astype(np.uint64)


def _slabs(rows: np.ndarray, first: np.ndarray, count: np.ndarray):
    """Comparisons of each row with `count` words from `first` on, by slabs."""
    i, total = 0, np.concatenate([[0], np.cumsum(count)])
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(total, total[i] + SLAB, "right")) - 1)
        n = count[i:j]
        row = np.repeat(rows[i:j], n)
        word = np.arange(total[j] - total[i]) - np.repeat(total[i:j] - total[i], n) + np.repeat(first[i:j], n)
        yield row, word
        i = j


def link_groups(fps: np.ndarray, group_end: np.ndarray, radius: int) -> Forest:
    """Link rows of one group within the radius; groups are runs of rows, group_end the end of each row's run."""
    forest = Forest(len(fps))
    rows = np.flatnonzero(group_end - np.arange(len(fps)) > 1)
    if not len(rows):
        return forest
    vertical, masks = planes(fps), _masks(fps)
    first = (rows + 1) // 64
    for row, word in _slabs(rows, first, (group_end[rows] - 1) // 64 - first + 1):
        valid = _span(np.maximum(row + 1 - 64 * word, 0), np.minimum(group_end[row] - 64 * word, 64))
        forest.link(*near(vertical, masks, row, word, valid, radius))
    return forest


def link_blocks(left: np.ndarray, right: np.ndarray, radius: int) -> Forest:
    """Link rows of two blocks within the radius; rows of the right one come after the left one's."""
    forest = Forest(len(left) + len(right))
    vertical, masks = planes(right), _masks(left)
    words = vertical.shape[1]
    rows = np.arange(len(left))
    last = _span(np.array([0]), np.array([len(right) - 64 * (words - 1)]))[0]
    for row, word in _slabs(rows, np.zeros(len(left), np.int64), np.full(len(left), words)):
        valid = np.where(word == words - 1, last, ONES)
        a, b = near(vertical, masks, row, word, valid, radius)
        forest.link(a, b + len(left))
    return forest


# -- tasks ---------------------------------------------------------------------------------------------------------------

_OUT = "a long, b long, key long, block long, rows binary"


def _links(forest: Forest, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    joined = np.flatnonzero(forest.label != np.arange(len(node)))
    return node[joined], node[forest.label[joined]]


def _batch(a, b, keys=(), blocks=(), rows=()) -> pa.RecordBatch:
    n, m = len(a), len(keys)
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([pa.array(a, pa.int64()), pa.nulls(m, pa.int64())]),
            pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(m, pa.int64())]),
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(keys, pa.int64())]),
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(blocks, pa.int64())]),
            pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(rows, pa.binary())]),
        ],
        names=["a", "b", "key", "block", "rows"],
    )


def _compare(words: int, radius: int, size: int):
    """Links within the groups of sorted rows (key, node, fingerprint), and blocks of groups that other tasks may hold."""

    def pack(key, node, fps):
        return int(key), int(node[0]), np.column_stack([node.view(np.uint64), fps]).tobytes()

    def run(batches):
        first_key = None
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, words), np.uint64))
        open_key = None  # its earlier blocks have gone out already
        done = False
        source = iter(batches)
        while not done:
            batch = next(source, None)
            done = batch is None
            if batch is not None:
                if not batch.num_rows:
                    continue
                key, node = (batch.column(i).to_numpy() for i in (0, 1))
                flat = batch.column(2).flatten().to_numpy().view(np.uint64).reshape(-1, words)
                held = tuple(np.concatenate(x) for x in zip(held, (key, node, flat), strict=True))
            key, node, fps = held
            if not len(key):
                break
            if first_key is None:
                first_key = key[0]
            tail = len(key) if done else int(np.searchsorted(key, key[-1]))
            if len(key) - tail > size:  # a frequent key: whole blocks of it needn't wait
                tail = len(key) - ((len(key) - tail) % size or size)
            held = (key[tail:], node[tail:], fps[tail:])
            key, node, fps = key[:tail], node[:tail], fps[:tail]
            if not len(key):
                continue
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            end = np.append(begin[1:], len(key))
            loose = []  # groups that are here whole
            out: list[tuple[int, int, bytes]] = []
            for i, j in zip(begin.tolist(), end.tolist(), strict=True):
                k = key[i]
                if k == first_key or k == open_key or j - i > size or (j == len(key) and (done or (len(held[0]) and held[0][0] == k))):
                    for x in range(i, j, size):
                        y = min(j, x + size)
                        out.append(pack(k, node[x:y], fps[x:y]))
                        yield _batch(*_links(link_groups(fps[x:y], np.full(y - x, y - x), radius), node[x:y]))
                    open_key = k
                elif j - i > 1:
                    loose.append((i, j))
            if out:
                yield _batch((), (), *zip(*out, strict=True))
            while loose:
                take, rows = 0, 0
                while take < len(loose) and (not take or rows + loose[take][1] - loose[take][0] <= 2 * size):
                    rows += loose[take][1] - loose[take][0]
                    take += 1
                spans, loose = loose[:take], loose[take:]
                lengths = np.array([j - i for i, j in spans])
                at = np.concatenate([np.arange(i, j) for i, j in spans])
                ends = np.repeat(np.cumsum(lengths), lengths)
                yield _batch(*_links(link_groups(fps[at], ends, radius), node[at]))

    return run


def _cross(words: int, radius: int):
    def unpack(raw):
        rows = np.frombuffer(raw, np.uint64).reshape(-1, words + 1)
        return rows[:, 0].view(np.int64), np.ascontiguousarray(rows[:, 1:])

    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (left, left_fps), (right, right_fps) = unpack(a), unpack(b)
                yield _batch(*_links(link_blocks(left_fps, right_fps, radius), np.concatenate([left, right])))

    return run


def block_keys(fp: Column) -> Column:
    """Ten keys of a 64-bit fingerprint: each pair of its five blocks. Any 3 bits leave two blocks alone."""
    cuts = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
    part = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1)) for at, n in cuts]
    return F.array(
        *[
            F.shiftleft(F.shiftleft(F.lit(t).cast("long"), 13).bitwiseOR(part[i]), 13).bitwiseOR(part[j])
            for t, (i, j) in enumerate(combinations(range(5), 2))
        ]
    )


# -- exact confirmation --------------------------------------------------------------------------------------------------

_SETS = "a long, b long, component long, block long, nodes binary, sizes binary, flat binary"


class _Prefixes:
    """Rows by the rarest codes of their sets: sets that are alike enough share one of these.

    codes ascend within a set by their frequency; a set of n codes that shares a part t with another one at least has one
    of its n - ceil(t * n) + 1 rarest codes among that one's.
    """

    def __init__(self, codes: np.ndarray, first: np.ndarray, sizes: np.ndarray, similarity: float):
        self.codes, self.first = codes, first
        self.length = np.where(sizes > 0, sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1, 0)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, code) of all prefixes of the rows."""
        n = self.length[rows]
        at = np.arange(n.sum()) + np.repeat(self.first[rows] - (np.cumsum(n) - n), n)
        return np.repeat(rows, n), self.codes[at]

    def index(self, rows: np.ndarray) -> None:
        owner, code = self.of(rows)
        order = np.argsort(code, kind="stable")
        self.owner, self.code = owner[order], code[order]

    def meet(self, row: int) -> np.ndarray:
        """Indexed rows that share a prefix code with the row."""
        mine = self.codes[self.first[row] : self.first[row] + self.length[row]]
        lo, hi = np.searchsorted(self.code, mine, "left"), np.searchsorted(self.code, mine, "right")
        n = hi - lo
        return np.unique(self.owner[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)])


def similar(flat: np.ndarray, sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, row that reached it): spanning links of sets, laid end to end, of that Jaccard similarity or more.

    Breadth first: a row meets only those that nothing has reached yet and that share one of its rarest codes. The index of
    these is made anew whenever half of its rows have been reached, so that large groups of copies don't stay in the way.
    """
    codes, count = np.unique(flat, return_inverse=True, return_counts=True)[1:]
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    codes = rank[codes]
    codes = codes[np.lexsort((codes, owner))]
    first = np.cumsum(sizes) - sizes
    prefixes = _Prefixes(codes, first, sizes, similarity)
    seen = np.zeros(len(count), bool)
    alive = sizes > 0
    indexed = left = int(alive.sum())
    prefixes.index(np.flatnonzero(alive))
    reached, by = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in np.flatnonzero(alive).tolist():
        if not alive[start]:
            continue
        alive[start] = False
        left -= 1
        queue = [start]
        while queue and left:
            if 2 * left < indexed:
                prefixes.index(np.flatnonzero(alive))
                indexed = left
            r = queue.pop()
            met = prefixes.meet(r)
            met = met[alive[met]]
            n = sizes[met]
            met = met[np.minimum(n, sizes[r]) / np.maximum(n, sizes[r]) >= similarity]
            if not len(met):
                continue
            n = sizes[met]
            begin = np.cumsum(n) - n
            mine = codes[first[r] : first[r] + sizes[r]]
            seen[mine] = True
            both = np.add.reduceat(seen[codes[np.repeat(first[met] - begin, n) + np.arange(n.sum())]], begin, dtype=np.int64)
            seen[mine] = False
            hit = met[both / (n + sizes[r] - both) >= similarity]
            alive[hit] = False
            left -= len(hit)
            queue += hit.tolist()
            reached.append(hit)
            by.append(np.full(len(hit), r))
    return np.concatenate(reached), np.concatenate(by)


def _set_batch(a, b, packed=()) -> pa.RecordBatch:
    n, m = len(a), len(packed)
    links = [pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(m, pa.int64())]) for x in (a, b)]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    blocks = [pa.concat_arrays([pa.nulls(n, t), pa.array([x[k] for x in packed], t)]) for k, t in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*links, *blocks], names=["a", "b", "component", "block", "nodes", "sizes", "flat"])


def _within(similarity: float):
    """Links inside each block of sorted rows (component, block, node, set, parts); the block too if there are several parts."""

    def close(held):
        node, size = np.array([h[0] for h in held]), np.array([len(h[1]) for h in held])
        flat = np.concatenate([h[1] for h in held])
        a, b = similar(flat, size, similarity)
        return node, size, flat, node[a], node[b]

    def run(batches):
        at, held = None, []
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in (0, 1, 2, 4)]
            cuts, flat = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy()
            for i, (component, block, node, parts) in enumerate(zip(*(c.tolist() for c in columns), strict=True)):
                if at != (component, block, parts):
                    if held:
                        yield from out(at, close(held))
                    at, held = (component, block, parts), []
                x = flat[cuts[i] : cuts[i + 1]]
                if not held or held[-1][0] != node or not np.array_equal(held[-1][1], x):  # repeated rows stand together
                    held.append((node, x.copy()))
        if held:
            yield from out(at, close(held))

    def out(at, found):
        node, size, flat, a, b = found
        packed = [(at[0], at[1], node.tobytes(), size.tobytes(), flat.tobytes())] if at[2] > 1 else []
        if len(a) or packed:
            yield _set_batch(a, b, packed)

    return run


def _between(similarity: float):
    """Links between two blocks."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                parts = [np.frombuffer(batch.column(k)[i].as_py(), np.int64) for k in range(6)]
                node, size, flat = (np.concatenate([parts[k], parts[k + 3]]) for k in range(3))
                a, b = similar(flat, size, similarity)
                yield _set_batch(node[a], node[b])

    return run


def _in_blocks(sets: DataFrame, similarity: float, several: bool = False) -> DataFrame:
    """_SETS of rows (component, node, set); `several`: blocks go out of components of one block too."""
    total = sets.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.size("set")).alias("size"))
    parts = F.greatest(F.ceil(F.col("n") / SET_ROWS), F.ceil(F.col("size") / SET_SHINGLES)).cast("long")
    many = common.materialise(total.select("component", parts.alias("parts")).filter("parts > 1"), "many")
    cut = sets.join(many, "component", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")))
    if several:
        cut = cut.withColumn("parts", F.col("parts") + 1)
    cut = cut.select("component", "block", "node", "set", "parts").repartition("component", "block").sortWithinPartitions("component", "block", "node")
    return common.materialise(cut.mapInArrow(_within(similarity), _SETS), "sets_linked")


def confirmed(docs: DataFrame, loose: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links of that Jaccard similarity that span all such pairs inside loose components (node, component).

    docs: (node, text), repeated rows allowed.
    """
    loose = common.materialise(loose, "loose")
    once = docs.join(loose, "node").dropDuplicates(["node"])
    sets = common.materialise(once.select("component", "node", shingle_sets(F.col("text"), shingle).alias("set")), "sets")
    made = _in_blocks(sets, similarity)
    links = made.filter("a IS NOT NULL").select("a", "b")
    blocks = made.filter("nodes IS NOT NULL").drop("a", "b")
    if not blocks.limit(1).count():
        return links

    def between(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.select("component", F.col("block").alias("block2"), *[F.col(c).alias(f"{c}2") for c in ("nodes", "sizes", "flat")])
        met = left.join(right, "component").select("nodes", "sizes", "flat", "nodes2", "sizes2", "flat2")
        return common.materialise(met.mapInArrow(_between(similarity), _SETS).select("a", "b"), "between")

    links = links.unionByName(between(blocks.filter("block > 0"), blocks.filter("block = 0")))
    joined = components(links).withColumnRenamed("component", "part")
    large = blocks.select("component").distinct()
    placed = loose.join(large, "component", "left_semi").join(joined, "node", "left").withColumn("part", F.coalesce("part", "node"))
    placed = common.materialise(placed, "placed")
    counts = placed.groupBy("component", "part").count()
    most = counts.groupBy("component").agg(F.max(F.struct("count", "part"))["part"].alias("most"))
    apart = placed.join(common.materialise(most, "most"), "component").filter("part <> most").select("node")
    apart = common.materialise(apart, "apart")
    others = _in_blocks(sets.join(apart, "node", "left_semi"), similarity, several=True)
    links = links.unionByName(others.filter("a IS NOT NULL").select("a", "b"))
    return links.unionByName(between(others.filter("nodes IS NOT NULL").drop("a", "b"), blocks))


def near_duplicates(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    radius: int = 3,
    words: int = 1,
    candidates: str = "blocks",
    block: int = BLOCK,
    similarity: float = 0.8,
) -> DataFrame:
    """(key, fp array<bigint>, component_id, tag, first_tag) of every row of `df`.

    `blocks` serves one word and a radius of 3 or less, and finds every link; `anchors` serves any radius, and links
    only candidates whose shingle sets have that Jaccard similarity. tag is the XXH64 of the row's text; (component_id,
    first_tag) are the least id and, of that id's texts in the component, the least tag: the name of the component. Rows
    that share an id but not the text are different documents.
    """
    if candidates == "blocks" and (words > 1 or radius > 3):
        raise ValueError("block keys serve 64 bits and a radius of 3 at most")
    anchors = candidates == "anchors"
    common.bound_batches(df.sparkSession)
    tagged = df.select(F.col(key).cast("long").alias("id"), F.xxhash64(common.text_of(F.col(text))).alias("tag"), F.col(text).alias("text"))
    rows = tagged.select("id", "tag", fingerprints(F.col("text"), shingle, words, anchors).alias("s"))
    rows = common.materialise(rows.select("id", "tag", "s.fp", "s.anchors"), "simhash")
    classes = rows.filter("id IS NOT NULL").groupBy("fp").agg(F.min(F.struct("id", "tag")).alias("first"), F.min("anchors").alias("anchors"))
    classes = common.materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    if anchors:
        keyed = classes.select("fp", "node", F.posexplode("anchors").alias("t", "h")).select(F.xxhash64("t", "h").alias("key"), "node", "fp")
    else:
        keyed = classes.select(F.explode(block_keys(F.col("fp")[0])).alias("key"), "node", "fp")
    keyed = common.materialise(keyed, "keyed")
    order = ["key", *[F.col("fp")[w] for w in range(words)]]
    compared = keyed.repartitionByRange(*order, "node").sortWithinPartitions(*order, "node").mapInArrow(_compare(words, radius, block), _OUT)
    compared = common.materialise(compared, "compared")
    blocks = compared.filter("rows IS NOT NULL").select("key", "block", "rows")
    other = blocks.select("key", F.col("block").alias("block2"), F.col("rows").alias("rows2"))
    crossed = blocks.join(other, "key").filter("block < block2").select("rows", "rows2").mapInArrow(_cross(words, radius), _OUT)
    links = compared.filter("a IS NOT NULL").select("a", "b").unionByName(crossed.select("a", "b"))
    found = components(links)
    if anchors:
        firsts = found.join(classes.select("node", "first.*"), "node")
        texts = tagged.join(firsts.select("node", "id", "tag"), ["id", "tag"]).select("node", "text")
        found = components(confirmed(texts, found, shingle, similarity))
    placed = classes.join(found, "node", "left").select("fp", "first", F.coalesce("component", "node").alias("component"))
    least = common.materialise(placed.groupBy("component").agg(F.min("first").alias("least")), "least")
    named = placed.join(least, "component").select("fp", "least")
    out = rows.join(named, "fp", "left")
    known = F.col("id").isNotNull()
    return out.select(
        F.col("id").alias(key), "fp", F.when(known, F.col("least.id")).alias("component_id"), "tag", F.when(known, F.col("least.tag")).alias("first_tag")
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id")
