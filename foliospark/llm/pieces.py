"""Operator 1: SentencePiece encoding and decoding by forward filtering and backward sampling.

A text gets the usual dummy space in front, and its piece lattice has an edge for every vocabulary piece that matches at a
byte position (a character without a piece of its own gets one edge per byte, the byte-fallback pieces). A path's weight is
the product of its pieces' weights p(piece) ** alpha. Forward filtering sums the weights of all paths into each node;
backward sampling walks from the end and draws the incoming edge in proportion, so that a segmentation comes up with exactly
its share of the total weight. The number drawn at a node is a hash of (seed, row key, byte position): the result depends
on the row alone, not on partitions, batches or retries.

No piece has white space after another character, so that every path passes the start of each word: the lattice of a text
is a chain of word lattices, filtered once for each distinct word of a slice and sampled for each occurrence. Filtering cuts
words further at each vertex that no piece spans. What stays longer than LONG_WORD (text without spaces can) is filtered in
blocks side by side: first each block's linear map from the sums before it, then the few sums at its start, then the block
itself; and its pieces are drawn for all nodes at once, for the draw at a node depends on its position alone.

Edge cases: an empty table gives no rows; a column of the output's name is kept, and the output gets underscores in front; a null or empty text has no pieces and decodes to the empty text; a null key is a key like any other; repeated
rows get equal pieces; a literal U+2581 is written in byte pieces and so survives; bytes that are no UTF-8 do too. A text
is handled whole; memory is bound by the slice (1 MB) or by one longer text.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import common

DEFAULT_MODEL = os.environ.get("FOLIOSPARK_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: A factor for each byte of a piece; it keeps sums near 1 and cancels out, for all paths of a word have the same bytes.
PER_BYTE = float(np.exp(0.45))
LATTICE_BYTES = 1 << 20  # text whose lattices are held at once
LONG_WORD = 1024  # bytes from which a word is filtered in blocks
RUN = 1 << 20  # bytes of a word whose blocks are filtered at once


class Lattices:
    """A model's pieces as a byte trie, with sampling and decoding over slices of texts."""

    def __init__(self, model: bytes, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.byte_id = np.full(256, -1, np.int32)
        usable = []
        weight = np.zeros(n)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
                weight[i] = PER_BYTE
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                raw = piece.replace("▁", " ").encode()
                self.bytes_of.append(raw)
                # Merge ranks stand for frequencies by the law of Zipf and Mandelbrot.
                weight[i] = (max(0.0, -sp.get_score(i)) + 2.7) ** -alpha * PER_BYTE ** len(raw)
                usable.append(i)
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces: decoding could lose characters")
        self.weight = weight
        self._trie(usable)
        inner = [self.bytes_of[i].lstrip(b" ") for i in usable]
        self.words_part = not any(b" " in x for x in inner)
        found = set(b"".join(self.bytes_of[i] for i in usable))
        self.alone = np.array([b < 128 and b not in found for b in range(256)])
        self.longest = max(len(self.bytes_of[i]) for i in usable)
        lengths = np.array([len(x) for x in self.bytes_of], np.int64)
        self.piece_len, self.piece_at = lengths, np.concatenate([[0], np.cumsum(lengths)])
        self.piece_data = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        lead = np.ones(256, np.int64)
        lead[0xC2:0xE0], lead[0xE0:0xF0], lead[0xF0:0xF5] = 2, 3, 4
        self.lead = lead

    def _trie(self, usable: list[int]) -> None:
        child: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        count = 1
        for i in usable:
            at = 0
            for b in self.bytes_of[i]:
                nxt = child.get((at, b))
                if nxt is None:
                    nxt = child[at, b] = count
                    count += 1
                at = nxt
            ends[at] = i
        inner = sorted({a for a, _ in child})
        place = np.empty(count, np.int64)
        is_inner = np.zeros(count, bool)
        is_inner[inner] = True
        place[inner] = np.arange(len(inner))
        place[~is_inner] = np.arange(len(inner), count)
        self.inner = len(inner)
        self.step = np.full((self.inner, 256), -1, np.int32)
        for (a, b), c in child.items():
            self.step[place[a], b] = place[c]
        self.ends = np.full(count, -1, np.int32)
        for a, i in ends.items():
            self.ends[place[a]] = i

    # -- the lattices of distinct words ------------------------------------------------------------------------------

    def _edges(self, data: np.ndarray, cuts: np.ndarray):
        """Edges by the node where they end, the longest first: (first edge of each node, start position, piece)."""
        n = len(data)
        stop = np.repeat(cuts[1:], np.diff(cuts))
        at = np.arange(n)
        state = self.step[0, data]
        at, state = at[state >= 0], state[state >= 0]
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        covered = np.zeros(n, bool)
        depth = 1
        while len(at):
            piece = self.ends[state]
            hit = piece >= 0
            starts = at[hit]
            found.append((depth, starts, piece[hit]))
            if depth <= 4:
                whole = starts[self.lead[data[starts]] == depth]
                for k in range(depth):
                    covered[whole + k] = True
            go = (state < self.inner) & (at + depth < stop[at])
            at, state = at[go], state[go]
            state = self.step[state, data[at + depth]]
            at, state = at[state >= 0], state[state >= 0]
            depth += 1
        bare = np.flatnonzero(~covered)
        found.append((1, bare, self.byte_id[data[bare]]))
        degree = np.zeros(n + 1, np.int64)
        for d, starts, _ in found:
            degree[starts + d] += 1  # ends of one depth are distinct, and so are those of both kinds of depth 1
        first = np.cumsum(degree)
        slot = first - degree
        slot, first = slot[1:].copy(), np.concatenate([[0], first[1:]])
        start_of = np.empty(first[-1], np.int64)
        piece_of = np.empty(first[-1], np.int32)
        for d, starts, piece in sorted(found, key=lambda x: -x[0]):
            node = starts + d - 1
            put = slot[node]
            slot[node] += 1
            start_of[put], piece_of[put] = starts, piece
        return first, start_of, piece_of

    def _vertices(self, cuts: np.ndarray, first: np.ndarray, start_of: np.ndarray) -> np.ndarray:
        """The cuts, and between them each position that no edge spans."""
        end = np.repeat(np.arange(1, len(first)), np.diff(first))
        inner = np.bincount(start_of + 1, minlength=len(first) + 1) - np.bincount(end, minlength=len(first) + 1)
        lone = np.cumsum(inner)[: len(first)] == 0
        lone[cuts] = True
        return np.flatnonzero(lone)

    def _filter(self, cuts: np.ndarray, first: np.ndarray, start_of: np.ndarray, piece_of: np.ndarray) -> np.ndarray:
        """Forward filtering of all words: each edge's cumulative share at its node."""
        weight = self.weight[piece_of]
        share = np.zeros(len(piece_of))
        total = np.ones(len(first) - 1)
        cuts = self._vertices(cuts, first, start_of)
        begin, lengths = cuts[:-1], np.diff(cuts)
        long = lengths > LONG_WORD
        order = np.argsort(-lengths[~long], kind="stable")
        self._side_by_side(begin[~long][order], lengths[~long][order], first, start_of, weight, share, total)
        for at, n in zip(begin[long].tolist(), lengths[long].tolist(), strict=True):
            self._in_blocks(at, n, first, start_of, weight, share, total)
        return share / np.repeat(total, np.diff(first))

    def _side_by_side(self, begin, sizes, first, start_of, weight, share, total) -> None:
        """Words, the longest first, position by position."""
        ahead = np.zeros(len(first))
        ahead[begin] = 1.0
        for k in range(1, int(sizes[0]) + 1 if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -k, "right"))
            node = begin[:live] + k - 1
            base, degree = first[node], first[node + 1] - first[node]
            got = np.zeros(live)
            some = np.flatnonzero(degree)
            j = 0
            while len(some):
                e = base[some] + j
                got[some] += ahead[start_of[e]] * weight[e]
                share[e] = got[some]
                j += 1
                some = some[degree[some] > j]
            reached = degree > 0
            total[node[reached]] = got[reached]
            on = reached & (sizes[:live] > k)
            ahead[node[on] + 1] = got[on]
            wild = np.flatnonzero(on & ((got < 1e-150) | (got > 1e150)))
            if len(wild):  # only starts within the longest piece matter later on
                for back in range(min(self.longest, k + 1)):
                    ahead[node[wild] + 1 - back] /= got[wild]

    def _in_blocks(self, at: int, n: int, first, start_of, weight, share, total) -> None:
        """One long word. The state before a block: the sums at its last `longest` positions, of any common scale."""
        reach = self.longest
        state = np.zeros(reach)
        state[-1] = 1.0
        for run in range(at, at + n, RUN):
            size = min(RUN, at + n - run)
            width = max(reach, int(size**0.5))
            starts = run + np.arange(0, size, width)
            maps = self._block_maps(starts[:-1], width, first, start_of, weight)
            states = [state]
            for m in maps:
                state = state @ m
                state = state / state.max()
                states.append(state)
            state = self._block_sums(starts, width, run + size, np.array(states), first, start_of, weight, share, total)

    def _block_maps(self, starts, width: int, first, start_of, weight) -> np.ndarray:
        """(blocks, reach, reach): what a block's last sums are, for each of the sums before it alone being 1."""
        reach, m = self.longest, len(starts)
        ring = np.zeros((reach, m, reach))  # the sums at position p are in row p % reach, p counted from the block's start
        for i in range(reach):
            ring[(i + 1) % reach, :, i] = 1.0  # of place i, which is position i + 1 - reach
        for k in range(1, width + 1):
            node = starts + k - 1
            base, degree = first[node], first[node + 1] - first[node]
            got = np.zeros((m, reach))
            some = np.flatnonzero(degree)
            j = 0
            while len(some):
                e = base[some] + j
                got[some] += ring[(start_of[e] - starts[some]) % reach, some] * weight[e][:, None]
                j += 1
                some = some[degree[some] > j]
            ring[k % reach] = got
            if k % 32 == 0:
                ring /= ring.max(axis=(0, 2), keepdims=True)
        return ring[(width + 1 + np.arange(reach)) % reach].transpose(1, 2, 0)

    def _block_sums(self, starts, width: int, stop: int, states, first, start_of, weight, share, total) -> np.ndarray:
        """Fills in shares and totals of blocks with known states before them; the state after the last one."""
        reach, m = self.longest, len(starts)
        sums = np.zeros((m, reach + width))
        sums[:, :reach] = states
        for k in range(1, width + 1):
            live = m if starts[-1] + k <= stop else m - 1
            if not live:
                break
            node = starts[:live] + k - 1
            base, degree = first[node], first[node + 1] - first[node]
            got = np.zeros(live)
            some = np.flatnonzero(degree)
            j = 0
            while len(some):
                e = base[some] + j
                got[some] += sums[some, reach - 1 + start_of[e] - starts[some]] * weight[e]
                share[e] = got[some]
                j += 1
                some = some[degree[some] > j]
            reached = degree > 0
            total[node[reached]] = got[reached]
            sums[:live, reach - 1 + k] = got
            wild = np.flatnonzero(reached & ((got < 1e-150) | (got > 1e150)))
            sums[wild, k : reach + k] /= got[wild, None]
        last = reach - 1 + stop - starts[-1]
        return sums[-1, last - reach + 1 : last + 1]

    # -- texts --------------------------------------------------------------------------------------------------------

    def sample(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids, n+1 offsets) of the rows of a byte buffer; keys: unsigned 64-bit, one a row."""
        rows = len(offsets) - 1
        some = np.diff(offsets) > 0
        if not some.any():
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        data = np.insert(data, offsets[:-1][some], 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(some)])
        head = np.zeros(len(data), bool)
        if self.words_part:
            space = data == 32
            head[1:] = space[1:] & ~space[:-1]
        lone = self.alone[data]
        head |= lone
        head[1:] |= lone[:-1]
        head[offsets[:-1][some]] = True
        starts = np.flatnonzero(head)
        coded = common.binary_array(data, np.append(starts, len(data))).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        text, cuts = common.buffer(coded.dictionary)
        first, start_of, piece_of = self._edges(text, cuts)
        share = self._filter(cuts, first, start_of, piece_of)

        row = np.searchsorted(offsets, starts, "right") - 1
        seed = keys[row]
        origin = cuts[code]
        shift = starts - offsets[row] - origin + 1
        node = cuts[code + 1] - 1
        count = np.zeros(len(code), np.int64)

        def pick(of: np.ndarray, node: np.ndarray) -> np.ndarray:
            """The edges drawn at nodes of the occurrences `of`."""
            u = (common.mix64(seed[of] + (node + shift[of]).astype(np.uint64) * GOLDEN) >> np.uint64(11)) * 2.0**-53
            edge, last = first[node], first[node + 1] - 1
            more = np.flatnonzero((edge < last) & (share[edge] <= u))
            while len(more):
                edge[more] += 1
                e = edge[more]
                more = more[(e < last[more]) & (share[e] <= u[more])]
            return edge

        walked: list[tuple[int, list[int]]] = []
        for i in np.flatnonzero(node - origin >= LONG_WORD).tolist():
            nodes = np.arange(origin[i], node[i] + 1)
            nodes = nodes[first[nodes + 1] > first[nodes]]
            edge = np.zeros(node[i] + 1 - origin[i], np.int64)
            edge[nodes - origin[i]] = pick(np.full(len(nodes), i), nodes)
            before, piece = (start_of[edge] - origin[i]).tolist(), piece_of[edge].tolist()
            at, out = len(edge), []
            while at > 0:
                out.append(piece[at - 1])
                at = before[at - 1]
            walked.append((i, out[::-1]))
            count[i] = len(out)
        live = np.flatnonzero(node - origin < LONG_WORD)
        node = node[live]
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            edge = pick(live, node)
            drawn.append((live, piece_of[edge]))
            count[live] += 1
            begin = start_of[edge]
            on = begin > origin[live]
            live, node = live[on], begin[on] - 1
        place = np.concatenate([[0], np.cumsum(count)])
        ids = np.empty(place[-1], np.int32)
        for back, (which, piece) in enumerate(drawn):
            ids[place[which + 1] - 1 - back] = piece
        for i, out in walked:
            ids[place[i] : place[i + 1]] = out
        return ids, place[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all bytes, n+1 offsets) of rows of piece ids, without the dummy space."""
        size = self.piece_len[ids]
        place = np.concatenate([[0], np.cumsum(size)])
        data = self.piece_data[np.arange(place[-1]) + np.repeat(self.piece_at[ids] - place[:-1], size)]
        cuts = place[offsets]
        full = np.flatnonzero(np.diff(cuts) > 0)
        dummy = full[data[cuts[full]] == 32]
        keep = np.ones(len(data), bool)
        keep[cuts[dummy]] = False
        gone = np.zeros(len(cuts), np.int64)
        gone[dummy + 1] = 1
        return data[keep], cuts - np.cumsum(gone)


@lru_cache(maxsize=4)
def lattices(model: bytes, alpha: float) -> Lattices:
    return Lattices(model, alpha)


def sample_encode(
    df: DataFrame, key: str = "doc_id", text: str = "text", model: str = DEFAULT_MODEL, alpha: float = 0.3, seed: int = 7
) -> DataFrame:
    """All columns of `df`, and a struct column, `pieces` or with underscores in front: token_ids, n_tokens, decoded_sha256, lossless.

    The last two come from decoding the drawn ids again: lossless says that the bytes are the text's.
    """
    common.bound_batches(df.sparkSession)
    proto = common.read_file(df.sparkSession, model)

    @F.arrow_udf("struct<token_ids:array<int>,n_tokens:bigint,decoded_sha256:string,lossless:boolean>")
    def encode(texts: pa.Array, keys: pa.Array) -> pa.Array:
        made = lattices(proto, alpha)
        data, offsets = common.buffer(texts)
        hashed = common.mix64(keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        out_ids, out_n, digests, same = [], [], [], []
        for i, j in common.slices(offsets, LATTICE_BYTES):
            part, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            ids, place = made.sample(part, cut, hashed[i:j])
            back, back_cut = made.decode(ids, place)
            out_ids.append(ids)
            out_n.append(np.diff(place))
            for r in range(j - i):
                raw = back[back_cut[r] : back_cut[r + 1]]
                digests.append(hashlib.sha256(raw).hexdigest())
                same.append(bool(np.array_equal(raw, part[cut[r] : cut[r + 1]])))
        sizes = np.concatenate(out_n) if out_n else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
            pa.array(np.concatenate(out_ids) if out_ids else np.zeros(0, np.int32), pa.int32()),
        )
        return pa.StructArray.from_arrays(
            [lists, pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())],
            names=["token_ids", "n_tokens", "decoded_sha256", "lossless"],
        )

    return df.withColumn(common.fresh(df, "pieces"), encode(common.text_of(F.col(text)), F.xxhash64(F.lit(seed), F.col(key))))


def decode(df: DataFrame, ids: str = "token_ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """All columns of `df`, and `decoded` (or with underscores in front): the text of an array of piece ids (null ids: null)."""
    proto = common.read_file(df.sparkSession, model)

    @F.arrow_udf("string")
    def back(arr: pa.Array) -> pa.Array:
        made = lattices(proto, 1.0)
        n = np.asarray(arr.value_lengths().fill_null(0))
        data, cuts = made.decode(arr.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)]))
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return pa.array(texts, pa.string(), mask=np.asarray(arr.is_null()))

    return df.withColumn(common.fresh(df, "decoded"), back(F.col(ids)))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return sample_encode(docs).select("doc_id", "pieces.*")
