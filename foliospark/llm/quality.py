"""Operator 5: quality classifier, a generalised additive model with pairwise interactions.

Features are shares and sizes of the whole text (characters by class, words by shape, repetition). They are cut into bins;
cyclic boosting visits one feature after another, fits a tree of three leaves to the gradients' histogram, and adds a
fraction of it to the feature's lookup table. Then the strongest pairs get two-dimensional tables from trees of four leaves
in the same way. A score is the sum of one table entry per feature and pair: vectorised bin additions.

Training uses at most TRAIN_ROWS labelled documents: distinct (id, text), the first by a hash of both, never a held-out one
(crc32(doc_id as text) mod 4 = 2). To lose a good document and to keep a bad one may weigh differently: GOOD_WEIGHTS are
tried on four fifths of the training rows, and the one with the least sum of both error rates at THRESHOLD on the last fifth
(of equals the least) is taken. All counts that enter a score come from the whole text of its own document.

Edge cases: null and empty texts are texts without characters and get a score; a doc_id with several labels has their mean,
above 0.5 being 1; a null doc_id is not held out; without usable labels, or with those of one class only, each score is the
prior (n1 + 1) / (n + 2), and `fitted` is false; repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import common

TRAIN_ROWS = 20_000
THRESHOLD = 0.7
BINS = 64
ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAST_HESSIAN, RIDGE = 120, 40, 6, 0.12, 4.0, 2.0
GOOD_WEIGHTS = (1.0, 2.0, 3.0, 4.0)
LONG = 16 << 20  # bytes of a text from which it is read in windows

LOWER, UPPER, DIGIT, SPACE, BREAK, STOP, SYMBOL, HIGH, CONTROL = range(9)
_CLASS = np.full(256, SYMBOL, np.int64)
_CLASS[:32] = CONTROL
_CLASS[127] = CONTROL
_CLASS[128:] = HIGH
_CLASS[ord("a") : ord("z") + 1] = LOWER
_CLASS[ord("A") : ord("Z") + 1] = UPPER
_CLASS[ord("0") : ord("9") + 1] = DIGIT
_CLASS[[ord(c) for c in " \t"]] = SPACE
_CLASS[[ord(c) for c in "\n\r"]] = BREAK
_CLASS[[ord(c) for c in ".,;:'\"?()-"]] = STOP

NAMES = (
    "log_bytes log_words upper digits stops symbols high breaks control word_length long_words short_words shouted "
    "marked bare_marks neighbours_equal distinct top_word words_per_line"
).split()


def _additive(data: np.ndarray, offsets: np.ndarray):
    """Sums for each row that windows of a text can add up, and the counts of its words: (sums, row, count, word)."""
    rows = len(offsets) - 1
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    chars = np.bincount(owner * 9 + _CLASS[data], minlength=rows * 9).reshape(rows, 9)
    codes, vocabulary, first = common.words(data, offsets)
    letters, cuts = common.buffer(vocabulary)
    kinds = _CLASS[letters]

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int64), cuts[:-1]) if len(letters) else np.zeros(0, np.int64)

    size = np.diff(cuts)
    upper, lower, symbols = (per_word(kinds == k) for k in (UPPER, LOWER, SYMBOL))
    solid = size - per_word(kinds == STOP) - symbols
    flags = [size, size > 12, size <= 3, (upper >= 2) & (lower == 0), (symbols > 0) & (solid > 0), solid == 0]
    word_row = np.repeat(np.arange(rows), np.diff(first))
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (word_row[1:] == word_row[:-1])
    sums = [np.bincount(word_row, weights=f[codes], minlength=rows) if len(codes) else np.zeros(rows) for f in flags]
    sums.append(np.bincount(word_row[same], minlength=rows))
    pairs, count = np.unique(word_row * max(len(size), 1) + codes, return_counts=True)
    at, word = np.divmod(pairs, max(len(size), 1))
    return np.column_stack([np.diff(offsets), np.diff(first), chars, *sums]).astype(float), at, count, (word, vocabulary)


def _finish(sums: np.ndarray, distinct: np.ndarray, top: np.ndarray) -> np.ndarray:
    size, n = sums[:, 0], sums[:, 1]
    chars, shape = sums[:, 2:11], sums[:, 11:]
    letters = np.maximum(chars[:, LOWER] + chars[:, UPPER] + chars[:, HIGH], 1)
    solid = np.maximum(size - chars[:, SPACE] - chars[:, BREAK], 1)
    some = np.maximum(n, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(n), chars[:, UPPER] / letters, chars[:, DIGIT] / solid, chars[:, STOP] / solid,
        chars[:, SYMBOL] / solid, chars[:, HIGH] / solid, chars[:, BREAK] / some, chars[:, CONTROL] / solid, shape[:, 0] / some,
        shape[:, 1] / some, shape[:, 2] / some, shape[:, 3] / some, shape[:, 4] / some, shape[:, 5] / some, shape[:, 6] / some,
        distinct / some, top / some, np.log1p(n / (chars[:, BREAK] + 1)),
    ])


def _long_features(data: np.ndarray, window: int) -> np.ndarray:
    """The features of one long text, read in windows that end at white space."""
    total, words, at, last = 0.0, Counter(), 0, None
    while at < len(data):
        stop = min(len(data), at + window)
        while stop < len(data) and data[stop] not in (32, 9, 10, 11, 12, 13):
            stop += 1
        part = data[at:stop]
        sums, _, count, (word, vocabulary) = _additive(part, np.array([0, len(part)]))
        names = vocabulary.take(pa.array(word)).to_pylist()
        for name, c in zip(names, count.tolist(), strict=True):
            words[name] += c
        edge = part.tobytes().split()
        if edge and last is not None and edge[0] == last:
            sums[0, -1] += 1
        last = edge[-1] if edge else last
        total = total + sums
        at = stop
    return _finish(total, np.array([len(words)]), np.array([max(words.values(), default=0)]))


def text_features(data: np.ndarray, offsets: np.ndarray, limit: int = common.SLICE_BYTES, long: int = LONG) -> np.ndarray:
    """A row of features (NAMES) for each row of a byte buffer."""
    out = [np.zeros((0, len(NAMES)))]
    for i, j in common.slices(offsets, limit):
        part, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if len(part) > long:
            out.append(_long_features(part, limit))
            continue
        sums, at, count, _ = _additive(part, cut)
        distinct, top = np.bincount(at, minlength=j - i), np.zeros(j - i)
        np.maximum.at(top, at, count)
        out.append(_finish(sums, distinct, top))
    return np.concatenate(out)


# -- the model -------------------------------------------------------------------------------------------------------------


@dataclass
class Additive:
    base: float
    fitted: bool = False
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if self.fitted and len(x):
            b = self.bins(x)
            for k, t in enumerate(self.tables):
                total += t[b[:, k]]
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                total += t[b[:, i], b[:, j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """The best place c to part bins lo..c-1 from c..hi-1, and its gain."""
    cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
    if len(cg) < 2:
        return 0.0, -1
    lg, lh = cg[:-1], ch[:-1]
    gain = _gain(lg, lh) + _gain(cg[-1] - lg, ch[-1] - lh) - _gain(cg[-1], ch[-1])
    gain[(lh < LEAST_HESSIAN) | (ch[-1] - lh < LEAST_HESSIAN)] = 0
    best = int(np.argmax(gain))
    return (float(gain[best]), lo + best + 1) if gain[best] > 0 else (0.0, -1)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray | None:
    """A tree of up to three leaves over the bins, as each bin's step."""
    gain, cut = _best_cut(g, h, 0, len(g))
    if cut < 0:
        return None
    cuts = [0, cut, len(g)]
    more = max((_best_cut(g, h, cuts[k], cuts[k + 1]) for k in (0, 1)), key=lambda x: x[0])
    if more[1] >= 0:
        cuts = sorted([*cuts, more[1]])
    step = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        step[a:b] = -g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree over two features: one cut of the first, and one of the second on either side."""
    gain, cut = _best_cut(g.sum(1), h.sum(1), 0, len(g))
    parts = [slice(0, cut), slice(cut, len(g))] if cut > 0 else [slice(0, len(g))]
    total, step = gain, np.zeros_like(g)
    for p in parts:
        pg, ph = g[p].sum(0), h[p].sum(0)
        inner, c = _best_cut(pg, ph, 0, len(pg))
        total += inner
        for q in (slice(0, c), slice(c, len(pg))) if c > 0 else (slice(0, len(pg)),):
            step[p, q] = -pg[q].sum() / (ph[q].sum() + RIDGE)
    return total, step


def fit(x: np.ndarray, y: np.ndarray, good_weight: float = 1.0) -> Additive:
    """Train on feature rows and 0/1 labels, those of 1 with that weight. The result depends on the rows' values, not on their order or any seed."""
    ones = float(y.sum())
    prior = (ones + 1) / (len(y) + 2)
    model = Additive(float(np.log(prior / (1 - prior))))
    if ones in (0.0, float(len(y))):
        return model
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order].astype(float)
    model.fitted = True
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    b = model.bins(x)
    total = np.full(len(y), model.base)
    weight = np.where(y > 0, good_weight, 1.0)

    def gradients():
        p = 1 / (1 + np.exp(-total))
        return weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k, t in enumerate(model.tables):
            g, h = gradients()
            step = _tree(np.bincount(b[:, k], g, len(t)), np.bincount(b[:, k], h, len(t)))
            if step is not None:
                t += RATE * step
                total += RATE * step[b[:, k]]

    def histogram(i: int, j: int):
        m, n = len(model.tables[i]), len(model.tables[j])
        at = b[:, i] * n + b[:, j]
        g, h = gradients()
        return np.bincount(at, g, m * n).reshape(m, n), np.bincount(at, h, m * n).reshape(m, n)

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda ij: (-_pair_tree(*histogram(*ij))[0], ij))
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            step = _pair_tree(*histogram(i, j))[1]
            t += RATE * step
            total += RATE * step[b[:, i], b[:, j]]
    return model


# -- Spark -----------------------------------------------------------------------------------------------------------------


def feature_lists(texts: pa.Array) -> pa.Array:
    x = text_features(*common.buffer(texts))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))


def is_held_out(key):
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def good_weight(x: np.ndarray, y: np.ndarray, weights: tuple[float, ...] = GOOD_WEIGHTS) -> float:
    """The weight of rows of label 1 with the least error rates on every fifth row of a fixed order."""
    order = np.lexsort((*x.T, y))
    last = np.zeros(len(y), bool)
    last[order[::5]] = True
    if any(len(set(y[part].tolist())) < 2 for part in (last, ~last)):
        return weights[0]

    def errors(w: float) -> float:
        kept = fit(x[~last], y[~last], w).score(x[last]) >= THRESHOLD
        return (~kept[y[last] == 1]).mean() + kept[y[last] == 0].mean()

    return min(weights, key=lambda w: (errors(w), w))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(x, y) of at most `rows` labelled documents that are not held out."""
    common.bound_batches(docs.sparkSession)
    usable = labels.select(F.col(key).alias("k"), F.col("quality").alias("q")).filter("k IS NOT NULL AND q IS NOT NULL")
    usable = usable.filter(~is_held_out(F.col("k"))).groupBy("k").agg(F.avg("q").alias("q"))
    chosen = usable.orderBy(F.xxhash64("k"), "k").limit(rows)  # the bound that lets it be broadcast
    body = common.text_of(F.col("t"))
    seen = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    made = seen.select("k", F.xxhash64(body).alias("tag"), (F.col("q") > 0.5).cast("int").alias("y"), F.arrow_udf(feature_lists, "array<double>")(body).alias("x"))
    return made.dropDuplicates(["k", "tag"]).orderBy(F.xxhash64("k", "tag"), "k", "tag").limit(rows).select("x", "y")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text") -> Additive:
    """The model of `training_rows`."""
    got = training_rows(docs, labels, rows, key, text).toPandas()
    x, y = np.array(got["x"].tolist(), float).reshape(-1, len(NAMES)), got["y"].to_numpy(int)
    return fit(x, y, good_weight(x, y))


def score_texts(df: DataFrame, model: Additive, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of `df`, and the score of its text column."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(text_features(*common.buffer(texts))))

    return df.withColumn(out, score(common.text_of(F.col(text))))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    scored = score_texts(docs, model)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
