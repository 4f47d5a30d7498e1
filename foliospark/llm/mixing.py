"""Operator 10: mixing sources to target weights by iterative proportional fitting.

Every document has a source, a language and a topic; its weight is its number of words. The total weight of each cell
(source, language, topic) is raked: its sums by source, by language and by topic are scaled to the targets in turn, and no
cell may exceed what it holds, until nothing moves. A document is then sampled with its cell's probability, the raked
weight over the weight held, by a hash of (seed, doc_id): reproducible, and independent of partitions.

Targets name the categories of a dimension and their shares. Categories that they don't name (and null) fall together as
"other", which keeps the share that it has. Topics, whose number is fixed, may have a power instead: their shares are those
that they hold, raised to it. So the number of cells is bound by the targets, and cells and sums by topic and language are
all that reaches the driver. Where cells hold too little for the targets, those cells are taken whole and the rest is raked
to meet the targets as far as it can; `residuals` tells what is missing, and `mix` logs the greatest gap.

Topics come from a spherical k-means over hashed bags of words, less the mean bag of their language (else topics would be
languages). Document counts, language means and all rounds are sums over all documents, kept as integers, so that their
order doesn't matter; a task hands on one row of sums for each language or topic. Only the first centres are picked from a
sample: the SEED_ROWS distinct texts that come first by a hash.

Edge cases: null text is empty: no words, topic 0; cells without weight keep the overall fraction as their probability;
null doc_ids share one draw; repeated rows share theirs; an empty table gives no rows; a dimension without targets isn't
raked.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import common

TOPICS, BUCKETS, SEED_ROWS, ROUNDS = 8, 256, 4096, 8
SCALE = 2.0**24  # of the integers that stand for parts of unit vectors in sums
OTHER = "other"
#: What the registered query mixes to: equal sources, languages by weight, topics evened out, and a fifth of all words. These
#: targets can be met with a third of all words in one source and three quarters in one topic; half of all words can't.
TARGETS = {
    "source": {f"src{i}": 1 / 20 for i in range(20)},
    "lang": {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1},
    "topic": 0.5,
}
FRACTION = 0.2
SEED = 11
LOG = logging.getLogger(__name__)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of words, hashed counts of words of five bytes or more) of the rows of a byte buffer."""
    sizes, counts = [np.zeros(0, np.int64)], [np.zeros((0, BUCKETS))]
    for i, j in common.slices(offsets):
        codes, vocabulary, first = common.words(_LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i])
        bucket = np.array([zlib.crc32(w) % BUCKETS if len(w) >= 5 else -1 for w in vocabulary.to_pylist()], np.int64)
        at = bucket[codes] if len(codes) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(j - i), np.diff(first))
        counts.append(np.bincount((owner * BUCKETS + at)[at >= 0], minlength=(j - i) * BUCKETS).reshape(j - i, BUCKETS).astype(float))
        sizes.append(np.diff(first))
    return np.concatenate(sizes), np.concatenate(counts)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Topics:
    """Centroids of square-rooted, idf-weighted unit bags, less their language's mean (no such language: nothing)."""

    def __init__(self, idf: np.ndarray, means: dict[str, np.ndarray], centres: np.ndarray):
        self.idf, self.means, self.centres = idf, means, centres

    def flat(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.sqrt(counts) * self.idf)

    def vectors(self, counts: np.ndarray, langs: list[str]) -> np.ndarray:
        none = np.zeros(counts.shape[1])
        less = np.array([self.means.get(g, none) for g in langs]).reshape(len(langs), counts.shape[1])
        return _unit(self.flat(counts) - less)

    def assign(self, counts: np.ndarray, langs: list[str]) -> np.ndarray:
        topic = (self.vectors(counts, langs) @ self.centres.T).argmax(1)
        return np.where(counts.sum(1) > 0, topic, 0)


def matrix(arr: pa.Array) -> np.ndarray:
    return arr.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, BUCKETS)


def _totals(bags: DataFrame, groups: int, width: int, make: Callable) -> np.ndarray:
    """(groups, width) sums over all rows with words of make(counts, langs): each row's group, and its integers."""

    def run(batches):
        total = np.zeros((groups, width), np.int64)
        for b in batches:
            counts = matrix(b.column(0))
            some = counts.sum(1) > 0
            group, x = make(counts[some], [g for g, s in zip(b.column(1).to_pylist(), some, strict=True) if s])
            for k in range(groups):
                total[k] += x[group == k].astype(np.int64).sum(0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], names=["at", "total"])

    parts = bags.select("bag", "c_lang").mapInArrow(run, "at long, total long")
    out = np.zeros(groups * width, np.int64)
    for r in parts.groupBy("at").agg(F.sum("total").alias("total")).collect():  # groups * width rows at most
        out[r["at"]] = r["total"]
    return out.reshape(groups, width)


def _seeds(x: np.ndarray, topics: int) -> np.ndarray:
    """The least row, and then again and again the farthest one from those chosen."""
    centres = np.zeros((topics, x.shape[1]))
    if len(x):
        x = x[np.lexsort(x.T)]
        centres[0] = x[0]
        for k in range(1, topics):
            centres[k] = x[np.argmin((x @ centres[:k].T).max(1))]
    return centres


def fit_topics(bags: DataFrame, langs: list[str], topics: int = TOPICS, rounds: int = ROUNDS, seed_rows: int = SEED_ROWS) -> Topics:
    """Topics of rows (tag: a hash of the text, c_lang: one of `langs`, n_words, bag)."""
    place = {g: k for k, g in enumerate(langs)}

    def by_lang(x: Callable) -> Callable:
        return lambda counts, seen: (np.array([place[g] for g in seen], np.int64), x(counts))

    found = _totals(bags, len(langs), BUCKETS + 1, by_lang(lambda c: np.column_stack([c > 0, np.ones(len(c))])))
    model = Topics(np.log((found[:, -1].sum() + 1) / (found[:, :-1].sum(0) + 1)) + 0.1, {}, np.zeros((topics, BUCKETS)))
    sums = _totals(bags, len(langs), BUCKETS, by_lang(lambda c: np.rint(model.flat(c) * SCALE)))
    model.means = {g: sums[k] / (SCALE * found[k, -1]) for k, g in enumerate(langs) if found[k, -1]}
    some = bags.filter("n_words > 0")
    tags = some.select("tag").distinct().orderBy(F.xxhash64("tag"), "tag").limit(seed_rows)  # the bound that lets it be broadcast
    seeds = some.join(F.broadcast(tags), "tag").groupBy("tag").agg(F.min("c_lang").alias("g"), F.min("bag").alias("b")).toPandas()
    counts = np.array(seeds["b"].tolist(), float).reshape(-1, BUCKETS)
    has = counts.sum(1) > 0
    model.centres = _seeds(model.vectors(counts[has], seeds["g"][has].tolist()), topics)
    for _ in range(rounds):
        sums = _totals(bags, topics, BUCKETS, lambda c, g: (model.assign(c, g), np.rint(model.vectors(c, g) * SCALE)))
        held = np.abs(sums).sum(1) > 0
        before, model.centres = model.centres, np.where(held[:, None], _unit(sums / SCALE), model.centres)
        if np.abs(before - model.centres).max() < 1e-6:
            break
    return model


def rake(held: np.ndarray, categories: list[np.ndarray], shares: list[np.ndarray | None], total: float, rounds: int = 500):
    """Cell weights of that total, at most `held`, whose sums by each dimension's categories are in its shares."""
    weight = held * (total / max(held.sum(), 1e-12))
    for _ in range(rounds):
        before = weight
        for at, share in zip(categories, shares, strict=True):
            if share is not None:
                sums = np.bincount(at, weight, len(share)).astype(float)
                want = np.where(sums > 0, share, 0)
                want = want / max(want.sum(), 1e-12) * total
                weight = np.minimum(weight * np.divide(want, sums, out=np.zeros_like(sums), where=sums > 0)[at], held)
        if np.abs(weight - before).max(initial=0) <= 1e-9 * max(total, 1):
            break
    return weight


def target_shares(targets: dict[str, float] | float, names: list[str], at: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The shares of the names in use; the other ones' share is what they hold. A number: a power of what each holds."""
    total = max(held.sum(), 1e-12)
    if not isinstance(targets, dict):
        share = (np.bincount(at, held, len(names)) / total) ** targets
        return share / max(share.sum(), 1e-12)
    share = np.array([targets.get(n, 0.0) for n in names])
    share = share / max(share.sum(), 1e-12)
    if OTHER in names and OTHER not in targets:
        rest = held[at == names.index(OTHER)].sum() / total
        share = share * (1 - rest)
        share[names.index(OTHER)] = rest
    return share


def probabilities(cells: list[tuple], targets: dict[str, dict[str, float] | float], fraction: float) -> np.ndarray:
    """Each cell's sampling probability; cells: (source, lang, topic, weight)."""
    held = np.array([float(c[3]) for c in cells])
    categories, shares = [], []
    for d, dimension in enumerate(("source", "lang", "topic")):
        names = sorted({c[d] for c in cells})
        at = np.array([names.index(c[d]) for c in cells], np.int64)
        categories.append(at)
        shares.append(target_shares(targets[dimension], names, at, held) if targets.get(dimension) else None)
    weight = rake(held, categories, shares, fraction * held.sum())
    return np.divide(weight, held, out=np.full(len(held), fraction), where=held > 0)


def residuals(cells: list[tuple], chance: np.ndarray, targets: dict[str, dict[str, float] | float]) -> list[tuple[str, str, float, float]]:
    """(dimension, category, share asked for, share that the probabilities give) of each raked dimension."""
    held = np.array([float(c[3]) for c in cells])
    weight, out = held * chance, []
    for d, dimension in enumerate(("source", "lang", "topic")):
        if targets.get(dimension):
            names = sorted({c[d] for c in cells})
            at = np.array([names.index(c[d]) for c in cells], np.int64)
            got = np.bincount(at, weight, len(names)) / max(weight.sum(), 1e-12)
            out += zip([dimension] * len(names), names, target_shares(targets[dimension], names, at, held).tolist(), got.tolist(), strict=True)
    return out


def folded(column: Column, targets: dict[str, float] | None) -> Column:
    """The column's value if the targets name it, else "other"."""
    return F.when(column.isin(list(targets or {})), column).otherwise(F.lit(OTHER))


def mix(
    df: DataFrame,
    targets: dict[str, dict[str, float] | float] = TARGETS,
    fraction: float = FRACTION,
    seed: int = SEED,
    key: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns `keep` of `df` (all), and a struct `mixing`: topic, n_words, probability, sampled."""
    common.bound_batches(df.sparkSession)

    @F.arrow_udf("struct<n_words:bigint,bag:array<int>>")
    def bag(texts: pa.Array) -> pa.Array:
        n, counts = bags(*common.buffer(texts))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BUCKETS, pa.int32()), pa.array(counts.astype(np.int32).ravel()))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), lists], names=["n_words", "bag"])

    keep = keep or df.columns
    rows = df.select(
        F.struct(*[F.col(c) for c in keep]).alias("row"),
        F.col(key).alias("k"),
        F.xxhash64(common.text_of(F.col(text))).alias("tag"),
        folded(F.col("source"), targets.get("source")).alias("c_source"),
        folded(F.col("lang"), targets.get("lang")).alias("c_lang"),
        bag(common.text_of(F.col(text))).alias("m"),
    )
    rows = common.materialise(rows.select("row", "k", "tag", "c_source", "c_lang", "m.*"), "bags")
    model = fit_topics(rows, sorted({OTHER, *(targets.get("lang") or {})}))

    @F.arrow_udf("int")
    def assign(counts: pa.Array, langs: pa.Array) -> pa.Array:
        return pa.array(model.assign(matrix(counts), langs.to_pylist()), pa.int32())

    rows = rows.withColumn("topic", assign(F.col("bag"), F.col("c_lang")))
    topics = F.col("topic").cast("string")
    by_name = isinstance(targets.get("topic"), dict)
    rows = rows.withColumn("c_topic", folded(topics, targets["topic"]) if by_name else topics)
    cell = ["c_source", "c_lang", "c_topic"]
    cells = [tuple(r) for r in rows.groupBy(*cell).agg(F.sum("n_words").alias("w")).orderBy(*cell).collect()]
    chance = probabilities(cells, targets, fraction)
    gaps = residuals(cells, chance, targets)
    if gaps:
        worst = max(gaps, key=lambda x: abs(x[2] - x[3]))
        LOG.info("asked for %.3f of all words; the greatest gap is %s %s: %.3f asked for, %.3f given", fraction, *worst)
    odds = df.sparkSession.createDataFrame([(*c[:3], float(p)) for c, p in zip(cells, chance, strict=True)], "c_source string, c_lang string, c_topic string, p double")
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("k")), 11) * F.lit(2.0**-53)
    out = rows.join(F.broadcast(odds), cell)
    mixing = F.struct("topic", "n_words", F.col("p").alias("probability"), (drawn < F.col("p")).alias("sampled"))
    return out.select(*[F.col("row")[c].alias(c) for c in keep], mixing.alias(common.fresh(df, "mixing")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mix(docs, keep=["doc_id", "source", "lang"]).select("doc_id", "source", "lang", "mixing.*")
