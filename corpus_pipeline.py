"""A corpus pipeline of five stages over the table `documents`, each by one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return documents' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import common, mixing, pieces, quality, secret_scan, simhash

SHINGLE, SIMILARITY, WORDS, BLOCK = 5, 0.8, 64, 1024


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; without usable labels there is no classifier, and all stay.

    Each row is judged by its whole text alone: null text is empty and gets a score like any other, a null id may be
    accepted, rows equal in text stay or go together. An empty table gives an empty one; further columns are kept as they are,
    whatever their names.
    """
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    if not model.fitted:
        return docs
    score = common.fresh(docs, "score")
    return quality.score_texts(docs, model, out=score).filter(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 of their five-word shingles: that with the smallest id.

    SimHash of 4096 bits finds the candidates, exact similarity links them. Null text is empty; a text of fewer than five words
    is one shingle; texts without words are copies of each other. Rows with a null id stay. Of different texts under one
    id, each is a document: of two such in one group that with the smaller XXH64 stays. Of rows equal in id and text one stays.
    An empty table gives an empty one; further columns are kept as they are, whatever their names.
    """
    found = simhash.near_duplicates(
        docs, shingle=SHINGLE, words=WORDS, radius=simhash.radius_for(SIMILARITY, 64 * WORDS), candidates="anchors", block=BLOCK, similarity=SIMILARITY
    )
    first, mark, tag = (common.fresh(docs, x) for x in ("first_id", "first_tag", "tag"))
    kept = found.filter("doc_id = component_id AND tag = first_tag").select(F.col("doc_id").alias(first), F.col("tag").alias(mark)).distinct()
    kept = common.materialise(kept, "kept")
    tagged = docs.withColumn(tag, F.xxhash64(common.text_of(F.col("text"))))
    named = tagged.join(kept, (F.col("doc_id") == F.col(first)) & (F.col(tag) == F.col(mark))).dropDuplicates(["doc_id", tag])
    return named.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced by a mark and the number of characters brought up to date.

    Null text stays null and has no secrets; where none is found n_chars stays as it is, null too. Spans that overlap become
    one mark; rows equal in text are redacted alike, whatever their ids. An empty table gives an empty one; further
    columns are kept as they are, whatever their names.
    """
    found = secret_scan.scan(docs)
    spans = found.columns[-1]
    text = F.when(F.col("text").isNotNull(), secret_scan.redact(F.col("text"), F.col(spans)))
    changed = found.withColumn("text", text)
    chars = F.when(F.size(spans) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", chars).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled with probabilities raked to the target weights of sources, languages and topics.

    Null text is empty and weighs nothing; null and unnamed sources and languages are "other". A draw goes by doc_id: rows
    of one id (null is one) share the draw, and stay or go together within a cell. An empty table gives an empty one; further
    columns are kept as they are, whatever their names.
    """
    mixed = mixing.mix(docs)
    return mixed.filter(F.col(mixed.columns[-1])["sampled"]).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, token_ids, n_tokens, decoded_sha256, lossless): a sampled segmentation of each text.

    A row for each row: null and empty texts have no pieces; equal rows get equal pieces; a null id is a key like any other.
    An empty table gives an empty one; further columns are not read.
    """
    return pieces.sample_encode(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", "pieces.*")


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: SQL expresses neither the fitted models nor the sampling; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written to the shared folder and read by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
