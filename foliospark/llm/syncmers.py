"""Operator 4 [native]: document fingerprints from closed syncmers.

A text's words are hashed. An inner string is INNER words, a k-mer is KMER words; a k-mer is chosen (a closed syncmer) if the
least hash of its inner strings stands at its first or last place. The choice depends on the k-mer's own words alone, so an
edit changes no anchor whose words it leaves, and shared passages keep their anchors at shifted positions. The fingerprint
is all of them in order: of each the step from the one before in words (a digit, for no two are further apart than
KMER - INNER words) and 32 bits of its hash, 8 hex digits.

Two fingerprints are matched by position: each hash that both have pairs its first places in either, and a pair counts if it
stands in the same order as the pair before or after it (a lone pair counts). The likeness is the number of counted pairs
over the distinct hashes of either that remain: Jaccard similarity of the anchors that both have in the same order.

Only DataFrame expressions are used; a text is one row throughout and is never exploded.

Edge cases: an empty table gives no rows, and further columns are not read; null text is empty; a text without words has the empty fingerprint, which is like (1.0) another empty one and
unlike (0.0) any other; a text of fewer than KMER words, or (rarely) without a closed syncmer, has its whole word sequence
as its one k-mer. When the next document is sought, equal rows are one document and each gets its result; different texts of
one doc_id go by their hash; a null doc_id is lowest; a single document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm import common

KMER = 5
INNER = 2
LOW, PLACE, SIDE = 0xFFFFFFFF, 0x7FFFFFFF, 0x80000000


def word_hashes(text: Column) -> Column:
    """XXH64 of the words of a text, in order."""
    words = F.filter(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def inner_hashes(hashes: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(hashes) - (INNER - 1), F.lit(1))),
        lambda i: F.xxhash64(*[F.get(hashes, i + (j - 1)) for j in range(INNER)]),
    )


def places(hashes: Column, inner: Column) -> Column:
    """First words of the closed syncmers."""
    last = KMER - INNER
    return F.filter(
        F.sequence(F.lit(0), F.greatest(F.size(hashes) - KMER, F.lit(0))),
        lambda i: F.least(F.get(inner, i), F.get(inner, i + last)) <= F.least(*[F.get(inner, i + j) for j in range(1, last)]),
    )


def anchors(hashes: Column, first: Column) -> Column:
    """array<bigint>: the closed syncmers in order, each the place of its first word and 32 bits of its hash; or the whole sequence at 0."""

    def packed(at: Column, h: Column) -> Column:
        return F.shiftleft(at.cast("long"), 32).bitwiseOR(h.bitwiseAND(F.lit(LOW)))

    chosen = F.transform(first, lambda i: packed(i, F.xxhash64(*[F.get(hashes, i + j) for j in range(KMER)])))
    whole = F.array(packed(F.lit(0), F.xxhash64(hashes)))
    return (
        F.when(F.size(hashes) == 0, F.slice(whole, 1, 0))
        .when((F.size(hashes) < KMER) | (F.size(first) == 0), whole)
        .otherwise(chosen)
    )


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """All columns of `df`, and the anchors of its text column.

    Each step is a column of its own, so that the next one's lambda reads an array and doesn't make it anew.
    """
    h, s, p = (common.fresh(df, f"{out}_{x}") for x in ("words", "inner", "places"))
    made = df.withColumn(h, word_hashes(common.text_of(F.col(text))))
    made = made.withColumn(s, inner_hashes(F.col(h)))
    made = made.withColumn(p, places(F.col(h), F.col(s)))
    return made.withColumn(out, anchors(F.col(h), F.col(p))).drop(h, s, p)


def place(anchor: Column) -> Column:
    return F.shiftrightunsigned(anchor, 32)


def as_text(found: Column) -> Column:
    """Nine hex digits for each anchor."""

    def digits(a: Column, i: Column) -> Column:
        step = place(a) - F.coalesce(place(F.get(found, i - 1)), F.lit(0).cast("long"))
        return F.concat(F.lower(F.hex(step)), F.lpad(F.lower(F.hex(a.bitwiseAND(F.lit(LOW)))), 8, "0"))

    return F.array_join(F.transform(found, digits), "")


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of anchors."""

    def pairs(ordered: Column) -> Column:
        """The first places of each shared hash, of `a` in the high half; in `ordered` they are neighbours."""

        def meet(x: Column, y: Column) -> Column:
            shared = F.shiftrightunsigned(x.bitwiseXOR(y), 31) == 1  # the same hash, on either side
            return F.when(shared, F.shiftleft(F.lit(PLACE) - x.bitwiseAND(F.lit(PLACE)), 32).bitwiseOR(y.bitwiseAND(F.lit(PLACE))))

        following = F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0)))
        return F.sort_array(F.filter(F.zip_with(ordered, following, meet), lambda x: x.isNotNull()))

    def counted(paired: Column) -> Column:
        """How many pairs are in the order of a neighbour."""

        def low(i: Column) -> Column:
            return F.get(paired, i).bitwiseAND(F.lit(LOW))

        def fine(x: Column, i: Column) -> Column:
            mine = x.bitwiseAND(F.lit(LOW))
            return F.coalesce(low(i - 1) < mine, F.lit(False)) | F.coalesce(mine < low(i + 1), F.lit(False))

        return F.when(F.size(paired) == 1, F.lit(1)).otherwise(F.size(F.filter(paired, fine)))

    def key(x: Column) -> Column:
        return F.shiftleft(x, 32)

    left = F.transform(a, lambda x: key(x).bitwiseOR(F.lit(PLACE) - place(x)))  # later places first, so that the first one is last
    right = F.transform(b, lambda x: key(x).bitwiseOR(F.lit(SIDE)).bitwiseOR(place(x)))
    both = common.named(common.named(F.sort_array(F.concat(left, right)), pairs), counted)
    distinct = [F.size(F.array_distinct(F.transform(x, lambda y: y.bitwiseAND(F.lit(LOW))))) for x in (a, b)]
    same = F.when(F.size(a) + F.size(b) == 0, F.lit(1.0))
    return same.otherwise(common.named(both, lambda n: n.cast("double") / (distinct[0] + distinct[1] - n)))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """All columns of `df`, and `pos`, the row's place from 0 in the order, with no step over all rows in one task.

    Rows are range-partitioned; places within partitions are added to the sums of the partitions before, of which there is
    one row per partition.
    """
    part = common.materialise(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sums = part.groupBy("part").agg(F.count("*").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = part.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
    return inside.join(F.broadcast(before), "part").withColumn("pos", F.col("at") + F.col("before")).drop("part", "at", "before")


def next_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, cut, next_id, next_tag) of each distinct (doc_id, tag, cut), by descending (doc_id, tag)."""
    placed = common.materialise(numbered(docs.distinct(), ["doc_id", "tag"]), "placed")
    rows = max(placed.count(), 1)
    # The next one of place p is p - 1, and that of place 0 the last place: seen from the donor, place p + 1 takes it.
    donors = placed.select(F.pmod(F.col("pos") + 1, F.lit(rows)).alias("pos"), F.col("doc_id").alias("next_id"), F.col("tag").alias("next_tag"))
    return placed.join(donors, "pos").drop("pos")


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", common.text_of(F.col("text")).alias("text"))
    docs = docs.withColumn("tag", F.xxhash64("text"))
    pairs = common.materialise(next_documents(docs.select("doc_id", "tag", F.floor(F.char_length("text") / 3).cast("int").alias("cut"))), "next")
    # Null ids get a value and a mark, so that both joins and the step between them are dealt by the same plain columns.
    key = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.isnull("doc_id").alias("none"), "tag"]
    told = [F.coalesce("next_id", F.lit(0)).alias("id"), F.isnull("next_id").alias("none"), F.col("next_tag").alias("tag")]
    to = [F.coalesce("doc_id", F.lit(0)).alias("to_id"), F.isnull("doc_id").alias("to_none"), F.col("tag").alias("to_tag")]
    docs = docs.select(*key, "text")
    # Both joins read the same exchange of documents. A donor's anchors are made once for its receiver, which needs only
    # their hashes in order, 4 bytes each.
    donors = with_anchors(docs.join(pairs.select(*told, *to, "cut"), ["id", "none", "tag"]), "text", "next_found")
    hashes = F.transform("next_found", lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int"))
    donors = donors.select("to_id", "to_none", "to_tag", "cut", F.expr("substring(text, 1, cut)").alias("prefix"), hashes.alias("next_hashes"))
    donors = donors.dropDuplicates(["to_id", "to_none", "to_tag"])
    both = docs.join(donors, [F.col("id") == F.col("to_id"), F.col("none") == F.col("to_none"), F.col("tag") == F.col("to_tag")])
    ordered = F.transform("next_hashes", lambda h, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(h.cast("long").bitwiseAND(F.lit(LOW))))
    both = both.withColumn("next_found", ordered).withColumn("doc_id", F.when(~F.col("none"), F.col("id")))
    both = both.withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - cut), prefix)"))
    both = both.select("doc_id", "n_chars", "text", "next_found", F.sha2("edited", 256).alias("edited_sha256"), "edited")
    both = with_anchors(with_anchors(both, "text", "found"), "edited", "edited_found")
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("found")).alias("fingerprint"),
        as_text(F.col("edited_found")).alias("edited_fingerprint"),
        likeness(F.col("found"), F.col("edited_found")).alias("near_edited"),
        likeness(F.col("found"), F.col("next_found")).alias("near_next"),
    )
