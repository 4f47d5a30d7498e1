"""Timing, size and benchmark reports as relational queries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How the files of a case are told apart.
KINDS = {"uncompressed.pdf": "raw", "new-0.8.pdf": "0.8", "new.pdf": "0.6"}
CSV_COLUMNS = ["deck", "quality", "pages", "raw_bytes", "their_bytes", "our_bytes", "size_delta_pct", "their_psnr", "our_psnr", "psnr_delta", "seconds", "error"]


def guarded_ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 if b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def phase_shares(timings: DataFrame, phase: str, seconds: str) -> DataFrame:
    """(phase, seconds, share): each phase's sum and its percentage of all of them."""
    sums = timings.groupBy(F.col(phase).alias("phase")).agg(F.sum(F.col(seconds)).alias("seconds"))
    total = sums.agg(F.sum("seconds").alias("total"))  # one row
    share = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(100.0 * F.col("seconds") / F.col("total"))
    return sums.join(F.broadcast(total)).select("phase", F.bround("seconds", 6).alias("seconds"), F.bround(share, 6).alias("share"))


def size_delta(ours: Column, theirs: Column) -> Column:
    """Percent that ours is larger than theirs; 0 if theirs is empty."""
    return F.when(theirs == 0, F.lit(0.0)).otherwise(100.0 * (ours / theirs - 1.0))


def with_deltas(rows: DataFrame) -> DataFrame:
    """All columns of benchmark rows, and size_delta_pct and psnr_delta (null if either is)."""
    return rows.withColumn("size_delta_pct", size_delta(F.col("our_bytes"), F.col("their_bytes"))).withColumn(
        "psnr_delta", F.col("our_psnr") - F.col("their_psnr")
    )


def by_quality(rows: DataFrame) -> DataFrame:
    """A row per quality over the rows that went well: sums, ratios, and how the deltas lie."""
    fine = with_deltas(rows).filter(F.col("error").isNull() & (F.col("our_bytes") > 0))
    sums = fine.groupBy("quality").agg(
        F.count("*").alias("decks"),
        F.sum("raw_bytes").alias("raw_bytes"),
        F.sum("their_bytes").alias("their_bytes"),
        F.sum("our_bytes").alias("our_bytes"),
        F.bround(F.median("size_delta_pct"), 6).alias("median_delta"),
        F.bround(F.min("size_delta_pct"), 6).alias("best_delta"),
        F.bround(F.max("size_delta_pct"), 6).alias("worst_delta"),
        F.count_if(F.col("size_delta_pct") < 0).alias("smaller"),
        F.bround(F.median("psnr_delta"), 6).alias("median_psnr_delta"),
        F.count("psnr_delta").alias("compared"),
        F.count_if(F.col("psnr_delta") > 0).alias("better"),
        F.bround(F.sum("seconds"), 6).alias("seconds"),
        F.bround(F.avg("seconds"), 6).alias("seconds_per_deck"),
    )
    raw = F.col("raw_bytes")
    return sums.select(
        "*",
        F.bround(guarded_ratio(raw, F.col("their_bytes")), 6).alias("their_ratio"),
        F.bround(guarded_ratio(raw, F.col("our_bytes")), 6).alias("our_ratio"),
        F.bround(size_delta(F.col("our_bytes"), F.col("their_bytes")), 6).alias("total_delta"),
    )


def cases(files: DataFrame, name: str) -> DataFrame:
    """(deck, raw, q0_6, q0_8): the files of each case that has a raw one and one to compare with.

    A file's case is its name before the first of the known endings, the longest ending first.
    """
    kind, deck = F.lit(None).cast("string"), F.lit(None).cast("string")
    for ending, which in sorted(KINDS.items(), key=lambda x: len(x[0])):
        fits = F.col(name).endswith("." + ending)
        kind = F.when(fits, which).otherwise(kind)
        deck = F.when(fits, F.expr(f"left(`{name}`, length(`{name}`) - {len(ending) + 1})")).otherwise(deck)
    known = files.select(deck.alias("deck"), kind.alias("kind"), F.col(name).alias("file")).filter("kind IS NOT NULL")
    wide = known.groupBy("deck").pivot("kind", ["raw", "0.6", "0.8"]).agg(F.max("file"))
    wide = wide.withColumnsRenamed({"0.6": "q0_6", "0.8": "q0_8"})
    return wide.filter("raw IS NOT NULL AND (q0_6 IS NOT NULL OR q0_8 IS NOT NULL)")


def runs(found: DataFrame) -> DataFrame:
    """(deck, quality, raw, reference): a row for each case and quality that it has a file for."""
    pairs = F.explode(F.array(F.struct(F.lit("0.6").alias("quality"), F.col("q0_6").alias("reference")), F.struct(F.lit("0.8").alias("quality"), F.col("q0_8").alias("reference"))))
    return found.select("deck", "raw", pairs.alias("p")).select("deck", "p.quality", "raw", "p.reference").filter("reference IS NOT NULL")


def smallest(rows: DataFrame, size: str, tie: str, n: int) -> DataFrame:
    """The n smallest rows (a top-k: one heap per task)."""
    return rows.orderBy(F.col(size), F.col(tie)).limit(n)


def sampled_pages(documents: DataFrame, pages: str, sample: int) -> DataFrame:
    """All columns, exploded to `page`: all pages, or `sample` of them evenly spread."""
    n = F.col(pages)
    step = n.cast("double") / (sample + 1)
    spread = F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.lit(sample)), lambda i: F.greatest(F.lit(1), F.least(n.cast("int"), F.bround(step * i).cast("int"))))
    )
    whole = F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1)))
    return documents.filter(n > 0).withColumn("page", F.explode(F.when(n <= sample, whole).otherwise(spread)))


def fixed(x: Column, digits: int) -> Column:
    """x as text with so many decimals, as C and Python print it: its exact binary value is rounded, ties to the even digit.

    Java's formatter (`format_string`) rounds the shortest decimal that names x, and ties up: it makes -3.13 of -3.125, and 0.05 of
    0.045, which is a little less. Exact native expressions make methods larger than the JVM compiles, and are slower. Null stays null.
    """
    show = f"%.{digits}f"

    def text(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else show % v for v in values.to_pylist()], pa.string())

    return F.arrow_udf(text, "string")(x.cast("double"))


def csv_rows(rows: DataFrame) -> DataFrame:
    """The benchmark's twelve columns as text: two decimals for deltas and seconds, three for decibels, nothing for null."""
    shown = {"size_delta_pct": 2, "their_psnr": 3, "our_psnr": 3, "psnr_delta": 3, "seconds": 2}
    ready = with_deltas(rows)
    return ready.select(
        *[F.coalesce(fixed(F.col(c), shown[c]) if c in shown else F.col(c).cast("string"), F.lit("")).alias(c) for c in CSV_COLUMNS]
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """The benchmark table as CSV files with a header, by quality and deck."""
    csv_rows(rows).orderBy("quality", "deck").write.option("header", True).option("emptyValue", "").csv(path)


def running_order(rows: DataFrame, by: list[str]) -> DataFrame:
    """All columns, and `position` within the whole order of each quality."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("quality").orderBy(*by)))
