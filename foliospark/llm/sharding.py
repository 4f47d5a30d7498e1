"""Operator 8 [native]: contiguous shards of near equal size in bytes.

Rows are ordered by (hash of the text, id) with a range partitioning, each partition sums its sizes, the few partition
totals are summed up in turn, and so every row knows how many bytes come before it in the whole table. A row's shard is the
one of the equal targets in which it starts. Equal texts stand together, and one rule holds for all of them: rows that
start in the same grain of bytes, counted from the start of their group, start where the grain does. The grain is the
largest single row, by which no cut can be finer anyway; so a group within it is not parted, and a larger one is parted
between grains.

Only narrow rows (id, size, hashes) are moved. No task sees more than one partition's rows, whatever group fills them.

Edge cases: null text is empty, of size 8; null ids are lowest in their group; equal rows are interchangeable; an empty
table gives no rows; with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm import common

SHARDS = 24
OVERHEAD = 8


def shard_by_bytes(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row of `df`."""
    body = common.text_of(F.col(text))
    rows = df.select(
        F.col(key).alias("id"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body).alias("crc"),
        F.xxhash64(body).alias("h"),
        F.monotonically_increasing_id().alias("tie"),  # parts even a table of equal rows; which of them goes where is all one
    )
    order = ["h", "id", "tie"]
    rows = common.materialise(rows, "sizes")
    ranged = common.materialise(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max("size").alias("most"))
    whole = sums.agg(F.sum("bytes").alias("bytes"), F.max("most").alias("most")).first()
    total, most = whole["bytes"] or 1, whole["most"] or 0
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = sums.select(
        "part",
        F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("rows_before"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    placed = ranged.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = placed.withColumn("at", F.row_number().over(inside) - 1).join(F.broadcast(before), "part")
    placed = placed.select(
        "id", "size", "crc", "h", (F.col("bytes_before") + F.col("upto") - F.col("size")).alias("start"), (F.col("rows_before") + F.col("at")).alias("place")
    )
    placed = common.materialise(placed, "places")
    groups = placed.groupBy("h").agg(F.min("start").alias("group_start"), F.count("*").alias("n"))
    groups = common.materialise(groups.filter("n > 1").select("h", "group_start"), "groups")
    # bytes * shards stays exact: decimals hold what a long may not
    grain = F.expr(f"group_start + ((start - group_start) DIV {max(most, 1)}) * {most}L")
    cut = F.floor(F.coalesce(grain, "start").cast("decimal(38,0)") * shards / F.lit(total).cast("decimal(38,0)"))
    dealt = placed.join(groups, "h", "left").select("id", "size", "crc", "place", F.least(cut.cast("int"), F.lit(shards - 1)).alias("shard"))
    first = dealt.groupBy("shard").agg(F.min("place").alias("first"))  # at most `shards` rows
    return dealt.join(F.broadcast(first), "shard").select(
        F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("first")).cast("long").alias("slot")
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard_by_bytes(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
