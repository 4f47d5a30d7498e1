"""Documents as they arrive: a file stream of a folder, each micro-batch through the dataflow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foliospark import pipeline
from foliospark.profiles import Profile

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, results: str, checkpoints: str, profile: Profile | None = None, files_per_batch: int = 100) -> StreamingQuery:
    """Write the RESULT rows of all documents in a folder, those there now and those to come, to a Parquet table.

    A batch is written under its number, so that a batch run again after a failure replaces what it had written.
    """
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_per_batch)

    def write(batch: DataFrame, number: int) -> None:
        pipeline.optimize(batch, profile).write.mode("overwrite").parquet(f"{results}/batch={number}")

    return reader.load(folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoints).trigger(availableNow=True).start()
