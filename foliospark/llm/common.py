"""Helpers shared by the training-data operators: shared scratch tables and Arrow buffers."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that Python code handles at once; a longer single text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 4 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Only where a local session (plain tests) doesn't set it a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="foliospark-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of BATCH_BYTES at most (or one longer text), so that a worker's memory is bound.

    The setting is the session's; a smaller one is kept.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_file(spark: SparkSession, path: str) -> bytes:
    """A vocabulary's bytes, from the driver's disk or from any store that Spark reads."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(col):
    """A text column with null as the empty text."""
    return F.coalesce(col, F.lit(""))


def named(value, use):
    """use(value) as a column, with the value made once for a row however often `use` reads it, within lambdas too."""
    return F.transform(F.array(value), use)[0]


def buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, n+1 offsets into them) of a string or binary array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Runs [i, j) of rows with at most `limit` bytes together, or one longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Consecutive cuts of `data` as a binary array, without copies."""
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    )


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray):
    """Words (runs without ASCII white space) of the rows of a byte buffer.

    Returns (codes, vocabulary, first): the word codes in order, the distinct words as a binary array, and for each
    row the index of its first word (n+1 entries).
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), pa.array([], pa.binary()), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    head = np.ones(n, bool)
    head[1:] = space[:-1]
    edge = offsets[:-1]
    head[edge[edge < n]] = True
    head &= ~space
    kept = data[~space]
    place = np.cumsum(~space)
    starts = np.flatnonzero(head)
    cuts = np.append(place[starts] - 1, len(kept))
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.int32), pa.array([], pa.binary()), first
    coded = binary_array(kept, cuts).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, first


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
