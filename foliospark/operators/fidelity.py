"""Fidelity of rendered pages, and the benchmark's rows: sizes, seconds, decibels and errors of each case and quality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.metrics import IDENTICAL
from foliospark.pdf import pixels

RASTER = "struct<width:int,height:int,data:binary>"


def page_psnr(base: dict | None, other: dict | None) -> float | None:
    """Decibels between two RGB rasters, the other one brought to the base's size; None if either holds no whole picture."""
    pictures = []
    for r in (base, other):
        raw = np.frombuffer((r or {}).get("data") or b"", np.uint8)
        if not len(raw) or len(raw) != r["width"] * r["height"] * 3:
            return None
        pictures.append(raw.reshape(r["height"], r["width"], 3))
    if pictures[0].shape != pictures[1].shape:
        pictures[1] = pixels.resized(pixels.Picture("RGB", pictures[1]), (base["width"], base["height"])).samples
    gap = pictures[0].astype(np.int64) - pictures[1]
    mse = float((gap * gap).mean())
    return IDENTICAL if mse == 0 else float(10.0 * np.log10(65025.0 / mse))


def _decibels(base: pa.Array, other: pa.Array) -> pa.Array:
    return pa.array([page_psnr(a, b) for a, b in zip(base.to_pylist(), other.to_pylist(), strict=True)], pa.float64())


def compared_pages(raw: DataFrame, theirs: DataFrame, ours: DataFrame, key: list[str]) -> DataFrame:
    """(key, their_psnr, our_psnr): means over the pages that both have; null where there is none.

    Each table has the key, `page` and `raster` (width, height, RGB data), one row a page.
    """
    both = raw.select(*key, "page", F.col("raster").alias("base"))
    for name, other in (("their_psnr", theirs), ("our_psnr", ours)):
        both = both.join(other.select(*key, "page", F.col("raster").alias(name)), [*key, "page"], "left")
    decibels = F.arrow_udf(_decibels, "double")
    scored = both.select(*key, *[decibels("base", n).alias(n) for n in ("their_psnr", "our_psnr")])
    return scored.groupBy(*key).agg(F.avg("their_psnr").alias("their_psnr"), F.avg("our_psnr").alias("our_psnr"))


def benchmark_rows(runs: DataFrame, files: DataFrame, results: DataFrame, pages: DataFrame, compared: DataFrame | None = None) -> DataFrame:
    """A row per run: deck, quality, pages, raw_bytes, their_bytes, our_bytes, their_psnr, our_psnr, seconds, error.

    runs (deck, quality, raw, reference); files (path, length); results (path, quality, after_bytes, seconds, error); pages (path,
    pages); compared (deck, quality, their_psnr, our_psnr, error). A run without a result, or whose result has an error, has
    size 0, no seconds and no decibels; an error of the comparison stays beside the sizes.
    """
    sizes = files.select("path", "length")
    made = results.select(F.col("path").alias("raw"), "quality", "after_bytes", "seconds", F.col("error").alias("failed"), F.lit(True).alias("ran"))
    rows = runs.join(sizes.withColumnsRenamed({"path": "raw", "length": "raw_bytes"}), "raw", "left")
    rows = rows.join(sizes.withColumnsRenamed({"path": "reference", "length": "their_bytes"}), "reference", "left")
    rows = rows.join(pages.select(F.col("path").alias("raw"), "pages"), "raw", "left").join(made, ["raw", "quality"], "left")
    fine = F.col("ran").isNotNull() & F.col("failed").isNull()
    if compared is None:
        rows = rows.withColumns({"their_psnr": F.lit(None).cast("double"), "our_psnr": F.lit(None).cast("double"), "unseen": F.lit(None).cast("string")})
    else:
        seen = compared if "error" in compared.columns else compared.withColumn("error", F.lit(None).cast("string"))
        rows = rows.join(seen.select("deck", "quality", "their_psnr", "our_psnr", F.concat(F.lit("render: "), "error").alias("unseen")), ["deck", "quality"], "left")
    return rows.select(
        "deck",
        "quality",
        F.coalesce("pages", F.lit(0)).alias("pages"),
        "raw_bytes",
        "their_bytes",
        F.when(fine, F.col("after_bytes")).otherwise(0).alias("our_bytes"),
        F.when(fine, F.col("their_psnr")).alias("their_psnr"),
        F.when(fine, F.col("our_psnr")).alias("our_psnr"),
        F.when(fine, F.col("seconds")).otherwise(0.0).alias("seconds"),
        F.when(F.col("ran").isNull(), F.lit("not run")).otherwise(F.coalesce("failed", "unseen")).alias("error"),
    )
