"""Queries over documents that are made from the given tables: pictures from vectors, pages from orders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark import pipeline
from foliospark.pdf import build
from foliospark.plans.relational import pictures
from foliospark.profiles import MinimalFileSize
from foliospark.sources import documents as source
from foliospark.tables import table, written


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a document per vector, with its picture enlarged twelvefold and drawn twice, once clipped."""

    def make(batches):
        for batch in batches:
            made = []
            for v, samples in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                picture = np.array(samples, np.uint8).reshape(8, 8).repeat(12, 0).repeat(12, 1)
                document = build.empty()
                image = document.add(build.image_stream(np.stack([picture] * 3, -1) if v % 2 else picture))
                clip = (0, 0, 18 + v % 36, 405) if v % 3 else None
                build.add_page(document, [(image, (36.0, 0.0, 0.0, 24.0, 0.0, 0.0), clip)])
                build.add_page(document, [(image, (36.0, 0.0, 0.0, 24.0, 0.0, 0.0), clip)])
                made.append((f"made/{v}.pdf", document.save(compact=False)))
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.binary())], names=["path", "content"])

    spread = pictures(spark, sf_dir).repartition(pipeline.tasks(table(spark, sf_dir, "embeddings")), "vec_id")
    return spread.mapInArrow(make, "path string, content binary")


def pdf_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many objects of each kind the documents hold."""
    return source.objects(documents(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("objects"))


PDF_OBJECTS_SQL = """
SELECT 'dictionary' AS kind, count(*) * 4 AS objects FROM embeddings UNION ALL SELECT 'stream', count(*) * 3 FROM embeddings
"""


def pdf_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each drawing's page, matrix and clip."""
    d = source.drawings(documents(spark, sf_dir))
    return d.select("path", "page", F.col("ctm.a").alias("a"), F.col("ctm.d").alias("d"), F.col("clip.x1").alias("clip_x1"), F.col("clip.y1").alias("clip_y1"), "px_w", "px_h")


PDF_DRAWINGS_SQL = """
SELECT 'made/' || vec_id::VARCHAR || '.pdf' AS path, page::INTEGER AS page, 36.0::DOUBLE AS a, 24.0::DOUBLE AS d,
  CASE WHEN vec_id % 3 <> 0 THEN 18 + vec_id % 36 ELSE 720 END::DOUBLE AS clip_x1, 405.0::DOUBLE AS clip_y1, 96 AS px_w, 96 AS px_h
FROM embeddings, unnest([0, 1]) AS t(page)
"""


def pdf_optimized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run makes of each document: sizes, images, merged objects, errors."""
    done = written(pipeline.optimize(documents(spark, sf_dir), MinimalFileSize(declare_srgb=True)), "optimized")
    return done.select("path", "before_bytes", "after_bytes", F.size("images").alias("n_images"), "merged_objects", "srgb_tagged", "error")


def flate_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts deflated at levels 1 and 9, and whether lossless could still beat a candidate of a hundredth of the size."""
    import zlib

    from foliospark.pdf.pixels import FLATE_GAIN

    def sizes(texts: pa.Array) -> pa.Array:
        raw = [(t or "").encode() for t in texts.to_pylist()]
        fast, full = ([len(zlib.compress(r, level)) for r in raw] for level in (1, 9))
        hopeless = [f > FLATE_GAIN * max(1, len(r) // 100) for f, r in zip(fast, raw, strict=True)]
        return pa.StructArray.from_arrays([pa.array(fast, pa.int64()), pa.array(full, pa.int64()), pa.array(hopeless)], names=["level1", "level9", "skipped"])

    made = F.arrow_udf(sizes, "struct<level1:bigint,level9:bigint,skipped:boolean>")
    return table(spark, sf_dir, "documents").select("doc_id", made("text").alias("s")).select("doc_id", "s.*")


QUERIES = {"pdf_objects": pdf_objects, "pdf_drawings": pdf_drawings, "pdf_optimized": pdf_optimized, "flate_sizes": flate_sizes}
SQL = {"pdf_objects": PDF_OBJECTS_SQL, "pdf_drawings": PDF_DRAWINGS_SQL}
