"""Queries that run the engine's relational operators over the given tables, and the same in SQL.

The tables hold no documents, so each operator gets an input derived from one of them: lines of orders stand for drawn images,
vectors for 8x8 grey pictures, texts for streams, events for timings, orders for benchmark runs and for object graphs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import geometry as g
from foliospark.functions import metrics
from foliospark.operators import encode_once, fidelity, graph, report
from foliospark.operators.planner import plan_images
from foliospark.profiles import MinimalFileSize, RemovalOptions
from foliospark.tables import table, written

PAGE = (0.0, 0.0, 720.0, 405.0)


# -- drawn images -------------------------------------------------------------------------------------------------------------


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of an order as one drawing of the image `l_orderkey` on a page of 720 by 405 points."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = rows.withColumn("w", 18.0 + 12.0 * F.col("l_quantity")).withColumn("h", 0.5 * F.col("w"))
    rows = rows.withColumn("x", ((k % 97) * 9).cast("double")).withColumn("y", ((k % 53) * 3 + (n % 2) * 200).cast("double"))
    w, h, x, y = (F.col(c) for c in "whxy")
    turned, mirrored = k % 5 == 0, F.col("l_returnflag") == "R"
    zero = F.lit(0.0)
    parts = (
        F.when(turned, zero).when(mirrored, -w).otherwise(w),
        F.when(turned, w).otherwise(zero),
        F.when(turned, -h).otherwise(zero),
        F.when(turned, zero).otherwise(h),
        F.when(~turned & mirrored, x + w).otherwise(x),
        y,
    )
    ctm = g.matrix(*parts)
    # Without a clip of its own, an image is clipped to the page.
    own = [F.when(k % 3 != 0, side) for side in (x, y, x + w * (0.25 + 5.0 * F.col("l_discount")), y + h)]
    return rows.select(
        k.alias("objgen"),
        ctm.alias("ctm"),
        g.intersection(g.box(*own), g.box(*PAGE)).alias("clip"),
        F.when(k % 19 == 0, 1).otherwise(200 + 16 * (k % 50)).cast("int").alias("px_w"),
        (150 + 9 * (k % 50)).cast("int").alias("px_h"),
        n.alias("seq"),
    )


PLACEMENTS_SQL = """
base AS (
  SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag = 'R' AS mirrored, l_orderkey % 5 = 0 AS turned,
    18.0::DOUBLE + 12.0::DOUBLE * l_quantity AS w, ((l_orderkey % 97) * 9)::DOUBLE AS x,
    ((l_orderkey % 53) * 3 + (l_linenumber % 2) * 200)::DOUBLE AS y, l_discount AS disc
  FROM lineitem),
sized AS (SELECT *, 0.5::DOUBLE * w AS h FROM base),
drawn AS (
  SELECT k AS objgen,
    CASE WHEN turned THEN 0.0::DOUBLE WHEN mirrored THEN -w ELSE w END AS a,
    CASE WHEN turned THEN w ELSE 0.0::DOUBLE END AS b,
    CASE WHEN turned THEN -h ELSE 0.0::DOUBLE END AS c,
    CASE WHEN turned THEN 0.0::DOUBLE ELSE h END AS d,
    CASE WHEN NOT turned AND mirrored THEN x + w ELSE x END AS e, y AS f,
    CASE WHEN k % 3 <> 0 THEN x END AS c0, CASE WHEN k % 3 <> 0 THEN y END AS c1,
    CASE WHEN k % 3 <> 0 THEN x + w * (0.25::DOUBLE + 5.0::DOUBLE * disc) END AS c2, CASE WHEN k % 3 <> 0 THEN y + h END AS c3,
    CASE WHEN k % 19 = 0 THEN 1 ELSE 200 + 16 * (k % 50) END::INTEGER AS px_w, (150 + 9 * (k % 50))::INTEGER AS px_h, n AS seq
  FROM sized),
paged AS (
  SELECT *, greatest(c0, 0.0::DOUBLE) AS q0, greatest(c1, 0.0::DOUBLE) AS q1, least(c2, 720.0::DOUBLE) AS q2, least(c3, 405.0::DOUBLE) AS q3 FROM drawn),
clipped AS (
  SELECT *, CASE WHEN q0 < q2 AND q1 < q3 THEN q0 ELSE 0.0::DOUBLE END AS k0, CASE WHEN q0 < q2 AND q1 < q3 THEN q1 ELSE 0.0::DOUBLE END AS k1,
    CASE WHEN q0 < q2 AND q1 < q3 THEN q2 ELSE 0.0::DOUBLE END AS k2, CASE WHEN q0 < q2 AND q1 < q3 THEN q3 ELSE 0.0::DOUBLE END AS k3
  FROM paged),
foot AS (
  SELECT *, least(e, a + e, c + e, a + c + e) AS f0, least(f, b + f, d + f, b + d + f) AS f1,
    greatest(e, a + e, c + e, a + c + e) AS f2, greatest(f, b + f, d + f, b + d + f) AS f3,
    abs(b) < 1e-6 AND abs(c) < 1e-6 AS aligned
  FROM clipped),
common AS (
  SELECT *, greatest(f0, k0) AS i0, greatest(f1, k1) AS i1, least(f2, k2) AS i2, least(f3, k3) AS i3 FROM foot),
seen AS (
  SELECT *, CASE WHEN i0 < i2 AND i1 < i3 THEN i0 ELSE 0.0::DOUBLE END AS v0x, CASE WHEN i0 < i2 AND i1 < i3 THEN i1 ELSE 0.0::DOUBLE END AS v0y,
    CASE WHEN i0 < i2 AND i1 < i3 THEN i2 ELSE 0.0::DOUBLE END AS v1x, CASE WHEN i0 < i2 AND i1 < i3 THEN i3 ELSE 0.0::DOUBLE END AS v1y
  FROM common)
"""


PIXELS = ["crop_left", "crop_top", "crop_right", "crop_bottom", "out_w", "out_h"]


def planner_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's plan; -1 stands for pixels that aren't planned."""
    return plan_images(placements(spark, sf_dir), ["objgen"]).fillna(-1, PIXELS)


def planner_minimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_images(placements(spark, sf_dir), ["objgen"], MinimalFileSize(crop_to_visible=False)).fillna(-1, PIXELS)


def _plan_sql(crop: bool, dpi: float, ratio: float) -> str:
    return f"""
WITH {PLACEMENTS_SQL},
parts AS (
  SELECT *, f2 - f0 AS wide, f3 - f1 AS high, aligned AND v1x > v0x AND v1y > v0y AND f2 > f0 AND f3 > f1 AS shown FROM seen),
uv AS (
  SELECT objgen, px_w, px_h, aligned, sqrt(a * a + b * b) AS along, sqrt(c * c + d * d) AS up,
    CASE WHEN shown THEN CASE WHEN a < 0 THEN 1 - (v1x - f0) / wide ELSE (v0x - f0) / wide END END AS u0,
    CASE WHEN shown THEN CASE WHEN a < 0 THEN 1 - (v0x - f0) / wide ELSE (v1x - f0) / wide END END AS u1,
    CASE WHEN shown THEN CASE WHEN d < 0 THEN 1 - (v1y - f1) / high ELSE (v0y - f1) / high END END AS v0,
    CASE WHEN shown THEN CASE WHEN d < 0 THEN 1 - (v0y - f1) / high ELSE (v1y - f1) / high END END AS v1
  FROM parts),
grouped AS (
  SELECT objgen, min(px_w) AS w, min(px_h) AS h, bool_or(NOT aligned) AS turned, min(u0) AS u0, min(v0) AS v0, max(u1) AS u1, max(v1) AS v1,
    min(CASE WHEN along > 0 THEN along END) AS along, min(CASE WHEN up > 0 THEN up END) AS up
  FROM uv GROUP BY objgen),
held AS (
  SELECT objgen, w, h, along, up, {str(crop).lower()} AND NOT turned AND u0 IS NOT NULL AS cut, greatest(0.0::DOUBLE, u0) AS u0, greatest(0.0::DOUBLE, v0) AS v0,
    least(1.0::DOUBLE, u1) AS u1, least(1.0::DOUBLE, v1) AS v1
  FROM grouped),
chosen AS (SELECT *, cut AND NOT (u1 - u0 >= 0.999::DOUBLE AND v1 - v0 >= 0.999::DOUBLE) AS cropped FROM held),
pixels AS (
  SELECT objgen, w, h, along, up, cropped,
    CASE WHEN cropped THEN greatest(0, floor(u0 * w)::INTEGER) END AS l, CASE WHEN cropped THEN greatest(0, floor((1.0::DOUBLE - v1) * h)::INTEGER) END AS t,
    CASE WHEN cropped THEN least(w, ceil(u1 * w)::INTEGER) END AS r, CASE WHEN cropped THEN least(h, ceil((1.0::DOUBLE - v0) * h)::INTEGER) END AS b
  FROM chosen),
snapped AS (
  SELECT *, l::DOUBLE / w AS u0, 1.0::DOUBLE - b::DOUBLE / h AS v0, r::DOUBLE / w AS u1, 1.0::DOUBLE - t::DOUBLE / h AS v1,
    coalesce(r - l, w) AS cw, coalesce(b - t, h) AS ch
  FROM pixels),
measured AS (
  SELECT *, CASE WHEN cropped THEN along * (u1 - u0) ELSE along END AS wp, CASE WHEN cropped THEN up * (v1 - v0) ELSE up END AS hp FROM snapped),
dpi AS (
  SELECT *, coalesce(CASE WHEN wp > 0 THEN cw / (wp / 72.0::DOUBLE) END, 0.0::DOUBLE) AS dx, coalesce(CASE WHEN hp > 0 THEN ch / (hp / 72.0::DOUBLE) END, 0.0::DOUBLE) AS dy,
    w >= 2 AND h >= 2 AND cw >= 2 AND ch >= 2 AS planned
  FROM measured)
SELECT objgen, planned,
  coalesce(CASE WHEN planned THEN l END, -1) AS crop_left, coalesce(CASE WHEN planned THEN t END, -1) AS crop_top, coalesce(CASE WHEN planned THEN r END, -1) AS crop_right, coalesce(CASE WHEN planned THEN b END, -1) AS crop_bottom,
  CASE WHEN planned THEN u0 END AS u0, CASE WHEN planned THEN v0 END AS v0, CASE WHEN planned THEN u1 END AS u1, CASE WHEN planned THEN v1 END AS v1,
  coalesce(CASE WHEN planned THEN CASE WHEN dx > {dpi * ratio!r}::DOUBLE THEN greatest(1, round_even(cw * {dpi!r}::DOUBLE / dx, 0)::INTEGER) ELSE cw END END, -1) AS out_w,
  coalesce(CASE WHEN planned THEN CASE WHEN dy > {dpi * ratio!r}::DOUBLE THEN greatest(1, round_even(ch * {dpi!r}::DOUBLE / dy, 0)::INTEGER) ELSE ch END END, -1) AS out_h
FROM dpi
"""


def geometry_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprint, visible part, hull with the page, and a mapped point of each drawing under a doubled matrix."""
    rows = placements(spark, sf_dir)
    rows = rows.select("objgen", "seq", *g.fields("ctm", g.MATRIX), *g.fields("clip", g.BOX))
    m = g.matrix(*g.columns("ctm", g.MATRIX))
    rows = rows.select("*", *g.fields(g.footprint(m), g.BOX, "foot"))
    vis = g.intersection(g.box(*g.columns("foot", g.BOX)), g.box(*g.columns("clip", g.BOX)))
    rows = rows.select("*", *g.fields(vis, g.BOX, "vis"))
    hull = g.hull(g.box(*g.columns("vis", g.BOX)), F.when(F.col("objgen") % 2 == 0, g.box(*PAGE)))
    x, y = g.mapped(g.product(m, g.matrix(2.0, 0.0, 0.0, 2.0, 1.0, -1.0)), F.lit(0.5), F.lit(0.25))
    return rows.select(
        "objgen",
        "seq",
        g.is_aligned(m).alias("aligned"),
        *g.columns("foot", g.BOX),
        *g.columns("vis", g.BOX),
        *g.fields(hull, g.BOX, "hull"),
        x.alias("mapped_x"),
        y.alias("mapped_y"),
    )


GEOMETRY_SQL = f"""
WITH {PLACEMENTS_SQL}
SELECT objgen, seq, aligned, f0 AS foot_x0, f1 AS foot_y0, f2 AS foot_x1, f3 AS foot_y1,
  v0x AS vis_x0, v0y AS vis_y0, v1x AS vis_x1, v1y AS vis_y1,
  least(v0x, CASE WHEN objgen % 2 = 0 THEN 0.0::DOUBLE END) AS hull_x0, least(v0y, CASE WHEN objgen % 2 = 0 THEN 0.0::DOUBLE END) AS hull_y0,
  greatest(v1x, CASE WHEN objgen % 2 = 0 THEN 720.0::DOUBLE END) AS hull_x1, greatest(v1y, CASE WHEN objgen % 2 = 0 THEN 405.0::DOUBLE END) AS hull_y1,
  a * 2.0::DOUBLE * 0.5::DOUBLE + c * 2.0::DOUBLE * 0.25::DOUBLE + (e * 2.0::DOUBLE + 1.0::DOUBLE) AS mapped_x,
  b * 2.0::DOUBLE * 0.5::DOUBLE + d * 2.0::DOUBLE * 0.25::DOUBLE + (f * 2.0::DOUBLE - 1.0::DOUBLE) AS mapped_y
FROM seen
"""


def restoring_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = planner_plan(spark, sf_dir).filter("u0 IS NOT NULL")
    m = g.restoring_matrix(*(F.col(c) for c in ("u0", "v0", "u1", "v1")))
    return plans.select("objgen", *[m[c].alias(f"m_{c}") for c in "abcdef"])


RESTORING_SQL = f"""
WITH plans AS ({_plan_sql(True, 150.0, 1.4)})
SELECT objgen, round_even(u1 - u0, 6) AS m_a, 0.0::DOUBLE AS m_b, 0.0::DOUBLE AS m_c, round_even(v1 - v0, 6) AS m_d,
  round_even(u0, 6) AS m_e, round_even(v0, 6) AS m_f
FROM plans WHERE u0 IS NOT NULL
"""


# -- pictures -----------------------------------------------------------------------------------------------------------------


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, v): each vector as the 64 grey samples of an 8x8 picture."""
    sample = lambda e: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.bround(128.0 + 255.0 * e.cast("double")))).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", sample).alias("v"))


PICTURES_SQL = """pictures AS (
  SELECT vec_id, list_transform(embedding, lambda e: greatest(0.0::DOUBLE, least(255.0::DOUBLE, round_even(128.0::DOUBLE + 255.0::DOUBLE * e::DOUBLE, 0)))::INTEGER) AS v
  FROM embeddings)"""


def picture_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSNR of each picture and its copy in steps of 32, the floor for its detail, and whether it clears that."""
    rows = pictures(spark, sf_dir).withColumn("q", F.transform("v", lambda x: (F.floor(x / 32) * 32).cast("int")))
    rows = rows.withColumn("error", metrics.squared_error(F.col("v"), F.col("q")))
    rows = rows.withColumn("psnr", F.bround(metrics.psnr(F.col("error"), F.size("v")), 6))
    gap = F.aggregate(
        F.zip_with(F.slice("v", 1, 63), F.slice("v", 2, 63), lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x
    )
    rows = rows.withColumn("detail", gap / 63.0)
    floor = metrics.floor_db(0.8, F.col("detail"))
    return rows.select("vec_id", "error", "psnr", F.bround("detail", 6).alias("detail"), F.bround(floor, 6).alias("floor_db"), (F.col("psnr") >= floor).alias("clears"))


PSNR_SQL = f"""
WITH {PICTURES_SQL},
q AS (SELECT vec_id, v, list_transform(v, lambda x: (x // 32) * 32) AS q FROM pictures),
s AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: (v[i] - q[i]) * (v[i] - q[i])))::BIGINT AS error,
  list_sum(list_transform(range(1, 64), lambda i: abs(v[i] - v[i + 1])))::BIGINT / 63.0::DOUBLE AS detail FROM q),
p AS (SELECT *, CASE WHEN error = 0 THEN 99.0::DOUBLE ELSE round_even(10.0::DOUBLE * log10(65025.0::DOUBLE / (error::DOUBLE / 64)), 6) END AS psnr,
  least(48.0::DOUBLE, 18.0::DOUBLE + 22.0::DOUBLE * 0.8::DOUBLE + least(18.0::DOUBLE, 12.0::DOUBLE / (0.3::DOUBLE + detail))) AS floor_db FROM s)
SELECT vec_id, error, psnr, round_even(detail, 6) AS detail, round_even(floor_db, 6) AS floor_db, psnr >= floor_db AS clears FROM p
"""



def page_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures as grey pages of a deck per label: means of two poorer copies' decibels, each over the pages that it has."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("deck")).join(pictures(spark, sf_dir), "vec_id").withColumnRenamed("vec_id", "page")

    def raster(step: int):
        codes = F.transform(F.flatten(F.transform("v", lambda x: F.array_repeat(F.floor(x / step) * step, 3))), lambda x: F.lpad(F.hex(x), 2, "0"))
        return F.struct(F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(F.array_join(codes, "")).alias("data")).alias("raster")

    theirs = rows.filter("page % 3 > 0").select("deck", "page", raster(32))
    ours = rows.filter("page % 5 > 0").select("deck", "page", raster(16))
    found = fidelity.compared_pages(rows.select("deck", "page", raster(1)), theirs, ours, ["deck"])
    return found.select("deck", F.bround("their_psnr", 6).alias("their_psnr"), F.bround("our_psnr", 6).alias("our_psnr"))


FIDELITY_SQL = f"""
WITH {PICTURES_SQL},
e AS (
  SELECT label AS deck, p.vec_id AS page, list_sum(list_transform(v, lambda x: (x % 32) * (x % 32)))::BIGINT AS a, list_sum(list_transform(v, lambda x: (x % 16) * (x % 16)))::BIGINT AS b
  FROM pictures p JOIN embeddings e ON p.vec_id = e.vec_id)
SELECT deck,
  round_even(avg(CASE WHEN a = 0 THEN 99.0::DOUBLE ELSE 10.0::DOUBLE * log10(65025.0::DOUBLE / (a / 64.0::DOUBLE)) END) FILTER (page % 3 > 0), 6) AS their_psnr,
  round_even(avg(CASE WHEN b = 0 THEN 99.0::DOUBLE ELSE 10.0::DOUBLE * log10(65025.0::DOUBLE / (b / 64.0::DOUBLE)) END) FILTER (page % 5 > 0), 6) AS our_psnr
FROM e GROUP BY deck
"""

REACH = 1


def picture_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each picture (in steps of 64) lies within a pixel of a change, and the dilution that this makes."""
    rows = pictures(spark, sf_dir).select("vec_id", F.transform("v", lambda x: F.floor(x / 64).cast("int")).alias("v"))
    v = F.col("v")
    edge = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: ((i % 8 < 7) & (F.get(v, i) != F.coalesce(F.get(v, i + 1), F.lit(-1)))) | ((i < 56) & (F.get(v, i) != F.coalesce(F.get(v, i + 8), F.lit(-1)))),
    )
    rows = rows.withColumn("edge", edge)
    near = [(dy, dx) for dy in range(-REACH, REACH + 1) for dx in range(-REACH, REACH + 1)]

    def covered(i):
        hits = [(i % 8 + dx).between(0, 7) & F.coalesce(F.get(F.col("edge"), i + (8 * dy + dx)), F.lit(False)) for dy, dx in near]
        out = hits[0]
        for h in hits[1:]:
            out = out | h
        return out

    n = F.size(F.filter(F.sequence(F.lit(0), F.lit(63)), covered))
    rows = rows.withColumn("coverage", n / 64.0)
    return rows.select("vec_id", "coverage", F.bround(metrics.dilution(F.col("coverage")), 6).alias("dilution_db"))


COVERAGE_SQL = f"""
WITH {PICTURES_SQL},
cells AS (SELECT vec_id, i, i // 8 AS y, i % 8 AS x, v[i + 1] // 64 AS s FROM pictures, unnest(range(0, 64)) AS t(i)),
edges AS (
  SELECT a.vec_id, a.x, a.y FROM cells a LEFT JOIN cells r ON r.vec_id = a.vec_id AND r.y = a.y AND r.x = a.x + 1
    LEFT JOIN cells d ON d.vec_id = a.vec_id AND d.x = a.x AND d.y = a.y + 1
  WHERE (r.s IS NOT NULL AND r.s <> a.s) OR (d.s IS NOT NULL AND d.s <> a.s)),
hit AS (
  SELECT DISTINCT c.vec_id, c.i FROM cells c JOIN edges e ON c.vec_id = e.vec_id AND abs(c.x - e.x) <= {REACH} AND abs(c.y - e.y) <= {REACH}),
n AS (SELECT p.vec_id, count(h.i) / 64.0::DOUBLE AS coverage FROM pictures p LEFT JOIN hit h ON h.vec_id = p.vec_id GROUP BY p.vec_id)
SELECT vec_id, coverage, round_even(-10.0::DOUBLE * log10(greatest(coverage, 0.01::DOUBLE)), 6) + 0.0::DOUBLE AS dilution_db FROM n
"""


def picture_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode each picture reduces to and what its use as a soft mask would become, after steps of 255 for odd labels."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label").join(pictures(spark, sf_dir), "vec_id")
    two = F.transform("v", lambda x: F.when(x >= 128, 255).otherwise(0))
    v = F.when(F.col("label") % 4 == 0, F.transform("v", lambda x: F.lit(255))).when(F.col("label") % 2 == 1, two).otherwise(F.col("v"))
    rows = rows.withColumn("s", v).withColumn("values", F.array_distinct("s"))
    low, high = F.array_min("s"), F.array_max("s")
    mode = F.when(F.col("label") % 3 == 0, "RGB").when(F.col("label") % 3 == 1, "LA").otherwise("CMYK")
    return rows.select(
        "vec_id",
        metrics.mode_for(mode).alias("mode"),
        metrics.reduced_mode(metrics.mode_for(mode), low, high, F.col("values"), F.col("label") % 2 == 1).alias("reduced"),
        metrics.mask_action(low, F.col("values")).alias("mask_action"),
    )


CLASSES_SQL = f"""
WITH {PICTURES_SQL},
s AS (
  SELECT p.vec_id, label, CASE WHEN label % 4 = 0 THEN list_transform(v, lambda x: 255) WHEN label % 2 = 1 THEN list_transform(v, lambda x: CASE WHEN x >= 128 THEN 255 ELSE 0 END) ELSE v END AS s
  FROM pictures p JOIN embeddings e ON p.vec_id = e.vec_id),
d AS (SELECT *, list_min(s) AS lo, list_max(s) AS hi, len(list_distinct(s)) AS n, len(list_filter(list_distinct(s), lambda x: x <> 0 AND x <> 255)) AS other,
  CASE label % 3 WHEN 0 THEN 'RGB' WHEN 1 THEN 'L' ELSE 'RGB' END AS mode FROM s),
f AS (SELECT *, CASE WHEN mode = 'RGB' AND label % 2 = 1 THEN 'L' ELSE mode END AS flat FROM d)
SELECT vec_id, mode, CASE WHEN flat = 'L' AND lo <> hi AND n <= 4 AND other = 0 THEN '1' ELSE flat END AS reduced,
  CASE WHEN lo = 255 THEN 'drop' WHEN n <= 4 AND other = 0 THEN 'stencil' ELSE 'replace' END AS mask_action
FROM f
"""


# -- streams ------------------------------------------------------------------------------------------------------------------


def streams_encoded_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a stream with a dictionary of two entries; equal ones are measured once, and all get the result."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    entries = F.create_map(F.lit("/Filter"), F.col("lang"), F.lit("/ColorSpace"), F.col("source"), F.lit("/Name"), F.col("doc_id").cast("string"))
    docs = docs.withColumn("key", encode_once.content_key(F.encode("text", "UTF-8"), entries))

    def measure(distinct: DataFrame) -> DataFrame:
        return distinct.select("key", F.octet_length("text").alias("bytes"), F.size(F.split("text", " ")).alias("pieces"))

    return encode_once.encode_once(docs.select("doc_id", "key", "text"), "key", measure, ["text"]).select("doc_id", "key", "bytes", "pieces")


ENCODED_SQL = """
SELECT doc_id, sha256(unhex(sha256(text)) || encode(
    chr(0) || chr(31) || chr(0) || chr(31) || lang || chr(31) || chr(0) || chr(31) || source || chr(31) || chr(0) || chr(31) || chr(0) || chr(31) || chr(0) || chr(31) || chr(0))) AS key,
  octet_length(encode(text))::INTEGER AS bytes, len(string_split(text, ' '))::INTEGER AS pieces
FROM documents
"""


def streams_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each text, taken as a stream of its source's file, merges into: the first with the same digest."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("num"), "text", "lang")
    entries = F.create_map(F.lit("/Lang"), F.col("lang"), F.lit("/Length"), F.octet_length("text").cast("string"), F.lit("/A"), F.lit("1"))
    hashed = docs.select("path", "num", graph.digest(entries, F.encode("text", "UTF-8")).alias("hashed"))
    first = graph.canonical(hashed, ["path"], "num", "hashed")
    return hashed.join(first, ["path", "hashed"]).select("path", "num", "canonical", "copies", (F.col("num") != F.col("canonical")).alias("merged"))


MERGED_SQL = """
SELECT source AS path, doc_id AS num, min(doc_id) OVER (PARTITION BY source, lang, text) AS canonical,
  count(*) OVER (PARTITION BY source, lang, text) AS copies, doc_id <> min(doc_id) OVER (PARTITION BY source, lang, text) AS merged
FROM documents
"""


def dictionaries_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties with page entries by event type, without the keys that a run discards."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "map<string,string>").alias("props"))
    page = F.create_map(F.lit("/Thumb"), F.lit("1"), F.lit("/Contents"), F.col("event_type"), F.lit("/Metadata"), F.lit("2"), F.lit("/StructParents"), F.lit("3"))
    entries = F.map_concat(F.coalesce("props", F.create_map().cast("map<string,string>")), page)
    kept = graph.without_keys(entries, graph.pruned_keys(RemovalOptions(remove_thumbnails=False), "page"))
    return rows.select("event_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("keys"), F.element_at("props", "k").alias("k"), F.size(kept).alias("n"))


PRUNED_SQL = """
SELECT event_id, '/Contents,/Thumb,k' AS keys, json_extract_string(props, '$.k') AS k, 3 AS n FROM events
"""


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders refer to customers, customers to nations, nations to regions: (path, src, key, dst), nodes numbered apart."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 4).alias("src"), (F.col("o_custkey") * 4 + 1).alias("dst"))
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 4 + 1).alias("src"), (F.col("c_nationkey") * 4 + 2).cast("long").alias("dst"))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 4 + 2).cast("long").alias("src"), (F.col("n_regionkey") * 4 + 3).cast("long").alias("dst"))
    return o.unionByName(c).unionByName(n).select(F.lit("tpch").alias("path"), "src", F.lit("/K").alias("key"), "dst")


def graph_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All objects that urgent orders lead to."""
    urgent = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    roots = urgent.select(F.lit("tpch").alias("path"), (F.col("o_orderkey") * 4).alias("num"))
    return graph.reachable(refs(spark, sf_dir), roots, checkpoint=lambda df: written(df, "reach")).select("num")


REACHABLE_SQL = """
WITH o AS (SELECT DISTINCT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'),
c AS (SELECT DISTINCT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)),
n AS (SELECT DISTINCT n_nationkey, n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c))
SELECT o_orderkey * 4 AS num FROM o UNION SELECT o_custkey * 4 + 1 FROM o UNION SELECT c_nationkey::BIGINT * 4 + 2 FROM c UNION SELECT n_regionkey::BIGINT * 4 + 3 FROM n
"""


def candidates_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as candidate encodings of an order, in their filter's rank; the smallest, where it beats the original."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.floor("l_extendedprice").cast("long").alias("size"), (F.col("l_partkey") % 3).cast("int").alias("rank"), F.col("l_suppkey").alias("tag")
    )
    rows = rows.groupBy("l_orderkey", "size", "rank").agg(F.min("tag").alias("tag"))
    best = encode_once.smallest_candidate(rows, ["l_orderkey"])
    names = F.array(*[F.lit(f) for f in encode_once.FILTERS])
    before = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.floor(F.col("o_totalprice") / 4).cast("long").alias("before_bytes"))
    joined = best.join(before, "l_orderkey").select("l_orderkey", F.col("size").alias("after_bytes"), F.get(names, F.col("rank")).alias("filter"), "tag", "before_bytes")
    return encode_once.accepted(joined)


SMALLEST_SQL = """
WITH c AS (SELECT l_orderkey, floor(l_extendedprice)::BIGINT AS size, (l_partkey % 3)::INTEGER AS rank, min(l_suppkey) AS tag FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY size, rank) AS place FROM c)
SELECT l_orderkey, size AS after_bytes, CASE rank WHEN 0 THEN '/FlateDecode' WHEN 1 THEN '/DCTDecode' ELSE '/JPXDecode' END AS filter, tag, floor(o_totalprice / 4)::BIGINT AS before_bytes
FROM r JOIN orders ON o_orderkey = l_orderkey WHERE place = 1 AND size < floor(o_totalprice / 4)
"""


# -- reports ------------------------------------------------------------------------------------------------------------------


def timing_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.phase_shares(table(spark, sf_dir, "events"), "event_type", "value")


TIMING_SQL = """
WITH s AS (SELECT event_type AS phase, sum(value) AS seconds FROM events GROUP BY event_type)
SELECT phase, round_even(seconds, 6) AS seconds,
  round_even(CASE WHEN sum(seconds) OVER () = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * seconds / sum(seconds) OVER () END, 6) AS share FROM s
"""


def size_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("before"), (F.col("o_custkey") % 100 * 1000).alias("after"))
    saved = F.when(F.col("before") == 0, F.lit(0.0)).otherwise(1.0 - F.col("after") / F.col("before"))
    return rows.select("o_orderkey", report.guarded_ratio(F.col("before"), F.col("after")).alias("ratio"), saved.alias("saved_fraction"))


RATIO_SQL = """
WITH r AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS before, o_custkey % 100 * 1000 AS after FROM orders)
SELECT o_orderkey, CASE WHEN after = 0 THEN 0.0::DOUBLE ELSE before::DOUBLE / after END AS ratio,
  CASE WHEN before = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - after::DOUBLE / before END AS saved_fraction FROM r
"""


def benchmark_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as benchmark rows: sizes, fidelities (some missing), seconds and errors."""
    k, p = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("deck-"), k.cast("string")).alias("deck"),
        F.when(k % 2 == 0, "0.6").otherwise("0.8").alias("quality"),
        (k % 40).cast("int").alias("pages"),
        (p * 10).alias("raw_bytes"),
        F.when(k % 17 == 0, 0).otherwise(p).cast("long").alias("their_bytes"),
        F.when(k % 13 == 0, 0).otherwise(p + (F.col("o_custkey") % 1000 - 600) * 20).cast("long").alias("our_bytes"),
        F.when(k % 7 != 0, (30 + k % 30).cast("double") + 0.25).alias("their_psnr"),
        F.when(k % 5 != 0, (30 + F.col("o_custkey") % 40).cast("double") + 0.5).alias("our_psnr"),
        (k % 300).cast("double").alias("seconds"),
        F.when(k % 11 == 0, "failed").alias("error"),
    )


RUNS_SQL = """runs AS (
  SELECT 'deck-' || o_orderkey::VARCHAR AS deck, CASE WHEN o_orderkey % 2 = 0 THEN '0.6' ELSE '0.8' END AS quality, (o_orderkey % 40)::INTEGER AS pages,
    floor(o_totalprice)::BIGINT * 10 AS raw_bytes, CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE floor(o_totalprice)::BIGINT END AS their_bytes,
    CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE floor(o_totalprice)::BIGINT + (o_custkey % 1000 - 600) * 20 END AS our_bytes,
    CASE WHEN o_orderkey % 7 <> 0 THEN (30 + o_orderkey % 30)::DOUBLE + 0.25::DOUBLE END AS their_psnr,
    CASE WHEN o_orderkey % 5 <> 0 THEN (30 + o_custkey % 40)::DOUBLE + 0.5::DOUBLE END AS our_psnr,
    (o_orderkey % 300)::DOUBLE AS seconds, CASE WHEN o_orderkey % 11 = 0 THEN 'failed' END AS error
  FROM orders),
deltas AS (SELECT *, CASE WHEN their_bytes = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * (our_bytes::DOUBLE / their_bytes - 1.0::DOUBLE) END AS size_delta_pct,
  our_psnr - their_psnr AS psnr_delta FROM runs)"""


def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_quality(benchmark_runs(spark, sf_dir))


SUMMARY_SQL = f"""
WITH {RUNS_SQL},
fine AS (SELECT * FROM deltas WHERE error IS NULL AND our_bytes > 0),
s AS (SELECT quality, count(*) AS decks, sum(raw_bytes)::BIGINT AS raw_bytes, sum(their_bytes)::BIGINT AS their_bytes, sum(our_bytes)::BIGINT AS our_bytes,
  round_even(median(size_delta_pct), 6) AS median_delta, round_even(min(size_delta_pct), 6) AS best_delta, round_even(max(size_delta_pct), 6) AS worst_delta,
  count(*) FILTER (WHERE size_delta_pct < 0) AS smaller, round_even(median(psnr_delta), 6) AS median_psnr_delta, count(psnr_delta) AS compared,
  count(*) FILTER (WHERE psnr_delta > 0) AS better, round_even(sum(seconds), 6) AS seconds, round_even(avg(seconds), 6) AS seconds_per_deck FROM fine GROUP BY quality)
SELECT *, round_even(raw_bytes::DOUBLE / their_bytes, 6) AS their_ratio, round_even(raw_bytes::DOUBLE / our_bytes, 6) AS our_ratio,
  round_even(100.0::DOUBLE * (our_bytes::DOUBLE / their_bytes - 1.0::DOUBLE), 6) AS total_delta FROM s
"""


def benchmark_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.csv_rows(benchmark_runs(spark, sf_dir))


CSV_SQL = f"""
WITH {RUNS_SQL}
SELECT deck, quality, pages::VARCHAR AS pages, raw_bytes::VARCHAR AS raw_bytes, their_bytes::VARCHAR AS their_bytes, our_bytes::VARCHAR AS our_bytes,
  format('{{:.2f}}', size_delta_pct) AS size_delta_pct, coalesce(format('{{:.3f}}', their_psnr), '') AS their_psnr, coalesce(format('{{:.3f}}', our_psnr), '') AS our_psnr,
  coalesce(format('{{:.3f}}', psnr_delta), '') AS psnr_delta, format('{{:.2f}}', seconds) AS seconds, coalesce(error, '') AS error
FROM deltas
"""


def benchmark_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that went wrong, in the report's order."""
    return report.running_order(benchmark_runs(spark, sf_dir).filter("error IS NOT NULL"), ["deck"]).select("quality", "deck", "position", "error")


FAILURES_SQL = f"""
WITH {RUNS_SQL}
SELECT quality, deck, row_number() OVER (PARTITION BY quality ORDER BY deck)::INTEGER AS position, error FROM runs WHERE error IS NOT NULL
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names as files of a benchmark corpus, with three endings and others, some missing."""
    k = F.col("c_custkey")
    ending = F.when(k % 5 == 0, "uncompressed.pdf").when(k % 5 == 1, "new.pdf").when(k % 5 == 2, "new-0.8.pdf").when(k % 5 == 3, "old.pdf").otherwise("uncompressed.pdf")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("case "), F.floor(k / 7).cast("string"), F.lit("."), ending).alias("file"))


FILES_SQL = """files AS (
  SELECT 'case ' || (c_custkey // 7)::VARCHAR || '.' || CASE c_custkey % 5 WHEN 0 THEN 'uncompressed.pdf' WHEN 1 THEN 'new.pdf' WHEN 2 THEN 'new-0.8.pdf' WHEN 3 THEN 'old.pdf' ELSE 'uncompressed.pdf' END AS file
  FROM customer),
known AS (SELECT file, CASE WHEN ends_with(file, '.uncompressed.pdf') THEN 'raw' WHEN ends_with(file, '.new-0.8.pdf') THEN '0.8' WHEN ends_with(file, '.new.pdf') THEN '0.6' END AS kind,
  CASE WHEN ends_with(file, '.uncompressed.pdf') THEN left(file, length(file) - 17) WHEN ends_with(file, '.new-0.8.pdf') THEN left(file, length(file) - 12) ELSE left(file, length(file) - 8) END AS deck FROM files),
found AS (SELECT deck, max(CASE WHEN kind = 'raw' THEN file END) AS raw, max(CASE WHEN kind = '0.6' THEN file END) AS q0_6, max(CASE WHEN kind = '0.8' THEN file END) AS q0_8
  FROM known WHERE kind IS NOT NULL GROUP BY deck)"""


def benchmark_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.runs(report.cases(files(spark, sf_dir), "file"))


CASES_SQL = f"""
WITH {FILES_SQL}
SELECT deck, '0.6' AS quality, raw, q0_6 AS reference FROM found WHERE raw IS NOT NULL AND q0_6 IS NOT NULL
UNION ALL SELECT deck, '0.8', raw, q0_8 FROM found WHERE raw IS NOT NULL AND q0_8 IS NOT NULL
"""


def benchmark_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty smallest runs: a top-k report."""
    return report.smallest(benchmark_runs(spark, sf_dir).select("deck", "raw_bytes"), "raw_bytes", "deck", 20)


SMALLEST_RUNS_SQL = f"WITH {RUNS_SQL} SELECT deck, raw_bytes FROM runs ORDER BY raw_bytes, deck LIMIT 20"


def benchmark_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sampled_pages(benchmark_runs(spark, sf_dir).select("deck", "pages"), "pages", 6)


PAGES_SQL = f"""
WITH {RUNS_SQL},
few AS (SELECT deck, pages, i::INTEGER AS page FROM runs, unnest(range(1, 7)) AS t(i) WHERE pages > 0 AND pages <= 6 AND i <= pages),
many AS (SELECT DISTINCT deck, pages, greatest(1, least(pages, round_even(pages::DOUBLE / 7 * i, 0)::INTEGER)) AS page FROM runs, unnest(range(1, 7)) AS t(i) WHERE pages > 6)
SELECT * FROM few UNION ALL SELECT * FROM many
"""


QUERIES = {
    "planner_plan": planner_plan,
    "planner_minimal": planner_minimal,
    "geometry_boxes": geometry_boxes,
    "restoring_matrices": restoring_matrices,
    "picture_psnr": picture_psnr,
    "page_fidelity": page_fidelity,
    "picture_coverage": picture_coverage,
    "picture_classes": picture_classes,
    "streams_encoded_once": streams_encoded_once,
    "streams_merged": streams_merged,
    "dictionaries_pruned": dictionaries_pruned,
    "graph_reachable": graph_reachable,
    "candidates_smallest": candidates_smallest,
    "timing_shares": timing_shares,
    "size_ratios": size_ratios,
    "benchmark_summary": benchmark_summary,
    "benchmark_csv": benchmark_csv,
    "benchmark_failures": benchmark_failures,
    "benchmark_cases": benchmark_cases,
    "benchmark_smallest": benchmark_smallest,
    "benchmark_pages": benchmark_pages,
}

SQL = {
    "planner_plan": _plan_sql(True, 150.0, 1.4),
    "planner_minimal": _plan_sql(False, 130.0, 1.4),
    "geometry_boxes": GEOMETRY_SQL,
    "restoring_matrices": RESTORING_SQL,
    "picture_psnr": PSNR_SQL,
    "page_fidelity": FIDELITY_SQL,
    "picture_coverage": COVERAGE_SQL,
    "picture_classes": CLASSES_SQL,
    "streams_encoded_once": ENCODED_SQL,
    "streams_merged": MERGED_SQL,
    "dictionaries_pruned": PRUNED_SQL,
    "graph_reachable": REACHABLE_SQL,
    "candidates_smallest": SMALLEST_SQL,
    "timing_shares": TIMING_SQL,
    "size_ratios": RATIO_SQL,
    "benchmark_summary": SUMMARY_SQL,
    "benchmark_csv": CSV_SQL,
    "benchmark_failures": FAILURES_SQL,
    "benchmark_cases": CASES_SQL,
    "benchmark_smallest": SMALLEST_RUNS_SQL,
    "benchmark_pages": PAGES_SQL,
}
