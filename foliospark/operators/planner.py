"""The image planner: from all placements of an image, its crop and its size, by one grouped aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import geometry as g
from foliospark.profiles import Profile, Web

#: A crop that leaves this share of both axes isn't worth rewriting its placements.
WHOLE = 0.999
LEAST_PIXELS = 2
POINTS = 72.0


def plan_images(placements: DataFrame, key: list[str], profile: Profile | None = None, order: list[str] | None = None) -> DataFrame:
    """One row per image: key, planned, crop_* (null: none), out_w, out_h, u0, v0, u1, v1 (null: whole).

    `placements` has the key, `ctm` (matrix), `clip` (box, null: unbounded), `px_w`, `px_h`, one row per drawn occurrence.
    `planned` is false for images to be left alone: less than two pixels wide or high, before or after the crop.
    """
    profile = profile or Web()
    # Every step is a set of plain columns: nested structs would be inlined into each other and grow beyond what compiles.
    seen = placements.select(*key, *(order or []), "px_w", "px_h", *g.fields("ctm", g.MATRIX), *g.fields("clip", g.BOX), F.col("clip").isNull().alias("open"))
    m, clip = g.matrix(*g.columns("ctm", g.MATRIX)), g.box(*g.columns("clip", g.BOX))
    seen = seen.select("*", g.is_aligned(m).alias("aligned"), *g.fields(g.footprint(m), g.BOX, "foot"))
    foot = g.box(*g.columns("foot", g.BOX))
    cut = g.fields(g.intersection(foot, clip), g.BOX, "vis")
    whole = g.columns("foot", g.BOX)
    seen = seen.select("*", *[F.when(F.col("open"), w).otherwise(c).alias(f"vis_{n}") for n, w, c in zip(g.BOX, whole, cut, strict=True)])
    foot_x0, foot_y0, foot_x1, foot_y1 = g.columns("foot", g.BOX)
    vis_x0, vis_y0, vis_x1, vis_y1 = g.columns("vis", g.BOX)
    seen = seen.select("*", (foot_x1 - foot_x0).alias("wide"), (foot_y1 - foot_y0).alias("high"))
    wide, high = F.col("wide"), F.col("high")
    seen = seen.withColumn("shown", F.col("aligned") & (vis_x1 > vis_x0) & (vis_y1 > vis_y0) & (wide > 0) & (high > 0))
    spans = {"left": (vis_x0 - foot_x0) / wide, "right": (vis_x1 - foot_x0) / wide, "low": (vis_y0 - foot_y0) / high, "top": (vis_y1 - foot_y0) / high}
    seen = seen.select("*", *[F.when(F.col("shown"), c).alias(n) for n, c in spans.items()])
    mirrored, flipped = m["a"] < 0, m["d"] < 0
    parts = {
        "u0": F.when(mirrored, 1 - F.col("right")).otherwise(F.col("left")),
        "u1": F.when(mirrored, 1 - F.col("left")).otherwise(F.col("right")),
        "v0": F.when(flipped, 1 - F.col("top")).otherwise(F.col("low")),
        "v1": F.when(flipped, 1 - F.col("low")).otherwise(F.col("top")),
    }
    seen = seen.select("*", *[c.alias(n) for n, c in parts.items()])
    along, up = F.hypot(m["a"], m["b"]), F.hypot(m["c"], m["d"])
    # One long for both sides, which hash aggregation can hold; a struct would sort all placements.
    size = F.shiftleft(F.col("px_w").cast("long"), 32).bitwiseOR(F.col("px_h").cast("long"))
    first = F.min_by(size, F.struct(*order)) if order else F.min(size)
    images = seen.groupBy(*key).agg(
        first.alias("px"),
        F.bool_or(~F.col("aligned")).alias("turned"),
        F.min("u0").alias("u0"),
        F.min("v0").alias("v0"),
        F.max("u1").alias("u1"),
        F.max("v1").alias("v1"),
        F.min(F.when(along > 0, along)).alias("along"),  # the smallest use has the highest resolution
        F.min(F.when(up > 0, up)).alias("up"),
    )
    images = images.withColumn("px_w", F.shiftright("px", 32).cast("int")).withColumn("px_h", F.col("px").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    cut = F.lit(profile.crop_to_visible) & ~F.col("turned") & F.col("u0").isNotNull()
    for n, edge in (("u0", F.greatest), ("v0", F.greatest), ("u1", F.least), ("v1", F.least)):
        images = images.withColumn(n, F.when(cut, edge(F.lit(0.0 if n[1] == "0" else 1.0), F.col(n))))
    whole = (F.col("u1") - F.col("u0") >= WHOLE) & (F.col("v1") - F.col("v0") >= WHOLE)
    images = images.withColumn("cropped", F.coalesce(~whole, F.lit(False)))
    w, h = F.col("px_w"), F.col("px_h")
    crop = {
        "crop_left": F.greatest(F.lit(0), F.floor(F.col("u0") * w)),
        "crop_top": F.greatest(F.lit(0), F.floor((1.0 - F.col("v1")) * h)),
        "crop_right": F.least(w, F.ceil(F.col("u1") * w)),
        "crop_bottom": F.least(h, F.ceil((1.0 - F.col("v0")) * h)),
    }
    images = images.select("*", *[F.when(F.col("cropped"), c).cast("int").alias(n) for n, c in crop.items()])
    snapped = {
        "u0": F.col("crop_left") / w,
        "v0": 1.0 - F.col("crop_bottom") / h,
        "u1": F.col("crop_right") / w,
        "v1": 1.0 - F.col("crop_top") / h,
    }
    kept = [c for c in images.columns if c not in snapped]
    images = images.select(*kept, *[F.when(F.col("cropped"), c).alias(n) for n, c in snapped.items()])
    images = images.withColumn("cw", F.coalesce(F.col("crop_right") - F.col("crop_left"), w)).withColumn("ch", F.coalesce(F.col("crop_bottom") - F.col("crop_top"), h))
    for n, length, pixels, span in (("dpi_x", "along", "cw", F.col("u1") - F.col("u0")), ("dpi_y", "up", "ch", F.col("v1") - F.col("v0"))):
        points = F.when(F.col("cropped"), F.col(length) * span).otherwise(F.col(length))
        images = images.withColumn(n, F.coalesce(F.when(points > 0, F.col(pixels) / (points / POINTS)), F.lit(0.0)))

    def reduced(pixels: str, dpi: str):
        if not profile.resolution_dpi:
            return F.col(pixels)
        smaller = F.greatest(F.lit(1), F.bround(F.col(pixels) * F.lit(profile.resolution_dpi) / F.col(dpi)).cast("int"))
        return F.when(F.col(dpi) > profile.threshold_dpi, smaller).otherwise(F.col(pixels))

    planned = (w >= LEAST_PIXELS) & (h >= LEAST_PIXELS) & (F.col("cw") >= LEAST_PIXELS) & (F.col("ch") >= LEAST_PIXELS)
    columns = [*crop, "u0", "v0", "u1", "v1"]
    return images.select(
        *key,
        planned.alias("planned"),
        *[F.when(planned, F.col(c)).alias(c) for c in columns],
        F.when(planned, reduced("cw", "dpi_x")).cast("int").alias("out_w"),
        F.when(planned, reduced("ch", "dpi_y")).cast("int").alias("out_h"),
    )
