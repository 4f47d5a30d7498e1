import math

import pytest

from foliospark.functions import geometry as g
from foliospark.operators.planner import plan_images
from foliospark.profiles import MinimalFileSize, Profile, Web
from pyspark.sql import functions as F

SCHEMA = "k int, seq int, ctm struct<a:double,b:double,c:double,d:double,e:double,f:double>, clip struct<x0:double,y0:double,x1:double,y1:double>, px_w int, px_h int"


def plan(spark, rows, profile=None):
    """rows: (matrix, clip or None, (w, h)) of one image."""
    df = spark.createDataFrame([(1, i, m, c, *px) for i, (m, c, px) in enumerate(rows)], SCHEMA)
    return plan_images(df, ["k"], profile, order=["seq"]).first()


def flat(w, h):
    return (float(w), 0.0, 0.0, float(h), 0.0, 0.0)


PX = (800, 450)


def test_sizes(spark):
    r = plan(spark, [(flat(720, 405), None, PX)])
    assert (r.out_w, r.out_h, r.crop_left, r.u0) == (800, 450, None, None)
    assert plan(spark, [(flat(180, 101.25), None, PX)]).out_w == 375
    r = plan(spark, [(flat(72, 200), None, (400, 100))])
    assert r.out_h == 100 and r.out_w == 150  # each axis by itself
    assert plan(spark, [(flat(72, 40), None, PX)], Profile(resolution_dpi=None)).out_w == 800
    small = plan(spark, [(flat(72, 40.5), None, PX)])
    both = plan(spark, [(flat(72, 40.5), None, PX), (flat(720, 405), None, PX)])
    assert (both.out_w, both.out_h) == (small.out_w, small.out_h)
    assert plan(spark, [(flat(180, 101.25), None, PX)], MinimalFileSize()).out_w == round(800 * 130 / 320)


def test_crops(spark):
    r = plan(spark, [(flat(720, 405), (0.0, 0.0, 360.0, 405.0), PX)])
    assert (r.crop_left, r.crop_top, r.crop_right, r.crop_bottom) == (0, 0, 400, 450) and (r.u0, r.v0, r.u1, r.v1) == (0, 0, 0.5, 1)
    mirrored = plan(spark, [((-720.0, 0.0, 0.0, -405.0, 720.0, 405.0), (0.0, 0.0, 360.0, 405.0), PX)])
    assert (mirrored.crop_left, mirrored.crop_right) == (400, 800)
    turned = plan(spark, [((0.0, 300.0, -300.0, 0.0, 0.0, 0.0), (0.0, 0.0, 50.0, 50.0), PX)])
    assert turned.planned and turned.crop_left is None
    mixed = plan(spark, [(flat(720, 405), (0.0, 0.0, 360.0, 405.0), PX), ((0.0, 300.0, -300.0, 0.0, 0.0, 0.0), None, PX)])
    assert mixed.crop_left is None
    assert plan(spark, [(flat(720, 405), (0.0, 0.0, 360.0, 405.0), PX)], Profile(crop_to_visible=False)).crop_left is None
    union = plan(spark, [(flat(720, 405), (0.0, 0.0, 90.0, 405.0), PX), (flat(720, 405), (180.0, 0.0, 360.0, 405.0), PX)])
    assert (union.crop_left, union.crop_right) == (0, 400)
    top = plan(spark, [(flat(720, 405), (0.0, 202.5, 720.0, 405.0), PX)])
    assert (top.crop_top, top.crop_bottom) == (0, 225)


def test_images_left_alone(spark):
    assert not plan(spark, [(flat(720, 405), None, (1, 1))]).planned
    sliver = plan(spark, [(flat(720, 405), (0.0, 0.0, 0.5, 405.0), PX)])
    assert not sliver.planned and sliver.out_w is None
    hidden = plan(spark, [(flat(180, 101.25), (0.0, 0.0, 0.0, 0.0), PX)])
    assert hidden.planned and hidden.crop_left is None and hidden.out_w == 375
    assert plan_images(spark.createDataFrame([], SCHEMA), ["k"]).count() == 0
    flat_line = plan(spark, [((0.0, 0.0, 0.0, 0.0, 5.0, 5.0), None, PX)])
    assert (flat_line.out_w, flat_line.out_h) == PX


def test_boxes(spark):
    def value(c):
        return spark.range(1).select(c.alias("v")).first().v

    none = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    a, b = g.box(0, 0, 2, 2), g.box(1, 1, 3, 3)
    assert tuple(value(g.intersection(a, b))) == (1, 1, 2, 2) and tuple(value(g.hull(a, b))) == (0, 0, 3, 3)
    assert tuple(value(g.intersection(a, none))) == (0, 0, 2, 2) and value(g.intersection(none, none)) is None
    assert tuple(value(g.intersection(a, g.box(2, 0, 3, 1)))) == (0, 0, 0, 0) and value(g.hull(none, none)) is None
    half = math.sqrt(0.5)
    turn = g.matrix(half, half, -half, half, 0, 0)
    assert value(g.is_aligned(g.matrix(1, 0, 0, -1, 5, 5))) and not value(g.is_aligned(turn))
    assert value(g.footprint(turn)).y1 == pytest.approx(2 * half)


def test_profiles():
    assert Web().threshold_dpi == 210.0 and MinimalFileSize().removal.remove_output_intents and Profile(resolution_dpi=None).threshold_dpi == 0
    for bad in ({"compression_quality": 1.1}, {"resolution_dpi": 0.0}):
        with pytest.raises(ValueError):
            Profile(**bad)
