import math

import numpy as np
import pytest

from foliospark import tables
from foliospark.operators import fidelity, graph
from foliospark.sources import documents


def raster(w, h, value):
    return {"width": w, "height": h, "data": bytes([value]) * (w * h * 3)}


def test_page_psnr():
    assert fidelity.page_psnr(raster(4, 3, 10), raster(4, 3, 10)) == 99
    assert math.isclose(fidelity.page_psnr(raster(4, 3, 10), raster(4, 3, 15)), 10 * math.log10(65025 / 25))
    assert math.isclose(fidelity.page_psnr(raster(8, 6, 10), raster(4, 3, 15)), 10 * math.log10(65025 / 25))  # brought to the base's size
    assert fidelity.page_psnr(None, raster(1, 1, 0)) is None and fidelity.page_psnr(raster(0, 0, 0), raster(0, 0, 0)) is None
    assert fidelity.page_psnr({"width": 2, "height": 2, "data": b"abc"}, raster(2, 2, 0)) is None


def test_means_over_pages_that_both_have(spark):
    schema = f"deck string, page int, raster {fidelity.RASTER}"
    table = lambda rows: spark.createDataFrame([(d, p, tuple(r.values()) if r else None) for d, p, r in rows], schema)
    raw = table([("a", 1, raster(2, 2, 0)), ("a", 2, raster(2, 2, 0)), ("a", 3, raster(2, 2, 0)), ("b", 1, raster(2, 2, 0))])
    theirs = table([("a", 1, raster(2, 2, 5)), ("a", 3, raster(2, 2, 0)), ("a", 9, raster(2, 2, 9)), ("b", 1, None)])
    ours = table([("a", 2, raster(1, 1, 5))])
    got = {r.deck: (r.their_psnr, r.our_psnr) for r in fidelity.compared_pages(raw, theirs, ours, ["deck"]).collect()}
    one = 10 * math.log10(65025 / 25)
    assert np.allclose(got["a"], [(one + 99) / 2, one]) and got["b"] == (None, None)


def test_benchmark_rows_and_errors(spark):
    runs = spark.createDataFrame([(d, "0.6", f"{d}.pdf", f"{d}.new.pdf") for d in "abcd"], "deck string, quality string, raw string, reference string")
    files = spark.createDataFrame([(f"{d}{e}.pdf", n) for d in "abcd" for e, n in (("", 1000), (".new", 400))], "path string, length long")
    results = spark.createDataFrame([("a.pdf", "0.6", 300, 1.5, None), ("b.pdf", "0.6", 0, 0.1, "ValueError: no"), ("d.pdf", "0.6", 200, 2.0, None)], "path string, quality string, after_bytes long, seconds double, error string")
    pages = spark.createDataFrame([("a.pdf", 3), ("b.pdf", 0)], "path string, pages long")
    compared = spark.createDataFrame([("a", "0.6", 30.0, 40.0, None), ("b", "0.6", 1.0, 1.0, None), ("d", "0.6", None, None, "OSError: x")], "deck string, quality string, their_psnr double, our_psnr double, error string")
    got = {r.deck: tuple(r)[1:] for r in fidelity.benchmark_rows(runs, files, results, pages, compared).collect()}
    assert got["a"] == ("0.6", 3, 1000, 400, 300, 30.0, 40.0, 1.5, None)
    assert got["b"] == ("0.6", 0, 1000, 400, 0, None, None, 0.0, "ValueError: no")
    assert got["c"] == ("0.6", 0, 1000, 400, 0, None, None, 0.0, "not run")
    assert got["d"] == ("0.6", 0, 1000, 400, 200, None, None, 2.0, "render: OSError: x")
    assert fidelity.benchmark_rows(runs, files, results, pages).filter("our_psnr IS NULL").count() == 4


def test_page_counts(spark):
    files = spark.createDataFrame([("broken.pdf", bytearray(b"no document"))], "path string, content binary")
    assert [tuple(r) for r in documents.page_counts(files).collect()] == [("broken.pdf", 0)]


def test_long_chains_are_followed_to_their_end(spark):
    n = 70
    edges = spark.createDataFrame([("p", i, i + 1) for i in range(n)] + [("q", 1, 2)], "path string, src int, dst int").coalesce(1)
    roots = spark.createDataFrame([("p", 0)], "path string, num int")
    found = graph.reachable(edges, roots, checkpoint=lambda df: tables.written(df.coalesce(1), "reach"))
    assert sorted(r.num for r in found.collect()) == list(range(n + 1))


def test_shared_folder_is_required_on_a_cluster():
    class Session:
        class conf:
            @staticmethod
            def get(name, default):
                return default

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_folder(Session())
