"""Numbers as text in reports: C's rounding, not Java's."""

import math

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foliospark.operators import report

TIES = [0.125, 0.375, 3.125, 0.5, 2.5, 0.0625, 0.1875, 12.0625, 2.0**49 + 0.0625, 2.0**50 + 0.125]
NEAR = [0.045, 0.285, 1.005, 0.0005, 0.0015, 0.995, 0.9995, 0.9999, 99.995, 1e6 + 0.005, 2.0**51 + 0.25]
WIDE = [0.0, 5e-324, 1e-9, 2.0**53, 2.0**62, 2.0**63 + 2**12, 9.2e20, 1e300, math.inf]


def test_fixed_as_c_prints(spark):
    values = [s * v for v in TIES + NEAR + WIDE for s in (1.0, -1.0)]
    values += [math.nextafter(v, to) for v in TIES + NEAR for to in (-math.inf, math.inf)] + [math.nan]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 2, 3):
        got = frame.select("x", report.fixed(F.col("x"), digits).alias("text")).collect()
        assert [r.text for r in got] == [f"{r.x:.{digits}f}" for r in got]
    assert spark.sql("SELECT CAST(null AS double) AS x").select(report.fixed(F.col("x"), 2)).first()[0] is None


def test_csv_rounds_ties_as_its_sql(spark, tmp_path):
    # 20 * (o_custkey % 1000 - 600) in percent of o_totalprice, at keys that leave both sizes in place
    orders = [(k, 1, p) for k, p in enumerate([383360.0, 347200.0, 95840.0, 11980.0, 19168.0, 1497.5, 12345.67], 18)]
    orders += [(64, 44, 355840.0), (66, 44, 4480.0), (67, 56, 348160.0), (71, 593, 4480.0), (72, 607, 4480.0)]
    path = str(tmp_path / "orders.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double").coalesce(1).write.parquet(path)
    got = entry.queries()["benchmark_csv"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = con.execute(entry.oracle_sql()["benchmark_csv"])
    names = [c[0] for c in want.description]
    assert got.columns == names
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(want.fetchall())
    assert "-3.12" in {r[names.index("size_delta_pct")] for r in rows}
