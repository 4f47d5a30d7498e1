"""Every registered query that has SQL gives the SQL's rows; the others run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]


def rows(frame):
    def plain(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    columns = sorted(frame.columns)
    return sorted(repr([plain(v) for v in r]) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf).toPandas()
    assert len(got) > 0
    sql = entry.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and os.path.isdir(entry.SMOKE_DIR)


def test_csv_sink(spark, sf, tmp_path):
    from foliospark.operators import report
    from foliospark.plans.relational import benchmark_runs

    report.write_csv(benchmark_runs(spark, sf), str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == report.CSV_COLUMNS and back.count() == benchmark_runs(spark, sf).count()
