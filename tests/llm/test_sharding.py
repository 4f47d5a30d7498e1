import zlib
from collections import defaultdict

from foliospark.llm import sharding


def check(rows, got, shards=24):
    sizes = [len((t or "").encode()) + 8 for _, t in rows]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (i is None, i or 0, s, zlib.crc32((t or "").encode())) for (i, t), s in zip(rows, sizes)
    )
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert 0 <= r.shard < shards
    total, most = sum(sizes), max(sizes)
    for k in range(shards):
        assert sorted(r.slot for r in by[k]) == list(range(len(by[k])))
        assert abs(sum(r.size for r in by[k]) - total / shards) <= 2 * most
    groups = defaultdict(list)
    for (i, t), s in zip(rows, sizes):
        groups[t or ""].append(s)
    home = defaultdict(set)
    for r in got:
        home[r.size, r.text_crc32].add(r.shard)
    for t, s in groups.items():
        if sum(s) <= most:
            assert len(home[s[0], zlib.crc32(t.encode())]) == 1


def test_tables(spark, sf, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6 + i, "a copy of many é") for i in range(300)] + [(None, None), (None, None), (5, ""), (5, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int").repartition(3)
    check(rows, sharding.shard_by_bytes(df).collect())
    same = [(1, "x" * 50)] * 500
    check(same, sharding.shard_by_bytes(spark.createDataFrame(same, "doc_id long, text string")).collect())
    few = [(1, "abc"), (2, None)]
    got = sharding.shard_by_bytes(spark.createDataFrame(few, "doc_id long, text string")).collect()
    assert sorted(r.slot for r in got) == [0, 0] and len({r.shard for r in got}) == 2
    assert sharding.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf):
    out = sharding.op8_sharding(spark, sf)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, out.collect())


def test_groups_on_both_sides_of_the_grain(spark):
    """Copies within the largest row's size stay together; of more copies each grain does."""
    rows = [(i, "L" * 992) for i in range(1)] + [(10 + i, "s" * 92) for i in range(10)] + [(100 + i, "m" * 92) for i in range(55)] + [(1000 + i, f"{i:092d}") for i in range(200)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    check(rows, got)
    homes = {c: [r.shard for r in got if r.text_crc32 == zlib.crc32((c * 92).encode())] for c in "sm"}
    assert len(set(homes["s"])) == 1 and len(homes["s"]) == 10
    counts = sorted(homes["m"].count(k) for k in set(homes["m"]))
    assert len(counts) > 1 and all(n % 10 == 0 for n in counts[1:]) and sum(counts) == 55
