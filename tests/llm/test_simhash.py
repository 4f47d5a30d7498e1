import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import simhash
from foliospark.llm.components import components


def plain_fingerprint(text, size=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, links):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def labels(forest):
    return forest.label.tolist()


@pytest.mark.parametrize(("words", "radius", "n"), [(1, 0, 90), (1, 3, 200), (1, 1, 65), (2, 24, 130), (4, 51, 150)])
def test_bit_slices_equal_brute_force(words, radius, n):
    rng = np.random.default_rng(words * 100 + radius)
    base = rng.integers(0, 2**64, (max(3, n // 8), words), dtype=np.uint64)
    fps = base[rng.integers(0, len(base), n)].copy()
    for i in range(n):
        for b in rng.choice(64 * words, rng.integers(0, radius + 2), replace=False):
            fps[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    ends = np.array([min(n, (i // 37 + 1) * 37) for i in range(n)])  # groups of 37 rows

    def distance(i, j):
        return sum(int(a ^ b).bit_count() for a, b in zip(fps[i].tolist(), fps[j].tolist()))

    links = [(i, j) for i in range(n) for j in range(i + 1, ends[i]) if distance(i, j) <= radius]
    want = plain_components(range(n), links)
    assert labels(simhash.link_groups(fps, ends, radius)) == [want[i] for i in range(n)]
    half = n // 2
    links = [(i, j) for i in range(half) for j in range(half, n) if distance(i, j) <= radius]
    want = plain_components(range(n), links)
    assert labels(simhash.link_blocks(fps[:half], fps[half:], radius)) == [want[i] for i in range(n)]


def test_block_keys_meet(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 3):
            y ^= 1 << b
        rows.append((i, x - (1 << 64) if x >> 63 else x, y - (1 << 64) if y >> 63 else y))
    df = spark.createDataFrame(rows, "i long, x long, y long")
    met = df.filter(F.arrays_overlap(simhash.block_keys(F.col("x")), simhash.block_keys(F.col("y"))))
    assert met.count() == 300


def near_texts(seed, n=160):
    """Texts with short ones, copies and slight edits, in random order."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "  \t", "one", "One", "one two", "ONE TWO", "one two three", "à É à", "à é à"]
    while len(texts) < n:
        base = [rng.choice(words) for _ in range(rng.choice([4, 30, 300, 900]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append("  ".join(copy) if rng.random() < 0.5 else "\n".join(copy))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [4, 4096])
def test_equals_brute_force(spark, block):
    texts = near_texts(1)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "again"), (None, texts[5], "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = simhash.near_duplicates(df, block=block).collect()
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    links = [(i, j) for i in fps for j in fps if i < j and (fps[i] ^ fps[j]).bit_count() <= 3]
    want = plain_components(fps, links)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.fp[0] % 2**64 == fps[5]
        else:
            assert (r.fp[0] % 2**64, r.component_id) == (fps[r.doc_id], want[r.doc_id])


def test_frequent_key_is_cut_into_blocks(spark):
    """Many fingerprints with common bits: every key's rows lie in several tasks and blocks."""
    rng = np.random.default_rng(9)
    fps = np.unique(np.bitwise_and(rng.integers(0, 2**64, 3000, dtype=np.uint64), np.uint64(0xFFF0000000)))[:700]
    rows = [(i, [int(f)]) for i, f in enumerate(fps.tolist())]
    keyed = spark.createDataFrame([(1, i, f) for i, f in rows], "key long, node long, fp array<long>").repartition(4)
    order = ["key", "fp", "node"]
    made = keyed.repartitionByRange(4, *order).sortWithinPartitions(*order).mapInArrow(simhash._compare(1, 3, 64), simhash._OUT).cache()
    blocks = made.filter("rows IS NOT NULL").select("key", "block", "rows")
    other = blocks.select("key", F.col("block").alias("block2"), F.col("rows").alias("rows2"))
    cross = blocks.join(other, "key").filter("block < block2").select("rows", "rows2").mapInArrow(simhash._cross(1, 3), simhash._OUT)
    found = components(made.filter("a IS NOT NULL").select("a", "b").union(cross.select("a", "b")))
    got = {r.node: r.component for r in found.collect()}
    x = fps.tolist()
    want = plain_components(range(len(x)), [(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if (x[i] ^ x[j]).bit_count() <= 3])
    assert [got.get(i, i) for i in range(len(x))] == [want[i] for i in range(len(x))]
    assert made.filter("a IS NOT NULL").count() <= len(x)


def test_anchors_find_near_texts(spark):
    rng = random.Random(2)
    base = [[f"v{rng.randrange(5000)}" for _ in range(200)] for _ in range(30)]
    rows = []
    for i, b in enumerate(base):
        copy = list(b)
        for at in rng.sample(range(200), 3):  # 15 of 196 shingles: similarity about 0.86
            copy[at] = f"new{rng.random()}"
        rows += [(2 * i, " ".join(b)), (2 * i + 1, " ".join(copy))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df, shingle=5, words=4, radius=simhash.radius_for(0.8, 256), candidates="anchors").collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got)


def test_components_of_a_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(chain).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(chain.limit(0)).count() == 0


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
