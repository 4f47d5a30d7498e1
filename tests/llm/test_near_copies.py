import random

import numpy as np
import pytest

import corpus_pipeline as p
from foliospark.llm import simhash


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(texts):
    """The smallest row of each component of rows that share 0.8 of their shingles."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in p.drop_near_copies(spark, df, "").collect())


def test_repeated_lines_and_short_texts(spark):
    rng = random.Random(1)
    body = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (204, 204, 64, 64, 8)]
    line = " ".join(f"l{i}" for i in range(10))
    texts = [body[0], body[0] + f" {line}" * 6, body[1], body[1] + f" {line}" * 20]  # near copies, for the line counts once
    texts += [body[2] + f" {line}" * 20, body[3] + f" {line}" * 20]  # not alike but for the line
    texts += [body[4], body[4] + " more"]  # four of five shingles
    want = brute(texts)
    got = kept(spark, texts)
    assert want[:4] == [0, 0, 2, 2] and want[4:] == [4, 5, 6, 6]
    assert got == sorted(set(want))


@pytest.mark.parametrize("rows", [256, 7])
def test_exact_links_of_large_groups(spark, monkeypatch, rows):
    """Groups around the similarity itself, in one block and in many."""
    monkeypatch.setattr(simhash, "SET_ROWS", rows)
    rng = random.Random(2)
    texts = []
    for edits in (1, 2, 3, 4):
        base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(30):
            copy = list(base)
            for at in rng.sample(range(120), edits):
                copy[at] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    want = brute(texts)
    assert 20 < len(set(want)) < 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    loose = spark.createDataFrame([(i, 0) for i in range(len(texts))], "node long, component long")
    found = simhash.components(simhash.confirmed(df.withColumnRenamed("doc_id", "node"), loose, 5, 0.8))
    label = {r.node: r.component for r in found.collect()}
    assert [label.get(i, i) for i in range(len(texts))] == want


def test_similar_without_rows():
    a, b = simhash.similar(np.zeros(0, np.int64), np.zeros(3, np.int64), 0.8)
    assert not len(a) and not len(b)


def test_similar_equals_brute_force():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 400, 30) for _ in range(6)]
    sets = []
    for _ in range(200):
        x = base[rng.integers(6)].copy()
        at = rng.integers(0, 30, rng.integers(0, 9))
        x[at] = rng.integers(0, 400, len(at))
        sets.append(np.unique(x[: rng.integers(20, 31)]))
    a, b = simhash.similar(np.concatenate(sets), np.array([len(x) for x in sets]), 0.8)
    forest = simhash.Forest(len(sets))
    forest.link(a, b)
    label = list(range(len(sets)))
    links = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                links += 1
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    assert links > 100 and len(set(label)) > 10
    assert forest.label.tolist() == label


def test_different_texts_under_one_id(spark):
    """Both are documents; neither takes the other along, and the links of one are not the other's."""
    rng = random.Random(4)
    a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(2))
    rows = [(1, a), (1, b), (1, b), (2, b + " x"), (3, a + " y"), (None, a), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc_id or 0, r.text) for r in p.drop_near_copies(spark, df, "").collect()))
    assert out == sorted([(0, a), (0, a), (1, a), (1, b)])
