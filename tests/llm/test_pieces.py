import hashlib
import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import common, pieces

with open(pieces.DEFAULT_MODEL, "rb") as f:
    MODEL = f.read()
MADE = pieces.lattices(MODEL, 0.3)
VOCABULARY = {x: i for i, x in enumerate(MADE.bytes_of) if x and i not in set(MADE.byte_id.tolist())}


def edges(raw: bytes):
    """(start, end, piece) of the lattice of a text with its dummy space, by definition."""
    found, covered, at = [], set(), 0
    for i in range(len(raw)):
        for j in range(i + 1, min(len(raw), i + MADE.longest) + 1):
            if raw[i:j] in VOCABULARY:
                found.append((i, j, VOCABULARY[raw[i:j]]))
    text = raw.decode()
    for c in text:
        size = len(c.encode())
        if c.encode() in VOCABULARY:
            covered |= set(range(at, at + size))
        at += size
    return found + [(i, i + 1, int(MADE.byte_id[raw[i]])) for i in range(len(raw)) if i not in covered]


def plain_sample(text: str, key: int) -> list[int]:
    """Forward filtering and backward sampling over the whole text's lattice, step by step."""
    if not text:
        return []
    raw = b" " + text.encode()
    into = {}
    for i, j, p in edges(raw):
        into.setdefault(j, []).append((i, p))
    ahead = [0.0] * (len(raw) + 1)
    ahead[0] = 1.0
    for j in range(1, len(raw) + 1):
        ahead[j] = sum(ahead[i] * MADE.weight[p] for i, p in into.get(j, []))
    out, j = [], len(raw)
    while j:
        mask = (1 << 64) - 1
        x = (key + j * int(pieces.GOLDEN)) & mask
        x = int(common.mix64(np.array([x], np.uint64))[0])
        u, run = (x >> 11) * 2.0**-53, 0.0
        choice = sorted(into[j])  # the longest first
        for i, p in choice:
            run += ahead[i] * MADE.weight[p] / ahead[j]
            if u < run or (i, p) == choice[-1]:
                break
        out.append(p)
        j = i
    return out[::-1]


def sample(texts, keys):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, place = MADE.sample(data, offsets, np.array(keys, np.uint64))
    return [ids[a:b].tolist() for a, b in zip(place[:-1], place[1:])], MADE.decode(ids, place)


TEXTS = ["", " ", "  two  spaces ", "the cat sat on the mat", "été à Köln 梦 ң", "a\nb\n\n c\t", "x ▁y▁▁", "\x00\x7f🙂🙂", "the the the", "word" * 50]


def test_equals_plain_sampling():
    keys = list(range(100, 100 + len(TEXTS)))
    got, _ = sample(TEXTS, keys)
    assert got == [plain_sample(t, k) for t, k in zip(TEXTS, keys)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=6))
def test_lossless(texts):
    ids, (data, cuts) = sample(texts, range(len(texts)))
    assert [data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])] == [t.encode() for t in texts]


def test_paths_come_up_by_their_weight():
    raw = b" then"
    paths = {}

    def walk(at, path, weight):
        if at == len(raw):
            paths[tuple(path)] = weight
        for i, j, p in EDGES:
            if i == at:
                walk(j, [*path, p], weight * MADE.weight[p])

    EDGES = edges(raw)
    walk(0, [], 1.0)
    total = sum(paths.values())
    n = 20000
    got, _ = sample(["then"] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919))
    seen = {}
    for g in got:
        seen[tuple(g)] = seen.get(tuple(g), 0) + 1
    assert set(seen) <= set(paths)
    for path, weight in paths.items():
        p = weight / total
        assert abs(seen.get(path, 0) - n * p) < 6 * math.sqrt(n * p * (1 - p)) + 1


def test_long_word_does_not_underflow():
    text = "ab1" * 3000
    got, (data, _) = sample([text], [3])
    assert data.tobytes() == text.encode() and all(i >= 0 for i in got[0])


def test_operator(spark):
    rows = [(1, "Hello  world\n é ▁x", "a"), (1, "Hello  world\n é ▁x", "b"), (None, "y", "c"), (3, None, "d"), (4, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    out = pieces.sample_encode(df).orderBy("n_tokens").collect()
    assert [r.n_tokens for r in out] == list("abcde")
    assert out[0].pieces == out[1].pieces and all(r.pieces.lossless for r in out)
    assert out[3].pieces.token_ids == [] and out[3].pieces.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    back = pieces.decode(pieces.sample_encode(df).select("text", "pieces.token_ids")).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    again = pieces.sample_encode(df.coalesce(1)).orderBy("n_tokens").collect()
    assert again == out
    assert pieces.sample_encode(df, seed=8).filter(F.col("n_tokens") == "a").first().pieces != out[0].pieces
    assert pieces.sample_encode(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1, 50, 1 << 20])
def test_slices_do_not_matter(limit):
    raw = [t.encode() for t in TEXTS]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data, keys = np.frombuffer(b"".join(raw), np.uint8), np.arange(len(raw), dtype=np.uint64)
    whole = MADE.sample(data, offsets, keys)[0]
    parts = [MADE.sample(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], keys[i:j])[0] for i, j in common.slices(offsets, limit)]
    assert np.array_equal(whole, np.concatenate(parts))


def dense(n, seed):
    """Text without spaces whose pieces overlap at most places."""
    rng = np.random.default_rng(seed)
    return "".join(rng.choice(["a", "t", "g", "c", "at", "the", "ing", "été", "梦"], n))


@pytest.mark.parametrize(("long", "run"), [(8, 1 << 20), (30, 200), (8, 97)])
def test_blocks_equal_the_plain_way(monkeypatch, long, run):
    texts = [dense(n, n) for n in (9, 40, 300, 1500)] + ["ab1" * 400, "=" * 500, "x " + dense(90, 1) + " y"] + TEXTS
    keys = list(range(len(texts)))
    want, _ = sample(texts, keys)
    monkeypatch.setattr(pieces, "LONG_WORD", long)
    monkeypatch.setattr(pieces, "RUN", run)
    got, (data, cuts) = sample(texts, keys)
    assert got == want and [data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])] == [t.encode() for t in texts]
    assert got[:3] == [plain_sample(t, k) for t, k in zip(texts[:3], keys[:3])]


def test_text_without_spaces_takes_time_in_proportion():
    rng = np.random.default_rng(1)
    chinese = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 350_000)))
    for text in (chinese, dense(700_000, 2), "a" * 1_000_000):
        begun = time.process_time()
        _, (data, _) = sample([text], [5])
        assert data.tobytes() == text.encode() and time.process_time() - begun < 20  # 2 to 5 s here


def test_operator_keeps_columns_of_its_names(spark):
    df = spark.createDataFrame([(1, "a b", "kept", "too")], "doc_id long, text string, pieces string, decoded string")
    out = pieces.sample_encode(df)
    assert out.columns == [*df.columns, "_pieces"] and out.first().pieces == "kept"
    back = pieces.decode(out.select("decoded", "_pieces.token_ids")).first()
    assert (back.decoded, back._decoded) == ("too", "a b")
