import hashlib
import re
import struct

import xxhash
from foliospark.llm import syncmers


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(values):
    """XXH64 of several 64-bit values, each the seed of the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def plain_anchors(text):
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if x]
    h = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in w]
    if not h:
        return []
    inner = [chain(h[i : i + 2]) for i in range(len(h) - 1)]
    found = []
    for i in range(len(h) - 4):
        s = inner[i : i + 4]
        if min(s) in (s[0], s[3]):
            found.append((i, chain(h[i : i + 5])))
    return found or [(0, chain(h))]


def plain_like(a, b):
    """Shared hashes by their first places; a pair counts beside a neighbour in the same order, or alone."""

    def places(found):
        out = {}
        for p, h in found:
            out.setdefault(h % 2**32, p)
        return out

    a, b = places(a), places(b)
    pairs = sorted((a[h], b[h]) for h in a if h in b)
    near = [(k > 0 and pairs[k - 1][1] < y) or (k + 1 < len(pairs) and y < pairs[k + 1][1]) for k, (_, y) in enumerate(pairs)]
    n = 1 if len(pairs) == 1 else sum(near)
    return n / (len(a) + len(b) - n) if a or b else 1.0


def as_text(found):
    steps = [p - q for (p, _), (q, _) in zip(found, [(0, 0), *found])]
    assert all(0 <= s <= syncmers.KMER - syncmers.INNER for s in steps)
    return "".join(f"{s:x}{h % 2**32:08x}" for s, (_, h) in zip(steps, found))


def plain(rows):
    """Results of distinct (doc_id, text) rows whose ids are distinct, by descending id."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        s, e, n = plain_anchors(t), plain_anchors(edited), plain_anchors(following)
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), as_text(s), as_text(e), plain_like(s, e), plain_like(s, n))
    return out


def write(spark, rows, path, schema="doc_id long, text string, lang string, tag string"):
    spark.createDataFrame([(*r, "en", "x") for r in rows], schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_query_equals_brute_force(spark, sf, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "one two"), (10**6 + 3, "é 🙂 a b c d E f"), (10**6 + 4, "é 🙂 a b c d E f"), (-5, "\n x ")]
    got = syncmers.op4_syncmers(spark, write(spark, rows, tmp_path)).collect()
    want = plain(rows)
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(rows)


def test_repeated_null_and_single_rows(spark, tmp_path):
    got = syncmers.op4_syncmers(spark, write(spark, [(1, "a b c"), (1, "a b c"), (None, "n u l l"), (2, "z")], tmp_path / "a")).collect()
    assert len(got) == 4 and len({tuple(r) for r in got if r.doc_id == 1}) == 1
    alone = syncmers.op4_syncmers(spark, write(spark, [(7, "a b c d e f")], tmp_path / "b")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    empty = syncmers.op4_syncmers(spark, write(spark, [], tmp_path / "c"))
    assert empty.count() == 0


def test_anchors_move_with_a_passage(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(passage,), ("some other words first " + passage,)], "text string")
    a, b = ({x & syncmers.LOW: x >> 32 for x in r.found} for r in syncmers.with_anchors(df, "text", "found").select("found").collect())
    assert len(a) > 15 and all(b[h] == p + 4 for h, p in a.items())


def test_matching_is_by_position(spark):
    """A passage that moved, words put in, words in another order, and words that share nothing."""
    w = [f"w{i}" for i in range(400)]
    texts = {
        "same": w,
        "put in": w[:200] + ["new", "words"] + w[200:],
        "moved": ["other"] * 7 + w,
        "halves": w[200:] + w[:200],
        "blocks": [x for k in range(0, 400, 8) for x in w[392 - k : 400 - k]],
        "none": [f"x{i}" for i in range(400)],
    }
    df = spark.createDataFrame([(k, " ".join(w), " ".join(t)) for k, t in texts.items()], "k string, a string, b string")
    df = syncmers.with_anchors(syncmers.with_anchors(df, "a", "fa"), "b", "fb")
    got = {r.k: r.like for r in df.withColumn("like", syncmers.likeness(df["fa"], df["fb"])).collect()}
    assert got["same"] == 1 and got["none"] == 0
    assert got["put in"] > 0.95 and got["moved"] > 0.95 and got["halves"] > 0.9
    shared = {r.k: len({x & syncmers.LOW for x in r.fa} & {x & syncmers.LOW for x in r.fb}) for r in df.collect()}
    for k, t in texts.items():
        assert got[k] == plain_like(plain_anchors(" ".join(w)), plain_anchors(" ".join(t)))
    assert shared["blocks"] > 50


def test_long_texts_keep_all_their_anchors(spark):
    """A passage of 100 words in texts of 10,000 is found by its anchors."""
    a, b = ([f"{c}{i}" for i in range(10_000)] for c in "ab")
    b[5000:5100] = a[100:200]
    df = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string")
    df = syncmers.with_anchors(syncmers.with_anchors(df, "a", "fa"), "b", "fb")
    row = df.withColumn("like", syncmers.likeness(df["fa"], df["fb"])).first()
    assert len(row.fa) > 4500 and 0.003 < row.like < 0.007
