import zlib

import numpy as np

from foliospark.llm import quality


def buffer(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_features_do_not_depend_on_slices_or_windows(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ["", " ", "a", "!! !!", "B B B b"]
    data, offsets = buffer(texts)
    whole = quality.text_features(data, offsets)
    assert whole.shape == (len(texts), len(quality.NAMES)) and np.isfinite(whole).all()
    assert np.array_equal(whole, quality.text_features(data, offsets, limit=3000))
    assert np.allclose(whole, quality.text_features(data, offsets, limit=300, long=500))


def test_model_learns_shapes_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((np.abs(x[:, 0] - 0.5) < 0.25) ^ ((x[:, 1] > 0.5) & (x[:, 2] > 0.5))).astype(int)
    model = quality.fit(x, y)
    z = rng.random((2000, 4))
    want = (np.abs(z[:, 0] - 0.5) < 0.25) ^ ((z[:, 1] > 0.5) & (z[:, 2] > 0.5))
    assert (1, 2) in model.pairs and ((model.score(z) > 0.5) == want).mean() > 0.9
    order = rng.permutation(len(x))
    assert np.array_equal(model.score(z), quality.fit(x[order], y[order]).score(z))


def test_too_few_labels():
    x = np.zeros((4, 2))
    assert quality.fit(x, np.ones(4, int)).score(x)[0] == 5 / 6
    assert quality.fit(x[:0], np.zeros(0, int)).score(x)[0] == 0.5


def area(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = quality.op5_quality(spark, d).toPandas()
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    assert got["held_out"].equals(got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2))
    both = got.merge(labels, on="doc_id")
    held = both[both["held_out"]]
    assert area(held["score"].to_numpy(), held["quality"].to_numpy()) > 0.97
    assert held[held["quality"] == 1]["predicted"].mean() > 0.97
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.7)).all()


def test_edges_and_held_out_labels_are_not_read(spark):
    texts = [(i, ("good words in a row %d" % i) if i % 2 else "BAD!! BAD!! BAD!!", "x") for i in range(300)]
    docs = spark.createDataFrame([*texts, (None, None, "x"), (1000, "", "x"), (1000, "", "x")], "doc_id long, text string, score string")
    labels = [(i, i % 2) for i in range(300)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels]
    made = [quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, flipped)]
    x = quality.text_features(*buffer(["good words in a row 7", "BAD!! BAD!! BAD!!"]))
    assert np.array_equal(made[0].score(x), made[1].score(x)) and made[0].score(x)[0] > 0.7 > made[0].score(x)[1]
    out = quality.score_texts(docs, made[0], out="q")
    assert out.count() == 303 and out.filter("q IS NULL").count() == 0 and "score" in out.columns
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert not none.fitted


def plain_features(text):
    """The features of one text, character by character and word by word."""
    raw = text.encode()
    white = b" \t\n\x0b\x0c\r"
    words, now = [], b""
    for c in raw + b" ":
        if c in white:
            words += [now] if now else []
            now = b""
        else:
            now += bytes([c])
    upper, lower, digit = (sum(a <= c <= b for c in raw) for a, b in ((65, 90), (97, 122), (48, 57)))
    high, breaks, blanks = sum(c > 127 for c in raw), raw.count(b"\n") + raw.count(b"\r"), raw.count(b" ") + raw.count(b"\t")
    stop = b".,;:'\"?()-"
    stops = sum(c in stop for c in raw)
    control = sum((c < 32 and c not in b"\t\n\r") or c == 127 for c in raw)
    symbols = len(raw) - upper - lower - digit - high - breaks - blanks - stops - control

    def is_symbol(c):
        return 32 < c < 127 and c not in stop and not chr(c).isalnum()

    letters, solid, n = max(upper + lower + high, 1), max(len(raw) - blanks - breaks, 1), max(len(words), 1)
    counts = {w: words.count(w) for w in words}
    marked = [sum(is_symbol(c) for c in w) for w in words]
    left = [len(w) - m - sum(c in stop for c in w) for w, m in zip(words, marked)]
    return [
        np.log1p(len(raw)), np.log1p(len(words)), upper / letters, digit / solid, stops / solid, symbols / solid, high / solid, breaks / n, control / solid,
        sum(map(len, words)) / n, sum(len(w) > 12 for w in words) / n, sum(len(w) <= 3 for w in words) / n,
        sum(sum(65 <= c <= 90 for c in w) >= 2 and not any(97 <= c <= 122 for c in w) for w in words) / n,
        sum(m > 0 and s > 0 for m, s in zip(marked, left)) / n, sum(s == 0 for s in left) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, len(counts) / n, max(counts.values(), default=0) / n, np.log1p(len(words) / (breaks + 1)),
    ]


def test_features_equal_brute_force(spark, sf):
    texts = ["", " ", "a", "!! !!", "B B B b", "É\x7f\x01 #é WORD12 x#y\r\n--- \tABC", "a\x0bb a b a"]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect() if r.text and len(r.text) < 4000]
    assert np.allclose(quality.text_features(*buffer(texts)), [plain_features(t) for t in texts], atol=1e-12)


def test_one_boosting_round_by_hand(monkeypatch):
    """One round over one feature of two values, of one pair: Newton steps of the weighted log loss."""
    monkeypatch.setattr(quality, "ROUNDS", 1)
    monkeypatch.setattr(quality, "PAIR_ROUNDS", 0)
    x = np.array([[0.0, 0.0]] * 60 + [[1.0, 0.0]] * 40)
    y = np.array([1] * 50 + [0] * 10 + [1] * 5 + [0] * 35)
    model = quality.fit(x, y, 3.0)
    prior = 56 / 102
    base = np.log(prior / (1 - prior))
    want = []
    for ones, zeros in ((50, 10), (5, 35)):
        g = 3 * ones * (prior - 1) + zeros * prior
        h = (3 * ones + zeros) * prior * (1 - prior)
        want.append(base - quality.RATE * g / (h + quality.RIDGE))
    assert np.allclose(model.raw(np.array([[0.0, 0.0], [1.0, 0.0]])), want)


def test_rows_bound_rows(spark):
    docs = spark.createDataFrame([(i % 8, f"text {i % 16}") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    assert quality.training_rows(docs, labels, rows=5).count() == 5
    usable = [i for i in range(8) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert quality.training_rows(docs, labels).count() == 2 * len(usable)


def test_weight_comes_from_the_rows():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = (x[:, 0] + rng.normal(0, 0.3, 2000) > 0.4).astype(int)
    w = quality.good_weight(x, y)
    assert w in quality.GOOD_WEIGHTS and w == quality.good_weight(x[::-1], y[::-1])
    assert quality.good_weight(x[:4], np.ones(4, int)) == quality.GOOD_WEIGHTS[0]
