import corpus_pipeline as p
from foliospark.llm import common, mixing, quality, secret_scan, simhash
from pyspark.sql import functions as F


def jaccard(a, b):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    a, b = shingles(a), shingles(b)
    return len(a & b) / max(1, len(a | b))


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = common.table(spark, sf, "documents")
    kept = common.materialise(p.keep_quality(spark, docs, sf), "q")
    scores = {r.doc_id: r.score for r in quality.op5_quality(spark, sf).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.7} and kept.columns == docs.columns

    single = common.materialise(p.drop_near_copies(spark, kept, sf), "n")
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in (kept, single))
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(kept, shingle=5, words=p.WORDS, radius=simhash.radius_for(0.8, 64 * p.WORDS), candidates="anchors").collect()}
    assert set(after) == {i for i in before if found[i] == i}
    texts = {}
    for i in sorted(before):
        texts.setdefault(before[i], i)
    assert all(texts[t] == i or found[i] <= texts[t] for i, t in before.items())
    left = sorted(after)
    assert not [(a, b) for a in left for b in left if a < b and abs(len(after[a]) - len(after[b])) < 0.2 * len(after[a]) and after[a][:20] == after[b][:20] and jaccard(after[a], after[b]) > 0.9]
    for i, c in found.items():  # each one that goes has a kin that is close
        if c != i:
            assert max(jaccard(before[i], before[j]) for j in found if found[j] == c and j != i) >= 0.8

    clean = common.materialise(p.redact_secrets(spark, single, sf), "s")
    rows = {r.doc_id: r for r in clean.collect()}
    assert set(rows) == set(after) and clean.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in rows.values())
    again = secret_scan.scan(clean.select("doc_id", "text"), keep=["doc_id"])
    assert again.filter(F.size("base") > 0).count() == 0

    mixed = common.materialise(p.mix_sources(spark, clean, sf), "m")
    want = {r.doc_id for r in mixing.mix(clean.select("doc_id", "text", "source", "lang"), keep=["doc_id"]).filter("mixing.sampled").collect()}
    assert {r.doc_id for r in mixed.collect()} == want and mixed.columns == docs.columns

    last = p.encode(spark, mixed, sf).collect()
    assert {r.doc_id for r in last} == want and all(r.lossless and r.n_tokens == len(r.token_ids) for r in last)
    assert sorted(r.doc_id for r in p.run(spark, sf).collect()) == sorted(want)


def test_edges(spark, tmp_path):
    rows = [(1, "a b c", "en", "src0", 3, "x"), (1, "a b c", "en", "src0", 3, "x"), (None, None, None, None, None, "x"), (2, "", "fr", "odd", 0, "x"), (3, "password=abcdefgh12", "en", "src1", 19, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = df
    for name, stage in p.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == df.columns
        if name == "secrets":
            assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == [(0, None), (1, "a b c"), (2, ""), (3, "[REDACTED]")]
    p.encode(spark, docs, str(tmp_path)).collect()
    for _, stage in p.STAGES:
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
