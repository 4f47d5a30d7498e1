import glob
import gzip
import hashlib
import random
import zlib

import pytest

from foliospark.llm import warc


def write(spark, rows, path):
    spark.createDataFrame(rows, "page_id long, url string, html string, first string").repartition(3).write.parquet(f"{path}/pages.parquet")
    return str(path)


def plain(rows):
    out = []
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        same = [j for j, _, h, _ in rows if (h or "").encode() == raw and j is not None]
        first = max(same) if len(raw) >= 1000 and same else i
        again = i is not None and first != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


BIG = "<p>é</p>" * 200
ROWS = [(1, "http://a/1", BIG, "x"), (2, None, BIG, "x"), (3, "http://a b/3\n", "small", "x"), (4, "u", "small", "x"), (5, "u", None, "x"), (6, "u", "", "x"),
        (7, "u", "a" * 1000, "x"), (8, "u", "a" * 1000, "x"), (8, "u", "a" * 1000, "x"), (9, "u", "b" * 999, "x"), (10, "u", "b" * 999, "x"), (None, "u", BIG, "x")]


def test_round_trip_equals_brute_force(spark, tmp_path):
    got = warc.op7_warc(spark, write(spark, ROWS, tmp_path / "a"))
    assert sorted(map(tuple, got.collect()), key=str) == plain(ROWS)
    assert warc.op7_warc(spark, write(spark, [], tmp_path / "b")).count() == 0


def test_ranges_and_payloads(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abcdef <>\n") for _ in range(rng.randrange(4000))), "x") for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, first string").repartition(2)
    path = str(tmp_path / "w")
    warc.write_warc(df, path)
    for f in glob.glob(f"{path}/part-*"):  # plain gzip readers accept the archives
        assert gzip.open(f).read().startswith(b"WARC/1.1")
    for size in (500, 3001, 1 << 20):
        got = warc.read_warc(spark, path, with_payload=True, files=size).collect()
        assert sorted((r.page_id, r.payload.decode()) for r in got) == [(i, h) for i, _, h, _ in rows]


def chance_member(content: bytes) -> bytes:
    """A member that holds the magic inside: a stored block of it."""
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


@pytest.mark.parametrize("size", [300, 900, 5000])
def test_chance_magic_in_foreign_archives(spark, tmp_path, size):
    rng = random.Random(size)
    rows, raw = [], b""
    for i in range(40):
        body = "".join(rng.choice("xyz\x1f") for _ in range(rng.randrange(800))).encode()
        if i % 3 == 0:
            body = body[: len(body) // 2] + warc.MAGIC + body[len(body) // 2 :] + warc.MAGIC
        rows.append((i, hashlib.sha1(body).hexdigest()))
        raw += chance_member(warc.record(i, "u", body, rows[-1][1], None))
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "foreign.warc").write_bytes(raw)
    got = warc.read_warc(spark, str(tmp_path / "f"), files=size).collect()
    assert sorted((r.page_id, r.payload_digest) for r in got) == rows


def test_long_members_and_files_that_are_no_archives(spark, tmp_path):
    rng = random.Random(5)
    body = b"".join(rng.randbytes(700) + warc.MAGIC for _ in range(60))  # a member over many ranges
    raw = b"".join(chance_member(warc.record(i, "u", b, hashlib.sha1(b).hexdigest(), None)) for i, b in enumerate((b"a", body, b"c")))
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.warc").write_bytes(raw)
    (tmp_path / "f" / "b.warc").write_bytes(raw + rng.randbytes(3000) + warc.MAGIC + rng.randbytes(9000))  # and no member at its end
    (tmp_path / "f" / "c.warc").write_bytes(b"".join(rng.randbytes(400) + warc.MAGIC for _ in range(50)))
    for size in (1000, 9000):
        got = warc.read_warc(spark, str(tmp_path / "f"), with_payload=True, files=size).collect()
        assert sorted((r.page_id, r.payload) for r in got) == [(i, b) for i, b in enumerate((b"a", body, b"c")) for _ in range(2)]


def test_members_spare_the_magic():
    for n in range(50):
        content = random.Random(n).randbytes(2000) + warc.MAGIC
        packed = warc.member(content)
        assert gzip.decompress(packed) == content and packed.find(warc.MAGIC, 1) < 0
    stored = warc.member(warc.MAGIC * 3, 6)
    assert gzip.decompress(stored) == warc.MAGIC * 3
    big = b"\0" * (16 << 20)
    row = warc.sink_row(warc.member(big)) + b"\0"
    assert gzip.decompress(row) == big
