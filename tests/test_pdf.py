import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark import api, pipeline
from foliospark.operators import graph
from foliospark.pdf import build, content, contexts, edit, jpeg, pixels
from foliospark.pdf.model import Damaged, Document, Name, Parser, Ref, Stream, serialise
from foliospark.profiles import MinimalFileSize, Profile, RemovalOptions, Web
from foliospark.sources import documents as source


def one_page(samples, m=(720, 0, 0, 405, 0, 0), clip=None, mask=None):
    d = build.empty()
    image = d.add(build.image_stream(samples, d.add(build.image_stream(mask)) if mask is not None else None))
    build.add_page(d, [(image, m, clip)])
    return d


def run(spark, document, profile=None, path="a.pdf"):
    body = document.save(compact=False)
    r = pipeline.optimize(spark.createDataFrame([(path, bytearray(body))], "path string, content binary"), profile).first()
    assert r.error is None, r.error
    return r, Document.load(bytes(r.output))


def test_values_survive_writing():
    text = b"<< /A#20b [1 -2.5 .5 (a\\)\\\\(x)\\101) <4142> true null 3 0 R] /D << /E /F >> >>"
    v = Parser(text).value()
    assert v == {"/A b": [1, -2.5, 0.5, b"a)\\(x)A", b"AB", True, None, Ref(3, 0)], "/D": {"/E": "/F"}}
    assert Parser(serialise(v)).value() == v


@pytest.mark.parametrize("compact", [True, False])
def test_documents_survive_writing(compact):
    d = one_page(build.gradient(40, 30), mask=np.full((30, 40), 7, np.uint8))
    again = Document.load(d.save(compact))
    assert len(again.pages()) == 1 and len(content.drawings(again)) == 1
    twice = Document.load(again.save(not compact))
    image = twice.get(content.drawings(twice)[0].ref)
    assert twice.decoded(image) == build.gradient(40, 30).tobytes()


def test_damaged_files_are_scanned_or_refused():
    body = one_page(build.gradient(20, 20)).save(compact=False)
    broken = body[: body.rfind(b"xref\n0")] + b"startxref\n7\n%%EOF"
    assert len(content.drawings(Document.load(broken))) == 1
    with pytest.raises(Damaged):
        Document.load(b"no document")


def test_predictors_and_filters():
    rows = np.arange(60, dtype=np.uint8).reshape(5, 12)
    for kind in range(5):
        coded = b""
        above = np.zeros(12, np.int64)
        for r in rows.astype(np.int64):
            left = np.concatenate([[0, 0, 0], r[:-3]])
            corner = np.concatenate([[0, 0, 0], above[:-3]])
            best = left + above - corner
            near = np.array([min((a, b, c), key=lambda v: abs(p - v)) for a, b, c, p in zip(left, above, corner, best)])
            guess = [0, left, above, (left + above) // 2, near][kind]
            coded += bytes([kind]) + ((r - guess) % 256).astype(np.uint8).tobytes()
            above = r
        s = Stream({"/Filter": Name("/FlateDecode"), "/DecodeParms": {"/Predictor": 15, "/Colors": 3, "/Columns": 4}}, zlib.compress(coded))
        assert Document({}, {}).decoded(s) == rows.tobytes()
    s = Stream({"/Filter": [Name("/ASCIIHexDecode"), Name("/RunLengthDecode")]}, b"02 61 62 63 FE 7A 80>")
    assert Document({}, {}).decoded(s) == b"abczzz"


def test_graphics_state():
    d = build.empty()
    image = d.add(build.image_stream(build.gradient(10, 10)))
    form = d.add(Stream({"/Subtype": Name("/Form"), "/BBox": [0, 0, 50, 50], "/Matrix": [2, 0, 0, 2, 0, 0], "/Resources": {"/XObject": {"/I": image}}}, b"q 10 0 0 10 0 0 cm /I Do Q Q /I Do"))
    build.add_page(d, [(image, (100, 0, 0, 100, 5, 5), (0, 0, 50, 400)), (form, (1, 0, 0, 1, 100, 0), None)], b"q 3 0 0 3 0 0 cm Q 0 0 20 20 re W n\n")
    got = content.drawings(d)
    assert [x.ctm for x in got] == [(100, 0, 0, 100, 5, 5), (20, 0, 0, 20, 100, 0), (2, 0, 0, 2, 100, 0)]
    assert got[0].clip == (0, 0, 20, 20) and got[1].clip == (0, 0, 0, 0)


def test_inline_images_are_kept():
    ops = list(content.operators(b"q BI /W 1 ID \x01\x02 EI Q"))
    assert [o for _, o in ops] == ["q", "BI", "Q"]
    assert b"ID \x01\x02 EI" in content.written(ops)


@pytest.mark.parametrize("shape", [(33, 50), (16, 16, 3), (45, 61, 3), (8, 9)])
@pytest.mark.parametrize("quality", [40, 75, 95])
def test_jpeg_round_trip(shape, quality):
    rng = np.random.default_rng(1)
    y, x = np.mgrid[: shape[0], : shape[1]]
    image = 120 + 80 * np.sin(x / 9) * np.cos(y / 7)
    image = np.stack([image, image[::-1], 255 - image], -1) if len(shape) == 3 else image
    image = np.clip(image + rng.normal(0, 6, image.shape), 0, 255).astype(np.uint8)
    scan = jpeg.Scan(image, quality >= jpeg.FULL_CHROMA)
    data = scan.encode(quality)
    back = jpeg.decode(data)
    assert np.array_equal(back, scan.pixels(quality))
    assert np.array_equal(jpeg.decode(scan.encode(quality, progressive=True)), back)
    assert pixels.psnr(image, back) > (24 if quality == 40 else 27)


def test_progressive_jpeg_of_a_flat_picture_ends_runs_of_blocks():
    scan = jpeg.Scan(np.full((1600, 1480), 9, np.uint8), True)  # 37,000 blocks, more than one symbol can end
    data = scan.encode(80, progressive=True)
    assert len(data) < 6000 and np.array_equal(jpeg.decode(data), scan.pixels(80))


def by_another(spark, folder):
    row = spark.read.format("image").load(str(folder)).select("image.*").first()
    samples = np.frombuffer(bytes(row.data), np.uint8).reshape(row.height, row.width, row.nChannels)
    return samples[..., ::-1] if row.nChannels == 3 else samples[..., 0]


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("quality", [75, 95])
def test_jpeg_is_read_by_another_decoder(spark, tmp_path, quality, progressive):
    image = build.gradient(67, 45)
    (tmp_path / "a.jpg").write_bytes(jpeg.Scan(image, quality >= jpeg.FULL_CHROMA).encode(quality, progressive))
    theirs = by_another(spark, tmp_path)
    assert theirs.shape == image.shape and pixels.psnr(image, theirs) > 32


def test_progressive_jpeg_of_another_encoder(spark, tmp_path):
    """Its scans refine values bit by bit, which the built-in encoder's don't."""
    source, folder = tmp_path / "source.jpg", tmp_path / "out"
    folder.mkdir()
    source.write_bytes(jpeg.Scan(build.noisy(75, 52), True).encode(95))
    io = spark._jvm.javax.imageio
    picture = io.ImageIO.read(spark._jvm.java.io.File(str(source)))
    writer = io.ImageIO.getImageWritersByFormatName("jpeg").next()
    options = writer.getDefaultWriteParam()
    options.setProgressiveMode(io.ImageWriteParam.MODE_DEFAULT)
    stream = io.ImageIO.createImageOutputStream(spark._jvm.java.io.File(str(folder / "a.jpg")))
    writer.setOutput(stream)
    writer.write(None, io.IIOImage(picture, None, None), options)
    stream.close()
    data = (folder / "a.jpg").read_bytes()
    assert b"\xff\xc2" in data and data.count(b"\xff\xda") > 5
    theirs, ours = by_another(spark, folder), jpeg.decode(data)
    assert ours.shape == theirs.shape and pixels.psnr(theirs, ours) > 30


def test_psnr_mask_and_detail():
    a = np.zeros((20, 20, 3), np.uint8)
    assert pixels.psnr(a, a) == 99.0 and pixels.psnr(a, a[:10]) == 0.0
    b = a.copy()
    b[0, 0, 0] = 10
    assert pixels.psnr(a, b) == pytest.approx(10 * np.log10(65025 / (100 / 1200)))
    dot = np.full((64, 64, 3), 255, np.uint8)
    dot[32, 32, 0] = 250
    mask = pixels.content_mask(pixels.Picture("RGB", dot))
    y, x = np.nonzero(mask)
    assert (x.min(), y.min(), x.max() + 1, y.max() + 1) == (23, 23, 41, 41)
    flat = pixels.Picture("L", np.full((30, 30), 9, np.uint8))
    assert not pixels.content_mask(flat).any() and pixels.detail(flat, pixels.content_mask(flat)) == 0.0
    smooth, photo = (pixels.detail(pixels.Picture("RGB", x)) for x in (build.gradient(), build.noisy()))
    assert smooth < 0.6 and photo > 5


def test_reduction_and_masks():
    ramp = np.tile(np.arange(256, dtype=np.uint8), (4, 1))
    assert pixels.reduced(pixels.Picture("RGB", np.stack([ramp] * 3, -1))).mode == "L"
    half = np.repeat(np.array([[0], [255]], np.uint8), 8, 0).repeat(16, 1)
    assert pixels.reduced(pixels.Picture("L", half)).mode == "1"
    assert pixels.reduced(pixels.Picture("L", half * 0 + 255)).mode == "L"
    web = Web()
    assert pixels.mask_outcome(pixels.Picture("L", half * 0 + 255), web) == ("drop", None)
    kind, made = pixels.mask_outcome(pixels.Picture("L", half), web)
    assert kind == "stencil" and zlib.decompress(made.data) == b"\xff\xff" * 8 + b"\x00\x00" * 8
    assert pixels.mask_outcome(pixels.Picture("L", ramp), web)[0] == "replace"


@pytest.mark.parametrize("answer", [30, 31, 45, 60, 64, 99])
@pytest.mark.parametrize("guess", [None, 28, 30, 44, 46, 64])
def test_search_equals_a_plain_one(answer, guess):
    seen = []

    def score(q):
        seen.append(q)
        return float(q)

    got = pixels.cheapest(score, 30, 64, float(answer), guess)
    assert got == (answer if answer <= 64 else 64) and len(seen) == len(set(seen))


def test_search_ends_where_encoding_fails():
    assert pixels.cheapest(lambda q: None, 1, 9, 5.0) is None
    assert pixels.cheapest(lambda q: None if q > 5 else float(q), 1, 9, 8.0) == 5


def test_candidates_clear_the_floor():
    for samples in (build.gradient(160, 90), build.noisy(120, 90)):
        p = pixels.Picture("RGB", samples)
        mask = pixels.content_mask(p)
        floor = pixels.floor_of(0.8, pixels.detail(p, mask))
        for c in pixels.candidates(p, Web()):
            if c.filter == "/DCTDecode":
                back = jpeg.decode(c.data)
                assert pixels.psnr(samples, back) >= min(floor, pixels.psnr(samples, jpeg.Scan(samples, True).pixels(95)))
                assert c.deflated is None or zlib.decompress(c.deflated) == c.data


def test_round_trip_shrinks_and_stays_alike(spark):
    d = one_page(build.noisy(400, 300), (180, 0, 0, 135, 10, 10))
    r, out = run(spark, d)
    assert r.after_bytes < r.before_bytes / 1.9 and len(r.images) == 1
    assert set(r.image_timings) == {"prepare", "encode"} and r.images[0].seconds == pytest.approx(sum(r.image_timings.values()))
    i = r.images[0]
    assert (i.source_w, i.source_h) == (400, 300) and i.result_w == 400 and i["filter"] == "/DCTDecode"
    small, out = run(spark, one_page(build.gradient(), (180, 0, 0, 101.25, 0, 0)))
    assert small.images[0].result_w == 375
    image = out.get(content.drawings(out)[0].ref)
    back = pixels.decode(out, image)
    want = pixels.resized(pixels.Picture("RGB", build.gradient()), back.size)
    assert pixels.psnr(want.samples, back.samples if back.samples.ndim == 3 else np.stack([back.samples] * 3, -1)) > 30
    again, _ = run(spark, out)
    assert again.after_bytes <= 1.1 * small.after_bytes


def test_crop_comes_with_its_matrix(spark):
    d = one_page(build.noisy(400, 225), clip=(0, 0, 360, 405))
    r, out = run(spark, d)
    assert r.images[0].cropped and r.images[0].result_w == 200
    ops = list(content.operators(out.contents(out.get(out.pages()[0]))))
    at = [k for k, (_, op) in enumerate(ops) if op == "Do"][0]
    assert [op for _, op in ops[at - 2 : at + 2]] == ["q", "cm", "Do", "Q"] and ops[at - 1][0] == [0.5, 0, 0, 1, 0, 0]
    r, _ = run(spark, d, Profile(crop_to_visible=False))
    assert not r.images[0].cropped


def test_masks_equal_images_and_sharing(spark):
    noise = build.noisy(100, 100)
    d = one_page(noise, mask=np.full((100, 100), 255, np.uint8))
    _, out = run(spark, d)
    assert "/SMask" not in out.get(content.drawings(out)[0].ref).entries
    half = np.zeros((100, 100), np.uint8)
    half[:, 50:] = 255
    _, out = run(spark, one_page(noise, mask=half))
    entries = out.get(content.drawings(out)[0].ref).entries
    assert out.get(entries["/Mask"]).entries["/ImageMask"] is True
    d = build.empty()
    twins = [d.add(build.image_stream(noise)) for _ in range(2)]
    build.add_page(d, [(t, (200, 0, 0, 200, 300 * k, 0), None) for k, t in enumerate(twins)])
    rows = spark.createDataFrame([("a.pdf", bytearray(d.save(False))), ("b.pdf", bytearray(d.save(False))), ("c.pdf", bytearray(b"junk"))], "path string, content binary")
    jobs = pipeline.plan_jobs(rows, Web())
    assert jobs.count() == 4 and jobs.select("job_key").distinct().count() == 1
    got = {r.path: r for r in pipeline.optimize(rows.repartition(3)).collect()}
    assert got["a.pdf"].output == got["b.pdf"].output and got["a.pdf"].merged_objects == 1 and got["c.pdf"].error
    assert pipeline.image_results(pipeline.optimize(rows)).count() == 4


def test_pruning():
    d = one_page(build.gradient(20, 20))
    root, page = d.get(d.trailer["/Root"]), d.get(d.pages()[0])
    for k in ("/Metadata", "/StructTreeRoot", "/Threads", "/OutputIntents", "/SpiderInfo"):
        root[k] = d.add({})
    page |= {"/Thumb": 1, "/PieceInfo": 2, "/StructParents": 3}
    d.trailer["/Info"] = d.add({"/Title": b"x"})
    edit.prune(d, RemovalOptions(remove_thumbnails=False))
    assert set(root) == {"/Type", "/Pages", "/OutputIntents"} and "/Thumb" in page and "/PieceInfo" not in page and "/Info" not in d.trailer
    edit.prune(d, MinimalFileSize().removal)
    assert "/OutputIntents" not in root and "/Thumb" not in page


def test_srgb(spark):
    d = build.empty()
    image = d.add(build.image_stream(build.gradient(20, 20)))
    form = d.add(Stream({"/Subtype": Name("/Form"), "/BBox": [0, 0, 9, 9], "/Resources": {"/XObject": {"/F": image}}}, b"1 0 0 rg"))
    build.add_page(d, [(form, (1, 0, 0, 1, 0, 0), None)])
    page = d.get(d.pages()[0])
    tree = d.get(d.get(d.trailer["/Root"])["/Pages"])
    tree["/Resources"] = page.pop("/Resources")
    assert edit.tag_srgb(d) == 2 and edit.tag_srgb(d) == 0
    profiles = [v for v in d.objects.values() if isinstance(v, Stream) and v.entries.get("/N") == 3]
    data = d.decoded(profiles[0])
    assert len(profiles) == 1 and int.from_bytes(data[:4], "big") == len(data) and data[36:40] == b"acsp"
    assert "/ColorSpace" in page["/Resources"] and "/ColorSpace" in d.get(form).entries["/Resources"]
    edit.prune(d, MinimalFileSize().removal)
    edit.tag_srgb(d)
    assert len([v for v in d.objects.values() if isinstance(v, Stream) and v.entries.get("/N") == 3]) == 1
    foreign = one_page(build.gradient(20, 20))
    foreign.get(foreign.trailer["/Root"])["/OutputIntents"] = [{"/S": Name("/GTS_PDFX"), "/OutputConditionIdentifier": b"FOGRA39"}]
    before = foreign.save()
    with pytest.raises(edit.ForeignOutputIntent):
        edit.tag_srgb(foreign)
    assert foreign.save() == before
    rows = spark.createDataFrame([("a", bytearray(before)), ("b", bytearray(one_page(build.gradient(20, 20)).save()))], "path string, content binary")
    got = {r.path: r for r in pipeline.declare_srgb(rows).collect()}
    assert got["a"].srgb_skipped and not got["a"].srgb_tagged and got["b"].srgb_tagged
    out = Document.load(bytes(got["b"].output))
    assert out.decoded(out.get(content.drawings(out)[0].ref)) == build.gradient(20, 20).tobytes()


def test_contexts_and_deep_page_trees(spark):
    d = build.empty()
    tile = d.add(Stream({"/PatternType": 1, "/Resources": {}}, b""))
    inner = d.add(Stream({"/Subtype": Name("/Form")}, b""))  # without resources of its own
    outer = d.add(Stream({"/Subtype": Name("/Form"), "/Resources": {"/XObject": {"/A": inner}, "/Pattern": {"/P": tile}}}, b""))
    d.get(outer).entries["/Resources"]["/XObject"]["/Self"] = outer
    for _ in range(2):
        build.add_page(d, [(outer, (1, 0, 0, 1, 0, 0), None)])
    top = d.get(d.get(d.trailer["/Root"])["/Pages"])
    for _ in range(300):  # as many levels between the root and its pages
        top["/Kids"] = [d.add({"/Type": Name("/Pages"), "/Parent": d.get(d.trailer["/Root"])["/Pages"], "/Kids": top["/Kids"], "/Count": 2})]
    assert len(d.pages()) == 2 and [c.kind for c in contexts.contexts(d)] == ["page", "page", "form", "form", "tiling"]
    rows = spark.createDataFrame([("a", bytearray(d.save(False))), ("bad", bytearray(b"x"))], "path string, content binary")
    assert {(r.kind, r.own, len(r.spaces)): r["count"] for r in source.contexts(rows).groupBy("kind", "own", "spaces").count().collect()} == {
        ("page", True, 0): 2, ("form", True, 0): 1, ("form", False, 0): 1, ("tiling", True, 0): 1,
    }
    assert edit.tag_srgb(d) == 4 and edit.tag_srgb(d) == 0


def test_tables(spark):
    d = one_page(build.gradient(20, 20))
    rows = spark.createDataFrame([("a", bytearray(d.save(False))), ("bad", bytearray(b"x"))], "path string, content binary")
    found = source.objects(rows)
    assert found.filter("path = 'a'").count() == 5 and found.filter("error IS NOT NULL").count() == 1
    assert source.pages(rows).first()[1:] == (0, 0.0, 0.0, 720.0, 405.0)
    assert [r.operator for r in source.operators(rows).orderBy("seq").collect()] == ["q", "cm", "Do", "Q"]
    edges = source.refs(rows).select("path", F.col("num").alias("src"), F.col("dst_num").alias("dst"))
    renumbered = Document.load(d.save(False))
    roots = spark.createDataFrame([("a", renumbered.trailer["/Root"].num)], "path string, num int")
    assert graph.reachable(edges, roots).count() == 5
    streams = spark.createDataFrame([("a", 1, b"x", False), ("a", 2, b"x", False), ("a", 3, b"p", False), ("a", 4, b"p", False), ("b", 5, b"x", False)], "path string, num int, body binary, exempt boolean")
    refs = spark.createDataFrame([("a", 3, "/K", 1), ("a", 4, "/K", 2)], "path string, num int, key string, dst int")
    assert {r.num: r.canonical for r in graph.merge_equal(streams, refs).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_command_line(spark, tmp_path, capsys):
    path, out = tmp_path / "a.pdf", tmp_path / "b.pdf"
    path.write_bytes(one_page(build.noisy(120, 90)).save(False))
    assert api.main([str(path), str(out), "-q", "0.5", "--srgb"]) == 0 and out.stat().st_size < path.stat().st_size
    assert api.main([str(tmp_path / "none.pdf")]) == 2
    assert api.main([str(path), "-q", "1.5"]) == 2 and api.main([str(path), "-d", "0"]) == 2
    assert api.main([str(path), "--srgb-only", "--no-crop"]) == 2
    assert api.main([str(path), str(out), "--srgb-only"]) == 0
    (tmp_path / "bad.pdf").write_bytes(b"junk")
    assert api.main([str(tmp_path / "bad.pdf")]) == 1
    with pytest.raises(SystemExit):
        api.main([str(path), "-j", "0"])
    assert "saved" in capsys.readouterr().out


def test_result_of_one_file(spark, tmp_path):
    path = tmp_path / "a.pdf"
    path.write_bytes(one_page(build.noisy(120, 90), mask=np.tile(np.arange(120, dtype=np.uint8), (90, 1))).save(False))
    r = api.optimize_document(path, tmp_path / "b.pdf")
    assert r.ratio == r.before_bytes / r.after_bytes and r.saved_fraction == 1 - r.after_bytes / r.before_bytes
    lines = r.timing_report().split("\n")
    assert {x.split(":")[0] for x in lines[:6]} == {"open", "rewrite", "prune", "dedupe", "save", "images"}
    assert {x.split(":")[0] for x in lines[6:]} == {"  prepare", "  mask", "  encode"}
    assert set(r.image_timings) == {"prepare", "mask", "encode"}


def test_stream_of_files(spark, tmp_path):
    from foliospark.streaming.ingest import watch

    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / "in" / f"{name}.pdf").write_bytes(one_page(build.noisy(60, 40)).save(False))
    for _ in range(2):  # the second time nothing is new
        watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).filter("error IS NULL").count() == 2
