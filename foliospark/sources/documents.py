"""Documents as tables: files, objects, references, pages, operators, drawn images.

Each function takes rows (path, content), as Spark's binaryFile source gives them or as any other table has them. A document
that can't be read gives one row with its error, where the table has such a column, and else none.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import DataFrame, SparkSession

from foliospark.pdf import content, model
from foliospark.pdf.contexts import contexts as contexts_of
from foliospark.pdf.model import Document, Name, Ref, Stream, serialise

OBJECTS = "path string, num int, gen int, kind string, entries map<string,string>, raw binary, error string"
REFS = "path string, num int, gen int, key string, dst_num int, dst_gen int"
CONTEXTS = "path string, num int, gen int, kind string, own boolean, spaces array<string>"
PAGES = "path string, page int, x0 double, y0 double, x1 double, y1 double"
OPERATORS = "path string, page int, seq int, operator string, operands array<string>"
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
DRAWINGS = f"path string, num int, gen int, page int, seq int, ctm struct<a:double,b:double,c:double,d:double,e:double,f:double>, clip {BOX}, px_w int, px_h int"


def files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, modificationTime, length, content) of the files under a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def table_of(documents: DataFrame, ddl: str, rows) -> DataFrame:
    """A table of the dicts that `rows(path, content)` yields for each document, some documents at a time."""
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for path, body in zip(batch.column(0), batch.column(1), strict=True):
                made = list(rows(path.as_py(), body.as_py() or b""))
                if made:
                    yield pa.RecordBatch.from_pylist(made, schema=schema)

    return documents.select("path", "content").mapInArrow(run, ddl)


def _kind(v) -> str:
    names = {Stream: "stream", dict: "dictionary", list: "array", Name: "name", bytes: "string", bool: "boolean", int: "integer", float: "real"}
    return names.get(type(v), "null")


def objects(documents: DataFrame) -> DataFrame:
    """OBJECTS: every object with its dictionary as text, and a stream's stored bytes."""

    def rows(path, body):
        try:
            document = Document.load(body)
        except Exception as e:
            yield {"path": path, "error": str(e) or type(e).__name__}
            return
        for ref, v in sorted(document.objects.items()):
            entries = v.entries if isinstance(v, Stream) else v if isinstance(v, dict) else {}
            shown = {k: serialise(x).decode("latin-1") for k, x in entries.items()}
            yield {"path": path, "num": ref.num, "gen": ref.gen, "kind": _kind(v), "entries": list(shown.items()), "raw": v.raw if isinstance(v, Stream) else serialise(v)}

    return table_of(documents, OBJECTS, rows)


def refs(documents: DataFrame) -> DataFrame:
    """REFS: every reference, by the keys that lead to it within its object."""

    def walk(v, key):
        if isinstance(v, Ref):
            yield key, v
        elif isinstance(v, dict | Stream):
            for k, x in (v.entries if isinstance(v, Stream) else v).items():
                yield from walk(x, f"{key}{k}")
        elif isinstance(v, list):
            for i, x in enumerate(v):
                yield from walk(x, f"{key}[{i}]")

    def rows(path, body):
        try:
            document = Document.load(body)
        except Exception:
            return
        for ref, v in sorted(document.objects.items()):
            for key, to in walk(v, ""):
                yield {"path": path, "num": ref.num, "gen": ref.gen, "key": key, "dst_num": to.num, "dst_gen": to.gen}

    return table_of(documents, REFS, rows)


def pages(documents: DataFrame) -> DataFrame:
    """PAGES: the box of each page, nulls if it has none."""

    def rows(path, body):
        try:
            document = Document.load(body)
        except Exception:
            return
        for n, ref in enumerate(document.pages()):
            box = content.page_box(document, document.get(ref)) or (None,) * 4
            yield {"path": path, "page": n, **dict(zip(("x0", "y0", "x1", "y1"), box, strict=True))}

    return table_of(documents, PAGES, rows)


def contexts(documents: DataFrame) -> DataFrame:
    """CONTEXTS: all that paints (page, form or tiling), whether its resources are its own, and the names of its colour spaces."""

    def rows(path, body):
        try:
            document = Document.load(body)
            found = contexts_of(document)
        except Exception:
            return
        for c in found:
            own = isinstance(document.get(c.holder.get("/Resources")), dict)
            yield {"path": path, "num": c.owner.num, "gen": c.owner.gen, "kind": c.kind, "own": own, "spaces": sorted(c.spaces(document))}

    return table_of(documents, CONTEXTS, rows)


def page_counts(documents: DataFrame) -> DataFrame:
    """(path, pages): how many pages each file has; 0 if it can't be read."""
    counts = pages(documents).groupBy("path").agg(F.count("*").alias("pages"))
    return documents.select("path").join(counts, "path", "left").select("path", F.coalesce("pages", F.lit(0)).alias("pages"))


def operators(documents: DataFrame) -> DataFrame:
    """OPERATORS: each page's content by place; a page that can't be read has none."""

    def rows(path, body):
        try:
            document = Document.load(body)
        except Exception:
            return
        for n, ref in enumerate(document.pages()):
            try:
                ops = list(content.operators(document.contents(document.get(ref))))
            except Exception:
                continue
            for seq, (operands, op) in enumerate(ops):
                yield {"path": path, "page": n, "seq": seq, "operator": str(op), "operands": [serialise(v).decode("latin-1") for v in operands]}

    return table_of(documents, OPERATORS, rows)


def drawings(documents: DataFrame) -> DataFrame:
    """DRAWINGS: each drawn occurrence of an image, with its matrix and the box that it is clipped to."""

    def rows(path, body):
        try:
            found = content.drawings(Document.load(body))
        except Exception:
            return
        for d in found:
            clip = None if d.clip is None else dict(zip(("x0", "y0", "x1", "y1"), d.clip, strict=True))
            yield {"path": path, "num": d.ref.num, "gen": d.ref.gen, "page": d.page, "seq": d.seq, "ctm": dict(zip("abcdef", d.ctm, strict=True)), "clip": clip, "px_w": d.px[0], "px_h": d.px[1]}

    return table_of(documents, DRAWINGS, rows)


def standalone(document: Document, stream: Stream) -> bytes | None:
    """An image's dictionary with all that its decoding needs and no references; None for what is left untouched."""
    if document.get(stream.entries.get("/ImageMask")) is True or isinstance(document.get(stream.entries.get("/Mask")), list):
        return None

    def plain(v):
        v = document.get(v)
        if isinstance(v, Stream):
            return document.decoded(v)
        if isinstance(v, list):
            if v and document.get(v[0]) == "/ICCBased":
                n = document.get(document.get(v[1]).entries.get("/N"))
                return {1: Name("/DeviceGray"), 3: Name("/DeviceRGB"), 4: Name("/DeviceCMYK")}[n]
            return [plain(x) for x in v]
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return v

    keys = ("/Width", "/Height", "/Filter", "/DecodeParms", "/ColorSpace", "/BitsPerComponent", "/Decode")
    try:
        return serialise({k: plain(stream.entries[k]) for k in keys if k in stream.entries})
    except Exception:
        return None


IMAGES = "path string, num int, gen int, before_bytes long, shape binary, raw binary, mask_shape binary, mask_raw binary, image_key string"


def images(documents: DataFrame) -> DataFrame:
    """IMAGES: every drawn image that may be encoded anew, with its soft mask, and a key that equal ones share."""

    def rows(path, body):
        try:
            document = Document.load(body)
            found = dict.fromkeys(d.ref for d in content.drawings(document))
        except Exception:
            return
        for ref in found:
            stream = document.get(ref)
            shape = standalone(document, stream)
            mask = document.get(stream.entries.get("/SMask"))
            mask_shape = standalone(document, mask) if isinstance(mask, Stream) and "/Matte" not in mask.entries else None
            if shape is None or (isinstance(mask, Stream) and mask_shape is None):
                continue
            h = hashlib.sha256()
            for part in (shape, stream.raw, mask_shape or b"", mask.raw if mask_shape else b""):
                h.update(len(part).to_bytes(8, "big") + part)
            yield {
                "path": path, "num": ref.num, "gen": ref.gen, "before_bytes": len(stream.raw), "shape": shape, "raw": stream.raw,
                "mask_shape": mask_shape, "mask_raw": mask.raw if mask_shape else None, "image_key": h.hexdigest(),
            }

    return table_of(documents, IMAGES, rows)


def stream_of(shape: bytes, raw: bytes) -> Stream:
    return Stream(model.Parser(shape).value(), raw)
