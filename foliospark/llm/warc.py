r"""Operator 7: WARC archives, written by record and read by byte ranges.

Writing: each record is one gzip member (ISO 28500, annex D). Spark's text sink carries the members, so archives land on any
store through its commit protocol, and lost tasks leave nothing behind. The sink puts a separator after each row; it is a zero
byte, and a member's last byte, the highest of its four-byte length, is left for it (members of 16 MB and more are
followed by an empty member, whose length is zero). No member holds gzip's magic inside: one that would is compressed again
at another level. Files don't end in .gz, else Hadoop would unpack them and they couldn't be split.

Reading: a task scans its byte range for the magic (Spark's text source, with the magic as separator, owns each record that
starts inside its range and reads on past the end of the range for the last one), takes each piece for a candidate,
and accepts it if it unpacks as a gzip member whose content starts with a WARC header. In archives made elsewhere, the magic
may stand inside a member by chance; such a member is taken together from its pieces, across ranges too.

Payloads of at least LEAST_SHARED bytes are stored once: the record with the largest page_id is a response, others of equal
payload are revisits that refer to it and hold the HTTP header only.

Edge cases: null html is empty, null url is the empty URI; a null page_id has no id field and is a response always; rows that
repeat a page_id with one payload are responses together if it is the largest, else revisits together; an empty table gives
no rows; further columns are not read, whatever their names; files that are no archives give no rows. A task holds one
record whole, and one stretch between two magics.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm import common

MAGIC = b"\x1f\x8b\x08"
LEAST_SHARED = 1000
DATE = "2024-01-01T00:00:00Z"
OUT_BYTES = 8 << 20
RECORD = "record_id string, type string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string"


# -- members -----------------------------------------------------------------------------------------------------------------


def member(content: bytes, level: int = 6) -> bytes:
    """A gzip member without the magic inside it."""
    for at in (level, *(x for x in range(9, 0, -1) if x != level)):
        packer = zlib.compressobj(at, zlib.DEFLATED, 31)
        out = packer.compress(content) + packer.flush()
        if out.find(MAGIC, 1) < 0:
            return out
    out = b""  # split the stream at other places until chance spares it
    step = len(content)
    while not out or out.find(MAGIC, 1) >= 0:
        step = max(1, step * 2 // 3)
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        out = b"".join(packer.compress(content[i : i + step]) + packer.flush(zlib.Z_FULL_FLUSH) for i in range(0, len(content), step)) + packer.flush()
        if step == 1:
            break
    return out


def sink_row(packed: bytes) -> bytes:
    """The member without its last byte, which the sink's separator completes."""
    if packed[-1]:
        packed += member(b"")
    return packed[:-1]


def header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record with its payload, or a revisit record without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page_id if page_id is not None else ''}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(url.split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
        ]
    return header(fields) + block + b"\r\n\r\n"


def parse(content: bytes) -> tuple[dict[str, str], bytes] | None:
    """(header fields by lower-case name, block) of an unpacked record; None if it is none."""
    if not content.startswith(b"WARC/1."):
        return None
    end = content.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in content[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit():
        return None
    size = int(fields["content-length"])
    return (fields, content[end + 4 : end + 4 + size]) if len(content) >= end + 4 + size else None


def _page(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def row_of(content: bytes, with_payload: bool) -> tuple | None:
    """A RECORD row of an unpacked response or revisit; its digest is made of the payload that is there."""
    got = parse(content)
    if got is None or got[0].get("warc-type") not in ("response", "revisit"):
        return None
    fields, block = got
    head, _, payload = block.partition(b"\r\n\r\n")
    if fields["warc-type"] == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        said = [x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size, digest = int(said[0]) if said else None, fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    urn = fields.get("warc-record-id")
    row = (urn, fields["warc-type"], fields.get("warc-target-uri"), _page(urn), _page(fields.get("warc-refers-to")), size, digest)
    return (*row, payload if fields["warc-type"] == "response" else None) if with_payload else row


# -- writing -----------------------------------------------------------------------------------------------------------------


def mark_revisits(pages: DataFrame) -> DataFrame:
    """All columns of `pages` (page_id, url, html), with payload_digest and refers_to (null: a response).

    Only narrow rows are grouped: the groups' largest ids, then the rows that aren't it. These are written, so that their
    size is known when they are joined to the pages: broadcast where small, sort-merged elsewhere.
    """
    body = common.text_of(F.col("html"))
    shared = pages.select("page_id", F.sha1(body).alias("digest"), F.octet_length(body).alias("size")).filter(F.col("size") >= LEAST_SHARED)
    shared = common.materialise(shared.filter("page_id IS NOT NULL"), "digests")
    first = shared.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = common.materialise(shared.join(first, "digest").filter("page_id < first").select("page_id", "digest", "first").distinct(), "revisits")
    marked = pages.withColumn("payload_digest", F.sha1(body))
    found = (marked["page_id"] == again["page_id"]) & (marked["payload_digest"] == again["digest"])
    return marked.join(again, found, "left").select(*[marked[c] for c in marked.columns], F.col("first").alias("refers_to"))


def write_warc(pages: DataFrame, path: str, level: int = 6) -> None:
    """Write a record for each row of `pages` (page_id, url, html) under the path."""

    def pack(batches):
        opened = False
        for batch in batches:
            rows, size = [], 0
            if not opened and batch.num_rows:
                info = b"software: foliospark\r\nformat: WARC File Format 1.1\r\n"
                fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:page:info>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")]
                rows.append(sink_row(member(header([*fields, ("Content-Length", str(len(info)))]) + info + b"\r\n\r\n", level)))
                opened = True
            ids, urls, bodies, digests, refers = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                said = record(ids[i].as_py(), urls[i].as_py() or "", bodies[i].as_py() or b"", digests[i].as_py(), refers[i].as_py())
                rows.append(sink_row(member(said, level)))
                size += len(rows[-1])
                if size >= OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    common.bound_batches(pages.sparkSession)
    marked = mark_revisits(pages.select("page_id", "url", "html"))
    rows = marked.select("page_id", "url", F.encode(common.text_of(F.col("html")), "UTF-8").alias("body"), "payload_digest", "refers_to")
    rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\x00").text(path)


# -- reading -----------------------------------------------------------------------------------------------------------------

_PIECES = "kind string, path string, at long, part long, piece binary"


class Member:
    """A gzip member that is unpacked piece by piece; `pieces` are those that it has got, without the magic before each."""

    def __init__(self, piece: bytes):
        self.pieces: list[bytes] = []
        self._packer, self._parts, self.bad = zlib.decompressobj(31), [], False
        self.feed(piece)

    def feed(self, piece: bytes) -> None:
        self.pieces.append(piece)
        if not self.bad and not self.ended:
            try:
                self._parts.append(self._packer.decompress(MAGIC + piece))
            except zlib.error:
                self.bad = True

    @property
    def ended(self) -> bool:
        return self._packer.eof

    @property
    def content(self) -> bytes:
        if len(self._parts) > 1:
            self._parts = [b"".join(self._parts)]
        return self._parts[0] if self._parts else b""

    def is_record(self) -> bool:
        """Whether it unpacks, so far, to the start of a WARC header."""
        return not self.bad and (self.ended or bool(self.content)) and self.content[:7] == b"WARC/1."[: len(self.content)]


def read_warc(spark: SparkSession, path: str, with_payload: bool = False, files: int | None = None) -> DataFrame:
    """The response and revisit records under a path, as RECORD columns (and `payload`); `files`: bytes of a range."""
    schema = RECORD + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def frame(rows, extra):
        rows, extra = list(rows), list(extra)
        cols = [pa.array([r[k] for r in rows] + [None] * len(extra), t) for k, t in enumerate(types)]
        more = [pa.array([None] * len(rows) + [e[k] for e in extra], kinds[x.split()[1]]) for k, x in enumerate(_PIECES.split(", "))]
        return pa.RecordBatch.from_arrays([*cols, *more], names=[*names, *(x.split()[0] for x in _PIECES.split(", "))])

    def scan(batches):
        place = None  # (file, start of the range, end of the range)
        current: Member | None = None  # one that goes on
        part = 0

        def cut_member(place):
            return [("tail", place[0], place[2], k, p) for k, p in enumerate(current.pieces)] if current else []

        for batch in batches:
            rows, extra, size = [], [], 0
            pieces, paths, starts, lengths = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                here = (paths[i].as_py(), starts[i].as_py(), starts[i].as_py() + lengths[i].as_py())
                if here != place:
                    extra += cut_member(place)
                    place, current, part, whole = here, None, 0, False
                piece = pieces[i].as_py()
                if not piece:
                    continue
                started = Member(piece)
                if started.is_record():
                    current = started
                    if not whole:
                        extra.append(("start", place[0], place[1], 0, None))
                    whole = True
                elif current:
                    current.feed(piece)
                elif not whole:  # nothing has started in this range yet: it may belong to the one before
                    extra.append(("head", place[0], place[1], part, piece))
                    part += 1
                    continue
                else:
                    continue
                if current.ended and not current.bad:
                    row = row_of(current.content, with_payload)
                    if row:
                        rows.append(row)
                        size += len(current.content) if with_payload else 200
                    current = None
                if size >= OUT_BYTES:
                    yield frame(rows, extra)
                    rows, extra, size = [], [], 0
            yield frame(rows, extra)
        if current:
            yield frame([], cut_member(place))

    def rejoin(batches):
        for batch in batches:
            rows = []
            for chain in batch.column(0).to_pylist():
                # By place: the pieces of a cut member, then those that ranges after it found before any member of theirs.
                current = None
                for p in sorted(chain, key=lambda x: (x["at"], x["kind"] == "head", x["part"])):
                    if current is None:
                        current = Member(p["piece"])
                    elif not current.ended:
                        current.feed(p["piece"])
                row = row_of(current.content, with_payload) if current.ended and not current.bad else None
                rows += [row] if row else []
            yield frame(rows, []).select(names)

    reader = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1")
    meta = [F.col(f"_metadata.{x}") for x in ("file_path", "file_block_start", "file_block_length")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    pieces = reader.text(path).select(F.col("value").cast("binary"), *meta)
    if files:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(files))
    try:
        found = common.materialise(pieces.mapInArrow(scan, f"{schema}, {_PIECES}"), "records")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # Which cut member goes on in a range is settled by narrow rows, three a range at most: the last event before a range's
    # head is either a cut member or a member's start, after which a head is no member's. So a file that is no archive has no
    # chain, and a chain has one member and what follows it up to the next range in which a member starts.
    events = found.filter("kind IS NOT NULL").select("path", "at", "kind").distinct()
    order = Window.partitionBy("path").orderBy("at", F.expr("CASE kind WHEN 'tail' THEN 0 WHEN 'head' THEN 1 ELSE 2 END"))
    last = F.last(F.when(F.col("kind") != "head", F.struct("kind", "at")), ignorenulls=True).over(order)
    chained = events.withColumn("last", last).filter("last.kind = 'tail'").select("path", "at", "kind", F.col("last.at").alias("tail_at"))
    pieces = found.filter("kind IN ('tail', 'head')").select("path", "at", "kind", "part", "piece").join(chained, ["path", "at", "kind"])
    chains = pieces.groupBy("path", "tail_at").agg(F.collect_list(F.struct("kind", "at", "part", "piece")).alias("chain"))
    cut = chains.select("chain").mapInArrow(rejoin, schema)
    return found.filter("kind IS NULL").select(*names).unionByName(cut)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "warc")
    write_warc(common.table(spark, sf_dir, "pages"), path)
    found = read_warc(spark, path)
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT *, CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY digest, size) ELSE page_id END AS first FROM p)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM m
"""
