"""Operator 6 [native]: secret scans with multipart credential linking.

Strong kinds are found by their form alone: `assign` (a key word, a sign and a value of 8 characters or more), `access`
(access identifiers) and `hex` (runs of 32 digits or more). Weak kinds are too common to report by themselves: `key` (a bare
token of 20 characters or more with small and capital letters and digits, and its padding; it may follow a sign or end a
sentence), `login` (a named user or client) and `endpoint`
(an address with a scheme). They are candidates only in documents with an identifier, and are reported if complementary
parts co-occur within a scope, which is REACH code points around a part of the same document:

* a key with an identifier (access or login);
* a login with a secret (assign, hex or key);
* an endpoint with both an identifier and a secret.

Linking is an interval join: intervals are widened by the reach and cut into bins, candidates meet parts by (text, bin) in
left semi joins, so no pair is ever emitted and a text with many parts is spread over its bins. Equal texts are linked once,
whatever number of rows has them. A text's matches are added up in chunks of the square root of their number: an array that
grows by one element at a time is copied each time, which would be quadratic in the matches of a text.

Edge cases: an empty table gives no rows; further columns are kept, and clashing names are left alone; null text is empty and has no spans; positions are code points, ends exclusive; a weak span that overlaps a
strong one is not reported; repeated rows and null ids get the results of their text; texts are scanned whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import common

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # an AKIA run is dropped or kept as a whole either way
HEX = r"[0-9a-f]{32,}"
KEY = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"  # taken whole, kept by KEY_PARTS
KEY_PARTS = ("[a-z]", "[A-Z]", "[0-9]")
LOGIN = r"""(?i:(user_?(?:name|id)?|login|account|client_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})"""
ENDPOINT = r"""(?i:https?|ftps?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]+"""
KINDS = ["assign", "access", "hex", "key", "login", "endpoint"]
STRONG = KINDS[:3]
LEAST_VALUE = 8
REACH = 256
SPAN = "struct<start:int,kind:int,end:int>"


def spans(text: Column, pattern: str, kind: str, value_group: int | None = None, parts: tuple[str, ...] = ()) -> Column:
    """Spans of the leftmost, non-overlapping matches, in order: array<struct<start, kind, end>>.

    The pieces between matches come from a split by the same pattern; their lengths and those of the matches add up to
    the positions. Texts without a match aren't split. With a value group, matches whose value is too short are dropped
    after they have taken their place; so are matches that lack one of the patterns `parts`.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    before = F.slice(F.split(text, pattern, -1), 1, F.size(found))

    def step(m: Column, g: Column) -> Column:
        fine = reduce(Column.__and__, [m.rlike(x) for x in parts], F.lit(True))
        return F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("size"), fine.alias("fine"))

    steps = F.zip_with(found, before, step)
    if value_group is not None:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
        steps = F.zip_with(
            steps, values, lambda x, v: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), (F.char_length(v) >= LEAST_VALUE).alias("fine"))
        )
    empty = F.array().cast(f"array<{SPAN}>")
    which = F.lit(KINDS.index(kind))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), which.alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["fine"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def total(chunks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(chunks, zero, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))
        moved = F.zip_with(chunks, starts["out"], lambda x, by: F.transform(x["out"], lambda y: F.struct((y["start"] + by).alias("start"), y["kind"].alias("kind"), (y["end"] + by).alias("end"))))
        return F.flatten(moved)

    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.when(text.rlike(pattern), common.named(in_chunks(steps, lambda chunk: F.aggregate(chunk, zero, add)), total)).otherwise(empty)


def in_chunks(items: Column, use: Callable[[Column], Column]) -> Column:
    """use(chunk) of the consecutive chunks of an array; there are as many as a chunk has items, about. No items: no chunk."""

    def cut(a: Column) -> Column:
        n = F.greatest(F.ceil(F.sqrt(F.size(a))), F.lit(1)).cast("int")
        places = F.sequence(F.lit(0), F.ceil(F.size(a) / n).cast("int") - 1)
        return F.when(F.size(a) > 0, F.transform(places, lambda i: use(F.slice(a, i * n + 1, n)))).otherwise(F.slice(F.transform(F.slice(a, 1, 1), lambda x: use(F.array(x))), 1, 0))

    return common.named(items, cut)


def _strong(body: Column) -> list[Column]:
    return [spans(body, ASSIGN, "assign", 2), spans(body, ACCESS, "access"), spans(body, HEX, "hex")]


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `df` (all), then the strong spans and all spans, both by start and kind.

    The two are named `base` and `spans`, with underscores in front where `df` has such columns.
    """
    keep = keep if keep is not None else df.columns
    base, added, weak, content, logins, c = (common.fresh(df, x) for x in ("base", "spans", "weak", "content", "logins", "linked"))
    body = common.text_of(F.col(text))
    found = df.withColumn(base, F.sort_array(F.concat(*_strong(body)))).withColumn(logins, spans(body, LOGIN, "login"))
    identified = F.exists(base, lambda s: s["kind"] == KINDS.index("access")) | (F.size(logins) > 0)
    others = F.concat(F.col(logins), spans(body, KEY, "key", parts=KEY_PARTS), spans(body, ENDPOINT, "endpoint"))
    found = found.withColumn(weak, F.when(identified, others).otherwise(F.array().cast(f"array<{SPAN}>")))
    found = found.withColumn(content, F.when(F.size(weak) > 0, F.sha2(body, 256)))
    found = common.materialise(found.select(*keep, base, weak, content), "scanned")
    some = found.filter(F.col(content).isNotNull())
    linked = link(some.select(F.col(content).alias("c"), F.col(base).alias("base"), F.col(weak).alias("weak")))
    linked = linked.select(F.col("c").alias(c), F.col("added").alias(added))
    some = some.join(linked, F.col(content) == F.col(c), "left")
    every = F.when(F.col(added).isNull(), F.col(base)).otherwise(F.sort_array(F.concat(F.col(base), F.col(added))))
    alone = found.filter(F.col(content).isNull()).select(*keep, base, F.col(base).alias(added))
    return alone.unionByName(some.select(*keep, base, every.alias(added)))


def _bins(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(F.greatest(start, F.lit(0)) / REACH), F.floor(F.greatest(end - 1, F.lit(0)) / REACH)))


def link(texts: DataFrame) -> DataFrame:
    """(c, added): the weak spans to report, of rows (c, base, weak); equal texts have equal c."""
    texts = texts.dropDuplicates(["c"])
    every = texts.select("c", F.explode("base").alias("s"), F.lit(True).alias("sure")).unionByName(texts.select("c", F.explode("weak").alias("s"), F.lit(False).alias("sure")))
    every = common.materialise(every.select("c", "s.*", "sure"), "parts")
    strong = every.filter("sure")
    taken = strong.select("c", F.col("start").alias("s2"), F.col("end").alias("e2"), _bins(F.col("start"), F.col("end")).alias("bin")).alias("y")
    weak = every.filter("NOT sure").withColumn("bin", _bins(F.col("start"), F.col("end"))).alias("x")
    apart = [F.col("x.c") == F.col("y.c"), F.col("x.bin") == F.col("y.bin"), F.col("start") < F.col("e2"), F.col("s2") < F.col("end")]
    taken = weak.join(taken, reduce(Column.__and__, apart), "left_semi").select("c", "start", "kind", "end").distinct()
    weak = every.filter("NOT sure").join(common.materialise(taken, "taken"), ["c", "start", "kind", "end"], "left_anti")
    parts = common.materialise(strong.unionByName(weak), "parts")

    def of(*kinds: str) -> Column:
        return F.col("kind").isin([KINDS.index(k) for k in kinds])

    def within_reach(candidates: DataFrame, *kinds: str) -> DataFrame:
        near = parts.filter(of(*kinds)).select("c", F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("kind").alias("k2"))
        near = near.withColumn("bin", _bins(F.col("s2") - REACH, F.col("e2") + REACH))
        meets = [F.col("x.c") == F.col("y.c"), F.col("x.bin") == F.col("y.bin"), F.col("start") < F.col("e2") + REACH, F.col("s2") - REACH < F.col("end")]
        other = (F.col("start") != F.col("s2")) | (F.col("kind") != F.col("k2"))
        binned = candidates.withColumn("bin", _bins(F.col("start"), F.col("end")))
        hit = binned.alias("x").join(near.alias("y"), reduce(Column.__and__, [*meets, other]), "left_semi")
        return hit.drop("bin").distinct()

    picked = parts.filter(~F.col("sure"))
    keys = within_reach(picked.filter(of("key")), "access", "login")
    logins = within_reach(picked.filter(of("login")), "assign", "hex", "key")
    ends = within_reach(within_reach(picked.filter(of("endpoint")), "access", "login"), "assign", "hex", "key")
    shown = keys.unionByName(logins).unionByName(ends)
    span = F.struct("start", "kind", "end")
    return shown.groupBy("c").agg(F.collect_list(span).alias("added"))


def as_text(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def redact(text: Column, found: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each maximal run of overlapping spans replaced by the mark; spans are sorted by start.

    Each chunk of spans cuts its own piece of the text once and then works on that.
    """

    def cut(chunks: Column) -> Column:
        """struct<at, spans> of each chunk: where the text before it has been used up."""
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

        def add(acc: Column, c: Column) -> Column:
            return F.struct(F.greatest(acc["at"], F.array_max(F.transform(c, lambda s: s["end"]))).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        def parts(upto: Column) -> Column:
            pieces = F.zip_with(chunks, upto["out"], lambda c, at: replaced(c, at))
            rest = F.substring(text, upto["at"] + 1, F.greatest(F.char_length(text) - upto["at"], F.lit(0)))
            return F.concat(F.array_join(pieces, ""), rest)

        return common.named(F.aggregate(chunks, zero, add), parts)

    def replaced(spans: Column, base: Column) -> Column:
        zero = F.struct(base.alias("at"), F.array().cast("array<string>").alias("out"))
        size = F.greatest(F.array_max(F.transform(spans, lambda s: s["end"])) - base, F.lit(0))

        def inside(piece: Column) -> Column:
            def add(acc: Column, s: Column) -> Column:
                gap = F.substring(piece, acc["at"] - base + 1, s["start"] - acc["at"])
                return F.struct(
                    F.greatest(acc["at"], s["end"]).alias("at"),
                    F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"]).alias("out"),
                )

            return F.array_join(F.aggregate(spans, zero, add)["out"], "")

        return common.named(F.substring(text, base + 1, size), inside)

    return F.when(F.size(found) > 0, common.named(in_chunks(found, lambda c: c), cut)).otherwise(text)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in STRONG],
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
    )
