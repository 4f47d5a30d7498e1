"""Encode each distinct payload once, and choose among candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The dictionary entries that change what an image's bytes decode to.
DECODE_KEYS = ["/Width", "/Height", "/Filter", "/DecodeParms", "/ColorSpace", "/BitsPerComponent", "/Decode", "/ImageMask", "/Mask"]
#: Candidates of equal size: the earlier one is taken.
FILTERS = ["/FlateDecode", "/DCTDecode", "/JPXDecode"]


def content_key(raw: Column, entries: Column) -> Column:
    """Equal for streams that decode alike: a hash of the bytes and of the entries that matter."""
    kept = F.array(*[F.coalesce(entries[k], F.lit("\x00")) for k in DECODE_KEYS])
    return F.sha2(F.concat(F.unhex(F.sha2(raw, 256)), F.encode(F.array_join(kept, "\x1f"), "UTF-8")), 256)


def encode_once(jobs: DataFrame, key: str, encode: Callable[[DataFrame], DataFrame], payload: list[str]) -> DataFrame:
    """All rows of `jobs`, with what `encode` made of their payload; each key is encoded once.

    `encode` gets (key, payload...) with distinct keys and returns rows with the key. Rows whose key is null are never
    shared with others and get nulls here.
    """
    distinct = jobs.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.any_value(c).alias(c) for c in payload])
    return jobs.join(encode(distinct), key, "left")


def smallest_candidate(candidates: DataFrame, key: list[str], size: str = "size", rank: str = "rank") -> DataFrame:
    """The smallest candidate of each key; of equal ones that with the lowest rank."""
    rest = [c for c in candidates.columns if c not in key]
    best = candidates.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(size, rank)).alias("best"))
    return best.select(*key, "best.*")


def accepted(results: DataFrame, before: str = "before_bytes", after: str = "after_bytes") -> DataFrame:
    """The results that are smaller than what they replace."""
    return results.filter(F.col(after) < F.col(before))
