"""Object graphs as tables: digests, merging of equal streams, reachability, and pruning of dictionaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.profiles import RemovalOptions

PASSES = 4
FRONTS = 24


def digest(entries: Column, payload: Column, skip: tuple[str, ...] = ("/Length",)) -> Column:
    """SHA-256 of a stream: its dictionary (map<string,string>) by key, without the skipped keys, then its payload."""
    kept = F.map_filter(entries, lambda k, _: ~k.isin(*skip))
    pairs = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("\x1f"), e["value"], F.lit("\x1e")))
    return F.sha2(F.concat(F.encode(F.array_join(pairs, ""), "UTF-8"), payload), 256)


def canonical(streams: DataFrame, path: list[str], key: str, hashed: str) -> DataFrame:
    """(path, hashed, canonical, copies): the least key of each digest.

    A grouped minimum that tasks pre-aggregate, so a digest that a third of all streams share costs nothing extra.
    """
    return streams.groupBy(*path, hashed).agg(F.min(key).alias("canonical"), F.count("*").alias("copies"))


def merge_equal(streams: DataFrame, refs: DataFrame, checkpoint=lambda df: df) -> DataFrame:
    """(path, num, canonical): what each stream (path, num, body, exempt) merges into, itself if nothing.

    refs (path, num, key, dst): a stream's digest is that of its body and its references, each by the object that its
    target has merged into. Rounds go on until nothing merges, PASSES at most; `checkpoint` cuts each one's lineage.
    """
    names = checkpoint(streams.select("path", "num", F.col("num").alias("canonical")))
    for _ in range(PASSES):
        to = names.select("path", F.col("num").alias("dst"), F.col("canonical").alias("target"))
        out = refs.join(to, ["path", "dst"], "left").withColumn("target", F.coalesce("target", "dst"))
        lists = out.groupBy("path", "num").agg(F.sort_array(F.collect_list(F.struct("key", "target"))).alias("refs"))
        hashed = streams.filter(~F.col("exempt")).join(lists, ["path", "num"], "left")
        hashed = hashed.select("path", "num", F.sha2(F.concat_ws("|", F.sha2("body", 256), F.to_json("refs")), 256).alias("hashed"))
        first = hashed.join(canonical(hashed, ["path"], "num", "hashed"), ["path", "hashed"]).select("path", "num", F.col("canonical").alias("least"))
        merged = names.join(first, ["path", "num"], "left").select("path", "num", F.coalesce("least", "canonical").alias("canonical"), (F.col("least") < F.col("canonical")).alias("moved"))
        merged = checkpoint(merged)
        moved = merged.filter("moved").limit(1).count()
        names = merged.select("path", "num", "canonical")
        if not moved:
            break
    return names


def reachable(edges: DataFrame, roots: DataFrame, checkpoint=lambda df: df) -> DataFrame:
    """The nodes (path, num) that the roots lead to over edges (path, src, dst), themselves included; breadth first.

    Each round joins only the nodes found last, until there are none; `checkpoint` cuts its lineage. What was found before
    stays as the rounds wrote it, and is written anew as one table every FRONTS rounds.
    """
    front = checkpoint(roots.select("path", "num").distinct())
    fronts = [front]
    while front.limit(1).count():
        step = edges.join(front.withColumnRenamed("num", "src"), ["path", "src"]).select("path", F.col("dst").alias("num")).distinct()
        front = checkpoint(step.join(reduce(DataFrame.unionByName, fronts), ["path", "num"], "left_anti"))
        fronts.append(front)
        if len(fronts) > FRONTS:
            fronts = [checkpoint(reduce(DataFrame.unionByName, fronts))]
    return reduce(DataFrame.unionByName, fronts)


def pruned_keys(removal: RemovalOptions, where: str) -> list[str]:
    """The dictionary keys that a run discards from the catalog ("root") or from pages ("page")."""
    r = removal
    if where == "root":
        chosen = [(r.remove_metadata, "/Metadata"), (r.remove_metadata, "/PieceInfo"), (r.remove_structure_tree, "/StructTreeRoot"), (r.remove_structure_tree, "/MarkInfo"),
                  (r.remove_article_threads, "/Threads"), (r.remove_output_intents, "/OutputIntents"), (True, "/SpiderInfo")]
    else:
        chosen = [(r.remove_thumbnails, "/Thumb"), (r.remove_piece_info, "/PieceInfo"), (r.remove_metadata, "/Metadata"), (r.remove_structure_tree, "/StructParents")]
    return [k for on, k in chosen if on]


def without_keys(entries: Column, keys: list[str]) -> Column:
    """A map without the keys."""
    return F.map_filter(entries, lambda k, _: ~k.isin(*keys)) if keys else entries
