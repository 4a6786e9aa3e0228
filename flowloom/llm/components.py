"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowloom.plans.storage import discard, write_and_read


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(lowest.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge list (u, v) of longs; the root is the smallest node that can be reached.

    Every round turns neighbourhoods into stars around their smallest member, with aggregates and joins only: a hub with any
    number of edges is summed before the shuffle, and its join is split by adaptive execution. Rounds are stored in
    the shared folder. Self-loops and repeated edges are allowed; an empty list gives an empty result.
    """
    tidy = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = write_and_read(tidy, "stars")
    state = _state(current)
    while state[0]:
        last, current = current, write_and_read(_small_star(_large_star(current).distinct()).distinct(), "stars")
        before, state = state, _state(current)
        discard(last)
        if before == state:
            break
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """(doc_id, key, root) of the rows of `first`, grouped by what either of two groupings (doc_id, key, root) of the same rows connects.

    Groups of `first` that share a group of `second` are linked as a star, so there is at most one link per group of `first` and group of `second`.
    """
    seen = second.select(F.col("key").alias("__key"), F.col("root").alias("other")).distinct()
    both = write_and_read(first.select("key", "root").distinct().join(seen, F.col("key") == F.col("__key")).select("other", "root").distinct(), "both")
    lowest = both.groupBy(F.col("other").alias("__other")).agg(F.min("root").alias("low"), F.count("*").alias("n")).where("n > 1")
    links = both.join(lowest, F.col("other") == F.col("__other")).select(F.col("root").alias("u"), F.col("low").alias("v"))
    linked = connected(links).withColumnRenamed("root", "__root")
    rows = first.join(linked, F.col("root") == F.col("node"), "left").select("doc_id", "key", F.coalesce("__root", "root").alias("root"))
    found = write_and_read(rows, "merged")
    discard(both)
    return found
