"""Near duplicates by SimHash: fingerprints within a few bits, found with vantage-point trees.

A tree node holds a vantage fingerprint and a radius. By the triangle inequality two fingerprints within `r` bits of each other have distances
to the vantage point that differ by at most `r`. So if everything at most `radius + r` away goes inside and everything more than
`radius` away goes outside, each close pair meets on at least one side; the strip in between goes to both. The top of the
tree, fitted on a bounded sample, deals all distinct fingerprints out to shards; inside a shard the tree is continued down to small blocks whose
pairs are compared bit by bit. A shard reports a spanning forest of its links, never all pairs.

Rows: a null text and a text without a word have fingerprint zero. Equal fingerprints are always linked. Rows that repeat a doc_id are
rows of their own. A null doc_id never names a component unless no member has an id (then component_id is null).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.components import connected
from flowloom.llm.text import row_key
from flowloom.plans.storage import write_and_read

WORDS = 3
BITS = 3
#: Fingerprints that a shard should hold, the bound of the sample that the top of the tree is fitted on, its largest depth.
SHARD, SAMPLE, DEPTH = 16_384, 16_384, 14
#: Fingerprints that are compared all with all, and pairs looked at in one step.
BLOCK, TILE = 256, 1 << 20
_CHUNK = 65_536


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of one text as an unsigned number."""
    tokens = text.encode("utf-8", "replace").lower().split() if text else []
    if not tokens:
        return 0
    shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words)))) if len(tokens) > words else iter([b" ".join(tokens)])
    total, votes = 0, np.zeros(64, np.int64)
    hashed = partial(xxhash.xxh64_intdigest, seed=42)
    while block := list(map(hashed, islice(shingles, _CHUNK))):
        bits = np.unpackbits(np.array(block, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
        total += len(block)
    return int(np.packbits(votes * 2 > total, bitorder="little").view(np.uint64)[0])


def _fingerprint_column(text: Column, words: int) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return of(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _best_radius(distances: np.ndarray, bits: int) -> tuple[int, int]:
    """(radius, size of the larger side) of the most even split."""
    below = np.cumsum(np.bincount(distances, minlength=65 + bits))
    inside = below[np.minimum(np.arange(65) + bits, 64 + bits)]
    larger = np.maximum(inside, len(distances) - below[:65])
    radius = int(np.argmin(larger))
    return radius, int(larger[radius])


def plan_tree(sample: np.ndarray, count: int, bits: int, shard: int = SHARD) -> dict[int, tuple[int, int]]:
    """Nodes (vantage, radius) by heap number; a leaf begins where `count` fingerprints like the sample leave at most `shard`."""
    nodes: dict[int, tuple[int, int]] = {}
    stack = [(0, sample)]
    while stack:
        at, own = stack.pop()
        if at >= 2**DEPTH - 1 or len(own) < 8 or len(own) / len(sample) * count <= shard:
            continue
        vantage = own[0]
        distances = np.bitwise_count(own ^ vantage)
        radius, larger = _best_radius(distances, bits)
        if larger > 0.95 * len(own):
            continue
        nodes[at] = (int(vantage), radius)
        stack += [(2 * at + 1, own[distances <= radius + bits]), (2 * at + 2, own[distances > radius])]
    return nodes


def deal(nodes: dict[int, tuple[int, int]], fps: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, its fingerprints): every two that are within `bits` of each other share a leaf."""
    stack = [(0, fps)]
    while stack:
        at, own = stack.pop()
        if not len(own):
            continue
        if at not in nodes:
            yield at, own
            continue
        vantage, radius = nodes[at]
        distances = np.bitwise_count(own ^ np.uint64(vantage))
        stack += [(2 * at + 1, own[distances <= radius + bits]), (2 * at + 2, own[distances > radius])]


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    found = parent[at]
    while (parent[found] != found).any():
        found = parent[found]
    return found


def _join_close(fps: np.ndarray, left: np.ndarray, right: np.ndarray, parent: np.ndarray, bits: int) -> None:
    """Unite all close pairs between two index lists, a tile at a time."""
    step = max(1, TILE // max(1, len(right)))
    for start in range(0, len(left), step):
        rows = left[start:start + step]
        a, b = np.nonzero(np.bitwise_count(fps[rows][:, None] ^ fps[right][None, :]) <= bits)
        ra, rb = _roots(parent, rows[a]), _roots(parent, right[b])
        apart = ra != rb
        for x, y in set(zip(ra[apart].tolist(), rb[apart].tolist())):
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)


def spanning_links(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what close pairs connect among distinct fingerprints: at most one per fingerprint."""
    parent, stack = np.arange(len(fps)), [np.arange(len(fps))]
    while stack:
        own = stack.pop()
        if len(own) > BLOCK:
            distances = np.bitwise_count(fps[own] ^ fps[own[len(own) // 2]])
            radius, larger = _best_radius(distances, bits)
            if larger <= 0.95 * len(own):
                stack += [own[distances <= radius + bits], own[distances > radius]]
                continue
        _join_close(fps, own, own, parent, bits)
    root = _roots(parent, np.arange(len(fps)))
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def links(distinct: DataFrame, count: int, bits: int = BITS) -> DataFrame:
    """(u, v): links among distinct fingerprints `fp` that connect exactly what pairs within `bits` bits connect."""
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    nodes = plan_tree(sample, count, bits)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dealt = list(deal(nodes, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))
            if dealt:
                offsets = np.cumsum([0, *(len(own) for _, own in dealt)], dtype=np.int32)
                held = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([own for _, own in dealt]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([leaf for leaf, _ in dealt], pa.int32()), held], ["shard", "fps"])

    def search(table: pa.Table) -> pa.Table:
        fps = table.column("fps").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        u, v = spanning_links(fps, bits)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    # a row holds what one batch deals to one shard
    dealt = distinct.select("fp").mapInArrow(shards, "shard int, fps array<long>")
    return dealt.groupBy("shard").applyInArrow(search, "u long, v long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS, with_key: bool = False
) -> DataFrame:
    """(doc_id, fp, component_id) for every row; `with_key` adds (key, root): the row's key and what names its component."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = [row_key("doc_id", "text").alias("key")] if with_key else []
    table = write_and_read(named.select("doc_id", _fingerprint_column(F.col("text"), words).alias("fp"), *key), "fingerprints")
    distinct = write_and_read(table.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "distinct")
    linked = connected(links(distinct, distinct.count(), bits))
    classes = write_and_read(
        distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "classes"
    )
    lowest = classes.groupBy("root").agg(F.min("smallest").alias("component_id"))
    more = ["key", "root"] if with_key else []
    return table.join(classes.select("fp", "root").join(lowest, "root"), "fp").select("doc_id", "fp", "component_id", *more)


def keep_one(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id; among rows of that id any one, always the same.

    A row without doc_id stays only if no row of its group has one.
    """
    return first_of_each(docs, write_and_read(near_duplicates(docs, words=words, bits=bits, with_key=True), "groups"))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `docs` that `keep_one` keeps of the groups in `found` (doc_id, key, root)."""
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")).select("first.key")
    gone = found.join(first, "key", "left_anti").select(F.col("key").alias("__gone")).distinct()
    kept = docs.withColumn("__key", row_key("doc_id", "text")).join(gone, F.col("__key") == F.col("__gone"), "left_anti")
    if found.join(first, "key", "left_semi").groupBy("key").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["__key"])
    return kept.drop("__key")
