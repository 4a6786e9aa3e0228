"""Nearest neighbours: exact and by locality-sensitive hashing, majority vote, classifiers.

Inputs are tables with an id and a vector (array of numbers). Blocks of queries meet blocks of keys; a task
returns only the best k per query and block, so neither pairs nor a whole side is ever materialised.

A task holds one group of blocks of each side and compares them tile by tile: one matrix product per tile, and only pairs that come nearer than
the k-th best so far are looked at again. Each vector travels once per group of the other side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom import constants as K
from flowloom.plans.storage import discard, write_and_read

BLOCK_ROWS = 8192
BROADCAST_NUMBERS = 1 << 24
#: Keys up to so many numbers and rows travel through the driver; blocks of keys and queries are gathered into groups of so many rows,
#: of which a side has a few even when it is small; keys and pairs that are compared at once.
DRIVER_NUMBERS, DRIVER_ROWS = 1 << 20, 1 << 16
GROUP_ROWS, LEAST_GROUPS = 1 << 15, 6
TILE_KEYS, TILE = 1 << 10, 1 << 20
BUCKET_KEYS = 128
MOST_BITS = 16
#: Queries that the angle of neighbours is measured on, and hash tables beyond which an exact search copies less.
ANGLE_SAMPLE, MOST_TABLES = 64, 128
FOUND = "query_id {query}, key_id {key}, label {label}, distance double, rank int"

# Digits to which distances are compared, so that equal vectors tie.
DIGITS = {"cosine": 12, "euclidean": 10}


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def distances(queries: np.ndarray, keys: np.ndarray, metric: str = "cosine") -> np.ndarray:
    """Distances of every query to every key; infinite for cosine with a zero vector."""
    dots = queries @ keys.T
    if metric == "cosine":
        lengths = np.sqrt((queries ** 2).sum(axis=1))[:, None] * np.sqrt((keys ** 2).sum(axis=1))[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where(lengths > 0, 1 - dots / lengths, np.inf)
        return np.round(d, DIGITS[metric])
    if metric == "euclidean":
        squares = (queries ** 2).sum(axis=1)[:, None] + (keys ** 2).sum(axis=1)[None, :] - 2 * dots
        return np.sqrt(np.round(np.maximum(squares, 0), DIGITS[metric]))
    raise ValueError(f"unknown metric {metric!r}")


def _first(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k smallest of every row, ties to the lowest column; NaN is left out."""
    limit = min(k, d.shape[1])
    kth = np.partition(d, limit - 1, axis=1)[:, limit - 1:limit]  # NaN sorts last
    kth = np.where(np.isnan(kth), np.inf, kth)
    below, tied = d < kth, d == kth
    tied &= np.cumsum(tied, axis=1) <= limit - below.sum(axis=1, keepdims=True)
    return np.nonzero(below | tied)


class _Side:
    """Vectors of one side, so prepared that a matrix product gives a score that falls as the distance grows."""

    def __init__(self, vectors: np.ndarray, metric: str, keys: bool):
        self.vectors, self.squares = vectors, (vectors ** 2).sum(axis=1)
        if metric == "cosine":
            self.lengths = np.sqrt(self.squares)
            plain = (self.lengths > 1e-140) & (self.lengths < 1e140)
            self.scored = vectors / np.where(plain, self.lengths, 1)[:, None]
        else:
            plain = np.isfinite(self.squares)
            one = np.ones(len(vectors))
            self.scored = np.column_stack([vectors * 2, -self.squares, -one] if keys else [vectors, one, self.squares])
        #: zero, infinite and absent numbers, which a product would not rank
        self.odd = np.nonzero(~plain)[0]
        self.scored[self.odd] = 0
        if keys:
            self.scored = np.ascontiguousarray(self.scored.T)

    def odd_in(self, start: int, stop: int) -> np.ndarray:
        return self.odd[slice(*np.searchsorted(self.odd, (start, stop)))]


def _apart(queries: _Side, row: np.ndarray, keys: _Side, col: np.ndarray, metric: str) -> np.ndarray:
    """`distances` of single pairs."""
    dots = np.einsum("ij,ij->i", queries.vectors[row], keys.vectors[col])
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        if metric == "cosine":
            lengths = queries.lengths[row] * keys.lengths[col]
            return np.round(np.where(lengths > 0, 1 - dots / lengths, np.inf), DIGITS[metric])
        return np.sqrt(np.round(np.maximum(queries.squares[row] + keys.squares[col] - 2 * dots, 0), DIGITS[metric]))


def _best(query_ids, queries, key_ids, keys, labels, k: int, metric: str, skip_same: bool, block_rows: int = BLOCK_ROWS) -> pd.DataFrame:
    """The k nearest keys of every query, ties to the lowest key id; `at` is the query's place."""
    if metric not in DIGITS:
        raise ValueError(f"unknown metric {metric!r}")
    order = np.argsort(key_ids, kind="stable")
    key_ids, keys, labels = key_ids[order], keys[order], labels[order]
    width = keys.shape[1]
    if queries.shape[1] != width:
        raise ValueError(f"queries have {queries.shape[1]} numbers, keys {width}")
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        q, t = _Side(queries, metric, False), _Side(keys, metric, True)
    columns = max(1, min(block_rows, TILE_KEYS, len(keys)))
    step = max(1, TILE // columns)
    near, where = np.full((len(queries), k), np.inf), np.full((len(queries), k), -1, np.int64)
    half, room = 0.5 * 10.0 ** -DIGITS[metric], np.empty(step * columns)
    for at in range(0, len(queries), step):
        stop = min(at + step, len(queries))
        for first in range(0, len(keys), columns):
            last = min(first + columns, len(keys))
            lacking = where[at:stop, -1] < 0
            found = []
            if lacking.any():
                some = at + np.nonzero(lacking)[0]
                with np.errstate(invalid="ignore", over="ignore"):
                    d = distances(queries[some], keys[first:last], metric)
                if skip_same:
                    d[query_ids[some][:, None] == key_ids[None, first:last]] = np.nan
                row, col = _first(d, k)
                found.append((some[row], col + first))
            if not lacking.all():
                with np.errstate(invalid="ignore", over="ignore"):
                    score = np.matmul(q.scored[at:stop], t.scored[:, first:last], out=room[:(stop - at) * (last - first)].reshape(stop - at, last - first))
                    for i in q.odd_in(at, stop):
                        score[i - at] = _score(distances(queries[i:i + 1], keys[first:last], metric)[0], metric)
                    odd = t.odd_in(first, last)
                    if len(odd):
                        score[:, odd - first] = _score(distances(queries[at:stop], keys[odd], metric), metric)
                # a rounded distance is smaller only if the distance is so by half a unit; the rest allows for the product's own error
                error = 1e-15 * (width + 100) * (1 if metric == "cosine" else q.squares[at:stop] + t.squares[first:last].max())
                least = _score(near[at:stop, -1], metric) + np.where(np.isfinite(error), half - error, -np.inf)
                least = np.where(lacking, np.inf, np.where(np.isnan(least), -np.inf, least))[:, None]
                hit = score > least
                row, col = np.divmod(np.flatnonzero(hit), last - first)
                if len(row) > 4 * k * (stop - at):
                    row, col = _first(np.where(hit, np.round(-score, DIGITS[metric]), np.nan), k + 1 if skip_same else k)
                if len(row):
                    found.append((row + at, col + first))
            if found:
                row, col = (np.concatenate(c) for c in zip(*found))
                if skip_same:
                    keep = ~np.asarray(query_ids[row] == key_ids[col], bool)
                    row, col = row[keep], col[keep]
                _enter(near, where, row, col, _apart(q, row, t, col, metric))
    row, place = np.nonzero(where >= 0)
    col = where[row, place]
    return pd.DataFrame({"query_id": query_ids[row], "key_id": key_ids[col], "label": labels[col], "distance": near[row, place], "rank": place + 1, "at": row})


def _score(d: np.ndarray, metric: str) -> np.ndarray:
    return 1 - d if metric == "cosine" else -d * d


def _enter(near: np.ndarray, where: np.ndarray, row: np.ndarray, col: np.ndarray, d: np.ndarray) -> None:
    """New pairs enter the best lists of their queries; columns are later ones than those already there."""
    k = near.shape[1]
    known = ~np.isnan(d)
    touched = np.unique(row[known])
    row = np.concatenate([np.repeat(touched, k), row[known]])
    col = np.concatenate([where[touched].ravel(), col[known]])
    d = np.concatenate([near[touched].ravel(), d[known]])
    row, col, d = row[col >= 0], col[col >= 0], d[col >= 0]
    order = np.lexsort((col, d, row))
    row, col, d = row[order], col[order], d[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    near[row[keep], place[keep]], where[row[keep], place[keep]] = d[keep], col[keep]


def _ranked(found: DataFrame, k: int, query: list[str]) -> DataFrame:
    """The best k over all blocks; at most k rows per query and block arrive here."""
    along = Window.partitionBy(*query).orderBy("distance", "key_id")
    return _finite(found.withColumn("rank", F.row_number().over(along)).filter(F.col("rank") <= k))


def _finite(found: DataFrame) -> DataFrame:
    return found.withColumn("distance", F.when(F.col("distance") != float("inf"), F.col("distance")))


def _prepared(side: DataFrame, id_col: str, vector: str, label: str | None = None) -> DataFrame:
    values = vector_to_array(F.col(vector)) if isinstance(side.schema[vector].dataType, VectorUDT) else F.col(vector)
    columns = [F.col(id_col).alias("id"), values.cast("array<double>").alias("v")]
    if label is not None:
        columns.append(F.col(label).alias("label"))
    return side.select(*columns)


def _schema(queries: DataFrame, keys: DataFrame) -> str:
    """Ids keep their types; numbers are whole ones."""
    kinds = {"query": queries.schema["id"].dataType, "key": keys.schema["id"].dataType, "label": keys.schema["label"].dataType}
    return FOUND.format(**{name: kind.simpleString() for name, kind in kinds.items()})


def nearest(
    queries: DataFrame, keys: DataFrame, k: int = 1, metric: str = "cosine", query_id: str = "id", key_id: str = "id",
    vector: str = "features", label: str | None = None, skip_same: bool = False,
    block_rows: int = BLOCK_ROWS, broadcast_numbers: int = BROADCAST_NUMBERS,
) -> DataFrame:
    """Exact k nearest keys of every query: (query_id, key_id, label, distance, rank).

    Few keys, as checked, travel to the tasks once. Otherwise both sides are dealt into groups of blocks by id hash and
    every pair of groups is one task-sized piece of work, compared block by block.
    Of keys up to `broadcast_numbers` every row of `queries` finds k, beyond that every query id.
    """
    q = _prepared(queries, query_id, vector)
    t = _prepared(keys, key_id, vector, label)
    if label is None:
        t = t.withColumn("label", F.lit(None).cast("int"))
    schema = _schema(q, t)
    size = t.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("numbers")).first()
    if size["n"] == 0:
        return q.sparkSession.createDataFrame([], schema)
    if size["numbers"] <= min(broadcast_numbers, DRIVER_NUMBERS) and size["n"] <= DRIVER_ROWS:
        local = t.toPandas()  # size checked above
        context = q.sparkSession.sparkContext
        shared = context.broadcast((local["id"].to_numpy(), _matrix(local["v"]), local["label"].to_numpy()))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, vectors, labels = shared.value
            for batch in batches:
                if len(batch):
                    yield _best(batch["id"].to_numpy(), _matrix(batch["v"]), ids, vectors, labels, k, metric, skip_same, block_rows).drop(columns="at")

        # every batch sees all keys, so its ranks are final; a small table may come in one partition
        return _finite(q.repartition(context.defaultParallelism).mapInPandas(search, schema))
    groups = lambda n: max(1, math.ceil(n / max(block_rows, GROUP_ROWS)), min(math.ceil(n / block_rows), LEAST_GROUPS))
    key_groups, query_groups = groups(size["n"]), groups(q.count())
    q = q.withColumn("row", F.monotonically_increasing_id()).withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(query_groups))).withColumn(
        "kb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(key_groups - 1).cast("long"))))
    t = t.withColumn("kb", F.pmod(F.xxhash64("id"), F.lit(key_groups))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_groups - 1).cast("long"))))
    found = _block_search(q, t, ["qb", "kb"], k, metric, skip_same, schema, block_rows)
    return _ranked(found, k, ["query_id", "row"] if size["numbers"] <= broadcast_numbers else ["query_id"]).drop("row")


def _block_search(
    q: DataFrame, t: DataFrame, group: list[str], k: int, metric: str, skip_same: bool, schema: str, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The best of every group; where `q` has a `row`, it is told."""
    rows = "row" in q.columns

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({name: np.zeros(0, object) for name in ("query_id", "key_id", "label", "distance", "rank") + (("row",) if rows else ())})
        found = _best(left["id"].to_numpy(), _matrix(left["v"]), right["id"].to_numpy(), _matrix(right["v"]),
                      right["label"].to_numpy(), k, metric, skip_same, block_rows)
        return found.assign(row=left["row"].to_numpy()[found["at"]]).drop(columns="at") if rows else found.drop(columns="at")

    return q.groupBy(*group).cogroup(t.groupBy(*group)).applyInPandas(search, schema + (", row long" if rows else ""))


def _hashed(side: DataFrame, planes, epsilon: float, tasks: int) -> DataFrame:
    """`side` with `codes`, (table, code) pairs of a vector: sign bits of its projections, bits closer to 0 than epsilon tried both ways; and
    `own`, the codes of all tables in a row without those tries. The work is dealt out whatever the size of the files."""
    names = side.columns
    kinds = ", ".join(f"`{name}` {side.schema[name].dataType.simpleString()}" for name in names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, bits, matrix = planes.value
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column("v").to_pandas())
            length = np.sqrt((unit ** 2).sum(axis=1, keepdims=True))
            projected = ((unit / np.where(length > 0, length, 1)) @ matrix).reshape(len(unit), tables, bits)
            own = ((projected > 0) * weights).sum(axis=2)
            row, tab, bit = np.nonzero(np.abs(projected) < epsilon)
            every, code = np.tile(np.arange(tables), len(unit)), own.ravel()
            ends = np.arange(len(unit) + 1) * tables
            if len(row):
                order = np.argsort(np.concatenate([np.repeat(np.arange(len(unit)), tables), row]), kind="stable")
                every, code = np.concatenate([every, tab])[order], np.concatenate([code, own[row, tab] ^ weights[bit]])[order]
                ends[1:] += np.cumsum(np.bincount(row, minlength=len(unit)))
            pairs = pa.StructArray.from_arrays([pa.array(every, pa.int32()), pa.array(code, pa.int64())], ["tab", "code"])
            codes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            packed = pa.array([line.tobytes() for line in own.astype(_code_type(bits))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, codes, packed], [*names, "codes", "own"])

    return side.repartition(tasks).mapInArrow(search, f"{kinds}, codes array<struct<tab:int,code:long>>, own binary")


def _code_type(bits: int) -> type:
    return np.uint16 if bits <= 16 else np.int64


def _dealt_codes(side: DataFrame) -> DataFrame:
    """A row for each code of a vector."""
    return side.withColumn("c", F.explode("codes")).select(*[c for c in side.columns if c != "codes"], "c.tab", "c.code")


def _planes(t: DataFrame, tables: int, bits: int, seed: int):
    width = t.select(F.size("v").alias("n")).first()["n"]
    matrix = np.random.default_rng(seed).normal(size=(width, tables * bits))
    return t.sparkSession.sparkContext.broadcast((tables, bits, matrix))


def lsh_candidates(q: DataFrame, t: DataFrame, tables: int, bits: int, seed: int, epsilon: float) -> tuple[DataFrame, DataFrame]:
    """Both sides once per hash table, with (tab, code)."""
    planes, tasks = _planes(t, tables, bits, seed), t.sparkSession.sparkContext.defaultParallelism
    return tuple(_dealt_codes(_hashed(side, planes, eps, tasks)).drop("own") for side, eps in ((q, epsilon), (t, 0.0)))


def _unmet(left: np.ndarray, right: np.ndarray, tab: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of queries and keys that are to be compared in a bucket of this table; `left` and `right` are their codes in all tables.

    Of many pairs that have shared a code in an earlier table, and so have been compared there, most are left out; every other pair is in exactly one part.
    """
    parts = [(np.arange(len(left)), np.arange(len(right)), 0)]
    while parts:
        q, t, at = parts.pop()
        while at < tab and len(q) * len(t) > TILE:
            mine, theirs = left[q, at], right[t, at]
            at += 1
            code, asked = np.unique(mine, return_counts=True)
            held = np.searchsorted(np.sort(theirs), code, "right") - np.searchsorted(np.sort(theirs), code)
            many = code[asked * held > TILE]
            for one in many:
                parts.append((q[mine == one], t[theirs != one], at))
            if len(many):
                q = q[~np.isin(mine, many)]
        if len(q) and len(t):
            yield q, t


def nearest_lsh(
    queries: DataFrame, keys: DataFrame, k: int = 1, query_id: str = "id", key_id: str = "id", vector: str = "features",
    label: str | None = None, skip_same: bool = False, tables: int | None = None, bits: int | None = None,
    search_epsilon: float = 0.0, seed: int = K.RANDOM_SEED, block_rows: int = BLOCK_ROWS, recall_target: float = 0.995,
    near_angle: float | None = 20.0,
) -> DataFrame:
    """Approximate cosine neighbours: keys that share a hash code in some table, ranked by exact distance.

    Without `bits` the code length grows with the number of keys up to `MOST_BITS`, so that buckets keep their size. Without
    `tables` there are as many as find a neighbour within `near_angle` degrees with probability `recall_target`, whatever the bits.
    With `near_angle=None` it is the largest angle of a k-th neighbour over `ANGLE_SAMPLE` queries that are searched exactly; where that
    asks for more than `MOST_TABLES` tables, all queries are.

    A bucket of any size is searched: it is cut into blocks of keys and of queries, and each block pair returns k rows
    per query. Queries that find fewer than k candidates are searched exactly.
    """
    q = _prepared(queries, query_id, vector)
    t = _prepared(keys, key_id, vector, label)
    if label is None:
        t = t.withColumn("label", F.lit(None).cast("int"))
    schema, n_keys = _schema(q, t), t.count()
    if n_keys == 0:
        return q.sparkSession.createDataFrame([], schema)
    if bits is None:
        bits = min(MOST_BITS, max(4, math.ceil(math.log2(n_keys / BUCKET_KEYS + 1))))
    if tables is None:
        if near_angle is None:
            near_angle = measured_angle(q, t, k, skip_same)
            if tables_for(bits, recall_target, near_angle) > MOST_TABLES:
                return nearest(q, t, k, vector="v", label="label", skip_same=skip_same)
        tables = tables_for(bits, recall_target, near_angle)
    planes, context = _planes(t, tables, bits, seed), q.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, math.ceil(n_keys / GROUP_ROWS))
    stored_q, stored_t = (write_and_read(_hashed(side, planes, eps, tasks), "hashed") for side, eps in ((q, search_epsilon), (t, 0.0)))
    hashed_q, hashed_t = _dealt_codes(stored_q), _dealt_codes(stored_t)
    # only large buckets are cut, so only these are looked up
    parts = lambda side, name: side.groupBy("tab", "code").agg(F.ceil(F.count("*") / F.lit(max(block_rows, GROUP_ROWS))).cast("long").alias(name))
    large = parts(hashed_q, "q_parts").join(parts(hashed_t, "k_parts").hint("merge"), ["tab", "code"], "inner").where("q_parts > 1 or k_parts > 1")
    large = write_and_read(large, "buckets")
    large = F.broadcast(large) if large.count() <= DRIVER_ROWS else large.hint("merge")
    block = lambda n: F.pmod(F.xxhash64("id"), F.coalesce(n, F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)) - 1))
    left = hashed_q.join(large, ["tab", "code"], "left").withColumn("qb", block("q_parts")).withColumn("kb", every("k_parts"))
    right = hashed_t.join(large, ["tab", "code"], "left").withColumn("kb", block("k_parts")).withColumn("qb", every("q_parts"))
    group = ["tab", "code", "qb", "kb"]
    kind = _code_type(bits)

    def search(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(mine) and len(theirs):
            query_ids, queries, key_ids, keys, labels = mine["id"].to_numpy(), _matrix(mine["v"]), theirs["id"].to_numpy(), _matrix(theirs["v"]), theirs["label"].to_numpy()
            codes = [np.frombuffer(b"".join(side["own"]), kind).reshape(len(side), -1) for side in (mine, theirs)]
            for a, b in _unmet(*codes, int(mine["tab"].iloc[0])):
                part = _best(query_ids[a], queries[a], key_ids[b], keys[b], labels[b], k, "cosine", skip_same, block_rows)
                found += [part] if len(part) else []
        names = ("query_id", "key_id", "label", "distance", "rank")
        return pd.DataFrame({name: np.concatenate([part[name].to_numpy() for part in found]) if found else np.zeros(0, object) for name in names})

    # buckets are small in bytes and long in work, so their tasks are not to be put together
    tasks = max(2 * context.defaultParallelism, math.ceil(n_keys * tables / DRIVER_ROWS))
    sides = [side.repartition(tasks, *group).groupBy(*group) for side in (left.select("id", "v", "own", *group), right.select("id", "v", "label", "own", *group))]
    found = sides[0].cogroup(sides[1]).applyInPandas(search, schema)
    # the same pair from several tables has one dense rank; both steps need the rows by query only, so they share a shuffle
    along = Window.partitionBy("query_id").orderBy("distance", "key_id")
    best = found.withColumn("rank", F.dense_rank().over(along)).filter(F.col("rank") <= k)
    found = write_and_read(_finite(best.dropDuplicates(["query_id", "key_id"])), "lsh")
    discard(stored_q, stored_t)
    # ids grow with the queries, whatever their files weigh: they are not sent through the driver
    complete = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("query_id").hint("merge")
    short = write_and_read(q.join(complete, q["id"] == complete["query_id"], "left_anti"), "short")
    if short.isEmpty():
        return found
    exact = nearest(short.withColumnRenamed("v", "features"), t.withColumnRenamed("v", "features"), k, "cosine",
                    label="label", skip_same=skip_same)
    return found.join(complete, "query_id", "left_semi").select(*exact.columns).unionByName(exact)


def measured_angle(q: DataFrame, t: DataFrame, k: int, skip_same: bool) -> float:
    """The largest angle between a query and its k-th key, over a sample of queries; 0 if there is none."""
    sample = q.orderBy(F.xxhash64("id"), "id").limit(ANGLE_SAMPLE)
    found = nearest(sample, t, k, vector="v", label="label", skip_same=skip_same)
    distance = found.agg(F.max("distance")).first()[0] or 0.0
    return math.degrees(math.acos(max(-1.0, min(1.0, 1 - distance))))


def tables_for(bits: int, recall_target: float, near_angle: float) -> int:
    """Hash tables after which a vector at the given angle has shared a code of so many bits with the wanted probability."""
    same = (1 - near_angle / 180) ** bits
    if same in (0.0, 1.0):
        return 1 if same else MOST_TABLES + 1
    return max(1, math.ceil(math.log(1 - recall_target) / math.log(1 - same)))


def candidate_pairs(queries: DataFrame, keys: DataFrame, query_id: str = "id", key_id: str = "id", vector: str = "features",
                    tables: int = 8, bits: int = 10, search_epsilon: float = 0.0, seed: int = K.RANDOM_SEED) -> DataFrame:
    """How many comparisons the hash tables ask for, next to all pairs."""
    q, t = _prepared(queries, query_id, vector), _prepared(keys, key_id, vector)
    hq, ht = lsh_candidates(q, t, tables, bits, seed, search_epsilon)
    size = lambda side, n: side.groupBy("tab", "code").agg(F.count("*").alias(n))
    pairs = size(hq, "a").join(size(ht, "b"), ["tab", "code"]).agg(F.sum(F.col("a") * F.col("b")).alias("compared"))
    return pairs.select(F.coalesce("compared", F.lit(0)).alias("compared"),
                        (F.lit(q.count()) * F.lit(t.count())).alias("all_pairs"))


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found."""
    hit = approximate.select("query_id", "key_id", F.lit(1).alias("hit"))
    return exact.join(hit.hint("merge"), ["query_id", "key_id"], "left").agg((F.count("hit") / F.count("*")).alias("recall"))


def vote(neighbours: DataFrame) -> DataFrame:
    """Most frequent label per query; a tie goes to the label met first."""
    votes = neighbours.groupBy("query_id", "label").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    return votes.groupBy("query_id").agg(F.min(F.struct(-F.col("n"), F.col("first"), F.col("label").alias("label"))).alias("w")).select(
        "query_id", F.col("w.label").alias("prediction"))


class _NeighbourParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    nNeighbors = Param(Params._dummy(), "nNeighbors", "neighbours that vote", TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "unique row id of any type", TypeConverters.toString)
    method = Param(Params._dummy(), "method", "cosine, euclidean, lsh or graph", TypeConverters.toString)
    tables = Param(Params._dummy(), "tables", "hash tables; 0 takes as many as the recall target needs", TypeConverters.toInt)
    bits = Param(Params._dummy(), "bits", "sign bits per table; 0 takes them from the number of keys", TypeConverters.toInt)
    searchEpsilon = Param(Params._dummy(), "searchEpsilon", "margin within which bits are tried both ways (lsh) or by which walks reach beyond the k-th best (graph)", TypeConverters.toFloat)


class NeighbourClassifier(Estimator, _NeighbourParams):
    """k nearest neighbours with majority vote as an estimator."""

    @keyword_only
    def __init__(self, *, nNeighbors=3, idCol="flow_id", method="cosine", tables=0, bits=0, searchEpsilon=0.0,
                 featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._setDefault(nNeighbors=3, idCol="flow_id", method="cosine", tables=0, bits=0, searchEpsilon=0.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "NeighbourModel":
        keys = dataset.select(self.getOrDefault("idCol"), self.getFeaturesCol(), self.getLabelCol())
        return self._copyValues(NeighbourModel(keys))


class NeighbourModel(Model, _NeighbourParams):
    def __init__(self, keys: DataFrame | None = None):
        super().__init__()
        self.keys, self.graph = keys, None

    def neighbours(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        common = dict(k=get("nNeighbors"), query_id=get("idCol"), key_id=get("idCol"), vector=self.getFeaturesCol(),
                      label=self.getLabelCol())
        if get("method") == "lsh":
            return nearest_lsh(dataset, self.keys, tables=get("tables") or None, bits=get("bits") or None,
                               search_epsilon=get("searchEpsilon"), **common)
        if get("method") == "graph":
            from flowloom.operators import neighbour_graph  # it builds on this module

            if self.graph is None:
                self.graph = neighbour_graph.build(self.keys, get("idCol"), self.getFeaturesCol(), self.getLabelCol())
            return neighbour_graph.search(self.graph, dataset, get("nNeighbors"), get("idCol"), self.getFeaturesCol(), search_epsilon=get("searchEpsilon") or None)
        return nearest(dataset, self.keys, metric=get("method"), **common)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        voted = vote(self.neighbours(dataset)).withColumnRenamed("prediction", self.getPredictionCol())
        return dataset.join(voted.hint("merge"), dataset[self.getOrDefault("idCol")] == voted["query_id"], "left").drop("query_id")
