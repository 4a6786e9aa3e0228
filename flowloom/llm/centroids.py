"""Centroid clustering with Ptolemaic pivots.

Vectors are whole numbers, distances exact. For four points of a Euclidean space Ptolemy's inequality says |d(v,p) d(c,s) - d(v,s) d(c,p)| <= d(v,c) d(p,s). A few
pivots are fixed before the first round and every vector keeps its distances to them. In a round the centroids' distances to the pivots are computed once, and each pair of
pivots then gives a lower bound of every distance from vector to centroid without looking at the components. Bounds are rounded down by more than
floating point can err. The centroid with the least bound is measured exactly; of the others only those whose bound does not exceed that distance are, so the
nearest centroid, and among equally near ones the smallest number, is always found.

Spark deals the vectors out; a task adds up its clusters before anything is shuffled, and a round sends K sums per task, so a vector that a third of all rows repeat is
nothing special. Centroids are parameters of the model: K vectors on the driver and in the tasks.

Rows: vectors of other than `size` components, with an absent or non-finite one, or absent themselves are left out. Rows that repeat a vec_id are points of their own. A null vec_id is kept but begins a centroid only when ids run
out. With fewer than K vectors there are fewer centroids; an empty table gives an empty result. Equal start vectors give equal centroids, of which the smallest number takes
all and the others stay as they are. Components of 2 ** 19 and more do not fit exact sums and are an error. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.plans.storage import write_and_read


@dataclass(frozen=True)
class Clusters:
    """K centroids in `rounds` rounds over vectors of `size` components, each turned into floor(scale * x)."""

    k: int = 40
    rounds: int = 5
    size: int = 64
    scale: int = 256
    seed: int = 2
    pivots: int = 8


#: Far above the relative error of the few operations that a bound takes.
SLACK = 1e-12
_MOST = 1 << 27
_TILE = 1 << 14


def whole_vectors(vectors: DataFrame, config: Clusters = Clusters()) -> DataFrame:
    """(vec_id, v) of all usable vectors."""
    exact = F.transform("embedding", lambda x: F.lit(float(config.scale)) * x.cast("double"))
    usable = (F.size("embedding") == config.size) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    fits = lambda x: F.when(F.abs(x) < _MOST, F.floor(x).cast("int")).otherwise(F.raise_error(F.lit("a component is too large")).cast("int"))
    return vectors.where(usable).select("vec_id", F.transform(exact, fits).alias("v"))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows of the same shape."""
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def choose_pivots(start: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` different start vectors, each the one farthest from those before."""
    chosen = [0] if len(start) else []
    near = np.full(len(start), np.iinfo(np.int64).max)
    while chosen and len(chosen) < count:
        near = np.minimum(near, squared(start, start[chosen[-1]][None]))
        if not near.max():
            break
        chosen.append(int(near.argmax()))
    return start[chosen]


def pivot_distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(points, p[None]) for p in pivots], axis=1).astype(np.float64))


def lower_bounds(cached: np.ndarray, own: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Bounds below the squared distance of each point to each centroid, from both sides' distances to the pivots."""
    best = np.zeros((len(cached), len(own)))
    for s in range(1, len(pivots)):
        for p in range(s):
            x, y = cached[:, p, None] * own[None, :, s], cached[:, s, None] * own[None, :, p]
            between = float(np.sqrt(float(squared(pivots[p][None], pivots[s][None])[0])))
            np.maximum(best, (np.abs(x - y) - SLACK * (x + y)) / between, out=best)
    return best * best * (1 - SLACK)


def nearest(points: np.ndarray, cached: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, exact squared distance, exact comparisons made) of each point."""
    bounds = lower_bounds(cached, pivot_distances(centroids, pivots), pivots)
    first = bounds.argmin(axis=1)
    reach = squared(points, centroids[first])
    left = bounds <= reach[:, None]
    left[np.arange(len(points)), first] = True
    rows, columns = np.nonzero(left)
    exact = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), _TILE):
        part = slice(at, at + _TILE)
        exact[part] = squared(points[rows[part]], centroids[columns[part]])
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    least = np.minimum.reduceat(exact, starts)
    hits = np.flatnonzero(exact == np.repeat(least, np.diff(starts, append=len(rows))))
    hits = hits[np.diff(rows[hits], prepend=-1) > 0]  # columns ascend, so the first hit of a row is its smallest number
    return columns[hits], least, len(rows)


def _points(batch: pa.RecordBatch, size: int, column: str = "v") -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


@dataclass(frozen=True)
class Fitted:
    config: Clusters
    #: (vec_id, v, cached): the usable vectors with their distances to the pivots, stored.
    vectors: DataFrame
    pivots: np.ndarray
    centroids: np.ndarray


def _with_cached(vectors: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pivot_distances(_points(batch, size).astype(np.int64), pivots) if batch.num_rows else np.zeros((0, len(pivots)))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(pivots)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["vec_id", "v", "cached"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(add, f"vec_id {kind}, v array<int>, cached array<double>")


def _sums(fitted: Fitted) -> list:
    """(cluster, n, sums of its components) of every cluster that has a vector; at most K rows."""
    k, size, centroids, pivots = len(fitted.centroids), fitted.config.size, fitted.centroids, fitted.pivots

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            if batch.num_rows:
                points = _points(batch, size).astype(np.int64)
                cluster, _, _ = nearest(points, _points(batch, len(pivots), "cached"), centroids, pivots)
                counts += np.bincount(cluster, minlength=k)
                for c in np.unique(cluster):
                    sums[c] += points[cluster == c].sum(axis=0)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array(counts[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"]
        )

    parts = fitted.vectors.select("v", "cached").mapInArrow(add_up, "cluster int, n long, sums array<long>")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(size)]).alias("sums"))
    return totals.collect()  # one row per centroid


def fit(vectors: DataFrame, config: Clusters = Clusters()) -> Fitted:
    """Start vectors by the hash of their ids, then `rounds` rounds of assignment and exact means."""
    usable = whole_vectors(vectors, config)
    order = F.sha2(F.concat(F.lit(f"{config.seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    start = usable.orderBy(order.asc_nulls_last(), "v").limit(config.k).select("v").collect()  # at most K vectors
    centroids = np.array([r.v for r in start], np.int64).reshape(-1, config.size)
    pivots = choose_pivots(centroids, config.pivots)
    if not len(centroids):
        return Fitted(config, usable.withColumn("cached", F.array().cast("array<double>")), pivots, centroids)
    stored = write_and_read(_with_cached(usable, pivots, config.size), "centroid-vectors")
    for _ in range(config.rounds):
        moved = centroids.copy()
        for row in _sums(Fitted(config, stored, pivots, centroids)):
            moved[row.cluster] = [total // row.n for total in row.sums]
        centroids = moved
    return Fitted(config, stored, pivots, centroids)


def assign(fitted: Fitted) -> DataFrame:
    """(vec_id, cluster, distance, compared): the nearest centroid of every vector and how many were measured exactly."""
    kind = fitted.vectors.schema["vec_id"].dataType.simpleString()
    size, centroids, pivots = fitted.config.size, fitted.centroids, fitted.pivots

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance, n = nearest(_points(batch, size).astype(np.int64), _points(batch, len(pivots), "cached"), centroids, pivots)
                share = pa.array(np.full(batch.num_rows, n / batch.num_rows))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance), share], names=["vec_id", "cluster", "distance", "compared"])

    return fitted.vectors.mapInArrow(of, f"vec_id {kind}, cluster int, distance long, compared double")


def cluster(vectors: DataFrame, config: Clusters = Clusters()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared for every usable vector."""
    fitted = fit(vectors, config)
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in fitted.centroids.tolist()]
    assigned = write_and_read(assign(fitted), "centroid-clusters")
    held = dict(assigned.groupBy("cluster").agg(F.sum("distance")).collect())  # one row per centroid
    by_number = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))
    return assigned.select(
        "vec_id", "cluster", "distance", by_number([held.get(i, 0) for i in range(len(names))], "long").alias("cluster_inertia"),
        F.lit(sum(held.values())).cast("long").alias("inertia"), by_number(names, "string").alias("centroid_sha256"), "compared",
    )
