"""Packets to codebook entries and back."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowloom import constants as K
from flowloom.functions import scaling as Z
from flowloom.operators.packets import present_packets
from flowloom.plans.storage import discard, write_and_read

CODEBOOK_SCHEMA = "cluster_id int, c_ps double, c_ipt double"
MAX_CODEBOOK = 1 << 20
INLINE_CODEBOOK = 64
#: Candidates that a round of seeding draws, as a share of the wanted centres.
SEEDS_PER_ROUND = 0.5
#: Points and centres that a search compares at once, and how often the cells beyond the outermost centres double.
COMPARED, RINGS = 1 << 20, 12


def scale_packets(series: DataFrame) -> DataFrame:
    return series.withColumn("s_ps", Z.scaled_ps(F.col("ps"))).withColumn("s_ipt", Z.scaled_ipt(F.col("ipt")))


def unscale_packets(scaled: DataFrame) -> DataFrame:
    return scaled.withColumn("ps", Z.unscaled_ps(F.col("s_ps"))).withColumn("ipt", Z.unscaled_ipt(F.col("s_ipt")))


class _CellIndex:
    """For every cell of a grid over the scaled plane, the centres that can be nearest to some point of the cell.

    A centre is kept for a cell when its smallest distance to the cell does not exceed the smallest of all centres'
    largest distances, so the nearest centre of any point in the cell is always among those kept.

    The outermost centres lie on edges. Beyond them cells begin narrow and double outwards, since a wide cell keeps nearly all
    centres and many points lie on the edge or a little beyond. A search compares at most `COMPARED` points and centres at once.
    """

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        side = int(np.clip(np.ceil(np.sqrt(len(centres))), 1, 128))
        self.edges = [self._edges(centres[:, axis], side) for axis in (0, 1)]
        spans = [self._spans(centres[:, axis], self.edges[axis]) for axis in (0, 1)]
        kept, counts = [], []
        for near_x, far_x in zip(*spans[0]):
            near = near_x[None, :] ** 2 + spans[1][0] ** 2
            far = far_x[None, :] ** 2 + spans[1][1] ** 2
            mask = near <= far.min(axis=1, keepdims=True) * (1 + 1e-9) + 1e-12
            kept.append(np.nonzero(mask)[1].astype(np.int32))
            counts.append(mask.sum(axis=1))
        self.kept = np.concatenate(kept)
        self.starts = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)

    @staticmethod
    def _edges(values: np.ndarray, side: int) -> np.ndarray:
        margin = max(float(np.ptp(values)), 1.0)
        rings = margin / 2.0 ** np.arange(RINGS)
        return np.unique(np.concatenate([values.min() - rings, np.quantile(values, np.linspace(0, 1, side + 1)), values.max() + rings]))

    @staticmethod
    def _spans(values: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = edges[:-1, None], edges[1:, None]
        near = np.maximum(np.maximum(low - values, values - high), 0)
        return near, np.maximum(np.abs(low - values), np.abs(high - values))

    def nearest(self, points: np.ndarray) -> np.ndarray:
        """Lowest id among the nearest centres of every point."""
        out = np.full(len(points), K.NO_PACKET, dtype=np.int32)
        place = [np.searchsorted(self.edges[a], points[:, a], side="right") - 1 for a in (0, 1)]
        known = np.isfinite(points).all(axis=1)
        inside = known.copy()
        for axis in (0, 1):
            inside &= (place[axis] >= 0) & (place[axis] < len(self.edges[axis]) - 1)
        cells = place[0] * (len(self.edges[1]) - 1) + place[1]
        rows = np.nonzero(inside)[0]
        asked = np.cumsum(self.starts[cells[rows] + 1] - self.starts[cells[rows]])
        parts = asked // COMPARED
        for part in np.split(rows, np.nonzero(np.diff(parts))[0] + 1):
            if len(part):
                self._search_cells(points, part, cells[part], out)
        beyond = np.nonzero(known & ~inside)[0]
        for rows in np.array_split(beyond, max(1, math.ceil(len(beyond) * len(self.centres) / COMPARED))):
            if len(rows):
                diff = points[rows][:, None, :] - self.centres[None, :, :]
                out[rows] = (diff ** 2).sum(axis=2).argmin(axis=1)
        return out

    def _search_cells(self, points: np.ndarray, rows: np.ndarray, cells: np.ndarray, out: np.ndarray) -> None:
        counts = self.starts[cells + 1] - self.starts[cells]
        heads = np.concatenate([[0], np.cumsum(counts)[:-1]])
        take = np.repeat(self.starts[cells] - heads, counts) + np.arange(counts.sum())
        ids = self.kept[take]
        diff = np.repeat(points[rows], counts, axis=0) - self.centres[ids]
        distance = diff[:, 0] ** 2 + diff[:, 1] ** 2
        best = np.repeat(np.minimum.reduceat(distance, heads), counts)
        ids = np.where(distance == best, ids, np.iinfo(np.int32).max)
        out[rows] = np.minimum.reduceat(ids, heads)


class Codebook:
    """Cluster centres in scaled units. Their number is a model parameter, so they may be broadcast.

    Up to 64 centres become plain column expressions; larger codebooks use a cell index inside Arrow batches.
    """

    def __init__(self, spark: SparkSession, centres: np.ndarray):
        centres = np.asarray(centres, dtype=float)
        centres = centres[np.isfinite(centres).all(axis=1)]
        if not 0 < len(centres) <= MAX_CODEBOOK:
            raise ValueError(f"a codebook holds 1 to {MAX_CODEBOOK} centres, got {len(centres)}")
        self.spark, self.centres, self.size = spark, centres, len(centres)
        self._index = None

    @classmethod
    def from_table(cls, table: DataFrame) -> "Codebook":
        rows = table.select("cluster_id", "c_ps", "c_ipt").limit(MAX_CODEBOOK + 1).collect()
        rows = sorted(rows, key=lambda r: r["cluster_id"])
        return cls(table.sparkSession, np.array([[r["c_ps"], r["c_ipt"]] for r in rows], dtype=float))

    def table(self) -> DataFrame:
        rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(self.centres)]
        return self.spark.createDataFrame(rows, CODEBOOK_SCHEMA)

    def save(self, path: str) -> None:
        self.table().coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Codebook":
        return cls.from_table(spark.read.parquet(path))

    def _literal(self) -> Column:
        return F.array(*[
            F.struct(F.lit(i).alias("id"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
            for i, (x, y) in enumerate(self.centres)
        ])

    def _searcher(self):
        if self._index is None:
            self._index = self.spark.sparkContext.broadcast(_CellIndex(self.centres))
        return self._index

    def _closest(self, x: Column, y: Column) -> Column:
        """Nearest of the literal centres; NULL and NaN distances never win over the check in `_inline`."""
        ranked = F.transform(self._literal(), lambda c: F.struct(
            ((x - c["x"]) * (x - c["x"]) + (y - c["y"]) * (y - c["y"])).alias("d"), c["id"].alias("id")))
        return F.array_min(ranked)["id"]

    def _inline(self, x: Column, y: Column) -> Column:
        known = F.abs(x) + F.abs(y) < float("inf")
        return F.when(known, self._closest(x, y)).otherwise(F.lit(K.NO_PACKET)).cast("int")

    def encode(self, ps: Column, ipt: Column) -> Column:
        """Nearest centre of a packet, ties to the lowest id; -1 where size or gap is absent or infinite."""
        x, y = Z.scaled_ps(ps), Z.scaled_ipt(ipt)
        if self.size <= INLINE_CODEBOOK:
            return self._inline(x, y)
        index = self._searcher()

        @F.pandas_udf("int")
        def nearest(xs: pd.Series, ys: pd.Series) -> pd.Series:
            return pd.Series(index.value.nearest(np.column_stack([xs.to_numpy(float), ys.to_numpy(float)])))

        return nearest(x, y)

    def encode_flow(self, packets: Column) -> Column:
        """Ids of a flow's packet array, in order; the array stays in its row, so nothing is shuffled."""
        if self.size <= INLINE_CODEBOOK:
            scaled = F.transform(packets, lambda p: F.struct(
                Z.scaled_ps(p["ps"]).alias("x"), Z.scaled_ipt(p["ipt"]).alias("y")))
            return F.transform(scaled, lambda s: self._inline(s["x"], s["y"]))
        index = self._searcher()

        @F.pandas_udf("array<int>")
        def nearest(xs: pd.Series, ys: pd.Series) -> pd.Series:
            there = xs.notna()  # an absent array stays absent
            out = pd.Series([None] * len(xs), index=xs.index, dtype=object)
            if there.any():
                flat = [np.concatenate([np.asarray(a, dtype=float) for a in s[there]]) for s in (xs, ys)]
                parts = np.split(index.value.nearest(np.column_stack(flat)), np.cumsum(xs[there].map(len).to_numpy())[:-1])
                out[there] = pd.Series(parts, index=out.index[there], dtype=object)
            return out

        return nearest(
            F.transform(packets, lambda p: Z.scaled_ps(p["ps"])), F.transform(packets, lambda p: Z.scaled_ipt(p["ipt"])))

    def decode(self, series: DataFrame, column: str = "cluster_id") -> DataFrame:
        """Add `ps` and `ipt` of the id's centre; -1 gives NULLs, ids beyond the codebook the first centre."""
        safe = F.when(F.col(column) >= self.size, 0).otherwise(F.col(column))
        table = F.broadcast(self.table().withColumnRenamed("cluster_id", "__id"))
        return series.join(table, safe == F.col("__id"), "left").select(
            *series.columns, Z.unscaled_ps(F.col("c_ps")).alias("ps"), Z.unscaled_ipt(F.col("c_ipt")).alias("ipt"))

    def decode_flow(self, ids: Column) -> Column:
        """Packet array of an id array; an absent packet is a NULL pair."""
        pair = "array<struct<ps:double,ipt:double>>"
        if self.size <= INLINE_CODEBOOK:
            pairs = F.array(*[F.struct(Z.unscaled_ps(F.lit(float(x))).alias("ps"), Z.unscaled_ipt(F.lit(float(y))).alias("ipt"))
                              for x, y in self.centres])
            return F.transform(ids, lambda i: F.when(i != K.NO_PACKET, F.element_at(
                pairs, F.when((i >= self.size) | (i < 0), 1).otherwise(i + 1)))).cast(pair)
        centres = self.spark.sparkContext.broadcast(self.centres)

        @F.pandas_udf("struct<x:array<double>,y:array<double>>")
        def scaled(rows: pd.Series) -> pd.DataFrame:
            def pick(a, axis):
                if a is None:
                    return None
                a = np.asarray(a, dtype=np.int64)
                safe = np.where((a < 0) | (a >= len(centres.value)), 0, a)
                return np.where(a == K.NO_PACKET, np.nan, centres.value[safe, axis])

            return pd.DataFrame({"x": [pick(a, 0) for a in rows], "y": [pick(a, 1) for a in rows]})

        pairs = scaled(ids)
        return F.zip_with(pairs["x"], pairs["y"], lambda x, y: F.when(x.isNotNull() & ~F.isnan(x), F.struct(
            Z.unscaled_ps(x).alias("ps"), Z.unscaled_ipt(y).alias("ipt")))).cast(pair)


def _weighted(series: DataFrame, flow: Sequence[str] | None) -> DataFrame:
    """(x, y, w): every distinct scaled packet and how often it occurs; repeated packets are counted before the shuffle."""
    present = present_packets(series)
    if flow is not None:
        several = present.filter("pos = 1").select(*flow).distinct()
        present = present.join(several, list(flow), "left_semi")
    scaled = scale_packets(present).select(F.col("s_ps").cast("double").alias("x"), F.col("s_ipt").cast("double").alias("y"))
    return write_and_read(scaled.where("abs(x) + abs(y) < double('infinity')").groupBy("x", "y").agg(F.count("*").alias("w")), "packets")


def _with_nearest(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """`points` (x, y, w) with the number of the nearest centre and the squared distance to it."""
    index = points.sparkSession.sparkContext.broadcast(_CellIndex(centres) if len(centres) > INLINE_CODEBOOK else centres)

    @F.pandas_udf("id int, d double")
    def nearest(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        here, known = np.column_stack([xs.to_numpy(float), ys.to_numpy(float)]), index.value
        if isinstance(known, np.ndarray):
            ids, places = ((here[:, None, :] - known[None, :, :]) ** 2).sum(axis=2).argmin(axis=1), known
        else:
            ids, places = known.nearest(here), known.centres
        return pd.DataFrame({"id": ids.astype(np.int32), "d": ((here - places[ids]) ** 2).sum(axis=1)})

    return points.withColumn("near", nearest("x", "y"))


def _plus_plus(places: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the weighted places, drawn by weight times squared distance to those before; one by one up to 256, beyond that k / 256 at a time."""
    rng = np.random.default_rng(seed)
    chosen, near = np.zeros(0, np.int64), np.where(weights > 0, 1.0, 0.0)
    while len(chosen) < k:
        share = near * weights
        many = min(max(1, k // 256) if len(chosen) else 1, k - len(chosen), np.count_nonzero(share))
        if not many:
            break
        new = rng.choice(len(places), many, replace=False, p=share / share.sum())
        apart = np.min([((places - c) ** 2).sum(axis=1) for c in places[new]], axis=0)
        near = apart if not len(chosen) else np.minimum(near, apart)
        chosen = np.concatenate([chosen, new])
    return places[chosen]


def seed_centres(points: DataFrame, k: int, seed: int = K.RANDOM_SEED, rounds: int = 5) -> np.ndarray:
    """Start centres by oversampling (k-means||): in each round every point becomes a candidate with a probability of SEEDS_PER_ROUND * k times its share of the error that is left.

    Candidates, about SEEDS_PER_ROUND * k per round whatever the number of points, are weighted by the packets nearest to them, and k of them are drawn.
    Draws depend on seed, round and point only. At most k points are all centres.
    """
    if points.count() <= k:
        return np.array([[r.x, r.y] for r in points.orderBy("x", "y").select("x", "y").collect()]).reshape(-1, 2)  # at most k rows
    draw = lambda turn: F.pmod(F.xxhash64("x", "y", F.lit(seed), F.lit(turn)), F.lit(1 << 52)) / float(1 << 52)
    new = np.array([[r.x, r.y] for r in points.orderBy(draw(0), "x", "y").limit(1).select("x", "y").collect()])
    candidates, told, turn = new, points.select("x", "y", "w", F.lit(-1).alias("id"), F.lit(float("inf")).alias("d")), 0
    while True:
        # points keep their nearest candidate so far, so each round looks at its own candidates only
        here = _with_nearest(told, new)
        nearer, first = F.col("near.d") < F.col("d"), len(candidates) - len(new)
        last, told = told, write_and_read(here.select(
            "x", "y", "w", F.when(nearer, F.col("near.id") + first).otherwise(F.col("id")).alias("id"), F.when(nearer, F.col("near.d")).otherwise(F.col("d")).alias("d")), "near")
        discard(last)
        total = told.agg(F.sum(F.col("d") * F.col("w"))).first()[0]
        if not total or turn >= rounds and len(candidates) >= k:
            break
        turn += 1
        drawn = told.where((F.col("d") > 0) & (draw(turn) * total < F.col("d") * F.col("w") * (SEEDS_PER_ROUND * k))).select("x", "y").collect()  # SEEDS_PER_ROUND * k on average
        new = np.array([[r.x, r.y] for r in drawn]).reshape(-1, 2)
        if not len(new):
            new = np.array([[r.x, r.y] for r in told.orderBy(F.desc(F.col("d") * F.col("w")), "x", "y").limit(1).select("x", "y").collect()])
        candidates = np.concatenate([candidates, new])
    weights = np.zeros(len(candidates))
    for row in told.groupBy("id").agg(F.sum("w").alias("w")).collect():  # one row per candidate
        weights[row["id"]] = row["w"]
    discard(told)
    order = np.lexsort(candidates.T)
    return _plus_plus(candidates[order], weights[order], k, seed)


def _settle(points: DataFrame, start: np.ndarray, counts: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd rounds from given centres, each of which already stands for `counts` packets: (centres, packets of each, earlier ones included).

    Ends with centres that lie within `tol` of the mean of what they stand for and have moved at most that far before, or after `max_iter` rounds.
    """
    centres, still = start, False
    for turn in range(max_iter + 1):
        moved, held = start * counts[:, None], counts.copy()
        sums = _with_nearest(points, centres).groupBy("near.id").agg(
            F.sum(F.col("x") * F.col("w")).alias("x"), F.sum(F.col("y") * F.col("w")).alias("y"), F.sum("w").alias("w"))
        for row in sums.collect():  # at most one row per centre
            moved[row["id"]] += (row["x"], row["y"])
            held[row["id"]] += row["w"]
        moved = np.where(held[:, None] > 0, moved / np.maximum(held, 1)[:, None], start)
        small = np.sqrt(((moved - centres) ** 2).sum(axis=1)).max() <= tol
        if turn == max_iter or still and small:
            return centres, held
        centres, still = moved, small
    return centres, counts


def fit_codebook(series: DataFrame, k: int = K.CODEBOOK_SIZE, seed: int = K.RANDOM_SEED, max_iter: int = 20,
                 tol: float = 0.01, flow: Sequence[str] | None = ("flow_id",)) -> Codebook:
    """K-means over all packets of multi-packet flows. `series` is the long packet form; `flow=None` takes all its packets.

    With fewer distinct packets than `k` there are as many centres as distinct packets. Rounds end when no centre is farther than `tol` from the mean of its packets.
    """
    return fit_chunks([series], k, seed, max_iter, tol, flow)[0]


def fit_chunks(chunks: Iterable[DataFrame], k: int = K.CODEBOOK_SIZE, seed: int = K.RANDOM_SEED, max_iter: int = 20, tol: float = 0.01,
               flow: Sequence[str] | None = ("flow_id",)) -> tuple[Codebook, np.ndarray]:
    """A codebook from chunk after chunk, and the packets that each centre stands for.

    The first chunk that has packets gives the start centres. Later chunks go on from the centres so far, which keep the weight of the packets that made them.
    While there are fewer than `k` centres, a chunk adds its own start centres up to `k`.
    """
    centres, counts, spark = np.zeros((0, 2)), np.zeros(0, np.int64), None
    for chunk in chunks:
        spark = chunk.sparkSession
        points = _weighted(chunk, flow)
        if len(centres) < k:
            new = seed_centres(points, k - len(centres), seed)
            there = set(map(tuple, centres))
            new = np.array([c for c in new if tuple(c) not in there]).reshape(-1, 2)
            centres, counts = np.concatenate([centres, new]), np.concatenate([counts, np.zeros(len(new), np.int64)])
        if len(centres):
            centres, counts = _settle(points, centres, counts, max_iter, tol)
        discard(points)
    return Codebook(spark, centres), counts


def refine_codebook(series: DataFrame, codebook: Codebook, max_iter: int = 20, tol: float = 0.01) -> Codebook:
    """Continue from given centres on further data: each round is one grouped average; only the centres reach the driver."""
    points = _weighted(series, None)
    centres, _ = _settle(points, codebook.centres, np.zeros(codebook.size, np.int64), max_iter, tol)
    return Codebook(codebook.spark, centres)


def centre_step(series: DataFrame, codebook: Codebook) -> DataFrame:
    """Mean of the packets of every centre."""
    scaled = scale_packets(present_packets(series)).withColumn("cluster_id", codebook.encode(F.col("ps"), F.col("ipt")))
    return scaled.groupBy("cluster_id").agg(F.avg("s_ps").alias("c_ps"), F.avg("s_ipt").alias("c_ipt"))


def quantizer_error(series: DataFrame, codebook: Codebook) -> DataFrame:
    """Centres in use, mean absolute error per coordinate and total absolute error, in scaled units."""
    scaled = scale_packets(present_packets(series)).withColumn("cluster_id", codebook.encode(F.col("ps"), F.col("ipt")))
    error = F.abs(F.col("s_ps") - F.col("c_ps")) + F.abs(F.col("s_ipt") - F.col("c_ipt"))
    return scaled.join(F.broadcast(codebook.table()), "cluster_id").agg(
        F.count_distinct("cluster_id").alias("centres"),
        (F.avg(error) / 2).alias("mae"),
        F.sum(error).alias("cumulative_error"),
    )
