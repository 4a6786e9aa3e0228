"""One-dimensional k-means of each class, exact and without chance.

The values of a class are counted first, so the work is that of the distinct values. Clusters of least total squared distance are intervals of the
ordered values; running sums give the cost of any interval in constant time, and dynamic programming over the number of clusters finds the best cuts: the best
last cut never moves left as the end moves right, so a row of the table takes n log n looks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowloom import constants as K
from flowloom.plans.keys import join_on
from flowloom.plans.storage import small_side, write_and_read

#: Distinct values of one class that one task works on; its table takes four bytes per value and cluster.
MOST_VALUES = 1 << 16


def best_cuts(values: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Where each of the min(k, n) best clusters of n ascending weighted values begins; of equally good cuts the leftmost."""
    n, k = len(values), min(k, len(values))
    weights = counts.astype(np.float64)
    x = values - np.floor((values * weights).sum() / weights.sum())  # small numbers keep their digits in squares
    w, s, q = (np.concatenate(([0.0], np.cumsum(c))) for c in (weights, weights * x, weights * x * x))

    def cost(m: np.ndarray, i: np.ndarray) -> np.ndarray:
        ds = s[i] - s[m]
        return (q[i] - q[m]) - ds * ds / (w[i] - w[m])

    best = np.full(n + 1, np.inf)
    best[1:] = cost(np.zeros(n, np.int64), np.arange(1, n + 1))
    cuts = np.zeros((k + 1, n + 1), np.int32)
    for j in range(2, k + 1):
        now, cut = np.full(n + 1, np.inf), cuts[j]
        step = 1 << max(0, (n - j + 1).bit_length() - 1)
        while step:  # ends between two solved ones look between their cuts only
            i = np.arange(j - 1 + step, n + 1, 2 * step)
            low = np.where(i - step >= j, cut[np.maximum(i - step, 0)], j - 1)
            high = np.minimum(np.where(i + step <= n, cut[np.minimum(i + step, n)], n), i - 1)
            size = high - low + 1
            first = np.cumsum(size) - size
            m = np.arange(int(size.sum())) + np.repeat(low - first, size)
            total = best[m] + cost(m, np.repeat(i, size))
            least = np.minimum.reduceat(total, first)
            now[i] = least
            cut[i] = np.minimum.reduceat(np.where(total == np.repeat(least, size), m, n), first)
            step >>= 1
        best = now
    starts, end = np.zeros(k, np.int64), n
    for j in range(k, 0, -1):
        end = starts[j - 1] = cuts[j][end] if j > 1 else 0
    return starts


def _clean(value: Column, digits: int | None) -> Column:
    number = value.cast("double") + F.lit(0.0)
    return F.round(number, digits) if digits is not None else number


def _usable(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


class ValueClusters:
    """Centres of each class: `table` is (class, cluster, low, high, cnt, centre), clusters counted from the lowest."""

    def __init__(self, table: DataFrame, by: str, digits: int | None = None):
        self.table, self.by, self.digits = table, by, digits

    @classmethod
    def fit(cls, sequences: DataFrame, values: str = "values", by: str = K.TARGET_CLASS, limit: int = K.MARKOV_CLUSTER_LIMIT,
            digits: int | None = None) -> "ValueClusters":
        """min(limit, distinct values) clusters for every class, the absent class included.

        Absent and non-finite values are not counted. A class may have `MOST_VALUES` distinct values, which is checked; measured times are rounded to
        `digits` decimals to stay below. An empty table gives no clusters.
        """
        flat = sequences.select(by, F.explode(values).alias("value")).where(_usable(F.col("value").cast("double")))
        counted = write_and_read(flat.select(by, _clean(F.col("value"), digits).alias("value")).groupBy(by, "value").agg(F.count("*").alias("cnt")), "values")
        widest = counted.groupBy(by).count().agg(F.max("count")).first()[0] or 0
        if widest > MOST_VALUES:
            raise ValueError(f"a class has {widest} distinct values, more than {MOST_VALUES}: round them to fewer digits")

        def solve(rows: pd.DataFrame) -> pd.DataFrame:  # at most MOST_VALUES rows
            rows = rows.sort_values("value", ignore_index=True)
            value, cnt = rows["value"].to_numpy(np.float64), rows["cnt"].to_numpy(np.int64)
            at = best_cuts(value, cnt, limit)
            size = np.add.reduceat(cnt, at)
            shift = np.floor((value * cnt).sum() / cnt.sum())
            return pd.DataFrame({
                by: rows[by].to_numpy()[at], "cluster": np.arange(len(at), dtype=np.int32), "low": value[at], "high": value[np.append(at[1:], len(value)) - 1],
                "cnt": size, "centre": shift + np.add.reduceat((value - shift) * cnt, at) / size})

        schema = T.StructType([sequences.schema[by], *T._parse_datatype_string("cluster int, low double, high double, cnt long, centre double").fields])
        return cls(write_and_read(counted.groupBy(by).applyInPandas(solve, schema), "clusters"), by, digits)

    def _by_class(self) -> DataFrame:
        """One row per class, broadcast when they are counted to be few."""
        rows = F.array_sort(F.collect_list(F.struct("cluster", "low", "high", "centre")))
        return small_side(self.table.groupBy(self.by).agg(rows.alias("__clusters")))

    def encode(self, sequences: DataFrame, values: str = "values", ids: str = "input_ids") -> DataFrame:
        """`values` as cluster numbers. A value between two clusters goes to the nearer centre, the lower of two equally near ones; unusable values are left out.
        Sequences of a class without clusters are left out."""
        last = lambda x: F.greatest(F.size(F.filter("__clusters", lambda c: c["low"] <= x)) - 1, F.lit(0))  # that begins at or below x

        def number(p: Column) -> Column:
            here, after = F.get("__clusters", p["at"]), F.get("__clusters", p["at"] + 1)
            beyond = (p["x"] > here["high"]) & (after["centre"] - p["x"] < p["x"] - here["centre"])
            return F.when(beyond, p["at"] + 1).otherwise(p["at"])

        usable = F.filter(F.transform(values, lambda x: _clean(x, self.digits)), _usable)
        joined = join_on(sequences, self._by_class(), [self.by])
        return joined.select(*[F.col(f"`{c}`") for c in sequences.columns if c != ids], F.transform(F.transform(usable, lambda x: F.struct(x.alias("x"), last(x).alias("at"))), number).alias(ids))

    def decode(self, sequences: DataFrame, ids: str = "input_ids", values: str = "values") -> DataFrame:
        """Cluster numbers as centres; a number that the class lacks becomes null."""
        joined = join_on(sequences, self._by_class(), [self.by])
        centre = F.transform(ids, lambda i: F.get("__clusters", i)["centre"])
        return joined.select(*[F.col(f"`{c}`") for c in sequences.columns if c not in (ids, values)], centre.alias(values))
