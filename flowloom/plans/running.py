"""Running totals and ranks over groups that are too large for one task.

A plain window puts a whole group into one task. Here the ordered axis is cut into slices,
each slice is totalled (map-side combine), the few slice totals are scanned per group, and a window
inside (group, slice) adds the slice's offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

SLICES = 512


def equal_slices(df: DataFrame, order: str, slices: int = SLICES, name: str = "slice") -> DataFrame:
    """Add a slice number that grows with a numeric column and holds a similar share of the rows.

    Split points come from a quantile sketch; only those few numbers reach the driver.
    Equal values always share a slice.
    """
    points = df.stat.approxQuantile(order, [i / slices for i in range(1, slices)], 0.25 / slices)
    cuts = sorted(set(points))
    if not cuts:
        return df.withColumn(name, F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    cast = df.withColumn("__order", F.col(order).cast("double"))
    return Bucketizer(splits=splits, inputCol="__order", outputCol=name, handleInvalid="keep").transform(cast).drop("__order")


def running_totals(
    df: DataFrame, by: Sequence[str], slice_col: str, order: Sequence[str | Column], values: dict[str, Column]
) -> DataFrame:
    """For each (name, value): the total of all earlier rows of the group as `before_<name>`.

    Rows are ordered by (slice, *order); `slice_col` must not decrease along the order.
    """
    by = list(by)
    staged = df.select("*", *[v.alias(f"__{n}") for n, v in values.items()])
    slices = staged.groupBy(*by, slice_col).agg(*[F.sum(f"__{n}").alias(f"__t_{n}") for n in values])
    earlier = Window.partitionBy(*by).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)],
        F.col(slice_col).alias("__slice"),
        *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in values],
    )
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)] + [F.col(slice_col) == F.col("__slice")]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    inside = Window.partitionBy(*by, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = staged.join(offsets, condition, "inner")
    return joined.select(
        *df.columns,
        *[(F.col(f"__o_{n}") + F.coalesce(F.sum(f"__{n}").over(inside), F.lit(0))).alias(f"before_{n}") for n in values],
    )


HASH_BITS = 60


def text_hash(*parts: Column) -> Column:
    """A number of 60 bits from the MD5 of the parts' texts, so that SQL elsewhere can recompute it."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def hash_order(seed: int, *columns: str) -> Column:
    """A reproducible pseudo-random order that does not depend on the partitioning."""
    return text_hash(F.lit(seed), *[F.col(c) for c in columns])


def ranked_by_hash(df: DataFrame, by: Sequence[str], ids: Sequence[str], seed: int, slice_bits: int = 14) -> DataFrame:
    """Add `hash_rank`, the exact 0-based rank of each row in its group by seeded hash."""
    hashed = df.withColumn("__hash", hash_order(seed, *ids)).withColumn(
        "__part", F.shiftright("__hash", HASH_BITS - slice_bits)
    )
    ranked = running_totals(hashed, by, "__part", ["__hash", *ids], {"rows": F.lit(1).cast("long")})
    return ranked.withColumnRenamed("before_rows", "hash_rank").drop("__hash", "__part")
