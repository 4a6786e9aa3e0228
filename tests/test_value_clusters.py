"""Exact 1-D clusters against trying all cuts, and sequences through them."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import value_clusters as V

SCHEMA = "target_class string, values array<double>"


def spread(values, counts, starts):
    total = 0.0
    for a, b in zip(starts, [*starts[1:], len(values)]):
        v, c = values[a:b], counts[a:b]
        total += (c * (v - (v * c).sum() / c.sum()) ** 2).sum()
    return total


def test_best_cuts():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 10):
        for k in (1, 2, 3, 4, 12):
            values, counts = np.sort(rng.choice(1000, n, replace=False)).astype(float) + 1e6, rng.integers(1, 50, n)
            at = V.best_cuts(values, counts, k)
            assert len(at) == min(n, k) and at[0] == 0 and (np.diff(at) > 0).all()
            best = min(spread(values, counts, (0, *c)) for c in itertools.combinations(range(1, n), min(n, k) - 1))
            assert spread(values, counts, at) == pytest.approx(best, rel=1e-9, abs=1e-6)
    # plain dynamic programming on more values
    n, k = 300, 17
    values, counts = np.sort(rng.normal(0, 50, n)), rng.integers(1, 9, n)
    w, s, q = (np.concatenate(([0], np.cumsum(x))) for x in (counts, counts * values, counts * values ** 2))
    f = [0.0] + [np.inf] * n
    for _ in range(k):
        f = [np.inf] + [min(f[m] + q[i] - q[m] - (s[i] - s[m]) ** 2 / (w[i] - w[m]) for m in range(i)) for i in range(1, n + 1)]
    assert spread(values, counts, V.best_cuts(values, counts, k)) == pytest.approx(f[n], rel=1e-9)


def test_sequences(spark):
    nan = float("nan")
    rows = [("a", [1.0, 2.0, 10.0, None]), ("a", [11.0, 2.0, nan, 100.0]), ("b", [5.0, 5.0]), (None, [7.0, -0.0, 0.0]), ("c", []), ("d", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    fitted = V.ValueClusters.fit(df, limit=3)
    got = {(r[0], r[1]): tuple(r)[2:] for r in fitted.table.withColumn("centre", F.round("centre", 9)).collect()}
    assert got == {
        ("a", 0): (1.0, 2.0, 3, round(5 / 3, 9)), ("a", 1): (10.0, 11.0, 2, 10.5), ("a", 2): (100.0, 100.0, 1, 100.0), ("b", 0): (5.0, 5.0, 2, 5.0),
        (None, 0): (0.0, 0.0, 2, 0.0), (None, 1): (7.0, 7.0, 1, 7.0)}
    new = spark.createDataFrame([("a", [-5.0, 2.0, 6.0, 6.1, 54.0, 60.0, 500.0, None]), ("b", [9.0]), (None, [3.0]), ("z", [1.0])], SCHEMA)
    coded = fitted.encode(new)
    assert {r.target_class: r.input_ids for r in coded.collect()} == {"a": [0, 0, 0, 1, 1, 2, 2], "b": [0], None: [0]}
    assert {r.target_class: r["values"] for r in fitted.decode(coded).collect()}["b"] == [5.0]
    shuffled = V.ValueClusters.fit(df.repartition(5), limit=3).table
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, fitted.table.collect()))
    assert V.ValueClusters.fit(df.limit(0)).table.count() == 0


def test_too_many_values_are_refused(spark, monkeypatch):
    monkeypatch.setattr(V, "MOST_VALUES", 50)
    df = spark.range(60).select(F.lit("a").alias("target_class"), F.array((F.col("id") / 10).cast("double")).alias("values"))
    with pytest.raises(ValueError, match="distinct values"):
        V.ValueClusters.fit(df)
    assert V.ValueClusters.fit(df, digits=0).table.agg(F.sum("cnt")).first()[0] == 60
