"""The neighbour graph against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import knn, neighbour_graph as G


def clustered(n, clusters=20, width=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    return [[float(x) for x in centres[i % clusters] + rng.normal(size=width) * 0.3] for i in range(n)]


@pytest.fixture(scope="module")
def keys(spark):
    rows = [(f"v{i}", v, i % 20) for i, v in enumerate(clustered(400))]
    return spark.createDataFrame(rows, "id string, features array<double>, label int").repartition(4)


def test_lists_are_the_nearest(keys):
    graph = G.build(keys, label="label", config=G.GraphConfig(degree=10, company=16))
    exact = knn.nearest(keys, keys, 10, label="label", skip_same=True).select("query_id", "key_id").collect()
    edges = {tuple(r) for r in graph.edges.collect()}
    assert np.mean([tuple(r) in edges for r in exact]) > 0.97 and 1 <= graph.rounds <= 12


def test_walks_find_neighbours(keys):
    graph = G.build(keys, label="label", config=G.GraphConfig())
    asked = keys.filter(F.xxhash64("id") % 10 == 0)
    exact = knn.nearest(asked, keys, 3, label="label", skip_same=True)
    met = G.walk(graph, asked, 3, skip_same=True, recall_target=0.95)
    assert knn.recall(G.best_of(graph, met, 3), exact).first()[0] >= 0.95
    assert met.count() == met.select("query_id", "key_id").distinct().count() < 0.5 * asked.count() * keys.count()
    found = {(r.query_id, r.key_id): r for r in G.best_of(graph, met, 3).collect()}
    want = {(r.query_id, r.key_id): r for r in exact.collect()}
    for pair in found.keys() & want.keys():
        assert found[pair].distance == pytest.approx(want[pair].distance, abs=1e-9) and found[pair].label == want[pair].label


def test_few_keys_ties_and_zero_vectors(spark):
    schema = "id long, features array<double>"
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (9, [1.0, 1.0])], schema)
    assert G.search(G.build(spark.createDataFrame([], schema)), asked, 2).collect() == []
    alone = G.search(G.build(spark.createDataFrame([(5, [0.0, 2.0])], schema)), asked, 2).collect()
    assert sorted((r.query_id, r.key_id, r.rank) for r in alone) == [(1, 5, 1), (9, 5, 1)]
    rows = [(i, [1.0, float(i % 3)]) for i in range(12)] + [(50, [0.0, 0.0])]
    got = G.search(G.build(spark.createDataFrame(rows, schema)), asked, 4, search_epsilon=1.0).collect()
    assert sorted(r.key_id for r in got if r.query_id == 1) == [0, 3, 6, 9] and sorted(r.key_id for r in got if r.query_id == 9) == [1, 4, 7, 10]
    assert all(r.distance == pytest.approx(0, abs=1e-9) for r in got)


def test_hubs_are_cut_into_parts(spark):
    """A key that all others list: its company is dealt out, and everybody still finds the own neighbours."""
    rng = np.random.default_rng(1)
    rows = [(0, [1.0] + [0.0] * 7)] + [(i, [2.0, *map(float, rng.normal(size=7))]) for i in range(1, 250)]
    keys = spark.createDataFrame(rows, "id long, features array<double>")
    graph = G.build(keys, config=G.GraphConfig(degree=8, company=8))
    exact = knn.nearest(keys, keys, 8, skip_same=True).select("query_id", "key_id").collect()
    edges = {tuple(r) for r in graph.edges.collect()}
    assert np.mean([tuple(r) in edges for r in exact]) > 0.9


def test_shards_are_all_walked(keys):
    """Keys beyond one shard: every shard has a graph of its own, every query walks all, and what is returned of them is the same in both forms."""
    graph = G.build(keys, label="label", config=G.GraphConfig(degree=10, company=16, shard=120))
    assert graph.shards == 4 and graph.index.select("id").distinct().count() == graph.index.count() == 400
    shard_of = {r["id"]: r["shard"] for r in graph.index.select("id", "shard").collect()}
    assert all(shard_of[a] == shard_of[b] and a != b for a, b in graph.edges.collect())
    assert {r["shard"] for r in graph.starts.collect()} == {0, 1, 2, 3}
    asked = keys.filter(F.xxhash64("id") % 5 == 0)
    exact = knn.nearest(asked, keys, 3, label="label", skip_same=True)
    met = G.walk(graph, asked, 3, skip_same=True, recall_target=0.95).cache()
    best = G.walk(graph, asked, 3, skip_same=True, recall_target=0.95, best=3)
    assert best.agg(F.sum("measured")).first()[0] == met.count() == met.select("query_id", "key_id").distinct().count()
    assert met.filter("query_id = key_id").isEmpty() and not met.filter("looked_up").isEmpty()
    found = [sorted(map(tuple, G.best_of(graph, m, 3).collect())) for m in (met, best)]
    assert found[0] == found[1] and knn.recall(G.best_of(graph, best, 3), exact).first()[0] >= 0.95


def test_rounds_and_steps_store_no_tables(keys, monkeypatch):
    """Descent and walks go on inside tasks: tables are stored once per build and search, not once per round."""
    names = []
    monkeypatch.setattr(G, "write_and_read", lambda df, name, store=G.write_and_read: (names.append(name), store(df, name))[1])
    graph = G.build(keys, label="label", config=G.GraphConfig(degree=10, company=16))
    assert graph.rounds > 1 and len(names) <= 2
    G.search(graph, keys.filter(F.xxhash64("id") % 5 == 0), 3, skip_same=True).count()
    assert len(names) <= 5


def test_rows_without_direction_are_met_by_no_walk(spark):
    """Zero vectors, absent and infinite numbers, absent ids and vectors; many equal vectors; a label that is null."""
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0], None) for i in range(300)] + [(i, [1.0, float(i)], i) for i in range(300, 310)]
    odd = [(400, [0.0, 0.0], 1), (401, [nan, 1.0], 1), (402, [1.0, inf], 1), (403, [None, 1.0], 1), (404, None, 1), (None, [1.0, 0.0], 1)]
    keys = spark.createDataFrame(rows + odd, "id long, features array<double>, label int")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "id long, features array<double>")
    graph = G.build(keys, label="label", config=G.GraphConfig(degree=4, company=8))
    found = G.search(graph, asked, 3, search_epsilon=0.02).collect()
    assert [(r.query_id, r.distance, r.label) for r in found] == [(1, 0.0, None)] * 3
    met = {r.key_id for r in G.walk(graph, asked, 3, search_epsilon=1.0).collect()}
    assert met <= set(range(310)) and met & set(range(300, 310))


def test_many_shards_are_dealt_by_direction(spark):
    """Beyond four shards a query walks the own cell and only those shards that may hold a nearer key, and finds what all shards together hold."""
    rows = [(f"v{i}", v, i % 20) for i, v in enumerate(clustered(1200, clusters=6, width=3))] + [("zero", [0.0] * 3, 0)]
    keys = spark.createDataFrame(rows, "id string, features array<double>, label int")
    asked = keys.filter(F.xxhash64("id") % 4 == 0).unionByName(spark.createDataFrame([("none", [0.0] * 3, 0)], keys.schema))
    graph = G.build(keys, label="label", config=G.GraphConfig(shard=100))
    sizes = [r["count"] for r in graph.index.groupBy("shard").count().collect()]
    assert graph.shards == len(sizes) > 12 and sum(sizes) == len(rows)
    for k in (1, 3):
        best = G.walk(graph, asked, k, skip_same=True, search_epsilon=1.0, best=k).cache()
        met = G.walk(graph, asked, k, skip_same=True, search_epsilon=1.0).cache()
        assert met.count() == met.select("query_id", "key_id").distinct().count() == best.agg(F.sum("measured")).first()[0] < 0.5 * asked.count() * len(rows)
        exact = {(r.query_id, r.key_id, r.label) for r in knn.nearest(asked, keys, k, label="label", skip_same=True).where("distance is not null").collect()}
        for found in (met, best):
            got = {(r.query_id, r.key_id, r.label) for r in G.best_of(graph, found, k).collect()}
            assert len(got) == len(exact) and len(got & exact) >= 0.98 * len(exact)
    assert "BroadcastHashJoin" not in G.best_of(graph, best, 1)._jdf.queryExecution().toString()
    nothing = G.build(spark.createDataFrame([(i, [0.0]) for i in range(60)], "id long, features array<double>"), config=G.GraphConfig(shard=10))
    assert G.search(nothing, spark.createDataFrame([(1, [1.0])], "id long, features array<double>"), 1, search_epsilon=1.0).count() == 0
