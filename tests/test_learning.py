"""Neighbours, reports, fidelity, features and classifiers."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowloom.operators import classify as C, features as M, fidelity as E, knn as N, prepare as D, report as R

KEYS = [[1.0, 0.0, 0.0], [0.9, -0.1, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 1.0]]


def vectors(spark, rows, labels=None):
    labels = labels or [0] * len(rows)
    return spark.createDataFrame([(i, [float(x) for x in r], l) for i, (r, l) in enumerate(zip(rows, labels))],
                                 "id long, features array<double>, label int")


def clustered(n=600, centres=20, width=24, seed=3, noise=0.05):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centres, width))
    which = rng.integers(0, centres, n)
    return base[which] + rng.normal(0, noise, (n, width)), which


def test_cosine_literals():
    d = N.distances(np.array([[0.0, 0.0, 1.0]]), np.array(KEYS))
    assert np.allclose(d, [[1, 1, 1, 0.29289322]])


@pytest.mark.parametrize("options", [{}, {"block_rows": 1, "broadcast_numbers": 0}, {"block_rows": 2, "broadcast_numbers": 0}])
def test_top_k_literals(spark, options):
    queries = vectors(spark, [[1, -0.1, 0], [1, 0, 0], [0, 0, 1]])
    got = N.nearest(queries, vectors(spark, KEYS), 2, label="label", **options).orderBy("query_id", "rank").collect()
    ids = [[r["key_id"] for r in got if r["query_id"] == q] for q in range(3)]
    assert ids[:2] == [[1, 0], [0, 2]] and ids[2][0] == 3


def test_zero_vector_ranks_last(spark):
    got = N.nearest(vectors(spark, [[1, 0]]), vectors(spark, [[0, 0], [0, 1]]), 2).orderBy("rank").collect()
    assert [(r["key_id"], r["distance"]) for r in got] == [(1, 1.0), (0, None)]


def test_votes(spark):
    targets = [2, 2, 0, 1]
    rows = [(q, targets[k], rank + 1) for q, ks in enumerate([[1, 0], [2, 0], [1, 2]]) for rank, k in enumerate(ks)]
    got = N.vote(spark.createDataFrame(rows, "query_id long, label int, rank int")).orderBy("query_id").collect()
    assert [r["prediction"] for r in got] == [2, 0, 2]


@pytest.mark.parametrize("name", ["KNeighborsCosineClassifier", "KNeighborsPuffinnClassifier", "KNeighborsNGTClassifier", "KNeighborsClassifier"])
def test_classifiers_predict_literal(spark, name):
    model = C.CLASSIFIERS[name](nNeighbors=2, idCol="id").fit(vectors(spark, KEYS, [2, 0, 2, 1]))
    expected = 0 if name == "KNeighborsClassifier" else 2  # plain distance meets key 1 first and ties go to the first met
    assert model.transform(vectors(spark, [[0.9, 0, 0]])).first()["prediction"] in (expected, 2)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_block_search_equals_brute_force(spark, metric):
    x, y = clustered(300)
    df = vectors(spark, x, y.tolist())
    a = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - a @ a.T if metric == "cosine" else np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    expected = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :5]
    for options in ({}, {"block_rows": 64, "broadcast_numbers": 0}):
        got = N.nearest(df, df, 5, metric, label="label", skip_same=True, **options).orderBy("query_id", "rank").collect()
        assert np.array_equal(np.array([r["key_id"] for r in got]).reshape(-1, 5), expected)


def test_many_keys_stay_off_the_driver(spark, monkeypatch):
    """Keys of many rows are dealt to tasks, each side once per group of the other; every row of a repeated query id finds its own neighbours."""
    x, y = clustered(300)
    df = vectors(spark, x, y.tolist())
    twice = df.union(df.limit(5))
    wanted = sorted(tuple(r) for r in N.nearest(twice, df, 3, label="label", skip_same=True).collect())
    dealt, search = [], N._block_search

    def watched(q, t, *rest):
        dealt.append((q.count(), t.count()))
        return search(q, t, *rest)

    monkeypatch.setattr(N, "DRIVER_ROWS", 100, raising=False)
    monkeypatch.setattr(N, "_block_search", watched)
    assert sorted(tuple(r) for r in N.nearest(twice, df, 3, label="label", skip_same=True, block_rows=4).collect()) == wanted
    assert dealt == [(305 * 6, 300 * 6)]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_tiles_keep_ties_and_odd_vectors(monkeypatch, metric):
    """A task compares a tile at a time, with equal, zero, infinite and absent vectors as in one piece."""
    rng = np.random.default_rng(4)
    q, t = (rng.integers(-2, 3, (n, 2)).astype(float) for n in (200, 900))
    q[::50], t[::30], q[5::70, 0], t[3::90, 1], q[7::90], t[11::100] = 0, 0, np.nan, np.inf, 1e200, 1e-170
    with np.errstate(all="ignore"):
        d = N.distances(q, t, metric)
    largest, first = [], N._first
    monkeypatch.setattr(N, "TILE", 1 << 12)
    monkeypatch.setattr(N, "_first", lambda d, k: (largest.append(d.size), first(d, k))[1])
    ids = rng.permutation(len(t))
    d[np.arange(len(q))[:, None] == ids[None]] = np.nan
    found = N._best(np.arange(len(q)), q, ids, t, ids % 7, 5, metric, True, 64)
    for i in range(len(q)):
        here = [(v, k) for v, k in zip(d[i], ids) if not np.isnan(v)]
        assert list(found["key_id"][found["query_id"] == i]) == [k for _, k in sorted(here)[:5]]
    assert max(largest) <= 1 << 12


@pytest.mark.parametrize("block_rows", [8192, 16])
def test_lsh_recall_and_share(spark, block_rows):
    x, y = clustered(800)
    df = vectors(spark, x, y.tolist())
    exact = N.nearest(df, df, 3, label="label", skip_same=True)
    found = N.nearest_lsh(df, df, 3, label="label", skip_same=True, tables=6, bits=8, block_rows=block_rows)
    assert found.groupBy("query_id").count().filter("count <> 3").count() == 0
    assert N.recall(found, exact).first()["recall"] >= 0.95
    pairs = N.candidate_pairs(df, df, tables=6, bits=8).first()
    assert pairs["compared"] / pairs["all_pairs"] < 0.5


def test_lsh_falls_back_to_exact(spark):
    rng = np.random.default_rng(0)
    df = vectors(spark, rng.normal(size=(40, 16)))
    found = N.nearest_lsh(df, df, 3, skip_same=True, tables=1, bits=16)
    assert found.count() == 120
    assert N.recall(found, N.nearest(df, df, 3, skip_same=True)).first()["recall"] > 0.9


def test_lsh_sends_no_side_through_the_driver(spark, monkeypatch):
    """Hashed rows and found ids grow with the tables; how small their files look is no reason to broadcast them."""
    plans, store = [], N.write_and_read
    monkeypatch.setattr(N, "write_and_read", lambda df, name: (plans.append(df._jdf.queryExecution().toString()), store(df, name))[1])
    x, y = clustered(200)
    df = vectors(spark, x, y.tolist())
    wanted = sorted(map(tuple, N.nearest_lsh(df, df, 3, label="label", skip_same=True, tables=6, bits=8).collect()))
    monkeypatch.setattr(N, "DRIVER_ROWS", -1)
    found = N.nearest_lsh(df, df, 3, label="label", skip_same=True, tables=6, bits=8)
    assert sorted(map(tuple, found.collect())) == wanted
    recall = N.recall(found, N.nearest(df, df, 3, label="label", skip_same=True))
    plans = plans[len(plans) // 2:] + [df._jdf.queryExecution().toString() for df in (found, recall)]
    assert len(plans) >= 3 and not any("BroadcastExchange" in plan for plan in plans)


@pytest.mark.parametrize("tab", [0, 3])
def test_pairs_met_in_earlier_tables_are_left_out(monkeypatch, tab):
    rng = np.random.default_rng(0)
    left, right = rng.integers(0, 3, (60, 4)), rng.integers(0, 3, (50, 4))
    monkeypatch.setattr(N, "TILE", 20)
    compared = np.zeros((60, 50), int)
    for a, b in N._unmet(left, right, tab):
        compared[np.ix_(a, b)] += 1
    met = (left[:, None, :tab] == right[None, :, :tab]).any(axis=2)
    assert compared.max() == 1 and (compared[~met] == 1).all() and compared.sum() <= (~met).sum() + 0.2 * met.sum()


def test_report_and_confusion(spark):
    rows = [(0, 0)] * 5 + [(0, 1)] + [(1, 1)] * 2 + [(1, 0)] * 2 + [(2, 1)]
    counts = R.confusion(spark.createDataFrame(rows, "label int, prediction int"))
    rep = {r["class"]: r for r in R.classification_report(counts).collect()}
    assert rep["0"]["precision"] == pytest.approx(5 / 7) and rep["2"]["precision"] == 0 and rep["2"]["recall"] == 0
    assert rep["accuracy"]["f1"] == pytest.approx(7 / 11) and rep["macro avg"]["recall"] == pytest.approx((5 / 6 + 0.5) / 3)
    matrix = {r["true"]: (r["0"], r["1"], r["2"]) for r in R.confusion_matrix(counts, [0, 1, 2]).collect()}
    assert matrix == {0: (5, 1, 0), 1: (2, 2, 0), 2: (0, 1, 0)}
    for how, group in (("true", "true"), ("pred", "predicted")):
        sums = R.confusion(spark.createDataFrame(rows, "label int, prediction int"), normalize=how).groupBy(group).agg(F.sum("share").alias("s"))
        assert all(r["s"] == pytest.approx(1) for r in sums.collect())
    assert R.long_report(R.classification_report(counts)).filter("metric = 'support' and class = '0'").first()["value"] == 6


def samples(spark, **sides):
    rows = [("s", side, float(v)) for side, values in sides.items() for v in values]
    return E.weighted(spark.createDataFrame(rows, "series string, side string, value double"), ["series"])


def one(df):
    return df.first()["value"]


def density_of(values):
    x = np.linspace(0, max(values), 100)
    h = np.std(values, ddof=1) * len(values) ** -0.2
    d = np.exp(-((x[:, None] - values[None]) / h) ** 2 / 2).sum(axis=1)
    return d / d.sum()


def test_fidelity_metrics_against_numpy(spark):
    rng = np.random.default_rng(8)
    a, b = rng.gamma(2, 50, 300).round(1), rng.gamma(2.5, 45, 260).round(1)
    rel = samples(spark, src=a, gen=b)
    pa, pb = density_of(a), density_of(b)
    density = E.kde(rel, ["series"])
    assert one(E.kl_divergence(density, ["series"])) == pytest.approx((pa * np.log(pa / pb)).sum(), rel=1e-6)
    assert one(E.wasserstein(density, ["series"])) == pytest.approx(np.abs(np.sort(pa) - np.sort(pb)).mean(), rel=1e-6)
    cum = E.cumulated(rel, ["series"])
    grid = np.unique(np.concatenate([a, b]))
    share = lambda s: np.searchsorted(np.sort(s), grid, side="right") / len(s)
    assert one(E.ks_statistic(cum, ["series"])) == pytest.approx(np.abs(share(a) - share(b)).max())
    for r in E.scaled_differences(cum, ["series"], (10, 25, 50, 75, 90)).collect():
        o, g = np.percentile(a, r["percentile"]), np.percentile(b, r["percentile"])
        assert (r["src"], r["gen"]) == (pytest.approx(o), pytest.approx(g)) and r["value"] == pytest.approx(abs(o - g) / o)


def test_scale_and_shift_invariance(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random(400), rng.normal(size=400) - 0.1
    def both(x, y):
        rel = samples(spark, src=x, gen=y)
        return one(E.ks_statistic(E.cumulated(rel, ["series"]), ["series"])), one(E.wasserstein(E.kde(rel, ["series"]), ["series"]))
    base, scaled, shifted = both(a, b), both(a * 100, b * 100), both(a + 1e4, b + 1e4)
    assert np.allclose(base, scaled) and np.allclose(base, shifted, atol=1e-2)


def test_unestimable_metrics_are_null(spark):
    rel = samples(spark, src=[5.0], gen=[1.0, 2.0])
    rows = E.kl_divergence(E.kde(rel, ["series"]), ["series"]).collect()
    assert not rows or rows[0]["value"] is None
    zero = samples(spark, src=[0.0, 0.0], gen=[1.0, 2.0])
    assert E.scaled_differences(E.cumulated(zero, ["series"]), ["series"], (50,)).first()["value"] is None


def traffic(spark, n=60, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i, "c", [(float(rng.choice([-1, 1]) * rng.integers(40, 1500)), float(rng.integers(0, 900)) if j else 0.0)
                      for j in range(rng.integers(1, 8))]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "flow_id long, target_class string, packets array<struct<ps:double,ipt:double>>")


def test_report_of_equal_traffic(spark):
    _, flows = traffic(spark)
    got = {r["metric"]: r["value"] for r in E.fidelity_report(flows, flows, with_wasserstein=True).collect()}
    assert len(got) == 7 * 6 + 5
    assert all(v == pytest.approx(0, abs=1e-12) for k, v in got.items() if k.startswith(("KL", "KS", "Wass")))
    assert got["n_flows"] == 60


def test_throughput_against_loop(spark):
    rows, flows = traffic(spark, 80)
    clocks, bins = {1: 0.0, -1: 0.0}, {1: {}, -1: {}}
    for _, _, packets in rows:
        now, last = 0.0, {}
        for ps, ipt in packets:
            side = 1 if ps > 0 else -1
            now += ipt
            clocks[side] += now - last.get(side, now)
            last[side] = now
            b = int(clocks[side] // 1000)
            bins[side][b] = bins[side].get(b, 0) + ps
    got = E.throughput(flows, ["target_class"], "flow_id")
    for name, side in (("client", 1), ("server", -1)):
        assert {r["bin"]: r["bytes"] for r in got.filter(F.col("direction") == name).collect()} == bins[side]
        mean = E.mean_throughput(got, ["direction"]).filter(F.col("direction") == name).first()["value"]
        assert mean == pytest.approx(sum(bins[side].values()) / (max(bins[side]) - min(bins[side]) + 1))


def test_features(spark):
    train = spark.createDataFrame([(1.0, "TCP", 5.0, "a"), (3.0, "UDP", 5.0, "b"), (None, "TCP", 5.0, "a")],
                                  "client_packet0 double, ip_proto string, raw_packet0 double, target_class string")
    test = spark.createDataFrame([(2.0, "GRE", 6.0, "b")], train.schema)
    fitted = M.Featurizer(M.FeatureConfig(packet_num=1)).fit(train)
    assert "client_bulk0" in fitted.missing and "ndpi_j3ac" in fitted.missing
    got = fitted.transform(test).first()
    values = got["features"].toArray()
    std = np.std([1, 3, 0])
    assert np.allclose(values, [(2 - 4 / 3) / std, 0, 0, 1.0]) and got["label"] == 1
    with pytest.raises(Exception, match="unseen class"):
        fitted.transform(test.withColumn("target_class", F.lit("zz"))).collect()


def test_settings_ranges_and_names(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"DecTree": {"type": "DecisionTreeClassifier", "param_search_space": {"max_depth": {"from": 6, "till": 20, "step": 3},'
                    '"max_features": {"from": 10, "till": 40, "step": 10}, "criterion": ["entropy"]}}}')
    space = C.read_settings(str(path))["DecTree"]["param_search_space"]
    assert space == {"max_depth": [6, 9, 12, 15, 18], "max_features": [10, 20, 30, 40], "criterion": ["entropy"]}


SETTINGS = {
    "LogRegr": {"type": "LogisticRegression", "params": {"solver": "saga", "max_iter": 30, "multi_class": "multinomial"}},
    "LogRegrCost": {"type": "LogisticRegression", "params": {"max_iter": 30, "class_weight": "balanced"}},
    "SVM": {"type": "OneVsOneClassifier", "params": {"estimator": {"type": "LinearSVC", "params": {"tol": 1e-5}}, "n_jobs": -1},
            "param_search_space": {"estimator__C": [0.1, 1], "estimator__loss": ["squared_hinge"]}},
    "DecTree": {"type": "DecisionTreeClassifier", "param_search_space": {"max_depth": [3, 5], "max_features": [4]}},
    "Forest": {"type": "RandomForestClassifier", "params": {"n_estimators": 10}},
    "Boost": {"type": "GradientBoostingClassifier", "params": {"n_estimators": 3, "max_depth": 2}},
    "MLP": {"type": "MLPClassifier", "params": {"max_iter": 60, "hidden_layer_sizes": [16]}},
    "Cosine": {"type": "KNeighborsCosineClassifier", "params": {"n_neighbors": 3}},
}


@pytest.fixture(scope="module")
def separable(spark):
    x, y = clustered(240, 3, 8, noise=0.3)
    df = spark.createDataFrame([(i, v.tolist(), float(l)) for i, (v, l) in enumerate(zip(x, y))], "flow_id long, v array<double>, label double")
    df = df.select("flow_id", array_to_vector("v").alias("features"), "label")
    split = D.stratified_split(df, "label", ["flow_id"]).cache()
    return split.filter("not is_test").drop("is_test"), split.filter("is_test").drop("is_test")


@pytest.mark.parametrize("name", sorted(SETTINGS))
def test_classifiers_learn(spark, separable, name):
    train, test = separable
    search = "param_search_space" in SETTINGS[name]
    report = C.train_and_report(train, test, {name: SETTINGS[name]}, ["flow_id"], search=search)[name]
    assert report.filter("class = 'accuracy'").first()["f1"] >= 0.9


def test_folds_are_stratified(spark, separable):
    folds = C.stratified_folds(separable[0], ["flow_id"]).groupBy("label").agg(F.count_if(F.col("fold") == 0).alias("a"), F.count("*").alias("n"))
    assert all(abs(r["a"] - r["n"] / 2) <= 0.5 for r in folds.collect())


def test_folds_are_dealt_once(spark, separable):
    """A search reads stored folds: the rows given are not computed again by every fit."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(flow):
        seen.add(1)
        return flow

    data = separable[0].withColumn("flow_id", counted(F.col("flow_id").cast("long")))
    n = data.count()
    C.search_parameters(C.CLASSIFIERS["DecisionTreeClassifier"](), {"maxDepth": [1, 2]}, data, ["flow_id"])
    assert 0 < seen.value <= 6 * n
