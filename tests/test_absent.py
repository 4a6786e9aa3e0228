"""Absent classes, endpoints and arrays; ids that are texts; classes that a model lacks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import fidelity as E, knn as N, markov as M, prepare as D, quantize as Q, tokens as T
from flowloom.plans.keys import join_on


def test_join_on_absent_keys(spark):
    left = spark.createDataFrame([(None, "x", 1), ("a", None, 2), ("a", "x", 3)], "k string, l string, v int")
    right = spark.createDataFrame([(None, "x", 10), ("a", None, 20)], "k string, l string, w int")
    assert {(r.v, r.w) for r in join_on(left, right, ["k", "l"]).collect()} == {(1, 10), (2, 20)}
    assert join_on(left, right, ["k", "l"], "left").columns == ["k", "l", "v", "w"]


@pytest.mark.parametrize("ids", ["long", "string"])
def test_report_with_text_ids_and_an_absent_class(spark, ids):
    rows = [(f"{i}", c, [(float(100 + i % 7), 0.0), (-50.0 - i % 3, 20.0 + i)]) for i in range(40) for c in ("a", None)]
    flows = spark.createDataFrame(rows, "flow_id string, target_class string, packets array<struct<ps:double,ipt:double>>")
    flows = flows.withColumn("flow_id", F.concat_ws("", "flow_id", F.when(F.col("target_class").isNull(), "9").otherwise("1")).cast(ids))
    report = E.fidelity_report(flows, flows.filter("cast(flow_id as long) % 4 <> 0")).collect()
    metrics = {c: {r.metric: r.value for r in report if r.target_class == c} for c in ("a", None)}
    assert set(metrics["a"]) == set(metrics[None]) and len(metrics["a"]) > 30
    assert metrics[None]["n_flows"] and metrics[None]["KS_2sample_PS_client"] < 0.5


def test_neighbours_of_text_ids(spark):
    keys = spark.createDataFrame([("k1", [1.0, 0.0], 0), ("k2", [0.0, 1.0], 1), ("k0", [2.0, 0.0], 2)], "id string, features array<double>, label int")
    query = spark.createDataFrame([("q", [3.0, 0.1])], "id string, features array<double>")
    for numbers in (0, 1 << 24):
        found = N.nearest(query, keys, 2, label="label", broadcast_numbers=numbers).orderBy("rank").collect()
        assert [(r.query_id, r.key_id) for r in found] == [("q", "k0"), ("q", "k1")]
    assert [r.key_id for r in N.nearest_lsh(query, keys, 1, label="label").collect()] == ["k0"]
    assert N.nearest_lsh(query, keys.limit(0), 1, label="label").count() == 0


def test_hash_tables_follow_the_recall_target(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 24))
    vectors = [(int(i), (centres[i % 60] + 0.05 * rng.normal(size=24)).tolist()) for i in range(900)]
    frame = spark.createDataFrame(vectors, "id long, features array<double>")
    for bits in (4, 10):
        assert N.tables_for(bits, 0.995, 20) >= N.tables_for(bits, 0.9, 20)
        found = N.nearest_lsh(frame, frame, 1, skip_same=True, bits=bits)
        exact = N.nearest(frame, frame, 1, skip_same=True)
        assert N.recall(found, exact).first()["recall"] >= 0.995
    pairs = N.candidate_pairs(frame, frame, tables=N.tables_for(10, 0.995, 20), bits=10).first()
    assert pairs["compared"] < pairs["all_pairs"]


def test_absent_endpoints_are_endpoints(spark):
    flows = spark.createDataFrame([(1, "a", None), (2, None, "a"), (3, "a", "a"), (4, "a", "b"), (5, "b", "a"), (6, None, None)], "i int, l string, r string")
    kept = D.drop_duplicate_flows(flows.withColumn("p", F.lit(6)), "p", "l", "r", ["i"])
    assert sorted(r.i for r in kept.collect()) == [1, 3, 4, 6]


@pytest.mark.parametrize("n", [64, 65])
def test_absent_arrays_on_both_sides_of_the_inline_limit(spark, n):
    book = Q.Codebook(spark, np.array([[i / 100, 0.0] for i in range(n)]))
    flows = spark.createDataFrame([(1, None), (2, []), (3, [(15.0, 0.0), (None, 1.0)])], "i int, packets array<struct<ps:double,ipt:double>>")
    ids = {r.i: r.ids for r in flows.select("i", book.encode_flow(F.col("packets")).alias("ids")).collect()}
    assert ids == {1: None, 2: [], 3: [1, -1]}
    back = {r.i: r.p for r in spark.createDataFrame([(1, None), (2, []), (3, [1, -1])], "i int, ids array<int>").select(
        "i", book.decode_flow(F.col("ids")).alias("p")).collect()}
    assert back[1] is None and back[2] == [] and back[3][0].ps == pytest.approx(15.0) and back[3][1] is None


def test_a_class_without_a_token_is_an_error(spark):
    book = Q.Codebook(spark, np.array([[0.0, 0.0], [0.5, 0.0]]))
    flows = spark.createDataFrame([(1, [(10.0, 0.0)], "a"), (2, [(10.0, 0.0)], "new")], "flow_id int, packets array<struct<ps:double,ipt:double>>, target_class string")
    vocab = T.Vocabulary.create(spark, 2).add_classes(flows.filter("flow_id = 1"))
    assert T.encode_flows(flows.filter("flow_id = 1"), book, vocab, label="target_class").count() == 1
    with pytest.raises(Exception, match="not in the vocabulary: new"):
        T.encode_flows(flows, book, vocab, label="target_class").collect()
    encoder = spark.createDataFrame([("a", 0)], "class string, label int")
    with pytest.raises(Exception, match="not in the vocabulary: new"):
        T.labelled_tokens(flows, book, vocab, encoder).collect()


def test_markov_models_keep_absent_classes_and_count_unknown_ones(spark, tmp_path):
    rows = [("a", [1, 2, 1, 2]), (None, [3, 3, 4]), (None, [3, 4]), ("a", [7])]
    sequences = spark.createDataFrame(rows, "target_class string, input_ids array<int>")
    moves = {(r.target_class, r["from"], r.to): (r.cnt, r.n_states) for r in M.transitions(sequences).collect()}
    assert moves == {("a", 1, 2): (2, 3), ("a", 2, 1): (1, 3), (None, 3, 3): (1, 2), (None, 3, 4): (2, 2)}
    assert {(r.target_class, r.state): r.cnt for r in M.priors(sequences).collect()} == {("a", 1): 1, ("a", 7): 1, (None, 3): 2}
    held = spark.createDataFrame([("a", [1, 2]), (None, [3, 4]), ("new", [1, 2, 3])], sequences.schema)
    judged = {r.target_class: r for r in M.perplexity(held, M.transitions(sequences)).collect()}
    assert judged["new"].unjudged == judged["new"].transitions == 2 and judged["new"].perplexity is None
    assert judged[None].unjudged == 0 and judged[None].perplexity == pytest.approx(1.5, rel=1e-3)
    model = M.MarkovModel.fit(sequences, 4)
    model.save(str(tmp_path / "m"))
    wanted = spark.createDataFrame([("a", 20)], "target_class string, n long")
    again = M.MarkovModel.load(spark, str(tmp_path / "m"))
    assert sorted(map(str, again.sample(wanted).collect())) == sorted(map(str, model.sample(wanted).collect()))


def test_features_derived_missing_and_refitted(spark):
    from flowloom.operators import features as M

    data = spark.createDataFrame([(1.0, 2.0, "a"), (3.0, 5.0, "b"), (4.0, 1.0, "a")], "x double, y double, target_class string")
    config = M.FeatureConfig(continuous=["x", "gone"], categorical=[], tcp_flags=False, fingerprints=False, raw=False,
                             derive=lambda d: d.withColumn("sum", F.col("x") + F.col("y")), derived=["sum"])
    made = M.Featurizer(config)
    for _ in range(2):
        with pytest.warns(UserWarning, match="gone"):
            made.fit(data)
        assert made.missing == ["gone"]
    assert all(len(r.features) == 2 for r in made.transform(data).collect())
