"""Codebook, tokens and Markov models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import markov as M, quantize as Q, tokens as T

PAIRS = "array<struct<ps:double,ipt:double>>"


@pytest.fixture(scope="module")
def book(spark):
    return Q.Codebook(spark, np.array([[0.04, 0.0], [-0.5, 1.0], [1.0, 2.0], [0.04, 3.0]]))


def test_scaling_round_trip(spark):
    rows = [(float(s), float(g)) for s, g in zip(np.linspace(-1500, 1500, 50), np.linspace(0, 9000, 50) ** 1.1)] + [(5.0, 0.0)]
    df = spark.createDataFrame(rows, "ps double, ipt double")
    back = Q.unscale_packets(Q.scale_packets(df).select("s_ps", "s_ipt")).select("ps", "ipt").collect()
    assert np.allclose(np.array(rows), np.array(back), atol=1e-8)


@pytest.mark.parametrize("k,seed", [(65, 0), (300, 1), (2000, 2)])
def test_cell_index_equals_brute_force(k, seed):
    rng = np.random.default_rng(seed)
    centres = np.column_stack([rng.choice([-1, 0.04, 1, 0.5], k) + rng.normal(0, 0.05, k), np.abs(rng.normal(0, 2, k))])
    centres[3] = centres[2]
    points = np.vstack([rng.normal(0, 2, (3000, 2)), centres[:50], [[50, 50], [-40, 0], [np.nan, 1], [np.inf, 0]]])
    got = Q._CellIndex(centres).nearest(points)
    with np.errstate(invalid="ignore"):
        d = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2)
    known = np.isfinite(points).all(axis=1)
    assert (got[known] == d[known].argmin(axis=1)).all() and (got[~known] == -1).all()


def test_cell_index_is_narrow_at_the_rim(monkeypatch):
    """Packets without a gap lie on the lower edge of the codebook; neither they nor a large batch may meet all centres at once."""
    centres = np.array([[i / 64 - 1, j / 25] for i in range(128) for j in range(128)])
    index = Q._CellIndex(centres)
    searched, search = [], Q._CellIndex._search_cells

    def watched(self, points, rows, cells, out):
        searched.append((len(rows), int((self.starts[cells + 1] - self.starts[cells]).sum())))
        search(self, points, rows, cells, out)

    monkeypatch.setattr(Q._CellIndex, "_search_cells", watched)
    points = np.column_stack([np.tile(np.linspace(-1, 63 / 64, 200), 10), np.repeat(np.linspace(-0.002, 0, 10), 200)])
    got = index.nearest(points)
    assert (got == ((points[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert sum(pairs for _, pairs in searched) < 100 * len(points)
    searched.clear()
    far = np.column_stack([np.full(3000, -2.5), np.linspace(-4, 9, 3000)])
    assert (index.nearest(far) == ((far[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert sum(n for n, _ in searched) == len(far) and max(pairs for _, pairs in searched) <= Q.COMPARED + len(centres)


def test_slots_are_dealt_to_many_tasks(spark):
    """Sequences are drawn in as many tasks as there are slot rows for, with the numbers that SQL would draw."""
    rows = [(c, [i % 3, (i + 1) % 3, i % 2]) for c in ("a", "b|é") for i in range(12)]
    model = M.MarkovModel.fit(spark.createDataFrame(rows, "target_class string, input_ids array<int>"), 3)
    wanted = spark.createDataFrame([("a", 20 * M.SLOT_ROWS), ("b|é", 300)], "target_class string, n long")
    drawn = model.sample(wanted)
    sizes = drawn.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 20 * M.SLOT_ROWS + 300 and max(r["count"] for r in sizes) <= 8 * M.SLOT_ROWS
    few = spark.createDataFrame([("a", 40), ("b|é", 40)], "target_class string, n long")
    assert sorted(map(tuple, model.sample(few).collect())) == sorted(map(tuple, model.sample(few, force_joins=True).collect()))


def test_chunks_read_stored_packets(spark, data, monkeypatch):
    """The many rounds over the chunks read packets that were built once."""
    from flowloom.queries import sequences as S

    plans = []

    def watched(chunks, **_):
        plans.extend(c._jdf.queryExecution().optimizedPlan().toString() for c in chunks)
        raise StopIteration

    monkeypatch.setattr(S.Q, "fit_chunks", watched)
    with pytest.raises(StopIteration):
        S.codebook_chunks(spark, data)
    assert plans and not any("Window" in p for p in plans)


def test_encode_absent_and_decode(spark, book):
    df = spark.createDataFrame([(60.0, 0.0), (None, 1.0), (1.0, float("inf")), (-750.0, 10.0)], "ps double, ipt double")
    ids = [r[0] for r in df.select(book.encode(F.col("ps"), F.col("ipt"))).collect()]
    assert ids == [0, -1, -1, 1]
    coded = spark.createDataFrame([(0,), (-1,), (99,), (1,)], "cluster_id int")
    back = {r["cluster_id"]: (r["ps"], r["ipt"]) for r in book.decode(coded).collect()}
    assert back[-1] == (None, None) and back[99] == back[0] == (60.0, 0.0) and back[1] == (-750.0, pytest.approx(10.0))


def test_large_codebook_array_paths(spark):
    rng = np.random.default_rng(5)
    centres = np.column_stack([rng.uniform(-1, 1, 200), rng.uniform(0.1, 4, 200)])
    large = Q.Codebook(spark, centres)
    rows = [(i, [(float(c[0] * 1500), float(10 ** c[1])) for c in centres[i:i + i % 4]]) for i in range(40)]
    flows = spark.createDataFrame(rows, f"id int, packets {PAIRS}")
    out = flows.withColumn("ids", large.encode_flow(F.col("packets"))).orderBy("id")
    assert [r["ids"] for r in out.collect()] == [list(range(i, i + i % 4)) for i in range(40)]
    back = out.select("id", large.decode_flow(F.col("ids")).alias("p")).orderBy("id").collect()
    for r, (_, packets) in zip(back, rows):
        assert np.allclose([(p["ps"], p["ipt"]) for p in r["p"]], packets) if packets else r["p"] == []
    holes = spark.createDataFrame([([0, -1, 5000],)], "ids array<int>").select(large.decode_flow(F.col("ids")).alias("p")).first()["p"]
    assert holes[1] is None and holes[2] == holes[0]


def test_codebook_fit_refine_save(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(float(rng.choice([100, -1400]) + rng.normal(0, 3)), float(rng.choice([1.0, 1000.0]))) for _ in range(400)]
    series = spark.createDataFrame(rows, "ps double, ipt double")
    fitted = Q.fit_codebook(series, k=4, flow=None)
    assert Q.quantizer_error(series, fitted).first()["mae"] < 0.01
    start = Q.Codebook(spark, fitted.centres + 0.05)
    refined = Q.refine_codebook(series, start, tol=1e-6)
    assert np.allclose(refined.centres, fitted.centres, atol=1e-3)
    refined.save(str(tmp_path / "book"))
    assert np.allclose(Q.Codebook.load(spark, str(tmp_path / "book")).centres, refined.centres)


def test_codebook_seeds_chunks_and_few_packets(spark):
    rng = np.random.default_rng(2)
    spots = np.array([(-1400.0, 1.0), (-200.0, 900.0), (60.0, 5.0), (700.0, 50.0), (1400.0, 2000.0)])
    rows = [(i // 4, i % 4, *map(float, spots[rng.integers(5)] * rng.normal(1, 0.01, 2))) for i in range(1200)]
    series = spark.createDataFrame(rows, "flow_id int, pos int, ps double, ipt double")
    book, counts = Q.fit_chunks([series.filter("flow_id < 150"), series.filter("flow_id >= 150"), series.limit(0)], k=5)
    assert counts.sum() == 1200 and (counts > 100).all()
    scaled = np.column_stack([spots[:, 0] / 1500, np.log10(spots[:, 1])])
    assert all(np.abs(book.centres - c).sum(axis=1).min() < 0.05 for c in scaled)
    again, same = Q.fit_chunks([series.repartition(7).filter("flow_id < 150"), series.filter("flow_id >= 150")], k=5)
    assert np.allclose(again.centres, book.centres) and (same == counts).all()
    large = Q.fit_codebook(series, k=300)
    assert large.size == 300 and Q.quantizer_error(series, large).first()["mae"] < Q.quantizer_error(series, book).first()["mae"] / 4
    points = Q._weighted(series, None)
    seeds = Q.seed_centres(points, 300)
    assert len(np.unique(seeds, axis=0)) == 300 and len(Q.seed_centres(points, 5000)) == points.count()
    grown, n = Q.fit_chunks([series.limit(2), series], k=40, flow=None)
    assert grown.size == 40 and n.sum() == 1202
    single = Q.fit_codebook(spark.createDataFrame([(1, 0, 5.0, 1.0), (1, 1, 5.0, 1.0), (1, 2, None, None), (2, 0, 9.0, 9.0)], "flow_id int, pos int, ps double, ipt double"))
    assert single.size == 1


def test_tokens_lengths_holes_and_round_trip(spark, book, tmp_path):
    vocab = T.Vocabulary.create(spark, 4).add_classes(spark.createDataFrame([("b",), ("a",), ("b",)], "target_class string"))
    assert (vocab.eof, vocab.pad, vocab.unk, vocab.bof) == (4, 5, 6, 7)
    assert (vocab.id_of("a"), vocab.id_of("b"), vocab.size(), vocab.token_of(8)) == (8, 9, 10, "a")
    assert vocab.add_classes(spark.createDataFrame([("a",), ("c",)], "target_class string")).id_of("c") == 10
    with pytest.raises(KeyError):
        vocab.id_of("zzz")
    vocab.save(str(tmp_path / "vocab"))
    assert T.Vocabulary.load(spark, str(tmp_path / "vocab"), 4).id_of("b") == 9
    flows = spark.createDataFrame([(1, "a", [(60.0, 0.0)] * 20), (2, "b", [(60.0, 0.0)] * 200),
                                   (3, "a", [(60.0, 0.0), (-750.0, 10.0), (None, None), (None, None)])],
                                  f"flow_id int, target_class string, packets {PAIRS}")
    got = {r["flow_id"]: r["input_ids"] for r in T.encode_flows(flows, book, vocab, label="target_class").collect()}
    assert len(got[1]) == 22 and len(got[2]) == 128 and got[2][-1] == 4
    assert got[3] == [8, 0, 1, 4, 5, 5]
    plain = T.encode_flows(flows, book, vocab, special=False).filter("flow_id = 3").first()
    assert plain["input_ids"] == [0, 1, 5, 5] and plain["attention_mask"] == [1, 1, 0, 0]
    first = T.encode_flows(flows, book, vocab, mask_first=True).filter("flow_id = 3").first()
    assert first["input_ids"][0] == 7 and first["attention_mask"] == [0, 1, 1, 1, 0, 0]
    decoded = T.decode_flows(T.encode_flows(flows, book, vocab), book, vocab).filter("flow_id = 3").first()["packets"]
    assert [None if p is None else round(p["ps"], 6) for p in decoded] == [60.0, -750.0, None, None]


def test_decode_without_end_token(spark):
    from flowloom.functions.arrays import strip_special

    df = spark.createDataFrame([([7, 1, 2, 3],), ([7, 1, 4, 5, 5],), ([7, 1, 2, 4],), ([7, 4, 5, 5],)], "t array<int>")
    got = [r[0] for r in df.select(strip_special(F.col("t"), 4)).collect()]
    assert got == [[1, 2], [1, -1, -1], [1, 2], [-1, -1]]


def test_batch_length_is_checked(spark, book):
    vocab = T.Vocabulary.create(spark, 4)
    flows = spark.createDataFrame([(1, [(60.0, 0.0)] * 9)], f"flow_id int, packets {PAIRS}")
    encoded = T.encode_flows(flows, book, vocab)
    assert T.with_lm_labels(T.pad_batch(encoded, vocab, 12), vocab).first()["labels"][-1] == -100
    with pytest.raises(Exception, match="longer than the batch"):
        T.pad_batch(encoded, vocab, 5).collect()


def test_size_tokens_range(spark):
    flows = spark.createDataFrame([(1, [(5000.0, 0.0), (-5000.0, 1.0), (3.0, 1.0)])], f"flow_id int, packets {PAIRS}")
    assert T.size_tokens(flows, 4, 100).first()["size_tokens"] == [99, 1, 53, 50]


SEQS = [("a", [1, 2, 2, 3]), ("a", [1, 2, 3, 3]), ("a", [2, 2, 2, 2]), ("b", [7, 8, 7, 8])]


def test_transitions_and_priors(spark):
    df = spark.createDataFrame(SEQS, "target_class string, input_ids array<int>")
    got = {(r["target_class"], r["from"], r["to"]): (r["cnt"], r["p"]) for r in M.transitions(df).collect()}
    assert got[("a", 2, 2)][0] == 4 and got[("a", 2, 3)][0] == 2
    assert got[("a", 2, 2)][1] == pytest.approx((4 + 1e-6) / (6 + 3e-6)) and got[("b", 8, 7)][1] == pytest.approx(1, abs=2e-6)
    prior = {(r["target_class"], r["state"]): r["p"] for r in M.priors(df).collect()}
    assert prior == {("a", 1): pytest.approx(2 / 3), ("a", 2): pytest.approx(1 / 3), ("b", 7): 1.0}


def test_transition_counts_against_loop(spark):
    rng = np.random.default_rng(3)
    rows = [("c", [int(x) for x in rng.integers(0, 30, 20)]) for _ in range(61)]
    df = spark.createDataFrame(rows, "target_class string, input_ids array<int>")
    matrix = np.full((30, 30), 1e-6)
    for _, ids in rows:
        for a, b in zip(ids, ids[1:]):
            matrix[a, b] += 1
    matrix /= matrix.sum(axis=1, keepdims=True)
    for r in M.transitions(df).collect():
        assert r["p"] == pytest.approx(matrix[r["from"], r["to"]])


def test_normalize_rows(spark):
    df = spark.createDataFrame([(0, 0, float("inf")), (0, 1, 0.0), (1, 0, 4.0), (1, 1, 16.0)], "r int, c int, w double")
    got = {(r["r"], r["c"]): r["w"] for r in M.normalize_rows(df, "r", "w").collect()}
    assert got == {(0, 0): 1.0, (0, 1): 0.0, (1, 0): 0.2, (1, 1): 0.8}


def test_sampling_is_reproducible_and_method_independent(spark):
    rng = np.random.default_rng(4)
    rows = [(str(c), [int(x) + 10 * c for x in np.cumsum(rng.integers(0, 2, 10))]) for c in range(2) for _ in range(80)]
    df = spark.createDataFrame(rows, "target_class string, input_ids array<int>")
    model = M.MarkovModel.fit(df, 10)
    wanted = spark.createDataFrame([("0", 300), ("1", 40)], "target_class string, n long")
    take = lambda d: sorted((r["target_class"], r["seq_id"], tuple(r["input_ids"])) for r in d.collect())
    a = take(model.sample(wanted))
    assert len(a) == 340 and a == take(model.sample(wanted.repartition(7))) == take(model.sample(wanted, force_joins=True))
    assert a != take(model.sample(wanted, seed=2))
    drawn = spark.createDataFrame([(c, list(s)) for c, _, s in a], "target_class string, input_ids array<int>")
    old = {(r["target_class"], r["state"]): r["p"] for r in M.priors(df).collect()}
    for r in M.priors(drawn).collect():
        assert r["p"] == pytest.approx(old[(r["target_class"], r["state"])], abs=0.15)
    assert {len(s) for _, _, s in a} == {10}


def test_value_model_keeps_the_distribution(spark):
    rng = np.random.default_rng(6)
    rows = [("x", [float(v) for v in rng.choice([40.0, 500.0, 1500.0], 6, p=[0.5, 0.3, 0.2])]) for _ in range(300)]
    df = spark.createDataFrame(rows, "target_class string, values array<double>")
    model = M.QuantizedMarkov.fit(df, 6)
    out = np.array([r["values"] for r in model.sample(spark.createDataFrame([("x", 600)], "target_class string, n long")).collect()])
    for value, share in ((40.0, 0.5), (500.0, 0.3), (1500.0, 0.2)):
        assert np.isclose(out, value, atol=1).mean() == pytest.approx(share, abs=0.06)


def test_perplexity_of_a_certain_model(spark):
    df = spark.createDataFrame([("b", [7, 8, 7, 8])], "target_class string, input_ids array<int>")
    assert M.perplexity(df, M.transitions(df)).first()["perplexity"] == pytest.approx(1, abs=1e-5)


def test_state_index(spark):
    df = spark.createDataFrame([("a", 5), ("a", 3), ("a", 5), ("b", 9)], "c string, s int")
    got = {(r["c"], r["s"]): r["state_index"] for r in M.state_index(df, "s", ["c"]).collect()}
    assert got == {("a", 3): 0, ("a", 5): 1, ("b", 9): 0}
