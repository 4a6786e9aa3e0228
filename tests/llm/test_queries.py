"""Every query of the package against SQL or a brute-force version over whole tables."""

import hashlib
import re
from collections import Counter

import pandas as pd
import pytest

from flowloom.llm import queries, quality, secret_scan, surrogates
from tests.llm import brute
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def documents(data):
    return pd.read_parquet(f"{data}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, data, name):
    ok, message = compare(spark, connect(data), name, queries.QUERIES[name], queries.ORACLES[name], data)
    assert ok, message


def test_near_copies(spark, data, documents):
    got = queries.op1_simhash(spark, data).toPandas().set_index("doc_id").loc[documents.doc_id]
    fps = [brute.fingerprint(t) for t in documents.text]
    assert list(got.fingerprint) == [f"{x:016x}" for x in fps]
    assert list(got.component_id) == list(documents.doc_id.to_numpy()[brute.components(fps)])
    assert len(set(got.component_id)) < len(documents)


def test_languages(spark, data, documents):
    got = queries.op2_language(spark, data).toPandas().merge(documents[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out]
    assert len(got) == len(documents) and 0.1 < got.held_out.mean() < 0.3
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_secrets(spark, data, documents):
    got = queries.op7_secrets(spark, data).toPandas().set_index("doc_id").loc[documents.doc_id]
    spans = [brute.base_secrets(t) for t in documents.text]
    assert list(got.base_sha256) == [hashlib.sha256(s.encode()).hexdigest() for s in spans]
    for column, rule in zip(("n_assign", "n_access", "n_hex"), secret_scan.BASE):
        assert list(got[column]) == [s.count(rule.kind + ":") for s in spans]


def test_surrogates(spark, data, documents):
    got = queries.op9_surrogates(spark, data).toPandas().set_index("doc_id").loc[documents.doc_id]
    old, new, pairs = set(), set(), set()
    for before, after, n in zip(documents.text, got.text, got.n_entities):
        a, b = surrogates.find_entities(before), surrogates.find_entities(after)
        assert len(a) == len(b) == n
        assert (before == after) == (n == 0)
        gaps = lambda text, found: [text[i:j] for i, j in zip([0, *(e[1] for e in found)], [*(e[0] for e in found), len(text)])]
        assert gaps(before, a) == gaps(after, b)
        for x, y in zip(a, b):
            assert x[2] == y[2]
            pairs.add((x[2:], y[2:]))
        old |= {x[2:] for x in a}
        new |= {y[2:] for y in b}
    assert len(pairs) == len(old) == len(new) and not old & new and old


def test_pipeline(spark, data, documents):
    got = queries.QUERIES["pipeline"](spark, data).toPandas()
    want = brute.pipeline(documents, pd.read_parquet(f"{data}/labels.parquet"), pd.read_parquet(f"{data}/benchmark.parquet"))
    assert list(got.columns) == list(documents.columns)
    assert Counter(got[sorted(got)].itertuples(index=False, name=None)) == Counter(want[sorted(got)].itertuples(index=False, name=None))


def test_cutoffs_are_certified_on_separable_labels(spark):
    texts = [" ".join(f"w{i}a{k}" for k in range(30)) for i in range(900)] + [" ".join(f"### q{i}b{k}" for k in range(30)) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 900), 0) for i in range(1100)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).toPandas()
    assert not got.base_failed.any()
    assert list(got.sort_values("doc_id").kept) == [True] * 900 + [False] * 200


def test_binomial_tail(spark):
    from math import comb

    rows = [(n, k) for n in (1, 10, 300, 2000) for k in (0, 1, 3, 17) if k <= n * 0.01]
    frame = spark.createDataFrame(rows, "n long, k long")
    from pyspark.sql import functions as F

    for r in frame.withColumn("p", quality.binomial_tail(F.col("n"), F.col("k"), 0.01)).collect():
        exact = sum(comb(r.n, j) * 0.01**j * 0.99 ** (r.n - j) for j in range(r.k + 1))
        assert r.p == pytest.approx(exact, rel=1e-9)


def test_patterns_of_persons():
    found = surrogates.find_entities("Dear Mrs. Smith and Hans Meier, call +1 (555) 123-4567 or госпожа Иванова; 10.0.0.7, v1.2.3, 2024-01-02")
    assert [(k, n) for _, _, k, n in found] == [
        ("person", "Smith"), ("person", "Hans Meier"), ("phone", "15551234567"), ("person", "Иванова"), ("ip", "10.0.0.7")
    ]
    assert [surrogates.drawn_words(k, n) for _, _, k, n in found] == [["Smith"], ["Meier"], ["15551234567"], ["Иван"], ["10.0.0.7"]]
    for _, _, kind, norm in found:
        word, = surrogates.drawn_words(kind, norm)
        new = surrogates.surrogate(b"key", kind, word, 0)
        assert new == surrogates.surrogate(b"key", kind, word, 0) != surrogates.surrogate(b"other", kind, word, 0)
        assert kind != "person" or surrogates._script(new) == surrogates._script(norm)
    assert surrogates.dress(b"key", "phone", "+1 (555) 123-4567", ["12345678901"]) == "+1 (234) 567-8901"
    assert surrogates.dress(b"key", "person", "Иванова", ["Бала"]) == "Балаова"
    hans = surrogates.dress(b"key", "person", "Hans Meier", ["Badel"]).split(" ")
    assert hans[0] in surrogates.GIVEN["latin", "m"] and hans[0] != "Hans" and hans[1] == "Badel"
    card = surrogates.surrogate(b"key", "card", "4111111111111111", 0)
    assert len(card) == 16 and surrogates._luhn(card) == 0 and re.fullmatch(r"4\d+", card)
