"""Near copies by shingle similarity against all pairs."""

import random

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from flowloom.llm import near_text, simhash
from tests.llm.brute import similar_texts


def test_edited_copies_on_documents(spark, data):
    docs = pd.read_parquet(f"{data}/documents.parquet").sort_values("doc_id").reset_index(drop=True)
    label = similar_texts(docs.text)
    got = corpus_pipeline.near_copies(spark, spark.read.parquet(f"{data}/documents.parquet"), data).toPandas()
    assert sorted(got.doc_id) == [d for i, d in enumerate(docs.doc_id) if label[i] == i]


@pytest.mark.parametrize("block", [128, 3])
def test_chains_and_families(spark, monkeypatch, block):
    monkeypatch.setattr(near_text, "BLOCK", block)
    draw = random.Random(1)
    texts = [None, "", "one two", "ONE  two"]
    for family in range(6):
        words = [f"f{family}w{i}" for i in range(150)]
        for _ in range(40):
            words[draw.randrange(150)] = f"x{draw.random()}"
            texts.append(" ".join(words))
        words = [f"f{family}w{i}" for i in range(150)]
        for _ in range(20):
            other = list(words)
            for _ in range(2):
                other[draw.randrange(150)] = f"y{draw.random()}"
            texts.append(" ".join(other))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    label = similar_texts(texts)
    kept = sorted(r.doc_id for r in near_text.keep_one(docs).collect())
    assert kept == sorted(set(label))
    assert near_text.bands(near_text.shingles("")) == [] and len(kept) < len(texts) / 2


def test_fingerprints_and_shingles_link_together(spark):
    """The first two texts share a fingerprint but few shingles, the second and third all shingles but no fingerprint."""
    round_ = "one two three four five six seven "
    texts = [round_ * 60 + "a b c d", round_ * 60 + "e f g h", round_ * 2 + "e f g h", "some other words that nobody else has", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    sets, prints = [near_text.shingles(t) for t in texts], np.array([simhash.fingerprint(t) for t in texts], np.uint64)
    assert not near_text.similar(sets[0], sets[1]) and np.bitwise_count(prints[0] ^ prints[1]) <= 3
    assert near_text.similar(sets[1], sets[2]) and np.bitwise_count(prints[1] ^ prints[2]) > 3
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [0, 3, 4]
    assert corpus_pipeline.near_copies(spark, docs.limit(0), "").count() == 0


def test_forest_connects_what_pairs_connect():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 10**6, 200)
    sets = [np.unique(np.concatenate([base[rng.random(200) < 0.93], rng.integers(0, 10**6, 8)])) for _ in range(60)]
    nodes, same = np.arange(60), np.zeros(60, np.int64)
    found = near_text.forest(nodes, nodes, sets, same)
    pairs = [(i, j) for i in range(60) for j in range(i) if near_text.similar(sets[i], sets[j])]
    assert len(found) == 60 - len(set(groups(60, pairs))) and groups(60, found) == groups(60, pairs) and pairs
    side = nodes % 2
    assert groups(60, near_text.forest(nodes, nodes, sets, side)) == groups(60, [(i, j) for i, j in pairs if side[i] != side[j]])
    assert near_text.forest(nodes, same, sets, same) == []


def groups(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    return label
