"""Language profiles against a plain version: one trigram after another, one document after another."""

import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pytest

from flowloom.llm import langid, queries


@lru_cache(None)
def letter(c: str) -> np.ndarray:
    return np.random.default_rng((20_240, ord(c) if c != " " else 0)).integers(0, 2, 1024, np.int8).astype(int) * 2 - 1


@lru_cache(100_000)
def trigram(g: str) -> np.ndarray:
    return np.roll(letter(g[0]), 2) * np.roll(letter(g[1]), 1) * letter(g[2])


def bundle(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not words:
        return None
    line = f" {' '.join(words)} "
    return sum(n * trigram(g) for g, n in Counter(line[i:i + 3] for i in range(len(line) - 2)).items())


def plain(rows):
    """{doc_id: (held_out, cosine by language or None)}"""
    bundles = {d: bundle(text) for d, _, text in rows}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d, *_ in rows}
    sums = {}
    for d, lang, _ in rows:
        if lang is not None and not held[d] and bundles[d] is not None:
            sums[lang] = sums.get(lang, 0) + bundles[d]
    cosine = lambda a, b: float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12))
    return {d: (held[d], None if b is None else {x: cosine(v, b) for x, v in sums.items()}) for d, b in bundles.items()}


def agree(got, rows):
    expected = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        held, cosines = expected[r.doc_id]
        assert r.held_out == held
        if not cosines:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        best = max(cosines.values())
        assert cosines[r.lang_pred] == pytest.approx(best, abs=1e-9)  # ties to rounding
        assert r.score == pytest.approx(min(1.0, max(0.0, best)), abs=1e-9)


def test_given_documents(spark, data):
    docs = pd.read_parquet(f"{data}/documents.parquet", columns=["doc_id", "lang", "text"]).astype(object)
    rows = [tuple(None if pd.isna(x) else x for x in r) for r in docs.itertuples(index=False)]
    agree(queries.op2_language(spark, data).collect(), rows)


def test_scripts_gaps_and_long_texts(spark):
    texts = {
        "en": ["The quick brown fox, and the lazy dog!", "it's  a\tgap\n\nand another", "the " * 30_000],
        "de": ["Der schnelle Fuchs läuft über die Straße", "ÜBER ALLE Berge"], "ru": ["Быстрая лиса и ленивая собака", "и ещё раз"],
        None: [None, "", "12 34 !?", "the fox and die Straße", "a", "İI ıi ǅ"],
    }
    rows = [(i, lang, text) for i, (lang, text) in enumerate((lang, t) for _ in range(6) for lang, ts in texts.items() for t in ts)]
    table = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    agree(langid.identify(table).collect(), rows)
