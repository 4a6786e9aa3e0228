"""Stupid-backoff language-model scores of documents, computed relationally.

Tokens are the characters of a text (A-Z lower-cased, runs of spaces as one), or its words. The corpus itself is the model: trigrams of all documents are counted
into tables partitioned by the trigram's hash; shorter counts are sums of those tables. Documents are exploded into their distinct
trigrams, joined with the tables and summed. A document is judged by what the others say: its own counts are taken off first. With C the remaining counts, token c
after a, b scores C(abc)/C(ab), else 0.4 C(bc)/C(b), else 0.16 C(c)/N, else 0.064/(N+1); the document's score is the mean of log10.

A null text and a text without tokens have 0 tokens and a null score. Rows that agree in doc_id and text get the same score and still
count as documents of their own, so each supports the other. An extremely long text is held by one task while it is scored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.text import row_key
from flowloom.plans.storage import write_and_read

BACKOFF = 0.4
#: Rows of the count table (at most 100 bytes each) up to which it is sent to all tasks; beyond, both sides are shuffled by hash.
SEND_ROWS = 500_000
_ROWS = 262_144


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs; exact pairs of characters and trigrams of them practically never meet."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _tokens(text: str | None, unit: str) -> np.ndarray:
    """Token numbers of a text, from 1 up for characters."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if unit == "word":
        return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64).view(np.int64)
    return np.frombuffer(b" ".join(words).decode().encode("utf-32-le", "replace"), np.uint32).astype(np.int64) + 1


class Grams:
    """The distinct trigrams of a text: hash, tokens a, b, c, and how often the text has abc, ab-, bc, b- and c."""

    def __init__(self, tokens: np.ndarray):
        a, b = np.concatenate(([0, 0], tokens[:-2]))[:len(tokens)], np.concatenate(([0], tokens[:-1]))
        ab = _mix(a, b)
        self.h, first, self.abc = np.unique(_mix(ab, tokens), return_index=True, return_counts=True)
        self.a, self.b, self.c = a[first], b[first], tokens[first]
        self.ab, self.bc, self.b1, self.c1 = (self._sums(k) for k in (ab[first], _mix(self.b, self.c), self.b, self.c))

    def _sums(self, keys: np.ndarray) -> np.ndarray:
        _, group = np.unique(keys, return_inverse=True)
        return np.bincount(group, weights=self.abc).astype(np.int64)[group]


def count_table(docs: DataFrame, unit: str) -> DataFrame:
    """(h, c_abc, c_ab, c_bc, c_b, c_c, n) of every trigram of the corpus, partitioned by hash."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                tokens = _tokens(text.as_py(), unit)
                if len(tokens):
                    waiting.append(Grams(tokens))
                    size += len(waiting[-1].h)
                if size >= _ROWS:
                    yield summed(waiting)
                    waiting, size = [], 0
        if waiting:
            yield summed(waiting)

    def summed(grams: list[Grams]) -> pa.RecordBatch:
        h, first, group = np.unique(np.concatenate([g.h for g in grams]), return_index=True, return_inverse=True)
        total = np.bincount(group, weights=np.concatenate([g.abc for g in grams])).astype(np.int64)
        parts = [np.concatenate([getattr(g, k) for g in grams])[first] for k in "abc"]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, *parts, total)], ["h", "a", "b", "c", "n"])

    found = docs.select("text").mapInArrow(counted, "h long, a long, b long, c long, n long")
    trigrams = write_and_read(found.groupBy("h").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("c").alias("c"), F.sum("n").alias("c_abc")), "trigrams")
    ab = trigrams.groupBy("a", "b").agg(F.sum("c_abc").alias("c_ab"))
    bc = write_and_read(trigrams.groupBy("b", "c").agg(F.sum("c_abc").alias("c_bc")), "bigrams")
    b = bc.groupBy("b").agg(F.sum("c_bc").alias("c_b"))
    c = bc.groupBy("c").agg(F.sum("c_bc").alias("c_c"))
    n = bc.agg(F.coalesce(F.sum("c_bc"), F.lit(0))).first()[0]
    table = trigrams.join(ab, ["a", "b"]).join(bc, ["b", "c"]).join(b, "b").join(c, "c")
    return write_and_read(table.select("h", "c_abc", "c_ab", "c_bc", "c_b", "c_c", F.lit(n).cast("long").alias("n")), "counts")


def exploded(docs: DataFrame, unit: str) -> DataFrame:
    """(key, h, m_abc, m_ab, m_bc, m_b, m_c): the distinct trigrams of every row with its own counts."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting, size = [], 0
            for key, text in zip(batch.column(0), batch.column(1)):
                tokens = _tokens(text.as_py(), unit)
                if len(tokens):
                    waiting.append((key.as_py(), Grams(tokens)))
                    size += len(waiting[-1][1].h)
                if size >= _ROWS:
                    yield out(waiting)
                    waiting, size = [], 0
            if waiting:
                yield out(waiting)

    def out(waiting: list) -> pa.RecordBatch:
        keys = np.repeat(np.array([k for k, _ in waiting], np.int64), [len(g.h) for _, g in waiting])
        own = [np.concatenate([getattr(g, k) for _, g in waiting]).astype(np.int32) for k in ("abc", "ab", "bc", "b1", "c1")]
        return pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(np.concatenate([g.h for _, g in waiting])), *map(pa.array, own)], ["key", "h", "m_abc", "m_ab", "m_bc", "m_b", "m_c"]
        )

    return docs.select(row_key("doc_id", "text").alias("key"), "text").mapInArrow(
        rows, "key long, h long, m_abc int, m_ab int, m_bc int, m_b int, m_c int"
    )


def score(docs: DataFrame, unit: str = "char", send_rows: int = SEND_ROWS) -> DataFrame:
    """doc_id, n_tokens, score for every row; unit is "char" or "word"."""
    ours = docs.select("doc_id", "text")
    counts = count_table(ours, unit)
    if counts.count() <= send_rows:
        counts = F.broadcast(counts)
    joined = exploded(ours, unit).join(counts, "h")
    rest = {k: F.col(f"c_{k}") - F.col(f"m_{k}") for k in ("abc", "ab", "bc", "b", "c")}
    others = F.col("n")
    value = (
        F.when(rest["abc"] > 0, rest["abc"] / rest["ab"])
        .when(rest["bc"] > 0, BACKOFF * rest["bc"] / rest["b"])
        .when(rest["c"] > 0, BACKOFF**2 * rest["c"] / others)
        .otherwise(BACKOFF**3 / (others + 1))
    )
    sums = joined.groupBy("key").agg(F.sum("m_abc").alias("__n"), F.sum(F.col("m_abc") * F.log10(value)).alias("__sum"))
    copies = ours.withColumn("key", row_key("doc_id", "text")).select("doc_id", "key")
    many = write_and_read(copies, "keys")
    repeats = many.groupBy("key").agg(F.count("*").alias("__copies"))
    scored = sums.join(repeats, "key").select(
        F.col("key").alias("__key"), (F.col("__n") / F.col("__copies")).cast("long").alias("__tokens"), F.round(F.col("__sum") / F.col("__n"), 6).alias("score")
    )
    return many.join(scored, F.col("key") == F.col("__key"), "left").select(
        "doc_id", F.coalesce("__tokens", F.lit(0)).cast("long").alias("n_tokens"), "score"
    )
