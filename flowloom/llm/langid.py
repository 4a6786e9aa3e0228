"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 made from its code point. A trigram is bound by multiplying its letters' vectors, the first rotated twice and the second once;
gaps between words are a letter of their own. The trigram vectors of a text are bundled, that is added up. A language's prototype is the
bundle of its training texts, and a text belongs to the language whose prototype has the largest cosine with its bundle (ties: the first by code point).

The prototypes are fitted on a sample with a documented bound: rows whose id hashes below a threshold, `per_lang` rows of each language in expectation.
Texts are lower-cased and read whole. A null text or one without a letter is `und` with score 0, and so is everything if no training row
has a language. A null doc_id is read as ''. Repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.plans.storage import write_and_read

DIM = 1024
PER_LANG = 2_000
#: Languages that may be learned; a prototype is 4 KB.
MAX_LANGS = 4_096
UNKNOWN = "und"
_SEED = 20_240
_CACHE = 32_768
_BITS = 21


class Space:
    """Letter and trigram vectors of one worker, made when first needed."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.known = np.zeros(0x110000, np.int8)  # 0 not seen, 1 letter, 2 other
        self.letters: dict[int, np.ndarray] = {}
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[int, int] = {}
        self.table = np.empty((_CACHE, self.dim), np.int8)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng((_SEED, code)).integers(0, 2, self.dim, np.int8) * 2 - 1
        return self.letters[code]

    def _bind(self, gram: int) -> np.ndarray:
        mask = (1 << _BITS) - 1
        a, b, c = gram >> 2 * _BITS, gram >> _BITS & mask, gram & mask
        return np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)

    def trigrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct trigrams and their counts, or None without a letter."""
        if not text:
            return None
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        kinds = self.known[codes]
        if not kinds.all():
            for code in set(codes[kinds == 0].tolist()):
                self.known[code] = 1 if chr(code).isalpha() else 2
            kinds = self.known[codes]
        letter = kinds == 1
        if not letter.any():
            return None
        codes[~letter] = 0
        codes = np.concatenate(([0], codes, [0]))
        codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
        return np.unique(codes[:-2] << 2 * _BITS | codes[1:-1] << _BITS | codes[2:], return_counts=True)

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dim, np.float64)
        for start in range(0, len(grams), 4_096):
            part = grams[start:start + 4_096].tolist()
            if len(self.rows) + len(part) > _CACHE:
                self._forget()
            at = np.empty(len(part), np.int64)
            for i, gram in enumerate(part):
                row = self.rows.get(gram)
                if row is None:
                    row = self.rows[gram] = len(self.rows)
                    self.table[row] = self._bind(gram)
                at[i] = row
            weights = counts[start:start + 4_096]
            if weights.max() < 1 << 23:
                total += (weights.astype(np.float32) @ self.table[at].astype(np.float32)).astype(np.float64)
            else:
                total += weights.astype(np.float64) @ self.table[at].astype(np.float64)
        return total


_SPACES: dict[int, Space] = {}


def _space(dim: int) -> Space:
    if dim not in _SPACES:
        _SPACES[dim] = Space(dim)
    return _SPACES[dim]


def sample(training: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """About `per_lang` rows (lang, text) of each language, the same ones on every run."""
    counts = write_and_read(training.where(F.col("lang").isNotNull()).groupBy(F.col("lang").alias("__lang")).agg(F.count("*").alias("n")), "langs")
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("lang")), F.lit(1 << 31))
    return training.join(counts, F.col("lang") == F.col("__lang")).where(
        draw * F.col("n") < F.lit(per_lang) * F.lit(1 << 31)
    ).select("lang", "text")


def fit(training: DataFrame, per_lang: int = PER_LANG, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """(languages by code point, their prototypes as unit rows) from rows (doc_id, lang, text)."""

    def bundles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = _space(dim), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if found := space.trigrams(text):
                    sums[lang] = sums.get(lang, 0) + np.rint(space.bundle(*found)).astype(np.int64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(total)], ["lang", "at", "v"])

    parts = sample(training, per_lang).mapInArrow(bundles, "lang string, at int, v long")
    totals = write_and_read(parts.groupBy("lang", "at").agg(F.sum("v").alias("v")), "prototypes")
    if totals.select("lang").distinct().count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    rows = totals.toPandas()  # dim numbers per language, counted above
    langs = sorted(rows["lang"].unique(), key=lambda x: x.encode())
    table = np.zeros((len(langs), dim))
    if langs:
        table[rows["lang"].map({x: i for i, x in enumerate(langs)}), rows["at"]] = rows["v"]
        table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)
    return langs, table


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, text_col: str = "text") -> DataFrame:
    """`docs` with `__lang`: a struct of lang and score."""

    @F.pandas_udf("lang string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        space, names, scores = _space(prototypes.shape[1]), [], []
        for text in texts:
            found = space.trigrams(text) if langs else None
            if found is None:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            bundle = space.bundle(*found)
            cosines = prototypes @ bundle / max(np.linalg.norm(bundle), 1e-12)
            best = int(np.argmax(cosines))
            names.append(langs[best])
            scores.append(float(min(1.0, max(0.0, cosines[best]))))
        return pd.DataFrame({"lang": names, "score": scores})

    return docs.withColumn("__lang", of(F.col(text_col)))


def identify(docs: DataFrame, per_lang: int = PER_LANG, dim: int = DIM) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the rows that are not held out."""
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0)
    rows = docs.select("doc_id", "lang", "text", held.alias("held_out"))
    langs, prototypes = fit(rows.where(~F.col("held_out")), per_lang, dim)
    found = predict(rows.select("doc_id", "held_out", "text"), langs, prototypes)
    return found.select("doc_id", "held_out", F.col("__lang.lang").alias("lang_pred"), F.col("__lang.score").alias("score"))
