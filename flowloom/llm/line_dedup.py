"""Removal of repeated passages by overlapping windows of three lines.

Lines are the \\n-parts of a text that hold a word; blank lines belong to no window and stay. Each three consecutive lines form a window, known by a hash.
Of all equal windows the one in the row with the smallest doc_id, and there the earliest, is the first; the lines of all later ones are removed. In
the row of the first itself, a later window gives up only lines behind the first window's end, so that the first stays whole where both overlap.
Covered positions of a row are merged and cut out in one step.

A null text stays null. Texts of fewer than three such lines stay as they are. A null doc_id comes after all others. Rows that agree in doc_id and text are one document and get the same result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.text import SPACED_WORD, row_key
from flowloom.plans.storage import write_and_read

LINES = 3
_SPACES = " \t\n\x0b\x0c\r"


def windows(docs: DataFrame) -> DataFrame:
    """(h, g, key, no_id, doc_id, at): every window of every row, `at` counting lines with a word from zero.

    Two hashes, of 128 bits together, name a window: 64 would meet by chance in a corpus of 10^10 lines.
    """
    lines = docs.select(
        "doc_id", row_key("doc_id", "text").alias("key"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(SPACED_WORD)).alias("__lines"),
    ).where(F.size("__lines") >= LINES)
    hashed = lines.withColumn("__hashes", F.transform("__lines", lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"))))

    def window(x: Column, i: Column) -> Column:
        own = [x, *[F.get("__hashes", i + k) for k in range(1, LINES)]]
        return F.struct(F.xxhash64(*[line["h"] for line in own]).alias("h"), F.xxhash64(*[line["g"] for line in own]).alias("g"))

    joined = F.transform(F.slice("__hashes", 1, F.size("__hashes") - (LINES - 1)), window)
    return hashed.select("doc_id", "key", F.posexplode(joined).alias("at", "w")).select(
        "w.h", "w.g", "key", F.col("doc_id").isNull().alias("no_id"), "doc_id", "at"
    )


def removals(docs: DataFrame) -> DataFrame:
    """(key, __spans): for each row that loses lines, the covered [start, stop) ranges in order; ranges may overlap.

    One aggregate with map-side combine finds repeated windows and their first place; one join, whose hot windows adaptive execution splits, marks the later ones.
    """
    found = write_and_read(windows(docs), "windows")
    place = F.struct("no_id", "doc_id", "key", "at")
    repeated = found.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(
        F.col("h").alias("__h"), F.col("g").alias("__g"), F.col("first.key").alias("__key"), F.col("first.at").alias("__at")
    )
    marked = found.join(repeated, (F.col("h") == F.col("__h")) & (F.col("g") == F.col("__g")))
    same = F.col("key") == F.col("__key")
    start = F.when(same, F.greatest(F.col("at"), F.col("__at") + LINES)).otherwise(F.col("at"))
    covered = marked.where(~(same & (F.col("at") == F.col("__at")))).select("key", start.alias("start"), (F.col("at") + LINES).alias("stop"))
    return covered.where("start < stop").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("__spans"))


def cut_lines(text: str, spans: list) -> tuple[str, int]:
    """The text without the lines (counted among those with a word) that lie in any of the ordered spans, and how many went."""
    kept, at, k, gone = [], 0, 0, 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            while k < len(spans) and spans[k]["stop"] <= at:
                k += 1
            covered = k < len(spans) and spans[k]["start"] <= at
            at += 1
            if covered:
                gone += 1
                continue
        kept.append(line)
    return "\n".join(kept), gone


def remove_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with repeated passages cut out of `text`; the number of lines that went is in `__removed`.

    A text all of whose lines go becomes empty. Only rows that lose lines pass through Python.
    """
    spans = removals(docs.select("doc_id", "text")).withColumnRenamed("key", "__gone")

    @F.pandas_udf("text string, gone long")
    def rewrite(texts: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        rows = [(None, 0) if c is None else cut_lines(t, list(c)) for t, c in zip(texts, cuts)]
        return pd.DataFrame(rows, columns=["text", "gone"])

    keyed = docs.withColumn("__key", row_key("doc_id", "text")).join(spans, F.col("__key") == F.col("__gone"), "left")
    cut = keyed.withColumn("__new", rewrite(F.when(F.col("__spans").isNotNull(), F.col("text")), F.col("__spans")))
    text = F.when(F.col("__spans").isNotNull(), F.col("__new.text")).otherwise(F.col("text"))
    return cut.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.col("__new.gone").alias("__removed"))
