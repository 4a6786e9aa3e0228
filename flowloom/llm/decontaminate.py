"""Benchmark decontamination, with DataFrame functions only.

Items and documents become lists of normalised words. Each ten consecutive words of an item are a window; an item of fewer words is one window. The windows'
hashes form a set that travels with the tasks when it was counted to be small; documents look up the hash of each of their windows in
it while they are scanned, without a shuffle. Beyond that size the documents' window hashes are joined with the set. Either
way the few rows that meet a hash are verified word by word before anything counts as a hit.

A null text has no words; items without words have no windows. Repeated windows, items and rows are allowed; rows that agree in doc_id and text get the
same result. A null item_id names no item, but its windows count as hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.text import PLAIN_WORD, computed_once, let, lower_ascii, row_key, sha256_hex, words_of
from flowloom.plans.storage import write_and_read

WIDTH = 10
#: Characters of words before lower-casing, and all others.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Distinct window hashes that may travel as a literal set.
SET_LIMIT = 50_000


def normal_words(text: Column) -> Column:
    return words_of(lower_ascii(text), PLAIN_WORD)


def _gram_hash(parts: list[Column]) -> Column:
    """The hash of a window from the hashes of its words."""
    return F.xxhash64(*parts)


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, len, h, ends, gram): the distinct windows of every item, hashed whole and by their first and last word."""
    items = benchmark.select("item_id", normal_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    full = items.where(F.size("words") >= width).select(
        "item_id", "words", F.explode(F.sequence(F.lit(1), F.size("words") - (width - 1))).alias("at")
    ).select("item_id", F.slice("words", F.col("at"), width).alias("gram"))
    short = items.where(F.size("words") < width).select("item_id", F.col("words").alias("gram"))
    grams = full.union(short).withColumn("len", F.size("gram"))
    hashed = F.lit(None).cast("long")
    for n in range(1, width + 1):
        hashed = F.when(F.col("len") == n, _gram_hash([F.xxhash64(F.get("gram", F.lit(k))) for k in range(n)])).otherwise(hashed)
    ends = F.xxhash64(F.xxhash64(F.get("gram", F.lit(0))), F.xxhash64(F.element_at("gram", -1)))
    return grams.select("item_id", "len", hashed.alias("h"), ends.alias("ends"), "gram").distinct()


def _met_in_row(words: Column, sets: dict[int, tuple[list[int], list[int]]]) -> Column:
    """The (at, len, h, gram) of every window of a row whose hash is in the set; a look at both ends comes first."""

    def of(hashes: Column) -> Column:
        found = []
        for n, (whole, ends) in sets.items():
            found.append(_met_of_length(words, hashes, n, whole, ends))
        return F.concat(*found)

    return let(_word_hashes(words), of)


def _met_of_length(words: Column, hashes: Column, n: int, whole: list[int], ends: list[int]) -> Column:
    def meet(first: Column, i: Column) -> Column:
        h = _gram_hash([first, *[F.get(hashes, i + k) for k in range(1, n)]])
        met = F.struct(i.cast("int").alias("at"), F.lit(n).alias("len"), h.alias("h"), F.slice(words, i + 1, F.lit(n)).alias("gram"))
        return F.when(F.xxhash64(first, F.get(hashes, i + (n - 1))).isin(ends), F.when(h.isin(whole), met))

    starts = F.slice(hashes, 1, F.greatest(F.size(hashes) - (n - 1), F.lit(0)))
    return F.filter(F.transform(starts, meet), lambda x: x.isNotNull())


def _met_by_join(worded: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(__key, at, len, h, gram) by a join on the hash, for sets of any size; hot windows are left to adaptive execution."""
    exploded = None
    for n in lengths:
        def grams(hashes: Column, width: int) -> Column:
            return F.transform(
                F.slice(hashes, 1, F.greatest(F.size(hashes) - (width - 1), F.lit(0))),
                lambda h, i: _gram_hash([h, *[F.get(hashes, i + k) for k in range(1, width)]]),
            )

        hashed = let(_word_hashes(F.col("__words")), lambda hashes: grams(hashes, n))  # noqa: B023
        own = worded.select("__key", "__words", F.posexplode(hashed).alias("at", "h"))
        own = own.select("__key", "at", F.lit(n).alias("len"), "h", F.slice("__words", F.col("at") + 1, F.lit(n)).alias("gram"))
        exploded = own if exploded is None else exploded.union(own)
    return exploded.join(windows.select("len", "h").distinct(), ["len", "h"], "left_semi").select("__key", "at", "len", "h", "gram")


def _verified(met: DataFrame, windows: DataFrame) -> DataFrame:
    """(__k, __spans, __items) for rows with a verified hit: ordered (at, len) ranges, items sorted as strings."""
    true = met.distinct().join(windows, ["len", "h", "gram"])
    return true.groupBy(F.col("__key").alias("__k")).agg(
        F.sort_array(F.collect_set(F.struct("at", "len"))).alias("__spans"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("__items"),
    )


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, set_limit: int = SET_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(scanned, found): doc_id, __key and n_words of every row, and the verified hits by `__k`; both stored."""
    windows = write_and_read(item_windows(benchmark, width), "windows")
    sizes = {r["len"]: r["count"] for r in windows.select("len", "h").distinct().groupBy("len").count().collect()}  # at most `width` rows
    key, words = row_key("doc_id", "text").alias("__key"), normal_words(F.col("text"))
    if sum(sizes.values()) <= set_limit:
        sets: dict[int, tuple[list[int], list[int]]] = {n: ([], []) for n in sorted(sizes) or [width]}
        for r in windows.select("len", "h", "ends").distinct().collect():  # counted above
            sets[r["len"]][0].append(r["h"])
            sets[r["len"]][1].append(r["ends"])
        found = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _met_in_row(w, sets).alias("met")))
        scanned = write_and_read(computed_once(docs, "__m", found, "doc_id", key).select("doc_id", "__key", "__m.*"), "scanned")
        met = scanned.where(F.size("met") > 0).select("__key", F.explode("met").alias("m")).select("__key", "m.*")
    else:
        worded = computed_once(docs, "__words", words, "doc_id", key)
        scanned = write_and_read(worded.select("doc_id", "__key", F.size("__words").cast("long").alias("n_words")), "scanned")
        met = _met_by_join(worded, windows, sorted(sizes))
    return scanned.select("doc_id", "__key", "n_words"), write_and_read(_verified(met, windows), "hits")


def _union_size(spans: str) -> Column:
    """Words in any of the ordered (at, len) ranges. A range reaches as far as the furthest of those that begin no later."""
    ends = F.aggregate(
        spans, F.struct(F.lit(0).alias("upto"), F.lit(0).alias("total")),
        lambda a, s: F.struct(
            F.greatest(a["upto"], s["at"] + s["len"]).alias("upto"),
            (a["total"] + F.greatest(F.lit(0), s["at"] + s["len"] - F.greatest(a["upto"], s["at"]))).alias("total"),
        ),
    )
    return ends["total"]


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, set_limit: int = SET_LIMIT) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row."""
    scanned, found = scan(docs, benchmark, width, set_limit)
    return scanned.join(found, F.col("__key") == F.col("__k"), "left").select(
        "doc_id", "n_words",
        F.coalesce(_union_size("__spans"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("__items"), F.lit(0)).cast("long").alias("n_items"),
        sha256_hex(F.coalesce(F.array_join("__items", ","), F.lit(""))).alias("items_sha256"),
        F.col("__spans").isNotNull().alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, set_limit: int = SET_LIMIT) -> DataFrame:
    """The rows of `docs` that hold no window of any item."""
    found = scan(docs, benchmark, width, set_limit)[1]
    keyed = docs.withColumn("__key", row_key("doc_id", "text"))
    return keyed.join(found.select("__k"), F.col("__key") == F.col("__k"), "left_anti").drop("__key")


def _merged(spans: str) -> Column:
    """The ordered (at, len) ranges as (start, stop) ranges that don't touch."""
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    def add(done: Column, s: Column) -> Column:
        last, stop = F.element_at(done, -1), s["at"] + s["len"]
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], stop).alias("stop"))
        return F.when(F.size(done) == 0, F.array(F.struct(s["at"].alias("start"), stop.alias("stop")))).when(
            s["at"] <= last["stop"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
        ).otherwise(F.concat(done, F.array(F.struct(s["at"].alias("start"), stop.alias("stop")))))

    return F.aggregate(spans, empty, add)


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, set_limit: int = SET_LIMIT) -> DataFrame:
    """`docs` with every hit word, and the characters up to the next word, taken out of `text`; the rest stays as it is."""
    found = scan(docs, benchmark, width, set_limit)[1]
    keyed = docs.withColumn("__key", row_key("doc_id", "text"))
    joined = keyed.join(found.withColumn("__cuts", _merged("__spans")).select("__k", "__cuts"), F.col("__key") == F.col("__k"), "left")
    hit = F.col("__cuts").isNotNull()
    pieces = joined.withColumn("__parts", F.when(hit, F.regexp_extract_all("text", F.lit(f"{_WORD}+{_OTHER}*"), F.lit(0))))
    left = F.filter("__parts", lambda part, i: ~F.exists("__cuts", lambda c: (c["start"] <= i) & (i < c["stop"])))
    text = F.when(hit, F.concat(F.regexp_extract("text", f"^{_OTHER}*", 0), F.array_join(left, ""))).otherwise(F.col("text"))
    return pieces.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
