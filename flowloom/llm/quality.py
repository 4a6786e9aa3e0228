"""Quality rules whose cutoffs carry a guarantee, with DataFrame functions only.

Each rule rejects a document whose measure lies above a cutoff. Candidate cutoffs are fixed from mild to strict. For each stratum and rule the labelled
good documents are the holdout: with k of n above a cutoff, the exact binomial tail P(Bin(n, alpha) <= k) is the p-value of "this cutoff rejects more
than a share alpha of the good documents". Cutoffs are tested from the mildest on and the last that passes is taken (fixed
sequence, no price for many candidates); the level is divided by the number of strata and rules (Bonferroni). With
probability 1 - level, no certified cutoff anywhere rejects more than alpha of the good documents.

A null text has no words. A stratum without labelled good documents gets no cutoffs. A null stratum is a stratum of its own. Several
labels of one doc_id count once, as good if one of them says so; rows that repeat a doc_id are measured each on their own, in the holdout too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.text import SPACED_WORD, computed_once, let, words_of
from flowloom.plans.storage import write_and_read

WINDOW = 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Fixed candidates, mild to strict.
RULES = {
    "symbols": [1.0, 0.5, 0.3, 0.2, 0.15],
    "dup_lines": [0.8, 0.6, 0.5, 0.4, 0.3],
    "repeats": [0.18, 0.16, 0.14, 0.12, 0.1],
    "capitals": [0.9, 0.8, 0.7, 0.6, 0.5],
}


@dataclass(frozen=True)
class Risk:
    """At most `alpha` of the good documents of a stratum may be rejected by each rule, with confidence 1 - `level` for all together."""

    alpha: float = 0.01
    level: float = 0.05
    rules: dict[str, list[float]] = field(default_factory=lambda: dict(RULES))


def _repeated_words(words: Column) -> Column:
    """Words in windows that occur twice or more; windows are compared by a 64-bit hash, and sorted only where some hash repeats."""
    def grams(hashes: Column) -> Column:
        return F.transform(
            F.slice(hashes, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))),
            lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]),
        )

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    def twice(ordered: Column) -> Column:
        found = F.filter(ordered, lambda x, i: F.get(ordered, i - 1)["g"].eqNullSafe(x["g"]) | F.get(ordered, i + 1)["g"].eqNullSafe(x["g"]))
        return let(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    def count(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(grams) > F.size(F.array_distinct(grams)), let(ordered, twice)).otherwise(F.lit(0).cast("long"))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), grams), count)


def _counts(text: Column) -> Column:
    lines = F.coalesce(F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACED_WORD)), F.array().cast("array<string>"))
    of_words = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeated_words(w).alias("n_repeat_words"),
    ))
    of_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
    ))
    return F.struct(
        of_words.alias("words"), of_lines.alias("lines"), _count(text, r"[#*$%&|<>]").alias("n_symbols"), _count(text, "[A-Z]").alias("capitals")
    )


def measures(docs: DataFrame, *carried: str) -> DataFrame:
    """`carried` columns, the base counts and the measure of each rule, in one pass without a shuffle."""
    counted = computed_once(docs, "__m", _counts(F.col("text")), *carried).select(
        *carried, "__m.words.n_words", "__m.words.word_chars", "__m.n_symbols", "__m.lines.n_dup_lines", "__m.words.n_repeat_words",
        F.col("__m.lines.n_lines").alias("__n_lines"), F.col("__m.capitals").alias("__capitals"),
    )
    return counted.select(
        *carried, *BASE,
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        _share("n_symbols", "n_words").alias("m_symbols"),
        _share("n_dup_lines", "__n_lines").alias("m_dup_lines"),
        _share("n_repeat_words", "n_words").alias("m_repeats"),
        _share("__capitals", "word_chars").alias("m_capitals"),
    )


def _count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.length(text) - F.length(F.regexp_replace(text, pattern, "")), F.lit(0)).cast("long")


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series beyond a shift of ten; the error is below 1e-12."""
    x = n.cast("double") + 11.0
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    shift = F.lit(0.0)
    for k in range(1, 11):
        shift = shift + F.log(n.cast("double") + k)
    return series - shift


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k up to the mean, exact to rounding; 1 beyond the mean, where no test passes.

    Terms are summed downwards from k; those that are left out are below the smallest double beside the first.
    """
    terms = F.sequence(F.greatest(F.lit(0).cast("long"), (k - 60 - 10 * F.sqrt(n.cast("double"))).cast("long")), k)

    def term(j: Column) -> Column:
        chosen = _log_factorial(n) - _log_factorial(j) - _log_factorial(n - j)
        return F.exp(chosen + j * F.log(F.lit(p)) + (n - j) * F.log1p(F.lit(-p)))

    total = F.aggregate(F.transform(terms, term), F.lit(0.0), lambda a, b: a + b)
    return F.when(k > n * F.lit(p), 1.0).otherwise(F.least(total, F.lit(1.0)))


def certified_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, risk: Risk = Risk()) -> DataFrame:
    """(stratum, c_<rule> ...): the strictest certified cutoff of each rule, or null."""
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("__quality")).where("__quality = 1").select("doc_id")
    holdout = measured.where("not base_failed").join(good, "doc_id", "left_semi")
    counts = holdout.groupBy(stratum).agg(F.count("*").alias("n"), *[
        F.count_if(F.col(f"m_{rule}") > cut).alias(f"k_{rule}_{i}") for rule, cuts in risk.rules.items() for i, cut in enumerate(cuts)
    ])
    strata = write_and_read(counts, "holdout")
    level = risk.level / max(1, strata.count() * len(risk.rules))
    candidates = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(cut).alias("cut"), F.col(f"k_{rule}_{i}").alias("k"))
        for rule, cuts in risk.rules.items() for i, cut in enumerate(cuts)
    ])
    tested = strata.select(F.col(stratum).alias("__stratum"), "n", F.explode(candidates).alias("c")).select("__stratum", "n", "c.*")
    # k, and with it the p-value, grows along a rule's candidates: the last that passes ends the sequence of those that pass
    passed = tested.withColumn("p", binomial_tail(F.col("n"), F.col("k"), risk.alpha)).where(F.col("p") <= level)
    return write_and_read(passed.groupBy("__stratum").agg(*[
        F.max(F.when(F.col("rule") == rule, F.struct("step", "cut")))["cut"].alias(f"c_{rule}") for rule in risk.rules
    ]), "cutoffs")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk(), carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `carried`, the base counts, base_failed and kept, one row for each row of `docs`."""
    keep = list(dict.fromkeys(["doc_id", stratum, *carried]))
    measured = write_and_read(measures(docs, *keep), "measures")
    cutoffs = certified_cutoffs(measured, labels, stratum, risk)
    rejected = F.lit(False)
    for rule in risk.rules:
        rejected = rejected | F.coalesce(F.col(f"m_{rule}") > F.col(f"c_{rule}"), F.lit(False))
    joined = measured.join(cutoffs, F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    return joined.select(*list(dict.fromkeys(["doc_id", *carried])), *BASE, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))


def filter_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """The rows of `docs` that the rules keep, with their columns.

    Cutoffs come from a first pass over all rows; the rules then run in the same pass that filters.
    """
    ours = docs.select("doc_id", stratum, "text")
    cutoffs = certified_cutoffs(write_and_read(measures(ours, "doc_id", stratum), "measures"), labels, stratum, risk)
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col("text"), F.col(stratum).alias("__own"))
    measured = measures(packed, "__row", "__own").join(cutoffs, F.col("__own").eqNullSafe(F.col("__stratum")), "left")
    rejected = F.col("base_failed")
    for rule in risk.rules:
        rejected = rejected | F.coalesce(F.col(f"m_{rule}") > F.col(f"c_{rule}"), F.lit(False))
    return measured.where(~rejected).select(*[F.col("__row")[c].alias(c) for c in names])
