"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, target / size of its source. Along a fixed order of the source's documents the expected copies are summed up,
one random offset per source is added, and a document is emitted once for each whole number that the sum crosses at it. The order runs by
size and then by a hash of the id, so that neighbours are of like size and the words taken stay near the target.

The running sum needs the rank of a document only. Ranks come from three levels, none of which is a whole source: sizes of a source, hash slices of a size, rows of a slice.

A null text has size 0. A null source is a source of its own, the last in order. Documents of size 0 get copies too, which take no words. A source
of total size 0 has target 0 and nothing of it is taken. Rows that agree in source, size and doc_id are interchangeable. A null doc_id counts as ''.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.llm.text import row_key
from flowloom.plans.storage import write_and_read


@dataclass(frozen=True)
class Mix:
    """Weights repeat over the sources in order; the mix takes `share` of all sizes, and of a source at most `cap` times its size."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    cap: int = 2
    seed: str = "mix"


_SPACE = r"[\x20\x09-\x0D]"
_SPACES = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]


def n_words(text: Column) -> Column:
    """The number of words, from the gaps between them; an absent or empty text has none."""
    edges = F.substring(text, 1, 1).isin(_SPACES).cast("long") + F.substring(text, -1, 1).isin(_SPACES).cast("long")
    return F.when(F.length(text) > 0, F.size(F.split(text, f"{_SPACE}+")) - edges).otherwise(0).cast("long")


def targets(totals: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """From (source, source_size): (__source, source_size, target): shares by weight, with what exceeds the cap dealt out again by weight until nothing exceeds it.

    Sources that reach their cap are those with the least size per weight, so one running sum in that order finds where the cap ends. The
    table has one row per source; the order over all sources is the only step in a single task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in mix.weights])
    weighed = totals.withColumn("w", F.get(weights, (F.row_number().over(by_name) - 1) % len(mix.weights)).cast("long"))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    filled = weighed.select(
        "*", F.sum("source_size").over(every).alias("all_size"), F.sum("w").over(every).alias("all_w"),
        F.coalesce(F.sum("source_size").over(fill), F.lit(0)).alias("size_before"), F.coalesce(F.sum("w").over(fill), F.lit(0)).alias("w_before"),
    ).withColumn("level", (F.col("all_size") * F.lit(mix.share) - mix.cap * F.col("size_before")) / (F.col("all_w") - F.col("w_before")))
    # the first source in that order that stays below its cap sets the level of all that follow
    open_ = F.min(F.when(F.col("level") * F.col("w") <= mix.cap * F.col("source_size"), F.struct("w_before", "level"))).over(every)
    return filled.withColumn("open", open_).select(
        F.col("source").alias("__source"), "source_size",
        F.when(F.col("w_before") >= F.col("open.w_before"), F.col("open.level") * F.col("w"))
        .otherwise(mix.cap * F.col("source_size")).cast("double").alias("target"),
    )


def _offset(seed: str) -> Column:
    """A number in [0, 1) for each source."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def draw(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """`sized` (doc_id, source, size, __tie, any more) with source_size, target and `copies`.

    `sized` is read twice, for the counts and for the rows; the rows are shuffled once. Ties in order are broken by __tie.
    """
    tag = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    # a name that is never absent: joins and windows on it share one partitioning
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    tagged = sized.withColumn("__tag", tag).withColumn("__slice", F.substring("__tag", 1, 2)).withColumn("__name", name)
    place = ["__name", "size", "__slice"]
    slices = write_and_read(tagged.groupBy("source", *place).agg(F.count("*").alias("n")), "slices")
    by_size = slices.groupBy("__name", "size").agg(F.sum("n").alias("n"))
    earlier = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    below = by_size.select("__name", "size", F.coalesce(F.sum("n").over(earlier(["__name"], "size")), F.lit(0)).alias("below"))
    within = slices.select(*place, F.coalesce(F.sum("n").over(earlier(["__name", "size"], "__slice")), F.lit(0)).alias("within"))
    totals = write_and_read(slices.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "sources")
    goals = write_and_read(targets(totals, mix), "targets")
    starts = within.join(below, ["__name", "size"]).select(*place, (F.col("below") + F.col("within")).alias("__start"))
    placed = tagged.join(starts, place).withColumn(
        "__rank", F.col("__start") + F.row_number().over(Window.partitionBy(*place).orderBy("__tag", "doc_id", "__tie"))
    )
    aimed = placed.join(goals, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = lambda rank: F.floor(F.col("__offset") + F.col("__each") * rank)
    return aimed.withColumn("__offset", _offset(mix.seed)).withColumn("__each", each).withColumn(
        "copies", (upto(F.col("__rank")) - upto(F.col("__rank") - 1)).cast("long")
    ).drop("__tag", "__name", "__slice", "__start", "__rank", "__offset", "__each", "__tie")


def plan(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.lit(0).alias("__tie"))
    drawn = draw(write_and_read(sized, "sizes"), mix)
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    names = docs.columns
    packed = docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), row_key("doc_id", "source", "text").alias("__tie"),
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"),
    )
    drawn = draw(packed, mix).where("copies > 0")
    repeated = drawn.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*[F.col("__row")[c].alias(c) for c in names])
