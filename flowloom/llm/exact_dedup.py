"""Exact duplicates by distributed radix partitioning, most significant bytes first.

All texts begin in one group. A level splits every group by the next run of bytes, its digit: one aggregate counts the members of each (group, digit), with map-side combine, and one join
brings the outcome back to the rows. A row that is alone is done. A row whose text ends with the digit is done too, as all that share group and digit hold the same bytes from
the first to the last. Only rows of open groups go on, with the bytes that they have not shown yet, so a text is moved once per level that it stays open.

Equality rests on the bytes themselves, not on a digest. The first digit has FIRST bytes, each later one GROWTH times as many, so that the number of levels
grows with the logarithm of the longest shared beginning. Groups of copies of any size are counted before the shuffle; in the join adaptive execution splits the
side of the rows. Nothing is gathered per group.

Rows: a null text counts as empty. The row with the largest doc_id of a group stays, and a null doc_id is less than any other. Of rows that agree in doc_id and text exactly one stays.
An empty table gives an empty result. Texts of any length are compared to their end. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowloom.llm.text import sha256_hex
from flowloom.plans.storage import small_side, write_and_read

#: Bytes of the first digit, and by how much digits grow from level to level.
FIRST, GROWTH = 16, 4
_REST = 2**31 - 1


def _split(rows: DataFrame, width: int, level: int) -> tuple[DataFrame, bool]:
    """One level: the rows with their outcome, and whether a group is still open.

    `rows` has (doc_id, carried, group, rest). An open row keeps the rest of its bytes behind the digit.
    """
    cut = rows.select(
        "doc_id", "carried", "group", F.substring("rest", 1, width).alias("digit"), (F.length("rest") <= width).alias("ended"),
        F.substring("rest", width + 1, _REST).alias("rest"),
    )
    shared = cut.groupBy("group", "digit", "ended").agg(F.count("*").alias("n"), F.max("doc_id").alias("largest")).where("n > 1")
    groups = write_and_read(shared.select(
        F.col("group").alias("of"), F.col("digit").alias("shown"), F.col("ended").alias("whole"), "n", "largest", F.monotonically_increasing_id().alias("node"),
    ), "radix-groups")
    same = (F.col("group") == F.col("of")) & (F.col("digit") == F.col("shown")) & (F.col("ended") == F.col("whole"))
    alone, open_ = F.col("node").isNull(), F.col("node").isNotNull() & ~F.col("ended")
    # always by sorting: a broadcast would end at some size, and the shuffle would then begin at once
    split = cut.join(groups.hint("merge"), same, "left").select(
        "doc_id", "carried", F.lit(level).alias("level"), "node", F.monotonically_increasing_id().alias("row"), F.coalesce("n", F.lit(1)).alias("n"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("largest")).alias("largest"), open_.alias("open"), F.when(open_, F.col("rest")).alias("rest"),
    )
    return write_and_read(split, "radix-rows"), not groups.where("not whole").isEmpty()


def groups_of(docs: DataFrame, *carried: str, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, carried): one row per row of `docs`, with the named columns in the struct `carried`.

    text_sha256 is part of the result only; no comparison looks at it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    more = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)]
    rows = docs.select(
        "doc_id", F.struct(sha256_hex(text).alias("sha"), *more).alias("carried"), F.lit(0).cast("long").alias("group"), text.cast("binary").alias("rest")
    )
    done, width, level, open_ = None, first, 0, True
    while open_:
        split, open_ = _split(rows, width, level)
        closed = split.where("not open").drop("open", "rest")
        done = closed if done is None else done.unionByName(closed)
        rows = split.where("open").select("doc_id", "carried", F.col("node").alias("group"), "rest")
        width, level = width * growth, level + 1
    stays = F.col("doc_id").eqNullSafe(F.col("largest"))
    # rows that repeat the doc_id of the row that stays; there are none where ids are unique
    repeated = done.where(stays & F.col("node").isNotNull()).groupBy("level", "node").agg(F.min("row").alias("first"), F.count("*").alias("again")).where("again > 1")
    firsts = small_side(repeated.select(F.col("level").alias("at"), F.col("node").alias("of"), "first"))
    told = done.join(firsts, (F.col("level") == F.col("at")) & (F.col("node") == F.col("of")), "left")
    return told.select(
        "doc_id", F.col("largest").alias("keep_id"), F.col("n").alias("group_size"), (stays & (F.col("first").isNull() | (F.col("row") == F.col("first")))).alias("kept"),
        F.col("carried.sha").alias("text_sha256"), "carried",
    )


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    return groups_of(docs).drop("carried")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    stay = groups_of(docs, *docs.columns).where("kept")
    return stay.select(*[F.col("carried")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])
