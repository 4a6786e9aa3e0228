"""A Merkle manifest of a dataset: a tree of digests per source and one over the sources.

Nodes of one level lie in order. Every FAN consecutive ones are a run and have one parent, the digest of the run from left to right. Columns at fixed offsets,
`lag` 1 to FAN - 1 and `lead` 1 to FAN - 1, masked by a node's slot in the run and by the run's length, are the siblings of each node; the row in slot 0 hashes itself and
what follows to the parent. So a level is one window, and no run is ever gathered.

Windows are not over whole sources: a run never crosses a multiple of BLOCK = FAN ** 3 positions, so (source, block) is what a task sees, however large a source is.
Positions come from a range partitioning by (source, doc_id, leaf): nodes per (range, source) are counted, the few counts are summed up, and a window inside (range, source) adds
the rest. Paths to the root are joined downwards, a run's path to its FAN children.

Rows: a null column is written `-`. The null source is first. A null doc_id comes before all others. Rows that repeat a doc_id are leaves of their own, ordered by their digests. An empty
table has no leaves and gives an empty result. Texts are hashed whole. Only the five columns of the leaf are read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.llm.text import lower_ascii, sha256_hex
from flowloom.plans.storage import write_and_read

FAN = 16
BLOCK = FAN ** 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return sha256_hex(F.concat(*parts))


def _field(value: Column) -> Column:
    """`-` if absent, else byte count, `:`, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The digest of a row, with some of its columns replaced."""
    return digest(*[_field(changed.get(c, F.col(c))) for c in FIELDS])


def _ranges(rows: DataFrame, by: list[str]) -> DataFrame:
    """`rows` stored with the number of its range in `part`; ranges follow the order of `by` and are of like size."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return write_and_read(rows.repartitionByRange(n, *by).withColumn("part", F.spark_partition_id()), "merkle-ranges")


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` (tree, part, ...) with their 0-based position in the tree and the size of the tree."""
    cells = write_and_read(rows.groupBy("tree", "part").agg(F.count("*").alias("n")), "merkle-cells")
    tree = Window.partitionBy("tree")
    starts = cells.select(
        "tree", "part", F.sum("n").over(tree).alias("size"),
        F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
    )
    inside = Window.partitionBy("tree", "part").orderBy(*order)
    return rows.join(starts, ["tree", "part"]).withColumn("pos", F.col("start") + F.row_number().over(inside) - 1).drop("start", "part")


def _level(nodes: DataFrame, name: str) -> DataFrame:
    """`nodes` (tree, pos, size, node, ...) stored with the digests of the siblings to the `left` and to the `right`."""
    block = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))
    row = Window.partitionBy("tree", "block").orderBy("pos")
    slot = F.col("pos") % FAN
    length = F.least(F.lit(FAN), F.col("size") - (F.col("pos") - slot))
    before = [F.when(slot >= k, F.lag("node", k).over(row)) for k in range(FAN - 1, 0, -1)]
    after = [F.when(slot + k < length, F.lead("node", k).over(row)) for k in range(1, FAN)]
    return write_and_read(block.select(*nodes.columns, F.concat_ws("", *before).alias("left"), F.concat_ws("", *after).alias("right")), name)


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """All levels from the given nodes up; a tree of one node is not continued."""
    levels = [_level(nodes, "merkle-level")]
    largest = levels[0].agg(F.max("size")).first()[0] or 0
    while largest > 1:
        below = levels[-1].where((F.col("size") > 1) & (F.col("pos") % FAN == 0))
        parents = below.select(
            "tree", F.floor(F.col("pos") / FAN).alias("pos"), F.ceil(F.col("size") / FAN).alias("size"), digest(F.col("node"), F.col("right")).alias("node")
        )
        levels.append(_level(parents, "merkle-level"))
        largest = -(-largest // FAN)
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, at, node): the last node of every tree and its level."""
    found = [x.where("size = 1").select("tree", F.lit(i).alias("at"), "node") for i, x in enumerate(levels)]
    tops = found[0]
    for more in found[1:]:
        tops = tops.union(more)
    return tops


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The columns of the lowest level with `path`, the (left, right) of each level up to the root, and `top`, the last node of the tree.

    `tops` has (tree, at, node, path): where each tree ends and how it goes on from there.
    """
    above = None
    for i in range(len(levels) - 1, -1, -1):
        ends = tops.where(F.col("at") == i).select(F.col("tree").alias("of"), F.col("node").alias("top"), F.col("path").alias("on"))
        own = [c for c in levels[i].columns if c not in ("left", "right")]
        here = levels[i].where("size = 1").join(ends, F.col("tree") == F.col("of")).select(*own, F.col("on").alias("path"), "top")
        if above is not None:
            run = above.select(F.col("tree").alias("of"), F.col("pos").alias("run"), F.col("path").alias("on"), "top")
            inner = levels[i].where("size > 1").join(run, (F.col("tree") == F.col("of")) & (F.floor(F.col("pos") / FAN) == F.col("run")))
            step = F.array(F.struct("left", "right"))
            here = here.union(inner.select(*own, F.concat(step, "on").alias("path"), "top"))
        above = here
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """(source, pos, doc_id, leaf, tampered, path, subroot, root): every leaf with its place, its siblings on the way to the root, and the leaf it would be with A-Z lowered."""
    touched = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    own, other = leaf(), leaf(text=lower_ascii(F.col("text")))
    # a name that is never absent and keeps the order: the null source first
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"), "doc_id", own.alias("node"),
        F.when(touched & F.col("text").isNotNull(), other).otherwise(own).alias("tampered"),
    )
    order = ["doc_id", "node"]
    levels = _levels(_placed(_ranges(rows, ["tree", *order]), order))
    subroots = write_and_read(_tops(levels), "merkle-subroots")
    sources = _ranges(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node"), ["source"])
    upper = _levels(_placed(sources, ["source"]))
    last = upper[-1].where("size = 1").select("node").first()
    none = F.array().cast("array<struct<left:string,right:string>>")
    over = _paths(upper, _tops(upper).withColumn("path", none)).select(F.col("source").alias("of"), "path")
    going_on = subroots.join(over, F.col("tree") == F.col("of")).select("tree", "at", "node", "path")
    return _paths(levels, write_and_read(going_on, "merkle-tops")).select(
        F.expr("substring(tree, 2)").alias("source"), "pos", "doc_id", F.col("node").alias("leaf"), "tampered", "path", F.col("top").alias("subroot"),
        F.lit(last[0] if last else None).cast("string").alias("root"),
    )


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda node, step: digest(step["left"], node, step["right"]))


def verify(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row: the fold of a copy that was tampered with where 5 divides the id's checksum."""
    told = manifest(docs)
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    folded = told.withColumn("folded_root", fold(F.col("tampered"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", sha256_hex(siblings).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
