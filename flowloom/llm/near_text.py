"""Near duplicates by the Jaccard similarity of word shingles: candidates from MinHash bands, every link verified on the texts.

A text is the set of its five-word shingles (all its words if it has fewer). Two texts with similarity s agree in a band of ROWS minima with probability s^ROWS, in
one of BANDS bands with 1 - (1 - s^ROWS)^BANDS: 0.99995 at 0.8. Of the pairs that share a band all are compared exactly, except those that verified links
connect already, so components are those of all similar pairs that share a band.

Equal sets are collapsed first. In each band all sets are then compared with one centre, the set that meets most others over all its bands. Of a family of edited copies that is the
text that they were made from, or one close to it, so one round of linear work connects most of the family.

What a set is still open to then follows from its shingles that no other open set holds. With c others of its n shingles it shares at most c with any set, and similarity s with a set of
m shingles asks for s / (1 + s) * (n + m) in common. Sets that no set of their band is small enough for leave the band. What is left of a band is cut into blocks, and each two blocks
are compared in one task, which returns a spanning forest of its links: a set travels once per block of its band, not once per pair. While bands have too many blocks
for that and links are still found, rounds with other centres come first.

A null text and a text without a word have the empty set; all of them are equal. Rows that repeat a doc_id are rows of their own. An empty table gives an empty result. Texts
are read to their end. Only `doc_id` and `text` are looked at; other columns are carried, and names that begin with `__` are reserved.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.components import connected
from flowloom.llm.simhash import first_of_each
from flowloom.llm.text import row_key
from flowloom.plans.storage import discard, write_and_read

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
#: Sets and shingles of a block, and how often a set of the band table may travel, on average, before rounds with other centres come first.
BLOCK, BLOCK_SHINGLES = 128, 1 << 19
TRAVELS = 16
_COLUMNS = 1 << 15
_CHUNK = 4096
_RNG = np.random.default_rng(5)
_MASKS = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64)
_FACTORS = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles in order."""
    tokens = text.encode("utf-8", "replace").lower().split() if text else []
    parts = map(b" ".join, zip(*(tokens[k:] for k in range(words)))) if len(tokens) > words else [b" ".join(tokens)] if tokens else []
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """A number for each band of minima; none for the empty set."""
    if not len(found):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _CHUNK):
        low = np.minimum(low, ((found[at:at + _CHUNK, None] ^ _MASKS) * _FACTORS).min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), seed=i) for i, row in enumerate(low.reshape(BANDS, ROWS))]


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _signed(text: Column) -> Column:
    @F.pandas_udf("node long, size int, bands array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t) for t in texts]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        return pd.DataFrame({"node": nodes, "size": [len(s) for s in sets], "bands": [np.array(bands(s), np.uint64).view(np.int64) for s in sets]})

    return of(text)


def _shingled(text: Column) -> Column:
    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t).view(np.int64) for t in texts])

    return of(text)


def _similar(left: Column, right: Column) -> Column:
    @F.pandas_udf("boolean")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        known = lru_cache(16)(shingles)
        return pd.Series([similar(known(x), known(y)) for x, y in zip(a, b)], dtype=bool)

    return of(left, right)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) of sets whose texts are similar."""
    wide = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("__a")), "u").join(
        texts.select(F.col("node").alias("v"), F.col("text").alias("__b")), "v"
    )
    return write_and_read(wide.where(_similar(F.col("__a"), F.col("__b"))).select("u", "v"), "similar")


def _famed(shared: DataFrame) -> DataFrame:
    """`shared` with `fame`, the number of sets that a set meets over all its bands."""
    crowds = shared.groupBy(F.col("band").alias("__band")).agg(F.count("*").alias("n"))
    fame = shared.join(crowds, F.col("band") == F.col("__band")).groupBy(F.col("node").alias("__node")).agg(F.sum("n").alias("fame"))
    return shared.join(fame, F.col("node") == F.col("__node")).select("band", "node", "fame")


def _partners(rest: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, size, most): how large a set may be that a node of `rest` can still be similar to; and (node, size, shingles)."""
    nodes = rest.select(F.col("node").alias("__node")).distinct()
    held = texts.join(nodes, F.col("node") == F.col("__node"))
    held = write_and_read(held.select("node", "size", _shingled(F.col("text")).alias("shingles")), "sets")
    words = held.select("node", F.explode("shingles").alias("shingle"))
    # a shingle of one set only: the set's own number is the least of all that hold it
    single = words.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("of")).where("n = 1").groupBy("of").agg(F.count("*").alias("alone"))
    shared = F.col("size") - F.coalesce("alone", F.lit(0))
    most = F.floor(shared * ((1 + SIMILARITY) / SIMILARITY) - F.col("size") + 1e-6)
    known = write_and_read(held.join(single, F.col("node") == F.col("of"), "left").select("node", "size", most.alias("most")), "partners")
    return known, held


def forest(nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], other: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links between similar sets of different roots that connect all such sets; where `other` differs only between its two values."""
    sizes = np.array([len(x) for x in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner, common = np.repeat(np.arange(len(sets)), sizes), np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for first in range(0, len(values), _COLUMNS):
        part = slice(*np.searchsorted(at, (first, first + _COLUMNS)))
        held = np.zeros((len(sets), _COLUMNS), np.float32)
        held[owner[part], at[part] - first] = 1
        common += held @ held.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = (common >= similarity * union - 1e-6) & (roots[:, None] != roots[None, :])
    if len(set(other.tolist())) > 1:
        linked &= other[:, None] != other[None, :]
    found, parent = [], {r: r for r in roots.tolist()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for u, v in np.argwhere(np.triu(linked)):
        a, b = root(int(roots[u])), root(int(roots[v]))
        if a != b:
            parent[a] = b
            found.append((int(nodes[u]), int(nodes[v])))
    return found


def _met_in_blocks(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (u, v) within the bands of `rest` (band, node, root, size)."""
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.col("size").cast("long")) / BLOCK_SHINGLES)).cast("long")
    counts = rest.groupBy(F.col("band").alias("__band")).agg(blocks.alias("blocks"))
    dealt = rest.join(counts, F.col("band") == F.col("__band")).withColumn("own", F.pmod(F.xxhash64("node", "band"), F.col("blocks")))
    every = dealt.select("band", "node", "root", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("to"))
    wide = every.join(sets.select(F.col("node").alias("__node"), "shingles"), F.col("node") == F.col("__node"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(forest(group["node"].to_numpy(), group["root"].to_numpy(), list(group["shingles"]), group["own"].to_numpy()), columns=["u", "v"])

    pairs = wide.select("band", F.least("own", "to").alias("low"), F.greatest("own", "to").alias("high"), "node", "root", "own", "shingles")
    met = pairs.groupBy("band", "low", "high").applyInPandas(meet, "u long, v long")
    return write_and_read(met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "similar")


def _open_bands(named: DataFrame) -> tuple[DataFrame, float]:
    """Bands (`__band`) with sets of several roots, and how many unconnected pairs they hold."""
    held = named.groupBy("band", "root").agg(F.count("*").alias("n"))
    held = held.groupBy("band").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    open_ = write_and_read(held.where("roots > 1").select(F.col("band").alias("__band"), ((F.col("n") * F.col("n") - F.col("same")) / 2).alias("pairs")), "open")
    return open_, open_.agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0]


def _links(shared: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of all sets that are linked; `shared` has (band, node) of bands with two sets or more."""
    total, seen = shared.count(), 0
    rest = write_and_read(_famed(shared).withColumn("root", F.col("node")), "named")
    links = roots = known = sets = None
    for attempt in range(1 << 20):
        found = links.count() if links is not None else 0
        if attempt:
            # rows of `rest` under their new roots, without bands that are connected and sets that nothing in their band can be similar to
            renamed = rest.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            named = write_and_read(renamed.select(*rest.columns), "named")
            open_, left = _open_bands(named)
            several = named.join(open_, F.col("band") == F.col("__band")).select(*rest.columns)
            if known is None and left:
                known, sets = _partners(several, texts)
                told = several.join(known.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node")).drop("__node")
                least = told.groupBy(F.col("band").alias("__band")).agg(F.min("size").alias("least"))
                able = told.join(least, F.col("band") == F.col("__band")).where((F.col("most") >= F.col("least")) & (F.col("most") >= SIMILARITY * F.col("size")))
                discard(rest)
                rest = write_and_read(able.select(*told.columns), "able")
                discard(named, open_)
                open_, left = _open_bands(rest)
                several = rest.join(open_, F.col("band") == F.col("__band")).select(*rest.columns)
            if not left:
                discard(open_)
                return roots
        else:
            several, left, open_ = rest, float("inf"), None
        last = attempt > 0 and (left <= TRAVELS * BLOCK * total or (attempt > 1 and found == seen))
        seen = found
        if last:
            new = _met_in_blocks(several, sets)
        else:
            order = F.xxhash64("node", F.lit(attempt)) if attempt else F.col("fame")
            centre = several.groupBy(F.col("band").alias("__b")).agg(F.max(F.struct(order.alias("o"), "node", "root")).alias("c"))
            centre = centre.select("__b", F.col("c.node").alias("__n"), F.col("c.root").alias("__r"))
            met = several.join(centre, F.col("band") == F.col("__b")).where("root != __r")
            new = _verified(met.select(F.greatest("node", "__n").alias("u"), F.least("node", "__n").alias("v")).distinct(), texts)
        before = links
        links = write_and_read(new if links is None else links.union(new), "links")
        discard(new, before, open_)
        roots = connected(links)
        if last:
            return roots


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, key, root) of every row: its key and what names its component."""
    keyed = docs.select("doc_id", row_key("doc_id", "text").alias("key"), "text")
    table = write_and_read(keyed.select("doc_id", "key", _signed(F.col("text")).alias("sig")), "signed")
    members = write_and_read(table.select(F.col("sig.node").alias("node"), F.explode("sig.bands").alias("band")).distinct(), "bands")
    several = members.groupBy(F.col("band").alias("__band")).agg(F.count("*").alias("n")).where("n > 1").select("__band")
    shared = write_and_read(members.join(several, F.col("band") == F.col("__band")).select("band", "node"), "shared")
    discard(members)
    wanted = table.groupBy(F.col("sig.node").alias("node")).agg(F.min("key").alias("__key"), F.min("sig.size").alias("size")).join(shared.select("node").distinct(), "node")
    texts = keyed.select("key", "text").join(wanted, F.col("key") == F.col("__key")).select("node", "size", "text")
    texts = write_and_read(texts.dropDuplicates(["node"]), "texts")
    linked = _links(shared, texts).withColumnRenamed("node", "__node")
    discard(shared, texts)
    rows = table.select("doc_id", "key", F.col("sig.node").alias("node"))
    return rows.join(linked, F.col("node") == F.col("__node"), "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, chosen as in `simhash.keep_one`."""
    return first_of_each(docs, write_and_read(near_duplicates(docs), "groups"))
