"""Exact duplicates, Merkle manifests and centroids against plain versions: absent values, long texts, ties, repeated rows, empty tables, clashing columns."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from flowloom.llm import centroids, exact_dedup, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, level int, node string, row long, kept int, pos int, tree string, rest string"
LONG = "a long text without end " * 40_000


def rows():
    texts = [
        None, "", "", "same", "same", "Same", "same ", "0123456789abcdef", "0123456789abcdef", "0123456789abcdefg", "0123456789abcdef" * 4, "0123456789abcdef" * 4,
        "0123456789abcdef" * 4 + "x", LONG, LONG, LONG + "!", "é" * 8, "é" * 8, "é" * 7 + "è", "\0", "\0\0",
    ]
    out = [(i, t, "en" if i % 2 else None, None if i % 3 else "a", None, i, "n", i, i, i, "t", "r") for i, t in enumerate(texts)]
    more = [(500 + i, f"text {i % 7}", "de", "hot", i, 1, "n", 1, 1, 1, "t", "r") for i in range(700)]
    return out + [out[4], out[4], out[13], (None, "same") + out[4][2:], (None, "alone with no id") + out[4][2:], (None, None, None, None, None) + out[4][5:]] + more


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, none):
    held = defaultdict(list)
    for r in rows():
        held[r[1] or ""].append(r[0])
    got = exact_dedup.duplicates(docs).collect()
    last = {t: max((i for i in ids if i is not None), default=None) for t, ids in held.items()}
    want = sorted((str(r[0]), str(last[r[1] or ""]), len(held[r[1] or ""]), sha256((r[1] or "").encode()).hexdigest()) for r in rows())
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in kept}) == len(held) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.duplicates(none).collect() == [] and exact_dedup.keep_one(none).columns == none.columns


def test_exact_rows_keep_their_columns(docs):
    got = exact_dedup.keep_one(docs)
    assert got.columns == docs.columns
    stayed = got.collect()
    assert len(stayed) == len({r.text or "" for r in stayed}) and {tuple(r) for r in stayed} <= set(rows())


@pytest.mark.parametrize("first,growth", [(1, 2), (3, 3), (64, 16)])
def test_exact_digits_do_not_matter(spark, first, growth):
    draw = random.Random(first)
    texts = ["".join(draw.choice("ab") for _ in range(draw.choice([0, 1, 2, 5, 9, 30]))) for _ in range(300)]
    got = exact_dedup.groups_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), first=first, growth=growth).collect()
    last = {t: i for i, t in enumerate(texts)}
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(i, last[t], texts.count(t), last[t] == i) for i, t in enumerate(texts)]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_manifest(table):
    """Rows of the query by lists and loops."""
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def tree(nodes):
        """(root, for each leaf its [(left, right)])"""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(paths):
                run, slot = divmod(at[i], 16)
                own = nodes[16 * run:16 * run + 16]
                p.append(("".join(own[:slot]), "".join(own[slot + 1:])))
            at = [a // 16 for a in at]
            nodes = [h(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
        return nodes[0], paths

    held = defaultdict(list)
    for doc_id, text, lang, source, n_chars in table:
        leaf = h(*map(field, (doc_id, source, lang, n_chars, text)))
        bad = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
            bad = h(*map(field, (doc_id, source, lang, n_chars, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))))
        held[b"" if source is None else b"=" + source.encode()].append(((doc_id is not None, doc_id or 0), leaf, bad, doc_id))
    names = sorted(held)
    trees = {n: tree([x[1] for x in sorted(held[n])]) for n in names}
    root, tops = tree([trees[n][0] for n in names])
    out = []
    for n, top in zip(names, tops):
        for (_, leaf, bad, doc_id), path in zip(sorted(held[n]), trees[n][1]):
            folded = bad
            for left, right in path + top:
                folded = h(left, folded, right)
            out.append((str(doc_id), leaf, trees[n][0], root, h(*[a + b for a, b in path + top]), folded, folded == root))
    return sorted(out)


def test_manifest(docs, none):
    got = sorted((str(r[0]), *r[1:]) for r in merkle.verify(docs).collect())
    assert got == plain_manifest([r[:5] for r in rows()])
    assert merkle.verify(none).collect() == []


@pytest.mark.parametrize("n,sources", [(1, 1), (16, 1), (17, 1), (257, 1), (4500, 1), (300, 40)])
def test_manifest_of_sizes(spark, n, sources):
    table = [(i, f"Text {i}", "en", f"s{i % sources}é", i) for i in range(n)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r[0]), *r[1:]) for r in merkle.verify(docs).collect())
    assert got == plain_manifest(table) and any(not r[-1] for r in got) == any(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(n))


def plain_clusters(table, k, rounds):
    """(vec_id, cluster, distance) and centroids with Python's own integers."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in table if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, h(f"2:{r[0]}") if r[0] is not None else "", r[1]))[:k]
    centres = [v for _, v in start]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        own = [[v for (_, v), (_, c) in zip(kept, assigned()) if c == j] for j in range(len(centres))]
        centres = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c for vs, c in zip(own, centres)]
    return sorted((str(i), c, d) for (i, _), (d, c) in zip(kept, assigned())), centres


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 64))
    out = [(i, [float(np.float32(x)) for x in base[i % 6] + rng.normal(size=64) * 0.2]) for i in range(150)]
    out += [(200 + i, [0.5] * 64) for i in range(60)]  # a vector that many rows repeat
    out += [out[0], out[0], (None, out[3][1]), (300, None), (301, []), (302, [1.0] * 63), (303, [float("nan")] + [1.0] * 63), (304, [None] + [1.0] * 63), (305, [float("inf")] + [0.0] * 63)]
    return out + [(306, [-0.0] * 64), (307, [-1e-9] * 64), (308, [5e5] * 64)]


def test_centroids(spark):
    table = vectors()
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in table], "vec_id long, embedding array<double>, cluster int, v int").repartition(4)
    got = centroids.cluster(frame).collect()
    want, centres = plain_clusters(table, 40, 5)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == want
    names = [h(",".join(map(str, c))) for c in centres]
    assert all(r.centroid_sha256 == names[r.cluster] for r in got)
    assert {r.inertia for r in got} == {sum(r.distance for r in got)}
    for c in {r.cluster for r in got}:
        assert {r.cluster_inertia for r in got if r.cluster == c} == {sum(r.distance for r in got if r.cluster == c)}
    assert all(1 <= r.compared <= 40 for r in got)


def test_centroids_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], schema)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, None), (2, [1.0])], schema)).collect() == []
    got = centroids.cluster(spark.createDataFrame([(7, [0.25] * 64), (8, [0.25] * 64), (9, [0.5] * 64)], schema)).collect()
    want, _ = plain_clusters([(7, [0.25] * 64), (8, [0.25] * 64), (9, [0.5] * 64)], 40, 5)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == want


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(5)
    for scale in (1, 300, 2**26):
        points = rng.integers(-scale, scale + 1, (400, 64))
        centres = np.concatenate([points[:10], points[:10] + rng.integers(0, 2, (10, 64))])
        pivots = centroids.choose_pivots(points[50:90], 8)
        assert len(pivots) == 8
        cached = centroids.pivot_distances(points, pivots)
        exact = np.stack([centroids.squared(points, c[None]) for c in centres], axis=1)
        bounds = centroids.lower_bounds(cached, centroids.pivot_distances(centres, pivots), pivots)
        assert (bounds <= exact).all() and bounds.max() > 0.2 * exact.max()
        found, least, compared = centroids.nearest(points, cached, centres, pivots)
        assert (found == exact.argmin(axis=1)).all() and (least == exact.min(axis=1)).all() and compared < exact.size
    assert len(centroids.choose_pivots(np.ones((5, 64), np.int64), 8)) == 1 and len(centroids.choose_pivots(np.ones((0, 64), np.int64), 8)) == 0
