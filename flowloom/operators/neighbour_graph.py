"""A neighbour graph as an index: built by neighbour descent, searched by a best-first walk.

Building. Every key holds a list of its `degree` best neighbours so far. Lists begin within blocks: random ones and ones of equal hash codes. In a round each key brings together
those in its list and those that list it; all pairs of such a company that have not met are compared, and whoever comes nearer than the last entry of a list
enters it. Neighbours of neighbours are neighbours more often than not, so a few rounds suffice; they end when less than `settled` of all entries change. A key
that many others list has its company cut into parts, which are dealt anew in each round.

Searching. Edges go both ways: the lists, and of those that list a key the nearest `degree`. A walk begins at a few keys of each of the query's hash buckets, so that it reaches clusters
without an edge to others. Each step of a walk looks up the neighbours of its nearest keys
not yet looked up, as far as these lie within (1 + epsilon) times the distance of its k-th best, and it ends when there are none. Keys met are kept, so none is measured twice. Without
an epsilon the walks of a sample of the queries, which are searched exactly too, widen step by step until they have found `recall_target` of their neighbours; all walks take that epsilon.

Up to four shards of about `shard` keys are dealt by id hash, more by direction: each key goes to the nearest of some centres, which are fitted on a bounded sample (`Cells`), and a cell of more keys is cut by id
hash. A shard has a graph of its own, built by one task, so a round moves no vector between tasks. A query walks the shards of its own cell, and then every other shard that by the triangle inequality of
angles may hold a key as near as its k-th best so far; the best of all shards are its neighbours. Without cells it walks every shard. A task of the search holds one shard and one block of queries. Building grows with the keys,
searching with queries times the shards that they reach: all of them among random directions, one or a few where keys lie close together. Distances are cosine distances. A key that is a zero vector, or holds a number that is not finite, has no distance and is met by no walk. Ids
may be of any type and must be unique; rows without an id or a vector are left out. With fewer keys than k a query finds fewer; without keys none.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from flowloom import constants as K
from flowloom.operators.knn import _finite, _matrix, _prepared, nearest
from flowloom.plans.storage import write_and_read

#: Rows of a block of queries; when all keys met are returned; groups of a block and a shard that a search has at least, as far as blocks have so many rows.
QUERY_ROWS, WHOLE_ROWS, LEAST_TASKS, LEAST_ROWS = 1 << 14, 1 << 7, 24, 16
#: Shards that keys have at least, as far as each has so many.
LEAST_SHARDS, LEAST_KEYS = 4, 1 << 11
#: Walks that go at once in a task, and distances of a tile of companies.
BATCH, TILE = 256, 1 << 21
#: Keys that centres of cells are fitted on, of which each has so many at least, and rounds of the fit.
CELL_SAMPLE, CELL_LEAST, CELL_ROUNDS = 1 << 14, 16, 10
#: By how much rounded distances and angles may be off.
DISTANCE_ERROR, ANGLE_ERROR = 1e-12, 1e-7
#: Tasks that groups of shards and blocks are dealt to at most.
MOST_TASKS = 1 << 12


@dataclass(frozen=True)
class GraphConfig:
    degree: int = 20
    #: Blocks that lists begin in: one random partition and so many by hash codes, of about `company` keys.
    tables: int = 3
    company: int = 48
    rounds: int = 12
    settled: float = 0.01
    seed: int = K.RANDOM_SEED
    #: Keys of each bucket and of all that walks begin at, keys looked up per query and round.
    begin: int = 3
    width: int = 6
    #: Step by which a walk widens, and where it stops widening.
    widen: float = 0.01
    widest: float = 1.0
    #: Queries that are searched exactly to see how many neighbours the walk has found.
    sample: int = 64
    #: Keys that have one graph at most, about.
    shard: int = 1 << 16


@dataclass(frozen=True)
class Cells:
    """Directions that keys are dealt by."""

    centres: np.ndarray
    #: The largest angle between a cell's centre and its keys; its first shard and how many it has.
    radius: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    def shards(self, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(line, shard) of the cells that each line reaches."""
        line, cell = np.nonzero(reached)
        parts = self.parts[cell]
        place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        return np.repeat(line, parts), np.repeat(self.first[cell], parts) + place


@dataclass(frozen=True)
class Graph:
    #: (id, v, label)
    keys: DataFrame
    #: (shard, id, v, turn, place, codes, near): a hash and a key's place by id in its shard, its code in each hash table, the places of its neighbours in both directions
    index: DataFrame
    shards: int
    config: GraphConfig
    #: Neighbour descent: most rounds of a shard, and comparisons of two keys.
    rounds: int
    compared: int
    #: How keys are dealt into shards; by id hash if absent.
    cells: Cells | None = None

    @property
    def edges(self) -> DataFrame:
        """(id, near): both directions"""
        ends = self.index.select("shard", F.col("place").alias("end"), F.col("id").alias("near"))
        return self.index.select("shard", "id", F.explode("near").alias("end")).join(ends, ["shard", "end"]).select("id", "near")

    @property
    def starts(self) -> DataFrame:
        """(shard, tab, code, key_id): where walks begin"""
        every = F.struct(F.lit(-1).alias("tab"), F.lit(0).cast("long").alias("code"))
        own = F.transform("codes", lambda code, tab: F.struct(tab.alias("tab"), code.alias("code")))
        dealt = self.index.select("shard", "turn", "place", "id", F.explode(F.concat(F.array(every), own)).alias("c")).select("shard", "turn", "place", "id", "c.tab", "c.code")
        along = Window.partitionBy("shard", "tab", "code").orderBy("turn", "place")
        few = dealt.withColumn("turn", F.row_number().over(along)).where(F.col("turn") <= self.config.begin)
        return few.select("shard", "tab", "code", F.col("id").alias("key_id"))


# ---- inside a shard ----

def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; of one without a direction all numbers are absent."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        unit = vectors / np.sqrt((vectors ** 2).sum(axis=1, keepdims=True))
    unit[~np.isfinite(unit).all(axis=1)] = np.nan
    return unit


def _codes(unit: np.ndarray, keys: int, config: GraphConfig) -> np.ndarray:
    """The code of each vector in each hash table of a shard of so many keys."""
    bits = max(1, round(math.log2(max(2.0, keys / config.company))))
    planes = np.random.default_rng(config.seed).normal(size=(unit.shape[1], config.tables * bits))
    above = (np.nan_to_num(unit) @ planes).reshape(len(unit), config.tables, bits) > 0
    return (above * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def _mixed(*numbers) -> np.ndarray:
    """A hash of whole numbers."""
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for number in numbers:
            out = (out ^ np.asarray(number).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            out = out ^ (out >> np.uint64(29))
    return out


def _runs(*sorted_by: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(sorted_by[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(sorted_by[0]), bool)
    new[1:] = np.any([by[1:] != by[:-1] for by in sorted_by], axis=0)
    return np.flatnonzero(new)


class _Lists:
    """The lists of a shard: neighbours, distances and which of them are new."""

    def __init__(self, unit: np.ndarray, degree: int):
        self.unit, self.degree, n = unit, degree, len(unit)
        self.near = np.full((n, degree), -1, np.int64)
        self.distance = np.full((n, degree), np.inf)
        self.fresh = np.zeros((n, degree), bool)
        self.compared = 0

    def meet(self, group: np.ndarray, member: np.ndarray, fresh: np.ndarray) -> None:
        """Members of equal groups are compared, two that are both not fresh excepted; rows are sorted by group."""
        at = _runs(group)
        size = np.diff(np.append(at, len(group)))
        found, entries = [], 0
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 1]
        bound, last_id = self.distance[:, -1].copy(), self.near[:, -1].copy()
        first = 0
        while first < len(order):
            # companies of like size share a tile
            last = first + 1
            while last < len(order) and (last - first + 1) * int(size[order[last]]) ** 2 <= TILE and size[order[last]] <= 1.25 * size[order[first]] + 4:
                last += 1
            some = order[first:last]
            first = last
            most = int(size[some].max())
            slot = at[some][:, None] + np.arange(most)
            there = np.arange(most) < size[some][:, None]
            slot = np.where(there, slot, 0)
            who, new = member[slot], fresh[slot] & there
            with np.errstate(invalid="ignore"):
                vectors = self.unit[who]
                d = np.round(1 - vectors @ vectors.transpose(0, 2, 1), 12)
            met = (new[:, :, None] | new[:, None, :]) & there[:, :, None] & there[:, None, :] & ~np.eye(most, dtype=bool)
            self.compared += int(met.sum()) // 2
            # ties go to the lowest id, also in a full list
            enters = (d < bound[who][:, :, None]) | (d == bound[who][:, :, None]) & (who[:, None, :] < last_id[who][:, :, None])
            d = np.where(met & enters, d, np.inf)
            if most > self.degree:
                d[d > np.partition(d, self.degree - 1, axis=2)[:, :, self.degree - 1:self.degree]] = np.inf
            company, row, col = np.nonzero(np.isfinite(d))
            found.append((who[company, row], who[company, col], d[company, row, col]))
            entries += len(row)
            if entries > TILE // 2:
                self._enter(*(np.concatenate(c) for c in zip(*found)))
                found, entries, bound, last_id = [], 0, self.distance[:, -1].copy(), self.near[:, -1].copy()
        if found:
            self._enter(*(np.concatenate(c) for c in zip(*found)))

    def _enter(self, row: np.ndarray, col: np.ndarray, d: np.ndarray) -> None:
        touched = np.unique(row)
        known = self.near[touched] >= 0
        old_row = np.repeat(touched, known.sum(axis=1))
        is_new = np.concatenate([self.fresh[touched][known], np.ones(len(row), bool)])
        standing = np.concatenate([np.zeros(len(old_row), bool), np.ones(len(row), bool)])
        row, col, d = np.concatenate([old_row, row]), np.concatenate([self.near[touched][known], col]), np.concatenate([self.distance[touched][known], d])
        # one entry of each pair, the old one first
        order = np.argsort((row * len(self.unit) + col) * 2 + standing)
        order = order[_runs(row[order], col[order])]
        row, col, d, is_new = row[order], col[order], d[order], is_new[order]
        order = np.lexsort((d, row))  # by key already
        row, col, d, is_new = row[order], col[order], d[order], is_new[order]
        at = _runs(row)
        place = np.arange(len(row)) - np.repeat(at, np.diff(np.append(at, len(row))))
        keep = place < self.degree
        self.near[touched], self.distance[touched], self.fresh[touched] = -1, np.inf, False
        self.near[row[keep], place[keep]], self.distance[row[keep], place[keep]], self.fresh[row[keep], place[keep]] = col[keep], d[keep], is_new[keep]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, place = np.nonzero(self.near >= 0)
        return row, self.near[row, place], self.fresh[row, place]


def _dealt(host: np.ndarray, member: np.ndarray, turn: int, config: GraphConfig) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by host and part, and the group of each in that order; rows are sorted by host."""
    at = _runs(host)
    size = np.diff(np.append(at, len(host)))
    parts = np.repeat(-(-size // (2 * config.company)), size)
    part = (_mixed(member, host, turn) % parts.astype(np.uint64)).astype(np.int64)
    order = np.lexsort((part, host))
    new = np.zeros(len(order), np.int64)
    new[_runs(host[order], part[order])] = 1
    return order, np.cumsum(new)


def _descended(unit: np.ndarray, codes: np.ndarray, config: GraphConfig) -> tuple[_Lists, int]:
    """The settled lists of a shard, and after how many rounds."""
    n, lists = len(unit), _Lists(unit, config.degree)
    sound = np.flatnonzero(~np.isnan(unit).any(axis=1))
    random = (_mixed(sound, config.seed) % np.uint64(max(1, n // config.company))).astype(np.int64)
    for tab, code in enumerate([random, *codes[sound].T]):
        by = np.argsort(code, kind="stable")
        order, group = _dealt(code[by], sound[by], -tab, config)
        lists.meet(group, sound[by][order], np.ones(len(order), bool))
    rounds = 0
    while rounds < config.rounds:
        row, near, fresh = lists.pairs()
        if fresh.sum() <= config.settled * len(row):
            break
        rounds += 1
        lists.fresh[:] = False
        host, member, fresh = np.concatenate([row, near]), np.concatenate([near, row]), np.concatenate([fresh, fresh])
        order = np.lexsort((~fresh, host * n + member))
        order = order[_runs(host[order], member[order])]
        host, member, fresh = host[order], member[order], fresh[order]
        # a company in which nobody is new has nothing to compare
        some = np.zeros(n, bool)
        some[host[fresh]] = True
        keep = some[host]
        host, member, fresh = host[keep], member[keep], fresh[keep]
        order, group = _dealt(host, member, rounds, config)
        lists.meet(group, member[order], fresh[order])
    return lists, rounds


def _both_ways(lists: _Lists) -> list[np.ndarray]:
    """The neighbours of each key: its list, and of those that list it the nearest."""
    n = len(lists.unit)
    row, near, _ = lists.pairs()
    order = np.lexsort((row, lists.distance[lists.near >= 0], near))
    back, to = row[order], near[order]
    at = _runs(to)
    place = np.arange(len(to)) - np.repeat(at, np.diff(np.append(at, len(to))))
    few = place < lists.degree
    pair = np.unique(np.concatenate([row * n + near, to[few] * n + back[few]]))
    return np.split((pair % n).astype(np.int32), np.searchsorted(pair // n, np.arange(1, n)))


class _Shard:
    """The graph of one shard, as walks use it."""

    def __init__(self, rows: pd.DataFrame, config: GraphConfig):
        rows = rows.sort_values("place")
        self.config, self.ids, self.unit = config, rows["id"].to_numpy(), _unit(_matrix(rows["v"]))
        n = len(rows)
        self.near = np.full((n, 2 * config.degree), -1, np.int64)
        for i, near in enumerate(rows["near"]):
            self.near[i, :len(near)] = near
        self.sound = ~np.isnan(self.unit).any(axis=1)
        #: a few keys of each bucket, and a few of all
        by_turn = np.argsort(rows["turn"].to_numpy(), kind="stable")
        by_turn = by_turn[self.sound[by_turn]]
        self.buckets = [{0: by_turn[:config.begin]}]
        for code in _matrix(rows["codes"]).astype(np.int64).T:
            order = by_turn[np.argsort(code[by_turn], kind="stable")]
            at = _runs(code[order])
            self.buckets.append({int(code[order[a]]): order[a:min(a + config.begin, b)] for a, b in zip(at, np.append(at[1:], len(order)))})

    def begun(self, unit: np.ndarray) -> np.ndarray:
        """The keys that the walk of each query begins at, repeats included."""
        codes = np.column_stack([np.zeros(len(unit), np.int64), _codes(unit, len(self.unit), self.config)])
        out = np.full((len(unit), len(self.buckets) * self.config.begin), -1, np.int64)
        for i, row in enumerate(codes):
            found = np.concatenate([bucket[code] for bucket, code in zip(self.buckets, row.tolist()) if code in bucket])
            out[i, :len(found)] = found
        return out


class _Walks:
    """The walks of a few queries through a shard, step by step together."""

    def __init__(self, shard: _Shard, ids: np.ndarray, unit: np.ndarray, k: int, skip_same: bool, whole: bool = False, widens: bool = False):
        """All met keys are noted for `everything`, and open ones beyond the reach kept where epsilon is to grow."""
        self.shard, self.unit, self.k, self.whole, self.widens, self.epsilon = shard, unit, k, whole, widens, 0.0
        n, m = len(shard.unit), len(unit)
        #: what has been met or is never to be met
        self.seen = np.zeros((m, n), bool)
        if skip_same:
            for i, same in enumerate(ids):
                self.seen[i] = shard.ids == same
        self.stamp = np.zeros(m * n, np.int32)
        self.best, self.best_at = np.full((m, k), np.inf), np.full((m, k), -1, np.int64)
        #: walks that go on, and the line of each in what they have met and not looked up
        self.rows, self.line = np.arange(m), np.arange(m)
        self.open, self.open_at = np.full((m, 0), np.inf), np.zeros((m, 0), np.int64)
        self.measured = np.zeros(m, np.int64)
        self.met, self.looked_up = [], []
        known = np.flatnonzero(~np.isnan(unit).any(axis=1))
        self._meet(known, shard.begun(unit[known]) if len(known) else np.zeros((0, 1), np.int64))

    def _meet(self, rows: np.ndarray, keys: np.ndarray) -> None:
        """The keys are measured, as far as they have not been met."""
        n = len(self.shard.unit)
        flat = (rows[:, None] * n + keys)[keys >= 0]
        flat = flat[~self.seen.reshape(-1)[flat]]
        turn = np.arange(len(flat), dtype=np.int32)
        self.stamp[flat] = turn
        flat = flat[self.stamp[flat] == turn]  # one of equal ones
        row, at = np.divmod(flat, n)
        order = np.argsort(row, kind="stable")
        row, at = row[order], at[order]
        self.seen[row, at] = True
        d = np.round(1 - np.einsum("ij,ij->i", self.unit[row], self.shard.unit[at]), 12)
        self.measured += np.bincount(row, minlength=len(self.unit))
        if self.whole:
            self.met.append((row, at, d))
        better = d <= self.best[row, -1]
        if better.any():
            self._rank(row[better], at[better], d[better])
        keep = np.full(len(row), True) if self.widens else d <= self._reach()[row]
        if keep.any():
            self.open, self.open_at = (np.concatenate(c, axis=1) for c in zip((self.open, self.open_at), self._padded(row[keep], at[keep], d[keep])[1:]))

    def _padded(self, row: np.ndarray, at: np.ndarray, d: np.ndarray, every: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which walks, and a row of distances and keys for each; rows are sorted by walk."""
        first = _runs(row)
        size = np.diff(np.append(first, len(row)))
        walks = self.rows if every else row[first]
        line = self.line[row] if every else np.repeat(np.arange(len(first)), size)
        place = np.arange(len(row)) - np.repeat(first, size)
        wide, wide_at = np.full((len(walks), int(size.max())), np.inf), np.full((len(walks), int(size.max())), -1, np.int64)
        wide[line, place], wide_at[line, place] = d, at
        return walks, wide, wide_at

    def _rank(self, row: np.ndarray, at: np.ndarray, d: np.ndarray) -> None:
        """The best of each query, ties to the lowest id."""
        walks, new, new_at = self._padded(row, at, d, every=False)
        d, at = np.concatenate([self.best[walks], new], axis=1), np.concatenate([self.best_at[walks], new_at], axis=1)
        order = np.lexsort((at, d), axis=1)[:, :self.k]
        self.best[walks], self.best_at[walks] = np.take_along_axis(d, order, 1), np.take_along_axis(at, order, 1)

    def _reach(self) -> np.ndarray:
        # distances on the unit sphere, where (1 + epsilon) is a length
        return np.maximum(self.best[:, -1], 0) * (1 + self.epsilon) ** 2

    def go(self, epsilon: float) -> None:
        """Every walk to its end at this epsilon."""
        self.epsilon = epsilon
        on, packed = np.arange(len(self.rows)), 0
        while self.open.shape[1] and len(on):
            reach = self._reach()[self.rows]
            if self.open.shape[1] > max(128, 2 * packed):
                self._pack(reach)
                packed = self.open.shape[1]
            few = min(self.shard.config.width, self.open.shape[1])
            if not few:
                return
            pick = np.argpartition(self.open[on], few - 1, axis=1)[:, :few]
            d = self.open[on[:, None], pick]
            now = (d <= reach[on][:, None]) & np.isfinite(d)
            goes = now.any(axis=1)
            on, pick, now, d = on[goes], pick[goes], now[goes], d[goes]
            if not len(on):
                return
            keys = np.where(now, self.open_at[on[:, None], pick], -1)
            self.open[on[:, None], pick] = np.where(now, np.inf, d)
            rows = self.rows[on]
            if self.whole:
                line, place = np.nonzero(now)
                self.looked_up.append((rows[line], keys[line, place]))
            if not self.widens and 2 * len(on) < len(self.rows):
                # walks that have ended do not begin again at the same epsilon
                self.rows, self.open, self.open_at = rows, self.open[on], self.open_at[on]
                on = np.arange(len(rows))
                self.line[rows] = on
            near = np.where(now[:, :, None], self.shard.near[keys], -1)
            self._meet(rows, near.reshape(len(rows), -1))

    def everything(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Walk, key, distance and whether it was looked up of all keys met."""
        row, at, d = (np.concatenate(c) for c in zip(*self.met)) if self.met else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        looked_up = np.zeros(self.seen.shape, bool)
        for line, key in self.looked_up:
            looked_up[line, key] = True
        return row, at, d, looked_up[row, at]

    def nearest(self, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Walk, key and distance of the best, and on the first of each walk how many were measured."""
        row, place = np.nonzero(self.best_at[:, :best] >= 0)
        return row, self.best_at[row, place], self.best[row, place], np.where(place == 0, self.measured[row], 0)

    def _pack(self, reach: np.ndarray) -> None:
        """Keys that are looked up, or out of reach for good, give up their places."""
        gone = ~np.isfinite(self.open) if self.widens else (self.open > reach[:, None]) | ~np.isfinite(self.open)
        order = np.argsort(gone, axis=1, kind="stable")[:, :int((~gone).sum(axis=1).max(initial=0))]
        self.open = np.where(np.take_along_axis(gone, order, 1), np.inf, np.take_along_axis(self.open, order, 1))
        self.open_at = np.take_along_axis(self.open_at, order, 1)


# ---- cells ----

def _angles(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angles between rows and centres; absent for a row without a direction."""
    return np.arccos(np.clip(unit @ centres.T, -1, 1))


def _centres(unit: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """So many directions, or fewer if there are not as many, that most rows are close to one of."""
    rng = np.random.default_rng(seed)
    unit = unit[~np.isnan(unit).any(axis=1)]
    if not len(unit):
        return unit
    centres = unit[:1]
    far = np.maximum(1 - unit @ centres[0], 0)
    while len(centres) < cells and far.max() > DISTANCE_ERROR:
        centres = np.concatenate([centres, unit[rng.choice(len(unit), p=far / far.sum())][None]])
        far = np.minimum(far, np.maximum(1 - unit @ centres[-1], 0))
    for _ in range(CELL_ROUNDS):
        own = (unit @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, unit)
        length = np.sqrt((total ** 2).sum(axis=1, keepdims=True))
        centres = np.where(length > DISTANCE_ERROR, total / np.where(length > 0, length, 1), centres)
    return centres


def _in_cells(t: DataFrame, count: int, config: GraphConfig) -> tuple[DataFrame, Cells | None]:
    """Keys with their shard, and the cells; None if no key has a direction."""
    wanted = min(math.ceil(count / config.shard), CELL_SAMPLE // CELL_LEAST)
    sample = t.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(CELL_SAMPLE).toPandas()["v"]  # of bounded size
    centres = _centres(_unit(_matrix(sample)), wanted, config.seed)
    if not len(centres):
        return t, None
    shared = t.sparkSession.sparkContext.broadcast(centres)

    def nearest_centre(batches):
        for batch in batches:
            for at in range(0, len(batch), max(1, TILE // len(shared.value))):
                rows = batch.iloc[at:at + max(1, TILE // len(shared.value))]
                unit = _unit(_matrix(rows["v"]))
                sound = ~np.isnan(unit).any(axis=1)
                angle = _angles(np.where(sound[:, None], unit, 0), shared.value)
                cell = angle.argmin(axis=1)
                yield rows.assign(cell=cell.astype(np.int32), angle=np.where(sound, angle[np.arange(len(rows)), cell], 0.0))

    schema = f"id {t.schema['id'].dataType.simpleString()}, v array<double>, cell int, angle double"
    spread = max(t.sparkSession.sparkContext.defaultParallelism, math.ceil(count / config.shard))
    found = write_and_read(t.select("id", "v").repartition(spread).mapInPandas(nearest_centre, schema), "graph-cells")
    # a row for each cell
    size, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for cell, n, most in found.groupBy("cell").agg(F.count("*"), F.max("angle")).collect():
        size[cell], radius[cell] = n, most
    parts = -(-size // config.shard)
    cells = Cells(centres, radius, np.cumsum(parts) - parts, parts)
    of = t.sparkSession.createDataFrame([(c, int(f), int(p)) for c, (f, p) in enumerate(zip(cells.first, parts))], "of int, first int, parts int")
    shard = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
    return found.join(F.broadcast(of), F.col("cell") == F.col("of")).select(shard.alias("shard"), "id", "v"), cells


# ---- over shards ----

def build(keys: DataFrame, id_col: str = "id", vector: str = "features", label: str | None = None, config: GraphConfig = GraphConfig()) -> Graph:
    """The graph over all keys."""
    t = _prepared(keys, id_col, vector, label)
    if label is None:
        t = t.withColumn("label", F.lit(None).cast("int"))
    t = write_and_read(t.where("id is not null and v is not null"), "graph-keys")
    count = t.count()
    shards = max(1, math.ceil(count / config.shard), min(count // LEAST_KEYS, LEAST_SHARDS))
    dealt, cells = t.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "v"), None
    if shards > LEAST_SHARDS:
        by_direction, cells = _in_cells(t, count, config)
        if cells is not None:
            dealt, shards = by_direction, int(cells.parts.sum())

    def descend(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable", ignore_index=True)
        unit = _unit(_matrix(rows["v"]))
        codes = _codes(unit, len(rows), config)
        lists, rounds = _descended(unit, codes, config)
        first = np.arange(len(rows)) == 0
        return rows.assign(
            place=np.arange(len(rows)), codes=list(codes), near=_both_ways(lists), rounds=np.where(first, rounds, 0), compared=np.where(first, lists.compared, 0))

    dealt = dealt.withColumn("turn", F.xxhash64("id", F.lit(config.seed)))
    kind = t.schema["id"].dataType.simpleString()
    schema = f"shard int, id {kind}, v array<double>, turn long, place int, codes array<long>, near array<int>, rounds int, compared long"
    # shards are small in bytes and long in work, so their tasks are not to be put together
    index = write_and_read(dealt.repartition(2 * shards, "shard").groupBy("shard").applyInPandas(descend, schema), "graph-index")
    state = index.agg(F.coalesce(F.max("rounds"), F.lit(0)), F.coalesce(F.sum("compared"), F.lit(0))).first()
    return Graph(t, index.drop("rounds", "compared"), shards, config, *state, cells)


def _meetings(graph: Graph, queries: DataFrame, rows: int):
    """Each block of queries and each shard, as one group."""
    size = queries.count()
    blocks = max(1, math.ceil(size / rows), min(math.ceil(size / LEAST_ROWS), math.ceil(LEAST_TASKS / graph.shards)))
    block = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(graph.shards - 1))))
    right = graph.index.withColumn("block", F.explode(block))
    sides = (side.repartition(2 * blocks * graph.shards, "shard", "block").groupBy("shard", "block") for side in (left, right))
    return next(sides).cogroup(next(sides))


def _reached(graph: Graph, queries: DataFrame, first: bool) -> DataFrame:
    """`queries` once for each shard to walk: those of the own cell, or after these the others that may hold a key within `reach`, the distance of the k-th best."""
    shared = queries.sparkSession.sparkContext.broadcast(graph.cells)

    def choose(batches):
        cells = shared.value
        for batch in batches:
            for at in range(0, len(batch), max(1, TILE // len(cells.centres))):
                rows = batch.iloc[at:at + max(1, TILE // len(cells.centres))]
                unit = _unit(_matrix(rows["v"]))
                sound = ~np.isnan(unit).any(axis=1)
                rows = rows[sound]
                angle = _angles(unit[sound], cells.centres)
                own = np.zeros(angle.shape, bool)
                own[np.arange(len(rows)), np.where(cells.parts > 0, angle, np.inf).argmin(axis=1)] = True
                reached = own
                if not first:
                    reach = rows["reach"].fillna(np.inf).to_numpy(dtype=np.float64)
                    limit = np.where(reach < 2, np.arccos(np.clip(1 - reach - DISTANCE_ERROR, -1, 1)), np.inf)
                    reached = ~own & (angle - cells.radius <= limit[:, None] + ANGLE_ERROR)
                line, shard = cells.shards(reached)
                yield rows.iloc[line][["id", "v", "row"]].assign(shard=shard.astype(np.int32))

    kind = queries.schema["id"].dataType.simpleString()
    spread = queries.repartition(queries.sparkSession.sparkContext.defaultParallelism) if first else queries
    return write_and_read(spread.mapInPandas(choose, f"id {kind}, v array<double>, row long, shard int"), "graph-reached")


def _meetings_of(graph: Graph, reached: DataFrame, rows: int):
    """Each shard and each block of the queries that walk it, as one group; None if there are none."""
    size = {shard: n for shard, n in reached.groupBy("shard").count().collect()}  # a row for each shard
    if not size:
        return None
    most = math.ceil(LEAST_TASKS / len(size))
    blocks = [(shard, max(1, math.ceil(n / rows), min(math.ceil(n / LEAST_ROWS), most))) for shard, n in size.items()]
    told = F.broadcast(reached.sparkSession.createDataFrame(blocks, "of int, blocks int"))
    cut = lambda side, block: side.join(told, F.col("shard") == F.col("of")).withColumn("block", block).drop("of", "blocks")
    left = cut(reached, F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    right = cut(graph.index, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = min(MOST_TASKS, 2 * sum(n for _, n in blocks))
    sides = (side.repartition(tasks, "shard", "block").groupBy("shard", "block") for side in (left, right))
    return next(sides).cogroup(next(sides))


def _epsilon(graph: Graph, sample: DataFrame, k: int, skip_same: bool, recall_target: float) -> float:
    """The first epsilon, in steps, at which walks of the sample have met the wanted share of its nearest keys."""
    config, steps = graph.config, math.ceil(graph.config.widest / graph.config.widen)
    truth = nearest(sample, graph.keys, k, vector="v", label="label", skip_same=skip_same).where("distance is not null")
    truth = write_and_read(sample.join(truth.groupBy(F.col("query_id").alias("id")).agg(F.collect_list("key_id").alias("truth")), "id"), "graph-truth")
    wanted = recall_target * truth.agg(F.coalesce(F.sum(F.size("truth")), F.lit(0))).first()[0]

    def first_met(until: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        def widen(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(left) and len(right):
                shard = _Shard(right, config)
                walks = _Walks(shard, left["id"].to_numpy(), _unit(_matrix(left["v"])), k, skip_same, widens=True)
                where = {key: at for at, key in enumerate(shard.ids)}
                rest = [(row, where[key]) for row, keys in enumerate(left["truth"]) for key in keys if key in where]
                for step in range(until + 1):
                    if not rest:
                        break
                    walks.go(step * config.widen)
                    found += [step for pair in rest if walks.seen[pair]]
                    rest = [pair for pair in rest if not walks.seen[pair]]
            return pd.DataFrame({"step": np.array(found, np.int32)})
        return widen

    until = min(steps, max(1, steps // 10))
    while True:
        by_step = _meetings(graph, truth, QUERY_ROWS).applyInPandas(first_met(until), "step int").groupBy("step").count().orderBy("step").collect()
        met = 0
        for step, count in by_step:
            met += count
            if met >= wanted:
                return step * config.widen
        if until == steps:
            return steps * config.widen
        until = min(steps, 2 * until)


def walk(
    graph: Graph, queries: DataFrame, k: int = 1, query_id: str = "id", vector: str = "features", skip_same: bool = False,
    search_epsilon: float | None = None, recall_target: float = 0.9, best: int | None = None,
) -> DataFrame:
    """(query_id, key_id, distance, looked_up): all keys that were measured for each query.

    With `best` these are only the so many nearest ones (at most k) of each query and shard: (query_id, key_id, distance, measured), where `measured`
    summed over the rows of a query is the number of its measured keys. That many rows are queries times shards times `best`.
    """
    if best is not None and best > k:
        raise ValueError(f"a walk for {k} neighbours does not rank {best}")
    config = graph.config
    q = write_and_read(_prepared(queries, query_id, vector).where("id is not null and v is not null"), "graph-queries")
    epsilon = search_epsilon
    if epsilon is None:
        epsilon = _epsilon(graph, q.orderBy(F.xxhash64("id"), "id").limit(config.sample), k, skip_same, recall_target)
    whole = best is None

    in_cells = graph.cells is not None

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [(left["id"].to_numpy()[:0], right["id"].to_numpy()[:0], np.zeros(0), np.zeros(0, bool if whole else np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            shard, ids, unit = _Shard(right, config), left["id"].to_numpy(), _unit(_matrix(left["v"]))
            rows = left["row"].to_numpy() if in_cells else np.zeros(len(left), np.int64)
            for at in range(0, len(left), BATCH):
                walks = _Walks(shard, ids[at:at + BATCH], unit[at:at + BATCH], k, skip_same, whole=whole)
                walks.go(epsilon)
                row, key, distance, last = walks.everything() if whole else walks.nearest(best)
                found.append((ids[at:at + BATCH][row], shard.ids[key], distance, last, rows[at:at + BATCH][row], walks.best[row, -1]))
        names = ("query_id", "key_id", "distance", "looked_up" if whole else "measured", "row", "reach")
        return pd.DataFrame({name: np.concatenate(c) for name, c in zip(names, zip(*found)) if in_cells or name not in ("row", "reach")})

    rows = WHOLE_ROWS if whole else QUERY_ROWS
    kinds = f"query_id {q.schema['id'].dataType.simpleString()}, key_id {graph.keys.schema['id'].dataType.simpleString()}, distance double, {'looked_up boolean' if whole else 'measured long'}"
    if not in_cells:
        found = _meetings(graph, q, rows).applyInPandas(search, kinds)
        return found if whole else write_and_read(found, "graph-found")
    q = write_and_read(q.withColumn("row", F.monotonically_increasing_id()), "graph-rows")
    kinds += ", row long, reach double"
    near = _meetings_of(graph, _reached(graph, q, True), rows)
    if near is None:
        return q.sparkSession.createDataFrame([], kinds).drop("row", "reach")
    near = write_and_read(near.applyInPandas(search, kinds), "graph-found")
    reach = near.groupBy(F.col("row").alias("of")).agg(F.min("reach").alias("reach")).hint("merge")
    far = _meetings_of(graph, _reached(graph, q.join(reach, F.col("row") == F.col("of"), "left").select("id", "v", "row", "reach"), False), rows)
    if far is not None:
        near = near.unionByName(write_and_read(far.applyInPandas(search, kinds), "graph-found"))
    return near.drop("row", "reach")


def search(
    graph: Graph, queries: DataFrame, k: int = 1, query_id: str = "id", vector: str = "features", skip_same: bool = False,
    search_epsilon: float | None = None, recall_target: float = 0.9,
) -> DataFrame:
    """The k nearest of the keys that the walks met: (query_id, key_id, label, distance, rank), as in `knn.nearest`."""
    return best_of(graph, walk(graph, queries, k, query_id, vector, skip_same, search_epsilon, recall_target, best=k), k)


def best_of(graph: Graph, met: DataFrame, k: int) -> DataFrame:
    along = Window.partitionBy("query_id").orderBy("distance", "key_id")
    best = met.withColumn("rank", F.row_number().over(along)).where(F.col("rank") <= k)
    labels = graph.keys.select(F.col("id").alias("key_id"), "label").hint("merge")  # as many as keys, however small their files
    return _finite(best.join(labels, "key_id").select("query_id", "key_id", "label", "distance", "rank"))
