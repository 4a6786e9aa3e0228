"""Secret scans with one deterministic automaton for all rules.

Each rule is a regular expression over ASCII. Its `sign`, a short expression that every reportable match contains, goes into the combined automaton: all signs
become one nondeterministic automaton, subset construction makes it deterministic, partition refinement makes it minimal, and bytes that no rule tells
apart share a column of the transition array. One pass over the bytes of a batch of texts runs it in lanes that advance together, one byte of each per
step. Lanes begin behind bytes that lead back to the start from every state where there are such, else at fixed distances: they take the start state for granted
and run again from the state that the lane before ended in until all agree; lanes that don't settle soon are run from every state at once and the maps composed.
Only parts between bytes that no match contains are looked at again, and only where a sign was met: the reversed automaton of the rule, run the same way,
says where matches begin, its own where the longest ends. Time is linear in the bytes, also of one line of any length.

Matches of one rule don't overlap; a match that is too short is dropped but still consumed. Offsets are code points, the end is exclusive.
A null text is empty. Texts of any length are read whole. Repeated rows are rows of their own. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import cache
from re import _constants as ops, _parser as patterns

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

_END = 0xFF  # never part of UTF-8: stands between texts
LANES = 4_096
LANE_BYTES = 64  # shorter lanes don't pay
ROUNDS = 3  # of running lanes again before all states are tried


@dataclass(frozen=True)
class Rule:
    """`head` is the part of a match that does not count towards `least` characters."""

    kind: str
    pattern: str
    sign: str
    least: int = 1
    head: str = ""


_KEYWORD = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
_VALUE = r"[A-Za-z0-9+/_.=-]"

#: Fixed base rules, then those that the method adds.
BASE = (
    Rule("assign", _KEYWORD + _VALUE + "+", _KEYWORD + _VALUE, 6, _KEYWORD),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]", 20),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{24}", 24),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]", 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]", 15),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]+\.eyJ", 30),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]+", r"AIza[A-Za-z0-9_-]", 39),
    Rule("payment_key", r"[rs]k_live_[A-Za-z0-9]+", r"[rs]k_live_[A-Za-z0-9]", 24),
)


class _Nfa:
    """Thompson construction: edges by byte set and empty edges."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree, start: int, fold: bool) -> int:
        """Append a parsed expression behind `start`; returns the state behind it."""
        for op, value in tree:
            if op is ops.LITERAL or op is ops.IN:
                end = self.state()
                self.edges[start].append((_bytes(op, value, fold), end))
                start = end
            elif op is ops.SUBPATTERN:
                _, on, off, inner = value
                start = self.add(inner, start, (fold or bool(on & re.IGNORECASE)) and not off & re.IGNORECASE)
            elif op is ops.BRANCH:
                end = self.state()
                for branch in value[1]:
                    self.empty[self.add(branch, start, fold)].append(end)
                start = end
            elif op is ops.MAX_REPEAT:
                least, most, inner = value
                for _ in range(least):
                    start = self.add(inner, start, fold)
                if most is ops.MAXREPEAT:
                    loop = self.state()
                    self.empty[start].append(loop)
                    self.empty[self.add(inner, loop, fold)].append(loop)
                    start = loop
                else:
                    end = self.state()
                    self.empty[start].append(end)
                    for _ in range(most - least):
                        start = self.add(inner, start, fold)
                        self.empty[start].append(end)
                    start = end
            else:
                raise ValueError(f"not supported in rules: {op}")
        return start

    def turn(self, first: int, finals: dict[int, int]) -> tuple[int, dict[int, int]]:
        """Turn all edges round; returns the new start and the new final states."""
        edges, empty = self.edges, self.empty
        self.edges, self.empty = [[] for _ in edges], [[] for _ in empty]
        for s in range(len(edges)):
            for allowed, t in edges[s]:
                self.edges[t].append((allowed, s))
            for t in empty[s]:
                self.empty[t].append(s)
        start, ends = self.state(), {}
        for final, k in finals.items():
            self.empty[start].append(final)
            reached, stack = {final}, [final]  # expressions share no state but `first`
            while stack:
                s = stack.pop()
                for t in [*self.empty[s], *(t for _, t in self.edges[s])]:
                    if t == first:
                        ends[s] = k
                    elif t not in reached:
                        reached.add(t)
                        stack.append(t)
        return start, ends

    def closure(self, states: frozenset[int]) -> frozenset[int]:
        found, stack = set(states), list(states)
        while stack:
            for s in self.empty[stack.pop()]:
                if s not in found:
                    found.add(s)
                    stack.append(s)
        return frozenset(found)


def _bytes(op, value, fold: bool) -> frozenset[int]:
    items = [(op, value)] if op is ops.LITERAL else value
    found: set[int] = set()
    for kind, x in items:
        if kind is ops.LITERAL:
            found.add(x)
        elif kind is ops.RANGE:
            found.update(range(x[0], x[1] + 1))
        else:
            raise ValueError(f"not supported in rules: {kind}")
    if max(found) > 127:
        raise ValueError("rules are over ASCII")
    if fold:
        found |= {ord(c) for x in found for c in (chr(x).lower(), chr(x).upper()) if ord(c) < 128}
    return frozenset(found)


@dataclass
class Automaton:
    """Transition array [state, class], byte classes, accepted rules of each state as bits. State 0 is the start."""

    table: np.ndarray
    classes: np.ndarray
    accepts: np.ndarray
    dead: int


def compile_rules(expressions: list[str], anywhere: bool, backwards: bool = False) -> Automaton:
    """The minimal automaton of several expressions; `anywhere` lets a match begin at every byte, `backwards` reads from right to left."""
    nfa = _Nfa()
    first, finals = nfa.state(), {}
    for k, text in enumerate(expressions):
        own = nfa.state()
        nfa.empty[first].append(own)
        finals[nfa.add(patterns.parse(text), own, False)] = k
    if backwards:
        first, finals = nfa.turn(first, finals)
    signature: dict[tuple, int] = {}
    classes = np.zeros(256, np.uint8)
    sets = list({s for edges in nfa.edges for s, _ in edges})
    for byte in range(256):
        classes[byte] = signature.setdefault(tuple(byte in s for s in sets), len(signature))
    example = {int(c): b for b, c in enumerate(classes)}
    start = nfa.closure(frozenset([first]))
    number, rows, order = {start: 0}, [], [start]
    for states in order:
        row = []
        for c in range(len(signature)):
            reached = {t for s in states for allowed, t in nfa.edges[s] if example[c] in allowed}
            target = nfa.closure(frozenset(reached | ({first} if anywhere else set())))
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        rows.append(row)
    table = np.array(rows, np.int32)
    accepts = np.array([sum(1 << finals[s] for s in states if s in finals) for states in order], np.int64)
    group = np.unique(accepts, return_inverse=True)[1]
    while True:  # split groups until all members of a group step alike
        finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    rename = np.full(group.max() + 1, -1)
    for g in group:  # the start stays state 0
        if rename[g] < 0:
            rename[g] = rename.max() + 1
    group = rename[group]
    keep = np.unique(group, return_index=True)[1]
    table, accepts = group[table[keep]].astype(np.int32), accepts[keep]
    still = np.flatnonzero((table == np.arange(len(table))[:, None]).all(axis=1) & (accepts == 0))
    return Automaton(table, classes, accepts, int(still[0]) if len(still) else -1)


class Runner:
    """An automaton that reads a whole batch in lanes; its matches may begin at every byte."""

    def __init__(self, auto: Automaton):
        self.auto, self.width = auto, auto.table.shape[1]
        self.flat = (auto.table * self.width).ravel()  # states are kept multiplied by the width
        self.hit = np.repeat(auto.accepts > 0, self.width)
        self.resets = (auto.table == 0).all(axis=0)[auto.classes]

    def _lanes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, stops) of lanes of about equal length, behind a resetting byte where one comes before the next lane."""
        lanes = max(1, min(LANES, len(data) // LANE_BYTES))
        wanted = np.arange(lanes + 1) * len(data) // lanes
        cuts = np.flatnonzero(self.resets[data]) + 1
        at = np.append(cuts, len(data) + 1)[np.searchsorted(cuts, wanted[1:-1])] if lanes > 1 else wanted[:0]
        starts = np.concatenate(([0], np.where(at < wanted[2:], at, wanted[1:-1])))
        return starts, np.append(starts[1:], len(data))

    def _steps(self, symbols: np.ndarray, starts: np.ndarray, stops: np.ndarray, state: np.ndarray):
        """Advance `state`, one row of states per lane, byte by byte; yields the lanes that went on and the step."""
        order = np.argsort(starts - stops, kind="stable")
        begin, lengths = starts[order], (stops - starts)[order]
        moving = state[order]
        for step, n in enumerate(np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), side="left").tolist()):
            read = symbols[begin[:n] + step]
            moving[:n] = self.flat[moving[:n] + read.reshape(-1, *[1] * (state.ndim - 1))]
            yield order[:n], moving[:n], step
        state[order] = moving

    def _run(self, symbols: np.ndarray, starts: np.ndarray, stops: np.ndarray, begin: np.ndarray):
        """(end states, lane, place, state) of the lanes from the states they begin in; the last three where the automaton accepts."""
        state, lanes, places, states = begin.copy(), [], [], []
        for who, now, step in self._steps(symbols, starts, stops, state):
            met = np.flatnonzero(self.hit[now])
            if len(met):
                lanes.append(who[met])
                places.append(starts[who[met]] + step)
                states.append(now[met])
        joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lanes, places, states)]
        return state, *joined

    def _composed(self, symbols: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The states that the lanes begin in, from what each lane makes of every state."""
        maps = np.tile(np.arange(len(self.auto.table), dtype=np.int32) * self.width, (len(starts), 1))
        for _ in self._steps(symbols, starts, stops, maps):
            pass
        begin = np.zeros(len(starts), np.int32)
        for i in range(len(starts) - 1):
            begin[i + 1] = maps[i, begin[i] // self.width]
        return begin

    def ends(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, rules as bits), by place, of the bytes at which some match ends."""
        starts, stops = self._lanes(data)
        symbols, begin = self.auto.classes[data], np.zeros(len(starts), np.int32)
        end, lane, place, state = self._run(symbols, starts, stops, begin)
        for turn in range(ROUNDS + 1):
            truth = self._composed(symbols, starts, stops) if turn == ROUNDS else np.concatenate(([0], end[:-1])).astype(np.int32)
            wrong = np.flatnonzero(truth != begin)
            if not len(wrong):
                break
            begin[wrong] = truth[wrong]
            again, of, where, reached = self._run(symbols, starts[wrong], stops[wrong], begin[wrong])
            end[wrong] = again
            stay = ~np.isin(lane, wrong)
            lane, place, state = (np.concatenate(x) for x in ((lane[stay], wrong[of]), (place[stay], where), (state[stay], reached)))
        order = np.argsort(place, kind="stable")
        return place[order], self.auto.accepts[state[order] // self.width]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.signs = Runner(compile_rules([r.sign for r in rules], True))
        self.begins = [Runner(compile_rules([r.pattern], True, backwards=True)) for r in rules]
        own = [compile_rules([r.pattern], False) for r in rules]
        heads = [compile_rules([r.head], False) if r.head else None for r in rules]
        self.cuts = [(a.table == a.dead).all(axis=0)[a.classes] for a in own]  # per rule: bytes that no match contains
        if not all(cuts[128:].all() for cuts in self.cuts):
            raise ValueError("a rule reaches beyond ASCII")
        self._own = [(a.table.tolist(), a.classes.tolist(), a.accepts.tolist(), a.dead) if a else None for a in (*own, *heads)]

    def _longest(self, which: int, data: bytes, start: int, stop: int) -> int:
        """Where the longest match from `start` ends, or -1."""
        table, classes, accepts, dead = self._own[which]
        state, end = 0, -1
        for i in range(start, stop):
            state = table[state][classes[data[i]]]
            if state == dead:
                break
            if accepts[state]:
                end = i + 1
        return end

    def _matches(self, k: int, data: bytes, array: np.ndarray, signs: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) of the leftmost longest matches of rule k in the parts between its cutting bytes that hold one of the `signs`."""
        cuts = np.flatnonzero(self.cuts[k][array])  # the last byte is one
        nearest = np.unique(np.searchsorted(cuts, signs))
        starts, stops = np.where(nearest > 0, cuts[nearest - 1] + 1, 0), cuts[nearest]
        sizes = stops - starts + 1  # with the cutting byte behind
        before = np.cumsum(sizes) - sizes
        places = np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)
        backwards, _ = self.begins[k].ends(array[places[::-1]])
        found, rule, free = [], self.rules[k], 0
        for at in places[len(places) - 1 - backwards[::-1]].tolist():
            if at < free:
                continue
            free = self._longest(k, data, at, len(data))
            head = self._longest(len(self.rules) + k, data, at, free) if rule.head else at
            if free - head >= rule.least:
                found.append((at, free))
        return found

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, end, rule) in code points, by start and then rule."""
        encoded = [(t or "").encode("utf-8", "replace") for t in texts]
        data = bytes([_END]).join([*encoded, b""])
        array = np.frombuffer(data, np.uint8)
        begins = np.concatenate(([0], np.cumsum([len(e) + 1 for e in encoded])))
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        places, met = self.signs.ends(array)
        for k in range(len(self.rules)):
            signs = places[met >> k & 1 == 1]
            for start, end in self._matches(k, data, array, signs) if len(signs) else ():
                at = int(np.searchsorted(begins, start, side="right")) - 1
                found[at].append((start - int(begins[at]), end - int(begins[at]), k))
        for at, spans in enumerate(found):
            if spans:
                points = np.cumsum((np.frombuffer(encoded[at] + b"\x00", np.uint8) & 0xC0) != 0x80) - 1
                found[at] = sorted(((int(points[s]), int(points[e]), k) for s, e, k in spans), key=lambda x: (x[0], x[2]))
        return found


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def _digest(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, e, k in spans)


def find_secrets(docs: DataFrame, more: tuple[Rule, ...] = MORE, text_col: str = "text") -> DataFrame:
    """`docs` with `__secrets`: counts of the base kinds, the digest of the base spans, and all spans as text."""
    rules = (*BASE, *more)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for spans in scanner(rules).scan(texts.tolist()):
            base = [x for x in spans if x[2] < len(BASE)]
            counts = [sum(x[2] == k for x in base) for k in range(len(BASE))]
            rows.append((*counts, hashlib.sha256(_digest(base, rules).encode()).hexdigest(), _digest(spans, rules)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.withColumn("__secrets", of(F.col(text_col)))


def redact(docs: DataFrame, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """`docs` with every found span of `text` replaced by its kind in brackets; of overlapping spans the first, then the longest, wins."""
    rules = (*BASE, *more)

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, scanner(rules).scan(texts.tolist())):
            parts, at = [], 0
            for start, end, k in sorted(spans, key=lambda x: (x[0], -x[1], x[2])):
                if start >= at:
                    parts += [text[at:start], f"[{rules[k].kind}]"]
                    at = end
            out.append("".join(parts) + text[at:] if spans else text)
        return pd.Series(out, dtype=object)

    return docs.select(*[of(F.col("text")).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
