"""Per-flow plug-ins: a user's state for every flow, updated by packets and merged across tasks.

A plug-in runs where the packets are. Each task keeps a state per flow it meets, in Arrow batches, and sends states, not packets, through one
shuffle; there the states of a flow are merged one after another. So a flow with a third of all packets costs each task one state, and no
task ever holds all packets, or all states, of a flow.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T


class FlowPlugin:
    """To be subclassed. `columns` are the numeric packet columns it reads, `result` the columns it adds to a flow, as DDL.

    `update` gets packets as arrays by name, `t` (microseconds) and `seq` included, sorted by these; a missing value is NaN. Several calls for one flow come in
    any order of time, so a state that depends on order keeps the times it needs. States are small objects that pickle can store.
    """

    columns: Sequence[str] = ()
    result: str = ""

    def init(self) -> Any:
        """The state of a flow without packets."""
        raise NotImplementedError

    def update(self, state: Any, packets: dict[str, np.ndarray]) -> Any:
        raise NotImplementedError

    def merge(self, state: Any, other: Any) -> Any:
        """The state of two parts of a flow, whose times may interleave."""
        raise NotImplementedError

    def finish(self, state: Any) -> tuple:
        """Values of `result`, once all packets are in."""
        raise NotImplementedError


class FirstPackets(FlowPlugin):
    """`t` and the columns' values of the first `limit` packets of a flow, as arrays in order of time and `seq`."""

    def __init__(self, columns: Sequence[str], limit: int):
        self.columns, self.limit = tuple(columns), limit
        self.result = ", ".join(["t array<bigint>", *(f"{c} array<double>" for c in self.columns)])

    def init(self):
        return np.empty((2, 0), dtype="int64"), np.empty((len(self.columns), 0))

    def update(self, state, packets):
        n = slice(self.limit)  # the run is in order
        values = np.array([packets[c][n] for c in self.columns], dtype="float64").reshape(len(self.columns), -1)
        return self.merge(state, (np.array([packets["t"][n], packets["seq"][n]]), values))

    def merge(self, state, other):
        at, values = (np.concatenate(pair, axis=1) for pair in zip(state, other))
        first = np.lexsort((at[1], at[0]))[: self.limit]
        return at[:, first], values[:, first]

    def finish(self, state):
        at, values = state
        return at[0].tolist(), *([None if np.isnan(x) else x for x in row.tolist()] for row in values)


def apply_plugin(packets: DataFrame, flow: Sequence[str], plugin: FlowPlugin, ts: str = "ts", seq: str = "seq", max_open: int = 50_000) -> DataFrame:
    """One row per flow: its key and the plug-in's result. `packets` are all packets, with their flow (`assemble.assign_flows`).

    A task sends its states on when it holds more than `max_open`; a flow met again begins another, merged with the rest later.
    Packets without a time belong to no flow. An empty table gives an empty one.
    """
    flow = list(flow)
    clash = {"t", "seq"} & {*flow, *plugin.columns}
    if clash:
        raise ValueError(f"names kept for time and order: {sorted(clash)}")
    named = [f"__flow{i}" for i in range(len(flow))]
    work = packets.where(F.col(ts).isNotNull()).select(
        *[F.col(c).alias(n) for c, n in zip(flow, named)], F.unix_micros(ts).alias("t"), F.coalesce(F.col(seq).cast("long"), F.lit(0)).alias("seq"),
        *[F.col(c).cast("double").alias(c) for c in plugin.columns],
    )
    key_fields = [T.StructField(n, work.schema[n].dataType) for n in named]
    partial = T.StructType([*key_fields, T.StructField("state", T.BinaryType())])
    result = T._parse_datatype_string(plugin.result)
    out = T.StructType([*key_fields, *result.fields])

    def sent(states: dict) -> pd.DataFrame:
        frame = pd.DataFrame(list(states), columns=named)
        frame["state"] = [pickle.dumps(s) for s in states.values()]
        return frame

    def begun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, Any] = {}
        for batch in batches:
            codes = batch.groupby(named, sort=False, dropna=False).ngroup().to_numpy()
            order = np.lexsort((batch["seq"], batch["t"], codes))
            batch, codes = batch.iloc[order], codes[order]
            arrays = {c: batch[c].to_numpy() for c in ("t", "seq", *plugin.columns)}
            edges = [*np.flatnonzero(np.diff(codes, prepend=-1)), len(codes)]
            heads = batch[named].iloc[edges[:-1]].astype(object)
            for a, b, key in zip(edges[:-1], edges[1:], heads.where(heads.notna(), None).itertuples(index=False, name=None)):
                state = states[key] if key in states else plugin.init()
                states[key] = plugin.update(state, {c: v[a:b] for c, v in arrays.items()})
            if len(states) > max_open:
                yield sent(states)
                states = {}
        if states:
            yield sent(states)

    def finished(rows: list) -> pd.DataFrame:
        return pd.DataFrame([(*key, *plugin.finish(state)) for key, state in rows], columns=out.names)

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, rows = None, None, []
        for batch in batches:
            keys = batch[named].astype(object)
            for key, stored in zip(keys.where(keys.notna(), None).itertuples(index=False, name=None), batch["state"]):
                other = pickle.loads(stored)
                if key == current:
                    state = plugin.merge(state, other)
                    continue
                if current is not None:
                    rows.append((current, state))
                current, state = key, other
                if len(rows) == 4096:
                    yield finished(rows)
                    rows = []
        if current is not None:
            yield finished([*rows, (current, state)])

    states = work.mapInPandas(begun, partial).repartition(*named).sortWithinPartitions(*named)
    done = states.mapInPandas(merged, out)
    return done.select(*[F.col(n).alias(c) for n, c in zip(named, flow)], *result.names)
