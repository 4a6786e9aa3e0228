"""Flow assembly, throughput, scoring and duplicate removal on streams."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowloom.operators.assemble import FlowConfig
from flowloom.operators.plugins import FlowPlugin
from flowloom.plans.storage import scratch_path

MAX_FILES = 64


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None,
                max_files: int = MAX_FILES) -> DataFrame:
    """Parquet files as they arrive; the number of files per micro-batch bounds what one batch can hold."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process what is there into a parquet table in the shared folder and return the table."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    query = (stream.writeStream.format("parquet").option("path", f"{base}/table")
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def run_to_end(spark: SparkSession, folder: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame], last: dict, name: str,
               pattern: str | None = None) -> DataFrame:
    """Process all files as a stream that then ends: what is still open is reported too.

    After the files, the same query goes on with one more row (`last`), later than all others by more than any timeout. It moves the watermark
    past everything; what belongs to that row itself stays open and is not reported.
    """
    base = scratch_path(spark, name)
    spark.createDataFrame([], schema).write.parquet(f"{base}/end")
    for closing in (False, True):
        if closing:
            row = spark.range(1).select(*[F.lit(last[f.name]).cast(f.dataType).alias(f.name) for f in schema])
            row.write.mode("append").parquet(f"{base}/end")
        source = read_stream(spark, folder, schema, pattern).unionByName(read_stream(spark, f"{base}/end", schema))
        out = transform(source)
        (out.writeStream.format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(out.schema).parquet(f"{base}/table")


def stream_sessions(packets: DataFrame, keys: Sequence[str], size: Column, idle_s: int, delay: str) -> DataFrame:
    """Idle-only flows: emitted once the watermark has passed their last packet by the idle timeout."""
    return (
        packets.withColumn("__size", size).withWatermark("ts", delay)
        .groupBy(*keys, F.session_window("ts", f"{idle_s} seconds").alias("w"))
        .agg(F.count("*").alias("packets"), F.sum("__size").alias("bytes"), F.min("ts").alias("first_ts"))
        .select(*keys, "first_ts", F.expr(f"w.end - interval {idle_s} seconds").alias("last_ts"), "packets", "bytes")
    )


def stream_throughput(packets: DataFrame, keys: Sequence[str], size: Column, width: str, delay: str) -> DataFrame:
    """Bytes per wall-clock bin."""
    return (
        packets.withColumn("__size", size).withWatermark("ts", delay).groupBy(*keys, F.window("ts", width).alias("w"))
        .agg(F.sum("__size").alias("bytes")).select(*keys, F.col("w.start").alias("start_ts"), "bytes")
    )


def stream_deduplicated(flows: DataFrame, keys: Sequence[str], delay: str) -> DataFrame:
    """One row per key within the watermark delay."""
    return flows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def stream_scored(stream: DataFrame, name: str, score: Column) -> DataFrame:
    """A column computed on the stream, such as a codebook's nearest centre."""
    return stream.withColumn(name, score)


#: One binary per bucket of keys: their open flows, plug-in states and waiting packets as arrays, since Spark takes a state apart field by field.
_STATE = T.StructType([T.StructField("held", T.BinaryType())])
#: Keys share a call and a state by their hash: a call costs Spark some 15 ms, whatever it holds.
BUCKETS = 1 << 10


def _whole(column: pd.Series) -> np.ndarray:
    """Whole numbers; an absent one is an error, as a number that is not finite cannot be cast."""
    return column.astype("int64").to_numpy()


def _starts(t: np.ndarray, start: int | None, last: int | None, idle: int, active: int) -> list[int]:
    """Positions in sorted times at which a new flow begins, given the open flow."""
    gaps = np.diff(t, prepend=t[0] if last is None else last) > idle
    if start is None:
        gaps[0] = True
    idle_starts = np.append(np.nonzero(gaps)[0], len(t))
    found, at, begin = [], 0, start
    while at < len(t):
        following = int(idle_starts[np.searchsorted(idle_starts, at)])
        cut = len(t) if begin is None else int(np.searchsorted(t, begin + active, side="right"))
        at = min(following, max(cut, at))
        if at < len(t):
            found.append(at)
            begin = int(t[at])
            at += 1
    return found


class _OpenFlow:
    """The open flow of a key: counters and the first N packets only."""

    def __init__(self, limit: int, state: tuple | None):
        self.limit = limit
        self.start, self.last, self.packets, self.bytes, self.ps, self.ipt = state or (None, None, 0, 0, [], [])
        self.ps, self.ipt = list(self.ps), list(self.ipt)

    def begin(self, t: int) -> None:
        self.start, self.last, self.packets, self.bytes = t, None, 0, 0
        self.ps, self.ipt = [], []

    def add(self, t: np.ndarray, size: np.ndarray, direction: np.ndarray) -> None:
        room = max(0, self.limit - len(self.ps))
        gaps = np.diff(t[:room], prepend=t[0] if self.last is None else self.last) / 1000.0
        self.ps += np.where(direction[:room] == 1, -size[:room], size[:room]).astype(float).tolist()
        self.ipt += gaps.tolist()
        self.packets, self.bytes, self.last = self.packets + len(t), self.bytes + int(size.sum()), int(t[-1])

    def row(self) -> dict:
        return {"start_us": self.start, "end_us": self.last, "packets": self.packets,
                "bytes": self.bytes, "ps": self.ps, "ipt": self.ipt}


def stream_flows(packets: DataFrame, keys: Sequence[str], size: Column, direction: Column, config: FlowConfig, delay: str,
                 on_flow: Callable[[dict], dict] | None = None, extra: T.StructType = T.StructType(), plugin: FlowPlugin | None = None,
                 buckets: int = BUCKETS) -> DataFrame:
    """Idle and active timeouts on a stream; a flow (key, start_us) is emitted when it can no longer change.

    State per key: the open flow's counters, its first N packets, and packets newer than the watermark, which wait there so
    that late packets fall into place. Input is processed per micro-batch in time order, so the state is bounded by
    N and by the packets that arrive within the watermark delay. Keys are dealt into `buckets` by hash; a task sees the keys of a bucket together,
    and a bucket's state is written anew when any of them has packets, so a stream of very many keys takes more buckets. `on_flow` may add columns (`extra`) to an emitted flow.
    `plugin` keeps its own state in that of the key, sees every packet of a flow in order and adds its result.
    """
    keys = list(keys)
    idle = int((config.idle if config.idle is not None else 1e12) * 1_000_000)
    active = int((config.active if config.active is not None else 1e12) * 1_000_000)
    limit = config.packet_limit
    read = {c: f"__read{i}" for i, c in enumerate(plugin.columns)} if plugin else {}
    result = T._parse_datatype_string(plugin.result) if plugin else T.StructType()
    order = ["t", "seq", "size", "dir"]
    named = [f"__key{i}" for i in range(len(keys))]
    kinds = [packets.schema[k].dataType for k in keys]
    # keys travel as text, which is exact beside absent ones too
    staged = packets.withWatermark("ts", delay).select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("__bucket"), *[F.col(k).cast("string").alias(n) for k, n in zip(keys, named)],
        "ts", F.unix_micros("ts").alias("t"), F.col("seq").cast("long").alias("seq"), size.cast("long").alias("size"),
        direction.cast("int").alias("dir"), *[F.col(c).cast("double").alias(n) for c, n in read.items()])
    out = T.StructType([T.StructField(n, T.StringType()) for n in named] + [
        T.StructField("start_us", T.LongType()), T.StructField("end_us", T.LongType()),
        T.StructField("packets", T.LongType()), T.StructField("bytes", T.LongType()),
        T.StructField("ps", T.ArrayType(T.DoubleType())), T.StructField("ipt", T.ArrayType(T.DoubleType())),
    ] + list(result.fields) + list(extra.fields))
    names = [f.name for f in out.fields]
    read_names = list(read.values())

    def advance(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, old, old_read = pickle.loads(state.get[0]) if state.exists else ({}, None, None)
        index = {key: i for i, key in enumerate(opened)}
        whole, floats = ([old], [old_read]) if old is not None else ([], [])
        for b in batches:
            code = [index.setdefault(key, len(index)) for key in zip(*[b[n] for n in named])]
            whole.append(np.array([np.array(code, dtype="int64"), *[_whole(b[c]) for c in order]]))
            floats.append(np.array([b[n].to_numpy(dtype="float64") for n in read_names]).reshape(len(read_names), len(b)))
        rows = np.concatenate(whole, axis=1) if whole else np.empty((1 + len(order), 0), dtype="int64")
        values = np.concatenate(floats, axis=1) if floats else np.empty((len(read_names), 0))
        watermark = state.getCurrentWatermarkMs() * 1000
        waits = rows[1] > watermark
        waiting, waiting_read = rows[:, waits], values[:, waits]
        rows, values = rows[:, ~waits], values[:, ~waits]
        along = np.lexsort((rows[2], rows[1], rows[0]))
        code, t, seq, sizes, dirs = rows[:, along]
        seen = {"t": t, "seq": seq, **dict(zip(read, values[:, along]))}
        places = np.searchsorted(code, np.arange(len(index) + 1)).tolist()
        done, kept = [], {}
        for key, start, stop in zip(index, places[:-1], places[1:]):
            flow_part, held = opened.get(key, (None, None))
            flow = _OpenFlow(limit, flow_part)

            def close() -> None:
                if flow.start is not None:
                    row = flow.row() | (dict(zip(result.names, plugin.finish(held))) if plugin else {})
                    done.append((on_flow(row) if on_flow else row) | dict(zip(named, key)))

            if stop > start:
                bounds = [start + i for i in _starts(t[start:stop], flow.start, flow.last, idle, active)]
                edges = ([start] if not bounds or bounds[0] > start else []) + bounds + [stop]
                fresh = set(bounds)
                for a, b in zip(edges[:-1], edges[1:]):
                    if a in fresh:
                        close()
                        flow.begin(int(t[a]))
                        held = plugin.init() if plugin else None
                    flow.add(t[a:b], sizes[a:b], dirs[a:b])
                    if plugin:
                        held = plugin.update(held, {c: v[a:b] for c, v in seen.items()})
            if flow.start is not None and watermark - flow.last > idle:
                close()
                flow.start = None
            if flow.start is not None:
                kept[key] = (flow.start, flow.last, flow.packets, flow.bytes, flow.ps, flow.ipt), held
        if not kept and not waiting.shape[1]:
            state.remove()
        else:
            # keys of the state are numbered anew: those with an open flow, then those that only wait
            known = list(index)
            for i in np.unique(waiting[0]).tolist():
                kept.setdefault(known[i], (None, None))
            number = {key: i for i, key in enumerate(kept)}
            waiting[0] = [number[known[i]] for i in waiting[0].tolist()]
            state.update((pickle.dumps((kept, waiting, waiting_read)),))
            due = [int(waiting[1].min()) // 1000] if waiting.shape[1] else []
            due += [(part[1] + idle) // 1000 for part, _ in kept.values() if part is not None]
            state.setTimeoutTimestamp(max(min(due), state.getCurrentWatermarkMs() + 1))
        if done:
            yield pd.DataFrame(done)[names]

    flows = staged.groupBy("__bucket").applyInPandasWithState(advance, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return flows.select(*[F.col(n).cast(kind).alias(k) for k, n, kind in zip(keys, named, kinds)], *out.names[len(keys):])
