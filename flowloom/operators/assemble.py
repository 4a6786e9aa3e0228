"""Packets to flows: bidirectional key, idle and active timeouts, first N packets.

A conversation key may carry a large share of all packets, so no step sorts or collects the packets of a
key in one task. Time is cut into steps no longer than either timeout. Such a step can hold no idle
gap and at most one active cut, so a summary with one row per (key, step) decides every flow boundary:
the packets are only aggregated into that summary (map-side combine) and joined back on (key, step).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom import constants as K
from flowloom.functions.columns import epoch_us, flow_id_text, with_protocol_name
from flowloom.plans.storage import write_and_read

KEY = ["key_protocol", "key_low", "key_high"]
FLOW = [*KEY, "flow_no"]


@dataclass(frozen=True)
class FlowConfig:
    """Timeouts in seconds (None switches one off), packets kept per flow.

    Sessions with at most `fold_limit` packets find their active cuts in one array; larger ones by joins.
    """

    idle: float | None = K.IDLE_TIMEOUT_S
    active: float | None = K.ACTIVE_TIMEOUT_OFFLINE_S
    packet_limit: int = K.PACKET_LIMIT
    fold_limit: int = 16384

    @classmethod
    def for_mode(cls, online: bool, **kwargs) -> "FlowConfig":
        return cls(active=K.ACTIVE_TIMEOUT_ONLINE_S if online else K.ACTIVE_TIMEOUT_OFFLINE_S, **kwargs)

    @property
    def step_us(self) -> int:
        limits = [int(t * 1_000_000) for t in (self.idle, self.active) if t is not None]
        if not limits or min(limits) <= 0:
            raise ValueError("at least one positive timeout is needed")
        return min(limits)


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Both directions of a 5-tuple get the same key columns."""
    src = F.concat_ws(":", "src_ip", F.col("src_port").cast("string"))
    dst = F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string"))
    return packets.select(
        "*",
        F.col("protocol").cast("int").alias(KEY[0]),
        F.least(src, dst).alias(KEY[1]),
        F.greatest(src, dst).alias(KEY[2]),
    )


def _step(t: Column, config: FlowConfig) -> Column:
    return F.floor(t / F.lit(config.step_us)).cast("long")


def _summary(packets: DataFrame, keys: list[str], config: FlowConfig) -> DataFrame:
    """One row per (key, time step) with the idle session it belongs to."""
    steps = packets.groupBy(*keys, _step(F.col("__t"), config).alias("__step")).agg(
        F.min("__t").alias("lo"), F.max("__t").alias("hi"), F.count("*").alias("n")
    )
    along = Window.partitionBy(*keys).orderBy("__step")
    previous = F.lag("hi").over(along)
    fresh = previous.isNull()
    if config.idle is not None:
        fresh = fresh | (F.col("lo") - previous > int(config.idle * 1_000_000))
    return steps.withColumn("fresh", fresh).withColumn(
        "session", F.max(F.when(F.col("fresh"), F.col("lo"))).over(along.rowsBetween(Window.unboundedPreceding, 0))
    )


def _fold_cuts(times: DataFrame, sid: list[str], active_us: int) -> DataFrame:
    """Active cuts of sessions whose times fit one bounded array."""
    acc = F.struct(F.col("times")[0].alias("start"), F.array().cast("array<bigint>").alias("cuts"))

    def step(a: Column, t: Column) -> Column:
        return F.when(
            t - a["start"] > active_us, F.struct(t.alias("start"), F.concat(a["cuts"], F.array(t)).alias("cuts"))
        ).otherwise(a)

    arrays = times.groupBy(*sid).agg(F.array_sort(F.collect_set("__t")).alias("times"))
    return arrays.select(*sid, F.explode(F.aggregate("times", acc, step, lambda a: a["cuts"])).alias("cut"))


def _next_start(points: DataFrame, summary: DataFrame, sid: list[str], config: FlowConfig, active_us: int) -> DataFrame:
    """For every point of time the first later point that is more than the active timeout away."""
    probes = points.select(*sid, (F.col("t") + active_us).alias("x"), F.lit(0).alias("is_point"), "t")
    targets = points.select(*sid, F.col("t").alias("x"), F.lit(1).alias("is_point"), "t")
    both = probes.unionByName(targets).withColumn("__step", _step(F.col("x"), config))
    back = Window.partitionBy(*sid, "__step").orderBy(F.desc("x"), "is_point").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("same_step", F.min(F.when(F.col("is_point") == 1, F.col("t"))).over(back)).filter(
        "is_point = 0"
    )
    steps = found.select(*sid, "__step").distinct().withColumn("lo", F.lit(None).cast("long")).unionByName(
        summary.select(*sid, "__step", "lo")
    ).groupBy(*sid, "__step").agg(F.min("lo").alias("lo"))
    later = Window.partitionBy(*sid).orderBy(F.desc("__step")).rowsBetween(Window.unboundedPreceding, -1)
    later_lo = steps.select(*sid, "__step", F.min("lo").over(later).alias("next_lo"))
    return found.join(later_lo, [*sid, "__step"], "left").select(
        *sid, "t", F.coalesce("same_step", "next_lo").alias("exit")
    )


def _chain_cuts(times: DataFrame, summary: DataFrame, sid: list[str], config: FlowConfig, active_us: int) -> DataFrame:
    """Active cuts of sessions of any size, by joins only.

    Cut the session into blocks as long as the active timeout. A flow start determines the next start, which
    lies in a later block; doubling the block length again and again gives, for the few points that can be the
    first start in a block, the first start beyond it. Walking back down marks the starts that are reached.
    """
    points = write_and_read(times.select(*sid, F.col("__t").alias("t")).distinct(), "times")
    session = F.col(sid[-1])

    def block(t: Column, level: int) -> Column:
        return F.shiftright(F.floor((t - session) / F.lit(active_us)).cast("long"), level)

    top = points.agg(F.max(block(F.col("t"), 0))).first()[0] or 0
    depth = int(top).bit_length()
    firsts = points.groupBy(*sid, block(F.col("t"), 0).alias("b")).agg(F.min("t").alias("t")).select(*sid, "t")
    exits = _next_start(points, summary, sid, config, active_us)
    levels = [write_and_read(exits, "level")]
    for level in range(1, depth):
        below = levels[-1]
        heads = below.filter(F.pmod(block(F.col("t"), 0), F.lit(1 << level)) == 0)
        heads = heads.unionByName(
            below.filter(F.pmod(block(F.col("t"), 0), F.lit(1 << level)) != 0).join(firsts, [*sid, "t"], "left_semi")
        )
        hop = below.select(*sid, F.col("t").alias("exit"), F.col("exit").alias("hop"))
        inside = block(F.col("exit"), level) == block(F.col("t"), level)
        levels.append(write_and_read(
            heads.join(hop, [*sid, "exit"], "left").select(
                *sid, "t", F.when(inside, F.col("hop")).otherwise(F.col("exit")).alias("exit")
            ), "level"
        ))
    starts = points.select(*sid).distinct().withColumn("t", F.col(sid[-1]))
    for level in reversed(range(depth)):
        reached = starts.join(levels[level], [*sid, "t"], "inner").filter(
            F.col("exit").isNotNull() & (block(F.col("exit"), level + 1) == block(F.col("t"), level + 1))
        ).select(*sid, F.col("exit").alias("t"))
        starts = write_and_read(starts.unionByName(reached), "starts")
    return starts.filter(F.col("t") != F.col(sid[-1])).select(*sid, F.col("t").alias("cut"))


def _active_cuts(packets: DataFrame, summary: DataFrame, keys: list[str], config: FlowConfig) -> DataFrame | None:
    """(key, cut) of all flows started by the active timeout; None when no session is that long."""
    active_us = int(config.active * 1_000_000)
    sid = [*keys, "session"]
    long = summary.groupBy(*sid).agg((F.max("hi") - F.min("lo")).alias("span"), F.sum("n").alias("size")).filter(
        F.col("span") > active_us
    )
    sizes = long.agg(F.count("*").alias("sessions"), F.count_if(F.col("size") > config.fold_limit).alias("large")).first()
    if sizes["sessions"] == 0:
        return None
    steps = summary.join(long, sid, "inner").select(*sid, "__step", "lo", "size")
    times = packets.select(*keys, "__t", _step(F.col("__t"), config).alias("__step")).join(
        steps.select(*sid, "__step", "size"), [*keys, "__step"], "inner"
    )
    cuts = None
    if sizes["sessions"] > sizes["large"]:
        cuts = _fold_cuts(times.filter(F.col("size") <= config.fold_limit), sid, active_us)
    if sizes["large"]:
        chained = _chain_cuts(
            times.filter(F.col("size") > config.fold_limit), steps.filter(F.col("size") > config.fold_limit),
            sid, config, active_us,
        )
        cuts = chained if cuts is None else cuts.unionByName(chained)
    return cuts.select(*keys, "cut")


def assign_flows(packets: DataFrame, keys: Sequence[str], config: FlowConfig = FlowConfig(), ts: str = "ts") -> DataFrame:
    """Add `flow_no` (1, 2, ... per key in time order) and `flow_start_us`."""
    keys = list(keys)
    timed = packets.withColumn("__t", epoch_us(F.col(ts)))
    summary = _summary(timed, keys, config)
    cuts = None
    if config.active is not None:
        summary = write_and_read(summary, "steps")
        cuts = _active_cuts(timed, summary, keys, config)
    if cuts is None:
        steps = summary.withColumn("cut", F.lit(None).cast("long"))
    else:
        cut_steps = cuts.withColumn("__step", _step(F.col("cut"), config))
        steps = summary.join(cut_steps, [*keys, "__step"], "left")
    along = Window.partitionBy(*keys).orderBy("__step")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("fresh"), F.col("lo"))
    bounds = steps.select(
        *keys, "__step", "cut",
        F.coalesce(opened, F.max(F.coalesce(F.col("cut"), opened)).over(before)).alias("base"),
        (F.count_if(F.col("fresh")).over(upto) + F.count("cut").over(before)).alias("base_no"),
    )
    crossed = F.col("cut").isNotNull() & (F.col("__t") >= F.col("cut"))
    return timed.withColumn("__step", _step(F.col("__t"), config)).join(bounds, [*keys, "__step"], "inner").select(
        *packets.columns,
        (F.col("base_no") + crossed.cast("long")).alias("flow_no"),
        F.when(crossed, F.col("cut")).otherwise(F.col("base")).alias("flow_start_us"),
    )


def first_packets(packets: DataFrame, flow: Sequence[str], order: Sequence[str], n: int = K.PACKET_LIMIT) -> DataFrame:
    """The first n packets of every flow with their 0-based `pos`.

    The limit on the rank is applied before the shuffle as well, so a huge flow sends at most n rows per input task.
    """
    along = Window.partitionBy(*flow).orderBy(*order)
    return packets.withColumn("__rn", F.row_number().over(along)).filter(F.col("__rn") <= n).withColumn(
        "pos", (F.col("__rn") - 1).cast("int")
    ).drop("__rn")


def with_direction(packets: DataFrame, flow: Sequence[str], order: Sequence[str] = ("pos",)) -> DataFrame:
    """Add the client endpoint (sender of the first packet) and `dir`: 0 from the client, 1 from the server.

    Takes the bounded first packets of each flow; naming the order they were ranked by saves a sort.
    """
    along = Window.partitionBy(*flow).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.struct("src_ip", "src_port", "dst_ip", "dst_port")).over(along)
    return (
        packets.withColumn("__first", first)
        .withColumn(
            "dir",
            F.when((F.col("src_ip") == F.col("__first.src_ip")) & (F.col("src_port") == F.col("__first.src_port")), 0)
            .otherwise(1).cast("int"),
        )
        .select(
            *packets.columns, "dir",
            F.col("__first.src_ip").alias("client_ip"), F.col("__first.src_port").alias("client_port"),
            F.col("__first.dst_ip").alias("server_ip"), F.col("__first.dst_port").alias("server_port"),
        )
    )


def packet_series(packets: DataFrame, flow: Sequence[str], time_ms: Column, size: str, payload: str,
                  window: Column, flags: Column, order: Sequence[str] = ("pos",)) -> DataFrame:
    """Long packet form of the first N packets: signed size, gap to the previous packet, payload, window, flags."""
    along = Window.partitionBy(*flow).orderBy(*order)
    signed = F.when(F.col("dir") == 1, -F.col(size)).otherwise(F.col(size)).cast("double")
    return packets.withColumn("__ms", time_ms).select(
        *packets.columns,
        signed.alias("ps"),
        F.coalesce(F.col("__ms") - F.lag("__ms").over(along), F.lit(0.0)).cast("double").alias("ipt"),
        F.col(payload).cast("double").alias("bulk"),
        window.cast("double").alias("win"),
        flags.cast("int").alias("flag"),
    )


def flow_packets(packets: DataFrame, config: FlowConfig = FlowConfig()) -> DataFrame:
    """Capture packets to the long form of the first N packets of every flow."""
    keyed = with_flow_key(packets)
    flows = assign_flows(keyed, KEY, config)
    order = ["ts", "seq"]
    first = with_direction(first_packets(flows, FLOW, order, config.packet_limit), FLOW, order)
    tcp4 = (F.col("protocol") == 6) & (F.col("ip_version") == 4)
    return packet_series(
        first, FLOW, epoch_us(F.col("ts")) / 1000.0, "ip_size", "payload_size",
        F.when(tcp4, F.col("tcp_window")).otherwise(0), F.when(tcp4, F.col("tcp_flags")).otherwise(0), order,
    )


def flow_identifiers(first: DataFrame) -> DataFrame:
    """One row per flow with the protocol name and `flow_id` text, initiator first."""
    heads = first.filter(F.col("pos") == 0)
    named = with_protocol_name(heads)
    return named.withColumn("flow_id", flow_id_text("ip_proto", "client_ip", "client_port", "server_ip", "server_port"))


def flow_sizes(packets: DataFrame, flow: Sequence[str], time_us: Column, size: Column) -> DataFrame:
    """Packets, bytes and duration in ms of every whole flow."""
    return packets.withColumn("__t", time_us).groupBy(*flow).agg(
        F.count("*").alias("bidirectional_packets"),
        F.sum(size).alias("bidirectional_bytes"),
        ((F.max("__t") - F.min("__t")) / 1000.0).alias("bidirectional_duration_ms"),
    )


def packet_arrays(series: DataFrame, flow: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """One row per flow with `packets array<struct<ps,ipt>>` in order; the input holds at most N packets per flow."""
    item = F.struct("pos", "ps", "ipt")
    return series.groupBy(*flow, *extra).agg(F.array_sort(F.collect_list(item)).alias("__p")).select(
        *flow, *extra,
        F.transform("__p", lambda p: F.struct(p["ps"].alias("ps"), p["ipt"].alias("ipt"))).alias("packets"),
    )
