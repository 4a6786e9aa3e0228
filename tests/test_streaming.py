"""Streams give what the batch operators give."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import assemble as A, plugins as U
from flowloom.schema import PACKETS
from flowloom.streaming import flows as S
from tests.test_assembly import frame, packet


def traffic(seed=4):
    rng = random.Random(seed)
    rows, seq = [], 0
    for host in range(5):
        at = rng.randrange(1000)
        for _ in range(120):
            at += rng.choice([0, 5, 800, 20_000, 59_000, 60_000, 60_001, 95_000])
            seq += 1
            there, back = ("10.0.0.1", 1000 + host), ("10.0.0.2", 80)
            src, dst = (there, back) if rng.random() < 0.6 else (back, there)
            rows.append(packet(at, src, dst, seq=seq, size=rng.randrange(40, 1500)))
    return rows


@pytest.mark.parametrize("active", [70, 10**6])
@pytest.mark.parametrize("parts", [1, 6])
def test_stream_equals_batch(spark, tmp_path, active, parts):
    rows = sorted(traffic(), key=lambda r: (r["ts"], r["seq"]))
    late = max(r["ts"] for r in rows) + dt.timedelta(days=1)
    size = -(-len(rows) // parts)
    folder = str(tmp_path / "in")
    for i in range(parts):
        part = rows[i * size:(i + 1) * size]
        random.Random(i).shuffle(part)
        frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
    sentinel = [packet(0, ("10.9.9.9", 1), ("10.9.9.8", 2), ts=late, seq=10**6)]
    frame(spark, sentinel).coalesce(1).write.mode("append").parquet(folder)
    config = A.FlowConfig(60, active, packet_limit=4)
    direction = (F.col("src_port") == 80).cast("int")
    stream = A.with_flow_key(S.read_stream(spark, folder, PACKETS, max_files=2))
    # files may be read in any order, so the delay covers the whole capture
    out = S.stream_flows(stream, A.KEY, F.col("ip_size"), direction, config, "12 hours")
    got = sorted((r["key_low"], r["start_us"], r["end_us"], r["packets"], r["bytes"], tuple(r["ps"]), tuple(r["ipt"]))
                 for r in S.run_available(out, "flows").collect())
    flows = A.assign_flows(A.with_flow_key(frame(spark, rows)), A.KEY, config)
    first = A.first_packets(flows, A.FLOW, ["ts", "seq"], 4).withColumn("dir", direction)
    series = A.packet_series(first, A.FLOW, F.unix_micros("ts") / 1000.0, "ip_size", "payload_size", F.lit(0), F.lit(0))
    arrays = A.packet_arrays(series, A.FLOW)
    totals = flows.groupBy(*A.FLOW).agg(F.min(F.unix_micros("ts")).alias("s"), F.max(F.unix_micros("ts")).alias("e"),
                                       F.count("*").alias("n"), F.sum("ip_size").alias("b"))
    expected = sorted((r["key_low"], r["s"], r["e"], r["n"], r["b"], tuple(p["ps"] for p in r["packets"]),
                       tuple(p["ipt"] for p in r["packets"])) for r in totals.join(arrays, A.FLOW).collect())
    assert got == expected


def test_flow_hook_adds_columns(spark, tmp_path):
    from pyspark.sql import types as T

    rows = [packet(0), packet(10), packet(86_400_000, src=("10.5.5.5", 7))]
    frame(spark, rows).write.parquet(str(tmp_path / "in"))
    stream = A.with_flow_key(S.read_stream(spark, str(tmp_path / "in"), PACKETS))
    out = S.stream_flows(stream, A.KEY, F.col("ip_size"), F.lit(0), A.FlowConfig(60, 60), "1 second",
                         on_flow=lambda r: {**r, "mean_size": r["bytes"] / r["packets"]},
                         extra=T.StructType([T.StructField("mean_size", T.DoubleType())]))
    assert [r["mean_size"] for r in S.run_available(out, "hook").collect()] == [100.0]


def test_plugin_on_a_stream_equals_batch(spark, tmp_path):
    rows = traffic(5)
    late = packet(0, ("10.9.9.9", 1), ("10.9.9.8", 2), ts=max(r["ts"] for r in rows) + dt.timedelta(days=1), seq=10**6)
    random.Random(1).shuffle(rows)
    folder = str(tmp_path / "in")
    for part in (rows[0::3], rows[1::3], rows[2::3], [late]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
    config, plugin = A.FlowConfig(60, 70, packet_limit=4), U.FirstPackets(["ip_size", "ip_version"], 5)
    stream = A.with_flow_key(S.read_stream(spark, folder, PACKETS, max_files=1))
    out = S.stream_flows(stream, A.KEY, F.col("ip_size"), F.lit(0), config, "12 hours", plugin=plugin)
    pick = lambda rows: sorted((r["key_low"], r["t"], r["ip_size"], r["ip_version"]) for r in rows)
    flows = A.assign_flows(A.with_flow_key(frame(spark, rows)), A.KEY, config)
    assert pick(S.run_available(out, "plugin").collect()) == pick(U.apply_plugin(flows, A.FLOW, plugin).collect())


def test_keys_share_buckets(spark, tmp_path):
    """Many keys, absent ones too, in few buckets over several batches: each flow stays with its key, and a bucket costs one call."""
    rng = random.Random(7)
    rows, seq = [], 0
    for host in range(40):
        at = 0
        for _ in range(12):
            at += rng.choice([5, 800, 59_000, 60_001])
            seq += 1
            rows.append(packet(at, ("10.0.0.1", 1000 + host), ("10.0.0.2", 80), seq=seq, size=rng.randrange(40, 1500)))
    random.Random(2).shuffle(rows)
    late = packet(0, ("10.9.9.9", 1), ("10.9.9.8", 2), ts=max(r["ts"] for r in rows) + dt.timedelta(days=1), seq=10**6)
    folder = str(tmp_path / "in")
    for part in (rows[0::2], rows[1::2], [late]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
    config, plugin = A.FlowConfig(60, 70, packet_limit=4), U.FirstPackets(["ip_size"], 5)
    absent = F.when(~F.col("key_low").endswith(":1003"), F.col("key_low"))
    pick = lambda rows: sorted((str(r["key_low"]), r["t"], r["ip_size"]) for r in rows)
    flows = A.assign_flows(A.with_flow_key(frame(spark, rows)), A.KEY, config).withColumn("key_low", absent)
    expected = pick(U.apply_plugin(flows, A.FLOW, plugin).collect())
    for buckets in (1, 3):
        stream = A.with_flow_key(S.read_stream(spark, folder, PACKETS, max_files=1)).withColumn("key_low", absent)
        out = S.stream_flows(stream, A.KEY, F.col("ip_size"), F.lit(0), config, "12 hours", plugin=plugin, buckets=buckets)
        assert out.schema["key_protocol"].dataType == stream.schema["key_protocol"].dataType
        assert pick(S.run_available(out, "plugin").collect()) == expected
