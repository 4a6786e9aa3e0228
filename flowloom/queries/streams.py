"""Streaming queries: each reads the events table as a stream and processes what is available."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from flowloom.operators import assemble as A, plugins as U, quantize as Q
from flowloom.queries.inputs import CONFIG, as_packets, events_sql, flows_sql, EVENT_PACKETS, table
from flowloom.queries.registry import query
from flowloom.streaming import flows as S

DELAY = "1 hour"


def _events(spark, sf):
    return S.read_stream(spark, sf, table(spark, sf, "events").schema, "events.parquet")


def _packets(spark, sf):
    return A.with_flow_key(as_packets(_events(spark, sf)))


LAST = {"event_id": -1, "ts": "2200-01-01 00:00:00", "user_id": 1, "event_type": "end", "value": 1.0, "props": '{"k": 0}'}


def _to_end(spark, sf, transform, name):
    packets = lambda events: transform(A.with_flow_key(as_packets(events)))
    return S.run_to_end(spark, sf, table(spark, sf, "events").schema, packets, LAST, name, "events.parquet")


_KEY = "key_protocol, key_low, key_high"


@query("stream_sessions", "with recursive " + EVENT_PACKETS.strip() + "," + flows_sql(CONFIG.idle, None) + f"""
select {_KEY}, min(t) as first_us, max(t) as last_us, count(*) as packets, sum(ip_size)::bigint as bytes
from flows group by {_KEY}, flow_no""")
def stream_sessions(spark, sf):
    sessions = lambda packets: S.stream_sessions(packets, A.KEY, F.col("ip_size"), CONFIG.idle, DELAY)
    return _to_end(spark, sf, sessions, "sessions").select(
        *A.KEY, F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "packets", "bytes")


@query("stream_flows", events_sql(f"""
select {_KEY}, min(t) as start_us, max(t) as end_us, count(*) as packets, sum(ip_size)::bigint as bytes,
  array_to_string(list((case when src_port = 443 then -ip_size else ip_size end) order by t, seq)[1:3], ',') as first_sizes
from flows group by {_KEY}, flow_no"""))
def stream_flows(spark, sf):
    flows = lambda packets: S.stream_flows(packets, A.KEY, F.col("ip_size"), (F.col("src_port") == 443).cast("int"), CONFIG, DELAY)
    sizes = F.transform(F.slice("ps", 1, 3), lambda x: x.cast("int").cast("string"))
    return _to_end(spark, sf, flows, "flows").select(
        *A.KEY, "start_us", "end_us", "packets", "bytes", F.concat_ws(",", sizes).alias("first_sizes"))


@query("stream_plugin", events_sql(f"""
select {_KEY}, flow_start_us as start_us, pos, payload_size::double as bulk, tcp_window::double as win, tcp_flags::double as flag from series""", series=True))
def stream_plugin(spark, sf):
    """Payload, window and flags of the first packets of flows on a stream, gathered by the plug-in that `flow_plugin` uses."""
    plugin = U.FirstPackets(["payload_size", "tcp_window", "tcp_flags"], CONFIG.packet_limit)
    flows = lambda packets: S.stream_flows(packets, A.KEY, F.col("ip_size"), F.lit(0), CONFIG, DELAY, plugin=plugin)
    each = F.posexplode(F.arrays_zip("payload_size", "tcp_window", "tcp_flags")).alias("pos", "p")
    return _to_end(spark, sf, flows, "plugin").select(*A.KEY, "start_us", each).select(
        *A.KEY, "start_us", "pos", F.col("p.payload_size").alias("bulk"), F.col("p.tcp_window").alias("win"), F.col("p.tcp_flags").alias("flag"))


@query("stream_throughput", "with " + EVENT_PACKETS.strip() + f"""
select protocol as key_protocol, (t // 1000000) * 1000000 as start_us, sum(ip_size)::bigint as bytes from packets
group by 1, 2""")
def stream_throughput(spark, sf):
    rates = lambda packets: S.stream_throughput(packets, ["key_protocol"], F.col("ip_size"), "1 second", DELAY)
    return _to_end(spark, sf, rates, "rates").select("key_protocol", F.unix_micros("start_ts").alias("start_us"), "bytes")


@query("stream_score", "with " + EVENT_PACKETS.strip() + """,
book as (select (row_number() over (order by x) - 1)::integer as id, x::double as x from (values (0.1),(0.3),(0.6),(0.9)) b(x))
select seq, arg_min(id, {d: (ip_size / 1500.0 - x) ** 2, i: id}) as cluster_id from packets, book group by seq""")
def stream_score(spark, sf):
    book = Q.Codebook(spark, np.array([[x, 0.0] for x in (0.1, 0.3, 0.6, 0.9)]))
    stream = as_packets(_events(spark, sf))
    scored = S.stream_scored(stream, "cluster_id", book.encode(F.col("ip_size").cast("double"), F.lit(0.0)))
    return S.run_available(scored.select("seq", "cluster_id"), "scored")


@query("stream_dedup", "with " + EVENT_PACKETS.strip() + """
select distinct protocol as key_protocol, least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) as key_low,
  greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) as key_high from packets""")
def stream_dedup(spark, sf):
    return S.run_available(S.stream_deduplicated(_packets(spark, sf), A.KEY, DELAY), "unique").select(*A.KEY)
