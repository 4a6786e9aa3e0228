"""Flow assembly, flow statistics and sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom import constants as K
from flowloom.functions import arrays as X, stats as S
from flowloom.functions.columns import epoch_us
from flowloom.operators import assemble as A, flowstats as G, packets as P, plugins as U
from flowloom.plans.running import running_totals
from flowloom.queries.inputs import (
    CONFIG, EVENT_PACKETS, event_packets, events_sql, line_flows, line_packets, lines_sql, table,
)
from flowloom.queries.registry import query

_KEY = "key_protocol, key_low, key_high, flow_no"


def _rounded(df, keep):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def _flow_table(flows):
    return flows.groupBy(*A.FLOW).agg(F.min("flow_start_us").alias("flow_start_us"), F.count("*").alias("packets"),
                                      F.sum("ip_size").alias("bytes"))


_FLOW_TABLE = f"""select {_KEY}, min(flow_start_us) as flow_start_us, count(*) as packets, sum(ip_size)::bigint as bytes
from flows group by {_KEY}"""


@query("flow_sessions_idle", events_sql(_FLOW_TABLE, active=None))
def flow_sessions_idle(spark, sf):
    return _flow_table(A.assign_flows(A.with_flow_key(event_packets(spark, sf)), A.KEY, A.FlowConfig(CONFIG.idle, None)))


@query("flow_sessions_active", events_sql(_FLOW_TABLE))
def flow_sessions_active(spark, sf):
    return _flow_table(A.assign_flows(A.with_flow_key(event_packets(spark, sf)), A.KEY, CONFIG))


@query("flow_sessions_active_only", events_sql(_FLOW_TABLE, idle=None))
def flow_sessions_active_only(spark, sf):
    config = A.FlowConfig(None, CONFIG.active)
    return _flow_table(A.assign_flows(A.with_flow_key(event_packets(spark, sf)), A.KEY, config))


@query("flow_sessions_active_chained", events_sql(_FLOW_TABLE, idle=None))
def flow_sessions_active_chained(spark, sf):
    """The same cuts by the join method that serves sessions of any size."""
    config = A.FlowConfig(None, CONFIG.active, fold_limit=0)
    return _flow_table(A.assign_flows(A.with_flow_key(event_packets(spark, sf)), A.KEY, config))


@query("flow_ids", events_sql(f"""
select {_KEY}, coalesce(name, 'UNKNOWN') as ip_proto,
  coalesce(name, 'UNKNOWN') || ' ' || client_ip || ':' || client_port || ' ' || server_ip || ':' || server_port as flow_id
from series left join (values (1,'ICMP'),(6,'TCP'),(17,'UDP')) n(number, name) on number = protocol
where pos = 0""", series=True))
def flow_ids(spark, sf):
    return A.flow_identifiers(A.flow_packets(event_packets(spark, sf), CONFIG)).select(*A.FLOW, "ip_proto", "flow_id")


@query("flow_packets", events_sql(f"select {_KEY}, pos, dir, ps, round(ipt, 3) as ipt, bulk, win, flag from series",
                                  series=True))
def flow_packets(spark, sf):
    return A.flow_packets(event_packets(spark, sf), CONFIG).select(
        *A.FLOW, "pos", "dir", "ps", F.round("ipt", 3).alias("ipt"), "bulk", "win", "flag"
    )


@query("flow_plugin", events_sql(f"""
select {_KEY}, pos, t, bulk, case when protocol = 6 and ip_version = 4 then tcp_window else 0 end::double as win,
  case when protocol = 6 and ip_version = 4 then tcp_flags else 0 end::double as flag from series""", series=True))
def flow_plugin(spark, sf):
    """Payload, window and flags of the first packets, gathered by a plug-in from all packets of the flows."""
    flows = A.assign_flows(A.with_flow_key(event_packets(spark, sf)), A.KEY, CONFIG)
    tcp4 = (F.col("protocol") == 6) & (F.col("ip_version") == 4)
    read = flows.withColumns({
        "bulk": F.col("payload_size"), "win": F.when(tcp4, F.col("tcp_window")).otherwise(0), "flag": F.when(tcp4, F.col("tcp_flags")).otherwise(0)})
    got = U.apply_plugin(read, A.FLOW, U.FirstPackets(["bulk", "win", "flag"], CONFIG.packet_limit))
    return got.select(*A.FLOW, F.posexplode(F.arrays_zip("t", "bulk", "win", "flag")).alias("pos", "p")).select(*A.FLOW, "pos", "p.*")


def _stats_sql(keys: str, source: str, tcp: bool = True, bases=(("bulk", "bulk"), ("packet", "abs(ps)"))) -> str:
    cols = []
    for prefix, side in (("client_", 0), ("server_", 1)):
        empty = f"case when count(*) filter (d = {side}) = 0 then 0 else"
        for base, value in bases:
            v = f"(case when d = {side} then {value} end)"
            for name, sql in (
                ("0", f"max(case when d = {side} and r = 0 then {value} end)"),
                ("1", f"max(case when d = {side} and r = 1 then {value} end)"),
                ("_max", f"max({v})"), ("_min", f"min({v})"), ("_avg", f"avg({v})"),
                ("_median", f"quantile_cont({v}, 0.5)"), ("_25q", f"quantile_cont({v}, 0.25)"),
                ("_75q", f"quantile_cont({v}, 0.75)"), ("_sum", f"sum({v})"),
                ("_number", f"count(*) filter (d = {side} and {value} > 0)"),
            ):
                cols.append(f"round(({empty} {sql} end)::double, 6) as {prefix}{base}{name}")
        if tcp:
            cols.append(f"round(({empty} avg(case when d = {side} then win end) end)::double, 6) as {prefix}tcp_window_avg")
            cols.append(f"coalesce(array_to_string(list_sort(list(distinct flag) filter (d = {side})), ','), '') "
                        f"as {prefix}found_tcp_flags")
    return f"""select {keys}, {', '.join(cols)}
from (select *, row_number() over (partition by {keys}, d order by pos) - 1 as r from {source}) x group by {keys}"""


def _flags_as_text(df):
    """Arrays are compared as text."""
    for side in ("client_", "server_"):
        name = f"{side}found_tcp_flags"
        df = df.withColumn(name, F.concat_ws(",", F.col(name).cast("array<string>")))
    return df


@query("flow_features", events_sql(_stats_sql(_KEY, "(select *, dir as d from series)"), series=True))
def flow_features(spark, sf):
    """Captures to flow statistics: the flagship query."""
    series, rows = A.flow_packets(event_packets(spark, sf), CONFIG), table(spark, sf, "events").count()
    return _rounded(_flags_as_text(G.flow_stats(series, A.FLOW, rows=rows)), A.FLOW)


@query("flow_stats", lines_sql(_stats_sql("flow_id", "(select *, dir as d from pl)")))
def flow_stats(spark, sf):
    rows = table(spark, sf, "lineitem").count()
    return _rounded(_flags_as_text(G.flow_stats(line_packets(spark, sf), ["flow_id"], rows=rows)), ["flow_id"])


@query("flow_stats_from_raw", lines_sql(
    "select flow_id, " + ", ".join(
        f"coalesce({side}_{base}{name}, 0) as {side}_{base}{name}" for side in ("client", "server")
        for base in ("packet", "iat") for name in S.FEATURES
    ) + " from (" + _stats_sql(
        "flow_id", "(select *, case when ps > 0 then 1 when ps < 0 then 0 end as d from pl)", tcp=False,
        bases=(("packet", "abs(ps)"), ("iat", "ipt"))) + ") y"))
def flow_stats_from_raw(spark, sf):
    flows = line_flows(spark, sf)
    out = G.stats_from_sequences(flows, ["flow_id"], with_iat=True, positive_is_client=False)
    return _rounded(out.drop("packets"), ["flow_id"])


@query("flow_first_n", lines_sql("select flow_id, pos, dir, ps, ipt from pl", n=5))
def flow_first_n(spark, sf):
    return line_packets(spark, sf, 5).select("flow_id", "pos", "dir", "ps", "ipt")


@query("flow_length_ecdf", """
with n as (select count(*) as n_packets from lineitem group by l_orderkey),
c as (select n_packets, count(*) as flows from n group by 1),
s as (select coalesce(sum(flows) filter (n_packets = 1), 0) as single, sum(flows) as total from c)
select n_packets, flows, round(sum(flows) over o / total, 6)::double as ecdf,
  round((sum(flows) over o - single) / nullif(total - single, 0), 6)::double as ecdf_multi
from c, s window o as (order by n_packets rows unbounded preceding)""")
def flow_length_ecdf(spark, sf):
    sizes = A.flow_sizes(table(spark, sf, "lineitem"), ["l_orderkey"], epoch_us(F.col("l_shipdate")), F.col("l_quantity"))
    return G.length_ecdf(sizes, "bidirectional_packets").select(
        "n_packets", "flows", F.round("ecdf", 6).alias("ecdf"), F.round("ecdf_multi", 6).alias("ecdf_multi")
    )


@query("flow_sizes", events_sql(f"""
select {_KEY}, count(*) as bidirectional_packets, sum(ip_size)::bigint as bidirectional_bytes,
  round((max(t) - min(t)) / 1000.0, 3)::double as bidirectional_duration_ms from flows group by {_KEY}"""))
def flow_sizes(spark, sf):
    flows = A.assign_flows(A.with_flow_key(event_packets(spark, sf)), A.KEY, CONFIG)
    return A.flow_sizes(flows, A.FLOW, epoch_us(F.col("ts")), F.col("ip_size")).withColumn(
        "bidirectional_duration_ms", F.round("bidirectional_duration_ms", 3)
    )


@query("raw_wide", lines_sql("select flow_id, " + ", ".join(
    f"max(case when pos = {i} then ps end) as raw_packet{i}, max(case when pos = {i} then ipt end) as raw_iat{i}"
    for i in range(K.PACKET_LIMIT)) + " from pl group by flow_id"))
def raw_wide(spark, sf):
    return line_flows(spark, sf).select("flow_id", *X.to_wide(F.col("packets"), K.PACKET_LIMIT))


@query("raw_long", lines_sql("select flow_id, pos, ps, ipt from pl"))
def raw_long(spark, sf):
    """Wide columns back to packets."""
    wide = line_flows(spark, sf).select("flow_id", *X.to_wide(F.col("packets"), K.PACKET_LIMIT))
    return X.unnest(wide.select("flow_id", X.from_wide(K.PACKET_LIMIT).alias("p")), "p").select(
        "flow_id", "pos", "p.ps", "p.ipt"
    )


_IAT = """
clocked as (select *, sum(ipt) over (partition by flow_id order by pos rows unbounded preceding) as clock from pl),
iats as (select flow_id, pos, ps,
  coalesce(clock - lag(clock) over (partition by flow_id, dir order by pos), 0)::double as iat from clocked)"""


@query("ipt_to_iat", lines_sql("select flow_id, pos, ps, iat from iats", more=_IAT))
def ipt_to_iat(spark, sf):
    flows = line_flows(spark, sf)
    return X.unnest(flows.select("flow_id", X.ipt_to_iat(F.col("packets")).alias("p")), "p").select(
        "flow_id", "pos", "p.ps", "p.iat"
    )


@query("multi_packet_flows", lines_sql(
    "select flow_id, count(*)::integer as n_packets from pl group by flow_id having count(*) >= 2"))
def multi_packet_flows(spark, sf):
    return G.packets_per_flow(P.multi_packet_flows(line_flows(spark, sf))).select("flow_id", "n_packets")


def _keep_sql(condition: str) -> str:
    return "with " + EVENT_PACKETS.strip() + f"\nselect seq, src_ip, dst_ip, protocol from packets where {condition}"


_UNICAST = """protocol not in (1, 58) and dst_ip not like '224.%' and src_ip not like '127.%' and dst_ip not like '127.%'"""


def _view(df):
    return df.select("seq", "src_ip", "dst_ip", F.col("protocol").cast("int").alias("protocol"))


@query("packets_without_icmp", _keep_sql("protocol <> 1"))
def packets_without_icmp(spark, sf):
    return _view(P.without_icmp(event_packets(spark, sf)))


@query("packet_filters", _keep_sql(_UNICAST))
def packet_filters(spark, sf):
    return _view(P.unicast_traffic(event_packets(spark, sf)))


@query("packets_without_lan", _keep_sql(
    _UNICAST + " and not (src_ip like '192.168.1.%' and dst_ip like '192.168.1.%')"))
def packets_without_lan(spark, sf):
    return _view(P.without_local_traffic(event_packets(spark, sf), "192.168.1.0/24"))


@query("device_split", "with " + EVENT_PACKETS.strip() + f"""
select seq, n_name as device_name, 'region_' || n_regionkey as device_category
from packets join nation on src_mac = '02:00:00:00:00:' || lpad(n_nationkey::varchar, 2, '0')
  or dst_mac = '02:00:00:00:00:' || lpad(n_nationkey::varchar, 2, '0')
where {_UNICAST} and not (src_ip like '192.168.1.%' and dst_ip like '192.168.1.%')""")
def device_split(spark, sf):
    devices = table(spark, sf, "nation").select(
        F.concat(F.lit("02:00:00:00:00:"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("mac"),
        F.col("n_name").alias("device_name"),
        F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("device_category"),
    )
    return P.split_by_devices(event_packets(spark, sf), devices).select("seq", "device_name", "device_category")


@query("packets_merged", "with " + EVENT_PACKETS.strip() + """
select src_mac, seq, rn::integer as rn from (
  select src_mac, seq, row_number() over (partition by src_mac order by t, seq) as rn from packets) x""")
def packets_merged(spark, sf):
    packets = event_packets(spark, sf)
    server = packets.filter(F.col("source_file").isin("capture_purchase", "capture_error"))
    client = packets.filter(~F.col("source_file").isin("capture_purchase", "capture_error"))
    merged = P.merge_captures(server, client)
    hourly = merged.select("src_mac", "ts", "seq", F.floor(epoch_us(F.col("ts")) / 3_600_000_000).alias("hour"))
    ranked = running_totals(hourly, ["src_mac"], "hour", ["ts", "seq"], {"packets": F.lit(1)})
    return ranked.select("src_mac", "seq", (F.col("before_packets") + 1).cast("int").alias("rn"))
