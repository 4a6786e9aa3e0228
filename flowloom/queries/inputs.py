"""The given tables read as packets, flows and labels, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.operators import assemble as A

CONFIG = A.FlowConfig(idle=21600, active=86400, packet_limit=20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_packets(events: DataFrame) -> DataFrame:
    """events rows as capture packets: a user talks to a server; purchases and errors are sent by the server."""
    u = F.col("user_id")
    text = lambda c: c.cast("string")
    client_ip = F.when(u % 5 == 0, F.concat(F.lit("192.168.1."), text(u % 250))).when(
        u % 7 == 0, F.concat(F.lit("127.0.0."), text(u % 250))
    ).otherwise(F.concat(F.lit("10.0."), text(F.floor(u / 256) % 256), F.lit("."), text(u % 256)))
    server_ip = F.when(u % 10 == 0, F.lit("192.168.1.254")).when(
        u % 11 == 0, F.concat(F.lit("224.0.0."), text(u % 250))
    ).otherwise(F.concat(F.lit("203.0.113."), text(u % 250)))
    mac = lambda c: F.concat(F.lit("02:00:00:00:00:"), F.lpad(text(c), 2, "0"))
    from_server = F.col("event_type").isin("purchase", "error")
    pick = lambda client, server: (F.when(from_server, server).otherwise(client), F.when(from_server, client).otherwise(server))
    src_mac, dst_mac = pick(mac(u % 40), mac((F.col("event_id") * 7) % 40))
    src_ip, dst_ip = pick(client_ip, server_ip)
    src_port, dst_port = pick((40000 + u % 20000).cast("int"), F.lit(443))
    size = F.floor(F.col("value") * 3).cast("int")
    return events.select(
        src_mac.alias("src_mac"), dst_mac.alias("dst_mac"), src_ip.alias("src_ip"), dst_ip.alias("dst_ip"),
        src_port.alias("src_port"), dst_port.alias("dst_port"),
        F.when(u % 4 == 0, 6).when(u % 4 == 1, 17).when(u % 4 == 2, 1).otherwise(200).cast("short").alias("protocol"),
        F.when(u % 3 == 0, 6).otherwise(4).cast("byte").alias("ip_version"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        (size + 40).alias("ip_size"), size.alias("payload_size"),
        (F.floor(F.col("value") * 100) % 65536).cast("int").alias("tcp_window"),
        (F.get_json_object("props", "$.k").cast("int") % 64).alias("tcp_flags"),
        F.concat(F.lit("capture_"), F.col("event_type")).alias("source_file"),
    )


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_packets(table(spark, sf_dir, "events"))


EVENT_PACKETS = """
ep_base as (
  select *, event_type in ('purchase','error') as from_server,
    case when user_id % 5 = 0 then '192.168.1.' || (user_id % 250)
         when user_id % 7 = 0 then '127.0.0.' || (user_id % 250)
         else '10.0.' || ((user_id // 256) % 256) || '.' || (user_id % 256) end as client_ip0,
    case when user_id % 10 = 0 then '192.168.1.254'
         when user_id % 11 = 0 then '224.0.0.' || (user_id % 250)
         else '203.0.113.' || (user_id % 250) end as server_ip0,
    '02:00:00:00:00:' || lpad((user_id % 40)::varchar, 2, '0') as client_mac0,
    '02:00:00:00:00:' || lpad(((event_id * 7) % 40)::varchar, 2, '0') as server_mac0,
    (40000 + user_id % 20000)::integer as client_port0
  from events),
packets as (
  select case when from_server then server_mac0 else client_mac0 end as src_mac,
    case when from_server then client_mac0 else server_mac0 end as dst_mac,
    case when from_server then server_ip0 else client_ip0 end as src_ip,
    case when from_server then client_ip0 else server_ip0 end as dst_ip,
    (case when from_server then 443 else client_port0 end)::integer as src_port,
    (case when from_server then client_port0 else 443 end)::integer as dst_port,
    (case user_id % 4 when 0 then 6 when 1 then 17 when 2 then 1 else 200 end)::integer as protocol,
    (case when user_id % 3 = 0 then 6 else 4 end)::integer as ip_version,
    ts, epoch_us(ts) as t, event_id as seq,
    (floor(value * 3) + 40)::integer as ip_size, floor(value * 3)::integer as payload_size,
    (floor(value * 100)::bigint % 65536)::integer as tcp_window,
    ((props::json ->> 'k')::integer % 64)::integer as tcp_flags,
    'capture_' || event_type as source_file
  from ep_base),
keyed as (
  select *, protocol as key_protocol,
    least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) as key_low,
    greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) as key_high
  from packets)
"""


def flows_sql(idle_s: int | None, active_s: int | None) -> str:
    """CTEs from `keyed` to `flows`: every packet with flow_no and flow_start_us."""
    fresh = "lag(t) over k is null" + (f" or t - lag(t) over k > {idle_s * 1000000}" if idle_s else "")
    cuts = "" if not active_s else f"""
  union all
  select s.key_protocol, s.key_low, s.key_high, s.session, min(p.t)
  from starts s join marked p on p.key_protocol = s.key_protocol and p.key_low = s.key_low
    and p.key_high = s.key_high and p.session = s.session and p.t > s.start + {int(active_s) * 1000000}
  group by all"""
    return f"""
gapped as (
  select *, case when {fresh} then 1 else 0 end as fresh from keyed
  window k as (partition by key_protocol, key_low, key_high order by t, seq)),
marked as (
  select *, sum(fresh) over (partition by key_protocol, key_low, key_high order by t, seq
    rows unbounded preceding) as session from gapped),
starts(key_protocol, key_low, key_high, session, start) as (
  select key_protocol, key_low, key_high, session, min(t) from marked group by all {cuts}),
numbered as (
  select *, row_number() over (partition by key_protocol, key_low, key_high order by start) as flow_no from starts),
flows as (
  select m.*, n.start as flow_start_us, n.flow_no
  from marked m asof join numbered n on m.key_protocol = n.key_protocol and m.key_low = n.key_low
    and m.key_high = n.key_high and m.t >= n.start)
"""


EVENT_SERIES = """
firsts as (
  select *, (row_number() over f - 1)::integer as pos,
    first_value(src_ip) over f as client_ip, first_value(src_port) over f as client_port,
    first_value(dst_ip) over f as server_ip, first_value(dst_port) over f as server_port,
    lag(t) over f as prev_t
  from flows window f as (partition by key_protocol, key_low, key_high, flow_no order by t, seq)),
series as (
  select *, (case when src_ip = client_ip and src_port = client_port then 0 else 1 end)::integer as dir,
    (case when src_ip = client_ip and src_port = client_port then ip_size else -ip_size end)::double as ps,
    coalesce(t / 1000.0 - prev_t / 1000.0, 0)::double as ipt, payload_size::double as bulk,
    (case when protocol = 6 and ip_version = 4 then tcp_window else 0 end)::double as win,
    (case when protocol = 6 and ip_version = 4 then tcp_flags else 0 end)::integer as flag
  from firsts where pos < 20)
"""


def events_sql(body: str, idle: int | None = CONFIG.idle, active: int | None = CONFIG.active, series: bool = False) -> str:
    parts = [EVENT_PACKETS, flows_sql(idle, active)] + ([EVENT_SERIES] if series else [])
    return "with recursive " + ",\n".join(p.strip() for p in parts) + "\n" + body


def line_packets(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    """lineitem rows as the long packet form: an order is a flow, a day of shipping time plays 100 ms."""
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "flow_id")
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]
    first = A.first_packets(items, ["flow_id"], order, n)
    sized = first.withColumn("dir", (F.col("l_linestatus") == "O").cast("int")).withColumn(
        "size", F.col("l_quantity") * 30.0
    )
    series = A.packet_series(
        sized, ["flow_id"], F.unix_date(F.col("l_shipdate").cast("date")) * 100.0, "size", "l_extendedprice",
        F.col("l_partkey") % 65536, F.col("l_suppkey") % 64, order,
    )
    return series.select("flow_id", "pos", "dir", "ps", "ipt", "bulk", "win", "flag")


def line_flows(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    """One row per order with its packet array."""
    return A.packet_arrays(line_packets(spark, sf_dir, n), ["flow_id"])


def line_packets_sql(n: int = 20) -> str:
    return f"""
li_raw as (
  select l_orderkey as flow_id,
    (row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey) - 1)::integer as pos,
    (date_diff('day', date '1970-01-01', l_shipdate::date) * 100)::double as t_ms,
    (case when l_linestatus = 'O' then 1 else 0 end)::integer as dir, l_quantity * 30.0 as size,
    l_extendedprice as bulk, (l_partkey % 65536)::double as win, (l_suppkey % 64)::integer as flag
  from lineitem),
pl as (
  select flow_id, pos, dir, (case when dir = 1 then -size else size end)::double as ps,
    coalesce(t_ms - lag(t_ms) over (partition by flow_id order by pos), 0)::double as ipt, bulk, win, flag
  from li_raw where pos < {n})
"""


def lines_sql(body: str, n: int = 20, more: str = "", recursive: bool = False) -> str:
    head = "with recursive " if recursive else "with "
    return head + line_packets_sql(n).strip() + ("," + more if more else "") + "\n" + body


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traffic class of every order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("flow_id"), F.col("o_orderpriority").alias("target_class")
    )
