"""Dataset preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.operators import prepare as D
from flowloom.queries.inputs import classes, line_flows, lines_sql, table
from flowloom.queries.registry import query
from flowloom.plans.running import running_totals
from flowloom.plans.storage import write_and_read
from flowloom.sources.datasets import fingerprint


def labelled_orders(spark, sf):
    """Orders as parsed flows: a traffic label from priority and market segment, a file name from the status."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    p, s = F.col("o_orderpriority"), F.col("c_mktsegment")
    app = (F.when(p == "1-URGENT", F.concat(F.lit("DNS."), s)).when(p == "2-HIGH", F.lit("TLS.Amazon"))
           .when(p == "3-MEDIUM", F.concat(F.lit("TLS."), s)).when(p == "4-NOT SPECIFIED", F.lit("Unknown"))
           .otherwise(F.lit("NTP")))
    status = F.col("o_orderstatus")
    name = (F.when(status == "F", F.concat(F.lit("train_camera_"), s, F.lit(".csv")))
            .when(status == "O", F.lit("val_202004.csv")).otherwise(F.concat(F.lit("test_"), s, F.lit(".csv"))))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("flow_id"), app.alias("ndpi_app"), name.alias("source_file"),
        F.col("o_custkey").alias("client"), F.col("c_nationkey").alias("server"),
    )


_LABELLED = """
labelled as (
  select o_orderkey as flow_id,
    case o_orderpriority when '1-URGENT' then 'DNS.' || c_mktsegment when '2-HIGH' then 'TLS.Amazon'
      when '3-MEDIUM' then 'TLS.' || c_mktsegment when '4-NOT SPECIFIED' then 'Unknown' else 'NTP' end as ndpi_app,
    case o_orderstatus when 'F' then 'train_camera_' || c_mktsegment || '.csv' when 'O' then 'val_202004.csv'
      else 'test_' || c_mktsegment || '.csv' end as raw_file
  from orders join customer on o_custkey = c_custkey),
routed as (
  select flow_id, ndpi_app, raw_file, regexp_replace(raw_file, '^(train|val|test)_', '') as source_file from labelled),
classed as (
  select *, split_part(source_file, '_', 1) in
      ('hub','camera','trigger','environment','healthcare','light_bulb','electronics') as is_device,
    case when ndpi_app like 'DNS%' then 'DNS' when ndpi_app like 'NTP%' then 'NTP' when ndpi_app like 'STUN%' then 'STUN'
      when split_part(source_file, '_', 1) in ('hub','camera','trigger','environment','healthcare','light_bulb','electronics')
        then 'IoT_' || split_part(source_file, '_', 1)
      else list_last(string_split(ndpi_app, '.')) end as target_class
  from routed),
cleaned as (
  select * from classed where not case when is_device
    then ndpi_app in ('ICMP','ICMPV6','DHCPV6','DHCP','Unknown','IGMP','SSDP')
    else target_class in ('ICMP','ICMPV6','DHCPV6','DHCP','Unknown','IGMP','SSDP','Amazon') end)"""


@query("label_rules", f"with {_LABELLED} select flow_id, source_file, is_device, target_class from classed")
def label_rules(spark, sf):
    return D.label_flows(D.route_files(labelled_orders(spark, sf))).select(
        "flow_id", "source_file", "is_device", "target_class")


@query("prepare_dataset", f"""with {_LABELLED} select flow_id, source_file, target_class from cleaned
  where raw_file not like '%202004%'""")
def prepare_dataset(spark, sf):
    return D.prepare_dataset(labelled_orders(spark, sf), exclude=("202004", "raw_csv")).select(
        "flow_id", "source_file", "target_class")


@query("dataset_union", f"""with {_LABELLED} select flow_id, target_class from cleaned where raw_file like 'train%'
  union all select flow_id, target_class from cleaned where raw_file like 'val%'""")
def dataset_union(spark, sf):
    flows = labelled_orders(spark, sf)
    train = D.prepare_dataset(flows.filter(F.startswith("source_file", F.lit("train"))))
    val = D.prepare_dataset(flows.filter(F.startswith("source_file", F.lit("val"))))
    return D.union_datasets(train, val).select("flow_id", "target_class")


def _session(spark, sf):
    items = table(spark, sf, "lineitem")
    a, b = F.col("l_suppkey").cast("string"), (F.col("l_partkey") % 100).cast("string")
    odd = F.col("l_linenumber") % 2 == 1
    return items.select(
        F.col("l_returnflag").alias("ip_proto"), F.when(odd, a).otherwise(b).alias("src"), F.when(odd, b).otherwise(a).alias("dst"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


@query("session_dedup", """
with s as (select l_returnflag as ip_proto, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  case when l_linenumber % 2 = 1 then l_suppkey::varchar else (l_partkey % 100)::varchar end as src,
  case when l_linenumber % 2 = 1 then (l_partkey % 100)::varchar else l_suppkey::varchar end as dst from lineitem)
select ip_proto, src, dst, l_orderkey, l_linenumber from (
  select *, row_number() over (partition by ip_proto, least(src, dst), greatest(src, dst)
    order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) as rn from s) x where rn = 1""")
def session_dedup(spark, sf):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return D.drop_duplicate_flows(_session(spark, sf), "ip_proto", "src", "dst", order).select(
        "ip_proto", "src", "dst", "l_orderkey", "l_linenumber")


@query("prune_rare", """
with c as (select user_id, count(*) as n from events group by 1),
cut as (select avg(n)::bigint as floor from c)
select event_id, user_id from events where user_id not in (select user_id from c, cut where n < floor)""")
def prune_rare(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id")
    counts = events.groupBy("user_id").count()
    floor = counts.agg(F.round(F.avg("count")).cast("long")).first()[0]
    return D.prune_classes(events, floor, label="user_id")[0]


@query("prune_by_train_list", """
with t as (select c_mktsegment || c_nationkey as class, c_acctbal < 5000 as train, c_custkey from customer),
rare as (select class from t where train group by 1 having count(*) < 6)
select c_custkey, class from t where not train and class not in (select class from rare)""")
def prune_by_train_list(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey", "c_acctbal", F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("class"))
    train, test = rows.filter(F.col("c_acctbal") < 5000), rows.filter(F.col("c_acctbal") >= 5000)
    _, rare = D.prune_classes(train, 6, label="class")
    return D.prune_classes(test.drop("c_acctbal"), pruned=rare, label="class")[0]


@query("dataset_fingerprint")
def dataset_fingerprint(spark, sf):
    return fingerprint(table(spark, sf, "orders"))


_HASH = "('0x' || substr(md5('1|' || o_orderkey), 1, 15))::bigint"


@query("stratified_split", f"""
select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by {_HASH}, o_orderkey)
  <= round(count(*) over (partition by o_orderpriority) * 0.25) as is_test from orders""")
def stratified_split(spark, sf):
    return D.stratified_split(table(spark, sf, "orders"), "o_orderpriority", ["o_orderkey"]).select(
        "o_orderkey", "o_orderpriority", "is_test")


@query("random_split", f"select o_orderkey, ({_HASH} % 1048576) / 1048576.0::double >= 0.9::double as is_test from orders")
def random_split(spark, sf):
    return D.random_split(table(spark, sf, "orders"), ["o_orderkey"]).select("o_orderkey", "is_test")


@query("shuffle_seeded", f"""
select o_orderkey, o_orderpriority, row_number() over (order by {_HASH}, o_orderkey) - 1 as place from orders""")
def shuffle_seeded(spark, sf):
    """The shuffled rows with their places in the result, numbered partition by partition."""
    ordered = D.shuffled(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"])
    placed = ordered.select("*", F.lit(0).alias("all"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    counted = running_totals(write_and_read(placed, "shuffled"), ["all"], "part", ["at"], {"rows": F.lit(1).cast("long")})
    return counted.select("o_orderkey", "o_orderpriority", F.col("before_rows").alias("place"))


@query("class_cap", """select o_orderpriority as target_class, count(*) as flows, least(count(*), 3000) as to_generate
from orders group by 1""")
def class_cap(spark, sf):
    return D.class_caps(classes(spark, sf), 3000)


@query("sequence_dataset", lines_sql("""
select c.flow_id, target_class, n as n_packets from classed c join
  (select flow_id, count(*)::integer as n from pl group by 1 having count(*) >= 2) p on c.flow_id = p.flow_id
where raw_file not like '%202004%'""", more=_LABELLED))
def sequence_dataset(spark, sf):
    flows = labelled_orders(spark, sf).join(line_flows(spark, sf), "flow_id")
    return D.sequence_dataset(flows, "labelled", exclude=("202004",)).select(
        "flow_id", "target_class", F.size("packets").alias("n_packets"))


@query("sequence_dataset_class", """
select o_orderkey as flow_id, target_class from (select o_orderkey, o_orderpriority as target_class from orders) x
where target_class = '2-HIGH'""")
def sequence_dataset_class(spark, sf):
    return D.sequence_dataset(classes(spark, sf), "class", target="2-HIGH")


@query("train_and_test", f"""
with {_LABELLED},
f as (select c.flow_id, raw_file, target_class, split_part(ndpi_app, '.', 1) as proto,
  o_custkey::varchar as client, 'n' || (o_orderkey % 40) as server from cleaned c join orders on o_orderkey = c.flow_id),
tr as (select * from f where raw_file not like 'test%'
  qualify row_number() over (partition by proto, least(client, server), greatest(client, server) order by flow_id) = 1),
te as (select * from f where raw_file like 'test%'
  qualify row_number() over (partition by proto, least(client, server), greatest(client, server) order by flow_id) = 1),
rare as (select target_class from tr group by 1 having count(*) < 50)
select 'train' as part, flow_id, target_class from tr where target_class not in (select target_class from rare)
union all
select 'test' as part, flow_id, target_class from te where target_class not in (select target_class from rare)""")
def train_and_test(spark, sf):
    raw = labelled_orders(spark, sf).withColumn("part", F.split_part("source_file", F.lit("_"), F.lit(1)))
    flows = D.prepare_dataset(raw).select(
        "flow_id", "part", "target_class", F.split_part("ndpi_app", F.lit("."), F.lit(1)).alias("proto"),
        F.col("client").cast("string").alias("client"),
        F.concat(F.lit("n"), (F.col("flow_id") % 40).cast("string")).alias("server"))
    pick = lambda name: flows.filter(F.col("part") == name)
    train, test = D.train_and_test(
        [pick("train"), pick("val")], pick("test"), "proto", "client", "server", ["flow_id"])
    named = lambda df, part: df.select(F.lit(part).alias("part"), "flow_id", "target_class")
    return named(train, "train").unionByName(named(test, "test"))
