"""Sources and sinks: what is written is read back and compared with the table it came from."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from flowloom import constants as K
from flowloom.functions import arrays as X
from flowloom.plans.storage import scratch_path
from flowloom.queries.inputs import classes, line_flows, lines_sql, table
from flowloom.queries.registry import query
from flowloom.sources import datasets as S

_WIDE = ", ".join(
    f"coalesce(max(case when pos = {i} then ps end), 0) as raw_packet{i}, coalesce(max(case when pos = {i} then ipt end), 0) as raw_iat{i}"
    for i in range(K.PACKET_LIMIT))


@query("flows_csv_filled", lines_sql(f"select flow_id, {_WIDE} from pl group by flow_id"))
def flows_csv_filled(spark, sf):
    """Wide flows to CSV and back, empty cells filled with 0."""
    wide = line_flows(spark, sf).select("flow_id", *X.to_wide(F.col("packets"), K.PACKET_LIMIT))
    path = scratch_path(spark, "csv")
    S.write_flows(wide, path, "csv")
    return S.read_flows(spark, path, wide.schema, fill_missing=True).select(*wide.columns)


@query("flows_pruned_scan", lines_sql("select flow_id, max(case when pos = 0 then ps end) as raw_packet0 from pl group by flow_id"))
def flows_pruned_scan(spark, sf):
    """Only the columns that are asked for are read; those that are missing are left out."""
    path = scratch_path(spark, "parquet")
    S.write_flows(line_flows(spark, sf).select("flow_id", *X.to_wide(F.col("packets"), K.PACKET_LIMIT)), path)
    return S.read_flows(spark, path, columns=["flow_id", "raw_packet0", "not_there"])


@query("flows_per_class", "select o_orderkey as flow_id, o_orderpriority as target_class from orders")
def flows_per_class(spark, sf):
    """One folder per class, read back with the class from the folder's name."""
    path = scratch_path(spark, "classes")
    S.write_per_class(classes(spark, sf), path)
    kinds = T.StructType([T.StructField("flow_id", T.LongType()), T.StructField("target_class", T.StringType())])
    return spark.read.schema(kinds).parquet(path).select("flow_id", "target_class")


@query("flows_split_by_size", "select count(*) as flows, true as bounded, count(*) > 1000 as split from orders")
def flows_split_by_size(spark, sf):
    """Files of at most 1,000 rows, counted file by file."""
    path = scratch_path(spark, "split")
    S.write_flows(classes(spark, sf), path, max_rows_per_file=1000)
    return S.file_sizes(spark, path).agg(
        F.sum("flows").alias("flows"), (F.max("flows") <= 1000).alias("bounded"), (F.count("*") > 1).alias("split"))


@query("version_saved", "select o_orderkey, o_custkey, o_orderstatus from orders")
def version_saved(spark, sf):
    """Saved twice under its content's name, kept once, and read back."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    folder = scratch_path(spark, "versions")
    S.save_version(rows, folder)
    return spark.read.parquet(S.save_version(rows.orderBy("o_custkey"), folder))


@query("version_cached", """
select 'by_status' as kind, o_orderstatus as key, count(*) as n from orders group by 2
union all select 'by_priority', o_orderpriority, count(*) from orders group by 2""")
def version_cached(spark, sf):
    """Two results of one source have places of their own; each is computed once."""
    rows, folder, built = table(spark, sf, "orders"), scratch_path(spark, "cache"), []

    def count(column):
        def build(source):
            built.append(column)
            return source.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))

        return build

    parts = []
    for kind, column in (("by_status", "o_orderstatus"), ("by_priority", "o_orderpriority")):
        for _ in range(2):
            found = S.cached_version(rows, folder, count(column), "count", column=column)
        parts.append(found.select(F.lit(kind).alias("kind"), "key", "n"))
    if len(built) != 2:
        raise ValueError("a stored result was computed again")
    return parts[0].unionByName(parts[1])


@query("report_saved", """
select o_orderpriority as class, count(*)::double as flows, round(avg(o_totalprice), 4) as price from orders group by 1""")
def report_saved(spark, sf):
    """Long metrics to a CSV table with one row per class, read back."""
    stats = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("class")).agg(
        F.count("*").cast("double").alias("flows"), F.round(F.avg("o_totalprice"), 4).alias("price"))
    metrics = stats.select("class", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("flows", "price")])).alias("m")).select("class", "m.*")
    path = scratch_path(spark, "report")
    S.write_report(metrics, path, ["flows", "price"])
    return spark.read.option("header", True).schema("class string, flows double, price double").csv(path)


