"""Per-flow, per-direction statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom import constants as K
from flowloom.functions import stats as S
from flowloom.plans.running import running_totals

#: Packets that a task sorts and aggregates when the number of rows is known.
TASK_ROWS = 1 << 17


def flow_stats(
    series: DataFrame,
    flow: Sequence[str],
    bases: dict[str, Column] | None = None,
    direction: Column | None = None,
    extra: Sequence[str] = (),
    features: dict[str, S.Feature] | None = None,
    tcp: bool = True,
    rows: int | None = None,
) -> DataFrame:
    """Client and server statistics side by side: one row per flow.

    A direction without packets has 0 everywhere (and no flags); a direction with one packet keeps a NULL second value.
    `direction` is 0 for the client and 1 for the server. The input holds the bounded first packets of each flow; the windows and
    the aggregation share one partitioning by flow. `rows`, an upper bound of the input's rows where one is known, sets the number of
    partitions, so that a task's sorts and aggregate keep their size as the input grows; without it Spark's own partitions are taken.
    """
    if rows is not None:
        parts = max(series.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))
        series = series.repartition(parts, *flow)
    if bases is None:
        bases = {"bulk": F.col("bulk"), "packet": F.abs(F.col("ps"))}
    side = Window.partitionBy(*flow, "__dir")
    work = series.withColumn("__dir", F.col("dir") if direction is None else direction).withColumns(
        {f"__v_{base}": value for base, value in bases.items()}
    ).withColumns({
        "__arrival": F.row_number().over(side.orderBy("pos")) - 1,
        "__n": F.count(F.lit(1)).over(side),
        **{f"__p_{base}": F.row_number().over(side.orderBy(f"__v_{base}")) - 1 for base in bases},
    })
    aggs: dict[str, Column] = {}
    for prefix, number in ((K.CLIENT, 0), (K.SERVER, 1)):
        here = F.col("__dir") == number
        aggs[f"__{prefix}n"] = F.count_if(here)
        for base in bases:
            one = S.Series(F.col(f"__v_{base}"), here, F.col("__arrival"), F.col(f"__p_{base}"), F.col("__n"))
            aggs.update({f"{prefix}{base}{name}": fn(one) for name, fn in (features or S.FEATURES).items()})
        if tcp:
            aggs[f"{prefix}tcp_window_avg"] = F.avg(F.when(here, F.col("win")))
            aggs.update({f"__{prefix}flags{i}": w for i, w in enumerate(S.flag_words(F.col("flag"), here))})
    wide = work.groupBy(*flow, *extra).agg(*[c.alias(n) for n, c in aggs.items()])
    out = []
    for prefix in (K.CLIENT, K.SERVER):
        for name in aggs:
            if name.startswith(prefix):
                out.append(F.when(F.col(f"__{prefix}n") == 0, F.lit(0.0)).otherwise(F.col(name)).alias(name))
        if tcp:
            out.append(S.flags_of([F.col(f"__{prefix}flags{i}") for i in range(4)]).alias(f"{prefix}found_tcp_flags"))
    return wide.select(*flow, *extra, *out)


def stats_from_sequences(
    flows: DataFrame,
    flow: Sequence[str],
    packets: str = "packets",
    packet_limit: int = K.PACKET_LIMIT,
    with_iat: bool = False,
    positive_is_client: bool = True,
) -> DataFrame:
    """Add size (and gap) statistics computed from stored packet arrays; flows that have statistics are returned as is.

    Missing values count as 0. `positive_is_client=False` reads positive sizes as sent by the server.
    """
    if any(f"{K.SERVER}{name}" in flows.columns for name in S.continuous_names()):
        return flows
    first = F.slice(F.col(packets), 1, packet_limit)
    values = {"packet": lambda p: F.abs(p["ps"])} | ({"iat": lambda p: p["ipt"]} if with_iat else {})
    sides = {K.CLIENT: positive_is_client, K.SERVER: not positive_is_client}
    parts, names = [], []
    for prefix, positive in sides.items():
        own = F.filter(first, lambda p: p["ps"] > 0) if positive else F.filter(first, lambda p: p["ps"] < 0)
        for base, value in values.items():
            parts.append(S.array_statistics(F.transform(own, value)).alias(f"{prefix}{base}"))
            names += [(f"{prefix}{base}", name) for name in S.ARRAY_FEATURES]
    # the row holds its packets: no shuffle
    computed = flows.select("*", F.explode(F.array(F.struct(*parts))).alias("__stats"))
    return computed.select(*flows.columns, *[F.coalesce(F.col("__stats")[part][name], F.lit(0.0)).alias(part + name) for part, name in names])


def apply_per_flow(series: DataFrame, flow: Sequence[str], plugin, schema) -> DataFrame:
    """A user's Python function on the first N packets of each flow, given and returned as pandas frames in packet order."""
    def run(packets):
        return plugin(packets.sort_values("pos"))

    return series.groupBy(*flow).applyInPandas(run, schema)


def packets_per_flow(flows: DataFrame, packets: str = "packets") -> DataFrame:
    return flows.withColumn("n_packets", F.size(packets))


def length_ecdf(lengths: DataFrame, length: str, step: int = 4096) -> DataFrame:
    """Share of flows with at most n packets, over all flows and over flows of more than one packet."""
    counts = lengths.groupBy(F.col(length).cast("long").alias("n_packets")).agg(F.count("*").alias("flows"))
    counts = counts.withColumn("__all", F.lit(0)).withColumn("__step", F.floor(F.col("n_packets") / step))
    single = F.when(F.col("n_packets") == 1, F.col("flows"))
    totals = counts.groupBy("__all").agg(F.sum("flows").alias("total"), F.coalesce(F.sum(single), F.lit(0)).alias("single"))
    cumulated = running_totals(counts, ["__all"], "__step", ["n_packets"], {"flows": F.col("flows")})
    upto = F.col("before_flows") + F.col("flows")
    return cumulated.join(totals, "__all").select(
        "n_packets", "flows", (upto / F.col("total")).alias("ecdf"),
        F.try_divide(upto - F.col("single"), F.col("total") - F.col("single")).alias("ecdf_multi"),
    )
