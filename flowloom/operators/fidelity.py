"""How close generated traffic is to its source.

All metrics work on one relation (by..., side, value, weight) in which equal values are merged, `side` is
'src' or 'gen' and `weight` counts the samples. Running totals over values go through slices, so a
series with any number of distinct values never has to fit one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from flowloom import constants as K
from flowloom.functions.arrays import ipt_to_iat, unnest
from flowloom.plans.keys import join_on
from flowloom.plans.running import equal_slices, running_totals
from flowloom.plans.storage import write_and_read

PERCENTILES = (10, 50, 90)


def weighted(samples: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Merge equal values."""
    return samples.filter(F.col(value).isNotNull()).groupBy(*by, "side", F.col(value).cast("double").alias("value")).agg(
        F.count("*").alias("weight"))


def _moments(rel: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, largest value and kernel width per sample; NULL width for fewer than two or only equal values."""
    keys = [*by, "side"]
    first = rel.groupBy(*keys).agg(
        F.sum("weight").alias("n"), F.max("value").alias("top"),
        (F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("mean"))
    spread = join_on(rel, first, keys).groupBy(*keys, "n", "top").agg(
        F.sum(F.col("weight") * F.pow(F.col("value") - F.col("mean"), 2)).alias("ss"))
    var = F.try_divide(F.col("ss"), F.col("n") - 1)
    return spread.select(*keys, "n", "top", F.when(var > 0, F.sqrt(var) * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"))


def kde(rel: DataFrame, by: Sequence[str], points: int = K.KDE_POINTS) -> DataFrame:
    """Gaussian density of each sample on `points` places from 0 to its largest value, normalised to sum 1.

    Each distinct value adds to the fixed number of places and is summed up before the shuffle.
    """
    keys = [*by, "side"]
    rel = write_and_read(rel, "samples")
    spread = join_on(rel, _moments(rel, by).filter("h is not null"), keys).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    z = (F.col("top") * F.col("i") / F.lit(float(points - 1)) - F.col("value")) / F.col("h")
    density = spread.groupBy(*keys, "i").agg(F.sum(F.col("weight") * F.exp(-z * z / 2)).alias("d"))
    return density.select(*keys, "i", F.try_divide("d", F.sum("d").over(Window.partitionBy(*keys))).alias("p"))


def _sides(rel: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Source and generated value side by side."""
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col(value)))
    return rel.groupBy(*keys).agg(pick("src").alias("src"), pick("gen").alias("gen"))


def kl_divergence(density: DataFrame, by: Sequence[str]) -> DataFrame:
    """Divergence of the two density vectors, place by place."""
    p, q = F.col("src"), F.col("gen")
    term = F.when(p.isNull() | q.isNull(), None).when(p == 0, 0.0).when(q == 0, float("inf")).otherwise(p * F.log(p / q))
    both = _sides(density, [*by, "i"], "p").withColumn("t", term)
    return both.groupBy(*by).agg(F.when(F.count("t") == F.count("*"), F.sum("t")).alias("value"))


def wasserstein(density: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean distance of the two density vectors after sorting each."""
    ranked = density.withColumn("r", F.row_number().over(Window.partitionBy(*by, "side").orderBy("p")))
    both = _sides(ranked, [*by, "r"], "p")
    return both.groupBy(*by).agg(F.avg(F.abs(F.col("src") - F.col("gen"))).alias("value"))


def cumulated(rel: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per distinct value the weights of both sides, the weights of all smaller values and the totals n_src and n_gen."""
    weight = lambda side: F.sum(F.when(F.col("side") == side, F.col("weight")).otherwise(0))
    flat = write_and_read(rel.groupBy(*by, "value").agg(weight("src").alias("src"), weight("gen").alias("gen")), "values")
    totals = flat.groupBy(*by).agg(F.sum("src").alias("n_src"), F.sum("gen").alias("n_gen"))
    sliced = equal_slices(flat, "value")
    running = running_totals(sliced, by, "slice", ["value"], {"src": F.col("src"), "gen": F.col("gen")}).drop("slice")
    return join_on(running, totals, by)


def ks_statistic(cum: DataFrame, by: Sequence[str]) -> DataFrame:
    """Largest distance of the two distribution functions."""
    share = lambda s: F.try_divide(F.col(f"before_{s}") + F.col(s), F.col(f"n_{s}"))
    return cum.groupBy(*by).agg(F.max(F.abs(share("src") - share("gen"))).alias("value"))


def percentiles(cum: DataFrame, by: Sequence[str], points: Sequence[int] = PERCENTILES) -> DataFrame:
    """Linearly interpolated percentiles of both sides, read off the running totals."""
    found: list[Column] = []
    for side in ("src", "gen"):
        for p in points:
            place = F.lit(p / 100.0) * (F.col(f"n_{side}") - 1)
            for name, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
                hit = (F.col(f"before_{side}") <= rank) & (rank < F.col(f"before_{side}") + F.col(side))
                found.append(F.max(F.when(hit, F.col("value"))).alias(f"{side}_{p}_{name}"))
            found.append(F.max(place - F.floor(place)).alias(f"{side}_{p}_f"))
    rows = cum.groupBy(*by).agg(*found)
    value = lambda side, p: F.col(f"{side}_{p}_lo") + F.col(f"{side}_{p}_f") * (F.col(f"{side}_{p}_hi") - F.col(f"{side}_{p}_lo"))
    return rows.select(*by, F.explode(F.array(*[
        F.struct(F.lit(p).alias("percentile"), value("src", p).alias("src"), value("gen", p).alias("gen")) for p in points
    ])).alias("x")).select(*by, "x.percentile", "x.src", "x.gen")


def scaled_differences(cum: DataFrame, by: Sequence[str], points: Sequence[int] = PERCENTILES) -> DataFrame:
    """abs(source - generated) / source at each percentile."""
    return percentiles(cum, by, points).withColumn(
        "value", F.try_divide(F.abs(F.col("src") - F.col("gen")), F.col("src")))


def directed_packets(flows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Packets with same-direction gaps; direction client for positive, server for negative sizes."""
    return unnest(flows.select(*by, order, ipt_to_iat(F.col("packets")).alias("p")), "p").select(
        *by, order, "pos", F.when(F.col("p.ps") > 0, "client").otherwise("server").alias("direction"),
        F.col("p.ps").alias("ps"), F.col("p.iat").alias("iat"))


def throughput(flows: DataFrame, by: Sequence[str], order: str, bin_ms: int = 1000) -> DataFrame:
    """Bytes per non-empty bin of a virtual clock that runs through the packets of one direction, flow after flow.

    `order` is unique and fixes the order of the flows: numbers count up, ids of another type are ordered by their hash. The clock at the start of a flow is a running total
    over flows; inside a flow it is an array fold.
    """
    clocked = []
    for name, test in (("client", lambda p: p["ps"] > 0), ("server", lambda p: p["ps"] < 0)):
        clocked.append(F.struct(F.lit(name).alias("direction"), F.filter("iats", test).alias("own")))
    number = F.col(order) if isinstance(flows.schema[order].dataType, T.NumericType) else F.xxhash64(order)
    sliced = equal_slices(flows.withColumn("__number", number), "__number")
    per_flow = sliced.select(*by, order, "__number", "slice", ipt_to_iat(F.col("packets")).alias("iats")).select(
        *by, order, "__number", "slice", F.explode(F.array(*clocked)).alias("d")).select(*by, order, "__number", "slice", "d.*")
    keys = [*by, "direction"]
    spent = F.aggregate("own", F.lit(0.0), lambda a, p: a + p["iat"])
    started = running_totals(per_flow, keys, "slice", ["__number", order], {"spent": spent})
    clock = F.transform(F.col("own"), lambda p, i: F.struct(
        (F.col("before_spent") + F.aggregate(F.slice("own", F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x["iat"])).alias("t"),
        p["ps"].alias("ps")))
    packets = unnest(started.select(*keys, clock.alias("p")), "p")
    return packets.groupBy(*keys, F.floor(F.col("p.t") / bin_ms).alias("bin")).agg(F.sum("p.ps").alias("bytes"))


def _bins(rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rates.groupBy(*keys).agg(
        F.sum("bytes").alias("bytes"), (F.max("bin") - F.min("bin") + 1).alias("bins"), F.count("*").alias("filled"))


def mean_throughput(rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean bytes per bin; empty bins count."""
    return _bins(rates, keys).select(*keys, (F.col("bytes") / F.col("bins")).alias("value"))


def traffic_samples(flows: DataFrame, by: Sequence[str], order: str) -> tuple[DataFrame, DataFrame]:
    """The seven series of the report as (by, side, series, value, weight), and the throughput bins.

    `flows(by, side, order, packets)` holds both sides.
    """
    keys = [*by, "side"]
    lengths = flows.select(*keys, F.lit("packets_per_flow").alias("series"), F.size("packets").cast("double").alias("value"))
    packets = directed_packets(flows, keys, order).select(*keys, F.explode(F.array(
        F.struct(F.concat(F.lit("PS_"), "direction").alias("series"), F.col("ps").alias("value")),
        F.struct(F.concat(F.lit("IAT_"), "direction").alias("series"), F.col("iat").alias("value")),
    )).alias("s")).select(*keys, "s.series", "s.value")
    rates = write_and_read(throughput(flows, keys, order), "throughput")
    series = F.concat(F.lit("thrpt_"), "direction").alias("series")
    empty = _bins(rates, [*keys, "direction"]).select(
        *keys, series, F.lit(0.0).alias("value"), (F.col("bins") - F.col("filled")).alias("weight")).filter("weight > 0")
    counted = weighted(lengths.unionByName(packets).unionByName(
        rates.select(*keys, series, F.col("bytes").alias("value"))), [*by, "series"])
    merged = counted.unionByName(empty.select(*counted.columns)).groupBy(*keys, "series", "value").agg(
        F.sum("weight").alias("weight"))
    return merged, rates


def fidelity_report(source: DataFrame, generated: DataFrame, by: Sequence[str] = (K.TARGET_CLASS,),
                    order: str = "flow_id", points: Sequence[int] = PERCENTILES, with_wasserstein: bool = False) -> DataFrame:
    """Long report (by, metric, value) of all classes at once; a metric that cannot be estimated is NULL."""
    by = list(by)
    columns = [*by, order, "packets"]
    flows = write_and_read(source.select(*columns).withColumn("side", F.lit("src")).unionByName(
        generated.select(*columns).withColumn("side", F.lit("gen"))), "flows")
    samples, rates = traffic_samples(flows, by, order)
    samples = write_and_read(samples, "samples")
    keys = [*by, "series"]
    density = write_and_read(kde(samples, keys), "density")
    cum = write_and_read(cumulated(samples, keys), "running")

    def named(part: DataFrame, prefix: Column) -> DataFrame:
        return part.select(*by, F.concat(prefix, F.lit("_"), "series").alias("metric"), "value")

    counts = flows.groupBy(*by, "side").agg(F.count("*").alias("n"))
    both = lambda c: F.coalesce(F.max(F.when(F.col("side") == c, F.col("n"))), F.lit(0))
    parts = [
        named(kl_divergence(density, keys), F.lit("KL")),
        named(ks_statistic(cum, keys), F.lit("KS_2sample")),
        named(scaled_differences(cum, keys, points), F.concat(F.col("percentile").cast("string"), F.lit("th_percentile"))),
        mean_throughput(rates, [*by, "side", "direction"]).select(
            *by, F.concat("side", F.lit("_avg_throughput_bytes_per_s_"), "direction").alias("metric"), "value"),
        counts.groupBy(*by).agg(F.least(both("src"), both("gen")).cast("double").alias("value")).select(
            *by, F.lit("n_flows").alias("metric"), "value"),
    ]
    if with_wasserstein:
        parts.append(named(wasserstein(density, keys), F.lit("Wasserstein")))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
