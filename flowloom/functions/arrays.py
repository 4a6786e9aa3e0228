"""Expressions on a flow's bounded packet array (array<struct<ps,ipt>>, at most N long)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_IAT = "array<struct<ps:double,iat:double>>"


def unnest(df: DataFrame, array: str, pos: str = "pos") -> DataFrame:
    """One row per element, with its position; rows with an empty array vanish.

    The outer form keeps Spark from inferring a filter on the array's size, which would compute the array a second time.
    """
    others = [c for c in df.columns if c != array]
    return df.select(*others, F.posexplode_outer(array).alias(pos, array)).filter(F.col(pos).isNotNull())


def ipt_to_iat(packets: Column) -> Column:
    """Replace the gap to the previous packet by the gap to the previous packet of the same direction.

    The first packet of a direction has 0; packets of size zero belong to no direction and are left out.
    """
    start = F.struct(
        F.lit(0.0).alias("clock"),
        F.lit(None).cast("double").alias("client"),
        F.lit(None).cast("double").alias("server"),
        F.array().cast(_IAT).alias("out"),
    )

    def step(acc: Column, p: Column) -> Column:
        clock = acc["clock"] + p["ipt"]
        to_server, to_client = p["ps"] > 0, p["ps"] < 0
        last = F.when(to_server, acc["client"]).otherwise(acc["server"])
        item = F.struct(p["ps"].alias("ps"), F.coalesce(clock - last, F.lit(0.0)).alias("iat"))
        return F.struct(
            clock.alias("clock"),
            F.when(to_server, clock).otherwise(acc["client"]).alias("client"),
            F.when(to_client, clock).otherwise(acc["server"]).alias("server"),
            F.when(to_server | to_client, F.concat(acc["out"], F.array(item))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(packets, start, step, lambda acc: acc["out"])


def gaps(times: Column) -> Column:
    """Differences between consecutive times; the first is 0, an empty array stays empty."""
    return F.transform(times, lambda t, i: F.when(i == 0, F.lit(0.0)).otherwise(t - F.get(times, i - 1)))


def to_wide(packets: Column, n: int) -> list[Column]:
    """The wide columns raw_packet0, raw_iat0, ... without a pivot; NULL where the flow has no packet."""
    out = []
    for i in range(n):
        item = F.get(packets, F.lit(i))
        out += [item["ps"].alias(f"raw_packet{i}"), item["ipt"].alias(f"raw_iat{i}")]
    return out


def from_wide(n: int, ps: str = "raw_packet", ipt: str = "raw_iat") -> Column:
    """Packet array of a wide row; absent, NaN and infinite packets are left out."""
    def number(name: str) -> Column:
        c = F.col(name).cast("double")
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)

    pairs = F.array(*[F.struct(number(f"{ps}{i}").alias("ps"), number(f"{ipt}{i}").alias("ipt")) for i in range(n)])
    return F.filter(pairs, lambda p: p["ps"].isNotNull() & p["ipt"].isNotNull())


def expand_tokens(ids: Column, first: Column, eof: int, pad: int, max_length: int = 128, absent: int = -1) -> Column:
    """Class or begin token, at most max_length - 2 packets, absent slots padded, end token after the last packet."""
    body = F.transform(F.slice(ids, 1, max_length - 2), lambda x: F.when(x == absent, F.lit(pad)).otherwise(x))
    raw = F.slice(ids, 1, max_length - 2)
    hole = F.array_position(raw, F.lit(absent).cast("int"))
    keep = F.when(hole > 0, hole - 1).otherwise(F.size(raw)).cast("int")
    return F.concat(
        F.array(first.cast("int")),
        F.slice(body, F.lit(1), keep),
        F.array(F.lit(eof).cast("int")),
        F.slice(body, keep + 1, F.size(body)),
    )


def pad_tokens(ids: Column, pad: int, absent: int = -1) -> Column:
    """Absent slots become the pad token; nothing is added."""
    return F.transform(ids, lambda x: F.when(x == absent, F.lit(pad).cast("int")).otherwise(x))


def attention_mask(tokens: Column, pad: int, mask_first: bool = False) -> Column:
    """1 for every token that is not padding; optionally 0 for the first position."""
    def bit(x: Column, i: Column) -> Column:
        on = (x != pad) & (i > 0) if mask_first else x != pad
        return on.cast("int")

    return F.transform(tokens, bit)


def lm_labels(tokens: Column, pad: int, ignore: int = -100) -> Column:
    """Training labels: padding is ignored."""
    return F.transform(tokens, lambda x: F.when(x == pad, F.lit(ignore).cast("int")).otherwise(x))


def strip_special(tokens: Column, eof: int, absent: int = -1) -> Column:
    """Back to packet ids: without the first token and one slot; everything from the end token on is absent."""
    tail = F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0)))
    at = F.array_position(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), F.lit(eof).cast("int"))
    return F.when(at == 0, tail).otherwise(
        F.transform(tail, lambda x, i: F.when(i + 1 >= at, F.lit(absent).cast("int")).otherwise(x))
    )


def size_token(ps: Column, size_range: int = 5000) -> Column:
    """Packet size clipped to an open range around 0 and shifted to be positive; absent counts as 0."""
    half = size_range // 2
    clipped = F.least(F.greatest(F.coalesce(ps, F.lit(0.0)), F.lit(float(1 - half))), F.lit(float(half - 1)))
    return (clipped + half).cast("int")
