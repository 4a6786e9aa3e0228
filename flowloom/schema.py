"""Table shapes and the absent-value rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

PACKETS = T.StructType([
    T.StructField("src_mac", T.StringType()),
    T.StructField("dst_mac", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.ShortType()),
    T.StructField("ip_version", T.ByteType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ip_size", T.IntegerType()),
    T.StructField("payload_size", T.IntegerType()),
    T.StructField("tcp_window", T.IntegerType()),
    T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("source_file", T.StringType()),
])

PACKET_PAIR = T.StructType([T.StructField("ps", T.DoubleType()), T.StructField("ipt", T.DoubleType())])

FLOW_IDS = ("flow_id", "ip_proto")
FLOW_LABELS = ("ndpi_app", "ndpi_category", "ndpi_client_info", "ndpi_server_info", "ndpi_j3ac", "ndpi_j3as")


def raw_columns(n: int, bases: tuple[str, ...] = ("packet", "iat")) -> list[str]:
    """Interleaved names of the wide form: raw_packet0, raw_iat0, raw_packet1, ..."""
    return [f"raw_{base}{i}" for i in range(n) for base in bases]


def flow_csv_schema(n: int, extra: tuple[str, ...] = ()) -> T.StructType:
    """Schema of a parsed-flow CSV holding identifiers, labels and n raw packets."""
    text = [T.StructField(c, T.StringType()) for c in FLOW_IDS + FLOW_LABELS + extra]
    return T.StructType(text + [T.StructField(c, T.DoubleType()) for c in raw_columns(n)])


def absent_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN and infinities into NULL: Spark orders NaN above every number."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select([
        F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c)
        if c in floats else F.col(c) for c in df.columns
    ])


def resolve_columns(df: DataFrame, wanted: list[str]) -> tuple[list[str], list[str]]:
    """(present, missing) of the wanted columns, both in the order asked for."""
    have = set(df.columns)
    return [c for c in wanted if c in have], [c for c in wanted if c not in have]
