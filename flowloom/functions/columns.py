"""Column expressions on packets, labels and identifiers."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowloom import constants as K


def epoch_us(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp, with or without a zone (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def in_network(ip: Column, cidr: str) -> Column:
    """True when the dotted IPv4 text lies in the network: whole octets as a prefix, at most one octet as a range."""
    address, bits = cidr.split("/")
    octets = [int(o) for o in address.split(".")]
    whole, rest = divmod(int(bits), 8)
    test = F.startswith(ip, F.lit("".join(f"{o}." for o in octets[:whole]))) if whole else F.lit(True)
    if whole == 4:
        test = ip == address
    elif rest:
        span = 1 << (8 - rest)
        low = octets[whole] - octets[whole] % span
        part = F.split_part(ip, F.lit("."), F.lit(whole + 1)).try_cast("int")
        test = test & part.between(low, low + span - 1)
    return F.coalesce(test, F.lit(False))


def protocol_names(spark: SparkSession) -> DataFrame:
    """The fixed lookup table of IP protocol names."""
    return spark.createDataFrame(list(K.IP_PROTOCOLS.items()), "protocol_number int, protocol_name string")


def with_protocol_name(df: DataFrame, protocol: str = "protocol", name: str = "ip_proto") -> DataFrame:
    """Add the protocol name; numbers outside the table become UNKNOWN. The table has a fixed size, so it is broadcast."""
    table = F.broadcast(protocol_names(df.sparkSession))
    return (
        df.join(table, df[protocol].cast("int") == table["protocol_number"], "left")
        .withColumn(name, F.coalesce("protocol_name", F.lit(K.UNKNOWN_PROTOCOL)))
        .drop("protocol_number", "protocol_name")
    )


def flow_id_text(protocol_name: str, src_ip: str, src_port: str, dst_ip: str, dst_port: str) -> Column:
    """`PROTO client:port server:port`."""
    return F.concat_ws(
        " ",
        F.col(protocol_name),
        F.concat_ws(":", F.col(src_ip), F.col(src_port).cast("string")),
        F.concat_ws(":", F.col(dst_ip), F.col(dst_port).cast("string")),
    )


def matches_any(name: Column, patterns: Iterable[str]) -> Column:
    """True when the text holds any pattern literally; no pattern matches nothing."""
    tests = [F.coalesce(F.contains(name, F.lit(p)), F.lit(False)) for p in patterns]
    return reduce(or_, tests, F.lit(False))


def base_file_name(name: Column) -> Column:
    """File name without a leading train_/val_/test_ part."""
    stripped = name
    for part in ("test", "val", "train"):
        stripped = F.when(F.startswith(name, F.lit(part)), F.substring_index(name, f"{part}_", -1)).otherwise(stripped)
    return stripped


def common_protocol(app: Column) -> Column:
    """DNS, NTP or STUN by label prefix, else NULL."""
    found = F.lit(None).cast("string")
    for name in K.COMMON_PROTOCOLS:
        found = F.when(F.startswith(app, F.lit(name)), F.lit(name)).otherwise(found)
    return found


def application_name(app: Column) -> Column:
    """Y of an X.Y label."""
    return F.substring_index(app, ".", -1)


def device_class(source_file: Column) -> Column:
    """`IoT_` and the category that starts the file name."""
    return F.concat(F.lit("IoT_"), F.substring_index(source_file, "_", 1))


def is_one_of(column: Column, values: Iterable[str]) -> Column:
    """Membership that is False, not NULL, for a missing value."""
    return F.coalesce(column.isin(*values), F.lit(False))
