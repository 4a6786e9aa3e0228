"""Packet filters and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowloom import constants as K
from flowloom.functions.columns import in_network


def without_icmp(packets: DataFrame) -> DataFrame:
    return packets.filter(F.col("protocol") != 1)


def unicast_traffic(packets: DataFrame) -> DataFrame:
    """Without ICMP, ICMPv6, broadcast, multicast and loopback traffic; ARP never becomes an IP packet."""
    src, dst = F.col("src_ip"), F.col("dst_ip")
    broadcast = dst == "255.255.255.255"
    multicast = in_network(dst, "224.0.0.0/4") | F.startswith(F.lower(dst), F.lit("ff"))
    if "dst_mac" in packets.columns:
        mac = F.lower(F.coalesce(F.col("dst_mac"), F.lit("")))
        broadcast = broadcast | (mac == "ff:ff:ff:ff:ff:ff")
        multicast = multicast | F.startswith(mac, F.lit("01:00:5e")) | F.startswith(mac, F.lit("33:33"))
    loopback = in_network(src, "127.0.0.0/8") | in_network(dst, "127.0.0.0/8")
    return packets.filter(~F.col("protocol").isin(1, 58) & ~broadcast & ~multicast & ~loopback)


def inside_network(cidr: str) -> Column:
    """Both ends in one network."""
    return in_network(F.col("src_ip"), cidr) & in_network(F.col("dst_ip"), cidr)


def without_local_traffic(packets: DataFrame, cidr: str = K.HOME_LAN) -> DataFrame:
    return unicast_traffic(packets.filter(~inside_network(cidr)))


def device_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.DEVICES), "mac string, device_name string, device_category string")


def split_by_devices(packets: DataFrame, devices: DataFrame, cidr: str = K.DEVICE_LAN) -> DataFrame:
    """Each packet once per known device that sends or receives it, without traffic inside the local network.

    Two lookups on the unique MAC and an in-row explode: no shuffle while the device table is small enough for
    Spark to broadcast, and no duplicate removal.
    """
    known = unicast_traffic(packets.filter(~inside_network(cidr)))
    for side in ("src", "dst"):
        table = devices.select(
            F.col("mac").alias(f"__{side}"),
            F.struct("device_category", "device_name").alias(f"__{side}_device"),
        )
        known = known.join(table, F.col(f"{side}_mac") == F.col(f"__{side}"), "left")
    found = F.array_distinct(F.filter(F.array("__src_device", "__dst_device"), lambda d: d.isNotNull()))
    return known.select(*packets.columns, F.explode(found).alias("__device")).select(
        *packets.columns, F.col("__device.device_category").alias("device_category"),
        F.col("__device.device_name").alias("device_name"),
    )


def merge_captures(*captures: DataFrame) -> DataFrame:
    """All packets of several captures; order by (ts, seq) where an order is needed."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), captures)


def multi_packet_flows(flows: DataFrame, packets: str = "packets", strict_reference: bool = False) -> DataFrame:
    """Flows with two packets or more.

    `strict_reference` keeps every flow whose second size is not 0, which also keeps single-packet flows.
    """
    if strict_reference:
        second = F.get(F.col(packets), F.lit(1))["ps"]
        return flows.filter(second.isNull() | (second != 0))
    return flows.filter(F.size(packets) >= 2)


def present_packets(series: DataFrame) -> DataFrame:
    """Without absent, NaN and infinite packets."""
    def finite(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))

    return series.filter(finite("ps") & finite("ipt"))
