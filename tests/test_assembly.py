"""Flow assembly on hand-made packets and against a plain loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from flowloom.functions import arrays as X
from flowloom.functions.columns import in_network, with_protocol_name
from flowloom.operators import assemble as A, flowstats as G, packets as P
from flowloom.schema import PACKETS, absent_to_null

T0 = dt.datetime(2024, 1, 1)


def packet(ms, src=("10.0.0.1", 1000), dst=("10.0.0.2", 80), proto=6, version=4, size=100, payload=60, win=5, flags=2, seq=None, **more):
    row = dict(src_mac="a", dst_mac="b", src_ip=src[0], dst_ip=dst[0], src_port=src[1], dst_port=dst[1], protocol=proto,
               ip_version=version, ts=T0 + dt.timedelta(milliseconds=ms), seq=ms if seq is None else seq, ip_size=size,
               payload_size=payload, tcp_window=win, tcp_flags=flags, source_file="f")
    row.update(more)
    return row


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in PACKETS.fields) for r in rows], PACKETS)


def loop_flows(times_us, idle_us, active_us):
    out, start, last, no = [], None, None, 0
    for t in sorted(times_us):
        if start is None or (idle_us is not None and t - last > idle_us):
            start, no = t, no + 1
        elif active_us is not None and t - start > active_us:
            start, no = t, no + 1
        last = t
        out.append((t, no, start))
    return out


def assigned(spark, rows, config):
    flows = A.assign_flows(A.with_flow_key(frame(spark, rows)), A.KEY, config)
    return {r["seq"]: (r["flow_no"], r["flow_start_us"]) for r in flows.collect()}


def test_idle_gap_equal_to_timeout_stays(spark):
    got = assigned(spark, [packet(0), packet(60_000), packet(120_001)], A.FlowConfig(60, None))
    assert [got[s][0] for s in (0, 60_000, 120_001)] == [1, 1, 2]


def test_active_timeout_cuts_twice(spark):
    rows = [packet(ms) for ms in range(0, 130_000, 7_000)]
    got = assigned(spark, rows, A.FlowConfig(60, 50))
    expected = loop_flows([r["ts"].timestamp() * 1e6 for r in rows], 60e6, 50e6)
    assert [v[0] for _, v in sorted(got.items())] == [e[1] for e in expected]
    assert max(v[0] for v in got.values()) == 3


@pytest.mark.parametrize("fold_limit", [16384, 0])
@pytest.mark.parametrize("idle,active", [(60, 60), (60, 600), (None, 45), (20, 45), (60, None)])
def test_random_traffic_matches_loop(spark, idle, active, fold_limit):
    rng = random.Random(f"{idle}{active}")
    rows, seq = [], 0
    for host in range(4):
        at = 0
        for _ in range(150 if host else 400):
            at += rng.choice([0, 3, 900, 7_000, 19_999, 20_000, 20_001, 45_000, 59_000, 60_000, 60_001, 90_000])
            seq += 1
            there, back = ("10.0.0.1", 1000 + host), ("10.0.0.2", 80)
            src, dst = (there, back) if rng.random() < 0.5 else (back, there)
            rows.append(packet(at, src, dst, seq=seq))
    got = assigned(spark, rows, A.FlowConfig(idle, active, fold_limit=fold_limit))
    for host in range(4):
        own = [r for r in rows if 1000 + host in (r["src_port"], r["dst_port"])]
        times = [int((r["ts"] - T0).total_seconds() * 1e6 + 0.5) for r in own]
        base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
        expected = loop_flows(times, None if idle is None else idle * 1e6, None if active is None else active * 1e6)
        for r, (t, no, start) in zip(sorted(own, key=lambda r: (r["ts"], r["seq"])), expected):
            assert got[r["seq"]] == (no, base + start)


def test_direction_and_series(spark):
    c, s = ("10.0.0.9", 5000), ("10.0.0.2", 80)
    rows = [packet(0, c, s, size=60), packet(10, s, c, size=70), packet(10, s, c, size=80, seq=11), packet(35, c, s, size=90)]
    got = A.flow_packets(frame(spark, rows), A.FlowConfig(packet_limit=3)).orderBy("pos").collect()
    assert [r["ps"] for r in got] == [60.0, -70.0, -80.0]
    assert [r["ipt"] for r in got] == [0.0, 10.0, 0.0]
    ids = A.flow_identifiers(A.flow_packets(frame(spark, rows))).first()
    assert ids["flow_id"] == "TCP 10.0.0.9:5000 10.0.0.2:80"


def test_window_and_flags_only_for_ipv4_tcp(spark):
    rows = [packet(0), packet(1, version=6, src=("10.0.0.3", 1)), packet(2, proto=17, src=("10.0.0.4", 1))]
    got = {(r["protocol"], r["ip_version"]): (r["win"], r["flag"]) for r in A.flow_packets(frame(spark, rows)).collect()}
    assert got == {(6, 4): (5.0, 2), (6, 6): (0.0, 0), (17, 4): (0.0, 0)}


def test_unknown_protocol(spark):
    got = with_protocol_name(spark.createDataFrame([(200,), (6,), (84,)], "protocol int")).collect()
    assert {r["protocol"]: r["ip_proto"] for r in got} == {200: "UNKNOWN", 6: "TCP", 84: "TTP |IPTM"}


def test_one_direction_statistics(spark):
    rows = [packet(0, size=100, payload=0, flags=2), packet(5, size=300, payload=200, flags=16), packet(9, size=200, payload=0, flags=2)]
    got = G.flow_stats(A.flow_packets(frame(spark, rows)), A.FLOW).first().asDict()
    assert got["client_packet0"] == 100 and got["client_packet1"] == 300
    assert got["client_packet_median"] == 200 and got["client_packet_25q"] == 150
    assert got["client_bulk_number"] == 1 and got["client_found_tcp_flags"] == [2, 16]
    assert got["server_packet_avg"] == 0 and got["server_packet1"] == 0 and got["server_found_tcp_flags"] == []


def test_single_packet_has_no_second_value(spark):
    got = G.flow_stats(A.flow_packets(frame(spark, [packet(0)])), A.FLOW).first().asDict()
    assert got["client_packet0"] == 100 and got["client_packet1"] is None


def test_user_feature_function(spark):
    from flowloom.functions.stats import FEATURES

    mine = {**FEATURES, "_range": lambda s: F.max(s.own()) - F.min(s.own())}
    rows = [packet(0, size=100), packet(5, size=300)]
    got = G.flow_stats(A.flow_packets(frame(spark, rows)), A.FLOW, features=mine).first()
    assert got["client_packet_range"] == 200


def test_sequence_statistics_sign_and_reuse(spark):
    flows = spark.createDataFrame([(1, [(100.0, 0.0), (-50.0, 3.0), (0.0, 1.0)]), (2, [])],
                                  "flow_id int, packets array<struct<ps:double,ipt:double>>")
    a = G.stats_from_sequences(flows, ["flow_id"]).orderBy("flow_id").collect()
    assert a[0]["client_packet_sum"] == 100 and a[0]["server_packet_sum"] == 50 and a[1]["client_packet_sum"] == 0
    b = G.stats_from_sequences(flows, ["flow_id"], positive_is_client=False).orderBy("flow_id").first()
    assert b["server_packet_sum"] == 100
    again = G.stats_from_sequences(G.stats_from_sequences(flows, ["flow_id"]), ["flow_id"])
    assert again.columns == G.stats_from_sequences(flows, ["flow_id"]).columns


def test_first_packets_and_partition_independence(spark):
    rows = [packet(i * 10, seq=i) for i in range(50)]
    one = A.flow_packets(frame(spark, rows).coalesce(1)).select("seq", "pos", "ipt").orderBy("seq").collect()
    many = A.flow_packets(frame(spark, rows).repartition(8)).select("seq", "pos", "ipt").orderBy("seq").collect()
    assert one == many and len(one) == 20


def test_iat_and_gaps(spark):
    df = spark.createDataFrame([([(10.0, 0.0), (-5.0, 2.0), (7.0, 3.0), (0.0, 1.0), (-1.0, 4.0)], [1.0, 4.0, 9.0], [])],
                               "p array<struct<ps:double,ipt:double>>, t array<double>, e array<double>")
    row = df.select(X.ipt_to_iat(F.col("p")).alias("iat"), X.gaps(F.col("t")).alias("g"), X.gaps(F.col("e")).alias("e")).first()
    assert [(r["ps"], r["iat"]) for r in row["iat"]] == [(10.0, 0.0), (-5.0, 0.0), (7.0, 5.0), (-1.0, 8.0)]
    assert row["g"] == [0.0, 3.0, 5.0] and row["e"] == []


def test_wide_round_trip_and_absent_values(spark):
    df = spark.createDataFrame([(1, [(10.0, 0.0), (-5.0, 2.0)])], "id int, p array<struct<ps:double,ipt:double>>")
    wide = df.select("id", *X.to_wide(F.col("p"), 3))
    assert wide.columns[1:] == ["raw_packet0", "raw_iat0", "raw_packet1", "raw_iat1", "raw_packet2", "raw_iat2"]
    assert wide.first()["raw_packet2"] is None
    back = wide.select(X.from_wide(3).alias("p")).first()["p"]
    assert [(r["ps"], r["ipt"]) for r in back] == [(10.0, 0.0), (-5.0, 2.0)]
    odd = spark.createDataFrame([(float("nan"), float("inf"), 1.0)], "a double, b double, c double")
    assert tuple(absent_to_null(odd).first()) == (None, None, 1.0)


def test_networks(spark):
    ips = ["192.168.1.7", "192.168.10.1", "224.0.0.1", "239.9.9.9", "240.0.0.1", "127.1.1.1", "fe80::1"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    hit = lambda cidr: [r["ip"] for r in df.filter(in_network(F.col("ip"), cidr)).collect()]
    assert hit("192.168.1.0/24") == ["192.168.1.7"]
    assert hit("224.0.0.0/4") == ["224.0.0.1", "239.9.9.9"]
    assert hit("127.0.0.0/8") == ["127.1.1.1"]
    assert hit("192.168.0.0/20") == ["192.168.1.7", "192.168.10.1"]


def test_capture_filter(spark):
    rows = [packet(0), packet(1, proto=1), packet(2, proto=58), packet(3, dst=("255.255.255.255", 1)), packet(4, dst=("224.0.0.5", 1)),
            packet(5, src=("127.0.0.1", 1)), packet(6, dst_mac="ff:ff:ff:ff:ff:ff"), packet(7, dst=("ff02::1", 1), version=6)]
    assert [r["seq"] for r in P.unicast_traffic(frame(spark, rows)).collect()] == [0]


def test_device_split_without_duplicates(spark):
    hub, cam = "d0:52:a8:00:67:5e", "30:8c:fb:2f:e4:b2"
    rows = [packet(0, src_mac=hub, dst_mac=cam), packet(1, src_mac=hub, dst_mac=hub), packet(2, src_mac="x", dst_mac="y"),
            packet(3, src_mac=hub, src=("192.168.1.2", 1), dst=("192.168.1.3", 2))]
    got = P.split_by_devices(frame(spark, rows), P.device_table(spark)).select("seq", "device_category").collect()
    assert sorted(map(tuple, got)) == [(0, "camera"), (0, "hub"), (1, "hub")]


def test_multi_packet_and_present(spark):
    flows = spark.createDataFrame([(1, [(1.0, 0.0)]), (2, [(1.0, 0.0), (2.0, 1.0)]), (3, [(1.0, 0.0), (0.0, 1.0)])],
                                  "id int, packets array<struct<ps:double,ipt:double>>")
    assert [r["id"] for r in P.multi_packet_flows(flows).collect()] == [2, 3]
    assert [r["id"] for r in P.multi_packet_flows(flows, strict_reference=True).collect()] == [1, 2]
    series = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (float("nan"), 1.0), (1.0, float("inf"))], "ps double, ipt double")
    assert P.present_packets(series).count() == 1


def test_user_plugin_sees_packets_in_order(spark):
    import pandas as pd

    rows = [packet(0, size=100), packet(5, size=300), packet(9, size=50)]
    series = A.flow_packets(frame(spark, rows).repartition(3))
    plugin = lambda p: pd.DataFrame({"flow_no": [p["flow_no"].iloc[0]], "sizes": [p["ps"].tolist()]})
    got = G.apply_per_flow(series, A.FLOW, plugin, "flow_no long, sizes array<double>").first()
    assert got["sizes"] == [100.0, 300.0, 50.0]


def test_known_rows_bound_the_packets_of_a_task(spark, monkeypatch):
    """A known number of rows sets the partitions of the statistics, whatever Spark's setting is; results stay."""
    rows = [packet(10 * i, ("10.0.0.1", 1000 + i % 150), ("10.0.0.2", 80), seq=i, size=40 + i % 900) for i in range(900)]
    series = A.flow_packets(frame(spark, rows))
    monkeypatch.setattr(G, "TASK_ROWS", 30)
    bounded = G.flow_stats(series, A.FLOW, rows=len(rows))
    assert bounded.rdd.getNumPartitions() == 30
    as_rows = lambda df: sorted(map(str, df.collect()))
    assert as_rows(bounded) == as_rows(G.flow_stats(series, A.FLOW))
