"""Plug-ins: states of tasks merged into flows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import plugins as U


class Spread(U.FlowPlugin):
    """Packets, bytes and the longest time between neighbours of a flow's largest packets."""

    columns = ("size",)
    result = "n long, bytes double, span_us long"

    def init(self):
        return 0, 0.0, None, None

    def update(self, state, packets):
        t = packets["t"]
        return self.merge(state, (len(t), float(np.nansum(packets["size"])), int(t[0]), int(t[-1])))

    def merge(self, a, b):
        low, high = [x for x in (a[2], b[2]) if x is not None], [x for x in (a[3], b[3]) if x is not None]
        return a[0] + b[0], a[1] + b[1], min(low), max(high)

    def finish(self, state):
        return state[0], state[1], state[3] - state[2]


def packets(spark, n=4000, seed=1):
    """A third of all packets in one flow, ties in time, absent sizes and absent keys."""
    rng = random.Random(seed)
    rows = [("hot" if i % 3 == 0 else None if i % 50 == 1 else f"f{rng.randrange(300)}", rng.randrange(5), rng.randrange(500), i,
             None if i % 17 == 0 else rng.randrange(1500)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "name string, no long, ms long, seq long, size int").withColumn("ts", F.timestamp_millis("ms"))


@pytest.mark.parametrize("parts, max_open", [(1, 50_000), (7, 50_000), (7, 3)])
def test_states_merge_to_the_whole(spark, parts, max_open):
    rows, table = packets(spark)
    flows = {}
    for name, no, ms, seq, size in rows:
        flows.setdefault((name, no), []).append((ms * 1000, seq, size))
    table = table.repartition(parts)
    got = {(r["name"], r.no): r for r in U.apply_plugin(table, ["name", "no"], Spread(), max_open=max_open).collect()}
    assert got.keys() == flows.keys()
    first = {(r["name"], r.no): r for r in U.apply_plugin(table, ["name", "no"], U.FirstPackets(["size"], 6), max_open=max_open).collect()}
    for key, items in flows.items():
        items.sort(key=lambda x: x[:2])
        assert (got[key].n, got[key].bytes, got[key].span_us) == (len(items), sum(s or 0 for *_, s in items), items[-1][0] - items[0][0])
        assert first[key].t == [t for t, *_ in items[:6]] and first[key]["size"] == [s for *_, s in items[:6]]


def test_empty_and_clashing(spark):
    table = packets(spark, 10)[1]
    assert U.apply_plugin(table.limit(0), ["name"], Spread()).columns == ["name", "n", "bytes", "span_us"]
    assert U.apply_plugin(table.where("false"), ["name"], Spread()).count() == 0
    assert U.apply_plugin(table.withColumn("ts", F.lit(None).cast("timestamp")), ["name"], Spread()).count() == 0
    with pytest.raises(ValueError):
        U.apply_plugin(table.withColumnRenamed("name", "t"), ["t"], Spread())
