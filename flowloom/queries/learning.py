"""Neighbour search, classifiers, reports, features and fidelity queries."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowloom.operators import classify as C, features as M, fidelity as E, knn as N, neighbour_graph as G, prepare as D, report as R
from flowloom.plans.storage import write_and_read
from flowloom.queries.inputs import classes, line_flows, lines_sql, table
from flowloom.queries.registry import query


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label")


def _neighbours(df):
    return df.select("query_id", "key_id", "rank", F.round("distance", 4).alias("distance"))


def _knn_sql(distance: str, k: int) -> str:
    return f"""
with v as (select vec_id, embedding::double[] as e, label from embeddings),
d as (select a.vec_id as query_id, b.vec_id as key_id, b.label, {distance} as distance from v a join v b on a.vec_id <> b.vec_id),
nn as (select *, (row_number() over (partition by query_id order by round(distance, 10), key_id))::integer as rank from d
  qualify rank <= {k})"""


_COS, _EUC = "list_cosine_distance(a.e, b.e)", "list_distance(a.e, b.e)"
_OUT = " select query_id, key_id, rank, round(distance, 4) as distance from nn"
_VOTED = """,
votes as (select query_id, label, count(*) as n, min(rank) as first from nn group by 1, 2),
voted as (select query_id, label as prediction from votes qualify row_number() over (partition by query_id order by n desc, first) = 1),
pairs as (select v.label, prediction from voted join v on vec_id = query_id)"""


@query("knn_cosine", _knn_sql(_COS, 3) + _OUT)
def knn_cosine(spark, sf):
    v = _vectors(spark, sf)
    return _neighbours(N.nearest(v, v, 3, label="label", skip_same=True))


@query("knn_cosine_blocks", _knn_sql(_COS, 3) + _OUT)
def knn_cosine_blocks(spark, sf):
    """The same search by pairs of blocks, as for keys too large to broadcast."""
    v = _vectors(spark, sf)
    return _neighbours(N.nearest(v, v, 3, label="label", skip_same=True, block_rows=256, broadcast_numbers=0))


@query("knn_euclid", _knn_sql(_EUC, 3) + _OUT)
def knn_euclid(spark, sf):
    v = _vectors(spark, sf)
    return _neighbours(N.nearest(v, v, 3, "euclidean", label="label", skip_same=True))


def _predicted(spark, sf, k=5):
    v = _vectors(spark, sf)
    voted = N.vote(N.nearest(v, v, k, label="label", skip_same=True))
    return voted.join(v.select(F.col("id").alias("query_id"), "label"), "query_id")


@query("knn_vote", _knn_sql(_COS, 5) + _VOTED + " select query_id, prediction from voted")
def knn_vote(spark, sf):
    return _predicted(spark, sf).select("query_id", "prediction")


@query("knn_lsh")
def knn_lsh(spark, sf):
    v = _vectors(spark, sf)
    return _neighbours(N.nearest_lsh(v, v, 3, label="label", skip_same=True, near_angle=None))


@query("knn_lsh_probing")
def knn_lsh_probing(spark, sf):
    v = _vectors(spark, sf)
    return _neighbours(N.nearest_lsh(v, v, 3, label="label", skip_same=True, search_epsilon=0.05, near_angle=None))


@query("confusion", _knn_sql(_COS, 5) + _VOTED + ' select label as "true", prediction as predicted, count(*) as n from pairs group by 1, 2')
def confusion(spark, sf):
    return R.confusion(_predicted(spark, sf))


@query("confusion_normalized", _knn_sql(_COS, 5) + _VOTED + """
select label as "true", prediction as predicted,
  round(count(*) / sum(count(*)) over (partition by label), 6)::double as share from pairs group by 1, 2""")
def confusion_normalized(spark, sf):
    return R.confusion(_predicted(spark, sf), normalize="true").withColumn("share", F.round("share", 6))


_PER_CLASS = """,
c as (select label as class from pairs union select prediction from pairs),
per as (select class, (select count(*) from pairs where label = class) as support,
  (select count(*) from pairs where prediction = class) as chosen,
  (select count(*) from pairs where prediction = class and label = class) as hit from c),
rep as (select class, case when chosen = 0 then 0 else hit / chosen end as precision,
  case when support = 0 then 0 else hit / support end as recall,
  case when support + chosen = 0 then 0 else 2 * hit / (support + chosen) end as f1, support, hit from per)"""


@query("clf_report", _knn_sql(_COS, 5) + _VOTED + _PER_CLASS + """,
full_rep as (
select class::varchar as class, precision, recall, f1, support from rep
union all select 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) from rep
union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from rep
union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), sum(support) from rep)
select class, round(precision, 6)::double as precision, round(recall, 6)::double as recall, round(f1, 6)::double as f1,
  support::bigint as support from full_rep""")
def clf_report(spark, sf):
    rep = R.classification_report(R.confusion(_predicted(spark, sf)))
    return rep.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("scores", _knn_sql(_COS, 5) + _VOTED + _PER_CLASS + """
select round(sum(hit) / sum(support), 6)::double as accuracy, round(avg(f1), 6)::double as f1_macro,
  round(sum(f1 * support) / sum(support), 6)::double as f1_weighted from rep""")
def scores(spark, sf):
    out = R.scores(R.confusion(_predicted(spark, sf)))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


# ---- features ----

@query("scale_onehot", """
with s as (select avg(c_acctbal) as m, stddev_pop(c_acctbal) as d from customer),
k as (select c_mktsegment, row_number() over (order by c_mktsegment) as i, count(*) over () as n from customer group by 1)
select c_custkey, round((c_acctbal - m) / d, 6)::double as scaled,
  array_to_string([case when j + 1 = i then 1 else 0 end for j in range(n)], ',') as onehot
from customer c join k on c.c_mktsegment = k.c_mktsegment cross join s""")
def scale_onehot(spark, sf):
    customer = table(spark, sf, "customer")
    config = M.FeatureConfig(continuous=["c_acctbal"], categorical=["c_mktsegment"], tcp_flags=False, fingerprints=False,
                             raw=False, target="c_nationkey")
    out = M.Featurizer(config).fit(customer).transform(customer).withColumn("v", vector_to_array("features"))
    return out.select("c_custkey", F.round(F.col("v")[0], 6).alias("scaled"), F.concat_ws(
        ",", F.transform(F.slice("v", F.lit(2), F.size("v")), lambda x: x.cast("int").cast("string"))).alias("onehot"))


@query("label_numbers", """
select c_custkey, dense_rank() over (order by c_mktsegment) - 1 as label from customer""")
def label_numbers(spark, sf):
    customer = table(spark, sf, "customer")
    encoder = M.label_encoder(customer, "c_mktsegment")
    return M.encode_labels(customer, encoder, "c_mktsegment").select("c_custkey", "label")


@query("batch_infer", """
select vec_id, round(list_avg(embedding::double[]), 5) as score, round(list_max(embedding)::double, 5) as top from embeddings""")
def batch_infer(spark, sf):
    """A user model on Arrow batches: here it returns mean and maximum."""
    def make():
        def predict(inputs: np.ndarray) -> np.ndarray:
            return np.stack([inputs.astype(np.float64).mean(axis=1), inputs.max(axis=1)], axis=1).astype(np.float32)
        return predict

    vectors = table(spark, sf, "embeddings")
    out = M.score_batches(vectors, make, "embedding", shapes=[[64]])
    return out.select("vec_id", F.round(F.col("scores")[0].cast("double"), 5).alias("score"),
                      F.round(F.col("scores")[1].cast("double"), 5).alias("top"))


@query("pooled_features", """
with w as (select vec_id, [embedding[1:16], embedding[17:32], embedding[33:48], embedding[49:64]] as p from embeddings)
select vec_id, round((p[1][i]::double + p[2][i]::double + p[3][i]::double + p[4][i]::double) / 4, 6) as pooled,
  round((p[2][i]::double + p[3][i]::double + p[4][i]::double) / 3, 6) as masked, (i - 1)::integer as i from w, range(1, 17) r(i)""")
def pooled_features(spark, sf):
    """Mean over positions of a (4, 16) sequence, whole and with the first position masked."""
    parts = F.array(*[F.slice("embedding", 16 * i + 1, 16) for i in range(4)])
    mask = F.array(*[F.lit(int(i > 0)) for i in range(4)])
    out = table(spark, sf, "embeddings").select("vec_id", F.posexplode(
        F.arrays_zip(M.mean_pooled(parts).alias("a"), M.mean_pooled(parts, mask).alias("b"))).alias("i", "x"))
    return out.select("vec_id", F.round(F.col("x.a"), 6).alias("pooled"), F.round(F.col("x.b"), 6).alias("masked"), "i")


# ---- classifiers ----

def _split(spark, sf):
    """Customers by market segment: the label follows from the features, so every classifier has to find it for the test rows."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment", (F.col("c_acctbal") / 100_000).alias("balance"))
    label = StringIndexer(inputCol="c_mktsegment", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    encoded = label.transform(rows)
    onehot = OneHotEncoder(inputCol="label", outputCol="segment", dropLast=False).fit(encoded).transform(encoded)
    data = VectorAssembler(inputCols=["segment", "balance"], outputCol="features").transform(onehot).select("id", "features", "label")
    stored = write_and_read(data, "split")
    return stored.filter("id % 4 <> 0"), stored.filter("id % 4 = 0")


_FOUND = """
with s as (select c_mktsegment, (row_number() over (order by c_mktsegment) - 1)::double as label from customer group by 1)
select c_custkey as id, label, label as prediction from customer join s using (c_mktsegment) where c_custkey % 4 = 0"""


def _classifier(name: str, **params):
    def run(spark, sf):
        train, test = _split(spark, sf)
        if params.get("balanced"):
            train = C.balanced_weights(train)
        model = C.CLASSIFIERS[name](**params).fit(train)
        return model.transform(test).select("id", "label", "prediction")
    return run


for _key, _name, _params in (
    ("classify_logreg", "LogisticRegression", {"maxIter": 100}),
    ("classify_logreg_balanced", "LogisticRegression", {"maxIter": 100, "balanced": True}),
    ("classify_ovr", "LogisticRegression", {"maxIter": 100, "one_vs_rest": True}),
    ("classify_svm", "OneVsOneClassifier", {"maxIter": 50}),
    ("classify_svm_ovr", "LinearSVC", {"maxIter": 50}),
    ("classify_tree", "DecisionTreeClassifier", {"maxDepth": 6}),
    ("classify_forest", "RandomForestClassifier", {"numTrees": 50}),
    ("classify_gbt", "GradientBoostingClassifier", {"maxIter": 10, "maxDepth": 3}),
    ("classify_mlp", "MLPClassifier", {"layers": [6, 32, 5], "maxIter": 200}),
    ("classify_knn", "KNeighborsCosineClassifier", {"nNeighbors": 3, "idCol": "id"}),
    ("classify_knn_lsh", "KNeighborsPuffinnClassifier", {"nNeighbors": 1, "idCol": "id"}),
    ("classify_knn_probing", "KNeighborsNGTClassifier", {"nNeighbors": 1, "idCol": "id", "searchEpsilon": 0.02}),
):
    query(_key, _FOUND)(_classifier(_name, **_params))


@query("knn_lsh_recall", "select count(*) as queries, true as reached from customer where c_custkey % 4 = 0")
def knn_lsh_recall(spark, sf):
    """Hash tables chosen from a recall target find the exact nearest keys of customers."""
    keys, queries = _split(spark, sf)
    exact = N.nearest(queries, keys)
    found = N.nearest_lsh(queries, keys, recall_target=0.995)
    recall = N.recall(found, exact).withColumn("queries", F.lit(queries.count()).cast("long"))
    return recall.select("queries", (F.col("recall") >= 0.995).alias("reached"))


@query("knn_lsh_recall_embeddings", """
select setting, count(*) as queries, true as reached from embeddings, (values ('plain'), ('probing')) s(setting) group by 1""")
def knn_lsh_recall_embeddings(spark, sf):
    """Both registered searches over embeddings find nine in ten of the exact nearest keys."""
    v = _vectors(spark, sf)
    exact = write_and_read(N.nearest(v, v, 3, label="label", skip_same=True), "exact")
    parts = [
        N.recall(search(spark, sf), exact).select(
            F.lit(name).alias("setting"), F.lit(v.count()).cast("long").alias("queries"), (F.col("recall") >= 0.9).alias("reached"))
        for name, search in (("plain", knn_lsh), ("probing", knn_lsh_probing))
    ]
    return parts[0].unionByName(parts[1])


def _graph_walk(spark, sf):
    """The graph over all vectors, and the walks of every twentieth of them."""
    v = _vectors(spark, sf)
    graph, asked = G.build(v, label="label"), v.filter("id % 20 = 0")
    return graph, asked, G.walk(graph, asked, 3, skip_same=True, recall_target=0.92, best=3)


@query("knn_graph")
def knn_graph(spark, sf):
    graph, _, met = _graph_walk(spark, sf)
    return _neighbours(G.best_of(graph, met, 3))


@query("knn_graph_recall", """
select count(*) filter (where vec_id % 20 = 0) as queries, (count(*) filter (where vec_id % 20 = 0) * (count(*) - 1))::bigint as all_pairs,
  true as reached, true as under_half from embeddings""")
def knn_graph_recall(spark, sf):
    """Walks find nine in ten of the exact nearest keys and measure fewer than half of all pairs."""
    graph, asked, met = _graph_walk(spark, sf)
    exact = N.nearest(asked, _vectors(spark, sf), 3, label="label", skip_same=True)
    found = N.recall(G.best_of(graph, met, 3), exact)
    n, pairs = asked.count(), met.agg(F.coalesce(F.sum("measured"), F.lit(0))).first()[0]
    every = n * (graph.keys.count() - 1)
    return found.select(F.lit(n).cast("long").alias("queries"), F.lit(every).cast("long").alias("all_pairs"), (F.col("recall") >= 0.9).alias("reached"), F.lit(2 * pairs < every).alias("under_half"))


@query("classify_grid", _FOUND)
def classify_grid(spark, sf):
    """The best of several trees by cross-validation."""
    train, test = _split(spark, sf)
    space = {"maxDepth": [1, 3, 6, 9], "impurity": ["gini", "entropy"]}
    found = C.search_parameters(C.CLASSIFIERS["DecisionTreeClassifier"](), space, train, ["id"])
    return found.transform(test).select("id", "label", "prediction")


@query("classify_report", """
with s as (select c_mktsegment, (row_number() over (order by c_mktsegment) - 1)::double as label from customer group by 1),
base as (select label from customer join s using (c_mktsegment) where c_custkey % 4 = 0),
classes as (
  select label::varchar as class, count(*) as support from base group by 1
  union all select name, (select count(*) from base) from (values ('accuracy'), ('macro avg'), ('weighted avg')) n(name))
select model, class, 1.0::double as precision, 1.0::double as recall, 1.0::double as f1, support::bigint as support
from classes, (values ('tree'), ('logistic')) m(model)""")
def classify_report(spark, sf):
    """Every configured classifier fitted and reported on in one call."""
    train, test = _split(spark, sf)
    settings = {"tree": {"type": "DecisionTreeClassifier", "params": {"max_depth": 6}},
                "logistic": {"type": "LogisticRegression", "params": {"max_iter": 100, "C": 100.0}}}
    reports = [r.withColumn("model", F.lit(name)) for name, r in C.train_and_report(train, test, settings, ["id"]).items()]
    return reports[0].unionByName(reports[1])


# ---- fidelity ----

def _sides(spark, sf):
    """Orders of status P against all others, by class; stored once because several passes follow."""
    status = table(spark, sf, "orders").select(F.col("o_orderkey").alias("flow_id"), "o_orderstatus")
    flows = write_and_read(line_flows(spark, sf).join(classes(spark, sf), "flow_id").join(status, "flow_id"), "flows")
    return flows.filter("o_orderstatus <> 'P'").drop("o_orderstatus"), flows.filter("o_orderstatus = 'P'").drop("o_orderstatus")


def _tagged(spark, sf):
    src, gen = _sides(spark, sf)
    return src.withColumn("side", F.lit("src")).unionByName(gen.withColumn("side", F.lit("gen")))


_SIDES = """
tagged as (select pl.*, o_orderpriority as target_class, case when o_orderstatus = 'P' then 'gen' else 'src' end as side
  from pl join orders on o_orderkey = flow_id),
clocked as (select *, sum(ipt) over (partition by flow_id order by pos rows unbounded preceding) as clock from tagged),
iats as (select *, case when ps > 0 then 'client' else 'server' end as direction,
  coalesce(clock - lag(clock) over (partition by flow_id, dir order by pos), 0)::double as iat from clocked),
virtual as (select *, sum(iat) over (partition by target_class, side, direction order by flow_id, pos rows unbounded preceding) as t from iats),
rates as (select target_class, side, direction, floor(t / 1000)::bigint as bin, sum(ps) as bytes from virtual group by 1, 2, 3, 4),
bins as (select target_class, side, direction, sum(bytes) as bytes, max(bin) - min(bin) + 1 as bins, count(*) as filled from rates group by 1, 2, 3),
raw_samples as (
  select target_class, side, 'packets_per_flow' as series, count(*)::double as value, 1 as w from tagged group by target_class, side, flow_id
  union all select target_class, side, 'PS_' || direction, ps, 1 from iats
  union all select target_class, side, 'IAT_' || direction, iat, 1 from iats
  union all select target_class, side, 'thrpt_' || direction, bytes, 1 from rates
  union all select target_class, side, 'thrpt_' || direction, 0, bins - filled from bins where bins > filled),
samples as (select target_class, side, series, value, sum(w)::double as weight from raw_samples group by 1, 2, 3, 4),
m1 as (select target_class, series, side, sum(weight) as n, max(value) as top, sum(value * weight) / sum(weight) as mean from samples group by 1, 2, 3),
m2 as (select s.target_class, s.series, s.side, any_value(n) as n, any_value(top) as top,
  sqrt(sum(weight * (value - mean) ** 2) / nullif(any_value(n) - 1, 0)) * any_value(n) ** -0.2 as h
  from samples s join m1 on s.target_class = m1.target_class and s.series = m1.series and s.side = m1.side group by 1, 2, 3),
dens as (select s.target_class, s.series, s.side, i, sum(weight * exp(-(((top * i / 99.0 - value) / h) ** 2) / 2)) as d
  from samples s join m2 on s.target_class = m2.target_class and s.series = m2.series and s.side = m2.side, range(100) r(i)
  where h > 0 group by 1, 2, 3, 4),
kdes as (select target_class, series, side, i, d / sum(d) over (partition by target_class, series, side) as p from dens),
both_kde as (select a.target_class, a.series, a.i, a.p as src, b.p as gen from kdes a join kdes b
  on a.target_class = b.target_class and a.series = b.series and a.i = b.i and a.side = 'src' and b.side = 'gen'),
vals as (select target_class, series, value, coalesce(sum(weight) filter (side = 'src'), 0) as src,
  coalesce(sum(weight) filter (side = 'gen'), 0) as gen from samples group by 1, 2, 3),
cum as (select *, sum(src) over w as c_src, sum(gen) over w as c_gen, sum(src) over g as n_src, sum(gen) over g as n_gen from vals
  window w as (partition by target_class, series order by value rows unbounded preceding), g as (partition by target_class, series)),
pts as (select target_class, series, p,
  min(case when c_src > floor(p / 100.0 * (n_src - 1)) then value end) as s_lo, min(case when c_src > ceil(p / 100.0 * (n_src - 1)) then value end) as s_hi,
  min(case when c_gen > floor(p / 100.0 * (n_gen - 1)) then value end) as g_lo, min(case when c_gen > ceil(p / 100.0 * (n_gen - 1)) then value end) as g_hi,
  max(p / 100.0 * (n_src - 1) - floor(p / 100.0 * (n_src - 1))) as s_f, max(p / 100.0 * (n_gen - 1) - floor(p / 100.0 * (n_gen - 1))) as g_f
  from cum, (values (10), (50), (90)) q(p) group by 1, 2, 3),
pct as (select target_class, series, p, s_lo + s_f * (s_hi - s_lo) as src, g_lo + g_f * (g_hi - g_lo) as gen from pts),
kl as (select target_class, series, sum(case when src = 0 then 0 when gen = 0 then 'infinity'::double else src * ln(src / gen) end) as value
  from both_kde group by 1, 2),
ks as (select target_class, series, max(abs(c_src / n_src - c_gen / n_gen)) as value from cum group by 1, 2)"""

_KEYS = ["target_class", "series"]


@query("throughput_1s", lines_sql("select target_class, side, direction, bin, bytes from rates", more=_SIDES))
def throughput_1s(spark, sf):
    return E.throughput(_tagged(spark, sf), ["target_class", "side"], "flow_id").withColumn("bin", F.col("bin").cast("long"))


@query("mean_throughput", lines_sql(
    "select target_class, side, direction, round(bytes / bins, 6)::double as value from bins", more=_SIDES))
def mean_throughput(spark, sf):
    rates = E.throughput(_tagged(spark, sf), ["target_class", "side"], "flow_id")
    return E.mean_throughput(rates, ["target_class", "side", "direction"]).withColumn("value", F.round("value", 6))


def _packet_series(spark, sf):
    """Sizes and same-direction gaps as one weighted relation."""
    packets = E.directed_packets(_tagged(spark, sf), ["target_class", "side"], "flow_id")
    rows = packets.select("target_class", "side", F.explode(F.array(
        F.struct(F.concat(F.lit("PS_"), "direction").alias("series"), F.col("ps").alias("value")),
        F.struct(F.concat(F.lit("IAT_"), "direction").alias("series"), F.col("iat").alias("value")))).alias("s")).select(
        "target_class", "side", "s.series", "s.value")
    return E.weighted(rows, _KEYS)


_PACKETS_ONLY = "where series like 'PS%' or series like 'IAT%'"


@query("kde", lines_sql(f"select target_class, series, side, i::integer as i, round(p, 9)::double as p from kdes {_PACKETS_ONLY}", more=_SIDES))
def kde(spark, sf):
    return E.kde(_packet_series(spark, sf), _KEYS).withColumn("p", F.round("p", 9))


@query("kl", lines_sql(f"select target_class, series, round(value, 6)::double as value from kl {_PACKETS_ONLY}", more=_SIDES))
def kl(spark, sf):
    return E.kl_divergence(E.kde(_packet_series(spark, sf), _KEYS), _KEYS).withColumn("value", F.round("value", 6))


@query("ks", lines_sql(f"select target_class, series, round(value, 9)::double as value from ks {_PACKETS_ONLY}", more=_SIDES))
def ks(spark, sf):
    return E.ks_statistic(E.cumulated(_packet_series(spark, sf), _KEYS), _KEYS).withColumn("value", F.round("value", 9))


@query("wasserstein", lines_sql("""
select a.target_class, a.series, round(avg(abs(a.p - b.p)), 9)::double as value from ranked a join ranked b
  on a.target_class = b.target_class and a.series = b.series and a.r = b.r and a.side = 'src' and b.side = 'gen'
where a.series like 'PS%' or a.series like 'IAT%' group by 1, 2""", more=_SIDES + """,
ranked as (select *, row_number() over (partition by target_class, series, side order by p) as r from kdes)"""))
def wasserstein(spark, sf):
    return E.wasserstein(E.kde(_packet_series(spark, sf), _KEYS), _KEYS).withColumn("value", F.round("value", 9))


@query("pctl_diff", lines_sql(f"""
select target_class, series, p::integer as percentile, round(src, 6)::double as src, round(gen, 6)::double as gen,
  round(abs(src - gen) / nullif(src, 0), 6)::double as value from pct {_PACKETS_ONLY}""", more=_SIDES))
def pctl_diff(spark, sf):
    out = E.scaled_differences(E.cumulated(_packet_series(spark, sf), _KEYS), _KEYS)
    return out.select(*_KEYS, "percentile", *[F.round(c, 6).alias(c) for c in ("src", "gen", "value")])


@query("fidelity_report", lines_sql("""
select target_class, metric, round(value, 5)::double as value from (
  select target_class, 'KL_' || series as metric, value from kl
  union all select target_class, 'KS_2sample_' || series, value from ks
  union all select target_class, p || 'th_percentile_' || series, abs(src - gen) / nullif(src, 0) from pct
  union all select target_class, side || '_avg_throughput_bytes_per_s_' || direction, bytes / bins from bins
  union all select target_class, 'n_flows', least(count(distinct flow_id) filter (side = 'src'),
    count(distinct flow_id) filter (side = 'gen')) from tagged group by 1) x""", more=_SIDES))
def fidelity_report(spark, sf):
    return E.fidelity_report(*_sides(spark, sf)).withColumn("value", F.round("value", 5))
