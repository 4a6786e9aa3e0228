"""Quantiser, tokeniser and Markov queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from flowloom import constants as K
from flowloom.functions import arrays as X
from flowloom.operators import markov as M, quantize as Q, tokens as T
from flowloom.operators.value_clusters import ValueClusters
from flowloom.plans.storage import write_and_read
from flowloom.queries.inputs import classes, line_flows, line_packets, lines_sql, table
from flowloom.queries.registry import query

_SIZES, _GAPS = (-0.75, -0.25, 0.25, 0.75), (0.0, 2.0, 3.2)


def small_codebook(spark):
    return Q.Codebook(spark, np.array([[x, y] for x in _SIZES for y in _GAPS]))


def large_codebook(spark):
    return Q.Codebook(spark, np.array([[i / 15 - 1, j / 2] for i in range(31) for j in range(10)]))


def grid_codebook(spark):
    """As many centres as the default codebook has."""
    return Q.Codebook(spark, np.array([[i / 64 - 1, j / 25] for i in range(128) for j in range(128)]))


_SCALED = """
scaled as (select flow_id, pos, ps, ipt, ps / 1500.0 as s_ps,
  case when abs(ipt) <= 1e-8 then 0 else log10(ipt) end as s_ipt from pl)"""
_SMALL = _SCALED + """,
book as (select (row_number() over (order by x, y) - 1)::integer as id, x::double as x, y::double as y
  from (values (-0.75),(-0.25),(0.25),(0.75)) a(x), (values (0.0),(2.0),(3.2)) b(y)),
coded as (select flow_id, pos, ps, ipt, s_ps, s_ipt,
  arg_min(id, {d: (s_ps - x) * (s_ps - x) + (s_ipt - y) * (s_ipt - y), i: id}) as cluster_id
  from scaled, book group by all)"""
_LARGE = _SCALED + """,
book as (select (i * 10 + j)::integer as id, i / 15.0::double - 1 as x, j / 2.0::double as y from range(31) a(i), range(10) b(j)),
coded as (select flow_id, pos, arg_min(id, {d: (s_ps - x) * (s_ps - x) + (s_ipt - y) * (s_ipt - y), i: id}) as cluster_id
  from scaled, book group by all)"""


@query("packet_scale", lines_sql("select flow_id, pos, round(s_ps, 6) as s_ps, round(s_ipt, 6)::double as s_ipt from scaled",
                                 more=_SCALED))
def packet_scale(spark, sf):
    return Q.scale_packets(line_packets(spark, sf)).select(
        "flow_id", "pos", F.round("s_ps", 6).alias("s_ps"), F.round("s_ipt", 6).alias("s_ipt"))


@query("packet_unscale", lines_sql("""
select flow_id, pos, round(s_ps * 1500, 4)::double as ps,
  round(case when abs(s_ipt) <= 1e-3 then 0 else pow(10, s_ipt) end, 4)::double as ipt from scaled""", more=_SCALED))
def packet_unscale(spark, sf):
    scaled = Q.scale_packets(line_packets(spark, sf)).select("flow_id", "pos", "s_ps", "s_ipt")
    return Q.unscale_packets(scaled).select("flow_id", "pos", F.round("ps", 4).alias("ps"), F.round("ipt", 4).alias("ipt"))


@query("quantize", lines_sql("select flow_id, pos, cluster_id from coded", more=_SMALL))
def quantize(spark, sf):
    book = small_codebook(spark)
    return line_packets(spark, sf).select("flow_id", "pos", book.encode(F.col("ps"), F.col("ipt")).alias("cluster_id"))


@query("quantize_large", lines_sql("select flow_id, pos, cluster_id from coded", more=_LARGE))
def quantize_large(spark, sf):
    book = large_codebook(spark)
    return line_packets(spark, sf).select("flow_id", "pos", book.encode(F.col("ps"), F.col("ipt")).alias("cluster_id"))


_GRID = _SCALED + """,
xs as (select i, i / 64.0::double - 1 as x from range(128) a(i)), ys as (select j, j / 25.0::double as y from range(128) b(j)),
near_x as (select s_ps, arg_min(i, {d: (s_ps - x) * (s_ps - x), i: i}) as i from (select distinct s_ps from scaled), xs group by 1),
near_y as (select s_ipt, arg_min(j, {d: (s_ipt - y) * (s_ipt - y), j: j}) as j from (select distinct s_ipt from scaled), ys group by 1),
coded as (select flow_id, pos, (i * 128 + j)::integer as cluster_id from scaled join near_x using (s_ps) join near_y using (s_ipt))"""


@query("quantize_16384", lines_sql("select flow_id, array_to_string(list(cluster_id order by pos), ',') as ids from coded group by 1", more=_GRID))
def quantize_16384(spark, sf):
    """The grid is separable, so SQL finds the nearest centre axis by axis."""
    book = grid_codebook(spark)
    return _text(line_flows(spark, sf).select("flow_id", book.encode_flow(F.col("packets")).alias("ids")), "ids")


@query("dequantize_16384", lines_sql("""
select flow_id, pos, round((cluster_id // 128 / 64.0::double - 1) * 1500, 4)::double as ps,
  round(case when cluster_id % 128 = 0 then 0 else pow(10, cluster_id % 128 / 25.0::double) end, 4)::double as ipt from coded""", more=_GRID))
def dequantize_16384(spark, sf):
    book = grid_codebook(spark)
    coded = line_flows(spark, sf).select("flow_id", book.encode_flow(F.col("packets")).alias("ids"))
    packets = X.unnest(coded.select("flow_id", book.decode_flow(F.col("ids")).alias("p")), "p")
    return packets.select("flow_id", "pos", F.round("p.ps", 4).alias("ps"), F.round("p.ipt", 4).alias("ipt"))


@query("dequantize", lines_sql("""
select flow_id, pos, cluster_id, round(x * 1500, 4)::double as ps,
  round(case when abs(y) <= 1e-3 then 0 else pow(10, y) end, 4)::double as ipt
from coded join book on id = cluster_id""", more=_SMALL))
def dequantize(spark, sf):
    book = small_codebook(spark)
    coded = line_packets(spark, sf).select("flow_id", "pos", book.encode(F.col("ps"), F.col("ipt")).alias("cluster_id"))
    return book.decode(coded).withColumn("ps", F.round("ps", 4)).withColumn("ipt", F.round("ipt", 4))


@query("quantizer_error", lines_sql("""
select count(distinct cluster_id) as centres, round(avg(abs(s_ps - x) + abs(s_ipt - y)) / 2, 6)::double as mae,
  round(sum(abs(s_ps - x) + abs(s_ipt - y)), 3)::double as cumulative_error
from coded join book on id = cluster_id""", more=_SMALL))
def quantizer_error(spark, sf):
    return Q.quantizer_error(line_packets(spark, sf), small_codebook(spark)).select(
        "centres", F.round("mae", 6).alias("mae"), F.round("cumulative_error", 3).alias("cumulative_error"))


@query("codebook_step", lines_sql("""
select cluster_id, round(avg(s_ps), 6)::double as c_ps, round(avg(s_ipt), 6)::double as c_ipt from coded group by 1""",
                                  more=_SMALL))
def codebook_step(spark, sf):
    return Q.centre_step(line_packets(spark, sf), small_codebook(spark)).select(
        "cluster_id", F.round("c_ps", 6).alias("c_ps"), F.round("c_ipt", 6).alias("c_ipt"))


@query("codebook_kmeans")
def codebook_kmeans(spark, sf):
    """A codebook of the full size, 16,384 centres."""
    return Q.fit_codebook(line_packets(spark, sf)).table()


_SEVERAL = "(select * from scaled where flow_id in (select flow_id from scaled where pos = 1))"


@query("codebook_settled", lines_sql(f"""
select least({K.CODEBOOK_SIZE}, count(*)) as centres, sum(n)::bigint as packets, true as settled
from (select s_ps, s_ipt, count(*) as n from {_SEVERAL} group by 1, 2)""", more=_SCALED))
def codebook_settled(spark, sf):
    """Every centre of the full codebook lies within the tolerance of the mean of its own packets, which are all packets of flows of several."""
    packets = line_packets(spark, sf)
    several = packets.join(packets.filter("pos = 1").select("flow_id").distinct(), "flow_id", "left_semi")
    book, counts = Q.fit_chunks([packets])
    means = Q.centre_step(several, book).withColumnsRenamed({"c_ps": "m_ps", "c_ipt": "m_ipt"})
    apart = F.sqrt(F.pow(F.col("c_ps") - F.col("m_ps"), 2) + F.pow(F.col("c_ipt") - F.col("m_ipt"), 2))
    return book.table().join(means, "cluster_id", "left").agg(
        F.count("*").alias("centres"), F.lit(int(counts.sum())).alias("packets"), (F.coalesce(F.max(apart), F.lit(0.0)) <= 0.01 + 1e-9).alias("settled"))


@query("codebook_chunks", lines_sql(f"""
select chunk, sum(count(*)) over (order by chunk)::bigint as packets, true as close from (select flow_id % 3 as chunk from {_SEVERAL}) group by 1""", more=_SCALED))
def codebook_chunks(spark, sf):
    """256 centres carried from chunk to chunk: after each, they stand for all packets so far and describe these nearly as well as a fit on them at once."""
    packets, rows = write_and_read(line_packets(spark, sf), "line-packets"), []  # read by many rounds
    parts = [packets.filter(F.col("flow_id") % 3 == i) for i in range(3)]
    for i in range(3):
        book, counts = Q.fit_chunks(parts[:i + 1], k=256)
        so_far = packets.filter(F.col("flow_id") % 3 <= i)
        error = [Q.quantizer_error(so_far, b).first()["mae"] for b in (book, Q.fit_codebook(so_far, k=256))]
        rows.append((i, int(counts.sum()), error[0] <= 1.25 * error[1]))
    return spark.createDataFrame(rows, "chunk long, packets long, close boolean")


def _text(df, *names):
    for name in names:
        df = df.withColumn(name, F.concat_ws(",", F.col(name).cast("array<string>")))
    return df


def vocabulary(spark, sf, size):
    return T.Vocabulary.create(spark, size).add_classes(classes(spark, sf))


def token_sequences(spark, sf, label="target_class"):
    """Token sequences of all orders with their class, padded to the longest, with codebook, vocabulary and length."""
    book = small_codebook(spark)
    vocab = vocabulary(spark, sf, book.size)
    flows = write_and_read(line_flows(spark, sf).join(classes(spark, sf), "flow_id"), "flows")
    longest = min(K.MAX_SEQUENCE, 2 + flows.agg(F.coalesce(F.max(F.size("packets")), F.lit(0))).first()[0])
    encoded = T.encode_flows(flows, book, vocab, label=label)
    return T.pad_batch(encoded, vocab, longest), book, vocab, longest


_TOKENS = _SMALL + """,
names as (select o_orderpriority as target_class, (15 + row_number() over (order by o_orderpriority))::integer as first
  from orders group by 1),
ids as (select flow_id, list(cluster_id order by pos) as ids from coded group by 1),
tokens as (
  select flow_id, o.o_orderpriority as target_class, o.o_orderstatus as status,
    list_resize([first] || ids || [12], (select max(len(ids)) + 2 from ids), 13) as input_ids
  from ids join orders o on o_orderkey = flow_id join names n on n.target_class = o.o_orderpriority)"""


@query("tokenize", lines_sql("""
select flow_id, target_class, array_to_string(input_ids, ',') as input_ids,
  array_to_string([case when x <> 13 then 1 else 0 end for x in input_ids], ',') as attention_mask from tokens""",
                             more=_TOKENS))
def tokenize(spark, sf):
    encoded, *_ = token_sequences(spark, sf)
    return _text(encoded.select("flow_id", "target_class", "input_ids", "attention_mask"), "input_ids", "attention_mask")


@query("tokenize_plain", lines_sql("""
select flow_id, array_to_string([15] || ids || [12], ',') as input_ids from ids""", more=_TOKENS))
def tokenize_plain(spark, sf):
    book = small_codebook(spark)
    vocab = T.Vocabulary.create(spark, book.size)
    return _text(T.encode_flows(line_flows(spark, sf), book, vocab, mask=False).select(
        "flow_id", "input_ids"), "input_ids")


@query("tokenize_unpadded", lines_sql("""
select flow_id, array_to_string(list(cluster_id order by pos), ',') as input_ids from coded group by 1""", more=_SMALL))
def tokenize_unpadded(spark, sf):
    book = small_codebook(spark)
    vocab = T.Vocabulary.create(spark, book.size)
    return _text(T.encode_flows(line_flows(spark, sf), book, vocab, special=False, mask=False).select(
        "flow_id", "input_ids"), "input_ids")


@query("lm_labels", lines_sql("""
select flow_id, array_to_string([case when x = 13 then -100 else x end for x in input_ids], ',') as labels from tokens""",
                              more=_TOKENS))
def lm_labels(spark, sf):
    encoded, _, vocab, _ = token_sequences(spark, sf)
    return _text(T.with_lm_labels(encoded, vocab).select("flow_id", "labels"), "labels")


@query("detokenize", lines_sql("""
select flow_id, pos, round(x * 1500, 4)::double as ps, round(case when abs(y) <= 1e-3 then 0 else pow(10, y) end, 4)::double as ipt
from coded join book on id = cluster_id where flow_id in (select o_orderkey from orders)""", more=_TOKENS))
def detokenize(spark, sf):
    encoded, book, vocab, _ = token_sequences(spark, sf)
    decoded = T.decode_flows(encoded, book, vocab)
    packets = X.unnest(decoded.select("flow_id", F.col("packets").alias("p")), "p")
    return packets.filter("p is not null").select(
        "flow_id", "pos", F.round("p.ps", 4).alias("ps"), F.round("p.ipt", 4).alias("ipt"))


@query("size_tokens", lines_sql("""
select flow_id, array_to_string(list(
  (case when ps is null then 0 else least(greatest(ps, -2499), 2499) end + 2500)::integer order by i), ',') as size_tokens
from (select f.flow_id, i, ps from (select distinct flow_id from pl) f cross join range(20) r(i)
  left join pl on pl.flow_id = f.flow_id and pl.pos = i) x group by 1"""))
def size_tokens(spark, sf):
    return _text(T.size_tokens(line_flows(spark, sf)).select("flow_id", "size_tokens"), "size_tokens")


@query("class_vocab", """
select token_id::integer as token_id, token from (
  select 12 + i as token_id, t as token from (values (0,'[EOF]'),(1,'[PAD]'),(2,'[UNK]'),(3,'[BOF]')) s(i, t)
  union all
  select 15 + row_number() over (order by o_orderpriority), o_orderpriority from orders group by o_orderpriority) x""")
def class_vocab(spark, sf):
    return vocabulary(spark, sf, 12).table


@query("labelled_tokens", lines_sql("""
select flow_id, label::bigint as label, array_to_string([15] || ids || [12], ',') as input_ids
from ids join orders on o_orderkey = flow_id join
  (select o_orderpriority as class, row_number() over (order by o_orderpriority) - 1 as label from orders group by 1) c
  on class = o_orderpriority""", more=_TOKENS))
def labelled_tokens(spark, sf):
    from flowloom.operators.features import label_encoder

    book = small_codebook(spark)
    vocab = T.Vocabulary.create(spark, book.size)
    flows = line_flows(spark, sf).join(classes(spark, sf), "flow_id")
    encoder = label_encoder(classes(spark, sf), "target_class")
    return _text(T.labelled_tokens(flows, book, vocab, encoder).drop("attention_mask"), "input_ids")


@query("markov_states", "select value, dense_rank() over (order by value) - 1 as state_index from events group by value")
def markov_states(spark, sf):
    return M.state_index(table(spark, sf, "events"), "value")


_PAIRS = """
pairs as (select target_class, status, input_ids[i] as "from", input_ids[i + 1] as "to"
  from (select *, unnest(range(1, len(input_ids))) as i from tokens) t),
states as (select target_class, count(distinct s) as n from (select target_class, unnest(input_ids) as s from tokens) u group by 1)"""


@query("markov_transitions", lines_sql("""
select p.target_class, "from", "to", count(*) as cnt,
  round((count(*) + 1e-6) / (sum(count(*)) over (partition by p.target_class, "from") + any_value(n) * 1e-6), 9)::double as p
from pairs p join states s on s.target_class = p.target_class group by 1, 2, 3""", more=_TOKENS + "," + _PAIRS))
def markov_transitions(spark, sf):
    encoded, *_ = token_sequences(spark, sf)
    return M.transitions(encoded).select("target_class", "from", "to", "cnt", F.round("p", 9).alias("p"))


@query("markov_priors", lines_sql("""
select target_class, input_ids[1] as state, count(*) as cnt,
  round(count(*) / sum(count(*)) over (partition by target_class), 9)::double as p from tokens group by 1, 2""", more=_TOKENS))
def markov_priors(spark, sf):
    encoded, *_ = token_sequences(spark, sf)
    return M.priors(encoded).withColumn("p", F.round("p", 9))


@query("markov_perplexity", lines_sql("""
select target_class, sum(held)::bigint as transitions, coalesce(sum(held) filter (n is null), 0)::bigint as unjudged, round(exp(-sum(held * ln(coalesce(p, u, 1.0 / n))) / sum(held)), 5)::double as perplexity
from (
  select h.target_class, h.held, m.p, r.u, t.n from
    (select target_class, "from", "to", count(*) as held from pairs where status = 'P' group by 1, 2, 3) h
    left join (select p.target_class, "from", "to",
        (count(*) + 1e-6) / (sum(count(*)) over (partition by p.target_class, "from") + any_value(n) * 1e-6) as p
      from pairs p join tn on tn.target_class = p.target_class where status <> 'P' group by 1, 2, 3) m using (target_class, "from", "to")
    left join (select p.target_class, "from", 1e-6 / (count(*) + any_value(n) * 1e-6) as u
      from pairs p join tn on tn.target_class = p.target_class where status <> 'P' group by 1, 2) r using (target_class, "from")
    left join tn t on t.target_class = h.target_class) x group by 1""", more=_TOKENS + "," + _PAIRS + """,
tn as (select target_class, count(distinct s) as n from
  (select target_class, unnest(input_ids) as s from tokens where status <> 'P') u group by 1)"""))
def markov_perplexity(spark, sf):
    encoded, *_ = token_sequences(spark, sf)
    status = table(spark, sf, "orders").select(F.col("o_orderkey").alias("flow_id"), "o_orderstatus")
    rows = write_and_read(encoded.select("flow_id", "target_class", "input_ids").join(status, "flow_id"), "tokens")
    model = M.transitions(rows.filter("o_orderstatus <> 'P'"))
    return M.perplexity(rows.filter("o_orderstatus = 'P'"), model).withColumn("perplexity", F.round("perplexity", 5))


def _generated(spark, sf, cap=K.CLASS_CAP):
    encoded, book, vocab, length = token_sequences(spark, sf)
    return M.MarkovModel.fit(encoded, length).sample_like_source(cap), book, vocab, length


@query("markov_sample")
def markov_sample(spark, sf):
    """Per class as many generated flows as there are source flows, up to the cap, decoded to packets."""
    sampled, book, vocab, length = _generated(spark, sf)
    drawn = T.decode_flows(sampled, book, vocab)
    return drawn.select("target_class", "seq_id", *X.to_wide(F.col("packets"), length - 2))


_UNIT = "(('0x' || substr(md5('1|{salt}|' || {c} || '|' || {seq} || '|' || {pos}), 1, 15))::bigint >> 8) / 4503599627370496.0::double"


def _unit(salt, c, seq, pos):
    return _UNIT.format(salt=salt, c=c, seq=seq, pos=pos)


_STEPS = _PAIRS + f""",
class_size as (select target_class, least(count(*), 20000) as n from tokens group by 1),
slots as (select target_class, unnest(range(n)) as seq_id from class_size),
starts as (
  select target_class, state, sum(cnt) over w - cnt as lo, sum(cnt) over w as hi, sum(cnt) over (partition by target_class) as total
  from (select target_class, input_ids[1] as state, count(*) as cnt from tokens group by 1, 2)
  window w as (partition by target_class order by state rows unbounded preceding)),
moves as (
  select m.target_class, "from", "to", sum(cnt) over w - cnt as lo, sum(cnt) over w as hi,
    sum(cnt) over (partition by m.target_class, "from") as total, n
  from (select target_class, "from", "to", count(*) as cnt from pairs group by 1, 2, 3) m join states using (target_class)
  window w as (partition by m.target_class, "from" order by "to" rows unbounded preceding)),
places as (
  select target_class, s, row_number() over (partition by target_class order by s) - 1 as at, count(*) over (partition by target_class) as n
  from (select distinct target_class, unnest(input_ids) as s from tokens)),
walk as (
  select t.target_class, t.seq_id, 0 as pos, state, [state] as ids
  from slots t join starts b on b.target_class = t.target_class
    and floor({_unit(0, "t.target_class", "t.seq_id", "0")} * total) >= lo and floor({_unit(0, "t.target_class", "t.seq_id", "0")} * total) < hi
  union all
  select target_class, seq_id, pos, state, list_append(ids, state) from (
    select w.target_class, w.seq_id, w.pos + 1 as pos, ids, case
        when m."to" is null or {_unit(1, "w.target_class", "w.seq_id", "(w.pos + 1)")} < m.n * (1e-6::double / (m.total + m.n * 1e-6::double)) then a.s
        else m."to" end as state
    from walk w
      left join moves m on m.target_class = w.target_class and m."from" = w.state
        and floor({_unit(0, "w.target_class", "w.seq_id", "(w.pos + 1)")} * m.total) >= m.lo
        and floor({_unit(0, "w.target_class", "w.seq_id", "(w.pos + 1)")} * m.total) < m.hi
      join places a on a.target_class = w.target_class and a.at = floor({_unit(0, "w.target_class", "w.seq_id", "(w.pos + 1)")} * a.n)
    where w.pos + 1 < (select max(len(input_ids)) from tokens)) x)"""
_WALK = _TOKENS + "," + _STEPS


@query("markov_sample_tokens", lines_sql("""
select target_class, seq_id, array_to_string(ids, ',') as input_ids from walk
where pos + 1 = (select max(len(input_ids)) from tokens)""", more=_WALK, recursive=True))
def markov_sample_tokens(spark, sf):
    """Sampled sequences row by row: SQL draws the same uniforms and walks the same model."""
    return _text(_generated(spark, sf)[0].select("target_class", "seq_id", "input_ids"), "input_ids")


@query("markov_sample_shape", lines_sql("""
select t.target_class, count(*) as flows, any_value(first)::integer as first_token,
  min(len(input_ids))::integer as shortest, max(len(input_ids))::integer as longest
from tokens t join names n on n.target_class = t.target_class group by 1""", more=_TOKENS))
def markov_sample_shape(spark, sf):
    """Generated sequences per class without a cap, their length and their class token."""
    size = F.size("input_ids")
    return _generated(spark, sf, None)[0].groupBy("target_class").agg(
        F.count("*").alias("flows"), F.max(F.get("input_ids", F.lit(0))).alias("first_token"),
        F.min(size).alias("shortest"), F.max(size).alias("longest"))


_SLOTTED = """
slotted as (
  select f.flow_id, o_orderpriority as target_class, o_orderstatus as status, i, coalesce(ps, 0)::double as v
  from (select distinct flow_id from pl) f join orders on o_orderkey = flow_id cross join range(20) r(i)
    left join pl on pl.flow_id = f.flow_id and pl.pos = i)"""


def _sizes(spark, sf):
    """The first packet sizes of every order, 0 where it has fewer."""
    flows = line_flows(spark, sf).join(classes(spark, sf), "flow_id")
    slots = F.sequence(F.lit(0), F.lit(K.PACKET_LIMIT - 1))
    return flows.select("target_class", F.transform(slots, lambda i: F.coalesce(F.get(F.col("packets"), i)["ps"], F.lit(0.0))).alias("values"))


@query("markov_sample_values", lines_sql("""
select target_class, seq_id, array_to_string([centres[i + 1]::bigint for i in ids], ',') as sizes
from walk join (select target_class, list(distinct v order by v) as centres from slotted group by 1) using (target_class) where pos = 19""",
                                         more=_SLOTTED + """,
tokens as (select target_class, status, list(place order by i)::integer[] as input_ids from (
  select *, dense_rank() over (partition by target_class order by v) - 1 as place from slotted) group by flow_id, target_class, status),""" + _STEPS.replace(
                                             "least(count(*), 20000)", "count(*)"), recursive=True))
def markov_sample_values(spark, sf):
    """Packet sizes through 1-D clusters and a Markov model; a class has fewer sizes than clusters are allowed, so each is a centre."""
    model = M.QuantizedMarkov.fit(_sizes(spark, sf), K.PACKET_LIMIT)
    drawn = model.sample(model.model.class_sizes().withColumnRenamed("flows", "n"))
    return _text(drawn.select("target_class", "seq_id", F.transform("values", lambda x: F.round(x).cast("long")).alias("sizes")), "sizes")


VALUE_CLUSTERS = 12


def _best_cuts_sql(k: int) -> str:
    """Optimal clusters by trying, for every number of clusters and every end, all last cuts."""
    cost = "(b.q - a.q) - (b.s - a.s) * (b.s - a.s) / (b.w - a.w)"
    layers = "".join(f""",
f{j} as materialized (
  select target_class, i, total as f, cut from (
    select b.target_class, b.i, a.i as cut, a.f + ({cost}) as total
    from sums b join (select * from f{j - 1} join sums using (target_class, i)) a on a.target_class = b.target_class and a.i < b.i)
  qualify row_number() over (partition by target_class, i order by total, cut) = 1),""".rstrip(",") for j in range(2, k + 1))
    back = f"\n,c{k} as (select target_class, max(i) as stop from sums group by 1)" + "".join(
        f"\n,c{j - 1} as (select target_class, f.cut as stop from c{j} join f{j} f using (target_class) where f.i = c{j}.stop)" for j in range(k, 1, -1))
    stops = " union all ".join(f"select target_class, {j - 1} as cluster, stop from c{j}" for j in range(1, k + 1))
    return f""",
counted as (select target_class, v, count(*) as n from slotted group by 1, 2),
moved as (select *, v - floor(sum(v * n) over (partition by target_class) / sum(n) over (partition by target_class)) as x from counted),
sums as (
  select target_class, row_number() over r as i, v, n, sum(n::double) over r as w, sum(n * x) over r as s, sum(n * x * x) over r as q
  from moved window r as (partition by target_class order by v rows unbounded preceding)
  union all select distinct target_class, 0, null::double, 0, 0.0::double, 0.0::double, 0.0::double from moved),
f1 as (select target_class, i, q - s * s / w as f, 0 as cut from sums where i > 0){layers}{back},
stops as ({stops}),
placed as (select s.*, min(t.cluster) as cluster from sums s join stops t on t.target_class = s.target_class and s.i <= t.stop where s.i > 0 group by all)"""


@query("markov_value_clusters", lines_sql("""
select target_class, cluster::integer as cluster, min(v)::double as low, max(v)::double as high, sum(n)::bigint as cnt, round(sum(v * n) / sum(n), 6)::double as centre
from placed group by 1, 2""", more=_SLOTTED + _best_cuts_sql(VALUE_CLUSTERS)))
def markov_value_clusters(spark, sf):
    """The exact 1-D clusters of every class; SQL tries all cuts."""
    found = ValueClusters.fit(_sizes(spark, sf), limit=VALUE_CLUSTERS).table
    return found.withColumn("centre", F.round("centre", 6))
