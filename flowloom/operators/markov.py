"""Class-wise Markov models of token sequences as sparse tables.

`by` names at least one column; data without classes gets a constant one.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from flowloom import constants as K
from flowloom.functions.arrays import unnest
from flowloom.operators.value_clusters import ValueClusters
from flowloom.plans.keys import join_on
from flowloom.plans.running import HASH_BITS, equal_slices, running_totals, text_hash
from flowloom.plans.storage import write_and_read

BROADCAST_STATES = 1 << 20
BROADCAST_TRANSITIONS = 1 << 22
#: Sequences that are drawn from one slot row, and tasks that slots are dealt to.
SLOT_ROWS, MOST_TASKS = 4096, 2048


def state_index(states: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Numbers 0..n-1 of the sorted distinct states."""
    distinct = states.select(*by, column).distinct().withColumn("__all", F.lit(0))
    sliced = equal_slices(distinct, column)
    ranked = running_totals(sliced, ["__all", *by], "slice", [column], {"states": F.lit(1).cast("long")})
    return ranked.select(*by, column, F.col("before_states").alias("state_index"))


def _pairs(ids: Column) -> Column:
    """Neighbouring states; the first state is the target of a pair that starts the sequence."""
    return F.transform(ids, lambda x, i: F.struct((i == 0).alias("start"), F.get(ids, i - 1).alias("from"), x.alias("to")))


def pair_counts(sequences: DataFrame, ids: str = "input_ids", by: Sequence[str] = (K.TARGET_CLASS,)) -> DataFrame:
    """(by, start, from, to, cnt): one pass over the sequences that transitions, priors and states are all read off."""
    pairs = unnest(sequences.select(*by, _pairs(F.col(ids)).alias("p")), "p")
    return pairs.groupBy(*by, F.col("p.start").alias("start"), F.col("p.from").alias("from"), F.col("p.to").alias("to")).agg(
        F.count("*").alias("cnt"))


def transition_counts(sequences: DataFrame, ids: str = "input_ids", by: Sequence[str] = (K.TARGET_CLASS,)) -> DataFrame:
    """Pairs of neighbouring states: taken inside the row, counted with map-side combine."""
    return pair_counts(sequences, ids, by).filter("not start").drop("start")


def states_of(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct states per class."""
    return pairs.select(*by, F.col("to").alias("state")).distinct()


def state_counts(sequences: DataFrame, ids: str = "input_ids", by: Sequence[str] = (K.TARGET_CLASS,)) -> DataFrame:
    """Distinct states per class."""
    return states_of(pair_counts(sequences, ids, by), by).groupBy(*by).agg(F.count("*").alias("n_states"))


def transitions_of(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Transitions from stored pair counts; a NULL class is a class."""
    by = list(by)
    counts = pairs.filter("not start").drop("start")
    rows = counts.groupBy(*by, "from").agg(F.sum("cnt").alias("row_cnt"))
    sizes = states_of(pairs, by).groupBy(*by).agg(F.count("*").alias("n_states"))
    rows = join_on(rows, sizes, by)
    weight = F.col("row_cnt") + F.col("n_states") * F.lit(K.SMOOTHING)
    return join_on(counts, rows, [*by, "from"]).select(
        *by, "from", "to", "cnt", "n_states",
        ((F.col("cnt") + F.lit(K.SMOOTHING)) / weight).alias("p"),
        (F.lit(K.SMOOTHING) / weight).alias("p_unseen"),
    )


def transitions(sequences: DataFrame, ids: str = "input_ids", by: Sequence[str] = (K.TARGET_CLASS,)) -> DataFrame:
    """Observed transitions with smoothed probability; every unseen pair has `p_unseen` of its row.

    The sequences are read once; everything else is read off their counted pairs.
    """
    return transitions_of(write_and_read(pair_counts(sequences, ids, by), "pairs"), by)


def priors_of(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    by = list(by)
    counts = pairs.filter("start and to is not null").select(*by, F.col("to").alias("state"), "cnt")
    totals = counts.groupBy(*by).agg(F.sum("cnt").alias("total"))
    return join_on(counts, totals, by).select(*by, "state", "cnt", (F.col("cnt") / F.col("total")).alias("p"))


def priors(sequences: DataFrame, ids: str = "input_ids", by: Sequence[str] = (K.TARGET_CLASS,)) -> DataFrame:
    """Share of sequences that start in each state."""
    first = sequences.select(*by, F.slice(F.col(ids), 1, 1).alias(ids))
    return priors_of(write_and_read(pair_counts(first, ids, by), "starts"), by)


def normalize_rows(weights: DataFrame, row: str, value: str) -> DataFrame:
    """Divide by the row total; an infinite weight counts as 1e7, an all-zero row stays."""
    safe = F.when(F.col(value) == float("inf"), F.lit(K.INFINITE_WEIGHT)).otherwise(F.col(value))
    capped = weights.withColumn(value, safe)
    totals = capped.groupBy(row).agg(F.sum(F.abs(value)).alias("__total"))
    return capped.join(totals, row).withColumn(
        value, F.when(F.col("__total") == 0, F.col(value)).otherwise(F.col(value) / F.col("__total"))).drop("__total")


def perplexity(heldout: DataFrame, model: DataFrame, sequences_ids: str = "input_ids",
               by: Sequence[str] = (K.TARGET_CLASS,)) -> DataFrame:
    """exp of the mean negative log probability of held-out transitions per class.

    Held-out pairs are counted before the join, so its size is that of the distinct pairs.
    A state the model never left gives every successor the same chance. Transitions of a class that the model lacks are counted as
    `unjudged`; the perplexity is that of the others.
    """
    by = list(by)
    model = write_and_read(model.select(*by, "from", "to", "p", "p_unseen", "n_states"), "model")
    counts = transition_counts(heldout, sequences_ids, by).withColumnRenamed("cnt", "held")
    known = model.select(*by, "from", "to", "p")
    rows = model.groupBy(*by, "from").agg(F.max("p_unseen").alias("p_unseen"))
    sizes = model.groupBy(*by).agg(F.max("n_states").alias("n_states"))
    joined = join_on(join_on(join_on(counts, known, [*by, "from", "to"], "left"), rows, [*by, "from"], "left"), sizes, by, "left")
    chance = F.coalesce("p", "p_unseen", F.lit(1.0) / F.col("n_states"))
    judged = F.when(F.col("n_states").isNotNull(), F.col("held"))
    return joined.groupBy(*by).agg(
        F.sum("held").alias("transitions"), F.coalesce(F.sum(F.col("held")) - F.coalesce(F.sum(judged), F.lit(0)), F.lit(0)).alias("unjudged"),
        F.exp(-F.sum(judged * F.log(chance)) / F.sum(judged)).alias("perplexity"),
    )


def _uniforms(seed: int, by: Sequence[str], length: int) -> Column:
    """Two reproducible uniforms per position from hashes of (seed, class, sequence, position)."""
    def unit(salt: int, pos: Column) -> Column:
        h = text_hash(F.lit(seed), F.lit(salt), *[F.col(c) for c in by], F.col("seq_id"), pos)
        return F.shiftright(h, 8).cast("double") / float(1 << (HASH_BITS - 8))

    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)),
                       lambda pos: F.struct(unit(0, pos).alias("u"), unit(1, pos).alias("v")))


def _drawn(seed: int, names: pd.Series, seq: pd.Series, length: int) -> np.ndarray:
    """The numbers of `_uniforms`, (salt, row, position), for a batch; `names` are the classes as text."""
    ends = [b"|%d" % pos for pos in range(length)]
    out = []
    for salt in (0, 1):
        heads = [f"{seed}|{salt}|{name}|{number}".encode() for name, number in zip(names, seq)]
        digests = b"".join([md5(head + end).digest() for head in heads for end in ends])
        # the first 60 bits, without the last 8
        out.append((np.frombuffer(digests, ">u8")[::2] >> np.uint64(64 - HASH_BITS + 8)).astype(np.float64).reshape(len(heads), length))
    return np.stack(out) / float(1 << (HASH_BITS - 8))


class MarkovModel:
    """Priors, transitions and states per class; every table is sparse and stays distributed."""

    def __init__(self, prior: DataFrame, trans: DataFrame, states: DataFrame, by: str, length: int):
        self.prior, self.trans, self.states, self.by, self.length = prior, trans, states, by, length

    @classmethod
    def fit(cls, sequences: DataFrame, length: int, ids: str = "input_ids", by: str = K.TARGET_CLASS) -> "MarkovModel":
        """Sequences without a class are left out: there is no name under which to draw them again."""
        pairs = write_and_read(pair_counts(sequences.filter(F.col(by).isNotNull()), ids, [by]), "pairs")
        tables = (priors_of(pairs, [by]), transitions_of(pairs, [by]), states_of(pairs, [by]))
        return cls(*[write_and_read(t, "markov") for t in tables], by, length)

    def class_sizes(self) -> DataFrame:
        """Fitted sequences per class as (class, flows)."""
        return self.prior.groupBy(self.by).agg(F.sum("cnt").alias("flows"))

    def save(self, path: str) -> None:
        for name, table in (("prior", self.prior), ("trans", self.trans), ("states", self.states)):
            table.withColumn("__length", F.lit(self.length)).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, by: str = K.TARGET_CLASS) -> "MarkovModel":
        tables = [spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in ("prior", "trans", "states")]
        length = tables[0].select("__length").first()[0]
        return cls(*[t.drop("__length") for t in tables], by, length)

    def sample_like_source(self, cap: int | None = K.CLASS_CAP, seed: int = K.RANDOM_SEED) -> DataFrame:
        """As many sequences per class as were fitted, up to the cap if there is one; all classes in one job."""
        size = F.col("flows") if cap is None else F.least("flows", F.lit(cap).cast("long"))
        wanted = self.class_sizes().select(self.by, size.alias("n"))
        return self.sample(wanted, seed)

    def sample(self, wanted: DataFrame, seed: int = K.RANDOM_SEED, force_joins: bool = False) -> DataFrame:
        """`wanted(class, n)` to sequences (class, seq_id, input_ids).

        The randomness belongs to (seed, class, sequence, position): neither the partitioning nor the method
        changes the result. Small models travel to the tasks, larger ones are joined position by position.
        """
        part = F.lit(SLOT_ROWS).cast("long")
        wanted = write_and_read(wanted.filter("n > 0"), "wanted")
        parts = wanted.agg(F.coalesce(F.sum(F.ceil(F.col("n") / part)), F.lit(0))).first()[0]
        # a number of partitions is kept, while a handful of rows dealt without one would be merged into one task
        tasks = min(max(int(parts), 1), MOST_TASKS)
        slots = wanted.select(
            self.by, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / part))).alias("part"),
        ).repartition(tasks, self.by, "part").select(self.by, F.explode(F.sequence(
            F.col("part") * part, F.least((F.col("part") + 1) * part, "n") - 1)).alias("seq_id"))
        small = (self.trans.limit(BROADCAST_TRANSITIONS + 1).count() <= BROADCAST_TRANSITIONS
                 and self.states.limit(BROADCAST_STATES + 1).count() <= BROADCAST_STATES)
        return self._sample_by_joins(slots, seed) if force_joins or not small else self._sample_in_tasks(slots, seed)

    def _steps(self) -> DataFrame:
        """Per (class, state): successors with the cumulated share, in state order, and the smoothing share."""
        smooth = F.col("n_states") * F.col("p_unseen")
        return self.trans.groupBy(self.by, "from").agg(
            F.array_sort(F.collect_list(F.struct("to", "cnt"))).alias("next"),
            F.sum("cnt").alias("total"), F.max(smooth).alias("smooth"))

    def _sample_in_tasks(self, slots: DataFrame, seed: int) -> DataFrame:
        spark, by, length = slots.sparkSession, self.by, self.length
        tables = (self.states.toPandas(), self.prior.toPandas(), self.trans.toPandas())  # sizes checked by the caller
        shared = spark.sparkContext.broadcast(_Chains(by, *tables))
        staged = slots.select(by, "seq_id", F.coalesce(F.col(by).cast("string"), F.lit("")).alias("__name"))
        schema = T.StructType([slots.schema[by], slots.schema["seq_id"], T.StructField("input_ids", T.ArrayType(T.IntegerType()))])

        def run(batches):
            for batch in batches:
                if len(batch):
                    ids = shared.value.walk(batch[by].to_numpy(), *_drawn(seed, batch["__name"], batch["seq_id"], length))
                    yield pd.DataFrame({by: batch[by], "seq_id": batch["seq_id"], "input_ids": list(ids)})

        return staged.mapInPandas(run, schema)

    def _sample_by_joins(self, slots: DataFrame, seed: int) -> DataFrame:
        by = self.by
        states = self.states.groupBy(by).agg(F.array_sort(F.collect_list("state")).alias("all"))
        prior = self.prior.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("state", "cnt"))).alias("next"),
                                           F.sum("cnt").alias("total"))
        steps = self._steps().withColumnRenamed("from", "state")

        def pick(options: Column, field: str, total: Column, u: Column) -> Column:
            start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("hit"))
            return F.aggregate(options, start, lambda a, o: F.struct(
                (a["seen"] + o["cnt"]).alias("seen"),
                F.when(a["hit"].isNull() & ((a["seen"] + o["cnt"]) > u * total), o[field]).otherwise(a["hit"]).alias("hit"),
            ), lambda a: a["hit"])

        def anywhere(u: Column) -> Column:
            return F.get(F.col("all"), F.floor(u * F.size("all")).cast("int"))

        now = slots.withColumn("r", _uniforms(seed, [by], self.length))
        now = now.join(prior, by).withColumn("state", pick(F.col("next"), "state", F.col("total"), F.col("r")[0]["u"]))
        now = now.select(by, "seq_id", "r", "state", F.array("state").alias("input_ids"))
        for pos in range(1, self.length):
            u, v = F.col("r")[pos]["u"], F.col("r")[pos]["v"]
            jump = F.col("total").isNull() | (v < F.col("smooth"))
            drawn = F.when(jump, anywhere(u)).otherwise(pick(F.col("next"), "to", F.col("total"), u))
            now = now.join(steps, [by, "state"], "left").join(states, by).withColumn("drawn", drawn).select(
                by, "seq_id", "r", F.col("drawn").alias("state"), F.concat("input_ids", F.array("drawn")).alias("input_ids"))
            if pos % 8 == 0:
                now = write_and_read(now, "walk")
        return now.select(by, "seq_id", "input_ids")


class _Chains:
    """The model's tables as flat arrays; a step of a whole batch is one binary search."""

    def __init__(self, by: str, states: pd.DataFrame, prior: pd.DataFrame, trans: pd.DataFrame):
        states = states.sort_values([by, "state"]).reset_index(drop=True)
        self.place = {key: i for i, key in enumerate(zip(states[by], states["state"]))}
        self.value = states["state"].to_numpy(np.int32)
        sizes = states.groupby(by, sort=True).size()
        self.classes = {c: i for i, c in enumerate(sizes.index)}
        self.first = np.concatenate([[0], np.cumsum(sizes.to_numpy())])
        prior = prior.sort_values([by, "state"])
        self.prior = self._rows(prior[by].map(self.classes).to_numpy(), prior, by, "state", len(sizes))
        trans = trans.sort_values([by, "from", "to"])
        source = np.array([self.place[k] for k in zip(trans[by], trans["from"])], dtype=np.int64)
        self.step = self._rows(source, trans, by, "to", len(states))
        self.smooth = np.full(len(states), np.inf)
        self.smooth[source] = (trans["n_states"] * trans["p_unseen"]).to_numpy(float)

    def _rows(self, source: np.ndarray, table: pd.DataFrame, by: str, target: str, n: int):
        """Targets and running counts of all rows one after the other."""
        to = np.array([self.place[k] for k in zip(table[by], table[target])], dtype=np.int64)
        seen = np.cumsum(table["cnt"].to_numpy(np.int64))
        total = np.bincount(source, weights=table["cnt"], minlength=n).astype(np.int64)
        return to, seen, np.concatenate([[0], np.cumsum(total)])[:-1], total

    @staticmethod
    def _draw(rows, source: np.ndarray, u: np.ndarray) -> np.ndarray:
        to, seen, start, total = rows
        return to[np.minimum(np.searchsorted(seen, start[source] + np.floor(u * total[source]), side="right"), len(to) - 1)]

    def walk(self, classes: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        group = np.array([self.classes[c] for c in classes], dtype=np.int64)
        size = self.first[group + 1] - self.first[group]
        at = self._draw(self.prior, group, u[:, 0])
        out = np.empty(u.shape, dtype=np.int32)
        out[:, 0] = self.value[at]
        for pos in range(1, u.shape[1]):
            anywhere = self.first[group] + np.floor(u[:, pos] * size).astype(np.int64)
            jump = v[:, pos] < self.smooth[at]
            at = np.where(jump, anywhere, self._draw(self.step, np.where(jump, self._any_source(), at), u[:, pos]))
            out[:, pos] = self.value[at]
        return out

    def _any_source(self) -> int:
        """A state that has successors, used where the drawn step is not taken."""
        return int(np.argmax(self.step[3] > 0))


class QuantizedMarkov:
    """Numeric sequences through the 1-D clusters of their class: fit, sample, and restore cluster centres."""

    def __init__(self, clusters: ValueClusters, model: MarkovModel):
        self.clusters, self.model = clusters, model

    @classmethod
    def fit(cls, sequences: DataFrame, length: int, values: str = "values", by: str = K.TARGET_CLASS, limit: int = K.MARKOV_CLUSTER_LIMIT,
            digits: int | None = None) -> "QuantizedMarkov":
        sequences = write_and_read(sequences.select(by, values).where(F.col(by).isNotNull()), "values")
        clusters = ValueClusters.fit(sequences, values, by, limit, digits)
        return cls(clusters, MarkovModel.fit(clusters.encode(sequences, values), length, by=by))

    def sample(self, wanted: DataFrame, seed: int = K.RANDOM_SEED) -> DataFrame:
        return self.clusters.decode(self.model.sample(wanted, seed)).select(self.model.by, "seq_id", "values")
