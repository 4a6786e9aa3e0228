"""Feature vectors: label numbers, scaling, one-hot, assembly, model scoring."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from flowloom import constants as K
from flowloom.functions.stats import continuous_names
from flowloom.schema import raw_columns, resolve_columns


def label_encoder(data: DataFrame, label: str = K.TARGET_CLASS) -> DataFrame:
    """Table (class, label) of the sorted distinct classes."""
    classes = data.select(F.col(label).alias("class")).distinct()
    return classes.select("class", (F.row_number().over(Window.orderBy("class")) - 1).cast("long").alias("label"))


def encode_labels(data: DataFrame, encoder: DataFrame, label: str = K.TARGET_CLASS, name: str = "label") -> DataFrame:
    """Add the class number; a class the encoder does not know is an error."""
    table = encoder.select(F.col("class").alias("__class"), F.col("label").alias(name))
    joined = data.join(table, data[label] == table["__class"], "left").drop("__class")
    return joined.withColumn(name, F.coalesce(name, F.raise_error(F.concat(
        F.lit("unseen class "), F.coalesce(F.col(label), F.lit("NULL")))).cast("long")))


def fit_scaler(data: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column from one aggregation; a constant column has deviation 1."""
    if not columns:
        return {}
    row = data.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns)
                     for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def scale(data: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return data.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()})


@dataclass
class FeatureConfig:
    """Which columns make up the vector. Missing columns are left out with a warning and listed by the fitted featurizer.

    `derive` may add columns to the data before fitting and before transforming; those named in `derived` join the continuous ones.
    """

    packet_num: int = K.PACKET_LIMIT
    continuous: Sequence[str] | None = None
    categorical: Sequence[str] | None = None
    tcp_flags: bool = True
    fingerprints: bool = True
    raw: bool = True
    gaps: bool = False
    target: str = K.TARGET_CLASS
    derive: Callable[[DataFrame], DataFrame] | None = None
    derived: Sequence[str] = ()

    def continuous_columns(self) -> list[str]:
        if self.continuous is not None:
            return [*self.continuous, *self.derived]
        bases = ("bulk", "packet") + (("iat",) if self.gaps else ())
        return [side + name for side in (K.CLIENT, K.SERVER) for name in continuous_names(bases)] + list(self.derived)

    def with_derived(self, data: DataFrame) -> DataFrame:
        return self.derive(data) if self.derive else data

    def categorical_columns(self) -> list[str]:
        chosen = ["ip_proto"] if self.categorical is None else list(self.categorical)
        if self.fingerprints:
            chosen += ["ndpi_j3ac", "ndpi_j3as"]
        if self.tcp_flags:
            chosen += [f"{side}found_tcp_flags" for side in (K.CLIENT, K.SERVER)]
        return chosen

    def raw_feature_columns(self) -> list[str]:
        return raw_columns(self.packet_num, ("packet", "iat") if self.gaps else ("packet",)) if self.raw else []


@dataclass
class Featurizer:
    """Fit once, then transform training and test data alike: continuous, one-hot and raw columns, in this order."""

    config: FeatureConfig
    missing: list[str] = field(default_factory=list)
    scaler: dict[str, tuple[float, float]] = field(default_factory=dict)
    encoder: DataFrame | None = None
    model: PipelineModel | None = None
    columns: tuple[list[str], list[str], list[str]] = ((), (), ())

    def fit(self, data: DataFrame) -> "Featurizer":
        data = self.config.with_derived(data)
        found, self.missing = [], []
        for wanted in (self.config.continuous_columns(), self.config.categorical_columns(),
                       self.config.raw_feature_columns()):
            present, missing = resolve_columns(data, wanted)
            found.append(present)
            self.missing += missing
        if self.missing:
            warnings.warn(f"columns that the data lacks are left out: {', '.join(self.missing)}", stacklevel=2)
        self.columns = tuple(found)
        continuous, categorical, raw = self.columns
        prepared = self._prepare(data)
        self.scaler = fit_scaler(prepared, continuous + raw)
        stages = []
        if categorical:
            stages.append(StringIndexer(inputCols=categorical, outputCols=[f"__i_{c}" for c in categorical],
                                        stringOrderType="alphabetAsc", handleInvalid="keep"))
            stages.append(OneHotEncoder(inputCols=[f"__i_{c}" for c in categorical],
                                        outputCols=[f"__o_{c}" for c in categorical], dropLast=True))
        stages.append(VectorAssembler(inputCols=continuous + [f"__o_{c}" for c in categorical] + raw, outputCol="features"))
        self.model = Pipeline(stages=stages).fit(scale(prepared, self.scaler))
        if self.config.target in data.columns:
            self.encoder = label_encoder(data, self.config.target)
        return self

    def _prepare(self, data: DataFrame) -> DataFrame:
        continuous, categorical, raw = self.columns
        out = data.fillna(0.0, subset=continuous + raw) if continuous + raw else data
        texts = {c: F.concat_ws(",", F.col(c).cast("array<string>")) if isinstance(data.schema[c].dataType, T.ArrayType)
                 else F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in categorical}
        return out.withColumns(texts) if texts else out

    def transform(self, data: DataFrame) -> DataFrame:
        """Add `features` (and `label` where the target column is present)."""
        out = self.model.transform(scale(self._prepare(self.config.with_derived(data)), self.scaler))
        out = out.select(*data.columns, "features")
        if self.encoder is not None and self.config.target in data.columns:
            out = encode_labels(out, self.encoder, self.config.target)
        return out


def score_batches(data: DataFrame, make_predict_fn: Callable, *inputs: str | Column, name: str = "scores",
                  return_type: T.DataType | None = None, batch_size: int = 1024, shapes=None) -> DataFrame:
    """Run a user's model on Arrow batches of at most `batch_size` rows; the model is built once per Python worker."""
    scorer = predict_batch_udf(make_predict_fn, return_type=return_type or T.ArrayType(T.FloatType()),
                               batch_size=batch_size, input_tensor_shapes=shapes)
    return data.withColumn(name, scorer(*[F.col(c) if isinstance(c, str) else c for c in inputs]))


def mean_pooled(vectors: Column, mask: Column | None = None) -> Column:
    """Mean of per-position vectors (array<array<float>>); with a mask only of the positions that count."""
    zero = F.transform(F.get(vectors, F.lit(0)), lambda _: F.lit(0.0))
    add = lambda acc, v: F.zip_with(acc, v, lambda a, b: a + F.coalesce(b.cast("double"), F.lit(0.0)))
    if mask is None:
        return F.aggregate(vectors, zero, add, lambda acc: F.transform(acc, lambda a: a / F.size(vectors)))
    kept = F.filter(F.zip_with(vectors, mask, lambda v, m: F.when(m == 1, v)), lambda v: v.isNotNull())
    return F.aggregate(kept, zero, add, lambda acc: F.transform(acc, lambda a: F.try_divide(a, F.size(kept).cast("double"))))
