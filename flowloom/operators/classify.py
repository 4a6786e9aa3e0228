"""Classifiers by name, parameter ranges, grid search on macro F1, training and reporting."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from itertools import combinations
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from flowloom import constants as K
from flowloom.operators import report as R
from flowloom.operators.knn import NeighbourClassifier
from flowloom.plans.running import ranked_by_hash
from flowloom.plans.storage import small_side, write_and_read


class OneVsOne(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """One linear classifier per pair of classes; votes decide, margins break ties.

    The rows are stored by class, so each fit, itself a distributed job, reads its two classes only.
    """

    def __init__(self, classifier: Estimator | None = None, parallelism: int = 8):
        super().__init__()
        self.classifier, self.parallelism = classifier or LinearSVC(), parallelism

    def copy(self, extra=None) -> "OneVsOne":
        twin = OneVsOne(self.classifier.copy(extra), self.parallelism)
        return self._copyValues(twin)

    def _fit(self, dataset: DataFrame) -> "OneVsOneModel":
        label = self.getLabelCol()
        rows = write_and_read(dataset.select(self.getFeaturesCol(), label), "one-vs-one", (label,))
        classes = sorted(r[0] for r in rows.select(label).distinct().collect())  # classes, not rows
        pairs = list(combinations(range(len(classes)), 2))

        def fit(pair):
            low, high = (classes[i] for i in pair)
            subset = rows.filter(F.col(label).isin(low, high)).withColumn(label, (F.col(label) == high).cast("double"))
            model = self.classifier.fit(subset)
            return model.coefficients.toArray(), model.intercept

        with ThreadPool(self.parallelism) as pool:
            fitted = pool.map(fit, pairs)
        weights = np.array([w for w, _ in fitted])
        return self._copyValues(OneVsOneModel(classes, pairs, weights, np.array([b for _, b in fitted])))


class OneVsOneModel(Model, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    def __init__(self, classes=(), pairs=(), weights=None, intercepts=None):
        super().__init__()
        self.classes, self.pairs, self.weights, self.intercepts = list(classes), list(pairs), weights, intercepts

    def _transform(self, dataset: DataFrame) -> DataFrame:
        classes, pairs, weights, intercepts = self.classes, self.pairs, self.weights, self.intercepts

        @F.pandas_udf("double")
        def choose(vectors: pd.Series) -> pd.Series:
            margins = np.stack(vectors) @ weights.T + intercepts
            votes = np.zeros((len(margins), len(classes)))
            for i, (low, high) in enumerate(pairs):
                votes[:, high] += margins[:, i] > 0
                votes[:, low] += margins[:, i] <= 0
                lean = margins[:, i] / (3 * len(classes) * (np.abs(margins[:, i]) + 1))
                votes[:, high] += lean
                votes[:, low] -= lean
            return pd.Series(np.array(classes, dtype=float)[votes.argmax(axis=1)])

        if not pairs:
            return dataset.withColumn(self.getPredictionCol(), F.lit(float(classes[0])))
        return dataset.withColumn(self.getPredictionCol(), choose(vector_to_array(F.col(self.getFeaturesCol()))))


class MacroF1(Evaluator):
    """Mean F1 over classes, each class counting the same."""

    def __init__(self, label: str = "label", predicted: str = "prediction"):
        super().__init__()
        self.label, self.predicted = label, predicted

    def _evaluate(self, dataset: DataFrame) -> float:
        pairs = dataset.select(F.col(self.label).cast("double").alias("label"), F.col(self.predicted).alias("prediction"))
        return float(R.scores(R.confusion(pairs)).first()["f1_macro"])

    def isLargerBetter(self) -> bool:
        return True


def balanced_weights(data: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Add n / (classes * class size)."""
    sizes = data.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__n"))
    sizes = small_side(sizes)
    total = sizes.agg(F.sum("__n").alias("n"), F.count("*").alias("c")).first()
    return data.join(sizes, data[label].eqNullSafe(sizes["__label"])).withColumn(
        name, F.lit(float(total["n"] or 0)) / (F.lit(float(total["c"])) * F.col("__n"))).drop("__label", "__n")


def _logistic(one_vs_rest: bool = False, balanced: bool = False, **params) -> Estimator:
    if balanced:
        params["weightCol"] = "weight"
    base = LogisticRegression(family="auto" if one_vs_rest else "multinomial", **params)
    return OneVsRest(classifier=base, parallelism=8) if one_vs_rest else base


def _tree(featureSubsetStrategy: str = "all", impurity: str = "entropy", seed: int = K.RANDOM_SEED, **params) -> Estimator:
    """A forest of one tree where only a part of the features may be tried per split."""
    if featureSubsetStrategy == "all":
        return DecisionTreeClassifier(impurity=impurity, seed=seed, **params)
    return RandomForestClassifier(numTrees=1, bootstrap=False, impurity=impurity, seed=seed,
                                  featureSubsetStrategy=featureSubsetStrategy, **params)


CLASSIFIERS: dict[str, Callable[..., Estimator]] = {
    "LogisticRegression": _logistic,
    "LinearSVC": lambda **p: OneVsRest(classifier=LinearSVC(**p), parallelism=8),
    "OneVsOneClassifier": lambda **p: OneVsOne(LinearSVC(**p)),
    "DecisionTreeClassifier": _tree,
    "RandomForestClassifier": lambda seed=K.RANDOM_SEED, **p: RandomForestClassifier(seed=seed, **p),
    "GradientBoostingClassifier": lambda seed=K.RANDOM_SEED, **p: OneVsRest(
        classifier=GBTClassifier(seed=seed, **p), parallelism=8),
    "MLPClassifier": lambda seed=K.RANDOM_SEED, **p: MultilayerPerceptronClassifier(seed=seed, **p),
    "KNeighborsClassifier": lambda **p: NeighbourClassifier(method="euclidean", **p),
    "KNeighborsCosineClassifier": lambda **p: NeighbourClassifier(method="cosine", **p),
    "KNeighborsPuffinnClassifier": lambda **p: NeighbourClassifier(method="lsh", **p),
    "KNeighborsNGTClassifier": lambda **p: NeighbourClassifier(method="graph", **{"searchEpsilon": 0.1, **p}),
}


def _spark_param(kind: str, name: str, value, shape: dict):
    """(parameter, value) in Spark's terms for a common parameter name; None for those without a counterpart."""
    if name == "C":  # weight of the loss against the penalty; Spark averages the loss over the rows
        return "regParam", 1.0 / (value * shape["rows"])
    if name == "n_estimators":
        return ("numTrees" if kind == "RandomForestClassifier" else "maxIter"), value
    if name == "max_features":
        return "featureSubsetStrategy", str(value)
    if name == "hidden_layer_sizes":
        return "layers", [shape["inputs"], *value, shape["outputs"]]
    if name == "multi_class":
        return "one_vs_rest", value == "ovr"
    if name == "class_weight":
        return "balanced", value == "balanced"
    renamed = {"max_iter": "maxIter", "max_depth": "maxDepth", "criterion": "impurity", "learning_rate": "stepSize",
               "n_neighbors": "nNeighbors", "search_epsilon": "searchEpsilon", "tol": "tol"}
    return (renamed[name], value) if name in renamed else None


def _translated(kind: str, params: dict, shape: dict) -> dict:
    pairs = {name: _spark_param(kind, name, value, shape) for name, value in params.items()}
    if lost := sorted(name for name, pair in pairs.items() if pair is None):
        warnings.warn(f"{kind}: left out for want of a counterpart: {', '.join(lost)}", stacklevel=3)
    return dict(p for p in pairs.values() if p is not None)


def expand_ranges(settings: dict) -> dict:
    """Replace {from, till, step} search ranges by lists; till is included."""
    out = {}
    for name, entry in settings.items():
        entry = dict(entry)
        if "param_search_space" in entry:
            entry["param_search_space"] = {
                key: list(range(value["from"], value["till"] + 1, value.get("step", 1)))
                if isinstance(value, dict) and "from" in value else value
                for key, value in entry["param_search_space"].items()
            }
        out[name] = entry
    return out


def read_settings(path: str) -> dict:
    """Classifier settings from JSON, or from YAML where a YAML reader is installed."""
    with open(path) as handle:
        if path.endswith(".json"):
            return expand_ranges(json.load(handle))
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("reading YAML settings needs a YAML package; use JSON instead") from error
        return expand_ranges(yaml.safe_load(handle))


def data_shape(data: DataFrame, features: str = "features", label: str = "label") -> dict:
    """Rows, vector width and number of classes."""
    row = data.agg(F.count("*").alias("rows"), F.count_distinct(label).alias("outputs")).first()
    first = data.select(F.size(vector_to_array(F.col(features))).alias("n")).first()
    return {"rows": row["rows"], "outputs": row["outputs"], "inputs": first["n"]}


def build(settings: dict, shape: dict) -> dict[str, tuple[Estimator, dict]]:
    """Per configured name the estimator and its search space, in Spark's parameter names.

    Parameters of a wrapped estimator are given as `estimator: {type, params}` and searched as `estimator__name`.
    """
    built = {}
    for name, entry in settings.items():
        kind, params = entry["type"], dict(entry.get("params", {}))
        params.update(params.pop("estimator", {}).get("params", {}))
        chosen = _translated(kind, params, shape)
        space: dict = {}
        for key, values in entry.get("param_search_space", {}).items():
            found = [_spark_param(kind, key.removeprefix("estimator__"), v, shape) for v in values]
            if found and found[0] is not None:
                space[found[0][0]] = [v for _, v in found]
        if kind == "DecisionTreeClassifier" and "featureSubsetStrategy" in space:
            chosen.setdefault("featureSubsetStrategy", space["featureSubsetStrategy"][0])
        if kind == "MLPClassifier":
            chosen.setdefault("layers", space["layers"][0] if "layers" in space else [shape["inputs"], 100, shape["outputs"]])
        built[name] = (CLASSIFIERS[kind](**chosen), space)
    return built


def stratified_folds(data: DataFrame, ids: list[str], folds: int = 2, label: str = "label", seed: int = K.RANDOM_SEED) -> DataFrame:
    """Add `fold`; every class is dealt out evenly by its exact hash rank."""
    return ranked_by_hash(data, [label], ids, seed).withColumn("fold", (F.col("hash_rank") % folds).cast("int")).drop("hash_rank")


def search_parameters(estimator: Estimator, space: dict, data: DataFrame, ids: list[str], folds: int = 2, parallelism: int = 4,
                      target: Estimator | None = None) -> CrossValidatorModel:
    """Grid search over named parameters on macro F1 with stratified folds, refit on all data.

    `target` owns the parameters where the estimator wraps another one. The dealt folds are stored, since every fit and the refit read them.
    """
    owner = target or getattr(estimator, "classifier", None) or (
        estimator.getClassifier() if hasattr(estimator, "getClassifier") else estimator)
    grid = ParamGridBuilder()
    for name, values in space.items():
        grid = grid.addGrid(owner.getParam(name), values)
    search = CrossValidator(estimator=estimator, estimatorParamMaps=grid.build(), evaluator=MacroF1(), numFolds=folds,
                            foldCol="fold", seed=K.RANDOM_SEED, parallelism=parallelism)
    return search.fit(write_and_read(stratified_folds(data, ids, folds), "folds"))


def evaluate(model, test: DataFrame, label: str = "label") -> DataFrame:
    """Classification report of a fitted model."""
    predicted = model.transform(test).select(F.col(label).cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction"))
    return R.classification_report(R.confusion(predicted))


def train_and_report(train: DataFrame, test: DataFrame, settings: dict, ids: list[str], search: bool = False) -> dict[str, DataFrame]:
    """Fit every configured classifier, searching its parameters if asked, and report on the test data."""
    reports = {}
    weighted = balanced_weights(train)
    for name, (estimator, space) in build(settings, data_shape(train)).items():
        fitted = search_parameters(estimator, space, weighted, ids) if search and space else estimator.fit(weighted)
        reports[name] = evaluate(fitted, test)
    return reports
