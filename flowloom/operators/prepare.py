"""Labelled flow datasets: file rules, classes, garbage removal, deduplication, pruning, splits."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from flowloom import constants as K
from flowloom.functions import columns as C
from flowloom.operators.packets import multi_packet_flows
from flowloom.plans.running import hash_order, ranked_by_hash
from flowloom.plans.storage import small_side


def exclude_files(flows: DataFrame, patterns: Iterable[str] = (), name: str = "source_file") -> DataFrame:
    """Without the files whose name holds any pattern."""
    patterns = tuple(patterns or ())
    return flows.filter(~C.matches_any(F.col(name), patterns)) if patterns else flows


def route_files(flows: DataFrame, categories: Iterable[str] = K.DEVICE_CATEGORIES) -> DataFrame:
    """Strip the split prefix of the file name and mark flows of device captures.

    The category is the text before the first `_`, so a category that itself holds `_` never matches.
    """
    named = flows.withColumn("source_file", C.base_file_name(F.col("source_file")))
    return named.withColumn("is_device", C.is_one_of(F.substring_index("source_file", "_", 1), categories))


def label_flows(flows: DataFrame) -> DataFrame:
    """Class of a routed flow: a common protocol, else the device category, else the application."""
    own = F.when(F.col("is_device"), C.device_class(F.col("source_file"))).otherwise(C.application_name(F.col("ndpi_app")))
    return flows.withColumn(K.TARGET_CLASS, F.coalesce(C.common_protocol(F.col("ndpi_app")), own))


def remove_garbage(flows: DataFrame) -> DataFrame:
    """Device flows are judged by their label, other flows by their class; flows without a label stay."""
    device = C.is_one_of(F.col("ndpi_app"), K.GARBAGE_PROTOCOLS)
    usual = C.is_one_of(F.col(K.TARGET_CLASS), K.GARBAGE_APPLICATIONS)
    return flows.filter(~F.when(F.col("is_device"), device).otherwise(usual))


def prepare_dataset(flows: DataFrame, drop_garbage: bool = True, exclude: Iterable[str] = ()) -> DataFrame:
    """Exclude files, route, label and clean: every step is a row expression, so nothing is shuffled."""
    labelled = label_flows(route_files(exclude_files(flows, exclude)))
    return (remove_garbage(labelled) if drop_garbage else labelled).drop("is_device")


def union_datasets(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def drop_duplicate_flows(flows: DataFrame, protocol: str, left: str, right: str, order: Sequence[str]) -> DataFrame:
    """The first flow per protocol and unordered endpoint pair.

    Ranking with a limit of one keeps a single row per key and input task before the shuffle.
    """
    pair = Window.partitionBy("__proto", "__ends").orderBy(*order)
    return (
        flows.withColumn("__proto", F.col(protocol))
        .withColumn("__ends", F.array_sort(F.array(left, right)))  # an absent endpoint is an endpoint
        .withColumn("__rn", F.row_number().over(pair))
        .filter("__rn = 1")
        .select(*flows.columns)
    )


def class_counts(flows: DataFrame, label: str = K.TARGET_CLASS) -> DataFrame:
    return flows.groupBy(label).agg(F.count("*").alias("flows"))


def rare_classes(flows: DataFrame, floor: int = K.CLASS_FLOOR, label: str = K.TARGET_CLASS) -> DataFrame:
    return class_counts(flows.filter(F.col(label).isNotNull()), label).filter(F.col("flows") < floor).select(label)


def prune_classes(
    flows: DataFrame, floor: int = K.CLASS_FLOOR, pruned: DataFrame | None = None, label: str = K.TARGET_CLASS
) -> tuple[DataFrame, DataFrame]:
    """Without the classes below the floor (or without a given list); also returns the list.

    Classes are counted first, so the rows themselves are only filtered while the list is small.
    """
    rare = small_side(rare_classes(flows, floor, label)) if pruned is None else pruned
    return flows.join(rare, label, "left_anti").select(*flows.columns), rare


def train_and_test(
    train: Sequence[DataFrame], test: DataFrame, protocol: str, left: str, right: str, order: Sequence[str],
    floor: int = K.CLASS_FLOOR,
) -> tuple[DataFrame, DataFrame]:
    """Union, deduplicate and prune the training parts; the test part loses the classes pruned there."""
    whole = drop_duplicate_flows(union_datasets(*train), protocol, left, right, order)
    kept, rare = prune_classes(whole, floor)
    tested, _ = prune_classes(drop_duplicate_flows(test, protocol, left, right, order), pruned=rare)
    return kept, tested


def class_caps(flows: DataFrame, cap: int = K.CLASS_CAP, label: str = K.TARGET_CLASS) -> DataFrame:
    """How many flows to generate per class."""
    return class_counts(flows, label).withColumn("to_generate", F.least("flows", F.lit(cap).cast("long")))


def shuffled(flows: DataFrame, ids: Sequence[str], seed: int = K.RANDOM_SEED) -> DataFrame:
    """A reproducible random order: it depends on the seed and the ids only."""
    return flows.orderBy(hash_order(seed, *ids), *ids)


def of_class(flows: DataFrame, target: str, label: str = K.TARGET_CLASS) -> DataFrame:
    return flows.filter(F.col(label) == target)


def stratified_split(
    flows: DataFrame, label: str, ids: Sequence[str], test_share: float = 0.25, seed: int = K.RANDOM_SEED
) -> DataFrame:
    """Add `is_test`: exactly round(share * size) rows of every class, chosen by seeded hash of the ids."""
    sizes = flows.groupBy(F.col(label).alias("__label")).agg(
        F.round(F.count("*") * F.lit(test_share)).cast("long").alias("__wanted")
    )
    sizes = small_side(sizes)
    ranked = ranked_by_hash(flows, [label], ids, seed)
    return ranked.join(sizes, ranked[label].eqNullSafe(sizes["__label"]), "inner").select(
        *flows.columns, (F.col("hash_rank") < F.col("__wanted")).alias("is_test")
    )


def random_split(flows: DataFrame, ids: Sequence[str], train_share: float = 0.9, seed: int = K.RANDOM_SEED) -> DataFrame:
    """Add `is_test` by hash, without regard to classes and without a shuffle."""
    unit = F.pmod(hash_order(seed, *ids), F.lit(1 << 20)) / float(1 << 20)
    return flows.withColumn("is_test", unit >= train_share)


def sequence_dataset(
    flows: DataFrame, mode: str = "plain", exclude: Iterable[str] = (), target: str | None = None,
    ids: Sequence[str] = ("flow_id",), seed: int = K.RANDOM_SEED, ordered: bool = True,
) -> DataFrame:
    """Flows for sequence models: `class` (one class), `labelled` (with class tokens) or `plain`."""
    if mode not in ("class", "labelled", "plain"):
        raise ValueError(f"unknown mode {mode!r}")
    if (mode == "class") != (target is not None):
        raise ValueError("a target class goes with mode 'class' only")
    if mode == "class":
        return of_class(flows, target)
    if mode == "labelled":
        chosen = multi_packet_flows(prepare_dataset(flows, drop_garbage=False, exclude=exclude))
    else:
        chosen = multi_packet_flows(exclude_files(flows, exclude))
    return shuffled(chosen, ids, seed) if ordered else chosen
