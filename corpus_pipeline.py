"""From raw documents to a training mix: five stages, each over all rows that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.llm import decontaminate, line_dedup, mixing, near_text, quality, simhash
from flowloom.llm.components import merged
from flowloom.plans.storage import write_and_read


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the certified quality rules reject go."""
    return quality.filter_documents(docs, _table(spark, sf_dir, "labels"))


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of three lines that came before are cut out of texts; n_chars follows where a text changes."""
    cut = line_dedup.remove_repeats(docs)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col("__removed") > 0, length).otherwise(F.col("n_chars")))
    return cut.drop("__removed")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash fingerprints within 3 bits, or five-word shingles similar to 0.8 or more."""
    prints = write_and_read(simhash.near_duplicates(docs, with_key=True), "prints")
    shingled = write_and_read(near_text.near_duplicates(docs), "shingled")
    return simhash.first_of_each(docs, merged(shingled, prints))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_documents(docs, _table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_repeats),
    ("near-dedup", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("source mixing", source_mix),
]

#: XXH64 fingerprints, MinHash bands and components are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stored and read again as the next one's input."""
    docs = _table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = write_and_read(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
