"""Reading and writing flow datasets, reports and models' small tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowloom import constants as K
from flowloom.operators.prepare import exclude_files
from flowloom.schema import absent_to_null, resolve_columns


def read_flows(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, fill_missing: bool = False,
    columns: Sequence[str] | None = None, exclude: Iterable[str] = (),
) -> DataFrame:
    """Flow files (CSV with a header when a schema is given, else parquet) with their `source_file`.

    Files are left out by name patterns; `fill_missing` puts 0 into every empty cell, texts included.
    """
    if schema is None:
        raw = spark.read.parquet(*([path] if isinstance(path, str) else path))
    else:
        raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    flows = exclude_files(raw.withColumn("source_file", F.col("_metadata.file_name")), exclude)
    if columns is not None:
        present, _ = resolve_columns(flows, list(columns))
        flows = flows.select(*present)
    flows = absent_to_null(flows)
    return flows.fillna(0).fillna("0") if fill_missing else flows


def write_flows(flows: DataFrame, path: str, form: str = "parquet", max_rows_per_file: int = 0,
                partition_by: Sequence[str] = ()) -> None:
    """Write flows; arrays become JSON text in CSV. `max_rows_per_file` splits large captures."""
    out = flows
    if form == "csv":
        out = flows.select([
            F.to_json(c).alias(c) if isinstance(flows.schema[c].dataType, (T.ArrayType, T.StructType)) else F.col(c)
            for c in flows.columns
        ])
    writer = out.write.mode("errorifexists").option("maxRecordsPerFile", max_rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def write_per_class(flows: DataFrame, path: str, label: str = K.TARGET_CLASS) -> None:
    """One folder per class; a large class keeps the parallelism of its input."""
    write_flows(flows, path, partition_by=[label])


def fingerprint(flows: DataFrame) -> DataFrame:
    """One row that identifies names, types and content regardless of the order of rows: count, hash sum, hash xor.

    Every cell is hashed with a mark whether it is absent, so that values cannot move over empty cells; nested cells are
    hashed as text that keeps their empty parts.
    """
    cells = [F.lit(",".join(sorted(f"{f.name} {f.dataType.simpleString()}" for f in flows.schema)))]
    for name in sorted(flows.columns):
        cell = F.col(f"`{name}`")
        if isinstance(flows.schema[name].dataType, (T.ArrayType, T.StructType, T.MapType)):
            cell = F.to_json(F.struct(cell.alias("x")), {"ignoreNullFields": "false"})
        cells += [F.col(f"`{name}`").isNull(), cell]
    return flows.select(F.xxhash64(*cells).alias("h")).agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
        F.coalesce(F.bit_xor("h"), F.lit(0).cast("long")).alias("hash_xor"),
    )


def version_of(flows: DataFrame) -> str:
    row = fingerprint(flows).first()
    return f"{row['rows']}_{row['hash_sum'].replace('-', 'm')}_{row['hash_xor'] & 0xFFFFFFFFFFFFFFFF:016x}"


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder has ended well."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def _write_once(flows: DataFrame, path: str) -> None:
    """A folder that was written to its end is kept; what a failed write has left is replaced."""
    if not _complete(flows.sparkSession, path):
        flows.write.mode("overwrite").parquet(path)


def save_version(flows: DataFrame, folder: str) -> str:
    """Write under a path that names the content; an existing version is kept."""
    path = f"{folder.rstrip('/')}/v={version_of(flows)}"
    _write_once(flows, path)
    return path


def cached_version(source: DataFrame, folder: str, build: Callable[[DataFrame], DataFrame], name: str, **parameters) -> DataFrame:
    """The stored result of `build(source)` for this content of `source`, computed and stored on first use.

    `name` and `parameters` say what is built: other names or parameters have results of their own.
    """
    said = hashlib.sha256(json.dumps([name, parameters], sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder.rstrip('/')}/{name}-{said}/v={version_of(source)}"
    if not _complete(source.sparkSession, path):
        _write_once(build(source), path)
    return source.sparkSession.read.parquet(path)


def file_sizes(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows per file."""
    return read_flows(spark, path, schema).groupBy("source_file").agg(F.count("*").alias("flows"))


def report_table(metrics: DataFrame, row: str = "class", metric: str = "metric", value: str = "value",
                 names: Sequence[str] | None = None) -> DataFrame:
    """Long metrics to a table with one row per class."""
    grouped = metrics.groupBy(row)
    return (grouped.pivot(metric, list(names)) if names else grouped.pivot(metric)).agg(F.first(value))


def write_report(metrics: DataFrame, path: str, names: Sequence[str] | None = None) -> None:
    report_table(metrics, names=names).write.mode("errorifexists").option("header", True).csv(path)
