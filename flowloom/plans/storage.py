"""Where intermediate results are kept when lineage has to be cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a scratch folder only where none is configured (local tests)."""
    context = spark.sparkContext
    folder = spark.conf.get(_SETTING, None) or context.getConf().get(_SETTING) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError(f"{_SETTING} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="flowloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; all paths of one application share a parent that can be deleted after it ends."""
    return f"{shared_folder(spark).rstrip('/')}/flowloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def write_and_read(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Materialise once as parquet in the shared folder, so a costly plan is not run per consumer.

    The table survives the loss of executors, ends the lineage and tells Spark its size.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of `write_and_read` that nothing will read again; anything else is left alone."""
    for table in tables:
        if (path := getattr(table, "stored_at", None)) is not None:
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def small_side(df: DataFrame, limit: int = 100_000, chars: int = 32 << 20) -> DataFrame:
    """A side of a join that is usually tiny: literal rows to broadcast when it has at most `limit` rows and `chars` characters as text, else a
    stored table.

    Deciding now spares the large side a shuffle that adaptive execution would start before it knows the size.
    """
    stored = write_and_read(df, "side")
    size = stored.agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    if size[0] > limit or size[1] > chars:
        return stored
    rows = stored.collect()  # size checked above
    return F.broadcast(df.sparkSession.createDataFrame(rows, stored.schema))
