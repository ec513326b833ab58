"""Intermediate tables in the folder that spark.checkpoint.dir names: driver and executors share it, and what stands there
survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a stored table by owner, request or fact that may be broadcast.
BROADCAST = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without one gets a folder of its own, a cluster is refused."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-factloom-")
        context.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, for loops over small tables."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, label: str, *sorted_by: str, folders: str | None = None) -> DataFrame:
    """df as a Parquet table of its own, read back: columns are pruned, and, where rows are sorted, row groups too. folders: a
    column of few values, each a folder, of which a filter on it reads its own alone."""
    path = f"{shared_dir(df.sparkSession)}/factloom/{label}-{uuid.uuid4().hex}"
    rows = (df.sortWithinPartitions(*sorted_by) if sorted_by else df).write
    (rows.partitionBy(folders) if folders else rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_buckets(df: DataFrame, label: str, buckets: int, by: list[str]) -> DataFrame:
    """df as a Parquet table of its own in so many buckets by those columns, read back: one task reads a bucket, and what is
    grouped or dealt by the columns into as many tasks is not shuffled. Only Spark's catalogue can say where buckets are; the
    name leaves it at once, the files stay."""
    name = f"factloom_{label}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", f"{shared_dir(df.sparkSession)}/factloom/{name}").bucketBy(buckets, *by).saveAsTable(name)
    held = df.sparkSession.table(name)
    df.sparkSession.sql(f"DROP TABLE {name}")
    return held


def keyed(df: DataFrame, label: str, *sorted_by: str, folders: str | None = None) -> DataFrame:
    """kept(df) for a table with a row for each owner, request or fact: where it has more than BROADCAST rows, joins shuffle it.
    Equal columns are small in Parquet, so that the optimiser would take the size of the file for that of the rows and send
    all owners through the driver."""
    held = kept(df, label, *sorted_by, folders=folders)
    return held.hint("merge") if held.count() > BROADCAST else held


def spread(df: DataFrame) -> DataFrame:
    """df on all cores where its input has fewer files than there are cores, as work that is heavy for each row would else run
    in few tasks; where files are many, nothing is moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
