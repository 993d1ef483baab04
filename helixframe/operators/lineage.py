"""Cutting lineage where a plan would read one intermediate table many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a local master; a cluster's
    machines couldn't read it, so there it is an error.
    """
    context = spark.sparkContext
    set_already = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (set_already.get() if set_already.isDefined() else None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="helixframe-")
    if set_already.isEmpty():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder: worked out once (a checkpoint does it twice), columns packed."""
    return stored(df, "cut")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str = "input_order") -> DataFrame:
    """df with a number from 1 by `order` (ties in any order), without one window over all rows.

    Rows are dealt by ranges of `order`; each range is numbered on its own, from
    the number of rows in the ranges before it (a row a range on the driver).
    """
    parts = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = sorted(tuple(r) for r in parts.groupBy("__range").count().collect())
    before, so_far = [], 0
    for part, n in sizes:
        before.append((part, so_far))
        so_far += n
    offsets = df.sparkSession.createDataFrame(before, "__range int, __before long")
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return parts.join(F.broadcast(offsets), "__range").withColumn(name, own + F.col("__before")).drop("__range", "__before")
