"""Tables written once to the folder that all executors share, so that what iterates does not grow its own plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def new_folder(spark: SparkSession, name: str) -> str:
    """A new name under spark.checkpoint.dir; a temporary folder only where the session names none and runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidegraph-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back."""
    path = new_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, order: str, name: str, start: int = 0) -> DataFrame:
    """df and `name`, counting rows from start + 1 by `order`: ranges are numbered apart and moved by what stands before them."""
    dealt = kept(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    before, at = {}, start
    for row in dealt.groupBy("_part").count().orderBy("_part").collect():  # a row a partition
        before[row["_part"]], at = at, at + row["count"]
    if not before:
        return dealt.withColumn(name, F.lit(None).cast("long")).drop("_part")
    moved = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair])[F.col("_part").cast("long")]
    return dealt.withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(order)) + moved).drop("_part")
