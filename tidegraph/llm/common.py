"""What the operators share: a folder that all executors see, tables cut off from their lineage, columns."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(module: str) -> None:
    """Functions of the module travel to the executors with the job, which need not have it installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)
#: Models that a Python worker keeps between tasks.
KEPT = 2
#: Rows up to which a side of a join is broadcast, which passes through the driver's memory.
SHIPPED = 1 << 17


def forget() -> None:
    """Give back what this Python worker keeps of other operators, before work that needs its memory."""
    state = sys.modules.get("_tidegraph_worker")
    if state is not None and vars(state).pop("kept", None):
        import ctypes
        import gc

        gc.collect()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)


def kept_by_worker(key: str, build):
    """build(), once for each Python worker: shipped code has globals of its own in each task, this outlives them. The last KEPT are kept."""
    state = sys.modules.setdefault("_tidegraph_worker", types.ModuleType("_tidegraph_worker")).__dict__.setdefault("kept", {})
    if key not in state:
        while len(state) >= KEPT:
            state.pop(next(iter(state)))
        state[key] = build()
    return state[key]


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder as a URI; a temporary one only where the session names none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidegraph-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: lineage ends here and nothing is computed twice."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialise` wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """From now on at most so many rows to an Arrow batch in this session: texts may be long, and a batch is held several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def ascii_lower(col: Column) -> Column:
    """A-Z only; other letters stay, unlike lower()."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """Whether df, a table, has at most max_rows rows."""
    return df.count() <= max_rows


def apart(df: DataFrame, rows: int) -> DataFrame:
    """df, a side of a join of at most so many rows: up to SHIPPED it is broadcast, beyond both sides are sorted and merged. The planner goes by
    the bytes of files, which tell little: rows that are exploded or pack well it would send through the driver, for a few rows in
    many small files it would deal out both sides to all partitions."""
    return df.hint("merge") if rows > SHIPPED else F.broadcast(df)
