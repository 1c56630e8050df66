"""Tables that cut a lineage, in the folder that driver and executors share, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bounds for what may be broadcast: rows, and bytes of the table's files.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 8 << 20
#: The same for what one task reads, so that loops over small tables don't deal out crumbs.
TASK_ROWS, TASK_BYTES = 100_000, 1 << 20
FILES_A_CORE = 4
_FOLDERS: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """A subfolder of spark.checkpoint.dir for this application; it goes when the application ends.

    Where the setting is missing, a local master gets a temporary folder; a cluster has none to offer, so that fails.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/loomgraph-{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of any Hadoop file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it: cuts the lineage, and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """As materialize, in FILES_A_CORE files for each core at most: for tables of numbers that loops store again and again.

    Where executors come and go with the load, the number of cores just now says little, and files are as many as tasks.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") != "true":
        df = df.coalesce(FILES_A_CORE * spark.sparkContext.defaultParallelism)
    return materialize(df, name)


def release(*tables: DataFrame | None) -> None:
    """Remove materialized tables that no plan will read any more."""
    for df in tables:
        if df is not None:
            delete(df.sparkSession, df._scratch_path)


def planned_bytes(df: DataFrame) -> int:
    """Spark's own estimate of df's size; for a materialized table, its columns' part of the files' bytes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def narrow(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it is within so many rows and BROADCAST_BYTES, else df as it is (then Spark shuffles, and
    splits skewed keys).

    Meant for materialized tables: their size is that of their files, and counting rows reads their footers only.
    """
    return F.broadcast(df) if planned_bytes(df) <= BROADCAST_BYTES and df.count() <= rows else df


def gathered(df: DataFrame) -> DataFrame:
    """df in one partition if it is within TASK_ROWS and TASK_BYTES, else as it is. Meant for materialized tables."""
    return df.coalesce(1) if planned_bytes(df) <= TASK_BYTES and df.count() <= TASK_ROWS else df
