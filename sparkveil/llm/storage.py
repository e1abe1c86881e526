"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, so a lost executor costs a re-read, never a recomputation
of everything before. Only where the session names no such folder and runs on one machine (local tests) is one made there.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_local: dict[str, str] = {}
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; in a local session without one, a folder of this machine."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{_KEY} must name a folder that all executors share")
        found = _local.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="sparkveil-"))
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back; what the step left in the driver and on the executors' disks goes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sparkveil-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _written.append(path)
    release(spark)
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``df``; its readers must be done."""
    path = getattr(df, "_stored_at", None)
    if path:
        _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Delete every table that this process's operators have written; their results must have been written elsewhere by then."""
    for path in list(_written):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


def release(spark: SparkSession) -> None:
    """Let the driver collect what finished steps left, so that their shuffle files go from the executors' disks."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
