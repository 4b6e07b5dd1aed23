"""Reading the tables and the session settings that the operators depend on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: An ordered scan has at most so many partitions, since each sends one summary row to the driver; and so many bytes of the
#: files that it reads in each.
MAX_SCAN_PARTITIONS, SCAN_BYTES = 100_000, 256 << 20


def table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One Parquet table; ``columns`` prunes the scan and hides extra columns whose names could clash downstream."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder: the session's, else ``spark.checkpoint.dir``, else (local tests only) a temporary one."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), "lifeweave-checkpoints")
    sc.setCheckpointDir(shared)
    return shared


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: the rows survive the loss of any executor. Its files go once nothing on the
    driver refers to them any more."""
    ensure_checkpoint_dir(df.sparkSession)
    df.sparkSession.sparkContext._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder beside the reliable checkpoints, which all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/written/{name}-{uuid.uuid4().hex}"


def scan_partitions(df: DataFrame) -> int:
    """Range partitions for an ordered scan of ``df``: as many as a shuffle has, or more where the files that the plan reads ask
    for them (what comes from checkpoints has no size worth trusting and isn't counted)."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = [leaves.apply(i) for i in range(leaves.size())]
    size = sum(int(str(x.stats().sizeInBytes())) for x in files if x.getClass().getSimpleName() == "LogicalRelation")
    return max(1, min(MAX_SCAN_PARTITIONS, max(least, -(-size // SCAN_BYTES))))


def nullable(schema: T.StructType) -> T.StructType:
    """The schema with every column nullable, as rows that come back from Python are."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
