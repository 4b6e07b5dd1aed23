"""Streams of fixes and items: sessions with watermarks, windowed counts, and thinning with state.

The batch operators are the reference for results; these give the same for rows that arrive within the allowed delay.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lifeweave.operators.track import KEPT_SOURCES, THIN_M2, THIN_S
from lifeweave.session import ensure_checkpoint_dir

#: Bytes of files in one batch of a stream.
BATCH_BYTES = 4 << 30


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder as a stream of its files, at most BATCH_BYTES a batch, with the schema of what is there."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    if os.path.isfile(path):
        return spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(path)


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is available now and returns what it wrote. Output and progress lie in the shared folder,
    so the run survives the loss of an executor and, started again with the same folder, writes nothing twice."""
    spark = stream.sparkSession
    at = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4()}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def run_complete(stream: DataFrame) -> DataFrame:
    """Runs an aggregating stream over all that is available now and returns its whole result, open windows included: every
    batch replaces the result before it, which makes repeated batches harmless."""
    spark = stream.sparkSession
    at = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4()}"

    done: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/{number:09d}")
        done.append(number)

    q = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/progress").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{at}/out/{done[-1]:09d}")


def sessions(items: DataFrame, key: str, seconds: str, pause: str = "4 hours", delay: str = "7 days") -> DataFrame:
    """key, first, last, n of runs without a pause of more than ``pause``; rows later than ``delay`` are left out. A pause of
    exactly that length doesn't end a session."""
    at = items.where(F.col(key).isNotNull() & F.col(seconds).isNotNull()).withColumn("at", F.timestamp_micros(F.floor(F.col(seconds) * 1e6).cast("bigint")))
    # a session window is open at its end: one microsecond more keeps the pause itself inside
    w = F.session_window("at", f"{pause} 1 microsecond")
    return at.withWatermark("at", delay).groupBy(key, w).agg(F.min(seconds).alias("first"), F.max(seconds).alias("last"), F.count("*").alias("n")).drop("session_window")


def counts(items: DataFrame, key: str, seconds: str, window: str = "1 day", slide: str | None = None, delay: str = "7 days") -> DataFrame:
    """key, start, n for tumbling or sliding windows of time."""
    at = items.where(F.col(key).isNotNull() & F.col(seconds).isNotNull()).withColumn("at", F.timestamp_micros(F.floor(F.col(seconds) * 1e6).cast("bigint")))
    w = F.window("at", window, slide) if slide else F.window("at", window)
    return at.withWatermark("at", delay).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.unix_seconds("w.start").alias("start"), "n")


def thin(fixes: DataFrame) -> DataFrame:
    """person, t, lat, lon, src of fixes kept as they arrive: more than 30 m or 20 minutes from the last kept one, or of a kept
    source. The last kept fix of a person is the state; within a batch fixes go by time, older ones than the state are kept."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["t", "lat", "lon"], kind="stable")
        lt, la, lo = state.get if state.exists else (-np.inf, 0.0, 0.0)
        out = []
        for t, lat, lon, src in zip(pdf["t"], pdf["lat"], pdf["lon"], pdf["src"]):
            across = (lon - lo) * 111_000.0 * np.cos(np.radians(lat))
            if abs(t - lt) > THIN_S or src in KEPT_SOURCES or across * across + ((lat - la) * 111_000.0) ** 2 > THIN_M2:
                out.append((key[0], t, lat, lon, src))
                if t >= lt:
                    lt, la, lo = t, lat, lon
        state.update((float(lt), float(la), float(lo)))
        yield pd.DataFrame(out, columns=["person", "t", "lat", "lon", "src"])

    rows = fixes.select("person", "t", "lat", "lon", F.col("src").cast("int").alias("src"))
    return rows.groupBy("person").applyInPandasWithState(keep, "person string, t double, lat double, lon double, src int", "t double, lat double, lon double", "append", GroupStateTimeout.NoTimeout)
