"""Queries that run as streams over the files of a table until all are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeweave.functions.geo import valid_latlon
from lifeweave.streaming import tracks


def stream_daily_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes of each person and day, counted by a stream."""
    f = tracks.stream_table(spark, sf_dir, "fixes").select("person", "t")
    return tracks.run_complete(tracks.counts(f, "person", "t"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of photos without a pause of more than four hours, by a stream."""
    p = tracks.stream_table(spark, sf_dir, "photos").select("person", "ts")
    return tracks.run_complete(tracks.sessions(p, "person", "ts"))


def stream_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes kept by the streaming thinning, by person: how many, first and last."""
    f = tracks.stream_table(spark, sf_dir, "fixes").where(F.col("person").isNotNull() & F.col("t").isNotNull() & valid_latlon("lat", "lon"))
    return tracks.run_to_end(tracks.thin(f)).groupBy("person").agg(F.count("*").alias("kept"), F.min("t").alias("first"), F.max("t").alias("last"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (stream_daily_fixes, stream_sessions, stream_thinned)}
SQL: dict[str, str] = {
    "stream_daily_fixes": "SELECT person, CAST(floor(t / 86400) AS BIGINT) * 86400 AS start, count(*) AS n FROM fixes WHERE person IS NOT NULL AND t IS NOT NULL GROUP BY ALL",
    "stream_sessions": """WITH p AS (SELECT person, ts, CASE WHEN floor(ts * 1000000) - lag(floor(ts * 1000000)) OVER (PARTITION BY person ORDER BY ts) <= 14400000000 THEN 0 ELSE 1 END AS fresh FROM photos WHERE person IS NOT NULL AND ts IS NOT NULL),
      n AS (SELECT *, sum(fresh) OVER (PARTITION BY person ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM p) SELECT person, min(ts) AS first, max(ts) AS last, count(*) AS n FROM n GROUP BY person, k""",
}
