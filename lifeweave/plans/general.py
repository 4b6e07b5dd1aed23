"""Queries of the general data-preparation operators: interval merging, mobility segmentation, time normalisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeweave.operators.intervals import merge_intervals
from lifeweave.operators.mobility import stops_and_trips
from lifeweave.operators.stamps import normalise_stamps
from lifeweave.session import table

WEEK_S = 7 * 86400


def _millis(c: str) -> F.Column:
    """Unix milliseconds of seconds held in a double; the tables hold whole milliseconds, so rounding restores them."""
    return F.round(F.col(c) * 1000).cast("bigint")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods covered by a person's place intervals, and the gaps of at most a week between them."""
    places = table(spark, sf_dir, "places", ["person", "t0", "t1"])
    out = merge_intervals(places.select("person", F.round(F.col("t0") * 1000).alias("a"), F.round(F.col("t1") * 1000).alias("b")), "person", "a", "b", max_gap=WEEK_S * 1000)
    return out.select("person", "kind", F.col("a").cast("bigint").alias("start_ms"), F.col("b").cast("bigint").alias("end_ms"))


def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per person: periods, gaps (of any length) and the time they take, in milliseconds."""
    places = table(spark, sf_dir, "places", ["person", "t0", "t1"])
    out = merge_intervals(places.select("person", F.round(F.col("t0") * 1000).alias("a"), F.round(F.col("t1") * 1000).alias("b")), "person", "a", "b")
    length, period = F.col("b") - F.col("a"), F.col("kind") == "period"
    return out.groupBy("person").agg(
        F.count_if(period).alias("periods"), F.count_if(~period).alias("gaps"),
        F.sum(F.when(period, length).otherwise(0)).cast("bigint").alias("covered_ms"), F.sum(F.when(~period, length).otherwise(0)).cast("bigint").alias("gap_ms"),
    )


_P1_ISLANDS = """
    WITH rows AS (SELECT DISTINCT person, CAST(round(t0 * 1000) AS BIGINT) a, CAST(round(t1 * 1000) AS BIGINT) b FROM places WHERE person IS NOT NULL AND t1 > t0),
    marked AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY person ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END fresh FROM rows),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY person ORDER BY a, b ROWS UNBOUNDED PRECEDING) island FROM marked),
    periods AS (SELECT person, min(a) a, max(b) b FROM numbered GROUP BY person, island),
    gaps AS (SELECT person, lag(b) OVER (PARTITION BY person ORDER BY a) a, a b FROM periods)
"""


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops and trips of each person, in whole hours."""
    out = stops_and_trips(table(spark, sf_dir, "fixes", ["person", "t", "lat", "lon", "acc"]))
    hour = lambda c: F.floor(F.col(c) / 3600).cast("bigint")
    return out.select("person", "kind", hour("start").alias("start_hour"), hour("end").alias("end_hour"))


def p2_mobility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per person: stops, trips, hours stopped and travelled, kilometres of trips."""
    out = stops_and_trips(table(spark, sf_dir, "fixes", ["person", "t", "lat", "lon", "acc"]))
    stop, hours = F.col("kind") == "stop", (F.col("end") - F.col("start")) / 3600
    return out.groupBy("person").agg(
        F.count_if(stop).alias("stops"), F.count_if(~stop).alias("trips"),
        F.round(F.sum(F.when(stop, hours).otherwise(0)), 3).alias("stop_hours"), F.round(F.sum(F.when(~stop, hours).otherwise(0)), 3).alias("trip_hours"),
        F.round(F.sum("distance") / 1000, 3).alias("trip_km"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant of each raw time value that denotes exactly one."""
    stamps = table(spark, sf_dir, "stamps", ["stamp_id", "raw_value", "zone_name", "locale_code"])
    return normalise_stamps(stamps).where(F.col("utc_ms").isNotNull()).select("stamp_id", "utc_ms")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_coverage": p1_coverage, "p2_found": p2_found, "p2_mobility": p2_mobility, "p4_found": p4_found}

SQL: dict[str, str] = {
    "p1_found": _P1_ISLANDS
    + f"""
    SELECT person, 'period' AS kind, a AS start_ms, b AS end_ms FROM periods
    UNION ALL SELECT person, 'gap' AS kind, a AS start_ms, b AS end_ms FROM gaps WHERE a IS NOT NULL AND b - a <= {WEEK_S * 1000}""",
    "p1_coverage": _P1_ISLANDS
    + """
    SELECT p.person, p.periods, coalesce(g.gaps, 0) AS gaps, p.covered_ms, coalesce(g.gap_ms, 0) AS gap_ms
    FROM (SELECT person, count(*) AS periods, CAST(sum(b - a) AS BIGINT) AS covered_ms FROM periods GROUP BY person) p
    LEFT JOIN (SELECT person, count(*) AS gaps, CAST(sum(b - a) AS BIGINT) AS gap_ms FROM gaps WHERE a IS NOT NULL GROUP BY person) g USING (person)""",
}
