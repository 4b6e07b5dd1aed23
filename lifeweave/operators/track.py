"""Cleaning of movement tracks: teleports, thinning, daily positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifeweave.functions.geo import haversine_m, valid_latlon
from lifeweave.operators.adjacent import with_neighbours
from lifeweave.operators.intervals import label_islands

# Origins of a fix. Fixes of photos, check-ins and posts are always kept.
RECORDS, SEMANTIC, TIMELINE, PHOTO, CHECKIN, GPX, POST, FIT = range(8)
KEPT_SOURCES = (PHOTO, CHECKIN, POST)
MAX_KMH, MIN_JUMP_M = 1200.0, 50_000.0
THIN_M2, THIN_S = 900.0, 1200.0


def admitted(fixes: DataFrame) -> DataFrame:
    """Fixes with a time and a valid position."""
    return fixes.where(F.col("person").isNotNull() & F.col("t").isNotNull() & valid_latlon("lat", "lon"))


def drop_teleports(fixes: DataFrame, order: str = "fix_id", passes: int = 2) -> DataFrame:
    """Without interior fixes that can only be reached and left at more than MAX_KMH, and lie more than MIN_JUMP_M from
    the one before; twice, as a removal makes new neighbours. Tracks of fewer than three fixes stay."""
    columns = fixes.columns
    kmh = lambda d, dt: d / F.greatest(dt, F.lit(1.0)) * 3.6
    for _ in range(passes):
        near = with_neighbours(fixes, "person", "t", order, ["t", "lat", "lon"])
        reach = haversine_m("prev.lat", "prev.lon", "lat", "lon")
        leave = haversine_m("lat", "lon", "next.lat", "next.lon")
        bad = (kmh(reach, F.col("t") - F.col("prev.t")) > MAX_KMH) & (kmh(leave, F.col("next.t") - F.col("t")) > MAX_KMH) & (reach > MIN_JUMP_M)
        fixes = near.where(~F.coalesce(bad, F.lit(False))).select(columns)
    return fixes


def thin(fixes: DataFrame, order: str = "fix_id") -> DataFrame:
    """Only fixes more than 30 m from the last kept one, or more than 20 minutes later, or of a kept source; and the first
    and last of each person.

    A fix more than 20 minutes after its predecessor is kept whatever came before, so the track falls into independent
    stretches there: these are found by the range-partitioned scan and folded one after the other in sorted streams."""
    columns = fixes.columns
    ends = fixes.groupBy("person").agg(F.max(F.struct("t", order)).alias("__end"))
    stretches = label_islands(fixes.select("person", "t", "lat", "lon", F.col("src").cast("int").alias("src"), order), ["person"], "t", F.col("t") + THIN_S, "stretch")
    keys = ["person", "stretch"]
    ordered = stretches.repartition(*keys).sortWithinPartitions(*keys, "t", order)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, lt, la, lo = None, 0.0, 0.0, 0.0
        for pdf in batches:
            if not len(pdf):
                continue
            t, lat, lon = (pdf[x].to_numpy(dtype=float) for x in ("t", "lat", "lon"))
            across = 111_000.0 * np.cos(np.radians(lat))
            keep = pdf["src"].isin(KEPT_SOURCES).to_numpy().tolist()
            person, stretch = pdf["person"].tolist(), pdf["stretch"].tolist()
            for i, (ti, ai, oi, ci) in enumerate(zip(t.tolist(), lat.tolist(), lon.tolist(), across.tolist())):
                k = (person[i], stretch[i])
                if k != key or keep[i] or ti - lt > THIN_S or ((oi - lo) * ci) ** 2 + ((ai - la) * 111_000.0) ** 2 > THIN_M2:
                    keep[i] = True
                    key, lt, la, lo = k, ti, ai, oi
            yield pdf[["person", order]][keep]

    kept = ordered.mapInPandas(fold, f"person string, {order} bigint")
    last = ends.select("person", F.col(f"__end.{order}").alias(order))
    return fixes.join(kept.unionByName(last).distinct(), ["person", order], "left_semi").select(columns)


def daily_positions(fixes: DataFrame) -> DataFrame:
    """person, day and the medians of t, lat and lon."""
    day = F.floor(F.col("t") / 86400).cast("bigint")
    return fixes.groupBy("person", day.alias("day")).agg(F.median("t").alias("t"), F.median("lat").alias("lat"), F.median("lon").alias("lon"), F.count("*").alias("fixes"))


def travelled_km(daily: DataFrame) -> DataFrame:
    """person, whole kilometres between successive daily positions, and days."""
    w = Window.partitionBy("person").orderBy("day")
    leg = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")
    return daily.withColumn("__leg", leg).groupBy("person").agg(F.floor(F.coalesce(F.sum("__leg"), F.lit(0.0)) / 1000).cast("bigint").alias("km"), F.count("*").alias("days"))
