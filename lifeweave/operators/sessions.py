"""Events: runs of a person's items without a long pause or a far jump, and what is chosen from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifeweave.functions.geo import flat_km
from lifeweave.operators.adjacent import running_sum, with_neighbours

PAUSE_S, JUMP_KM = 4 * 3600.0, 30.0


def sessionize(items: DataFrame, key: str, time: str, order: str, pause: float = PAUSE_S, jump_km: float = JUMP_KM) -> DataFrame:
    """``items`` with event (bigint from 1, within the key). A new event begins after more than ``pause`` seconds, or more
    than ``jump_km`` from the last item with a position, which may lie in an earlier event. Needs columns lat and lon
    (NULL if unknown); ties in time go by ``order``."""
    series = with_neighbours(items, key, time, order, [time], known=["lat", "lon"])
    fresh = F.col(time) - F.col("prev")[time] > pause
    far = F.col("lat").isNotNull() & (flat_km(F.col("lat"), F.col("lon"), F.col("seen.lat"), F.col("seen.lon")) > jump_km)
    starts = F.when(F.coalesce(fresh, F.lit(False)) | F.coalesce(far, F.lit(False)), 1).otherwise(0)
    flagged = series.withColumn("__starts", starts).drop("prev", "next", "seen")
    numbered = running_sum(flagged, key, time, order, F.col("__starts"), "event")
    return numbered.withColumn("event", (F.col("event") + 1).cast("bigint")).drop("__starts")


def event_table(items: DataFrame, key: str, time: str) -> DataFrame:
    """One row an event: size, t0, t1, median lat and lon of its positioned items, items that score above 1.5."""
    return items.groupBy(key, "event").agg(
        F.count("*").alias("size"), F.min(time).alias("t0"), F.max(time).alias("t1"), F.median("lat").alias("lat"), F.median("lon").alias("lon"), F.count_if(F.col("score") > 1.5).alias("liked"),
    )


def home_cells(events: DataFrame, key: str) -> DataFrame:
    """The cell of a tenth of a degree with most items, by event position; ties go to the cell of the earliest event."""
    cells = events.where("lat IS NOT NULL").groupBy(key, F.rint(F.col("lat") * 10).alias("cy"), F.rint(F.col("lon") * 10).alias("cx")).agg(F.sum("size").alias("items"), F.min("event").alias("first"))
    best = cells.groupBy(key).agg(F.max_by(F.struct("cy", "cx", "items"), F.struct("items", -F.col("first"))).alias("b"))
    return best.select(key, (F.col("b.cy") / 10).alias("home_lat"), (F.col("b.cx") / 10).alias("home_lon"), F.col("b.items").alias("items"))


def event_weight(far_from_home: Column) -> Column:
    """√size with bonuses for liked items and trips."""
    return F.sqrt(F.col("size")) * (1 + 0.15 * F.col("liked")) * F.when(far_from_home, 1.8).otherwise(1.0)


def largest_remainder(groups: DataFrame, over: list[str], weight: str, cap: str | None, total: Column | str, order: str, out: str) -> DataFrame:
    """Shares of ``total`` among the rows of each ``over`` in proportion to ``weight``: rounded down and capped, then one more
    each in the order of the remainders of the uncapped share (ties by ``order``) to those below their cap, in one pass."""
    everyone = Window.partitionBy(*over)
    share = F.col("__total") * F.col(weight) / F.sum(weight).over(everyone)
    g = groups.withColumn("__total", F.col(total) if isinstance(total, str) else total).withColumn("__raw", share)
    floor = F.floor("__raw").cast("bigint")
    limit = F.col(cap).cast("bigint") if cap else F.lit(2**62)
    g = g.withColumns({"__got": F.least(floor, limit), "__open": F.least(floor, limit) < limit, "__rest": F.col("__raw") - floor})
    queue = F.row_number().over(Window.partitionBy(*over, "__open").orderBy(F.desc(F.round("__rest", 9)), order))
    left = F.col("__total") - F.sum("__got").over(everyone)
    g = g.withColumns({"__queue": queue, "__left": left})
    return g.withColumn(out, (F.col("__got") + F.when(F.col("__open") & (F.col("__queue") <= F.col("__left")), 1).otherwise(0)).cast("bigint")).drop("__total", "__raw", "__got", "__open", "__rest", "__queue", "__left")
