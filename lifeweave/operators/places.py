"""Named places: interval joins with items, and the nearest town."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeweave.functions.geo import haversine_m, valid_latlon

COLUMNS = ["place_id", "person", "t0", "t1", "lat", "lon", "name", "source"]
MARGIN_S, DAY_S, NEAR_DEG = 1800.0, 86_400.0, 0.02
TOWN_KM = 50.0


def places(df: DataFrame) -> DataFrame:
    """Places with a person, a start and a valid position."""
    return df.where(F.col("person").isNotNull() & F.col("t0").isNotNull() & valid_latlon("lat", "lon"))


def items_in_places(items: DataFrame, named: DataFrame) -> DataFrame:
    """photo_id, place_id, name: the last place (by start) whose interval, widened by half an hour, holds the item's time,
    that began at most a day before it and lies near the item's position, if that is known.

    Both sides meet in buckets of a day: a place that began at most a day before (or half an hour after) an item is in the
    item's bucket or a neighbouring one. A place without an end is one of its start."""
    bucket = lambda t: F.floor(t / DAY_S).cast("bigint")
    p = named.where("name <> ''").select("person", bucket(F.col("t0")).alias("bucket"), "place_id", "t0", F.coalesce("t1", "t0").alias("t1"), F.col("lat").alias("plat"), F.col("lon").alias("plon"), "name")
    reach = F.array_distinct(F.array(bucket(F.col("ts") - DAY_S), bucket(F.col("ts")), bucket(F.col("ts") + MARGIN_S)))
    q = items.select("photo_id", "person", "ts", "lat", "lon", F.explode(reach).alias("bucket"))
    hit = q.join(p, ["person", "bucket"]).where(
        (F.col("t0") - MARGIN_S <= F.col("ts")) & (F.col("ts") <= F.col("t1") + MARGIN_S) & (F.col("t0") >= F.col("ts") - DAY_S)
        & (F.col("lat").isNull() | (F.abs(F.col("plat") - F.col("lat")) + F.abs(F.col("plon") - F.col("lon")) < NEAR_DEG))
    )
    shown = F.when(F.col("name") == "Inferred Home", "Home").when(F.col("name") == "Inferred Work", "Work").otherwise(F.col("name"))
    best = hit.groupBy("photo_id").agg(F.max(F.struct("t0", "place_id", shown.alias("name"))).alias("m"))
    return best.select("photo_id", "m.place_id", "m.name")


def towns(named: DataFrame, least: int = 5) -> DataFrame:
    """town, tlat, tlon: cells of a quarter of a degree with at least so many named places, under their first name."""
    cell = [F.floor(F.col(x) * 4).cast("bigint").alias(n) for x, n in (("lat", "cy"), ("lon", "cx"))]
    found = named.where("name <> ''").groupBy(*cell).agg(F.min("name").alias("town"), F.round(F.avg("lat"), 6).alias("tlat"), F.round(F.avg("lon"), 6).alias("tlon"), F.count("*").alias("n"))
    return found.where(F.col("n") >= least).select("town", "tlat", "tlon")


def nearest_towns(items: DataFrame, towns_: DataFrame, km: float = TOWN_KM) -> DataFrame:
    """photo_id, town, tlat, km: the nearest town within ``km`` (ties by name), through a grid whose cells are as high as that and
    grow wider towards the poles; each item's cell meets the towns of its own and the neighbouring cells."""
    height = km / 111.0
    row = lambda lat: F.floor(lat / height).cast("bigint")
    # the width of the cells of a row: at least km at the row's edge nearest to the pole
    edge = lambda r: F.least(F.greatest(F.abs(r), F.abs(r + 1)) * height, F.lit(89.0))
    width = lambda r: F.least(F.lit(height) / F.cos(F.radians(edge(r))), F.lit(360.0))
    t = towns_.withColumn("row", row(F.col("tlat"))).withColumn("col", F.floor(F.col("tlon") / width(F.col("row"))).cast("bigint"))
    q = items.withColumn("row", F.explode(F.array(*[row(F.col("lat")) + d for d in (-1, 0, 1)])))
    q = q.withColumn("w", width(F.col("row")))
    cells = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("lon") / F.col("w")).cast("bigint") + d)
    # across the antimeridian the first and last columns meet
    around = F.array_union(cells, F.transform(F.array(F.lit(-360.0), F.lit(360.0)), lambda d: F.floor((F.col("lon") + d) / F.col("w")).cast("bigint")))
    q = q.withColumn("col", F.explode(F.array_distinct(around)))
    near = q.join(t, ["row", "col"]).withColumn("km", F.round(haversine_m("lat", "lon", "tlat", "tlon") / 1000, 3)).where(F.col("km") <= km)
    return near.groupBy("photo_id").agg(F.min(F.struct("km", "town", "tlat")).alias("m")).select("photo_id", "m.town", "m.tlat", "m.km")


def countries_visited(items: DataFrame, key: str, towns_: DataFrame, least: int = 1, km: float = TOWN_KM) -> DataFrame:
    """key, cc, n of countries with at least ``least`` positions (photo_id, key, lat, lon), by the nearest town's cc."""
    near = nearest_towns(items.select("photo_id", "lat", "lon"), towns_, km).join(towns_.select("town", "tlat", "cc"), ["town", "tlat"])
    return items.select("photo_id", key).join(near, "photo_id").groupBy(key, "cc").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def captions(items: DataFrame, key: str, named: DataFrame, towns_: DataFrame, countries: DataFrame) -> DataFrame:
    """photo_id, place: the named place and the town, with its region at home (the country of most items) or its country
    elsewhere. towns: town, tlat, tlon, cc, region; countries: cc, country (one row each; small dimensions)."""
    near = nearest_towns(items.where("lat IS NOT NULL").select("photo_id", "lat", "lon"), towns_).join(towns_.select("town", "tlat", "cc", "region"), ["town", "tlat"])
    at = items.select("photo_id", key).join(near, "photo_id", "left").join(named.select("photo_id", "name"), "photo_id", "left").join(countries, "cc", "left")
    per = at.where("cc IS NOT NULL").groupBy(key, "cc").agg(F.count("*").alias("n"))
    home = per.groupBy(key).agg(F.max_by("cc", F.struct("n", "cc")).alias("home"))
    at = at.join(home, key, "left")
    where = F.when((F.col("cc") == F.col("home")) & (F.col("region") != ""), F.concat_ws(", ", "town", "region")).otherwise(F.concat_ws(", ", "town", F.coalesce("country", "cc")))
    place = F.when(F.col("town").isNull(), F.coalesce("name", F.lit(""))).when((F.col("name") != "") & (F.col("name") != F.col("town")), F.concat_ws(" · ", "name", where)).otherwise(where)
    return at.select("photo_id", place.alias("place"))
