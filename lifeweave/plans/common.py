"""Views that several queries start from, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeweave.functions.geo import valid_latlon
from lifeweave.session import table

PHOTO_COLUMNS = ["photo_id", "person", "uri", "ts", "lat", "lon", "source", "title", "description", "favorite", "views", "album", "shared", "ts_origin", "kind", "origin"]


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos with a person and a time; the unknown position is NULL."""
    p = table(spark, sf_dir, "photos", PHOTO_COLUMNS).where("person IS NOT NULL AND ts IS NOT NULL AND NOT isnan(ts)")
    ok = valid_latlon("lat", "lon")
    return p.withColumns({"lat": F.when(ok, F.col("lat")), "lon": F.when(ok, F.col("lon")), "favorite": F.coalesce("favorite", F.lit(False)), "shared": F.coalesce("shared", F.lit(False)), "title": F.coalesce("title", F.lit("")), "description": F.coalesce("description", F.lit("")), "views": F.coalesce("views", F.lit(0))})


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fixes", ["fix_id", "person", "t", "lat", "lon", "src"])
    return f.where(F.col("person").isNotNull() & F.col("t").isNotNull() & valid_latlon("lat", "lon"))


_VALID = "coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (abs(lat) < 1e-6 AND abs(lon) < 1e-6), false)"

SQL_PHOTO = f"""photo AS (
  SELECT photo_id, person, uri, ts, CASE WHEN {_VALID} THEN lat END AS lat, CASE WHEN {_VALID} THEN lon END AS lon, source, coalesce(title, '') AS title, coalesce(description, '') AS description,
    coalesce(favorite, false) AS favorite, coalesce(views, 0) AS views, album, coalesce(shared, false) AS shared, ts_origin, kind, origin
  FROM photos WHERE person IS NOT NULL AND ts IS NOT NULL AND NOT isnan(ts))"""

SQL_FIX = f"fix AS (SELECT fix_id, person, t, lat, lon, src FROM fixes WHERE person IS NOT NULL AND t IS NOT NULL AND {_VALID})"


def sql_haversine(a1: str, o1: str, a2: str, o2: str) -> str:
    h = f"pow(sin(radians({a2} - {a1}) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) * pow(sin(radians({o2} - {o1}) / 2), 2)"
    return f"(12742000.0 * asin(sqrt(least(greatest({h}, 0.0), 1.0))))"


def sql_flat_km(a1: str, o1: str, a2: str, o2: str) -> str:
    return f"(sqrt(pow(radians({a2} - {a1}), 2) + pow(radians({o2} - {o1}) * cos(radians(({a1} + {a2}) / 2)), 2)) * 6371.0)"


SQL_SCORE = (
    "(3.0 * CAST(favorite AS INT) + 2.0 * CAST(shared AS INT) + 0.6 * ln(1.0 + greatest(views, 0)) + CAST(description <> '' AS INT) + 0.3 * CAST(lat IS NOT NULL AS INT)"
    " - 1.5 * CAST(regexp_matches(title, '(?i)-WA\\d+|^received_|telegram|viber|^FB_IMG|^Messenger_') AS INT))"
)
SQL_SKIP = "regexp_matches(title, '(?i)screenshot|screen[ _-]?shot|screen[ _-]?record|rpreplay|снимок экрана|скриншот|bildschirmfoto|captura')"


def sql_file_time(name: str) -> str:
    """Unix seconds that a file name tells; RE2 has no lookaround, so what stands before and after the match is matched too."""
    part = lambda i: f"regexp_extract({name}, '(?:^|[^0-9])((?:19|20)\\d\\d)[-_.]?(\\d\\d)[-_.]?(\\d\\d)[-_ T.]?(\\d\\d)[-_.:]?(\\d\\d)[-_.:]?(\\d\\d)(\\d*)', {i})"
    text = " || ".join([part(1), "'-'", part(2), "'-'", part(3), "' '", part(4), "':'", part(5), "':'", part(6)])
    return f"CASE WHEN {part(1)} <> '' AND length({part(7)}) < 3 THEN CAST(epoch(TRY_CAST({text} AS TIMESTAMP)) AS DOUBLE) END"
