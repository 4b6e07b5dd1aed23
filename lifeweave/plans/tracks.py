"""Queries of movement tracks and of enrichment: cleaning, positions at given times, places, cities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeweave.functions import scalar
from lifeweave.functions.geo import lat_of, lon_of, world_x, world_y
from lifeweave.operators import places as ops
from lifeweave.operators import track
from lifeweave.operators.asof import nearest, neighbours, position_at
from lifeweave.plans.common import SQL_FIX, SQL_PHOTO, fixes, photos, sql_haversine
from lifeweave.session import checkpoint, table


def teleport_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes left after removing teleports."""
    return track.drop_teleports(fixes(spark, sf_dir)).select("fix_id", "person")


def _sql_teleport(src: str, out: str) -> str:
    return f"""
{out}0 AS (SELECT *, {sql_haversine("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} AS d1, {sql_haversine("lat", "lon", "lead(lat) OVER w", "lead(lon) OVER w")} AS d2, t - lag(t) OVER w AS g1, lead(t) OVER w - t AS g2
  FROM {src} WINDOW w AS (PARTITION BY person ORDER BY t, fix_id)),
{out} AS (SELECT * EXCLUDE (d1, d2, g1, g2) FROM {out}0 WHERE NOT coalesce(d1 / greatest(g1, 1.0) * 3.6 > 1200 AND d2 / greatest(g2, 1.0) * 3.6 > 1200 AND d1 > 50000, false))"""


_SQL_CLEAN = SQL_FIX + "," + _sql_teleport("fix", "c1") + "," + _sql_teleport("c1", "c2")


def thin_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes left after cleaning and thinning."""
    clean = checkpoint(track.drop_teleports(fixes(spark, sf_dir)))  # read three times below
    return track.thin(clean).select("fix_id", "person")


_SQL_THIN = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY t, fix_id) AS n, count(*) OVER (PARTITION BY person) AS m FROM c2),
fold AS (
  SELECT person, n, fix_id, true AS keep, t AS lt, lat AS la, lon AS lo FROM numbered WHERE n = 1
  UNION ALL
  SELECT person, n, fix_id, k, CASE WHEN k THEN t ELSE lt END, CASE WHEN k THEN lat ELSE la END, CASE WHEN k THEN lon ELSE lo END FROM (
    SELECT x.*, f.lt, f.la, f.lo, (pow((x.lat - f.la) * 111000.0, 2) + pow((x.lon - f.lo) * 111000.0 * cos(radians(x.lat)), 2) > 900 OR x.t - f.lt > 1200 OR x.src IN (3, 4, 6)) AS k
    FROM fold f JOIN numbered x ON x.person = f.person AND x.n = f.n + 1))
SELECT f.fix_id, f.person FROM fold f JOIN numbered x ON x.person = f.person AND x.n = f.n WHERE keep OR x.n = x.m"""


def daily_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median position of each day."""
    d = track.daily_positions(fixes(spark, sf_dir))
    return d.select("person", "day", F.round("t", 1).alias("t"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), "fixes")


def track_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kilometres between daily positions."""
    return track.travelled_km(track.daily_positions(fixes(spark, sf_dir)))


def track_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes of all origins by person: movement track, positioned photos (but not post times) and named places."""
    f = fixes(spark, sf_dir).select("person", "t", "lat", "lon", F.col("src").cast("int").alias("src"))
    p = photos(spark, sf_dir).where("lat IS NOT NULL AND ts_origin <> 'post'").select("person", F.col("ts").alias("t"), "lat", "lon", F.lit(track.PHOTO).alias("src"))
    c = ops.places(table(spark, sf_dir, "places", ops.COLUMNS)).where("source = 'facebook'").select("person", F.col("t0").alias("t"), "lat", "lon", F.lit(track.CHECKIN).alias("src"))
    return f.unionByName(p).unionByName(c).groupBy("person", "src").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photos(spark, sf_dir).select("photo_id", "person", "ts")


def _world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixes(spark, sf_dir).select("person", "t", world_x("lon").alias("mx"), world_y("lat").alias("my"))


def nearest_fix_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every photo the fix nearest in time, at most three hours away."""
    near = neighbours(_asked(spark, sf_dir), fixes(spark, sf_dir).select("person", "t", "fix_id", "lat", "lon"), "person", "ts", "t", ["fix_id", "lat", "lon"], at_is_next=True)
    got = near.select("photo_id", "ts", nearest("prev", "next", "ts", "t", 3 * 3600.0).alias("n")).where("n IS NOT NULL")
    return got.select("photo_id", F.round(F.abs(F.col("ts") - F.col("n.t")), 3).alias("gap"), F.round("n.lat", 6).alias("lat"), F.round("n.lon", 6).alias("lon"))


def _positions(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    near = neighbours(_asked(spark, sf_dir), _world(spark, sf_dir), "person", "ts", "t", ["mx", "my"])
    x, y = position_at("prev", "next", "ts", "t", "mx", "my", strict)
    found = near.select("photo_id", x.alias("x"), y.alias("y")).where("x IS NOT NULL")
    return found.select("photo_id", F.round(lat_of("y"), 5).alias("lat"), F.round(lon_of("x"), 5).alias("lon"))


def position_at_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of the track at each photo's time; across gaps the last fix holds."""
    return _positions(spark, sf_dir, False)


def position_at_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same; across gaps in which the person moved only near a fix."""
    return _positions(spark, sf_dir, True)


_SQL_WORLD = f"""{SQL_FIX}, {SQL_PHOTO},
world AS (SELECT person, t, (lon + 180.0) / 360.0 AS mx, (1 - ln(tan(radians(least(greatest(lat, -85.0511), 85.0511))) + 1 / cos(radians(least(greatest(lat, -85.0511), 85.0511)))) / pi()) / 2 AS my FROM fix)"""


def sql_positions(strict: bool, asked: str = "photo", at: str = "ts", key: str = "person", keep: str = "photo_id", world: str = "world", name: str = "pos") -> str:
    """CTEs with x and y of ``world`` at the times of ``asked``."""
    near = f"WHEN moved THEN CASE WHEN b <= 21600 AND b <= a THEN {{p}} WHEN a <= 21600 THEN {{n}} END" if strict else ""
    of = lambda v: f"CASE WHEN both_known AND nt - pt <= 21600 THEN p{v} + CASE WHEN nt > pt THEN b / (nt - pt) ELSE 0 END * (n{v} - p{v}) {near.format(p='p' + v, n='n' + v)} WHEN b <= 172800 THEN p{v} WHEN a <= 172800 THEN n{v} END"
    return f"""
{name}p AS (SELECT q.*, w.t AS pt, w.mx AS pmx, w.my AS pmy FROM {asked} q ASOF LEFT JOIN (SELECT {key} AS k, t, max(struct_pack(mx := mx, my := my)) AS v, max(struct_pack(mx := mx, my := my)).mx AS mx, max(struct_pack(mx := mx, my := my)).my AS my FROM {world} GROUP BY ALL) w ON q.{key} = w.k AND q.{at} >= w.t),
{name}n AS (SELECT q.*, w.t AS nt, w.mx AS nmx, w.my AS nmy FROM {name}p q ASOF LEFT JOIN (SELECT {key} AS k, t, min(struct_pack(mx := mx, my := my)).mx AS mx, min(struct_pack(mx := mx, my := my)).my AS my FROM {world} GROUP BY ALL) w ON q.{key} = w.k AND q.{at} < w.t),
{name}g AS (SELECT *, {at} - pt AS b, nt - {at} AS a, pt IS NOT NULL AND nt IS NOT NULL AS both_known, coalesce(sqrt(pow(nmx - pmx, 2) + pow(nmy - pmy, 2)) > 6e-4, false) AS moved FROM {name}n),
{name} AS (SELECT {keep}, {of("mx")} AS x, {of("my")} AS y FROM {name}g)"""


def photo_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named place in which each photo was taken."""
    return ops.items_in_places(photos(spark, sf_dir), ops.places(table(spark, sf_dir, "places", ops.COLUMNS)))


def nearest_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest town of every positioned photo, at most fifty kilometres away. The towns are an input: here the
    most named grid cells of the places table."""
    items = photos(spark, sf_dir).where("lat IS NOT NULL").select("photo_id", "lat", "lon")
    return ops.nearest_towns(items, ops.towns(ops.places(table(spark, sf_dir, "places", ops.COLUMNS)))).select("photo_id", "town", "km")


def place_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date and place captions: the named place, else the nearest town, else nothing."""
    p = photos(spark, sf_dir)
    named = photo_in_place(spark, sf_dir).select("photo_id", F.col("name").alias("place"))
    town = nearest_city(spark, sf_dir).select("photo_id", "town")
    out = p.join(named, "photo_id", "left").join(town, "photo_id", "left")
    return out.select("photo_id", scalar.caption_date("ts", "lon").alias("date"), F.coalesce("place", "town", F.lit("")).alias("place"), F.substring("description", 1, 160).alias("caption"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Towns with a country code and region: cells of thirty and ten degrees, as no gazetteer is at hand."""
    t = ops.towns(ops.places(table(spark, sf_dir, "places", ops.COLUMNS)))
    cell = lambda n: F.concat_ws(":", F.floor(F.col("tlat") / n).cast("string"), F.floor(F.col("tlon") / n).cast("string"))
    return t.withColumns({"cc": cell(30), "region": cell(10)})


def countries_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries of each person's positioned photos."""
    items = photos(spark, sf_dir).where("lat IS NOT NULL").select("photo_id", "person", "lat", "lon")
    return ops.countries_visited(items, "person", regions(spark, sf_dir))


def full_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place captions with region at home and country elsewhere."""
    towns = regions(spark, sf_dir)
    countries = towns.select("cc", F.concat(F.lit("Country "), F.col("cc")).alias("country")).distinct()
    return ops.captions(photos(spark, sf_dir).select("photo_id", "person", "lat", "lon"), "person", photo_in_place(spark, sf_dir), towns, countries)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (teleport_filter, thin_track, daily_track, track_km, track_union, nearest_fix_asof, position_at_loose, position_at_strict, photo_in_place, nearest_city, place_captions, countries_visited, full_captions)
}
SQL_PLACE = "place AS (SELECT place_id, person, t0, t1, lat, lon, name, source FROM places WHERE person IS NOT NULL AND t0 IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (abs(lat) < 1e-6 AND abs(lon) < 1e-6))"
_SQL_IN_PLACE = f"""{SQL_PHOTO}, {SQL_PLACE},
hit AS (SELECT photo_id, max(struct_pack(t0 := p.t0, place_id := p.place_id, name := CASE WHEN p.name = 'Inferred Home' THEN 'Home' WHEN p.name = 'Inferred Work' THEN 'Work' ELSE p.name END)) AS m
  FROM photo q JOIN place p ON p.person = q.person AND p.t0 - 1800 <= q.ts AND q.ts <= coalesce(p.t1, p.t0) + 1800 AND p.t0 >= q.ts - 86400 AND (q.lat IS NULL OR abs(p.lat - q.lat) + abs(p.lon - q.lon) < 0.02)
  WHERE coalesce(p.name, '') <> '' GROUP BY photo_id)"""
SQL_TOWN = f"""town AS (SELECT CAST(floor(lat * 4) AS BIGINT) AS cy, CAST(floor(lon * 4) AS BIGINT) AS cx, min(name) AS town, round(avg(lat), 6) AS tlat, round(avg(lon), 6) AS tlon FROM place WHERE coalesce(name, '') <> '' GROUP BY ALL HAVING count(*) >= 5),
near AS (SELECT photo_id, arg_min(struct_pack(town := town, km := d, tlat := tlat), struct_pack(d := d, town := town, tlat := tlat)) AS m FROM (
    SELECT photo_id, town, tlat, round({sql_haversine("p.lat", "p.lon", "tlat", "tlon")} / 1000, 3) AS d FROM photo p JOIN town ON tlat BETWEEN p.lat - 1.0 AND p.lat + 1.0 WHERE p.lat IS NOT NULL) WHERE d <= 50 GROUP BY photo_id)"""
SQL: dict[str, str] = {
    "teleport_filter": f"WITH {_SQL_CLEAN} SELECT fix_id, person FROM c2",
    "thin_track": f"WITH RECURSIVE {_SQL_CLEAN}, {_SQL_THIN}",
    "daily_track": f"WITH {SQL_FIX} SELECT person, CAST(floor(t / 86400) AS BIGINT) AS day, round(median(t), 1) AS t, round(median(lat), 5) AS lat, round(median(lon), 5) AS lon, count(*) AS fixes FROM fix GROUP BY ALL",
    "track_km": f"""WITH {SQL_FIX}, d AS (SELECT person, CAST(floor(t / 86400) AS BIGINT) AS day, median(lat) AS lat, median(lon) AS lon FROM fix GROUP BY ALL),
      l AS (SELECT person, {sql_haversine("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} AS leg FROM d WINDOW w AS (PARTITION BY person ORDER BY day)) SELECT person, CAST(floor(coalesce(sum(leg), 0) / 1000) AS BIGINT) AS km, count(*) AS days FROM l GROUP BY person""",
    "track_union": f"""WITH {SQL_FIX}, {SQL_PHOTO}, {SQL_PLACE}, u AS (SELECT person, t, CAST(src AS INT) AS src FROM fix UNION ALL SELECT person, ts, 3 FROM photo WHERE lat IS NOT NULL AND ts_origin <> 'post' UNION ALL SELECT person, t0, 4 FROM place WHERE source = 'facebook')
      SELECT person, src, count(*) AS n, min(t) AS first, max(t) AS last FROM u GROUP BY ALL""",
    "nearest_fix_asof": f"""WITH {SQL_FIX}, {SQL_PHOTO}, p AS (SELECT q.photo_id, q.person, q.ts, w.t AS pt, w.v AS pv FROM photo q ASOF LEFT JOIN (SELECT person, t, max(struct_pack(fix_id := fix_id, lat := lat, lon := lon)) AS v FROM fix GROUP BY ALL) w ON q.person = w.person AND q.ts > w.t),
      n AS (SELECT q.*, w.t AS nt, w.v AS nv FROM p q ASOF LEFT JOIN (SELECT person, t, min(struct_pack(fix_id := fix_id, lat := lat, lon := lon)) AS v FROM fix GROUP BY ALL) w ON q.person = w.person AND q.ts <= w.t),
      f AS (SELECT photo_id, CASE WHEN coalesce(ts - pt, 1e18) <= coalesce(nt - ts, 1e18) THEN ts - pt ELSE nt - ts END AS gap, CASE WHEN coalesce(ts - pt, 1e18) <= coalesce(nt - ts, 1e18) THEN pv ELSE nv END AS v FROM n)
      SELECT photo_id, round(gap, 3) AS gap, round(v.lat, 6) AS lat, round(v.lon, 6) AS lon FROM f WHERE gap <= 10800""",
    "position_at_loose": f"WITH {_SQL_WORLD}, {sql_positions(False)} SELECT photo_id, round(degrees(atan(sinh(pi() * (1 - 2 * y)))), 5) AS lat, round(x * 360.0 - 180.0, 5) AS lon FROM pos WHERE x IS NOT NULL",
    "position_at_strict": f"WITH {_SQL_WORLD}, {sql_positions(True)} SELECT photo_id, round(degrees(atan(sinh(pi() * (1 - 2 * y)))), 5) AS lat, round(x * 360.0 - 180.0, 5) AS lon FROM pos WHERE x IS NOT NULL",
    "photo_in_place": f"WITH {_SQL_IN_PLACE} SELECT photo_id, m.place_id AS place_id, m.name AS name FROM hit",
    "countries_visited": f"WITH {SQL_PHOTO}, {SQL_PLACE}, {SQL_TOWN} SELECT person, CAST(CAST(floor(t.tlat / 30) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(floor(t.tlon / 30) AS BIGINT) AS VARCHAR) AS cc, count(*) AS n FROM near JOIN photo USING (photo_id) JOIN town t ON t.town = m.town AND t.tlat = m.tlat GROUP BY ALL",
    "place_captions": f"""WITH {_SQL_IN_PLACE}, {SQL_TOWN}, d AS (SELECT *, (DATE '1970-01-01' + CAST(floor((ts + coalesce(round_even(lon / 15, 0), 0) * 3600) / 86400) AS INT)) AS d FROM photo)
      SELECT d.photo_id, strftime(d, '%-d %B %Y') AS date, coalesce(h.m.name, n.m.town, '') AS place, substring(description, 1, 160) AS caption FROM d LEFT JOIN hit h USING (photo_id) LEFT JOIN near n USING (photo_id)""",
    "full_captions": f"""WITH {_SQL_IN_PLACE}, {SQL_TOWN}, cell AS (SELECT photo_id, m.town AS town, CAST(CAST(floor(t.tlat / 30) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(floor(t.tlon / 30) AS BIGINT) AS VARCHAR) AS cc, CAST(CAST(floor(t.tlat / 10) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(floor(t.tlon / 10) AS BIGINT) AS VARCHAR) AS region FROM near JOIN town t ON t.town = m.town AND t.tlat = m.tlat),
      spots AS (SELECT p.photo_id, p.person, town, cc, region, h.m.name AS name FROM photo p LEFT JOIN cell USING (photo_id) LEFT JOIN hit h ON h.photo_id = p.photo_id), home AS (SELECT person, arg_max(cc, struct_pack(n := n, cc := cc)) AS home FROM (SELECT person, cc, count(*) AS n FROM spots WHERE cc IS NOT NULL GROUP BY ALL) GROUP BY person),
      w AS (SELECT photo_id, town, name, CASE WHEN cc = home THEN town || ', ' || region ELSE town || ', Country ' || cc END AS spot FROM spots LEFT JOIN home USING (person))
      SELECT photo_id, CASE WHEN town IS NULL THEN coalesce(name, '') WHEN name <> '' AND name <> town THEN name || ' · ' || spot ELSE spot END AS place FROM w""",
    "nearest_city": f"WITH {SQL_PHOTO}, {SQL_PLACE}, {SQL_TOWN} SELECT photo_id, m.town AS town, m.km AS km FROM near",
}
