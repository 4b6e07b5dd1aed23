"""Queries of scalar functions and of strip and map statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lifeweave.functions import scalar
from lifeweave.functions.geo import flat_km, haversine_m, lat_of, lon_of, smoothstep, world_x, world_y, zoom_for_bbox
from lifeweave.operators.adjacent import percentiles, with_neighbours
from lifeweave.plans.common import SQL_FIX, SQL_PHOTO, SQL_SCORE, SQL_SKIP, fixes, photos, sql_file_time, sql_flat_km, sql_haversine
from lifeweave.session import table


def mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World coordinates of every fix, and back."""
    f = fixes(spark, sf_dir).select("fix_id", "lat", "lon", world_x("lon").alias("mx"), world_y("lat").alias("my"))
    return f.select("fix_id", F.round("mx", 12).alias("mx"), F.round("my", 12).alias("my"), F.round(lat_of("my"), 7).alias("lat"), F.round(lon_of("mx"), 7).alias("lon"))


def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both distances between each fix and the one before."""
    f = with_neighbours(fixes(spark, sf_dir), "person", "t", "fix_id", ["lat", "lon"])
    args = [F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon")]
    return f.select("fix_id", F.round(haversine_m(*args), 3).alias("metres"), F.round(flat_km(*args), 5).alias("km"))


def parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unix seconds of raw time values, by the lenient rules of the readers (a value without offset is UTC)."""
    return table(spark, sf_dir, "stamps", ["stamp_id", "raw_value"]).select("stamp_id", F.round(scalar.parse_time("raw_value"), 3).alias("ts"))


def filename_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unix seconds that file names tell."""
    return photos(spark, sf_dir).select("photo_id", scalar.time_from_filename("title").alias("ts"))


def fix_mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that the plain Latin-1 round trip changes."""
    s = table(spark, sf_dir, "social", ["social_id", "text"]).select("social_id", "text", scalar.fix_mojibake("text").alias("fixed"))
    return s.where("fixed <> text").select("social_id", "fixed")


def meta_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every photo's metadata."""
    return photos(spark, sf_dir).select("photo_id", F.round(scalar.meta_score(), 6).alias("score"))


def names_and_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of uris, media kinds, copy numbers, edit marks, captures and received media."""
    p = photos(spark, sf_dir).where("uri IS NOT NULL")
    path = F.element_at(F.split("uri", "::"), -1)
    s = scalar.stem(scalar.basename(path))
    return p.select(
        "photo_id", scalar.basename(path).alias("name"), scalar.dirname(path).alias("dir"), scalar.media_kind(path).alias("media"), scalar.copy_number(s).cast("bigint").alias("copy"),
        (scalar.without_edit_mark(scalar.stem("title")) != scalar.stem("title")).alias("edited"), F.col("title").rlike(scalar.SKIP).alias("capture"), F.col("title").rlike(scalar.RECEIVED).alias("received"),
        F.coalesce(F.col("origin").rlike(scalar.RECEIVED_ORIGIN), F.lit(False)).alias("shared_by_others"),
    )


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in solar time, years, shortened and cleaned texts."""
    p = photos(spark, sf_dir)
    return p.select("photo_id", scalar.caption_date("ts", "lon").alias("date"), scalar.year_of("ts").cast("bigint").alias("year"), F.substring(scalar.strip_emoji("description"), 1, 90).alias("short"))


def posts_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts without short links, retweets left out."""
    s = table(spark, sf_dir, "social", ["social_id", "source", "kind", "text"]).where("kind IN ('post', 'comment') AND text IS NOT NULL AND NOT startswith(text, 'RT @')")
    return s.select("social_id", scalar.strip_links("text").alias("text"))


def view_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zoom that fits the way from each fix to the next, the smooth share of its minute, and hash distance of their ids."""
    f = fixes(spark, sf_dir).select("person", "fix_id", "t", world_x("lon").alias("x"), world_y("lat").alias("y"))
    f = with_neighbours(f, "person", "t", "fix_id", ["x", "y", "fix_id"]).where("next IS NOT NULL").select("fix_id", "t", "x", "y", F.col("next.x").alias("x2"), F.col("next.y").alias("y2"), F.col("next.fix_id").alias("next"))
    zoom = zoom_for_bbox(F.least("x", "x2"), F.least("y", "y2"), F.greatest("x", "x2"), F.greatest("y", "y2"), 960, 540, 256)
    return f.select("fix_id", F.round(zoom, 4).alias("zoom"), F.round(smoothstep(F.col("t") % 60 / 60), 6).alias("ease"), scalar.hamming("fix_id", "next").cast("bigint").alias("bits"))


def excluded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos left after an exclude list of uris and titles: here the names of all edited copies."""
    p = photos(spark, sf_dir)
    marked = p.where(F.col("title").rlike(r"(?iu)-edited\.")).select(F.col("title").alias("entry")).union(p.where("album = 'Trip'").select("uri")).distinct()
    out = p.join(marked.withColumnRenamed("entry", "title"), "title", "left_anti").join(marked.withColumnRenamed("entry", "uri"), "uri", "left_anti")
    return out.groupBy("person").agg(F.count("*").alias("n"))


# ---- statistics of strips and maps


def robust_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box of each person's fixes between the 2 and 98 percentiles, or of all if they are few."""
    f = fixes(spark, sf_dir).select("person", world_x("lon").alias("mx"), world_y("lat").alias("my"))
    ends = f.groupBy("person").agg(F.count("*").alias("n"), *[low(c).alias(f"all_{n}") for n, c, low in (("x0", "mx", F.min), ("y0", "my", F.min), ("x1", "mx", F.max), ("y1", "my", F.max))])
    for c in "xy":
        ends = ends.join(percentiles(f, "person", f"m{c}", {f"{c}0": 0.02, f"{c}1": 0.98}, 1e-5), "person")
    return ends.select("person", *[F.round(F.when(F.col("n") <= 20, F.col(f"all_{c}")).otherwise(F.col(c)), 9).alias(c) for c in ("x0", "y0", "x1", "y1")])


def timeline_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos and fixes of each person in 60 bins over the range of the photos, as shares √(n/max)."""
    p = photos(spark, sf_dir).select("person", F.col("ts").alias("t"), F.lit("photos").alias("what"))
    ends = p.groupBy("person").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    both = p.unionByName(fixes(spark, sf_dir).select("person", "t", F.lit("fixes").alias("what"))).join(ends, "person").where("t >= t0 AND t <= t1 AND t1 > t0")
    bin_ = F.least(F.floor((F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")) * 60), F.lit(59)).cast("bigint")
    n = both.groupBy("person", "what", bin_.alias("bin")).agg(F.count("*").alias("n"))
    return n.select("person", "what", "bin", "n", F.round(F.sqrt(F.col("n") / F.max("n").over(Window.partitionBy("person", "what"))), 6).alias("height"))


def density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes and glow of every pixel of a world map 4096 pixels wide."""
    px = lambda c: F.floor(F.col(c) * 4096).cast("bigint")
    f = fixes(spark, sf_dir).select(world_x("lon").alias("mx"), world_y("lat").alias("my"))
    return f.groupBy(px("mx").alias("px"), px("my").alias("py")).agg(F.count("*").alias("n")).withColumn("glow", F.round(1 - F.exp(-0.6 * F.col("n")), 6))


def time_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick marks of each person's strip: years beyond three years, months beyond 75 days, else days."""
    ends = photos(spark, sf_dir).groupBy("person").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    day = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(c) / 86400).cast("int"))
    days = (F.col("t1") - F.col("t0")) / 86400
    unit = F.when(days > 1095, "year").when(days > 75, "month").otherwise("day")
    e = ends.select("person", unit.alias("unit"), day("t0").alias("d0"), day("t1").alias("d1"))
    first = F.when(F.col("unit") == "year", F.trunc(F.add_months("d0", 12), "year")).when(F.col("unit") == "month", F.trunc(F.add_months("d0", 1), "month")).otherwise(F.date_add("d0", 1))
    e = e.withColumn("first", first).where("first <= d1")
    step = lambda u, i: e.where(F.col("unit") == u).select("person", "unit", F.explode(F.sequence("first", "d1", F.expr(i))).alias("day"))
    ticks = step("year", "INTERVAL 1 YEAR").union(step("month", "INTERVAL 1 MONTH")).union(step("day", "INTERVAL 1 DAY"))
    label = F.when(F.date_format("day", "MM-dd") == "01-01", F.year("day").cast("string")).when(F.col("unit") == "month", F.date_format("day", "MMM")).otherwise(F.date_format("day", "d MMM"))
    return ticks.select("person", "unit", F.date_format("day", "yyyy-MM-dd").alias("day"), label.alias("label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (mercator, haversine_pairs, parse_times, filename_time, fix_mojibake, meta_score, names_and_kinds, captions, posts_clean, view_math, excluded_items, robust_bbox, timeline_histogram, density_grid, time_ticks)
}
_MY = "(1 - ln(tan(radians(least(greatest(lat, -85.0511), 85.0511))) + 1 / cos(radians(least(greatest(lat, -85.0511), 85.0511)))) / pi()) / 2"
_WORLD = f"{SQL_FIX}, w AS (SELECT person, fix_id, t, (lon + 180.0) / 360.0 AS mx, {_MY} AS my FROM fix)"
_DATE = "(DATE '1970-01-01' + CAST(floor({}) AS INT))"
SQL: dict[str, str] = {
    "mercator": f"WITH {_WORLD} SELECT fix_id, round(mx, 12) AS mx, round(my, 12) AS my, round(degrees(atan(sinh(pi() * (1 - 2 * my)))), 7) AS lat, round(mx * 360.0 - 180.0, 7) AS lon FROM w",
    "haversine_pairs": f"WITH {SQL_FIX}, p AS (SELECT fix_id, lat, lon, lag(lat) OVER w AS a, lag(lon) OVER w AS o FROM fix WINDOW w AS (PARTITION BY person ORDER BY t, fix_id)) SELECT fix_id, round({sql_haversine('a', 'o', 'lat', 'lon')}, 3) AS metres, round({sql_flat_km('a', 'o', 'lat', 'lon')}, 5) AS km FROM p",
    "filename_time": f"WITH {SQL_PHOTO} SELECT photo_id, {sql_file_time('title')} AS ts FROM photo",
    "fix_mojibake": """WITH s AS (SELECT social_id, text, TRY(decode(unhex(array_to_string(list_transform(string_split(text, ''), lambda c: printf('%02X', unicode(c))), '')))) AS fixed FROM social WHERE regexp_matches(text, '[^\\x00-\\x7f]') AND regexp_full_match(text, '[\\x{0}-\\x{ff}]*')) SELECT social_id, fixed FROM s WHERE fixed <> text""",
    "parse_times": """WITH v AS (SELECT stamp_id, regexp_replace(raw_value, '^\\s+|\\s+$', '', 'g') AS v FROM stamps), k AS (SELECT *, regexp_matches(v, '^\\d+(\\.\\d+)?$') AS is_number,
        CASE WHEN regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}') THEN regexp_replace(v, '[Zz]$', '+00:00') WHEN regexp_matches(v, '^\\d{4}:\\d{2}:\\d{2} ') THEN replace(substring(v, 1, 10), ':', '-') || substring(v, 11, 30) END AS t,
        regexp_extract(v, '^[A-Z][a-z]{2} ([A-Z][a-z]{2} \\d{2} \\d{2}:\\d{2}:\\d{2} [+-]\\d{4} \\d{4})$', 1) AS tweet, regexp_extract(v, '^(\\d{1,2} [A-Z][a-z]{2} \\d{4}, \\d{2}:\\d{2}:\\d{2}) UTC$', 1) AS words FROM v)
      SELECT stamp_id, round(CASE WHEN is_number THEN CASE WHEN CAST(v AS DOUBLE) > 1e11 THEN CAST(v AS DOUBLE) / 1000 ELSE CAST(v AS DOUBLE) END
        WHEN t IS NOT NULL THEN epoch(TRY_CAST(CASE WHEN regexp_matches(t, '[+-]\\d{2}:?\\d{2}$') THEN t ELSE t || '+00:00' END AS TIMESTAMPTZ))
        WHEN tweet <> '' THEN epoch(try_strptime(tweet, '%b %d %H:%M:%S %z %Y')) WHEN words <> '' THEN epoch(try_strptime(words, '%d %b %Y, %H:%M:%S')) END, 3) AS ts FROM k""",
    "meta_score": f"WITH {SQL_PHOTO} SELECT photo_id, round({SQL_SCORE}, 6) AS score FROM photo",
    "names_and_kinds": f"""WITH {SQL_PHOTO}, p AS (SELECT *, string_split(uri, '::')[-1] AS path FROM photo WHERE uri IS NOT NULL), q AS (SELECT *, string_split(path, '/')[-1] AS name, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM p)
      SELECT photo_id, name, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir,
        CASE WHEN ext IN ({", ".join(repr(e) for e in scalar.IMAGE_EXT)}) THEN 'image' WHEN ext IN ({", ".join(repr(e) for e in scalar.VIDEO_EXT)}) THEN 'video' END AS media,
        coalesce(TRY_CAST(regexp_extract(regexp_replace(name, '\\.[^.]*$', ''), '\\((\\d+)\\)$', 1) AS BIGINT), 0) AS copy,
        regexp_matches(regexp_replace(title, '\\.[^.]*$', ''), '{scalar.EDITED.replace("(?iu)", "(?i)")}') AS edited, {SQL_SKIP} AS capture, regexp_matches(title, '{scalar.RECEIVED.replace("(?iu)", "(?i)")}') AS received,
        coalesce(regexp_matches(origin, '(?i)partner|shared'), false) AS shared_by_others FROM q""",
    "captions": f"""WITH {SQL_PHOTO}, d AS (SELECT photo_id, {_DATE.format("(ts + coalesce(round_even(lon / 15, 0), 0) * 3600) / 86400")} AS d, {_DATE.format("ts / 86400")} AS u, trim(regexp_replace(description, '[\U0001f000-\U0001faff☀-➿️‍]', '', 'g')) AS s FROM photo)
      SELECT photo_id, strftime(d, '%-d %B %Y') AS date, CAST(year(u) AS BIGINT) AS year, substring(s, 1, 90) AS short FROM d""",
    "posts_clean": r"SELECT social_id, trim(regexp_replace(text, '\s*https://t\.co/\w+', '', 'g')) AS text FROM social WHERE kind IN ('post', 'comment') AND text IS NOT NULL AND NOT starts_with(text, 'RT @')",
    "view_math": f"""WITH {_WORLD}, p AS (SELECT fix_id, t, mx AS x, my AS y, lead(mx) OVER o AS x2, lead(my) OVER o AS y2, lead(fix_id) OVER o AS nxt FROM w WINDOW o AS (PARTITION BY person ORDER BY t, fix_id))
      SELECT fix_id, round(least(greatest(least(log2(960 / 256.0 / greatest((greatest(x, x2) - least(x, x2)) * 1.35, 1e-9)), log2(540 / 256.0 / greatest((greatest(y, y2) - least(y, y2)) * 1.35, 1e-9))), 1.0), 14.5), 4) AS zoom,
        round(pow(fmod(t, 60) / 60, 2) * (3 - 2 * fmod(t, 60) / 60), 6) AS ease, CAST(bit_count(xor(fix_id, nxt)) AS BIGINT) AS bits FROM p WHERE nxt IS NOT NULL""",
    "excluded_items": f"WITH {SQL_PHOTO}, x AS (SELECT title AS entry FROM photo WHERE regexp_matches(title, '(?i)-edited\\.') UNION SELECT uri FROM photo WHERE album = 'Trip') SELECT person, count(*) AS n FROM photo WHERE title NOT IN (SELECT entry FROM x WHERE entry IS NOT NULL) AND coalesce(uri, '') NOT IN (SELECT entry FROM x WHERE entry IS NOT NULL) GROUP BY person",
    "robust_bbox": f"""WITH {_WORLD} SELECT person, round(CASE WHEN count(*) <= 20 THEN min(mx) ELSE quantile_cont(mx, 0.02) END, 9) AS x0, round(CASE WHEN count(*) <= 20 THEN min(my) ELSE quantile_cont(my, 0.02) END, 9) AS y0,
        round(CASE WHEN count(*) <= 20 THEN max(mx) ELSE quantile_cont(mx, 0.98) END, 9) AS x1, round(CASE WHEN count(*) <= 20 THEN max(my) ELSE quantile_cont(my, 0.98) END, 9) AS y1 FROM w GROUP BY person""",
    "timeline_histogram": f"""WITH {SQL_FIX}, {SQL_PHOTO}, e AS (SELECT person, min(ts) AS t0, max(ts) AS t1 FROM photo GROUP BY person), u AS (SELECT person, ts AS t, 'photos' AS what FROM photo UNION ALL SELECT person, t, 'fixes' FROM fix),
      b AS (SELECT person, what, CAST(least(floor((t - t0) / (t1 - t0) * 60), 59) AS BIGINT) AS bin, count(*) AS n FROM u JOIN e USING (person) WHERE t >= t0 AND t <= t1 AND t1 > t0 GROUP BY ALL)
      SELECT person, what, bin, n, round(sqrt(n / max(n) OVER (PARTITION BY person, what)), 6) AS height FROM b""",
    "density_grid": f"WITH {_WORLD} SELECT CAST(floor(mx * 4096) AS BIGINT) AS px, CAST(floor(my * 4096) AS BIGINT) AS py, count(*) AS n, round(1 - exp(-0.6 * count(*)), 6) AS glow FROM w GROUP BY ALL",
    "time_ticks": f"""WITH {SQL_PHOTO}, e AS (SELECT person, {_DATE.format("min(ts) / 86400")} AS d0, {_DATE.format("max(ts) / 86400")} AS d1, (max(ts) - min(ts)) / 86400 AS days FROM photo GROUP BY person),
      f AS (SELECT *, CASE WHEN days > 1095 THEN 'year' WHEN days > 75 THEN 'month' ELSE 'day' END AS unit FROM e), g AS (SELECT person, unit, unnest(generate_series(CAST(d0 AS TIMESTAMP) + INTERVAL 1 DAY, CAST(d1 AS TIMESTAMP), INTERVAL 1 DAY)) AS day FROM f)
      SELECT person, unit, strftime(day, '%Y-%m-%d') AS day, CASE WHEN month(day) = 1 AND day(day) = 1 THEN CAST(year(day) AS VARCHAR) WHEN unit = 'month' THEN strftime(day, '%b') ELSE strftime(day, '%-d %b') END AS label
      FROM g WHERE unit = 'day' OR (unit = 'month' AND day(day) = 1) OR (unit = 'year' AND day(day) = 1 AND month(day) = 1)""",
}
