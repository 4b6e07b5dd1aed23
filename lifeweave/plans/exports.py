"""Queries of sources and sinks: the tables are written in the forms of exports, read back by the readers, and must agree.

Documents are built a (person, stretch of time) each, so none grows with a person's share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeweave.functions import scalar
from lifeweave.plans.common import SQL_FIX, SQL_PHOTO, fixes, photos
from lifeweave.session import new_folder, table
from lifeweave.sources import google, meta, others, sinks

STRETCH_S = 30 * 86_400


def _documents(rows: DataFrame, by: list[Column], each: Column, whole: Callable[[Column], Column], name: Column | str) -> DataFrame:
    """container, name, content: one document for each group of ``by``, of the JSON or XML texts of its rows."""
    keys = [b.alias(f"k{i}") for i, b in enumerate(by)]
    docs = rows.groupBy(*keys).agg(F.array_join(F.collect_list(each), ",\n").alias("parts"))
    return docs.select(F.concat_ws("/", *[f"k{i}" for i in range(len(by))]).alias("container"), (F.lit(name) if isinstance(name, str) else name).alias("name"), whole(F.col("parts")).cast("binary").alias("content"))


def _list(head: str = "[", tail: str = "]") -> Callable[[Column], Column]:
    return lambda parts: F.concat(F.lit(head), parts, F.lit(tail))


def _stretch(time: str) -> Column:
    return F.floor(F.col(time) / STRETCH_S)


def _iso(time: str) -> Column:
    return F.date_format(F.timestamp_seconds(F.floor(time)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _as_meta(text: Column | str) -> Column:
    """A text as Meta's exports hold it: the bytes of its UTF-8 form as characters."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def read_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photo records through sidecar files."""
    p = photos(spark, sf_dir).where("uri IS NOT NULL AND ts > 0")
    geo = F.struct(F.coalesce("lat", F.lit(0.0)).alias("latitude"), F.coalesce("lon", F.lit(0.0)).alias("longitude"))
    doc = F.to_json(F.struct("title", "description", F.struct(F.floor("ts").cast("string").alias("timestamp")).alias("photoTakenTime"), geo.alias("geoData"), F.col("favorite").alias("favorited"), F.col("views").cast("string").alias("imageViews")))
    docs = p.select(F.col("photo_id").cast("string").alias("container"), F.concat(F.element_at(F.split("uri", "::"), -1), F.lit(".json")).alias("name"), doc.cast("binary").alias("content"))
    out = google.sidecars(docs)
    return out.select(F.col("container").cast("bigint").alias("photo_id"), "dir", "title", "ts", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "description", "favorite", "views")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "places", ["person", "place_id", "t0", "t1", "lat", "lon", "name", "source"]).where("person IS NOT NULL AND t0 >= 1 AND t1 >= t0 AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (abs(lat) < 1e-6 AND abs(lon) < 1e-6)")


_SQL_PLACED = "p AS (SELECT * FROM places WHERE person IS NOT NULL AND t0 >= 1 AND t1 >= t0 AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (abs(lat) < 1e-6 AND abs(lon) < 1e-6))"


def read_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits through a phone's timeline: places, and the fixes at their ends."""
    spot = F.struct(F.format_string("%.7f°, %.7f°", "lat", "lon").alias("latLng"))
    visit = F.struct(F.struct(F.lit("INFERRED_HOME").alias("semanticType"), spot.alias("placeLocation")).alias("topCandidate"))
    each = F.to_json(F.struct(_iso("t0").alias("startTime"), _iso("t1").alias("endTime"), visit.alias("visit")))
    docs = _documents(_placed(spark, sf_dir), [F.col("person"), _stretch("t0")], each, _list('{"semanticSegments": [', "]}"), "Timeline.json")
    seen, places = google.timeline(docs)
    rows = places.select("t0", "t1", "lat", "lon", "name").unionByName(seen.select(F.col("t").alias("t0"), F.col("t").alias("t1"), "lat", "lon", F.lit("fix").alias("name")))
    return rows.groupBy("t0", "t1", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "name").agg(F.count("*").alias("n"))


def read_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named visits through the semantic location history."""
    e7 = lambda c: F.rint(F.col(c) * 1e7).cast("bigint")
    visit = F.struct(F.struct(e7("lat").alias("latitudeE7"), e7("lon").alias("longitudeE7"), F.col("name").alias("name")).alias("location"), F.struct(_iso("t0").alias("startTimestamp"), _iso("t1").alias("endTimestamp")).alias("duration"))
    docs = _documents(_placed(spark, sf_dir), [F.col("person"), _stretch("t0")], F.to_json(F.struct(visit.alias("placeVisit"))), _list('{"timelineObjects": [', "]}"), "2019_JUNE.json")
    return google.semantic(docs)[1].groupBy("t0", "t1", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "name").agg(F.count("*").alias("n"))


def read_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes through fitness samples; those worse than 500 m are left out."""
    f = table(spark, sf_dir, "fixes", ["fix_id", "person", "t", "lat", "lon", "acc"]).where("person IS NOT NULL AND t > 0")
    value = lambda c: F.struct(F.struct(F.col(c).cast("double").alias("fpVal")).alias("value"))
    each = F.to_json(F.struct((F.floor("t") * 1_000_000_000).alias("startTimeNanos"), F.array(value("lat"), value("lon"), value("acc")).alias("fitValue")))
    docs = _documents(f, [F.col("person"), F.floor(F.col("t") / 86_400)], each, _list('{"Data Points": [', "]}"), "Takeout/Fit/All data/location.sample.json")
    return google.fit_samples(docs).groupBy("t", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon")).agg(F.count("*").alias("n"))


def read_gpx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes through track files."""
    f = fixes(spark, sf_dir).where("t > 0")
    each = F.format_string('<trkpt lat="%.7f" lon="%.7f"><time>%s</time></trkpt>', "lat", "lon", _iso("t"))
    docs = _documents(f, [F.col("person"), F.floor(F.col("t") / 86_400)], each, _list("<gpx><trk><trkseg>", "</trkseg></trk></gpx>"), "ride.gpx")
    return others.track_points(docs).groupBy("t", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon")).agg(F.count("*").alias("n"))


_MESSAGES = "person IS NOT NULL AND who IS NOT NULL AND kind IN ('message_in', 'message_out') AND ts > 0 AND text <> ''"


def read_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages through thread files, where texts and names are written as Meta does."""
    s = table(spark, sf_dir, "social", ["person", "ts", "kind", "text", "who"]).where(_MESSAGES)
    sender = F.when(F.col("kind") == "message_out", F.col("person")).otherwise(F.col("who"))
    each = F.to_json(F.struct(_as_meta(sender).alias("sender_name"), (F.floor("ts") * 1000).alias("timestamp_ms"), _as_meta("text").alias("content")))
    keys = [F.col("person"), F.col("who"), _stretch("ts")]
    docs = s.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.array_join(F.collect_list(each), ",").alias("parts"))
    head = F.to_json(F.array(F.struct(_as_meta("k0").alias("name")), F.struct(_as_meta("k1").alias("name"))))
    docs = docs.select(F.col("k0").alias("container"), F.lit("your_facebook_activity/messages/inbox/t_1/message_1.json").alias("name"), F.concat(F.lit('{"participants": '), head, F.lit(', "messages": ['), "parts", F.lit("]}")).cast("binary").alias("content"))
    return meta.messages(docs).groupBy("ts", "sender", "text", F.element_at("members", 1).alias("owner")).agg(F.count("*").alias("n"))


def read_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts through an archive's script; retweets are left out and short links cut off."""
    s = table(spark, sf_dir, "social", ["social_id", "person", "ts", "kind", "text"]).where("person IS NOT NULL AND kind IN ('post', 'comment') AND ts > 0 AND text IS NOT NULL")
    tweet = F.struct(F.col("social_id").cast("string").alias("id_str"), F.date_format(F.timestamp_seconds(F.floor("ts")), "EEE MMM dd HH:mm:ss Z yyyy").alias("created_at"), F.col("text").alias("full_text"), F.when(F.col("kind") == "comment", F.lit("someone")).alias("in_reply_to_screen_name"))
    docs = _documents(s, [F.col("person"), _stretch("ts")], F.to_json(F.struct(tweet.alias("tweet"))), _list("window.YTD.tweets.part0 = [", "]"), "data/tweets.js")
    none = spark.createDataFrame([], "container string, name string")
    return others.tweets(docs, none)[0].groupBy("ts", "kind", "text").agg(F.count("*").alias("n"))


def read_checkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places through check-ins."""
    each = F.to_json(F.struct(F.floor("t0").alias("timestamp"), _as_meta("name").alias("name"), F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("coordinate")))
    docs = _documents(_placed(spark, sf_dir), [F.col("person"), _stretch("t0")], each, _list('{"check_ins": [', "]}"), "your_facebook_activity/posts/check-ins.json")
    return meta.facebook_places(docs).groupBy("t0", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "name").agg(F.count("*").alias("n"))


def read_instagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts and stories through the lists that hold their media."""
    s = table(spark, sf_dir, "social", ["person", "ts", "kind", "text"]).where("person IS NOT NULL AND kind IN ('post', 'story') AND ts > 0 AND text <> ''")
    each = F.to_json(F.struct(F.floor("ts").alias("creation_timestamp"), _as_meta("text").alias("title"), F.lit("media/posts/1.jpg").alias("uri")))
    name = F.when(F.col("k1") == "story", "your_instagram_activity/content/stories.json").otherwise("your_instagram_activity/content/posts_1.json")
    docs = _documents(s, [F.col("person"), F.col("kind"), _stretch("ts")], each, _list(), name)
    return meta.instagram_posts(docs)[0].groupBy("ts", "kind", "text").agg(F.count("*").alias("n"))


def read_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments through their file."""
    s = table(spark, sf_dir, "social", ["person", "ts", "kind", "text"]).where("person IS NOT NULL AND kind = 'comment' AND ts > 0 AND text <> ''")
    comment = F.struct(F.struct(F.floor("ts").alias("timestamp"), _as_meta("text").alias("comment")).alias("comment"))
    each = F.to_json(F.struct(F.floor("ts").alias("timestamp"), F.lit("A commented on Bo's post.").alias("title"), F.array(comment).alias("data")))
    docs = _documents(s, [F.col("person"), _stretch("ts")], each, _list('{"comments_v2": [', "]}"), "your_facebook_activity/comments_and_reactions/comments.json")
    return meta.comments(docs, "facebook").groupBy("ts", "text", "who").agg(F.count("*").alias("n"))


def social_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the readers of posts, comments, stories and check-ins find, in one table, by source and kind."""
    parts = [read_tweets(spark, sf_dir).select(F.lit("x").alias("source"), "kind", "n"), read_instagram(spark, sf_dir).select(F.lit("instagram").alias("source"), "kind", "n"), read_comments(spark, sf_dir).select(F.lit("facebook").alias("source"), F.lit("comment").alias("kind"), "n"), read_checkins(spark, sf_dir).select(F.lit("facebook").alias("source"), F.lit("checkin").alias("kind"), "n")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("source", "kind").agg(F.sum("n").alias("n"))


def written_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The track written by person and read back for a range of times, the middle third of all."""
    f = fixes(spark, sf_dir).select("fix_id", "person", "t", "lat", "lon", F.col("src").cast("int").alias("src"))
    ends = f.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    path = new_folder(spark, "track")
    sinks.write_track(f, path)
    third = (ends["b"] - ends["a"]) / 3
    return sinks.load_track(spark, path, ends["a"] + third, ends["b"] - third).select("fix_id", F.col("person").cast("string").alias("person"), "t", "src")


def written_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos written as JSON lines and read back."""
    path = new_folder(spark, "photos")
    columns = ["photo_id", "person", "ts", "title", "description", "favorite", "views"]
    p = photos(spark, sf_dir).select(*columns)
    sinks.write_lines(p, path)
    return spark.read.schema(p.schema).json(path).select(*columns)


def written_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos left after an exclude list was written and read: the titles of edited copies and the uris of an album."""
    p = photos(spark, sf_dir)
    path = new_folder(spark, "exclude")
    entries = p.where(F.col("title").rlike(r"(?iu)-edited\.")).select(F.col("title").alias("entry")).union(p.where("album = 'Trip' AND uri IS NOT NULL").select("uri")).distinct()
    sinks.write_list(entries, "entry", path)
    return sinks.without_excluded(p.withColumn("uri", F.coalesce("uri", F.lit(""))), sinks.read_exclude(spark, path)).select("photo_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (read_sidecars, read_timeline, read_semantic, read_fit, read_gpx, read_messages, read_tweets, read_checkins, read_instagram, read_comments, social_union, written_track, written_lines, written_exclusions)
}
_VALID_FIX = "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (abs(lat) < 1e-6 AND abs(lon) < 1e-6)"
_TWEET = r"SELECT CAST(floor(ts) AS DOUBLE) AS ts, kind, trim(regexp_replace(text, '\s*https://t\.co/\w+', '', 'g')) AS text FROM social WHERE person IS NOT NULL AND kind IN ('post', 'comment') AND ts > 0 AND text IS NOT NULL AND NOT starts_with(text, 'RT @')"
SQL: dict[str, str] = {
    "read_sidecars": f"WITH {SQL_PHOTO}, p AS (SELECT *, string_split(uri, '::')[-1] AS path FROM photo WHERE uri IS NOT NULL AND ts > 0) SELECT photo_id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, title, CAST(floor(ts) AS DOUBLE) AS ts, round(lat, 7) AS lat, round(lon, 7) AS lon, description, favorite, views FROM p",
    "read_timeline": f"WITH {_SQL_PLACED}, r AS (SELECT CAST(floor(t0) AS DOUBLE) AS t0, CAST(floor(t1) AS DOUBLE) AS t1, round(lat, 7) AS lat, round(lon, 7) AS lon, 'Inferred Home' AS name FROM p UNION ALL SELECT floor(t0), floor(t0), round(lat, 7), round(lon, 7), 'fix' FROM p UNION ALL SELECT floor(t1), floor(t1), round(lat, 7), round(lon, 7), 'fix' FROM p) SELECT *, count(*) AS n FROM r GROUP BY ALL",
    "read_semantic": f"WITH {_SQL_PLACED} SELECT CAST(floor(t0) AS DOUBLE) AS t0, CAST(floor(t1) AS DOUBLE) AS t1, round(lat, 7) AS lat, round(lon, 7) AS lon, name, count(*) AS n FROM p WHERE name <> '' GROUP BY ALL",
    "read_fit": f"SELECT CAST(floor(t) AS DOUBLE) AS t, round(lat, 7) AS lat, round(lon, 7) AS lon, count(*) AS n FROM fixes WHERE person IS NOT NULL AND t > 0 AND {_VALID_FIX} AND coalesce(acc, 0) <= 500 GROUP BY ALL",
    "read_gpx": f"WITH {SQL_FIX} SELECT CAST(floor(t) AS DOUBLE) AS t, round(lat, 7) AS lat, round(lon, 7) AS lon, count(*) AS n FROM fix WHERE t > 0 GROUP BY ALL",
    "read_messages": f"SELECT CAST(floor(ts) AS DOUBLE) AS ts, CASE WHEN kind = 'message_out' THEN person ELSE who END AS sender, text, person AS owner, count(*) AS n FROM social WHERE {_MESSAGES} GROUP BY ALL",
    "read_tweets": f"SELECT *, count(*) AS n FROM ({_TWEET}) WHERE text <> '' GROUP BY ALL",
    "read_checkins": f"WITH {_SQL_PLACED} SELECT CAST(floor(t0) AS DOUBLE) AS t0, round(lat, 7) AS lat, round(lon, 7) AS lon, coalesce(name, '') AS name, count(*) AS n FROM p GROUP BY ALL",
    "read_instagram": "SELECT CAST(floor(ts) AS DOUBLE) AS ts, kind, text, count(*) AS n FROM social WHERE person IS NOT NULL AND kind IN ('post', 'story') AND ts > 0 AND text <> '' GROUP BY ALL",
    "read_comments": "SELECT CAST(floor(ts) AS DOUBLE) AS ts, text, 'Bo' AS who, count(*) AS n FROM social WHERE person IS NOT NULL AND kind = 'comment' AND ts > 0 AND text <> '' GROUP BY ALL",
    "social_union": f"""WITH {_SQL_PLACED} SELECT source, kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'x' AS source, kind FROM ({_TWEET}) WHERE text <> '' UNION ALL SELECT 'instagram', kind FROM social WHERE person IS NOT NULL AND kind IN ('post', 'story') AND ts > 0 AND text <> ''
      UNION ALL SELECT 'facebook', kind FROM social WHERE person IS NOT NULL AND kind = 'comment' AND ts > 0 AND text <> '' UNION ALL SELECT 'facebook', 'checkin' FROM p) GROUP BY ALL""",
    "written_track": f"WITH {SQL_FIX}, e AS (SELECT min(t) AS a, max(t) AS b FROM fix) SELECT fix_id, person, t, CAST(src AS INT) AS src FROM fix, e WHERE t BETWEEN a + (b - a) / 3 AND b - (b - a) / 3",
    "written_lines": f"WITH {SQL_PHOTO} SELECT photo_id, person, ts, title, description, favorite, views FROM photo",
    "written_exclusions": f"WITH {SQL_PHOTO}, x AS (SELECT title AS entry FROM photo WHERE regexp_matches(title, '(?i)-edited\\.') UNION SELECT uri FROM photo WHERE album = 'Trip') SELECT photo_id FROM photo WHERE title NOT IN (SELECT entry FROM x WHERE entry IS NOT NULL) AND coalesce(uri, '') NOT IN (SELECT entry FROM x WHERE entry IS NOT NULL)",
}
