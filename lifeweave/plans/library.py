"""Queries of merging: sidecar pairing, duplicates, posted copies, messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeweave.functions import scalar
from lifeweave.operators import library as ops
from lifeweave.plans.common import SQL_PHOTO, photos, sql_file_time
from lifeweave.session import table

_MARKS = "|".join(scalar.EDIT_MARKS)


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of photo exports: folder and file name inside the container."""
    p = photos(spark, sf_dir).where("source = 'google_photos' AND uri IS NOT NULL")
    path = F.element_at(F.split("uri", "::"), -1)
    return p.select("person", F.col("photo_id").alias("media_id"), scalar.dirname(path).alias("dir"), scalar.basename(path).alias("name"), "kind", "ts", "title")


def _sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars as the exports have them: for records dated by one, with the original's title and the file's copy number."""
    p = photos(spark, sf_dir).where("source = 'google_photos' AND ts_origin = 'sidecar' AND uri IS NOT NULL")
    path = F.element_at(F.split("uri", "::"), -1)
    title = F.concat(scalar.without_edit_mark(scalar.stem("title")), F.regexp_extract("title", r"(\.[^.]*)$", 1))
    return p.select("person", F.col("photo_id").alias("sidecar_id"), scalar.dirname(path).alias("dir"), title.alias("title"), scalar.copy_number(scalar.stem(scalar.basename(path))).alias("dup"))


_SQL_MEDIA = f"""{SQL_PHOTO},
media0 AS (SELECT person, photo_id AS media_id, string_split(uri, '::')[-1] AS path, kind, ts, title FROM photo WHERE source = 'google_photos' AND uri IS NOT NULL),
media AS (SELECT person, media_id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, string_split(path, '/')[-1] AS name, kind, ts, title FROM media0),
side0 AS (SELECT person, photo_id AS sidecar_id, string_split(uri, '::')[-1] AS path, title FROM photo WHERE source = 'google_photos' AND ts_origin = 'sidecar' AND uri IS NOT NULL),
side AS (SELECT person, sidecar_id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir,
    lower(regexp_replace(regexp_replace(title, '\\.[^.]*$', ''), '-({_MARKS})$', '', 'i') || regexp_extract(title, '(\\.[^.]*)$', 1)) AS title,
    coalesce(TRY_CAST(regexp_extract(regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', ''), '\\((\\d+)\\)$', 1) AS INT), 0) AS dup FROM side0),
best AS (SELECT person, dir, title, dup, max(sidecar_id) AS sidecar_id FROM side GROUP BY ALL),
keyed AS (SELECT *, coalesce(TRY_CAST(regexp_extract(st, '\\((\\d+)\\)$', 1) AS INT), 0) AS dup, regexp_replace(regexp_replace(st, '\\(\\d+\\)$', ''), '-({_MARKS})$', '', 'i') AS base, lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) AS ext
  FROM (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS st FROM media)),
joined AS (SELECT k.*, a.sidecar_id AS s1, b.sidecar_id AS s2 FROM keyed k
  LEFT JOIN best a ON a.person = k.person AND a.dir = k.dir AND a.title = lower(k.base) || '.' || k.ext AND a.dup = k.dup
  LEFT JOIN best b ON b.person = k.person AND b.dir = k.dir AND b.title = lower(k.base) || '.' || k.ext AND b.dup = 0),
near AS (SELECT j.media_id, min(b.sidecar_id) AS s3 FROM joined j JOIN best b ON b.person = j.person AND b.dir = j.dir AND b.dup = j.dup AND starts_with(b.title, lower(j.base))
  WHERE j.s1 IS NULL AND j.s2 IS NULL GROUP BY j.media_id HAVING count(DISTINCT b.title) = 1),
paired AS (SELECT person, j.media_id, dir, name, coalesce(s1, s2, s3) AS sidecar_id, CASE WHEN s1 IS NOT NULL THEN 'same' WHEN s2 IS NOT NULL THEN 'first' WHEN s3 IS NOT NULL THEN 'prefix' END AS found
  FROM joined j LEFT JOIN near n ON n.media_id = j.media_id)"""


def sidecar_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sidecar of every media file, and how it was found."""
    return ops.pair_sidecars(_media(spark, sf_dir), _sidecars(spark, sf_dir), ["person"])


def unpaired_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media without a sidecar, with the time that their name tells."""
    lone = sidecar_pairing(spark, sf_dir).where("sidecar_id IS NULL")
    return lone.select("media_id", "name", scalar.time_from_filename("name").alias("ts"))


def live_photo_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media without the video halves of live photos; every seventh image is given such a half, as the table holds none."""
    m = _media(spark, sf_dir)
    halves = m.where("kind = 'image' AND media_id % 7 = 0").withColumns({"media_id": F.col("media_id") + 1_000_000_000, "name": F.concat(F.upper(scalar.stem("name")), F.lit(".MOV")), "kind": F.lit("video")})
    return ops.fold_live_photos(m.unionByName(halves), ["person"]).select("media_id", "kind")


def album_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library records after merging the copies in albums."""
    return ops.album_dedup(photos(spark, sf_dir).where("source = 'google_photos'")).select("photo_id", "copies", "favorite", "views", "description")


def fold_posted_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library records after folding in what was posted of them."""
    return ops.fold_posted_copies(photos(spark, sf_dir))


def merge_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots over all libraries, credited to one owner."""
    return ops.merge_libraries(photos(spark, sf_dir), "person", ["person", "ts", "photo_id"])


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages as the exports have them: sender and thread instead of direction and counterpart."""
    s = table(spark, sf_dir, "social", ["social_id", "person", "ts", "source", "kind", "text", "who"])
    s = s.where("kind IN ('message_in', 'message_out') AND who IS NOT NULL AND ts IS NOT NULL AND ts <> 0 AND text <> ''")
    name = F.lower(F.trim(F.regexp_replace("who", r"\s+", " ")))
    return s.select(
        "person", "source", F.col("social_id").alias("id"), "ts", F.concat_ws("/", "source", name).alias("thread"), F.when(F.col("kind") == "message_out", F.col("person")).otherwise(name).alias("sender"), F.array("person", name).alias("members"),
    )


_SQL_MESSAGES = r"""raw0 AS (SELECT *, lower(trim(regexp_replace(who, '\s+', ' ', 'g'))) AS name FROM social WHERE kind IN ('message_in', 'message_out') AND who IS NOT NULL AND ts IS NOT NULL AND ts <> 0 AND text <> ''),
raw AS (SELECT person, source, social_id AS id, ts, source || '/' || name AS thread, CASE WHEN kind = 'message_out' THEN person ELSE name END AS sender, name FROM raw0),
own AS (SELECT person, source, sender AS self, threads FROM (SELECT person, source, sender, count(DISTINCT thread) AS threads, min(struct_pack(ts := ts, id := id)) AS seen FROM raw GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY person, source ORDER BY threads DESC, seen, sender) = 1)"""


def self_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who of the senders is the owner of each account."""
    return ops.self_names(_messages(spark, sf_dir), ["person", "source"])


def messages_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction and counterpart of each message."""
    return ops.direct_messages(_messages(spark, sf_dir), ["person", "source"]).select("id", "direction", "counterpart")


def library_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source and kind, with the range of times, of items and of social records."""
    p = photos(spark, sf_dir).select(F.lit("photos").alias("tbl"), "source", "kind", "ts", F.col("lat").isNotNull().alias("placed"))
    s = table(spark, sf_dir, "social", ["source", "kind", "ts", "lat"]).where("ts IS NOT NULL AND ts <> 0").select(F.lit("social").alias("tbl"), "source", "kind", "ts", F.col("lat").isNotNull().alias("placed"))
    return p.unionByName(s).groupBy("tbl", "source", "kind").agg(F.count("*").alias("n"), F.count_if("placed").alias("placed"), F.min("ts").alias("first"), F.max("ts").alias("last"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (sidecar_pairing, unpaired_media, live_photo_fold, album_dedup, fold_posted_copies, merge_libraries, self_name, messages_directed, library_summary)
}
SQL: dict[str, str] = {
    "sidecar_pairing": f"WITH {_SQL_MEDIA} SELECT * FROM paired",
    "unpaired_media": f"WITH {_SQL_MEDIA} SELECT media_id, name, {sql_file_time('name')} AS ts FROM paired WHERE sidecar_id IS NULL",
    "live_photo_fold": f"""WITH {_SQL_MEDIA}, lm AS (SELECT person, media_id, dir, name, kind FROM media UNION ALL SELECT person, media_id + 1000000000, dir, upper(regexp_replace(name, '\\.[^.]*$', '')) || '.MOV', 'video' FROM media WHERE kind = 'image' AND media_id % 7 = 0)
      SELECT media_id, kind FROM lm m WHERE NOT (kind = 'video' AND EXISTS (SELECT 1 FROM lm i WHERE i.kind = 'image' AND i.person = m.person AND i.dir = m.dir
      AND lower(regexp_replace(i.name, '\\.[^.]*$', '')) = lower(regexp_replace(m.name, '\\.[^.]*$', ''))))""",
    "album_dedup": f"""WITH {SQL_PHOTO}, r AS (SELECT *, lower(regexp_replace(regexp_replace(title, '\\.[^.]*$', ''), '-({_MARKS})$', '', 'i')) AS st, CAST(round_even(ts, 0) AS BIGINT) AS sec,
      struct_pack(a := NOT coalesce(starts_with(album, 'Photos from'), false), u := uri, p := photo_id) AS ord FROM photo WHERE source = 'google_photos')
      SELECT arg_min(photo_id, ord) AS photo_id, count(*) AS copies, bool_or(favorite) AS favorite, max(views) AS views, arg_min(description, ord) FILTER (description <> '') AS description FROM r GROUP BY person, kind, st, sec""",
    "fold_posted_copies": f"""WITH {SQL_PHOTO}, cp AS (SELECT * FROM photo WHERE source IN ('facebook', 'instagram', 'x')), og AS (SELECT * FROM photo WHERE source NOT IN ('facebook', 'instagram', 'x')),
      sure AS (SELECT c.photo_id, any_value(c.description) AS description, any_value(c.lat) AS lat, any_value(c.lon) AS lon, min(o.photo_id) AS original FROM cp c JOIN og o ON o.person = c.person AND o.kind = c.kind AND o.ts >= c.ts - 2 AND o.ts < c.ts + 2
        WHERE c.ts_origin = 'exif' GROUP BY c.photo_id HAVING count(*) = 1),
      adds AS (SELECT original, count(*) AS copies, arg_min(description, photo_id) FILTER (description <> '') AS said, arg_min(lat, photo_id) FILTER (lat IS NOT NULL) AS alat, arg_min(lon, photo_id) FILTER (lat IS NOT NULL) AS alon FROM sure GROUP BY original)
      SELECT photo_id, person, ts, shared OR copies IS NOT NULL AS shared, CASE WHEN description <> '' THEN description ELSE coalesce(said, '') END AS description, coalesce(lat, alat) AS lat, coalesce(lon, alon) AS lon, coalesce(copies, 0) AS copies
      FROM og LEFT JOIN adds ON original = photo_id
      UNION ALL SELECT photo_id, person, ts, shared, description, lat, lon, CAST(NULL AS BIGINT) FROM cp WHERE photo_id NOT IN (SELECT photo_id FROM sure)""",
    "merge_libraries": f"""WITH {SQL_PHOTO}, r AS (SELECT *, struct_pack(r := coalesce(regexp_matches(origin, '(?i)partner|shared'), false), a := person, b := ts, c := photo_id) AS ord, lower(regexp_replace(title, '\\.[^.]*$', '')) AS name, CAST(round_even(ts, 0) AS BIGINT) AS second FROM photo)
      SELECT name, second, kind, arg_min(person, ord) AS owner, arg_min(photo_id, ord) AS photo_id, bool_or(favorite) AS favorite, count(*) AS copies, count(DISTINCT person) AS owners FROM r GROUP BY name, second, kind""",
    "self_name": f"WITH {_SQL_MESSAGES} SELECT * FROM own",
    "messages_directed": f"""WITH {_SQL_MESSAGES} SELECT id, CASE WHEN sender = self THEN 'message_out' ELSE 'message_in' END AS direction, CASE WHEN sender <> self THEN sender WHEN person = self THEN name ELSE person END AS counterpart FROM raw JOIN own USING (person, source)""",
    "library_summary": f"""WITH {SQL_PHOTO}, r AS (SELECT 'photos' AS tbl, source, kind, ts, lat IS NOT NULL AS placed FROM photo UNION ALL SELECT 'social', source, kind, ts, lat IS NOT NULL FROM social WHERE ts IS NOT NULL AND ts <> 0)
      SELECT tbl, source, kind, count(*) AS n, count(*) FILTER (placed) AS placed, min(ts) AS first, max(ts) AS last FROM r GROUP BY tbl, source, kind""",
}
