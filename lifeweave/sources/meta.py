"""Readers of Facebook and Instagram exports. Each takes rows of (container, name, content) and gives typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeweave.functions import scalar
from lifeweave.functions.geo import valid_latlon
from lifeweave.sources.archives import text_of

# Names of the files that hold each kind of record.
MESSAGES = r"/messages/(inbox|e2ee_cutover|archived_threads|filtered_threads|message_requests)/[^/]+/message_\d+\.json$"
FB_POSTS = r"(^|/)(your_posts[^/]*|your_uncategorized_photos|your_videos|album/\d+|group_posts_and_comments)\.json$"
FB_OTHER_POSTS = r"(^|/)posts_on_other_pages_and_profiles\.json$"
IG_POSTS = r"(^|/)content/(posts_\d+|stories|reels|archived_posts|igtv_videos)\.json$"
COMMENTS = r"(^|/)comments[^/]*/[^/]*comments[^/]*\.json$|(^|/)(comments|your_comments_in_groups)\.json$"
FB_LOCATION = r"(^|/)(location_history|your_location_history|check-ins|check_ins)[^/]*\.json$"


def _get(col: str | Column, path: str) -> Column:
    return F.get_json_object(col, path)


def _list(text: Column) -> Column:
    """A document that is a list, or an object whose first list counts; elements as JSON text."""
    text = F.trim(text)
    values = F.map_values(F.from_json(text, "map<string,string>"))
    inner = F.get(F.filter(values, lambda v: v.startswith("[")), F.lit(0))
    return F.from_json(F.when(text.startswith("["), text).otherwise(inner), "array<string>")


def _items(contents: DataFrame, pattern: str) -> DataFrame:
    return contents.where(F.col("name").rlike(pattern)).select("container", "name", F.explode(_list(text_of())).alias("o"))


def _text(c: Column) -> Column:
    return scalar.fix_mojibake(c)


def _first_exif(media: str, test) -> Column:
    """The first EXIF entry of a medium, of photo or video, that passes a test."""
    lists = [F.coalesce(F.from_json(_get(media, f"$.media_metadata.{k}.exif_data"), "array<string>"), F.array().cast("array<string>")) for k in ("photo_metadata", "video_metadata")]
    return F.get(F.filter(F.concat(*lists), test), F.lit(0))


def posted_media(items: DataFrame, platform: str) -> DataFrame:
    """Media rows (container, uri, ts, ts_origin, lat, lon, caption) from items with a JSON text ``m`` and caption, fallback
    time and position of their post (said, at, plat, plon). The camera's time, if the upload kept it, comes first."""
    ok = lambda e: valid_latlon(_get(e, "$.latitude").try_cast("double"), _get(e, "$.longitude").try_cast("double"))
    taken_of = lambda e: scalar.parse_time(F.coalesce(_get(e, "$.taken_timestamp"), _get(e, "$.date_time_original")))
    placed, dated = _first_exif("m", ok), _first_exif("m", lambda e: taken_of(e).isNotNull())
    taken = taken_of(dated)
    made = scalar.parse_time(_get("m", "$.creation_timestamp"))
    out = items.select(
        "container", _get("m", "$.uri").alias("uri"), F.coalesce(taken, made, F.col("at")).alias("ts"), F.when(taken.isNotNull(), "exif").otherwise("post").alias("ts_origin"),
        F.coalesce(_get(placed, "$.latitude").try_cast("double"), F.col("plat")).alias("lat"), F.coalesce(_get(placed, "$.longitude").try_cast("double"), F.col("plon")).alias("lon"),
        F.coalesce(F.nullif(F.col("said"), F.lit("")), _text(_get("m", "$.description")), F.lit("")).alias("description"), F.lit(platform).alias("source"), F.lit(True).alias("shared"),
    )
    return out.where(scalar.media_kind("uri").isNotNull() & F.col("ts").isNotNull()).withColumn("kind", scalar.media_kind("uri"))


def facebook_posts(contents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(social, places, media) of posts, albums and group posts. Of several places the first counts, but for journeys
    ('travelling to'): there the post was made at the last, and both are named."""
    i = _items(contents, FB_POSTS)
    strings = lambda c, p: F.coalesce(F.from_json(_get(c, p), "array<string>"), F.array().cast("array<string>"))
    i = i.select("container", "o", scalar.parse_time(F.coalesce(_get("o", "$.timestamp"), _get("o", "$.creation_timestamp"))).alias("ts"), _text(_get("o", "$.title")).alias("title"),
                 F.array_join(F.filter(F.transform(strings("o", "$.data"), lambda d: _get(d, "$.post")), lambda p: p != ""), " ").alias("text"),
                 F.flatten(F.transform(strings("o", "$.attachments"), lambda a: strings(a, "$.data"))).alias("att"))
    i = i.withColumns({"text": _text(F.col("text")), "pls": F.filter(F.transform("att", lambda d: _get(d, "$.place")), lambda p: p.isNotNull()), "med": F.filter(F.transform("att", lambda d: _get(d, "$.media")), lambda m: m.isNotNull())})
    travel = (F.size("pls") > 1) & F.coalesce(F.col("title").contains("travelling to"), F.lit(False))
    here = F.when(travel, F.try_element_at("pls", F.lit(-1))).otherwise(F.get("pls", F.lit(0)))
    i = i.withColumns({"here": here, "travel": travel})
    first, last = _text(_get(F.get("pls", F.lit(0)), "$.name")), _text(_get(F.try_element_at("pls", F.lit(-1)), "$.name"))
    lat, lon = _get("here", "$.coordinate.latitude").try_cast("double"), _get("here", "$.coordinate.longitude").try_cast("double")
    ok = valid_latlon(lat, lon)
    place = F.when(F.col("travel"), F.concat(last, F.lit(" → "), first)).otherwise(F.coalesce(_text(_get("here", "$.name")), F.lit("")))
    i = i.withColumns({"place": place, "plat": F.when(ok, lat), "plon": F.when(ok, lon), "med": F.when(_get("o", "$.uri").isNotNull(), F.array_append("med", F.col("o"))).otherwise(F.col("med"))})
    kind = F.when((F.col("place") != "") & (F.col("text") == ""), "checkin").otherwise("post")
    social = i.where("ts IS NOT NULL AND ts <> 0 AND (text <> '' OR place <> '')").select(
        "ts", F.lit("facebook").alias("source"), kind.alias("kind"), F.when(F.col("text") != "", F.col("text")).otherwise(F.coalesce("title", F.lit(""))).alias("text"), F.lit("").alias("who"), "place", F.col("plat").alias("lat"), F.col("plon").alias("lon"), F.transform("med", lambda m: _get(m, "$.uri")).alias("media"),
    )
    places = i.where("ts IS NOT NULL AND ts <> 0 AND place <> '' AND plat IS NOT NULL").select(F.col("ts").alias("t0"), F.col("ts").alias("t1"), F.col("plat").alias("lat"), F.col("plon").alias("lon"), F.col("place").alias("name"), F.lit("facebook").alias("source"))
    media = posted_media(i.select("container", F.explode("med").alias("m"), F.col("text").alias("said"), F.col("ts").alias("at"), "plat", "plon"), "facebook")
    return social, places, media


def facebook_other_posts(contents: DataFrame) -> DataFrame:
    """Posts on others' pages, from their lists of labels and values."""
    i = _items(contents, FB_OTHER_POSTS)
    labels = F.map_from_entries(F.transform(F.from_json(_get("o", "$.label_values"), "array<struct<label:string,value:string>>"), lambda x: F.struct(x["label"], x["value"])))
    out = i.select(scalar.parse_time(_get("o", "$.timestamp")).alias("ts"), _text(F.try_element_at(labels, F.lit("Message"))).alias("text"), F.coalesce(_text(F.try_element_at(labels, F.lit("Target"))), F.lit("")).alias("who"))
    return out.where("ts IS NOT NULL AND ts <> 0 AND text <> ''").select("ts", F.lit("facebook").alias("source"), F.lit("post").alias("kind"), "text", "who")


def instagram_posts(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(social, media) of posts, stories and reels; an item without a media list is its own only medium."""
    i = _items(contents, IG_POSTS)
    own = F.from_json(_get("o", "$.media"), "array<string>")
    i = i.select("container", "name", "o", F.when(F.size(own) > 0, own).otherwise(F.array("o")).alias("med"))
    one = F.get("med", F.lit(0))
    i = i.withColumns({"ts": scalar.parse_time(F.coalesce(_get("o", "$.creation_timestamp"), _get(one, "$.creation_timestamp"))), "text": _text(F.coalesce(F.nullif(_get("o", "$.title"), F.lit("")), _get(one, "$.title"), F.lit("")))})
    kind = F.when(F.col("name").contains("stories"), "story").otherwise("post")
    social = i.where("ts IS NOT NULL AND ts <> 0 AND text <> ''").select("ts", F.lit("instagram").alias("source"), kind.alias("kind"), "text", F.transform("med", lambda m: _get(m, "$.uri")).alias("media"))
    none = F.lit(None).cast("double")
    media = posted_media(i.select("container", F.explode("med").alias("m"), F.col("text").alias("said"), F.col("ts").alias("at"), none.alias("plat"), none.alias("plon")), "instagram")
    return social, media


def comments(contents: DataFrame, platform: str) -> DataFrame:
    """Comments of both platforms; whom they are on comes from the title or the media owner."""
    i = _items(contents, COMMENTS)
    fb = i.select("o", F.explode(F.from_json(_get("o", "$.data"), "array<string>")).alias("d"))
    fb = fb.select(
        scalar.parse_time(F.coalesce(_get("d", "$.comment.timestamp"), _get("o", "$.timestamp"))).alias("ts"), _text(_get("d", "$.comment.comment")).alias("text"), F.regexp_extract(F.coalesce(_text(_get("o", "$.title")), F.lit("")), r"(?:on|to) (.+?)'s? ", 1).alias("who"),
    )
    ig = i.where(_get("o", "$.string_map_data").isNotNull()).select(
        scalar.parse_time(_get("o", "$.string_map_data.Time.timestamp")).alias("ts"), _text(_get("o", "$.string_map_data.Comment.value")).alias("text"), F.coalesce(_text(_get("o", "$.string_map_data['Media Owner'].value")), F.lit("")).alias("who"),
    )
    out = fb.unionByName(ig).where("ts IS NOT NULL AND ts <> 0 AND text <> ''")
    return out.select("ts", F.lit(platform).alias("source"), F.lit("comment").alias("kind"), "text", "who")


def facebook_places(contents: DataFrame) -> DataFrame:
    """Check-ins and location history."""
    i = _items(contents, FB_LOCATION)
    ts = scalar.parse_time(F.coalesce(_get("o", "$.creation_timestamp"), _get("o", "$.timestamp")))
    out = i.select(ts.alias("t0"), ts.alias("t1"), _get("o", "$.coordinate.latitude").try_cast("double").alias("lat"), _get("o", "$.coordinate.longitude").try_cast("double").alias("lon"), F.coalesce(_text(_get("o", "$.name")), F.lit("")).alias("name"), F.lit("facebook").alias("source"))
    return out.where(F.col("t0").isNotNull() & (F.col("t0") != 0) & valid_latlon("lat", "lon"))


def messages(contents: DataFrame) -> DataFrame:
    """Raw messages: ts, sender, text, thread, members; empty and unsent ones are left out."""
    j = contents.where(F.col("name").rlike(MESSAGES)).select(text_of().alias("j"))
    members = F.transform(F.from_json(_get("j", "$.participants"), "array<struct<name:string>>"), lambda p: _text(p["name"]))
    thread = F.coalesce(F.nullif(_text(_get("j", "$.title")), F.lit("")), F.array_join(members, ", "))
    m = j.select(members.alias("members"), thread.alias("thread"), F.explode(F.from_json(_get("j", "$.messages"), "array<string>")).alias("m"))
    out = m.select(scalar.parse_time(_get("m", "$.timestamp_ms")).alias("ts"), _text(F.coalesce(_get("m", "$.sender_name"), F.lit(""))).alias("sender"), _text(_get("m", "$.content")).alias("text"), "thread", "members", F.coalesce(_get("m", "$.is_unsent"), F.lit("false")).alias("unsent"))
    return out.where("text <> '' AND unsent <> 'true'").drop("unsent")
