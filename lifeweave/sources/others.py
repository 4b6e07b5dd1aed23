"""Readers of X archives, GPX and TCX tracks, and the EXIF head of photos."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeweave.functions import scalar
from lifeweave.functions.geo import valid_latlon
from lifeweave.operators.track import GPX
from lifeweave.sources.archives import text_of

# Paths of an archive's members.
TWEETS = r"(^|/)data/tweets?(-part\d+)?\.js$"
TWEET_MEDIA = r"data/tweets?_media/(\d+)-[^/]+$"
DIRECT = r"(^|/)data/direct-messages(-part\d+)?\.js$"
HEAD_BYTES, SMALL_IMAGE = 256 * 1024, 50_000


def _js(contents: DataFrame, pattern: str) -> DataFrame:
    """The list that a script assigns, one element a row, as JSON text."""
    j = contents.where(F.col("name").rlike(pattern)).select("container", F.regexp_replace(text_of(), r"^[^=]*=\s*", "").alias("j"))
    return j.select("container", F.explode(F.from_json("j", "array<string>")).alias("o"))


def _get(c: str, path: str) -> Column:
    return F.get_json_object(c, path)


def tweets(contents: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(social, media) of posts and replies; retweets are left out, media belong to the post whose id begins their name."""
    t = _js(contents, TWEETS).select("container", F.coalesce(_get("o", "$.tweet"), F.col("o")).alias("t"))
    lon, lat = (_get("t", f"$.coordinates.coordinates[{i}]").try_cast("double") for i in (0, 1))
    ok = valid_latlon(lat, lon)
    text = F.coalesce(_get("t", "$.full_text"), _get("t", "$.text"), F.lit(""))
    t = t.select("container", _get("t", "$.id_str").alias("id"), scalar.parse_time(_get("t", "$.created_at")).alias("ts"), text.alias("raw"), scalar.strip_links(text).alias("text"), F.when(ok, lat).alias("lat"), F.when(ok, lon).alias("lon"),
                 F.coalesce(_get("t", "$.in_reply_to_screen_name"), F.lit("")).alias("who"), F.coalesce(_get("t", "$.place.full_name"), F.lit("")).alias("place")).where(~F.col("raw").startswith("RT @"))
    social = t.where("ts IS NOT NULL AND text <> ''").select("ts", F.lit("x").alias("source"), F.when(F.col("who") != "", "comment").otherwise("post").alias("kind"), "text", "who", "place", "lat", "lon")
    media = members.where(F.col("name").rlike(TWEET_MEDIA)).select("container", F.col("name").alias("member"), F.regexp_extract("name", TWEET_MEDIA, 1).alias("id"), scalar.media_kind("name").alias("kind")).where("kind IS NOT NULL")
    media = t.where("ts IS NOT NULL").join(media, ["container", "id"])
    return social, media.select("container", "member", "ts", "lat", "lon", "kind", F.col("text").alias("description"), F.lit("x").alias("source"), F.lit("post").alias("ts_origin"), F.lit(True).alias("shared"))


def direct_messages(contents: DataFrame) -> DataFrame:
    """Direct messages, if the archive tells whose it is."""
    me = _js(contents, r"(^|/)data/account\.js$").select("container", _get("o", "$.account.accountId").alias("me"))
    m = _js(contents, DIRECT).select("container", F.explode(F.from_json(_get("o", "$.dmConversation.messages"), "array<string>")).alias("m")).select("container", _get("m", "$.messageCreate").alias("m")).join(me, "container")
    mine = _get("m", "$.senderId") == F.col("me")
    out = m.select(
        scalar.parse_time(_get("m", "$.createdAt")).alias("ts"), F.lit("x").alias("source"), F.when(mine, "message_out").otherwise("message_in").alias("kind"), F.regexp_replace(_get("m", "$.text"), r"\s*https://t\.co/\w+", "").alias("text"),
        F.when(mine, _get("m", "$.recipientId")).otherwise(_get("m", "$.senderId")).alias("who"),
    )
    return out.where("ts IS NOT NULL AND text <> ''")


def track_points(contents: DataFrame) -> DataFrame:
    """Fixes of GPX (track, route and way points, attributes in either order) and TCX files; points without a time or a
    position are left out, and every TCX point is read on its own, so none borrows the next one's position."""
    t = contents.where(F.lower("name").rlike(r"\.(gpx|tcx)$")).select(F.lower("name").alias("name"), text_of().alias("x"))
    gpx = t.where("name LIKE '%.gpx'").select(F.explode(F.regexp_extract_all("x", F.lit(r"(?s)(<(?:trkpt|rtept|wpt)\s[^>]*>.*?</(?:trkpt|rtept|wpt)>)"), 1)).alias("p"))
    one = lambda pattern: F.regexp_extract("p", pattern, 1)
    a = gpx.select(scalar.parse_time(one(r"<time>([^<]+)</time>")).alias("t"), one(r'^<[^>]*\blat="([-\d.]+)"').try_cast("double").alias("lat"), one(r'^<[^>]*\blon="([-\d.]+)"').try_cast("double").alias("lon"))
    tcx = t.where("name LIKE '%.tcx'").select(F.explode(F.regexp_extract_all("x", F.lit(r"(?s)<Trackpoint>(.*?)</Trackpoint>"), 1)).alias("p"))
    b = tcx.select(scalar.parse_time(one(r"<Time>([^<]+)</Time>")).alias("t"), one(r"<LatitudeDegrees>([-\d.]+)</LatitudeDegrees>").try_cast("double").alias("lat"), one(r"<LongitudeDegrees>([-\d.]+)</LongitudeDegrees>").try_cast("double").alias("lon"))
    out = a.unionByName(b).where(F.col("t").isNotNull() & valid_latlon("lat", "lon"))
    return out.select("t", "lat", "lon", F.lit(GPX).cast("tinyint").alias("src"), F.lit(0.0).cast("float").alias("acc"))


# ---- EXIF (a TIFF directory in a JPEG head)


def _directory(data: bytes, at: int, order: str) -> dict[int, tuple]:
    """Tag to (type, count, offset of the value) of one image file directory."""
    out = {}
    (n,) = struct.unpack_from(order + "H", data, at)
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}.get(kind, 1) * count
        place = at + 2 + 12 * k + 8
        out[tag] = (kind, count, place if size <= 4 else struct.unpack_from(order + "I", data, place)[0])
    return out


def _value(data: bytes, entry: tuple, order: str):
    kind, count, at = entry
    if kind == 2:
        return data[at : at + count].split(b"\0")[0].decode("latin-1").strip()
    if kind in (5, 10):
        pairs = struct.unpack_from(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", data, at)
        return [a / b if b else float("nan") for a, b in zip(pairs[::2], pairs[1::2])]
    if kind == 3:
        return struct.unpack_from(f"{order}{count}H", data, at)
    return struct.unpack_from(f"{order}{count}I", data, at) if kind == 4 else data[at : at + count]


def read_exif(data: bytes | None) -> tuple[str | None, str | None, float | None, float | None]:
    """(time as 'YYYY:MM:DD HH:MM:SS', its offset or None, lat, lon) of a JPEG or TIFF head; None for what isn't there."""
    nothing = (None, None, None, None)
    if not data:
        return nothing
    try:
        if data[:2] == b"\xff\xd8":
            at = data.find(b"Exif\0\0")
            if at < 0:
                return nothing
            data = data[at + 6 :]
        if data[:4] not in (b"II*\0", b"MM\0*"):
            return nothing
        order = "<" if data[:2] == b"II" else ">"
        main = _directory(data, struct.unpack_from(order + "I", data, 4)[0], order)
        sub = lambda tag: _directory(data, _value(data, main[tag], order)[0], order) if tag in main else {}
        exif, gps = sub(0x8769), sub(0x8825)
        when = _value(data, exif[0x9003], order) if 0x9003 in exif else _value(data, main[0x0132], order) if 0x0132 in main else None
        zone = _value(data, exif[0x9011], order) if 0x9011 in exif else None
        lat = lon = None
        if 2 in gps and 4 in gps:
            place = []
            for value, ref in ((2, 1), (4, 3)):
                d, m, s = _value(data, gps[value], order)
                v = d + m / 60 + s / 3600
                place.append(-v if ref in gps and _value(data, gps[ref], order)[:1] in ("S", "W", b"S", b"W") else v)
            if all(v == v for v in place) and place != [0, 0]:
                lat, lon = place
        return when[:19] if when else None, zone if zone and re.fullmatch(r"[+-]\d\d:\d\d", zone) else None, lat, lon
    except (struct.error, IndexError, ValueError, KeyError, TypeError):
        return nothing


def loose_photos(heads: DataFrame, members: DataFrame, source: str = "photos") -> DataFrame:
    """Photos and videos without sidecars: time and position from EXIF, else the time that the file name tells. Images of
    less than SMALL_IMAGE bytes are left out (unknown sizes pass); videos need a time in their name.

    heads: container, name, content (the first HEAD_BYTES of images)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [read_exif(x) for x in pdf["content"]]
            yield pd.DataFrame({"container": pdf["container"], "name": pdf["name"], "taken": [g[0] for g in got], "zone": [g[1] for g in got], "lat": [g[2] for g in got], "lon": [g[3] for g in got]})

    exif = heads.mapInPandas(read, "container string, name string, taken string, zone string, lat double, lon double")
    kind = scalar.media_kind("name")
    m = members.where(kind.isNotNull()).select("container", "name", "size", kind.alias("kind")).where("kind = 'video' OR coalesce(size, -1) NOT BETWEEN 0 AND 49999")
    m = m.join(exif, ["container", "name"], "left")
    taken = F.when(F.col("kind") == "image", scalar.parse_time(F.concat("taken", F.coalesce("zone", F.lit("")))))
    told = scalar.time_from_filename(scalar.basename("name"))
    out = m.select(
        F.concat_ws("::", "container", "name").alias("uri"), F.coalesce(taken, told).alias("ts"), "lat", "lon", F.lit(source).alias("source"), scalar.basename("name").alias("title"), scalar.basename(scalar.dirname("name")).alias("album"),
        F.when(taken.isNotNull(), "exif").otherwise("filename").alias("ts_origin"), "kind",
    )
    return out.where("ts IS NOT NULL")
