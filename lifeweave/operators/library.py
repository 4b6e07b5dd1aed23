"""Merging a media library: sidecars, live photos, albums, posted copies, two owners, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifeweave.functions import scalar

# Platforms whose media are posted copies.
PLATFORMS = ["facebook", "instagram", "x"]


def _media_keys(media: DataFrame) -> DataFrame:
    """Media with the parts that sidecars are found by: folder, base name (without copy number and edit mark), copy number."""
    s = scalar.stem("name")
    return media.withColumns({"dup": scalar.copy_number(s), "base": scalar.without_edit_mark(scalar.without_copy_number(s)), "ext": F.lower(scalar.extension("name"))})


def pair_sidecars(media: DataFrame, sidecars: DataFrame, group: list[str]) -> DataFrame:
    """``media`` with sidecar_id and how it was found: 'same' (same folder, title and copy number), 'first' (copy number 0),
    'prefix' (the only title in the folder, among those with the copy number, that begins with the base name), or NULL.

    media: ``group`` columns, media_id, dir, name; sidecars: ``group`` columns, sidecar_id, dir, title, dup. Of sidecars equal
    in folder, title and number the last (greatest id) counts. Names compare without case."""
    m = _media_keys(media)
    s = sidecars.select(*group, "dir", F.lower("title").alias("title"), "dup", "sidecar_id")
    best = s.groupBy(*group, "dir", "title", "dup").agg(F.max("sidecar_id").alias("sidecar_id"))
    full = F.concat(F.lower("base"), F.lit("."), F.col("ext"))
    m = m.withColumn("title", full)
    same = best.withColumnRenamed("sidecar_id", "s1")
    first = best.where("dup = 0").drop("dup").withColumnRenamed("sidecar_id", "s2")
    m = m.join(same, [*group, "dir", "title", "dup"], "left").join(first, [*group, "dir", "title"], "left")
    found = m.withColumn("sidecar_id", F.coalesce("s1", "s2"))
    open_ = found.where("sidecar_id IS NULL").select(*group, "media_id", "dir", "dup", F.lower("base").alias("base"))
    # titles cut to the lengths that open bases of their folder have: what begins with a base equals it there. A folder's
    # titles are repeated a few dozen times (once a length), never once a file
    lengths = open_.select(*group, "dir", "dup", F.length("base").alias("k")).distinct()
    cut = best.join(lengths, [*group, "dir", "dup"]).where(F.length("title") >= F.col("k")).withColumn("base", F.expr("substring(title, 1, k)"))
    alone = cut.groupBy(*group, "dir", "dup", "base").agg(F.count_distinct("title").alias("titles"), F.min("sidecar_id").alias("s3")).where("titles = 1").drop("titles")
    only = open_.join(alone, [*group, "dir", "dup", "base"]).select(*group, "media_id", "s3")
    out = found.join(only, [*group, "media_id"], "left")
    how = F.when(F.col("s1").isNotNull(), "same").when(F.col("s2").isNotNull(), "first").when(F.col("s3").isNotNull(), "prefix")
    return out.select(*group, "media_id", "dir", "name", F.coalesce("sidecar_id", "s3").alias("sidecar_id"), how.alias("found"))


def fold_live_photos(media: DataFrame, group: list[str]) -> DataFrame:
    """Without videos that share folder and name (but for case and extension) with an image."""
    m = media.withColumn("__stem", F.lower(scalar.stem("name")))
    images = m.where("kind = 'image'").select(*group, "dir", "__stem").distinct().withColumn("__video", F.lit("video"))
    same = [m[g] == images[g] for g in [*group, "dir", "__stem"]] + [m["kind"] == images["__video"]]
    return m.join(images, same, "left_anti").drop("__stem")


def album_dedup(photos: DataFrame) -> DataFrame:
    """One row for each (person, title without edit mark and case, whole second, kind): the first by (not in a yearly folder,
    uri) stands, is a favorite if any row is, has the most views of all and the first description that isn't empty."""
    key = ["person", "kind", "__stem", "__second"]
    rows = photos.withColumns({"__stem": F.lower(scalar.without_edit_mark(scalar.stem("title"))), "__second": F.rint("ts").cast("bigint")})
    order = F.struct((~F.coalesce(F.col("album").startswith("Photos from"), F.lit(False))).alias("a"), F.col("uri"), F.col("photo_id"))
    said = F.when(F.col("description") != "", order)
    return rows.groupBy(*key).agg(
        F.min_by("photo_id", order).alias("photo_id"), F.count("*").alias("copies"), F.bool_or("favorite").alias("favorite"), F.max("views").alias("views"), F.min_by("description", said).alias("description"),
    ).drop("__stem", "__second")


def fold_posted_copies(photos: DataFrame) -> DataFrame:
    """Originals with what their posted copies add, and the number of copies folded; copies that match no or several
    originals stay as rows of their own (copies NULL).

    A copy (of a platform, with the camera's time) matches originals of its person and kind from two seconds before to
    just under two seconds after; buckets of four seconds on both sides bring the candidates together."""
    copy = F.col("source").isin(PLATFORMS)
    originals = photos.where(~copy)
    slot = F.floor(F.col("ts") / 4).cast("bigint")
    o = originals.select("person", "kind", slot.alias("slot"), F.col("ts").alias("at"), F.col("photo_id").alias("original"))
    posted = photos.where(copy & (F.col("ts_origin") == "exif"))
    c = posted.select("person", "kind", F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"), "ts", "photo_id", "description", "lat", "lon")
    near = c.join(o, ["person", "kind", "slot"]).where("at >= ts - 2 AND at < ts + 2")
    sure = near.groupBy("photo_id").agg(F.count("*").alias("n"), F.min("original").alias("original"), F.first("description").alias("description"), F.first("lat").alias("lat"), F.first("lon").alias("lon")).where("n = 1")
    adds = sure.groupBy("original").agg(
        F.count("*").alias("copies"), F.min_by("description", F.when(F.col("description") != "", F.col("photo_id"))).alias("said"), F.min_by(F.struct("lat", "lon"), F.when(F.col("lat").isNotNull(), F.col("photo_id"))).alias("place"),
    )
    shown = originals.join(adds, originals["photo_id"] == adds["original"], "left")
    placed = F.col("lat").isNotNull()
    out = shown.select(
        "photo_id", "person", "ts", (F.col("shared") | F.col("copies").isNotNull()).alias("shared"),
        F.when(F.col("description") != "", F.col("description")).otherwise(F.coalesce("said", F.lit(""))).alias("description"),
        F.when(placed, F.col("lat")).otherwise(F.col("place.lat")).alias("lat"), F.when(placed, F.col("lon")).otherwise(F.col("place.lon")).alias("lon"), F.coalesce("copies", F.lit(0)).alias("copies"),
    )
    rest = photos.where(copy).join(sure.select("photo_id"), "photo_id", "left_anti")
    return out.unionByName(rest.select("photo_id", "person", "ts", "shared", "description", "lat", "lon", F.lit(None).cast("bigint").alias("copies")))


def merge_libraries(photos: DataFrame, owner: str, order: list[str]) -> DataFrame:
    """One row for each shot that several owners' libraries hold (name without case and extension, whole second, kind): the
    owner whose copy wasn't received from someone else is credited, else the first; a favorite of any is one."""
    received = F.coalesce(F.col("origin").rlike(scalar.RECEIVED_ORIGIN), F.lit(False))
    key = [F.lower(scalar.stem("title")).alias("name"), F.rint("ts").cast("bigint").alias("second"), F.col("kind")]
    rank = F.struct(received.alias("r"), *[F.col(x) for x in order])
    return photos.groupBy(*key).agg(F.min_by(owner, rank).alias("owner"), F.min_by("photo_id", rank).alias("photo_id"), F.bool_or("favorite").alias("favorite"), F.count("*").alias("copies"), F.count_distinct(owner).alias("owners"))


def self_names(messages: DataFrame, group: list[str]) -> DataFrame:
    """The sender found in most threads of each ``group`` (ties: the one seen first); messages: thread, sender, ts, id."""
    per = messages.where("sender IS NOT NULL").groupBy(*group, "sender").agg(F.count_distinct("thread").alias("threads"), F.min(F.struct("ts", "id")).alias("seen"))
    w = Window.partitionBy(*group).orderBy(F.desc("threads"), "seen", "sender")
    return per.withColumn("k", F.row_number().over(w)).where("k = 1").select(*group, F.col("sender").alias("self"), "threads")


def direct_messages(messages: DataFrame, group: list[str]) -> DataFrame:
    """Messages with direction (out, in) and counterpart: the thread if it has more than two members, else the other member;
    for received ones the sender. messages: ``group``, id, thread, sender, members (array)."""
    own = self_names(messages, group).select(*group, "self")
    m = messages.join(own, group)
    out = F.col("sender") == F.col("self")
    other = F.get(F.filter("members", lambda x: x != F.col("self")), F.lit(0))
    who = F.when(~out, F.col("sender")).when(F.size("members") > 2, F.col("thread")).otherwise(other)
    return m.select(*group, "id", F.when(out, "message_out").otherwise("message_in").alias("direction"), who.alias("counterpart"))
