"""Queries of film timelines: each person's film of positioned favorites, and windows over the frames of a track."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lifeweave.functions.geo import lat_of, world_x, world_y, zoom_for_bbox
from lifeweave.operators import frames as ops
from lifeweave.operators.adjacent import numbered, running_sum, windowed, with_neighbours
from lifeweave.plans.common import SQL_FIX, SQL_PHOTO, fixes, photos
from lifeweave.session import checkpoint

FPS, INTRO, OUTRO, HOLD, HOLD_VIDEO, TRANS = 10, 5.0, 6.0, 2.2, 4.0, 1.0


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = photos(spark, sf_dir).where("favorite AND lat IS NOT NULL")
    slot = F.row_number().over(Window.partitionBy("person").orderBy("ts", "photo_id")) - 1
    return p.select("person", "photo_id", "ts", F.col("kind").alias("media"), slot.alias("slot"), F.when(F.col("kind") == "video", HOLD_VIDEO).otherwise(HOLD).alias("hold"), F.lit(TRANS).alias("trans"))


_SQL_SLOTS = f"""{SQL_PHOTO},
slots AS (SELECT person, photo_id, ts, kind AS media, row_number() OVER (PARTITION BY person ORDER BY ts, photo_id) - 1 AS slot, CASE WHEN kind = 'video' THEN {HOLD_VIDEO} ELSE {HOLD} END AS hold FROM photo WHERE favorite AND lat IS NOT NULL),
parts AS (SELECT person, slot, 0 AS o, 'hold' AS kind, CAST(round_even(hold * {FPS}, 0) AS BIGINT) AS n FROM slots
  UNION ALL SELECT person, slot, 1, 'trans', {int(TRANS * FPS)} FROM slots WHERE slot < (SELECT max(slot) FROM slots m WHERE m.person = slots.person)
  UNION ALL SELECT person, -1, 0, 'intro', {int(INTRO * FPS)} FROM slots GROUP BY person UNION ALL SELECT person, max(slot), 2, 'outro', {int(OUTRO * FPS)} FROM slots GROUP BY person),
seg AS (SELECT person, kind, slot, CAST(sum(n) OVER w - n AS BIGINT) AS f0, CAST(sum(n) OVER w AS BIGINT) AS f1 FROM parts WINDOW w AS (PARTITION BY person ORDER BY slot, o ROWS UNBOUNDED PRECEDING))"""


def frame_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intro, holds, transitions and outro in frames."""
    return ops.segments(_slots(spark, sf_dir), "person", FPS, INTRO, OUTRO)


def frame_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyframes of the map clock."""
    return ops.anchors(frame_segments(spark, sf_dir), _slots(spark, sf_dir), "person")


def _world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixes(spark, sf_dir).select("person", "t", world_x("lon").alias("mx"), world_y("lat").alias("my"))


def _film(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Segments and keyframes, computed once for all that a film needs them for."""
    segs = checkpoint(frame_segments(spark, sf_dir))
    return segs, checkpoint(ops.anchors(segs, _slots(spark, sf_dir), "person"))


def _photo_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The track that a person's photos draw; it stands for a second person's."""
    return photos(spark, sf_dir).where("lat IS NOT NULL").select("person", F.col("ts").alias("t"), world_x("lon").alias("mx"), world_y("lat").alias("my"))


def _track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's fixes and the places of their photos in one track."""
    return _world(spark, sf_dir).unionByName(_photo_world(spark, sf_dir))


def frame_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock and position of every frame."""
    segs, keys = _film(spark, sf_dir)
    out = ops.motion(keys, segs, _track(spark, sf_dir), "person")
    return out.select("person", "frame", F.round("tau", 3).alias("tau"), F.round("mx", 9).alias("mx"), F.round("my", 9).alias("my"))


def _camera(segs: DataFrame, moves: DataFrame, dots: list[tuple[str, str]]) -> DataFrame:
    frames = ops.film_frames(segs, "person").join(moves, ["person", "frame"], "left")
    cam = ops.camera(frames, "person", dots, FPS, HOLD + TRANS)
    return cam.select("person", "frame", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), F.round("zoom", 3).alias("zoom"), F.round("visible", 3).alias("visible"))


def film_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The camera that follows each film's dot, on every frame."""
    segs, keys = _film(spark, sf_dir)
    return _camera(segs, ops.motion(keys, segs, _track(spark, sf_dir), "person"), [("mx", "my")])


def joint_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The camera of a film for two, which keeps both dots in view; the second is that of the photos' own track."""
    segs, keys = _film(spark, sf_dir)
    other = ops.motion(keys, segs, _photo_world(spark, sf_dir), "person").select("person", "frame", F.col("mx").alias("nx"), F.col("my").alias("ny"))
    return _camera(segs, ops.motion(keys, segs, _track(spark, sf_dir), "person").join(other, ["person", "frame"], "full"), [("mx", "my"), ("nx", "ny")])


def merge_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a film for two shows one map or two; here clips count as together."""
    modes = _slots(spark, sf_dir).select("person", "slot", (F.col("media") == "video").alias("together"))
    return ops.merge_curve(frame_segments(spark, sf_dir), modes, "person", FPS).select("person", "frame", F.round("merge", 6).alias("merge"))


def film_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each film: photos, clips, years and length in seconds."""
    s = _slots(spark, sf_dir)
    year = F.year(F.timestamp_seconds(F.floor("ts"))).cast("bigint")
    return s.groupBy("person").agg(
        F.count_if(F.col("media") != "video").alias("photos"), F.count_if(F.col("media") == "video").alias("clips"), F.min(year).alias("first_year"), F.max(year).alias("last_year"),
        F.round(INTRO + OUTRO + F.sum("hold") + (F.count("*") - 1) * TRANS, 3).alias("seconds"),
    )


def frame_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every frame of a film shows: the segment that contains it."""
    segs = frame_segments(spark, sf_dir).where("f0 < f1")
    return segs.select("person", F.explode(F.sequence(F.col("f0"), F.col("f1") - 1)).alias("frame"), "kind", "slot")


def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames shared out among eight workers."""
    return ops.chunk_bounds(frame_segments(spark, sf_dir), "person", 8)


def mosaic_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the opening mosaic."""
    return ops.mosaic(_slots(spark, sf_dir).select("person", "photo_id", "ts"), "person", ["ts", "photo_id"], 1920, 1080).select("photo_id", "x", "y", "w", "h")


def contact_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page, row and column of every slot: eight columns, four hundred a page."""
    k = F.col("slot")
    return _slots(spark, sf_dir).select("photo_id", F.floor(k / 400).cast("bigint").alias("page"), F.floor(k % 400 / 8).cast("bigint").alias("row"), (k % 8).cast("bigint").alias("col"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixes(spark, sf_dir).select("person", "fix_id", "t", world_x("lon").alias("mx"), world_y("lat").alias("my"))
    return numbered(f, "person", "t", "fix_id", "n")


_MY = "(1 - ln(tan(radians(least(greatest(lat, -85.0511), 85.0511))) + 1 / cos(radians(least(greatest(lat, -85.0511), 85.0511)))) / pi()) / 2"
_SQL_NUMBERED = f"{SQL_FIX}, num AS (SELECT person, fix_id, t, (lon + 180.0) / 360.0 AS mx, {_MY} AS my, row_number() OVER (PARTITION BY person ORDER BY t, fix_id) AS n FROM fix)"


def _boxes(spark: SparkSession, sf_dir: str, half: int = 25) -> DataFrame:
    over = {n: (lambda w, f=f, c=c: f(c).over(w.rowsBetween(-half, half))) for n, f, c in (("x0", F.min, "mx"), ("y0", F.min, "my"), ("x1", F.max, "mx"), ("y1", F.max, "my"))}
    return windowed(_numbered(spark, sf_dir), "person", "n", half, over).select("person", "n", "fix_id", *over)


def sliding_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding box and zoom of the fixes around each one."""
    b = _boxes(spark, sf_dir)
    return b.select("fix_id", *[F.round(c, 10).alias(c) for c in ("x0", "y0", "x1", "y1")], F.round(zoom_for_bbox("x0", "y0", "x1", "y1", 960, 540, 256), 5).alias("zoom"))


def smooth_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian smoothing over neighbouring fixes, ends repeated."""
    k = ops.kernel(2.0)
    even = {f"s{c}": (lambda w, c=c: ops.evened(c, k, ["person", "__block"], "n")) for c in ("mx", "my")}
    return windowed(_numbered(spark, sf_dir), "person", "n", len(k) // 2, even).select("fix_id", F.round("smx", 9).alias("mx"), F.round("smy", 9).alias("my"))


def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving share of fixes that follow the one before within fifteen minutes, and the last such fix (else the first)."""
    f = with_neighbours(_numbered(spark, sf_dir), "person", "t", "fix_id", ["t", "fix_id"])
    ok = F.coalesce(F.col("t") - F.col("prev.t") <= 900, F.lit(False))
    f = f.withColumn("ok", ok).withColumn("good", F.when(F.col("ok"), F.col("fix_id"))).drop("prev", "next")
    f = with_neighbours(f, "person", "t", "fix_id", ["n"], known=["good"])
    first = f.where("n = 1").select("person", F.col("fix_id").alias("first"))
    f = f.join(first, "person").withColumn("seen_fix", F.coalesce("good", "seen.good", "first"))
    f = windowed(f, "person", "n", 5, {"share": lambda w: F.avg(F.col("ok").cast("double")).over(w.rowsBetween(-5, 5))})
    return f.select("fix_id", F.round("share", 6).alias("share"), F.col("seen_fix").alias("from_fix"))


def trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trail of every fix: how many of the last fifty points, the age of the oldest and the width, cut (not rounded, as
    engines round halves differently) after nine places; at least two points."""
    age = F.least(F.col("n") - 1, F.lit(50))
    last = lambda w: w.rowsBetween(-50, 0)
    f = windowed(_numbered(spark, sf_dir), "person", "n", 50, {"points": lambda w: F.count("*").over(last(w)), "width": lambda w: F.max("mx").over(last(w)) - F.min("mx").over(last(w))})
    return f.where("points >= 2").select("fix_id", "points", F.round(age / 50, 4).alias("oldest"), (F.floor(F.col("width") * 1e9) / 1e9).alias("width"))


def frame_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map tiles that the views of all films need."""
    b = _boxes(spark, sf_dir)
    views = b.select(F.round((F.col("x0") + F.col("x1")) / 2, 5).alias("cx"), F.round((F.col("y0") + F.col("y1")) / 2, 5).alias("cy"), F.floor(zoom_for_bbox("x0", "y0", "x1", "y1", 960, 540, 256)).alias("zoom")).distinct()
    return ops.view_tiles(views, [], 960, 540).distinct()


def best_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best four seconds of each video; samples of sharpness and shake are derived from its id, as pixels are no input."""
    v = photos(spark, sf_dir).where("kind = 'video'").select("photo_id", (2.0 + F.col("photo_id") % 17).alias("duration"))
    s = v.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor(F.col("duration") * 2).cast("int")))).select(
        "photo_id", "duration", (F.col("i") / 2.0).alias("t"), ((F.col("photo_id") * 7 + F.col("i") * 13) % 29 / 29.0).alias("q"), ((F.col("photo_id") * 3 + F.col("i") * 5) % 11 / 100.0).alias("shake")
    )
    return ops.best_window(s, "photo_id", 4.0).select("photo_id", "start", F.round("score", 6).alias("score"))


def prune_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached clips to delete, least recently used first, until a person's rest fits two hundred megabytes; favorites stay.
    Sizes follow from ids, as the table holds none."""
    v = photos(spark, sf_dir).where("kind = 'video'").select("person", "photo_id", "favorite", "ts", ((F.col("photo_id") % 50 + 5) * 1_000_000).alias("bytes"))
    total = v.groupBy("person").agg(F.sum("bytes").alias("total"))
    freed = F.when(F.col("favorite"), 0).otherwise(F.col("bytes"))
    v = running_sum(v, "person", "ts", "photo_id", freed, "freed", bucket=30 * 86_400.0).join(total, "person")
    return v.where(F.col("total") - (F.col("freed") - freed) > 200_000_000).where("NOT favorite").select("photo_id", "bytes")


def scale_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length in metres of the scale bar of each view: the largest 1, 2 or 5 times a power of ten within 22% of its width."""
    b = _boxes(spark, sf_dir)
    zoom = F.round(zoom_for_bbox("x0", "y0", "x1", "y1", 960, 540, 256), 5)
    lat = lat_of((F.col("y0") + F.col("y1")) / 2)
    goal = 40_075_016.686 * F.cos(F.radians(lat)) / (256 * F.pow(F.lit(2.0), zoom)) * 960 * 0.22
    e = F.pow(F.lit(10.0), F.floor(F.log10(goal)))
    return b.select("fix_id", F.round(F.when(5 * e <= goal, 5 * e).when(2 * e <= goal, 2 * e).otherwise(e), 3).alias("metres"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (frame_segments, frame_anchors, frame_motion, film_camera, joint_camera, merge_curve, film_summary, frame_lookup, chunk_bounds, mosaic_layout, contact_sheet, sliding_bbox, smooth_track, visibility, trail, frame_tiles, best_window, prune_cache, scale_bar)
}
_K = ops.kernel(2.0)


def _sql_smooth(c: str) -> str:
    r = len(_K) // 2
    of = lambda k: c if not k else f"coalesce({'lead' if k > 0 else 'lag'}({c}, {abs(k)}) OVER w, {'last' if k > 0 else 'first'}_value({c}) OVER a)"
    return " + ".join(f"{x!r} * {of(i - r)}" for i, x in enumerate(_K))


_ZOOM = "least(greatest(least(log2(960 / 256.0 / greatest((x1 - x0) * 1.35, 1e-9)), log2(540 / 256.0 / greatest((y1 - y0) * 1.35, 1e-9))), 1.0), 14.5)"
_SQL_BOX = _SQL_NUMBERED + ", box AS (SELECT fix_id, min(mx) OVER w AS x0, min(my) OVER w AS y0, max(mx) OVER w AS x1, max(my) OVER w AS y1 FROM num WINDOW w AS (PARTITION BY person ORDER BY n ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING))"
SQL: dict[str, str] = {
    "frame_segments": f"WITH {_SQL_SLOTS} SELECT * FROM seg",
    "frame_anchors": f"""WITH {_SQL_SLOTS}, h AS (SELECT s.person, f0, f1, ts, hold, media FROM seg s JOIN slots USING (person, slot) WHERE kind = 'hold')
      SELECT person, f0 AS frame, ts AS t, true AS video FROM h WHERE media = 'video' UNION ALL SELECT person, greatest(f0, f1 - 1), ts + hold, false FROM h WHERE media = 'video' UNION ALL SELECT person, (f0 + f1) // 2, ts, false FROM h WHERE media <> 'video'""",
    "merge_curve": f"""WITH {_SQL_SLOTS}, f AS (SELECT person, CAST(k AS BIGINT) AS frame, CASE WHEN kind = 'intro' THEN 0 WHEN kind = 'trans' AND k >= (f0 + f1) // 2 THEN slot + 1 ELSE slot END AS slot FROM seg, generate_series(f0, f1 - 1) g(k)),
      o AS (SELECT person, frame, CAST(media = 'video' AS DOUBLE) AS one, row_number() OVER w AS i, count(*) OVER (PARTITION BY person) AS n FROM f JOIN slots USING (person, slot) WINDOW w AS (PARTITION BY person ORDER BY frame)),
      m AS (SELECT person, frame, (sum(one) OVER b + greatest(3 - i, 0) * first_value(one) OVER a + greatest(i + 2 - n, 0) * last_value(one) OVER a) / 5 AS x FROM o WINDOW a AS (PARTITION BY person ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), b AS (PARTITION BY person ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
      SELECT person, frame, round(x * x * (3 - 2 * x), 6) AS merge FROM m""",
    "film_summary": f"WITH {_SQL_SLOTS} SELECT person, count(*) FILTER (media <> 'video') AS photos, count(*) FILTER (media = 'video') AS clips, CAST(min(year(make_timestamp(CAST(floor(ts) * 1000000 AS BIGINT)))) AS BIGINT) AS first_year, CAST(max(year(make_timestamp(CAST(floor(ts) * 1000000 AS BIGINT)))) AS BIGINT) AS last_year, round(CAST({INTRO + OUTRO} + sum(CAST(hold AS DOUBLE)) + (count(*) - 1) * {TRANS} AS DOUBLE), 3) AS seconds FROM slots GROUP BY person",
    "frame_lookup": f"WITH {_SQL_SLOTS} SELECT person, CAST(k AS BIGINT) AS frame, kind, slot FROM seg, generate_series(f0, f1 - 1) g(k)",
    "chunk_bounds": f"""WITH {_SQL_SLOTS}, film AS (SELECT person, max(f1) AS n FROM seg GROUP BY person), goal AS (SELECT person, n, w, floor(n * w / 8) AS goal FROM film, generate_series(1, 7) g(w)),
      near AS (SELECT g.person, g.n, w, arg_min(f0, struct_pack(d := abs(f0 - goal), f := f0)) AS f0 FROM goal g JOIN seg s ON s.person = g.person AND s.kind = 'hold' GROUP BY ALL), cuts AS (SELECT DISTINCT person, n, f0 FROM near UNION SELECT person, n, 0 FROM film)
      SELECT person, row_number() OVER w AS chunk, f0, coalesce(lead(f0) OVER w, n) AS f1 FROM cuts WINDOW w AS (PARTITION BY person ORDER BY f0)""",
    "mosaic_layout": f"""WITH {_SQL_SLOTS}, a AS (SELECT photo_id, slot AS k, count(*) OVER (PARTITION BY person) AS n FROM slots), b AS (SELECT *, CAST(greatest(1, ceil(sqrt(n * 1920 / 1080))) AS BIGINT) AS cols FROM a), c AS (SELECT *, CAST(ceil(n / cols) AS BIGINT) AS rows FROM b),
      d AS (SELECT photo_id, k // cols AS r, k % cols AS c, rows, CASE WHEN k // cols = rows - 1 THEN n - cols * (rows - 1) ELSE cols END AS per FROM c),
      e AS (SELECT photo_id, CAST(round_even(c * 1920 / per, 0) AS BIGINT) AS x, CAST(round_even(r * 1080 / rows, 0) AS BIGINT) AS y, CAST(round_even((c + 1) * 1920 / per, 0) AS BIGINT) AS x2, CAST(round_even((r + 1) * 1080 / rows, 0) AS BIGINT) AS y2 FROM d)
      SELECT photo_id, x, y, x2 - x AS w, y2 - y AS h FROM e""",
    "contact_sheet": f"WITH {_SQL_SLOTS} SELECT photo_id, slot // 400 AS page, (slot % 400) // 8 AS row, slot % 8 AS col FROM slots",
    "sliding_bbox": f"WITH {_SQL_BOX} SELECT fix_id, round(x0, 10) AS x0, round(y0, 10) AS y0, round(x1, 10) AS x1, round(y1, 10) AS y1, round({_ZOOM}, 5) AS zoom FROM box",
    "smooth_track": f"WITH {_SQL_NUMBERED} SELECT fix_id, round({_sql_smooth('mx')}, 9) AS mx, round({_sql_smooth('my')}, 9) AS my FROM num WINDOW w AS (PARTITION BY person ORDER BY n), a AS (PARTITION BY person ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "visibility": f"""WITH {_SQL_NUMBERED}, o AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY person ORDER BY n) <= 900, false) AS ok FROM num)
      SELECT fix_id, round(avg(CAST(ok AS DOUBLE)) OVER (PARTITION BY person ORDER BY n ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS share,
        coalesce(last_value(CASE WHEN ok THEN fix_id END IGNORE NULLS) OVER (PARTITION BY person ORDER BY n ROWS UNBOUNDED PRECEDING), first_value(fix_id) OVER (PARTITION BY person ORDER BY n)) AS from_fix FROM o""",
    "trail": f"""WITH {_SQL_NUMBERED}, x AS (SELECT fix_id, n, count(*) OVER w AS points, round(least(n - 1, 50) / 50, 4) AS oldest, floor((max(mx) OVER w - min(mx) OVER w) * 1e9) / 1e9 AS width FROM num WINDOW w AS (PARTITION BY person ORDER BY n ROWS BETWEEN 50 PRECEDING AND CURRENT ROW))
      SELECT fix_id, points, oldest, width FROM x WHERE points >= 2""",
    "frame_tiles": f"""WITH {_SQL_BOX}, v AS (SELECT DISTINCT round((x0 + x1) / 2, 5) AS cx, round((y0 + y1) / 2, 5) AS cy, CAST(floor({_ZOOM}) AS BIGINT) AS zoom FROM box), l AS (SELECT *, 'base' AS layer, CAST(zoom AS INT) AS z FROM v UNION ALL SELECT *, 'labels', CAST(greatest(zoom - 1, 0) AS INT) FROM v),
      e AS (SELECT layer, z, CAST(floor((cx * 256 * pow(2, z) - 480 / pow(2.0, zoom - z)) / 256) AS BIGINT) AS xa, CAST(floor((cx * 256 * pow(2, z) + 480 / pow(2.0, zoom - z)) / 256) AS BIGINT) AS xb, CAST(floor((cy * 256 * pow(2, z) - 270 / pow(2.0, zoom - z)) / 256) AS BIGINT) AS ya, CAST(floor((cy * 256 * pow(2, z) + 270 / pow(2.0, zoom - z)) / 256) AS BIGINT) AS yb, CAST(pow(2, z) AS BIGINT) AS side FROM l)
      SELECT DISTINCT layer, z, ((x % side) + side) % side AS x, y FROM e, generate_series(xa, xb) gx(x), generate_series(ya, yb) gy(y) WHERE y >= 0 AND y < side""",
    "best_window": f"""WITH {SQL_PHOTO}, v AS (SELECT photo_id, CAST(2 + photo_id % 17 AS DOUBLE) AS duration FROM photo WHERE kind = 'video'), s AS (SELECT photo_id, i / 2.0 AS t, ((photo_id * 7 + i * 13) % 29) / 29.0 AS q, ((photo_id * 3 + i * 5) % 11) / 100.0 AS shake FROM v, generate_series(0, CAST(floor(duration * 2) AS BIGINT)) g(i)),
      m AS (SELECT photo_id, duration, least(4.0, duration) AS size, CASE WHEN duration >= least(4.0, duration) + 2.0 THEN 1.0 ELSE greatest(0.0, (duration - least(4.0, duration)) / 2) END AS margin FROM v),
      st AS (SELECT photo_id, size, i, margin + i * 0.25 AS start FROM m, generate_series(0, CAST(floor((greatest(margin, duration - size - margin) - margin + 1e-6) / 0.25) AS BIGINT)) g(i)),
      h AS (SELECT st.*, q, shake, t >= start AND t <= start + size AS inside, abs(t - (start + size / 2)) AS off FROM st JOIN s USING (photo_id)), h2 AS (SELECT *, min(off) OVER (PARTITION BY photo_id, i) AS near, bool_or(inside) OVER (PARTITION BY photo_id, i) AS has_any FROM h),
      c AS (SELECT photo_id, i, start, avg(q) - 6.0 * avg(greatest(shake - 0.02, 0)) AS score FROM h2 WHERE inside OR (NOT has_any AND off = near) GROUP BY ALL)
      SELECT photo_id, CAST(start AS DOUBLE) AS start, round(score, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY round(score, 9) DESC, start) = 1""",
    "prune_cache": f"""WITH {SQL_PHOTO}, v AS (SELECT person, photo_id, favorite, ts, (photo_id % 50 + 5) * 1000000 AS bytes FROM photo WHERE kind = 'video'),
      x AS (SELECT *, sum(bytes) OVER (PARTITION BY person) AS total, coalesce(sum(CASE WHEN favorite THEN 0 ELSE bytes END) OVER (PARTITION BY person ORDER BY ts, photo_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM v) SELECT photo_id, bytes FROM x WHERE NOT favorite AND total - freed > 200000000""",
    "scale_bar": f"""WITH {_SQL_BOX}, g AS (SELECT fix_id, 40075016.686 * cos(radians(degrees(atan(sinh(pi() * (1 - 2 * ((y0 + y1) / 2))))))) / (256 * pow(2.0, round({_ZOOM}, 5))) * 960 * 0.22 AS goal FROM box), e AS (SELECT *, pow(10.0, floor(log10(goal))) AS e FROM g)
      SELECT fix_id, round(CASE WHEN 5 * e <= goal THEN 5 * e WHEN 2 * e <= goal THEN 2 * e ELSE e END, 3) AS metres FROM e""",
}
