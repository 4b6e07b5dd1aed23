"""Queries of selection: events, homes, quotas, candidate pools, diverse picks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lifeweave.functions import media, scalar
from lifeweave.functions.geo import flat_km
from lifeweave.operators.sessions import event_table, event_weight, home_cells, largest_remainder, sessionize
from lifeweave.plans.common import SQL_PHOTO, SQL_SCORE, SQL_SKIP, photos, sql_flat_km
from lifeweave.session import checkpoint
from lifeweave.sources import sinks

CHOSEN, VIDEO_SHARE = 60, 0.15


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their event and score."""
    items = photos(spark, sf_dir).where(~F.col("title").rlike(scalar.SKIP))
    items = items.select("photo_id", "person", "ts", "lat", "lon", "kind", scalar.meta_score().alias("score"))
    return sessionize(items, "person", "ts", "photo_id")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written once: quotas, weights and pools all start from it."""
    return checkpoint(_labelled(spark, sf_dir))


def _events(items: DataFrame) -> DataFrame:
    return event_table(items, "person", "ts")


_SQL_EVENTS = f"""{SQL_PHOTO},
item0 AS (SELECT photo_id, person, uri, ts, lat, lon, kind, favorite, {SQL_SCORE} AS score FROM photo WHERE NOT {SQL_SKIP}),
item1 AS (SELECT *, lag(ts) OVER w AS pt, last_value(lat IGNORE NULLS) OVER b AS pla, last_value(lon IGNORE NULLS) OVER b AS plo FROM item0
  WINDOW w AS (PARTITION BY person ORDER BY ts, photo_id), b AS (PARTITION BY person ORDER BY ts, photo_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
item AS (SELECT photo_id, person, uri, ts, lat, lon, kind, favorite, score,
    CAST(sum(CASE WHEN ts - pt > 14400 OR (lat IS NOT NULL AND {sql_flat_km("lat", "lon", "pla", "plo")} > 30) THEN 1 ELSE 0 END) OVER (PARTITION BY person ORDER BY ts, photo_id ROWS UNBOUNDED PRECEDING) + 1 AS BIGINT) AS event
  FROM item1),
event AS (SELECT person, event, count(*) AS size, min(ts) AS t0, max(ts) AS t1, median(lat) AS lat, median(lon) AS lon, count(*) FILTER (score > 1.5) AS liked FROM item GROUP BY person, event)"""


def sessionize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each person's photos."""
    return _events(_labelled(spark, sf_dir)).select("person", "event", "size", "t0", "t1", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "liked")


def home_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each person takes most photos."""
    return home_cells(_events(_labelled(spark, sf_dir)), "person")


_SQL_HOME = """
cell AS (SELECT person, round_even(lat * 10, 0) AS cy, round_even(lon * 10, 0) AS cx, CAST(sum(size) AS BIGINT) AS items, min(event) AS first FROM event WHERE lat IS NOT NULL GROUP BY ALL),
home AS (SELECT person, cy / 10 AS home_lat, cx / 10 AS home_lon, items FROM cell QUALIFY row_number() OVER (PARTITION BY person ORDER BY items DESC, first) = 1)"""


def _periods(items: DataFrame, period: int = 30) -> DataFrame:
    """Items of each person in periods of so many days, with square-root weights."""
    day = F.floor(F.col("ts") / (86400 * period)).cast("bigint")
    return items.groupBy("person", day.alias("period")).agg(F.count("*").alias("items")).withColumn("weight", F.sqrt("items"))


def _period_quota(items: DataFrame) -> DataFrame:
    p = _periods(items)
    total = F.least(F.lit(CHOSEN), F.sum("items").over(Window.partitionBy("person"))).cast("bigint")
    p = p.withColumn("total", total)
    return largest_remainder(p, ["person"], "weight", "items", "total", "period", "quota").select("person", "period", "items", "quota")


def period_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of CHOSEN items among the periods of each person, by √items and no more than there are."""
    return _period_quota(_labelled(spark, sf_dir))


def sql_remainder(src: str, over: str, weight: str, cap: str, total: str, order: str, name: str) -> str:
    return f"""
{name}_a AS (SELECT *, {total} * {weight} / sum({weight}) OVER (PARTITION BY {over}) AS raw FROM {src}),
{name}_b AS (SELECT *, least(CAST(floor(raw) AS BIGINT), {cap}) AS got, least(CAST(floor(raw) AS BIGINT), {cap}) < {cap} AS open, raw - floor(raw) AS rest FROM {name}_a),
{name}_c AS (SELECT *, row_number() OVER (PARTITION BY {over}, open ORDER BY round(rest, 9) DESC, {order}) AS queue, {total} - sum(got) OVER (PARTITION BY {over}) AS left_over FROM {name}_b),
{name} AS (SELECT * EXCLUDE (raw, got, open, rest, queue, left_over), CAST(got + CASE WHEN open AND queue <= left_over THEN 1 ELSE 0 END AS BIGINT) AS quota FROM {name}_c)"""


_SQL_PERIOD = """
period0 AS (SELECT person, CAST(floor(ts / 2592000) AS BIGINT) AS period, count(*) AS items, sqrt(count(*)) AS weight FROM item GROUP BY ALL),
period1 AS (SELECT *, CAST(least(60, sum(items) OVER (PARTITION BY person)) AS BIGINT) AS total FROM period0),""" + sql_remainder("period1", "person", "weight", "items", "total", "period", "pq")


def period_quota_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with at least one item for every period, taken from the period that has most at that moment."""
    q = period_quota(spark, sf_dir)
    groups = q.groupBy("person").agg(F.array_sort(F.collect_list(F.struct("period", "items", "quota"))).alias("rows"))

    def give(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for person, rows in zip(pdf["person"], pdf["rows"]):
                quota = [r["quota"] for r in rows]
                if CHOSEN >= len(quota):
                    for i, v in enumerate(quota):
                        if v == 0:
                            donor = max(range(len(quota)), key=lambda j: (quota[j], -j))
                            quota[donor] -= 1
                            quota[i] = 1
                out += [(person, r["period"], r["items"], v) for r, v in zip(rows, quota)]
            yield pd.DataFrame(out, columns=["person", "period", "items", "quota"])

    return groups.mapInPandas(give, "person string, period bigint, items bigint, quota bigint")


def _weighted(events: DataFrame) -> DataFrame:
    """Events with their weight and their rank within the period of their start."""
    home = home_cells(events, "person").select("person", "home_lat", "home_lon")
    events = events.join(home, "person", "left")
    far = F.coalesce(flat_km("lat", "lon", "home_lat", "home_lon") > 100, F.lit(False))
    events = events.withColumns({"weight": event_weight(far), "period": F.floor(F.col("t0") / 2592000).cast("bigint")})
    rank = F.row_number().over(Window.partitionBy("person", "period").orderBy(F.desc(F.round("weight", 9)), "event"))
    return events.withColumn("rank", rank.cast("bigint"))


_SQL_WEIGHTED = f"""
weighted0 AS (SELECT e.*, sqrt(size) * (1 + 0.15 * liked) * CASE WHEN {sql_flat_km("lat", "lon", "home_lat", "home_lon")} > 100 THEN 1.8 ELSE 1.0 END AS weight, CAST(floor(t0 / 2592000) AS BIGINT) AS period
  FROM event e LEFT JOIN home USING (person)),
weighted AS (SELECT *, row_number() OVER (PARTITION BY person, period ORDER BY round(weight, 9) DESC, event) AS rank FROM weighted0)"""


def event_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and rank of every event within its period."""
    return _weighted(_events(_items(spark, sf_dir))).select("person", "period", "event", F.round("weight", 6).alias("weight"), "rank")


def _event_quota(items: DataFrame, events: DataFrame | None = None) -> DataFrame:
    quotas = _period_quota(items).select("person", "period", F.col("quota").alias("q")).where("q > 0")
    events = checkpoint(_weighted(_events(items) if events is None else events)).join(quotas, ["person", "period"])
    top = events.where("rank <= q").withColumn("cap", F.greatest(F.lit(1), F.floor(F.col("size") / 3)).cast("bigint"))
    top = largest_remainder(top, ["person", "period"], "weight", "cap", "q", "rank", "quota").select("person", "period", "event", "rank", "quota", "q")
    short = top.groupBy("person", "period").agg(F.max("q").alias("q"), F.sum("quota").alias("given")).where("given < q")
    more = events.drop("q").join(short, ["person", "period"]).where("rank > q AND rank <= q + (q - given)").select("person", "period", "event", "rank", F.lit(1).cast("bigint").alias("quota"))
    return top.where("quota > 0").select("person", "period", "event", "rank", "quota").unionByName(more)


def event_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items to take of each chosen event: the best events of a period share its quota; what caps leave goes to the next ones."""
    return _event_quota(_items(spark, sf_dir))


_SQL_EVENT_QUOTA = (
    """
top0 AS (SELECT w.*, p.quota AS q, CAST(greatest(1, floor(size / 3)) AS BIGINT) AS cap FROM weighted w JOIN pq p USING (person, period) WHERE p.quota > 0 AND rank <= p.quota),"""
    + sql_remainder("top0", "person, period", "weight", "cap", "q", "rank", "tq")
    + """,
short AS (SELECT person, period, max(q) AS q, sum(quota) AS given FROM tq GROUP BY ALL HAVING sum(quota) < max(q)),
eq AS (SELECT person, period, event, rank, quota FROM tq WHERE quota > 0
  UNION ALL SELECT w.person, w.period, w.event, w.rank, CAST(1 AS BIGINT) FROM weighted w JOIN short s USING (person, period) WHERE rank > q AND rank <= q + (q - given))"""
)


def representative_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the events that represent each person's life, period by period, with their places and quotas."""
    items = _items(spark, sf_dir)
    events = checkpoint(_events(items))
    return _event_quota(items, events).join(events, ["person", "event"]).select("person", "period", "event", "quota", "size", "t0", "t1", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the chosen events: best by score, evenly spaced ones, and the two best videos."""
    items = _items(spark, sf_dir)
    items = items.join(_event_quota(items).select("person", "event", F.col("quota").alias("k")), ["person", "event"])
    group = Window.partitionBy("person", "event")
    by_score = group.orderBy(F.desc(F.round("score", 9)), "ts", "photo_id")
    items = items.withColumns({
        "best": F.row_number().over(by_score), "i": F.row_number().over(group.orderBy("ts", "photo_id")) - 1, "n": F.count("*").over(group),
        "video_best": F.row_number().over(Window.partitionBy("person", "event", "kind").orderBy(F.desc(F.round("score", 9)), "ts", "photo_id")),
    })
    m = F.least("n", 4 * F.col("k"))
    # i is one of floor(j (n-1) / (m-1)), j = 0 .. m-1: it is that of the smallest j not below it
    j = F.ceil(F.col("i") * (m - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    even = F.when(m <= 1, F.col("i") == 0).otherwise(F.floor(j * (F.col("n") - 1) / F.greatest(m - 1, F.lit(1))) == F.col("i"))
    return items.where((F.col("best") <= F.col("k")) | even | ((F.col("kind") == "video") & (F.col("video_best") <= 2)))


def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items worth a closer look, of each chosen event."""
    return _pool(spark, sf_dir).select("person", "event", "photo_id")


_SQL_POOL = """
pool0 AS (SELECT i.*, q.quota AS k, row_number() OVER (PARTITION BY i.person, i.event ORDER BY round(score, 9) DESC, ts, photo_id) AS best,
    row_number() OVER (PARTITION BY i.person, i.event ORDER BY ts, photo_id) - 1 AS at, count(*) OVER (PARTITION BY i.person, i.event) AS n,
    row_number() OVER (PARTITION BY i.person, i.event, kind ORDER BY round(score, 9) DESC, ts, photo_id) AS video_best
  FROM item i JOIN eq q ON i.person = q.person AND i.event = q.event),
even AS (SELECT DISTINCT p.person, p.event, CASE WHEN p.m <= 1 THEN 0 ELSE CAST(floor(j * (n - 1) / (p.m - 1)) AS BIGINT) END AS at
  FROM (SELECT DISTINCT person, event, n, least(n, 4 * k) AS m FROM pool0) p, generate_series(0, p.m - 1) g(j))
SELECT p.person, p.event, p.photo_id FROM pool0 p LEFT JOIN even e ON p.person = e.person AND p.event = e.event AND p.at = e.at
WHERE best <= k OR e.at IS NOT NULL OR (kind = 'video' AND video_best <= 2)"""


def candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos that a selection may choose from: no captures, no compositions (every fiftieth record stands for one), in the
    years 2016 to 2024, neither uri nor title on an exclude list, clips only if their share leaves room for any."""
    p = photos(spark, sf_dir).withColumn("origin", F.when(F.col("photo_id") % 50 == 0, "composition").otherwise(F.coalesce("origin", F.lit(""))))
    p = p.where(~F.col("title").rlike(scalar.SKIP) & ~F.col("origin").startswith("composition") & F.col("ts").between(scalar.date_bound("2016"), scalar.date_bound("2024", end=True)))
    entries = photos(spark, sf_dir).where("album = 'Trip'").select(F.explode(F.array("uri", "title")).alias("entry")).where("entry <> ''").distinct()
    p = sinks.without_excluded(p.withColumn("uri", F.coalesce("uri", F.lit(""))), entries)
    return p.where((F.col("kind") == "image") | F.lit(media.max_videos(VIDEO_SHARE, CHOSEN) > 0)).select("photo_id", "kind")


def share_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items a tenth of each person's photos is."""
    return photos(spark, sf_dir).groupBy("person").agg(F.count("*").alias("photos")).select("person", "photos", scalar.share_count(F.lit(0.1), "photos").alias("chosen"))


def video_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips that a film of CHOSEN items may use: of each person's best twice as many by metadata, those that are usable, the
    best up to the ceiling. Sizes and lengths follow from ids, as the table holds none."""
    most = media.max_videos(VIDEO_SHARE, CHOSEN)
    v = photos(spark, sf_dir).where("kind = 'video'").withColumn("score", F.round(scalar.meta_score(), 9))
    v = v.withColumns({"size": (F.col("photo_id") % 13) * 100_000_000, "duration": (F.col("photo_id") % 9) / 2.0})
    order = Window.partitionBy("person").orderBy(F.desc("score"), "ts", "photo_id")
    top = v.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * most).where(media.clip_usable("size", "favorite", "duration"))
    return top.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= most).select("person", "photo_id", "place")


def diverse_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items chosen from each event's pool: best score first, none whose perceptual hash is near that of a chosen one, and,
    while the pool is large, none too near in time. The hash here is one of the time of day and kind, as pixels are no input."""
    bits = F.xxhash64((F.floor(F.col("ts") / 60)).cast("bigint"), "kind")
    pool = _pool(spark, sf_dir).withColumn("hash", bits)
    groups = pool.groupBy("person", "event", "k").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("cost"), "ts", "photo_id", "hash"))).alias("rows"))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for person, event, k, rows in zip(pdf["person"], pdf["event"], pdf["k"], pdf["rows"]):
                span = max(r["ts"] for r in rows) + 1 - min(r["ts"] for r in rows)
                chosen: list = []
                for r in rows:
                    if len(chosen) >= k:
                        break
                    if any(((r["hash"] ^ o["hash"]) & 0xFFFFFFFFFFFFFFFF).bit_count() < 12 for o in chosen):
                        continue
                    if len(rows) > 2 * k and any(abs(r["ts"] - o["ts"]) < span / (3 * k) for o in chosen):
                        continue
                    chosen.append(r)
                out += [(person, event, o["photo_id"]) for o in chosen]
            yield pd.DataFrame(out, columns=["person", "event", "photo_id"])

    return groups.mapInPandas(pick, "person string, event bigint, photo_id bigint")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (representative_events, sessionize_events, home_cell, period_quota, period_quota_filled, event_weights, event_quota, candidate_pool, candidate_filter, share_counts, video_ceiling, diverse_pick)
}
_W = "WITH " + _SQL_EVENTS
SQL: dict[str, str] = {
    "sessionize_events": f"{_W} SELECT person, event, size, t0, t1, round(lat, 6) AS lat, round(lon, 6) AS lon, liked FROM event",
    "home_cell": f"{_W}, {_SQL_HOME} SELECT person, home_lat, home_lon, items FROM home",
    "period_quota": f"{_W}, {_SQL_PERIOD} SELECT person, period, items, quota FROM pq",
    "event_weights": f"{_W}, {_SQL_HOME}, {_SQL_WEIGHTED} SELECT person, period, event, round(weight, 6) AS weight, rank FROM weighted",
    "event_quota": f"{_W}, {_SQL_HOME}, {_SQL_WEIGHTED}, {_SQL_PERIOD}, {_SQL_EVENT_QUOTA} SELECT person, period, event, rank, quota FROM eq",
    "representative_events": f"{_W}, {_SQL_HOME}, {_SQL_WEIGHTED}, {_SQL_PERIOD}, {_SQL_EVENT_QUOTA} SELECT person, q.period, event, q.quota, e.size, e.t0, e.t1, round(e.lat, 6) AS lat, round(e.lon, 6) AS lon FROM eq q JOIN event e USING (person, event)",
    "candidate_filter": f"""WITH {SQL_PHOTO}, x AS (SELECT unnest([uri, title]) AS entry FROM photo WHERE album = 'Trip') SELECT photo_id, kind FROM photo WHERE NOT {SQL_SKIP} AND photo_id % 50 <> 0 AND NOT starts_with(coalesce(origin, ''), 'composition')
      AND ts BETWEEN epoch(TIMESTAMP '2016-01-01') AND epoch(TIMESTAMP '2024-12-31 23:59:59') AND title NOT IN (SELECT entry FROM x WHERE entry <> '') AND coalesce(uri, '') NOT IN (SELECT entry FROM x WHERE entry <> '')""",
    "share_counts": f"WITH {SQL_PHOTO} SELECT person, count(*) AS photos, CAST(greatest(2, round_even(0.1 * count(*), 0)) AS BIGINT) AS chosen FROM photo GROUP BY person",
    "video_ceiling": f"""WITH {SQL_PHOTO}, v AS (SELECT person, photo_id, favorite, ts, round({SQL_SCORE}, 9) AS score FROM photo WHERE kind = 'video'), t AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY score DESC, ts, photo_id) AS rank FROM v),
      u AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY score DESC, ts, photo_id) AS place FROM t WHERE rank <= 18 AND ((photo_id % 13) * 100000000 <= 1073741824 OR favorite) AND (photo_id % 9) / 2.0 >= 2.0) SELECT person, photo_id, place FROM u WHERE place <= 9""",
    "candidate_pool": f"{_W}, {_SQL_HOME}, {_SQL_WEIGHTED}, {_SQL_PERIOD}, {_SQL_EVENT_QUOTA}, {_SQL_POOL}",
}
