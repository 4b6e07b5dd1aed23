"""Queries that compare two tracks: each person's movement track with the track that their photos draw."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lifeweave.functions import media, scalar
from lifeweave.functions.geo import world_x, world_y
from lifeweave.operators import pair, places
from lifeweave.operators.sessions import largest_remainder
from lifeweave.plans.common import SQL_FIX, SQL_PHOTO, fixes, photos, sql_haversine
from lifeweave.plans.selection import diverse_pick, sql_remainder
from lifeweave.plans.tracks import SQL_PLACE, SQL_TOWN, regions, sql_positions
from lifeweave.session import new_folder


def _tracks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = fixes(spark, sf_dir).select("person", "t", world_x("lon").alias("mx"), world_y("lat").alias("my"))
    b = photos(spark, sf_dir).where("lat IS NOT NULL").select("person", F.col("ts").alias("t"), world_x("lon").alias("mx"), world_y("lat").alias("my"))
    return a, b


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair.copresence(*_tracks(spark, sf_dir), "person")


_MY = "(1 - ln(tan(radians(least(greatest(lat, -85.0511), 85.0511))) + 1 / cos(radians(least(greatest(lat, -85.0511), 85.0511)))) / pi()) / 2"
_LAT, _LON = "degrees(atan(sinh(pi() * (1 - 2 * {})))) ", "({} * 360.0 - 180.0)"
_SQL_GRID = f"""{SQL_FIX}, {SQL_PHOTO},
wa AS (SELECT person, t, (lon + 180.0) / 360.0 AS mx, {_MY} AS my FROM fix), wb AS (SELECT person, ts AS t, (lon + 180.0) / 360.0 AS mx, {_MY} AS my FROM photo WHERE lat IS NOT NULL),
span AS (SELECT person, CAST(floor(greatest(a0, b0) / 600) AS BIGINT) AS s0, CAST(ceil(least(a1, b1) / 600) AS BIGINT) AS s1 FROM (SELECT person, min(t) AS a0, max(t) AS a1 FROM wa GROUP BY ALL) JOIN (SELECT person, min(t) AS b0, max(t) AS b1 FROM wb GROUP BY ALL) USING (person)),
steps AS (SELECT person, step, CAST(step * 600 AS DOUBLE) AS t FROM span, generate_series(s0, s1 - 1) g(step)),{sql_positions(True, "steps", "t", "person", "person, step, t", "wa", "pa")},
st2 AS (SELECT person, step, t, x AS ax, y AS ay FROM pa),{sql_positions(True, "st2", "t", "person", "person, step, t, ax, ay", "wb", "pb")},
grid0 AS (SELECT person, step, t, {sql_haversine(_LAT.format("ay"), _LON.format("ax"), _LAT.format("y"), _LON.format("x"))} AS dist, {_LAT.format("ay")} AS lat, {_LON.format("ax")} AS lon FROM pb),
grid AS (SELECT person, step, t, CASE WHEN dist IS NULL THEN 0 WHEN dist <= 500 THEN 2 ELSE 1 END AS state, dist, CASE WHEN dist IS NOT NULL THEN lat END AS lat, CASE WHEN dist IS NOT NULL THEN lon END AS lon FROM grid0),
days AS (SELECT person, CAST(floor(t / 86400) AS BIGINT) AS day, count(*) FILTER (state <> 0) AS known, count(*) FILTER (state = 2) AS together, median(dist) AS dist, median(lat) FILTER (state = 2) AS lat, median(lon) FILTER (state = 2) AS lon FROM grid GROUP BY ALL)"""


def _company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of each person and a companion a hundred metres away, who is three degrees off every other day."""
    f = fixes(spark, sf_dir)
    away = F.floor(F.col("t") / 86_400) % 2 == 1
    b = f.withColumn("lat", F.col("lat") + 0.0009 + F.when(away, F.when(F.col("lat") > 0, -3.0).otherwise(3.0)).otherwise(0.0))
    world = lambda d: d.select("person", "t", world_x("lon").alias("mx"), world_y("lat").alias("my"))
    return pair.copresence(world(f), world(b), "person")


_SQL_COMPANY = _SQL_GRID.replace("FROM photo WHERE lat IS NOT NULL)", "FROM comp)").replace("SELECT person, ts AS t, (lon", "SELECT person, t, (lon").replace("\nwa AS", "\ncomp AS (SELECT person, t, lon, lat + 0.0009 + CASE WHEN CAST(floor(t / 86400) AS BIGINT) % 2 = 1 THEN CASE WHEN lat > 0 THEN -3.0 ELSE 3.0 END ELSE 0.0 END AS lat FROM fix),\nwa AS")


def data_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of each person's data without outliers."""
    times = photos(spark, sf_dir).select("person", F.col("ts").alias("t")).unionByName(fixes(spark, sf_dir).select("person", "t"))
    s = pair.data_span(times, "person", "t")
    return s.select("person", F.round("first", 2).alias("first"), F.round("last", 2).alias("last"))


def copresence_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every step at which it is known."""
    return _grid(spark, sf_dir).where("state <> 0").select("person", "step", "state", F.round("dist", 1).alias("dist"))


def copresence_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps known and together, by day."""
    return pair.daily(_grid(spark, sf_dir), "person").select("person", "day", "known", "together", F.round("dist", 1).alias("dist"))


def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each pair of tracks."""
    return pair.pair_stats(pair.daily(_grid(spark, sf_dir), "person"), "person")


def first_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begin of the first sustained time together."""
    return pair.first_together(pair.daily(_grid(spark, sf_dir), "person"), "person")


def reunions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days together with the companion after more than a day apart (the film's rule is sixty days, more than tracks last)."""
    return pair.reunions(pair.daily(_company(spark, sf_dir), "person"), "person", apart=1)


def company_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each person and their companion."""
    return pair.pair_stats(pair.daily(_company(spark, sf_dir), "person"), "person")


def company_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begin of the first sustained time with the companion."""
    return pair.first_together(pair.daily(_company(spark, sf_dir), "person"), "person")


def countries_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries in which a person and their companion were together for two hours or more; every step counts, none is
    sampled."""
    steps = _company(spark, sf_dir).where(F.col("state") == pair.TOGETHER).select("person", F.monotonically_increasing_id().alias("photo_id"), "lat", "lon")
    return places.countries_visited(steps, "person", regions(spark, sf_dir)).where(F.col("n") * pair.STEP_S >= 7200).groupBy("person").agg(F.count("*").alias("countries"))


def written_copresence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of each person and their companion, written by person and read back."""
    path = new_folder(spark, "copresence")
    g = _company(spark, sf_dir).select("person", "step", "state", F.round("dist", 1).alias("dist"))
    g.repartition("person", F.floor(F.col("step") / 4320)).write.partitionBy("person").parquet(path)
    return spark.read.schema(g.schema).parquet(path).where("state <> 0").select("person", "step", "state", "dist")


def category_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a sixth of each person's photos among those taken together with the companion (which weigh double) and the
    other photos of each side (favorites stand for the second one's), by √count and no more than there are."""
    at = pair.raw_modes(_items(spark, sf_dir), _company(spark, sf_dir), "person")
    kind = F.when(F.col("state") == pair.TOGETHER, "together").when(F.col("favorite"), "second").otherwise("first")
    n = at.groupBy("person", kind.alias("category")).agg(F.count("*").alias("items"))
    whole = F.sum("items").over(Window.partitionBy("person"))
    n = n.withColumns({"weight": F.sqrt("items") * F.when(F.col("category") == "together", 2.0).otherwise(1.0), "total": F.least(whole, scalar.share_count(F.lit(1 / 6), whole)).cast("bigint")})
    return largest_remainder(n, ["person"], "weight", "items", "total", "category", "quota").select("person", "category", "items", "quota")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photos(spark, sf_dir).select("photo_id", "person", "ts", "favorite")


def display_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout mode of each photo, smoothed."""
    return pair.display_modes(_items(spark, sf_dir), _grid(spark, sf_dir), "person")


_SQL_MODES = """
bound AS (SELECT person, min(step) AS low, max(step) AS high FROM grid GROUP BY person),
it AS (SELECT q.photo_id, q.person, q.ts, greatest(low, least(high, CAST(floor(q.ts / 600) AS BIGINT))) AS step FROM photo q JOIN bound USING (person)),
own AS (SELECT i.*, CASE WHEN state = 2 OR (state = 1 AND dist <= 25000) THEN 'together' WHEN state = 1 THEN 'apart' END AS own FROM it i JOIN grid g ON g.person = i.person AND g.step = i.step),
raw AS (SELECT person, photo_id, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY person ORDER BY ts, photo_id ROWS UNBOUNDED PRECEDING), 'apart') AS mode, row_number() OVER (PARTITION BY person ORDER BY ts, photo_id) AS n FROM own),
ahead AS (SELECT *, lead(mode) OVER (PARTITION BY person ORDER BY n) AS nxt FROM raw),
fold AS (SELECT person, n, photo_id, mode FROM ahead WHERE n = 1
  UNION ALL SELECT a.person, a.n, a.photo_id, CASE WHEN a.nxt IS NOT NULL AND f.mode = a.nxt AND a.nxt <> a.mode THEN f.mode ELSE a.mode END FROM fold f JOIN ahead a ON a.person = f.person AND a.n = f.n + 1)
SELECT photo_id, mode FROM fold"""


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen photos of a film for two. The sides are the person's other photos and favorites; shapes follow from ids, as
    the tables hold none."""
    chosen = diverse_pick(spark, sf_dir).select("photo_id")
    items = _items(spark, sf_dir).join(display_modes(spark, sf_dir), "photo_id").join(chosen, "photo_id", "left_semi")
    return items.select("person", "ts", "photo_id", F.col("favorite").cast("int").alias("side"), "mode", F.when(F.col("photo_id") % 3 == 0, 0.75).otherwise(1.5).alias("aspect"))


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of every person's photos fit a row that begins with each, and whether two of a side fit side by side."""
    items = _items(spark, sf_dir).select("person", "ts", "photo_id", F.col("favorite").cast("int").alias("side"), F.when(F.floor(F.col("ts") / 86_400) % 2 == 0, "together").otherwise("apart").alias("mode"), F.when(F.col("photo_id") % 3 == 0, 0.75).when(F.col("photo_id") % 3 == 1, 1.0).otherwise(1.5).alias("aspect"))
    return pair.row_counts(items, "person").select("photo_id", F.col("run").cast("bigint").alias("run"), "row", "pair")


#: Screens of ``pair_screens``.
SCREENS = [(1920, 1080), (1280, 720), (3840, 2160), (1080, 1920), (854, 480)]


def pair_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of the screen for two at several sizes."""
    sizes = spark.createDataFrame(SCREENS, "width int, height int")
    areas = F.explode(F.array(*[F.struct(F.lit(n).alias("area"), media.pair_area(n, "width", "height").alias("r")) for n in media.PAIR_AREAS]))
    return sizes.select("width", "height", areas.alias("a")).select("width", "height", "a.area", "a.r.*")


def spread_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen photos packed into spreads. The selection bounds each person's plan, which is folded in order."""
    return _packed(_shown(spark, sf_dir))


def _packed(shown: DataFrame) -> DataFrame:
    rows = pair.row_counts(shown, "person").groupBy("person").agg(F.array_sort(F.collect_list(F.struct("ts", "photo_id", "side", "mode", "row", "pair"))).alias("rows"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for person, found in zip(pdf["person"], pdf["rows"]):
                out += [(person, *s) for s in pair.spreads([(r["photo_id"], r["side"], r["mode"], r["row"], r["pair"]) for r in found])]
            yield pd.DataFrame(out, columns=["person", "spread", "mode", "side", "photo_id"])

    return rows.mapInPandas(pack, "person string, spread bigint, mode string, side string, photo_id bigint")


def relayout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored plan's items packed anew by the rules as they stand, without selecting again."""
    path = new_folder(spark, "plan")
    _shown(spark, sf_dir).select("person", "ts", "photo_id", "side", "aspect").write.parquet(path)
    kept = spark.read.parquet(path)
    modes = pair.display_modes(kept.select("person", "ts", "photo_id"), _grid(spark, sf_dir), "person")
    return _packed(kept.join(modes, "photo_id"))


def chapter_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos that open a chapter: reunions with the companion after more than a day apart."""
    days = pair.daily(_company(spark, sf_dir), "person")
    marks = pair.reunions(days, "person", apart=1).select("person", (F.col("day") * 86400.0).alias("at"), F.concat(F.lit("Together again, after "), F.col("days").cast("string"), F.lit(" days apart")).alias("mark"), F.col("day").alias("k"))
    slots = _items(spark, sf_dir).select("person", F.struct("ts", "photo_id").alias("slot"), "ts")
    return pair.chapters(slots, marks, "person").where("chapter IS NOT NULL").select("person", F.col("slot.photo_id").alias("photo_id"), "chapter")


def distance_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance strip in 48 columns: share of known steps, share together of the known, median kilometres and height on a
    log scale; columns known for less than a fifth have no data."""
    g = _grid(spark, sf_dir)
    ends = g.groupBy("person").agg(F.min("step").alias("s0"), (F.max("step") + 1).alias("s1"))
    col = F.least(F.floor((F.col("step") - F.col("s0")) * 48 / (F.col("s1") - F.col("s0"))), F.lit(47)).cast("bigint")
    per = g.join(ends, "person").groupBy("person", col.alias("col")).agg(F.count("*").alias("n"), F.count_if(F.col("state") != 0).alias("known"), F.count_if(F.col("state") == 2).alias("tog"), F.median("dist").alias("d"))
    has = F.col("known") / F.col("n") >= 0.2
    km = F.col("d") / 1000
    return per.select("person", "col", F.round(F.col("known") / F.col("n"), 6).alias("known"), F.when(has, F.round(F.col("tog") / F.col("known"), 6)).alias("together"), F.when(has, F.round(F.log10(1 + km) / F.log10(F.lit(20_001.0)), 4)).alias("height"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (data_span, copresence_grid, copresence_daily, pair_stats, company_stats, company_first, first_together, reunions, countries_together, written_copresence, category_quota, display_modes, pair_screens, row_counts, spread_packing, relayout, chapter_marks, distance_strip)
}
_W = f"WITH {_SQL_GRID}"


def _sql_score(aspects: list[str], w: int, h: int, gap: int) -> str:
    n, total = len(aspects), " + ".join(aspects)
    tall = f"least({h}.0, ({w} - {gap * (n - 1)}) / greatest({total}, 1e-6))"
    return f"(({' + '.join(f'round_even({a} * {tall}, 0)' for a in aspects)}) * round_even({tall}, 0) / {w * h} + {0.08 * n!r})"


#: Areas of photos at 1920 by 1080: width together, width of a side, height.
_ROW, _SIDE, _TALL, _GAP = 1872, 929, 601, 14
_C = f"WITH {_SQL_COMPANY}"
_STATS = f"""{{grid}}, s AS (SELECT person, day, lat, lon, day - lag(day) OVER w AS gap, {sql_haversine("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} AS leg FROM days WHERE together >= 6 WINDOW w AS (PARTITION BY person ORDER BY day)),
      t AS (SELECT person, count(*) AS days_together, CAST(greatest(coalesce(max(gap) - 1, 0), 0) AS BIGINT) AS longest_apart, CAST(round_even(coalesce(sum(leg) FILTER (gap = 1), 0) / 1000, 0) AS BIGINT) AS km_together FROM s GROUP BY person),
      a AS (SELECT person, count(*) FILTER (known >= 12) AS days_both, CAST(round_even(coalesce(max(dist) FILTER (known >= 6), 0) / 1000, 0) AS BIGINT) AS furthest_km FROM days GROUP BY person)
      SELECT person, days_both, furthest_km, coalesce(days_together, 0) AS days_together, coalesce(longest_apart, 0) AS longest_apart, coalesce(km_together, 0) AS km_together FROM a LEFT JOIN t USING (person)"""
_REUNION = "tg AS (SELECT person, day, day - lag(day) OVER (PARTITION BY person ORDER BY day) AS days FROM days WHERE together >= 6), re AS (SELECT * FROM tg WHERE days > 1)"
SQL: dict[str, str] = {
    "data_span": f"WITH {SQL_FIX}, {SQL_PHOTO}, u AS (SELECT person, t FROM fix UNION ALL SELECT person, ts FROM photo) SELECT person, round(quantile_cont(t, 0.005), 2) AS first, round(quantile_cont(t, 0.995), 2) AS last FROM u GROUP BY person",
    "copresence_grid": f"{_W} SELECT person, step, state, round(dist, 1) AS dist FROM grid WHERE state <> 0",
    "copresence_daily": f"{_W} SELECT person, day, known, together, round(dist, 1) AS dist FROM days",
    "pair_stats": _STATS.format(grid=_W),
    "first_together": f"{_W}, g AS (SELECT person, day, count(*) OVER (PARTITION BY person ORDER BY day RANGE BETWEEN CURRENT ROW AND 29 FOLLOWING) AS n FROM days WHERE together >= 12) SELECT person, min(day) AS day FROM g WHERE n >= 3 GROUP BY person",
    "company_stats": _STATS.format(grid=f"WITH {_SQL_COMPANY}"),
    "company_first": f"{_C}, g AS (SELECT person, day, count(*) OVER (PARTITION BY person ORDER BY day RANGE BETWEEN CURRENT ROW AND 29 FOLLOWING) AS n FROM days WHERE together >= 12) SELECT person, min(day) AS day FROM g WHERE n >= 3 GROUP BY person",
    "countries_together": f"""{_C}, {SQL_PLACE}, s AS (SELECT row_number() OVER () AS photo_id, person, lat, lon FROM grid WHERE state = 2), {SQL_TOWN.replace("FROM photo p JOIN town", "FROM s p JOIN town")},
      v AS (SELECT person, floor(t.tlat / 30) AS a, floor(t.tlon / 30) AS b, count(*) AS n FROM near JOIN s USING (photo_id) JOIN town t ON t.town = m.town AND t.tlat = m.tlat GROUP BY ALL) SELECT person, count(*) AS countries FROM v WHERE n * 600 >= 7200 GROUP BY person""",
    "written_copresence": f"{_C} SELECT person, step, state, round(dist, 1) AS dist FROM grid WHERE state <> 0",
    "category_quota": f"""{_C}, bound AS (SELECT person, min(step) AS low, max(step) AS high FROM grid GROUP BY person), it AS (SELECT q.person, q.favorite, greatest(low, least(high, CAST(floor(q.ts / 600) AS BIGINT))) AS step FROM photo q JOIN bound USING (person)),
      cat AS (SELECT i.person, CASE WHEN state = 2 THEN 'together' WHEN favorite THEN 'second' ELSE 'first' END AS category, count(*) AS items FROM it i JOIN grid g ON g.person = i.person AND g.step = i.step GROUP BY ALL),
      cq0 AS (SELECT *, sqrt(items) * CASE WHEN category = 'together' THEN 2.0 ELSE 1.0 END AS weight, CAST(least(sum(items) OVER (PARTITION BY person), greatest(2, round_even(sum(items) OVER (PARTITION BY person) / 6, 0))) AS BIGINT) AS total FROM cat),{sql_remainder("cq0", "person", "weight", "items", "total", "category", "cq")} SELECT person, category, items, quota FROM cq""",
    "reunions": f"{_C}, {_REUNION} SELECT person, day, days FROM re",
    "pair_screens": f"""WITH s AS (SELECT *, CAST(floor(24 * (height / 1080)) AS INT) AS m, CAST(floor(14 * (height / 1080)) AS INT) AS g, CAST(floor(46 * (height / 1080)) AS INT) AS strip, CAST(floor(floor(height * 0.36) / 2) AS INT) * 2 AS band FROM (VALUES {", ".join(map(str, SCREENS))}) v(width, height)),
      d AS (SELECT *, (width - 2 * m - g) // 2 AS half, height - strip - band - g // 2 AS top FROM s), r AS (SELECT *, 'photos' AS kind, m AS y, top - g - m AS h FROM d UNION ALL SELECT *, 'maps', top, band FROM d)
      SELECT width, height, kind || '_' || place AS area, CASE WHEN place = 'right' THEN width - m - half ELSE m END AS x, y, CASE WHEN place = 'together' THEN width - 2 * m ELSE half END AS w, h FROM r, (VALUES ('together'), ('left'), ('right')) p(place)""",
    "row_counts": f"""WITH {SQL_PHOTO}, i AS (SELECT person, ts, photo_id, CAST(favorite AS INT) AS side, CASE WHEN CAST(floor(ts / 86400) AS BIGINT) % 2 = 0 THEN 'together' ELSE 'apart' END AS mode, CASE photo_id % 3 WHEN 0 THEN 0.75 WHEN 1 THEN 1.0 ELSE 1.5 END::DOUBLE AS a FROM photo),
      c AS (SELECT *, CASE WHEN mode = lag(mode) OVER w THEN 0 ELSE 1 END AS fresh FROM i WINDOW w AS (PARTITION BY person ORDER BY ts, photo_id)), r AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY person ORDER BY ts, photo_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM c),
      n AS (SELECT *, lead(a) OVER w AS b, lead(a, 2) OVER w AS c, lead(a) OVER (PARTITION BY person, run, side ORDER BY ts, photo_id) AS s FROM r WINDOW w AS (PARTITION BY person, run ORDER BY ts, photo_id)),
      e AS (SELECT *, {_sql_score(["a"], _ROW, _TALL, _GAP)} AS one, {_sql_score(["a", "b"], _ROW, _TALL, _GAP)} AS two, {_sql_score(["a", "b", "c"], _ROW, _TALL, _GAP)} AS three, {_sql_score(["a"], _SIDE, _TALL, _GAP)} AS alone, {_sql_score(["a", "s"], _SIDE, _TALL, _GAP)} AS side_by_side FROM n)
      SELECT photo_id, run, CASE WHEN two > one AND three > two AND three > one AND c IS NOT NULL THEN 3 WHEN two > one AND b IS NOT NULL THEN 2 ELSE 1 END AS row, s IS NOT NULL AND side_by_side > alone AS pair FROM e""",
    "display_modes": f"{_W.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_SQL_MODES}",
    "chapter_marks": f"""{_C}, {_REUNION}, cl AS (SELECT r.person, r.day, r.days, arg_min(p.photo_id, struct_pack(a := p.ts, b := p.photo_id)) AS photo_id FROM re r JOIN photo p ON p.person = r.person AND p.ts >= r.day * 86400.0 - 86400 GROUP BY ALL)
      SELECT person, photo_id, 'Together again, after ' || arg_min(days, day) || ' days apart' AS chapter FROM cl GROUP BY person, photo_id""",
    "distance_strip": f"""{_W}, e AS (SELECT person, min(step) AS s0, max(step) + 1 AS s1 FROM grid GROUP BY person),
      c AS (SELECT g.person, CAST(least(floor((step - s0) * 48 / (s1 - s0)), 47) AS BIGINT) AS col, count(*) AS n, count(*) FILTER (state <> 0) AS known, count(*) FILTER (state = 2) AS tog, median(dist) AS d FROM grid g JOIN e USING (person) GROUP BY ALL)
      SELECT person, col, round(known / n, 6) AS known, CASE WHEN known / n >= 0.2 THEN round(tog / known, 6) END AS together, CASE WHEN known / n >= 0.2 THEN round(log10(1 + d / 1000) / log10(20001.0), 4) END AS height FROM c""",
}
