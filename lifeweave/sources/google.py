"""Readers of Google exports: photo sidecars, location histories of all generations, Fit samples.

Each takes rows of (container, name, content) and gives typed rows; a document that isn't of its form gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeweave.functions import scalar
from lifeweave.functions.geo import valid_latlon
from lifeweave.operators.track import FIT, RECORDS, SEMANTIC, TIMELINE
from lifeweave.sources.archives import text_of

SIDECAR_BYTES = 64 * 1024
MAX_FIT_ACC = 500.0
FIX = "t", "lat", "lon", "src", "acc"


def _json(path: str) -> Column:
    return F.get_json_object("j", path)


def latlng(text: Column) -> tuple[Column, Column]:
    """(lat, lon) of a position in any of the exports' forms, given as JSON text or as a string of two numbers."""
    text = F.coalesce(F.get_json_object(text, "$.placeLocation"), text)
    get = lambda k: F.get_json_object(text, f"$.{k}")
    pair = F.coalesce(get("latLng"), get("point"), get("LatLng"), F.when(~text.startswith("{"), text))
    s_lat, s_lon = scalar.parse_latlng(pair)
    num = lambda k, scale: get(k).try_cast("double") / scale
    return F.coalesce(num("latitudeE7", 1e7), num("latE7", 1e7), num("latitude", 1.0), s_lat), F.coalesce(num("longitudeE7", 1e7), num("lngE7", 1e7), num("longitude", 1.0), s_lon)


def _fixes(rows: DataFrame, t: Column, place: Column, src: int, acc: Column | None = None) -> DataFrame:
    lat, lon = latlng(place)
    out = rows.select(t.alias("t"), lat.alias("lat"), lon.alias("lon"), F.lit(src).cast("tinyint").alias("src"), (F.lit(0.0) if acc is None else F.coalesce(acc, F.lit(0.0))).cast("float").alias("acc"))
    return out.where(F.col("t").isNotNull() & valid_latlon("lat", "lon"))


def sidecars(contents: DataFrame) -> DataFrame:
    """Photo sidecars: dir, title, dup, ts, lat, lon, description, favorite, views, origin."""
    j = contents.where((F.length("content") < SIDECAR_BYTES) & F.col("name").endswith(".json")).select("container", "name", text_of().alias("j"))
    j = j.where(_json("$.photoTakenTime").isNotNull())
    geo = [(_json(f"$.{g}.latitude").try_cast("double"), _json(f"$.{g}.longitude").try_cast("double")) for g in ("geoData", "geoDataExif")]
    ok = [valid_latlon(*g) for g in geo]
    pick = lambda i: F.when(ok[0], geo[0][i]).when(ok[1], geo[1][i])
    base = F.regexp_replace(scalar.basename("name"), r"\.json$", "")
    return j.select(
        "container", scalar.dirname("name").alias("dir"), F.coalesce(_json("$.title"), F.lit("")).alias("title"), scalar.copy_number(base).alias("dup"), scalar.parse_time(_json("$.photoTakenTime.timestamp")).alias("ts"), pick(0).alias("lat"), pick(1).alias("lon"),
        F.coalesce(_json("$.description"), F.lit("")).alias("description"), F.coalesce(_json("$.favorited").try_cast("boolean"), F.lit(False)).alias("favorite"), F.coalesce(_json("$.imageViews").try_cast("bigint"), F.lit(0)).alias("views"),
        F.coalesce(scalar.origin_of(_json("$.googlePhotosOrigin")), F.lit("")).alias("origin"),
    )


def record_fixes(members: DataFrame, batch: int = 20_000) -> DataFrame:
    """Fixes of Records.json members (container, kind, name). One such document can hold gigabytes and can't be split, so it
    is read as a stream of its objects, a batch of rows at a time."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for pdf in batches:
            for container, kind, name in zip(pdf["container"], pdf["kind"], pdf["name"]):
                raw = zipfile.ZipFile(container).open(name) if kind == "zip" else open(container if kind == "location" else f"{container}/{name}", "rb")
                held: list[str] = []
                with raw:
                    for text in objects(io.TextIOWrapper(raw, "utf-8", errors="replace"), "locations"):
                        held.append(text)
                        if len(held) >= batch:
                            yield pd.DataFrame({"j": held})
                            held = []
                if held:
                    yield pd.DataFrame({"j": held})

    rows = members.select("container", "kind", "name").repartition("container", "name").mapInPandas(read, "j string")
    t = scalar.parse_time(F.coalesce(_json("$.timestamp"), _json("$.timestampMs")))
    return _fixes(rows, t, F.col("j"), RECORDS, _json("$.accuracy").try_cast("double"))


def objects(stream, key: str, size: int = 1 << 16) -> Iterator[str]:
    """The texts of the objects in the array under ``key`` of a JSON document, read piece by piece."""
    buf, found = "", False
    depth, start, quoted, escaped, at = 0, -1, False, False, 0
    while True:
        piece = stream.read(size)
        if not piece:
            return
        buf += piece
        if not found:
            k = buf.find(f'"{key}"')
            if k < 0:
                buf = buf[-len(key) - 2 :]
                continue
            k = buf.find("[", k)
            if k < 0:
                continue
            found, at = True, k + 1
        while at < len(buf):
            c = buf[at]
            if quoted:
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c == "{":
                if depth == 0:
                    start = at
                depth += 1
            elif c == "}":
                depth -= 1
                if depth == 0:
                    yield buf[start : at + 1]
                    start = -1
            elif c == "]" and depth == 0:
                return
            at += 1
        keep = start if start >= 0 else len(buf)
        buf, at, start = buf[keep:], at - keep, 0 if start >= 0 else -1


def _array(path: str, as_: str = "o") -> Column:
    return F.explode(F.from_json(_json(path), "array<string>")).alias(as_)


def _of(col: str, path: str) -> Column:
    return F.get_json_object(col, path)


def _span(prefix: str) -> tuple[Column, Column]:
    return tuple(scalar.parse_time(F.coalesce(_of("o", f"{prefix}.{e}Timestamp"), _of("o", f"{prefix}.{e}TimestampMs"))) for e in ("start", "end"))  # type: ignore[return-value]


def semantic(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fixes, places) of Semantic Location History: visits give their ends and a place; segments their raw path and, spread
    evenly over their time, their waypoints (so some positions come twice)."""
    o = contents.select(text_of().alias("j")).select(_array("$.timelineObjects"))
    t0, t1 = _span("$.placeVisit.duration")
    visit = o.where(_of("o", "$.placeVisit").isNotNull()).select("o", t0.alias("t0"), t1.alias("t1"), _of("o", "$.placeVisit.location").alias("loc")).where("t0 IS NOT NULL AND t0 <> 0")
    ends = _fixes(visit, F.col("t0"), F.col("loc"), SEMANTIC).unionByName(_fixes(visit, F.col("t1"), F.col("loc"), SEMANTIC))
    lat, lon = latlng(F.col("loc"))
    name = F.coalesce(F.nullif(_of("loc", "$.name"), F.lit("")), F.split(_of("loc", "$.address"), "\n")[0])
    places = visit.select("t0", F.coalesce("t1", "t0").alias("t1"), lat.alias("lat"), lon.alias("lon"), name.alias("name"), F.lit("google_semantic").alias("source")).where("name <> '' AND lat IS NOT NULL")
    s0, s1 = _span("$.activitySegment.duration")
    seg = o.where(_of("o", "$.activitySegment").isNotNull()).select("o", s0.alias("t0"), F.coalesce(s1, s0).alias("t1")).where("t0 IS NOT NULL AND t0 <> 0")
    raw = seg.select(F.explode(F.from_json(_of("o", "$.activitySegment.simplifiedRawPath.points"), "array<string>")).alias("p"))
    raw = _fixes(raw, scalar.parse_time(F.coalesce(_of("p", "$.timestamp"), _of("p", "$.timestampMs"))), F.col("p"), SEMANTIC)
    way = F.concat(F.array(_of("o", "$.activitySegment.startLocation")), F.coalesce(F.from_json(_of("o", "$.activitySegment.waypointPath.waypoints"), "array<string>"), F.array().cast("array<string>")), F.array(_of("o", "$.activitySegment.endLocation")))
    known = F.filter(way, lambda p: p.isNotNull() & latlng(p)[0].isNotNull())
    spread = seg.select("t0", "t1", known.alias("w")).select("t0", "t1", F.size("w").alias("n"), F.posexplode("w").alias("i", "p"))
    spread = _fixes(spread, F.col("t0") + (F.col("t1") - F.col("t0")) * F.col("i") / F.greatest(F.lit(1), F.col("n") - 1), F.col("p"), SEMANTIC)
    return ends.unionByName(raw).unionByName(spread), places


def timeline(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fixes, places) of phone exports: Android's semanticSegments and rawSignals, and the list that iPhones write."""
    j = contents.select(F.trim(text_of()).alias("j"))
    segs = F.when(F.col("j").startswith("["), F.col("j")).otherwise(_json("$.semanticSegments"))
    s = j.select(F.explode(F.from_json(segs, "array<string>")).alias("o")).select("o", scalar.parse_time(_of("o", "$.startTime")).alias("t0"), scalar.parse_time(_of("o", "$.endTime")).alias("t1")).where("t0 IS NOT NULL").withColumn("t1", F.coalesce("t1", "t0"))
    at = lambda path, t: _fixes(s.withColumn("p", _of("o", path)), F.col(t), F.col("p"), TIMELINE)
    visit = "$.visit.topCandidate.placeLocation"
    fixes = at(visit, "t0").unionByName(at(visit, "t1")).unionByName(at("$.activity.start", "t0")).unionByName(at("$.activity.end", "t1"))
    path = s.select("t0", F.explode(F.from_json(_of("o", "$.timelinePath"), "array<string>")).alias("p"))
    when = F.coalesce(scalar.parse_time(_of("p", "$.time")), F.col("t0") + 60 * _of("p", "$.durationMinutesOffsetFromStartTime").try_cast("double"))
    fixes = fixes.unionByName(_fixes(path.withColumn("q", _of("p", "$.point")), when, F.col("q"), TIMELINE))
    raw = j.select(_array("$.rawSignals")).select(_of("o", "$.position").alias("p")).where("p IS NOT NULL")
    fixes = fixes.unionByName(_fixes(raw, scalar.parse_time(_of("p", "$.timestamp")), F.col("p"), TIMELINE, _of("p", "$.accuracyMeters").try_cast("double")))
    kind = _of("o", "$.visit.topCandidate.semanticType")
    v = s.select("t0", "t1", kind.alias("kind"), _of("o", visit).alias("p")).where((F.col("kind") != "") & ~F.upper("kind").isin("UNKNOWN", "SEARCHED_ADDRESS", "ALIASED_LOCATION"))
    lat, lon = latlng(F.col("p"))
    places = v.select("t0", "t1", lat.alias("lat"), lon.alias("lon"), F.initcap(F.translate(F.lower("kind"), "_", " ")).alias("name"), F.lit("google_timeline").alias("source")).where("lat IS NOT NULL")
    return fixes, places


def fit_samples(contents: DataFrame) -> DataFrame:
    """Fixes of Google Fit: nanoseconds; samples worse than MAX_FIT_ACC metres are left out."""
    p = contents.select(text_of().alias("j")).select(F.explode(F.from_json(F.get_json_object("j", "$['Data Points']"), "array<string>")).alias("p"))
    v = lambda i: _of("p", f"$.fitValue[{i}].value.fpVal").try_cast("double")
    rows = p.select((_of("p", "$.startTimeNanos").try_cast("double") / 1e9).alias("t"), v(0).alias("lat"), v(1).alias("lon"), F.lit(FIT).cast("tinyint").alias("src"), v(2).cast("float").alias("acc"))
    return rows.where(F.col("t").isNotNull() & valid_latlon("lat", "lon") & (F.coalesce("acc", F.lit(0.0)) <= MAX_FIT_ACC))


def location_route(head: Column, name: Column) -> Column:
    """Which reader a location file is for, by its name and first bytes: 'records', 'timeline', 'semantic', 'fit', 'track'."""
    text = F.ltrim(head.cast("string"))
    return (
        F.when(name.rlike(r"(^|/)Fit/All data/[^/]*location\.sample[^/]*\.json$"), "fit").when(F.lower(name).rlike(r"\.(gpx|tcx)$"), "track").when(F.substring(text, 1, 200).contains('"locations"'), "records")
        .when(text.contains('"timelineObjects"'), "semantic").when(text.contains('"semanticSegments"') | text.contains('"rawSignals"') | (text.startswith("[") & text.contains('"startTime"')), "timeline")
    )
