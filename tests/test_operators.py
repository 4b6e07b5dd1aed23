"""Boundary rows of the timeline operators, by hand, and as-of joins against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lifeweave.functions import geo, scalar
from lifeweave.operators import adjacent, asof, frames, library, pair, places, sessions, track


def test_scalars(spark):
    rows = [("100000000000",), ("1556701200000",), ("1556701200",), ("2019-05-01T09:00:00Z",), ("2019-05-01T11:00:00+02:00",), ("2019-05-01T09:00:00",), ("Wed May 01 09:00:00 +0000 2019",), ("2019:05:01 09:00:00",), ("1 May 2019, 09:00:00 UTC",), ("nope",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(scalar.parse_time("v")).collect()]
    assert got == [100000000000.0] + [1556701200.0] * 8 + [None] * 3
    texts = [("CafÃ©",), ("Café",), ("plain",), (None,), ("Ã",), ("日",)]
    assert [r[0] for r in spark.createDataFrame(texts, "v string").select(scalar.fix_mojibake("v")).collect()] == ["Café", "Café", "plain", None, "Ã", "日"]
    names = [("IMG_20230513_165021.jpg",), ("2023-05-13 16.50.21.jpg",), ("IMG_20231313_165021.jpg",), ("x.jpg",), ("PXL_20230513_165021123.jpg",)]
    assert [r[0] for r in spark.createDataFrame(names, "v string").select(scalar.time_from_filename("v")).collect()] == [1683996621.0, 1683996621.0, None, None, None]
    kinds = spark.createDataFrame([("a.JPG",), ("b.mov",), ("c.txt",), ("d",)], "v string").select(scalar.media_kind("v")).collect()
    assert [r[0] for r in kinds] == ["image", "video", None, None]
    one = spark.range(1)
    assert one.select(scalar.degrees_of(F.lit(12.0), F.lit(30.0), F.lit(36.0), F.lit("S"))).first()[0] == -12.51
    assert one.select(scalar.plural(F.lit(1821), "day"), scalar.plural(F.lit(1), "day"), scalar.span_text(F.lit(2017), F.lit(2025))).first()[:] == ("1,821 days", "1 day", "2017 — 2025")
    assert one.select(scalar.origin_of(F.lit('{"mobileUpload": {"deviceType": "X"}}')), scalar.origin_of(F.lit('{"picasa": {}}'))).first()[:] == ("mobileUpload:X", "picasa")
    assert one.select(scalar.hamming(F.lit(-1), F.lit(0)), geo.smoothstep(F.lit(0.5)), geo.valid_latlon(F.lit(0.0), F.lit(0.0)), geo.valid_latlon(F.lit(91.0), F.lit(0.0))).first()[:] == (64, 0.5, False, False)
    lat, lon = scalar.parse_latlng(F.lit("geo:12.5,-8.25"))
    assert one.select(lat, lon).first()[:] == (12.5, -8.25)


def test_options():
    assert scalar.date_bound("2019", end=True) == 1577836799 and scalar.date_bound("2019-12", end=True) == 1577836799 and scalar.date_bound("2019-02-28") == 1551312000
    assert scalar.share_option("15%") == 0.15 and scalar.count_option("150") == 150 and scalar.count_option("0.3%") == pytest.approx(0.003)
    for bad in (lambda: scalar.share_option("150%"), lambda: scalar.count_option("1"), lambda: scalar.count_option("0%"), lambda: scalar.date_bound("x")):
        with pytest.raises(ValueError):
            bad()


def test_sessions(spark):
    h = 14_400.0
    items = [("a", 1, 0.0, 1.0, 1.0), ("a", 2, h, 1.0, 1.0), ("a", 3, 2 * h + 1, None, None), ("a", 4, 2 * h + 2, 1.0, 1.26), ("a", 5, 2 * h + 3, None, None), ("a", 6, 2 * h + 4, 1.0, 1.55)]
    rows = sessions.sessionize(spark.createDataFrame(items, "person string, id int, ts double, lat double, lon double"), "person", "ts", "id").collect()
    assert [r["event"] for r in sorted(rows, key=lambda r: r["id"])] == [1, 1, 2, 2, 2, 3]


def test_largest_remainder(spark):
    g = spark.createDataFrame([("a", 1, 5.0, 1), ("a", 2, 3.0, 9), ("a", 3, 2.0, 9), ("b", 1, 1.0, 5)], "k string, o int, w double, cap int")
    got = {(r["k"], r["o"]): r["q"] for r in sessions.largest_remainder(g, ["k"], "w", "cap", F.lit(9), "o", "q").collect()}
    assert got == {("a", 1): 1, ("a", 2): 3, ("a", 3): 2, ("b", 1): 5}  # caps bind: six of nine are given out, and no more


def test_teleports_and_thinning(spark):
    f = lambda rows: spark.createDataFrame([(i, "a", *r) for i, r in enumerate(rows)], "fix_id long, person string, t double, lat double, lon double, src int")
    spikes = f([(0.0, 0.0, 10.0, 0), (60.0, 0.0, 10.0, 0), (120.0, 5.0, 10.0, 0), (180.0, -5.0, 10.0, 0), (240.0, 0.0, 10.0, 0), (300.0, 0.0, 10.0, 0)])
    assert sorted(r["fix_id"] for r in track.drop_teleports(spikes).collect()) == [0, 1, 4, 5]
    assert track.drop_teleports(f([(0.0, 0.0, 1.0, 0), (1.0, 50.0, 1.0, 0)])).count() == 2
    step = 30.0 / 111_000.0
    rows = [(0.0, 0.0, 10.0, 0), (10.0, step * 0.999, 10.0, 0), (20.0, step * 1.001, 10.0, 0), (30.0, step * 1.001, 10.0, 3), (1230.0, step * 1.001, 10.0, 0), (1231.0, step * 1.001, 10.0, 0), (1240.0, step * 1.001, 10.0, 0)]
    assert sorted(r["fix_id"] for r in track.thin(f(rows)).collect()) == [0, 2, 3, 5, 6]
    assert track.thin(f(rows).limit(0)).collect() == []


def test_neighbours_against_brute_force(spark):
    r = random.Random(2)
    points = [(r.choice("ab"), float(r.randint(0, 40)) * 20_000, i) for i in range(60)]
    asked = [(i, r.choice(["a", "b", "c", None]), r.choice([None, float(r.randint(0, 80)) * 10_000])) for i in range(80)]
    q, p = spark.createDataFrame(asked, "i int, k string, at double"), spark.createDataFrame(points, "k string, t double, v long")
    for inclusive in (False, True):
        for row in asof.neighbours(q, p, "k", "at", "t", ["v"], at_is_next=inclusive).collect():
            mine = [(t, v) for k, t, v in points if k == row["k"]]
            before = [x for x in mine if row["at"] is not None and (x[0] < row["at"] if inclusive else x[0] <= row["at"])]
            after = [x for x in mine if row["at"] is not None and (x[0] >= row["at"] if inclusive else x[0] > row["at"])]
            assert (row["prev"] and tuple(row["prev"])) == (max(before) if before else None), row
            assert (row["next"] and tuple(row["next"])) == (min(after) if after else None), row


def test_gap_aware_position(spark):
    h = 3600.0
    t = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("a", 6 * h, 0.6, 0.0), ("a", 100 * h, 0.7, 0.0)], "k string, t double, mx double, my double")
    ask = [3 * h, 6 * h, 10 * h, 50 * h, 60 * h, 97 * h, 100 * h, 147 * h, 149 * h, -47 * h, -49 * h]
    q = spark.createDataFrame([("a", float(x)) for x in ask], "k string, at double")
    got = {}
    for strict in (False, True):
        near = asof.neighbours(q, t, "k", "at", "t", ["mx", "my"])
        x, _ = asof.position_at("prev", "next", "at", "t", "mx", "my", strict)
        got[strict] = {r["at"]: r["x"] for r in near.select("at", x.alias("x")).collect()}
    assert [got[False][float(a)] for a in ask] == [0.3, 0.6, 0.6, 0.6, 0.7, 0.7, 0.7, 0.7, None, 0.0, None]
    assert [got[True][float(a)] for a in ask] == [0.3, 0.6, 0.6, None, None, 0.7, 0.7, 0.7, None, 0.0, None]


def test_posted_copies(spark):
    cols = "photo_id long, person string, kind string, ts double, source string, ts_origin string, shared boolean, description string, lat double, lon double"
    p = [(1, "a", "image", 100.0, "google", "sidecar", False, "", None, None), (2, "a", "image", 102.0, "x", "exif", True, "said", 1.0, 2.0), (3, "a", "image", 98.0, "x", "exif", True, "out", None, None), (4, "a", "video", 100.0, "x", "exif", True, "v", None, None), (5, "a", "image", 100.0, "x", "post", True, "p", None, None)]
    out = {r["photo_id"]: r for r in library.fold_posted_copies(spark.createDataFrame(p, cols)).collect()}
    # an original two seconds before a copy is in its window, one two seconds after it isn't
    assert set(out) == {1, 3, 4, 5} and (out[1]["copies"], out[1]["shared"], out[1]["description"], out[1]["lat"]) == (1, True, "said", 1.0)


def test_places(spark):
    cols = "place_id long, person string, t0 double, t1 double, lat double, lon double, name string, source string"
    pl = [(1, "a", 100_000.0, 103_600.0, 1.0, 1.0, "early", "g"), (2, "a", 101_000.0, 103_600.0, 1.0, 1.0, "Inferred Home", "g"), (3, "a", 102_000.0, 103_000.0, 1.5, 1.5, "far", "g"), (4, "a", 0.0, 200_000.0, 1.0, 1.0, "old", "g"), (5, "a", 101_500.0, None, 1.0, 1.0, "", "g")]
    items = spark.createDataFrame([(1, "a", 105_400.0, 1.0, 1.0), (2, "a", 105_401.0, 1.0, 1.0), (3, "a", 98_200.0, 1.0, 1.0), (4, "a", 102_500.0, None, None)], "photo_id long, person string, ts double, lat double, lon double")
    got = {r["photo_id"]: r["name"] for r in places.items_in_places(items, places.places(spark.createDataFrame(pl, cols))).collect()}
    assert got == {1: "Home", 3: "early", 4: "far"}


def test_nearest_towns_against_brute_force(spark):
    r = random.Random(8)
    towns = [(f"t{i}", r.uniform(-85, 85), r.uniform(-180, 180)) for i in range(400)] + [("east", 10.0, 179.9), ("north", 84.9, 0.0)]
    items = [(i, r.uniform(-80, 80), r.uniform(-180, 180)) for i in range(300)] + [(1000, 10.0, -179.95), (1001, 84.8, 3.0)]
    got = {x["photo_id"]: (x["town"], x["km"]) for x in places.nearest_towns(spark.createDataFrame(items, "photo_id long, lat double, lon double"), spark.createDataFrame(towns, "town string, tlat double, tlon double"), 200.0).collect()}
    import math

    def km(a, o, b, p):
        h = math.sin(math.radians(b - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(b)) * math.sin(math.radians(p - o) / 2) ** 2
        return 12742 * math.asin(math.sqrt(min(1, h)))

    for i, a, o in items:
        best = min((km(a, o, b, p), n) for n, b, p in towns)
        assert got.get(i, (None,))[0] == (best[1] if best[0] <= 200 else None), i
    assert got[1000][0] == "east" and got[1001][0] == "north"


def test_sidecars(spark):
    media = spark.createDataFrame([(1, "a", "d", "IMG.jpg"), (2, "a", "d", "IMG-edited.jpg"), (3, "a", "d", "IMG(1).jpg"), (4, "a", "d", "A_very_long_na.jpg"), (5, "a", "e", "IMG.jpg"), (6, "a", "d", "Amb.jpg")], "media_id long, person string, dir string, name string")
    side = spark.createDataFrame([(10, "a", "d", "IMG.jpg", 0), (11, "a", "d", "img.JPG", 0), (12, "a", "d", "IMG.jpg", 1), (13, "a", "d", "A_very_long_name_indeed.jpg", 0), (14, "a", "d", "Amb1.jpg", 0), (15, "a", "d", "Amb2.jpg", 0)], "sidecar_id long, person string, dir string, title string, dup int")
    got = {r["media_id"]: (r["sidecar_id"], r["found"]) for r in library.pair_sidecars(media, side, ["person"]).collect()}
    assert got == {1: (11, "same"), 2: (11, "same"), 3: (12, "same"), 4: (13, "prefix"), 5: (None, None), 6: (None, None)}


def test_modes_layout_and_spreads():
    assert pair.smooth(list("abaab")) == list("aaaab") and pair.smooth(list("ababa")) == list("aaaaa") and pair.smooth(["a"]) == ["a"]
    out = pair.spreads([(1, 0, "apart", 1, True), (2, 0, "apart", 1, True), (3, 1, "apart", 1, False), (4, 0, "apart", 1, False), (5, 1, "together", 1, False)])
    assert out == [(0, "apart", "left", 1), (0, "apart", "left", 2), (0, "apart", "right", 3), (1, "apart", "left", 4), (1, "apart", "right again", 3), (2, "together", "row", 5)]
    rows = [(i, 0, "together", k, False) for i, k in enumerate((3, 1, 1, 2, 2, 1, 1))]
    assert [n for n, *_ in pair.spreads(rows)] == [0, 0, 0, 1, 1, 2, 3] and pair.spreads([]) == []


def test_rows_that_fit(spark):
    data = [("a", float(i), i, 0, "together" if i < 5 else "apart", a) for i, a in enumerate([0.75, 0.75, 0.75, 3.0, 3.0, 0.75, 0.75, 1.5, 3.0])]
    got = {x["photo_id"]: x for x in pair.row_counts(spark.createDataFrame(data, "k string, ts double, photo_id long, side int, mode string, aspect double"), "k").collect()}
    assert [got[i]["row"] for i in range(5)] == [3, 3, 2, 1, 1] and [got[i]["pair"] for i in range(5, 9)] == [True, True, False, False]


def test_first_together_and_reunions(spark):
    days = spark.createDataFrame([("a", d, 20, n, 1.0, 1.0, 1.0) for d, n in ((0, 12), (40, 12), (50, 12), (69, 12), (200, 6))], "k string, day long, known long, together long, dist double, lat double, lon double")
    assert pair.first_together(days, "k").collect()[0]["day"] == 40
    assert [(r["day"], r["days"]) for r in pair.reunions(days, "k").collect()] == [(200, 131)]
    s = pair.pair_stats(days, "k").collect()[0]
    assert (s["days_both"], s["days_together"], s["longest_apart"]) == (5, 5, 130)


def test_motion(spark):
    segs = spark.createDataFrame([("a", "intro", -1, 0, 5), ("a", "hold", 0, 5, 15), ("a", "trans", 0, 15, 35), ("a", "hold", 1, 35, 45), ("a", "outro", 1, 45, 50), ("b", "hold", 0, 0, 4)], "k string, kind string, slot long, f0 long, f1 long")
    keys = spark.createDataFrame([("a", 10, 0.0, False), ("a", 20, 3600.0, True), ("a", 30, 7200.0, False), ("a", 40, 4e6, False), ("b", 2, 9e9, False)], "k string, frame long, t double, video boolean")
    track = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("a", 900.0, 0.3, 0.0), ("a", 1800.0, 0.3, 0.1), ("a", 3600.0, 0.4, 0.1), ("a", 5400.0, 0.5, 0.2), ("a", 7200.0, 0.7, 0.2)], "k string, t double, mx double, my double")
    got = {(x["k"], x["frame"]): x for x in frames.motion(keys, segs, track, "k").collect()}
    assert sorted(got) == [("a", f) for f in range(50)] + [("b", f) for f in range(4)]
    a = [got[("a", f)] for f in range(50)]
    assert all((x["tau"], x["mx"], x["my"]) == (0.0, 0.0, 0.0) for x in a[:11]) and all(x["tau"] == 4e6 and x["mx"] is None for x in a[40:])
    # eased along 0.3 + 0.1 + 0.1 of the way
    for f in range(10, 20):
        u = (f - 10) / 10
        way = u * u * (3 - 2 * u) * 0.5
        x, y = (way, 0.0) if way <= 0.3 else (0.3, way - 0.3) if way <= 0.4 else (way - 0.1, 0.1)
        t = way / 0.3 * 900 if way <= 0.3 else 900 + (way - 0.3) / 0.1 * 900 if way <= 0.4 else 1800 + (way - 0.4) / 0.1 * 1800
        assert (a[f]["mx"], a[f]["my"], a[f]["tau"]) == (pytest.approx(x), pytest.approx(y), pytest.approx(t))
    # in the clip real time, and the dot where the track has it
    assert [x["tau"] for x in a[20:30]] == [pytest.approx(3600 + 360 * i) for i in range(10)] and a[25]["mx"] == pytest.approx(0.5) and a[22]["mx"] == pytest.approx(0.44)
    # the next place is unknown: half of the frames at the last one
    assert all(x["mx"] == pytest.approx(0.7) for x in a[30:35]) and all(x["mx"] is None for x in a[35:])
    assert all(got[("b", f)]["mx"] is None for f in range(4)) and frames.motion(keys.limit(0), segs, track, "k").collect() == []
    k = frames.kernel(2.0)
    assert len(k) == 13 and sum(k) == pytest.approx(1)


def test_neighbours_across_buckets(spark):
    r = random.Random(9)
    rows = [(r.choice("aaab"), float(t), i, r.choice([None, 1.0 * i])) for i, t in enumerate(r.sample(range(1000), 150))]
    df = spark.createDataFrame(rows, "k string, t double, id long, v double").withColumn("w", F.col("v"))
    got = {x["id"]: x for x in adjacent.with_neighbours(df, "k", "t", "id", ["id"], known=["v", "w"], bucket=40.0).collect()}
    sums = {x["id"]: x["n"] for x in adjacent.running_sum(df, "k", "t", "id", F.lit(1), "n", bucket=40.0).collect()}
    for k in "ab":
        mine = sorted((t, i, v) for q, t, i, v in rows if q == k)
        for n, (_, i, _) in enumerate(mine):
            x = got[i]
            assert (x["prev"] and x["prev"]["id"]) == (mine[n - 1][1] if n else None)
            assert (x["next"] and x["next"]["id"]) == (mine[n + 1][1] if n + 1 < len(mine) else None)
            known = [v for _, _, v in mine[:n] if v is not None]
            assert (x["seen"] and x["seen"]["v"]) == (known[-1] if known else None) and sums[i] == n + 1
    assert adjacent.with_neighbours(df.limit(0), "k", "t", "id", ["id"]).collect() == []


def test_media_functions(spark):
    import numpy as np

    from lifeweave.functions import media

    one = spark.range(1)
    text = "Duration: 00:01:02.50, start\n  Stream #0:0: Video: hevc, yuv420p10le(bt2020nc/bt2020/arib-std-b67), 1920x1080, 30 fps\n  displaymatrix: rotation of -90.00 degrees"
    assert tuple(one.select(media.probe(F.lit(text)).alias("p")).first()["p"]) == (62.5, 1080, 1920, True)
    assert one.select(media.probe(F.lit("nothing")).alias("p")).first()["p"] is None
    plain = media.picture_score(F.lit(400.0), F.lit(118.0), F.lit(60.0), F.lit(50.0), F.lit(0.1), F.lit(4), F.lit(3))
    paper = media.picture_score(F.lit(400.0), F.lit(118.0), F.lit(60.0), F.lit(20.0), F.lit(0.9), F.lit(9), F.lit(3))
    a, b = one.select(plain, paper).first()
    assert a == pytest.approx(1.2 * np.log1p(400) / 6 + 0.8 + 0.5) and b == pytest.approx(a - 0.3 - 3 - 3)
    assert one.select(media.clip_usable(F.lit(2 << 30), F.lit(False), F.lit(5.0)), media.clip_usable(F.lit(2 << 30), F.lit(True), F.lit(5.0)), media.clip_usable(F.lit(1), F.lit(True), F.lit(1.9)), media.even(F.lit(5.1))).first()[:] == (False, True, False, 6)
    assert media.max_videos(0.15, 120) == 18
    r = {n: tuple(one.select(media.pair_area(n, F.lit(1920), F.lit(1080)).alias("r")).first()["r"]) for n in media.PAIR_AREAS}
    assert r["photos_together"] == (24, 24, 1872, 601) and r["maps_right"] == (967, 639, 929, 388) == (1920 - 24 - 929, *r["maps_left"][1:])
    line = np.array([[0.0, 0.0], [10.0, 0.0], [500.0, 0.0]])
    assert (media.offset_line(line, 3.0)[:, 1] == 3).all() and len(media.with_arcs(line, 100.0)) == 25 and media.with_arcs(line, 100.0)[:, 1].min() < -10


def plain_camera(on, dots, fps, period, width, height):
    """The camera by plain loops over the frames of one film."""
    import math

    n = len(on)
    seen = [on[f] and any(d[f] is not None for d in dots) for f in range(n)]
    r, s = max(2, int(0.5 * period * fps)), max(2.0, min(0.5 * fps, 0.4 * period * fps))
    views = {}
    even = lambda v, k: [sum(w * v[min(max(i + j - len(k) // 2, 0), len(v) - 1)] for j, w in enumerate(k)) for i in range(len(v))]
    f = 0
    while f < n:
        e = f
        while e < n and seen[e] == seen[f]:
            e += 1
        if seen[f]:
            part = range(f, e)
            box = [[[d[g][i] for d in dots for g in range(max(0, h - r), min(n, h + r + 1)) if d[g] is not None] for i in (0, 1)] for h in part]
            c = [even([(min(b[i]) + max(b[i])) / 2 for b in box], frames.kernel(s)) for i in (0, 1)]
            half = [[math.exp(x) / 2 for x in even([math.log(max(max(b[i]) - min(b[i]), 1.3e-4)) for b in box], frames.kernel(2 * s))] for i in (0, 1)]
            need = [math.log(max([1.0] + [abs(d[g][i] - c[i][g - f]) / (0.8 * half[i][g - f]) for d in dots if d[g] is not None for i in (0, 1)])) for g in part]
            most = [max(need[max(0, i - int(2 * s)) : i + int(2 * s) + 1]) for i in range(len(need))]
            grow = [math.exp(max(a, b)) for a, b in zip(even(most, frames.kernel(s)), need)]
            for i, g in enumerate(part):
                zoom = min(math.log2(px / 256 / max(2 * half[k][i] * grow[i] * 1.35, 1e-9)) for k, px in ((0, width), (1, height)))
                views[g] = (c[0][i], c[1][i], min(max(zoom, 1.0), 14.5))
        f = e
    k = max(1, int(0.25 * fps))
    fade = even([float(x) for x in seen], [1 / (2 * k + 1)] * (2 * k + 1))
    held, out = views[min(views)] if views else None, []
    for f in range(n):
        held = views.get(f, held)
        out.append((*held, fade[f] if seen[f] else 0.0) if held else None)
    return out


def test_camera(spark):
    r = random.Random(13)
    data, want = [], {}
    for film in "abc":
        n, dots = 260, []
        for _ in range(2):
            x, y, dot = 0.5, 0.4, []
            for f in range(n):
                if 60 < f < 90:
                    x, y = x + r.uniform(0, 0.01), y - r.uniform(0, 0.004)
                dot.append(None if film != "a" and (f // 37) % 3 == 1 else (x, y))
            dots.append(dot)
        if film == "c":
            dots[1] = [None] * n
        on = [5 <= f < 250 for f in range(n)]
        want[film] = plain_camera(on, dots, 10, 3.2, 960, 540)
        data += [(film, f, on[f], *[v for d in dots for v in (d[f] or (None, None))]) for f in range(n)]
    df = spark.createDataFrame(data + [("d", 0, True, None, None, None, None)], "k string, frame long, on boolean, ax double, ay double, bx double, by double")
    got = {}
    for x in frames.camera(df, "k", [("ax", "ay"), ("bx", "by")], 10, 3.2, 960, 540).collect():
        got[(x["k"], x["frame"])] = (x["cx"], x["cy"], x["zoom"], x["visible"])
    assert len(got) == 780
    for (k, f), v in got.items():
        assert v == pytest.approx(want[k][f], abs=1e-9), (k, f)


def read_of(df, column):
    """How often the plan reads a table that has the column."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(f"{column}#" in leaves.apply(i).toString() for i in range(leaves.size()))


def test_camera_streams_films_of_any_length(spark):
    r = random.Random(16)
    data, want = [], {}
    # hidden for longer than a chunk at the start, in between and at the end; a film without any view; films of one frame
    for film, n, shown in (("a", 1500, ((300, 620), (900, 1100), (1101, 1102))), ("b", 400, ()), ("c", 1, ((0, 1),)), ("d", 450, ((0, 450),))):
        x, y, dot = 0.5, 0.4, []
        for _ in range(n):
            x, y = (x + r.uniform(-0.01, 0.01), y + r.uniform(-0.004, 0.004)) if r.random() < 0.2 else (x, y)
            dot.append(None if r.random() < 0.01 else (x, y))
        on = [any(a <= f < b for a, b in shown) for f in range(n)]
        want[film] = plain_camera(on, [dot], 10, 3.2, 960, 540) if shown else []
        data += [(film, f, on[f], *(dot[f] or (None, None))) for f in range(n)]
    r.shuffle(data)
    out = frames.camera(spark.createDataFrame(data, "k string, frame long, on boolean, x double, y double"), "k", [("x", "y")], 10, 3.2, 960, 540, chunk=60)
    # a window over all later frames costs the square of a film's length; frames (and the motion they come from) are read once
    assert read_of(out, "frame") == 1 and "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {(x["k"], x["frame"]): (x["cx"], x["cy"], x["zoom"], x["visible"]) for x in out.collect()}
    assert sorted(got) == [(k, f) for k in "abcd" for f in range(len(want[k]))]
    for (k, f), v in got.items():
        assert v == pytest.approx(want[k][f], abs=1e-9), (k, f)


def plain_motion(keys, n, track):
    """Clock and position of each frame by plain loops; keys: frame, t, video; track: t, x, y."""
    import numpy as np

    track, days, out = sorted(track), {}, {}
    for q in track:
        days.setdefault(q[0] // 86_400, []).append(q)
    daily = sorted(tuple(float(np.median(v)) for v in zip(*qs)) for qs in days.values())

    def place(t):
        prev, after = [q for q in track if q[0] <= t][-1:], [q for q in track if q[0] > t][:1]
        if prev and after and after[0][0] - prev[0][0] <= 6 * 3600:
            (a, *p), (b, *q) = prev[0], after[0]
            return tuple(u + (t - a) / (b - a) * (v - u) for u, v in zip(p, q))
        return prev[0][1:] if prev and t - prev[0][0] <= 2 * 86_400 else after[0][1:] if after and after[0][0] - t <= 2 * 86_400 else None

    for f in range(keys[0][0]):
        out[f] = (keys[0][1], place(keys[0][1]))
    for f in range(keys[-1][0], n):
        out[f] = (keys[-1][1], place(keys[-1][1]))
    for (fa, ta, video), (fb, tb, _) in zip(keys, keys[1:]):
        a, b = place(ta), place(tb)
        way = []
        if a and b:
            way = [q for q in (track if tb - ta <= 2 * 86_400 else daily) if ta < q[0] <= tb]
            way = [(ta, *a), *[q for i, q in enumerate(way) if len(way) <= 300 or not i or i * 299 // (len(way) - 1) > (i - 1) * 299 // (len(way) - 1)], (tb, *b)]
        gone = np.cumsum([0.0, *[np.hypot(q[1] - p[1], q[2] - p[2]) for p, q in zip(way, way[1:])]])
        for f in range(fa, fb):
            u = (f - fa) / (fb - fa)
            e = u * u * (3 - 2 * u)
            if video:
                out[f] = (ta + (tb - ta) * u, place(ta + (tb - ta) * u))
            elif not way:
                out[f] = (ta + (tb - ta) * e, a if f - fa < (fb - fa) // 2 else b)
            elif gone[-1] == 0:
                out[f] = (ta + (tb - ta) * e, a)
            else:
                t, x, y = (np.interp(e, gone / gone[-1], v) for v in zip(*way))
                out[f] = (t if tb > ta else ta, (x, y))
    return out


def test_motion_over_blocks_of_time(spark):
    r = random.Random(17)
    edge = frames.BLOCK_S * 500
    track, t = [], edge - 40 * 86_400
    while t < edge + 50 * 86_400:
        # dense near the edge of two blocks; elsewhere with silences of up to five days
        t += r.uniform(60, 900) if abs(t - edge) < 2 * 86_400 else r.choice([600.0, 3600.0, 86_400.0, 5 * 86_400.0]) * r.random()
        track.append((t, r.random(), r.random()))
    track += [(track[5][0], 0.9, 0.9), (edge, 0.2, 0.3), (edge, 0.2, 0.4)]
    times = sorted([r.uniform(edge - 45 * 86_400, edge + 55 * 86_400) for _ in range(25)] + [r.uniform(edge - 2 * 86_400, edge + 2 * 86_400) for _ in range(12)] + [edge, edge - 1.5 * 86_400, edge - 1])
    keys, f = [], 7
    for i, t in enumerate(times):
        keys.append((f, t, i % 5 == 0))
        f += r.randint(1, 30)
    n = f + 9
    data = {"a": (keys, track), "b": ([(2, times[3], False), (9, times[1], False), (12, times[30], False)], track), "c": (keys[:2], [])}
    ks = spark.createDataFrame([(p, *x) for p, (k, _) in data.items() for x in k], "k string, frame long, t double, video boolean")
    segs = spark.createDataFrame([(p, "hold", 0, 0, n) for p in data], "k string, kind string, slot long, f0 long, f1 long")
    tr = spark.createDataFrame([(p, *x) for p, (_, q) in data.items() for x in q], "k string, t double, mx double, my double")
    out = frames.motion(ks, segs, tr, "k")
    assert read_of(out, "mx") == 1
    got = {(x["k"], x["frame"]): (x["tau"], x["mx"], x["my"]) for x in out.collect()}
    want = {(p, f): v for p, (k, q) in data.items() for f, v in plain_motion(k, n, q).items()}
    assert sorted(got) == sorted(want)
    for k, (t, at) in want.items():
        assert got[k] == ((pytest.approx(t, abs=1e-3), None, None) if at is None else (pytest.approx(t, abs=1e-3), pytest.approx(at[0], abs=1e-9), pytest.approx(at[1], abs=1e-9))), k


def test_windows_over_blocks_equal_whole_windows(spark):
    from pyspark.sql import Window

    r = random.Random(14)
    data = [(r.choice("aaaab"), float(r.randint(0, 10**6)), i, r.random()) for i in range(400)]
    df = spark.createDataFrame(data, "k string, t double, id long, v double")
    n = adjacent.numbered(df, "k", "t", "id", "n", bucket=50_000.0)
    got = {x["id"]: x for x in adjacent.windowed(n, "k", "n", 7, {"low": lambda w: F.min("v").over(w.rowsBetween(-7, 7)), "even": lambda w: frames.evened("v", frames.kernel(2.0), ["k", "__block"], "n")}, block=25).collect()}
    w = Window.partitionBy("k").orderBy("n")
    want = n.select("id", "n", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")).alias("m"), F.min("v").over(w.rowsBetween(-7, 7)).alias("low"), frames.evened("v", frames.kernel(2.0), ["k"], "n").alias("even")).collect()
    assert len(got) == 400 and all(x["n"] == x["m"] and got[x["id"]]["low"] == x["low"] and got[x["id"]]["even"] == pytest.approx(x["even"]) for x in want)


def test_percentiles(spark):
    import numpy as np

    r = random.Random(15)
    data = [(k, v) for k, n in (("a", 500), ("b", 1), ("c", 2), ("d", 300)) for v in ([1.5] * n if k == "d" else [r.gauss(0, 50) for _ in range(n)])] + [("e", None), (None, 1.0), ("a", float("nan"))]
    df = spark.createDataFrame(data, "k string, v double")
    got = {x["k"]: (x["p"], x["q"]) for x in adjacent.percentiles(df, "k", "v", {"p": 0.013, "q": 0.5}, 7.0).collect()}
    assert sorted(got) == list("abcd")
    for k, v in got.items():
        mine = [x for q, x in data if q == k and x is not None and x == x]
        assert v == pytest.approx(tuple(np.quantile(mine, [0.013, 0.5])))


def test_recursive_repair():
    from lifeweave.functions import scalar

    assert scalar.mend_tree('{"CafÃ©": ["Ã©", 1, null, {"a": "ok ъ"}]}') == '{"Café": ["é", 1, null, {"a": "ok ъ"}]}' and scalar.mend_tree("no json") == "no json"


def test_positions_in_any_form(spark):
    from lifeweave.sources import google

    forms = ["+12.5°, +45.6°", "geo:12.5,45.6", '{"latitudeE7": 125000000, "longitudeE7": 456000000}', '{"placeLocation": {"latLng": "12.5°, 45.6°"}}', '{"placeLocation": "geo:12.5,45.6"}']
    df = spark.createDataFrame([(x,) for x in forms], "p string")
    assert {tuple(x) for x in df.select(*google.latlng(F.col("p"))).collect()} == {(12.5, 45.6)}
