import io
import json
import struct

import pytest
from pyspark.sql import functions as F

from lifeweave.sources import archives, google, meta, others, sinks


@pytest.fixture(scope="module")
def exports(tmp_path_factory):
    d = tmp_path_factory.mktemp("exports")
    (d / "a.zip").write_bytes(archives.zip_bytes({"Takeout/Google Photos/Photos from 2019/IMG_1.jpg": b"x", "Takeout/Google Photos/Photos from 2019/IMG_1.jpg.json": b"{}"}))
    (d / "half.zip").write_bytes(b"PK\x03\x04 broken")
    (d / "Takeout" / "Google Photos").mkdir(parents=True)
    (d / "Takeout" / "Google Photos" / "b.jpg").write_bytes(b"y")
    (d / "Takeout" / "Mail").mkdir()
    (d / "Takeout" / "Mail" / "all.mbox").write_bytes(b"z")
    (d / "fb" / "your_facebook_activity" / "posts").mkdir(parents=True)
    (d / "fb" / "your_facebook_activity" / "posts" / "your_posts_1.json").write_text("[]")
    (d / "Timeline.json").write_text("[]")
    (d / "loose").mkdir()
    (d / "loose" / "IMG_20190501_101010.jpg").write_bytes(b"q")
    (d / "loose" / "notes.txt").write_text("no")
    return d


def test_discovery_members_and_kinds(spark, exports):
    files = archives.listing(spark, [str(exports), str(exports / "loose")])
    found = archives.containers(files)
    kinds = {(r["kind"], r["name"]) for r in found.collect()}
    assert ("export", "Google Photos/b.jpg") in kinds and ("export", "your_facebook_activity/posts/your_posts_1.json") in kinds
    assert ("location", "Timeline.json") in kinds and ("loose", "IMG_20190501_101010.jpg") in kinds
    assert not any(n and ("mbox" in n or "notes" in n) for _, n in kinds)
    members = archives.members(found)
    rows = members.collect()
    assert [r["error"] for r in rows if r["container"].endswith("half.zip")] == ["not a complete zip"]
    sources = {r["container"].rsplit("/", 1)[-1]: r["source"] for r in archives.export_kinds(members).collect()}
    assert sources["a.zip"] == "google" and sources["Takeout"] == "google" and sources["fb"] == "facebook"
    got = archives.contents(members.where("name LIKE '%.json' OR name LIKE '%.jpg'")).collect()
    assert {r["name"]: bytes(r["content"]) for r in got}["Takeout/Google Photos/Photos from 2019/IMG_1.jpg"] == b"x"
    prints = archives.fingerprints(found)
    assert archives.not_yet_scanned(prints, prints).count() == 0 and archives.not_yet_scanned(prints, prints.limit(0)).count() == prints.count()


def docs(spark, **files):
    return spark.createDataFrame([("c", k, v.encode() if isinstance(v, str) else json.dumps(v).encode()) for k, v in files.items()], "container string, name string, content binary")


def test_sidecars(spark):
    good = {"title": "IMG.jpg", "description": "d", "photoTakenTime": {"timestamp": "1556701200"}, "geoData": {"latitude": 0.0, "longitude": 0.0}, "geoDataExif": {"latitude": 1.5, "longitude": 2.5}, "favorited": True, "imageViews": "7", "googlePhotosOrigin": {"mobileUpload": {"deviceType": "ANDROID_PHONE"}}}
    r = google.sidecars(docs(spark, **{"p/IMG.jpg(1).json": good, "p/metadata.json": {"title": "album"}, "p/bad.json": "{"})).collect()
    assert len(r) == 1 and (r[0]["dir"], r[0]["dup"], r[0]["ts"], r[0]["lat"], r[0]["favorite"], r[0]["views"], r[0]["origin"]) == ("p", 1, 1556701200.0, 1.5, True, 7, "mobileUpload:ANDROID_PHONE")


def test_streamed_records():
    doc = '{"a": ["{"], "locations": [' + ", ".join(json.dumps({"latitudeE7": i, "n": {"s": "}]\\\""}}) for i in range(50)) + "]}"
    for size in (1, 7, 4096):
        assert [json.loads(x)["latitudeE7"] for x in google.objects(io.StringIO(doc), "locations", size)] == list(range(50))


def test_record_fixes(spark, tmp_path):
    doc = {"locations": [{"latitudeE7": 377749000, "longitudeE7": -1224194000, "timestamp": "2019-05-01T09:00:00Z", "accuracy": 12}, {"latitudeE7": 10000000, "longitudeE7": 20000000, "timestampMs": "1556701200000"}, {"latitudeE7": 0, "longitudeE7": 0, "timestampMs": "1"}]}
    (tmp_path / "Records.json").write_text(json.dumps(doc))
    m = spark.createDataFrame([(str(tmp_path / "Records.json"), "location", "Records.json")], "container string, kind string, name string")
    assert sorted((r["t"], round(r["lat"], 4), r["acc"]) for r in google.record_fixes(m).collect()) == [(1556701200.0, 1.0, 0.0), (1556701200.0, 37.7749, 12.0)]


def test_semantic_and_timeline(spark):
    d = {"startTimestamp": "2019-06-01T10:00:00Z", "endTimestamp": "2019-06-01T12:00:00Z"}
    sem = {"timelineObjects": [{"placeVisit": {"location": {"latitudeE7": 488566000, "longitudeE7": 23522000, "address": "Rue X\nParis"}, "duration": d}}, {"activitySegment": {"startLocation": {"latitudeE7": 10000000, "longitudeE7": 10000000}, "endLocation": {"latitudeE7": 30000000, "longitudeE7": 10000000}, "waypointPath": {"waypoints": [{"latE7": 20000000, "lngE7": 10000000}]}, "duration": d}}]}
    fixes, places = google.semantic(docs(spark, s=sem))
    assert sorted((r["t"] - 1559383200, r["lat"]) for r in fixes.collect()) == [(0, 1.0), (0, 48.8566), (3600, 2.0), (7200, 3.0), (7200, 48.8566)]
    assert [(r["name"], r["t1"] - r["t0"]) for r in places.collect()] == [("Rue X", 7200)]
    seg = [{"startTime": "2019-06-01T10:00:00Z", "endTime": "2019-06-01T11:00:00Z", "visit": {"topCandidate": {"semanticType": "INFERRED_HOME", "placeLocation": {"latLng": "1.5°, 2.5°"}}}}, {"startTime": "2019-06-01T10:00:00Z", "timelinePath": [{"point": "geo:3.5,4.5", "durationMinutesOffsetFromStartTime": "5"}]}]
    for doc in (seg, {"semanticSegments": seg, "rawSignals": [{"position": {"LatLng": "5.5°, 6.5°", "timestamp": "2019-06-01T10:00:00Z", "accuracyMeters": 9}}]}):
        fixes, places = google.timeline(docs(spark, t=doc))
        got = sorted((r["t"] - 1559383200, r["lat"]) for r in fixes.collect())
        assert got == sorted([(0, 1.5), (3600, 1.5), (300, 3.5)] + ([(0, 5.5)] if isinstance(doc, dict) else []))
        assert [r["name"] for r in places.collect()] == ["Inferred Home"]


def test_fit_and_routes(spark):
    p = lambda acc: {"startTimeNanos": 1556701200000000000, "fitValue": [{"value": {"fpVal": 1.5}}, {"value": {"fpVal": 2.5}}, {"value": {"fpVal": acc}}]}
    assert google.fit_samples(docs(spark, f={"Data Points": [p(10), p(900)]})).count() == 1
    d = docs(spark, **{"Timeline.json": [{"startTime": 1}], "Records.json": {"locations": []}, "x.gpx": "<gpx/>", "2019_MAY.json": {"timelineObjects": []}})
    assert {r["name"]: r["r"] for r in d.select("name", google.location_route(F.col("content"), F.col("name")).alias("r")).collect()} == {"Timeline.json": "timeline", "Records.json": "records", "x.gpx": "track", "2019_MAY.json": "semantic"}


def test_facebook(spark):
    place = lambda n, la: {"place": {"name": n, "coordinate": {"latitude": la, "longitude": 2.0}}}
    posts = [
        {"timestamp": 1556701200, "data": [{"post": "CafÃ©"}], "attachments": [{"data": [{"media": {"uri": "posts/m/1.jpg", "creation_timestamp": 1556700000, "media_metadata": {"photo_metadata": {"exif_data": [{"taken_timestamp": 1556699999}, {"latitude": 9.0, "longitude": 8.0}]}}}}]}]},
        {"timestamp": 1556701300, "title": "X was travelling to B from A.", "attachments": [{"data": [place("B", 3.0), place("A", 1.0)]}]},
    ]
    social, places, media = meta.facebook_posts(docs(spark, **{"posts/your_posts_1.json": posts}))
    s = {r["text"]: r for r in social.collect()}
    assert s["Café"]["kind"] == "post" and list(s["Café"]["media"]) == ["posts/m/1.jpg"]
    trip = s["X was travelling to B from A."]
    assert (trip["kind"], trip["place"], trip["lat"]) == ("checkin", "A → B", 1.0)
    assert [(r["name"], r["lat"]) for r in places.collect()] == [("A → B", 1.0)]
    assert [(r["ts"], r["ts_origin"], r["lat"], r["description"]) for r in media.collect()] == [(1556699999.0, "exif", 9.0, "Café")]
    other = meta.facebook_other_posts(docs(spark, **{"posts_on_other_pages_and_profiles.json": [{"timestamp": 5, "label_values": [{"label": "Message", "value": "hi"}, {"label": "Target", "value": "T"}]}]}))
    assert [(r["text"], r["who"]) for r in other.collect()] == [("hi", "T")]
    c = meta.comments(docs(spark, **{"comments.json": {"comments_v2": [{"timestamp": 7, "title": "A commented on Bo's post.", "data": [{"comment": {"comment": "yes", "timestamp": 8}}]}]}}), "facebook")
    assert [(r["ts"], r["text"], r["who"]) for r in c.collect()] == [(8.0, "yes", "Bo")]
    assert meta.facebook_places(docs(spark, **{"check-ins.json": {"x": [{"name": "N", "coordinate": {"latitude": 1.0, "longitude": 2.0}, "timestamp": 9}]}})).count() == 1


def test_instagram_and_messages(spark):
    social, media = meta.instagram_posts(docs(spark, **{"content/posts_1.json": [{"media": [{"uri": "m/1.jpg", "creation_timestamp": 5, "title": "cap"}]}], "content/stories.json": {"ig_stories": [{"uri": "m/2.mp4", "creation_timestamp": 6, "title": "st"}]}}))
    assert sorted((r["kind"], r["text"]) for r in social.collect()) == [("post", "cap"), ("story", "st")]
    assert sorted((r["kind"], r["ts_origin"]) for r in media.collect()) == [("image", "post"), ("video", "post")]
    ig = meta.comments(docs(spark, **{"comments/post_comments.json": [{"string_map_data": {"Comment": {"value": "nice"}, "Time": {"timestamp": 5}, "Media Owner": {"value": "z"}}}]}), "instagram")
    assert [(r["text"], r["who"]) for r in ig.collect()] == [("nice", "z")]
    m = meta.messages(docs(spark, **{"a/messages/inbox/t/message_1.json": {"participants": [{"name": "A"}, {"name": "B"}], "messages": [{"timestamp_ms": 1556701200000, "sender_name": "A", "content": "x"}, {"timestamp_ms": 1, "sender_name": "B"}, {"timestamp_ms": 2, "content": "y", "is_unsent": True}]}}))
    assert [(r["ts"], r["sender"], r["thread"], list(r["members"])) for r in m.collect()] == [(1556701200.0, "A", "A, B", ["A", "B"])]


def test_x_archive(spark):
    tweets = [{"tweet": {"id_str": "11", "full_text": "hello https://t.co/abc", "created_at": "Mon Dec 04 14:41:52 +0000 2017", "coordinates": {"coordinates": ["2.0", "1.0"]}}}, {"tweet": {"id_str": "12", "full_text": "RT @x: no", "created_at": "Mon Dec 04 14:41:52 +0000 2017"}}]
    dm = [{"dmConversation": {"messages": [{"messageCreate": {"senderId": "1", "recipientId": "2", "text": "hi", "createdAt": "2017-12-04T14:41:52.000Z"}}]}}]
    d = docs(spark, **{"data/tweets.js": "window.YTD.tweets.part0 = " + json.dumps(tweets), "data/account.js": 'window.YTD.account.part0 = [{"account": {"accountId": "1"}}]', "data/direct-messages.js": "x = " + json.dumps(dm)})
    members = spark.createDataFrame([("c", "data/tweets_media/11-a.jpg"), ("c", "data/tweets_media/99-b.jpg")], "container string, name string")
    social, media = others.tweets(d, members)
    assert [(r["text"], r["kind"], r["lat"]) for r in social.collect()] == [("hello", "post", 1.0)]
    assert [r["member"] for r in media.collect()] == ["data/tweets_media/11-a.jpg"]
    assert [(r["kind"], r["who"]) for r in others.direct_messages(d).collect()] == [("message_out", "2")]


def test_tracks(spark):
    gpx = '<trkpt lat="1.5" lon="2.5"><time>2019-05-01T09:00:00Z</time></trkpt><wpt lon="4.5" lat="3.5"><time>2019-05-01T10:00:00Z</time></wpt><trkpt lat="9" lon="9"></trkpt>'
    tcx = "<Trackpoint><Time>2019-05-01T09:00:00Z</Time></Trackpoint><Trackpoint><Time>2019-05-01T09:00:05Z</Time><Position><LatitudeDegrees>5.5</LatitudeDegrees><LongitudeDegrees>6.5</LongitudeDegrees></Position></Trackpoint>"
    assert sorted((r["lat"], r["lon"]) for r in others.track_points(docs(spark, **{"a.GPX": gpx, "b.tcx": tcx})).collect()) == [(1.5, 2.5), (3.5, 4.5), (5.5, 6.5)]


def exif_jpeg(when, lat, lon):
    """A JPEG head with time, offset and position, little-endian."""
    def ifd(at, entries):
        out, extra, place = struct.pack("<H", len(entries)), b"", at + 2 + 12 * len(entries) + 4
        for tag, kind, count, data in entries:
            if len(data) <= 4:
                out += struct.pack("<HHI", tag, kind, count) + data.ljust(4, b"\0")
            else:
                out += struct.pack("<HHII", tag, kind, count, place + len(extra))
                extra += data
        return out + b"\0\0\0\0" + extra
    dms = lambda v: struct.pack("<6I", int(abs(v)), 1, 30, 1, 0, 1)
    main = ifd(8, [(0x8769, 4, 1, struct.pack("<I", 100)), (0x8825, 4, 1, struct.pack("<I", 200))])
    exif = ifd(100, [(0x9003, 2, 20, when.encode() + b"\0"), (0x9011, 2, 7, b"+02:00\0")])
    gps = ifd(200, [(1, 2, 2, b"S\0" if lat < 0 else b"N\0"), (2, 5, 3, dms(lat)), (3, 2, 2, b"W\0" if lon < 0 else b"E\0"), (4, 5, 3, dms(lon))])
    tiff = (b"II*\0" + struct.pack("<I", 8) + main).ljust(100, b"\0") + exif
    return b"\xff\xd8\xff\xe1\0\0Exif\0\0" + tiff.ljust(200, b"\0") + gps


def test_exif_and_loose_photos(spark):
    data = exif_jpeg("2019:05:01 11:00:00", -12.0, 77.0)
    assert others.read_exif(data) == ("2019:05:01 11:00:00", "+02:00", -12.5, 77.5)
    assert others.read_exif(b"nothing") == (None,) * 4 == others.read_exif(None) == others.read_exif(data[:150])
    heads = spark.createDataFrame([("c", "d/a.jpg", data), ("c", "d/IMG_20190501_101010.jpg", b"")], "container string, name string, content binary")
    members = spark.createDataFrame([("c", "d/a.jpg", 60_000), ("c", "d/IMG_20190501_101010.jpg", -1), ("c", "d/small.jpg", 10), ("c", "VID_20190501_101010.mp4", 5), ("c", "clip.mp4", 5)], "container string, name string, size bigint")
    got = {r["title"]: (r["ts"], r["ts_origin"], r["album"]) for r in others.loose_photos(heads, members).collect()}
    assert got == {"a.jpg": (1556701200.0, "exif", "d"), "IMG_20190501_101010.jpg": (1556705410.0, "filename", "d"), "VID_20190501_101010.mp4": (1556705410.0, "filename", "")}


def test_uri_resolution(spark):
    members = spark.createDataFrame([("c", "wrap/posts/media/1.jpg"), ("c", "wrap/other/1.jpg")], "container string, name string")
    uris = spark.createDataFrame([("c", "posts/media/1.jpg"), ("c", "zzz/1.jpg"), ("c", "none.jpg"), ("c", "http://x/1.jpg")], "container string, uri string")
    assert {r["uri"]: r["member"] for r in archives.resolve_uris(uris, members).collect()} == {"posts/media/1.jpg": "wrap/posts/media/1.jpg", "zzz/1.jpg": "wrap/other/1.jpg", "none.jpg": None, "http://x/1.jpg": None}


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([("u1", "t1", "google", "image", 1.0, 2.0, 5.0), ("u2", "t2", "x", "video", None, None, 6.0)], "uri string, title string, source string, kind string, lat double, lon double, ts double")
    (tmp_path / "exclude.txt").write_text("# no\n\n u1 \n")
    left = sinks.without_excluded(p, sinks.read_exclude(spark, str(tmp_path / "exclude.txt")))
    assert [r["uri"] for r in left.collect()] == ["u2"]
    f = spark.createDataFrame([("a", 1.0, 1.0, 1.0), ("a", 9.0, 1.0, 1.0)], "person string, t double, lat double, lon double")
    sinks.write_track(f, str(tmp_path / "track"))
    assert sinks.load_track(spark, str(tmp_path / "track"), 1.0, 5.0).count() == 1
    s = sinks.summary(p, p.withColumn("kind", F.lit("post")), f).collect()[0]
    assert (s["items"], s["videos"], s["geotagged"], s["fixes"], s["by_source"], s["by_kind"]) == (2, 1, 1, 2, {"google": 1, "x": 1}, {"post": 2})
    sinks.write_lines(p, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    sinks.write_list(p, "uri", str(tmp_path / "flags"))
    sinks.write_plan(p.limit(1), str(tmp_path / "plan"))
    assert sinks.read_plan(spark, str(tmp_path / "plan"), "uri string").collect()[0]["uri"] == "u1"
