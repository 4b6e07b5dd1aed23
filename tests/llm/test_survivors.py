import itertools
import random

from pyspark.sql import functions as F

from lifeweave.llm import survivors as s

SCHEMA = "photo_id long, person string, uri string, ts double, lat double, lon double, source string, title string, description string, favorite boolean, album string, ts_origin string, kind string, origin string"


def photo(i, **k):
    d = dict(photo_id=i, person="a", uri=f"z::d/{i}.jpg", ts=1000.0, lat=None, lon=None, source="google_photos", title="IMG.jpg", description=None, favorite=False, album=None, ts_origin="sidecar", kind="image", origin=None) | k
    return tuple(d.values())


def test_consensus_of_merits_takes_the_row_with_most():
    subsets = [c for n in range(5) for c in itertools.combinations(s.MERITS, n)]
    r = random.Random(1)
    for _ in range(300):
        group = r.sample(subsets, r.randint(2, 5))
        consensus = s.vote(s.profile([(m, r.randint(1, 9)) for m in group]), 0.0)
        assert consensus == sorted({t for m in group for t in m})
        best = min(s.distance(m, consensus) for m in group)
        assert {m for m in group if s.distance(m, consensus) == best} == {m for m in group if len(m) == max(map(len, group))}


def test_alignment_and_vote():
    values = [("a b c d".split(), 3.0), ("a b x d".split(), 1.0), ("a b c".split(), 1.0)]
    assert s.vote(s.profile(values), 1.0) == ["a", "b", "c", "d"]
    assert s.profile([([], 1.0)]) == [] and s.vote([], 1.0) == []
    assert s.distance([], ["a"]) == 1 and s.distance(["a", "b"], ["b"]) == 1
    assert s.profile(values) == s.profile(values[::-1])


def test_shots(spark):
    rows = [
        photo(1), photo(2, title="img-EDITED.JPG", ts=1001.9), photo(3, ts=1003.8), photo(4, ts=1005.8),  # 4 is two seconds later: another shot
        photo(5, source="facebook", ts_origin="exif", title="99_n.jpg", ts=1004.0), photo(6, source="x", ts_origin="post", title="98.jpg"),
        photo(7, person="b", favorite=True, uri="z::d/Photos from 2019/7.jpg", lat=1.0, lon=1.0, origin="mobileUpload"), photo(8, person="b", lat=0.0, lon=0.0, origin="fromPartnerSharing"), photo(9, person="b"),
        photo(10, kind="video"), photo(11, person="c", source="x", ts_origin="exif", title="1"), photo(12, person="c", source="facebook", ts_origin="exif", title="2", ts=1001.0), photo(13, person=None), photo(14, ts=None), photo(15, person="d", title=None), photo(16, person="d", title=None, favorite=None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("stem", F.lit("clash")).withColumn("island", F.lit(1))
    got = {r["first_id"]: r["keep_id"] for r in s.best_of_shots(df).collect()}
    assert got == {1: 1, 7: 7, 11: 11, 15: 15}
    members = {r["photo_id"]: (r["person"], r["stem"], r["island"]) for r in s.shots(df).collect()}
    assert members[5] == members[3] and members[4] != members[3] and members[11] == members[12] and 13 not in members and 14 not in members
    assert s.best_of_shots(df.limit(0)).collect() == []


def test_hot_group_and_repeats(spark):
    rows = [photo(i, favorite=i == 77) for i in range(500)] + [photo(1000 + i, person=f"p{i}") for i in range(100)]
    assert [tuple(r) for r in s.best_of_shots(spark.createDataFrame(rows, SCHEMA)).collect()] == [(0, 77)]


def test_surviving_values(spark):
    rows = [("g", "t", v, w) for v, w in (("the old bridge at night", 1.0), ("The old bridge at dawn", 1.0), ("the old bridge at night!", 2.0), ("x", 0.5), (None, 9.0), ("  ", 9.0))] + [("h", "t", None, 1.0), ("i", "t", "only", 1.0), ("i", "t", "only", 1.0)]
    df = spark.createDataFrame(rows, "k string, field string, value string, weight double")
    assert {r["k"]: r["value"] for r in s.consensus_values(df, ["k"]).collect()} == {"g": "the old bridge at night", "i": "only"}
    many = spark.range(650).select(F.lit("g").alias("k"), F.lit("t").alias("field"), F.concat(F.lit("a shared sentence number "), F.col("id").cast("string")).alias("value"), F.lit(1.0).alias("weight"))
    assert s.consensus_values(many, ["k"]).collect()[0]["value"].startswith("a shared sentence number ")
    assert s.consensus_values(many.limit(0), ["k"]).collect() == []


def test_built_records(spark):
    rows = [photo(1, description="sunset", album="Trip"), photo(2, description="sunset", favorite=True), photo(3, description="a cat")]
    r = s.built_records(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(x["first_id"], x["members"], x["favorite"], x["title"], x["description"], x["album"]) for x in r] == [(1, 3, True, "IMG.jpg", "sunset", "Trip")]
