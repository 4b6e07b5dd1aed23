"""Film queries over the smallest tables: results are whole."""

import os

import pytest

from lifeweave.plans import film

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")


def test_trail_of_every_fix(spark):
    tracks = {}
    for x in film._numbered(spark, DATA).orderBy("person", "n").collect():
        tracks.setdefault(x["person"], []).append((x["fix_id"], x["mx"]))
    want = {}
    for track in tracks.values():
        for k in range(1, len(track)):
            xs = [mx for _, mx in track[max(0, k - 50) : k + 1]]
            want[track[k][0]] = (len(xs), pytest.approx(min(k, 50) / 50, abs=1e-4), pytest.approx(max(xs) - min(xs), abs=1e-9))
    got = {x["fix_id"]: (x["points"], x["oldest"], x["width"]) for x in film.trail(spark, DATA).collect()}
    assert got == want


def test_camera_on_every_frame(spark):
    frames = {}
    for x in film.film_camera(spark, DATA).collect():
        frames.setdefault(x["person"], []).append(x["frame"])
    length = {x["person"]: x["f1"] for x in film.frame_segments(spark, DATA).where("kind = 'outro'").collect()}
    assert frames and all(sorted(f) == list(range(length[p])) for p, f in frames.items())


def test_every_frame_is_looked_up(spark):
    want = sorted((x["person"], f, x["kind"], x["slot"]) for x in film.frame_segments(spark, DATA).collect() for f in range(x["f0"], x["f1"]))
    assert want and sorted(tuple(x) for x in film.frame_lookup(spark, DATA).select("person", "frame", "kind", "slot").collect()) == want


def test_film_for_two_reads_each_table_once_a_dot(spark):
    df = film.joint_camera(spark, DATA)
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    # segments and keyframes come from checkpoints; tracks: fixes and photos, and the photos again for the second dot
    assert sum(leaves.apply(i).getClass().getSimpleName() == "LogicalRelation" for i in range(leaves.size())) == 3
    assert df.count() == film.film_camera(spark, DATA).count() > 0
