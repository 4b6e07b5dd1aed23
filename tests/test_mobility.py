import random

from lifeweave.operators.mobility import Mobility, stops_and_trips

SCHEMA = "person string, t double, lat double, lon double, acc float"
HOUR = 3600.0


def day(r, person, legs, start=1_500_000_000.0):
    """Fixes for legs of ('stay', lat, lon, seconds), ('go', lat, lon, seconds) and ('silence', seconds)."""
    t, at, rows, truth = start, None, [], []
    for leg in legs:
        if leg[0] == "silence":
            t += leg[1]
            continue
        _, lat, lon, seconds = leg
        begin, end = t, t + seconds
        origin = at or (lat, lon)
        while t < end:
            u = (t - begin) / seconds if leg[0] == "go" else 1.0
            rows.append((person, t, origin[0] + (lat - origin[0]) * u + r.gauss(0, 1e-4), origin[1] + (lon - origin[1]) * u + r.gauss(0, 1e-4), r.choice([10.0, 20.0, None, 0.0])))
            t += r.uniform(25, 70)
        at = (lat, lon)
        if leg[0] == "stay":
            truth.append((begin, end))
    return rows, truth


def test_stops_trips_and_false_positions(spark):
    r = random.Random(3)
    legs = [("stay", 10.0, 20.0, 2 * HOUR), ("go", 10.1, 20.0, 0.5 * HOUR), ("stay", 10.1, 20.0, HOUR), ("silence", 5 * HOUR), ("stay", 10.1, 20.0, HOUR), ("go", 10.1, 20.1, 0.4 * HOUR), ("stay", 10.1, 20.1, HOUR), ("silence", 9 * HOUR), ("stay", 10.1, 20.1, HOUR), ("silence", 2 * HOUR), ("stay", 10.5, 20.1, HOUR)]
    rows, truth = day(r, "a", legs)
    n = len(rows)
    for i in range(5, n, 23):  # false positions, with and without a telling accuracy, unknown ones and repeats
        p, t, la, lo, _ = rows[i]
        rows += [(p, t + 1, la + 0.05, lo, 3000.0 if i % 2 else None), (p, t + 2, 0.0, 0.0, 5.0), (p, t + 3, None, lo, 5.0), (p, t, la, lo, None), (None, t, la, lo, 5.0), (p, None, la, lo, 5.0)]
    out = sorted(stops_and_trips(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda x: (x["start"], x["end"]))
    stops = [(x["start"], x["end"]) for x in out if x["kind"] == "stop"]
    want = [truth[0], (truth[1][0], truth[2][1]), *truth[3:]]  # the silence of five hours at one place ends nothing
    assert len(stops) == len(want) and all(abs(a - b) < 120 for s, w in zip(stops, want) for a, b in zip(s, w))
    trips = [x for x in out if x["kind"] == "trip"]
    assert len(trips) == 3  # none over the silence of nine hours
    assert 10_500 < trips[0]["distance"] < 13_000 and 40_000 < trips[2]["distance"] < 50_000


def test_buckets_make_no_difference(spark):
    r = random.Random(4)
    legs = [leg for k in range(12) for leg in (("stay", 10.0 + k % 3 * 0.1, 20.0, 5 * HOUR), ("go", 10.0 + (k + 1) % 3 * 0.1, 20.0, 0.5 * HOUR))]
    rows, truth = day(r, "a", legs)
    df = spark.createDataFrame(rows, SCHEMA)
    hours = lambda p: sorted((x["kind"], round(x["start"] / 300), round(x["end"] / 300)) for x in stops_and_trips(df, p).collect())
    whole, cut = hours(Mobility(bucket=1e7)), hours(Mobility(bucket=4 * HOUR, overlap=1800.0))
    assert len([x for x in whole if x[0] == "stop"]) == len(truth) and whole == cut


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA + ", kind string, bucket int")
    assert stops_and_trips(empty).collect() == []
    lone = spark.createDataFrame([("a", 1.0, 1.0, 1.0, None)] * 3, SCHEMA)
    assert stops_and_trips(lone).collect() == []
    still = spark.createDataFrame([("é" * 50, 60.0 * i, 179.0 / 2, 180.0, None) for i in range(30)], SCHEMA)
    assert [x["kind"] for x in stops_and_trips(still).collect()] == ["stop"]


def test_copies_with_unknown_accuracy_are_dropped_while_streaming():
    import numpy as np
    import pandas as pd

    from lifeweave.operators import mobility

    part = pd.DataFrame({"person": ["a"] * 5, "t": [1.0] * 5, "acc": [np.nan] * 5})
    other = pd.DataFrame({"person": ["a", "a", "b"], "t": [1.0, 1.0, 1.0], "acc": [np.nan, 3.0, 3.0]})
    got = pd.concat(mobility._without_repeats(iter([part, part, other])))
    assert got["person"].tolist() == ["a", "a", "b"] and got["acc"].isna().tolist() == [True, False, False]
