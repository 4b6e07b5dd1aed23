"""Stops and trips from noisy location fixes, by penalised changepoint segmentation.

Method. Fixes are filtered (unknown positions, telling accuracy, running-median outliers), then each person's track is cut
where the cheapest two-state labelling (dwelling or moving; evidence from displacement speed, a fixed penalty a change)
switches, and at every jump between two places. The pieces are labelled stop or trip; silences beyond the limit are
explicit breaks.

Distribution. The raw fixes are shuffled once, by (person, time bucket) with a small overlap, so that a person with any
share of the rows is spread over tasks of bounded size. What leaves this stage is one row a piece (some dozens a day).
Pieces are sessionized at long silences by the range-partitioned scan of ``intervals`` and joined up per session in one
streaming pass that holds one piece at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeweave.operators.intervals import label_islands
from lifeweave.session import checkpoint

METRES_PER_DEGREE = 111_195.0


@dataclass(frozen=True)
class Mobility:
    """Parameters; metres and seconds."""

    radius: float = 250.0
    min_stop: float = 900.0
    max_silence: float = 8 * 3600.0
    max_acc: float = 200.0
    outlier: float = 200.0
    window: float = 150.0
    speed: float = 0.5
    speed_scale: float = 0.2
    penalty: float = 4.0
    edge: float = 150.0
    pause: float = 900.0
    bucket: float = 172_800.0
    overlap: float = 3600.0


_PIECE = "person string, stay boolean, t0 double, t1 double, n bigint, lat double, lon double, lat_low double, lat_high double, lon_low double, lon_high double, path double"
_OUT = "person string, kind string, start double, end double, distance double, lat double, lon double, fixes bigint"


def _starts(change: np.ndarray) -> np.ndarray:
    return np.flatnonzero(change)


def _potts(evidence: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Cheapest labelling (True: moving) under a penalty a change, each block from ``first`` on its own.

    ``d`` is the cost of dwelling less that of moving; one step adds the evidence to d clipped to the penalty, and the
    labels are read backwards: a label changes where the clipping shows that changing was cheaper."""
    n = len(evidence)
    ev, new = evidence.tolist(), first.tolist()
    before, d = [0.0] * n, 0.0
    for i in range(n):
        b = 0.0 if new[i] else (penalty if d > penalty else -penalty if d < -penalty else d)
        before[i] = d
        d = b + ev[i]
    last = d
    moving = np.zeros(n, dtype=bool)
    state = last > 0
    for i in range(n - 1, -1, -1):
        moving[i] = state
        b = before[i]
        if new[i]:
            state = b > 0
        elif b > penalty:
            state = True
        elif b < -penalty:
            state = False
    return moving


def _clip_to_block(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(at, low), high)


def segment(pdf: pd.DataFrame, p: Mobility) -> pd.DataFrame:
    """Pieces of the complete (person, bucket) groups in ``pdf``, which is sorted by person, bucket, t."""
    person, bucket = pdf["person"].to_numpy(), pdf["bucket"].to_numpy()
    t, lat, lon = (pdf[c].to_numpy(dtype=float) for c in ("t", "lat", "lon"))

    def groups(person: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.ones(len(person), dtype=bool)
        new[1:] = (person[1:] != person[:-1]) | (bucket[1:] != bucket[:-1])
        return new, np.cumsum(new) - 1

    new, g = groups(person, bucket)
    keep = new.copy()
    keep[1:] |= t[1:] != t[:-1]
    # metres from the first fix of the group; outliers from the running median of five
    begin = _starts(new)
    lat0, lon0 = lat[begin][g], lon[begin][g]
    scale = np.cos(np.radians(lat0)) * METRES_PER_DEGREE
    x, y = ((lon - lon0 + 180.0) % 360.0 - 180.0) * scale, (lat - lat0) * METRES_PER_DEGREE
    for _ in range(2):
        person, bucket, t, lat, lon, x, y, g = (a[keep] for a in (person, bucket, t, lat, lon, x, y, g))
        new = np.ones(len(g), dtype=bool)
        new[1:] = g[1:] != g[:-1]
        begin = _starts(new)
        end = np.append(begin[1:], len(g)) - 1
        run = np.cumsum(new) - 1
        low, high, i = begin[run], end[run], np.arange(len(g))
        around = []
        for k in (-2, -1, 0, 1, 2):
            j = i + k
            j = np.where(j < low, 2 * low - j, np.where(j > high, 2 * high - j, j))
            around.append(_clip_to_block(j, low, high))
        mx, my = np.median(x[np.array(around)], axis=0), np.median(y[np.array(around)], axis=0)
        keep = np.hypot(x - mx, y - my) <= p.outlier
        if keep.all():
            break
    else:
        person, bucket, t, lat, lon, x, y, g, mx, my = (a[keep] for a in (person, bucket, t, lat, lon, x, y, g, mx, my))
        new = np.ones(len(g), dtype=bool)
        new[1:] = g[1:] != g[:-1]
    if not len(t):
        return pd.DataFrame()
    # displacement speed over a window that doesn't reach across pauses
    pause = new.copy()
    pause[1:] |= np.diff(t) > p.pause
    block = np.cumsum(pause) - 1
    at = _starts(pause)
    tt = (t - t[at][block]) + block * (2 * (p.bucket + 2 * p.overlap) + 10 * p.window)
    low, high = tt[at][block], tt[np.append(at[1:], len(t)) - 1][block]
    ahead, behind = _clip_to_block(tt + p.window, low, high), _clip_to_block(tt - p.window, low, high)
    moved = np.hypot(np.interp(ahead, tt, mx) - np.interp(behind, tt, mx), np.interp(ahead, tt, my) - np.interp(behind, tt, my))
    speed = moved / np.maximum(ahead - behind, p.window)
    step = np.diff(t, prepend=t[0])
    step[pause] = 0.0
    weight = np.clip(step / 45.0, 0.5, 3.0)
    moving = _potts(np.clip((speed - p.speed) / p.speed_scale, -2.0, 2.0) * weight, pause, p.penalty)
    # runs; two dwelling fixes that lie apart belong to two places
    hop = np.hypot(np.diff(mx, prepend=mx[0]), np.diff(my, prepend=my[0]))
    silence = np.diff(t, prepend=t[0])

    def cut(moving: np.ndarray) -> np.ndarray:
        c = new.copy()
        c[1:] |= (moving[1:] != moving[:-1]) | (silence[1:] > p.max_silence) | (~moving[1:] & (hop[1:] > p.radius))
        return c

    at = _starts(cut(moving))
    to = np.append(at[1:], len(t))
    # edges: a dwelling ends where its place is left, not where the speed window notices it
    for k in np.flatnonzero(~moving[at]):
        a, b = at[k], to[k]
        if b - a < 2:
            continue
        cx, cy = np.median(mx[a:b]), np.median(my[a:b])
        while a < b and np.hypot(mx[a] - cx, my[a] - cy) > p.edge:
            moving[a] = True
            a += 1
        while b > a and np.hypot(mx[b - 1] - cx, my[b - 1] - cy) > p.edge:
            moving[b - 1] = True
            b -= 1
        while a > 0 and g[a - 1] == g[at[k]] and moving[a - 1] and silence[a] <= p.max_silence and np.hypot(x[a - 1] - cx, y[a - 1] - cy) <= p.edge:
            a -= 1
            moving[a] = False
        while b < len(t) and g[b] == g[at[k]] and moving[b] and silence[b] <= p.max_silence and np.hypot(x[b] - cx, y[b] - cy) <= p.edge:
            moving[b] = False
            b += 1
    # one row a piece, of the fixes of the bucket itself
    leg = np.hypot(np.diff(x, prepend=x[0]), np.diff(y, prepend=y[0]))
    leg[new] = 0.0
    own = np.floor(t / p.bucket) == bucket
    edges = cut(moving)
    piece = np.cumsum(edges)[own]
    if not len(piece):
        return pd.DataFrame()
    first = np.ones(len(piece), dtype=bool)
    first[1:] = piece[1:] != piece[:-1]
    at = _starts(first)
    to = np.append(at[1:], len(piece)) - 1
    t, lat, lon, person, moving, leg = (a[own] for a in (t, lat, lon, person, moving, leg))
    n = to - at + 1
    lon0 = lon[at]
    east = (lon - np.repeat(lon0, n) + 180.0) % 360.0 - 180.0
    return pd.DataFrame({
        "person": person[at], "stay": ~moving[at], "t0": t[at], "t1": t[to], "n": n,
        "lat": np.add.reduceat(lat, at) / n, "lon": lon0 + np.add.reduceat(east, at) / n,
        "lat_low": np.minimum.reduceat(lat, at), "lat_high": np.maximum.reduceat(lat, at), "lon_low": lon0 + np.minimum.reduceat(east, at), "lon_high": lon0 + np.maximum.reduceat(east, at),
        "path": np.add.reduceat(leg, at),
    })


def _without_repeats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows without those equal to the one before, so that copies of a fix, however many, are never held."""
    last: pd.DataFrame | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        rows = pdf if last is None else pd.concat([last, pdf], ignore_index=True)
        new = np.zeros(len(rows), dtype=bool)
        new[0] = last is None
        for c in rows.columns:
            v, gone = rows[c].to_numpy(), pd.isna(rows[c]).to_numpy()  # unknown values are equal to each other
            new[1:] |= (v[1:] != v[:-1]) & ~(gone[1:] & gone[:-1])
        last = pdf.iloc[-1:]
        yield rows[new]


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], at_least: int = 50_000) -> Iterator[pd.DataFrame]:
    """Batches regrouped so that no group of ``keys`` (the rows are sorted by them) is split."""
    held: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        size += len(pdf)
        if size < at_least:
            continue
        pdf = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        differs = np.zeros(len(pdf), dtype=bool)
        for k in keys:
            differs |= (pdf[k] != pdf[k].iat[-1]).to_numpy()
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut:
            yield pdf.iloc[:cut]
        held = [pdf.iloc[cut:]]
        size = len(held[0])
    if size:
        yield pd.concat(held, ignore_index=True)


def _metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    east = ((lon2 - lon1 + 180.0) % 360.0 - 180.0) * np.cos(np.radians((lat1 + lat2) / 2))
    return METRES_PER_DEGREE * float(np.hypot(lat2 - lat1, east))


@dataclass
class _Stay:
    t0: float
    t1: float
    n: int
    lat: float
    lon: float

    def take(self, o: _Stay) -> None:
        w = o.n / (self.n + o.n)
        self.lat += (o.lat - self.lat) * w
        self.lon += ((o.lon - self.lon + 180.0) % 360.0 - 180.0) * w
        self.t1, self.n = max(self.t1, o.t1), self.n + o.n


@dataclass
class _Session:
    """The streaming state of one person's track between two long silences."""

    person: str
    p: Mobility
    rows: list = field(default_factory=list)
    stop: _Stay | None = None  # the last stop written, or to be
    now: _Stay | None = None  # the dwelling that may still go on
    far: float = 0.0  # how far from it the moves since then went
    since_now: float = 0.0  # path since its end
    since_stop: float = 0.0  # path since the end of the last stop

    def piece(self, r) -> None:
        if not r.stay:
            if self.now is not None:
                corners = [(a, b) for a in (r.lat_low, r.lat_high) for b in (r.lon_low, r.lon_high)]
                self.far = max(self.far, *(_metres(self.now.lat, self.now.lon, a, b) for a, b in corners))
            self.since_now += r.path
            return
        s = _Stay(r.t0, r.t1, r.n, r.lat, r.lon)
        if self.now is not None and self.far <= 1.4 * self.p.radius and _metres(self.now.lat, self.now.lon, s.lat, s.lon) <= self.p.radius:
            self.now.take(s)
            self.far = self.since_now = 0.0
            return
        self.close()
        self.now, self.far = s, 0.0

    def close(self) -> None:
        """Ends the dwelling that was open: a stop if it is long enough, else a part of the trip."""
        s = self.now
        if s is not None and s.t1 - s.t0 >= self.p.min_stop:
            if self.stop is not None:
                direct = _metres(self.stop.lat, self.stop.lon, s.lat, s.lon)
                self.rows.append((self.person, "trip", self.stop.t1, s.t0, max(self.since_stop, direct), s.lat, s.lon, 0))
            self.rows.append((self.person, "stop", s.t0, s.t1, 0.0, s.lat, s.lon, s.n))
            self.stop, self.since_stop = s, 0.0
        self.since_stop += self.since_now
        self.since_now = 0.0
        self.now = None


def stops_and_trips(fixes: DataFrame, params: Mobility | None = None) -> DataFrame:
    """Stops and trips of each person: kind ('stop', 'trip'), start and end (unix seconds), distance (metres), lat and lon
    (of the stop, or of the trip's destination), number of fixes.

    ``fixes`` has person, t, lat, lon, acc. Rows without person, t or a valid position (0/0 is unknown) and those whose
    known accuracy (acc > 0) is worse than ``max_acc`` are no evidence. Repeated fixes count once. A person without a
    dwelling of ``min_stop`` seconds gets no row, as does an empty table; extra columns are ignored."""
    p = params or Mobility()
    known = F.col("person").isNotNull() & F.col("t").isNotNull() & ~F.isnan("t") & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.abs("lat") < 1e-6) & (F.abs("lon") < 1e-6))
    good = F.coalesce(F.col("acc"), F.lit(0.0)) <= p.max_acc
    b = lambda t: F.floor(t / p.bucket).cast("bigint")
    here = F.col("t").cast("double")
    buckets = F.array_distinct(F.array(b(here - p.overlap), b(here), b(here + p.overlap)))
    raw = (
        fixes.select("person", here.alias("t"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("acc").cast("double").alias("acc"))
        .where(known & good)
        .select("person", "t", "lat", "lon", F.explode(buckets).alias("bucket"))
        .repartition("person", "bucket")
        .sortWithinPartitions("person", "bucket", "t", "lat", "lon")
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(_without_repeats(batches), ["person", "bucket"]):
            out = segment(pdf, p)
            if len(out):
                yield out

    pieces = checkpoint(raw.mapInPandas(cut, _PIECE))  # the range partitioning below reads them twice
    sessions = label_islands(pieces, ["person"], "t0", F.col("t1") + p.max_silence, "session")
    ordered = sessions.repartition("person", "session").sortWithinPartitions("person", "session", "t0", "t1")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["person", "kind", "start", "end", "distance", "lat", "lon", "fixes"]
        state, key = None, None
        for pdf in batches:
            out: list = []
            for r in pdf.itertuples(index=False):
                if (r.person, r.session) != key:
                    if state is not None:
                        state.close()
                        out += state.rows
                    state, key = _Session(r.person, p), (r.person, r.session)
                state.piece(r)
                out += state.rows
                state.rows = []
            if out:
                yield pd.DataFrame(out, columns=names)
        if state is not None:
            state.close()
            if state.rows:
                yield pd.DataFrame(state.rows, columns=names)

    return ordered.mapInPandas(fold, _OUT)
