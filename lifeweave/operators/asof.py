"""As-of joins: the neighbours in time of each query row, and positions from them.

Both sides are cut into time buckets, so a key with any share of the rows is spread over tasks. A bucket that lacks the
neighbour inside gets it from the nearest bucket that has one: that search runs on one row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifeweave.functions.geo import c

DAY = 86_400.0


def neighbours(queries: DataFrame, track: DataFrame, key: str, at: str, time: str, columns: list[str], at_is_next: bool = False, bucket: float = DAY) -> DataFrame:
    """``queries`` with structs prev and next (``time`` and ``columns`` of the track row before and after ``at``; NULL if none).

    A track row at the very time is prev, or next if ``at_is_next``. Among rows of one time the greatest values count as
    latest, the smallest as earliest. Query rows without key or time keep NULL neighbours; track rows without are ignored."""
    b = lambda t: F.floor(F.col(t) / bucket).cast("bigint")
    fix = F.struct(F.col(time).alias(time), *[F.col(x).alias(x) for x in columns])
    points = track.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("__k"), b(time).alias("__b"), F.col(time).alias("__t"), fix.alias("__fix"))
    asked = queries.withColumns({"__k": F.col(key), "__b": b(at), "__t": F.col(at)})
    # of each bucket its first and last point; for each asked bucket the nearest of the others
    ends = points.groupBy("__k", "__b").agg(F.min("__fix").alias("__first"), F.max("__fix").alias("__last"))
    wanted = asked.where("__k IS NOT NULL AND __b IS NOT NULL").groupBy("__k", "__b").agg(F.lit(True).alias("__asked"))
    both = ends.join(wanted, ["__k", "__b"], "full")
    ahead = Window.partitionBy("__k").orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumns({"__before": F.last("__last", ignorenulls=True).over(behind), "__after": F.last("__first", ignorenulls=True).over(ahead)}).where("__asked")
    outside = both.select("__k", "__b", F.explode(F.array("__before", "__after")).alias("__fix")).where("__fix IS NOT NULL").withColumn("__t", F.col(f"__fix.{time}"))
    side, row = F.lit(1 if at_is_next else 0), F.struct(*[F.col(f"`{x}`") for x in queries.columns])
    all_rows = (
        points.unionByName(outside).select("__k", "__b", "__t", "__fix", side.alias("__side"), F.lit(None).cast(asked.select(row.alias("r")).schema["r"].dataType).alias("__row"))
        .unionByName(asked.select("__k", "__b", "__t", F.lit(None).cast(points.schema["__fix"].dataType).alias("__fix"), F.lit(0 if at_is_next else 1).alias("__side"), row.alias("__row")))
    )
    forward = Window.partitionBy("__k", "__b").orderBy("__t", "__side", "__fix").rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy("__k", "__b").orderBy(F.desc("__t"), F.desc("__side"), F.desc("__fix")).rowsBetween(Window.unboundedPreceding, 0)
    found = all_rows.withColumns({"prev": F.last("__fix", ignorenulls=True).over(forward), "next": F.last("__fix", ignorenulls=True).over(backward)})
    return found.where("__row IS NOT NULL").select("__row.*", "prev", "next")


def nearest(prev: Column | str, nxt: Column | str, at: Column | str, time: str, max_gap: float) -> Column:
    """The nearer of both neighbours within ``max_gap`` (ties: the earlier), else NULL."""
    prev, nxt, at = c(prev), c(nxt), c(at)
    before, after = at - prev[time], nxt[time] - at
    far = F.lit(float("inf"))
    first = F.coalesce(before, far) <= F.coalesce(after, far)
    return F.when(first & (before <= max_gap), prev).when(~first & (after <= max_gap), nxt)


GAP_S, STALE_S, MOVED = 6 * 3600.0, 2 * 86_400.0, 6e-4


def position_at(prev: Column | str, nxt: Column | str, at: Column | str, time: str, x: str, y: str, strict: bool) -> tuple[Column, Column]:
    """Gap-aware position between two neighbours, in their coordinates ``x`` and ``y``.

    Linear between fixes at most GAP_S apart. Across a longer gap the last fix holds for STALE_S, else the next one does
    for as long. If ``strict``, and the two lie more than MOVED apart, only the nearer one within GAP_S counts."""
    prev, nxt, at = c(prev), c(nxt), c(at)
    before, after = at - prev[time], nxt[time] - at
    gap = nxt[time] - prev[time]
    both = prev.isNotNull() & nxt.isNotNull()
    weight = F.when(gap > 0, before / gap).otherwise(0.0)
    moved = both & (F.sqrt(F.pow(nxt[x] - prev[x], 2) + F.pow(nxt[y] - prev[y], 2)) > MOVED)

    def of(v: str) -> Column:
        out = F.when(both & (gap <= GAP_S), prev[v] + weight * (nxt[v] - prev[v]))
        if strict:
            near = F.when((before <= GAP_S) & (before <= after), prev[v]).when(after <= GAP_S, nxt[v])
            out = out.when(moved, near)
        return out.when(before <= STALE_S, prev[v]).when(after <= STALE_S, nxt[v])

    return of(x), of(y)
