"""Values of neighbouring rows of a key's ordered series, cut into time buckets.

A plain window by key sorts all rows of a key in one task. Here the series is cut into buckets of time; windows run by
(key, bucket), and what a bucket needs from outside - the row before it, the last known value, the running total - is
carried over from one row a bucket. A key of any share is thus spread over its buckets, with the same results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_S = 86_400.0


def _bucketed(df: DataFrame, time: str, bucket: float) -> DataFrame:
    return df.withColumn("__b", F.floor(F.col(time) / bucket).cast("bigint"))


def with_neighbours(df: DataFrame, key: str, time: str, order: str, columns: list[str], known: list[str] | None = None, bucket: float = BUCKET_S) -> DataFrame:
    """``df`` with structs prev and next of ``columns`` (NULL at the ends) and, if ``known`` is given, seen: a struct of those
    columns from the last row before whose first of them isn't NULL. The order is by ``time``, then ``order``.

    Rows must have key and time; ties in both order columns have no defined order among themselves."""
    rows = _bucketed(df, time, bucket)
    own = F.struct(*[F.col(c) for c in columns])
    place = F.struct(time, order)
    held = F.struct(*[F.col(c) for c in known]) if known else None
    aggs = [F.min_by(own, place).alias("__first"), F.max_by(own, place).alias("__last")]
    if known:
        aggs.append(F.max_by(held, F.when(F.col(known[0]).isNotNull(), place)).alias("__seen"))
    ends = rows.groupBy(key, "__b").agg(*aggs)
    w = Window.partitionBy(key).orderBy("__b")
    carried = ends.select(
        key, "__b", F.lag("__last").over(w).alias("__before"), F.lead("__first").over(w).alias("__after"), *([F.last("__seen", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__known")] if known else []),
    )
    inside = Window.partitionBy(key, "__b").orderBy(time, order)
    out = rows.join(carried, [key, "__b"])
    new = {"prev": F.coalesce(F.lag(own).over(inside), F.col("__before")), "next": F.coalesce(F.lead(own).over(inside), F.col("__after"))}
    if known:
        last = F.last(F.when(F.col(known[0]).isNotNull(), held), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
        new["seen"] = F.coalesce(last, F.col("__known"))
    return out.withColumns(new).drop("__b", "__before", "__after", "__known")


def running_sum(df: DataFrame, key: str, time: str, order: str, value: Column, name: str, bucket: float = BUCKET_S) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the key up to and including each row."""
    rows = _bucketed(df, time, bucket).withColumn("__v", value)
    totals = rows.groupBy(key, "__b").agg(F.sum("__v").alias("__t"))
    w = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, "__b", F.coalesce(F.sum("__t").over(w), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(key, "__b").orderBy(time, order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(totals, [key, "__b"]).withColumn(name, F.col("__offset") + F.sum("__v").over(inside))
    return out.drop("__b", "__v", "__offset")


def numbered(df: DataFrame, key: str, time: str, order: str, name: str, bucket: float = BUCKET_S) -> DataFrame:
    """``df`` with the place (from 1) of each row in the order of its key."""
    return running_sum(df, key, time, order, F.lit(1).cast("bigint"), name, bucket)


def windowed(df: DataFrame, key: str, number: str, reach: int, made: dict[str, Callable[[Window], Column]], block: int = 20_000) -> DataFrame:
    """``df`` with columns over the rows at most ``reach`` places away, in the order of ``number`` (1, 2, ... within the key).

    ``made``: name to a function that gives the column over a window of one block; the frame of rows is the function's own,
    within ``reach``. Rows are cut into blocks of so many places, and those near an edge go to the next block too, so a key
    of any share is spread and every row sees the rows it would see in one window."""
    n = F.col(number) - 1
    home = F.floor(n / block).cast("bigint")
    near = F.array_distinct(F.array(home, F.floor((n - reach) / block).cast("bigint"), F.floor((n + reach) / block).cast("bigint")))
    rows = df.withColumns({"__home": home, "__block": F.explode(near)}).where("__block >= 0")
    w = Window.partitionBy(key, "__block").orderBy(number)
    return rows.withColumns({k: f(w) for k, f in made.items()}).where("__block = __home").drop("__home", "__block")


def percentiles(df: DataFrame, key: str, value: str, shares: dict[str, float], width: float) -> DataFrame:
    """key and the exact percentiles of ``value``, by name and share, interpolated between neighbouring ranks.

    Equal values are counted first; counts a bin of ``width`` tell in which bins the wanted ranks lie, and only those bins'
    values are put in order. Keys without a known value have no row."""
    known = df.where(F.col(key).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))
    v = known.groupBy(key, F.col(value).alias("__v")).agg(F.count("*").alias("__n")).withColumn("__bin", F.floor(F.col("__v") / width).cast("bigint"))
    along = Window.partitionBy(key).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = v.groupBy(key, "__bin").agg(F.sum("__n").alias("__in")).withColumn("__before", F.coalesce(F.sum("__in").over(along), F.lit(0)))
    at = [F.struct(F.lit(n).alias("name"), (F.lit(float(s)) * (F.col("__all") - 1)).alias("rank")) for n, s in shares.items()]
    asked = bins.groupBy(key).agg(F.sum("__in").alias("__all")).select(key, F.explode(F.array(*at)).alias("a")).select(key, "a.*")
    asked = asked.select(key, "name", "rank", F.explode(F.array_distinct(F.array(F.floor("rank"), F.ceil("rank")))).alias("__k"))
    hit = bins.join(asked, key).where((F.col("__before") <= F.col("__k")) & (F.col("__k") < F.col("__before") + F.col("__in"))).select(key, "__bin", "name", "rank", "__k", "__before")
    inside = Window.partitionBy(key, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    some = v.join(hit.select(key, "__bin").distinct(), [key, "__bin"], "left_semi").withColumn("__low", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    found = hit.join(some, [key, "__bin"]).where((F.col("__low") <= F.col("__k") - F.col("__before")) & (F.col("__k") - F.col("__before") < F.col("__low") + F.col("__n")))
    part = F.when(F.floor("rank") == F.ceil("rank"), F.col("__v")).otherwise(F.col("__v") * (1 - F.abs(F.col("rank") - F.col("__k"))))
    return found.groupBy(key).agg(*[F.sum(F.when(F.col("name") == n, part)).alias(n) for n in shares])
