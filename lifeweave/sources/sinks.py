"""Where results go: JSON lines, the columnar track, the summary, the plan that people edit, exclude and flag lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line; Spark's committer replaces the folder only when all tasks are done."""
    df.write.mode("overwrite").json(path)


def write_track(fixes: DataFrame, path: str) -> None:
    """The cleaned track, a folder for each person, in order of time within the files. A person's thirty days go to one
    writer, so that none writes the whole of a large track."""
    fixes.repartition("person", F.floor(F.col("t") / 2_592_000)).sortWithinPartitions("person", "t").write.mode("overwrite").partitionBy("person").parquet(path)


def summary(photos: DataFrame, social: DataFrame, fixes: DataFrame) -> DataFrame:
    """One row: items by source, social records by kind, and the range of times of items and fixes."""
    counts = lambda df, c: df.groupBy(c).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(c, F.lit("")), "n")))).alias("m"))
    items = photos.agg(F.count("*").alias("items"), F.count_if(F.col("kind") == "video").alias("videos"), F.count_if(F.col("lat").isNotNull()).alias("geotagged"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    track = fixes.agg(F.count("*").alias("fixes"), F.min("t").alias("track_first"), F.max("t").alias("track_last"))
    one = lambda df: df.withColumn("__one", F.lit(1))  # noqa: E731  (all sides are single rows)
    out = one(items).join(one(track), "__one").join(one(counts(photos, "source").withColumnRenamed("m", "by_source")), "__one").join(one(counts(social, "kind").withColumnRenamed("m", "by_kind")), "__one")
    return out.drop("__one")


def write_plan(plan: DataFrame, path: str) -> None:
    """A plan (one row, slots nested) as one JSON file that can be edited by hand."""
    plan.coalesce(1).write.mode("overwrite").json(path)


def read_plan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_list(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_exclude(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an exclude list: one uri or title a line; blank lines and lines from '#' on don't count."""
    line = F.trim(F.col("value"))
    return spark.read.text(path).select(line.alias("entry")).where((F.col("entry") != "") & ~F.col("entry").startswith("#")).distinct()


def without_excluded(items: DataFrame, entries: DataFrame) -> DataFrame:
    """Items whose uri and title aren't on the list."""
    by = lambda c: entries.withColumnRenamed("entry", c)
    return items.join(by("uri"), "uri", "left_anti").join(by("title"), "title", "left_anti")


def load_track(spark: SparkSession, path: str, first: float, last: float) -> DataFrame:
    """Fixes of a time range, both ends included; the bounds reach the Parquet scan."""
    return spark.read.parquet(path).where(F.col("t").between(first, last))
