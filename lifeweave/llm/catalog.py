"""Queries of the training-data operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeweave.llm import conversations as talk
from lifeweave.llm import encoding, leaks, packing, quality, sql, survivors, variety
from lifeweave.session import table

_PHOTOS = ["photo_id", "person", "kind", "ts", "source", "title", "ts_origin", "lat", "lon", "favorite", "origin", "uri", "description", "album"]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row to keep of each shot that several rows hold."""
    return survivors.best_of_shots(table(spark, sf_dir, "photos", _PHOTOS))


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each such shot, built field by field from the values closest to the consensus."""
    return survivors.built_records(table(spark, sf_dir, "photos", _PHOTOS))


SUBSET = 60


def p6_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUBSET photos of each person, spread over times and places."""
    return variety.varied_subset(table(spark, sf_dir, "photos", ["photo_id", "person", "ts", "lat", "lon", "favorite"]), SUBSET)


def p6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per person: photos, size of the subset, and weeks and places that it covers."""
    photos = table(spark, sf_dir, "photos", ["photo_id", "person", "ts", "lat", "lon", "favorite"])
    every = photos.where("person IS NOT NULL AND ts IS NOT NULL").groupBy("person").agg(F.count("*").alias("photos"))
    mine = variety.varied_subset(photos, SUBSET).groupBy("person", "week").agg(F.count("*").alias("n"), F.collect_set("place").alias("places"))
    mine = mine.groupBy("person").agg(F.sum("n").alias("subset"), F.count("*").alias("weeks"), F.max("n").alias("most_in_a_week"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("bigint").alias("places"))
    return every.join(mine, "person")


_SOCIAL = ["social_id", "person", "source", "who", "kind", "ts", "text"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of kept conversations."""
    return talk.conversations(table(spark, sf_dir, "social", _SOCIAL)).select("conv_id", F.col("id").alias("social_id"))


def p5_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with speaker roles, the message replied to and the place in the order (block in unix seconds, turn)."""
    out = talk.conversations(table(spark, sf_dir, "social", _SOCIAL))
    return out.select("conv_id", F.col("id").alias("social_id"), "role", "reply_to", F.col("block").cast("bigint").alias("block"), "turn")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text fields that may be garbled, of three tables."""
    parts = [("social", "social_id", "text"), ("places", "place_id", "name"), ("photos", "photo_id", "description")]
    frames = [table(spark, sf_dir, t, [i, "source", c]).select(F.lit(t).alias("tbl"), F.col(i).alias("row_id"), "source", F.col(c).alias("text")) for t, i, c in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text is garbled."""
    return encoding.repair(_texts(spark, sf_dir)).select("tbl", "row_id")


def p7_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the encoding chain and, where nothing was lost, the original text."""
    return encoding.repair(_texts(spark, sf_dir)).select("tbl", "row_id", "chain", F.round("posterior", 3).alias("posterior"), "restored")


def _capacities(spark: SparkSession, sf_dir: str) -> dict[int, int]:
    """The container sizes: a fixed table of four rows."""
    return {r["size_id"]: r["capacity_tokens"] for r in table(spark, sf_dir, "pack_sizes", ["size_id", "capacity_tokens"]).collect()}


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of its pieces, for each container size."""
    return packing.pack(table(spark, sf_dir, "documents", ["doc_id", "text"]), _capacities(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each size are."""
    sizes = _capacities(spark, sf_dir)
    return packing.fill_rates(packing.pack(table(spark, sf_dir, "documents", ["doc_id", "text"]), sizes), sizes)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item, with the item."""
    return leaks.leaks(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "eval_items", ["item_id", "text"])).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each leaked item: documents, and the longest passage in words."""
    found = leaks.leaks(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "eval_items", ["item_id", "text"]))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest_words"), F.first("item_words").alias("item_words"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are mainly a list, a table or junk."""
    return quality.text_quality(table(spark, sf_dir, "documents", ["doc_id", "text"])).where("form <> 'prose'").select("doc_id")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of each document."""
    stats = quality.text_quality(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return stats.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in stats.dtypes])


def p10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of the statistics that SQL can count too."""
    return p10_statistics(spark, sf_dir).select("doc_id", "n_chars", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "digit_ratio", "end_punctuation_ratio", "duplicate_line_ratio")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p3_records": p3_records, "p6_subset": p6_subset, "p6_coverage": p6_coverage, "p5_found": p5_found, "p5_turns": p5_turns, "p7_found": p7_found, "p7_repaired": p7_repaired, "p8_packed": p8_packed, "p8_fill": p8_fill, "p9_found": p9_found, "p9_items": p9_items, "p10_found": p10_found, "p10_statistics": p10_statistics, "p10_counts": p10_counts}
SQL: dict[str, str] = {"p3_found": sql.P3, "p5_found": sql.P5, "p5_turns": sql.P5_TURNS, "p10_counts": sql.P10_COUNTS}
