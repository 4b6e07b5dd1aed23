"""The best representative of each group of duplicate records, by token-level consensus.

Method: the values of a group are aligned token by token, one after the other, to a growing profile of columns; in each
column the tokens vote with their weights; the consensus is the row of winners, and the existing value closest to it
survives. Equal values vote once with their summed weight, so the aggregation before the shuffle takes care of groups of
copies of any size; the distinct values of a group are aligned in blocks whose profiles are then aligned with each other,
so no task holds more than a block.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeweave.functions import scalar
from lifeweave.operators.intervals import label_islands
from lifeweave.session import checkpoint

#: Distinct values, or profiles, that one alignment takes at a time.
BLOCK = 200
#: A column's gap: a value that has no token there. It votes with this share of the value's weight.
GAP = ""

# Platforms whose copies of a shot keep the camera's time but not its name.
PLATFORMS = ["facebook", "instagram", "x"]

Profile = list[dict[str, float]]


def _align(a: Profile, b: Profile) -> Profile:
    """The columns of both profiles in one order: shared tokens side by side (most shared weight), the others in between;
    where the order is free, the column with the smaller token comes first."""
    n, m = len(a), len(b)
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    match = [[sum(min(v, b[j].get(k, 0.0)) for k, v in a[i].items() if k != GAP) for j in range(m)] for i in range(n)]
    for i in range(n - 1, -1, -1):
        row, below = score[i], score[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = max(below[j], row[j + 1], below[j + 1] + match[i][j] if match[i][j] > 0 else 0.0)
    wa, wb = max((sum(c.values()) for c in a), default=0.0), max((sum(c.values()) for c in b), default=0.0)
    out: Profile = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and match[i][j] > 0 and score[i][j] == score[i + 1][j + 1] + match[i][j]:
            c = dict(a[i])
            for k, v in b[j].items():
                c[k] = c.get(k, 0.0) + v
            i, j = i + 1, j + 1
        else:
            left = i < n and score[i][j] == score[i + 1][j]
            right = j < m and score[i][j] == score[i][j + 1]
            if left and (not right or min(k for k in a[i] if k != GAP) <= min(k for k in b[j] if k != GAP)):
                c = dict(a[i])
                c[GAP] = c.get(GAP, 0.0) + wb
                i += 1
            else:
                c = dict(b[j])
                c[GAP] = c.get(GAP, 0.0) + wa
                j += 1
        out.append(c)
    return out


def profile(values: Sequence[tuple[Sequence[str], float]]) -> Profile:
    """Progressive alignment: the longest value first, then by weight and text, so the order of rows doesn't matter."""
    p: Profile = []
    for k, (tokens, weight) in enumerate(sorted(values, key=lambda v: (-len(v[0]), -v[1], list(v[0])))):
        own = [{t: float(weight)} for t in tokens]
        p = own if not k else _align(p, own)
        if k and not own:
            for c in p:
                c[GAP] = c.get(GAP, 0.0)
    return p


def vote(p: Profile, gap_share: float) -> list[str]:
    """The winning token of each column; a gap wins only with more than its share of the weight. Ties go to the smaller token."""
    won = []
    for c in p:
        best = min(((-w, t) for t, w in c.items() if t != GAP), default=None)
        if best is not None and -best[0] >= gap_share * c.get(GAP, 0.0):
            won.append(best[1])
    return won


def distance(tokens: Sequence[str], consensus: Sequence[str]) -> int:
    """Tokens to insert or delete to get from one to the other."""
    row = list(range(len(consensus) + 1))
    for i, t in enumerate(tokens, 1):
        last, row[0] = row[0], i
        for j, u in enumerate(consensus, 1):
            last, row[j] = row[j], last if t == u else 1 + min(row[j], row[j - 1])
    return row[-1]


def shots(photos: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """photo_id and the shot it belongs to: person, kind, stem, island (columns of a key), with the ``extra`` columns.

    Rows of one person and kind are one shot if their times follow at less than two seconds and their titles are equal
    apart from case, extension and a mark for edited copies; a platform's copy with the camera's time joins the nearest
    shot less than two seconds away, or other such copies. Rows without person, kind or ts are in no shot; a row without
    a title, unless it is such a copy, is matched with others without one by time alone."""
    extra = extra or {}
    stem = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce("title", F.lit("")), r"\.[^.]*$", "")), scalar.EDITED, "")
    rows = photos.where(F.col("person").isNotNull() & F.col("kind").isNotNull() & F.col("ts").isNotNull() & ~F.isnan("ts")).select(
        "photo_id", "person", "kind", F.col("ts").cast("double").alias("ts"), stem.alias("stem"), (F.coalesce("source", F.lit("")).isin(PLATFORMS) & (F.coalesce("ts_origin", F.lit("")) == "exif")).alias("copy"), *[c.alias(n) for n, c in extra.items()]
    )
    names = ["photo_id", *extra]
    key = ["person", "kind", "stem", "island"]
    originals = label_islands(rows.where(~F.col("copy")).drop("copy"), ["person", "kind", "stem"], "ts", F.col("ts") + 2.0, "island", touching=False)
    # copies: the nearest of the distinct (shot, time) within two seconds, found through buckets of two seconds
    slot = F.floor(F.col("ts") / 2).cast("bigint")
    copies = rows.where("copy").drop("copy", "stem")
    near = originals.select("person", "kind", slot.alias("slot"), F.col("ts").alias("at"), "stem", "island").distinct()
    wanted = copies.select("person", "kind", "ts").distinct().withColumn("slot", F.explode(F.array(slot - 1, slot, slot + 1)))
    best = (
        wanted.join(near, ["person", "kind", "slot"])
        .where(F.abs(F.col("ts") - F.col("at")) < 2)
        .groupBy("person", "kind", "ts")
        .agg(F.min_by(F.struct("stem", "island"), F.struct(F.abs(F.col("ts") - F.col("at")), "stem", "island")).alias("shot"))
    )
    placed = copies.join(best, ["person", "kind", "ts"], "left")
    joined = placed.where(F.col("shot").isNotNull()).select(*names, "person", "kind", "shot.stem", "shot.island")
    alone = placed.where(F.col("shot").isNull()).drop("shot")
    alone = label_islands(alone, ["person", "kind"], "ts", F.col("ts") + 2.0, "island", touching=False).withColumn("stem", F.lit("\n"))
    columns = [*names, *key]
    return originals.select(columns).unionByName(joined.select(columns)).unionByName(alone.select(columns))


# What speaks for a record, in the order of its tokens.
MERITS = ["1 position", "2 favorite", "3 own upload", "4 dated folder"]


def merits() -> Column:
    """Tokens of ``MERITS`` that apply to a photo row."""
    lat, lon = F.col("lat"), F.col("lon")
    position = lat.between(-90, 90) & lon.between(-180, 180) & ~((F.abs(lat) < 1e-6) & (F.abs(lon) < 1e-6))
    origin = F.trim(F.coalesce("origin", F.lit("")))
    own = (origin != "") & ~F.lower(origin).startswith("from")
    dated = F.col("uri").rlike(r"(::|/)Photos from \d{4}/[^/]*$")
    each = [F.when(c, F.lit(m)) for c, m in zip((position, F.col("favorite"), own, dated), MERITS)]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def best_of_shots(photos: DataFrame) -> DataFrame:
    """first_id (smallest photo_id) and keep_id of each shot of two or more rows.

    The values aligned are the rows' merit tokens. A token votes against no other, so the consensus holds every merit found
    in the group, and the closest existing row is the one to which most apply; ties go to the smallest photo_id. An empty
    table gives no rows; repeated rows are further copies of their shot; extra columns are ignored."""
    key = ["person", "kind", "stem", "island"]
    votes = shots(photos, {"merit": merits()}).groupBy(*key, "merit").agg(F.count("*").alias("n"), F.min("photo_id").alias("id"))
    groups = votes.groupBy(*key).agg(F.sum("n").alias("size"), F.min("id").alias("first_id"), F.collect_list(F.struct("merit", "n", "id")).alias("values")).where("size > 1")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, list[str]] = {}
        for pdf in batches:
            keep = []
            for values in pdf["values"]:
                rows = [(tuple(v["merit"]), float(v["n"]), int(v["id"])) for v in values]
                k = tuple(sorted(r[:2] for r in rows))
                if k not in known:
                    known[k] = vote(profile([(m, w) for m, w in k]), 0.0)
                keep.append(min((distance(m, known[k]), i) for m, _, i in rows)[1])
            yield pd.DataFrame({"first_id": pdf["first_id"].to_numpy(), "keep_id": keep})

    return groups.select("first_id", "values").mapInPandas(choose, "first_id bigint, keep_id bigint")


def consensus_values(values: DataFrame, key: list[str], field: str = "field", value: str = "value", weight: str = "weight", gap_share: float = 1.0) -> DataFrame:
    """The surviving value of each (key, field): the existing one closest to the token consensus of the group.

    Ties go to the greater weight, then to the smaller text. Null and blank values don't vote and can't survive; a group
    of nothing else gets no row. ``gap_share`` is the say of values that lack a token (1: as strong as a token)."""
    group = [*key, field]
    tokens = lambda c: F.split(F.trim(F.lower(c)), r"\s+|(?<=[^\p{L}\p{N}])|(?=[^\p{L}\p{N}])")
    distinct = values.where(F.trim(F.col(value)) != "").groupBy(*group, value).agg(F.sum(weight).alias("w"))
    counts = distinct.groupBy(*group).agg(F.count("*").alias("n"))
    sized = checkpoint(distinct.join(counts, group))  # read by all that follows
    sure = sized.where("n = 1").select(*group, F.col(value).alias("value"))
    open_ = sized.where("n > 1")
    most = open_.agg(F.max("n")).first()[0] or 0
    # blocks of values, then blocks of profiles, until one a group is left
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("bigint")
    level = open_.withColumn("block", F.pmod(F.xxhash64(value), blocks)).groupBy(*group, "block").agg(F.collect_list(F.to_json(F.struct(tokens(F.col(value)).alias("t"), F.col("w").cast("double").alias("w")))).alias("items"))

    def first(items: pd.Series) -> pd.Series:
        return items.map(lambda vs: json.dumps(profile([([t for t in v["t"] if t], v["w"]) for v in map(json.loads, vs)])))

    def again(items: pd.Series) -> pd.Series:
        def fold(ps) -> str:
            out: Profile = []
            for p in sorted(map(json.loads, ps), key=lambda q: (-len(q), repr(q))):
                out = _align(out, p) if out else p
            return json.dumps(out)

        return items.map(fold)

    level = level.select(*group, "block", F.pandas_udf(first, "string")("items").alias("p"))
    left = -(-most // BLOCK)
    while left > 1:
        level = level.withColumn("block", F.floor(F.col("block") / BLOCK)).groupBy(*group, "block").agg(F.collect_list("p").alias("items"))
        level = level.select(*group, "block", F.pandas_udf(again, "string")("items").alias("p"))
        left = -(-left // BLOCK)
    winners = level.select(*group, F.pandas_udf(lambda ps: ps.map(lambda p: vote(json.loads(p), gap_share)), "array<string>")("p").alias("consensus"))
    gap = F.pandas_udf(lambda a, b: pd.Series([distance([t for t in x if t], list(y)) for x, y in zip(a, b)], dtype="int64"), "bigint")
    near = open_.join(winners, group).withColumn("d", gap(tokens(F.col(value)), "consensus"))
    closest = near.groupBy(*group).agg(F.min_by(value, F.struct(F.col("d"), -F.col("w"), F.col(value))).alias("value"))
    return sure.unionByName(closest)


def built_records(photos: DataFrame) -> DataFrame:
    """One record built for each shot of two or more rows: first_id and, field by field, the surviving title, description,
    album and uri (NULL where no row has a value), whether any row is a favorite, and the number of rows."""
    key = ["person", "kind", "stem", "island"]
    fields = ["title", "description", "album", "uri"]
    # the better a row, the more its values weigh; shots are found by ids, and only rows of several get their texts
    rows = shots(photos, {"favorite": F.coalesce("favorite", F.lit(False)), "weight": (F.size(merits()) + 1).cast("double")})
    rows = checkpoint(rows.withColumn("island", F.col("island").cast("string")))
    heads = rows.groupBy(*key).agg(F.min("photo_id").alias("first_id"), F.count("*").alias("members"), F.bool_or("favorite").alias("favorite")).where("members > 1")
    texts = photos.select("photo_id", *[F.col(f).cast("string").alias(f) for f in fields])
    told = rows.join(heads.select(*key), key, "left_semi").select("photo_id", *key, "weight").join(texts, "photo_id")
    long = told.select(*key, "weight", F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])).alias("field", "value"))
    chosen = consensus_values(long, key).groupBy(*key).pivot("field", fields).agg(F.first("value"))
    return heads.join(chosen, key, "left").select("first_id", "members", "favorite", *fields)
