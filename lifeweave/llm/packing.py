"""Filling containers of fixed capacity with texts, by optimal length buckets.

Method. Texts are measured in tokens; a text longer than a container is split into full containers and a rest. Dynamic
programming over the global histogram of lengths chooses the bucket boundaries that minimise padding, exactly, for any
capacity. Batches then form bucket by bucket within the token budget of a container: as many items as fit, longest bucket
first; unless ``fill_rest`` is off, what a batch leaves free is offered to the shorter buckets, since the room beside an item
of more than half a container fits none of its own bucket. Batches are planned on the bucket counts, so the plan takes a few
hundred steps whatever the number of texts.

Distribution. Tokens are counted once where the texts are read. The histogram has a bounded number of rows (the
capacities, whatever the data), and so have the boundaries and the plan, which go to every task. Items get ranks within
their bucket from counts a partition; the running totals of these counts stay in a table and reach the task that places a
partition's items as rows before them, so nothing that grows with the partitions reaches the driver or a closure.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifeweave.session import checkpoint

#: Byte-level BPE ranks and the pattern that cuts a text into words; a parameter of the query, not part of this library.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the word pattern that belongs to these ranks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: So many buckets at most.
BUCKETS = 64
#: Stands for the full containers of split texts among the buckets.
WHOLE = -1


def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, tokens (bigint) of every document; a null or empty text has none. Special tokens' strings are plain text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = None
        for pdf in batches:
            enc = enc or _encoding(tokenizer)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]})

    return documents.select("doc_id", "text").where("doc_id IS NOT NULL").mapInPandas(run, "doc_id bigint, tokens bigint")


def _layer(before: np.ndarray, upper: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least padding of the first j lengths with one bucket more, for every j, and where that bucket begins.

    The best beginning never moves back as j grows (a wider bucket pads every length more), so each round of midpoints
    searches between the beginnings of its neighbours: a row of lengths each round, not each j."""
    m = len(before) - 1
    best, arg = np.zeros(m + 1), np.zeros(m + 1, dtype=np.int64)
    low, high = np.array([1]), np.array([m])
    first, last = np.array([0]), np.array([m - 1])
    while len(low):
        mid = (low + high) // 2
        start, stop = np.minimum(first, mid - 1), np.minimum(last, mid - 1)
        sizes = stop - start + 1
        ends = np.cumsum(sizes)
        i = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(start, sizes)
        j = np.repeat(mid, sizes)
        cost = before[i] + upper[j - 1] * (n[j] - n[i]) - (s[j] - s[i])
        least = np.minimum.reduceat(cost, ends - sizes)
        hit = np.flatnonzero(cost == np.repeat(least, sizes))
        group = np.searchsorted(ends, hit, side="right")
        at = i[hit[np.unique(group, return_index=True)[1]]]
        best[mid], arg[mid] = least, at
        low, high, first, last = (np.concatenate(x) for x in ((low, mid + 1), (mid - 1, high), (first, at), (at, last)))
        some = low <= high
        low, high, first, last = low[some], high[some], first[some], last[some]
    return best, arg


def boundaries(histogram: dict[int, int], capacity: int, buckets: int = BUCKETS) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least total padding, by dynamic programming over all lengths that
    occur. ``histogram``: length (1 to capacity) to count."""
    lengths = np.array(sorted(k for k, v in histogram.items() if v and 0 < k <= capacity), dtype=np.int64)
    m = len(lengths)
    if not m:
        return []
    count = np.array([histogram[k] for k in lengths.tolist()], dtype=float)
    upper, n, s = lengths.astype(float), np.concatenate([[0.0], np.cumsum(count)]), np.concatenate([[0.0], np.cumsum(count * lengths)])
    best = np.concatenate([[0.0], upper * n[1:] - s[1:]])
    back = [np.zeros(m + 1, dtype=np.int64)]
    for _ in range(1, min(buckets, m)):
        best, arg = _layer(best, upper, n, s)
        back.append(arg)
    cut, j = [], m
    for arg in reversed(back):
        if j:
            cut.append(int(lengths[j - 1]))
            j = int(arg[j])
    return cut[::-1]


def plan(counts: list[int], widths: list[int], capacity: int, fill_rest: bool = True) -> list[tuple[int, list[tuple[int, int]]]]:
    """Batches for buckets of the given counts and widths: (containers alike, [(bucket, items in each)]). A batch holds items
    of one bucket and, if ``fill_rest``, of shorter ones in the room that is left."""
    left, out = list(counts), []
    for k in range(len(widths) - 1, -1, -1):
        while left[k]:
            room, fill = capacity, []
            for b in range(k, -1 if fill_rest else k - 1, -1):
                t = min(left[b], room // widths[b])
                if t:
                    fill.append((b, t))
                    room -= t * widths[b]
            alike = min(left[b] // t for b, t in fill)
            for b, t in fill:
                left[b] -= alike * t
            out.append((alike, fill))
    return out


def pack(documents: DataFrame, capacities: dict[int, int], tokenizer: str = TOKENIZER, fill_rest: bool = True) -> DataFrame:
    """Where every text goes, for each of ``capacities`` (size_id to tokens): size_id, container, doc_id, piece (0 unless the
    text is longer than a container), first_token, tokens.

    A text of no more than the capacity is never split; the pieces of a longer one are full but for the last. Null and
    empty texts take no room and are in no container. Repeated texts are items of their own; an empty table gives no rows.
    Containers are numbered from 0 within their size; the full ones of split texts come last."""
    sizes = {int(k): int(v) for k, v in capacities.items() if v and v > 0}
    schema = "size_id bigint, container bigint, doc_id bigint, piece bigint, first_token bigint, tokens bigint"
    if not sizes:
        return documents.sparkSession.createDataFrame([], schema)
    measured = checkpoint(count_tokens(documents, tokenizer).where("tokens > 0").withColumn("pid", F.spark_partition_id()))
    # lengths of what goes into buckets: whole texts, and rests of longer ones; split pieces fill containers alone
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("size_id"), F.lit(c).alias("capacity")) for k, c in sizes.items()]))
    rest = F.col("tokens") % F.col("s.capacity")
    items = measured.select("pid", "doc_id", "tokens", each.alias("s"))
    seen = items.groupBy("pid", "s.size_id", rest.alias("length")).agg(F.count("*").alias("n"), F.sum(F.floor(F.col("tokens") / F.col("s.capacity"))).cast("bigint").alias("full"))
    per_length = seen.groupBy("size_id", "length").agg(F.sum("n").alias("n")).where("length > 0").collect()
    histograms: dict[int, dict[int, int]] = {k: {} for k in sizes}
    for r in per_length:
        histograms[r["size_id"]][r["length"]] = r["n"]
    cuts = {k: boundaries(h, sizes[k]) for k, h in histograms.items()}
    bucket = F.lit(None).cast("int")
    for k, c in cuts.items():
        if c:
            bucket = F.when(F.col("size_id") == k, F.array_position(F.transform(F.array(*[F.lit(x) for x in c]), lambda u: F.col("length") <= u), F.lit(True)).cast("int") - 1).otherwise(bucket)
    # counts of each partition by bucket, full containers as bucket WHOLE, and what the partitions before hold
    part = seen.where("length > 0").groupBy("pid", "size_id", bucket.alias("bucket")).agg(F.sum("n").alias("n"))
    part = part.unionByName(seen.where("full > 0").groupBy("pid", "size_id", F.lit(WHOLE).alias("bucket")).agg(F.sum("full").cast("bigint").alias("n")))
    totals = {(r["size_id"], r["bucket"]): r["n"] for r in part.groupBy("size_id", "bucket").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("size_id", "bucket").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    heads = part.select("pid", F.lit(0).alias("o"), F.col("size_id").cast("bigint").alias("a"), F.col("bucket").cast("bigint").alias("b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # for each bucket: ranks from which a run of equal containers is filled, their first container, items in each
    runs: dict[tuple[int, int], tuple[list[int], list[int], list[int]]] = {(k, b): ([], [], []) for k, c in cuts.items() for b in range(len(c))}
    containers: dict[int, int] = {}
    for k, c in cuts.items():
        at, filled = 0, [0] * len(c)
        for alike, fill in plan([totals.get((k, b), 0) for b in range(len(c))], c, sizes[k], fill_rest):
            for b, t in fill:
                starts, first, per = runs[(k, b)]
                starts.append(filled[b])
                first.append(at)
                per.append(t)
                filled[b] += alike * t
            at += alike
        containers[k] = at

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks: dict[tuple[int, int], int] = {}
        now = None
        for pdf in batches:
            if not len(pdf):
                continue
            out = []
            pids = pdf["pid"].to_numpy()
            edges = [0, *(np.flatnonzero(pids[1:] != pids[:-1]) + 1).tolist(), len(pdf)]
            for low, high in zip(edges, edges[1:]):
                if pids[low] != now:
                    now, ranks = pids[low], {}
                mine = pdf.iloc[low:high]
                head = mine["o"].to_numpy() == 0
                for k, b, n in mine.loc[head, ["a", "b", "before"]].itertuples(index=False):
                    ranks[(int(k), int(b))] = int(n)
                doc, tokens = mine["a"].to_numpy()[~head], mine["b"].to_numpy()[~head]
                if not len(doc):
                    continue
                for k, capacity in sizes.items():
                    length, whole = tokens % capacity, tokens // capacity
                    bucket = np.searchsorted(np.array(cuts[k] or [0]), length)
                    for b in np.unique(bucket[length > 0]):
                        at = np.flatnonzero((bucket == b) & (length > 0))
                        key = (k, int(b))
                        rank = ranks[key] + np.arange(len(at))
                        ranks[key] += len(at)
                        starts, first, per = (np.array(x) for x in runs[key])
                        run = np.searchsorted(starts, rank, side="right") - 1
                        out.append(pd.DataFrame({"size_id": k, "container": first[run] + (rank - starts[run]) // per[run], "doc_id": doc[at], "piece": whole[at], "first_token": whole[at] * capacity, "tokens": length[at]}))
                    long = np.flatnonzero(whole)
                    if len(long):
                        n = whole[long]
                        start = containers[k] + ranks[(k, WHOLE)]
                        piece = np.concatenate([np.arange(x) for x in n])
                        out.append(pd.DataFrame({"size_id": k, "container": start + np.arange(n.sum()), "doc_id": np.repeat(doc[long], n), "piece": piece, "first_token": piece * capacity, "tokens": capacity}))
                        ranks[(k, WHOLE)] += int(n.sum())
            if out:
                yield pd.concat(out, ignore_index=True)

    items = measured.select("pid", F.lit(1).alias("o"), F.col("doc_id").alias("a"), F.col("tokens").alias("b"), F.lit(0).cast("bigint").alias("before"))
    return heads.unionByName(items).repartition("pid").sortWithinPartitions("pid", "o", "a").mapInPandas(place, schema)


def fill_rates(packed: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """size_id, containers, tokens, fill (share of the containers' room in use) and the least number any packing needs."""
    room = F.create_map(*[F.lit(int(x)) for k, v in capacities.items() for x in (k, v)])[F.col("size_id")]
    sums = packed.groupBy("size_id").agg((F.max("container") + 1).alias("containers"), F.sum("tokens").alias("tokens"))
    return sums.select("size_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * room), 4).alias("fill"), F.ceil(F.col("tokens") / room).cast("bigint").alias("at_least"))
