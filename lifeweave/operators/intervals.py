"""Merging overlapping intervals into periods and gaps, by a range-partitioned scan with carried state.

Method: range-partition by (key, start) over the whole table, sort within partitions, reduce each partition to the
island still open at its end (the maximum-end summary), combine these summaries from left to right, and scan again
with the island carried in from the left. A key that holds any share of the rows is spread over as many partitions as
its share asks for; nothing is ever gathered per key. Only one summary row a partition reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeweave.session import checkpoint, nullable, scan_partitions


def _ordered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their keys, __s, __e and whatever else, range-partitioned and sorted; the checkpoint fixes __pid.

    A hash of the other columns ends the range key: rows of one key, start and end are spread over partitions too. That
    leaves their order, and so the scan, as it is."""
    n = scan_partitions(df)
    order = [*keys, "__s", "__e"]
    others = [F.col(f"`{c}`") for c in df.columns if c not in order]
    spread = [F.xxhash64(*others)] if others else []
    return checkpoint(df.repartitionByRange(n, *order, *spread).sortWithinPartitions(*order).withColumn("__pid", F.spark_partition_id()))


def _runs(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """True where the key differs from the row before (the first row of the batch is True)."""
    new = np.zeros(len(pdf), dtype=bool)
    new[0] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return new


def _islands(s: np.ndarray, e: np.ndarray, newkey: np.ndarray, carry_end: float, touching: bool) -> tuple[np.ndarray, np.ndarray]:
    """(is the first of an island, largest end of its key so far including the row). carry_end applies to the leading rows
    that continue the key of the batch before (newkey[0] False); -inf if none."""
    run = np.cumsum(newkey)
    # a running maximum that starts anew at each key: rank ends so that later keys always rank above earlier ones
    order = np.argsort(e, kind="stable")
    rank = np.empty(len(e), dtype=np.int64)
    rank[order] = np.arange(1, len(e) + 1)
    lifted = np.maximum.accumulate(rank + (run.astype(np.int64) * (len(e) + 1)))
    upto = e[order][lifted - run * (len(e) + 1) - 1]
    lead = run == run[0] if not newkey[0] else np.zeros(len(e), dtype=bool)
    upto = np.where(lead, np.maximum(upto, carry_end), upto)
    before = np.empty(len(e))
    before[0] = carry_end if not newkey[0] else -np.inf
    before[1:] = np.where(newkey[1:], -np.inf, upto[:-1])
    return (s > before) if touching else (s >= before), upto


class _Open:
    """The island open at some point of the scan: its key, start and largest end."""

    __slots__ = ("e", "key", "s")

    def __init__(self, key: tuple, s: float, e: float):
        self.key, self.s, self.e = key, s, e


def _scan(batches: Iterator[pd.DataFrame], keys: list[str], carry: _Open | None, touching: bool) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, _Open | None, _Open]]:
    """For each batch: rows, first-of-island flags, largest end so far, start of the island of each row, the island open before and after."""
    now = carry
    for pdf in batches:
        if not len(pdf):
            continue
        s, e = pdf["__s"].to_numpy(dtype=float), pdf["__e"].to_numpy(dtype=float)
        newkey = _runs(pdf, keys)
        if now is not None and tuple(pdf[k].iat[0] for k in keys) == now.key:
            newkey[0] = False
        first, upto = _islands(s, e, newkey, now.e if now is not None and not newkey[0] else -np.inf, touching)
        at = np.maximum.accumulate(np.where(first, np.arange(len(s)), -1))
        start = np.where(at >= 0, s[np.maximum(at, 0)], now.s if now is not None else np.nan)
        last = _Open(tuple(pdf[k].iat[-1] for k in keys), float(start[-1]), float(upto[-1]))
        yield pdf, first, upto, start, now, last
        now = last


def _summaries(df: DataFrame, keys: list[str], touching: bool) -> list:
    """One row a partition: first and last key, and the island open at its end as seen without what lies to the left."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, last, pid = None, None, None
        for pdf, _, _, _, _, last in _scan(batches, keys, None, touching):  # noqa: B007
            if head is None:
                head, pid = tuple(pdf[k].iat[0] for k in keys), int(pdf["__pid"].iat[0])
        if head is not None:
            yield pd.DataFrame({"pid": [pid], "head": [list(head)], "tail": [list(last.key)], "s": [last.s], "e": [last.e]})

    rows = df.select("__pid", *keys, "__s", "__e").mapInPandas(reduce, "pid int, head array<string>, tail array<string>, s double, e double")
    return sorted(rows.collect(), key=lambda r: r["pid"])


def _carries(summaries: list, touching: bool) -> tuple[dict[int, tuple], int]:
    """The island carried into each partition (prefix combination of the summaries) and the id of the last partition.

    The combination is associative: an island carried in survives a partition of the same key only if it reaches the
    start of the partition's own open island; starts are sorted, so it then takes in the whole partition."""
    carries: dict[int, tuple] = {}
    now: tuple | None = None
    for r in summaries:
        if now is not None:
            carries[r["pid"]] = now
        key = tuple(r["tail"])
        if now is not None and now[0] == key == tuple(r["head"]) and (r["s"] <= now[2] if touching else r["s"] < now[2]):
            now = (key, now[1], max(now[2], r["e"]))
        else:
            now = (key, r["s"], r["e"])
    return carries, summaries[-1]["pid"] if summaries else -1


def _prepare(df: DataFrame, keys: list[str], start: Column | str, end: Column | str) -> DataFrame:
    s, e = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    df = df.withColumn("__s", s.cast("double")).withColumn("__e", e.cast("double"))
    ok = F.col("__s").isNotNull() & F.col("__e").isNotNull() & ~F.isnan("__s") & ~F.isnan("__e")
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return df.where(ok)


def merge_intervals(df: DataFrame, key: str, start: str, end: str, max_gap: float | None = None, touching: bool = True) -> DataFrame:
    """Continuous periods of each key and the gaps between consecutive periods.

    Rows count if key, start and end are known and end > start; touching intervals are one period if ``touching``.
    ``max_gap`` drops longer gaps (same unit as start and end). An empty table gives no rows; repeated rows change
    nothing; extra columns are ignored. Result: key (string), kind ('period', 'gap'), start, end (double)."""
    rows = _prepare(df.select(F.col(key).cast("string").alias("k"), F.col(start).alias("a"), F.col(end).alias("b")), ["k"], "a", "b")
    # copies of one interval count once, and meet before the shuffle
    rows = _ordered(rows.where(F.col("__e") > F.col("__s")).select("k", "__s", "__e").distinct(), ["k"])
    carries, last_pid = _carries(_summaries(rows, ["k"], touching), touching)
    limit = float("inf") if max_gap is None else float(max_gap)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first_batch = next(batches, None)
        while first_batch is not None and not len(first_batch):
            first_batch = next(batches, None)
        if first_batch is None:
            return
        pid = int(first_batch["__pid"].iat[0])

        def chain() -> Iterator[pd.DataFrame]:
            yield first_batch
            yield from batches

        c = carries.get(pid)
        open_ = _Open(*c) if c else None
        tail = None
        for pdf, first, upto, start_, before, tail in _scan(chain(), ["k"], open_, touching):  # noqa: B007
            # an island ends where the next one starts; its end is the largest end just before
            at = np.flatnonzero(first)
            if not len(at):
                continue
            k, s = pdf["k"].to_numpy(), pdf["__s"].to_numpy(dtype=float)
            prev = at - 1
            inside = prev >= 0
            pk = np.where(inside, k[np.maximum(prev, 0)], before.key[0] if before else None)
            ps = np.where(inside, start_[np.maximum(prev, 0)], before.s if before else np.nan)
            pe = np.where(inside, upto[np.maximum(prev, 0)], before.e if before else np.nan)
            done = inside | (before is not None)
            gap = done & (pk == k[at]) & (s[at] - pe <= limit)
            yield pd.DataFrame({
                "k": np.concatenate([pk[done], k[at][gap]]), "kind": np.repeat(["period", "gap"], [done.sum(), gap.sum()]),
                "s": np.concatenate([ps[done], pe[gap]]), "e": np.concatenate([pe[done], s[at][gap]]),
            })
        if pid == last_pid and tail is not None:
            yield pd.DataFrame({"k": [tail.key[0]], "kind": ["period"], "s": [tail.s], "e": [tail.e]})

    out = rows.mapInPandas(emit, "k string, kind string, s double, e double")
    return out.select(F.col("k").alias(key), "kind", F.col("s").alias(start), F.col("e").alias(end))


def label_islands(df: DataFrame, keys: list[str], start: Column | str, end: Column | str, label: str = "island", touching: bool = True) -> DataFrame:
    """Every row with the start of the island that its interval belongs to (double column ``label``).

    Keys must be string columns; integer columns beside them must not hold NULLs (they pass through pandas). Rows whose
    key, start or end is unknown are left out; end may equal start. With end = start + d this is sessionization by silences of more than d (``touching``) or of d and more (not)."""
    columns = df.columns
    rows = _ordered(_prepare(df, keys, start, end), keys)
    carries, _ = _carries(_summaries(rows, keys, touching), touching)
    schema = nullable(rows.select(*columns, F.lit(0.0).alias(label)).schema)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first_batch = next(batches, None)
        while first_batch is not None and not len(first_batch):
            first_batch = next(batches, None)
        if first_batch is None:
            return
        c = carries.get(int(first_batch["__pid"].iat[0]))

        def chain() -> Iterator[pd.DataFrame]:
            yield first_batch
            yield from batches

        for pdf, _, _, start_, _, _ in _scan(chain(), keys, _Open(*c) if c else None, touching):
            out = pdf[columns].copy()
            out[label] = start_
            yield out

    return rows.mapInPandas(emit, schema)

