"""A varied subset of given size, by minimum-cost flow quotas.

Method. Records are aggregated into combinations of categories (time, place). A flow of as many units as the subset is to
have runs from the times through the combinations to the places; each category has a balanced target (the share of the
square root of its size), and units beyond it cost more and more. The cheapest flow is the number to take of each
combination, which deterministic ranks then fill: one record of each occasion first, favorites before others.

Distribution. Only counts of combinations reach the flow, one group of them a person (their number is bounded by the
categories, not by the records). Ranks are cut to the subset's size before and after the shuffle, so a crowded occasion
never gathers in one task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifeweave.session import scan_partitions

#: Cost of a unit that repeats an occasion, against that of a unit beyond a target.
REPEAT = 50.0


def _marginal(x: int, target: float) -> float:
    """Cost of the x-th unit of a category: next to nothing up to its target, then growing with the excess."""
    return 0.01 * (x - 0.5) / target + max(0.0, (2 * (x - target) - 1) / target)


def targets(sizes: dict, units: int) -> dict:
    roots = {k: math.sqrt(n) for k, n in sizes.items()}
    whole = sum(roots.values())
    return {k: max(0.5, units * r / whole) for k, r in roots.items()}


def quotas(combinations: list[tuple[str, str, int, int]], units: int) -> list[int]:
    """How many to take of each (time, place, records, occasions): the minimum-cost flow of min(units, records) units.

    Successive shortest paths with potentials; the costs of categories are convex, so each path adds one unit at the
    marginal cost. Ties go by the order of the combinations, which the caller sorts."""
    times, places = {}, {}
    for t, p, _, occasions in combinations:
        times[t] = times.get(t, 0) + occasions
        places[p] = places.get(p, 0) + occasions
    goal_t, goal_p = targets(times, units), targets(places, units)
    t_ids, p_ids = {t: i for i, t in enumerate(times)}, {p: i for i, p in enumerate(places)}
    goals = [goal_t[t] for t in times], [goal_p[p] for p in places]
    used_t, used_p = [0] * len(t_ids), [0] * len(p_ids)
    taken = [0] * len(combinations)
    ends = [(t_ids[t], p_ids[p]) for t, p, _, _ in combinations]
    of_t: list[list[int]] = [[] for _ in t_ids]
    of_p: list[list[int]] = [[] for _ in p_ids]
    for e, (t, p) in enumerate(ends):
        of_t[t].append(e)
        of_p[p].append(e)
    n_t, n = len(t_ids), len(t_ids) + len(p_ids)
    potential = [0.0] * n

    def unit(e: int, back: bool) -> float:
        occasions = combinations[e][3]
        return (-(REPEAT if taken[e] > occasions else 0.0)) if back else (REPEAT if taken[e] >= occasions else 0.0)

    for _ in range(min(units, sum(c[2] for c in combinations))):
        # from the source into every time at its marginal cost, along combinations, out of a place at its marginal cost
        dist, via = [math.inf] * n, [-1] * n
        heap = []
        for t in range(n_t):
            d = _marginal(used_t[t] + 1, goals[0][t]) - potential[t]
            dist[t] = d
            heap.append((d, t))
        heapq.heapify(heap)
        done = [False] * n
        while heap:
            d, v = heapq.heappop(heap)
            if done[v] or d > dist[v]:
                continue
            done[v] = True
            for e in of_t[v] if v < n_t else of_p[v - n_t]:
                if v < n_t:
                    w, ok, c = n_t + ends[e][1], taken[e] < combinations[e][2], unit(e, False)
                else:
                    w, ok, c = ends[e][0], taken[e] > 0, unit(e, True)
                if ok and not done[w] and (x := d + max(0.0, c + potential[v] - potential[w])) < dist[w] - 1e-12:
                    dist[w], via[w] = x, e
                    heapq.heappush(heap, (x, w))
        best = min(((dist[n_t + p] + potential[n_t + p] + _marginal(used_p[p] + 1, goals[1][p]), p) for p in range(len(p_ids)) if dist[n_t + p] < math.inf), default=None)
        if best is None:
            break
        v = n_t + best[1]
        used_p[best[1]] += 1
        while via[v] >= 0:
            e = via[v]
            forward = v >= n_t
            taken[e] += 1 if forward else -1
            v = ends[e][0] if forward else n_t + ends[e][1]
        used_t[v] += 1
        top = max((x for x in dist if x < math.inf), default=0.0)
        potential = [potential[i] + min(dist[i], top) for i in range(n)]
    return taken


def varied_subset(photos: DataFrame, size: int, cell: float = 0.5, occasion: float = 3600.0) -> DataFrame:
    """photo_id, person, week (its Monday), place and rank (within the person's combination) of at most ``size`` photos of each person.

    Exactly ``size`` where a person has that many rows with a known time, else all of them. The place is a grid cell of
    ``cell`` degrees, or 'unknown' for a missing or 0/0 position; rows without person or ts can't be chosen; of rows equal
    in all that counts, the hash of the id decides. An empty table gives no rows; extra columns are ignored."""
    lat, lon = F.col("lat"), F.col("lon")
    known = lat.between(-90, 90) & lon.between(-180, 180) & ~((F.abs(lat) < 1e-6) & (F.abs(lon) < 1e-6))
    rows = photos.where(F.col("person").isNotNull() & F.col("ts").isNotNull() & ~F.isnan("ts")).select(
        "photo_id", "person",
        F.date_add(F.lit("1970-01-05").cast("date"), (F.floor((F.col("ts") / 86400 - 4) / 7) * 7).cast("int")).cast("string").alias("week"),
        F.when(known, F.concat_ws(":", F.floor(lat / cell).cast("string"), F.floor(lon / cell).cast("string"))).otherwise("unknown").alias("place"),
        F.floor(F.col("ts") / occasion).cast("bigint").alias("occasion"),
        F.coalesce("favorite", F.lit(False)).cast("int").alias("liked"),
        F.xxhash64("photo_id").alias("chance"),
    )
    key = ["person", "week", "place"]
    by_occasion = rows.groupBy(*key, "occasion").agg(F.count("*").alias("n"))
    counts = by_occasion.groupBy(*key).agg(F.sum("n").alias("n"), F.count("*").alias("occasions"))
    groups = counts.groupBy("person").agg(F.array_sort(F.collect_list(F.struct("week", "place", "n", "occasions"))).alias("combinations"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for person, found in zip(pdf["person"], pdf["combinations"]):
                combos = [(c["week"], c["place"], int(c["n"]), int(c["occasions"])) for c in found]
                out += [(person, m, p, q) for (m, p, _, _), q in zip(combos, quotas(combos, size)) if q]
            yield pd.DataFrame(out, columns=["person", "week", "place", "quota"])

    # a few rows each, but much work: spread over a fixed number of tasks, which isn't cut by their size (a hash of another
    # form than that of the grouping, whose own exchange would else stand for this one)
    plan = groups.repartition(scan_partitions(photos), F.xxhash64("person")).mapInPandas(solve, "person string, week string, place string, quota bigint")
    # an occasion's first record comes before any occasion's second one; both limits hold before the shuffle too
    repeat = F.row_number().over(Window.partitionBy(*key, "occasion").orderBy(F.desc("liked"), "chance", "photo_id"))
    some = rows.withColumn("repeat", repeat).where(F.col("repeat") <= size)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("repeat", F.desc("liked"), "chance", "photo_id"))
    ranked = some.withColumn("rank", rank).where(F.col("rank") <= size)
    return ranked.join(plan, key).where("rank <= quota").select("photo_id", *key, F.col("rank").cast("bigint").alias("rank"))
