"""Feature statistics, rank correlation, ablation and bootstrap intervals."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Tables

FLOOR = 1e-9


def feature_stats(df: DataFrame, vec: str = "vec") -> DataFrame:
    """(dim, mean, std, n, n_missing) of every position; NULL and NaN are missing; an empty position has 0 and 1.

    The vectors are exploded map-side and reduced by partial aggregation, so only one row
    per dimension and task is shuffled.
    """
    e = df.select(F.posexplode(vec).alias("dim", "x"))
    x = F.when(~F.isnan("x"), F.col("x").cast("double"))
    return e.groupBy("dim").agg(F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.when(F.count(x) > 0, F.greatest(F.stddev_pop(x), F.lit(FLOOR))).otherwise(1.0).alias("std"), F.count(x).alias("n"), (F.count("*") - F.count(x)).alias("n_missing"))


def as_arrays(stats: DataFrame) -> tuple[Column, Column]:
    """The means and deviations in order of dimension, as literals: one number per dimension comes to the driver."""
    rows = sorted(stats.select("dim", "mean", "std").collect())
    return F.array(*[F.lit(r["mean"]) for r in rows]), F.array(*[F.lit(r["std"]) for r in rows])


def spearman(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Rank correlation with ordinal ranks (ties by key); NULL for fewer than 3 rows or no variance.

    Ranks come from sorted ranges with offsets, so no task holds the whole column.
    """
    ranked = ordinal(ordinal(df.select(key, x, y).dropna(), x, key, "rank_x"), y, key, "rank_y")
    r = ranked.agg(F.count("*").alias("n"), F.corr("rank_x", "rank_y").alias("r"))
    return r.select("n", F.when(F.col("n") >= 3, F.col("r")).alias("rank_ic"))


def ordinal(df: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """Adds the 1-based rank of (value, key), nulls first.

    Rows are sorted in ranges of (value, key), so ties of one value spread over ranges as well,
    and written once with their place; the ranges' counts then give where each begins.  Nothing
    but one number for each range comes to the driver.
    """
    tables = Tables(df.sparkSession, "ranks")
    placed = df.repartitionByRange(value, key).sortWithinPartitions(value, key).withColumn("__place", F.monotonically_increasing_id())
    placed = tables.write(placed, "placed")
    of = F.shiftright("__place", 33).cast("int")
    at, first = 0, []
    for part, n in sorted(tuple(r) for r in placed.groupBy(of.alias("part")).count().collect()):
        first.append((part, at))
        at += n
    begins = df.sparkSession.createDataFrame(first, "__part int, __first long")
    ranked = placed.withColumn("__part", of).join(F.broadcast(begins), "__part")
    return ranked.withColumn(name, F.col("__first") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__first", "__place")


def rank_ic(cards: DataFrame, actual: DataFrame, key: str = "query_id") -> DataFrame:
    """Rank correlation of the neighbours' mean return with the query's own."""
    return spearman(cards.select(key, "avg_fwd_return").join(actual.select(key, "fwd_return"), key), "avg_fwd_return", "fwd_return", key)


def evenly_spaced(df: DataFrame, m: int, order: str) -> DataFrame:
    """m rows at equal steps of the order, first and last included."""
    n = df.count()
    wanted = {int(i * (n - 1) / (m - 1)) + 1 for i in range(m)} if m > 1 else {1}
    return ordinal(df, order, order, "__rank").filter(F.col("__rank").isin(sorted(wanted))).drop("__rank")


def bca(values: list[float], resamples: int = 10_000, level: float = 0.95, seed: int = 0) -> dict[str, float]:
    """Bias-corrected and accelerated bootstrap interval of a mean (Efron 1987); for short lists."""
    x = np.asarray(values, float)
    n = len(x)
    if not n:
        return {"point": 0.0, "lower": 0.0, "upper": 0.0, "n": 0, "n_resamples": resamples, "method": "bca", "acceleration": 0.0}
    point = float(x.mean())
    if n < 2 or float(x.std()) == 0:
        return {"point": point, "lower": point, "upper": point, "n": n, "n_resamples": resamples, "method": "degenerate", "acceleration": 0.0}
    rng = np.random.default_rng(seed)
    boot = np.sort(x[rng.integers(0, n, (resamples, n))].mean(1))
    normal = NormalDist()
    below = min(max(float((boot < point).mean()), 1 / resamples), 1 - 1 / resamples)
    z0 = normal.inv_cdf(below)
    jack = (x.sum() - x) / (n - 1)
    d = jack.mean() - jack
    a = float((d**3).sum() / (6 * max(float((d**2).sum()), 1e-300) ** 1.5))
    ends = []
    for p in ((1 - level) / 2, (1 + level) / 2):
        z = normal.inv_cdf(p)
        q = normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))
        ends.append(float(boot[min(resamples - 1, max(0, math.floor(q * resamples)))]))
    return {"point": point, "lower": ends[0], "upper": ends[1], "n": n, "n_resamples": resamples, "method": "bca", "acceleration": a}


def compare_arms(arms: dict[str, dict[str, float]]) -> dict:
    """Every arm against every other, by its point and the lower end of its interval.

    SIGNIFICANT: the lower end is above the other's point; UNCERTAIN: only the point is;
    else HURTS.  Arms rank by wins of either kind, then by fewer losses.  The report is
    PENDING for fewer than two arms, SIGNIFICANT if the first arm beats all others clearly,
    TIED if the first two have the same tally, else UNCERTAIN.
    """
    kinds = ("SIGNIFICANT", "UNCERTAIN", "HURTS")
    pairs = {
        (a, b): kinds[0] if x["lower"] > y["point"] else kinds[1] if x["point"] > y["point"] else kinds[2]
        for a, x in arms.items() for b, y in arms.items() if a != b
    }
    tally = {a: tuple(sum(v == kind for (left, _), v in pairs.items() if left == a) for kind in kinds) for a in arms}
    merit = lambda a: (tally[a][0], tally[a][1], -tally[a][2])
    order = sorted(arms, key=merit, reverse=True)
    if len(order) < 2:
        return {"verdict": "PENDING", "champion": None, "order": order, "pairs": pairs, "tally": tally}
    first = tally[order[0]]
    verdict = kinds[0] if first[0] == len(order) - 1 and not first[2] else "TIED" if merit(order[0]) == merit(order[1]) else kinds[1]
    return {"verdict": verdict, "champion": order[0], "order": order, "pairs": pairs, "tally": tally}


def mean_metrics(cards: DataFrame) -> DataFrame:
    """Means of the per-query cards."""
    return cards.agg(F.count("*").alias("queries"), *[F.avg(c).alias(f"mean_{c}") for c in ("true_S_rate", "stale_S_rate", "false_trap_rate", "label_entropy", "avg_fwd_return", "support_diversity", "same_symbol_ratio")])


#: Least gain of the fused arm's rank correlation over the plain one's.
GATE = 0.02


def rank_ic_gate(arms: DataFrame, base: str = "z", fused: str = "fused", gate: float = GATE) -> DataFrame:
    """arms: arm, n, rank_ic.  One row: both values, their difference and whether it exceeds the gate (NULL if a value is missing)."""
    of = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    one = arms.agg(of(base, "rank_ic").alias("base_ic"), of(fused, "rank_ic").alias("fused_ic"), of(base, "n").alias("n_base"), of(fused, "n").alias("n_fused"))
    delta = F.col("fused_ic") - F.col("base_ic")
    return one.select("base_ic", "fused_ic", delta.alias("delta"), (delta > gate).alias("passes_gate"), "n_base", "n_fused")


def out_of_sample(patterns: DataFrame, most: int, share: float = 0.7, order: str = "idx", key: str = "id") -> DataFrame:
    """At most ``most`` evenly spaced rows of those after the first ``share`` by order."""
    ranked = ordinal(patterns, order, key, "__at")
    n = patterns.count()
    split = split_point(n, share)
    left = n - split
    if left <= most or most <= 0:
        return ranked.filter(F.col("__at") > split).drop("__at")
    wanted = {split + 1 + int(i * (left - 1) / (most - 1)) for i in range(most)} if most > 1 else {split + 1}
    return ranked.filter(F.col("__at").isin(sorted(wanted))).drop("__at")


def split_point(n: int, share: float = 0.7) -> int:
    return int(share * n)


#: Most keys of a seeded split: their permutation is drawn on the driver, one number each.
MOST_KEYS = 5_000_000


def seeded_split(df: DataFrame, column: str, seed: int = 42, of: tuple[int, int] = (2, 3)) -> DataFrame:
    """(column, place, train): the distinct keys in the order that ``random.Random(seed).shuffle`` gives their sorted list; the first two thirds train.

    Keys are ranked in ranges; the permutation of ranks is drawn once and joined by rank, so
    no task or driver holds the keys.  At least one key trains.  NULL is no key.
    """
    import random

    keys = ordinal(df.select(column).dropna().distinct(), column, column, "__rank")
    n = keys.count()
    if n > MOST_KEYS:
        raise ValueError(f"a seeded split takes {MOST_KEYS} keys at most")
    order = list(range(1, n + 1))
    random.Random(seed).shuffle(order)
    import pandas as pd

    places = df.sparkSession.createDataFrame(pd.DataFrame({"__rank": pd.Series(order, dtype="int64"), "place": pd.Series(range(n), dtype="int64")}), "__rank long, place long")
    cut = max(1, n * of[0] // of[1])
    return keys.join(places, "__rank").select(column, "place", (F.col("place") < cut).alias("train"))


def smoothed_entropy(p: Column) -> Column:
    """One label's part of the entropy with 1e-12 inside the logarithm."""
    return -p * F.log(p + 1e-12)
