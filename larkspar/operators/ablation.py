"""Comparison of vector arms on out-of-sample queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evidence, recall, stats

#: Horizons, bars of the same symbol that must lie between, and queries of a run.
HORIZONS, SAME_SYMBOL_GAP, QUERIES = ("T5", "T10", "T20"), 30, 20
#: The horizon that decides, and digits of the means.
PRIMARY, DIGITS = "T10", {"true_S_rate": 3, "false_trap_rate": 3, "stale_S_rate": 3, "avg_fwd_return": 2, "similarity": 3, "same_symbol_ratio": 3, "neighbor_age_median": 1}
ROWS = "arm string, horizon string, skipped boolean, reason string, n_queries long, " + ", ".join(f"mean_{c} double" for c in DIGITS) + ", true_S array<double>"


def metrics(patterns: DataFrame, arms: dict[str, str], horizons: tuple[str, ...] = HORIZONS, k: int = 5, most: int = QUERIES) -> DataFrame:
    """Rows of ROWS: an arm at each horizon, or one row with a reason for an arm without vectors.

    ``arms``: name to vector column.  Patterns need id, symbol, idx, cohort, market_regime and, by
    horizon, label_T, fwd_return_T and mae_T.  Queries without neighbours do not count; one recall
    per arm serves all horizons.  ``true_S`` has a number for each query, in order of their ids.
    """
    spark = patterns.sparkSession
    asked = stats.out_of_sample(patterns, most)
    own = asked.select(F.col("id").alias("query_id"), "symbol", "idx", F.col("market_regime").alias("regime"))
    out = spark.createDataFrame([], ROWS)
    for name, column in arms.items():
        if not recall.has_vectors(patterns, column):
            out = out.unionByName(spark.createDataFrame([(name, True, f"no {column} vectors")], "arm string, skipped boolean, reason string"), allowMissingColumns=True)
            continue
        hits = recall.arm(asked, patterns, column, k=k, exclude_symbol=True, gap=SAME_SYMBOL_GAP)
        near = hits.groupBy("query_id").agg(F.avg("similarity").alias("similarity"))
        for h in horizons:
            case = patterns.select(
                F.col("id").alias("case_id"), F.col("symbol").alias("case_symbol"), F.col("idx").alias("case_idx"), F.col("market_regime").alias("case_regime"),
                F.col(f"label_{h}").alias("label"), F.col(f"fwd_return_{h}").alias("fwd_return"), F.col(f"mae_{h}").alias("mae"),
            )
            card = evidence.cards(hits.join(case, "case_id"), own, k).filter("top_k_returned > 0").join(near, "query_id").withColumn("neighbor_age_median", F.col("age_median"))
            mean = lambda c: F.round(F.avg(F.col(c).cast("double")), DIGITS[c])
            of = {f"mean_{c}": mean(c) if c == "neighbor_age_median" else F.coalesce(mean(c), F.lit(0.0)) for c in DIGITS}
            rates = F.transform(F.sort_array(F.collect_list(F.struct("query_id", "true_S_rate"))), lambda x: x["true_S_rate"])
            one = card.agg(F.count("*").alias("n_queries"), *[x.alias(c) for c, x in of.items()], rates.alias("true_S"))
            out = out.unionByName(one.select("*", F.lit(name).alias("arm"), F.lit(h).alias("horizon"), F.lit(False).alias("skipped")), allowMissingColumns=True)
    return out


def intervals(found: DataFrame, resamples: int = 10_000) -> list[dict]:
    """Arms and horizons with the bootstrap interval of their true_S rate; at most ``most`` numbers for each come to the driver."""
    rows = []
    for r in found.filter("not skipped").collect():
        rows.append({"arm": r["arm"], "horizon": r["horizon"], "point": r["mean_true_S_rate"], "bca": stats.bca(list(r["true_S"]), resamples) if r["true_S"] else {}})
    return rows


def decide(found: DataFrame, first: str, horizon: str = PRIMARY, resamples: int = 10_000) -> dict:
    """The verdict over the arms at one horizon; PENDING with a reason without the first arm or a second one."""
    arms = {}
    for r in intervals(found.filter(F.col("horizon") == horizon), resamples):
        arms[r["arm"]] = {"point": r["point"], "lower": r["bca"].get("lower", 0.0), "upper": r["bca"].get("upper", 0.0)}
    if first not in arms:
        return {"verdict": "PENDING", "reason": f"{first} arm missing; cannot evaluate.", "champion": None, "order": [], "pairs": {}, "tally": {}}
    verdict = stats.compare_arms(arms)
    if verdict["verdict"] == "PENDING":
        return verdict | {"reason": f"Only {list(arms)} available; need at least 2 arms for comparison."}
    top, *rest = verdict["order"]
    score = {a: tuple(verdict["tally"][a]) for a in arms}
    if verdict["verdict"] == "SIGNIFICANT":
        reason = f"{top} won every pairwise comparison (SIG x {score[top][0]})."
    elif verdict["verdict"] == "TIED":
        reason = f"{top} and {rest[0]} tied on (SIG,UNCERTAIN,HURTS)={score[top]}."
    else:
        reason = f"{top} leads by (SIG,UNCERTAIN,HURTS)={score[top]} over {rest[0]}={score[rest[0]]}."
    return verdict | {"reason": reason, "arms": arms}


def report(found: DataFrame, first: str, **options) -> dict:
    """The whole report: every arm, skipped ones with their reason, intervals, and the decision."""
    rows = [r.asDict() for r in found.drop("true_S").collect()]
    arms: dict = {}
    for r in rows:
        if r["skipped"]:
            arms[r["arm"]] = {"skipped": True, "reason": r["reason"]}
        else:
            arms.setdefault(r["arm"], {"skipped": False, "horizons": {}})["horizons"][r["horizon"]] = {c: v for c, v in r.items() if c.startswith(("mean_", "n_"))}
    for r in intervals(found):
        arms[r["arm"]]["horizons"][r["horizon"]]["bca_true_S_rate"] = r["bca"]
    return {"arms": arms, "decision": decide(found, first, **options)}
