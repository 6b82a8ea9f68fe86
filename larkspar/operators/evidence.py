"""Evidence cards: what the neighbours of a query show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LABELS = ("true_S", "stale_S", "false_trap")
#: Warnings of a card.
SAME_SYMBOL = "same-symbol support ratio high; treat confidence as lower"
NO_NEIGHBOURS = "no neighbors returned after leakage guards"
SPARSE = "sparse support set"


def rate(hits: Column, total: Column) -> Column:
    """hits / total, 0 for an empty total."""
    return F.coalesce(F.try_divide(hits.cast("double"), total.cast("double")), F.lit(0.0))


def nearest_rank(column: str, q: float) -> Column:
    """Nearest-rank quantile: the ceil(q n)-th smallest value."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")


#: Accuracy of the approximate quantiles, and how far around a rank the bounds are taken.
ACCURACY, AROUND = 1024, 1 / 128


def nearest_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """Exact nearest-rank quantiles of groups of any size: (keys, one column per rank).

    Approximate quantiles AROUND each rank, eight times as far as they can be off, bound
    where it lies.  Rows below the bounds are counted, and those within, about one in 64,
    are reduced to counts by value, in whose order the rank is found.
    """
    d = df.select(*keys, F.col(value).alias("x")).filter("x is not null")
    names = list(ranks)
    at = [min(max(q + side * AROUND, 0.0), 1.0) for q in ranks.values() for side in (-1, 1)]
    cuts = d.groupBy(*keys).agg(F.percentile_approx("x", at, ACCURACY).alias("cuts"), F.count("*").alias("total"))
    cuts = cuts.select(*keys, "total", *[F.get("cuts", F.lit(k)).alias(f"cut{k}") for k in range(len(at))])
    d = d.join(cuts, keys)
    x, low, high = F.col("x"), [F.col(f"cut{2 * k}") for k in range(len(names))], [F.col(f"cut{2 * k + 1}") for k in range(len(names))]
    below = d.groupBy(*keys).agg(*[F.count_if(x < low[k]).alias(f"below{k}") for k in range(len(names))])
    near = [(x >= low[k]) & (x <= high[k]) for k in range(len(names))]
    inside = d.filter(reduce(lambda a, b: a | b, near)).select(*keys, "x", "total", F.explode(F.array(*[F.when(near[k], F.lit(k)) for k in range(len(names))])).alias("k"))
    counts = inside.filter("k is not null").groupBy(*keys, "k", "x").agg(F.count("*").alias("n"), F.first("total").alias("total"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "k").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    of_k = lambda columns: F.coalesce(*[F.when(F.col("k") == k, c) for k, c in enumerate(columns)])
    counts = counts.withColumn("upto", upto).join(below, keys)
    rank = F.ceil(of_k([F.lit(q) for q in ranks.values()]) * F.col("total"))
    found = counts.filter(of_k([F.col(f"below{k}") for k in range(len(names))]) + F.col("upto") >= rank)
    return found.groupBy(*keys).agg(*[F.min(F.when(F.col("k") == k, x)).alias(name) for k, name in enumerate(names)])


def _rank_of(values: Column, q: float) -> Column:
    """Nearest-rank quantile of a short sorted array; NULL for an empty one."""
    return F.get(values, F.ceil(F.lit(q) * F.size(values)).cast("int") - 1)


def cards(hits: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """One card per query, also for queries without neighbours.

    hits: query_id, case_id, case_symbol, similarity, rank, label, fwd_return, mae, case_idx,
    case_regime; queries: query_id, symbol, idx, regime.  Rates divide by all hits, labelled
    or not; entropy takes its probabilities over all hits too.  The at most k hits of a query
    are gathered once and everything is computed on that array, so the recall runs once.
    """
    hit = F.struct("rank", "case_id", "case_symbol", "label", "fwd_return", "mae", "case_idx", "case_regime")
    found = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    c = queries.select("query_id", F.col("symbol").alias("q_symbol"), F.col("idx").alias("q_idx"), F.col("regime").alias("q_regime")).join(found, "query_id", "left")
    c = c.withColumn("hits", F.coalesce("hits", F.array().cast(found.schema["hits"].dataType)))
    h, n = F.col("hits"), F.size("hits").cast("long")
    values = lambda name: F.array_sort(F.array_compact(F.transform(h, lambda x: x[name])))
    count = lambda test: F.size(F.filter(h, lambda x: F.coalesce(test(x), F.lit(False))))
    c = c.withColumns({"fwd": values("fwd_return"), "mae": values("mae"), "labels": values("label"), "age": F.array_sort(F.transform(h, lambda x: F.col("q_idx") - x["case_idx"]))})
    total = lambda column: F.aggregate(column, F.lit(0.0), lambda s, x: s + x)
    names = F.array_distinct("labels")
    of = lambda name: F.size(F.filter("labels", lambda x: x == name))
    # log2-free entropy over the labels of the card; a card without labels has 0
    entropy = F.aggregate(names, F.lit(0.0), lambda s, x: s - of(x) / n * F.log(of(x) / n))
    same = rate(count(lambda x: x["case_symbol"] == F.col("q_symbol")), n)
    with_regime = count(lambda x: x["case_regime"].isNotNull())
    return c.select(
        "query_id", F.lit(k).alias("top_k_requested"), n.alias("top_k_returned"),
        F.when(F.size("labels") > 0, F.map_from_entries(F.transform(names, lambda x: F.struct(x.alias("label"), of(x).cast("long").alias("n"))))).alias("label_distribution"),
        *[rate(of(F.lit(x)), n).alias(f"{x}_rate") for x in LABELS],
        F.coalesce(entropy, F.lit(0.0)).alias("label_entropy"), F.try_divide(total("fwd"), F.size("fwd").cast("double")).alias("avg_fwd_return"), _rank_of(F.col("fwd"), 0.5).alias("median_fwd_return"),
        F.get("mae", F.lit(0)).alias("worst_mae"), *[_rank_of(F.col("mae"), q).alias(f"mae_p{int(q * 100)}") for q in (0.25, 0.5, 0.75)],
        _rank_of(F.col("age"), 0.5).cast("long").alias("age_median"), F.get("age", F.lit(0)).alias("age_min"), F.get("age", (n - 1).cast("int")).alias("age_max"),
        same.alias("same_symbol_ratio"), rate(F.size(F.array_distinct(values("case_symbol"))), n).alias("support_diversity"),
        F.when(F.col("q_regime").isNotNull(), F.try_divide(count(lambda x: x["case_regime"] == F.col("q_regime")).cast("double"), with_regime.cast("double"))).alias("regime_match_rate"),
        F.transform(h, lambda x: x["case_id"]).alias("case_ids"),
        F.array_distinct(F.array_compact(F.array(F.when(same > 0.5, SAME_SYMBOL), F.when(n == 0, NO_NEIGHBOURS).when(n < max(1, k // 2), SPARSE)))).alias("warnings"),
    )


def stance(n: Column, trap: Column, same_symbol: Column, true_s: Column) -> Column:
    """What the evidence advises; in this order."""
    return F.when(n == 0, "abstain").when(trap >= 0.35, "caution").when(same_symbol >= 0.5, "lower_confidence").when((true_s >= 0.5) & (trap < 0.2), "confirm").otherwise("caution")


def arm_score(true_s: Column, trap: Column, diversity: Column) -> Column:
    return true_s * (1 - trap) * (0.5 + 0.5 * diversity)


def late_fusion(arms: DataFrame) -> DataFrame:
    """arms: query_id, arm, score.  Weights are the scores' shares; the fused score is their weighted sum."""
    total = arms.groupBy("query_id").agg(F.sum("score").alias("total"), F.sum(F.col("score") * F.col("score")).alias("squares"), F.max_by("arm", F.struct("score", "arm")).alias("best_arm"))
    return total.select("query_id", "best_arm", F.when(F.col("total") > 0, F.col("squares") / F.col("total")).otherwise(0.0).alias("late_fusion_score"))


def label_counts(cases: DataFrame) -> DataFrame:
    """Demo card: cases per outcome label with their ids."""
    return cases.groupBy("outcome_label").agg(F.count("*").alias("cases"), F.sort_array(F.collect_list("case_id")).alias("case_ids"), F.lit(0.0).alias("similarity"))


def prompt_block(card: DataFrame) -> DataFrame:
    """A card as text; empty for a query without neighbours."""
    text = F.format_string("neighbours %d | true_S %.2f | false_trap %.2f | same symbol %.2f | average return %+.2f", "top_k_returned", "true_S_rate", "false_trap_rate", "same_symbol_ratio", F.coalesce("avg_fwd_return", F.lit(0.0)))
    return card.select("query_id", F.when(F.col("top_k_returned") > 0, text).otherwise("").alias("block"))


def ledger_fields(card: DataFrame) -> DataFrame:
    """The card and its stance as JSON text columns of a ledger row."""
    advice = stance(F.col("top_k_returned"), F.col("false_trap_rate"), F.col("same_symbol_ratio"), F.col("true_S_rate"))
    return card.select("query_id", F.to_json(F.struct(*[c for c in card.columns if c != "query_id"])).alias("card_json"), F.to_json("case_ids").alias("ids_json"), advice.alias("stance"))
