"""Decision ledger: forward outcomes, the four verdict passes and run summaries.

Returns here are fractions (0.15 is 15 %).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bars as b

#: Thresholds of the passes (above, below) and their verdicts.
PASSES = {
    "journals": (0.15, -0.05, "REFUTED", "VALIDATED"),
    "missed": (0.15, -0.05, "MISSED_ENTRY", "CORRECT_WAIT"),
    "entries": (0.10, -0.05, "GOOD_ENTRY", "BAD_ENTRY"),
    "holds": (0.10, -0.05, "PREMATURE_EXIT", "GOOD_EXIT"),
}


def outcomes(decisions: DataFrame, prices: DataFrame, horizon: int = 10) -> DataFrame:
    """Decisions with the price ``horizon`` bars on; of duplicate days the last bar counts.

    prices: symbol, day, close, seq.  The window over a symbol's bars and the join share the
    partitioning by symbol.
    """
    one = prices.groupBy("symbol", "day").agg(F.max_by("close", "seq").alias("close"))
    w = Window.partitionBy("symbol").orderBy("day")
    ahead = one.withColumn("later", F.lead("close", horizon).over(w)).withColumn("verdict_day", F.lead("day", horizon).over(w))
    d = decisions.join(ahead, ["symbol", "day"])
    d = d.filter("later > 0 and close > 0")
    return d.withColumn("pnl_frac", (F.col("later") - F.col("close")) / F.col("close"))


def in_pass(name: str) -> Column:
    action = F.upper("action")
    held = F.coalesce(F.col("shares"), F.lit(0.0)) > 0
    if name == "journals":
        return action.isin("SELL", "TRIM") & (F.trim(F.coalesce("journal", F.lit(""))) != "")
    if name == "missed":
        return (action == "WAIT") & ~held
    if name == "entries":
        return action.isin("BUY", "ADD")
    return (action.isin("WAIT", "HOLD") & held) | (action.isin("SELL", "TRIM") & (F.upper("conviction") == "SKIP"))


def verdicts(settled: DataFrame) -> DataFrame:
    """The union of the four passes; one decision can get two verdicts.  Thresholds are strict."""
    out = None
    for name, (high, low, above, below) in PASSES.items():
        v = F.when(F.col("pnl_frac") > high, above).when(F.col("pnl_frac") < low, below)
        rows = settled.filter(in_pass(name)).withColumn("verdict", v).filter("verdict is not null").withColumn("pass", F.lit(name))
        out = rows if out is None else out.unionAll(rows)
    return out.withColumn("pnl_pct", F.bround(F.col("pnl_frac") * 100, 2)).withColumn("snippet", F.substring(F.coalesce("journal", F.lit("")), 1, 200))


def summary(ledger: DataFrame, risk_free: float = 0.03, days: int = 252) -> DataFrame:
    """Per run: total return, Sharpe, Sortino, drawdown and Calmar of the daily equity."""
    w = Window.partitionBy("run_id").orderBy("day_index")
    before = F.lag("equity").over(w)
    daily = F.when(before > 0, F.col("equity") / before - 1)
    fall = b.drawdown(F.col("equity"), ["run_id"], "day_index")
    rf = (1 + risk_free) ** (1 / days) - 1
    d = ledger.withColumn("r", daily).withColumn("dd", fall)
    traded = F.upper("action").isin("BUY", "ADD", "SELL", "TRIM")
    a = d.groupBy("run_id").agg(
        F.count("*").alias("days"), F.count_if(traded).alias("trades"), F.min_by("equity", "day_index").alias("first"), F.max_by("equity", "day_index").alias("last"),
        F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.sqrt(F.avg(F.pow(F.least(F.col("r") - rf, F.lit(0.0)), 2))).alias("down"), F.max("dd").alias("max_dd"),
    )
    total = F.try_divide("last", "first") - 1
    yearly = F.pow(1 + total, days / F.col("days")) - 1
    return a.select(
        "run_id", F.col("days").alias("days"), "trades", total.alias("total_return"),
        F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * days**0.5).otherwise(0.0).alias("sharpe"), F.when(F.col("down") > 1e-8, (F.col("mean") - rf) / F.col("down") * days**0.5).otherwise(0.0).alias("sortino"),
        F.col("max_dd").alias("max_drawdown"), F.when(F.col("max_dd") > 0.001, yearly / F.col("max_dd")).otherwise(0.0).alias("calmar"),
    )


def activity(ledger: DataFrame) -> DataFrame:
    """Per run: decisions by conviction, days in the market, average position while in it."""
    p = F.col("position_pct")
    return ledger.groupBy("run_id").agg(
        *[F.count_if(F.upper("conviction") == c).alias(f"n_{c.lower()}") for c in ("FULL", "PROBE", "SKIP")],
        F.count_if(p > 1e-4).alias("days_in_market"), F.avg(F.when(p > 1e-4, p)).alias("avg_position_pct"),
    )


def scan(ledger: DataFrame, run_id: str) -> DataFrame:
    return ledger.filter(F.col("run_id") == run_id).orderBy("day_index")


def fallback(shares: Column, position_pct: Column, keep: bool) -> Column:
    """The safe decision when none can be had: hold what is held, else wait."""
    held = F.coalesce(shares, F.lit(0.0)) > 0
    target = F.when(held & F.lit(keep), position_pct).otherwise(0.0)
    return F.struct(F.when(held, "HOLD").otherwise("WAIT").alias("action"), F.lit("SKIP").alias("conviction"), target.alias("target_pct"), F.lit(True).alias("risk_flag"))


def next_id(existing: DataFrame, new: DataFrame, id_col: str, order: str) -> DataFrame:
    """New rows numbered on from the largest id; a small batch is ordered by one task."""
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    return new.withColumn(id_col, F.lit(top) + F.row_number().over(Window.orderBy(order)))


def compact_events(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Actions counted, price range and first to last day of a stretch of decisions."""
    counts = events.groupBy(*keys, "action").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("action", "n")))).alias("actions"))
    span = events.groupBy(*keys).agg(F.min("close").alias("low"), F.max("close").alias("high"), F.min(order).alias("first"), F.max(order).alias("last"))
    return span.join(counts, keys)
