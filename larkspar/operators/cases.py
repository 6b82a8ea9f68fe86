"""Case memory: latest verdict per bucket, and past journals scored by heuristics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets of verdicts, and words of the journal score.
BUCKETS = {
    "calibrated_wait": ["CORRECT_WAIT", "VALIDATED"], "missed_entry": ["MISSED_ENTRY"], "good_entry": ["GOOD_ENTRY"],
    "premature_exit": ["PREMATURE_EXIT"], "good_exit": ["GOOD_EXIT"], "bad_trade": ["BAD_ENTRY", "REFUTED"],
}
FEAR = ["scared", "afraid", "fear", "worried", "nervous", "hesitant", "panic"]
MISSED = ["missing", "missed", "regret", "should have", "too late", "left behind"]
GREED = ["acceleration", "momentum", "breakout", "all-in", "fat pitch", "moon"]
STRONG = ["strong", "adx", "trend"]


def bucket_of(verdict: Column) -> Column:
    return F.coalesce(*[F.when(verdict.isin(v), F.lit(k)) for k, v in BUCKETS.items()])


def latest(cases: DataFrame, before: Column | None = None, symbol: str | None = None, top_k: int = 3) -> DataFrame:
    """The latest case of each bucket that was known before a day, then the last ``top_k``.

    Per source database the latest by (journal_date, id), then over all sources the latest by
    (journal_date, verdict_date, id): two max_by aggregations, so nothing is sorted.
    """
    c = cases.withColumn("bucket", bucket_of(F.col("verdict"))).filter("bucket is not null")
    if symbol:
        c = c.filter(F.col("run_id").startswith(symbol + "_"))
    if before is not None:
        c = c.filter((F.col("journal_date") < before) & F.col("verdict_date").isNotNull() & (F.col("verdict_date") < before))
    row = F.struct(*c.columns)
    per_source = c.groupBy("source_db", "bucket").agg(F.max_by(row, F.struct("journal_date", "id", "verdict")).alias("r")).select("r.*")
    best = per_source.groupBy("bucket").agg(F.max_by(F.struct(*per_source.columns), F.struct("journal_date", "verdict_date", "id", "verdict")).alias("r")).select("r.*")
    best = best.dropDuplicates(["run_id", "journal_date", "verdict", "action"])
    return best.orderBy(F.desc("journal_date"), F.desc("verdict_date"), F.desc("verdict")).limit(top_k)


def any_word(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def journal_score(journal: Column, action: Column, trend_mode: Column, adx: Column, rsi: Column) -> Column:
    j, mode = F.lower(F.coalesce(journal, F.lit(""))), F.lower(F.coalesce(trend_mode, F.lit("")))
    points = [
        (3, (mode != "") & F.contains(j, mode)), (2, ((rsi < 30) & any_word(j, FEAR)) | ((rsi > 70) & any_word(j, GREED))), (2, any_word(j, MISSED)),
        (1, (adx > 35) & any_word(j, STRONG)), (1, F.upper(action).isin("BUY", "ADD") & (mode == "acceleration")),
    ]
    total = F.lit(0)
    for n, when in points:
        total = total + F.when(when, n).otherwise(0)
    return total


def usable(ledger: DataFrame, symbol: str | None = None, before=None, run_id: str | None = None) -> DataFrame:
    """Rows with a journal, of a symbol, before a day, not of the running run."""
    d = ledger.filter(F.trim(F.coalesce("journal", F.lit(""))) != "")
    d = d.filter(F.col("symbol") == symbol) if symbol else d
    d = d.filter(F.col("day") < before) if before is not None else d
    return d.filter(F.col("run_id") != run_id) if run_id else d


def similar_journals(ledger: DataFrame, trend_mode: Column, adx: Column, rsi: Column, top_k: int = 3, **which) -> DataFrame:
    """Best scored journals; equal scores keep the later day first."""
    d = usable(ledger, **which).withColumn("score", journal_score(F.col("journal"), F.col("action"), trend_mode, adx, rsi))
    return d.filter("score > 0").orderBy(F.desc("score"), F.desc("day"), "id").limit(top_k)


def title(verdict: Column, action: Column, price: Column) -> Column:
    a = F.upper(F.coalesce(action, F.lit("")))
    verb = (
        F.when(verdict.isin("MISSED_ENTRY", "CORRECT_WAIT"), "You waited").when(verdict.isin("GOOD_ENTRY", "BAD_ENTRY") | a.isin("BUY", "ADD"), "You bought")
        .when(verdict.isin("VALIDATED", "REFUTED", "PREMATURE_EXIT", "GOOD_EXIT") | a.isin("SELL", "TRIM"), "You exited").otherwise("You acted")
    )
    return F.when(price.isNull(), verb).otherwise(F.concat(verb, F.format_string(" at %.2f", price)))


#: What follows the move in a case's summary, and the frame of the prompt text.
ENDINGS = {
    "MISSED_ENTRY": "Lesson: Should have entered with PROBE conviction.", "GOOD_ENTRY": "Entry was correct.",
    "PREMATURE_EXIT": "Exit was premature; protect strong structures from fear-driven selling.", "GOOD_EXIT": "Exit was correct; risk control saved capital.",
    "CORRECT_WAIT": "Patience was correct.", "VALIDATED": "Exit was correct.", "BAD_ENTRY": "The action was premature.", "REFUTED": "The action was premature.",
}
HEAD = [
    "## 📋 Case Memory (Outcome-Validated)", "These are past decisions validated before today against actual market outcomes.",
    "Use them as calibration, not as commands.\n",
]
FOOT = (
    '⚠️ Memory is calibration, not truth. A past SKIP is "correct" only if the subsequent path did NOT offer a risk-adjusted entry. '
    "Today's market structure decides everything."
)


def rounded(x: Column, digits: int) -> Column:
    """A double to some digits as SQL engines in C round it: scaled first, then half away from zero; ``F.round`` rounds its shortest decimal text, so 26.549999999999997 would give 26.5 instead of 26.6."""
    return F.round(x * 10.0**digits) / 10.0**digits


def summary(verdict: Column, price: Column, pnl: Column, lesson: Column) -> Column:
    """What came of a case: its move over 10 days (or its lesson, if unknown) and an ending by verdict."""
    lesson = F.trim(F.coalesce(lesson, F.lit("")))
    move = F.concat(F.lit("Price "), F.when(pnl >= 0, "rose").otherwise("fell"), F.format_string(" to %.2f (", price), F.format_string("%+.0f%%", F.bround(pnl)), F.lit(") in 10 days."))
    move = F.when(price.isNotNull() & pnl.isNotNull(), move).otherwise(lesson)
    endings = [F.when(verdict == v, F.concat(move, F.lit(" " + x))) for v, x in ENDINGS.items()]
    return F.coalesce(*endings, F.when(lesson != "", lesson).otherwise(move))


def case_block(found: DataFrame) -> DataFrame:
    """Retrieved cases (verdict, journal_date, action, price, verdict_price, pnl_pct, lesson) as one prompt text, the latest first; empty without any."""
    head = F.concat(F.lit("**["), F.coalesce("verdict", F.lit("CASE")), F.lit("] "), F.coalesce(F.col("journal_date").cast("string"), F.lit("N/A")), F.lit(" — "), title(F.col("verdict"), F.col("action"), F.col("price")), F.lit("**"))
    line = F.concat_ws("\n", head, F.concat(F.lit("> "), summary(F.col("verdict"), F.col("verdict_price"), F.col("pnl_pct"), F.col("lesson"))), F.lit(""))
    order = F.sort_array(F.collect_list(F.struct("journal_date", "verdict", line.alias("line"))), asc=False)
    lines = F.transform(order, lambda x: x["line"])
    frame = [F.array(*[F.lit(x) for x in HEAD]), lines, F.array(F.lit(FOOT))]
    return found.agg(F.when(F.count("*") > 0, F.array_join(F.concat(*frame), "\n")).otherwise("").alias("block"))


def regrets(trades: DataFrame, top: int = 3) -> DataFrame:
    """Trades that ran far ahead and gave much back, the last ones by day."""
    return trades.filter("mfe_pct > 15 and regret_pct > 10").orderBy(F.desc("day"), "id").limit(top)


def past_self(journals: DataFrame) -> DataFrame:
    """Journals as one prompt text, 500 characters of each."""
    line = F.concat(F.lit("["), F.col("day").cast("string"), F.lit("] "), F.substring("journal", 1, 500))
    return journals.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("day", "id", line.alias("line"))), asc=False), lambda x: x["line"]), "\n").alias("block"))


def latest_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
