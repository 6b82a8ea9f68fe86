"""Rules of a trading day: when to ask for a decision, and what cooldowns forbid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bars

#: Bars after a sale without a new entry, and after a trim without an addition.
SALE_COOLDOWN, TRIM_COOLDOWN = 3, 5
#: Convictions that enter a position.
ENTRIES = ("PROBE", "HIGH", "MAX")
#: Marks of a structure point that stand for none, and the side that warns.
NO_POINT, SELL_SIDE = ["none", "unknown"], "卖"


def wake(x: dict[str, Column]) -> Column:
    """Whether a day asks for a decision.

    x: adx, watch_hit, skip_on_flat, shares, exited, trend_locked, grade, close, ma20, side,
    change_pct, threshold, signal_changed, last_point, is_ready, compression, squeezed,
    volume_ratio, prev_adx.  Without an ADX nothing wakes; a watchpoint always does.  With a
    position it takes an exited shield or two signs of damage; without one, any strength.
    A long silence alone is noted by the caller but does not wake.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    number = lambda c: F.coalesce(c, F.lit(0.0))
    grade = F.coalesce(x["grade"], F.lit("C"))
    signs = [(grade == "C") & ~yes(x["trend_locked"]), (x["close"] < x["ma20"]) & (x["ma20"] > 0), x["side"] == SELL_SIDE]
    damage = sum((yes(s).cast("int") for s in signs), F.lit(0))
    strength = [
        grade.isin("S", "A", "B"), F.abs(x["change_pct"]) > x["threshold"], x["signal_changed"], x["last_point"].isNotNull() & ~x["last_point"].isin(NO_POINT),
        x["is_ready"], (number(x["compression"]) >= 4) & yes(x["squeezed"]), number(x["volume_ratio"]) >= 1.5, (x["adx"] > 20) & (x["prev_adx"] <= 20) & (x["prev_adx"] > 0),
    ]
    strong = F.lit(False)
    for s in strength:
        strong = strong | yes(s)
    held = yes(x["exited"]) | (damage >= 2)
    return F.when(number(x["adx"]) == 0, False).when(yes(x["watch_hit"]) | ~yes(x["skip_on_flat"]), True).otherwise(F.when(number(x["shares"]) > 0, held).otherwise(strong))


def since_last(df: DataFrame, keys: list[str], order: str, event: Column, name: str) -> DataFrame:
    """Adds the bars since the last earlier event of the series; NULL before the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("__i", F.row_number().over(w))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.col("__i") - F.last(F.when(event, F.col("__i")), ignorenulls=True).over(before)).drop("__i")


def after_sale(conviction: Column, shares: Column, bars_since_sale: Column, grade: Column) -> Column:
    """The conviction that stands: an entry soon after a sale becomes SKIP unless the grade is S."""
    entry = conviction.isin(*ENTRIES) & (shares == 0)
    blocked = entry & (bars_since_sale <= SALE_COOLDOWN) & (F.coalesce(grade, F.lit("C")) != "S")
    return F.when(F.coalesce(blocked, F.lit(False)), "SKIP").otherwise(conviction)


def after_trim(action: Column, bars_since_trim: Column) -> Column:
    """The action that stands: an addition soon after a trim becomes HOLD."""
    return F.when(F.coalesce((action == "ADD") & (bars_since_trim <= TRIM_COOLDOWN), F.lit(False)), "HOLD").otherwise(action)


def history(df: DataFrame, keys: list[str], order: str, value: str, size: int, name: str) -> DataFrame:
    """Adds the last ``size`` values of the series, the current one last."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - size, 0)
    return df.withColumn(name, F.collect_list(value).over(w))


#: Fixed value: days without a call after which a heartbeat is noted.
HEARTBEAT = 5
#: Closes that a day carries along.
PAST = 5
#: What the fold of days reads and gives; ``due_exited`` and ``due`` are the wake rule with and without an exited shield.
DAY = "symbol string, at timestamp, shares double, cost double, close double, ma20 double, grade string, atr_pct double, action string, conviction string, watching boolean, due_exited boolean, due boolean"
FOLDED = f"symbol string, at timestamp, kind string, {bars.SHIELD}, wake boolean, silent long, note string, conviction string, action string, past array<double>"


def due(x: dict[str, Column]) -> tuple[Column, Column]:
    """The wake rule for either state of the shield, so that only the choice between them needs the days before."""
    return wake(x | {"exited": F.lit(True)}).alias("due_exited"), wake(x | {"exited": F.lit(False)}).alias("due")


def note(silent: Column, watching: Column) -> Column:
    """A long silence without watchpoints is noted; it does not wake."""
    return F.when((silent >= HEARTBEAT) & ~F.coalesce(watching, F.lit(False)), "heartbeat")


def fold(df: DataFrame) -> DataFrame:
    """Rows of DAY to days of FOLDED: the shield, whether the day wakes, the days without a call before it, cooldowns and history.

    All state is in windows over the days of a symbol; the stream form carries it in keyed state.
    """
    w = Window.partitionBy("symbol").orderBy("at")
    d = bars.with_shield(df, "symbol", "at").withColumn("wake", F.coalesce(F.when(F.col("shield") == "EXITED", F.col("due_exited")).otherwise(F.col("due")), F.lit(False)))
    d = d.withColumn("__i", F.row_number().over(w))
    d = d.withColumn("silent", (F.col("__i") - 1 - F.coalesce(F.max(F.when(F.col("wake"), F.col("__i"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("long"))
    for event, name in (("SELL", "__sale"), ("TRIM", "__trim")):
        d = since_last(d, ["symbol"], "at", F.col("action") == event, name)
    d = history(d, ["symbol"], "at", "close", PAST, "past")
    standing = {
        "conviction": after_sale(F.col("conviction"), F.coalesce("shares", F.lit(0.0)), F.col("__sale"), F.col("grade")), "action": after_trim(F.col("action"), F.col("__trim")),
        "kind": F.lit("day"), "note": note(F.col("silent"), F.col("watching")),
    }
    return d.withColumns(standing).select(*[c.split()[0] for c in FOLDED.split(", ")])


def heartbeats(folded: DataFrame, upto, days: int = HEARTBEAT) -> DataFrame:
    """(symbol, at): the moments ``days`` after a wake that no other wake has come by, as far as time has gone on."""
    w = Window.partitionBy("symbol").orderBy("at")
    # timers know milliseconds
    woken = folded.filter("wake").withColumn("at", F.date_trunc("MILLISECOND", "at")).withColumn("__next", F.lead("at").over(w)).withColumn("__due", F.col("at") + F.expr(f"INTERVAL {days} DAYS"))
    quiet = F.col("__next").isNull() | (F.col("__next") > F.col("__due"))
    return woken.filter(quiet & (F.col("__due") <= F.lit(upto))).select("symbol", F.col("__due").alias("at"))


#: What a symbol's next day needs of the days before.
STATE = "symbol string, mode string, below int, above int, d int, peak double, recent array<double>, bars long, last_wake long, last_sale long, last_trim long, beat timestamp, past array<double>"


def state_after(df: DataFrame) -> DataFrame:
    """Rows of DAY to one row of STATE per symbol: where a stream over later days starts."""
    w = Window.partitionBy("symbol").orderBy("at")
    d = fold(df).join(df.select("symbol", "at", F.col("action").alias("__action"), F.col("close").alias("__close"), "shares", "cost"), ["symbol", "at"])
    held = (F.coalesce("shares", F.lit(0.0)) > 0) & (F.coalesce("cost", F.lit(0.0)) > 0)
    d = d.withColumn("__i", F.row_number().over(w)).withColumn("__past", F.collect_list(F.struct("__close")).over(w.rowsBetween(2 - PAST, 0)))
    d = d.withColumn("__run", F.sum(F.when(held, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("symbol", "__run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # closes above 0 of a run, the last RECENT of them
    d = d.withColumn("__priced", held & (F.col("__close") > 0))
    recent = Window.partitionBy("symbol", "__run", "__priced").orderBy("at").rowsBetween(1 - bars.RECENT, 0)
    d = d.withColumn("__recent", F.when(F.col("__priced"), F.collect_list("__close").over(recent)))
    d = d.withColumn("__recent", F.coalesce(F.last("__recent", ignorenulls=True).over(run), F.array().cast("array<double>")))
    last = lambda c: F.max(F.when(c, F.col("__i")))
    of = d.groupBy("symbol").agg(
        F.max_by(F.struct("shield", "days_below", "days_above", "d_days", "peak", "__recent", "__past"), "at").alias("x"), F.count("*").alias("bars"),
        last(F.col("wake")).alias("last_wake"), last(F.col("__action") == "SELL").alias("last_sale"), last(F.col("__action") == "TRIM").alias("last_trim"), F.max(F.when(F.col("wake"), F.col("at"))).alias("__woken"), F.max("at").alias("__at"),
    )
    beat = F.date_trunc("MILLISECOND", "__woken") + F.expr(f"INTERVAL {HEARTBEAT} DAYS")
    return of.select(
        "symbol", F.col("x.shield").alias("mode"), F.col("x.days_below").alias("below"), F.col("x.days_above").alias("above"), F.col("x.d_days").alias("d"), F.col("x.peak").alias("peak"),
        F.col("x.__recent").alias("recent"), "bars", F.col("last_wake").cast("long"), F.col("last_sale").cast("long"), F.col("last_trim").cast("long"),
        F.when(beat > F.col("__at"), beat).alias("beat"), F.col("x.__past.__close").alias("past"),
    )


def coverage(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, bars, first, last): what was loaded."""
    return df.groupBy(*keys).agg(F.count("*").alias("bars"), F.min(order).alias("first"), F.max(order).alias("last"))


def tallies(df: DataFrame, reason: Column) -> DataFrame:
    """(reason, n) of what was skipped; rows without a reason were not."""
    return df.select(reason.alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def bar_at(df: DataFrame, keys: list[str], time: Column, day: Column, order: str, wanted: str) -> DataFrame:
    """(keys, at): the last bar whose time holds the wanted text, else the last of its day."""
    hit, same = F.contains(time, F.lit(wanted)), day.cast("string") == wanted[:10]
    return df.groupBy(*keys).agg(F.coalesce(F.max(F.when(hit, F.col(order))), F.max(F.when(same, F.col(order)))).alias("at"))


def train_rows(df: DataFrame, cohort: str, first, last, day: str = "as_of_date") -> DataFrame:
    """Rows of one normalisation cohort within the training days, both included."""
    return df.filter((F.coalesce("cohort", F.lit("")) == cohort) & F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def train_end(df: DataFrame, cohort: str, day: str = "as_of_date"):
    """The last training day of a cohort; None for an empty one.  One value comes to the driver."""
    return df.filter(F.coalesce("cohort", F.lit("")) == cohort).agg(F.max(day)).first()[0]


def merged(train: DataFrame, more: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both tables, those of a key in one list: training rows first, then the others, each in their order.

    ``place`` counts from 0 within a key; keys of one side alone stay.  Lists stay rows, so a key
    may have any number of them.  Rows of equal order keep that of their other columns.
    """
    both = train.withColumn("part", F.lit(0)).unionByName(more.withColumn("part", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "part", order)]
    w = Window.partitionBy(key).orderBy("part", order, *rest)
    return both.withColumn("place", F.row_number().over(w) - 1)


#: Milliseconds and agreement that an encoder must reach.
GO_MS, CAVEAT_MS, STABLE = 500, 2000, 0.999


def feasibility(mean_ms: Column, cosine: Column) -> Column:
    """Whether an encoder can be used: by its latency, and by how well repeated runs agree."""
    speed = F.when(mean_ms < GO_MS, "GO").when(mean_ms < CAVEAT_MS, "GO_WITH_CAVEATS").otherwise("NO_GO")
    return F.struct(speed.alias("verdict"), (cosine > STABLE).alias("stable"))
