"""Ordered computation over price bars: calendars, forward outcomes, trailing windows, indicators, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def series(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def calendar(days: DataFrame, day: str = "trade_date") -> DataFrame:
    """(trade_date, trade_idx, is_month_end) of the distinct days; the last day always ends a month.

    A calendar is one row per trading day, some thousands in all, so one task orders it.
    """
    w = Window.orderBy(day)
    following = F.lead(F.date_trunc("month", F.col(day))).over(w)
    end = F.coalesce(following != F.date_trunc("month", F.col(day)), F.lit(True))
    return days.select(day).distinct().select(day, (F.row_number().over(w) - 1).alias("trade_idx"), end.alias("is_month_end"))


def at_day(df: DataFrame, cal: DataFrame, on: str, day: str = "trade_date") -> DataFrame:
    """Adds trade_idx of exactly that day; days that are missing are dropped (no as-of)."""
    return df.join(F.broadcast(cal.select(F.col(day).alias(on), "trade_idx")), on)


def forward_return(close: Column, keys: list[str], order: str, n: int, last: bool = False) -> Column:
    """close n rows on over close now, minus 1; with ``last`` the last price stands in past the end."""
    w = series(keys, order)
    later = F.lead(close, n).over(w)
    if last:
        later = F.coalesce(later, F.last(close).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return F.try_divide(later, close) - 1


def drawdown(value: Column, keys: list[str], order: str) -> Column:
    """Fall from the running peak as a share of it."""
    peak = F.max(value).over(series(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return F.when(peak > 0, (peak - value) / peak).otherwise(0.0)


def excursions(close: Column, keys: list[str], order: str, n: int) -> tuple[Column, Column]:
    """Best and worst return of the next n rows, this one included."""
    w = series(keys, order).rowsBetween(0, n)
    return F.try_divide(F.max(close).over(w), close) - 1, F.try_divide(F.min(close).over(w), close) - 1


def trailing(columns: list[str], keys: list[str], order: str, length: int) -> Column:
    """The last ``length`` bars up to this one, oldest first; NULL for fewer than two."""
    w = series(keys, order).rowsBetween(1 - length, 0)
    rows = F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(w)
    return F.when(F.size(rows) >= 2, rows)


def extremes(high: Column, low: Column, keys: list[str], order: str, length: int = 250) -> tuple[Column, Column]:
    w = series(keys, order).rowsBetween(1 - length, 0)
    return F.max(high).over(w), F.min(low).over(w)


def fill_price(open_: Column, close: Column, keys: list[str], order: str) -> Column:
    """The next bar's open, else this close."""
    return F.coalesce(F.lead(open_).over(series(keys, order)), close)


def since(event: Column, keys: list[str], order: str) -> Column:
    """Rows since the last event before this row; NULL if there was none."""
    w = series(keys, order)
    i = F.row_number().over(w)
    last = F.last(F.when(event, i), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return i - last


def streak(df: DataFrame, condition: Column, keys: list[str], order: str, name: str) -> DataFrame:
    """Adds the number of rows in a row, this one last, for which the condition holds."""
    w = series(keys, order)
    df = df.withColumn("__c", F.coalesce(condition, F.lit(False)))
    df = df.withColumn("__g", F.sum(F.when(F.col("__c"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*keys, "__g").orderBy(order)
    return df.withColumn(name, F.sum(F.col("__c").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0))).drop("__c", "__g")


def trend_start(direction: Column, day: Column, keys: list[str], order: str) -> Column:
    """Day on which the current direction began."""
    w = series(keys, order)
    before = F.lag(direction).over(w)
    changed = before.isNull() | ~before.eqNullSafe(direction)
    return changed, day


def trend_starts(df: DataFrame, direction: str, day: str, keys: list[str], order: str, name: str = "trend_start") -> DataFrame:
    changed, at = trend_start(F.col(direction), F.col(day), keys, order)
    df = df.withColumn("__at", F.when(changed, at))
    return df.withColumn(name, F.last("__at", ignorenulls=True).over(series(keys, order).rowsBetween(Window.unboundedPreceding, 0))).drop("__at")


def unrealised(shares: Column, cost: Column, close: Column, cash: Column) -> dict[str, Column]:
    """pnl in percent, position in percent and equity."""
    equity = cash + shares * close
    return {
        "pnl_pct": F.when((shares > 0) & (cost > 0), (close / cost - 1) * 100).otherwise(0.0),
        "position_pct": F.coalesce(F.try_divide(shares * close, equity) * 100, F.lit(0.0)),
        "equity": equity,
    }


def transition_drift(df: DataFrame, vec: str, keys: list[str], order: str) -> DataFrame:
    """Adds the cosine with the previous row's vector."""
    from ..functions.vectors import cosine_soft, doubles

    before = F.lag(F.col(vec)).over(series(keys, order))
    return df.withColumn("__b", before).withColumn("drift", F.when(F.col("__b").isNotNull(), cosine_soft(doubles(F.col(vec)), doubles(F.col("__b"))))).drop("__b")


# ---- recursive indicators and state ---------------------------------------------------

INDICATORS = "rsi double, macd_line double, macd_signal double, macd_hist double, adx double, plus_di double, minus_di double, atr double, bb_pos double, volume_ratio double"


#: Steps of a recursion that one matrix product covers.
STRIDE = 64


def smooth(x, weight: float, n: int, first: int):
    """y[i] = y[i-1] + weight * (x[i] - y[i-1]), seeded with the mean of n values from position ``first``.

    STRIDE steps at a time: a triangular matrix of powers of (1 - weight) applied to the
    inputs, plus what remains of the last value before them.
    """
    import numpy as np

    out = np.full(len(x), np.nan)
    start = first + n - 1
    if start >= len(x):
        return out
    out[start] = x[first : first + n].mean()
    power = (1 - weight) ** np.arange(STRIDE + 1)
    lag = np.arange(STRIDE)[:, None] - np.arange(STRIDE)[None, :]
    matrix = np.where(lag >= 0, weight * power[np.maximum(lag, 0)], 0.0)
    for i in range(start + 1, len(x), STRIDE):
        m = min(STRIDE, len(x) - i)
        out[i : i + m] = matrix[:m, :m] @ x[i : i + m] + power[1 : m + 1] * out[i - 1]
    return out


def wilder(x, n: int, first: int):
    """Wilder smoothing."""
    return smooth(x, 1 / n, n, first)


def ema(x, n: int, first: int = 0):
    """Exponential mean with weight 2 / (n + 1)."""
    return smooth(x, 2 / (n + 1), n, first)


def indicators_of(high, low, close, volume):
    """All indicators of one series as a dict of arrays; NaN until enough bars are there."""
    import numpy as np

    n = len(close)
    with np.errstate(all="ignore"):
        step = np.diff(close, prepend=close[:1])
        gain, loss = wilder(np.maximum(step, 0), 14, 1), wilder(np.maximum(-step, 0), 14, 1)
        rsi = np.where(gain + loss > 0, 100 * gain / (gain + loss), np.where(np.isnan(gain), np.nan, 50.0))
        line = ema(close, 12) - ema(close, 26)
        signal = ema(line, 9, 25) if n >= 34 else np.full(n, np.nan)
        before = np.concatenate((close[:1], close[:-1]))
        true_range = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
        up, down = np.diff(high, prepend=high[:1]), -np.diff(low, prepend=low[:1])
        plus = np.where((up > down) & (up > 0), up, 0.0)
        minus = np.where((down > up) & (down > 0), down, 0.0)
        atr = wilder(true_range, 14, 1)
        pdi, mdi = 100 * wilder(plus, 14, 1) / atr, 100 * wilder(minus, 14, 1) / atr
        dx = np.nan_to_num(100 * np.abs(pdi - mdi) / (pdi + mdi))
        adx = wilder(dx, 14, 14)
        windows = np.lib.stride_tricks.sliding_window_view
        bb, ratio = np.full(n, np.nan), np.full(n, np.nan)
        if n >= 20:
            w = windows(close, 20)
            mid, sd = w.mean(1), w.std(1)
            bb[19:] = np.where(sd > 0, (close[19:] - (mid - 2 * sd)) / (4 * sd), np.nan)
            ratio[19:] = volume[19:] / windows(volume, 20).mean(1)
    return {"rsi": rsi, "macd_line": line, "macd_signal": signal, "macd_hist": line - signal, "adx": adx, "plus_di": pdi, "minus_di": mdi, "atr": atr, "bb_pos": bb, "volume_ratio": ratio}


def indicators(df: DataFrame, key: str, order: str) -> DataFrame:
    """RSI, MACD, ADX, ATR, Bollinger position and volume ratio of every bar.

    Series come one after the other in sorted partitions; each is one slice of arrays.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [c.split()[0] for c in INDICATORS.split(", ")]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def emit(table):
            keys = table.column(0).combine_chunks()
            values = [table.column(k).cast(pa.float64()).to_numpy() for k in range(2, 6)]
            text = keys.to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(text[1:] != text[:-1]) + 1), len(text)]
            parts = [indicators_of(*(v[a:b] for v in values)) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a]
            columns = [pa.array(np.concatenate([p[n] for p in parts])) for n in names]
            return pa.RecordBatch.from_arrays([keys, table.column(1).combine_chunks(), *columns], names=[key, order, *names])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            keys = table.column(0).to_numpy()
            last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if len(keys) and (keys != keys[-1]).any() else 0
            if last:
                yield emit(table.slice(0, last))
            held = table.slice(last)
        if held is not None and held.num_rows:
            yield emit(held)

    rows = df.select(key, order, "high", "low", "close", "volume").repartition(key).sortWithinPartitions(key, order)
    return rows.mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {INDICATORS}")


def volume_state(ratio: Column) -> Column:
    return F.when(ratio > 2, "heavy").when(ratio > 1.3, "above_avg").when(ratio < 0.5, "dried_up").when(ratio.isNotNull(), "normal")


def macd_state(line: Column, signal: Column) -> Column:
    hist = line - signal
    return F.when((hist > 0) & (line > signal), "bullish").when((hist < 0) & (line < signal), "bearish").when(hist.isNotNull(), "neutral")


def trend_mode(adx: Column, plus_di: Column, minus_di: Column) -> Column:
    return F.when(adx <= 25, "range").when(plus_di <= minus_di, "decline").when(adx > 35, "acceleration").when(adx.isNotNull(), "trending")


def stop(pnl_pct: Column, grade: Column) -> Column:
    """SELL below -10 %, or below -5 % with grade D; else NULL."""
    return F.when(pnl_pct < -10, "SELL").when((grade == "D") & (pnl_pct < -5), "SELL")


SHIELD = "shield string, days_below int, days_above int, d_days int, peak double"
#: Fixed values of the shield: closes below the 20-day mean, days of grade D and falls in ATR that exit or damage, closes above that recover, closes of a high.
EXIT_BELOW, EXIT_D, EXIT_ATR, DAMAGE_BELOW, DAMAGE_ATR, RECOVER_ABOVE, RECENT = 5, 3, 4, 2, 2, 3, 20


def shield_steps(rows, state: dict | None = None) -> list[tuple]:
    """The winner shield over rows of (shares, cost, close, ma20, grade, atr_pct), oldest first.

    Exits after 5 closes below the 20-day mean, 3 days of grade D or a fall from the peak of
    4 ATR; is damaged after 2 closes or 2 ATR; recovers after 3 closes above or a new
    20-day high.  No position resets it.  ``state`` is carried from batch to batch.
    """
    state = {} if state is None else state
    new = lambda: {"mode": "ACTIVE", "below": 0, "above": 0, "d": 0, "peak": 0.0, "recent": []}
    if not state:
        state.update(new())
    out = []
    for shares, cost, close, ma20, grade, atr in rows:
        if not (shares or 0) > 0 or not (cost or 0) > 0:
            state.update(new())
            out.append((state["mode"], 0, 0, 0, 0.0))
            continue
        close, ma20, atr = close or 0.0, ma20 or 0.0, atr or 0.0
        high = bool(state["recent"]) and close > max(state["recent"]) > 0
        state["peak"] = max(state["peak"], close)
        below, above = close > 0 and ma20 > 0 and close < ma20, close > 0 and ma20 > 0 and close > ma20
        state["below"] = state["below"] + 1 if below else 0
        state["above"] = state["above"] + 1 if above else 0
        state["d"] = state["d"] + 1 if (grade or "C").upper() == "D" else 0
        fall = (state["peak"] - close) / state["peak"] * 100 if close > 0 and state["peak"] > 0 else 0.0
        if (state["below"] >= EXIT_BELOW or state["d"] >= EXIT_D or atr > 0 and fall >= EXIT_ATR * atr) and state["mode"] != "EXITED":
            state["mode"] = "EXITED"
        elif state["mode"] == "DAMAGED" and (state["above"] >= RECOVER_ABOVE or high):
            state["mode"] = "ACTIVE"
        elif state["mode"] == "ACTIVE" and (state["below"] >= DAMAGE_BELOW or atr > 0 and fall >= DAMAGE_ATR * atr):
            state["mode"] = "DAMAGED"
        if close > 0:
            state["recent"] = [*state["recent"], close][-RECENT:]
        out.append((state["mode"], state["below"], state["above"], state["d"], float(state["peak"])))
    return out


def with_shield(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds the columns of SHIELD to rows with shares, cost, close, ma20, grade and atr_pct, by windows alone.

    A run is a position from its first day to its last.  Within it all counts are streaks; an
    exit stands for good.  Before it, a day that only damages or only recovers sets the mode,
    and one that does both turns it over: the mode is the last set one, turned as often as days
    since then did both.
    """
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    held = (number("shares") > 0) & (number("cost") > 0)
    series = Window.partitionBy(key).orderBy(order)
    run = Window.partitionBy(key, "__run", "__held").orderBy(order)
    d = df.withColumn("__held", held).withColumn("__run", F.sum(F.when(F.col("__held"), 0).otherwise(1)).over(series.rowsBetween(Window.unboundedPreceding, 0)))
    close, ma20, atr = number("close"), number("ma20"), number("atr_pct")
    priced = (close > 0) & (ma20 > 0)
    flags = {"below": priced & (close < ma20), "above": priced & (close > ma20), "d": F.upper(F.coalesce(F.col("grade"), F.lit("C"))) == "D"}
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__i", F.row_number().over(run))
    for name, flag in flags.items():
        d = d.withColumn(f"__{name}", (F.col("__i") - F.coalesce(F.max(F.when(~flag, F.col("__i"))).over(upto), F.lit(0))).cast("int"))
    d = d.withColumn("__peak", F.max(F.greatest(close, F.lit(0.0))).over(upto)).withColumn("__priced", close > 0)
    recent = Window.partitionBy(key, "__run", "__held", "__priced").orderBy(order).rowsBetween(-RECENT, -1)
    high = F.col("__priced") & (close > F.max(close).over(recent))
    fall = F.when((close > 0) & (F.col("__peak") > 0), (F.col("__peak") - close) / F.col("__peak") * 100).otherwise(0.0)
    far = lambda times: (atr > 0) & (fall >= times * atr)
    d = d.withColumn("__exit", F.max((F.col("__below") >= EXIT_BELOW) | (F.col("__d") >= EXIT_D) | far(EXIT_ATR)).over(upto))
    d = d.withColumn("__damage", (F.col("__below") >= DAMAGE_BELOW) | far(DAMAGE_ATR)).withColumn("__recover", (F.col("__above") >= RECOVER_ABOVE) | F.coalesce(high, F.lit(False)))
    d = d.withColumn("__turns", F.count_if(F.col("__damage") & F.col("__recover")).over(upto))
    d = d.withColumn("__set", F.last(F.when(F.col("__damage") != F.col("__recover"), F.struct("__damage", "__turns")), ignorenulls=True).over(upto))
    turned = (F.col("__turns") - F.coalesce(F.col("__set.__turns"), F.lit(0))) % 2 == 1
    damaged = F.coalesce(F.col("__set.__damage"), F.lit(False)) != turned
    mode = F.when(~F.col("__held"), "ACTIVE").when(F.col("__exit"), "EXITED").when(damaged, "DAMAGED").otherwise("ACTIVE")
    of = lambda c: F.when(F.col("__held"), F.col(c)).otherwise(0)
    shown = [mode.alias("shield"), of("__below").cast("int").alias("days_below"), of("__above").cast("int").alias("days_above"), of("__d").cast("int").alias("d_days"), of("__peak").cast("double").alias("peak")]
    return d.select(*df.columns, *shown)


def shield(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order) and the columns of SHIELD."""
    return with_shield(df, key, order).select(key, order, *[c.split()[0] for c in SHIELD.split(", ")])
