"""The day rules over a stream: one keyed processor with typed state and a timer."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import bars, episode

OUT = f"symbol string, day string, {bars.SHIELD}"


def shield_stream(rows: DataFrame) -> DataFrame:
    """The winner shield over a stream of (symbol, day, shares, cost, close, ma20, grade, atr_pct).

    The state is one small JSON text per symbol; days of a batch are taken in order, so a
    stream over the days gives what the batch form gives.
    """
    import pandas as pd

    def step(key, frames, state):
        kept = json.loads(state.get[0]) if state.exists else {}
        pdf = pd.concat(list(frames)).sort_values("day", kind="stable")
        out = bars.shield_steps(pdf[["shares", "cost", "close", "ma20", "grade", "atr_pct"]].itertuples(index=False, name=None), kept)
        state.update((json.dumps(kept),))
        found = pd.DataFrame(out, columns=[c.split()[0] for c in bars.SHIELD.split(", ")])
        yield pd.concat([pd.DataFrame({"symbol": [key[0]] * len(pdf), "day": pdf["day"].astype(str).to_numpy()}), found], axis=1)

    return rows.groupBy("symbol").applyInPandasWithState(step, OUT, "state string", "append", "NoTimeout")


NAMES = [c.split()[0] for c in episode.FOLDED.split(", ")]
MODES = ("mode", "below", "above", "d", "peak")
BEAT_MS = episode.HEARTBEAT * 86_400_000


#: What the processor keeps of a symbol, as one value: a key costs one read and one write of state a batch.
KEPT = "mode string, below int, above int, d int, peak double, recent array<double>, bars long, last_wake long, last_sale long, last_trim long, past array<double>, beat long"
#: Rows of episode.FOLDED whose moment is in microseconds, so that no row passes through a time zone.
FOLDED_US = episode.FOLDED.replace("at timestamp", "at long")
FOLDED_ROW = Row(*NAMES)


def _known(x):
    return None if x is None or x != x else x


class Days(StatefulProcessor):
    """Folds the days of a symbol as ``episode.fold`` does, from batch to batch.

    State: one typed value (KEPT) with the shield and its recent closes, counters of bars,
    calls, sales and trims, the last closes and the moment a heartbeat is due.  A call sets a
    timer HEARTBEAT days ahead and takes back the one before; if it fires, or a later day
    arrives first, one row of kind 'heartbeat' is given, which wakes nothing.  Rows come and
    go as rows, not as a frame for each key: a symbol brings few days a batch.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", KEPT)

    @staticmethod
    def _beat(symbol: str, at_ms: int) -> Row:
        known = {"symbol": symbol, "at": at_ms * 1000, "kind": "heartbeat", "note": "heartbeat"}
        return FOLDED_ROW(*[known.get(n) for n in NAMES])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState
        lists = [[_known(x) for x in r[c]] for c in ("recent", "past")]
        self.kept.update((*(r[c] for c in MODES), lists[0], r["bars"], *(r[c] or 0 for c in ("last_wake", "last_sale", "last_trim")), lists[1], r["beat"]))
        if r["beat"] is not None:
            self.handle.registerTimer(r["beat"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        days, before = sorted(rows, key=lambda r: r["us"]), self.kept.get()
        kept, (n, wake, sale, trim), past, beat = {}, (0, 0, 0, 0), [], None
        if before is not None:
            kept = dict(zip((*MODES, "recent"), before[:6], strict=True)) | {"recent": list(before[5] or [])}
            (n, wake, sale, trim), past, beat = before[6:10], list(before[10] or []), before[11]
        first_beat, out = beat, []
        shields = bars.shield_steps([(_known(r["shares"]), _known(r["cost"]), _known(r["close"]), _known(r["ma20"]), r["grade"], _known(r["atr_pct"])) for r in days], kept)
        for r, shield in zip(days, shields, strict=True):
            at, shares = r["us"] // 1000, _known(r["shares"])
            n += 1
            if beat is not None and beat < at:  # the day comes before the timer could fire
                out.append(self._beat(key[0], beat))
                beat = None
            due = r["due_exited"] if shield[0] == "EXITED" else r["due"]
            called, silent = bool(due), n - 1 - wake
            past = [*past, _known(r["close"])][-episode.PAST :]
            grade = r["grade"] if r["grade"] is not None else "C"
            entry = r["conviction"] in episode.ENTRIES and not shares
            conviction = "SKIP" if entry and sale and n - sale <= episode.SALE_COOLDOWN and grade != "S" else r["conviction"]
            action = "HOLD" if r["action"] == "ADD" and trim and n - trim <= episode.TRIM_COOLDOWN else r["action"]
            noted = "heartbeat" if silent >= episode.HEARTBEAT and not r["watching"] else None
            out.append(FOLDED_ROW(key[0], r["us"], "day", *shield, called, silent, noted, conviction, action, [x for x in past if x is not None]))
            if called:
                wake, beat = n, at + BEAT_MS
            sale, trim = n if r["action"] == "SELL" else sale, n if r["action"] == "TRIM" else trim
        self.kept.update((*(kept[c] for c in MODES[:4]), float(kept["peak"]), [float(x) for x in kept["recent"]], n, wake, sale, trim, past[-(episode.PAST - 1) :], beat))
        if beat != first_beat:
            if first_beat is not None:
                self.handle.deleteTimer(first_beat)
            if beat is not None:
                self.handle.registerTimer(beat)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, kept = expiredTimerInfo.getExpiryTimeInMs(), self.kept.get()
        if kept is None or kept[11] != at:
            return iter(())
        self.kept.update((*kept[:11], None))
        return iter([self._beat(key[0], at)])

    def close(self) -> None:
        pass


STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """Typed state needs the RocksDB store; a query keeps the setting that it starts with."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def fold_stream(rows: DataFrame, start: DataFrame | None = None, delay: str = "0 seconds") -> DataFrame:
    """Rows of episode.DAY to rows of episode.FOLDED; ``start``: rows of episode.STATE from a batch over earlier days.

    Days must arrive in order, up to the delay; later ones are dropped by the watermark.
    """
    initial = start.withColumn("beat", F.unix_millis("beat")).groupBy("symbol") if start is not None else None
    days = rows.withWatermark("at", delay).withColumn("us", F.unix_micros("at")).groupBy("symbol")
    folded = days.transformWithState(statefulProcessor=Days(), outputStructType=FOLDED_US, outputMode="Append", timeMode="EventTime", initialState=initial)
    return folded.withColumn("at", F.timestamp_micros("at"))


def run_days(spark: SparkSession, source: str, out: str, checkpoint: str, start: DataFrame | None = None) -> None:
    """Folds the day files of a folder that are new to the checkpoint and appends to a table; the next call goes on where this one ended."""
    with keyed_state(spark):
        rows = spark.readStream.schema(episode.DAY).parquet(source)
        fold_stream(rows, start).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
