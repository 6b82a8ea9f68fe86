"""The rules of a trading day, folded over the days of a symbol: in windows, and as a stream with keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars, episode
from ..sources.scratch import Tables
from ..streaming import episodes
from .bindings import table

QUERIES, SQL = {}, {}

#: Events as days of a symbol with position, indicators and what the wake rule reads.
DAYS = """
SELECT CAST(user_id AS STRING) AS symbol, ts,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN (day(ts) + user_id) % 12 < 9 THEN 1.0 ELSE 0.0 END AS shares, 50.0 AS cost,
  CASE WHEN event_id % 61 = 0 THEN NULL WHEN event_id % 67 = 0 THEN 0.0 ELSE 40.0 + (event_id * 37) % 21 END AS close,
  CASE WHEN event_id % 53 = 0 THEN NULL ELSE 45.0 + day(ts) / 3 END AS ma20,
  CASE (event_id * 7) % 10 WHEN 0 THEN 'S' WHEN 1 THEN 'A' WHEN 2 THEN 'D' WHEN 3 THEN 'd' WHEN 4 THEN NULL ELSE 'C' END AS grade,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0.0 WHEN 2 THEN 12.0 ELSE 7.0 END AS atr_pct,
  CASE event_id % 6 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' WHEN 2 THEN 'WAIT' WHEN 3 THEN 'HOLD' WHEN 4 THEN 'TRIM' ELSE 'ADD' END AS action,
  CASE event_id % 7 WHEN 0 THEN 'PROBE' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MAX' WHEN 3 THEN 'SKIP' ELSE 'FULL' END AS conviction,
  event_id % 3 = 0 AS watching, CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE CAST(event_id % 40 AS DOUBLE) END AS adx,
  CAST((event_id * 3) % 40 AS DOUBLE) AS prev_adx, event_id % 30 = 0 AS watch_hit, event_id % 41 <> 0 AS skip_on_flat,
  event_id % 3 = 0 AS trend_locked, CASE event_id % 17 WHEN 0 THEN '卖' WHEN 1 THEN '买' END AS side, CAST(event_id % 19 AS DOUBLE) - 10 AS change_pct,
  event_id % 29 = 0 AS signal_changed, CASE event_id % 16 WHEN 0 THEN 'T1' WHEN 1 THEN 'none' WHEN 2 THEN 'unknown' END AS last_point,
  event_id % 23 = 0 AS is_ready, CAST(event_id % 7 AS DOUBLE) AS compression, event_id % 25 = 0 AS squeezed, CAST(event_id % 16 AS DOUBLE) / 10 AS volume_ratio
FROM events
"""
#: Where the ranges of days end that come to the stream one after the other, and where a resumed one starts.
RANGES, RESUME = ("2024-01-11", "2024-01-21", "2024-02-01"), "2024-01-16"


def days(spark, sf):
    """Rows of episode.DAY."""
    d = spark.sql(DAYS.replace("FROM events", "FROM {e}"), e=table(spark, sf, "events"))
    due = episode.due({c: F.col(c) for c in d.columns} | {"threshold": F.lit(8.0)})
    d = d.withColumn("at", F.col("ts").cast("timestamp")).select("*", *due)
    return d.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in episode.DAY.split(", ")])


def shown(folded):
    ms = F.unix_millis("at").alias("at_ms")
    past = [F.size("past").cast("long").alias("past_n"), F.array_join(F.transform("past", lambda x: F.round(x).cast("long").cast("string")), ",").alias("past")]
    return folded.filter("kind = 'day'").select("symbol", ms, "shield", *[F.col(c).cast("long").alias(c) for c in ("days_below", "days_above", "d_days")], "peak", "wake", "silent", "note", "conviction", "action", *past)


QUERIES["win7_winner_shield"] = lambda s, d: bars.shield(days(s, d), "symbol", "at").select("symbol", F.unix_millis("at").alias("at_ms"), "shield", *[F.col(c).cast("long").alias(c) for c in ("days_below", "days_above", "d_days")], "peak")

#: The fold as recursion over the days of a symbol, one day a step: independent of the windows of the operator.
FOLD = f"""
WITH RECURSIVE days AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, coalesce(shares, 0) > 0 AND cost > 0 AS held, coalesce(close, 0)::DOUBLE AS c, coalesce(ma20, 0)::DOUBLE AS m, coalesce(atr_pct, 0)::DOUBLE AS atr,
    CASE WHEN coalesce(adx, 0) = 0 THEN 0 WHEN watch_hit OR NOT skip_on_flat THEN 3 WHEN coalesce(shares, 0) > 0 THEN
      CASE WHEN ((coalesce(grade, 'C') = 'C' AND NOT trend_locked)::INT + coalesce(close < ma20 AND ma20 > 0, FALSE)::INT + coalesce(side = '卖', FALSE)::INT) >= 2 THEN 3 ELSE 2 END
    WHEN coalesce(grade, 'C') IN ('S', 'A', 'B') OR abs(change_pct) > 8 OR signal_changed OR coalesce(last_point NOT IN ('none', 'unknown'), FALSE) OR is_ready OR (compression >= 4 AND squeezed) OR volume_ratio >= 1.5
      OR (adx > 20 AND prev_adx <= 20 AND prev_adx > 0) THEN 3 ELSE 0 END AS wakes  -- 3: wakes, 2: wakes if the shield is exited
  FROM ({DAYS})
), steps AS (
  SELECT symbol, 0::BIGINT AS i, 'ACTIVE' AS mode, 0::BIGINT AS below, 0::BIGINT AS above, 0::BIGINT AS d, 0::DOUBLE AS peak, []::DOUBLE[] AS recent, FALSE AS wake, 0::BIGINT AS silent, NULL::BIGINT AS sale, NULL::BIGINT AS trim_,
    []::DOUBLE[] AS past FROM days WHERE i = 1
  UNION ALL
  SELECT symbol, i, CASE WHEN wiped THEN 'ACTIVE' WHEN out_ AND mode <> 'EXITED' THEN 'EXITED' WHEN mode = 'DAMAGED' AND back THEN 'ACTIVE' WHEN mode = 'ACTIVE' AND hurt THEN 'DAMAGED' ELSE mode END AS mode, below, above, d, peak,
    CASE WHEN wiped THEN [] WHEN c > 0 THEN list_append(recent, c)[-20:] ELSE recent END, wakes = 3 OR (wakes = 2 AND CASE WHEN out_ OR mode = 'EXITED' THEN NOT wiped ELSE FALSE END), silent, sale, trim_, past
  FROM (
    SELECT *, below >= 5 OR d >= 3 OR (atr > 0 AND fall >= 4 * atr) AS out_, above >= 3 OR high AS back, below >= 2 OR (atr > 0 AND fall >= 2 * atr) AS hurt FROM (
      SELECT *, CASE WHEN c > 0 AND peak > 0 THEN (peak - c) / peak * 100 ELSE 0 END AS fall FROM (
        SELECT y.symbol, y.i, s.mode, NOT y.held AS wiped, y.c, y.atr, y.wakes, s.recent,
          CASE WHEN y.held AND y.c > 0 AND y.m > 0 AND y.c < y.m THEN s.below + 1 ELSE 0 END AS below, CASE WHEN y.held AND y.c > 0 AND y.m > 0 AND y.c > y.m THEN s.above + 1 ELSE 0 END AS above,
          CASE WHEN y.held AND upper(coalesce(y.grade, 'C')) = 'D' THEN s.d + 1 ELSE 0 END AS d, CASE WHEN y.held THEN greatest(s.peak, y.c) ELSE 0 END AS peak,
          len(s.recent) > 0 AND y.c > list_max(s.recent) AS high, CASE WHEN s.wake OR y.i = 1 THEN 0 ELSE s.silent + 1 END AS silent,
          CASE WHEN p.action = 'SELL' THEN 1 ELSE s.sale + 1 END AS sale, CASE WHEN p.action = 'TRIM' THEN 1 ELSE s.trim_ + 1 END AS trim_, list_append(s.past, y.close::DOUBLE)[-5:] AS past
        FROM steps s JOIN days y ON y.symbol = s.symbol AND y.i = s.i + 1 LEFT JOIN days p ON p.symbol = s.symbol AND p.i = s.i
      )
    )
  )
), folded AS (
  SELECT f.symbol, epoch_us(y.ts) // 1000 AS at_ms, f.mode AS shield, f.below AS days_below, f.above AS days_above, f.d AS d_days, f.peak, f.wake, f.silent, CASE WHEN f.silent >= 5 AND NOT y.watching THEN 'heartbeat' END AS note,
    CASE WHEN y.conviction IN ('PROBE', 'HIGH', 'MAX') AND coalesce(y.shares, 0) = 0 AND coalesce(f.sale <= 3, FALSE) AND coalesce(y.grade, 'C') <> 'S' THEN 'SKIP' ELSE y.conviction END AS conviction,
    CASE WHEN y.action = 'ADD' AND coalesce(f.trim_ <= 5, FALSE) THEN 'HOLD' ELSE y.action END AS action, len(list_filter(f.past, lambda x: x IS NOT NULL)) AS past_n,
    array_to_string(list_transform(list_filter(f.past, lambda x: x IS NOT NULL), lambda x: CAST(round(x) AS BIGINT)::VARCHAR), ',') AS past, date_trunc('millisecond', y.ts) AS ts
  FROM steps f JOIN days y ON y.symbol = f.symbol AND y.i = f.i
)
"""
COLUMNS = "symbol, at_ms, shield, days_below, days_above, d_days, peak, wake, silent, note, conviction, action, past_n, past"
SQL["win7_winner_shield"] = FOLD + "SELECT symbol, at_ms, shield, days_below, days_above, d_days, peak FROM folded"
QUERIES["str2_day_fold"] = lambda s, d: shown(episode.fold(days(s, d)))
SQL["str2_day_fold"] = FOLD + f"SELECT {COLUMNS} FROM folded"


def streamed(spark, sf):
    """The days as they come, a range a run: every run starts from the state that the one before has left."""
    d, tables = days(spark, sf), Tables(spark, "days")
    for before, end in zip(("2000-01-01", *RANGES[:-1]), RANGES, strict=True):
        d.filter((F.col("at") >= F.lit(before).cast("timestamp")) & (F.col("at") < F.lit(end).cast("timestamp"))).write.mode("append").parquet(f"{tables.root}/in")
        episodes.run_days(spark, f"{tables.root}/in", f"{tables.root}/out", f"{tables.root}/state")
    return spark.read.schema(episode.FOLDED).parquet(f"{tables.root}/out")


def with_beats(folded):
    """Days, and a row for each heartbeat whose other columns are empty."""
    empty = {"shield": "heartbeat", "peak": 0.0, "wake": False, "note": "heartbeat"} | dict.fromkeys(("conviction", "action", "past"), "")
    longs = [F.lit(0).cast("long").alias(c) for c in ("days_below", "days_above", "d_days", "silent", "past_n")]
    beats = folded.filter("kind = 'heartbeat'").select("symbol", F.unix_millis("at").alias("at_ms"), *[F.lit(x).alias(c) for c, x in empty.items()], *longs)
    return shown(folded).unionByName(beats)


QUERIES["str3_day_stream"] = lambda s, d: with_beats(streamed(s, d))
SQL["str3_day_stream"] = FOLD + f"""
, woken AS (SELECT symbol, ts + INTERVAL 5 DAYS AS due, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS next FROM folded WHERE wake)
SELECT {COLUMNS} FROM folded
UNION ALL SELECT symbol, epoch_us(due) // 1000, 'heartbeat', 0, 0, 0, 0, FALSE, 0, 'heartbeat', '', '', 0, '' FROM woken WHERE (next IS NULL OR next > due) AND due <= (SELECT max(ts) FROM folded)
"""


def resumed(spark, sf):
    """A batch over the first days gives the state that a stream over the later ones starts from."""
    d, tables = days(spark, sf), Tables(spark, "resumed")
    early = F.col("at") < F.lit(RESUME).cast("timestamp")
    d.filter(~early).write.parquet(f"{tables.root}/in")
    start = tables.write(episode.state_after(d.filter(early)), "start")
    episodes.run_days(spark, f"{tables.root}/in", f"{tables.root}/out", f"{tables.root}/state", start)
    return shown(spark.read.schema(episode.FOLDED).parquet(f"{tables.root}/out"))


QUERIES["str6_resumed_days"] = resumed
SQL["str6_resumed_days"] = FOLD + f"SELECT {COLUMNS} FROM folded WHERE ts >= TIMESTAMP '{RESUME}'"
