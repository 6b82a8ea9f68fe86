"""The driver's tables in the roles of the operators' inputs.

Each binding exists once as a query in SQL that Spark and DuckDB both read, so a query and
its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Embeddings as patterns: the id is the bar index, the label the symbol.
PATTERNS = """
SELECT vec_id AS id, vec_id AS pattern_id, CAST(label AS STRING) AS symbol, vec_id AS idx, vec_id AS trade_idx, '' AS cohort, embedding AS vec,
  CASE WHEN vec_id % 11 = 0 THEN NULL WHEN label % 3 = 0 THEN 'true_S' WHEN label % 3 = 1 THEN 'stale_S' ELSE 'false_trap' END AS label_T10,
  CASE WHEN vec_id % 3 = 0 THEN 'true_S' WHEN vec_id % 3 = 1 THEN 'stale_S' ELSE 'false_trap' END AS label_T20,
  CAST((vec_id * 7) % 61 AS DOUBLE) - 20.0 AS fwd_return_T10, CAST((vec_id * 3) % 41 AS DOUBLE) - 20.0 AS fwd_return_T20,
  0.0 - CAST((vec_id * 5) % 17 AS DOUBLE) AS mae_T10, 0.0 - CAST(vec_id % 13 AS DOUBLE) AS mae_T5,
  CASE vec_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'bull' WHEN 2 THEN 'bear' ELSE 'range' END AS market_regime,
  CASE vec_id % 5 WHEN 0 THEN 'S' WHEN 1 THEN 'A' WHEN 2 THEN 'B+' WHEN 3 THEN 'B' ELSE 'C' END AS v8_grade,
  CAST((vec_id * 13) % 101 AS DOUBLE) AS v8_score, vec_id % 2 AS spring_launch, CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END AS chan_divergence_flag,
  CASE WHEN vec_id % 6 = 0 THEN NULL ELSE 'T1' END AS chan_bsp_types, CAST('2024-01-01' AS DATE) + CAST(vec_id % 700 AS INT) AS as_of_date
FROM embeddings
"""

#: Events as daily bars of a user.
BARS = """
SELECT user_id AS symbol, CAST(ts AS DATE) AS day, min_by(value, event_id) AS open, max_by(value, event_id) AS close, max(value) AS high, min(value) AS low, count(*) AS volume
FROM events WHERE value > 0 GROUP BY user_id, CAST(ts AS DATE)
"""

#: Events as a decision ledger; every event is a decision of its user's run.
LEDGER = """
SELECT event_id AS id, 'S' || CAST(user_id AS STRING) || '_r' AS run_id, user_id AS symbol, CAST(ts AS DATE) AS day, event_id AS day_index, value AS close,
  CASE event_id % 6 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' WHEN 2 THEN 'WAIT' WHEN 3 THEN 'HOLD' WHEN 4 THEN 'TRIM' ELSE 'ADD' END AS action,
  CASE event_id % 4 WHEN 0 THEN 'SKIP' WHEN 1 THEN 'FULL' ELSE 'PROBE' END AS conviction,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'Strong trend, I missed the breakout' WHEN 3 THEN 'nervous but patient' ELSE 'acceleration; all-in on momentum' END AS journal,
  CAST(event_id % 3 AS DOUBLE) AS shares, CAST(event_id % 101 AS DOUBLE) AS position_pct, 1000.0 + value + CAST(event_id % 97 AS DOUBLE) AS equity
FROM events
"""

#: Events as snapshot documents with absent, null, empty, mistyped and odd values.
SNAPSHOTS = """
SELECT event_id, '{"symbol":"S' || CAST(user_id AS STRING) || '"'
  || CASE event_id % 7 WHEN 0 THEN '' ELSE ',"as_of_date":"2026-01-0' || CAST(1 + event_id % 9 AS STRING) || ' 10:00:00"' END
  || CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN ',"scenario":null' ELSE ',"scenario":"missed_entry"' END || ',"outcome_label":"x"'
  || ',"v8_score":{"grade":' || CASE event_id % 4 WHEN 0 THEN '"A"' WHEN 1 THEN '"B"' WHEN 2 THEN 'null' ELSE '""' END
  || ',"setup_score":' || CASE event_id % 3 WHEN 0 THEN '"n/a"' ELSE CAST(event_id % 90 AS STRING) || '.5' END || ',"ignition_score":' || CAST(event_id % 70 AS STRING)
  || ',"overheat_index":' || CASE event_id % 6 WHEN 0 THEN '"2.5"' WHEN 1 THEN '7' WHEN 2 THEN '3.5' WHEN 3 THEN '"x"' ELSE CAST(event_id % 9 AS STRING) END
  || ',"toxic_breaker":' || CASE event_id % 13 WHEN 0 THEN 'true' ELSE 'false' END || CASE event_id % 17 WHEN 0 THEN ',"toxic_breaker_factors":["a"]' WHEN 1 THEN ',"toxic_breaker_factors":[]' ELSE '' END || '}'
  || ',"ls1_supercharged":{"spring":{"coiling":' || CASE event_id % 2 WHEN 0 THEN 'true' ELSE 'false' END || ',"launch":' || CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'null' END || ',"breakout_60d":' || CASE event_id % 4 WHEN 1 THEN 'true' ELSE 'false' END || '}'
  || ',"three_push":{"pump_dump_vol_ratio":0.' || CAST(event_id % 5 AS STRING) || '5}}'
  || ',"compression_setup":{"is_range_compressed":' || CASE event_id % 3 WHEN 1 THEN 'true' ELSE 'false' END || ',"is_bb_squeeze":' || CASE event_id % 5 WHEN 2 THEN 'true' WHEN 3 THEN 'null' ELSE 'false' END || ',"is_ready":' || CASE event_id % 11 WHEN 0 THEN 'true' ELSE 'false' END || '}'
  || ',"trap_detection":{' || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '"pump_fake":"odd",' WHEN 2 THEN '"pump_fake":{"is_trap":true,"trap_type":"pump","volume_ratio":0.07,"details":"d"},' ELSE '"pump_fake":{"is_trap":false},' END || '"volume_gap":{"is_gap":' || CASE event_id % 6 WHEN 5 THEN 'true' ELSE 'false' END || '}}'
  || ',"intraday_volume_structure":{"launch_signal":' || CASE event_id % 2 WHEN 1 THEN 'true' ELSE 'false' END || '},"crash_signals":{"panic_reversal":{"detected":' || CASE event_id % 19 WHEN 0 THEN 'true' ELSE 'false' END || '}}'
  || ',"chan":{"stage_code":' || CASE event_id % 6 WHEN 0 THEN '"forming"' WHEN 1 THEN '"developing"' WHEN 2 THEN '"mature"' WHEN 3 THEN '"odd"' WHEN 4 THEN '""' ELSE 'null' END || ',"zs_count":' || CAST(event_id % 5 AS STRING) || ',"trend_type":' || CASE event_id % 3 WHEN 0 THEN '"UpTrend"' WHEN 1 THEN '"down_trend"' ELSE '"?"' END
  || ',"pivot":{"pct_in_range":0.' || CAST(event_id % 9 AS STRING) || ',"range":[1.5,' || CAST(2 + event_id % 4 AS STRING) || CASE event_id % 5 WHEN 0 THEN ',9' ELSE '' END || ']}'
  || ',"bsp":{"latest":' || CASE event_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '{"side":"buy","types":["T1p","2sell"]}' ELSE '{"side":"sell","types":[]}' END || ',"latest_confirmed":' || CASE event_id % 4 WHEN 0 THEN '{"side":"long","types":["T3"]}' ELSE 'null' END || '}}'
  || ',"indicators":{"macd":{"state":"' || CASE event_id % 4 WHEN 0 THEN 'Golden X' WHEN 1 THEN 'dead' ELSE 'flat' END || '","hist":-0.' || CAST(event_id % 10 AS STRING) || '},"rsi":{"value":' || CAST(30 + event_id % 50 AS STRING) || '}}'
  || ',"momentum":{"vol_ratio_5d":1.' || CAST(event_id % 10 AS STRING) || ',"consecutive_up_days":' || CAST(event_id % 4 AS STRING) || '},"macro_sentinel":{"regime":"' || CASE event_id % 3 WHEN 0 THEN 'bull' WHEN 1 THEN 'odd' ELSE 'crash' END || '","hard_block":' || CASE event_id % 23 WHEN 0 THEN 'true' ELSE 'false' END || '}}' AS snapshot
FROM events
"""

#: Conversations as decisions: text, reply and action.
CHATS = """
SELECT conv_id, turn, text, role, CASE turn % 5 WHEN 0 THEN 'BUY_FULL' WHEN 1 THEN 'NO_BUY' WHEN 2 THEN 'AVOID' WHEN 3 THEN 'PANIC_SELL' ELSE 'BUY' END AS action,
  text || CASE conv_id % 6 WHEN 0 THEN ' half 0.5 override' WHEN 1 THEN ' panic' WHEN 2 THEN ' full winner loser' WHEN 3 THEN ' 0.1' WHEN 4 THEN ' 0.3' ELSE '' END AS said, CASE conv_id % 3 WHEN 0 THEN 'Overheat ahead' ELSE 'fine' END AS reply,
  CASE (conv_id + turn) % 9 WHEN 0 THEN 0.03 WHEN 1 THEN -0.03 WHEN 2 THEN 0.02 WHEN 3 THEN -0.02 WHEN 4 THEN 0.0 WHEN 5 THEN 0.2 ELSE NULL END AS r5, CASE (conv_id + turn) % 4 WHEN 0 THEN 0.05 ELSE -0.01 END AS r10,
  (conv_id + turn) % 3 = 0 AS lethal, CASE conv_id % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END AS grade
FROM conversations
"""

TABLES = {PATTERNS: ["embeddings"], BARS: ["events"], LEDGER: ["events"], SNAPSHOTS: ["events"], CHATS: ["conversations"]}


def bind(spark: SparkSession, sf_dir: str, sql: str, dealt: bool = False) -> DataFrame:
    """A binding over the tables of a folder; only the columns that a query uses are read.

    ``dealt``: the tables are spread before the binding, so that their columns move and not what is made of them.
    """
    names = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[sql]}
    names = {t: spread(df) for t, df in names.items()} if dealt else names
    text = sql.replace("{", "{{").replace("}", "}}")
    for t in names:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task whose projection costs more than a shuffle.
DEAL_ROWS = 100_000


def spread(df: DataFrame) -> DataFrame:
    """The table dealt over all cores, and to tasks of about DEAL_ROWS rows, if its files have fewer splits: for projections that cost more than a shuffle."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // DEAL_ROWS))
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(parts) if splits < parts else df
