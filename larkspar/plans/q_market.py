"""Bars, windows, ledger verdicts, cases and graph over the driver's events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as b
from ..operators import cases, graph, ledger
from .bindings import BARS, LEDGER, PATTERNS, bind, table

QUERIES, SQL = {}, {}
K = ["symbol"]
W = "PARTITION BY symbol ORDER BY day"


def bars(s, d):
    return bind(s, d, BARS)


def of_bars(name, spark, sql):
    """A query over the bars that keeps symbol and day."""
    QUERIES[name] = lambda s, d: bars(s, d).select("symbol", "day", *spark())
    SQL[name] = f"WITH bars AS ({BARS}) SELECT symbol, day, {sql} FROM bars"


of_bars("win1_forward_return", lambda: [F.round(b.forward_return(F.col("close"), K, "day", 5), 6).alias("r5"), F.round(b.forward_return(F.col("close"), K, "day", 5, last=True), 6).alias("r5_last")],
        f"round(lead(close, 5) OVER ({W}) / close - 1, 6) AS r5, round(coalesce(lead(close, 5) OVER ({W}), last(close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / close - 1, 6) AS r5_last")
of_bars("win3_drawdown", lambda: [F.round(b.drawdown(F.col("close"), K, "day"), 6).alias("dd")], f"round((max(close) OVER ({W} ROWS UNBOUNDED PRECEDING) - close) / max(close) OVER ({W} ROWS UNBOUNDED PRECEDING), 6) AS dd")
of_bars("win4_excursions", lambda: [F.round(x, 6).alias(n) for x, n in zip(b.excursions(F.col("close"), K, "day", 10), ("mfe", "mae"))],
        f"round(max(close) OVER ({W} ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) / close - 1, 6) AS mfe, round(min(close) OVER ({W} ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) / close - 1, 6) AS mae")
of_bars("win2_trailing_window", lambda: [F.size(b.trailing(["close", "volume"], K, "day", 8)).alias("bars"), F.round(F.get(F.get(b.trailing(["close", "volume"], K, "day", 8), F.lit(0)), F.lit(0)), 6).alias("oldest")],
        f"CASE WHEN count(*) OVER w >= 2 THEN count(*) OVER w END AS bars, CASE WHEN count(*) OVER w >= 2 THEN round(first(close) OVER w, 6) END AS oldest".replace("OVER w", f"OVER ({W} ROWS 7 PRECEDING)"))
of_bars("win11_extremes", lambda: [x.alias(n) for x, n in zip(b.extremes(F.col("high"), F.col("low"), K, "day"), ("high_250d", "low_250d"))], f"max(high) OVER ({W} ROWS 249 PRECEDING) AS high_250d, min(low) OVER ({W} ROWS 249 PRECEDING) AS low_250d")
of_bars("win15_fill_price", lambda: [b.fill_price(F.col("open"), F.col("close"), K, "day").alias("fill")], f"coalesce(lead(open) OVER ({W}), close) AS fill")
of_bars("win8_since_event", lambda: [b.since(F.col("close") > 100, K, "day").cast("long").alias("bars_since")], f"row_number() OVER ({W}) - max(CASE WHEN close > 100 THEN i END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bars_since")
SQL["win8_since_event"] = SQL["win8_since_event"].replace(f"({BARS})", f"(SELECT *, row_number() OVER ({W}) AS i FROM ({BARS}))")
of_bars("win16_unrealised", lambda: [F.round(x, 6).alias(n) for n, x in b.unrealised(F.col("volume") - 1, F.col("open"), F.col("close"), F.lit(1000.0)).items()],
        "round(CASE WHEN volume > 1 AND open > 0 THEN (close / open - 1) * 100 ELSE 0 END, 6) AS pnl_pct, round((volume - 1) * close / (1000 + (volume - 1) * close) * 100, 6) AS position_pct, round(1000 + (volume - 1) * close, 6) AS equity")
of_bars("win9_stops", lambda: [b.stop((F.col("close") / F.col("open") - 1) * 100, F.when(F.col("volume") > 1, "D").otherwise("B")).alias("stop")],
        "CASE WHEN (close / open - 1) * 100 < -10 THEN 'SELL' WHEN volume > 1 AND (close / open - 1) * 100 < -5 THEN 'SELL' END AS stop")
QUERIES["win7_streaks"] = lambda s, d: b.streak(bars(s, d), F.col("close") < F.col("open"), K, "day", "down_days").select("symbol", "day", F.col("down_days").cast("long").alias("down_days"))
SQL["win7_streaks"] = f"WITH g AS (SELECT *, sum(CASE WHEN close < open THEN 0 ELSE 1 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS g FROM ({BARS})) SELECT symbol, day, sum((close < open)::INT) OVER (PARTITION BY symbol, g ORDER BY day ROWS UNBOUNDED PRECEDING)::BIGINT AS down_days FROM g"
QUERIES["win14_trend_start"] = lambda s, d: b.trend_starts(bars(s, d).withColumn("up", F.col("close") >= F.col("open")), "up", "day", K, "day").select("symbol", "day", "up", "trend_start")
SQL["win14_trend_start"] = f"WITH x AS (SELECT *, close >= open AS up, lag(close >= open) OVER ({W}) AS was FROM ({BARS})) SELECT symbol, day, up, max(CASE WHEN was IS NULL OR was <> up THEN day END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS trend_start FROM x"
QUERIES["win5_trading_calendar"] = lambda s, d: b.calendar(table(s, d, "orders").select(F.to_date("o_orderdate").alias("trade_date"))).select("trade_date", F.col("trade_idx").cast("long").alias("trade_idx"), "is_month_end")
CAL = "SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS trade_idx, coalesce(date_trunc('month', lead(trade_date) OVER (ORDER BY trade_date)) <> date_trunc('month', trade_date), TRUE) AS is_month_end FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS trade_date FROM orders)"
SQL["win5_trading_calendar"] = CAL
QUERIES["jon4_at_day"] = lambda s, d: b.at_day(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day")), b.calendar(table(s, d, "orders").select(F.to_date("o_orderdate").alias("trade_date"))), "day").groupBy("trade_idx").agg(F.count("*").alias("n")).select(F.col("trade_idx").cast("long").alias("trade_idx"), "n")
SQL["jon4_at_day"] = f"SELECT trade_idx, count(*) AS n FROM lineitem JOIN ({CAL}) ON CAST(l_shipdate AS DATE) = trade_date GROUP BY 1"
QUERIES["win12_transition_drift"] = lambda s, d: b.transition_drift(bind(s, d, PATTERNS), "vec", K, "idx").select("id", F.round("drift", 6).alias("drift"))
SQL["win12_transition_drift"] = f"WITH x AS (SELECT id, vec::DOUBLE[] AS a, lag(vec) OVER (PARTITION BY symbol ORDER BY idx)::DOUBLE[] AS b FROM ({PATTERNS})) SELECT id, CASE WHEN b IS NOT NULL THEN round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) + 1e-9), 6) END AS drift FROM x"
QUERIES["win10_indicators"] = lambda s, d: b.indicators(bars(s, d), "symbol", "day")


def settled(s, d, horizon=3):
    e = bind(s, d, LEDGER)
    return ledger.outcomes(e.drop("close"), e.select("symbol", "day", "close", F.col("id").alias("seq")), horizon)


SETTLED = f"""WITH l AS ({LEDGER}), one AS (SELECT symbol, day, max_by(close, id) AS close FROM l GROUP BY ALL), ahead AS (SELECT *, lead(close, 3) OVER ({W}) AS later FROM one),
o AS (SELECT l.id, l.run_id, l.action, l.conviction, l.journal, l.shares, a.close, a.later, (a.later - a.close) / a.close AS pnl FROM l JOIN ahead a ON a.symbol = l.symbol AND a.day = l.day WHERE a.later > 0 AND a.close > 0),
v AS (SELECT id, 'journals' AS pass, CASE WHEN pnl > 0.15 THEN 'REFUTED' WHEN pnl < -0.05 THEN 'VALIDATED' END AS verdict, pnl FROM o WHERE action IN ('SELL', 'TRIM') AND trim(coalesce(journal, '')) <> ''
 UNION ALL SELECT id, 'missed', CASE WHEN pnl > 0.15 THEN 'MISSED_ENTRY' WHEN pnl < -0.05 THEN 'CORRECT_WAIT' END, pnl FROM o WHERE action = 'WAIT' AND shares <= 0
 UNION ALL SELECT id, 'entries', CASE WHEN pnl > 0.10 THEN 'GOOD_ENTRY' WHEN pnl < -0.05 THEN 'BAD_ENTRY' END, pnl FROM o WHERE action IN ('BUY', 'ADD')
 UNION ALL SELECT id, 'holds', CASE WHEN pnl > 0.10 THEN 'PREMATURE_EXIT' WHEN pnl < -0.05 THEN 'GOOD_EXIT' END, pnl FROM o WHERE (action IN ('WAIT', 'HOLD') AND shares > 0) OR (action IN ('SELL', 'TRIM') AND conviction = 'SKIP'))
"""
QUERIES["jon3_forward_outcome"] = lambda s, d: settled(s, d).select("id", "close", "later", F.round("pnl_frac", 6).alias("pnl"))
SQL["jon3_forward_outcome"] = SETTLED + "SELECT id, close, later, round(pnl, 6) AS pnl FROM o"
QUERIES["rul6_to_9_verdicts"] = lambda s, d: ledger.verdicts(settled(s, d)).select("id", "pass", "verdict", F.round("pnl_frac", 6).alias("pnl"))
SQL["rul6_to_9_verdicts"] = SETTLED + "SELECT id, pass, verdict, round(pnl, 6) AS pnl FROM v WHERE verdict IS NOT NULL"
QUERIES["set1_verdict_counts"] = lambda s, d: ledger.verdicts(settled(s, d)).groupBy("pass", "verdict").agg(F.count("*").alias("n"))
SQL["set1_verdict_counts"] = SETTLED + "SELECT pass, verdict, count(*) AS n FROM v WHERE verdict IS NOT NULL GROUP BY ALL"
QUERIES["agg21_run_summary"] = lambda s, d: ledger.summary(bind(s, d, LEDGER)).select("run_id", "days", "trades", *[F.round(c, 5).alias(c) for c in ("total_return", "sharpe", "sortino", "max_drawdown", "calmar")])
SQL["agg21_run_summary"] = f"""WITH l AS ({LEDGER}), r AS (SELECT *, equity / lag(equity) OVER w - 1 AS r, (max(equity) OVER (w ROWS UNBOUNDED PRECEDING) - equity) / max(equity) OVER (w ROWS UNBOUNDED PRECEDING) AS dd FROM l WINDOW w AS (PARTITION BY run_id ORDER BY day_index)),
a AS (SELECT run_id, count(*) AS days, count(*) FILTER (action IN ('BUY', 'ADD', 'SELL', 'TRIM')) AS trades, max_by(equity, day_index) / min_by(equity, day_index) - 1 AS tr, avg(r) AS m, stddev_samp(r) AS sd, sqrt(avg(pow(least(r - (pow(1.03, 1.0::DOUBLE / 252) - 1), 0), 2))) AS dn, max(dd) AS dd FROM r GROUP BY 1)
SELECT run_id, days, trades, round(tr, 5) AS total_return, round(CASE WHEN sd > 0 THEN m / sd * sqrt(252) ELSE 0 END, 5) AS sharpe, round(CASE WHEN dn > 1e-8 THEN (m - (pow(1.03, 1.0::DOUBLE / 252) - 1)) / dn * sqrt(252) ELSE 0 END, 5) AS sortino, round(dd, 5) AS max_drawdown,
round(CASE WHEN dd > 0.001 THEN (pow(1 + tr, 252.0::DOUBLE / days) - 1) / dd ELSE 0 END, 5) AS calmar FROM a"""
SQL["agg21_run_summary"] = SQL["agg21_run_summary"].replace("(max(equity) OVER (w ROWS UNBOUNDED PRECEDING) - equity) / max(equity) OVER (w ROWS UNBOUNDED PRECEDING)", "(max(equity) OVER (PARTITION BY run_id ORDER BY day_index ROWS UNBOUNDED PRECEDING) - equity) / max(equity) OVER (PARTITION BY run_id ORDER BY day_index ROWS UNBOUNDED PRECEDING)")
QUERIES["agg22_activity"] = lambda s, d: ledger.activity(bind(s, d, LEDGER)).withColumn("avg_position_pct", F.round("avg_position_pct", 6))
SQL["agg22_activity"] = f"SELECT run_id, count(*) FILTER (conviction = 'FULL') AS n_full, count(*) FILTER (conviction = 'PROBE') AS n_probe, count(*) FILTER (conviction = 'SKIP') AS n_skip, count(*) FILTER (position_pct > 1e-4) AS days_in_market, round(avg(position_pct) FILTER (position_pct > 1e-4), 6) AS avg_position_pct FROM ({LEDGER}) GROUP BY 1"
QUERIES["agg27_compaction"] = lambda s, d: ledger.compact_events(bind(s, d, LEDGER), ["run_id"], "day").select("run_id", "low", "high", "first", "last", F.map_values("actions").alias("v")).withColumn("n", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x)).drop("v")
SQL["agg27_compaction"] = f"SELECT run_id, min(close) AS low, max(close) AS high, min(day) AS first, max(day) AS last, count(*) AS n FROM ({LEDGER}) GROUP BY 1"
QUERIES["prj38_fallback_decision"] = lambda s, d: bind(s, d, LEDGER).select("id", ledger.fallback(F.col("shares"), F.col("position_pct"), True).alias("x")).select("id", "x.*")
SQL["prj38_fallback_decision"] = f"SELECT id, CASE WHEN shares > 0 THEN 'HOLD' ELSE 'WAIT' END AS action, 'SKIP' AS conviction, CASE WHEN shares > 0 THEN position_pct ELSE 0.0 END AS target_pct, TRUE AS risk_flag FROM ({LEDGER})"
QUERIES["agg25_next_id"] = lambda s, d: ledger.next_id(table(s, d, "customer").select(F.col("c_custkey").alias("id")), table(s, d, "nation").select("n_name", F.lit(0).cast("long").alias("id")), "id", "n_name").select("n_name", F.col("id").cast("long").alias("id"))
SQL["agg25_next_id"] = "SELECT n_name, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY n_name) AS id FROM nation"


def verdict_rows(s, d):
    v = ledger.verdicts(settled(s, d)).withColumn("source_db", F.concat(F.lit("db"), (F.col("id") % 3).cast("string")))
    return v.select("source_db", "id", "run_id", F.col("day").alias("journal_date"), F.col("verdict_day").alias("verdict_date"), "verdict", "action", "pnl_pct")


CASE_ROWS = SETTLED.replace("lead(close, 3)", "lead(day, 3) OVER (PARTITION BY symbol ORDER BY day) AS vday, lead(close, 3)").replace("l.shares,", "l.shares, l.day, a.vday,").replace(", pnl FROM o", ", pnl, run_id, day, vday, action FROM o")
QUERIES["top3_latest_cases"] = lambda s, d: cases.latest(verdict_rows(s, d)).select("id", "bucket", "verdict", "journal_date")
SQL["top3_latest_cases"] = CASE_ROWS + """, c AS (SELECT *, CASE WHEN verdict IN ('CORRECT_WAIT', 'VALIDATED') THEN 'calibrated_wait' WHEN verdict IN ('BAD_ENTRY', 'REFUTED') THEN 'bad_trade' ELSE lower(verdict) END AS bucket, id % 3 AS db FROM v WHERE verdict IS NOT NULL),
s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY db, bucket ORDER BY day DESC, id DESC, verdict DESC) = 1), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY day DESC, vday DESC, id DESC, verdict DESC) = 1)
SELECT id, bucket, verdict, day AS journal_date FROM t ORDER BY day DESC, vday DESC, verdict DESC LIMIT 3"""
QUERIES["flt11_cases_before"] = lambda s, d: cases.latest(verdict_rows(s, d), before=F.lit("2024-02-01").cast("date")).select("bucket", "journal_date")
SQL["flt11_cases_before"] = SQL["top3_latest_cases"].replace("WHERE verdict IS NOT NULL)", "WHERE verdict IS NOT NULL AND day < DATE '2024-02-01' AND vday < DATE '2024-02-01')").replace("SELECT id, bucket, verdict, day AS", "SELECT bucket, day AS")
SCORE = "(CASE WHEN contains(lower(journal), 'acceleration') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(lower(journal), 'acceleration|momentum|breakout|all-in|fat pitch|moon') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(journal), 'missing|missed|regret|should have|too late|left behind') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(journal), 'strong|adx|trend') THEN 1 ELSE 0 END + CASE WHEN action IN ('BUY', 'ADD') THEN 1 ELSE 0 END)"
QUERIES["rul10_journal_score"] = lambda s, d: cases.usable(bind(s, d, LEDGER)).select("id", cases.journal_score(F.col("journal"), F.col("action"), F.lit("acceleration"), F.lit(40.0), F.lit(75.0)).cast("long").alias("score"))
SQL["rul10_journal_score"] = f"SELECT id, {SCORE}::BIGINT AS score FROM ({LEDGER}) WHERE trim(coalesce(journal, '')) <> ''"
QUERIES["top4_similar_journals"] = lambda s, d: cases.similar_journals(bind(s, d, LEDGER), F.lit("acceleration"), F.lit(40.0), F.lit(75.0), top_k=10).select("id", F.col("score").cast("long").alias("score"))
SQL["top4_similar_journals"] = f"SELECT id, {SCORE}::BIGINT AS score FROM ({LEDGER}) WHERE trim(coalesce(journal, '')) <> '' AND {SCORE} > 0 ORDER BY score DESC, day DESC, id LIMIT 10"
QUERIES["prj25_case_title"] = lambda s, d: ledger.verdicts(settled(s, d)).select("id", "pass", cases.title(F.col("verdict"), F.col("action"), F.col("close")).alias("title"))
SQL["prj25_case_title"] = CASE_ROWS.replace(", pnl, run_id", ", pnl, close, run_id") + "SELECT id, pass, CASE WHEN verdict IN ('MISSED_ENTRY', 'CORRECT_WAIT') THEN 'You waited' WHEN verdict IN ('GOOD_ENTRY', 'BAD_ENTRY') OR action IN ('BUY', 'ADD') THEN 'You bought' ELSE 'You exited' END || printf(' at %.2f', close) AS title FROM v WHERE verdict IS NOT NULL"
QUERIES["flt14_regrets"] = lambda s, d: cases.regrets(bind(s, d, LEDGER).withColumn("mfe_pct", F.col("close")).withColumn("regret_pct", F.col("position_pct"))).select("id", "day")
SQL["flt14_regrets"] = f"SELECT id, day FROM ({LEDGER}) WHERE close > 15 AND position_pct > 10 ORDER BY day DESC, id LIMIT 3"
QUERIES["src7_ledger_scan"] = lambda s, d: ledger.scan(bind(s, d, LEDGER), "S1_r").select("id", "action", "day")
SQL["src7_ledger_scan"] = f"SELECT id, action, day FROM ({LEDGER}) WHERE run_id = 'S1_r'"

# ---- graph ---------------------------------------------------------------------------

QUERIES["flt8_archetypes"] = lambda s, d: bind(s, d, PATTERNS).select("id", *[F.expr(rule).alias(name) for name, _, _, rule in graph.ARCHETYPES])
SQL["flt8_archetypes"] = f"SELECT id, {', '.join(f'({rule}) AS {name}' for name, _, _, rule in graph.ARCHETYPES)} FROM ({PATTERNS})"


def selected(s, d):
    p = bind(s, d, PATTERNS)
    chosen = graph.select(p.select("pattern_id", "symbol", "label_T10", "label_T20", "fwd_return_T10", "fwd_return_T20", "mae_T10", "mae_T5", "v8_grade", "v8_score", "spring_launch", "chan_divergence_flag", "chan_bsp_types", "as_of_date"))
    return chosen.join(p.select("pattern_id", "vec", "trade_idx"), "pattern_id")


def chosen(s, d):
    return selected(s, d).select("pattern_id", "archetype", "sel_rank")


#: The greedy passes by recursion: one step looks at the next candidate of the pass, and takes it if it is new and its symbol has room.
SELECTED = f"""
WITH RECURSIVE p AS ({PATTERNS}), ranked AS (
  {" UNION ALL ".join(f"SELECT {k} AS pass, '{name}' AS archetype, {cap} AS cap, pattern_id, symbol, row_number() OVER (ORDER BY v8_score DESC, pattern_id) AS r FROM p WHERE {rule}" for k, (name, _, cap, rule) in enumerate(graph.ARCHETYPES))}
), walk AS (
  SELECT 0 AS pass, 0::BIGINT AS r, 50::BIGINT AS room, []::BIGINT[] AS ids, []::VARCHAR[] AS symbols, []::VARCHAR[] AS kinds
  UNION ALL
  SELECT CASE WHEN c.pass IS NULL THEN w.pass + 1 ELSE w.pass END, CASE WHEN c.pass IS NULL THEN 0 ELSE w.r + 1 END, CASE WHEN c.pass IS NULL THEN 50 - len(w.ids) ELSE w.room END,
    CASE WHEN takes THEN list_append(w.ids, c.pattern_id) ELSE w.ids END, CASE WHEN takes THEN list_append(w.symbols, c.symbol) ELSE w.symbols END, CASE WHEN takes THEN list_append(w.kinds, c.archetype) ELSE w.kinds END
  FROM walk w LEFT JOIN ranked c ON c.pass = w.pass AND c.r = w.r + 1 AND c.r <= 3 * w.room
  CROSS JOIN LATERAL (SELECT c.pass IS NOT NULL AND NOT list_contains(w.ids, c.pattern_id) AND len(list_filter(w.symbols, lambda s: s = c.symbol)) < c.cap AND len(w.ids) < 50 AS takes) t
  WHERE w.pass < {len(graph.ARCHETYPES)}
), last AS (SELECT ids, kinds FROM walk WHERE pass = {len(graph.ARCHETYPES)}), taken AS (SELECT unnest(ids) AS pattern_id, unnest(kinds) AS archetype, unnest(range(len(ids))) AS sel_rank FROM last)
"""
QUERIES["top2_select_patterns"] = chosen
SQL["top2_select_patterns"] = SELECTED + "SELECT pattern_id, archetype, sel_rank FROM taken"
SQL["jon9_similar_to"] = SELECTED + """, s AS (
  SELECT a.pattern_id AS source, b.pattern_id AS target, round(list_dot_product(x.vec::DOUBLE[], y.vec::DOUBLE[]) / (sqrt(list_dot_product(x.vec::DOUBLE[], x.vec::DOUBLE[])) * sqrt(list_dot_product(y.vec::DOUBLE[], y.vec::DOUBLE[]))), 6) AS weight
  FROM taken a JOIN taken b ON a.pattern_id <> b.pattern_id JOIN p x ON x.pattern_id = a.pattern_id JOIN p y ON y.pattern_id = b.pattern_id
) SELECT * FROM s WHERE weight >= 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY weight DESC, target) <= 3"""
SQL["jon10_supports"] = SELECTED + """
SELECT a.pattern_id AS source, b.pattern_id AS target, round(greatest(0, 1 - abs(x.as_of_date - y.as_of_date) / 90), 6) AS weight
FROM taken a JOIN taken b ON a.archetype = b.archetype AND a.sel_rank < b.sel_rank JOIN p x ON x.pattern_id = a.pattern_id JOIN p y ON y.pattern_id = b.pattern_id WHERE x.symbol <> y.symbol AND abs(x.as_of_date - y.as_of_date) <= 90"""
QUERIES["jon9_similar_to"] = lambda s, d: graph.similar_to(selected(s, d), "vec", least=0.0).select("source", "target", F.round("weight", 6).alias("weight"))
QUERIES["jon10_supports"] = lambda s, d: graph.supports(selected(s, d)).select("source", "target", F.round("weight", 6).alias("weight"))
QUERIES["jon7_follows"] = lambda s, d: graph.follows(bind(s, d, PATTERNS)).select("source", "target", F.round("weight", 6).alias("weight"))
SQL["jon7_follows"] = f"WITH p AS ({PATTERNS}) SELECT a.id AS source, b.id AS target, round(greatest(0, 1 - (b.idx - a.idx) / 5), 6) AS weight FROM p a JOIN p b ON a.symbol = b.symbol AND b.idx > a.idx AND b.idx <= a.idx + 5 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.idx, b.id) <= 3"
QUERIES["jon8_recovered_from"] = lambda s, d: graph.recovered_from(bind(s, d, PATTERNS).withColumn("symbol", F.lit("x"))).select("source", "target", F.round("weight", 6).alias("weight"))
SQL["jon8_recovered_from"] = f"WITH p AS ({PATTERNS}), x AS (SELECT a.id AS source, b.id AS target, a.idx - b.idx AS gap FROM p a JOIN p b ON b.idx < a.idx AND a.label_T10 = 'true_S' AND b.label_T10 = 'false_trap' QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.idx DESC) = 1) SELECT source, target, 1.0::DOUBLE AS weight FROM x WHERE gap <= 30"


def edges(s, d):
    p = bind(s, d, PATTERNS)
    return graph.follows(p).unionByName(graph.recovered_from(p))


EDGES = f"WITH p AS ({PATTERNS}), f AS (SELECT a.id AS source, b.id AS target, 'follows' AS relation, 1 - (b.idx - a.idx) / 5 AS weight FROM p a JOIN p b ON a.symbol = b.symbol AND b.idx > a.idx AND b.idx <= a.idx + 5 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.idx, b.id) <= 3), x AS (SELECT a.id AS source, b.id AS target, a.idx - b.idx AS gap FROM p a JOIN p b ON a.symbol = b.symbol AND b.idx < a.idx AND a.label_T10 = 'true_S' AND b.label_T10 = 'false_trap' QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.idx DESC) = 1), e AS (SELECT * FROM f UNION ALL SELECT source, target, 'recovered_from', 1.0::DOUBLE FROM x WHERE gap <= 30) "
QUERIES["agg24_edges_by_relation"] = lambda s, d: graph.by_relation(edges(s, d))
SQL["agg24_edges_by_relation"] = EDGES + "SELECT relation, count(*) AS n_edges FROM e GROUP BY 1"
QUERIES["top5_edge_cap"] = lambda s, d: graph.capped(edges(s, d), 40).select("source", "target", "relation")
SQL["top5_edge_cap"] = EDGES + "SELECT source, target, relation FROM e ORDER BY weight DESC, source, target, relation LIMIT 40"
QUERIES["jon13_links"] = lambda s, d: graph.links(edges(s, d)).select("source", F.size("links").cast("long").alias("n"), F.array_join(F.transform("links", lambda x: x["target"].cast("string")), ",").alias("targets"))
SQL["jon13_links"] = EDGES + "SELECT source, count(*) AS n, string_agg(target::VARCHAR, ',' ORDER BY relation, target) AS targets FROM e GROUP BY 1"


def matrix(s, d):
    e = table(s, d, "embeddings").select(F.col("label").cast("string").alias("name"), F.posexplode("embedding").alias("i", "x")).groupBy("name", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = e.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]).alias("vec"))
    return graph.similarity_matrix(means, "name", "vec").select("a", "b", F.round("sim", 6).alias("sim"))


QUERIES["jon14_similarity_matrix"] = matrix
SQL["jon14_similarity_matrix"] = "WITH u AS (SELECT label::VARCHAR AS name, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT name, i, avg(x) AS x FROM u GROUP BY ALL), v AS (SELECT name, list(x ORDER BY i) AS v FROM m GROUP BY 1) SELECT a.name AS a, b.name AS b, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-9), 6) AS sim FROM v a, v b"
QUERIES["prj36_gap_bars"] = lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", graph.gap_bars(F.when(F.col("l_linenumber") == 1, F.col("l_partkey")), F.col("l_suppkey"), F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("long").alias("gap"))
SQL["prj36_gap_bars"] = "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber = 1 THEN l_partkey END - l_suppkey, datediff('day', o_orderdate::DATE, l_shipdate::DATE)) AS gap FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
