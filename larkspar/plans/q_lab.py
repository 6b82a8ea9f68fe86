"""Lessons, case texts, episode rules and arm comparisons over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ablation, cases, episode, graph, ledger, recall, stats
from ..operators import evidence as ev
from ..operators import provenance as pv
from .bindings import CHATS, LEDGER, PATTERNS, bind, table
from .q_market import SETTLED, settled

QUERIES, SQL = {}, {}

# ---- lessons and texts ---------------------------------------------------------------

KIND = "CASE conv_id % 5 WHEN 0 THEN 'beta_error' WHEN 1 THEN 'alpha_error' WHEN 2 THEN 'scoring_error' WHEN 3 THEN 'mixed_error' ELSE 'no_error' END"


def lessons(spark, sf):
    c = bind(spark, sf, CHATS).withColumn("kind", F.expr(KIND)).withColumn("beta", pv.discipline(F.col("said"), F.col("reply"), F.col("action")))
    r5 = F.coalesce(F.col("r5").cast("double"), F.lit(0.0))
    c = c.withColumn("outcome", F.struct(r5.alias("return_t5"), F.least(r5, F.lit(0.0)).alias("mae"), F.greatest(r5, F.lit(0.0)).alias("mfe")))
    alpha = {"grade": F.col("grade"), "overheat": (F.col("turn") + 0.5).cast("double"), "trap": F.col("turn") % 2 == 0, "lethal": F.col("lethal"), "regime": F.lit("bull")}
    made = pv.lesson(F.col("kind"), F.lit("600.SH"), F.lit("2026-01-05T10:00:00"), alpha, F.col("beta"), F.col("outcome"))
    return c.select("conv_id", "turn", made.alias("x")).select("conv_id", "turn", "x.*")


def text_sql(template, **values):
    for name, sql in values.items():
        template = template.replace("{" + name + "}", f"' || {sql} || '")
    return f"('{template}')"


_flag = lambda sql: f"CASE WHEN {sql} THEN 'True' ELSE 'False' END"
_values = {
    "grade": "grade", "overheat": "CAST(turn + 0.5::DOUBLE AS VARCHAR)", "regime": "'bull'", "trap": _flag("turn % 2 = 0"), "sizing": "CAST(sizing AS VARCHAR)", "share": "printf('%.1f', sizing)",
    "panic": _flag("panic"), "override": _flag("override"), "t5": "printf('%.2f%%', 100 * r)", "mae": "printf('%.2f%%', 100 * least(r, 0))", "mfe": "printf('%.2f%%', 100 * greatest(r, 0))",
}
QUERIES["prj30_lesson"] = lessons
SQL["prj30_lesson"] = f"""
WITH c AS (
  SELECT *, {KIND} AS kind, coalesce(r5, 0)::DOUBLE AS r, contains(lower(said), 'panic') OR action = 'PANIC_SELL' AS panic, contains(lower(said), 'override') AS override,
    CASE WHEN contains(said, '0.5') THEN 0.5 WHEN contains(lower(said), 'full') OR contains(said, '1.0') OR action = 'BUY_FULL' THEN 1.0 WHEN contains(said, '0.1') THEN 0.1 WHEN contains(said, '0.3') THEN 0.3 ELSE 1.0 END::DOUBLE AS sizing
  FROM ({CHATS})
), k AS (
  SELECT *, CASE WHEN kind <> 'beta_error' THEN kind WHEN panic THEN 'panic' WHEN lethal THEN 'lethal' ELSE 'intraday' END AS lesson FROM c
)
SELECT conv_id, turn, 'LS1-600_SH-' || upper(kind) || '-20260105T100000' AS lesson_id, upper(kind) AS verdict_type,
  CASE lesson {' '.join(f"WHEN '{n}' THEN {text_sql(t, **_values)}" for n, t in pv.LESSONS.items())} END AS core_axiom,
  {text_sql(pv.EVIDENCE, **_values)} AS evidence
FROM k
"""

QUERIES["prj25_case_summary"] = lambda s, d: ledger.verdicts(settled(s, d)).select(
    "id", "pass", cases.summary(F.col("verdict"), F.col("later"), cases.rounded(100 * F.col("pnl_frac"), 1), F.lit("x")).alias("summary")
)
SQL["prj25_case_summary"] = SETTLED.replace(", pnl FROM o", ", pnl, later FROM o") + f"""
SELECT id, pass, 'Price ' || CASE WHEN round(100 * pnl, 1) >= 0 THEN 'rose' ELSE 'fell' END || printf(' to %.2f (%+.0f%%) in 10 days. ', later, round_even(round(100 * pnl, 1), 0)) ||
  CASE verdict {' '.join(f"WHEN '{v}' THEN '{x}'" for v, x in cases.ENDINGS.items())} END AS summary
FROM v WHERE verdict IS NOT NULL
"""

DRESSED = f"""
SELECT *, 'Stock ' || symbol AS name, CASE pattern_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'up' ELSE '' END AS chan_trend_type, CASE pattern_id % 2 WHEN 0 THEN 'buy' END AS chan_bsp_side,
  pattern_id % 4 = 0 AS spring_coiling, 'golden_launch' AS archetype, 0.0 - CAST(pattern_id % 13 AS DOUBLE) AS mae_T20
FROM ({PATTERNS})
"""


def memory(spark, sf):
    p = bind(spark, sf, PATTERNS)
    return graph.memory_text(spark.sql(DRESSED.replace(f"({PATTERNS})", "{p}"), p=p))


QUERIES["prj24_memory_sentences"] = memory
SQL["prj24_memory_sentences"] = f"""
SELECT pattern_id, '[' || CAST(as_of_date AS VARCHAR) || '] ' || symbol || ' ' || name || ': golden launch detected. V8=' || v8_grade || printf('(%.0f), Chan=', v8_score) || coalesce(nullif(chan_trend_type, ''), '?')
  || ' ' || coalesce(chan_bsp_side, '') || ' ' || coalesce(chan_bsp_types, '') || '.' || CASE WHEN spring_coiling THEN ' Spring coiling active.' ELSE '' END || CASE WHEN spring_launch = 1 THEN ' Spring launch confirmed.' ELSE '' END
  || ' T10: ' || coalesce(label_T10, 'None') || printf(', fwd_return=%+.1f%%, MAE=%+.1f%%. T20: ', fwd_return_T10, mae_T10) || label_T20 || printf(', fwd_return=%+.1f%%, MAE=%+.1f%%.', fwd_return_T20, mae_T20) AS memory_text
FROM ({DRESSED})
"""

# ---- arms ----------------------------------------------------------------------------

def armed(spark, sf):
    p = bind(spark, sf, PATTERNS).withColumn("head", F.slice("vec", 1, 16)).withColumn("empty", F.lit(None).cast("array<float>"))
    return p.withColumn("label_T5", F.when(F.col("id") % 2 == 0, "true_S").otherwise(F.col("label_T20"))).withColumn("fwd_return_T5", F.col("fwd_return_T10") * 2).withColumn("mae_T20", F.col("mae_T10") * 2)


SQL["agg18_ablation"] = f"""
WITH p AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'true_S' ELSE label_T20 END AS label_T5, fwd_return_T10 * 2 AS fwd_return_T5 FROM ({PATTERNS})),
r AS (SELECT id, row_number() OVER (ORDER BY idx, id) AS at, count(*) OVER () AS n, (0.7 * count(*) OVER ())::DOUBLE AS x FROM p),
q AS (SELECT DISTINCT p.* FROM p JOIN r ON r.id = p.id JOIN range(20) t(i) ON r.at = floor(x) + 1 + floor(t.i * (n - floor(x) - 1) / 19)),
a AS (SELECT 'A' AS arm, id, vec::DOUBLE[] AS v FROM p UNION ALL SELECT 'C', id, vec[1:16]::DOUBLE[] FROM p),
s AS (
  SELECT x.arm, q.id AS query_id, c.id AS case_id, round(list_cosine_similarity(x.v, y.v), 12) AS sim
  FROM q JOIN p c ON c.idx <= q.idx - 40 AND c.id <> q.id AND (c.symbol <> q.symbol OR c.idx <= q.idx - 30) JOIN a x ON x.id = q.id JOIN a y ON y.id = c.id AND y.arm = x.arm
), h AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY arm, query_id ORDER BY sim DESC, case_id) <= 5),
u AS (SELECT id, unnest(['T5', 'T10', 'T20']) AS horizon, unnest([label_T5, label_T10, label_T20]) AS label, unnest([fwd_return_T5, fwd_return_T10, fwd_return_T20]) AS fwd FROM p),
per AS (
  SELECT arm, horizon, h.query_id, count(*) FILTER (u.label = 'true_S') / count(*) AS t, count(*) FILTER (u.label = 'false_trap') / count(*) AS f, count(*) FILTER (u.label = 'stale_S') / count(*) AS st, avg(u.fwd) AS fwd, avg(sim) AS sim,
    count(*) FILTER (c.symbol = q.symbol) / count(*) AS same, quantile_disc(q.idx - c.idx, 0.5) AS age
  FROM h JOIN u ON u.id = h.case_id JOIN p q ON q.id = h.query_id JOIN p c ON c.id = h.case_id GROUP BY arm, horizon, h.query_id
)
SELECT arm, horizon, FALSE AS skipped, NULL AS reason, count(*) AS n_queries, round(avg(t), 3) AS "mean_true_S_rate", round(avg(f), 3) AS mean_false_trap_rate, round(avg(st), 3) AS "mean_stale_S_rate", round(avg(fwd), 2) AS mean_avg_fwd_return,
  round(avg(sim), 3) AS mean_similarity, round(avg(same), 3) AS mean_same_symbol_ratio, round(avg(age), 1) AS mean_neighbor_age_median, string_agg(round(t, 3)::VARCHAR, ',' ORDER BY query_id) AS "true_S"
FROM per GROUP BY arm, horizon
UNION ALL SELECT 'B', NULL, TRUE, 'no empty vectors', 0, 0, 0, 0, 0, 0, 0, 0, ''
"""


def ablated(spark, sf):
    m = ablation.metrics(armed(spark, sf), {"A": "vec", "B": "empty", "C": "head"})
    rates = F.array_join(F.transform("true_S", lambda x: F.round(x, 3).cast("string")), ",")
    return m.withColumn("true_S", F.coalesce(rates, F.lit(""))).fillna(0, [c for c, k in m.dtypes if k in ("bigint", "double")])


QUERIES["agg18_ablation"] = ablated


def decision(spark, sf):
    """The report's decision: verdict, reason, and each arm's interval and tally."""
    found = ablation.decide(ablation.metrics(armed(spark, sf), {"A": "vec", "B": "empty", "C": "head"}), "A")
    rows = [(a, x["point"], round(x["lower"], 6), round(x["upper"], 6), *found["tally"][a], found["verdict"], found["reason"], found["champion"] == a) for a, x in found["arms"].items()]
    return spark.createDataFrame(rows, "arm string, point double, lower double, upper double, significant long, uncertain long, hurts long, verdict string, reason string, champion boolean")


QUERIES["agg18_decision"] = decision


def gate(spark, sf):
    p = armed(spark, sf)
    own = p.select(F.col("id").alias("query_id"), F.col("fwd_return_T10").alias("fwd_return"))
    rows = None
    for name, column in (("z", "vec"), ("fused", "head")):
        hits = recall.arm(p, p, column).join(p.select(F.col("id").alias("case_id"), "fwd_return_T10"), "case_id")
        means = hits.groupBy("query_id").agg(F.avg("fwd_return_T10").alias("avg_fwd_return"))
        one = stats.rank_ic(means, own).withColumn("arm", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    g = stats.rank_ic_gate(rows)
    return g.select(*[F.round(c, 6).alias(c) for c in ("base_ic", "fused_ic", "delta")], "passes_gate", "n_base", "n_fused")


_ic = lambda name, vec: f"""{name} AS (  -- one arm
  WITH p AS ({PATTERNS}), s AS (SELECT q.id AS query_id, c.id AS case_id, c.fwd_return_T10 AS fwd, round(list_cosine_similarity(q.{vec}::DOUBLE[], c.{vec}::DOUBLE[]), 12) AS sim FROM p q JOIN p c ON c.idx <= q.idx - 40 AND c.id <> q.id),
  h AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, case_id) <= 5), m AS (SELECT query_id, avg(fwd) AS fwd FROM h GROUP BY 1),
  r AS (SELECT row_number() OVER (ORDER BY m.fwd, query_id) AS a, row_number() OVER (ORDER BY fwd_return_T10, query_id) AS b FROM m JOIN p ON p.id = m.query_id)
  SELECT count(*) AS n, corr(a, b) AS ic FROM r
)"""  # noqa: E731
QUERIES["agg14_rank_ic_gate"] = gate
SQL["agg14_rank_ic_gate"] = f"WITH z AS (SELECT * FROM ({'WITH ' + _ic('t', 'vec')} SELECT * FROM t)), f AS (SELECT * FROM ({'WITH ' + _ic('t', 'vec[1:16]')} SELECT * FROM t)) SELECT round(z.ic, 6) AS base_ic, round(f.ic, 6) AS fused_ic, round(f.ic - z.ic, 6) AS delta, f.ic - z.ic > 0.02 AS passes_gate, z.n AS n_base, f.n AS n_fused FROM z, f"


# ---- episode -------------------------------------------------------------------------

#: A ledger row as a day with its indicators.
DAY = f"""
SELECT id, symbol, day_index, action, conviction, shares, CASE id % 9 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE CAST(id % 40 AS DOUBLE) END AS adx, CAST((id * 3) % 40 AS DOUBLE) AS prev_adx, id % 50 = 0 AS watch_hit, id % 13 <> 0 AS skip_on_flat,
  id % 31 = 0 AS exited, id % 3 = 0 AS trend_locked, CASE id % 8 WHEN 0 THEN 'S' WHEN 1 THEN 'B' WHEN 2 THEN NULL ELSE 'C' END AS grade, close, CAST(id % 200 AS DOUBLE) AS ma20, CASE id % 7 WHEN 0 THEN '卖' WHEN 1 THEN '买' END AS side,
  CAST(id % 21 AS DOUBLE) - 10 AS change_pct, id % 19 = 0 AS signal_changed, CASE id % 6 WHEN 0 THEN 'T1' WHEN 1 THEN 'none' WHEN 2 THEN 'unknown' END AS last_point, id % 23 = 0 AS is_ready, CAST(id % 7 AS DOUBLE) AS compression,
  id % 5 = 0 AS squeezed, CAST(id % 17 AS DOUBLE) / 10 AS volume_ratio
FROM ({LEDGER})
"""


def days(spark, sf):
    return spark.sql(DAY.replace(f"({LEDGER})", "{l}"), l=bind(spark, sf, LEDGER))


def woken(spark, sf):
    d = days(spark, sf)
    return d.select("id", episode.wake({c: F.col(c) for c in d.columns} | {"threshold": F.lit(8.0)}).alias("wake"))


QUERIES["flt13_wake"] = woken
SQL["flt13_wake"] = f"""
SELECT id, CASE WHEN coalesce(adx, 0) = 0 THEN FALSE WHEN watch_hit OR NOT skip_on_flat THEN TRUE
  WHEN shares > 0 THEN exited OR ((coalesce(grade, 'C') = 'C' AND NOT trend_locked)::INT + (close < ma20 AND ma20 > 0)::INT + coalesce(side = '卖', FALSE)::INT) >= 2
  ELSE coalesce(grade, 'C') IN ('S', 'A', 'B') OR abs(change_pct) > 8 OR signal_changed OR coalesce(last_point NOT IN ('none', 'unknown'), FALSE) OR is_ready OR (compression >= 4 AND squeezed) OR volume_ratio >= 1.5 OR (adx > 20 AND prev_adx <= 20 AND prev_adx > 0)
  END AS wake
FROM ({DAY})
"""


def cooled(spark, sf):
    d = episode.since_last(days(spark, sf), ["symbol"], "day_index", F.col("action") == "SELL", "since_sale")
    d = episode.since_last(d, ["symbol"], "day_index", F.col("action") == "TRIM", "since_trim")
    return d.select("id", episode.after_sale(F.col("conviction"), F.col("shares"), F.col("since_sale"), F.col("grade")).alias("conviction"), episode.after_trim(F.col("action"), F.col("since_trim")).alias("action"))


QUERIES["win8_cooldowns"] = cooled
SQL["win8_cooldowns"] = f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day_index) AS i FROM ({DAY})),
s AS (SELECT *, i - max(CASE WHEN action = 'SELL' THEN i END) OVER w AS sale, i - max(CASE WHEN action = 'TRIM' THEN i END) OVER w AS trim_ FROM n WINDOW w AS (PARTITION BY symbol ORDER BY day_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, CASE WHEN conviction = 'PROBE' AND shares = 0 AND coalesce(sale <= 3, FALSE) AND coalesce(grade, 'C') <> 'S' THEN 'SKIP' ELSE conviction END AS conviction,
  CASE WHEN action = 'ADD' AND coalesce(trim_ <= 5, FALSE) THEN 'HOLD' ELSE action END AS action
FROM s
"""
QUERIES["win13_history"] = lambda s, d: episode.history(bind(s, d, LEDGER), ["symbol"], "day_index", "close", 5, "h").select("id", F.size("h").cast("long").alias("n"), F.get("h", F.lit(0)).alias("oldest"), F.element_at("h", -1).alias("latest"))
SQL["win13_history"] = f"SELECT id, least(row_number() OVER w, 5) AS n, first_value(close) OVER (PARTITION BY symbol ORDER BY day_index ROWS 4 PRECEDING) AS oldest, close AS latest FROM ({LEDGER}) WINDOW w AS (PARTITION BY symbol ORDER BY day_index)"
QUERIES["agg26_coverage"] = lambda s, d: episode.coverage(bind(s, d, LEDGER), ["symbol"], "day")
SQL["agg26_coverage"] = f"SELECT symbol, count(*) AS bars, min(day) AS first, max(day) AS last FROM ({LEDGER}) GROUP BY 1"
_skip = "CASE WHEN close <= 0 THEN 'no price' WHEN trim(coalesce(journal, '')) = '' THEN 'no journal' WHEN shares = 0 THEN 'no shares' END"
QUERIES["agg23_skip_tallies"] = lambda s, d: episode.tallies(bind(s, d, LEDGER), F.expr(_skip))
SQL["agg23_skip_tallies"] = f"SELECT {_skip} AS reason, count(*) AS n FROM ({LEDGER}) WHERE {_skip} IS NOT NULL GROUP BY 1"
QUERIES["top8_bar_at"] = lambda s, d: episode.bar_at(table(s, d, "events"), ["user_id"], F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.to_date("ts"), "event_id", "2024-01-05 10")
SQL["top8_bar_at"] = "SELECT user_id, coalesce(max(CASE WHEN contains(strftime(ts, '%Y-%m-%d %H:%M:%S'), '2024-01-05 10') THEN event_id END), max(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-05' THEN event_id END)) AS at FROM events GROUP BY 1"
QUERIES["flt9_train_rows"] = lambda s, d: episode.train_rows(bind(s, d, PATTERNS), "", "2024-02-01", "2024-06-30").select("id", "as_of_date")
SQL["flt9_train_rows"] = f"SELECT id, as_of_date FROM ({PATTERNS}) WHERE as_of_date BETWEEN DATE '2024-02-01' AND DATE '2024-06-30'"
QUERIES["jon16_train_end"] = lambda s, d: (lambda p: p.filter(F.col("as_of_date") == episode.train_end(p, "")).select("id", "as_of_date"))(bind(s, d, PATTERNS))
SQL["jon16_train_end"] = f"SELECT id, as_of_date FROM ({PATTERNS}) WHERE as_of_date = (SELECT max(as_of_date) FROM ({PATTERNS}))"


def latencies(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("value") * 10).alias("ms"))
    mean = e.groupBy("event_type").agg(F.avg("ms").alias("mean_ms"))
    both = mean.join(ev.nearest_ranks(e, ["event_type"], "ms", {"p99": 0.99}), "event_type")
    return both.select("event_type", F.round("mean_ms", 6).alias("mean_ms"), "p99", episode.feasibility(F.col("mean_ms"), F.lit(0.9995)).alias("x")).select("event_type", "mean_ms", "p99", "x.*")


QUERIES["agg28_latency"] = latencies
SQL["agg28_latency"] = "SELECT event_type, round(avg(value * 10), 6) AS mean_ms, quantile_disc(value * 10, 0.99) AS p99, CASE WHEN avg(value * 10) < 500 THEN 'GO' WHEN avg(value * 10) < 2000 THEN 'GO_WITH_CAVEATS' ELSE 'NO_GO' END AS verdict, TRUE AS stable FROM events GROUP BY 1"
