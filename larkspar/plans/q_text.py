"""Snapshot projection, provenance, transcripts, scalars, sources and sinks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import snapshot as sn
from ..functions import text as tx
from ..operators import provenance as pv
from ..operators import tensor, transcript
from ..sources import readers, sinks
from ..streaming import queue
from .bindings import CHATS, LEDGER, PATTERNS, SNAPSHOTS, bind, table

QUERIES, SQL = {}, {}


def docs(s, d):
    return bind(s, d, SNAPSHOTS, dealt=True).withColumn("doc", sn.parse(F.col("snapshot")))


DOCS = f"WITH s AS (SELECT event_id, snapshot::JSON AS j FROM ({SNAPSHOTS}))"
x = lambda p: f"json_extract_string(j, '$.{p}')"
true = lambda p: f"coalesce({x(p)} NOT IN ('false', '0', '0.0', '', '[]', '{{}}'), FALSE)"
first_true = lambda *ps: "coalesce(" + ", ".join(f"CASE WHEN {x(p)} IS NOT NULL THEN {true(p)} END" for p in ps) + ", FALSE)"
num = lambda p, dflt: f"coalesce(TRY_CAST({x(p)} AS DOUBLE), {dflt})"
there = lambda p: f"json_exists(j, '$.{p}')"
is_obj = lambda p: f"coalesce(json_type(j, '$.{p}') = 'OBJECT', FALSE)"
whole = lambda p: f"coalesce(CAST(round_even(TRY_CAST({x(p)} AS DOUBLE), 0) AS BIGINT), 0)"

QUERIES["prj1_dig"] = lambda s, d: table(s, d, "events").select("event_id", sn.number(sn.parse(F.col("props")), "k").alias("k"), sn.text(sn.parse(F.col("props")), "a.b").alias("gone"))
SQL["prj1_dig"] = "SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k, json_extract_string(props, '$.a.b') AS gone FROM events"
QUERIES["prj2_first_non_null"] = lambda s, d: docs(s, d).select("event_id", sn.dig(F.col("doc"), "chan.bsp.latest.side", "chan.bsp.latest_confirmed.side").alias("side"))
SQL["prj2_first_non_null"] = DOCS + f" SELECT event_id, coalesce({x('chan.bsp.latest.side')}, {x('chan.bsp.latest_confirmed.side')}) AS side FROM s"
QUERIES["prj3_contract_facts"] = lambda s, d: docs(s, d).select("event_id", F.explode(tensor.facts(F.col("doc"))).alias("path", "value"))
SQL["prj3_contract_facts"] = DOCS + " " + " UNION ALL ".join(f"SELECT event_id, '{p}' AS path, {x(p)} AS value FROM s" for p in tensor.CONTRACT)
QUERIES["prj4_validate"] = lambda s, d: sn.add(docs(s, d), "doc", "v", tensor.validate).select("event_id", "v.ok", F.array_join("v.envelope_errors", ",").alias("envelope"), F.array_join("v.missing_paths", ",").alias("missing"))
_env = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT {there(k)} THEN '{k}' END" for k in tensor.ENVELOPE) + ")"
_mis = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT {there(k)} THEN '{k}' END" for k in tensor.CONTRACT) + ")"
SQL["prj4_validate"] = DOCS + f" SELECT event_id, {_env} = '' AND {_mis} = '' AS ok, {_env} AS envelope, {_mis} AS missing FROM s"
QUERIES["prj5_casts"] = lambda s, d: docs(s, d).select("event_id", sn.to_float(sn.text(F.col("doc"), "v8_score.setup_score"), -1.0).alias("f"), sn.to_int(sn.text(F.col("doc"), "v8_score.overheat_index")).alias("i"))
SQL["prj5_casts"] = DOCS + f" SELECT event_id, {num('v8_score.setup_score', -1)} AS f, {whole('v8_score.overheat_index')} AS i FROM s"

FLAT = ["symbol", "as_of_date", "grade", "global_regime.*", "structure.*", "ignition.*", "volume.*", "risk.*", "is_lethal"]


def alpha(mode):
    return lambda s, d: tensor.project(bind(s, d, SNAPSHOTS, dealt=True), mode=mode).select("event_id", "tensor.*").select("event_id", *FLAT)


def bsp_sql(strict):
    out = []
    for p in ("chan.bsp.latest_confirmed", "chan.bsp.latest", "chan.bsp.latest_candidate"):
        side, types = x(p + ".side"), f"json_extract_string(j, '$.{p}.types[*]')"
        label = f"CASE WHEN {side} IN ('买', 'buy', 'long') THEN '买点' WHEN coalesce({side}, '') <> '' THEN '卖点' ELSE '' END"
        listed = f"CASE WHEN len({types}) > 0 THEN '·' || array_to_string({types}, '/') ELSE '' END"
        out.append(f"CASE WHEN {is_obj(p)} THEN '缠论' || {label} || {listed} END")
    return "coalesce(" + ", ".join(out) + ", '无')"


def alpha_sql(strict):
    flag = first_true if strict else (lambda *ps: "(" + " OR ".join(true(p) for p in ps) + ")")
    fake = "trap_detection.pump_fake"
    ratio = num("ls1_supercharged.three_push.pump_dump_vol_ratio", 1.0)
    trapped = f"({is_obj(fake)} AND {true(fake + '.is_trap')})"
    inferred = f"(NOT {is_obj(fake)})" if strict else f"(NOT {is_obj(fake)} AND {true(fake)})"
    trap = f"CASE WHEN {is_obj(fake)} THEN {trapped} WHEN {inferred} THEN {ratio} < 0.2 ELSE FALSE END"
    grade = f"coalesce({x('v8_score.grade')}, '?')" if strict else f"coalesce(nullif({x('v8_score.grade')}, ''), 'C')"
    regime = "'range'" if strict else f"CASE WHEN {x('macro_sentinel.regime')} IN ('bull', 'bear', 'range', 'crash') THEN {x('macro_sentinel.regime')} ELSE 'range' END"
    toxic = f"({true('v8_score.toxic_breaker')}{' OR ' + true('v8_score.toxic_breaker_factors') if strict else ''})"
    systemic = flag("macro_sentinel.hard_block", "crash_signals.panic_reversal.detected")
    stage = f"coalesce({x('chan.stage_code')}, '')"
    base = f"CASE {stage} WHEN 'forming' THEN '震荡构筑' WHEN 'developing' THEN '洗盘吸收' WHEN 'mature' THEN '洗盘吸收就绪' WHEN '' THEN '震荡' ELSE {stage} END"
    phase = f"{base} || CASE WHEN {true('compression_setup.is_ready')} THEN '·就绪' WHEN {true('ls1_supercharged.spring.coiling')} AND {true('compression_setup.is_range_compressed')} THEN '·盘整压缩' WHEN {true('compression_setup.is_range_compressed')} THEN '·区间压缩' ELSE '' END"
    macd = f"CASE WHEN contains(lower({x('indicators.macd.state')}), 'golden') THEN 'golden' WHEN contains(lower({x('indicators.macd.state')}), 'dead') THEN 'dead' ELSE 'none' END"
    named = f"CASE WHEN {true(fake + '.trap_type')} THEN {x(fake + '.trap_type')} ELSE 'none' END"
    over = whole("v8_score.overheat_index")
    return DOCS + f""" SELECT event_id, {x('symbol')} AS symbol, coalesce({x('as_of_date')}, '{'' if strict else '2026-01-01 10:00:00'}') AS as_of_date, {grade} AS grade, {regime} AS market_regime, 'normal' AS vol_regime, 'neutral' AS iron_verdict, {systemic} AS systemic_risk_flag,
    {bsp_sql(strict)} AS chan_bsp, {num('v8_score.setup_score', 0.0)} AS setup_score, {whole('chan.zs_count')} AS zs_count, {phase} AS consolidation_phase, FALSE AS gann_support, {flag('compression_setup.is_bb_squeeze', 'compression_setup.is_range_compressed')} AS bollinger_squeeze, '缠绕' AS ma_alignment,
    {num('v8_score.ignition_score', 0.0)} AS ignition_score, {macd} AS macd_cross, {flag('ls1_supercharged.spring.launch', 'intraday_volume_structure.launch_signal')} AS ignition_bar_present, {flag('breakout.breakout_60d', 'ls1_supercharged.spring.breakout_60d')} AS breakout_confirmed, 0.0::DOUBLE AS fund_inflow_intensity,
    {num('momentum.vol_ratio_5d', 1.0)} AS volume_ratio_5d, 0.0::DOUBLE AS turnover_rate, CASE WHEN {trapped} THEN {num(fake + '.volume_ratio', 1.0)} ELSE {ratio} END AS pump_dump_vol_ratio, {true('trap_detection.volume_gap.is_gap')} AS volume_gap_detected,
    {over} AS overheat_index, {trap} AS is_trap, CASE WHEN {inferred} THEN CASE WHEN {ratio} < 0.2 THEN 'pump_fake' ELSE 'none' END ELSE {named} END AS trap_type, CASE WHEN {is_obj(fake)} THEN coalesce({x(fake + '.details')}, '') ELSE '' END AS trap_details, {toxic} AS toxic_breaker,
    {systemic} OR ({trap}) OR {over} >= 6 OR {toxic} AS is_lethal FROM s"""


QUERIES["prj15_alpha_tensor_any_true"] = alpha("any_true")
SQL["prj15_alpha_tensor_any_true"] = alpha_sql(False)
QUERIES["prj15_alpha_tensor_first_non_null"] = alpha("first_non_null")
SQL["prj15_alpha_tensor_first_non_null"] = alpha_sql(True)
QUERIES["prj16_lethal_by_grade"] = lambda s, d: tensor.project(bind(s, d, SNAPSHOTS)).groupBy("tensor.grade").agg(F.count_if("tensor.is_lethal").alias("lethal"), F.count("*").alias("n"))
SQL["prj16_lethal_by_grade"] = f"SELECT grade, count(*) FILTER (is_lethal) AS lethal, count(*) AS n FROM ({alpha_sql(False)}) GROUP BY 1"

_types = "json_extract_string(j, '$.chan.bsp.latest.types[*]')"
_width = "CASE WHEN json_array_length(j, '$.chan.pivot.range') = 2 THEN json_extract_string(j, '$.chan.pivot.range[1]')::DOUBLE - json_extract_string(j, '$.chan.pivot.range[0]')::DOUBLE END"
_tier = lambda k, some: f"CASE WHEN {some} THEN (len(list_filter({_types}, lambda t: starts_with(t, 'T{k}') OR t IN ('{k}buy', '{k}sell'))) > 0)::INT::DOUBLE END"
QUERIES["prj19_feature_vector"] = lambda s, d: sn.add(docs(s, d), "doc", "v", tensor.feature_vector).select(
    "event_id", *[F.nanvl(F.get("v", F.lit(list(tensor.RAW_FEATURES).index(n))), F.lit(-99.0)).alias(n) for n in ("zs_count", "pivot_pct_in_range", "pivot_range_width", "trend_type_encoded", "stage_code_encoded", "vol_ratio_5d", "rsi", "macd_hist", "consecutive_up_days", "bsp_side_encoded", "bsp_type_t1", "bsp_type_t2", "bsp_type_t3")],
    F.size(tensor.missing_features(F.col("v"))).cast("long").alias("n_missing"),
)
SQL["prj19_feature_vector"] = DOCS + f""", f AS (SELECT event_id, {x('chan.zs_count')}::DOUBLE AS zs_count, {x('chan.pivot.pct_in_range')}::DOUBLE AS pivot_pct_in_range, {_width} AS pivot_range_width, CASE {x('chan.trend_type')} WHEN 'UpTrend' THEN 2.0 WHEN 'down_trend' THEN 0.0 ELSE 0.5 END AS trend_type_encoded,
CASE {x('chan.stage_code')} WHEN 'forming' THEN 1.0 WHEN 'developing' THEN 2.0 WHEN 'mature' THEN 3.0 ELSE CASE WHEN {x('chan.stage_code')} IS NOT NULL THEN 0.0 END END AS stage_code_encoded, -99.0::DOUBLE AS vol_ratio_5d, {x('indicators.rsi.value')}::DOUBLE AS rsi, {x('indicators.macd.hist')}::DOUBLE AS macd_hist, {x('momentum.consecutive_up_days')}::DOUBLE AS consecutive_up_days,
CASE {x('chan.bsp.latest.side')} WHEN 'buy' THEN 1.0 WHEN 'sell' THEN -1.0 END AS bsp_side_encoded, {_tier(1, is_obj('chan.bsp.latest'))} AS bsp_type_t1, {_tier(2, is_obj('chan.bsp.latest'))} AS bsp_type_t2, {_tier(3, is_obj('chan.bsp.latest'))} AS bsp_type_t3 FROM s)
SELECT event_id, zs_count, pivot_pct_in_range, coalesce(pivot_range_width, -99) AS pivot_range_width, trend_type_encoded::DOUBLE AS trend_type_encoded, coalesce(stage_code_encoded, -99)::DOUBLE AS stage_code_encoded, vol_ratio_5d, rsi, macd_hist, consecutive_up_days, coalesce(bsp_side_encoded, -99)::DOUBLE AS bsp_side_encoded, coalesce(bsp_type_t1, -99) AS bsp_type_t1, coalesce(bsp_type_t2, -99) AS bsp_type_t2, coalesce(bsp_type_t3, -99) AS bsp_type_t3,
18 + (pivot_range_width IS NULL)::INT + (stage_code_encoded IS NULL)::INT + (bsp_side_encoded IS NULL)::INT + 3 * (bsp_type_t1 IS NULL)::INT AS n_missing FROM f"""
#: Numbers of the 34 values with their path and default; the others are worked out from codes, lists and sides.
NUMBERS = {
    "structure": {"zs_count": ("chan.zs_count", 0), "bi_count": ("chan.bi_count", 0), "seg_count": ("chan.seg_count", 0), "pivot_pct_in_range": ("chan.pivot.pct_in_range", 0)},
    "volume": {"cvd": ("volume.consecutive_vol_days", 0), "vol_ratio_5d": ("volume.vol_ratio_5d", 1), "shrink_days": ("volume.shrink_days", 0), "fake_out_days": ("volume.fake_out_days", 0), "vol_up_down_ratio": ("momentum.vol_up_down_ratio", 1)},
    "momentum": {"rsi": ("indicators.rsi.value", 50), "macd_hist": ("indicators.macd.hist", 0), "adx": ("indicators.adx.value", 0), "bb_pct_b": ("indicators.bb.pct_b", 0.5), "return_1d": ("momentum.return_1d", 0), "rsi_momentum_5d": ("momentum.rsi_momentum_5d", 0), "consecutive_up_days": ("momentum.consecutive_up_days", 0)},
    "risk": {"overheat_index": ("v8_score.overheat_index", 0), "fever_penalty_raw": ("v8_score.details.fever_penalty_raw", 0), "toxic_penalty": ("v8_score.details.toxic_penalty", 0)},
    "chan_bsp": {"macd_area_ratio": ("chan.macd_divergence.area_ratio", 0)},
    "score_ref": {n: (f"v8_score.{n}", 0) for n in ("setup_score", "ignition_score", "left_total", "right_total")},
}


def beta(s, d):
    """All 34 values, each from its block, with the vector's lengths."""
    b = sn.add(docs(s, d), "doc", "b", tensor.beta_tensor)
    values = [F.col(f"b.{block}.{name}").cast("double").alias(f"{block}_{name}") for block, names in tensor.BLOCKS.items() for name in names]
    return b.select("event_id", "b.grade", "b.symbol", "b.as_of_date", *values, F.size(tensor.to_vector(F.col("b"))).alias("dims"), F.size(tensor.to_vector(F.col("b"), blind=False)).alias("all_dims"))


QUERIES["prj17_beta_tensor"] = beta
_side = f"CASE WHEN {is_obj('chan.bsp.latest')} THEN {x('chan.bsp.latest.side')} ELSE {x('chan.bsp.latest_confirmed.side')} END"
_best_types = f"CASE WHEN {is_obj('chan.bsp.latest')} THEN json_extract_string(j, '$.chan.bsp.latest.types[*]') ELSE json_extract_string(j, '$.chan.bsp.latest_confirmed.types[*]') END"
_worked = {
    "structure_pivot_range_width": f"coalesce({_width}, 0.0)", "structure_pivot_core_width": "0.0",
    "structure_trend_type_encoded": f"CASE {x('chan.trend_type')} WHEN 'UpTrend' THEN 2.0 WHEN 'down_trend' THEN 0.0 ELSE 0.5 END", "structure_stage_code_encoded": f"CASE {x('chan.stage_code')} WHEN 'forming' THEN 1.0 WHEN 'developing' THEN 2.0 WHEN 'mature' THEN 3.0 ELSE 0.0 END",
    "risk_toxic_breaker_count": "coalesce(json_array_length(j, '$.v8_score.toxic_breaker_factors'), 0)", "chan_bsp_bsp_side_encoded": f"CASE {_side} WHEN 'buy' THEN 1.0 WHEN 'sell' THEN -1.0 ELSE 0.0 END", "chan_bsp_macd_divergence": "0.0",
    **{f"chan_bsp_bsp_type_t{k}": f"CASE WHEN len(list_filter({_best_types}, lambda t: starts_with(t, 'T{k}') OR t IN ('{k}buy', '{k}sell'))) > 0 THEN 1.0 ELSE 0.0 END" for k in (1, 2, 3)},
}
_worked |= {f"{b}_{n}": num(path, default) for b, names in NUMBERS.items() for n, (path, default) in names.items()}
SQL["prj17_beta_tensor"] = DOCS + f" SELECT event_id, coalesce({x('v8_score.grade')}, '?') AS grade, coalesce({x('symbol')}, 'UNKNOWN') AS symbol, coalesce({x('as_of_date')}, '') AS as_of_date, {', '.join(f'({sql})::DOUBLE AS {name}' for name, sql in _worked.items())}, 30 AS dims, 34 AS all_dims FROM s"

# ---- provenance ----------------------------------------------------------------------

CASES = {"rul4_discipline_flags": (lambda: pv.discipline(F.col("said"), F.col("reply"), F.col("action")),
    "contains(lower(reply), 'overheat') AS short_term_risk, FALSE AS long_term_size, contains(lower(said), 'winner') AND contains(lower(said), 'loser') AS winner_for_loser, contains(lower(said), 'panic') OR action = 'PANIC_SELL' AS panic_exit, contains(lower(said), 'override') AS fundamental_override, CASE WHEN contains(said, '0.5') THEN 0.5 WHEN contains(said, '1.0') OR contains(lower(said), 'full') OR action = 'BUY_FULL' THEN 1.0 WHEN contains(said, '0.1') THEN 0.1 WHEN contains(said, '0.3') THEN 0.3 ELSE 1.0 END::DOUBLE AS sizing_pct")}
QUERIES["rul4_discipline_flags"] = lambda s, d: bind(s, d, CHATS).select("conv_id", "turn", CASES["rul4_discipline_flags"][0]().alias("x")).select("conv_id", "turn", "x.*")
SQL["rul4_discipline_flags"] = f"SELECT conv_id, turn, {CASES['rul4_discipline_flags'][1]} FROM ({CHATS})"
LABEL = "CASE WHEN r5 IS NULL THEN 'NEUTRAL' WHEN contains(action, 'BUY') AND NOT contains(action, 'NO') AND r5 >= 0.02 THEN 'TRUE_POSITIVE' WHEN contains(action, 'BUY') AND NOT contains(action, 'NO') AND r5 <= -0.02 THEN 'FALSE_POSITIVE' WHEN action IN ('NO_BUY', 'AVOID') AND r5 <= -0.02 THEN 'TRUE_NEGATIVE' WHEN action IN ('NO_BUY', 'AVOID') AND r5 >= 0.02 THEN 'FALSE_NEGATIVE' ELSE 'NEUTRAL' END"
QUERIES["rul1_outcome_label"] = lambda s, d: bind(s, d, CHATS).select("conv_id", "turn", pv.outcome_label(F.col("action"), F.col("r5")).alias("label"))
SQL["rul1_outcome_label"] = f"SELECT conv_id, turn, {LABEL} AS label FROM ({CHATS})"
QUERIES["rul2_diagnosis"] = lambda s, d: bind(s, d, CHATS).select("conv_id", "turn", pv.diagnose(F.col("lethal"), F.col("grade"), pv.outcome_label(F.col("action"), F.col("r5")), F.col("action") == "PANIC_SELL", F.coalesce("r5", F.lit(0.0)), F.col("r10"), F.lit(1.0)).alias("diagnosis"))
SQL["rul2_diagnosis"] = f"WITH c AS (SELECT *, {LABEL} AS label, action = 'PANIC_SELL' AS panic FROM ({CHATS})) SELECT conv_id, turn, CASE WHEN NOT lethal AND label = 'TRUE_POSITIVE' AND NOT panic THEN 'no_error' WHEN lethal AND label = 'TRUE_NEGATIVE' THEN 'no_error' WHEN panic AND r10 >= 0.02 THEN 'beta_error' WHEN NOT lethal AND label = 'FALSE_POSITIVE' AND NOT panic THEN 'alpha_error' WHEN grade IN ('S', 'A') AND lethal AND coalesce(r5, 0) <= -0.02 THEN 'scoring_error' WHEN lethal THEN 'mixed_error' ELSE 'no_error' END AS diagnosis FROM c"
QUERIES["rul3_sandbox_diagnosis"] = lambda s, d: bind(s, d, CHATS).select("conv_id", "turn", pv.diagnose_sandbox(F.col("action"), F.when(F.col("turn") % 3 == 0, "missed_entry").when(F.col("turn") % 3 == 1, "false_breakout").otherwise("healthy_washout"), F.coalesce("r5", F.lit(0.0)), F.col("conv_id") % 2 == 0, F.col("lethal"), F.col("conv_id") % 3 == 0, F.col("grade"), F.col("conv_id") % 5 == 0, F.lit("p")).alias("diagnosis"))
SQL["rul3_sandbox_diagnosis"] = f"SELECT conv_id, turn, CASE WHEN starts_with(action, 'BUY') AND conv_id % 2 = 0 AND NOT lethal AND coalesce(r5, 0) < -0.02 THEN 'beta_error' WHEN turn % 3 = 0 AND conv_id % 3 = 0 AND grade IN ('B', 'C', 'D') THEN 'scoring_error' WHEN turn % 3 = 1 AND conv_id % 5 = 0 THEN 'alpha_error' WHEN turn % 3 = 2 AND NOT lethal THEN 'no_error' WHEN lethal AND coalesce(r5, 0) <= -0.02 THEN 'scoring_error' ELSE 'no_error' END AS diagnosis FROM ({CHATS})"


def replay(s, d):
    c = bind(s, d, CHATS).select("conv_id", "turn", F.col("said").alias("raw_text"), F.col("reply").alias("agent_reply"), F.col("action").alias("human_action"), F.when(F.col("r5").isNotNull(), F.array(F.lit(10.0), F.lit(10.0), 10 * (1 + F.col("r10")))).alias("prices"), F.struct(F.col("lethal").alias("is_lethal"), "grade", F.lit("S").alias("symbol"), F.lit("2026-01-01").alias("as_of_date"), F.struct(F.lit(1.5).alias("overheat_index"), F.lit(False).alias("is_trap")).alias("risk"), F.struct(F.lit("range").alias("market_regime")).alias("global_regime")).alias("tensor"))
    return pv.replay(c).select("conv_id", "turn", F.round("outcome.return_t5", 6).alias("r5"), F.round("outcome.mae", 6).alias("mae"), F.round("outcome.return_t1", 6).alias("r1"), "outcome.outcome_label")


QUERIES["api9_replay"] = replay
SQL["api9_replay"] = f"WITH c AS (SELECT conv_id, turn, action, r5 IS NOT NULL AS has, CASE WHEN r5 IS NOT NULL THEN r10::DOUBLE ELSE 0 END AS r FROM ({CHATS})) SELECT conv_id, turn, round(r, 6) AS r5, round(least(r, 0), 6) AS mae, 0.0::DOUBLE AS r1, CASE WHEN contains(action, 'BUY') AND NOT contains(action, 'NO') AND r >= 0.02 THEN 'TRUE_POSITIVE' WHEN action IN ('NO_BUY', 'AVOID') AND r >= 0.02 THEN 'FALSE_NEGATIVE' ELSE 'NEUTRAL' END AS outcome_label FROM c"
QUERIES["rul13_forward_label"] = lambda s, d: bind(s, d, PATTERNS).select("id", *[pv.forward_label(h, F.col("fwd_return_T10")).alias(h.lower()) for h in ("T5", "T10", "T20")])
SQL["rul13_forward_label"] = f"SELECT id, {', '.join(f'CASE WHEN fwd_return_T10 >= {a} THEN {chr(39)}true_S{chr(39)} WHEN fwd_return_T10 <= {b} THEN {chr(39)}stale_S{chr(39)} ELSE {chr(39)}neutral{chr(39)} END AS {h}' for h, a, b in (('t5', 3, -2), ('t10', 5, -3), ('t20', 8, -5)))} FROM ({PATTERNS})"

# ---- transcripts and text ------------------------------------------------------------

SAID = "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'User: ' WHEN 1 THEN 'assistant:' WHEN 2 THEN 'bot: ' ELSE '' END || text || chr(10) || '  ' || chr(10) || CASE conv_id % 3 WHEN 0 THEN 'agent: watch 600519.sh and monitor: 000001.SZ because of volume' ELSE 'I decided: wait' END AS said FROM conversations"


def said(s, d):
    return s.sql(SAID.replace("FROM conversations", "FROM {c}").replace("chr(10)", "char(10)"), c=table(s, d, "conversations"))


EVENTS = f"WITH l AS (SELECT conv_id, turn, unnest(range(len(regexp_split_to_array(said, '\\r\\n|\\r|\\n')))) AS line, trim(unnest(regexp_split_to_array(said, '\\r\\n|\\r|\\n'))) AS raw FROM ({SAID})), e AS (SELECT conv_id, turn, line, CASE WHEN regexp_matches(raw, '(?i)^(user|assistant|human|agent|system)\\s*:\\s*(.+)$') THEN lower(regexp_extract(raw, '(?i)^(user|assistant|human|agent|system)\\s*:\\s*(.+)$', 1)) ELSE 'unknown' END AS role, CASE WHEN regexp_matches(raw, '(?i)^(user|assistant|human|agent|system)\\s*:\\s*(.+)$') THEN trim(regexp_extract(raw, '(?i)^(user|assistant|human|agent|system)\\s*:\\s*(.+)$', 2)) ELSE raw END AS text FROM l WHERE raw <> '')"
QUERIES["src15_transcript_events"] = lambda s, d: transcript.events(said(s, d), "said", "chat", "conv_id", "turn").select("conv_id", "turn", F.col("line").cast("long").alias("line"), "role", "text")
SQL["src15_transcript_events"] = EVENTS + " SELECT conv_id, turn, line, role, text FROM e"
QUERIES["api8_decision_atoms"] = lambda s, d: transcript.atoms(transcript.events(said(s, d), "said", "chat", "conv_id", "turn"), "conv_id", "turn", "line").select("conv_id", "turn", F.col("line").cast("long").alias("line"), "atom_type", "symbol", "text")
SQL["api8_decision_atoms"] = EVENTS + r""", w AS (SELECT conv_id, turn, line, text, unnest(regexp_extract_all(text, '(?i)(watch|观察|关注|跟踪|monitor)\s*[:：]?\s*(\d{6}\.(?:SH|SZ))', 2)) AS s FROM e)
SELECT conv_id, turn, line, 'watch_idea' AS atom_type, upper(s) AS symbol, substr(text, 1, 500) AS text FROM w UNION ALL
SELECT conv_id, turn, line, 'decision_rationale', NULL, substr(trim(regexp_extract(text, '(?i)(because|原因|理由|rationale|decided|决定)\s*[:：]?\s*(.+)', 2)), 1, 800) FROM e WHERE regexp_extract(text, '(?i)(because|原因|理由|rationale|decided|决定)\s*[:：]?\s*(.+)', 2) <> ''"""
QUERIES["prj23_redaction"] = lambda s, d: table(s, d, "conversations").select("conv_id", "turn", tx.redact_user(F.col("text")).alias("u"), tx.redact_agent(F.col("text")).alias("a"))
SQL["prj23_redaction"] = "WITH c AS (SELECT conv_id, turn, trim(coalesce(text, ''), ' ') AS t FROM conversations) SELECT conv_id, turn, CASE WHEN t = '' THEN '(redacted)' WHEN length(t) > 120 THEN substr(t, 1, 117) || '...' ELSE t END AS u, CASE WHEN t = '' THEN '(redacted)' WHEN length(t) > 200 THEN substr(t, 1, 197) || '...' ELSE t END AS a FROM c"
QUERIES["prj28_distil_lesson"] = lambda s, d: bind(s, d, CHATS).select("conv_id", "turn", pv.distil(F.lit("rule"), F.col("grade"), F.lit("2026-01-02 10:00"), F.col("text")).alias("lesson"))
SQL["prj28_distil_lesson"] = f"SELECT conv_id, turn, '[rule] ' || grade || ' @ 2026-01-02: ' || substr(text, 1, 400) AS lesson FROM ({CHATS})"
QUERIES["prj27_keywords_and_path"] = lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(tx.keywords(F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.array("p_brand", "p_type"))).otherwise(F.concat_ws(", ", "p_brand", "p_type", F.lit("")))), "|").alias("words"), tx.memory_path(F.concat(F.lit("//a\\b/"), F.col("p_brand"))).alias("path"))
SQL["prj27_keywords_and_path"] = "SELECT p_partkey, p_brand || '|' || p_type AS words, 'memory/a/b/' || p_brand AS path FROM part"
QUERIES["rul12_market_clock"] = lambda s, d: table(s, d, "events").select("event_id", tx.market_clock(F.col("ts")).alias("phase"))
SQL["rul12_market_clock"] = "WITH t AS (SELECT event_id, ts + INTERVAL 8 HOUR AS t FROM events), m AS (SELECT event_id, isodow(t) AS d, hour(t) * 60 + minute(t) AS m FROM t) SELECT event_id, CASE WHEN d >= 6 OR m >= 900 THEN '/trading/equity/daily_review' WHEN m >= 555 AND m < 600 THEN '/trading/equity/ops/T0' WHEN m >= 555 AND m < 900 THEN '/trading/equity/journal/positions' ELSE '' END AS phase FROM m"
QUERIES["emb8_time_features"] = lambda s, d: table(s, d, "events").select("event_id", F.array_join(F.transform(tx.time_stamp_features(F.col("ts")), lambda v: v.cast("int").cast("string")), ",").alias("features"))
SQL["emb8_time_features"] = "SELECT event_id, concat_ws(',', minute(ts), hour(ts), isodow(ts) - 1, day(ts), month(ts)) AS features FROM events"
QUERIES["prj39_facade_helpers"] = lambda s, d: table(s, d, "orders").select("o_orderkey", tx.as_bool(F.when(F.col("o_orderkey") % 3 == 0, " Yes ").when(F.col("o_orderkey") % 3 == 1, "off")).alias("flag"), tx.tool_name(F.concat(F.lit("t_"), "o_orderstatus"), "t_").alias("tool"))
SQL["prj39_facade_helpers"] = "SELECT o_orderkey, o_orderkey % 3 = 0 AS flag, o_orderstatus AS tool FROM orders"

# ---- sources and sinks ---------------------------------------------------------------


def queue_rows(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 4 == 0, "pending").when(F.col("event_id") % 4 == 1, "").when(F.col("event_id") % 4 == 2, "synced").alias("status"), (F.col("event_id") % 3).cast("int").alias("retry_count"), F.lit(None).cast("string").alias("error"))


QUERIES["src14_pending_queue"] = lambda s, d: readers.pending(queue_rows(s, d)).select("id", "created_at")
SQL["src14_pending_queue"] = "SELECT event_id AS id, ts AS created_at FROM events WHERE event_id % 4 <> 2"
QUERIES["snk21_settle_queue"] = lambda s, d: queue.settle(queue_rows(s, d), table(s, d, "events").filter("event_id % 5 < 2").select(F.col("event_id").alias("id"), (F.col("event_id") % 5 == 0).alias("ok"), F.lit("e" * 1200).alias("error"))).select("id", "status", F.col("retry_count").cast("long").alias("retry_count"), F.length("error").cast("long").alias("error_length"))
SQL["snk21_settle_queue"] = "WITH q AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN '' WHEN 2 THEN 'synced' END AS status, event_id % 3 AS n, CASE event_id % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS ok FROM events) SELECT id, CASE WHEN ok THEN 'synced' WHEN NOT ok THEN CASE WHEN n + 1 >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS status, n + CASE WHEN NOT ok THEN 1 ELSE 0 END AS retry_count, CASE WHEN NOT ok THEN 1000 END AS error_length FROM q"
QUERIES["snk1_upsert_keep_last"] = lambda s, d: sinks.upserted(table(s, d, "customer").select("c_custkey", "c_acctbal"), sinks.keep_last(table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), "o_orderkey"), ["c_custkey"], ["o_orderkey"]).drop("o_orderkey"), ["c_custkey"])
SQL["snk1_upsert_keep_last"] = "WITH n AS (SELECT o_custkey AS c_custkey, max_by(o_totalprice, o_orderkey) AS c_acctbal FROM orders GROUP BY 1) SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n"
QUERIES["snk3_coalesced_update"] = lambda s, d: sinks.coalesced_update(table(s, d, "part").select("p_partkey", "p_brand", "p_size"), table(s, d, "part").filter("p_partkey % 3 = 0").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "new").alias("p_brand")), ["p_partkey"], ["p_brand"])
SQL["snk3_coalesced_update"] = "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'new' ELSE p_brand END AS p_brand, p_size FROM part"
QUERIES["snk9_schema_evolution"] = lambda s, d: sinks.evolve(table(s, d, "nation").select("n_nationkey", "n_name"), table(s, d, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("region")))
SQL["snk9_schema_evolution"] = "SELECT n_nationkey, n_name, NULL AS region FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region"
QUERIES["snk12_json_lines"] = lambda s, d: sinks.to_json_rows(table(s, d, "nation").select("n_nationkey", "n_name"))
SQL["snk12_json_lines"] = """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS value FROM nation"""
QUERIES["snk10_ghost_trades"] = lambda s, d: sinks.ghost_trades(table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, 5).alias("horizon"), F.lit(None).cast("int").alias("days")))
SQL["snk10_ghost_trades"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 20 END AS horizon, 0 AS days FROM orders"
QUERIES["src12_semi_join"] = lambda s, d: readers.existing(table(s, d, "customer").select("c_custkey"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])
SQL["src12_semi_join"] = "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"
QUERIES["jon12_anti_join"] = lambda s, d: readers.unseen(
    table(s, d, "customer").select("c_custkey"), table(s, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]
)
SQL["jon12_anti_join"] = "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"
QUERIES["set2_distinct_cohorts"] = lambda s, d: bind(s, d, PATTERNS).select("symbol", F.size("vec").alias("dims")).distinct()
SQL["set2_distinct_cohorts"] = f"SELECT DISTINCT symbol, len(vec) AS dims FROM ({PATTERNS})"
QUERIES["jon6_left_join_default"] = lambda s, d: pv.with_default(table(s, d, "customer").select("c_custkey"), table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("snapshot")), ["c_custkey"], "none")
SQL["jon6_left_join_default"] = "SELECT c_custkey, coalesce((SELECT max(o_orderpriority) FROM orders WHERE o_custkey = c_custkey), 'none') AS snapshot FROM customer"
