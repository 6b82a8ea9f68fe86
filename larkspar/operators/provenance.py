"""Decision provenance: discipline flags, outcome, diagnosis and lesson as ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

#: Words that raise a flag.
WARN_OVERHEAT, DAY_TRADE = ["overheat", "超买", "过热"], ["做t", "日内"]
WARN_SIZE = ["仓位", "不建议满仓", "风控", "风险"]
PANIC = ["慌了", "怕了", "砸了", "割肉", "急跌", "panic"]
FUNDAMENTAL = ["基本面", "研报", "业绩", "行业", "override"]
HALF, FULL, TENTH, THIRD = ["半", "一半", "0.5", "半分"], ["满仓", "梭哈", "全仓", "1.0", "full"], ["一成", "0.1"], ["三成", "0.3"]


def has_any(value: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | value.contains(w)
    return out


def discipline(raw: Column, reply: Column, action: Column) -> Column:
    """struct of five flags and the sizing share."""
    text, answer, act = (F.coalesce(f(c), F.lit("")) for f, c in ((F.lower, raw), (F.lower, reply), (F.upper, action)))
    sizing = F.when(has_any(text, HALF), 0.5).when(has_any(text, FULL) | (act == "BUY_FULL"), 1.0).when(has_any(text, TENTH), 0.1).when(has_any(text, THIRD), 0.3).otherwise(1.0)
    return F.struct(
        (has_any(answer, WARN_OVERHEAT) | has_any(text, DAY_TRADE)).alias("short_term_risk"), has_any(answer, WARN_SIZE).alias("long_term_size"),
        (text.contains("winner") & text.contains("loser")).alias("winner_for_loser"), (has_any(text, PANIC) | (act == "PANIC_SELL")).alias("panic_exit"),
        has_any(text, FUNDAMENTAL).alias("fundamental_override"), sizing.alias("sizing_pct"),
    )


def outcome_label(action: Column, r5: Column) -> Column:
    """From the action and the 5-bar return (a fraction; NULL: no prices)."""
    a = F.upper(action)
    buy = a.contains("BUY") & ~a.contains("NO")
    avoid = a.contains("NO_BUY") | a.contains("AVOID")
    return (
        F.when(r5.isNull(), "NEUTRAL").when(buy & (r5 >= 0.02), "TRUE_POSITIVE").when(buy & (r5 <= -0.02), "FALSE_POSITIVE")
        .when(avoid & (r5 <= -0.02), "TRUE_NEGATIVE").when(avoid & (r5 >= 0.02), "FALSE_NEGATIVE").otherwise("NEUTRAL")
    )


def outcome(prices: Column, action: Column) -> Column:
    """struct of returns after 1, 5, 10 and 20 prices (the last one past the end), best and worst, and the label."""
    entry, n = F.get(prices, F.lit(0)), F.size(prices)
    gain = lambda x: F.when((n > 0) & (entry > 0), (x - entry) / entry).otherwise(0.0)
    at = lambda k: gain(F.get(prices, F.least(F.lit(k), n - 1)))
    label = outcome_label(action, F.when(n > 0, at(5)))
    return F.struct(*[at(k).alias(f"return_t{k}") for k in (1, 5, 10, 20)], gain(F.array_max(prices)).alias("mfe"), gain(F.array_min(prices)).alias("mae"), label.alias("outcome_label"))


def diagnose(lethal: Column, grade: Column, label: Column, panic: Column, r5: Column, r10: Column, sizing: Column) -> Column:
    """Seven rules in order; the third can never fire, as a true positive has gained."""
    return (
        F.when(~lethal & (label == "TRUE_POSITIVE") & ~panic, "no_error").when(lethal & (label == "TRUE_NEGATIVE"), "no_error")
        .when(lethal & (label == "TRUE_POSITIVE") & (r5 <= -0.02), "beta_error").when(panic & (r10 >= 0.02), "beta_error")
        .when(~lethal & (label == "FALSE_POSITIVE") & ~panic, "alpha_error").when(F.upper(grade).isin("S", "A") & lethal & (r5 <= -0.02), "scoring_error")
        .when(lethal & (sizing > 0.8), "mixed_error").otherwise("no_error")
    )


def diagnose_sandbox(action: Column, scenario: Column, r5: Column, discouraged: Column, lethal: Column, ignition: Column, grade: Column, trap: Column, phase: Column) -> Column:
    return (
        F.when(F.upper(action).startswith("BUY") & discouraged & ~lethal & (r5 < -0.02), "beta_error")
        .when((scenario == "missed_entry") & ignition & grade.isin("B", "C", "D"), "scoring_error").when((scenario == "false_breakout") & trap, "alpha_error")
        .when((scenario == "healthy_washout") & ~lethal & (phase != ""), "no_error").when(lethal & (r5 <= -0.02), "scoring_error").otherwise("no_error")
    )


def bind(chats: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Chat events with their snapshot; the chat's symbol and time win, texts are redacted."""
    s = snapshots.select(F.col("symbol").alias("snap_symbol"), F.col("as_of_date").alias("snap_time"), "snapshot")
    j = chats.join(s, chats["symbol"] == s["snap_symbol"])
    return j.select(
        F.coalesce("symbol", "snap_symbol").alias("symbol"), F.coalesce(F.col("timestamp").cast("string"), F.col("snap_time").cast("string")).alias("as_of_time"),
        t.redact_user(F.col("user_text")).alias("user_text"), t.redact_agent(F.col("agent_text")).alias("agent_text"), F.coalesce("human_action", F.lit("")).alias("human_action"), "snapshot",
    )


def with_default(atoms: DataFrame, snapshots: DataFrame, keys: list[str], default: str) -> DataFrame:
    """Each decision with its snapshot, or the default document where there is none."""
    return atoms.join(snapshots.select(*keys, "snapshot"), keys, "left").withColumn("snapshot", F.coalesce("snapshot", F.lit(default)))


def replay(atoms: DataFrame, default_prices: tuple[float, ...] = (10.0,) * 6) -> DataFrame:
    """Decision to lesson in one projection.  atoms: raw_text, agent_reply, human_action, tensor, prices."""
    d = atoms.withColumn("discipline", discipline(F.col("raw_text"), F.col("agent_reply"), F.col("human_action")))
    d = d.withColumn("outcome", outcome(F.coalesce("prices", F.array(*[F.lit(p) for p in default_prices])), F.col("human_action")))
    x = F.col("outcome")
    kind = diagnose(F.col("tensor.is_lethal"), F.col("tensor.grade"), x["outcome_label"], F.col("discipline.panic_exit"), x["return_t5"], x["return_t10"], F.col("discipline.sizing_pct"))
    risk, regime = F.col("tensor.risk"), F.col("tensor.global_regime")
    alpha = {"grade": F.col("tensor.grade"), "overheat": risk["overheat_index"], "trap": risk["is_trap"], "lethal": F.col("tensor.is_lethal"), "regime": regime["market_regime"]}
    return d.withColumn("diagnosis", kind).withColumn("lesson", lesson(F.col("diagnosis"), F.col("tensor.symbol"), F.col("tensor.as_of_date"), alpha, F.col("discipline"), x))


#: What each diagnosis teaches.  A beta error has three texts: a panic exit, a lethal chart, else.
LESSONS = {
    "panic": "【纪律教训】大周期趋势与支撑位完好，绝不能在盘中洗盘（Washout）低点因恐慌而割肉离场。必须严格以大周期收盘或结构破位为退出信号。",
    "lethal": "【纪律教训】大周期指标已提示超买或微观存在高潮骗炮（Overheat={overheat}），绝对严禁满仓追高！必须遵守分批或轻仓纪律。",
    "intraday": "【纪律教训】在面临日内波动时，必须严格执行日内T+0减仓规避短线波动，而非在持仓期不做任何对冲保护。",
    "alpha_error": "【系统教训】个股在健康的左侧和右侧共振形态下依然发生跌破，表明市场大环境出现短期风格切换（Regime={regime}）或局部主力诱多出货，指标发生回撤。",
    "scoring_error": "【评分教训】V8评分系统存在钝化滞后。在个股量能微观场已经检测出骗炮/诱多风险（is_trap=True）的情况下，评分依然给出了 S/A 的高评分，需要修正评分权重。",
    "mixed_error": "【综合教训】个股本身处于量能与风险的模糊边界，同时执行端严重超重仓（Sizing={sizing}），在没有对冲保护的情况下，多重失误共振导致亏损。",
    "no_error": "【操作规范】在 Grade={grade} 且大盘稳定的背景下，严格按照模型信号操作，交易逻辑闭环，无纪律违规。",
}
EVIDENCE = "Alpha: Grade={grade}, Overheat={overheat}, is_trap={trap} | Beta: Sizing={share}, Panic={panic}, Override={override} | Outcome: T5_ret={t5}, MAE={mae}, MFE={mfe}"


def fill(template: str, **values: Column) -> Column:
    """A text with its {names} replaced by columns."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(rest))


def lesson(diagnosis: Column, symbol: Column, as_of: Column, alpha: dict[str, Column], beta: Column, outcome_: Column) -> Column:
    """struct(lesson_id, verdict_type, core_axiom, evidence): no part of the chat gets in.

    alpha: grade, overheat (double), trap and lethal (boolean), regime; beta and outcome_ are
    the structs of :func:`discipline` and :func:`outcome`.
    """
    flag = lambda c: F.when(c, "True").otherwise("False")
    percent = lambda c: F.format_string("%.2f%%", 100 * c)
    sizing = beta["sizing_pct"]
    values = {
        "grade": alpha["grade"], "overheat": alpha["overheat"].cast("string"), "regime": alpha["regime"], "trap": flag(alpha["trap"]),
        "sizing": sizing.cast("string"), "share": F.format_string("%.1f", sizing), "panic": flag(beta["panic_exit"]), "override": flag(beta["fundamental_override"]),
        "t5": percent(outcome_["return_t5"]), "mae": percent(outcome_["mae"]), "mfe": percent(outcome_["mfe"]),
    }
    kind = F.when(diagnosis == "beta_error", F.when(beta["panic_exit"], "panic").when(alpha["lethal"], "lethal").otherwise("intraday"))
    kind = kind.when(diagnosis.isin("alpha_error", "scoring_error", "mixed_error"), diagnosis).otherwise("no_error")
    axiom = F.coalesce(*[F.when(kind == k, fill(x, **values)) for k, x in LESSONS.items()])
    moment = F.translate(as_of, ":-", "")
    number = F.concat(F.lit("LS1-"), F.replace(symbol, F.lit("."), F.lit("_")), F.lit("-"), F.upper(diagnosis), F.lit("-"), moment)
    return F.struct(number.alias("lesson_id"), F.upper(diagnosis).alias("verdict_type"), axiom.alias("core_axiom"), fill(EVIDENCE, **values).alias("evidence"))


def distil(kind: Column, symbol: Column, as_of: Column, text: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit("] "), F.coalesce(symbol, F.lit("?")), F.lit(" @ "), F.substring(as_of, 1, 10), F.lit(": "), F.substring(text, 1, 400))


def forward_label(horizon: str, return_pct: Column) -> Column:
    """true_S, stale_S or neutral by the horizon's thresholds (in percent); false_trap is an input."""
    high, low = {"T5": (3, -2), "T10": (5, -3), "T20": (8, -5)}[horizon]
    return F.when(return_pct >= high, "true_S").when(return_pct <= low, "stale_S").otherwise("neutral")


def labelled_horizons(labels: dict[str, Column]) -> Column:
    """The horizons that have a label."""
    return F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(h).alias("horizon"), c.alias("label"))) for h, c in labels.items()]))
