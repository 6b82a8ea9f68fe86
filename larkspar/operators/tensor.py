"""Typed projection of snapshot documents.

Two fall-through modes exist: ``any_true`` goes on past every false value, and
``first_non_null`` only past absent and null ones.  All functions take a DataFrame with a
VARIANT column and add columns by one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import snapshot as s
from ..functions import vectors as v

#: Keys of the envelope and contract paths that a snapshot must have.
ENVELOPE = ["symbol", "as_of_date", "scenario", "outcome_label"]
CONTRACT = [
    "ls1_supercharged.spring.coiling", "ls1_supercharged.spring.launch", "ls1_supercharged.spring.breakout_60d", "ls1_supercharged.three_push.pump_dump_vol_ratio",
    "compression_setup.is_range_compressed", "compression_setup.is_bb_squeeze", "compression_setup.is_ready",
    "trap_detection.pump_fake.is_trap", "trap_detection.pump_fake.trap_type", "trap_detection.pump_fake.volume_ratio", "trap_detection.volume_gap.is_gap",
    "intraday_volume_structure.launch_signal", "intraday_volume_structure.accel_ratio", "intraday_volume_structure.escape_signal", "crash_signals.panic_reversal.detected",
    "chan.bsp.latest", "chan.bsp.latest_confirmed", "chan.bsp.latest_candidate", "chan.stage_code", "chan.zs_count",
]
#: Words of the projection.
NONE, PHRASE, BUY_POINT, SELL_POINT, TANGLED = "无", "缠论", "买点", "卖点", "缠绕"
STAGES = {"forming": "震荡构筑", "developing": "洗盘吸收", "mature": "洗盘吸收就绪", "complete": "结构完成"}
BASE_STAGE, READY, COILED, COMPRESSED = "震荡", "·就绪", "·盘整压缩", "·区间压缩"


def facts(doc: Column) -> Column:
    """The contract paths as a map from path to text; absent and null paths map to null."""
    return F.create_map(*[x for p in CONTRACT for x in (F.lit(p), s.text(doc, p))])


def validate(doc: Column) -> Column:
    """struct(ok, envelope_errors, missing_paths); a path that holds null is present."""
    envelope = F.array_compact(F.array(*[F.when(~s.present(doc, k), F.lit(k)) for k in ENVELOPE]))
    missing = F.array_compact(F.array(*[F.when(~s.present(doc, p), F.lit(p)) for p in CONTRACT]))
    return F.struct(((F.size(envelope) == 0) & (F.size(missing) == 0)).alias("ok"), envelope.alias("envelope_errors"), missing.alias("missing_paths"))


def buy_sell_phrase(doc: Column, strict: bool) -> Column:
    """Side and types of the best node: confirmed, then latest, then candidate."""
    paths = [f"chan.bsp.{k}" for k in ("latest_confirmed", "latest", "latest_candidate")]
    usable = (lambda p: s.text(doc, p).isNotNull()) if strict else (lambda p: s.truthy(doc, p))

    def phrase(p: str) -> Column:
        side, listed = s.text(doc, p + ".side"), s.get(doc, f"{p}.types", "array<string>")
        label = F.when(side.isin("买", "buy", "long"), BUY_POINT).when(F.coalesce(side, F.lit("")) != "", SELL_POINT).otherwise("")
        types = F.when(F.size(listed) > 0, F.concat(F.lit("·"), F.array_join(listed, "/"))).otherwise("")
        text = F.concat(F.lit(PHRASE), label, types)
        return F.when(~s.is_object(doc, p), F.lit(NONE)).otherwise(F.when((label == "") & (types == ""), F.lit(NONE)).otherwise(text) if strict else text)

    return F.coalesce(*[F.when(usable(p), phrase(p)) for p in paths], F.lit(NONE))


def phase(doc: Column, stage: Column) -> Column:
    base = F.coalesce(*[F.when(stage == k, F.lit(x)) for k, x in STAGES.items()], F.when(stage == "", F.lit(BASE_STAGE)), stage, F.lit(BASE_STAGE))
    ready, coiling, compressed = (s.truthy(doc, p) for p in ("compression_setup.is_ready", "ls1_supercharged.spring.coiling", "compression_setup.is_range_compressed"))
    suffix = F.when(ready, READY).when(coiling & compressed, COILED).when(compressed, COMPRESSED).otherwise("")
    return F.concat(base, suffix)


def macd_cross(state: Column) -> Column:
    low = F.lower(F.coalesce(state, F.lit("")))
    return F.when(low.contains("金叉") | low.contains("golden"), "golden").when(low.contains("死叉") | low.contains("dead"), "dead").otherwise("none")


def alpha_tensor(doc: Column, mode: str = "any_true") -> Column:
    """The five blocks of the tensor.  ``any_true`` is the sandbox form, ``first_non_null`` the full one."""
    if mode not in ("any_true", "first_non_null"):
        raise ValueError(f"unknown mode {mode}")
    strict = mode == "first_non_null"
    flag = s.first_non_null if strict else s.any_true
    ratio = s.to_float(s.text(doc, "ls1_supercharged.three_push.pump_dump_vol_ratio"), 1.0)
    fake = "trap_detection.pump_fake"
    trapped = s.is_object(doc, fake) & s.truthy(doc, fake + ".is_trap")
    # what is no object: in the sandbox only a true value, in the full form also an absent or null one
    inferred = ~s.is_object(doc, fake) & (F.lit(True) if strict else s.truthy(doc, fake))
    is_trap = F.when(s.is_object(doc, fake), trapped).when(inferred, ratio < 0.2).otherwise(False)
    named = F.when(s.truthy(doc, fake + ".trap_type"), s.text(doc, fake + ".trap_type")).otherwise("none")
    trap_type = F.when(inferred, F.when(ratio < 0.2, "pump_fake").otherwise("none")).otherwise(named)
    details = F.when(s.truthy(doc, fake + ".details"), s.text(doc, fake + ".details")).otherwise("")
    if strict:
        details = F.when(inferred, F.coalesce(s.text(doc, "ls1_supercharged.three_push.details"), F.lit(""))).otherwise(details)
    toxic = s.truthy(doc, "v8_score.toxic_breaker")
    if strict:
        toxic = toxic | s.truthy(doc, "v8_score.toxic_breaker_factors")
    if strict:
        market = "macro_sentinel.indices.CSI300.features."
        ret, slope, above = s.to_float(s.text(doc, market + "ret_20d"), 0.0), s.to_float(s.text(doc, market + "ma20_slope_pct"), 0.0), s.truthy(doc, market + "ma20_above_ma60")
        atr = s.to_float(s.text(doc, market + "atr_pct"), 2.0)
        regime = F.when(ret <= -15, "crash").when(above & (slope > 0.1), "bull").when(~above & (slope < -0.1), "bear").otherwise("range")
        volatility = F.when(atr < 2, "low").when(atr < 4, "normal").when(atr < 7, "high").otherwise("extreme")
    else:
        regime = F.coalesce(F.when(s.text(doc, "macro_sentinel.regime").isin("bull", "bear", "range", "crash"), s.text(doc, "macro_sentinel.regime")), F.lit("range"))
        volatility = F.coalesce(F.when(s.text(doc, "macro_sentinel.vol_regime").isin("low", "normal", "high", "extreme"), s.text(doc, "macro_sentinel.vol_regime")), F.lit("normal"))
    systemic = ["macro_sentinel.hard_block", "crash_signals.panic_reversal.detected"] + ["crash_signals.systemic_risk"] * strict
    more = lambda *paths: paths if strict else paths[:1]  # noqa: E731  the full form knows more places
    or_default = lambda col, d: F.coalesce(col if strict else F.when(col != "", col), F.lit(d))
    overheat = s.to_int(s.text(doc, "v8_score.overheat_index"))
    risk = F.struct(overheat.alias("overheat_index"), is_trap.alias("is_trap"), trap_type.alias("trap_type"), details.alias("trap_details"), toxic.alias("toxic_breaker"))
    systemic_flag = flag(doc, *systemic)
    return F.struct(
        F.coalesce(s.text(doc, "symbol"), F.lit("UNKNOWN" if strict else "SYNTHETIC.SH")).alias("symbol"),
        F.coalesce(s.dig(doc, *more("as_of_date", "as_of", "timestamp", "data_trust.quote_updated_at")), F.lit("" if strict else "2026-01-01 10:00:00")).alias("as_of_date"),
        or_default(s.dig(doc, *more("v8_score.grade", "v8_grade")), "?" if strict else "C").alias("grade"),
        F.struct(regime.alias("market_regime"), volatility.alias("vol_regime"), or_default(s.text(doc, "iron_verdict"), "neutral").alias("iron_verdict"), systemic_flag.alias("systemic_risk_flag")).alias("global_regime"),
        F.struct(
            buy_sell_phrase(doc, strict).alias("chan_bsp"), s.to_float(s.text(doc, "v8_score.setup_score"), 0.0).alias("setup_score"), s.to_int(s.text(doc, "chan.zs_count")).alias("zs_count"),
            phase(doc, F.coalesce(s.dig(doc, *more("chan.stage_code", "chan.stage")), F.lit(""))).alias("consolidation_phase"), s.truthy(doc, "gann_support.hit").alias("gann_support"),
            flag(doc, "compression_setup.is_bb_squeeze", "compression_setup.is_range_compressed").alias("bollinger_squeeze"), or_default(s.dig(doc, *more("chan_mtf.alignment", "ma_alignment")), TANGLED).alias("ma_alignment"),
        ).alias("structure"),
        F.struct(
            s.to_float(s.text(doc, "v8_score.ignition_score"), 0.0).alias("ignition_score"), macd_cross(s.dig(doc, *more("indicators.macd.state", "momentum.macd_state"))).alias("macd_cross"),
            flag(doc, "ls1_supercharged.spring.launch", "intraday_volume_structure.launch_signal").alias("ignition_bar_present"), flag(doc, "breakout.breakout_60d", "ls1_supercharged.spring.breakout_60d").alias("breakout_confirmed"),
            s.to_float(s.dig(doc, *more("capital_flow.total_net", "fusion_intel_signals.moneyflow_net_large")), 0.0).alias("fund_inflow_intensity"),
        ).alias("ignition"),
        F.struct(
            s.to_float(s.dig(doc, *more("momentum.vol_ratio_5d", "volume.volume_ratio_5d")), 1.0).alias("volume_ratio_5d"), s.to_float(s.dig(doc, *more("price.turnover_rate", "turnover_rate")), 0.0).alias("turnover_rate"),
            F.when(trapped, s.to_float(s.text(doc, fake + ".volume_ratio"), 1.0)).otherwise(ratio).alias("pump_dump_vol_ratio"),
            flag(doc, *more("trap_detection.volume_gap.is_gap", "crash_signals.volume_gap")).alias("volume_gap_detected"),
        ).alias("volume"),
        risk.alias("risk"),
        (systemic_flag | is_trap | (overheat >= 6) | toxic).alias("is_lethal"),
    )


# ---- numeric vectors -----------------------------------------------------------------

#: Codes of trends and stages, and the sources of the 30 raw features by group.
TREND_CODES = {"UpTrend": 2.0, "UP_TREND": 2.0, "up_trend": 2.0, "Consolidation": 1.0, "CONSOLIDATION": 1.0, "consolidation": 1.0, "DownTrend": 0.0, "DOWN_TREND": 0.0, "down_trend": 0.0}
STAGE_CODES = {"forming": 1.0, "developing": 2.0, "mature": 3.0, "complete": 4.0}
DOMAINS = {"structure": (0, 8), "volume": (8, 13), "momentum": (13, 20), "risk": (20, 24), "chan": (24, 30), "score_ref": (30, 34)}
RAW_FEATURES = {
    "zs_count": "chan.zs_count", "bi_count": "chan.bi_count", "seg_count": "chan.seg_count", "pivot_pct_in_range": "chan.pivot.pct_in_range",
    "pivot_range_width": None, "pivot_core_width": None, "trend_type_encoded": None, "stage_code_encoded": None,
    "cvd": "volume.consecutive_vol_days", "vol_ratio_5d": "volume.vol_ratio_5d", "shrink_days": "volume.shrink_days", "fake_out_days": "volume.fake_out_days", "vol_up_down_ratio": "momentum.vol_up_down_ratio",
    "rsi": "indicators.rsi.value", "macd_hist": "indicators.macd.hist", "adx": "indicators.adx.value", "bb_pct_b": "indicators.bb.pct_b",
    "rsi_momentum_5d": "momentum.rsi_momentum_5d", "consecutive_up_days": "momentum.consecutive_up_days", "return_1d": "momentum.return_1d",
    "atr_ratio_pct": "risk.atr_ratio_pct", "bias_60": "risk.bias_60", "max_drawdown_60d": "risk.max_drawdown_60d", "downside_std_20d": "risk.downside_std_20d",
    "bsp_side_encoded": None, "bsp_type_t1": None, "bsp_type_t2": None, "bsp_type_t3": None, "macd_divergence": None, "macd_area_ratio": "chan.macd_divergence.area_ratio",
}
#: What a feature is if its source is no number, if not 0; and features counted in whole days.
FALLBACK = {"vol_up_down_ratio": 1.0, "rsi": 50.0, "bb_pct_b": 0.5}
WHOLE = {"cvd", "shrink_days", "fake_out_days", "consecutive_up_days"}


def code(value: Column, codes: dict[str, float], other: float) -> Column:
    return F.coalesce(*[F.when(value == k, F.lit(x)) for k, x in codes.items()], F.lit(other))


def side_code(side: Column) -> Column:
    return F.when(side.isin("买", "buy"), 1.0).when(side.isin("卖", "sell"), -1.0).otherwise(0.0)


def has_tier(types: Column, tier: int) -> Column:
    hit = F.exists(types, lambda t: t.startswith(f"T{tier}") | t.isin(f"{tier}buy", f"{tier}sell"))
    return F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0)


def width(doc: Column, path: str) -> Column:
    """b - a of a two-element list [a, b]; NULL for anything else."""
    ends = s.get(doc, path, "array<double>")
    return F.when(F.size(ends) == 2, F.get(ends, F.lit(1)) - F.get(ends, F.lit(0)))


def feature_vector(doc: Column) -> Column:
    """The 30 raw features; NaN where the source is missing."""
    nan = F.lit(float("nan"))
    out = []
    for name, path in RAW_FEATURES.items():
        if path:
            raw = s.text(doc, path)
            value = F.coalesce(s.int_text(raw).cast("double"), F.lit(0.0)) if name in WHOLE else s.finite(raw, FALLBACK.get(name, 0.0))
            value = F.when(raw.isNotNull(), value)
        elif name == "pivot_range_width":
            value = width(doc, "chan.pivot.range")
        elif name == "pivot_core_width":
            value = width(doc, "chan.pivot.core_range")
        elif name == "trend_type_encoded":
            value = F.when(s.text(doc, "chan.trend_type").isNotNull(), code(s.text(doc, "chan.trend_type"), TREND_CODES, 0.5))
        elif name == "stage_code_encoded":
            value = F.when(s.text(doc, "chan.stage_code").isNotNull(), code(s.text(doc, "chan.stage_code"), STAGE_CODES, 0.0))
        elif name == "bsp_side_encoded":
            value = F.when(s.text(doc, "chan.bsp.latest.side").isNotNull(), side_code(s.text(doc, "chan.bsp.latest.side")))
        elif name == "macd_divergence":
            value = F.when(s.text(doc, "chan.macd_divergence.divergence").isNotNull(), s.truthy(doc, "chan.macd_divergence.divergence").cast("double"))
        else:
            types = s.get(doc, "chan.bsp.latest.types", "array<string>")
            value = F.when(types.isNotNull(), has_tier(types, int(name[-1])))
        out.append(F.coalesce(value, nan))
    return F.array(*out)


def missing_features(vector: Column) -> Column:
    return v.missing(vector, list(RAW_FEATURES))


def beta_tensor(doc: Column) -> Column:
    """Six numeric blocks, 34 values, null-safe; missing values take their defaults."""
    f = lambda path, d=0.0: s.to_float(s.text(doc, path), d)
    best = [f"chan.bsp.{k}" for k in ("latest", "latest_confirmed", "latest_candidate")]
    of_best = lambda field, kind: F.coalesce(*[F.when(s.text(doc, p).isNotNull(), F.struct(s.get(doc, f"{p}.{field}", kind).alias("x"))) for p in best])["x"]
    types = of_best("types", "array<string>")
    factors = s.get(doc, "v8_score.toxic_breaker_factors", "array<variant>")
    block = lambda **columns: F.struct(*[c.alias(k) for k, c in columns.items()])
    return F.struct(
        F.coalesce(s.text(doc, "symbol"), F.lit("UNKNOWN")).alias("symbol"),
        F.coalesce(s.dig(doc, "as_of_date", "as_of", "timestamp"), F.lit("")).alias("as_of_date"),
        F.coalesce(s.dig(doc, "v8_score.grade", "v8_grade"), F.lit("?")).alias("grade"),
        block(
            zs_count=f("chan.zs_count"), bi_count=f("chan.bi_count"), seg_count=f("chan.seg_count"), pivot_pct_in_range=f("chan.pivot.pct_in_range"),
            pivot_range_width=F.coalesce(width(doc, "chan.pivot.range"), F.lit(0.0)), pivot_core_width=F.coalesce(width(doc, "chan.pivot.core_range"), F.lit(0.0)),
            trend_type_encoded=code(s.dig(doc, "chan.trend_type", "chan.trend"), TREND_CODES, 0.5), stage_code_encoded=code(s.dig(doc, "chan.stage_code", "chan.stage"), STAGE_CODES, 0.0),
        ).alias("structure"),
        block(cvd=f("volume.consecutive_vol_days"), vol_ratio_5d=f("volume.vol_ratio_5d", 1.0), shrink_days=f("volume.shrink_days"), fake_out_days=f("volume.fake_out_days"), vol_up_down_ratio=f("momentum.vol_up_down_ratio", 1.0)).alias("volume"),
        block(rsi=f("indicators.rsi.value", 50.0), macd_hist=f("indicators.macd.hist"), adx=f("indicators.adx.value"), bb_pct_b=f("indicators.bb.pct_b", 0.5), rsi_momentum_5d=f("momentum.rsi_momentum_5d"), consecutive_up_days=f("momentum.consecutive_up_days"), return_1d=f("momentum.return_1d")).alias("momentum"),
        block(overheat_index=f("v8_score.overheat_index"), toxic_breaker_count=F.coalesce(F.size(factors), F.lit(0)).cast("double"), fever_penalty_raw=f("v8_score.details.fever_penalty_raw"), toxic_penalty=f("v8_score.details.toxic_penalty")).alias("risk"),
        block(
            bsp_side_encoded=side_code(of_best("side", "string")), bsp_type_t1=has_tier(types, 1), bsp_type_t2=has_tier(types, 2), bsp_type_t3=has_tier(types, 3),
            macd_divergence=s.truthy(doc, "chan.macd_divergence.divergence").cast("double"), macd_area_ratio=f("chan.macd_divergence.area_ratio"),
        ).alias("chan_bsp"),
        block(setup_score=f("v8_score.setup_score"), ignition_score=f("v8_score.ignition_score"), left_total=f("v8_score.left_total"), right_total=f("v8_score.right_total")).alias("score_ref"),
    )


BLOCKS = {
    "structure": list(RAW_FEATURES)[:8], "volume": list(RAW_FEATURES)[8:13], "momentum": list(RAW_FEATURES)[13:20],
    "risk": ["overheat_index", "toxic_breaker_count", "fever_penalty_raw", "toxic_penalty"], "chan_bsp": list(RAW_FEATURES)[24:], "score_ref": ["setup_score", "ignition_score", "left_total", "right_total"],
}


def to_vector(beta: Column, blind: bool = True) -> Column:
    """30 values without the score block, or all 34."""
    return F.array(*[beta[b][n] for b, names in BLOCKS.items() if not (blind and b == "score_ref") for n in names])


def domain_vector(beta: Column, domain: str) -> Column:
    return F.array(*[beta[domain][n] for n in BLOCKS[domain]]) if domain in BLOCKS else F.array().cast("array<double>")


def project(df: DataFrame, text_col: str = "snapshot", mode: str = "any_true") -> DataFrame:
    """The flagship projection: a JSON text column to one tensor column."""
    return s.add(df.withColumn("__doc", s.parse(F.col(text_col))), "__doc", "tensor", lambda doc: alpha_tensor(doc, mode)).drop("__doc")
