import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspar.functions import snapshot as sn
from larkspar.functions import text as tx
from larkspar.functions import vectors as v
from larkspar.operators import bars, cases, evidence, fusion, guards, provenance, recall, stats, tensor
from larkspar.plans import actions
from larkspar.sources import sinks
from larkspar.streaming import episodes


@pytest.mark.parametrize(
    ("query", "candidate", "h", "p", "safe"),
    [(100, 50, 20, 20, True), (100, 60, 20, 20, True), (100, 61, 20, 20, False), (100, 100, 20, 20, False), (0, 0, 20, 20, False), (100, 94, 5, 1, True), (100, 95, 5, 1, False), (100, 80, 20, 0, True), (100, 81, 20, 0, False), (100, 100, 0, 0, True), (100, 90, 0, 10, True), (100, 91, 0, 10, False), (200, 160, 20, 20, True), (200, 161, 20, 20, False)],
)
def test_guard_table(spark, query, candidate, h, p, safe):
    assert guards.enforce(query, candidate, h, p) is safe
    assert spark.range(1).select(guards.is_safe(F.lit(query), F.lit(candidate), h, p)).first()[0] is safe


@pytest.mark.parametrize(("query", "candidate"), [(-1, 10), (10, -1), (-5, -3)])
def test_guard_rejects_negatives(spark, query, candidate):
    with pytest.raises(ValueError):
        guards.enforce(query, candidate)
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(guards.check_index(F.lit(query), F.lit(candidate))).collect()


def test_guard_parameters():
    guards.check_parameters("T10", "fused")
    with pytest.raises(ValueError):
        guards.check_parameters("T7", "fused")
    with pytest.raises(ValueError):
        guards.other_symbol(F.lit("a"), F.lit("b"), F.lit(1), F.lit(1), 0)


SNAPS = {
    "missed": {"symbol": "A", "as_of_date": "d", "scenario": "missed_entry", "outcome_label": "x", "v8_score": {"grade": "C", "overheat_index": 3}, "ls1_supercharged": {"spring": {"launch": True, "breakout_60d": False}, "three_push": {"pump_dump_vol_ratio": 1.15}}, "trap_detection": {"pump_fake": {"is_trap": False, "volume_ratio": 0.0}}, "chan": {"stage_code": "developing", "bsp": {"latest": {"side": "buy", "types": ["T2"]}, "latest_confirmed": None}}, "compression_setup": {"is_range_compressed": True}, "indicators": {"macd": {"state": "金叉"}}},
    "breakout": {"symbol": "B", "v8_score": {"grade": "A", "overheat_index": "2.5"}, "breakout": {"breakout_60d": True}, "trap_detection": {"pump_fake": {"is_trap": True, "trap_type": "pump", "volume_ratio": 0.07}}, "ls1_supercharged": {"spring": {"launch": False}}, "intraday_volume_structure": {"launch_signal": True}},
}


def project(spark, snap, mode):
    d = spark.createDataFrame([(json.dumps(snap),)], "snapshot string")
    return tensor.project(d, mode=mode).first()["tensor"].asDict(recursive=True)


def test_alpha_tensor_scenarios(spark):
    a = project(spark, SNAPS["missed"], "any_true")
    assert a["grade"] == "C" and a["ignition"]["ignition_bar_present"] and not a["ignition"]["breakout_confirmed"]
    assert a["structure"]["chan_bsp"] == "缠论买点·T2" and a["volume"]["pump_dump_vol_ratio"] == 1.15 and a["ignition"]["macd_cross"] == "golden"
    assert a["structure"]["consolidation_phase"] == "洗盘吸收·区间压缩" and not a["is_lethal"]
    b = project(spark, SNAPS["breakout"], "any_true")
    assert b["risk"]["is_trap"] and b["volume"]["pump_dump_vol_ratio"] == 0.07 and b["is_lethal"] and b["risk"]["overheat_index"] == 2


def test_modes_differ_on_false(spark):
    assert project(spark, SNAPS["breakout"], "any_true")["ignition"]["ignition_bar_present"]
    assert not project(spark, SNAPS["breakout"], "first_non_null")["ignition"]["ignition_bar_present"]
    with pytest.raises(ValueError):
        tensor.alpha_tensor(F.lit(None), "other")


def test_absent_trap_block_differs_by_mode(spark):
    snap = {"ls1_supercharged": {"three_push": {"pump_dump_vol_ratio": 0.1}}}
    assert not project(spark, snap, "any_true")["risk"]["is_trap"]
    assert project(spark, snap, "first_non_null")["risk"]["is_trap"]


def test_null_is_present_absent_is_missing(spark):
    d = spark.createDataFrame([(json.dumps({"symbol": None, "chan": {"zs_count": None}}),)], "t string").select(sn.parse(F.col("t")).alias("doc"))
    r = d.select(tensor.validate(F.col("doc")).alias("v")).first()["v"]
    assert "symbol" not in r["envelope_errors"] and "scenario" in r["envelope_errors"] and "chan.zs_count" not in r["missing_paths"] and "chan.stage_code" in r["missing_paths"] and not r["ok"]


def test_numbers(spark):
    d = spark.createDataFrame([("2.5",), ("3.5",), ("x",), (None,), ("1d",), ("1e3",), ("true",), ("inf",)], "s string")
    r = d.select(sn.to_float(F.col("s"), -1.0), sn.to_int(F.col("s"), -9)).collect()
    assert [x[0] for x in r] == [2.5, 3.5, -1.0, -1.0, -1.0, 1000.0, 1.0, float("inf")]
    assert [x[1] for x in r] == [2, 4, -9, -9, -9, 1000, 1, -9]


def test_recall_edges(spark):
    rows = [(1, "a", 0, "", [1.0, 0.0]), (2, "a", 60, "", [1.0, 0.0]), (3, "b", 61, "", [1.0, 0.0]), (4, "b", 10, "", [0.0, 0.0]), (5, "b", 10, "", None), (6, "b", 10, "x", [1.0, 0.0]), (7, "b", 10, "", [1.0, 0.0, 0.0]), (8, "b", 60, "", [1.0, 0.0]), (100, "a", 100, "", [2.0, 0.0])]
    p = spark.createDataFrame(rows, "id long, symbol string, idx long, cohort string, vec array<double>")
    q = p.filter("id = 100")
    ids = lambda **o: [r["case_id"] for r in recall.top_k(q, p, **o).orderBy("rank").collect()]
    assert ids() == [1, 2, 8] and ids(block=1) == [1, 2, 8] and ids(k=2) == [1, 2]
    assert ids(exclude_symbol=True) == [8] and ids(exclude_symbol=True, gap=50) == [1, 8]
    assert recall.top_k(q.filter("id < 0"), p).count() == 0


def test_card_without_neighbours(spark):
    q = spark.createDataFrame([(1, "a", 5, None)], "query_id long, symbol string, idx long, regime string")
    h = spark.createDataFrame([], "query_id long, case_id long, similarity double, rank int, case_symbol string, case_idx long, label string, fwd_return double, mae double, case_regime string")
    c = evidence.cards(h, q).first()
    assert c["top_k_returned"] == 0 and c["warnings"] == [evidence.NO_NEIGHBOURS] and c["case_ids"] == []
    assert evidence.prompt_block(evidence.cards(h, q)).first()["block"] == ""


def test_nearest_rank_median_is_lower_middle(spark):
    d = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "x int")
    assert d.select(evidence.nearest_rank("x", 0.5), evidence.nearest_rank("x", 0.25)).first()[:] == (2, 1)


def test_pca_against_svd(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) + 3
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    basis = fusion.fit_pca(d, "vec", components=3)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = (u[:, :3] * np.sqrt(len(x) - 1))
    got = np.array([r["z"] for r in d.select("id", fusion.project(F.col("vec"), basis).alias("z")).orderBy("id").collect()])
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-6)
    assert fusion.save(basis)[1] == fusion.save(dict(reversed(basis.items())))[1] and "variance" in fusion.save(basis)[0]
    with pytest.raises(ValueError):
        fusion.fit_pca(d.limit(1), "vec")


def test_stats_treat_nan_as_missing(spark):
    d = spark.createDataFrame([([1.0, float("nan")],), ([3.0, None],)], "vec array<double>")
    r = {x["dim"]: x for x in stats.feature_stats(d).collect()}
    assert (r[0]["mean"], r[0]["std"], r[0]["n_missing"]) == (2.0, 1.0, 0) and (r[1]["mean"], r[1]["std"], r[1]["n_missing"]) == (0.0, 1.0, 2)


def test_bca_contains_point():
    x = stats.bca([0.0, 1.0, 1.0, 0.0, 1.0] * 8, resamples=2000)
    assert x["lower"] <= x["point"] <= x["upper"] and stats.bca([])["n"] == 0 and stats.bca([2.0, 2.0])["method"] == "degenerate"


def test_compare_arms():
    arms = {"a": {"point": 0.15, "lower": 0.1}, "b": {"point": 0.35, "lower": 0.3}, "c": {"point": 0.25, "lower": 0.15}}
    r = stats.compare_arms(arms)
    assert r["champion"] == "b" and r["verdict"] == "SIGNIFICANT" and r["pairs"]["a", "b"] == "HURTS" and r["pairs"]["c", "a"] == "UNCERTAIN" and r["tally"]["b"] == (2, 0, 0)
    assert stats.compare_arms({"a": arms["a"]})["verdict"] == "PENDING"
    same = {"a": {"point": 0.2, "lower": 0.1}, "b": {"point": 0.2, "lower": 0.1}}
    assert stats.compare_arms(same)["verdict"] == "TIED" and stats.compare_arms(arms | {"b": {"point": 0.35, "lower": 0.2}})["verdict"] == "UNCERTAIN"


def test_indicator_recursions_by_plain_loops():
    import numpy as np

    r = np.random.default_rng(5)
    for n in (5, 14, 15, 78, 79, 300):
        x = r.normal(10, 3, n)
        for weight, seed, first in ((1 / 14, 14, 1), (2 / 13, 12, 0)):
            want = [None] * n
            if n >= first + seed:
                want[first + seed - 1] = float(np.mean(x[first : first + seed]))
                for i in range(first + seed, n):
                    want[i] = want[i - 1] + weight * (x[i] - want[i - 1])
            got = bars.smooth(x, weight, seed, first)
            assert all(np.isnan(g) if w is None else abs(g - w) < 1e-9 for g, w in zip(got, want, strict=True))


def test_indicators_are_those_of_each_series(spark):
    import numpy as np

    r = np.random.default_rng(6)
    series = {f"s{k}": r.normal(50, 5, (n, 4)).cumsum(0) for k, n in enumerate((1, 20, 33, 90, 250))}
    rows = [(k, i, *map(float, v)) for k, m in series.items() for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "symbol string, day int, high double, low double, close double, volume double").repartition(3)
    got = {}
    for x in bars.indicators(df, "symbol", "day").collect():
        got[x["symbol"], x["day"]] = x
    for k, m in series.items():
        want = bars.indicators_of(*m.T)
        for name, values in want.items():
            assert all((got[k, i][name] is None or np.isnan(got[k, i][name])) if np.isnan(v) else abs(got[k, i][name] - v) < 1e-9 for i, v in enumerate(values)), (k, name)


def test_recall_by_brute_force_over_cohorts_and_blocks(spark):
    import numpy as np

    r = np.random.default_rng(7)
    rows = [(i, f"s{i % 4}", int(r.integers(0, 90)), "a" if i % 3 else "b", [float(v) for v in r.normal(size=6 if i % 7 else 4)]) for i in range(300)]
    rows += [(400, "s1", 80, "a", [0.0] * 6), (401, "s1", 80, None, [1.0] * 6), (402, "s1", None, "a", [1.0] * 6)]
    df = spark.createDataFrame(rows, "id long, symbol string, idx long, cohort string, vec array<double>")

    def cosine(a, b):
        d = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / d, 12) if d else None

    for options in ({}, {"exclude_symbol": True}, {"exclude_symbol": True, "gap": 60}):
        want = set()
        for q in rows:
            found = []
            for c in rows:
                if None in (q[2], c[2]) or (q[3] or "") != (c[3] or "") or len(q[4]) != len(c[4]) or c[0] == q[0] or c[2] > q[2] - 40:
                    continue
                if options and c[1] == q[1] and not ("gap" in options and c[2] <= q[2] - 60):
                    continue
                if (s := cosine(q[4], c[4])) is not None:
                    found.append((-s, c[0]))
            want |= {(q[0], c, k + 1) for k, (_, c) in enumerate(sorted(found)[:5])}
        for block in (1, 2048):
            got = {(x["query_id"], x["case_id"], x["rank"]) for x in recall.top_k(df, df, block=block, **options).collect()}
            assert got == want


def test_recall_skips_blocks_by_their_angles(spark):
    """Clouds in different directions: bounds spare most block pairs, and the hits stay those of a plain search."""
    import numpy as np

    from larkspar.operators.recall import search, skipped

    r = np.random.default_rng(11)
    clouds = r.normal(size=(10, 24))
    x = clouds[np.arange(1500) % 10] + 0.02 * r.normal(size=(1500, 24))
    rows = [(i, "s", i, "", v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "id long, symbol string, idx long, cohort string, vec array<double>")
    raw = search(df, df, block=16)
    s = skipped(raw).first()
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    sim = np.round(unit @ unit.T, 12)
    allowed = np.arange(1500)[None, :] <= np.arange(1500)[:, None] - 40
    order = np.lexsort((np.broadcast_to(np.arange(1500), sim.shape), np.where(allowed, -sim, np.inf)), axis=1)
    want = {(q, int(c)) for q in range(1500) for c in order[q, :5] if allowed[q, c]}
    assert {(h["query_id"], h["case_id"]) for h in recall.top_k(df, df, block=16).collect()} == want
    blocks = 1500 // 16
    assert s["compared"] < 0.25 * blocks * blocks / 2 and s["share_skipped"] > 0.3
    plan = recall._pairs(*[raw.sparkSession.createDataFrame([], recall.TILES)] * 2, 40, None)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "SinglePartition" not in plan


def test_ledgers_of_many_runs(spark, tmp_path):
    from larkspar.sources import readers

    for k in range(2):
        spark.createDataFrame([(k, "BUY")], "id long, action string").write.parquet(str(tmp_path / f"run{k}"))
    paths = [str(tmp_path / x) for x in ("run0", "gone", "run1", "run0")]
    assert sorted(r["id"] for r in readers.runs(spark, *paths).collect()) == [0, 1]
    with pytest.raises(FileNotFoundError):
        readers.runs(spark, str(tmp_path / "gone"))


def test_nearest_ranks_of_odd_groups(spark):
    import math

    groups = {"one": [5.0], "ties": [1.0] * 50 + [2.0], "two": [3.0, 1.0], "long": [float((i * 7919) % 1000) for i in range(3000)]}
    df = spark.createDataFrame([(k, v) for k, x in groups.items() for v in [*x, None]], "g string, v double")
    got = {x["g"]: (x["a"], x["b"], x["c"]) for x in evidence.nearest_ranks(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 1.0}).collect()}
    assert got == {k: tuple(sorted(x)[max(math.ceil(q * len(x)), 1) - 1] for q in (0.25, 0.5, 1.0)) for k, x in groups.items()}


def test_case_block(spark):
    rows = [("GOOD_ENTRY", "2024-01-02", "BUY", 10.0, 12.5, 25.0, None), ("MISSED_ENTRY", "2024-02-02", "WAIT", None, None, None, " waited too long "), (None, None, "HOLD", 3.0, 2.0, -33.4, "x")]
    df = spark.createDataFrame(rows, "verdict string, journal_date string, action string, price double, verdict_price double, pnl_pct double, lesson string")
    block = cases.case_block(df).first()["block"]
    assert block.index("**[MISSED_ENTRY] 2024-02-02 — You waited**\n> waited too long Lesson: Should have entered") < block.index("**[GOOD_ENTRY] 2024-01-02 — You bought at 10.00**\n> Price rose to 12.50 (+25%) in 10 days. Entry was correct.")
    assert "**[CASE] N/A — You acted at 3.00**\n> x\n" in block and cases.case_block(df.limit(0)).first()["block"] == ""


def test_out_of_sample(spark):
    d = spark.range(100).select("id", (99 - F.col("id")).alias("idx"))
    assert sorted(x["idx"] for x in stats.out_of_sample(d, 4).collect()) == [70, 79, 89, 99]
    assert stats.out_of_sample(d, 50).count() == 30 and stats.out_of_sample(d, 0).count() == 30


def test_outcome_edges(spark):
    d = spark.createDataFrame([([], "BUY"), ([10.0], "BUY"), ([10.0] * 5 + [10.21], "BUY_FULL"), ([10.0] * 5 + [9.79], "NO_BUY"), ([0.0, 1.0], "BUY")], "p array<double>, a string")
    r = [x["o"] for x in d.select(provenance.outcome(F.col("p"), F.col("a")).alias("o")).collect()]
    assert [x["outcome_label"] for x in r] == ["NEUTRAL", "NEUTRAL", "TRUE_POSITIVE", "TRUE_NEGATIVE", "NEUTRAL"]
    assert r[0]["return_t5"] == 0 and round(r[2]["return_t20"], 6) == 0.021


def test_redaction_lengths(spark):
    d = spark.createDataFrame([("x" * 120,), ("x" * 121,), ("",), (None,)], "t string")
    r = [x[0] for x in d.select(tx.redact_user(F.col("t"))).collect()]
    assert [len(x) for x in r[:2]] == [120, 120] and r[1].endswith("...") and r[2:] == ["(redacted)"] * 2


def test_shield_stream_state_equals_batch():
    rows = [(1.0, 10.0, c, 10.0, "C", 6.0) for c in (11, 9, 9, 9.5, 11, 12, 13, 9, 9, 9, 9, 9, 12)] + [(0.0, 0.0, 10.0, 10.0, "C", 2.0)]
    whole = bars.shield_steps(rows)
    state: dict = {}
    parts = bars.shield_steps(rows[:4], state) + bars.shield_steps(rows[4:9], state) + bars.shield_steps(rows[9:], state)
    assert whole == parts and {x[0] for x in whole} >= {"ACTIVE", "DAMAGED", "EXITED"} and whole[-1] == ("ACTIVE", 0, 0, 0, 0.0)


def test_indicators_start_after_enough_bars():
    x = np.linspace(1, 50, 60) + np.sin(np.arange(60))
    r = bars.indicators_of(x + 1, x - 1, x, np.ones(60))
    assert np.isnan(r["rsi"][13]) and not np.isnan(r["rsi"][14]) and np.isnan(r["macd_signal"][32]) and not np.isnan(r["macd_signal"][33]) and not np.isnan(r["adx"][27])
    assert ((0 <= r["rsi"][14:]) & (r["rsi"][14:] <= 100)).all()


def test_versioned_upsert_is_idempotent(spark, tmp_path):
    t = sinks.Versioned(spark, str(tmp_path / "t"))
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (1, "c", 2)], "id int, x string, seq int")
    assert t.upsert(a, ["id"], ["seq"]).count() == 2 and t.current() is None
    for _ in range(2):
        t.upsert(a, ["id"], ["seq"], dry_run=False)
        assert sorted((r["id"], r["x"]) for r in t.read().collect()) == [(1, "c"), (2, "b")]


def test_actions(spark, tmp_path):
    p = str(tmp_path / "rows")
    spark.createDataFrame([(1, 2)], "k int, v int").write.parquet(p)
    blocked = actions.run(spark, "evolve", "r", {"table": str(tmp_path / "t"), "rows": p, "keys": ["k"], "dry_run": False})
    assert blocked["status"] == "blocked" and actions.run(spark, "evaluate", "r", {})["status"] == "failed" and len(actions.ACTIONS) == 11
    assert actions.run(spark, "evolve", "r", {"table": str(tmp_path / "t"), "rows": p, "keys": ["k"]})["status"] == "ok"


def test_cosine_variants(spark):
    d = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    r = d.select(v.cosine(F.col("a"), F.col("b")), v.cosine_soft(F.col("a"), F.col("b")), v.cosine_floored(F.col("a"), F.col("b"))).first()
    assert r[0] is None and r[1] == 0 and r[2] == 0


def test_shield_as_stream(spark, tmp_path):
    schema = "symbol string, day string, shares double, cost double, close double, ma20 double, grade string, atr_pct double"
    closes = [11.0, 9, 9, 9.5, 11, 12, 13, 9, 9, 9, 9, 9, 12]
    rows = [("A", f"d{i:02d}", 1.0, 10.0, float(c), 10.0, "C", 2.0) for i, c in enumerate(closes)] + [("B", f"d{i:02d}", 1.0, 10.0, 20.0, 10.0, "D", 2.0) for i in range(5)]
    df = spark.createDataFrame(rows, schema)
    for i, part in enumerate((df.filter("day < 'd04'"), df.filter("day >= 'd04'"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = episodes.shield_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.foreachBatch(lambda b, _, i=i: b.write.mode("append").parquet(str(tmp_path / "out")))
        q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted(tuple(r) for r in bars.shield(df, "symbol", "day").collect())
    assert got == want
