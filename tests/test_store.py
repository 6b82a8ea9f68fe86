"""Keyed stores, artefacts, backfill, splits, merges and reports: repeats, cut-off runs and plain loops."""

import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspar.operators import ablation, episode, fusion, stats
from larkspar.sources import store as st

SCHEMA = "id long, a int, b string"


def rows(s):
    return sorted(tuple(r) for r in s.read().collect())


def frame(spark, *values, columns=SCHEMA):
    return spark.createDataFrame(list(values), columns)


def test_store_repeats_updates_and_compacts(spark, tmp_path):
    s = st.KeyedStore(spark, str(tmp_path / "s"), SCHEMA, ["id"])
    assert rows(s) == []
    assert s.put(frame(spark, (1, 1, "x"), (2, 2, "y")), "one") and not s.put(frame(spark, (1, 9, "z")), "one")
    assert s.update(frame(spark, (1, 5), (7, 7), columns="id long, a int"), "two")
    assert rows(s) == [(1, 5, "x"), (2, 2, "y")]
    s.update(frame(spark, (1, None, None), (2, None, "w")), "three", coalesce=True)
    assert rows(s) == [(1, 5, "x"), (2, 2, "w")]
    before = rows(s)
    s.compact()
    s.compact()
    assert rows(s) == before and len(list((tmp_path / "s" / "bases").glob("*.json"))) == 1
    assert not s.put(frame(spark, (1, 9, "z")), "one")
    s.put(frame(spark, (2, None, None), (3, 3, "v")), "four")
    assert rows(s) == [(1, 5, "x"), (2, None, None), (3, 3, "v")]
    with pytest.raises(ValueError):
        s.put(frame(spark, (1, 2), columns="id long, c int"), "five")


def test_a_batch_that_was_cut_off_is_unseen_and_can_be_repeated(spark, tmp_path, monkeypatch):
    s = st.KeyedStore(spark, str(tmp_path / "s"), SCHEMA, ["id"])
    s.put(frame(spark, (1, 1, "x")), "one")
    monkeypatch.setattr(s, "_create", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        s.put(frame(spark, (1, 2, "half"), (5, 5, "half")), "two")
    monkeypatch.undo()
    assert rows(s) == [(1, 1, "x")]
    assert s.put(frame(spark, (1, 3, "whole")), "two") and rows(s) == [(1, 3, "whole")]


def test_what_a_batch_writes_does_not_follow_the_table(spark, tmp_path):
    s = st.KeyedStore(spark, str(tmp_path / "s"), SCHEMA, ["id"])
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "s").rglob("*.parquet"))
    s.put(spark.range(20_000).select("id", F.col("id").cast("int").alias("a"), F.sha2(F.col("id").cast("string"), 256).alias("b")), "large")
    before = size()
    s.put(frame(spark, (1, 1, "x")), "small")
    assert size() - before < 0.05 * before


def test_artefacts_refuse_what_does_not_match(spark, tmp_path):
    e = spark.createDataFrame([(r.tolist(),) for r in np.random.default_rng(1).normal(size=(40, 5))], "x array<double>")
    basis, kept = fusion.fit_pca(e, "x", components=2), st.Artefacts(spark, str(tmp_path / "a"))
    record = kept.save(basis, "p", "2024-01-01", "2024-06-30")
    assert kept.save(basis, "p", "2024-01-01", "2024-06-30") == record and kept.load("p", "2024-06-30") == basis
    with pytest.raises(ValueError, match="another"):
        kept.save(basis | {"n": 1}, "p", "2024-01-01", "2024-06-30")
    with pytest.raises(ValueError, match="after"):
        kept.load("p", "2024-06-29")
    with pytest.raises(KeyError):
        kept.load("q")
    part = next(Path(record["artifact_path"]).glob("part-*"))
    text = part.read_text()
    part.write_text(text.replace("true", "false"))
    (part.parent / f".{part.name}.crc").unlink()
    with pytest.raises(ValueError, match="record"):
        kept.load("p")


def test_seeded_split_is_the_shuffle_of_the_sorted_list(spark):
    for n in (1, 2, 3, 50, 700):
        names = [f"S{i * 7 % 1000}" for i in range(n)]
        df = spark.createDataFrame([(x,) for x in names * 2 + [None]], "symbol string")
        want = sorted(set(names))
        random.Random(7).shuffle(want)
        got = {r["symbol"]: (r["place"], r["train"]) for r in stats.seeded_split(df, "symbol", seed=7).collect()}
        assert got == {x: (i, i < max(1, len(want) * 2 // 3)) for i, x in enumerate(want)}


def test_merged_lists_keep_one_sided_keys_and_order(spark):
    a, b = {"x": [3, 1, 1], "y": [5]}, {"x": [2, 0], "z": [4]}
    make = lambda d: spark.createDataFrame([(k, v) for k, vs in d.items() for v in vs], "s string, t int")
    want, got = defaultdict(list), defaultdict(list)
    for d in (a, b):
        for k, vs in d.items():
            want[k].extend(sorted(vs))
    for r in sorted(episode.merged(make(a), make(b), "s", "t").collect(), key=lambda r: r["place"]):
        got[r["s"]].append(r["t"])
    assert got == want


def series(spark):
    bars = [(s, f"2024-01-{d:02d}", [float(d + k), 1.0]) for k, s in enumerate("abcdefgh") for d in range(1, 12)]
    targets = [(f"{s}{d}", s, f"2024-01-{d:02d}") for s in "abcdefghz" for d in (1, 2, 9, 20)]
    return spark.createDataFrame(targets, "pattern_id string, symbol string, day string"), spark.createDataFrame(bars, "symbol string, day string, bar array<double>")


def test_backfill_goes_on_where_it_was_cut_off(spark, tmp_path):
    targets, bars = series(spark)
    stores = []
    for name, runs in (("one", (None,)), ("cut", (1, 2, None, None))):
        s = st.KeyedStore(spark, str(tmp_path / name), "pattern_id string, kronos_vector array<double>", ["pattern_id"])
        s.put(targets.select("pattern_id"), "rows")
        found = [fusion.backfill(s, targets, bars, "k", length=4, claims=4, most_claims=most) for most in runs]
        assert found[-1]["claims"] == (4 if name == "one" else 0)
        assert sum(f["n_written"] for f in found) == 16 and {k: sum(f["skips"][k] for f in found) for k in fusion.SKIPS} == {"no_series": 4, "date_not_in_series": 8, "insufficient_bars": 8}
        stores.append(sorted((r["pattern_id"], r["kronos_vector"]) for r in s.read().collect()))
    assert stores[0] == stores[1] and sum(v is not None for _, v in stores[0]) == 16


def test_a_leaking_encoder_is_caught(spark):
    r = np.random.default_rng(2)
    w = spark.createDataFrame([(i, r.normal(size=(12, 3)).tolist()) for i in range(5)] + [(9, [[1.0]] * 3), (10, None)], "k long, bars array<array<double>>")
    found = lambda encoder: {x["key"]: x["leaks"] for x in fusion.causality(w, "k", "bars", encoder).collect()}
    backwards = lambda x: np.cumsum(x[::-1], 0)[::-1]
    assert found(fusion.stub_encoder) == dict.fromkeys(range(5), False) and found(backwards) == dict.fromkeys(range(5), True)


def test_ablation_gives_reasons_intervals_and_a_verdict(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(160):
        label = "true_S" if r.random() < 0.5 else "false_trap"
        good = [1.0 if label == "true_S" else -1.0, *(0.05 * r.normal(size=3)).tolist()]
        rows.append((i, f"s{i % 5}", i, "", "bull", good, r.normal(size=4).tolist(), None, label, 1.5, -2.0))
    p = spark.createDataFrame(rows, "id long, symbol string, idx long, cohort string, market_regime string, good array<double>, bad array<double>, none array<double>, label_T10 string, fwd_return_T10 double, mae_T10 double")
    found = ablation.metrics(p, {"A": "bad", "B": "none", "C": "good"}, horizons=("T10",))
    whole = ablation.report(found, "A", resamples=500)
    assert whole["arms"]["B"] == {"skipped": True, "reason": "no none vectors"}
    a, c = (whole["arms"][x]["horizons"]["T10"] for x in "AC")
    assert a["n_queries"] == c["n_queries"] == 20 and c["mean_neighbor_age_median"] > 0 and 0 <= c["mean_same_symbol_ratio"] <= 1
    # the neighbours' rates of the arm that knows the label are 0 or 1, and their mean is the share of such queries
    rates = next(x["true_S"] for x in found.collect() if x["arm"] == "C")
    assert set(rates) <= {0.0, 1.0} and c["mean_true_S_rate"] == round(sum(rates) / len(rates), 3)
    boot = np.random.default_rng(0)
    means = np.sort(np.array(rates)[boot.integers(0, 20, (500, 20))].mean(1))
    low = whole["decision"]["arms"]["C"]["lower"]
    assert means[0] <= low <= c["mean_true_S_rate"] and whole["decision"]["verdict"] in ("SIGNIFICANT", "UNCERTAIN", "TIED") and whole["decision"]["reason"]
    assert ablation.decide(found, "B")["verdict"] == "PENDING" and "B arm missing" in ablation.decide(found, "B")["reason"]
    one = ablation.metrics(p, {"A": "bad", "B": "none"}, horizons=("T10",))
    assert ablation.decide(one, "A")["reason"] == "Only ['A'] available; need at least 2 arms for comparison."
