"""The day rules in windows, row by row, and as a stream that is stopped, started again and started from a batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larkspar.operators import bars, episode
from larkspar.streaming import episodes

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    r, out = random.Random(3), []
    for s in range(6):
        for k in range(45):
            if r.random() < 0.3:
                continue
            close = r.choice([None, 0.0]) if r.random() < 0.05 else 50 + 20 * r.random()
            held = float(r.choice([0, 1, 1, 1, 1, 2])) if r.random() < 0.9 else None
            grade = r.choice(["D", "C", "A", None, "d"]) if r.random() < 0.6 else "B"
            flags = r.random() < 0.3, r.random() < 0.5, r.random() < 0.12
            out.append((f"s{s}", START + dt.timedelta(days=k), held, 50.0, close, 60.0 if r.random() < 0.9 else None, grade, r.choice([0.0, 3.0, 8.0, None]), r.choice(["SELL", "TRIM", "ADD", "HOLD"]), r.choice(["PROBE", "FULL", "SKIP", "HIGH"]), *flags))
    return out


def plain(table, kind="day"):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in (r[c] for c in episodes.NAMES)) for r in table if r["kind"] == kind), key=repr)


def test_shield_in_windows_is_the_shield_by_steps(spark, rows):
    got = {(r["symbol"], r["at"]): tuple(r)[2:] for r in bars.shield(spark.createDataFrame(rows, episode.DAY), "symbol", "at").collect()}
    modes = set()
    for s in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == s), key=lambda r: r[1])
        for r, want in zip(own, bars.shield_steps([r[2:8] for r in own]), strict=True):
            assert got[s, r[1]] == want
            modes.add(want[0])
    assert modes == {"ACTIVE", "DAMAGED", "EXITED"}


def test_stream_stopped_and_started_again_is_the_batch(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, episode.DAY)
    batch = episode.fold(df)
    path = {n: str(tmp_path / n) for n in ("in", "out", "state")}
    for first, last in ((0, 20), (20, 45)):
        df.filter((df["at"] >= START + dt.timedelta(days=first)) & (df["at"] < START + dt.timedelta(days=last))).write.mode("append").parquet(path["in"])
        episodes.run_days(spark, path["in"], path["out"], path["state"])
    out = spark.read.parquet(path["out"]).collect()
    assert plain(out) == plain(batch.collect())
    beats = sorted((r["symbol"], r["at"]) for r in episode.heartbeats(batch, max(r[1] for r in rows)).collect())
    noted = [r for r in out if r["kind"] == "heartbeat"]
    assert beats and sorted((r["symbol"], r["at"]) for r in noted) == beats and not any(r["wake"] for r in noted)


def test_stream_starts_from_the_state_of_a_batch(spark, rows, tmp_path):
    df, cut = spark.createDataFrame(rows, episode.DAY), START + dt.timedelta(days=25)
    path = {n: str(tmp_path / n) for n in ("in", "out", "state")}
    df.filter(df["at"] >= cut).write.parquet(path["in"])
    episodes.run_days(spark, path["in"], path["out"], path["state"], episode.state_after(df.filter(df["at"] < cut)))
    later = episode.fold(df).filter(F.col("at") >= F.lit(cut))
    assert plain(spark.read.parquet(path["out"]).collect()) == plain(later.collect())


def test_no_days(spark):
    assert episode.fold(spark.createDataFrame([], episode.DAY)).count() == 0 == episode.state_after(spark.createDataFrame([], episode.DAY)).count()
