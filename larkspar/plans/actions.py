"""Actions by name, with a safety gate: whatever writes runs dry unless told otherwise."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Action:
    run: Callable[[SparkSession, dict], dict]
    summary: str
    writes: bool = False


ACTIONS: dict[str, Action] = {}


def action(name: str, summary: str, writes: bool = False):
    def register(f):
        ACTIONS[name] = Action(f, summary, writes)
        return f

    return register


def require(params: dict, *names: str) -> None:
    gone = [n for n in names if n not in params]
    if gone:
        raise ValueError(f"missing parameters: {', '.join(gone)}")


@action("evaluate", "run summary of a ledger, written as a table if an output is named")
def _evaluate(spark, p):
    from ..operators import ledger

    require(p, "ledger")
    found = ledger.summary(spark.read.parquet(p["ledger"]))
    if p.get("output"):
        found.write.mode("overwrite").parquet(p["output"])
        return {"status": "ok", "output": p["output"]}
    # one row per run; a result that is returned as JSON passes through the driver as a whole
    return {"status": "ok", "runs": [r.asDict() for r in found.toLocalIterator()]}


@action("evolve", "write a new version of a table; needs dry_run off and unfreeze on", writes=True)
def _evolve(spark, p):
    from ..sources.sinks import Versioned

    require(p, "table", "rows", "keys")
    if not p.get("dry_run", True) and not p.get("unfreeze", False):
        return {"status": "blocked", "reason": "dry_run=false needs unfreeze=true"}
    new = spark.read.parquet(p["rows"])
    out = Versioned(spark, p["table"]).upsert(new, p["keys"], p.get("order", p["keys"]), dry_run=p.get("dry_run", True))
    return {"status": "ok", "rows": out.count()}


@action("fund_manager", "verdicts of a ledger against prices")
def _fund_manager(spark, p):
    from ..operators import ledger

    require(p, "ledger", "prices")
    v = ledger.verdicts(ledger.outcomes(spark.read.parquet(p["ledger"]), spark.read.parquet(p["prices"]), p.get("horizon", 10)))
    return {"status": "ok", "verdicts": {r["verdict"]: r["n"] for r in v.groupBy("verdict").agg(F.count("*").alias("n")).collect()}}


@action("forensics_tag", "latest cases per bucket")
def _forensics(spark, p):
    from ..operators import cases

    require(p, "cases")
    return {"status": "ok", "cases": [r.asDict() for r in cases.latest(spark.read.parquet(p["cases"]), top_k=p.get("top_k", 3)).collect()]}


@action("promote_lesson", "replay decisions and return their lessons", writes=True)
def _promote(spark, p):
    from ..operators import provenance

    require(p, "atoms")
    d = provenance.replay(spark.read.parquet(p["atoms"])).select("diagnosis", "lesson.*").distinct()
    if not p.get("dry_run", True):
        require(p, "out")
        d.write.mode("append").parquet(p["out"])
    return {"status": "ok", "lessons": d.count()}


@action("pattern", "select patterns by archetype")
def _pattern(spark, p):
    from ..operators import graph

    require(p, "patterns")
    return {"status": "ok", "patterns": [r["pattern_id"] for r in graph.select(spark.read.parquet(p["patterns"]), p.get("max_total", 50)).collect()]}


@action("pattern_store_build", "statistics and z-vectors of a pattern table", writes=True)
def _build(spark, p):
    from ..operators import stats

    require(p, "patterns")
    s = stats.feature_stats(spark.read.parquet(p["patterns"]), p.get("vec", "raw"))
    if not p.get("dry_run", True):
        require(p, "out")
        s.write.mode("overwrite").parquet(p["out"])
    return {"status": "ok", "dims": s.count()}


@action("pattern_similarity_eval", "guarded top-k of a pattern table")
def _similarity(spark, p):
    from ..operators import recall

    require(p, "patterns")
    d = spark.read.parquet(p["patterns"])
    return {"status": "ok", "hits": recall.arm(d, d, p.get("vec", "z"), k=p.get("top_k", 5)).count()}


@action("kronos_probe", "similarity of named vectors")
def _probe(spark, p):
    from ..operators import graph

    require(p, "vectors")
    d = spark.read.parquet(p["vectors"])
    if d.limit(101).count() > 100:
        raise ValueError("a probe compares at most 100 vectors")
    return {"status": "ok", "matrix": [r.asDict() for r in graph.similarity_matrix(d, "name", "vec").collect()]}


@action("kronos_embed", "embed windows of bars", writes=True)
def _embed(spark, p):
    from ..operators import fusion

    require(p, "windows")
    e = fusion.embed(spark.read.parquet(p["windows"]), p.get("key", "key"), p.get("bars", "bars"), p.get("mode", "last"))
    if not p.get("dry_run", True):
        require(p, "out")
        e.write.mode("overwrite").parquet(p["out"])
    return {"status": "ok", "rows": e.count()}


@action("cvrf_discriminate", "train and held-out symbols by a seeded shuffle, two to one")
def _discriminate(spark, p):
    require(p, "symbols")
    d = split(spark.read.parquet(p["symbols"]), "symbol", p.get("seed", 42))
    r = d.agg(F.count_if("train").alias("train"), F.count_if(~F.col("train")).alias("held_out")).first()
    return {"status": "ok", "train": r["train"], "held_out": r["held_out"]}


def split(df, column: str, seed: int = 42):
    """Distinct keys with whether they train: two thirds do, in the order of the seeded shuffle."""
    from ..operators import stats

    return stats.seeded_split(df, column, seed).drop("place")


def run(spark: SparkSession, name: str, run_id: str, params: dict) -> dict:
    """The result record; an action that fails or is blocked is a result, not an exception."""
    started = datetime.now(UTC).isoformat()
    if name not in ACTIONS:
        raise KeyError(f"unknown action {name}; known: {', '.join(sorted(ACTIONS))}")
    try:
        result = ACTIONS[name].run(spark, params)
        status = result.get("status", "ok")
    except ValueError as e:
        result, status = {"error": str(e)}, "failed"
    return {"run_id": run_id, "action": name, "status": status, "started": started, "completed": datetime.now(UTC).isoformat(), "result": result}


def main(argv: list[str]) -> int:
    """action --run-id ID --params-json JSON; 1 only for bad JSON or an exception."""
    import argparse

    a = argparse.ArgumentParser()
    a.add_argument("action", choices=sorted(ACTIONS))
    a.add_argument("--run-id", required=True)
    a.add_argument("--params-json", default="{}")
    args = a.parse_args(argv)
    try:
        params = json.loads(args.params_json)
        print(json.dumps(run(SparkSession.builder.getOrCreate(), args.action, args.run_id, params), default=str))
        return 0
    except Exception as e:  # noqa: BLE001  the exit code is the contract
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
