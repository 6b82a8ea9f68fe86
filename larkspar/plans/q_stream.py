"""Queries whose results SQL cannot express: encoders, streams and the action registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import bars, fusion
from ..sources.scratch import Tables
from ..streaming import queue
from . import actions
from .bindings import BARS, LEDGER, PATTERNS, bind, table
from .q_market import SQL as MARKET_SQL
from .q_recall import SQL as RECALL_SQL

QUERIES, SQL = {}, {}


def encoded(s, d):
    """Windows of bars through the stand-in encoder."""
    w = bind(s, d, BARS).withColumn("bars", bars.trailing(["open", "high", "low", "close", "volume"], ["symbol"], "day", 16))
    w = w.select(F.concat_ws("_", F.col("symbol").cast("string"), F.col("day").cast("string")).alias("key"), "bars")
    return fusion.embed(w, "key", "bars", mode="concat_last_mean").select("key", F.size("embedding").alias("dims"), F.length(fusion.to_bytes(F.col("embedding"))).alias("bytes"))


def stream_drain(s, d):
    """The queue drained once as a stream, each id pushed once."""
    root = Tables(s, "queue").root
    rows = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), F.when(F.col("event_id") % 4 == 0, "pending").when(F.col("event_id") % 4 == 1, "").when(F.col("event_id") % 4 == 2, "synced").alias("status"))
    rows.unionByName(rows.filter("id % 10 = 0")).write.parquet(f"{root}/in")
    out = f"{root}/out"
    queue.drain(s, f"{root}/in", "id long, created_at timestamp, status string", f"{root}/state", lambda df: df.write.mode("append").parquet(out)).awaitTermination()
    return s.read.schema("id long, created_at timestamp, status string").parquet(out).select("id")


QUERIES["emb1_encode_windows"] = encoded
QUERIES["str1_stream_drain"] = stream_drain
SQL["str1_stream_drain"] = "SELECT event_id AS id FROM events WHERE event_id % 4 <> 2"


def acted(s, d):
    """Actions run on tables made from the driver's: what each reports, and a write that the safety gate blocks."""
    tables, rows = Tables(s, "actions"), []
    ledger, patterns = bind(s, d, LEDGER), bind(s, d, PATTERNS)
    tables.write(ledger.drop("close"), "ledger")
    tables.write(ledger.select("symbol", "day", "close", F.col("id").alias("seq")), "prices")
    tables.write(patterns, "patterns")
    path = lambda name: f"{tables.root}/{name}"
    asked = {
        "fund_manager": {"ledger": path("ledger"), "prices": path("prices"), "horizon": 3}, "pattern": {"patterns": path("patterns")}, "pattern_store_build": {"patterns": path("patterns"), "vec": "vec"},
        "pattern_similarity_eval": {"patterns": path("patterns"), "vec": "vec"}, "cvrf_discriminate": {"symbols": path("ledger")},
        "evolve": {"table": path("out"), "rows": path("prices"), "keys": ["symbol"], "dry_run": False}, "evaluate": {},
    }
    count = {
        "fund_manager": lambda r: sum(r["verdicts"].values()), "pattern": lambda r: len(r["patterns"]), "pattern_store_build": lambda r: r["dims"], "pattern_similarity_eval": lambda r: r["hits"], "cvrf_discriminate": lambda r: r["train"],
    }
    for name, params in asked.items():
        r = actions.run(s, name, "run", params)
        rows.append((name, r["status"], count[name](r["result"]) if r["status"] == "ok" else 0, actions.ACTIONS[name].writes))
    return s.createDataFrame(rows, "action string, status string, n long, writes boolean")


QUERIES["api1_action_registry"] = acted
SQL["api1_action_registry"] = f"""
SELECT 'fund_manager' AS action, 'ok' AS status, (SELECT count(*) FROM ({MARKET_SQL["rul6_to_9_verdicts"]})) AS n, FALSE AS writes
UNION ALL SELECT 'pattern', 'ok', (SELECT count(*) FROM ({MARKET_SQL["top2_select_patterns"]})), FALSE
UNION ALL SELECT 'pattern_store_build', 'ok', (SELECT max(len(embedding)) FROM embeddings), TRUE
UNION ALL SELECT 'pattern_similarity_eval', 'ok', (SELECT count(*) FROM ({RECALL_SQL["jon1_query_top_k"]})), FALSE
UNION ALL SELECT 'cvrf_discriminate', 'ok', (SELECT greatest(1, count(DISTINCT user_id) * 2 // 3) FROM events), FALSE
UNION ALL SELECT 'evolve', 'blocked', 0, TRUE UNION ALL SELECT 'evaluate', 'failed', 0, FALSE
"""
QUERIES["emb9_floored_cosine"] = lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(v.cosine_floored(F.slice(v.doubles(F.col("embedding")), 1, 8), F.slice(v.doubles(F.col("embedding")), 9, 8)), 6).alias("sim"))
SQL["emb9_floored_cosine"] = "WITH e AS (SELECT vec_id, embedding[1:8]::DOUBLE[] AS a, embedding[9:16]::DOUBLE[] AS b FROM embeddings) SELECT vec_id, round(list_dot_product(a, b) / (greatest(sqrt(list_dot_product(a, a)), 1e-9) * greatest(sqrt(list_dot_product(b, b)), 1e-9)), 6) AS sim FROM e"
