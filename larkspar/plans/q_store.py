"""Keyed stores, artefacts, promotion, merges, splits, backfill and the causality probe over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import bars, episode, fusion, stats
from ..sources import sinks
from ..sources.scratch import Tables
from ..sources.store import Artefacts, KeyedStore, decision_rows, ledger_store, stats_rows, stats_store
from .bindings import BARS, LEDGER, bind, table
from .q_lab import DRESSED, lessons
from .q_lab import SQL as LAB_SQL
from .bindings import PATTERNS

QUERIES, SQL = {}, {}


def root(spark, name):
    return f"{Tables(spark, name).root}/store"


# ---- statistics, vectors, decisions --------------------------------------------------


def stored_stats(spark, sf):
    """Statistics of an early window, replaced by those of all rows; the second writing of a batch changes nothing."""
    store, e, names = stats_store(spark, root(spark, "stats")), table(spark, sf, "embeddings"), [f"f{i}" for i in range(64)]
    for part, batch in ((e.filter("vec_id < 100"), "early"), (e, "all"), (e.filter("vec_id < 50"), "early")):
        store.put(stats_rows(stats.feature_stats(part, "embedding"), names, "s1", "split", "2024-01-01", "2024-06-30", "2024-08-01"), batch)
    store.put(stats_rows(stats.feature_stats(e.filter("label = 1"), "embedding"), names, "s2", "split", "2024-01-01", "2024-06-30", "2024-08-01"), "other cohort")
    return store.read().select("stats_id", "feature_set", "feature_name", "train_end", "purge_bars", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n", "n_missing")


QUERIES["snk2_stats_store"] = stored_stats
_moments = "SELECT '{id}' AS stats_id, 'warpcore_v1' AS feature_set, 'f' || dim AS feature_name, DATE '2024-06-30' AS train_end, 20 AS purge_bars, round(avg(x), 6) AS mean, round(greatest(stddev_pop(x), 1e-9), 6) AS std, count(x) AS n, count(*) - count(x) AS n_missing FROM u WHERE {rows} GROUP BY dim"
SQL["snk2_stats_store"] = "WITH u AS (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) " + _moments.format(id="s1", rows="TRUE") + " UNION ALL " + _moments.format(id="s2", rows="label = 1")


def updated_vectors(spark, sf):
    """Rows put once, then vectors written in batches: an unknown id is ignored, a coalesced null sets nothing, and a compaction changes no row."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pattern_id"), v.doubles(F.col("embedding")).alias("x"), "label")
    store = KeyedStore(spark, root(spark, "vectors"), "pattern_id long, label int, kronos array<double>, fused array<double>, version string", ["pattern_id"])
    store.put(e.select("pattern_id", "label"), "rows")
    for k in range(2):
        store.update(e.filter(F.col("pattern_id") % 3 == k).select((F.col("pattern_id") + F.lit(10_000_000) * (F.col("pattern_id") % 2)).alias("pattern_id"), F.slice("x", 1, 4).alias("kronos")), f"kronos{k}")
    store.compact()
    store.update(e.filter("pattern_id % 4 = 0").select("pattern_id", F.slice("x", 5, 2).alias("fused"), F.lit("v1").alias("version")), "fused1", coalesce=True)
    store.update(e.filter("pattern_id % 8 = 0").select("pattern_id", F.slice("x", 7, 2).alias("fused"), F.lit(None).cast("string").alias("version")), "fused2", coalesce=True)
    store.put(e.filter("pattern_id % 50 = 0").select("pattern_id", F.lit(-1).alias("label")), "replaced")
    first = lambda c: F.round(F.get(c, F.lit(0)), 6)
    return store.read().select("pattern_id", F.col("label").cast("long").alias("label"), first("kronos").alias("kronos_0"), F.coalesce(F.size("kronos"), F.lit(0)).cast("long").alias("n_kronos"), first("fused").alias("fused_0"), "version")


QUERIES["snk5_vector_updates"] = updated_vectors
SQL["snk5_vector_updates"] = """
SELECT vec_id AS pattern_id, CASE WHEN vec_id % 50 = 0 THEN -1 ELSE label END AS label, CASE WHEN vec_id % 3 < 2 AND vec_id % 2 = 0 AND vec_id % 50 <> 0 THEN round(embedding[1]::DOUBLE, 6) END AS kronos_0,
  CASE WHEN vec_id % 3 < 2 AND vec_id % 2 = 0 AND vec_id % 50 <> 0 THEN 4 ELSE 0 END AS n_kronos,
  CASE WHEN vec_id % 50 = 0 THEN NULL WHEN vec_id % 8 = 0 THEN round(embedding[7]::DOUBLE, 6) WHEN vec_id % 4 = 0 THEN round(embedding[5]::DOUBLE, 6) END AS fused_0, CASE WHEN vec_id % 4 = 0 AND vec_id % 50 <> 0 THEN 'v1' END AS version
FROM embeddings
"""


def logged(spark, sf):
    """Decisions logged in three batches, one of them twice."""
    store = ledger_store(spark, root(spark, "ledger"))
    d = bind(spark, sf, LEDGER).select(
        "run_id", F.col("symbol").cast("string").alias("symbol"), F.col("day").alias("date"), "day_index", F.col("close").alias("close_price"), "action", (F.col("position_pct") / 100).alias("target_position_pct"),
        F.lit(0.5).alias("confidence"), F.array("action", "conviction").alias("reason_codes"), F.struct("conviction", F.col("shares").cast("long").alias("held")).alias("thesis_update"),
        F.when(F.col("shares") > 1, F.array(F.lit("size"))).alias("iron_blocks"), F.lit("why").alias("brief_rationale"), F.col("journal").alias("inner_journal"), F.struct(F.col("shares").cast("long").alias("shares")).alias("portfolio_state"),
    )
    for k in (0, 1, 0, 2):
        store.put(decision_rows(d.filter(F.col("day_index") % 3 == k), store.read()), f"day{k}")
    return store.read()


QUERIES["snk8_decision_log"] = logged
SQL["snk8_decision_log"] = f"""
SELECT row_number() OVER (ORDER BY day_index % 3, day_index) AS id, run_id, CAST(symbol AS VARCHAR) AS symbol, day AS date, day_index, close AS close_price, action, position_pct / 100 AS target_position_pct, 0.5::DOUBLE AS confidence,
  '["' || action || '","' || conviction || '"]' AS reason_codes, '{{"conviction":"' || conviction || '","held":' || CAST(shares AS BIGINT) || '}}' AS thesis_update, 'null' AS risk_flags, 'why' AS brief_rationale, coalesce(journal, '') AS inner_journal,
  '{{"shares":' || CAST(shares AS BIGINT) || '}}' AS portfolio_state, 'null' AS execution_result, '' AS iron_verdict, CASE WHEN shares > 1 THEN '["size"]' ELSE '[]' END AS iron_blocks, '[]' AS iron_penalties, '' AS snapshot_source,
  '' AS snapshot_schema_version, '' AS v8_grade_at_decision, NULL::DOUBLE AS v8_score_at_decision, '' AS iron_entry_verdict_at_decision, '[]' AS iron_entry_blocks_at_decision, '[]' AS toxic_breaker_factors_at_decision,
  '[]' AS objective_tension_types_at_decision, '' AS policy_gate_reason, '' AS pattern_recall_version, '' AS embedding_arm, '' AS stats_id, '' AS pca_artifact_id, '' AS top_k_case_ids, '' AS evidence_card_json, '' AS fund_manager_interpretation
FROM ({LEDGER})
"""


def artefact(spark, sf):
    """A basis fitted, saved twice and loaded: projections by the loaded one against the fitted one, with its record."""
    e, kept = table(spark, sf, "embeddings"), Artefacts(spark, root(spark, "artefacts"))
    basis = fusion.fit_pca(e, "embedding", components=4)
    for _ in range(2):
        record = kept.save(basis, "pca_a", "2024-01-01", "2024-06-30", "s1")
    loaded = kept.load("pca_a", "2024-07-01")
    gap = lambda x, y: F.array_max(F.zip_with(x, y, lambda a, b: F.abs(a - b)))
    return e.select("vec_id", (gap(fusion.project(F.col("embedding"), loaded), fusion.project(F.col("embedding"), basis)) == 0).alias("same"), *[F.lit(record[c]).cast("long").alias(c) for c in ("n_fit_rows", "n_components")], F.lit(str(record["fit_end"])).alias("fit_end"))


QUERIES["snk17_artefact_registry"] = artefact
SQL["snk17_artefact_registry"] = "SELECT vec_id, TRUE AS same, count(*) OVER () AS n_fit_rows, 4 AS n_components, '2024-06-30' AS fit_end FROM embeddings"

# ---- promotion -----------------------------------------------------------------------

EDGES = """
SELECT pattern_id AS source, pattern_id + 1 AS target, 'follows' AS relation, CAST(pattern_id % 7 AS DOUBLE) / 7 AS weight, 'e' || CAST(pattern_id AS STRING) AS evidence FROM {p} WHERE pattern_id % 2 = 0
UNION ALL SELECT pattern_id, pattern_id + 2, 'similar_to', CAST(0.5 AS DOUBLE), '' FROM {p} WHERE pattern_id % 6 = 0
"""


def promoted(spark, sf):
    p = bind(spark, sf, PATTERNS)
    dressed = spark.sql(DRESSED.replace(f"({PATTERNS})", "{p}"), p=p).withColumn("keyword", F.lit("spring_launch"))
    m = sinks.promotion(dressed, spark.sql(EDGES, p=p))
    return m.select("pattern_id", "path", "summary", "importance", F.array_join("keywords", ",").alias("keywords"), F.array_join("entities", ",").alias("entities"), F.col("metadata.source").alias("source"), F.coalesce(F.to_json("metadata.links"), F.lit("")).alias("links"), F.length("text").cast("long").alias("n_text"))


QUERIES["snk15_promotion"] = promoted
SQL["snk15_promotion"] = f"""
WITH p AS ({PATTERNS}), e AS ({EDGES.format(p="p")}),
l AS (SELECT source, '[' || string_agg('{{"target_pattern_id":' || target || ',"relation":"' || relation || '","weight":' || round(weight, 4)::VARCHAR || ',"evidence":"' || evidence || '"}}', ',' ORDER BY target, relation) || ']' AS links FROM e GROUP BY 1),
t AS ({LAB_SQL["prj24_memory_sentences"]})
SELECT p.pattern_id, '/trading/equity/patterns/' || symbol || '/' || CAST(as_of_date AS VARCHAR) AS path, 'golden launch' AS summary, 0.85::DOUBLE AS importance, 'pattern,spring_launch,' || coalesce(label_T10, 'unknown') || ',' || symbol AS keywords,
  symbol || ',Stock ' || symbol AS entities, 'phase6_auto_promote' AS source, coalesce(l.links, '') AS links, length(t.memory_text) AS n_text
FROM p JOIN t USING (pattern_id) LEFT JOIN l ON l.source = p.pattern_id
"""
QUERIES["snk16_lesson_document"] = lambda s, d: sinks.lesson_document(lessons(s, d).withColumn("symbol", F.lit("600.SH"))).select("id", "path", "text", F.col("metadata.verdict").alias("verdict"), F.col("metadata.type").alias("type"))
SQL["snk16_lesson_document"] = f"""
SELECT 'provenance_lesson:' || lesson_id AS id, '/trading/equity/lessons/decision_provenance/600.SH' AS path, verdict_type AS verdict, 'decision_provenance_lesson' AS type,
  '# Atomic Lesson: ' || lesson_id || chr(10) || chr(10) || '**Symbol**: 600.SH' || chr(10) || '**Verdict**: ' || verdict_type || chr(10) || '**Axiom**: ' || core_axiom || chr(10) || '**Evidence**: ' || evidence || chr(10) AS text
FROM ({LAB_SQL["prj30_lesson"]})
"""

# ---- merges and splits ---------------------------------------------------------------


def merged(spark, sf):
    """Even events train, odd ones follow; users under 5 have one side, users over 9 the other."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("symbol"), "event_id", F.col("value").alias("close"))
    train = e.filter("event_id % 2 = 0 AND NOT (symbol < 5)")
    more = e.filter("(event_id % 2 = 1 OR event_id % 10 = 0) AND NOT (symbol > 9 AND symbol < 14)")
    return episode.merged(train, more, "symbol", "event_id").select("symbol", "place", "event_id", "part")


QUERIES["jon17_merged_lists"] = merged
SQL["jon17_merged_lists"] = """
WITH b AS (
  SELECT user_id AS symbol, event_id, 0 AS part FROM events WHERE event_id % 2 = 0 AND NOT (user_id < 5)
  UNION ALL SELECT user_id, event_id, 1 FROM events WHERE (event_id % 2 = 1 OR event_id % 10 = 0) AND NOT (user_id > 9 AND user_id < 14)
) SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY part, event_id) - 1 AS place, event_id, part FROM b
"""
QUERIES["top9_seeded_split"] = lambda s, d: stats.seeded_split(table(s, d, "events").select(F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("symbol")), "symbol")

# ---- backfill and probe --------------------------------------------------------------


def filled(spark, sf):
    """A backfill that is cut off after three claims, goes on, and is repeated."""
    b = bind(spark, sf, BARS).select(F.col("symbol").cast("string").alias("symbol"), "day", F.array(*[F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume")]).alias("bar"))
    key = F.concat_ws("_", "symbol", F.col("day").cast("string"))
    t = b.filter("CAST(symbol AS INT) % 3 <> 0").withColumn("day", F.when(F.day("day") % 10 == 0, F.date_add("day", 400)).otherwise(F.col("day"))).select(key.alias("pattern_id"), "symbol", "day")
    t = t.withColumn("symbol", F.when(F.day("day") % 7 == 0, F.concat(F.lit("gone"), "symbol")).otherwise(F.col("symbol")))
    store = KeyedStore(spark, root(spark, "backfill"), "pattern_id string, symbol string, kronos_vector array<double>", ["pattern_id"])
    store.put(t.select("pattern_id", "symbol").distinct(), "rows")
    for most in (3, None, None):
        fusion.backfill(store, t, b, "kronos", length=16, most_claims=most)
    return store.read().select("pattern_id", F.coalesce(F.size("kronos_vector"), F.lit(0)).cast("long").alias("dims"))


QUERIES["emb5_backfill"] = filled
SQL["emb5_backfill"] = f"""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i FROM ({BARS})),
t AS (SELECT CAST(symbol AS VARCHAR) AS symbol, i, CASE WHEN day(day) % 10 = 0 THEN day + 400 ELSE day END AS due, day(day) % 10 = 0 AS moved FROM b WHERE symbol % 3 <> 0)
SELECT symbol || '_' || CAST(CAST(due AS DATE) AS VARCHAR) AS pattern_id, CASE WHEN moved OR day(due) % 7 = 0 OR i < 2 THEN 0 ELSE 16 END AS dims FROM t
"""


def running(x):
    """Means of the bars so far: causal."""
    import numpy as np

    return np.cumsum(x, 0) / np.arange(1, len(x) + 1)[:, None]


def centred(x):
    """Bars against the mean of the whole window: later bars reach earlier states."""
    return x - x.mean(0)


def probed(spark, sf):
    w = bind(spark, sf, BARS).withColumn("bars", bars.trailing(["close"], ["symbol"], "day", 16)).select(F.concat_ws("_", F.col("symbol").cast("string"), F.col("day").cast("string")).alias("key"), "bars")
    out = None
    for name, encoder in (("running", running), ("centred", centred)):
        one = fusion.causality(w, "key", "bars", encoder).withColumn("encoder", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("encoder", "key", "positions", F.round("difference", 6).alias("difference"), "leaks")


QUERIES["emb7_causality_probe"] = probed
SQL["emb7_causality_probe"] = f"""
WITH w AS (SELECT symbol || '_' || CAST(day AS VARCHAR) AS key, list(close::DOUBLE) OVER (PARTITION BY symbol ORDER BY day ROWS 15 PRECEDING) AS x FROM ({BARS})),
c AS (SELECT key, x, len(x) // 2 AS n FROM w WHERE len(x) >= 4), m AS (SELECT *, list_avg(x[1:n]) AS mu, list_aggregate(x[1:n], 'stddev_pop') AS sd FROM c),
z AS (SELECT key, n, list_transform(x, lambda v: greatest(-5, least(5, (v - mu) / (sd + 1e-5)))) AS z FROM m), d AS (SELECT key, n, abs(list_avg(z) - list_avg(z[1:n])) AS d FROM z)
SELECT 'running' AS encoder, key, n AS positions, 0.0::DOUBLE AS difference, FALSE AS leaks FROM d UNION ALL SELECT 'centred', key, n, round(d, 6), d > 1e-6 FROM d
"""
