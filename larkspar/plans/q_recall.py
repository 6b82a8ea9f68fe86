"""Recall, evidence, statistics and fusion over the driver's embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import evidence, fusion, guards, recall, stats
from .bindings import PATTERNS, bind, table

QUERIES, SQL = {}, {}

TOP_SQL = f"""WITH p AS ({PATTERNS}), s AS (
  SELECT q.id AS query_id, c.id AS case_id, round(list_cosine_similarity(q.VEC::DOUBLE[], c.VEC::DOUBLE[]), 12) AS similarity
  FROM p q JOIN p c ON c.idx <= q.idx - 40 AND c.id <> q.id AND (COND)
), hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, case_id) AS rank FROM s QUALIFY rank <= 5)
"""
PLAIN = TOP_SQL.replace("VEC", "vec").replace("COND", "TRUE")


def hits(spark, sf, **options):
    p = bind(spark, sf, PATTERNS)
    return recall.top_k(p, p, **options)


def shown(h):
    return h.select("query_id", "case_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


SHOW = "SELECT query_id, case_id, round(similarity, 6) AS similarity, rank FROM hits"
QUERIES["jon1_query_top_k"] = lambda s, d: shown(hits(s, d))
SQL["jon1_query_top_k"] = PLAIN + SHOW
QUERIES["flt3_top_k_other_symbols"] = lambda s, d: shown(hits(s, d, exclude_symbol=True))
SQL["flt3_top_k_other_symbols"] = TOP_SQL.replace("VEC", "vec").replace("COND", "c.symbol <> q.symbol") + SHOW
QUERIES["flt3_top_k_symbol_gap"] = lambda s, d: shown(hits(s, d, exclude_symbol=True, gap=90))
SQL["flt3_top_k_symbol_gap"] = TOP_SQL.replace("VEC", "vec").replace("COND", "c.symbol <> q.symbol OR c.idx <= q.idx - 90") + SHOW


def cards(spark, sf, **options):
    p = bind(spark, sf, PATTERNS)
    case = p.select(F.col("id").alias("case_id"), F.col("symbol").alias("case_symbol"), F.col("idx").alias("case_idx"), F.col("label_T10").alias("label"), F.col("fwd_return_T10").alias("fwd_return"), F.col("mae_T10").alias("mae"), F.col("market_regime").alias("case_regime"))
    q = p.select(F.col("id").alias("query_id"), "symbol", "idx", F.col("market_regime").alias("regime"))
    return evidence.cards(hits(spark, sf, **options).join(case, "case_id"), q)


CARD_SQL = """, j AS (
  SELECT h.*, q.symbol AS qs, c.symbol AS cs, q.idx - c.idx AS age, c.label_T10 AS label, c.fwd_return_T10 AS fwd, c.mae_T10 AS mae, q.market_regime AS qr, c.market_regime AS cr
  FROM hits h JOIN p q ON q.id = h.query_id JOIN p c ON c.id = h.case_id
), pl AS (SELECT query_id, label, count(*) AS n FROM j WHERE label IS NOT NULL GROUP BY ALL
), ent AS (SELECT pl.query_id, -sum(n / a * ln(n / a)) AS e FROM pl JOIN (SELECT query_id, count(*)::DOUBLE AS a FROM j GROUP BY 1) t ON t.query_id = pl.query_id GROUP BY 1
), b AS (SELECT query_id, count(*) AS n, count(*) FILTER (label = 'true_S') / count(*) AS ts, count(*) FILTER (label = 'stale_S') / count(*) AS ss, count(*) FILTER (label = 'false_trap') / count(*) AS ft,
  avg(fwd) AS avg_fwd, quantile_disc(fwd, 0.5) AS med_fwd, min(mae) AS worst, quantile_disc(mae, 0.25) AS m25, quantile_disc(mae, 0.75) AS m75, quantile_disc(age, 0.5) AS amed, min(age) AS amin, max(age) AS amax,
  count(*) FILTER (cs = qs) / count(*) AS same, count(DISTINCT cs) / count(*) AS div, count(*) FILTER (cr = qr) AS sr, count(cr) AS wr FROM j GROUP BY 1
), card AS (SELECT q.id AS query_id, coalesce(b.n, 0) AS n, coalesce(ts, 0) AS ts, coalesce(ss, 0) AS ss, coalesce(ft, 0) AS ft, coalesce(e, 0) AS e, avg_fwd, med_fwd, worst, m25, m75, amed, amin, amax, coalesce(same, 0) AS same, coalesce(div, 0) AS div,
  CASE WHEN q.market_regime IS NOT NULL AND wr > 0 THEN sr / wr END AS rm FROM p q LEFT JOIN b ON b.query_id = q.id LEFT JOIN ent ON ent.query_id = q.id)
"""
QUERIES["agg1_evidence_cards"] = lambda s, d: cards(s, d).select(
    "query_id", F.col("top_k_returned").alias("n"), *[F.round(c, 6).alias(c) for c in ("true_S_rate", "stale_S_rate", "false_trap_rate", "label_entropy", "avg_fwd_return", "same_symbol_ratio", "support_diversity", "regime_match_rate")],
    "median_fwd_return", "worst_mae", "mae_p25", "mae_p75", "age_median", "age_min", "age_max", F.array_join("warnings", ",").alias("warnings"),
)
SQL["agg1_evidence_cards"] = PLAIN + CARD_SQL + """SELECT query_id, n, round(ts, 6) AS "true_S_rate", round(ss, 6) AS "stale_S_rate", round(ft, 6) AS false_trap_rate, round(e, 6) AS label_entropy, round(avg_fwd, 6) AS avg_fwd_return, round(same, 6) AS same_symbol_ratio,
  round(div, 6) AS support_diversity, round(rm, 6) AS regime_match_rate, med_fwd AS median_fwd_return, worst AS worst_mae, m25 AS mae_p25, m75 AS mae_p75, amed AS age_median, amin AS age_min, amax AS age_max,
  concat_ws(',', CASE WHEN same > 0.5 THEN 'same-symbol support ratio high; treat confidence as lower' END, CASE WHEN n = 0 THEN 'no neighbors returned after leakage guards' WHEN n < 2 THEN 'sparse support set' END) AS warnings FROM card"""
QUERIES["agg2_label_distribution"] = lambda s, d: cards(s, d).select("query_id", F.explode("label_distribution").alias("label", "n"))
SQL["agg2_label_distribution"] = PLAIN + CARD_SQL + "SELECT query_id, label, n FROM pl"
QUERIES["rul5_stance"] = lambda s, d: cards(s, d).select("query_id", evidence.stance(F.col("top_k_returned"), F.col("false_trap_rate"), F.col("same_symbol_ratio"), F.col("true_S_rate")).alias("stance"))
SQL["rul5_stance"] = PLAIN + CARD_SQL + "SELECT query_id, CASE WHEN n = 0 THEN 'abstain' WHEN ft >= 0.35 THEN 'caution' WHEN same >= 0.5 THEN 'lower_confidence' WHEN ts >= 0.5 AND ft < 0.2 THEN 'confirm' ELSE 'caution' END AS stance FROM card"
QUERIES["prj26_prompt_block"] = lambda s, d: evidence.prompt_block(cards(s, d))
SQL["prj26_prompt_block"] = PLAIN + CARD_SQL + "SELECT query_id, CASE WHEN n > 0 THEN printf('neighbours %d | true_S %.2f | false_trap %.2f | same symbol %.2f | average return %+.2f', n, ts, ft, same, coalesce(avg_fwd, 0)) ELSE '' END AS block FROM card"


def late(spark, sf):
    p = bind(spark, sf, PATTERNS)
    out = None
    for name, vec in (("whole", F.col("vec")), ("head", F.slice("vec", 1, 16))):
        a = p.withColumn("vec", vec)
        case = p.select(F.col("id").alias("case_id"), F.col("symbol").alias("cs"), F.col("label_T10").alias("label"))
        h = recall.top_k(a, a).join(case, "case_id").groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "true_S").alias("t"), F.count_if(F.col("label") == "false_trap").alias("f"), F.count_distinct("cs").alias("c"))
        score = evidence.arm_score(F.col("t") / F.col("n"), F.col("f") / F.col("n"), F.col("c") / F.col("n"))
        rows = h.select("query_id", F.lit(name).alias("arm"), score.alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return evidence.late_fusion(out).select("query_id", F.round("late_fusion_score", 6).alias("late_fusion_score"))


QUERIES["agg20_late_fusion"] = late
SQL["agg20_late_fusion"] = f"""WITH p AS ({PATTERNS}), a AS (SELECT id, idx, symbol, label_T10, 'whole' AS arm, vec::DOUBLE[] AS v FROM p UNION ALL SELECT id, idx, symbol, label_T10, 'head', vec[1:16]::DOUBLE[] FROM p),
s AS (SELECT q.id AS query_id, q.arm, c.id AS case_id, c.symbol AS cs, c.label_T10 AS label, round(list_cosine_similarity(q.v, c.v), 12) AS sim FROM a q JOIN a c ON q.arm = c.arm AND c.idx <= q.idx - 40 AND c.id <> q.id),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id, arm ORDER BY sim DESC, case_id) AS r FROM s QUALIFY r <= 5),
x AS (SELECT query_id, arm, (count(*) FILTER (label = 'true_S') / count(*)) * (1 - count(*) FILTER (label = 'false_trap') / count(*)) * (0.5 + 0.5 * count(DISTINCT cs) / count(*)) AS score FROM h GROUP BY 1, 2)
SELECT query_id, round(CASE WHEN sum(score) > 0 THEN sum(score * score) / sum(score) ELSE 0 END, 6) AS late_fusion_score FROM x GROUP BY 1"""


def ic(spark, sf):
    p = bind(spark, sf, PATTERNS).select(F.col("id").alias("query_id"), F.col("fwd_return_T10").alias("fwd_return"))
    r = stats.rank_ic(cards(spark, sf), p)
    return r.select("n", F.round("rank_ic", 6).alias("rank_ic"))


QUERIES["agg14_rank_ic"] = ic
SQL["agg14_rank_ic"] = PLAIN + CARD_SQL + """, r AS (SELECT row_number() OVER (ORDER BY avg_fwd, query_id) AS a, row_number() OVER (ORDER BY fwd_return_T10, query_id) AS b FROM card JOIN p ON p.id = card.query_id WHERE avg_fwd IS NOT NULL)
SELECT count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(a, b) END, 6) AS rank_ic FROM r"""
QUERIES["agg15_mean_metrics"] = lambda s, d: stats.mean_metrics(cards(s, d)).select("queries", F.round("mean_true_S_rate", 6).alias("true_s"), F.round("mean_label_entropy", 6).alias("entropy"), F.round("mean_avg_fwd_return", 6).alias("fwd"))
SQL["agg15_mean_metrics"] = PLAIN + CARD_SQL + "SELECT count(*) AS queries, round(avg(ts), 6) AS true_s, round(avg(e), 6) AS entropy, round(avg(avg_fwd), 6) AS fwd FROM card"
QUERIES["agg13_spearman"] = lambda s, d: stats.spearman(table(s, d, "orders"), "o_totalprice", "o_custkey", "o_orderkey").select("n", F.round("rank_ic", 6).alias("rank_ic"))
SQL["agg13_spearman"] = "WITH r AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS a, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS b FROM orders) SELECT count(*) AS n, round(corr(a, b), 6) AS rank_ic FROM r"
QUERIES["agg12_feature_stats"] = lambda s, d: stats.feature_stats(table(s, d, "embeddings"), "embedding").select(F.col("dim").cast("long").alias("dim"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n", "n_missing")
SQL["agg12_feature_stats"] = "WITH u AS (SELECT unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT dim, round(avg(x), 6) AS mean, round(greatest(stddev_pop(x), 1e-9), 6) AS std, count(x) AS n, count(*) - count(x) AS n_missing FROM u GROUP BY dim"


def znorm(spark, sf):
    e = table(spark, sf, "embeddings")
    means, stds = stats.as_arrays(stats.feature_stats(e, "embedding"))
    z = e.select("vec_id", v.zscore(v.doubles(F.col("embedding")), means, stds).alias("z"))
    return z.select("vec_id", F.posexplode("z").alias("dim", "x")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("x", 5).alias("z"))


QUERIES["agg12_z_vectors"] = znorm
SQL["agg12_z_vectors"] = "WITH u AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT dim, avg(x) AS m, greatest(stddev_pop(x), 1e-9) AS sd FROM u GROUP BY dim) SELECT vec_id, u.dim, round((x - m) / sd, 5) AS z FROM u JOIN s ON u.dim = s.dim"
QUERIES["agg4_nearest_rank"] = lambda s, d: evidence.nearest_ranks(
    table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p25": 0.25, "p50": 0.5, "p75": 0.75}
)
SQL["agg4_nearest_rank"] = "SELECT l_returnflag, l_linestatus, quantile_disc(l_extendedprice, 0.25) AS p25, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.75) AS p75 FROM lineitem GROUP BY ALL"
QUERIES["flt1_guard_pairs"] = lambda s, d: bind(s, d, PATTERNS).filter(guards.check_index(F.col("idx"))).groupBy("symbol").agg(F.max("idx").alias("last"), F.count("*").alias("n"), F.count_if(guards.is_safe(F.lit(300), F.col("idx"))).alias("safe"), F.count_if(guards.future(F.lit(300), F.col("idx"))).alias("future"))
SQL["flt1_guard_pairs"] = f"SELECT symbol, max(idx) AS last, count(*) AS n, count(*) FILTER (idx <= 260) AS safe, count(*) FILTER (idx > 299) AS future FROM ({PATTERNS}) GROUP BY 1"
QUERIES["flt15_arm_availability"] = lambda s, d: s.createDataFrame([("vec", recall.has_vectors(bind(s, d, PATTERNS), "vec"))], "arm string, available boolean")
SQL["flt15_arm_availability"] = "SELECT 'vec' AS arm, count(embedding) > 0 AS available FROM embeddings"
QUERIES["top6_evenly_spaced"] = lambda s, d: stats.evenly_spaced(bind(s, d, PATTERNS), 20, "id").select("id")
SQL["top6_evenly_spaced"] = "WITH r AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings) SELECT DISTINCT id FROM r JOIN range(20) t(k) ON i = floor(k * (n - 1) / 19)"
QUERIES["win6_window_zscore"] = lambda s, d: table(s, d, "embeddings").select("vec_id", F.posexplode(v.window_zscore(v.doubles(F.col("embedding")))).alias("dim", "x")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("x", 5).alias("x"))
SQL["win6_window_zscore"] = "WITH u AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, dim, round(greatest(-5, least(5, (x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-5))), 5) AS x FROM u WINDOW w AS (PARTITION BY vec_id)"
QUERIES["emb9_soft_cosine"] = lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(v.cosine_soft(F.slice(v.doubles(F.col("embedding")), 1, 32), F.slice(v.doubles(F.col("embedding")), 33, 32)), 6).alias("sim"))
SQL["emb9_soft_cosine"] = "WITH e AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings) SELECT vec_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) + 1e-9), 6) AS sim FROM e"

#: A small fixed basis: differences and sums of neighbouring positions.
BASIS = {"mean": [0.0] * 64, "components": [[1.0 if i == 2 * k else (-1.0) ** k if i == 2 * k + 1 else 0.0 for i in range(64)] for k in range(4)], "variance": [1.0, 4.0, 0.25, 1.0], "whiten": True}
QUERIES["emb3_transform_fused"] = lambda s, d: table(s, d, "embeddings").select("vec_id", F.posexplode(fusion.fuse(F.col("embedding"), F.slice("embedding", 9, 6), BASIS)).alias("dim", "x")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("x", 5).alias("x"))
SQL["emb3_transform_fused"] = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), b AS (SELECT vec_id, [v[1] + v[2], (v[3] - v[4]) / 2, (v[5] + v[6]) / 0.5, v[7] - v[8]] AS a, v[9:14] AS f FROM e),
c AS (SELECT vec_id, list_concat(list_transform(a, lambda x: x / (sqrt(list_dot_product(a, a)) + 1e-8) * sqrt(0.35)), list_transform(f, lambda x: x / (sqrt(list_dot_product(f, f)) + 1e-8) * sqrt(0.65))) AS j FROM b)
SELECT vec_id, unnest(range(len(j))) AS dim, round(unnest(list_transform(j, lambda x: x / (sqrt(list_dot_product(j, j)) + 1e-8))), 5) AS x FROM c"""


def pca(spark, sf):
    """Pairwise-independent view of a fitted basis: whitened coordinates have variance 1."""
    e = table(spark, sf, "embeddings")
    basis = fusion.fit_pca(e, "embedding", components=8)
    c = e.select(F.posexplode(fusion.project(F.col("embedding"), basis)).alias("component", "x"))
    return c.groupBy("component").agg(F.round(F.abs(F.avg("x")), 6).alias("mean"), F.round(F.var_samp("x"), 6).alias("variance"))


QUERIES["agg29_pca"] = pca


def fused(spark, sf):
    p = bind(spark, sf, PATTERNS).withColumn("z", F.slice("vec", 1, 30)).withColumn("kronos", F.slice("vec", 31, 34))
    out, _ = fusion.build_fused(p, F.lit("2025-01-01").cast("date"), components=16)
    return out.select("id", F.size("fused").alias("dims"), F.round(v.norm(F.col("fused")), 6).alias("norm"))


QUERIES["emb4_build_fused"] = fused


def bootstrap(spark, sf):
    # an ablation asks an evenly spaced sample of 100 queries
    rows = stats.evenly_spaced(cards(spark, sf).select("query_id", "true_S_rate", "support_diversity"), 100, "query_id").collect()
    arms = {a: stats.bca([r[c] for r in rows]) for a, c in (("true_S", "true_S_rate"), ("diversity", "support_diversity"))}
    found = stats.compare_arms(arms)
    return spark.createDataFrame([(a, x["point"], x["lower"], x["upper"], x["n"], found["champion"] == a) for a, x in arms.items()], "arm string, point double, lower double, upper double, n long, champion boolean")


QUERIES["agg16_bca_bootstrap"] = bootstrap
