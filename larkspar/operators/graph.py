"""Pattern selection and the edges between selected patterns (a few dozen rows by contract)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as v

#: Archetypes in order, each with its keyword, cap per symbol and filter.
ARCHETYPES = [
    ("classic_true_S", "true_S_breakout", 3, "label_T10 = 'true_S' AND fwd_return_T10 > 15 AND mae_T10 > -5 AND v8_grade IN ('A','B+','B')"),
    ("classic_false_trap", "false_trap", 3, "label_T10 = 'false_trap' AND mae_T10 < -10 AND v8_grade IN ('A','B+','B')"),
    ("wyckoff_spring", "spring_launch", 2, "spring_launch = 1 AND label_T20 = 'true_S' AND mae_T5 > -8"),
    ("volume_climax_top", "volume_climax", 2, "label_T20 = 'stale_S' AND fwd_return_T20 < -5"),
    ("divergence_trap", "divergence_trap", 2, "chan_divergence_flag = 1 AND label_T10 = 'false_trap'"),
    ("high_confidence_bsp", "chan_bsp", 2, "chan_bsp_types IS NOT NULL AND v8_grade IN ('S','A') AND label_T10 = 'true_S'"),
]


def select(patterns: DataFrame, total: int = 50) -> DataFrame:
    """Six greedy passes with a cap per symbol that all passes share; ties go to the smaller id.

    Each pass reads at most 3 x ``total`` rows to the driver, as a pass depends on what the
    ones before it took; the table itself is only filtered and cut by top-k.
    """
    columns = patterns.columns
    taken, seen, per_symbol = [], set(), {}
    for name, keyword, cap, rule in ARCHETYPES:
        room = total - len(taken)
        if room <= 0:
            break
        for r in patterns.filter(F.expr(rule)).orderBy(F.desc("v8_score"), "pattern_id").limit(3 * room).collect():
            if r["pattern_id"] in seen or per_symbol.get(r["symbol"], 0) >= cap or len(taken) >= total:
                continue
            seen.add(r["pattern_id"])
            per_symbol[r["symbol"]] = per_symbol.get(r["symbol"], 0) + 1
            taken.append((*r, name, keyword, len(taken)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in patterns.schema.fields)
    return patterns.sparkSession.createDataFrame(taken, f"{kinds}, archetype string, keyword string, sel_rank int").select(*columns, "archetype", "keyword", "sel_rank")


def follows(patterns: DataFrame, gap: int = 5, most: int = 3) -> DataFrame:
    """Edges to the next patterns of the symbol within ``gap`` bars, at most ``most`` each.

    Patterns are joined by symbol and stretch of ``gap`` bars with those of the same stretch and
    the next one, so a symbol with very many patterns is never paired with itself.
    """
    stretch = F.floor(F.col("trade_idx") / gap)
    a = patterns.select("symbol", F.col("pattern_id").alias("source"), F.col("trade_idx").alias("i"), F.explode(F.array(stretch, stretch + 1)).alias("stretch"))
    b = patterns.select("symbol", F.col("pattern_id").alias("target"), F.col("trade_idx").alias("j"), stretch.alias("stretch"))
    pairs = a.join(b, ["symbol", "stretch"]).filter((F.col("j") > F.col("i")) & (F.col("j") <= F.col("i") + gap))
    w = Window.partitionBy("source").orderBy("j", "target")
    near = pairs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    return near.select("source", "target", F.lit("follows").alias("relation"), F.greatest(F.lit(0.0), 1.0 - (F.col("j") - F.col("i")) / F.lit(float(max(gap, 1)))).alias("weight"))


def recovered_from(patterns: DataFrame, label: str = "label_T10", within: int = 30) -> DataFrame:
    """Backward as-of: a true_S and the symbol's nearest earlier false_trap, if within ``within`` bars.

    One window per symbol; only the nearest trap is looked at.
    """
    w = Window.partitionBy("symbol").orderBy("trade_idx").rangeBetween(Window.unboundedPreceding, -1)
    trap = F.max(F.when(F.col(label) == "false_trap", F.struct("trade_idx", "pattern_id"))).over(w)
    d = patterns.withColumn("trap", trap).filter((F.col(label) == "true_S") & (F.col("trade_idx") - F.col("trap.trade_idx") <= within))
    return d.select(F.col("pattern_id").alias("source"), F.col("trap.pattern_id").alias("target"), F.lit("recovered_from").alias("relation"), F.lit(1.0).alias("weight"))


def similar_to(selected: DataFrame, vec: str, most: int = 3, least: float = 0.7) -> DataFrame:
    """Each selected pattern's most similar others; a selection is at most a few dozen rows, which is checked."""
    if selected.limit(1001).count() > 1000:
        raise ValueError("similar_to compares a selection; use recall.top_k for tables")
    a = selected.select(F.col("pattern_id").alias("source"), v.doubles(F.col(vec)).alias("x"))
    b = selected.select(F.col("pattern_id").alias("target"), v.doubles(F.col(vec)).alias("y"))
    pairs = a.join(F.broadcast(b), F.col("source") != F.col("target")).select("source", "target", v.cosine_floored(F.col("x"), F.col("y")).alias("weight"))
    w = Window.partitionBy("source").orderBy(F.desc("weight"), "target")
    return pairs.filter(F.col("weight") >= least).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).select("source", "target", F.lit("similar_to").alias("relation"), "weight")


def supports(selected: DataFrame, days: int = 90) -> DataFrame:
    """Pairs of one archetype, of different symbols, at most ``days`` apart, in order of selection."""
    c = ["pattern_id", "symbol", "as_of_date", "sel_rank"]
    a = selected.select("archetype", *[F.col(x).alias(f"a_{x}") for x in c])
    b = selected.select("archetype", *[F.col(x).alias(f"b_{x}") for x in c])
    apart = F.abs(F.datediff("a_as_of_date", "b_as_of_date"))
    pairs = a.join(b, "archetype").filter((F.col("a_sel_rank") < F.col("b_sel_rank")) & (F.col("a_symbol") != F.col("b_symbol")) & (apart <= days))
    return pairs.select(F.col("a_pattern_id").alias("source"), F.col("b_pattern_id").alias("target"), F.lit("supports").alias("relation"), F.greatest(F.lit(0.0), 1.0 - apart / F.lit(float(days))).alias("weight"))


def capped(edges: DataFrame, most: int = 2000) -> DataFrame:
    """The heaviest edges."""
    return edges.orderBy(F.desc("weight"), "source", "target", "relation").limit(most)


def links(edges: DataFrame) -> DataFrame:
    """Edges grouped into one row per source."""
    return edges.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("relation", "target", "weight"))).alias("links"))


def by_relation(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("n_edges"))


def gap_bars(q_idx, c_idx, q_day, c_day):
    """Bars between two rows; days where an index is missing; else NULL."""
    return F.coalesce(q_idx - c_idx, F.datediff(q_day, c_day))


def similarity_matrix(df: DataFrame, name: str, vec: str) -> DataFrame:
    """All pairs (a, b, sim) of a few named vectors; at most 1,000, which is checked."""
    if df.limit(1001).count() > 1000:
        raise ValueError("similarity_matrix compares a few named vectors; use recall.top_k for tables")
    a = df.select(F.col(name).alias("a"), v.doubles(F.col(vec)).alias("x"))
    return a.crossJoin(F.broadcast(a.select(F.col("a").alias("b"), F.col("x").alias("y")))).select("a", "b", v.cosine_soft(F.col("x"), F.col("y")).alias("sim"))


def divergence(day: DataFrame, minutes: DataFrame) -> DataFrame:
    """Difference of two similarity matrices."""
    return day.alias("d").join(minutes.alias("m"), ["a", "b"]).select("a", "b", (F.col("d.sim") - F.col("m.sim")).alias("divergence"))


def memory_text(p: DataFrame) -> DataFrame:
    """A few sentences per selected pattern: archetype, score, structure, spring and what followed."""
    pct = lambda c: F.format_string("%+.1f%%", F.col(c))
    or_else = lambda c, x: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(x)
    on = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    after = lambda h: F.concat(F.lit(f"{h}: "), F.coalesce(F.col(f"label_{h}"), F.lit("None")), F.lit(", fwd_return="), pct(f"fwd_return_{h}"), F.lit(", MAE="), pct(f"mae_{h}"), F.lit("."))
    text = F.concat_ws(
        " ",
        F.concat(F.lit("["), F.col("as_of_date").cast("string"), F.lit("] "), F.col("symbol"), F.lit(" "), F.col("name"), F.lit(": "), F.replace("archetype", F.lit("_"), F.lit(" ")), F.lit(" detected.")),
        F.concat(F.lit("V8="), F.col("v8_grade"), F.lit("("), F.format_string("%.0f", F.bround("v8_score")), F.lit("), Chan="), or_else("chan_trend_type", "?"), F.lit(" "), or_else("chan_bsp_side", ""), F.lit(" "), or_else("chan_bsp_types", ""), F.lit(".")),
        F.when(on("spring_coiling"), "Spring coiling active."), F.when(on("spring_launch"), "Spring launch confirmed."), after("T10"), after("T20"),
    )
    return p.select("pattern_id", text.alias("memory_text"))
