"""Writers.  Parquet has no MERGE, so an upsert writes a new version of the table and then
moves the pointer; readers see the old version or the new one, never a part.  All writers
do nothing but return the rows they would write unless ``dry_run`` is off.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose keys are not in the new ones, and the new ones."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def coalesced_update(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Old rows with the columns' new values; where a new value is null the old one stays."""
    n = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = old.join(n, keys, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


class Versioned:
    """A table as a folder of versions and a pointer to the current one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        p, fs = self._fs("current.json")
        return json.loads(self.spark.read.text(f"{self.root}/current.json").first()[0])["version"] if fs.exists(p) else None

    def read(self) -> DataFrame | None:
        v = self.current()
        return self.spark.read.parquet(f"{self.root}/{v}") if v else None

    def write(self, df: DataFrame, partition_by: tuple[str, ...] = (), dry_run: bool = True) -> DataFrame:
        if dry_run:
            return df
        v = uuid.uuid4().hex
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/{v}")
        p, fs = self._fs("current.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps({"version": v}).encode()))
        out.close()
        return self.spark.read.parquet(f"{self.root}/{v}")

    def upsert(self, new: DataFrame, keys: list[str], order: list[str], dry_run: bool = True) -> DataFrame:
        new = keep_last(new, keys, order)
        old = self.read()
        return self.write(upserted(old, new, keys) if old is not None else new, dry_run=dry_run)


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables under the union of their columns."""
    return old.unionByName(new, allowMissingColumns=True)


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row, nulls included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def journal(df: DataFrame, path: str, dry_run: bool = True) -> DataFrame:
    rows = to_json_rows(df)
    if not dry_run:
        rows.write.mode("append").text(path)
    return rows


def report(summary: dict) -> tuple[str, str]:
    """A small result as JSON and as Markdown."""
    lines = ["| key | value |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in summary.items()]]
    return json.dumps(summary, sort_keys=True, default=str), "\n".join(lines)


def ghost_trades(df: DataFrame) -> DataFrame:
    return df.withColumn("horizon", F.coalesce("horizon", F.lit(20))).withColumn("days", F.coalesce("days", F.lit(0)))


#: Fixed values of a promoted pattern: what its metadata carries along, and its source mark.
CARRIED, SOURCE_MARK = ("pattern_id", "archetype", "v8_grade", "v8_score", "label_T10", "fwd_return_T10", "mae_T10", "chan_trend_type", "chan_bsp_side"), "phase6_auto_promote"


def promotion(selected: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Payload of every selected pattern's memory: path, text, summary, keywords, entities and metadata with its links.

    selected: patterns with archetype and keyword; edges: source, target, relation, weight, and evidence if known.
    Links of a pattern are few, as edges are capped.  The raw chat is never part of it.
    """
    from ..operators import graph

    d = selected.join(graph.memory_text(selected), "pattern_id")
    if edges is not None:
        e = edges if "evidence" in edges.columns else edges.withColumn("evidence", F.lit(""))
        link = F.struct(F.col("target").alias("target_pattern_id"), "relation", F.round("weight", 4).alias("weight"), "evidence")
        d = d.join(e.groupBy(F.col("source").alias("pattern_id")).agg(F.sort_array(F.collect_list(link)).alias("links")), "pattern_id", "left")
    metadata = F.struct(*CARRIED, F.lit(SOURCE_MARK).alias("source"), *(["links"] if edges is not None else []))
    return d.select(
        "pattern_id", F.concat(F.lit("/trading/equity/patterns/"), "symbol", F.lit("/"), F.col("as_of_date").cast("string")).alias("path"), F.col("memory_text").alias("text"),
        F.replace("archetype", F.lit("_"), F.lit(" ")).alias("summary"), F.lit(0.85).alias("importance"), F.array(F.lit("pattern"), "keyword", F.coalesce(F.nullif("label_T10", F.lit("")), F.lit("unknown")), "symbol").alias("keywords"),
        F.array("symbol", F.coalesce(F.nullif("name", F.lit("")), "symbol")).alias("entities"), metadata.alias("metadata"),
    )


def lesson_document(lessons: DataFrame, symbol: str = "symbol") -> DataFrame:
    """The memory of a lesson (lesson_id, verdict_type, core_axiom, evidence): id, path, text and metadata."""
    text = F.concat(
        F.lit("# Atomic Lesson: "), "lesson_id", F.lit("\n\n**Symbol**: "), F.col(symbol), F.lit("\n**Verdict**: "), "verdict_type", F.lit("\n**Axiom**: "), "core_axiom", F.lit("\n**Evidence**: "), "evidence", F.lit("\n")
    )
    about = F.struct(F.col(symbol).alias("symbol"), F.col("verdict_type").alias("verdict"), "lesson_id", F.lit("decision_provenance_lesson").alias("type"))
    return lessons.select(F.concat(F.lit("provenance_lesson:"), "lesson_id").alias("id"), F.concat(F.lit("/trading/equity/lessons/decision_provenance/"), F.col(symbol)).alias("path"), text.alias("text"), about.alias("metadata"))


def operational(trades: DataFrame) -> DataFrame:
    """Trade memories: real portfolios with status ok only."""
    return trades.filter((F.col("portfolio") == "real") & (F.col("status") == "ok"))
