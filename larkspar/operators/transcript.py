"""Transcripts to events and decision atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: a line's role, watched symbols, and reasons.
ROLE = r"(?i)^(user|assistant|human|agent|system)\s*:\s*(.+)$"
WATCH = r"(?i)(watch|观察|关注|跟踪|monitor)\s*[:：]?\s*(\d{6}\.(?:SH|SZ))"
REASON = r"(?i)(because|原因|理由|rationale|decided|决定)\s*[:：]?\s*(.+)"


def events(df: DataFrame, text: str, source: str, *keys: str) -> DataFrame:
    """(keys, line, source, role, text): one row per line that is not blank; no role is 'unknown'."""
    lines = df.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")).alias("line", "raw")).withColumn("raw", F.trim("raw")).filter("raw != ''")
    role = F.lower(F.regexp_extract("raw", ROLE, 1))
    return lines.select(*keys, "line", F.lit(source).alias("source"), F.when(role == "", "unknown").otherwise(role).alias("role"), F.when(role == "", F.col("raw")).otherwise(F.trim(F.regexp_extract("raw", ROLE, 2))).alias("text"))


def atoms(df: DataFrame, *keys: str) -> DataFrame:
    """Watch ideas (one per symbol named) and at most one rationale per event."""
    none = F.lit(None).cast("string")
    watch = F.transform(F.regexp_extract_all("text", F.lit(WATCH), F.lit(2)), lambda s: F.struct(F.lit("watch_idea").alias("atom_type"), F.upper(s).alias("symbol"), F.substring("text", 1, 500).alias("text")))
    reason = F.regexp_extract("text", REASON, 2)
    rationale = F.when(reason != "", F.array(F.struct(F.lit("decision_rationale").alias("atom_type"), none.alias("symbol"), F.substring(F.trim(reason), 1, 800).alias("text")))).otherwise(F.array().cast("array<struct<atom_type:string,symbol:string,text:string>>"))
    return df.select(*keys, "role", F.explode(F.concat(watch, rationale)).alias("a")).select(*keys, "role", "a.*")


def bind(df: DataFrame, pattern_id: Column, symbol: Column, as_of: Column) -> DataFrame:
    return df.withColumns({"pattern_id": pattern_id, "symbol": symbol, "as_of_date": F.substring(as_of.cast("string"), 1, 10)})
