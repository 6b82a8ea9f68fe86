"""Readers: snapshots, chats, transcripts, bars, ledgers and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import snapshot

CHAT = "timestamp string, symbol string, user_text string, agent_text string, human_action string, redacted boolean"


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file: (file, snapshot, doc)."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("snapshot"))
    return d.withColumn("doc", snapshot.parse(F.col("snapshot")))


def chats(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank ones are skipped, malformed ones give null fields."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", CHAT).alias("c")).select("c.*")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def bars(spark: SparkSession, path: str, symbols: list[str] | None = None, period: str | None = None) -> DataFrame:
    """Bars partitioned by period and symbol; both filters prune partitions."""
    d = spark.read.parquet(path)
    d = d.filter(F.col("period") == period) if period else d
    return d.filter(F.col("symbol").isin(symbols)) if symbols else d


def runs(spark: SparkSession, *paths: str) -> DataFrame:
    """Ledgers of many runs as one table.

    Paths that are not there, and files that vanish or cannot be read, are skipped; repeated paths count once.  No path at all raises.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = [(p, jvm.org.apache.hadoop.fs.Path(p)) for p in dict.fromkeys(paths)]
    paths = [p for p, x in at if x.getFileSystem(conf).exists(x)]
    if not paths:
        raise FileNotFoundError("none of the ledgers is there")
    reader = spark.read.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).option("mergeSchema", True)
    return reader.parquet(*paths).withColumn("source_db", F.input_file_name())


def pending(queue: DataFrame) -> DataFrame:
    """Queue rows that still wait: status pending, empty or null, oldest first."""
    return queue.filter(F.coalesce("status", F.lit("")).isin("", "pending")).orderBy("created_at", "id")


def fusion_inputs(patterns: DataFrame, a: str = "kronos", b: str = "z") -> DataFrame:
    return patterns.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).orderBy("pattern_id")


def targets(patterns: DataFrame, only_missing: bool = True, column: str = "kronos") -> DataFrame:
    d = patterns.filter(F.col(column).isNull()) if only_missing else patterns
    return d.orderBy("symbol", "as_of_date")


def stats(table: DataFrame, stats_id: str) -> DataFrame:
    return table.filter(F.col("stats_id") == stats_id)


def trade_idx(calendar: DataFrame, day) -> int:
    """Index of one day; KeyError if it is no trading day."""
    row = calendar.filter(F.col("trade_date") == F.lit(day).cast("date")).select("trade_idx").first()
    if row is None:
        raise KeyError(str(day))
    return row[0]


def existing(keys: DataFrame, patterns: DataFrame, on: list[str]) -> DataFrame:
    """Keys that the pattern table has."""
    return keys.join(patterns.select(*on), on, "left_semi")


def unseen(rows: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(seen.select(*on), on, "left_anti")


def mock_block() -> str:
    """A constant snapshot block of the contract's shape, for fixtures."""
    return '{"ls1_supercharged":{"spring":{"coiling":true,"launch":false,"breakout_60d":false},"three_push":{"pump_dump_vol_ratio":1.0}},"compression_setup":{"is_range_compressed":true,"is_bb_squeeze":false,"is_ready":false}}'


def pattern_key(symbol: Column, day: Column, period: Column) -> Column:
    return F.concat_ws("_", symbol, day.cast("string"), period)
