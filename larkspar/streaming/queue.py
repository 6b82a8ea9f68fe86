"""Memory queue as a stream: claim, push, acknowledge or retry, once per id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_RETRIES = 3


def settle(queue: DataFrame, results: DataFrame, most: int = MOST_RETRIES) -> DataFrame:
    """Queue rows after a push.  results: id, ok, error.  A failure counts a retry and ends as 'failed' at the limit."""
    j = queue.join(results.select("id", "ok", F.col("error").alias("__error")), "id", "left")
    tries = F.coalesce("retry_count", F.lit(0)) + F.when(F.col("ok") == F.lit(False), 1).otherwise(0)
    status = F.when(F.col("ok"), "synced").when(F.col("ok") == F.lit(False), F.when(tries >= most, "failed").otherwise("pending")).otherwise(F.col("status"))
    error = F.when(F.col("ok") == F.lit(False), F.substring("__error", 1, 1000)).when(F.col("ok"), F.lit(None)).otherwise(F.col("error") if "error" in queue.columns else F.lit(None))
    keep = [c for c in queue.columns if c not in ("status", "retry_count", "error")]
    return j.select(*keep, status.alias("status"), tries.alias("retry_count"), error.cast("string").alias("error"))


def drain(spark: SparkSession, source: str, schema: str, checkpoint: str, push: Callable[[DataFrame], None], available_now: bool = True, every: str = "60 seconds"):
    """Reads new queue files, drops ids seen before and pushes each batch; a replayed batch has the same rows."""

    def batch(df: DataFrame, _: int) -> None:
        push(df.filter(F.coalesce("status", F.lit("")).isin("", "pending")).dropDuplicates(["id"]))

    stream = spark.readStream.schema(schema).parquet(source).withWatermark("created_at", "1 day").dropDuplicatesWithinWatermark(["id"])
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
