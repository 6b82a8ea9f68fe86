"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the normalised text (A-Z
lower-cased, null as empty).  A batch of new documents is reduced to one row per digest
(partial aggregation, so a group of copies of any size meets as one row per task) and
split by sort-merge anti-join and semi-join with the index (whose side is neither shuffled
nor sorted again): digests that are new are appended as entries, digests that are known as
changes of their counts.  Reading merges the rows of a digest, bucket by bucket, so the
kept doc_id is the largest of all batches and group_size counts them all.

Nulls: a null text counts as the empty text, a null doc_id loses against any other.
Empty tables give an empty index and no rows.  Rows that repeat a doc_id and its text are
one document: all its rows carry kept = true, and :func:`keep_first` returns one of them.
Columns other than the id and the text are not looked at, so they may have any name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, few


#: A group of copies is hot if it has more than HOT_ROWS rows and more than 1 / HOT_GROUPS of all rows.
HOT_ROWS, HOT_GROUPS = 1_000, 1_000


def digest(text="text"):
    return F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256)


#: Batches in which :meth:`DigestIndex.load` brings a table into an index.
BATCHES = 2


class DigestIndex:
    """A table of (digest, keep_id, group_size, entry, batch), bucketed and sorted by digest.

    ``entry`` marks the row that first brought a digest; later batches add rows that only
    change it.  A batch is appended in one job, and one that the index has is not added again.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64):
        self.spark, self.table, self.buckets = spark, table, buckets

    @classmethod
    def fresh(cls, spark: SparkSession, buckets: int = 64) -> DigestIndex:
        return cls(spark, f"digest_index_{uuid.uuid4().hex}", buckets)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def rows(self) -> DataFrame:
        """(digest, keep_id, group_size), one row per digest; no shuffle, as the table is bucketed."""
        return self.spark.table(self.table).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table} PURGE")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> None:
        """Adds a batch; ``batch`` is its name, drawn if not given."""
        found = (
            docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("digest"))
            .groupBy("digest")
            .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        )
        if self.exists():
            index = self.spark.table(self.table)
            if batch is not None and not index.filter(F.col("batch") == batch).isEmpty():
                return
            known = index.filter("entry").select("digest").hint("merge")
            new = found.join(known, "digest", "left_anti").withColumn("entry", F.lit(True))
            found = new.unionByName(found.join(known, "digest", "left_semi").withColumn("entry", F.lit(False)))
        else:
            found = found.withColumn("entry", F.lit(True))
        found = found.withColumn("batch", F.lit(batch or uuid.uuid4().hex)).repartition(self.buckets, "digest")
        found.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def load(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DigestIndex:
        """Adds a table in batches by a hash of the id, each deduplicated against those before."""
        part = F.pmod(F.xxhash64(F.col(id_col), F.lit(10)), F.lit(batches))
        for k in range(batches):
            self.add(docs.filter(part == k), id_col, text_col)
        return self

    def look_up(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Each document with its keep_id, group_size and whether it is the row that stays."""
        d = docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("digest"))
        # a group with over a thousandth of all rows would be one long task of the merge
        # join; there are under a thousand such groups, so they are broadcast
        rows = self.rows()
        total = rows.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
        large = F.col("group_size") > max(HOT_ROWS, total // HOT_GROUPS)
        hot = F.broadcast(rows.filter(large))
        found = d.join(hot, "digest").unionByName(d.join(hot.select("digest"), "digest", "left_anti").join(rows.filter(~large), "digest"))
        return found.select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
        )


def keep_first(docs: DataFrame, index: DigestIndex, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Only digests of two rows or more matter: they are broadcast if they are few (else both
    sides are shuffled), and of the rows only those that stay for such a digest are dealt
    by it, to leave one of repeated rows.
    """
    many = scratch.write(index.rows().filter("group_size > 1").select("digest", "keep_id"), "many")
    shape = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), digest(text_col).alias("digest"), docs[id_col].alias("id"))
    found = shape.join(few(many.withColumn("copied", F.lit(True))), "digest", "left")
    alone = found.filter("copied is null").select("row.*")
    return alone.unionByName(found.filter("copied and id <=> keep_id").dropDuplicates(["digest"]).select("row.*"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex.fresh(spark).load(docs)
    out = Scratch(spark, "exact_dedup").result(index.look_up(docs))
    index.drop()
    return out


OP10_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents
), g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g ON d.h = g.h
"""
