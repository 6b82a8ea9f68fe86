"""The stages of the corpus pipeline: documents in, documents out (pieces at the end)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cube, digest_index, fertility, near_dup, packing
from .common import Scratch, few


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go."""
    return fertility.filter_docs(docs, fertility.default_vocabulary(), Scratch(spark, "stage_quality"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    index = digest_index.DigestIndex.fresh(spark).load(docs)
    kept = digest_index.keep_first(docs, index, Scratch(spark, "stage_exact"))
    index.drop()  # its repeated digests are written by now
    return kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (5-word shingles, similarity 0.8).

    A document is a doc_id with a text, so of rows that share a doc_id each text is judged by itself.
    """
    found = near_dup.groups(docs, Scratch(spark, "stage_near_dup"), shingle=5, percent=80)
    gone = few(found.filter("not kept").select("doc_id", "text_hash").distinct())
    same = docs["doc_id"].eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["text_hash"])
    return docs.join(gone, same, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Rows equal in doc_id, source and text are one: it is returned as often as all of them are taken.
    """
    scratch = Scratch(spark, "stage_mix")
    taken = cube.mix(docs, scratch).groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).filter("copies > 0")
    # one row for each document taken: it grows as the documents do, so it is never broadcast
    taken = scratch.result(taken).hint("merge")
    same = docs["doc_id"].eqNullSafe(taken["doc_id"]) & docs["source"].eqNullSafe(taken["source"]) & (F.xxhash64(docs["text"]) == taken["text_hash"])
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    found = docs.join(taken, same).select(row, taken["copies"].alias("copies"), taken["rows"].alias("rows"), *[taken[c].alias(f"of_{c}") for c in ("doc_id", "source", "text_hash")])
    again = found.filter("rows > 1").dropDuplicates(["of_doc_id", "of_source", "of_text_hash"])
    found = found.filter("rows = 1").unionByName(again)
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return packing.pack(docs, packing.default_tokenizer())
