"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is f times its size takes each of its documents floor(f) times and
once more with probability f - floor(f).  Which documents get the extra copy is settled by
the cube method: the vector of probabilities moves inside the null-space of two
constraints (number of documents, number of words) until all but at most two entries are
0 or 1 (the flight), so both totals are kept exactly.  Every step goes one way or the
other with chances that keep each probability on average, so a document gets its extra
copy with just the probability it began with.  Blocks of a source fly in parallel;
what they leave open (two documents each at most) flies again in blocks of a higher
level, until one block per source is left, where the last two documents land (see
:func:`land`).  Blocks, orders and draws come from hashes of the documents, so reruns agree
whatever the partitioning.

Null source: its own source, last in the order.  Null text: size 0.  A source without
words has target 0, so its documents are taken 0 times.  Repeated rows are documents of
their own: equal ones are counted, numbered and hashed with their number, so that null ids
or repeated rows never fill one block.  Empty tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, Scratch, ship

#: Documents that fly in one block.
BLOCK = 2_000
#: A document is taken at most so often.
MOST = 3
#: Settled documents that a landing may turn over while the words are off by more than TOLERANCE.
TURNS, TOLERANCE = 8, 0.001


def word_count(text: Column) -> Column:
    """Number of words, without building them: places where a word begins."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def draws(order: np.ndarray, level: int) -> np.ndarray:
    """A uniform number in [0, 1) for each document on a level, from its hash."""
    x = order.astype(np.int64).view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def fly(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Flight phase: at most two entries of the result lie strictly between 0 and 1.

    Works on three open documents at a time: the vector orthogonal to (1, 1, 1) and their
    sizes is the only direction that keeps both totals.  The step goes along it until one
    of the three is settled, or against it, the sense drawn with chances in proportion to
    the opposite lengths, which keeps every entry's expectation.  Each step draws with the
    number of its newest document, which no other step uses.
    """
    p = p.astype(float).tolist()
    x = size.astype(float).tolist()
    eps = 1e-9
    open_: list[int] = []
    for i in range(len(p)):
        if not eps < p[i] < 1 - eps:
            p[i] = float(round(p[i]))
            continue
        open_.append(i)
        if len(open_) < 3:
            continue
        a, b, c = open_
        u = [x[c] - x[b], x[a] - x[c], x[b] - x[a]]
        if not any(u):
            u = [1.0, -1.0, 0.0]
        ahead = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(open_, u, strict=True) if v)
        behind = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(open_, u, strict=True) if v)
        step = ahead if draw[i] * (ahead + behind) < behind else -behind
        for k, v in zip(open_, u, strict=True):
            p[k] += step * v
        left = []
        for k in open_:
            if p[k] <= eps or p[k] >= 1 - eps:
                p[k] = float(round(p[k]))
            else:
                left.append(k)
        open_ = left
    return np.asarray(p)


def land(p: np.ndarray, size: np.ndarray, want: float) -> np.ndarray:
    """Landing phase: settles the at most two open documents the way that comes nearest to
    ``want`` words.  A long open document can leave the total off by its length, so a few
    settled documents are then turned over, each the one whose size is nearest to what is
    still missing, as long as that helps.
    """
    p = p.copy()
    at = np.flatnonzero((p > 0) & (p < 1))
    if not len(at):
        return p
    fixed = float((np.where((p > 0) & (p < 1), 0, p) * size).sum())
    best = min(range(1 << len(at)), key=lambda m: (abs(fixed + sum(size[k] for j, k in enumerate(at) if m >> j & 1) - want), m))
    for j, k in enumerate(at):
        p[k] = float(best >> j & 1)
    for _ in range(TURNS):
        off = float((p * size).sum()) - want
        can = np.flatnonzero(p == (1 if off > 0 else 0))
        if not len(can) or abs(off) <= TOLERANCE * want:
            break
        k = can[np.abs(size[can] - abs(off)).argmin()]
        if abs(abs(off) - size[k]) >= abs(off):
            break
        p[k] = 1 - p[k]
    return p


def _block(level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id", "size"], kind="stable")
        start = pdf["p"].to_numpy()
        p, size = pdf["p"].to_numpy(), pdf["size"].to_numpy()
        p = fly(p, size, draws(pdf["order"].to_numpy(), level))
        if bool(pdf["only"].iloc[0]):
            p = land(p, size, float((start * size).sum()))
        return pdf.assign(p=p)

    return run


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: (source, source_size, docs).  Adds weight, target and share = target / size.

    The reshare of what exceeds MOST times a size is water filling: with sources sorted by
    capacity over weight, the first k are full and the rest share by weight for the least
    k that leaves none above.  One row per source (about 100 bytes) goes through windows in one task,
    which sorts and spills like any other: meant for up to some ten million sources.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "utf-8"))
    s = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn("most", F.col("source_size").cast("double") * MOST)
    whole = Window.partitionBy()
    rank = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"words": F.sum("source_size").over(whole).cast("double"), "all_w": F.sum("weight").over(whole), "most_before": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "w_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    s = s.withColumn("rank", F.row_number().over(rank)).withColumn("level", (F.col("words") - F.col("most_before")) / (F.col("all_w") - F.col("w_before")))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("rank", "level"))).over(whole)["level"])
    s = s.withColumn("target", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))))
    return s.select("source", "source_size", "docs", "target", F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)).alias("share"))


def mix(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, text_hash, source_size, target, copies, taken) for every row."""
    spark = df.sparkSession
    ship(spark)
    d = df.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(text_col).alias("text_hash"),
    )
    d = d.groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").cast("int").alias("n"))
    d = d.withColumn("number", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
    d = d.withColumn("order", F.xxhash64("doc_id", "source", "text_hash", "number", F.lit(8))).drop("number")
    d = scratch.write(d, "sizes")
    t = targets(d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    t = t.withColumn("blocks", F.ceil(F.col("docs") / BLOCK)).drop("docs")
    t = scratch.write(t.coalesce(1), "targets").withColumnRenamed("source", "s")
    d = d.join(t, d["source"].eqNullSafe(t["s"])).drop("s")
    base = F.least(F.floor(F.col("share") + 1e-12), F.lit(MOST))
    d = d.withColumn("base", base.cast("int")).withColumn("p", F.greatest(F.col("share") - F.col("base"), F.lit(0.0)))
    d = d.withColumn("block", F.pmod(F.col("order"), F.col("blocks"))).withColumn("only", F.col("blocks") == 1)
    columns = ["doc_id", "source", "size", "text_hash", "source_size", "target", "base", "p", "order", "block", "blocks", "only"]
    d = d.select(*columns)
    done, level = [], 0
    while True:
        d = scratch.write(d.groupBy("source", "block").applyInPandas(_block(level), d.schema), f"level{level}")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(d.filter(~open_))
        d = d.filter(open_)
        if d.isEmpty():
            break
        level += 1
        counts = d.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).alias("nb")).withColumnRenamed("source", "s")
        d = d.join(counts, d["source"].eqNullSafe(counts["s"])).withColumn("blocks", F.col("nb")).withColumn("only", F.col("nb") == 1)
        d = d.withColumn("block", F.pmod(F.xxhash64("order", F.lit(level)), F.col("blocks"))).select(*columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("base") + F.col("p").cast("int")
    return out.select("doc_id", "source", "size", "text_hash", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "mix")
    return scratch.result(mix(docs, scratch).select("doc_id", "size", "source_size", "target", "taken"))


def expected_copies(size: int, target: float) -> tuple[int, float]:
    """floor and remainder of target / size, as used for each document of a source."""
    f = target / size if size else 0.0
    return math.floor(f + 1e-12), f - math.floor(f + 1e-12)
