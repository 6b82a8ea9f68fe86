"""Hierarchical weighted hash tree.

A key descends region, rack and shard.  On each level every child draws
-ln(u) / weight with u from the MD5 of (seed, key, child), and the least draw wins, so a
child is chosen in proportion to its weight and a child's draw depends on nothing but
itself.  Changing weights below one node moves keys only into or out of that node.
A shard added by :func:`grow` is a subtree of its own below the root: no other weight
changes, so keys move only into it (the law ``key``).

Null keys draw as the text 'null'; a null text has 16 bytes of size and the checksum of
the empty text; equal rows fall into the same shard and get neighbouring slots.  An
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a shard that one task sorts to number them.
SLOT_ROWS = 500_000


@dataclass(frozen=True)
class Tree:
    """regions[i][j] is a rack: its shards as (number, weight)."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def uniform_tree(shards: int, rack: int = 4, racks: int = 2) -> Tree:
    """Shards of weight 1 dealt into racks of ``rack`` and regions of ``racks`` racks."""
    numbers = [(s, 1.0) for s in range(shards)]
    in_racks = [tuple(numbers[i : i + rack]) for i in range(0, shards, rack)]
    return Tree(tuple(tuple(in_racks[i : i + racks]) for i in range(0, len(in_racks), racks)))


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """One more shard, as a region of its own."""
    return Tree((*tree.regions, (((tree.shards, weight),),)))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _choose(seed: str, key: Column, prefix: Column, weights: Column) -> Column:
    """Index of the child with the least draw."""

    def draw(weight: Column, i: Column) -> Column:
        text = F.concat(F.lit(seed + "|"), key, F.lit("|"), prefix, F.lit("/"), i.cast("string"))
        bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
        return F.struct(F.try_divide(-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))), weight).alias("d"), i.alias("i"))

    return F.array_min(F.filter(F.transform(weights, draw), lambda x: x["d"].isNotNull()))["i"]


def place(df: DataFrame, key: Column, tree: Tree, name: str, seed: str = "larkspar") -> DataFrame:
    """Adds the column ``name``: the shard of each key.  Children of weight 0 get no key."""
    regions = tree.regions
    array = lambda xs: F.array(*xs)
    region_w = array([F.lit(float(sum(w for rack in r for _, w in rack))) for r in regions])
    rack_w = array([array([F.lit(float(sum(w for _, w in rack))) for rack in r]) for r in regions])
    shard_w = array([array([array([F.lit(float(w)) for _, w in rack]) for rack in r]) for r in regions])
    shard_n = array([array([array([F.lit(int(s)) for s, _ in rack]) for rack in r]) for r in regions])
    text = F.coalesce(key.cast("string"), F.lit("null"))

    def in_region(r: Column) -> Column:
        at = F.concat(F.lit("r/"), r.cast("string"))
        return _let(_choose(seed, text, at, F.get(rack_w, r)), lambda k: in_rack(r, k, F.concat(at, F.lit("/"), k.cast("string"))))

    def in_rack(r: Column, k: Column, at: Column) -> Column:
        leaf = _choose(seed, text, at, F.get(F.get(shard_w, r), k))
        return F.get(F.get(F.get(shard_n, r), k), leaf)

    return df.withColumn(name, _let(_choose(seed, text, F.lit("r"), region_w), in_region))


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40) -> DataFrame:
    """Every row's shard and its slot there.

    Slots are numbered in two steps: rows are dealt by hash into parts of a shard of about
    SLOT_ROWS rows, each part is sorted by a task of its own, and the parts' counts (a
    table of shards x parts rows) give each part its first slot.
    """
    tree = uniform_tree(shards)
    d = df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    d = place(d, F.col("doc_id"), tree, "shard")
    d = place(d, F.col("doc_id"), grow(tree), "grown_shard")
    parts = max(4, -(-df.count() // (shards * SLOT_ROWS)))
    d = d.withColumn("__part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(parts)).cast("int"))
    counts = d.groupBy("shard", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy("shard", "__part").orderBy("doc_id", "text_crc32", "size")
    numbered = d.withColumn("__at", F.row_number().over(within) - 1)
    return numbered.join(first, ["shard", "__part"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("__first") + F.col("__at")).cast("long").alias("slot"), "grown_shard"
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
