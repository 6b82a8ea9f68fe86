"""Exact Jaccard join in a metric space, and the components of its links.

The Jaccard distance (1 - intersection / union) of shingle sets obeys the triangle
inequality.  Links are pairs within EPS = 1 - percent / 100.

1. *Far documents.*  Two sets chosen at random are almost 1 apart and almost 1 from every
   pivot, so no triangle tells them apart; they are parted exactly beforehand.  Shingles
   fall into slices by their hash.  Linked sets differ in at most
   d = size * (100 - percent) / percent shingles, so of d + 1 + SPARE slices they agree in
   SPARE + 1 whole ones, and in one that is not empty unless both have more than SPARE empty
   ones (these then count as well).  The number of slices follows the size in steps of 1.5,
   and a set near the upper end of a step's partners is in both.  Documents that share a
   slice are a region; all other pairs cannot be linked.
2. *First pivots.*  The least member of a region is its pivot.  A document goes to the pivot
   that it shares most slices with; the distance to it is computed on full sets.  Components
   of the links found, and only regions with members of several components go on.
3. *Profiles.*  A profile counts a set's shingles by bin.  Profiles of linked sets differ by d
   at most, summed over bins, as each shingle that only one has changes one count by one: a
   coarser metric that bounds the sets' own from below, at a 32nd of their bytes.  Members of
   a region that it does not part form the groups whose full sets are compared.
4. *Voronoi regions.*  A group of more than LEAF members gets PIVOTS pivots, drawn by hash.
   Distances of all members to them are exact.  A member lives in the cell of its nearest
   pivot p, and is replicated to that of any pivot q with d(x, q) <= d(x, p) + 2 EPS: for a
   partner y that lives there d(x, q) <= d(y, q) + EPS <= d(y, p) + EPS <= d(x, p) + 2 EPS.
   Members within EPS of a pivot are linked to it at once.  Cells are split again, up to
   DEPTH times, while they shrink below SHRINK of their region and mix components.
5. *Leaves.*  Pairs of a cell are compared exactly if one of them lives there, their
   components differ, their sizes allow it, and their distances to the cell's pivot differ
   by EPS at most (triangle inequality).  A cell is dealt to tasks in pairs of blocks, so no
   task holds more than two blocks, and a search returns a spanning forest of its links,
   never all pairs.

Equal sets are one node from the start, and cells only ever leave out pairs that cannot be
linked or are connected already, so all components are exact, at any size and skew.  A dense
cell, with more members than a block that are within 2 EPS of each other but not linked
through its pivots, is compared pair by pair in its blocks: that work grows with its square.

Nulls, empty or blank texts have an empty set and are linked with nothing; fewer words than
a shingle make one shingle.  Rows of null doc_id link like any other but are never the
least; a component of such rows alone has a null component_id.  Rows that repeat a doc_id
with another text are nodes of their own.  An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunked, few, read, ship, trim
from .near_dup import M1, M3, PAIRS, TILE, Shingler, _by_group, _confirmed, _full_sets, _in_blocks, _join_labels, _mixed, _shared, components, mix

#: Empty slices that a set may leave out, and the steps of sizes that have the same number of slices.
SPARE, STEP = 2, 1.5
#: Pivots of a region, members from which it is split, how often, and what part of it a cell may keep to be split again.
PIVOTS, LEAF, DEPTH, SHRINK = 16, 512, 4, 0.75
#: Members of a region that one task takes to its pivots; least and most members of a block, and bytes of sets in one.
DEAL, LEAST_BLOCK, MOST_BLOCK, BLOCK_BYTES = 2048, 128, 4096, 32 << 20
#: Rounding of distances as doubles; windows are wider by it.
TINY = 1e-9
#: Least number of bins of a profile, and shingles of a bin; the number is a power of two.
LEAST_BINS, BIN = 64, 4
SLICED = "doc_id long, text_hash long, n_shingles long, set_id binary, node long, other long, keys array<long>, profile binary"


def steps(percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First sizes of the steps up to a size, and the number of slices of each (0: such sets link to equal ones only)."""
    first = [1]
    while first[-1] <= most:
        first.append(max(first[-1] + 1, int(np.ceil(first[-1] * max(STEP, 120 / percent)))))
    first = np.array(first)
    differ = (first[1:] - 1) * (100 - percent) // percent
    return first, np.where(differ > 0, differ + 1 + SPARE, 0)


def slice_keys(x: np.ndarray, level: int, slices: int) -> np.ndarray:
    """A key for every slice of a sorted set: its number with a hash of its shingles."""
    at = ((x >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    number, content = at[begin], np.add.reduceat(mix(x), begin)
    if slices - len(number) > SPARE:
        missing = np.setdiff1d(np.arange(slices), number)
        number, content = np.concatenate((number, missing)), np.concatenate((content, np.zeros(len(missing), np.uint64)))
    return mix(mix(content * M1 + number.astype(np.uint64)) + np.array([level + 1], np.uint64) * M3).view(np.int64)


def keys_of(x: np.ndarray, first: np.ndarray, slices: np.ndarray, percent: int) -> np.ndarray:
    """Keys at the step of the set's size, and at the one below if a partner may stand there."""
    level = int(np.searchsorted(first, len(x), "right")) - 1
    levels = [level, level - 1] if level and percent * len(x) <= 100 * (first[level] - 1) else [level]
    found = [slice_keys(x, k, int(slices[k])) for k in levels if slices[k]]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def profile(x: np.ndarray) -> bytes:
    """Shingles by bin, up to 255; the number of bins follows the size."""
    bins = max(LEAST_BINS, 1 << (max(1, len(x) // BIN) - 1).bit_length())
    at = (x >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=bins), 255).astype(np.uint8).tobytes()


def _slice(size: int, percent: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        shingler = Shingler(size)
        first, slices = steps(percent, 1 << 20)
        for part, texts in chunked(batches, 1):
            sets = shingler.sets(texts)
            lens = np.fromiter(map(len, sets), np.int64, len(sets))
            if len(sets) and lens.max() >= first[-1]:
                first, slices = steps(percent, int(lens.max()))
            keys = [keys_of(x, first, slices, percent) if len(x) else np.zeros(0, np.int64) for x in sets]
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            numbers = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            names = pa.array([x if n else None for x, n in zip(digests, lens, strict=True)], pa.binary())
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            profiles = pa.array([profile(x) if len(x) else None for x in sets], pa.binary())
            columns = [part.column(0), part.column(2), pa.array(lens), names, pa.array(numbers[:, 0]), pa.array(numbers[:, 1]), listed, profiles]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SLICED.split(", ")])

    return run


BUCKET = "key long, node long, centre long"


def _shared_keys(batches) -> Iterator:
    """Rows of (key, node), sorted, to those of keys with several rows, each with the least node of its key.

    Of a key that goes on in the next batch only its first row and its number so far are kept.
    """
    import pyarrow as pa

    # the last key, its least node, and whether its only row so far has yet to be given
    of, least, held = None, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = (np.asarray(batch.column(i), np.int64) for i in range(2))
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        counts = np.diff(np.append(begin, len(key)))
        centres, several = node[begin].copy(), counts > 1
        out = [np.zeros((3, 0), np.int64)]
        if of is not None and key[0] == of:
            centres[0], several[0] = least, True
            if held:
                out.append(np.array([[of], [least], [least]], np.int64))
        take = np.repeat(several, counts)
        out.append(np.stack((key[take], node[take], np.repeat(centres, counts)[take])))
        of, least, held = int(key[-1]), int(centres[-1]), not several[-1]
        found = np.concatenate(out, 1)
        if found.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["key", "node", "centre"])


def near_bytes(distance: np.ndarray, home: np.ndarray) -> list[bytes]:
    """The distance to the cell's pivot and whether the member lives there, before its shingles: 16 bytes."""
    both = np.stack((np.asarray(distance, float), np.asarray(home, float)), 1)
    return [row.tobytes() for row in both]


#: Of members that no pivot has dealt: all live in their region, at the same distance.
UNDEALT = near_bytes(np.zeros(1), np.ones(1))[0]


def _possible(g: dict, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of different components whose sizes and profiles allow a link.

    A pair is compared at half the bins of the larger set, which the smaller one has as well.
    """
    comp, n, side = g["comp"], g["n"], g["side"]
    own = [np.frombuffer(x, np.uint8).astype(np.int16) for x in g["profile"]]
    bins = np.array([len(x) for x in own])
    right, label, out = np.flatnonzero(side != 0), np.arange(len(comp)), []
    differ = n * (100 - percent) // percent
    folded: dict[int, np.ndarray] = {}
    for i in np.flatnonzero(side != 1).tolist():
        at = right[(label[right] != label[i]) & (comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
        for size in np.unique(np.maximum(bins[at], bins[i]) // 2).tolist():
            if size not in folded:
                folded[size] = np.zeros((len(own), size), np.int16)
                for j in np.flatnonzero(bins >= size).tolist():
                    folded[size][j] = own[j].reshape(size, -1).sum(1)
            m, these = folded[size], at[np.maximum(bins[at], bins[i]) // 2 == size]
            these = these[label[these] != label[i]]
            near = these[np.abs(m[these] - m[i]).sum(1, dtype=np.int64) <= np.minimum(differ[these], differ[i])]
            if len(near):
                out += [(i, j) for j in _join_labels(label, i, near).tolist()]
    return out


def _leaf(g: dict, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between different components of a cell (or a pair of its blocks)."""
    eps, side, label = 1 - percent / 100, g["side"], g["comp"].copy()
    head = np.array([np.frombuffer(x[:16], float) for x in g["hashes"]])
    dist, home = head[:, 0], head[:, 1] > 0
    sets = [np.frombuffer(x, np.uint64, offset=16) for x in g["hashes"]]
    n = np.array([len(x) for x in sets])
    order = np.argsort(dist, kind="stable")  # so that tiles are windows of distance
    left, right = order[side[order] != 1], order[side[order] != 0]
    out = []
    for a in range(0, len(left), TILE):
        rows = left[a : a + TILE]
        near = right[(dist[right] >= dist[rows[0]] - eps - TINY) & (dist[right] <= dist[rows[-1]] + eps + TINY)]
        for b in range(0, len(near), TILE):
            cols = near[b : b + TILE]
            open_ = (label[rows][:, None] != label[cols][None, :]) & (home[rows][:, None] | home[cols][None, :])
            open_ &= np.abs(dist[rows][:, None] - dist[cols][None, :]) <= eps + TINY
            open_ &= 100 * np.minimum(n[rows][:, None], n[cols][None, :]) >= percent * np.maximum(n[rows][:, None], n[cols][None, :])
            r, c = rows[open_.any(1)], cols[open_.any(0)]
            if not len(r):
                continue
            both = _shared([sets[i] for i in r], [sets[j] for j in c])
            holds = 100 * both >= percent * (n[r][:, None] + n[c][None, :] - both)
            for i, ok in zip(r.tolist(), holds, strict=True):
                linked = c[ok & (label[c] != label[i])]
                if len(linked):
                    out += [(i, j) for j in _join_labels(label, i, linked).tolist()]
    return out


DEALT = "key long, parent long, node long, comp long, near binary, a long, b long"


def _to_pivots(percent: int, salt: int):
    """Rows of (key, deal, member, node, comp, hashes), pivots first: to cells and links to pivots."""
    eps = 1 - percent / 100

    def cells(key, pivots, batch):
        import pyarrow as pa

        members = [np.frombuffer(x, np.uint64) for x in batch["hashes"]]
        names, sets = pivots
        node = np.array(batch["node"], np.int64)
        n, m = np.array([len(x) for x in members]), np.array([len(x) for x in sets])
        both = _shared(members, sets).astype(np.int64)
        union = n[:, None] + m[None, :] - both
        d = 1 - both / union
        own = d.argmin(1)
        row, cell = np.nonzero(d <= d[np.arange(len(d)), own][:, None] + 2 * eps + TINY)
        # cells are numbered by their pivots
        number = mix(np.array(names, np.int64).view(np.uint64) * M3 + np.array([salt + 1], np.uint64) + np.array([key], np.int64).view(np.uint64) * M1).view(np.int64)
        i, p = np.nonzero((100 * both >= percent * union) & (node[:, None] != np.array(names)[None, :]))
        rows, links = len(row), len(i)
        none = pa.nulls(links, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(number[cell]), none]), pa.concat_arrays([pa.array(np.full(rows, key, np.int64)), none]),
                pa.concat_arrays([pa.array(node[row]), none]), pa.concat_arrays([pa.array(np.array(batch["comp"], np.int64)[row]), none]),
                pa.concat_arrays([pa.array(near_bytes(d[row, cell], own[row] == cell), pa.binary()), pa.nulls(links, pa.binary())]),
                pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(np.minimum(node[i], np.array(names)[p]))]),
                pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(np.maximum(node[i], np.array(names)[p]))]),
            ],
            names=[c.split()[0] for c in DEALT.split(", ")],
        )

    def run(batches) -> Iterator:
        of, pivots = None, ([], [])
        for batch in batches:
            for start in range(0, batch.num_rows, TILE):
                b = batch.slice(start, TILE).to_pydict()
                marks = list(zip(b["key"], b["deal"], b["member"], strict=True))
                cut = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
                for i, j in zip(cut[:-1], cut[1:], strict=True):
                    if marks[i][:2] != of:
                        of, pivots = marks[i][:2], ([], [])
                    if marks[i][2]:
                        yield cells(of[0], pivots, {k: v[i:j] for k, v in b.items()})
                    else:
                        pivots[0].extend(b["node"][i:j])
                        pivots[1].extend(np.frombuffer(x, np.uint64) for x in b["hashes"][i:j])
        trim()

    return run


def split(rows: DataFrame, sets: DataFrame, scratch: Scratch, percent: int, number: int) -> DataFrame:
    """Deals regions (key, node, comp, k) to the cells of their pivots; returns rows of DEALT.

    Members are dealt to tasks DEAL at a time, each with the few pivots of its region.
    """
    mark = F.xxhash64("node", "key", F.lit(number))
    drawn = rows.groupBy("key", F.pmod(F.xxhash64("node", F.lit(number)), F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct(mark.alias("h"), "node", "comp")).alias("p"), F.first("k").alias("k"))
    deals = F.ceil(F.col("k") / DEAL).cast("int")
    pivots = drawn.select("key", F.col("p.node").alias("node"), F.col("p.comp").alias("comp"), F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"), F.lit(0).alias("member"))
    members = rows.select("key", "node", "comp", F.pmod(F.xxhash64("node"), deals).alias("deal"), F.lit(1).alias("member"))
    asked = pivots.unionByName(members).join(sets.select("node", "hashes"), "node").select("key", "deal", "member", "node", "comp", "hashes")
    asked = asked.repartition("key", "deal").sortWithinPartitions("key", "deal", "member", "node")
    return scratch.write(asked.mapInArrow(_to_pivots(percent, number), DEALT), f"cells{number}")


def _relabelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows with the components that later links have made of theirs."""
    later = few(comps.select(F.col("node").alias("comp"), F.col("comp").alias("into")))
    return rows.join(later, "comp", "left").withColumn("comp", F.coalesce("into", "comp")).drop("into")


def _regions(rows: DataFrame) -> DataFrame:
    """Rows of (key, node, comp, near) with k, main and n_main; regions of one component are left out."""
    return rows.join(few(_mixed(rows).drop("h")), "key")


def residual(docs: DataFrame, buckets: DataFrame, nodes: DataFrame, comps: DataFrame, scratch: Scratch, shingle: int, percent: int) -> DataFrame:
    """Links between different components that share a region, as a forest (a, b)."""
    by_size = F.least(F.greatest(F.ceil(F.col("k") / 4), F.lit(LEAST_BLOCK)), F.lit(MOST_BLOCK))
    placed = buckets.select("key", "node").join(few(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = scratch.write(placed, "placed")
    # of regions with the same members one goes on
    mixed = _mixed(placed).groupBy("k", "h").agg(F.min(F.struct("key", "main", "n_main")).alias("one")).select("one.*", "k")
    rows = placed.join(few(scratch.write(mixed, "mixed")), "key").join(nodes.select("node", F.col("n_shingles").alias("n"), "profile"), "node")
    possible = scratch.write(_in_blocks(rows, by_size, "profile").mapInArrow(_by_group(_possible, percent, "profile"), PAIRS).distinct(), "possible")
    scratch.drop("placed", "buckets")
    groups = components(possible, scratch, "possible_groups")
    groups = groups.unionByName(groups.select(F.col("comp").alias("node"), "comp").distinct()).select("node", F.xxhash64("comp").alias("key"))
    rows = groups.join(few(comps), "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"), F.lit(UNDEALT).alias("near"))
    rows = scratch.write(_regions(rows), "regions0")
    sets = _full_sets(docs, rows.select("node"), nodes, scratch, "regions", shingle).withColumn("bytes", F.octet_length("hashes").cast("long"))
    leaves, links, n = [rows.filter(F.col("k") <= LEAF)], [], 0
    rows = rows.filter(F.col("k") > LEAF)
    while n < DEPTH and not rows.isEmpty():
        dealt = split(rows.select("key", "node", "comp", "k"), sets, scratch, percent, n)
        found = dealt.filter("a is not null").select("a", "b").distinct()
        links.append(found)
        # links of nodes are links of their components as well
        by_node = few(rows.select("node", "comp").distinct())
        ends = found.join(by_node.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(by_node.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
        joined = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch, f"cells{n}_")
        n += 1
        before = rows.select(F.col("key").alias("parent"), F.col("k").alias("parent_k")).distinct()
        cells = _relabelled(dealt.filter("a is null").select("key", "parent", "node", "comp", "near"), joined)
        cells = scratch.write(_regions(cells).join(few(before), "parent"), f"regions{n}")
        again = (F.col("k") > LEAF) & (F.col("k") <= SHRINK * F.col("parent_k")) & F.lit(n < DEPTH)
        columns = [F.col(c) for c in ("key", "node", "comp", "near", "k", "main", "n_main")]
        leaves.append(cells.filter(~again).select(*columns))
        rows = cells.filter(again).select(*columns)
    all_leaves = leaves[0].select("key", "node", "comp", "near", "k", "main", "n_main")
    for more in leaves[1:]:
        all_leaves = all_leaves.unionByName(more)
    all_leaves = all_leaves.join(sets, "node")
    size = few(scratch.write(all_leaves.groupBy("key").agg(F.sum("bytes").alias("region_bytes")), "sizes"))
    all_leaves = all_leaves.join(size, "key").withColumn("n", F.col("bytes")).withColumn("hashes", F.concat("near", "hashes"))
    by_bytes = F.greatest(F.floor(F.col("k") * F.lit(BLOCK_BYTES) / F.col("region_bytes")), F.lit(1))
    last = scratch.write(_in_blocks(all_leaves, F.least(by_size, by_bytes), "hashes").mapInArrow(_by_group(_leaf, percent, "hashes"), PAIRS).distinct(), "leaf_links")
    for found in links:
        last = last.unionByName(found)
    return last


def join(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    if not 70 <= percent < 100:
        raise ValueError("percent must be from 70 to 99")
    ship(df.sparkSession)
    d = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    sliced = scratch.write(d.mapInArrow(_slice(shingle, percent), SLICED), "sliced")
    filled = sliced.filter("set_id is not null")
    copies = filled.groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).filter("rows > 1").select("set_id", "least")
    copies = few(scratch.write(copies, "copies"))
    columns = ["set_id", "node", "other", "doc_id", "text_hash", "n_shingles", "keys", "profile"]
    first = filled.join(copies, "set_id").filter("doc_id <=> least").dropDuplicates(["set_id"]).select(*columns)
    numbered = scratch.write(filled.join(copies, "set_id", "left_anti").select(*columns).unionByName(first), "numbered")
    # keys are the bulk of both tables: what stays of them is written without
    rows = scratch.write(sliced.select("doc_id", "n_shingles", "set_id"), "rows")
    scratch.drop("sliced")
    clash = few(scratch.write(numbered.groupBy("node").agg(F.count("*").alias("sets")).filter("sets > 1").select(F.col("node").alias("clash")), "clash"))
    if not clash.isEmpty():
        numbered = numbered.join(clash, numbered["node"] == clash["clash"], "left").withColumn("node", F.when(F.col("clash").isNull(), F.col("node")).otherwise(F.col("other"))).drop("clash")
    members = numbered.select(F.explode("keys").alias("key"), "node")
    # one shuffle of the keys, and no second one to meet those that are shared; a task goes through the rows of a key as they come
    buckets = scratch.write(members.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared_keys, BUCKET), "buckets")
    nodes = scratch.write(numbered.drop("keys"), "nodes")
    scratch.drop("numbered")
    stars = buckets.filter("node != centre").groupBy("node", "centre").agg((-F.count("*")).alias("k"))
    stars = scratch.write(stars.groupBy("node").agg(F.min(F.struct("k", "centre")).alias("most")).select(F.col("most.centre").alias("a"), F.col("node").alias("b")), "stars")
    edges = _confirmed(d, stars, nodes, scratch, shingle, percent)
    comps = components(edges, scratch, "first")
    more = residual(d, buckets, nodes, comps, scratch, shingle, percent)
    if not more.isEmpty():
        comps = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more), scratch, "second")
    comps = comps.unionByName(comps.select(F.col("comp").alias("node"), "comp").distinct())
    named = scratch.write(few(comps).join(nodes.select("node", "set_id", "doc_id"), "node").select("set_id", "comp", "doc_id"), "named")
    least = few(scratch.write(named.groupBy("comp").agg(F.min("doc_id").alias("component")), "least"))
    labels = few(scratch.write(named.join(least, "comp").select("set_id", "component"), "labels"))
    out = rows.join(copies, "set_id", "left").join(labels, "set_id", "left")
    return scratch.result(out.select("doc_id", "n_shingles", F.coalesce("component", "least", "doc_id").alias("component_id")))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"), Scratch(spark, "metric_join"))
