"""Near-duplicate groups by one-permutation hashing.

1. Every document's distinct word shingles are hashed once (64 bits).  The hash picks one
   of BANDS x ROWS bins and each bin keeps its least hash; an empty bin borrows from the
   first filled bin in an order of its own (optimal densification: the orders are fixed
   random permutations, the same for all documents).  ROWS bins make one band key.
2. Documents with the same shingle set are one class; only one row of each (with its least
   doc_id) goes on, so exact copies never pair up.  A class is a node, numbered by eight
   bytes of its set's digest; sets whose numbers clash take eight others.
3. In each bucket every member points to the bucket's least member: a star, so a bucket
   of n members has n - 1 candidate edges.  Of its stars a member first keeps the one it
   meets most often.  Edges are confirmed on full shingle sets, then components follow by
   alternating large-star and small-star steps.
4. Buckets whose members are still in different components hold pairs that no star has
   tested.  Of buckets with the same members one goes on.  Its members are compared in
   blocks inside tasks (never as joined rows); members of its largest component are not
   dealt to each other.  Sizes and sketches rule out most pairs; documents that stay form
   candidate groups, whose pairs are compared on full sets, again in blocks.  Each search
   returns a spanning forest of stars.  So no cap on bucket sizes is needed, and no pair
   that shares a bucket is left out unless it is connected already.

Rows dealt in step 4: a block has a quarter of a bucket, within LEAST_BLOCK and MOST_BLOCK
members, so a member is dealt about four times in buckets of up to 4 x MOST_BLOCK members,
and once for every MOST_BLOCK members in larger ones that are not connected by stars.  The
comparisons themselves (in numpy, in the tasks) grow with the square of such a bucket.

A pair at the threshold of 85 % misses all 40 bands of 6 rows with a chance below 1e-8
(80 %: below 1e-5) if its sets fill most bins; small sets fill few and miss more often.
Sketches are compared only for sets of SKETCH_FROM shingles or more and rule a pair out at
MARGIN below the threshold, seven standard deviations away.

Null, empty or blank texts have an empty set and are linked with nothing; texts of fewer
words than a shingle are one shingle.  Rows with a null doc_id link like any other but are
never the least; a component of such rows alone has a null component_id.  Rows that repeat
a doc_id with another text are nodes of their own.  Repeated rows fall into one class.  An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Grow, Scratch, WordCache, chunked, few, ship, trim

BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
#: Members of a block, bytes of full sets in one, and members that one matrix product compares.
LEAST_BLOCK, MOST_BLOCK, BLOCK_BYTES, TILE = 128, 4096, 32 << 20, 256
SKETCH_FROM, MARGIN = 200, 0.2
SIGNATURE = "doc_id long, text_hash long, n_shingles long, set_id binary, node long, other long, keys array<long>, sketch binary"
M1, M2, M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct shingle hashes of documents."""

    def __init__(self, size: int):
        self.size = size
        self.cache = WordCache(self._build, self._reset, lambda at: self.hashes.keep(at))

    def _reset(self) -> None:
        self.hashes = Grow(np.uint64)

    def _build(self, words: list[bytes]) -> None:
        from xxhash import xxh3_64_intdigest

        self.hashes.extend(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        at, begin = self.cache.number([t.lower().split() for t in texts])
        words = self.hashes.a[at]
        w, n = self.size, len(words)
        h = np.zeros(max(n - w + 1, 0), np.uint64)
        for k in range(w):
            h = mix(h * M3 + words[k : k + len(h)] + np.uint64(k))
        out = []
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            if b - a >= w:
                x = np.sort(h[a : b - w + 1])
                out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
            elif b > a:
                short = np.array([b - a], np.uint64)
                for k in range(a, b):
                    short = mix(short * M3 + words[k : k + 1])
                out.append(short)
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def probe_ranks() -> np.ndarray:
    """RANK[i, j]: when the empty bin i asks bin j; each row is a fixed random permutation."""
    rng = np.random.default_rng(77)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)]).astype(np.int16)


class Signer:
    """Signatures of shingle sets: band keys and an 8-bit sketch of every bin."""

    def __init__(self):
        self.ranks = probe_ranks()

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), BINS), np.uint64)
        for row, x in zip(out, sets, strict=True):
            if not len(x):
                continue
            bins = (((x >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
            first = np.concatenate(([True], bins[1:] != bins[:-1]))
            filled, values = bins[first], x[first]
            row[filled] = values
            if len(filled) < BINS:
                empty = np.ones(BINS, bool)
                empty[filled] = False
                lender = self.ranks[empty][:, filled].argmin(1)
                row[empty] = values[lender]
        return out

    @staticmethod
    def keys(signatures: np.ndarray) -> np.ndarray:
        s = signatures.reshape(len(signatures), BANDS, ROWS)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(s), BANDS)) * M3
        for k in range(ROWS):
            key = mix(key * M1 + s[:, :, k])
        return key.view(np.int64)


def _sign(size: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        shingler, signer = Shingler(size), Signer()
        for part, texts in chunked(batches, 1):
            sets = shingler.sets(texts)
            lens = np.fromiter(map(len, sets), np.int64, len(sets))
            signatures = signer.signatures(sets)
            keys = signer.keys(signatures)
            some = lens > 0
            offsets = np.concatenate(([0], np.cumsum(some * BANDS))).astype(np.int32)
            sketch = mix(signatures).astype(np.uint8)
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            numbers = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(2), pa.array(lens), pa.array([x if k else None for x, k in zip(digests, some, strict=True)], pa.binary()), *(pa.array(numbers[:, k]) for k in (0, 1)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel())), pa.array([s.tobytes() if k else None for s, k in zip(sketch, some, strict=True)], pa.binary()),
                ],
                names=[c.split()[0] for c in SIGNATURE.split(", ")],
            )

    return run


def _sets(size: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        shingler = Shingler(size)
        for part, texts in chunked(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in shingler.sets(texts)], pa.binary())], names=["node", "hashes"])

    return run


def _confirm(percent: int):
    """Keeps the pairs with 100 * intersection >= percent * union."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for x, y in zip(a, b, strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                if 100 * len(p) < percent * len(q):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


def _join_labels(label: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Joins the clusters of ``others`` to that of i; returns one of ``others`` for each cluster joined."""
    clusters, first = np.unique(label[others], return_index=True)
    label[np.isin(label, clusters)] = label[i]
    return others[first]


def _alike(g: dict, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of different components that are alike in size and sketch."""
    comp, n, sketch, side = g["comp"], g["n"], g["sketch"], g["side"]
    right = np.flatnonzero(side != 0)
    label = np.arange(len(comp))
    out = []
    for i in np.flatnonzero(side != 1).tolist():
        at = right[(label[right] != label[i]) & (comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
        if not len(at):
            continue
        # agreement of 8-bit sketches, less what differing bins agree on by chance
        like = ((sketch[at] == sketch[i]).mean(1) - 1 / 256) / (1 - 1 / 256)
        at = at[(np.minimum(n[at], n[i]) < SKETCH_FROM) | (like >= percent / 100 - MARGIN)]
        if len(at):
            out += [(i, j) for j in _join_labels(label, i, at).tolist()]
    return out


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of 0-1 matrices of documents and shingles."""
    every = np.unique(np.concatenate(left))
    out = np.zeros((len(left), len(right)), np.float32)

    def cells(sets):
        owner, x = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(every, x), len(every) - 1)
        ok = every[at] == x
        order = np.argsort(at[ok], kind="stable")
        return owner[ok][order], at[ok][order]

    (a_owner, a), (b_owner, b) = cells(left), cells(right)
    for low in range(0, len(every), 8192):
        ms = []
        for owner, at, sets in ((a_owner, a, left), (b_owner, b, right)):
            i, j = np.searchsorted(at, (low, low + 8192))
            m = np.zeros((len(sets), 8192), np.float32)
            m[owner[i:j], at[i:j] - low] = 1
            ms.append(m)
        out += ms[0] @ ms[1].T
    return out


def _linked(g: dict, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of different components that hold on full sets."""
    side, label = g["side"], g["comp"].copy()
    sets = [np.frombuffer(x, np.uint64) for x in g["hashes"]]
    n = np.array([len(x) for x in sets])
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    out = []
    for a in range(0, len(left), TILE):
        rows = left[a : a + TILE]
        for b in range(0, len(right), TILE):
            cols = right[b : b + TILE]
            open_ = (label[rows][:, None] != label[cols][None, :]) & (100 * np.minimum(n[rows][:, None], n[cols][None, :]) >= percent * np.maximum(n[rows][:, None], n[cols][None, :]))
            r, c = rows[open_.any(1)], cols[open_.any(0)]
            if not len(r):
                continue
            both = _shared([sets[i] for i in r], [sets[j] for j in c])
            holds = 100 * both >= percent * (n[r][:, None] + n[c][None, :] - both)
            for i, ok in zip(r.tolist(), holds, strict=True):
                near = c[ok & (label[c] != label[i])]
                if len(near):
                    out += [(i, j) for j in _join_labels(label, i, near).tolist()]
    return out


def _by_group(forest, percent: int, last: str):
    """Runs ``forest`` over each (key, block, block) of a sorted partition, group by group."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        held: dict[str, np.ndarray] | None = None

        def arrays(batch):
            g = {name: np.asarray(batch.column(k)) for k, name in enumerate(("key", "bi", "bj", "side", "node", "comp", "n"))}
            values = batch.column(7).to_pylist()
            if last == "sketch":
                g[last] = np.frombuffer(b"".join(values), np.uint8).reshape(-1, BINS)
            else:
                g[last] = np.array([*values, None], object)[:-1]
            return g

        def emit(g):
            g["comp"] = np.unique(g["comp"], return_inverse=True)[1]
            cut = np.flatnonzero((np.diff(g["key"]) != 0) | (np.diff(g["bi"]) != 0) | (np.diff(g["bj"]) != 0)) + 1
            pairs = set()
            for a, b in zip([0, *cut], [*cut, len(g["key"])]):
                node = g["node"][a:b].tolist()
                for i, j in forest({k: v[a:b] for k, v in g.items()}, percent):
                    if node[i] != node[j]:
                        pairs.add((min(node[i], node[j]), max(node[i], node[j])))
            found = sorted(pairs)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                g = arrays(batch.slice(start, 2048))
                if held is not None:
                    g = {k: np.concatenate((held[k], g[k])) for k in g}
                last_group = (g["key"] == g["key"][-1]) & (g["bi"] == g["bi"][-1]) & (g["bj"] == g["bj"][-1])
                first = int(np.flatnonzero(last_group)[0])
                held = {k: v[first:] for k, v in g.items()}
                if first:
                    yield emit({k: v[:first] for k, v in g.items()})
        if held is not None:
            yield emit(held)
        held = None
        trim()

    return run


PAIRS = "a long, b long"


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, comp): the least node reachable, for all nodes of the edges (a, b).

    Alternating large-star and small-star steps; the edge table is written after each
    round, and the rounds end when it no longer changes.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    e = scratch.write(e, f"{label}0")
    before, round_ = None, 0
    while True:
        mark = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == before or not mark[0]:
            break
        before, round_ = mark, round_ + 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a table of its own: the join below then has a shuffle on either side, so the edges of
        # a node with very many of them are split over tasks
        least = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{label}_least{round_}")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = scratch.write(small.filter("u != v").distinct(), f"{label}{round_}")
        scratch.drop(f"{label}{round_ - 1}", f"{label}_least{round_}")
    # now every node points to its component's least node
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    return docs.mapInArrow(_sign(shingle), SIGNATURE)


def groups(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) of every row; text_hash is xxhash64 of the text."""
    spark = df.sparkSession
    ship(spark)
    d = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    signed = scratch.write(_signed(d, shingle), "signed")
    filled = signed.filter("set_id is not null")
    copies = filled.groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).filter("rows > 1").select("set_id", "least")
    copies = scratch.write(copies, "copies")
    c = few(copies)
    columns = ["set_id", "node", "other", "doc_id", "text_hash", "n_shingles", "keys", "sketch"]
    first = filled.join(c, "set_id").filter("doc_id <=> least").dropDuplicates(["set_id"]).select(*columns)
    nodes = scratch.write(filled.join(c, "set_id", "left_anti").select(*columns).unionByName(first), "numbered")
    clash = few(scratch.write(nodes.groupBy("node").agg(F.count("*").alias("sets")).filter("sets > 1").select(F.col("node").alias("clash")), "clash"))
    if not clash.isEmpty():
        nodes = nodes.join(clash, nodes["node"] == clash["clash"], "left").withColumn("node", F.when(F.col("clash").isNull(), F.col("node")).otherwise(F.col("other"))).drop("clash")
        nodes = scratch.write(nodes, "nodes")
    members = nodes.select("node", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("k")).filter("k > 1").select("key", "centre")
    buckets = scratch.write(members.join(shared, "key"), "buckets")
    stars = buckets.filter("node != centre").groupBy("node", "centre").agg((-F.count("*")).alias("k"))
    stars = scratch.write(stars.groupBy("node").agg(F.min(F.struct("k", "centre")).alias("most")).select(F.col("most.centre").alias("a"), F.col("node").alias("b")), "stars")
    edges = _confirmed(d, stars, nodes, scratch, shingle, percent)
    comps = components(edges, scratch, "first")
    more = _residual(d, buckets, nodes, comps, scratch, shingle, percent)
    if not more.isEmpty():
        all_edges = comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more)
        comps = components(all_edges, scratch, "second")
    comps = comps.unionByName(comps.select(F.col("comp").alias("node"), "comp").distinct())
    named = few(comps).join(nodes.select("node", "set_id", "doc_id"), "node").select("node", "set_id", "comp", "doc_id")
    named = scratch.write(named, "named")
    least = scratch.write(named.groupBy("comp").agg(F.min("doc_id").alias("component")), "least")
    labels = few(scratch.write(named.join(few(least), "comp").select("set_id", "component"), "labels"))
    out = signed.select("doc_id", "text_hash", "n_shingles", "set_id").join(c, "set_id", "left").join(labels, "set_id", "left")
    component = F.coalesce("component", "least", "doc_id")
    return scratch.result(out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash"))


def _full_sets(docs: DataFrame, wanted: DataFrame, nodes: DataFrame, scratch: Scratch, label: str, shingle: int) -> DataFrame:
    """(node, hashes) of the wanted nodes, whose texts are shingled again."""
    rows = few(wanted.distinct()).join(nodes.select("node", "doc_id", "text_hash"), "node")
    rows = few(scratch.write(rows.select("node", F.col("doc_id").alias("i"), F.col("text_hash").alias("h")), f"wanted_{label}"))
    texts = docs.join(rows, docs["doc_id"].eqNullSafe(rows["i"]) & (docs["text_hash"] == rows["h"])).select("node", "text").dropDuplicates(["node"])
    return scratch.write(texts.mapInArrow(_sets(shingle), "node long, hashes binary"), f"sets_{label}")


def _confirmed(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, scratch: Scratch, shingle: int, percent: int) -> DataFrame:
    """The star edges (a, b) that hold on full sets."""
    sets = _full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, scratch, "stars", shingle)
    a, b = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"set_{x}")) for x in "ab")
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b")
    found = scratch.write(joined.mapInArrow(_confirm(percent), PAIRS).distinct(), "edges")
    scratch.drop("sets_stars", "wanted_stars", "stars")
    return found


def _in_blocks(rows: DataFrame, block: Column, last: str) -> DataFrame:
    """Rows of (key, node, comp, n, last; k, main, n_main) dealt to pairs of blocks of their key, sorted by them.

    A key has k members, n_main of them in its largest component ``main``; these have blocks
    of their own, which are not paired with each other.  A member goes to each pair that its
    block is in, so no task sees more of a key than two blocks.
    """
    is_main = F.col("comp") == F.col("main")
    rows = rows.withColumn("m", F.ceil(F.col("n_main") / block).cast("int")).withColumn("o", F.ceil((F.col("k") - F.col("n_main")) / block).cast("int"))
    number = F.xxhash64("node")
    rows = rows.withColumn("block", F.when(is_main, F.pmod(number, F.col("m"))).otherwise(F.col("m") + F.pmod(number, F.col("o"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(is_main, F.col("m")).otherwise(0), F.col("m") + F.col("o") - 1))).select(
        "key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"),
        F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") > F.col("other")).cast("int")).alias("side"), "node", "comp", "n", last,
    )
    return rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "node")


def _mixed(placed: DataFrame) -> DataFrame:
    """(key, k, main, n_main, h) of the keys with members in different components; h stands for the members."""
    per = placed.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h"))
    per = per.groupBy("key").agg(F.sum("c").alias("k"), F.max(F.struct("c", "comp")).alias("top"), F.sum("h").alias("h"), F.count("*").alias("comps"))
    return per.filter("comps > 1").select("key", "k", F.col("top.comp").alias("main"), F.col("top.c").alias("n_main"), "h")


def _residual(docs: DataFrame, buckets: DataFrame, nodes: DataFrame, comps: DataFrame, scratch: Scratch, shingle: int, percent: int) -> DataFrame:
    """Links between different components that share a bucket, as a spanning forest.

    First the buckets are searched for pairs alike in size and sketch.  Their forest gives
    candidate groups; all pairs of a group's documents are then compared on full sets,
    block by block.  Either search returns fewer rows than it reads.
    """
    block = F.least(F.greatest(F.ceil(F.col("k") / 4), F.lit(LEAST_BLOCK)), F.lit(MOST_BLOCK))
    placed = buckets.select("key", "node").join(few(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = scratch.write(placed, "placed")
    mixed = _mixed(placed).groupBy("k", "h").agg(F.min(F.struct("key", "main", "n_main")).alias("one")).select("one.*", "k")
    mixed = scratch.write(mixed, "mixed")
    rows = placed.join(few(mixed), "key").join(nodes.select("node", F.col("n_shingles").alias("n"), "sketch"), "node")
    alike = scratch.write(_in_blocks(rows, block, "sketch").mapInArrow(_by_group(_alike, percent, "sketch"), PAIRS).distinct(), "alike")
    members = components(alike, scratch, "alike_groups")
    members = members.unionByName(members.select(F.col("comp").alias("node"), "comp").distinct()).select("node", F.xxhash64("comp").alias("key"))
    members = scratch.write(members.join(few(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node")), "members")
    sets = _full_sets(docs, members.select("node"), nodes, scratch, "alike", shingle).withColumn("n", F.octet_length("hashes").cast("long"))
    total = members.select("node", "key").join(sets.select("node", "n"), "node").groupBy("key").agg(F.sum("n").alias("bytes"))
    groups_ = few(scratch.write(_mixed(members).join(total, "key"), "groups"))
    rows = members.join(groups_, "key").join(sets, "node")
    by_bytes = F.greatest(F.floor(F.col("k") * F.lit(BLOCK_BYTES) / F.col("bytes")), F.lit(1))
    return scratch.write(_in_blocks(rows, F.least(block, by_bytes), "hashes").mapInArrow(_by_group(_linked, percent, "hashes"), PAIRS).distinct(), "more")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "near_dup")).drop("text_hash")
