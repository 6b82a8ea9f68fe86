"""Exact guarded cosine top-k for many queries at once, pruned by angles to pivots.

1. A few pivots are drawn.  Rows are sorted by cohort, length of the vector, nearest pivot
   and index, over ranges, and packed into tiles of ``block`` x TILE rows, one row of the
   table each, with the least and largest index and, for every pivot, the least and largest
   angle to it.  No window runs over rows, and a cohort spreads over as many ranges as it
   fills.
2. Tiles, not vectors, are joined, on cohort, length and a bucket of the candidate.  A pair
   is left out if the guard rules it out as a whole, or if the angles do: for any pivot p,
   angle(q, c) >= |angle(q, p) - angle(c, p)|, so the cosine is at most that of the widest
   gap between the two ranges of angles.
3. First every query tile meets the SEEDS candidate tiles of its own pivot that come last
   before it.  The k-th similarity of its queries is then a floor: tile pairs whose bound is
   below the floor of all their queries never move a vector.
4. A task holds one query tile and up to GROUP candidate tiles, the most promising first, and
   keeps the k best of each query.  Within a tile pair, blocks are skipped in the same way, by
   guard and by the running k-th similarity of each query, before any product is computed.
   Products are taken in single precision first; only pairs that reach the running k-th
   similarity within its error are computed in double precision, checked and ordered.

The result is exact: bounds are compared with SLACK to spare.  Similarities are compared to
12 digits, ties go to the smaller id.  Zero, infinite and NULL vectors and those of another
length are never neighbours.  :func:`skipped` tells how many block pairs the bounds spared.

The hits are written once to spark.checkpoint.dir, so that what is built on them reads them
instead of searching again.  Without structure (all angles alike) all allowed block pairs are
compared, and work grows with the square of a cohort; the table of tile pairs has one row for
some thousands of rows on either side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import Tables
from . import guards

#: Rows of a block, and blocks of a tile: 4096 vectors of 64 doubles are two megabytes.
BLOCK, TILE = 512, 8
#: Pivots, rows they are chosen from, candidate tiles that give a floor, candidate tiles of a task, buckets of the tile join.
PIVOTS, SAMPLE, SEEDS, GROUP, BUCKETS = 16, 1024, 2, 16, 64
#: Cosines and angles that differ by less count as equal where something is left out.
SLACK = 1e-9
ROW = "cohort string, id long, symbol string, idx long, vec array<double>, size int, cell int"
TILES = "tile long, cohort string, size int, cell int, ids array<long>, idxs binary, symbols array<string>, vecs binary, first long, last long, low array<double>, high array<double>"
HITS = "query_id long, case_id long, similarity double, pairs long, compared long"


def _vectors(column, size):
    import numpy as np

    return np.asarray(column.flatten(), float).reshape(-1, size)


def _angles(unit, pivots):
    import numpy as np

    return np.arccos(np.clip(unit @ pivots.T, -1, 1)) if len(pivots) else np.zeros((len(unit), 0))


def _unit(x):
    import numpy as np

    with np.errstate(all="ignore"):
        return x / np.sqrt((x * x).sum(1))[:, None]


def shape(df: DataFrame) -> DataFrame:
    """The columns of a search, with rows left out that can be no one's neighbour."""
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    keep = F.col("vec").isNotNull() & F.col("idx").isNotNull() & ~F.exists("vec", lambda x: x.isNull())
    cols = [F.coalesce("cohort", F.lit("")).alias("cohort"), F.col("id").cast("long"), F.coalesce(F.col("symbol").cast("string"), F.lit("")).alias("symbol"), F.col("idx").cast("long"), F.col("vec").cast("array<double>")]
    return df.select(*cols).filter(keep).filter((norm > 0) & (norm < float("inf")))


def pivots_of(df: DataFrame, most: int = PIVOTS):
    """At most ``most`` unit vectors far from each other, of the most frequent length of the first SAMPLE rows; any choice gives the same hits."""
    import numpy as np

    rows = [r["vec"] for r in df.select("vec").limit(SAMPLE).collect()]
    if not rows:
        return np.zeros((0, 0))
    sizes = [len(x) for x in rows]
    size = max(set(sizes), key=lambda n: (sizes.count(n), n))
    x = _unit(np.array([v for v in rows if len(v) == size]))
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(most, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def _to_cells(pivots):
    """Adds the length and the nearest pivot (-1: none of that length)."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column(4)))
            cell = np.full(len(sizes), -1, np.int32)
            if len(pivots) and (at := np.flatnonzero(sizes == pivots.shape[1])).size:
                cell[at] = (_unit(_vectors(batch.column(4).take(pa.array(at)), pivots.shape[1])) @ pivots.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(cell)], names=[c.split()[0] for c in ROW.split(", ")])

    return run


def _pack(pivots, rows: int):
    """Sorted rows to tiles; a tile has one cohort, length and nearest pivot."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number, held, schema = TaskContext.get().partitionId() << 32, None, None

        def tile(t):
            nonlocal number
            size = t.column("size")[0].as_py()
            vec = _vectors(t.column("vec").combine_chunks(), size)
            angles = _angles(_unit(vec), pivots if len(pivots) and pivots.shape[1] == size else np.zeros((0, size)))
            idx = np.asarray(t.column("idx"), np.int64)
            number += 1
            values = {
                "tile": number, "cohort": t.column("cohort")[0].as_py(), "size": size, "cell": t.column("cell")[0].as_py(), "ids": t.column("id").to_pylist(), "idxs": idx.tobytes(),
                "symbols": t.column("symbol").to_pylist(), "vecs": vec.tobytes(), "first": int(idx.min()), "last": int(idx.max()), "low": angles.min(0).tolist(), "high": angles.max(0).tolist(),
            }
            return pa.RecordBatch.from_pylist([values], schema=schema)

        schema = pa.schema([
            ("tile", pa.int64()), ("cohort", pa.string()), ("size", pa.int32()), ("cell", pa.int32()), ("ids", pa.list_(pa.int64())), ("idxs", pa.binary()), ("symbols", pa.list_(pa.string())), ("vecs", pa.binary()),
            ("first", pa.int64()), ("last", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
        ])
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            cohort, size, cell = np.array(table.column("cohort").to_pylist(), object), np.asarray(table.column("size")), np.asarray(table.column("cell"))
            cut = [0, *(np.flatnonzero((cohort[1:] != cohort[:-1]) | (size[1:] != size[:-1]) | (cell[1:] != cell[:-1])) + 1), len(size)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                while b - a > rows or (b < len(size) and a < b):
                    yield tile(table.slice(a, min(rows, b - a)))
                    a = min(a + rows, b)
            held = table.slice(a)
        if held is not None and held.num_rows:
            yield tile(held)

    return run


def pack(df: DataFrame, n: int, pivots, tables: Tables, name: str, block: int = BLOCK) -> DataFrame:
    """The table of tiles of a shaped table of n rows."""
    rows = block * TILE
    parts = max(1, math.ceil(n / (4 * rows)))
    order = ["cohort", "size", "cell", "idx", "id"]
    cells = df.mapInArrow(_to_cells(pivots), ROW).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return tables.write(cells.mapInArrow(_pack(pivots, rows), TILES), name)


class _Side:
    """One tile in a task, cut into blocks."""

    def __init__(self, row: dict, pivots, block: int):
        import numpy as np

        self.size = row["size"]
        self.id, self.idx = np.array(row["ids"], np.int64), np.frombuffer(row["idxs"], np.int64)
        self.symbol = np.array(row["symbols"], object)
        self.vec = np.frombuffer(row["vecs"], float).reshape(-1, self.size)
        self.norm = np.sqrt((self.vec * self.vec).sum(1))
        unit = self.vec / self.norm[:, None]
        self.unit = unit.astype(np.float32)
        self.angle = _angles(unit, pivots if len(pivots) and pivots.shape[1] == self.size else np.zeros((0, self.size)))
        self.blocks = [slice(a, min(a + block, len(self.id))) for a in range(0, len(self.id), block)]
        self.first = [self.idx[b].min() for b in self.blocks]
        self.range = [(self.angle[b].min(0), self.angle[b].max(0)) for b in self.blocks]


def _search(pivots, k: int, ahead: int, exclude_symbol: bool, gap: int | None, block: int):
    """Runs over rows sorted by (query tile, group), the query tile and its floors before the candidates."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def bound(q, at, c, n):
            """The best cosine that each query of a block may have in the n-th candidate block."""
            if not q.angle.shape[1]:
                return np.ones(at.stop - at.start)
            (low, high), x = c.range[n], q.angle[at]
            return np.cos(np.clip(np.maximum(low - x, x - high).max(1), 0, np.pi))

        def allowed(q, i, c, j):
            ok = (c.idx[j] <= q.idx[i] - ahead) & (c.id[j] != q.id[i])
            if exclude_symbol:
                other = c.symbol[j] != q.symbol[i]
                ok &= other if gap is None else other | (c.idx[j] <= q.idx[i] - gap)
            return ok

        def reach(q, use, c, b, floor):
            """(query, candidate) of the pairs of a block that may enter the k best, by single precision with its error to spare."""
            error = np.float32((q.size + 8) * 2.0**-23)
            near = q.unit[use] @ c.unit[b].T
            least = floor.copy()
            if len(new := np.flatnonzero(~np.isfinite(floor))):  # queries with fewer than k so far: the k-th of this block is their floor
                ok = allowed(q, use[new][:, None], c, np.arange(b.start, b.stop)[None, :])
                near[new] = np.where(ok, near[new], -np.inf)
                if near.shape[1] >= k:
                    least[new] = np.partition(near[new], -k, axis=1)[:, -k] - error
                least[new] = np.maximum(least[new], -2)
            return np.divmod(np.flatnonzero((near >= (least - error).astype(np.float32)[:, None] - error).ravel()), near.shape[1])

        def merge(q, best, c):
            pairs = compared = 0
            for at in q.blocks:
                last = q.idx[at].max()
                met = [(b, bound(q, at, c, n)) for n, b in enumerate(c.blocks) if c.first[n] <= last - ahead]
                pairs += len(met)
                for b, most in sorted(met, key=lambda x: -x[1].max()):  # the most promising first: they raise what others must reach
                    use = at.start + np.flatnonzero(most >= best[0][at, k - 1] - SLACK)
                    if not len(use):
                        continue
                    compared += 1
                    i, j = reach(q, use, c, b, best[0][use, k - 1])
                    ok = allowed(q, use[i], c, j + b.start)
                    i, j = i[ok], j[ok]
                    if len(i) > len(use) * 16:
                        sim = (q.vec[use] @ c.vec[b].T)[i, j]
                    else:
                        sim = np.einsum("ij,ij->i", q.vec[use[i]], c.vec[j + b.start])
                    i, j = use[i], j + b.start
                    sim = np.round(sim / (q.norm[i] * c.norm[j]), 12)
                    enters = (sim > best[0][i, k - 1]) | ((sim == best[0][i, k - 1]) & (c.id[j] < best[1][i, k - 1]))
                    i, j, sim = i[enters], j[enters], sim[enters]
                    if not len(i):
                        continue
                    rows = np.unique(i)
                    of = np.concatenate((np.repeat(rows, k), i))
                    sims, ids = np.concatenate((best[0][rows].ravel(), sim)), np.concatenate((best[1][rows].ravel(), c.id[j]))
                    order = np.lexsort((ids, -sims, of))
                    firsts = order[np.searchsorted(of[order], rows)[:, None] + np.arange(k)]
                    best[0][rows], best[1][rows] = sims[firsts], ids[firsts]
            return pairs, compared

        def show(q, best, known, counts):
            i, rank = np.nonzero(np.isfinite(best[0]) & ~known(best))
            columns = [pa.array(q.id[i]), pa.array(best[1][i, rank]), pa.array(best[0][i, rank]), pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.int64())]
            rows = pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in HITS.split(", ")])
            return [rows, pa.RecordBatch.from_pylist([{"pairs": int(counts[0]), "compared": int(counts[1])}], schema=rows.schema)]

        names = ["size", "ids", "idxs", "symbols", "vecs"]
        of, q, best, floor, counts = None, None, None, None, np.zeros(2, np.int64)
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n].as_py() for c in ("q_tile", "part", "candidate", "best", *names)}
                if (row["q_tile"], row["part"]) != of:
                    if q is not None:
                        yield from show(q, best, floor, counts)
                    of, q, counts = (row["q_tile"], row["part"]), None, np.zeros(2, np.int64)
                if not row["candidate"]:
                    q = _Side(row, pivots, block)
                    best = (np.full((len(q.id), k), -np.inf), np.full((len(q.id), k), np.iinfo(np.int64).max))
                    known = {}
                    for x in row["best"] or []:
                        known.setdefault(x["query_id"], []).append((-x["similarity"], x["case_id"]))
                    for i, name in enumerate(q.id.tolist()):
                        for r, (s, c) in enumerate(sorted(known.get(name, []))[:k]):
                            best[0][i, r], best[1][i, r] = -s, c
                    seen = {(name, c) for name, x in known.items() for _, c in x}
                    # hits of the floor are in the table already
                    floor = lambda b, q=q, seen=seen: np.array([[(name, c) in seen for c in row] for name, row in zip(q.id.tolist(), b[1].tolist())], bool).reshape(b[1].shape)
                elif q is not None:
                    counts += merge(q, best, _Side(row, pivots, block))
        if q is not None:
            yield from show(q, best, floor, counts)

    return run


def _pairs(q: DataFrame, c: DataFrame, ahead: int, floors: DataFrame | None) -> DataFrame:
    """(q_tile, c_tile, gap) of the tile pairs that guard and angles allow; rows are tiles, without vectors."""
    side = lambda df, n: df.select("cohort", "size", *[F.col(x).alias(f"{n}_{x}") for x in ("tile", "cell", "first", "last", "low", "high")])
    every = F.array(*[F.lit(i) for i in range(BUCKETS)])
    asked = side(q, "q").withColumn("bucket", F.explode(every))
    shown = side(c, "c").withColumn("bucket", F.pmod(F.xxhash64("c_tile"), F.lit(BUCKETS)).cast("int"))
    between = lambda x, y: F.zip_with(x, y, lambda a, b: a - b)
    gap = F.greatest(F.lit(0.0), F.array_max(between("q_low", "c_high")), F.array_max(between("c_low", "q_high")))
    found = asked.join(shown, ["cohort", "size", "bucket"]).filter(F.col("c_first") <= F.col("q_last") - ahead).withColumn("gap", F.coalesce(gap, F.lit(0.0)))
    if floors is not None:
        found = found.join(floors, found["q_tile"] == floors["f_tile"], "left").filter(F.col("floor").isNull() | (F.cos("gap") >= F.col("floor") - SLACK))
    return found.select("q_tile", "c_tile", "gap", "q_cell", "c_cell", "c_last")


def _run(pairs: DataFrame, q: DataFrame, c: DataFrame, best: DataFrame | None, search, k: int) -> DataFrame:
    """Deals tile pairs to tasks, GROUP candidates each, and searches."""
    n = F.count("*").over(Window.partitionBy("q_tile"))
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("c_tile"), F.ceil(n / GROUP)).cast("int")).select("q_tile", "c_tile", "part", "gap")
    data = ["size", "ids", "idxs", "symbols", "vecs"]
    none = F.lit(None).cast("array<struct<query_id:bigint,case_id:bigint,similarity:double>>")
    asked = q.select(F.col("tile").alias("q_tile"), *data).join(dealt.select("q_tile", "part").distinct(), "q_tile")
    asked = asked.join(best, "q_tile", "left") if best is not None else asked.withColumn("best", none)
    asked = asked.select("q_tile", "part", F.lit(0).alias("candidate"), F.lit(0.0).alias("gap"), "best", *data)
    shown = dealt.join(c.select(F.col("tile").alias("c_tile"), *data), "c_tile").select("q_tile", "part", F.lit(1).alias("candidate"), "gap", none.alias("best"), *data)
    rows = asked.unionByName(shown).repartition("q_tile", "part").sortWithinPartitions("q_tile", "part", "candidate", "gap")
    return rows.mapInArrow(search, HITS)


def _first(raw: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "case_id")
    return raw.filter("query_id is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "case_id", "similarity", "rank")


def search(
    queries: DataFrame, candidates: DataFrame, k: int = 5, horizon: int = guards.HORIZON, purge: int = guards.PURGE,
    exclude_symbol: bool = False, gap: int | None = None, block: int = BLOCK,
) -> DataFrame:
    """Hits of every task, at least the k best of each query, with counts of block pairs in rows of their own."""
    spark, ahead = queries.sparkSession, horizon + purge
    tables = Tables(spark, "recall")
    shown = shape(candidates)
    n, asked = shown.count(), shape(queries)
    # no more cells than the table fills with tiles
    pivots = pivots_of(shown, min(PIVOTS, n // (block * TILE) + 1))
    c = pack(shown, n, pivots, tables, "candidates", block)
    q = c if queries is candidates else pack(asked, asked.count(), pivots, tables, "queries", block)
    find = _search(pivots, k, ahead, exclude_symbol, gap, block)
    pairs = _pairs(q, c, ahead, None)
    if c.count() <= GROUP:  # one task holds all candidates of a tile: a floor beforehand spares it nothing
        return tables.write(_run(pairs, q, c, None, find, k), "hits")
    late = F.row_number().over(Window.partitionBy("q_tile").orderBy(F.desc("c_last"), "c_tile"))
    near = pairs.filter("q_cell = c_cell").withColumn("at", late).filter(F.col("at") <= SEEDS)
    seeds = tables.write(near.select("q_tile", "c_tile", "gap"), "seeds")
    first = tables.write(_run(seeds, q, c, None, find, k), "first")
    of = q.select(F.col("tile").alias("q_tile"), F.explode("ids").alias("query_id"))
    hits = _first(first, k)
    best = hits.join(of, "query_id").groupBy("q_tile").agg(F.collect_list(F.struct("query_id", "case_id", "similarity")).alias("best"), F.min(F.when(F.col("rank") == k, F.col("similarity"))).alias("least"), F.count_if(F.col("rank") == k).alias("full"))
    best = tables.write(best.join(q.select(F.col("tile").alias("q_tile"), F.size("ids").alias("n")), "q_tile"), "best")
    # a tile has a floor if all its queries have k hits
    floors = best.select(F.col("q_tile").alias("f_tile"), F.when(F.col("full") == F.col("n"), F.col("least")).alias("floor"))
    rest = _pairs(q, c, ahead, floors).join(seeds.select("q_tile", "c_tile"), ["q_tile", "c_tile"], "left_anti")
    return tables.write(first.unionByName(_run(rest, q, c, best.select("q_tile", "best"), find, k)), "hits")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, **options) -> DataFrame:
    """(query_id, case_id, similarity, rank) of the best k cases of every query.

    Both tables have id, symbol, idx, cohort and vec (array<double>).  ``options``: those of :func:`search`.
    """
    return _first(search(queries, candidates, k, **options), k)


def skipped(raw: DataFrame) -> DataFrame:
    """(pairs, compared, share_skipped): block pairs that the guard allowed in tile pairs that met, and those compared.

    Tile pairs that the bounds kept from meeting are skipped on top of these.
    """
    r = raw.filter("pairs is not null").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))
    return r.withColumn("share_skipped", F.when(F.col("pairs") > 0, 1 - F.col("compared") / F.col("pairs")))


def by_scenario(cases: DataFrame, scenario: str, k: int) -> DataFrame:
    """First k registered cases of a scenario, in order of registration."""
    return cases.filter(F.col("scenario") == scenario).orderBy("registered").limit(k)


def arm(queries: DataFrame, patterns: DataFrame, column: str, **options) -> DataFrame:
    """Recall over one vector column of the pattern table."""
    shown = patterns.withColumn("vec", F.col(column))
    return top_k(shown if queries is patterns else queries.withColumn("vec", F.col(column)), shown, **options)


def has_vectors(patterns: DataFrame, column: str) -> bool:
    """Whether an arm is available: any row has its vector.  Reads until the first one."""
    return not patterns.filter(F.col(column).isNotNull()).limit(1).isEmpty()
