"""Centroid clustering over exact integers, with Hamerly's bounds.

Vectors of SIZE finite components become integers, floor(1024 * x); the first centroids are
the vectors with the least hashes.  Each pass streams the vectors once, without a shuffle
or a join: a vector is stored with its cluster, an upper bound of the distance to its
centroid and a lower bound of the distance to any other.  Centroids that moved loosen both
by their drift.  While the upper bound is below the lower one (or below half the way from
the centroid to its nearest neighbour), the cluster stands and nothing is computed.  Else
the upper bound is made exact, and if that does not decide, all squared distances are
compared as integers.  Bounds are rounded outwards, so they never decide a tie.

A task adds one row of totals for each centroid (count, full scans, squared distances, sums
of components); the driver sees CENTROIDS times SIZE + 3 sums per round.  The
vectors of a pass are a table in spark.checkpoint.dir, and the one before is dropped: writing
them with their bounds costs less than sorting them for a join with a table of bounds.

Vectors that are null, have another length, a null or a non-finite component are left out.
A null vec_id hashes as the empty text; rows that repeat a vec_id are vectors of their own,
and those of equal hash are ordered by their components.  With fewer than CENTROIDS vectors
each is a centroid; an empty table gives no rows.  Integers beyond 2^27 raise an error,
as squared distances then no longer fit a long.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read, ship

SIZE, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, "3"
#: Integers up to here keep 64 squared differences within a long.
LIMIT = 1 << 27
#: Bounds are widened by this part of themselves: more than all roundings of a pass.
SLACK = 1e-12
#: What a row of totals begins with, before the sums.
COUNT, SCANNED, INERTIA, HEAD = 0, 1, 2, 3
STATE = "vec_id long, v array<long>, cluster int, upper double, lower double, distance long, totals array<long>"


def integers(vec: Column) -> Column:
    """The integer components; NULL for vectors that are left out."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    whole = F.transform(vec, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    checked = F.when(F.exists(whole, lambda x: F.abs(x) > LIMIT), F.raise_error(F.lit(f"a component is beyond {LIMIT}"))).otherwise(whole)
    return F.when((F.size(vec) == SIZE) & F.forall(vec, fine), checked.cast("array<long>"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(name.cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, SIZE)


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids."""
    out = np.empty((len(v), len(centroids)), np.int64)
    for c, at in enumerate(centroids):
        d = v - at
        out[:, c] = np.einsum("ij,ij->i", d, d)
    return out


class Bounds:
    """What a pass needs of the centroids: themselves, how far each and the others moved, and half the way to the nearest."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        k = len(centroids)
        self.centroids = centroids
        moved = np.sqrt(((centroids - (centroids if before is None else before)) ** 2).sum(1).astype(float)) * (1 + SLACK)
        self.drift, self.others = moved, np.array([max([0.0, *np.delete(moved, c)]) for c in range(k)])
        between = np.sqrt(squared(centroids, centroids).astype(float))
        np.fill_diagonal(between, np.inf)
        self.half = between.min(1, initial=np.inf) / 2 * (1 - SLACK)

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """The new clusters and bounds, and how many vectors were compared with all centroids."""
        cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
        old = cluster >= 0
        at = cluster[old]
        upper[old] = (upper[old] + self.drift[at]) * (1 + SLACK)
        lower[old] = lower[old] - self.others[at] - SLACK * (np.abs(lower[old]) + self.others[at])
        open_ = np.flatnonzero(~old | (upper >= np.maximum(lower, self.half[cluster])))
        known = open_[cluster[open_] >= 0]
        upper[known] = np.sqrt(self.own(v[known], cluster[known]).astype(float)) * (1 + SLACK)
        open_ = open_[(cluster[open_] < 0) | (upper[open_] >= np.maximum(lower[open_], self.half[cluster[open_]]))]
        if len(open_):
            d = squared(v[open_], self.centroids)
            best = d.argmin(1)  # the smaller number of equal ones
            rows = np.arange(len(d))
            cluster[open_], upper[open_] = best, np.sqrt(d[rows, best].astype(float)) * (1 + SLACK)
            rest = d.astype(float)
            rest[rows, best] = np.inf
            lower[open_] = np.sqrt(rest.min(1)) * (1 - SLACK)
        return cluster, upper, lower, len(open_)

    def own(self, v: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        d = v - self.centroids[cluster]
        return np.einsum("ij,ij->i", d, d)


def _pass(bounds: Bounds, last: bool):
    def run(batches) -> Iterator:
        import pyarrow as pa

        names, k = [c.split()[0] for c in STATE.split(", ")], len(bounds.centroids)
        totals = np.zeros((k, HEAD + SIZE), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.asarray(batch.column(1).flatten()).reshape(-1, SIZE)
            cluster, upper, lower, some = bounds.assign(v, *(np.asarray(batch.column(c)) for c in (2, 3, 4)))
            distance = bounds.own(v, cluster) if last else None
            totals[0, SCANNED] += some
            for c in np.unique(cluster):
                of = cluster == c
                totals[c, COUNT] += of.sum()
                totals[c, INERTIA] += distance[of].sum() if last else 0
                totals[c, HEAD:] += v[of].sum(0)
            none = pa.nulls(len(v), pa.list_(pa.int64()))
            shown = pa.array(distance) if last else pa.nulls(len(v), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), shown, none], names=names)
        if totals[:, COUNT].any():
            none = [pa.nulls(k, t) for t in (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.float64(), pa.float64(), pa.int64())]
            none[2] = pa.array(range(k), pa.int32())
            yield pa.RecordBatch.from_arrays([*none, pa.array(totals.tolist(), pa.list_(pa.int64()))], names=names)

    return run


class Clustering:
    """Final centroids, the table of (vec_id, cluster, distance), counts and inertia by centroid, and full scans by pass."""

    def __init__(self, centroids: np.ndarray, rows: DataFrame, n: list[int], inertia: list[int], scanned: list[int]):
        self.centroids, self.rows, self.n, self.inertia, self.scanned = centroids, rows, n, inertia, scanned


def cluster(df: DataFrame, scratch: Scratch, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS) -> Clustering | None:
    """Clusters a table; None if it has no vector to keep."""
    ship(df.sparkSession)
    vectors = df.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vec_col)).alias("v")).filter("v is not null")
    centroids, before, scanned = first_centroids(vectors, k), None, []
    k = len(centroids)
    if not k:
        return None
    state = vectors.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    for number in range(rounds + 1):
        last = number == rounds
        written = scratch.write(state.mapInArrow(_pass(Bounds(centroids, before), last), STATE), f"pass{number}")
        scratch.drop(f"pass{number - 1}")
        each = written.filter("totals is not null").select("cluster", F.posexplode("totals").alias("at", "x"))
        found = np.zeros((k, HEAD + SIZE), object)
        for r in each.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
            found[r["cluster"], r["at"]] = int(r["x"])
        scanned.append(found[0, SCANNED])
        state = written.filter("totals is null").select("vec_id", "v", "cluster", "upper", "lower", "distance")
        if not last:
            before = centroids
            centroids = np.array([row[HEAD:] // row[COUNT] if row[COUNT] else at for row, at in zip(found, centroids, strict=True)], np.int64)
    return Clustering(centroids, state.select("vec_id", "cluster", "distance"), found[:, COUNT].tolist(), found[:, INERTIA].tolist(), scanned)


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def described(found: Clustering) -> DataFrame:
    """Every vector with its cluster's and the whole inertia and the hash of its centroid."""
    spark = found.rows.sparkSession
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    about = spark.createDataFrame([(c, found.inertia[c], sum(found.inertia), h) for c, h in enumerate(hashes)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(about), "cluster").select(*[c.split()[0] for c in RESULT.split(", ")])


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(read(spark, sf_dir, "embeddings"), Scratch(spark, "hamerly"))
    return described(found) if found else spark.createDataFrame([], RESULT)


def sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """Plain rounds of assignment and replacement in SQL, without bounds."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {SIZE}
)""",
        f"""first AS (SELECT v, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c FROM kept)""",
        f"c0 AS MATERIALIZED (SELECT c, v FROM first WHERE c < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS (
  SELECT k.row, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept k CROSS JOIN c{i} c
), a{i} AS MATERIALIZED (SELECT row, min(struct_pack(d := CAST(d AS BIGINT), c := c)) AS best FROM d{i} GROUP BY row)""")
        if i < rounds:
            parts.append(f"""s{i} AS (
  SELECT a.best.c AS c, i, sum(k.v[i]) AS s, count(*) AS n FROM a{i} a JOIN kept k USING (row) CROSS JOIN range(1, {SIZE + 1}) r(i) GROUP BY ALL
), u{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(u.v, c.v) AS v FROM c{i} c LEFT JOIN u{i} u ON u.c = c.c)""")
    return f"""WITH {", ".join(parts)}
SELECT k.vec_id, CAST(a.best.c AS INTEGER) AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept k USING (row) JOIN c{rounds} c ON c.c = a.best.c"""


OP13_SQL = sql()
