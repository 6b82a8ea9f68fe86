"""PCA fit, block-weighted fusion of two vectors, and embedding by an injected encoder."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v

COMPONENTS, WEIGHTS = 16, (0.35, 0.65)


def moments(df: DataFrame, vec: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance (n - 1): each partition sends one d x d matrix, so rows never move."""

    def partial(batches) -> Iterator:
        import pyarrow as pa

        n, s, m = 0, None, None
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float)
            if len(x):
                s = x.sum(0) if s is None else s + x.sum(0)
                m = x.T @ x if m is None else m + x.T @ x
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([m.ravel().tolist()])], names=["n", "s", "m"])

    rows = df.select(F.col(vec).cast("array<double>")).filter(F.col(vec).isNotNull()).mapInArrow(partial, "n long, s array<double>, m array<double>")
    total = rows.select("n", F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    sums = rows.select("n", F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()
    if not sums:
        raise ValueError("no vectors to fit")
    n, d = sums[0]["n"], len(sums)
    if n < 2 or len(total) != d * d:
        raise ValueError("a fit needs two or more vectors of one length")
    mean = np.array([r["x"] for r in sums]) / n
    second = np.array([r["x"] for r in total]).reshape(d, d)
    return n, mean, (second - n * np.outer(mean, mean)) / (n - 1)


def fit_pca(df: DataFrame, vec: str, components: int = COMPONENTS, whiten: bool = True) -> dict:
    """The basis: mean, components, variances and the share of variance they explain.

    Only two aggregates of size d and d x d come to the driver.  Signs are fixed so that the
    largest entry of a component is positive.
    """
    n, mean, cov = moments(df, vec)
    values, axes = np.linalg.eigh(cov)
    k = min(components, n - 1, len(mean))
    order = np.argsort(-values)[:k]
    c = axes[:, order].T
    c *= np.sign(c[np.arange(k), np.abs(c).argmax(1)])[:, None]
    var = np.maximum(values[order], 1e-12)
    return {"n": int(n), "mean": mean.tolist(), "components": c.tolist(), "variance": var.tolist(), "explained": float(values[order].sum() / max(values.sum(), 1e-300)), "whiten": whiten}


def save(basis: dict) -> tuple[str, str]:
    """Sorted-key JSON of a basis, variances included, and its SHA-256."""
    text = json.dumps(basis, sort_keys=True)
    return text, hashlib.sha256(text.encode()).hexdigest()


def project(vec: Column, basis: dict) -> Column:
    """Centred (and whitened) coordinates in a basis, as column arithmetic."""
    mean = F.array(*[F.lit(x) for x in basis["mean"]])
    centred = F.zip_with(v.doubles(vec), mean, lambda x, m: x - m)
    rows = []
    for c, var in zip(basis["components"], basis["variance"], strict=True):
        by = np.sqrt(var) if basis["whiten"] else 1.0
        rows.append(F.array(*[F.lit(float(x / by)) for x in c]))
    return F.transform(F.array(*rows), lambda c: v.dot(centred, c))


def fuse(embedding: Column, features: Column, basis: dict, weights: tuple[float, float] = WEIGHTS) -> Column:
    """Unit blocks times the roots of their weights, joined and made unit again."""
    a = v.scale(v.unit(project(embedding, basis)), float(np.sqrt(weights[0])))
    b = v.scale(v.unit(v.doubles(features)), float(np.sqrt(weights[1])))
    return v.unit(F.concat(a, b))


def build_fused(patterns: DataFrame, fit_end, embedding: str = "kronos", features: str = "z", **options) -> tuple[DataFrame, dict]:
    """Fits on rows up to ``fit_end`` only, then fuses all rows that have both vectors."""
    both = patterns.filter(F.col(embedding).isNotNull() & F.col(features).isNotNull())
    basis = fit_pca(both.filter(F.col("as_of_date") <= fit_end), embedding, **options)
    return both.withColumn("fused", fuse(F.col(embedding), F.col(features), basis)), basis


def pool(states: np.ndarray, mode: str, last: int = 8) -> np.ndarray:
    """A sequence of states to one vector: last, mean, last_k_mean or concat_last_mean."""
    if mode == "last":
        return states[-1]
    if mode == "mean":
        return states.mean(0)
    if mode == "last_k_mean":
        return states[-last:].mean(0)
    if mode == "concat_last_mean":
        return np.concatenate((states[-1], states.mean(0)))
    raise ValueError(f"unknown pooling {mode}")


def stub_encoder(window: np.ndarray, width: int = 16, seed: int = 5) -> np.ndarray:
    """A deterministic stand-in for an encoder: states of a fixed random projection."""
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(window.shape[1], width)) / np.sqrt(window.shape[1])
    return np.tanh(np.cumsum(window @ w, 0) / np.sqrt(np.arange(1, len(window) + 1))[:, None])


def _windows(batch, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, bars x columns) of the windows of an Arrow batch that have ``least`` bars.

    Arrays are made of the batch's own buffers, a window at a time: as Python lists the 10,000 windows of a batch take
    over 200 bytes a bar in every worker.
    """
    rows = batch.column(1)
    bars, ends, there = rows.values, rows.offsets.to_numpy(), rows.is_valid().to_numpy(zero_copy_only=False)
    flat, at = np.asarray(bars.values.to_numpy(zero_copy_only=False), float), bars.offsets.to_numpy()
    widths = np.where(bars.is_valid().to_numpy(zero_copy_only=False), np.diff(at), -1)
    for i, (low, high) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if not there[i] or high - low < least:
            continue
        width = widths[low]
        if width < 0 or (widths[low:high] != width).any():
            raise ValueError("the bars of a window are null or differ in length")
        yield i, np.nan_to_num(flat[at[low] : at[high]].reshape(high - low, width))


def embed(windows: DataFrame, key: str, bars: str, mode: str = "last", encoder: Callable[[np.ndarray], np.ndarray] = stub_encoder, least: int = 2) -> DataFrame:
    """(key, embedding) of windows of bars (array<array<double>>), normalised per column; short windows are skipped."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at, out = [], []
            for i, x in _windows(batch, least):
                x = np.clip((x - x.mean(0)) / (x.std(0) + 1e-5), -5, 5)
                at.append(i)
                out.append(pool(encoder(x), mode).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.list_(pa.float32()))], names=["key", "embedding"])

    kind = windows.schema[key].dataType.simpleString()
    return windows.select(F.col(key).alias("key"), F.col(bars)).mapInArrow(run, f"key {kind}, embedding array<float>")


#: Largest difference of states at one position that rounding may make.
CAUSAL = 1e-6


def causality(windows: DataFrame, key: str, bars: str, encoder: Callable[[np.ndarray], np.ndarray] = stub_encoder, cut: float = 0.5, least: int = 4) -> DataFrame:
    """(key, positions, difference, leaks): each window encoded with and without its future bars.

    The first ``cut`` of a window is encoded alone and as part of the whole, both scaled by the
    first part only; a causal encoder gives the same state at each of its positions, so a larger
    difference than CAUSAL means that later bars reach earlier states.  Windows under ``least``
    bars, and null ones, are left out.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at, positions, found = [], [], []
            for i, x in _windows(batch, least):
                n = max(1, int(len(x) * cut))
                x = np.clip((x - x[:n].mean(0)) / (x[:n].std(0) + 1e-5), -5, 5)
                apart, whole = encoder(x[:n]), encoder(x)[:n]
                at.append(i)
                positions.append(n)
                found.append(float(np.abs(apart - whole).max()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(positions, pa.int64()), pa.array(found, pa.float64())], names=["key", "positions", "difference"])

    kind = windows.schema[key].dataType.simpleString()
    found = windows.select(F.col(key).alias("key"), F.col(bars)).mapInArrow(run, f"key {kind}, positions long, difference double")
    return found.withColumn("leaks", F.col("difference") > CAUSAL)


SKIPS = ("no_series", "date_not_in_series", "insufficient_bars")


def backfill(store, targets: DataFrame, series: DataFrame, name: str, length: int = 256, claims: int = 8, most_claims: int | None = None, column: str = "kronos_vector", **how) -> dict:
    """Embeds the trailing bars of each target and writes them to a keyed store, a claim of symbols at a time.

    targets: pattern_id, symbol, day; series: symbol, day, bar (array<double>).  A claim is a range of hashed
    symbols, written and committed as one batch of the store, so a run that was cut off goes on with the first claim
    that is not there, and repeated runs write nothing.  Returns counts, skips by reason included; ``most_claims``
    ends a run early.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy("symbol").orderBy("day")
    claim = lambda df: F.pmod(F.xxhash64("symbol"), F.lit(claims))
    done, written, skips, ran = {c["batch"] for c in store.commits()}, 0, dict.fromkeys(SKIPS, 0), 0
    for k in range(claims):
        batch = f"{name}-{k}-of-{claims}"
        if batch in done:
            continue
        if most_claims is not None and ran == most_claims:
            break
        ran += 1
        own, bars = targets.filter(claim(targets) == k), series.filter(claim(series) == k)
        # of repeated days the last bar counts
        one = bars.groupBy("symbol", "day").agg(F.max("bar").alias("bar"))
        windows = one.withColumn("bars", F.collect_list("bar").over(w.rowsBetween(1 - length, 0)))
        known = one.select("symbol").distinct().withColumn("known", F.lit(True))
        joined = own.join(known, "symbol", "left").join(windows, ["symbol", "day"], "left")
        reason = F.when(F.col("known").isNull(), SKIPS[0]).when(F.col("bars").isNull(), SKIPS[1]).when(F.size("bars") < 2, SKIPS[2])
        joined = joined.withColumn("reason", reason)
        for r in joined.groupBy("reason").agg(F.count("*").alias("n")).collect():
            if r["reason"]:
                skips[r["reason"]] += r["n"]
            else:
                written += r["n"]
        found = embed(joined.filter("reason is null"), "pattern_id", "bars", **how)
        store.update(found.select(F.col("key").alias("pattern_id"), F.col("embedding").cast("array<double>").alias(column)), batch)
    return {"n_written": written, "n_skipped": sum(skips.values()), "skips": skips, "claims": ran}


def to_bytes(vec: Column) -> Column:
    """float32 values as little-endian bytes."""

    @F.pandas_udf("binary")
    def pack(s):
        return s.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return pack(vec.cast("array<float>"))
