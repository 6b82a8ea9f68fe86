"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word's subwords are the word and its character n-grams (3 to 5 bytes, with word
boundaries), hashed into buckets; a misspelling shares most of them.  The embeddings of
all subwords in a window of WINDOW words are averaged and go through a linear softmax; a
document's margin is the smooth maximum over all its windows, so a short insult in a
long text counts.  Embeddings and softmax are trained jointly (Adam on the full sample,
in numpy, on the driver) from labelled documents only.

The training sample is bounded: at most TRAIN_ROWS documents of each label, of at most
TRAIN_BYTES bytes each, the first by a hash of their ids.  Scoring reads whole texts.

Null or empty texts score the prior of the sample.  Unlabelled or null-labelled rows
are no examples; without examples of both labels, or with no word in any of them, every
score is the prior (0.5 if there is none).  Of rows that share a labelled doc_id one text
is an example.  Repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Grow, WordCache, chunked, held_out, read, ship

BUCKETS, WIDTH, WINDOW = 1 << 17, 8, 3
TRAIN_ROWS, TRAIN_BYTES = 1_500, 8_000
#: A bucket takes part if so many training documents have it; rarer ones can only be learned by heart.
LEAST_DOCS = 5
SHARPNESS = 4.0
DECAY = 3e-5
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' subwords in a row, and how many each word has."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = [b"<" + w.strip(b".,;:!?\"'()[]#*$%&|").lower() + b">" for w in words]
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    begin = np.cumsum(lens) - lens
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), lens)
    left = np.repeat(begin + lens, lens) - np.arange(len(data))
    prime = np.uint64(0x100000001B3)
    owners, buckets = [], []
    h = np.zeros(len(data), np.uint64)
    for n in range(1, 6):
        m = len(data) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ (data[n - 1 :] + np.uint64(n))) * prime
        h ^= h >> np.uint64(29)
        if n >= 3:
            ok = left[:m] >= n
            owners.append(owner[:m][ok])
            buckets.append(h[:m][ok])
    # the whole word: a sum over its bytes, weighted by place
    place = np.arange(len(data)) - np.repeat(begin, lens)
    with np.errstate(over="ignore"):
        weight = (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) * (data + np.uint64(7))
    weight ^= weight >> np.uint64(31)
    if len(begin):
        owners.append(np.arange(len(marked)))
        buckets.append(np.add.reduceat(weight, begin) * prime)
    own, key = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(own, kind="stable")
    key = key[order]
    key ^= key >> np.uint64(33)
    key *= np.uint64(0xC4CEB9FE1A85EC53)
    return (key >> np.uint64(64 - 17)).astype(np.int64), np.bincount(own, minlength=len(marked))


@dataclass
class Model:
    unit: np.ndarray  # margin of each bucket: its embedding times the softmax's weight difference
    bias: float
    prior: float

    def margins(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of subword margins and number of subwords, by word."""
        keys, n = subwords(words)
        ends = np.concatenate(([0.0], np.cumsum(self.unit[keys], dtype=np.float64)))
        upto = np.cumsum(n)
        return ends[upto] - ends[upto - n], n.astype(np.float64)


def windows(sums: np.ndarray, counts: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, document, mean margin) of every window; shorter texts are one window."""
    n = np.diff(begin)
    per = np.where(n > 0, np.maximum(n - WINDOW + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), per)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + begin[doc]
    end = np.minimum(first + WINDOW, begin[doc + 1])
    s, c = np.concatenate(([0.0], np.cumsum(sums))), np.concatenate(([0.0], np.cumsum(counts)))
    return first, end, doc, (s[end] - s[first]) / np.maximum(c[end] - c[first], 1)


def pooled(mean: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Smooth maximum of each document's windows and each window's share in it."""
    if not len(doc):
        return np.zeros(docs), mean
    start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    top = np.zeros(docs)
    top[doc[start]] = np.maximum.reduceat(mean, start)
    e = np.exp(SHARPNESS * (mean - top[doc]))
    total = np.bincount(doc, e, docs)
    return np.where(total > 0, top + np.log(np.maximum(total, 1e-300)) / SHARPNESS, 0.0), e / total[doc]


def train(texts: list[bytes], labels: list[int], prior: float | None = None, steps: int = 60, seed: int = 2) -> Model:
    y = np.asarray(labels, float)
    prior = (float(y.mean()) if len(y) else 0.5) if prior is None else prior
    docs = [t.split() for t in texts]
    if not len(y) or y.min() == y.max() or not any(docs):
        return Model(np.zeros(BUCKETS, np.float32), 0.0, prior)
    vocabulary: dict[bytes, int] = {}
    at = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for words in docs for w in words), np.int64)
    begin = np.concatenate(([0], np.cumsum([len(x) for x in docs])))
    keys, n = subwords(list(vocabulary))
    owner = np.repeat(np.arange(len(n)), n)
    # how many documents reach a bucket, counted by their distinct words
    pairs = np.unique(np.repeat(np.arange(len(docs)), np.diff(begin)) * len(n) + at)
    reach = np.bincount(pairs % len(n), minlength=len(n))
    seen = np.bincount(keys, reach[owner], BUCKETS)
    active = (seen >= LEAST_DOCS).astype(float)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.01, (BUCKETS, WIDTH)) * active[:, None]
    soft = rng.normal(0, 0.5, WIDTH)  # weight of label 1 minus weight of label 0
    bias, params = np.zeros(1), None
    counts = n.astype(float)[at]
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for step in range(1, steps + 1):
        unit = emb @ soft
        word = np.bincount(owner, unit[keys], len(n))
        first, end, doc, mean = windows(word[at], counts, begin)
        margin, share = pooled(mean, doc, len(y))
        p = 1 / (1 + np.exp(-(margin + bias[0])))
        g = (p - y) * weight
        span = np.concatenate(([0.0], np.cumsum(counts)))
        per_window = g[doc] * share / np.maximum(span[end] - span[first], 1)
        edge = np.bincount(first, per_window, len(at) + 1) - np.bincount(end, per_window, len(at) + 1)
        per_word = np.bincount(at, np.cumsum(edge)[:-1], len(n))
        per_bucket = np.bincount(keys, np.repeat(per_word, n), BUCKETS) * active
        grads = [per_bucket[:, None] * soft + DECAY * emb, emb.T @ per_bucket + 1e-4 * soft, np.array([g.sum()])]
        params = params or [(np.zeros_like(x), np.zeros_like(x)) for x in grads]
        for x, d, (m, v), rate in zip((emb, soft, bias), grads, params, (0.05, 0.05, 0.05), strict=True):
            m *= 0.9
            m += 0.1 * d
            v *= 0.99
            v += 0.01 * d * d
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Model((emb @ soft).astype(np.float32), float(bias[0]), prior)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.trained = model, bool(model.unit.any())
        self.cache = WordCache(self._build, self._reset, lambda at: (self.sums.keep(at), self.counts.keep(at)))

    def _reset(self) -> None:
        self.sums, self.counts = Grow(np.float64), Grow(np.float64)

    def _build(self, words: list[bytes]) -> None:
        s, c = self.model.margins(words)
        self.sums.extend(s)
        self.counts.extend(c)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.trained:
            return np.full(len(texts), self.model.prior)
        at, begin = self.cache.number([t.split() for t in texts])
        _, _, doc, mean = windows(self.sums.a[at], self.counts.a[at], begin)
        margin, _ = pooled(mean, doc, len(texts))
        p = 1 / (1 + np.exp(-(margin + self.model.bias)))
        return np.where(np.diff(begin) > 0, p, self.model.prior)


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[bytes], list[int], float]:
    """The bounded training sample and the share of label 1 among all training rows."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).filter("i is not null and y in (0, 1)")
    known = known.groupBy("i").agg(F.max("y").alias("y")).filter(~held_out(F.col("i")))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], [], 0.5
    first = [known.filter(F.col("y") == y).orderBy(F.xxhash64("i", F.lit(2)), "i").limit(TRAIN_ROWS) for y in (0, 1)]
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter(F.octet_length("t") <= TRAIN_BYTES)
    # the sample is bounded, so it goes to the documents and no text is shuffled before it is thinned
    rows = d.join(F.broadcast(first[0].unionByName(first[1])), "i").groupBy("i", "y").agg(F.min("t").alias("t")).collect()
    rows.sort(key=lambda r: (r["i"], r["t"]))
    return [r["t"].encode() for r in rows], [r["y"] for r in rows], counts.get(1, 0) / sum(counts.values())


def _scores(broadcast):
    def run(batches) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(broadcast.value)
        for part, texts in chunked(batches, 1):
            p = scorer.scores(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    spark = df.sparkSession
    ship(spark)
    d = df.select(F.col(id_col).cast("long"), F.col(text_col), held_out(F.col(id_col)).alias("held_out"))
    return d.mapInArrow(_scores(spark.sparkContext.broadcast(model)), SCHEMA)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    texts, labels, prior = sample(docs, read(spark, sf_dir, "labels"))
    return score(docs, train(texts, labels, prior))
