"""Language ID: a bidirectional gated recurrent network over bytes.

The network runs over words (A-Z lower-cased, in pieces of at most PIECE bytes, cut between
characters): a forward
and a backward gated recurrent unit read the bytes, and a softmax over both states labels
every position.  A document's probabilities are the mean over all its positions; words
without a letter have none.  Words are independent of each other, so each distinct word
runs once per task and its summed probabilities are reused; every byte of every text
counts.

Training is backpropagation through time in numpy on the driver, on a bounded sample:
about SAMPLE_DOCS documents per language (fewer if all languages together have more than
SAMPLE_ALL), chosen by hash, TRAIN_WORDS words of each, and STEPS batches of BATCH
pieces of words drawn evenly over the languages.  Any number of languages can be learned.

Null texts and texts without a letter are 'und' with score 0.  With no labelled text
every document is 'und' with score 0; a single language is predicted with score 1.
Repeated rows are labelled alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Grow, WordCache, chunked, few, held_out, read, ship

HIDDEN, PIECE = 16, 32
SAMPLE_DOCS, SAMPLE_ALL, TRAIN_WORDS, WORD_CHARS = 400, 16_000, 600, 64
STEPS, BATCH = 400, 256
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def cuts(word: bytes) -> list[bytes]:
    """The word in pieces of at most PIECE bytes, cut before a byte that begins a character."""
    out = []
    while len(word) > PIECE:
        at = next((k for k in range(PIECE, PIECE - 4, -1) if word[k] & 0xC0 != 0x80), PIECE)
        out.append(word[:at])
        word = word[at:]
    return [*out, word]


def pieces(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte matrix, lengths, word) of all words, in pieces of at most PIECE bytes."""
    cut = [(x, k) for k, w in enumerate(words) for x in (cuts(w) if len(w) > PIECE else (w,))]
    lens = np.fromiter((len(w) for w, _ in cut), np.int64, len(cut))
    width = int(lens.max()) if len(lens) else 1
    flat = np.frombuffer(b"".join(w for w, _ in cut), np.uint8)
    out = np.zeros((len(cut), width), np.uint8)
    out[np.arange(width)[None, :] < lens[:, None]] = flat
    return out, lens, np.fromiter((k for _, k in cut), np.int64, len(cut))


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One gated recurrent unit; byte inputs are rows of its input weights."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        h = hidden
        self.h = h
        self.w = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
        self.u = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
        self.b = np.zeros(3 * h, np.float32)

    @property
    def params(self):
        return [self.w, self.u, self.b]

    def forward(self, x: np.ndarray, live: np.ndarray, keep: list | None) -> np.ndarray:
        """States after each position; rows are sorted by length and row count live[t] runs at t."""
        n, t_max = x.shape
        h = self.h
        states = np.zeros((t_max, n, h), np.float32)
        wb = self.w + self.b
        s = np.zeros((n, h), np.float32)
        for t in range(t_max):
            m = live[t]
            a = wb[x[:m, t]]
            old = s[:m]
            zr = sigmoid(a[:, : 2 * h] + old @ self.u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(a[:, 2 * h :] + (r * old) @ self.u[:, 2 * h :])
            new = old + z * (c - old)
            if keep is not None:
                keep.append((old.copy(), z, r, c))
            s[:m] = new
            states[t, :m] = new
        return states

    def backward(self, x, live, keep, d_states):
        """Gradients of w, u and b through time."""
        h = self.h
        dw, du, db = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.b)
        ds = np.zeros((x.shape[0], h), np.float32)
        for t in reversed(range(x.shape[1])):
            m = live[t]
            old, z, r, c = keep[t]
            d = ds[:m] + d_states[t, :m]
            dc = d * z * (1 - c * c)
            dz = d * (c - old) * z * (1 - z)
            dro = dc @ self.u[:, 2 * h :].T
            dr = dro * old * r * (1 - r)
            da = np.concatenate((dz, dr, dc), 1)
            np.add.at(dw, x[:m, t], da)
            db += da.sum(0)
            du[:, : 2 * h] += old.T @ da[:, : 2 * h]
            du[:, 2 * h :] += (r * old).T @ dc
            ds[:m] = d * (1 - z) + dro * r + da[:, : 2 * h] @ self.u[:, : 2 * h].T
        return [dw, du, db]


class Model:
    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.both = [Direction(rng, hidden), Direction(rng, hidden)]
        self.v = rng.normal(0, 0.3, (2 * hidden, len(langs))).astype(np.float32)
        self.c = np.zeros(len(langs), np.float32)

    @property
    def params(self):
        return [*self.both[0].params, *self.both[1].params, self.v, self.c]

    def run(self, x: np.ndarray, lens: np.ndarray, keep=None):
        """Probabilities (position, row, language) of rows sorted by falling length."""
        live = (lens[None, :] > np.arange(x.shape[1])[:, None]).sum(1)
        place = np.arange(x.shape[1])[None, :]
        back = np.where(place < lens[:, None], lens[:, None] - 1 - place, 0)
        turned = np.take_along_axis(x, back, 1)
        kept = ([], []) if keep is not None else (None, None)
        ahead = self.both[0].forward(x, live, kept[0])
        behind = self.both[1].forward(turned, live, kept[1])
        behind = np.take_along_axis(behind, back.T[:, :, None], 0)
        both = np.concatenate((ahead, behind), 2)
        logit = both @ self.v + self.c
        e = np.exp(logit - logit.max(2, keepdims=True))
        p = e / e.sum(2, keepdims=True)
        if keep is not None:
            keep.update(live=live, back=back, turned=turned, kept=kept, both=both)
        return p

    def gradients(self, x, lens, y):
        keep: dict = {}
        p = self.run(x, lens, keep)
        inside = (np.arange(x.shape[1])[:, None] < lens[None, :]).astype(np.float32)
        d = p.copy()
        d[:, np.arange(len(y)), y] -= 1
        d *= (inside / inside.sum())[:, :, None]
        h = self.both[0].h
        d_both = d @ self.v.T
        d_behind = np.zeros_like(d_both[:, :, h:])
        rows = np.broadcast_to(np.arange(len(y))[None, :], keep["back"].T.shape)
        np.add.at(d_behind, (keep["back"].T, rows), d_both[:, :, h:] * inside[:, :, None])
        g = self.both[0].backward(x, keep["live"], keep["kept"][0], d_both[:, :, :h] * inside[:, :, None])
        g += self.both[1].backward(keep["turned"], keep["live"], keep["kept"][1], d_behind)
        flat = keep["both"].reshape(-1, 2 * h)
        g += [flat.T @ d.reshape(-1, d.shape[2]), d.sum((0, 1))]
        loss = -float((np.log(p[:, np.arange(len(y)), y] + 1e-9) * inside).sum() / inside.sum())
        return loss, g

    def word_sums(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of position probabilities and number of positions of each word."""
        out = np.zeros((len(words), len(self.langs)))
        x, lens, word = pieces(words)
        for part in np.array_split(np.argsort(-lens, kind="stable"), max(1, len(lens) // 4096)):
            if not len(part):
                continue
            n = lens[part]
            p = self.run(x[part, : n[0]], n)
            p *= (np.arange(n[0])[:, None] < n[None, :])[:, :, None]
            np.add.at(out, word[part], p.sum(0))
        return out, np.bincount(word, lens, len(words))


def train(texts: list[str], langs: list[str], steps: int = STEPS, seed: int = 6) -> Model | None:
    """Adam on batches of words drawn evenly over the languages; None without examples."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    words_of: dict[str, list[bytes]] = {name: [] for name in names}
    for t, x in zip(texts, langs, strict=True):
        words_of[x] += [w.lower() for w in t.encode().split() if has_letter(w)]
    by = [words_of[name] for name in names]
    names = [n for n, words in zip(names, by, strict=True) if words]
    by = [words for words in by if words]
    if not names:
        return None
    model = Model(names, seed=seed)
    if len(names) == 1:
        return model
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.params]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(names), BATCH)
        words = [(parts := cuts(by[k][rng.integers(len(by[k]))]))[rng.integers(len(parts))] for k in y]
        x, lens, _ = pieces(words)
        order = np.argsort(-lens, kind="stable")
        _, grads = model.gradients(x[order], lens[order], y[order])
        rate = 0.01 * min(1.0, 2 * (1 - (step - 1) / steps))
        for p, g, (m, v) in zip(model.params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))


class Labeller:
    def __init__(self, model: Model):
        self.model = model
        self.cache = WordCache(self._build, self._reset, lambda at: (self.sums.keep(at), self.places.keep(at)))

    def _reset(self) -> None:
        self.sums, self.places = Grow(np.float32, len(self.model.langs)), Grow(np.int64)

    def _build(self, words: list[bytes]) -> None:
        sums, places = np.zeros((len(words), len(self.model.langs))), np.zeros(len(words), np.int64)
        at = [k for k, w in enumerate(words) if has_letter(w)]
        if at:
            sums[at], places[at] = self.model.word_sums([words[k] for k in at])
        self.sums.extend(sums)
        self.places.extend(places)

    def label(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        at, begin = self.cache.number([t.lower().split() for t in texts])
        upto = np.concatenate((np.zeros((1, len(self.model.langs))), np.cumsum(self.sums.a[at], axis=0, dtype=np.float64)))
        places = np.concatenate(([0], np.cumsum(self.places.a[at])))
        n = places[begin[1:]] - places[begin[:-1]]
        p = (upto[begin[1:]] - upto[begin[:-1]]) / np.maximum(n, 1)[:, None]
        best = p.argmax(1)
        names = [self.model.langs[b] if k else "und" for b, k in zip(best, n, strict=True)]
        return names, np.where(n > 0, np.clip(p[np.arange(len(n)), best], 0, 1), 0.0)


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[str]]:
    """About SAMPLE_DOCS training documents of each language, by hash, and SAMPLE_ALL in all; of each TRAIN_WORDS words from anywhere in its text, by hash.

    Words longer than WORD_CHARS are drawn in parts of that length.
    """
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).filter("l is not null and t is not null").filter(~held_out(F.col("i")))
    counts = d.groupBy("l").agg(F.count("*").alias("n")).withColumnRenamed("l", "of")
    many = counts.count()
    if not many:
        return [], []
    line = counts.withColumn("line", F.lit(min(SAMPLE_DOCS, SAMPLE_ALL / many) * float(1 << 20)) / F.col("n"))
    d = d.join(few(line), F.col("l") == F.col("of")).filter(F.pmod(F.xxhash64("i", "t", F.lit(6)), F.lit(1 << 20)) < F.col("line"))
    parts = F.regexp_extract_all("t", F.lit(rf"([^\x20\x09-\x0D]{{1,{WORD_CHARS}}})"), F.lit(1))
    drawn = F.slice(F.sort_array(F.transform(parts, lambda w, k: F.struct(F.xxhash64(w, k).alias("h"), w.alias("w")))), 1, TRAIN_WORDS)
    rows = d.select("i", F.array_join(F.transform(drawn, lambda x: x["w"]), " ").alias("t"), "l").distinct().collect()
    rows.sort(key=lambda r: (r["i"] is None, r["i"] or 0, r["t"], r["l"]))
    return [r["t"] for r in rows], [r["l"] for r in rows]


def _labels(broadcast):
    def run(batches) -> Iterator:
        import pyarrow as pa

        model = broadcast.value
        labeller = Labeller(model) if model else None
        for part, texts in chunked(batches, 1):
            names, p = labeller.label(texts) if labeller else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(names, pa.string()), pa.array(p, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = df.sparkSession
    ship(spark)
    d = df.select(F.col(id_col).cast("long"), F.col(text_col), held_out(F.col(id_col)).alias("held_out"))
    return d.mapInArrow(_labels(spark.sparkContext.broadcast(model)), SCHEMA)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict(docs, train(*sample(docs)))
