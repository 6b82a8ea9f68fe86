"""Shared helpers: code shipping, shared scratch tables, words and word caches."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, count, islice
from pathlib import Path

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one numpy pass handles in a Python worker.
CHUNK_BYTES = 2 << 20
#: Distinct words that a worker's cache may hold before all but its often used ones go.
CACHE_WORDS = 250_000
#: Rows that travel to a Python worker at once: texts are long, and a batch is held twice.
BATCH_ROWS = 500
#: Rows up to which a narrow table is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 100_000


BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def trim() -> None:
    """Give freed memory back, as Python workers are kept for later tasks."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application; keep Arrow batches small."""
    sc = spark.sparkContext
    if int(spark.conf.get(BATCH_SETTING)) > BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    if getattr(sc, "_larkspar_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="larkspar")
    archive = os.path.join(folder, "larkspar_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(archive)
    sc._larkspar_shipped = True


def ship_file(spark: SparkSession, path: str) -> str:
    """Send a driver-side file (a vocabulary) to the executors; returns its name there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def shipped_file(name: str) -> str:
    """Where an executor finds a file sent by :func:`ship_file`."""
    return SparkFiles.get(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Only a local master may go without it; there a temporary folder is set.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="larkspar-shared"))
    return sc.getCheckpointDir()


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        self.names.add(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in self.names & {*names}:
            self.names.discard(name)
            p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def result(self, df: DataFrame) -> DataFrame:
        """The table, written; all others are dropped."""
        others = tuple(self.names)
        df = self.write(df, "result")
        self.drop(*others)
        return df


def few(df: DataFrame) -> DataFrame:
    """The table, marked for broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 5, is 0; a null doc_id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def chunked(batches: Iterable, text_at: int) -> Iterator[tuple[list, list[bytes]]]:
    """Slices of Arrow batches with their texts as bytes (null: empty), about CHUNK_BYTES each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(text_at)
            lengths = np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64)
            upto, start = np.cumsum(lengths), 0
            while start < batch.num_rows:
                base = upto[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(upto, base + CHUNK_BYTES, "right")))
                part = batch.slice(start, stop - start)
                kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
                yield part, [x or b"" for x in part.column(text_at).cast(kind).to_pylist()]
                start = stop
    finally:
        trim()


class Grow:
    """A numpy array that grows by doubling."""

    def __init__(self, dtype, width: int | None = None):
        self.n, self.a = 0, np.zeros((1024,) if width is None else (1024, width), dtype)

    def extend(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.a):
            new = np.zeros((max(2 * len(self.a), self.n + len(x)), *self.a.shape[1:]), self.a.dtype)
            new[: self.n] = self.a[: self.n]
            self.a = new
        self.a[self.n : self.n + len(x)] = x
        self.n += len(x)

    def keep(self, at: np.ndarray) -> None:
        """Only the rows ``at`` stay, in that order."""
        self.a = self.a[at] if len(at) else self.a[:1024]
        self.n = len(at)


class WordCache:
    """Numbers words; ``build`` is called once for each word that is not yet known.

    When it holds more than ``most`` words (CACHE_WORDS if not given), those that came up only
    once go, and of the others at most half of that number stay, the most used first (an older use counts half
    of a later one).  So its memory is bounded, frequent words are built once however long
    a task runs, and results never depend on it.  ``keep`` drops the values of all words
    but those at the given numbers.
    """

    def __init__(self, build: Callable[[list[bytes]], None], reset: Callable[[], None], keep: Callable[[np.ndarray], None], most: int | None = None):
        self.most = most
        self.ids: dict[bytes, int] = defaultdict(count().__next__)
        self.build, self.keep = build, keep
        self.uses = Grow(np.float32)
        reset()

    def _age(self) -> None:
        uses, half = self.uses.a[: self.uses.n], (self.most or CACHE_WORDS) // 2
        at = np.flatnonzero(uses >= 2)
        if len(at) > half:
            at = np.sort(at[np.argsort(-uses[at], kind="stable")[:half]])
        words = list(self.ids)
        self.ids = defaultdict(count(len(at)).__next__, ((words[i], k) for k, i in enumerate(at.tolist())))
        self.uses.keep(at)
        self.uses.a[: self.uses.n] /= 2
        self.keep(at)

    def number(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers, one document after the other, and where each document begins."""
        counts = np.fromiter(map(len, docs), np.int64, len(docs))
        offsets = np.concatenate(([0], np.cumsum(counts)))
        if len(self.ids) > (self.most or CACHE_WORDS):
            self._age()
        words = list(chain.from_iterable(docs))
        known = len(self.ids)
        at = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        if len(self.ids) > known:  # a word not seen before got the next number
            new = list(islice(self.ids, known, None))
            self.build(new)
            self.uses.extend(np.zeros(len(new), np.float32))
        self.uses.a[: self.uses.n] += np.bincount(at, minlength=self.uses.n)
        return at, offsets


class RaggedCache:
    """A word cache whose value for each word is an array of ids.

    ``encode`` gives the ids of many words in a row and how many each word has.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int | None = None):
        self.encode = encode
        self.cache = WordCache(self._build, self._reset, self._keep, most)

    def _reset(self) -> None:
        self.values, self.starts, self.lens = Grow(np.int32), Grow(np.int64), Grow(np.int64)

    def _keep(self, at: np.ndarray) -> None:
        values, lens = self._gather(at)
        self._reset()
        self._add(values, lens)

    def _add(self, values: np.ndarray, lens: np.ndarray) -> None:
        self.starts.extend(self.values.n + np.cumsum(lens) - lens)
        self.lens.extend(lens)
        self.values.extend(values)

    def _build(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 20_000):
            self._add(*self.encode(words[i : i + 20_000]))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.lens.a[at]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        return self.values.a[np.repeat(self.starts.a[at] - (ends - lens), lens) + np.arange(total)], lens

    def tokens(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of all documents in a row, where each document's begin, and the same of word numbers."""
        at, offsets = self.cache.number(docs)
        values, lens = self._gather(at)
        return values, np.concatenate(([0], np.cumsum(lens)))[offsets], at, offsets


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array, and their lengths."""
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(lens.sum())), lens
