"""Sum-of-squares online packing of token sequences.

A document (its ids and an end id) longer than a window fills whole windows; what remains
is placed online.  Partially filled windows are counted in an array of LEVELS fill levels,
and a piece goes where the sum of the squared counts becomes least: whole into the window
on top of some level, into an empty window, or, as documents may be cut, with its first
part filling such a window to the last token and the rest placed again in the same way.
A cut counts CUT more.  A placement looks at each level once, whatever the number of
windows, and as two windows of one level cost more than a cut, about as many windows as
levels stay open.

Each input partition packs by itself, in one pass and without a shuffle.  At its end the
pieces in open windows are placed once more by the same rule, the longest first, with an
empty window only where none is open.  The last window is cut into sequences of
power-of-two lengths, which need no padding.  Sequence ids carry the partition's number in
their high bits, so they are unique and a repeated task gives the same ids.

Null text: the end id alone.  Empty tables give no rows.  Repeated rows are packed as
often as they come.  Very long texts are tokenised word by word and never cut short.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RaggedCache, chunked, flat, ship, ship_file, shipped_file

WINDOW, END_ID = 2048, 1
#: Fill levels of a window, and what a cut adds to the sum of squares.
LEVELS, CUT = 32, 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: ASCII punctuation that may end a word; no apostrophe, which can begin a token of its own.
TAIL = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Words that a worker keeps: encoding is the larger part of this operator's work, and a word takes some 200 bytes.
PACK_WORDS = 1_000_000
#: Words that are encoded as one text, and texts in one call.
BULK, CALL = 50, 100


def word_encoder(path: str):
    """Encodes single words with a file of the tokenizers library.

    This tokenizer lower-cases, drops white space and splits letters from punctuation
    before it merges, so a text's ids are those of its words in a row.  A word of letters
    is one merge unit, with punctuation behind it two; such words are encoded many at a
    time and cut apart at the ids that end a unit.  Where the number of units is not the
    one expected, and for all other words, each word is encoded by itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    vocabulary = t.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = b"\n".join(words).decode("utf-8", "replace").split("\n")
        units = np.fromiter(map(str.isalpha, whole), np.int64, len(words))
        for k in np.flatnonzero(units == 0).tolist():
            w = whole[k]
            if w.rstrip(TAIL).isalpha() and "<|" not in w:
                units[k] = 2
        plain = np.flatnonzero(units)
        lens, starts, parts, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        odd = np.flatnonzero(units == 0).tolist()
        bulks = [plain[i : i + BULK] for i in range(0, len(plain), BULK)]
        for i in range(0, len(bulks), CALL):
            some = bulks[i : i + CALL]
            found = t.encode_batch_fast([" ".join([whole[k] for k in x.tolist()]) for x in some], add_special_tokens=False)
            for x, e in zip(some, found, strict=True):
                ids = np.array(e.ids, np.int32)
                cuts = np.flatnonzero(ends[ids]) + 1
                upto = np.cumsum(units[x])
                if len(cuts) != upto[-1] or cuts[-1] != len(ids):
                    odd += x.tolist()
                    continue
                stop = cuts[upto - 1]
                begin = np.concatenate(([0], stop[:-1]))
                lens[x], starts[x] = stop - begin, at + begin
                parts.append(ids)
                at += len(ids)
        if odd:
            values, n = flat([e.ids for e in t.encode_batch_fast([whole[k] for k in odd], add_special_tokens=False)])
            lens[odd], starts[odd] = n, at + np.cumsum(n) - n
            parts.append(values)
        values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        upto = np.cumsum(lens)
        return values[np.repeat(starts - (upto - lens), lens) + np.arange(int(lens.sum()))], lens

    return encode


_CACHES: dict[str, RaggedCache] = {}


def worker_cache(path: str) -> RaggedCache:
    """The word cache of this Python worker, kept from task to task; its size is bounded."""
    if path not in _CACHES:
        _CACHES[path] = RaggedCache(word_encoder(path), PACK_WORDS)
    return _CACHES[path]


class SumOfSquares:
    """Packs pieces (doc_id, start, ids, doc_tokens); closed windows come out of :meth:`closed`."""

    def __init__(self, window: int = WINDOW, first_sequence: int = 0, levels: int = LEVELS):
        self.window, self.next = window, first_sequence
        self.grain = -(-window // levels)
        self.count = [0] * (levels + 1)
        #: by level: windows as [tokens, pieces]
        self.open: list[list[list]] = [[] for _ in self.count]
        self.out: list[tuple] = []

    def level(self, tokens: int) -> int:
        return -(-tokens // self.grain)

    def add(self, doc_id, ids: np.ndarray) -> None:
        n = len(ids)
        full = n - n % self.window
        for at in range(0, full, self.window):
            self._close([(doc_id, at, ids[at : at + self.window], n)])
        if n > full:
            self._place((doc_id, full, ids[full:], n))

    def choose(self, n: int, fresh: bool = True) -> int:
        """The level whose top window takes a piece of n tokens; 0: an empty window (if ``fresh``)."""
        w, count = self.window, self.count
        best, least = 0, 2 * count[self.level(n)] + 1 if fresh else None
        for h, windows in enumerate(self.open):
            if not windows:
                continue
            total = windows[-1][0] + n
            change = 1 - 2 * count[h]
            if total != w:
                to = self.level(total if total < w else total - w)
                change += 2 * (count[to] - (to == h)) + 1
            if total > w:
                change += CUT
            if least is None or change < least:
                best, least = h, change
        return best

    def _place(self, piece: tuple, fresh: bool = True) -> None:
        doc_id, start, ids, total = piece
        while len(ids):
            h = self.choose(len(ids), fresh)
            if h:
                target = self.open[h].pop()
                self.count[h] -= 1
            else:
                target = [0, []]
            room = self.window - target[0]
            target[1].append((doc_id, start, ids[:room], total))
            target[0] += min(len(ids), room)
            start, ids = start + room, ids[room:]
            if target[0] == self.window:
                self._close(target[1])
            else:
                level = self.level(target[0])
                self.open[level].append(target)
                self.count[level] += 1

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def flush(self) -> None:
        """Place what is in open windows again, an empty window only where none is open, and close the last."""
        rest = [piece for windows in self.open for _, pieces in windows for piece in pieces]
        self.count = [0] * len(self.count)
        self.open = [[] for _ in self.count]
        for piece in sorted(rest, key=lambda p: -len(p[2])):
            self._place(piece, fresh=not any(self.count))
        last = [piece for windows in self.open for _, pieces in windows for piece in pieces]
        self.open = [[] for _ in self.count]
        self.count = [0] * len(self.count)
        total = sum(len(p[2]) for p in last)
        sizes = [1 << b for b in range(total.bit_length(), -1, -1) if total >> b & 1]
        fill: list[tuple] = []
        room = sizes.pop(0) if sizes else 0
        for doc_id, start, ids, n in last:
            while len(ids):
                cut = min(room, len(ids))
                fill.append((doc_id, start, ids[:cut], n))
                start, ids, room = start + cut, ids[cut:], room - cut
                if not room:
                    self._close(fill)
                    fill, room = [], sizes.pop(0) if sizes else 0

    def closed(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _packer(name: str, window: int, end_id: int):
    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
        cache = worker_cache(shipped_file(name))
        packer = SumOfSquares(window, TaskContext.get().partitionId() << 32)
        for part, texts in chunked(batches, 1):
            tokens, begin, _, _ = cache.tokens([(t if b"<|" in t else t.lower()).split() for t in texts])
            for k, doc_id in enumerate(part.column(0).to_pylist()):
                ids = np.empty(begin[k + 1] - begin[k] + 1, np.int32)
                ids[:-1] = tokens[begin[k] : begin[k + 1]]
                ids[-1] = end_id
                packer.add(doc_id, ids)
            if rows := packer.closed():
                yield batch_of(rows)
        packer.flush()
        if rows := packer.closed():
            yield batch_of(rows)

    return run


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document; ``tokenizer`` is a path on the driver."""
    spark = df.sparkSession
    ship(spark)
    d = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_packer(ship_file(spark, tokenizer), window, end_id), SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
