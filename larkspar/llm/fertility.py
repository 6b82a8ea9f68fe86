"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback encodes every word of a text (words are encoded one
by one, as its pieces never cross white space, so each distinct word is encoded once per
task).  Three measures follow: characters per token, the share of byte-fallback tokens and
the entropy of the text's tokens as a share of the most that so many tokens can have.  A
text is rejected outside its band; there is one band for each language, and one for each
script of the texts without a language.

Bands are fitted on the table itself, on all texts that pass the base rules (fewer than 10
words, or more than a fifth of all words inside repeated 5-word windows, fail them).  The
middle of a band is the median of its texts.  A measure of n tokens scatters with the root
of n, so distances from the middle are compared times that root: the limit is REACH times
their quartile distance, which shrinks to PRIOR for bands of few texts, plus FLOOR.  So a
short text has wide limits and a long one narrow ones, without a length at which rules
change.  Medians and quartiles come from counts of values in fixed steps: they are exact
up to a step, do not depend on the order of rows and hold a few thousand counts per band.

Null or empty texts have no words: all counts are 0 and they fail the base rule.  A null
or empty language counts as none.  Repeated rows get equal rows; extra columns are ignored
(:func:`filter_docs` passes them through).  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, RaggedCache, Scratch, chunked, few, flat, ship, ship_file, shipped_file

MEASURED = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_tokens long, chars_per_token double, byte_share double, token_entropy double, band string"
)
SYMBOLS, BLANKS = b"#*$%&|<>", b" \t\n\r\x0b\x0c"
WINDOW = 5
#: Quartile distances that a text may be away from its band's middle, by measure.
REACH = {"chars": 4.0, "bytes": 4.0, "fill": 8.0}
#: Quartile distance (times the root of the tokens) before any text is seen, worth so many texts.
PRIOR, PRIOR_TEXTS = {"chars": 1.2, "bytes": 1.0, "fill": 0.5}, 20
#: What every text may be away, and the steps in which values and distances are counted.
FLOOR, STEPS = {"chars": 0.02, "bytes": 0.02, "fill": 0.0}, {"middle": 0.001, "spread": 0.01}
#: Code point ranges of the scripts that have bands.
SCRIPTS = [("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("cjk", 0x3040, 0x30FF), ("cjk", 0x3400, 0x9FFF), ("cjk", 0xAC00, 0xD7AF)]


def script_of(text: str) -> str:
    """The script most of the letters belong to; 'other' without letters."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    points = points[(points > 0x7F) | ((points | 32) >= 0x61) & ((points | 32) <= 0x7A)]
    if not len(points):
        return "other"
    found: dict[str, int] = {}
    for name, low, high in SCRIPTS:
        found[name] = found.get(name, 0) + int(((points >= low) & (points <= high)).sum())
    best = max(found, key=lambda k: found[k])
    return best if 2 * found[best] >= len(points) else "other"


def piece_encoder(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    encode = lambda words: flat(sp.encode([w.decode("utf-8", "replace") for w in words], num_threads=1))
    return encode, np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])


def repeated_words(words: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """By document: words inside 5-word windows that the document has at least twice."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(len(begin) - 1, np.int64)
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    key = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = key[: n - WINDOW + 1].copy()
    for k in range(WINDOW):
        key ^= words[k : n - WINDOW + 1 + k].astype(np.uint64) + np.uint64(k + 1)
        key *= np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    at = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(n + 1, np.int64)
    starts = order[twice]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    return covered[begin[1:]] - covered[begin[:-1]]


def entropy(tokens: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Bits of each document's token distribution."""
    n = np.diff(begin)
    doc = np.repeat(np.arange(len(n)), n)
    cells, counts = np.unique((doc.astype(np.int64) << 20) | tokens, return_counts=True)
    of = cells >> 20
    p = counts / n[of]
    return np.bincount(of, -p * np.log2(p), len(n)) + 0.0


class Meter:
    """Measures documents given as UTF-8 bytes."""

    def __init__(self, path: str):
        encode, self.is_byte = piece_encoder(path)
        self.cache = RaggedCache(encode)

    def measure(self, texts: list[bytes], langs: list[str | None]) -> dict[str, list]:
        docs = [t.split() for t in texts]
        tokens, begin, words, word_begin = self.cache.tokens(docs)
        n_words = np.diff(word_begin)
        n_tokens = np.diff(begin)
        chars = np.array([len(t.decode("utf-8", "replace")) - (len(t) - len(t.translate(None, BLANKS))) for t in texts], np.int64)
        symbols = [len(t) - len(t.translate(None, SYMBOLS)) for t in texts]
        dup_lines = []
        for t in texts:
            lines = [x for x in t.split(b"\n") if x.strip(BLANKS)]
            dup_lines.append(len(lines) - len(set(lines)))
        repeated = repeated_words(words, word_begin)
        failed = (n_words < 10) | (100 * repeated > 20 * n_words)
        byte_sum = np.concatenate(([0], np.cumsum(self.is_byte[tokens])))
        some = np.maximum(n_tokens, 1)
        per_token = chars / some
        byte_share = (byte_sum[begin[1:]] - byte_sum[begin[:-1]]) / some
        bits = entropy(tokens, begin)
        names = [lang or script_of(t.decode("utf-8", "replace")) for lang, t in zip(langs, texts, strict=True)]
        return {
            "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeated, "base_failed": failed,
            "n_tokens": n_tokens, "chars_per_token": per_token, "byte_share": byte_share, "token_entropy": bits, "band": names,
        }


def _measures(name: str, text_at: int, lang_at: int):
    """Adds the measures to all columns."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        meter = Meter(shipped_file(name))
        for part, texts in chunked(batches, text_at):
            found = meter.measure(texts, part.column(lang_at).to_pylist())
            columns = [*part.columns, *(pa.array(x) for x in found.values())]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(part.columns))] + list(found))

    return run


def measured(df: DataFrame, vocabulary: str, text_at: int, lang_at: int) -> DataFrame:
    """All columns, named c0, c1 and so on, and the measures of the text."""
    spark = df.sparkSession
    ship(spark)
    columns = [T.StructField(f"c{k}", f.dataType, True) for k, f in enumerate(df.schema.fields)]
    schema = T.StructType([*columns, *T.StructType.fromDDL(MEASURED).fields])
    return df.toDF(*(f.name for f in columns)).mapInArrow(_measures(ship_file(spark, vocabulary), text_at, lang_at), schema)


def _value(measure: str) -> Column:
    return {
        "chars": F.col("chars_per_token"),
        "bytes": F.col("byte_share"),
        "fill": F.col("token_entropy") / F.log2(F.greatest(F.col("n_tokens"), F.lit(2)).cast("double")),
    }[measure]


def _quantiles(df: DataFrame, value: dict[str, Column], step: float) -> DataFrame:
    """(band, measure, texts, q1, q2, q3): quartiles of each measure, from counts of its values in steps."""
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.round(v / step).cast("long").alias("cell")) for m, v in value.items()])
    counts = df.select("band", F.explode(cells).alias("x")).groupBy("band", "x.measure", "x.cell").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("band", "measure")
    upto = F.sum("n").over(whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("upto", upto).withColumn("texts", F.sum("n").over(whole))
    at = lambda q: (F.min(F.when(4 * F.col("upto") >= q * F.col("texts"), F.col("cell"))) * F.lit(step)).alias(f"q{q}")
    return counts.groupBy("band", "measure").agg(F.max("texts").alias("texts"), at(1), at(2), at(3))


def fit(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The bands: (band, chars, chars_spread, bytes, bytes_spread, fill, fill_spread).

    The middle of each measure, and the distance from it, times the root of the tokens, that is allowed.
    """
    texts = texts.filter("not base_failed and n_tokens > 0")
    middle = _quantiles(texts, {m: _value(m) for m in REACH}, STEPS["middle"]).groupBy("band").pivot("measure", list(REACH)).agg(F.first("q2"))
    middle = scratch.write(middle, "middle")
    far = texts.select("band", "n_tokens", *[_value(m).alias(f"of_{m}") for m in REACH]).join(few(middle), "band")
    root = F.sqrt(F.col("n_tokens").cast("double"))
    spread = _quantiles(far, {m: (F.col(f"of_{m}") - F.col(m)) * root for m in REACH}, STEPS["spread"])
    by = lambda d: F.element_at(F.create_map(*[F.lit(x) for m in REACH for x in (m, d[m])]), F.col("measure"))
    distance = (F.col("texts") * (F.col("q3") - F.col("q1")) + PRIOR_TEXTS * by(PRIOR)) / (F.col("texts") + PRIOR_TEXTS)
    spread = spread.withColumn("spread", by(REACH) * distance).groupBy("band").pivot("measure", list(REACH)).agg(F.first("spread"))
    return scratch.write(middle.join(spread.toDF("band", *(f"{m}_spread" for m in REACH)), "band"), "bands")


def judge(texts: DataFrame, bands: DataFrame) -> DataFrame:
    """Adds ``kept``: whether a text passes the base rules and lies within its band."""
    root = F.sqrt(F.col("n_tokens").cast("double"))
    within = F.lit(True)
    for m in REACH:
        within = within & (F.abs(_value(m) - F.col(m)) <= F.col(f"{m}_spread") / root + FLOOR[m])
    texts = texts.join(few(bands), "band", "left")
    return texts.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True)))


def score(df: DataFrame, vocabulary: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts, measures and verdict of every document; ``vocabulary`` is a path on the driver."""
    d = df.select(F.col(id_col).cast("long"), F.col(text_col), F.col(lang_col).cast("string"))
    texts = scratch.write(measured(d, vocabulary, 1, 2).drop("c1", "c2"), "measured")
    found = judge(texts, fit(texts, scratch)).withColumnRenamed("c0", "doc_id")
    return scratch.result(found.select("doc_id", *[c.split()[0] for c in MEASURED.split(", ")][:6], "kept", "n_tokens", "chars_per_token", "byte_share", "token_entropy", "band"))


def filter_docs(df: DataFrame, vocabulary: str, scratch: Scratch, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that are kept, with all their columns.

    A verdict depends on text and language alone.  The measures are written without the
    texts; rejected documents are then known by 128 bits of hash and left out by a broadcast
    anti-join if they are few, or else by measuring once more, so texts are never shuffled.
    """
    at = df.columns.index
    lang = F.col(lang_col).cast("string")
    number = lambda d: [F.xxhash64(d[text_col], d[lang_col].cast("string")), F.xxhash64(F.lit(3), d[lang_col].cast("string"), d[text_col])]
    d = df.select(number(df)[0].alias("h"), number(df)[1].alias("g"), F.col(text_col).alias("text"), lang.alias("lang"))
    texts = scratch.write(measured(d, vocabulary, 2, 3).drop("c2", "c3"), "measured")
    bands = fit(texts, scratch)
    gone = scratch.write(judge(texts, bands).filter("not kept").select("c0", "c1").distinct(), "gone")
    scratch.drop("measured", "middle")
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        h, g = number(df)
        return df.join(F.broadcast(gone), (h == gone["c0"]) & (g == gone["c1"]), "left_anti")
    kept = judge(measured(df, vocabulary, at(text_col), at(lang_col)), bands).filter("kept")
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(df.columns)])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary(), Scratch(spark, "fertility"))


def brute_force(text: str | None) -> dict[str, int]:
    """The base counts by plain loops; for tests."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - WINDOW + 1):
        windows.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    inside = {i + k for found in windows.values() if len(found) > 1 for i in found for k in range(WINDOW)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside)}
