"""The pipeline against a plain version of its first three stages, and its own invariants."""

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from larkspar.llm import fertility, packing
from larkspar.llm.common import Scratch
from tests.llm import data


def test_stages_and_run(spark, tmp_path):
    rows = data.texts()
    data.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    verdict = {}
    for r in fertility.score(docs, fertility.default_vocabulary(), Scratch(spark, "t")).collect():
        verdict.setdefault((r["doc_id"], r["n_words"], r["word_chars"]), r["kept"])
    kept = [r for r in rows if verdict[r[0], len(data.words(r[1])), sum(map(len, data.words(r[1])))]]
    best = {}
    for r in kept:
        k = data.lower(r[1])
        if k not in best or (r[0] is not None and (best[k][0] is None or r[0] > best[k][0])):
            best[k] = r
    unique = list(best.values())
    comps = data.components(unique, 5, 80)
    near = [r for r, c in zip(unique, comps, strict=True) if r[0] == c]
    frames = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        frames.append(docs)
    ids = lambda f: Counter(r["doc_id"] for r in f.select("doc_id").collect())
    assert ids(frames[0]) == Counter(r[0] for r in kept) and ids(frames[1]) == Counter(r[0] for r in unique) and ids(frames[2]) == Counter(r[0] for r in near)
    mixed = ids(frames[3])
    assert set(mixed) <= set(ids(frames[2])) and max(mixed.values()) <= 3 and frames[3].columns == data.frame(spark).columns
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    tokens = {r["doc_id"]: np.array([*t.encode(r["text"], add_special_tokens=False).ids, 1], "<u4") for r in frames[3].collect()}
    pieces = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sum(p["length"] for p in pieces) == sum(len(tokens[i]) * n for i, n in mixed.items())
    assert all(zlib.crc32(tokens[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for p in pieces)
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def test_queries_import_without_spark():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names if x.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
