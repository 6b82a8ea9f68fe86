"""Search over treaps gives the rows of scoring every document."""

import math
import re
from collections import Counter

import numpy as np

from larkspar.llm import treaps
from larkspar.llm.common import Scratch
from tests.compare import oracle, rows
from tests.llm.data import frame, lower, prose, texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id string, term string, score string, ids string"


def items(spark, rows):
    return spark.createDataFrame([(i, t, "d", "t", "s", "i") for i, t in rows], ITEMS)


def plain(docs, asked, k=10):
    """Sorted (item_id, rank, doc_id, score), every document scored."""
    terms = [(d, Counter(TERM.findall(lower(t)))) for d, t, *_ in docs]
    n = sum(1 for _, c in terms if c)
    total = sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item_id, words in sorted({(i, tuple(TERM.findall(lower(t)))) for i, t in asked}, key=repr):
        scores = []
        for d, c in terms:
            m = 25 + (75 * sum(c.values()) * n) // total if total else 0
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in Counter(words).items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item_id, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def asked():
    base = [(i, prose(4 + 6 * i, 300 + i)) for i in range(8)]
    return base + [(50, None), (51, ""), (52, " ... "), (53, "zzz-unknown"), (54, "one ONE one two"), (54, "日本語"), (54, "日本語"), (None, "line other"), (55, "x y " + prose(400, 9)), (56, "The the and,the"), (57, "É é über QUÉ")]


def search(spark, docs, wanted, **how):
    out = treaps.search(frame(spark, docs), items(spark, wanted), Scratch(spark, "treaps"), **how).collect()
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in out], key=repr)


def test_search_by_brute_force(spark):
    docs = texts() + [(500 + i, prose(3 + i % 17, 900 + i // 3), "en", "src0") for i in range(400)]  # each text thrice: ties
    assert search(spark, docs, asked()) == plain(docs, asked())


def test_small_blocks_groups_and_all_terms(spark, monkeypatch):
    docs = texts() + [(700 + i, prose(30, 40 + i // 2), "en", "src0") for i in range(60)]
    monkeypatch.setattr(treaps, "GROUP", 4)
    monkeypatch.setattr(treaps, "WANTED", 5)
    monkeypatch.setattr(treaps, "SALTS", 2)
    assert search(spark, docs, asked(), k=3) == plain(docs, asked(), k=3)


def test_blocks_keep_whole_documents(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(treaps, "BLOCK_POSTINGS", 50)
    monkeypatch.setattr(treaps, "BLOCK_DOCS", 7)
    docs = [(i, prose((i * 7) % 90, i)) for i in range(80)] + [(None, "a b"), (90, None)]
    batch = pa.record_batch([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs])], names=["doc_id", "text"])
    blocks = [b.to_pylist()[0] for b in treaps._index(None)([batch])]
    assert len(blocks) > 12 and all(len(b["ids"]) <= 7 for b in blocks)
    got = Counter()
    for b in blocks:
        at, tf, start = np.frombuffer(b["at"], np.int32), np.frombuffer(b["tf"], np.int32), 0
        for t, size in zip(b["terms"], b["sizes"], strict=True):
            assert (np.diff(at[start : start + size]) > 0).all()
            for j in range(start, start + size):
                got[b["ids"][at[j]], t] += int(tf[j])
            start += size
    assert got == Counter({(d, t): c for d, text in docs for t, c in Counter(TERM.findall(lower(text))).items()})


def test_treaps_are_search_trees_and_heaps():
    r = np.random.default_rng(4)
    for kind in (lambda n: r.integers(0, 5, n), lambda n: np.arange(n), lambda n: -np.arange(n), lambda n: np.zeros(n, int), lambda n: r.integers(0, 10**12, n)):
        sizes = [1, 2, 3, 50, 400]
        first = np.concatenate(([0], np.cumsum(sizes)))
        impact = np.concatenate([kind(n) for n in sizes])
        left, right, roots = treaps.treaps(impact, first)
        for a, b, root in zip(first[:-1], first[1:], roots):
            seen, stack = [], [(root, a, b)]
            while stack:
                at, low, high = stack.pop()
                assert low <= at < high
                top = impact[low:high].max()
                assert impact[at] == top and at == low + int(impact[low:high].argmax())  # equal impacts: the smaller id above
                seen.append(at)
                for child, x, y in ((left[at], low, at), (right[at], at + 1, high)):
                    assert (child >= 0) == (x < y)
                    if child >= 0:
                        stack.append((child, x, y))
            assert sorted(seen) == list(range(a, b))


def test_subtrees_that_cannot_enter_are_skipped():
    r = np.random.default_rng(9)
    docs, lists = 1000, 6
    postings = [np.sort(r.choice(docs, 400, replace=False)) for _ in range(lists)]
    doc = np.concatenate(postings)
    impact = (r.pareto(1.2, len(doc)) * 1000).astype(np.int64) + 1
    first = np.concatenate(([0], np.cumsum([len(p) for p in postings])))
    left, right, roots = treaps.treaps(impact, first)
    best = treaps.Best(1, 10)
    scored = treaps.walk(best, np.arange(docs), np.zeros(docs, bool), doc, impact, left, right, roots[None, :], np.ones((1, lists), np.int64))
    score = np.bincount(doc, impact, docs).astype(np.int64)
    order = np.lexsort((np.arange(docs), -score))[:10]
    assert best.id.tolist() == order.tolist() and best.score.tolist() == score[order].tolist()
    assert scored < 0.4 * docs


def test_empty_tables(spark):
    assert search(spark, [], asked()) == [] and search(spark, texts(), []) == [] and search(spark, [(1, None, None, None)], asked()) == []


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert rows(treaps.op12(spark, sf).toPandas()) == rows(oracle(treaps.OP12_SQL, sf))
