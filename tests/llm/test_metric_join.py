"""The metric join loses no link: components equal those of comparing all pairs."""

import random

import numpy as np
import pytest

from larkspar.llm import metric_join
from larkspar.llm.common import Scratch
from tests.llm.data import components, frame, prose, shingles, texts


def edited(words, n, r):
    words = list(words)
    for at in r.sample(range(len(words)), n):
        words[at] = f"w{r.randrange(10**6)}"
    return words


def clusters(seed=3):
    """Chains, stars and dense groups around the threshold, in several sizes."""
    r, out, i = random.Random(seed), [], 1000
    for size in (12, 14, 25, 60, 150, 400):
        for kind in range(3):
            base = prose(size, seed * 1000 + size * 10 + kind).split(" ")
            at = base
            for step in range(12):
                most = max(1, round(size * 0.1 / 3.4))
                at = edited(at if kind == 0 else base, r.randint(0, most) if kind != 1 else r.randint(0, max(1, most // 2)), r)
                if step % 4 == 3:
                    at = at + [f"tail{k}" for k in range(r.randint(0, most))]
                out.append((i, " ".join(at), "en", "src0"))
                i += 1
    return out


def joined(spark, rows, **how):
    got = metric_join.join(frame(spark, rows), Scratch(spark, "metric"), **how).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr)


def plain(rows, percent=90):
    comps = components(rows, 3, percent)
    return sorted(((d, len(shingles(t, 3)), c) for (d, t, *_), c in zip(rows, comps, strict=True)), key=repr)


@pytest.mark.parametrize("percent", [90, 80])
def test_components_by_brute_force(spark, percent):
    rows = texts() + clusters()
    assert joined(spark, rows, percent=percent) == plain(rows, percent)


def test_regions_split_by_pivots(spark, monkeypatch):
    """Small leaves, few pivots, small deals and blocks: Voronoi cells, windows and recursion carry the join."""
    for name, value in (("LEAF", 6), ("PIVOTS", 3), ("DEAL", 7), ("LEAST_BLOCK", 4), ("SHRINK", 0.95)):
        monkeypatch.setattr(metric_join, name, value)
    shared = prose(80, 77)
    r = random.Random(5)
    # one large region of several groups that share most of their words, so that one pivot links few of them
    rows = [(i, shared + " " + " ".join(edited(prose(30, 500 + i % 6).split(" "), r.randint(0, 6), r)), "en", "src0") for i in range(90)] + clusters(4)[:60]
    # without the profiles all members of a region stay together
    monkeypatch.setattr(metric_join, "_possible", lambda g, percent: [(0, j) for j in range(1, len(g["comp"]))])
    numbers = []
    split = metric_join.split
    monkeypatch.setattr(metric_join, "split", lambda *a: numbers.append(a[-1]) or split(*a))
    assert joined(spark, rows) == plain(rows)
    assert 1 in numbers


def test_linked_sets_share_a_slice():
    r = np.random.default_rng(3)
    first, slices = metric_join.steps(90, 4000)
    for n in [9, 10, 11, 17, 18, 19, 26, 27, 28, 41, 62, 93, 140, 300, 1000, 3000]:
        for _ in range(40):
            x = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
            differ = int(r.integers(0, n // 9 + 1))
            drop = int(r.integers(0, differ + 1))
            y = np.unique(np.concatenate((x[r.permutation(len(x))[drop:]], r.integers(0, 2**64, differ - drop, dtype=np.uint64))))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 90 * (len(x) + len(y) - both) and len(np.setxor1d(x, y)):
                assert len(np.intersect1d(metric_join.keys_of(x, first, slices, 90), metric_join.keys_of(y, first, slices, 90)))


def test_edges(spark):
    assert joined(spark, []) == []
    rows = [(1, None, None, None), (2, "", None, None), (3, " \t", None, None), (None, None, None, None), (4, "one", "en", "a"), (5, "ONE", "en", "a"), (None, "one", "en", "a"), (None, "two words", None, None), (4, "one", "en", "a")]
    assert joined(spark, rows) == plain(rows)
    with pytest.raises(ValueError):
        metric_join.join(frame(spark, rows), Scratch(spark, "metric"), percent=50)


def test_profiles_bound_the_difference():
    r = np.random.default_rng(7)
    for n in (9, 60, 250, 260, 1000, 5000):
        x = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        y = np.unique(np.concatenate((x[r.permutation(len(x))[n // 20 :]], r.integers(0, 2**64, n // 30, dtype=np.uint64))))
        far = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        g = {"comp": np.arange(3), "side": np.full(3, 2), "n": np.array([len(x), len(y), len(far)]), "profile": [metric_join.profile(v) for v in (x, y, far)]}
        linked = 100 * len(np.intersect1d(x, y)) >= 90 * len(np.union1d(x, y))
        found = {(min(p), max(p)) for p in metric_join._possible(g, 90)}
        assert ((0, 1) in found) >= linked and not any(2 in p for p in found)
