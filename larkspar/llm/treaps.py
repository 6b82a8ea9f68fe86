"""Ranked lexical search over inverted treaps.

The index is dealt by documents: a block holds about BLOCK_POSTINGS postings of up to
BLOCK_DOCS documents, and for each term the list of its documents there.  So a term that
all documents hold is spread over all blocks, and no list is ever gathered.  A task makes
each list of a block a treap: a binary tree in which documents stand in the order of ids
and no document has a greater impact (its part of a score) than its parent; of equal
impacts the smaller id is above.  Such a tree is given by its keys alone; parents come from
the nearest greater neighbours, for all terms at once.

All items of a group walk the treaps of their terms at the same time.  A state is an
interval of documents with the root that each of the item's treaps has in it; the sum of the
roots' impacts bounds every score inside.  Of the states of an item the BEAM best are taken
up: the document of the strongest root is looked up in all treaps of the item (its whole
score), and the two intervals beside it, with the roots met on the way, are new states.
States whose bound cannot enter the item's best k go, with all their subtrees.  The best k
are kept from block to block of a task, so later blocks are pruned harder, and the rows of
all tasks are ranked in two steps.

Items come in groups of about GROUP; each group walks the whole index once.  The index has
the terms of the items if these are at most WANTED, else all terms.  Documents without a
term count for nothing; a null doc_id comes after all others of equal score; rows that
repeat a doc_id are ranked each.  Items that repeat (item_id, text) are one item, equal
item_ids with different texts are items of their own; items without a known term give no
rows.  Empty tables give no rows; other columns are ignored.  Sums of a document's terms
times N must stay within a long: 75 * n * N < 2^63.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Grow, Scratch, WordCache, ascii_lower, chunked, read, ship, trim

#: Documents have terms of these characters; only A-Z are lower-cased.
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_POSTINGS, BLOCK_DOCS, GROUP, BEAM, WANTED, SALTS = 1 << 17, 1024, 256, 32, 100_000, 64
#: The same for bytes of UTF-8: what is no letter, digit or part of a longer character becomes a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INDEX = "docs long, total long, ids array<long>, lens array<long>, terms array<string>, sizes array<int>, at binary, tf binary"
NO_ID = np.iinfo(np.int64).max


def item_terms(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TERM_PATTERN), F.lit(0))


class _Words(WordCache):
    """Numbers words and knows which of them are wanted; all are if ``wanted`` is None."""

    def __init__(self, wanted: set[bytes] | None):
        self.wanted = wanted
        super().__init__(self._add, self._reset, self._only)

    def _reset(self) -> None:
        self.words, self.use = [], Grow(bool)

    def _add(self, words: list[bytes]) -> None:
        self.words += words
        self.use.extend(np.array([self.wanted is None or w in self.wanted for w in words], bool))

    def _only(self, at: np.ndarray) -> None:
        self.words = [self.words[i] for i in at.tolist()]
        self.use.keep(at)


def _index(wanted: set[bytes] | None):
    """Documents to blocks of postings."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        words = _Words(wanted)
        ids, lens, parts, numbers = [], [], [], {}

        def block():
            # documents in the order of ids, null last; postings by term, then document
            order = np.argsort(np.array([NO_ID if i is None else i for i in ids], np.int64), kind="stable")
            order = np.array(sorted(order.tolist(), key=lambda d: ids[d] is None), np.int64)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            doc, term, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
            doc = place[doc]
            by = np.lexsort((doc, term))
            sizes = np.bincount(term, minlength=len(numbers)).tolist()
            n = np.array(lens)[order]
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "docs": int((n > 0).sum()), "total": int(n.sum()), "ids": [ids[d] for d in order.tolist()], "lens": n.tolist(),
                        "terms": [w.decode() for w in numbers], "sizes": sizes, "at": doc[by].astype(np.int32).tobytes(), "tf": tf[by].astype(np.int32).tobytes(),
                    }
                ],
                schema=pa.schema([("docs", pa.int64()), ("total", pa.int64()), ("ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("at", pa.binary()), ("tf", pa.binary())]),
            )

        postings = 0
        for part, texts in chunked(batches, 1):
            at, begin = words.number([t.translate(_BYTES).split() for t in texts])
            owner = np.repeat(np.arange(len(texts)), np.diff(begin))
            use = words.use.a[at]
            pairs, tf = np.unique(owner[use] * len(words.words) + at[use], return_counts=True)
            doc, word = np.divmod(pairs, max(len(words.words), 1))
            part_ids, part_lens = part.column(0).to_pylist(), np.diff(begin).tolist()
            start = 0
            while start < len(texts):
                # as many documents as the block still takes, one at least if it is empty
                upto = np.searchsorted(doc, np.arange(start, len(texts) + 1))
                room = int(np.searchsorted(upto - upto[0], BLOCK_POSTINGS - postings, "right")) - 1
                stop = min(len(texts), start + room, start + BLOCK_DOCS - len(ids))
                if stop <= start and ids:
                    yield block()
                    ids, lens, parts, numbers, postings = [], [], [], {}, 0
                    continue
                stop = max(stop, start + 1)
                i, j = upto[0], upto[stop - start]
                some, back = np.unique(word[i:j], return_inverse=True)
                number = np.array([numbers.setdefault(words.words[w], len(numbers)) for w in some.tolist()], np.int64)
                parts.append((doc[i:j] - start + len(ids), number[back] if j > i else back, tf[i:j]))
                ids += part_ids[start:stop]
                lens += part_lens[start:stop]
                postings += int(j - i)
                start = stop
        if ids:
            yield block()
        trim()

    return run


class Index:
    """The written blocks with the counts that weights need."""

    def __init__(self, blocks: DataFrame):
        self.blocks = blocks
        r = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
        self.n, self.total = int(r["n"]), int(r["total"])

    def weights(self) -> DataFrame:
        """(term, w) of every term of the index."""
        each = self.blocks.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).select("x.*")
        df = each.groupBy(F.col("terms").alias("term")).agg(F.sum("sizes").alias("df"))
        return df.select("term", F.floor(1000 * F.log((2.0 * self.n + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("w"))


def build(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", wanted: set[str] | None = None, name: str = "index") -> Index:
    """The index of a table; ``wanted`` limits it to some terms, the counts are always of all."""
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    only = None if wanted is None else {w.encode() for w in wanted}
    return Index(scratch.write(d.mapInArrow(_index(only), INDEX), name))


def treaps(impact: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right children of every posting and the root of every list, -1 for none.

    Lists begin at ``first``, ends with the length of all, and are sorted by document.
    """
    n = len(impact)
    begin = np.repeat(first[:-1], np.diff(first))
    end = np.repeat(first[1:], np.diff(first))
    # nearest at least as great to the left, nearest greater to the right; pointers jump over
    # what the neighbour has jumped over already
    up, down = np.arange(-1, n - 1), np.arange(1, n + 1)
    open_ = np.arange(n)
    while len(open_):
        open_ = open_[up[open_] >= begin[open_]]
        open_ = open_[impact[up[open_]] < impact[open_]]
        up[open_] = up[up[open_]]
    open_ = np.arange(n)
    while len(open_):
        open_ = open_[down[open_] < end[open_]]
        open_ = open_[impact[down[open_]] <= impact[open_]]
        down[open_] = down[down[open_]]
    has_up, has_down = up >= begin, down < end
    left, right, roots = np.full(n, -1), np.full(n, -1), np.full(len(first) - 1, -1)
    alone = np.flatnonzero(~has_up & ~has_down)
    roots[np.searchsorted(first, alone, "right") - 1] = alone
    both = has_up & has_down
    by_right = np.flatnonzero((both & (impact[np.where(both, up, 0)] >= impact[np.where(both, down, 0)])) | (has_down & ~has_up))
    by_left = np.flatnonzero((both & (impact[np.where(both, up, 0)] < impact[np.where(both, down, 0)])) | (has_up & ~has_down))
    left[down[by_right]] = by_right
    right[up[by_left]] = by_left
    return left, right, roots


class Best:
    """The k best (score, doc_id) of each item so far, in order."""

    def __init__(self, items: int, k: int):
        self.k, self.items = k, items
        self.item, self.score, self.id, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        self.least, self.last = np.zeros(items, np.int64), np.full(items, -1, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc_id: np.ndarray, null: np.ndarray) -> None:
        use = (score > self.least[item]) | ((score == self.least[item]) & (score > 0) & (doc_id <= self.last[item]))
        if not use.any():
            return
        item, score, doc_id, null = (np.concatenate((old, new[use])) for old, new in ((self.item, item), (self.score, score), (self.id, doc_id), (self.null, null)))
        order = np.lexsort((null, doc_id, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[rank < self.k]
        self.item, self.score, self.id, self.null = item[rank < self.k], score[keep], doc_id[keep], null[keep]
        full = np.flatnonzero(np.bincount(self.item, minlength=self.items) == self.k)
        at = np.searchsorted(self.item, full, "right") - 1
        self.least[full], self.last[full] = self.score[at], self.id[at]


def walk(best: Best, ids: np.ndarray, null: np.ndarray, doc: np.ndarray, impact: np.ndarray, left: np.ndarray, right: np.ndarray, root: np.ndarray, repeats: np.ndarray, beam: int = BEAM) -> int:
    """Adds a block's documents to the best of every item; returns how many documents were scored.

    ``root`` has a row for each item with the roots of its treaps, padded with -1; ``repeats``
    how often the item has each term.
    """
    ids = np.append(ids, NO_ID)

    def bounds(item, roots):
        return np.where(roots >= 0, impact[roots] * repeats[item], 0).sum(1)

    item, roots, low, high = np.arange(len(root)), root, np.full(len(root), -1), np.full(len(root), len(null))
    bound, scored = bounds(item, roots), 0
    while True:
        # equal bounds count only where an id below that of the last of the best may follow
        least = best.least[item]
        use = np.flatnonzero((bound > least) | ((bound == least) & (bound > 0) & (ids[low + 1] <= best.last[item])))
        if not len(use):
            return scored
        order = use[np.lexsort((-bound[use], item[use]))]
        rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        now, later = order[rank < beam], order[rank >= beam]
        of, at = item[now], roots[now]
        strength = np.where(at >= 0, impact[at] * repeats[of], -1)
        d = doc[at[np.arange(len(at)), strength.argmax(1)]]
        # every treap of the item is searched for the document; the first nodes on either side
        # of it that lie in the interval are the roots of the two halves
        scored += len(at)
        wide = at.shape[1]
        score, before, after = np.zeros(at.size, np.int64), np.full(at.size, -1), np.full(at.size, -1)
        lows, highs, wants = (np.repeat(x, wide) for x in (low[now], high[now], d))
        cells = np.flatnonzero(at.ravel() >= 0)
        cur = at.ravel()[cells]
        while len(cells):
            here, want = doc[cur], wants[cells]
            hit, less, more = here == want, here < want, here > want
            score[cells[hit]] = impact[cur[hit]]
            for side, child, met in ((before, left, less & (here > lows[cells])), (after, right, more & (here < highs[cells]))):
                unset = side[cells] < 0
                side[cells[met & unset]] = cur[met & unset]
                side[cells[hit & unset]] = child[cur[hit & unset]]
            go = np.where(less, right[cur], left[cur])
            on = ~hit & (go >= 0)
            cells, cur = cells[on], go[on]
        for side, child, out in ((before, right, lambda x: doc[before[x]] <= lows[x]), (after, left, lambda x: doc[after[x]] >= highs[x])):
            cells = np.flatnonzero(side >= 0)
            while len(cells):
                cells = cells[out(cells)]
                side[cells] = child[side[cells]]
                cells = cells[side[cells] >= 0]
        score, before, after = (x.reshape(-1, wide) for x in (score, before, after))
        best.add(of, (score * repeats[of]).sum(1), ids[d], null[d])
        item = np.concatenate((item[later], of, of))
        roots = np.concatenate((roots[later], before, after))
        bound = np.concatenate((bound[later], bounds(of, before), bounds(of, after)))
        low, high = np.concatenate((low[later], low[now], d)), np.concatenate((high[later], d, high[now]))


FOUND = "item long, item_id long, doc_id long, score long"


def _search(items: list[tuple[int, int | None, list[tuple[str, int]]]], weight: dict[str, int], n: int, total: int, k: int):
    """Blocks to the best k documents that a task has for every item."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        terms = {t: i for i, t in enumerate(sorted(weight))}
        w = np.array([weight[t] for t in terms], np.int64)
        wide = max(len(x) for _, _, x in items)
        term, repeats = np.full((len(items), wide), len(terms)), np.zeros((len(items), wide), np.int64)
        for row, (_, _, own) in enumerate(items):
            term[row, : len(own)] = [terms[t] for t, _ in own]
            repeats[row, : len(own)] = [r for _, r in own]
        best = Best(len(items), k)
        for batch in batches:
            for b in range(batch.num_rows):
                value = lambda c: batch.column(c)[b]
                ids = value(2).values
                null, ids, lens = np.asarray(ids.is_null()), np.asarray(ids.fill_null(NO_ID)), np.asarray(value(3).values)
                sizes = np.asarray(value(5).values).astype(np.int64)
                number = np.array([terms.get(t, -1) for t in value(4).values.to_pylist()], np.int64)
                owner = np.repeat(number, sizes)
                use = (owner >= 0) & (w[np.maximum(owner, 0)] > 0) if len(w) else np.zeros(len(owner), bool)
                if not use.any():
                    continue
                doc, tf = (np.frombuffer(value(c).as_py(), np.int32).astype(np.int64)[use] for c in (6, 7))
                owner = owner[use]
                m = 25 + 75 * lens * n // total
                impact = w[owner] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                first = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]))
                left, right, roots = treaps(impact, first)
                of_term = np.full(len(terms) + 1, -1)
                of_term[owner[first[:-1]]] = roots
                root = of_term[term]
                # only the columns that some item needs here
                some = np.argsort(root < 0, axis=1, kind="stable")[:, : max(1, int((root >= 0).sum(1).max()))]
                rows = np.arange(len(items))[:, None]
                walk(best, ids, null, doc, impact, left, right, root[rows, some], repeats[rows, some])
        if len(best.item):
            keys, names = np.array([x for x, _, _ in items], np.int64), [x for _, x, _ in items]
            columns = [pa.array(keys[best.item]), pa.array([names[i] for i in best.item], pa.int64()), pa.array(best.id, mask=best.null), pa.array(best.score)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])
        trim()

    return run


def search(docs: DataFrame, items: DataFrame, scratch: Scratch, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of greatest score of every item."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), item_terms(F.col(item_text)).alias("terms")).distinct()
    asked = asked.withColumn("item", F.xxhash64("item_id", "terms"))
    asked = scratch.write(asked.select("item", "item_id", F.explode("terms").alias("term")).groupBy("item", "item_id", "term").agg(F.count("*").alias("repeats")), "items")
    terms = [r["term"] for r in asked.select("term").distinct().limit(WANTED + 1).collect()]
    index = build(docs, scratch, id_col, text_col, None if len(terms) > WANTED else set(terms))
    weighed = scratch.write(asked.join(index.weights(), "term"), "weighed")
    groups = max(1, math.ceil(weighed.select("item").distinct().count() / GROUP))
    found = None
    for g in range(groups):
        part = weighed.filter(F.pmod(F.xxhash64("item"), F.lit(groups)) == g)
        own = part.groupBy("item", "item_id").agg(F.sort_array(F.collect_list(F.struct("term", "repeats"))).alias("terms")).collect()
        if not own:
            continue
        weight = {r["term"]: r["w"] for r in part.select("term", "w").distinct().collect()}
        rows = [(r["item"], r["item_id"], [(t["term"], t["repeats"]) for t in r["terms"]]) for r in own]
        hits = index.blocks.mapInArrow(_search(rows, weight, index.n, index.total, k), FOUND)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    few = found.withColumn("salt", F.spark_partition_id() % SALTS)
    few = few.withColumn("at", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("at") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "treaps")
    return scratch.result(search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), scratch))


_TERMS = rf"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM_PATTERN}')"
OP12_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce({_TERMS}, []) AS terms FROM documents),
  c AS (SELECT count(*) FILTER (len(terms) > 0) AS n, sum(len(terms)) AS l FROM d),
  item AS MATERIALIZED (SELECT row_number() OVER () AS item, item_id, terms FROM (SELECT DISTINCT item_id, coalesce({_TERMS}, []) AS terms FROM benchmark)),
  q AS MATERIALIZED (SELECT item, item_id, term, count(*) AS r FROM (SELECT item, item_id, unnest(terms) AS term FROM item) GROUP BY ALL),
  p AS MATERIALIZED (
    SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
    WHERE term IN (SELECT term FROM q) GROUP BY ALL
  ),
  w AS (SELECT term, CAST(floor(1000 * ln((2.0 * c.n + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, c.n),
  s AS (
    SELECT q.item, q.item_id, p.row, p.doc_id, CAST(sum(q.r * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * p.n * c.n) // c.l)))) AS BIGINT) AS score
    FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL
  ),
  r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
