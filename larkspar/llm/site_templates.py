"""Main text of web pages, with site template removal.

One pass over a page builds its element tree, leaves out elements that are no article by
their very name (menus, page headers, footers, sidebars, scripts, styles), cuts the rest
into blocks and hashes the subtree of every element.  Spark then counts, for each host, on
how many different pages a subtree recurs, inside and outside articles alike.  Outside, a
subtree on LEAST_PAGES pages and on MIN_SHARE of the host's pages, or on MANY_PAGES
whatever their share, is template and its blocks are deleted.  Inside an article or main
element, paragraphs, headings, quotations, list items and tables, and these two elements
themselves, are likelier content and go only on MIN_PAGES pages and MAIN_SHARE of all.
Pages with equal content count once, so mirrored pages do not make their own article a
template.

Forms, and elements whose role or class names furniture (notices, adverts, comments, share
bars), go too unless they hold an article or main element; a name counts if all its parts
are such words, with at most a word of place around them (site-footer, cookie-bar), so
cookie-recipe or comments-page take nothing.  Headings never go by their class.  If a page has article or main elements its text is theirs; else it is all that is
left.  Time and memory are linear in a page's length, however deep it nests.

Null or empty html gives an empty text.  A null or unparsable url has no host, and such
pages neither have nor make templates.  Repeated rows give equal rows; extra columns are
ignored.  Unclosed tags, quotes and comments end where HTML ends them, at the latest with
the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, few, ship

#: Pages and share of a host's pages from which a subtree outside articles is template.
LEAST_PAGES, MIN_SHARE, MANY_PAGES = 3, 0.25, 100
#: The same for CONTENT elements inside an article or main.
MIN_PAGES, MAIN_SHARE = 10, 0.5
#: Deletions up to this many are broadcast to the pages; beyond, both sides are shuffled.
BROADCAST_HITS = 1_000_000
CHUNK_ROWS = 200
PARSED = "key long, page_id long, url string, host string, root long, texts array<string>, owners array<int>, parents array<int>, elements array<long>"

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html head td th tr tbody thead tfoot option dd dt li".split()) | {"li", "dd", "dt"}
SPACE = frozenset("br td th img".split())
#: An open element of the key's kind is closed by the start of those named, up to the fence.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, {"html"})}
P_FENCE = frozenset("table td th caption button object template article main section div aside nav body html".split()) - {"div"}
#: Elements and roles that are no article, and words of class and id names that mark furniture.
DROPPED = frozenset("head nav aside footer script style noscript template svg canvas button select datalist dialog iframe object textarea title xmp noembed noframes audio video map menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside ad ads adv advert advertisement adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login comment comments disqus reply replies respond share sharing social related recommended widget toolbar pagination pager skip copyright legal".split()
)
#: What may stand before and after such a word: site-footer, cookie-bar, comments_section-2; any other part (cookie-recipe) makes a name no mark.
BEFORE = frozenset("site page main global top bottom left right primary secondary inner outer the js is has".split())
AFTER = frozenset("bar box list section container wrapper wrap inner outer area block links link buttons button btn icons icon slot unit panel item items row col top bottom left right fixed sticky wide small large form".split())
ITSELF = frozenset("comment comments reply advert ad sponsored related".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text stays though all of it is a link; outside articles, links in lists and boxes are menus.
PROSE = HEADINGS | {"p", "blockquote", "pre"}
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption td tr tbody table article main".split())

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+|[\"'])*+)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def host_of(url: str | None) -> str | None:
    m = HOST.match(url or "")
    return m[1].lower().removeprefix("www.") if m else None


def is_furniture(name: str) -> bool:
    """Whether a class or id name is made of furniture words, with at most a word of place before and after."""
    if name in WORDS:
        return True
    parts = [x for x in re.split("[-_]+", name) if x and not x.isdigit()]
    while len(parts) > 1 and parts[0] in BEFORE:
        del parts[0]
    while len(parts) > 1 and parts[-1] in AFTER:
        del parts[-1]
    return bool(parts) and all(x in WORDS for x in parts)


def is_marked(tag: str, attributes: str) -> bool:
    """Whether an element's role, class or id marks it as furniture."""
    if tag == "form":
        return True
    if not attributes or tag in HEADINGS or tag in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2].strip("\"'").lower()
        if key == "role":
            if value in ROLES:
                return True
        elif tag in ("article", "main"):
            if ITSELF & {*value.split()}:
                return True
        else:
            for name in value.split():
                if is_furniture(name):
                    return True
    return False


class Page:
    """The blocks of one page: texts, and the element that each is in."""

    def __init__(self, html: str):
        import xxhash

        self.hash = lambda s: xxhash.xxh64_intdigest(s.encode("utf-8", "replace")) - (1 << 63)
        # open elements: [tag, dropped, in main, number of its element or -1]
        self.stack: list[list] = [["", False, False, -1]]
        self.depths: dict[str, list[int]] = {}  # places in the stack by tag
        self.block_depths = [0]
        self.parents: list[int] = []
        self.items: list[list[str]] = []
        self.names: list[str] = []
        self.guarded: list[bool] = []
        self.marked: list[bool] = []
        self.holds_main: list[bool] = []
        self.hashes: list[int | None] = []
        self.blocks: list[tuple[str, int, bool]] = []
        self.buffer: list[str] = []
        self.linked = 0
        self.length = 0
        self.links = 0
        self._read(html)
        while len(self.stack) > 1:
            self._pop()
        self._flush()

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        search = TAG.search
        while at < n:
            m = search(html, at)
            start = m.start() if m else n
            if start > at and not self.stack[-1][1]:
                self._text(html[at:start])
            if not m:
                return
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                self._end(name)
                continue
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = close.end() if close else n
                continue
            self._start(name, m[3])

    def _text(self, text: str) -> None:
        self.buffer.append(text)
        self.length += len(text)
        if self.links:
            self.linked += len(text)

    def _start(self, tag: str, attributes: str) -> None:
        stack = self.stack
        if tag in CLOSES_P and self.depths.get("p"):
            self._close({"p"}, P_FENCE)
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        _, dropped, in_main, element = stack[-1]
        block = tag in BLOCK
        if block:
            self._flush()
        elif tag in SPACE and not dropped:
            self.buffer.append(" ")
        if tag in VOID or attributes.endswith("/") and not block and tag != "a":
            return
        dropped = dropped or tag in DROPPED or tag == "header" and not in_main
        marked = not dropped and is_marked(tag, attributes)
        if dropped or marked:
            self._flush()
        article = tag in ("article", "main") and not dropped and not marked
        in_main = in_main or article
        if (block or marked) and not dropped:
            self.parents.append(element)
            self.items.append([])
            self.names.append(tag)
            self.guarded.append(in_main and tag in CONTENT)
            self.marked.append(marked)
            self.holds_main.append(False)
            self.hashes.append(None)
            element = len(self.parents) - 1
            while article and element >= 0 and not self.holds_main[element]:
                self.holds_main[element] = True
                element = self.parents[element]
            element = len(self.parents) - 1
        if tag == "a":
            self.links += 1
        self.depths.setdefault(tag, []).append(len(stack))
        if block:
            self.block_depths.append(len(stack))
        stack.append([tag, dropped, in_main, element])

    def _end(self, tag: str) -> None:
        depths = self.depths.get(tag)
        if depths and (tag in BLOCK or depths[-1] > self.block_depths[-1]):
            depth = depths[-1]
            while len(self.stack) > depth:
                self._pop()

    def _close(self, tags: set[str], fence: set[str]) -> None:
        top = lambda names: max((d[-1] for x in names if (d := self.depths.get(x))), default=0)
        depth = top(tags)
        if depth > top(fence):
            while len(self.stack) > depth:
                self._pop()

    def _pop(self) -> None:
        tag, dropped, _, element = self.stack[-1]
        own = element >= 0 and element != self.stack[-2][3]
        if tag in BLOCK or own or dropped and not self.stack[-2][1]:
            self._flush()
        self.stack.pop()
        self.depths[tag].pop()
        if tag in BLOCK:
            self.block_depths.pop()
        if tag == "a":
            self.links -= 1
        if own and self.items[element]:
            h = self.hash(tag + "\0" + "\0".join(self.items[element]))
            self.hashes[element] = h
            if self.parents[element] >= 0:
                self.items[self.parents[element]].append(str(h))
            self.items[element] = []

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join(unescape("".join(self.buffer)).split())
            if text:
                _, dropped, in_main, element = self.stack[-1]
                only_links = self.linked >= self.length and not in_main and (element < 0 or self.names[element] not in PROSE)
                if not dropped and not only_links:
                    if element >= 0:
                        self.items[element].append("t" + text)
                    self.blocks.append((text, element, in_main))
            self.buffer = []
        self.length = self.linked = 0

    def result(self) -> tuple[int, list[str], list[int], list[int], list[int]]:
        """(hash of all content, texts of its blocks, element of each, parents and hashes of the whole page's elements).

        Elements are those with text; an element's hash has its last bit cleared, or set if
        it is guarded content.
        """
        cut: list[bool] = []
        place: list[int] = []  # of the nearest element that is listed; -1: none
        parents, elements = [], []
        for k, parent in enumerate(self.parents):
            above = place[parent] if parent >= 0 else -1
            cut.append(parent >= 0 and cut[parent] or self.marked[k] and not self.holds_main[k])
            if self.hashes[k] is None or self.names[k] in ("html", "body"):
                place.append(above)
                continue
            place.append(len(elements))
            parents.append(above)
            elements.append(self.hashes[k] & -2 | self.guarded[k])
        left = [(text, element, in_main) for text, element, in_main in self.blocks if element < 0 or not cut[element]]
        main = any(in_main for _, _, in_main in left)
        left = [(text, place[element] if element >= 0 else -1) for text, element, in_main in left if in_main or not main]
        texts = [text for text, _ in left]
        return self.hash("\0".join(texts)), texts, [owner for _, owner in left], parents, elements


def _parse(batches) -> Iterator:
    import pyarrow as pa
    import xxhash

    longs = pa.int64()
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK_ROWS):
            part = batch.slice(start, CHUNK_ROWS)
            urls, pages = part.column(1).to_pylist(), part.column(2).to_pylist()
            rows = [Page(x or "").result() for x in pages]
            keys = [xxhash.xxh64_intdigest(f"{i}\0{u}\0{h}".encode("utf-8", "replace")) - (1 << 63) for i, u, h in zip(part.column(0).to_pylist(), urls, pages, strict=True)]
            ints = pa.list_(pa.int32())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((longs, pa.list_(pa.string()), ints, ints, pa.list_(longs)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, longs), part.column(0), part.column(1), pa.array([host_of(u) for u in urls], pa.string()), *columns],
                names=[c.strip().split()[0] for c in PARSED.split(", ")],
            )


def living(texts: list[str], owners: list[int], parents: list[int], dead: list[int]) -> list[str]:
    """The texts that are in no dead element; parents come before their children."""
    gone = [False] * len(parents)
    for k in dead:
        gone[k] = True
    for k, parent in enumerate(parents):
        if parent >= 0 and gone[parent]:
            gone[k] = True
    return [t for t, k in zip(texts, owners, strict=True) if k < 0 or not gone[k]]


def _delete(batches) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK_ROWS):
            part = batch.slice(start, CHUNK_ROWS)
            kept = [living(*row) for row in zip(*(part.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(["\n\n".join(x) for x in kept], pa.string())], names=["page_id", "url", "text"])


def templates(parsed: DataFrame, least_pages: int = LEAST_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES, min_pages: int = MIN_PAGES, main_share: float = MAIN_SHARE) -> DataFrame:
    """(host, element): subtrees on many different pages of a host; with the last bit set, as guarded content."""
    known = parsed.filter("host is not null")
    elements = known.select("host", "root", F.explode("elements").alias("element")).withColumn("element", F.col("element").bitwiseAND(F.lit(-2))).distinct()
    counts = elements.groupBy("host", "element").agg(F.count("*").alias("n")).filter(F.col("n") >= min(least_pages, min_pages))
    pages = known.select("host", "root").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    found = counts.join(pages, "host").withColumn("guarded", F.explode(F.array(F.lit(0), F.lit(1))))
    n, share = F.col("n"), F.col("n") / F.col("pages")
    outside = (n >= least_pages) & ((share >= min_share) | (n >= many_pages))
    inside = (n >= min_pages) & (share >= main_share)
    return found.filter(F.when(F.col("guarded") == 1, inside).otherwise(outside)).select("host", F.col("element").bitwiseOR(F.col("guarded").cast("long")).alias("element"))


def extract(df: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **limits) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; ``limits`` are those of :func:`templates`."""
    spark = df.sparkSession
    ship(spark)
    d = df.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col))
    parsed = scratch.write(d.mapInArrow(_parse, PARSED), "parsed")
    found = few(scratch.write(templates(parsed, **limits), "templates"))
    on_page = parsed.select("key", "host", F.posexplode("elements").alias("place", "element"))
    hits = on_page.join(found, ["host", "element"]).groupBy("key").agg(F.collect_set("place").alias("dead"))
    hits = scratch.write(hits, "hits")
    places = hits.agg(F.coalesce(F.sum(F.size("dead")), F.lit(0))).first()[0]
    hits = F.broadcast(hits) if places <= BROADCAST_HITS else hits
    whole = parsed.join(hits.select("key"), "key", "left_anti").select("page_id", "url", F.array_join("texts", "\n\n").alias("text"))
    cut = parsed.join(hits, "key").select("page_id", "url", "texts", "owners", "parents", "dead").mapInArrow(_delete, "page_id long, url string, text string")
    return whole.unionByName(cut).withColumn("n_chars", F.char_length("text").cast("long"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), Scratch(spark, "pages"))
