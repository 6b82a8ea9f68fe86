"""Small documents with every odd case, and brute-force versions."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, node int, comp int, digest string, p double, block int, `order` string, held_out string, gone long, taken_doc_id long, copies int, text_hash string, row string, node2 string"
VOCABULARY = [a + b for a in ("the", "and", "er", "in", "on", "st", "qu", "ré", "über") for b in ("", "ing", "tion", "eau", "lich", "ment", "ó")]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def texts():
    base = prose(300, 1)
    near = base.split(" ")
    near[150] = "changed"
    out = [(i, prose(20 + 7 * i, i), "en" if i % 2 else "fr", f"src{i % 3}") for i in range(30)]
    out += [(100 + i, base, "en", "src0") for i in range(6)]
    out += [(110, " ".join(near), "en", "src0"), (111, base.upper(), "en", None), (112, None, "en", "src1"), (113, "", None, "src1"), (114, " \n\t ", "en", "src2"), (115, "one", "en", "src2"), (116, "one", None, None), (117, "One two", "en", "src9")]
    out += [(118, prose(40_000, 5), "en", "src1"), (119, "!" * 60, "de", "src1"), (None, "no id here at all", "en", "src0"), (None, None, None, None), (3, prose(20 + 21, 3), "fr", "src0"), (120, "x" * 5000 + " y", "zz", "src0"), (121, "a b  c d\x1ce", "en", "src0"), (122, "日本語 テキスト 😀", "ja", "src0")]
    out += [(130, "line\nline\nline\n\n other\nother", "en", "src0"), (131, "a b c d e " * 12, "en", "src0")]
    return out


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "x", "k", 1, 2, "d", 0.5, 9, "o", "h", 5, 6, 7, "th", "r", "n") for i, t, g, s in rows], COLUMNS)


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size):
    w = words(lower(text))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(rows, size=3, percent=85):
    """component by row index, all pairs compared."""
    sets = [shingles(t, size) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        r = root(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [least.get(root(i)) if sets[i] else rows[i][0] for i in range(len(rows))]
