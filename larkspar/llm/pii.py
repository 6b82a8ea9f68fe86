"""Personal data: base patterns, and a linear-chain conditional random field that adds more.

The base kinds (email, ip, card, phone) follow fixed patterns and checks.  The random
field labels the words of a text by their shape (character classes, length, alternation
of digits and letters, a few key words), by key words up to three words before them and
by their neighbours' labels, and adds spans of kinds that no pattern here covers:
``secret`` (keys, tokens, passwords), ``account`` (IBANs and other document numbers),
``person`` (names after a title or a word for name), ``address`` (number and street) and
``birthdate``.  It is trained on the driver from a small labelled table,
:func:`labelled_rows`, in four languages with drawn names and values, and decoded by
Viterbi in numpy over all words of a batch at once.  A word whose emission for 'outside'
beats every other label by more than any two transitions can make good is outside on
every best path, so only the runs between such words are decoded; the result is that of
decoding the whole text.

Offsets are code points.  An added span that overlaps a base span is dropped; base spans
always stay, and the four counts are of base spans.  Null or empty texts have no spans:
counts of 0, an empty list and its hash.  Repeated rows give equal rows; extra columns are
ignored.  Long texts are read whole; the patterns are linear in their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Grow, WordCache, chunked, ship

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "account", "person", "address", "birthdate")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
TAGS = ("outside", "key", "separator", "secret", "account", "person", "address", "birthdate")
OUT, KEY, SEP, SECRET, ACCOUNT, PERSON, ADDRESS, BIRTH = range(8)

#: Words that announce a secret, and words that announce an account or document number.
SECRET_KEYS = {b"token", b"key", b"apikey", b"api_key", b"api-key", b"secret", b"client_secret", b"password", b"passwd", b"pwd", b"bearer", b"access_key", b"auth", b"credential", b"passwort", b"clave", b"contrase\xc3\xb1a"}
ACCOUNT_KEYS = {b"iban", b"ssn", b"passport", b"account", b"konto", b"compte", b"cuenta", b"dni", b"nif", b"steuer-id"}
#: Words before a name, before an address and before a birth date, and words for streets.
PERSON_KEYS = {x.encode() for x in "name mr mrs dr herr frau madame monsieur mme señor señora nom nombre surname".split()}
ADDRESS_KEYS = {x.encode() for x in "live lives address adresse wohnt wohne habite dirección vive vivo".split()}
BIRTH_KEYS = {x.encode() for x in "born birth dob birthday geboren geburtsdatum née né nacido nacida nacimiento".split()}
STREETS = {x.encode() for x in "street road avenue lane square strasse straße platz rue boulevard calle avenida plaza".split()}
STREET_ENDS = ("strasse".encode(), "straße".encode())

DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)
DIGIT = re.compile(rb"[0-9]")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of all base spans, sorted.

    Emails: a match starts where the run of local characters before an @ does (or where
    the last match ended), so each @ is looked at once.  Addresses: a match can only start
    where a run of digits does.
    """
    found = []
    if b"@" in text:
        free = at = 0
        while (at := text.find(b"@", at)) >= 0:
            if m := DOMAIN.match(text, at):
                start = at
                while start > free and text[start - 1] in LOCAL:
                    start -= 1
                if start < at:
                    found.append((start, 0, m.end()))
                    free = at = m.end()
                    continue
            at += 1
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip(b"0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(b".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].translate(None, NOT_DIGITS)) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if b"+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(m[0].translate(None, NOT_DIGITS)) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---- word-shape features -------------------------------------------------------------

LETTERS = bytes(c for c in range(256) if chr(c).isascii() and chr(c).isalpha() or c >= 128)
PUNCT = b".,;:!?\"'()[]{}#*$%&|<>"
PLAIN_RESTS = {b"", b".", b",", b";", b"!", b"?", b".!!", b",!!", b"!!", b"|"}
FEATURES = (
    "bias", "plain", "digit", "digits", "letters", "mixed", "at", "has_sep", "ends_sep", "is_sep", "quoted", "hex", "upper", "lower", "dots", "dashes", "slash",
    "len<6", "len<12", "len<20", "len<32", "len>=32", "turns0", "turns1", "turns3", "turns6", "secret_key", "account_key", "key_value", "iban", "group4", "dashed_id", "cap", "person_key", "address_key", "birth_key", "street", "date",
)
AT = {name: i for i, name in enumerate(FEATURES)}
HEX = re.compile(rb"(?:[0-9a-f]{12,}|[0-9A-F]{12,})")
IBAN = re.compile(rb"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{10,30})?")
GROUP4 = re.compile(rb"[0-9A-Z]{4}|[0-9]{2,3}")
DASHED = re.compile(rb"[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z][0-9]{7,8}|[0-9]{8}-?[A-Z]")
KEY_VALUE = re.compile(rb"\"?([A-Za-z_\xc3\xb1-]+)\"?[=:]+\"?'?([^\"'=:]{6,})")
TURN = re.compile(rb"[0-9]+|[^0-9]+")
DATE = re.compile(rb"[0-3]?[0-9][./-][01]?[0-9][./-](?:[0-9]{2}){1,2}|[0-9]{4}[./-][01]?[0-9][./-][0-3]?[0-9]")
#: What a word may be to those around it, and the places (before: negative) whose words it bears on.
NEAR = [(kind, d) for kind in (1, 2, 3) for d in (1, 2, 3)] + [(4, -1)]
NAMED = {w: kind for kind, words in ((1, PERSON_KEYS), (2, ADDRESS_KEYS), (3, BIRTH_KEYS), (4, STREETS)) for w in words}


def bearing(word: bytes) -> int:
    """1: before a name, 2: before an address, 3: before a birth date, 4: a street, 0: none."""
    core = word.strip(PUNCT).lower()
    return NAMED.get(core) or (4 if core.endswith(STREET_ENDS) else 0)


def nearby(kinds: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, number in NEAR) of all words that a word of their own text bears on."""
    at = np.flatnonzero(kinds)
    text = np.searchsorted(begin, at, "right") - 1
    places, rows = [], []
    for k, (kind, d) in enumerate(NEAR):
        some = kinds[at] == kind
        to = at[some] + d
        ok = (to >= begin[text[some]]) & (to < begin[text[some] + 1])
        places.append(to[ok])
        rows.append(np.full(int(ok.sum()), k))
    return np.concatenate(places), np.concatenate(rows)


def is_plain(word: bytes) -> bool:
    if word.translate(None, LETTERS) not in PLAIN_RESTS:
        return False
    core = word.strip(PUNCT).lower()
    return core not in SECRET_KEYS and core not in ACCOUNT_KEYS and core not in NAMED and not core.endswith(STREET_ENDS)


def is_capital(word: bytes) -> bool:
    """Whether a plain word begins like a name; non-ASCII letters count if they are capitals of Latin-1."""
    core = word.lstrip(PUNCT)
    return core[:1].isupper() and not core[1:].isupper() or core[:1] == b"\xc3" and 0x80 <= core[1] <= 0x9E if len(core) > 1 else False


def features(word: bytes) -> list[int]:
    """Numbers of the features that a word has."""
    if is_plain(word):
        return [AT["bias"], AT["plain"], AT["cap"]] if is_capital(word) else [AT["bias"], AT["plain"]]
    core = word.strip(PUNCT)
    low, b = core.lower(), bearing(word)
    names = ["bias"]
    digits = len(core) - len(core.translate(None, b"0123456789"))
    letters = len(core) - len(core.translate(None, LETTERS))
    if word.strip(b"\"'") in (b"=", b":", b":=", b"=>", b"->"):
        names.append("is_sep")
    elif word.endswith((b"=", b":")):
        names.append("ends_sep")
    names += [n for n, ok in (
        ("digit", digits > 0), ("digits", digits == len(core) > 0), ("letters", letters == len(core) > 0), ("mixed", digits > 0 and letters > 0), ("at", b"@" in core), ("has_sep", b"=" in core or b":" in core),
        ("quoted", word[:1] in b"\"'" and len(word) > 1), ("hex", bool(HEX.fullmatch(core))), ("upper", letters > 0 and core.isupper()), ("lower", letters > 0 and core.islower()), ("dots", b"." in core), ("dashes", b"-" in core), ("slash", b"/" in core),
        ("secret_key", low in SECRET_KEYS), ("account_key", low in ACCOUNT_KEYS), ("iban", bool(IBAN.fullmatch(core))), ("group4", bool(GROUP4.fullmatch(core))), ("dashed_id", bool(DASHED.fullmatch(core))),
        ("cap", is_capital(word)), ("person_key", b == 1), ("address_key", b == 2), ("birth_key", b == 3), ("street", b == 4), ("date", bool(DATE.fullmatch(core))),
    ) if ok]
    if (m := KEY_VALUE.match(word)) and m[1].lower() in SECRET_KEYS:
        names.append("key_value")
    n = len(core)
    names.append("len<6" if n < 6 else "len<12" if n < 12 else "len<20" if n < 20 else "len<32" if n < 32 else "len>=32")
    turns = sum(1 for _ in islice(TURN.finditer(core), 7)) - 1
    names.append("turns0" if turns < 1 else "turns1" if turns < 3 else "turns3" if turns < 6 else "turns6")
    return [AT[x] for x in names]


# ---- the labelled table --------------------------------------------------------------

#: Sentences of the labelled table.  {s}: a secret, {h}: hexadecimal, {a}: an
#: account number, {k} {e}: a key word and its separator, {p}: a name, {n} {g} {f} {c}: an address
#: (in the order of English, German, French and Spanish), {d}: a date of birth, {W}: a capitalised
#: word, {X}: one in capitals, {q}: symbols; the rest is outside.
SENTENCES = """
the config has {k:token} {e:=} {h} in it
set {k:password} {e:=} {s} before the run
{k:api_key} {e:=} {h}
{k:api_key:} {s} is mine
use {k:secret} {e::} {s} for now
send {k:Bearer} {s} with each call
my {k:token} {e:=} {h} . keep it
{k:client_secret} {e:=} {s}
{k:key} {e:=} {h} and so on
der {k:token} {e:=} {h} gilt noch
le {k:token} {e:=} {h} reste valable
la {k:clave} {e:=} {s} es nueva
{v} was in the log
export {v} and start
{k:IBAN} {a} is on the bill
{k:IBAN:} {a}
pay to {k:account} {a} today
her {k:SSN} {a} was on file
{k:passport} {a} was lost
the key to the house was lost
a token of thanks and a secret plan
the password was weak
my account has 1200 points since 2019
a bearer of news came at 10:30
call +1 (555) 010-9999 or write to a.b@mail.example.com
the server 192.168.10.20 answered in 35 ms
card 4111111111111111 was declined
card 1234567812345678 expires 12/27
version 2.0 of 2004-01-15 costs $19.99 or 20%
room 101 has 2 beds , 3 chairs and 1 table
see https://example.com/a/b?x=1 for more
on 24.12.1999 we met 15 people
a = b and c = 12
x1 y2 z3 are names
chapter 12: the end of part 3
note: this is short
the {w} of {w} and {w} is {w}
{w} {w} {w}, {w} {w}. {w}
{w}!! {w}!! {w}### {w}%%% | {w}
it was 1,000,000 and 3.14159 in 1987
order 00012345 shipped in 2 days
license MIT (c) 2020 all rights reserved
my name is {p} and i work here
his name was {p} , they said
Mr {p} called twice
Dear Mrs {p} , thank you
then Dr. {p} signed the form
Herr {p} kommt morgen
gestern hat Frau {p} angerufen
madame {p} est venue
monsieur {p} a dit non
el señor {p} no vino
name: {p}
Nombre: {p}
Nom : {p}
i live at {n} since May
she lives at {n} now
address: {n}
Adresse: {g}
er wohnt in der {g} seit Mai
ich wohne {g}
elle habite {f} depuis longtemps
Adresse: {f}
vive en {c} desde enero
mi dirección es {c} .
he was born on {d} in Rome
born {d}
date of birth: {d}
DOB {d}
geboren am {d} in Bonn
née le {d} à Lyon
nacido el {d} en Madrid
the name of the game is {w}
her name was on the list
name the file {w} first
{W} {w} {w} {W} {w}
{W} {W} said {w} to {W}
In {W} we met the {w} of {W}
we live in peace and {w}
they live at home with {w}
the street was long and the road was wide
la rue est longue et la calle es larga
born to run in the {w}
he was born in {W} , they say
de la {W} y el {w}
{w} was given birth in {W}
on {D} we met 15 people
{W}. {W} {w} {w}. {W} {w}
{w}{q} {W}{q} {w}{q} {w}, {W}{q} {w}.{q} {w}{q} {w}{q}
{W}{q} {w}{q} {W}.{q} | {w} {w}{q} {w},{q} {W} {w}{q}
{q} {w}{q} {w}{q} the{q} {W}{q} of{q} {w}{q} la{q} {w}{q}
{X} {X} {X}, {X}{q} {X}. {X}{q} {X} {X}
"""


def labelled_rows(copies: int = 12, seed: int = 9, lines: list[str] | None = None) -> list[tuple[list[bytes], list[int]]]:
    """The labelled table: (words, tags) rows, from the sentences above with drawn values."""
    rng = np.random.default_rng(seed)
    draw = lambda chars, n: "".join(chars[i] for i in rng.integers(0, len(chars), n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    quote = lambda x: ('"' + x + '"' + ["", "!!", "###", ".", "%%%"][rng.integers(5)]) if rng.random() < 0.6 else x

    def secret():
        return draw(low + up + dig, int(rng.integers(14, 44)))

    def hexa():
        x = draw("0123456789abcdef", int(rng.choice([16, 32, 40, 64])))
        return x.upper() if rng.random() < 0.3 else x

    cap = lambda: (draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "ÉÖÁ", 1) + draw(low + "éüñ", int(rng.integers(2, 9))))
    number = lambda: str(int(rng.integers(1, 400))) + str(rng.choice(["", "", "", "a"]))
    pick = lambda *xs: str(rng.choice(xs))

    free = {
        "w": lambda: draw(low, int(rng.integers(1, 12))), "W": cap, "X": lambda: draw(up, int(rng.integers(1, 12))), "D": lambda: date(),
        "q": lambda: str(rng.choice(list("#*$%&|<>~^_=!?+-;/"))) * int(rng.integers(1, 4)),
    }

    def date():
        y, m, d = int(rng.integers(1920, 2012)), int(rng.integers(1, 13)), int(rng.integers(1, 29))
        return pick(f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m}/{d}/{y}", f"{d}/{m}/{y}")

    def street(kind: str):
        if kind == "n":
            return [number(), cap(), pick("Street", "Road", "Avenue", "Lane", "Square")]
        if kind == "g":
            return [cap() + pick("straße", "strasse"), number()] if rng.random() < 0.7 else [cap(), "Platz", number()]
        if kind == "f":
            return [number(), pick("rue", "avenue", "boulevard"), *(cap() for _ in range(int(rng.integers(1, 3))))]
        return [pick("calle", "avenida", "plaza", "Calle"), cap(), number()]

    rows = []
    for line in (lines or SENTENCES.strip().split("\n")):
        for _ in range(copies):
            words, tags = [], []
            shout = rng.random() < 0.15
            for part in line.split(" "):
                m = re.fullmatch(r"\{([ksehvapngfcd])(?::(.+))?\}", part)
                if not m:
                    word = re.sub(r"\{([wWDXq])\}", lambda x: free[x[1]](), part)
                    new = [(word.upper() if shout else word, OUT)]
                elif m[1] == "k":
                    new = [(m[2].upper() if shout else m[2], KEY)]
                elif m[1] == "e":
                    new = [(m[2], SEP)]
                elif m[1] in "sh":
                    new = [(quote(secret() if m[1] == "s" else hexa()), SECRET)]
                elif m[1] == "p":
                    new = [(cap(), PERSON) for _ in range(int(rng.integers(1, 4)))]
                elif m[1] in "ngfc":
                    new = [(x, ADDRESS) for x in street(m[1])]
                elif m[1] == "d":
                    new = [(date(), BIRTH)]
                elif m[1] == "v":
                    new = [(str(rng.choice(["token", "api_key", "password", "secret"])) + "=" + quote(secret()), SECRET)]
                else:
                    kind = rng.integers(4)
                    iban = draw(up, 2) + draw(dig, 2)
                    if kind == 0:
                        new = [(iban + draw(dig, 18), ACCOUNT)]
                    elif kind == 1:
                        new = [(iban, ACCOUNT), *((draw(dig, 4), ACCOUNT) for _ in range(4)), (draw(dig, 2), ACCOUNT)]
                    elif kind == 2:
                        new = [(f"{draw(dig, 3)}-{draw(dig, 2)}-{draw(dig, 4)}", ACCOUNT)]
                    else:
                        new = [(draw(up, 1) + draw(dig, 8), ACCOUNT)]
                words += [w.encode() for w, _ in new]
                tags += [t for _, t in new]
            rows.append((words, tags))
    return rows


# ---- the random field ----------------------------------------------------------------


@dataclass
class Field:
    weights: np.ndarray  # feature by tag; those of NEAR come last
    moves: np.ndarray  # from tag to tag; text begins and ends outside

    def emissions(self, words: list[bytes]) -> np.ndarray:
        out = np.empty((len(words), len(TAGS)))
        plain = self.weights[[AT["bias"], AT["plain"]]].sum(0)
        capital = plain + self.weights[AT["cap"]]
        for i, w in enumerate(words):
            out[i] = (capital if is_capital(w) else plain) if is_plain(w) else self.weights[features(w)].sum(0)
        return out

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Emissions of the words of one text, with what they bear on each other."""
        out = self.emissions(words)
        kinds = np.fromiter(map(bearing, words), np.int8, len(words))
        place, row = nearby(kinds, np.array([0, len(words)]))
        np.add.at(out, place, self.weights[len(FEATURES) + row])
        return out

    def anchors(self, emissions: np.ndarray) -> np.ndarray:
        """Words that are outside on every best path."""
        gain = (self.moves - self.moves[:, [OUT]]).max(0) + (self.moves - self.moves[[OUT], :]).max(1)
        lead = emissions[:, [OUT]] - emissions - gain[None, :]
        lead[:, OUT] = np.inf
        return lead.min(1) > 0


def train(rows: list[tuple[list[bytes], list[int]]], steps: int = 250, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by Adam; expected counts come from forward and backward passes."""
    n, k = len(rows), len(TAGS)
    longest = max(len(w) for w, _ in rows)
    x = np.zeros((n, longest, len(FEATURES) + len(NEAR)))
    y = np.zeros((n, longest), int)
    live = np.zeros((n, longest), bool)
    for i, (words, tags) in enumerate(rows):
        for t, w in enumerate(words):
            x[i, t, features(w)] = 1
        place, row = nearby(np.fromiter(map(bearing, words), np.int8, len(words)), np.array([0, len(words)]))
        x[i, place, len(FEATURES) + row] = 1
        y[i, : len(tags)] = tags
        live[i, : len(words)] = True
    hot = np.eye(k)[y] * live[:, :, None]
    previous = np.concatenate((np.full((n, 1), OUT), y[:, :-1]), 1)
    seen_w = np.einsum("ntf,ntk->fk", x, hot)
    seen_m = np.einsum("nta,ntb->ab", np.eye(k)[previous] * live[:, :, None], hot)
    ends = live.sum(1)
    np.add.at(seen_m, (y[np.arange(n), ends - 1], OUT), 1)
    w, m = np.zeros((len(FEATURES) + len(NEAR), k)), np.zeros((k, k))
    moments = [np.zeros_like(a) for a in (w, w, m, m)]
    lse = lambda a, axis: (top := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - top).sum(axis))
    for step in range(1, steps + 1):
        e = x @ w
        ahead, behind = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        ahead[:, 0] = m[OUT] + e[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(live[:, t, None], lse(ahead[:, t - 1, :, None] + m[None], 1) + e[:, t], ahead[:, t - 1])
        last = ahead[:, -1] + m[:, OUT]
        z = lse(last, 1)
        behind[:, -1] = m[:, OUT]
        for t in range(longest - 2, -1, -1):
            behind[:, t] = np.where(live[:, t + 1, None], lse(m[None] + (e[:, t + 1] + behind[:, t + 1])[:, None, :], 2), m[:, OUT])
        p = np.exp(ahead + behind - z[:, None, None]) * live[:, :, None]
        pair = ahead[:, :-1, :, None] + m[None, None] + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None]
        hope_m = (np.exp(pair) * live[:, 1:, None, None]).sum((0, 1))
        hope_m[OUT] += p[:, 0].sum(0)
        hope_m[:, OUT] += np.exp(last - z[:, None]).sum(0)
        for a, g, m1, m2 in ((w, np.einsum("ntf,ntk->fk", x, p) - seen_w, *moments[:2]), (m, hope_m - seen_m, *moments[2:])):
            g = g / n + ridge * a
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            a -= 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    return Field(w, m)


def viterbi(emissions: np.ndarray, begin: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of many runs at once; run i has the rows begin[i] to begin[i + 1]."""
    lens = np.diff(begin)
    order = np.argsort(-lens, kind="stable")
    start, lens = begin[:-1][order], lens[order]
    out = np.zeros(len(emissions), np.int64)
    if not len(lens) or not lens[0]:
        return out
    score = moves[OUT][None, :] + emissions[start[lens > 0]]
    back = []
    final = np.zeros(len(lens), np.int64)
    t, live = 0, len(score)
    while live:
        more = int((lens > t + 1).sum())
        final[more:live] = (score[more:live] + moves[:, OUT]).argmax(1)
        if not more:
            break
        paths = score[:more, :, None] + moves[None]
        back.append(paths.argmax(1).astype(np.int8))
        score = paths.max(1) + emissions[start[:more] + t + 1]
        t, live = t + 1, more
    tag = final
    for t in range(int(lens[0]) - 1, -1, -1):
        m = int((lens > t).sum())
        out[start[:m] + t] = tag[:m]
        if t:
            tag[:m] = np.take_along_axis(back[t - 1][:m], tag[:m, None].astype(np.int64), 1)[:, 0]
    return out


WORD = re.compile(rb"[^\x20\x09-\x0D]+")
VALUE = re.compile(rb"[A-Za-z0-9\x80-\xff](?:[^\"'\x20]*[A-Za-z0-9\x80-\xff])?")


class Finder:
    def __init__(self, field: Field):
        self.field = field
        self.cache = WordCache(self._build, self._reset, lambda at: (self.emission.keep(at), self.anchor.keep(at), self.kind.keep(at)))

    def _reset(self) -> None:
        self.emission, self.anchor, self.kind = Grow(np.float64, len(TAGS)), Grow(np.bool_), Grow(np.int8)

    def _build(self, words: list[bytes]) -> None:
        e = self.field.emissions(words)
        self.emission.extend(e)
        self.anchor.extend(self.field.anchors(e))
        self.kind.extend(np.fromiter(map(bearing, words), np.int8, len(words)))

    def tagged(self, texts: list[bytes]) -> dict[int, list[tuple[int, int]]]:
        """By document: (word, tag) of the words tagged as personal data."""
        at, begin = self.cache.number([t.split() for t in texts])
        anchor = self.anchor.a[at]
        place, row = nearby(self.kind.a[at], begin)
        moved, index = np.unique(place, return_inverse=True)
        score = self.emission.a[at[moved]]
        np.add.at(score, index, self.field.weights[len(FEATURES) + row])
        anchor[moved] = self.field.anchors(score)
        open_ = np.flatnonzero(~anchor)
        emission = self.emission.a[at[open_]]
        if len(open_):
            k = np.minimum(np.searchsorted(open_, moved), len(open_) - 1)
            inside = open_[k] == moved
            emission[k[inside]] = score[inside]
        doc = np.searchsorted(begin, open_, "right") - 1
        cut = np.flatnonzero((np.diff(open_) != 1) | (np.diff(doc) != 0)) + 1
        runs = np.concatenate(([0], cut, [len(open_)])) if len(open_) else np.zeros(1, np.int64)
        tags = viterbi(emission, runs, self.field.moves)
        found: dict[int, list[tuple[int, int]]] = {}
        for i in np.flatnonzero(tags >= SECRET):
            found.setdefault(int(doc[i]), []).append((int(open_[i] - begin[doc[i]]), int(tags[i])))
        return found

    def added(self, text: bytes, marks: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, kind, end) in bytes; neighbouring words of one kind make one span, but each secret is its own.

        An address has a digit.
        """
        spans: list[tuple[int, int, int]] = []
        wanted = dict(marks)
        last, closed = -2, False
        for k, m in enumerate(WORD.finditer(text)):
            if k not in wanted:
                continue
            kind = wanted[k] + 1  # the added kinds follow the base kinds
            skip = kv.start(2) if (kv := KEY_VALUE.match(m[0])) and kv[1].lower() in SECRET_KEYS else 0
            v = VALUE.search(m[0], skip)
            if not v:
                continue
            start, end = m.start() + v.start(), m.start() + v.end()
            if kind > 4 and last == k - 1 and spans and spans[-1][1] == kind and not closed:
                spans[-1] = (spans[-1][0], kind, end)
            else:
                spans.append((start, kind, end))
            last = k
            # a name or an address does not go on after the end of a sentence
            closed = kind > 5 and m[0][-1:] in b".!?;"
        return [x for x in spans if x[1] != 7 or DIGIT.search(text, x[0], x[2])]

    def find(self, texts: list[bytes]) -> list[tuple[list, list]]:
        """By document: base spans and all spans, (start, kind, end) in code points."""
        marks = self.tagged(texts)
        out = []
        for i, text in enumerate(texts):
            base = base_spans(text)
            more = [s for s in self.added(text, marks[i]) if all(s[2] <= b[0] or b[2] <= s[0] for b in base)] if i in marks else []
            if (base or more) and not text.isascii():
                edges = sorted({p for s in (*base, *more) for p in (s[0], s[2])})
                points, where, last = 0, {}, 0
                for p in edges:
                    points += len(text[last:p].decode("utf-8", "replace"))
                    where[p], last = points, p
                base, more = ([(where[a], k, where[b]) for a, k, b in x] for x in (base, more))
            out.append((base, sorted([*base, *more])))
        return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _rows(broadcast):
    def run(batches) -> Iterator:
        import pyarrow as pa

        finder = Finder(broadcast.value)
        for part, texts in chunked(batches, 1):
            found = finder.find(texts)
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            sha = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found])
            yield pa.RecordBatch.from_arrays([part.column(0), *counts, sha, pa.array([listed(x) for _, x in found], pa.string())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def find(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of base spans, their hash and the list of all spans of every document."""
    spark = df.sparkSession
    ship(spark)
    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_rows(spark.sparkContext.broadcast(field)), SCHEMA)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), train(labelled_rows()))
