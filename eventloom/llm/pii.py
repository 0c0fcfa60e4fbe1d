"""Personal information in free text, found by a linear-chain conditional random field.

Tokens are words, numbers and single signs. The score of a tag at a token is a sum over features of
the tokens from REACH before to REACH behind it: word, shape, first and last letters, membership in
the tables of names and brands, and what stands before the token. Since a feature depends on one
token only, each distinct token is scored once per place in the window, a text's scores are sums of
looked-up rows, and Viterbi runs over thousands of windows at once in numpy.

The model is trained in the driver from a labelled table of a few hundred sentences. Spans in it are
replaced at random by others of their kind, so that the model learns the surroundings and the
shapes rather than the values. Texts are decoded whole, in windows that overlap by more than
any span.
"""

from __future__ import annotations

import hashlib
import random
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from eventloom.frames import pick
from eventloom.llm import pii_table as table

KINDS = ("email", "phone", "id_number", "address", "name")
TAGS = ["O"] + [f"{b}-{k}" for k in KINDS for b in "BI"]
TAG = {t: i for i, t in enumerate(TAGS)}
REACH = 4
#: What the tag of no information gives away: finds are checked afterwards, misses are not.
LENIENCE = 1.5
#: Tokens of a window that count, and that are read before and behind them.
CORE, MARGIN = 320, 24
#: Variants made of each labelled sentence, and passes over them in training.
VARIANTS, PASSES, BATCH, RATE, DECAY = 10, 7, 200, 0.08, 2e-6
#: Share of the tokens outside of spans whose word is hidden in a pass of training, so that shapes,
#: tables and the rest of the surroundings must do without it.
HIDDEN = 0.35
#: Rows of a table of names or items; the recogniser is broadcast with them, and more are refused.
GAZETTEER = 100_000

TOKEN = regex.compile(r"(\s*)(\p{L}[\p{L}\p{M}]*|\p{N}+|\S)")
AGAIN = regex.compile(r"(\p{L})\1{2,}")


# --- tokens and features -------------------------------------------------------------------


def tokens_of(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Tokens, each with a first character that tells what stands before it (nothing, blank, line
    break), and the places in the text where they begin and end."""
    pairs = TOKEN.findall(text)
    if not pairs:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    blanks, words = zip(*pairs)
    size = np.fromiter(map(len, words), np.int64, len(pairs))
    end = np.cumsum(size + np.fromiter(map(len, blanks), np.int64, len(pairs)))
    out = [("_" if b == " " else "." if not b else "^" if "\n" in b else "_") + w for b, w in pairs]
    if not blanks[0]:
        out[0] = "^" + words[0]
    return out, end - size, end


def features(token: str, given: set[str], family: set[str], brand: set[str], hidden: bool = False) -> list[str]:
    """Names of a token's features; ``hidden``: without those that tell its word."""
    flag, s = token[0], token[1:]
    out = ["*", "f" + flag]
    c = s[0]
    if c.isalpha():
        low = AGAIN.sub(r"\1", s.lower())
        case = "X" if len(s) == 1 and c.isupper() else "XX" if s.isupper() else "Xx" if c.isupper() else "xx"
        size = min(len(s), 4)
        out += ["s" + case, f"n{case}{size}", "sf" + case + flag]
        if not hidden:
            out += ["w" + low[:24], "a" + low[:3], "z" + low[-3:], "y" + low[-4:]]
        known = (low in given) * 1 + (low in family) * 2 + (low in brand) * 4
        out += [f"g{known}", f"gs{known}{case}"]
    elif c.isnumeric():
        out += [f"d{min(len(s), 16)}", "s9", f"d{min(len(s), 16)}{flag}", f"q{s[:2]}{len(s)}", "p" + s[0]]
        if len(s) <= 4:
            out.append("w" + s)
    else:
        out += ["w" + c, "s!", "wf" + c + flag]
    return out


# --- training data -------------------------------------------------------------------------


class Maker:
    """Variants of labelled sentences; the same seed gives the same ones."""

    SPAN = regex.compile(r"\[(email|phone|id_number|address|name|code|item|brand|word)\|((?:[^\[\]]|\[(?:at|dot)\])*)\]")

    def __init__(self, given: list[str], family: list[str], brands: list[str], items: list[str], seed: int = 7):
        self.r = random.Random(seed)
        self.given, self.family = sorted(given) or ["Anna"], sorted(family) or ["Muster"]
        self.brands, self.items = sorted(brands) or ["Quillon"], sorted(items) or ["Talara X1"]
        self.other_given, self.other_family = table.OTHER_GIVEN.split(), table.OTHER_FAMILY.split()
        self.streets, self.phones, self.numbers, self.codes = (x.strip().split("\n") for x in (table.STREETS, table.PHONES, table.NUMBERS, table.CODES))
        self.lines = [self.parse(x) for x in table.SENTENCES.strip().split("\n")]

    def parse(self, line: str) -> list[tuple[str, str]]:
        out, at = [], 0
        for m in self.SPAN.finditer(line):
            out += [("", line[at : m.start()]), (m[1], m[2])]
            at = m.end()
        return [x for x in [*out, ("", line[at:])] if x[1]]

    def word(self) -> str:
        w = "".join(self.r.choices(table.SYLLABLES.split(), k=self.r.randint(2, 4)))
        return w.capitalize() if self.r.random() < 0.6 else w

    def filled(self, pattern: str) -> str:
        return "".join(self.r.choice("0123456789") if c == "d" else self.r.choice("ABCDEFGHKMNRSWX") if c == "A" and pattern[:1] != "A" else c for c in pattern)

    def name(self) -> str:
        r = self.r
        made = lambda: r.choice(table.FAMILY_STARTS.split()) + r.choice(table.FAMILY_ENDS.split()) if r.random() < 0.7 else self.word().capitalize()
        one = lambda known, other, new: r.choice(known) if r.random() < 0.5 else r.choice(other) if r.random() < 0.55 else new()
        given = lambda: one(self.given, self.other_given, lambda: self.word().capitalize())
        family = lambda: one(self.family, self.other_family, made)
        g, f = given(), family()
        form = r.random()
        if form < 0.12:
            g = f"{g}-{given()}"
        elif form < 0.2:
            f = f"{f}-{family()}"
        elif form < 0.32:
            g = f"{g} {g[0]}."
        elif form < 0.44:
            g = f"{g[0]}."
        n = f"{f}, {g}" if 0.44 < form < 0.56 else f"{g} {f}"
        return n.upper() if r.random() < 0.08 else n.lower() if r.random() < 0.08 else n

    def address(self, like: str) -> str:
        r = self.r
        n = str(r.randint(1, 260))
        if regex.search(r"box|postfach", like.lower()):
            return f"{'PO Box' if 'box' in like.lower() else 'Postfach'} {r.randint(100, 9999)}"
        if regex.search(r"\b(rue|avenue d|bd|chemin)\b", like):
            return f"{n}{r.choice(['', '', ' bis'])}{r.choice(['', ','])} {r.choice(table.FRENCH_ROADS.split())} {r.choice(table.FRENCH)}"
        if regex.search(r"Calle|Plaza|Avenida|C/", like):
            return f"{r.choice(table.SPANISH_ROADS.split())} {r.choice(table.SPANISH)}{r.choice([' ', ', ', ' nº '])}{n}"
        if regex.search(r"^Am |straße|str\.|weg|gasse", like):
            street = r.choice(table.GERMAN_WHOLE) if r.random() < 0.35 else r.choice(table.GERMAN.split())[:-1] + r.choice(table.GERMAN_ROADS.split())
            return f"{street} {n}{r.choice(['', '', 'a', 'b'])}"
        street = r.choice(self.streets) if r.random() < 0.7 else self.word().capitalize()
        a = f"{n}{r.choice(['', '', '', 'a', 'b', 'c'])} {r.choice(['', '', '', 'N. ', 'S. ', 'E. ', 'W. '])}{street} {r.choice(table.ROADS.split())}"
        if r.random() < 0.25:
            a += f", {r.choice(['Apt ', 'Flat ', 'Unit ', '# '])}{r.randint(1, 40)}{r.choice(['', 'A', 'B', 'C'])}"
        return a.lower() if r.random() < 0.2 else a

    def email(self) -> str:
        r = self.r
        plain = lambda w: regex.sub(r"[^a-z]", "", w.lower()) or "mail"
        g, f = plain(r.choice(self.given)), plain(r.choice(self.family))
        local = r.choice([f"{g}.{f}", f"{f}_{g}", f"{g[0]}{f}", f"{g}{r.randint(1, 99)}", f"{g}-{f}{r.randint(50, 99)}", f"{g}.{f}+shop"])
        domain = r.choice(table.DOMAINS.split())
        form = r.random()
        if form < 0.65:
            e = f"{local}@{domain}"
        elif form < 0.72:
            e = f"{local}＠{domain}"
        elif form < 0.8:
            e = f"{local} @ {domain}"
        elif form < 0.87:
            e = f"{local} (at) {domain}"
        elif form < 0.94:
            e = f"{local} [at] {domain.replace('.', ' [dot] ')}"
        else:
            e = f"{local}＠{domain.replace('.', ' . ')}"
        return e.upper() if r.random() < 0.07 else e

    def value(self, kind: str, old: str) -> str:
        r = self.r
        if r.random() < 0.1:
            return old
        if kind == "phone":
            return self.filled(r.choice(self.phones))
        if kind == "id_number":
            return self.filled(r.choice(self.numbers))
        if kind == "code":
            return self.filled(r.choice(self.codes))
        if kind in ("name", "email"):
            return getattr(self, kind)()
        if kind == "address":
            return self.address(old)
        return self.word() if kind == "word" else r.choice(self.brands if kind == "brand" else self.items)

    def variant(self, line: list[tuple[str, str]]) -> list[tuple[str, str]]:
        r = self.r
        digits = lambda s: regex.sub(r"[0-9]", lambda m: r.choice("0123456789"), s) if r.random() < 0.8 else s
        out = [(k, self.value(k, s) if k else digits(s)) for k, s in line]
        case = r.random()
        if case < 0.05:
            out = [(k, s.upper()) for k, s in out]
        elif case < 0.09:
            out = [(k, s.lower()) for k, s in out]
        elif case < 0.13:
            out = [(k, s[:1].lower() + s[1:] if i == 0 and not k else s) for i, (k, s) in enumerate(out)]
        if r.random() < 0.08:
            i = r.randrange(len(out))
            k, s = out[i]
            if not k and len(s) > 4:
                j = r.randrange(1, len(s) - 1)
                s = s[:j] + s[j] * r.randint(2, 5) + s[j + 1 :] if r.random() < 0.5 else s[: j - 1] + s[j] + s[j - 1] + s[j + 1 :]
                out[i] = (k, s)
        return out

    def sequences(self) -> Iterator[tuple[list[str], list[int]]]:
        """Tokens and tags of sentences among others."""
        r = self.r
        for _ in range(VARIANTS):
            for line in self.lines:
                parts = [*([self.variant(r.choice(self.lines))] if r.random() < 0.6 else []), self.variant(line), *([self.variant(r.choice(self.lines))] if r.random() < 0.6 else [])]
                text, tags, ends = "", [], []
                for i, p in enumerate(parts):
                    text += r.choice([" ", " ", "\n"]) if i else ""
                    for k, s in p:
                        ends.append((len(text), len(text) + len(s), k if k in KINDS else ""))
                        text += s
                words, a, b = tokens_of(text)
                spans = [x for x in ends if x[2]]
                tags = [0] * len(words)
                for lo, hi, k in spans:
                    inside = np.flatnonzero((a >= lo) & (b <= hi))
                    for n, i in enumerate(inside):
                        tags[i] = TAG[("B-" if n == 0 else "I-") + k]
                if words:
                    yield words, tags


# --- the random field ----------------------------------------------------------------------


def _allowed() -> np.ndarray:
    ok = np.ones((len(TAGS), len(TAGS)), bool)
    for i, a in enumerate(TAGS):
        for j, b in enumerate(TAGS):
            if b[0] == "I" and a[2:] != b[2:]:
                ok[i, j] = False
    return ok


class Field:
    """Weights of the features at each place of the window, and of neighbouring tags."""

    def __init__(self, names: dict[str, int], given: set[str], family: set[str], brand: set[str]):
        self.names, self.given, self.family, self.brand = names, given, family, brand
        self.w = np.zeros((2 * REACH + 1, len(names), len(TAGS)), np.float32)
        self.t = np.where(_allowed(), 0.0, -1e4)
        self.start = np.where([t[0] == "I" for t in TAGS], -1e4, 0.0)

    def ids(self, token: str, hidden: bool = False) -> list[int]:
        names = self.names
        return [i for f in features(token, self.given, self.family, self.brand, hidden) if (i := names.get(f)) is not None]

    def scores(self, lists: list[list[int]]) -> np.ndarray:
        """For each token type its share in the score at each place: (places, types, tags)."""
        flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if lists else np.zeros(0, np.int64)
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        begin = np.r_[0, np.cumsum(n)[:-1]] if len(n) else n
        return np.stack([np.add.reduceat(self.w[o][flat], begin, axis=0) for o in range(2 * REACH + 1)]) if len(flat) else np.zeros((2 * REACH + 1, len(lists), len(TAGS)))


def _emissions(parts: np.ndarray, types: np.ndarray) -> np.ndarray:
    """Scores at the places of padded windows of token types (-1: none); (rows, length, tags)."""
    rows, length = types.shape
    with_none = np.concatenate([parts, np.zeros((parts.shape[0], 1, parts.shape[2]), parts.dtype)], axis=1)
    padded = np.pad(types, ((0, 0), (REACH, REACH)), constant_values=-1)
    e = with_none[0][padded[:, :length]].copy()
    for o in range(1, 2 * REACH + 1):
        e += with_none[o][padded[:, o : o + length]]
    return e


def _marginals(e: np.ndarray, size: np.ndarray, t: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected tags (rows, length, tags) and transitions (tags, tags) of padded sequences."""
    rows, length, k = e.shape
    et = np.exp(t)
    f, b = np.zeros_like(e), np.zeros_like(e)
    x = np.exp(e - e.max(2, keepdims=True))
    a = x[:, 0] * np.exp(start)
    f[:, 0] = a / a.sum(1, keepdims=True)
    for i in range(1, length):
        a = (f[:, i - 1] @ et) * x[:, i]
        f[:, i] = a / a.sum(1, keepdims=True)
    live = np.arange(length)[None] < size[:, None]
    b[:, length - 1] = 1
    for i in range(length - 2, -1, -1):
        a = (x[:, i + 1] * b[:, i + 1]) @ et.T
        b[:, i] = np.where(live[:, i + 1, None], a / a.sum(1, keepdims=True), 1)
    m = f * b
    m /= m.sum(2, keepdims=True)
    m *= live[:, :, None]
    right = x[:, 1:] * b[:, 1:]
    z = np.einsum("rik,kj,rij->ri", f[:, :-1], et, right)
    scale = np.where(live[:, 1:], 1 / z, 0)
    pairs = np.einsum("rik,rij->kj", f[:, :-1] * scale[:, :, None], right) * et
    return m, pairs


def train(given: list[str], family: list[str], brands: list[str], items: list[str], seed: int = 7) -> Field:
    """A field from the labelled table; the same tables give the same weights."""
    maker = Maker(given, family, brands, items, seed)
    data = list(maker.sequences())
    low = lambda xs: {w for x in xs for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", x.lower())}
    g, f, b = low(given), low(family), low([*brands, *items])
    types = sorted({w for words, _ in data for w in words})
    at = {w: i for i, w in enumerate(types)}
    seen: dict[str, int] = {}
    for w in types:
        for x in features(w, g, f, b):
            seen[x] = seen.get(x, 0) + 1
    names = {x: i for i, x in enumerate(sorted(seen))}
    field = Field(names, g, f, b)
    # each type once as it is and once with its word hidden
    lists = [np.array(field.ids(w, h), np.int64) for h in (False, True) for w in types]
    order = np.random.default_rng(seed)
    ok = _allowed()
    n_w, m_w, v_w = 0, np.zeros_like(field.w), np.zeros_like(field.w)
    m_t, v_t = np.zeros_like(field.t), np.zeros_like(field.t)
    by_size = sorted(range(len(data)), key=lambda i: len(data[i][0]))
    groups = [by_size[i : i + BATCH] for i in range(0, len(by_size), BATCH)]
    for step in range(PASSES):
        for j in order.permutation(len(groups)):
            rows = [data[i] for i in groups[j]]
            size = np.array([len(w) for w, _ in rows])
            length = int(size.max())
            x, y = np.full((len(rows), length), -1), np.zeros((len(rows), length), np.int64)
            for i, (w, t) in enumerate(rows):
                x[i, : len(w)] = [at[q] for q in w]
                y[i, : len(t)] = t
            x[(x >= 0) & (y == 0) & (order.random(x.shape) < HIDDEN)] += len(types)
            used, small = np.unique(x, return_inverse=True)
            small = small.reshape(x.shape)
            if used[0] == -1:
                used, small = used[1:], small - 1
            mine = [lists[u] for u in used]
            e = _emissions(field.scores(mine), small)
            m, pairs = _marginals(e, size, field.t, field.start)
            live = small >= 0
            m[live, y[live]] -= 1
            both = live[:, 1:]
            np.subtract.at(pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
            flat = np.concatenate(mine)
            owner = np.repeat(np.arange(len(mine)), [len(q) for q in mine])
            by_name = np.argsort(flat, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(flat[by_name]) != 0])
            hit = flat[by_name][cuts]
            n_w += 1
            rate = RATE * (1 - step / PASSES) * (1 - 0.999**n_w) ** 0.5 / (1 - 0.9**n_w)
            per_type = np.empty((2 * REACH + 1, len(mine), len(TAGS)), np.float32)
            for o in range(2 * REACH + 1):
                d = o - REACH
                to = small[:, max(0, d) : length + min(0, d)]
                from_ = m[:, max(0, -d) : length + min(0, -d)]
                k = to >= 0
                cell = (to[k][:, None] * len(TAGS) + np.arange(len(TAGS))).ravel()
                per_type[o] = np.bincount(cell, weights=from_[k].ravel(), minlength=len(mine) * len(TAGS)).reshape(len(mine), len(TAGS))
            now = field.w[:, hit]
            grad = np.add.reduceat(per_type[:, owner[by_name]], cuts, axis=1) / np.float32(len(rows)) + np.float32(DECAY) * now
            first, second = 0.9 * m_w[:, hit] + 0.1 * grad, 0.999 * v_w[:, hit] + 0.001 * grad**2
            m_w[:, hit], v_w[:, hit] = first, second
            field.w[:, hit] = now - np.float32(rate) * first / (np.sqrt(second) + np.float32(1e-8))
            grad = pairs / len(rows)
            m_t, v_t = 0.9 * m_t + 0.1 * grad, 0.999 * v_t + 0.001 * grad**2
            field.t = np.where(ok, field.t - rate * m_t / (np.sqrt(v_t) + 1e-8), -1e4)
    return field


def viterbi(e: np.ndarray, size: np.ndarray, t: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best tags of padded sequences (rows, length). Going forward only the scores of the best ways
    are kept; which tag a way came from is looked up for the best way when going back."""
    rows, length, k = e.shape
    to = t.astype(e.dtype)
    best = np.empty((length, rows, k), e.dtype)
    best[0] = e[:, 0] + start
    one = np.empty((rows, k), e.dtype)
    for i in range(1, length):
        new = best[i]
        np.add(best[i - 1, :, :1], to[0], out=new)
        for j in range(1, k):
            np.add(best[i - 1, :, j : j + 1], to[j], out=one)
            np.maximum(new, one, out=new)
        new += e[:, i]
        over = i >= size
        new[over] = best[i - 1, over]
    out = np.zeros((rows, length), np.int64)
    tag = best[length - 1].argmax(1)
    back = to.T.copy()
    for i in range(length - 1, -1, -1):
        inside = i < size
        out[:, i] = np.where(inside, tag, 0)
        if i:
            tag = np.where(inside, (best[i - 1] + back[tag]).argmax(1), tag)
    return out


class Recogniser:
    """Spans of personal information in texts."""

    def __init__(self, field: Field):
        self.field = field
        self.cache: dict[str, int] = {}
        self.lists: list[list[int]] = []
        self.parts = np.zeros((2 * REACH + 1, 0, len(TAGS)), np.float32)

    def _types(self, words: list[str]) -> np.ndarray:
        """Numbers of token types; new types are scored and kept until there are too many."""
        if len(self.cache) > 300_000:
            self.cache, self.parts = {}, self.parts[:, :0]
        cache = self.cache
        new = [w for w in dict.fromkeys(words) if w not in cache]
        if new:
            base = len(cache)
            cache.update((w, base + i) for i, w in enumerate(new))
            self.parts = np.concatenate([self.parts, self.field.scores([self.field.ids(w) for w in new]).astype(np.float32)], axis=1)
        return np.fromiter((cache[w] for w in words), np.int64, len(words))

    def tags(self, texts: list[list[str]]) -> list[np.ndarray]:
        words = [w for t in texts for w in t]
        types = self._types(words) if words else np.zeros(0, np.int64)
        out = np.zeros(len(words), np.int64)
        windows = []
        at = 0
        for t in texts:
            for c in range(0, len(t), CORE):
                windows.append((at + max(0, c - MARGIN), at + min(len(t), c + CORE + MARGIN), at + c, at + min(len(t), c + CORE)))
            at += len(t)
        windows.sort(key=lambda w: w[1] - w[0])
        begin = 0
        while begin < len(windows):
            # sorted by size, so the windows of a part are about equally long
            part = windows[begin : begin + max(1, 250_000 // (windows[begin][1] - windows[begin][0]))]
            begin += len(part)
            size = np.array([b - a for a, b, _, _ in part])
            x = np.full((len(part), int(size.max())), -1)
            for j, (a, b, _, _) in enumerate(part):
                x[j, : b - a] = types[a:b]
            e = _emissions(self.parts, x)
            e[:, :, 0] -= LENIENCE
            y = viterbi(e, size, self.field.t, self.field.start)
            for j, (a, _, c, d) in enumerate(part):
                out[c:d] = y[j, c - a : d - a]
        return np.split(out, np.cumsum([len(t) for t in texts])[:-1]) if texts else []

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Begin, end and kind of the spans in each text, checked, in order, without overlaps."""
        taken = [tokens_of(t) for t in texts]
        found = []
        for text, (_, a, b), y in zip(texts, taken, self.tags([w for w, _, _ in taken])):
            mine: list[tuple[int, int, str]] = []
            hits = np.flatnonzero(y)
            i = 0
            while i < len(hits):
                j = i
                kind = TAGS[y[hits[i]]][2:]
                while j + 1 < len(hits) and hits[j + 1] == hits[j] + 1 and TAGS[y[hits[j + 1]]] == f"I-{kind}":
                    j += 1
                s = checked(text, int(a[hits[i]]), int(b[hits[j]]), kind, self.field)
                if s and not (mine and s[0] < mine[-1][1]):
                    mine.append(s)
                i = j + 1
            found.append(mine)
        return found


# --- exact check of what the field found ---------------------------------------------------

# How the parts of an e-mail address and of a street address are written.
DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\s\.\s)"
EMAIL = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}._+\-]*\s?(?:@|＠|\(at\)|\[at\])\s?[\p{L}\p{N}\-]+(?:" + DOT + r"[\p{L}\p{N}\-]+)+", regex.I)
SPOKEN = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}._+\-]*\sat\s[\p{L}\p{N}\-]+(?:\s(?:dot|punkt|point|punto)\s[\p{L}\p{N}\-]+)+", regex.I)
PHONE = regex.compile(r"(?:\+\s?)?\(?\p{N}[\p{N}\s().\-‑–/]*\p{N}")
NUMBER = regex.compile(r"(?<![\p{L}\p{N}])(?:\p{Lu}{2}\s{1,3})?[\p{L}\p{N}]+(?:(?:\s?[\-‑–/]\s?|\.(?=[\p{N}\-])|\.-|\s{1,3})[\p{L}\p{N}]+)*(?![\p{L}\p{N}])")
MOMENT = regex.compile(r"(?:19|20)\p{N}{2}-\p{N}{2}-\p{N}{2}(?!\p{N})|\p{N}{1,3}(?:\.\p{N}{1,3}){3}$")
TWICE = regex.compile(r"(.{6,}?)[\s(.,;!]+\1[)!.]?", regex.DOTALL)
LAST = regex.compile(r"[\s,.;:!?()\[\]<>\"'。、]+$")
FIRST = regex.compile(r"^[^\p{L}\p{N}]+")
TITLE = regex.compile(r"^(?:(?:dr|mr|mrs|ms|nurse|doctor|frau|herrn?|sra?|mme)\.?\s+)+", regex.I)
ADDRESSES = [
    regex.compile(p, regex.I)
    for p in (
        r"[0-9]+\s?[a-d]?\s+(?:[NSEW]\.?\s+)?(?:[\p{L}'\-]+\.?\s+){1,3}?(?:st\b\.?|(?:rd|ave|blvd|ln|dr)\b(?:\.(?=[.,]))?|(?:street|road|lane|avenue|way|close|crescent|drive|court|square|terrace|place)\b)(?:,?\s+(?:(?:apt|flat|unit|suite|no)\.?|\#)\s*[0-9]+[a-z]?\b)?",
        r"[0-9]+(?:\s+(?:bis|ter))?,?\s+(?:rue|avenue|bd|boulevard|chemin|place|allée|impasse|quai)\s+(?:(?:des?|du|la|le|les|d'|l')\s*){0,2}[\p{L}'\-]+",
        r"(?:calle|plaza|c/|avenida|avda\.?|paseo|camino)\s*(?:(?:del?|las?|los?|el)\s+){0,2}[\p{L}\-]+,?\s+(?:n\.?º\s*)?[0-9]+[a-d]?\b",
        r"(?:(?:am|im|an\s+der|zum)\s+[\p{L}\-]+|[\p{L}\-]+(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|ufer|damm))\s+[0-9]+[a-d]?\b",
        r"(?:p\.?\s*o\.?\s*box|postfach|apartado|bp)\s+[0-9]+",
    )
]

#: Words that the labelled sentences write in lower case outside of spans.
OTHER_NAMES = {w.lower() for w in f"{table.OTHER_GIVEN} {table.OTHER_FAMILY}".split()}
PLAIN_WORDS = {w for line in table.SENTENCES.split("\n") for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", Maker.SPAN.sub(" ", line)) if w == w.lower()}



def _further(text: str, a: int, b: int) -> int:
    """Where a number ends that goes on behind its span with the same separator."""
    s = text[a:b].rstrip()
    signs = regex.findall(r"[^\p{L}\p{N}()+]", s)
    if not signs:
        return b
    sign = regex.escape(signs[-1])
    at = a + len(s) - (s[-1] == signs[-1])
    more = regex.compile(r"(?:" + sign + r"\p{N}{2," + ("8" if signs[-1] == "/" else "4") + r"}(?!\p{N})(?!\.\p{N}))+").match(text, at)
    return max(b, more.end()) if more else b


def checked(text: str, a: int, b: int, kind: str, field: Field) -> tuple[int, int, str] | None:
    """The exact span of a find, or None if it can't be of its kind."""
    if kind == "email":
        for pattern in (EMAIL, SPOKEN):
            for m in pattern.finditer(text, max(0, a - 80), min(len(text), b + 80)):
                if m.start() < b and m.end() > a:
                    return m.start(), m.end(), kind
        return None
    if kind == "phone":
        lo = a - 1 if a and text[a - 1] in "+(" else a
        lo = lo - 1 if lo and text[lo - 1] == "+" else lo
        hi = _further(text, a, b)
        m = PHONE.search(text, lo, hi)
        if m and m[0].count("(") != m[0].count(")"):
            m = PHONE.search(text, m.start() + 1, hi)
        if m and (twice := TWICE.fullmatch(m[0])):
            m = PHONE.search(text, m.start(), m.start() + twice.end(1))
        digits = sum(c.isnumeric() for c in m[0]) if m else 0
        return (m.start(), m.end(), kind) if m and 7 <= digits <= 15 and not MOMENT.match(m[0]) else None
    if kind == "id_number":
        lo = a
        if (left := regex.compile(r"(?<![\p{L}\p{N}])\p{Lu}{2}\s{0,3}$").search(text, max(0, a - 5), a)) and text[a].isnumeric() and left[0].strip() not in ("ID", "NO", "NR"):
            lo = left.start()
        hi = _further(text, a, b)
        if tail := regex.compile(r"(?:-|\s)?\p{Lu}(?![\p{L}\p{N}'’])").match(text, hi):
            hi = tail.end() if text[hi : hi + 1] == "-" or text[lo].isalpha() and not text[hi - 1].isalpha() else hi
        m = NUMBER.search(text, lo, hi)
        if m and (twice := TWICE.fullmatch(m[0])):
            m = NUMBER.search(text, m.start(), m.start() + twice.end(1))
        digits = sum(c.isnumeric() for c in m[0]) if m else 0
        return (m.start(), m.end(), kind) if m and not MOMENT.match(m[0]) and 4 <= digits <= 16 and 7 <= sum(c.isalnum() for c in m[0]) <= 18 else None
    s = text[a:b]
    a += len(s) - len(FIRST.sub("", s))
    s = FIRST.sub("", s)
    if kind == "address":
        for pattern in ADDRESSES:
            for m in pattern.finditer(text, max(0, a - 2), min(len(text), b + 8)):
                if m.start() < b and m.end() > a:
                    return m.start(), m.end(), kind
        return None
    m = TITLE.match(s)
    if m:
        a, s = a + m.end(), s[m.end() :]
    stop = regex.search(r"(?<=\p{L}{2})[.!?]\s|[\n<>(){}|]", s)
    s = s[: stop.start()] if stop else s
    end = LAST.sub("", s)
    if regex.search(r"(?:^|[\s,])\p{Lu}$", end) and s[len(end) :].startswith("."):
        end += "."
    words = regex.findall(r"\p{L}[\p{L}\p{M}]*", end)
    known = lambda w: w.lower() in field.given or w.lower() in field.family
    if any(len(w) > 1 and not known(w) and (AGAIN.sub(r"\1", w.lower()) in PLAIN_WORDS or (w[0].islower() and end != end.lower())) for w in words):
        return None
    # in small letters throughout only a known name shows that it is one
    if end == end.lower() and not any(known(w) or w.lower() in OTHER_NAMES for w in words):
        return None
    if twice := TWICE.fullmatch(end):
        end = twice[1]
    # a letter behind a number belongs to the number
    if regex.match(r"\p{L}\.\s", end) and regex.search(r"\p{N}\s?$", text[max(0, a - 3) : a]):
        return None
    if any(not regex.match(r"\p{Latin}", w) for w in words) or (a and text[a - 1] in "'’") or len(regex.findall(r"\p{M}", end)) > 3 or regex.search(r"'(?:ll|s|t|ve|m)\b", end, regex.I) or len(words) < 2 or not any(len(w) > 1 for w in words) or any(c.isnumeric() for c in end):
        return None
    if all(w.lower() in field.brand for w in words if len(w) > 1) and not any(w.lower() in field.given | field.family for w in words):
        return None
    return a, a + len(end), kind


# --- operators -----------------------------------------------------------------------------


def masked_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, k in spans:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


@lru_cache(maxsize=4)
def _trained(given: tuple[str, ...], family: tuple[str, ...], brands: tuple[str, ...], items: tuple[str, ...], version: str) -> Field:
    return train(list(given), list(family), list(brands), list(items))


def recogniser_field(person_names: DataFrame, items: DataFrame) -> Field:
    """The trained field for tables of names (``name, kind``) and items (``item_name, brand``), of
    each at most GAZETTEER distinct entries: they are definitions, and larger tables are refused.
    Trained once a session for the same tables."""
    names = pick(person_names, "name", "kind").filter("name is not null").distinct().limit(GAZETTEER + 1).collect()
    goods = pick(items, "item_name", "brand").distinct().limit(GAZETTEER + 1).collect()
    if max(len(names), len(goods)) > GAZETTEER:
        raise ValueError(f"a table of names or items has more than {GAZETTEER} rows")
    version = hashlib.md5(table.SENTENCES.encode()).hexdigest()
    of = lambda kind: tuple(sorted({r["name"] for r in names if r["kind"] == kind}))
    return _trained(of("given"), of("family"), tuple(sorted({r["brand"] for r in goods if r["brand"]})), tuple(sorted({r["item_name"] for r in goods if r["item_name"]})), version)


#: A worker keeps the recogniser of the query it works for.
_RECOGNISERS: dict[str, Recogniser] = {}


def _annotated(documents: DataFrame, field: Field, key: str, text: str, answer, schema: str) -> DataFrame:
    """answer: (key, text, spans) of texts -> rows. Texts go in groups of about a million
    characters, so that a worker's memory is bounded by that and its longest text."""
    shared, query = documents.sparkSession.sparkContext.broadcast(field), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if query not in _RECOGNISERS:
            _RECOGNISERS.clear()
            _RECOGNISERS[query] = Recogniser(shared.value)
        r = _RECOGNISERS[query]
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            begin, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size > 400_000 or i == len(texts) - 1:
                    part = texts[begin : i + 1]
                    yield answer(keys.slice(begin, i + 1 - begin), part, r.spans([t or "" for t in part]))
                    begin, size = i + 1, 0

    d = pick(documents, key, text).toDF("_k", "_t")
    return d.mapInArrow(run, f"_k {d.schema['_k'].dataType.simpleString()}, {schema}").withColumnRenamed("_k", key)


def personal_information(documents: DataFrame, person_names: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, kind, found``: one row per document, kind and distinct string, exactly as it stands
    in the text. Null, empty and blank texts have none. Rows that repeat a document repeat its finds."""

    def answer(keys, texts, spans) -> pa.RecordBatch:
        rows = [list(dict.fromkeys((k, t[a:b]) for a, b, k in s)) for t, s in zip(texts, spans)]
        at = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        flat = [x for y in rows for x in y]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array([k for k, _ in flat], pa.string()), pa.array([f for _, f in flat], pa.string())], names=["_k", "kind", "found"])

    return _annotated(documents, recogniser_field(person_names, items), key, text, answer, "kind string, found string")


def without_personal_information(documents: DataFrame, person_names: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text``: every document with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME] in the
    place of what was found, otherwise unchanged; null stays null. One row per input row."""

    def answer(keys, texts, spans) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, pa.array([None if t is None else masked_text(t, s) for t, s in zip(texts, spans)], pa.string())], names=["_k", "text"])

    return _annotated(documents, recogniser_field(person_names, items), key, text, answer, "text string")
