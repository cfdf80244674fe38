"""Problem 9: evaluation texts leaking into training text.

One Aho-Corasick automaton over the normalised test questions and answers scans every document
once. As a leak may be damaged, its entries are the three-word windows of the items' sentences, of
which an unaltered one is left in any leak; a hit's word offset maps back to the original text.
Around a hit the sentence, or a run of RUN words, is aligned with the document word by word.

Items may be written to one pattern ("Critics of the X plan cite ..."). A window is a sentence's own
if all sentences that have it are versions of one another; only own windows are searched for, and an
alignment counts if some of the unit's own windows are in it. A passage held by any number of items
is one sentence with many items.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from itertools import accumulate

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.runtime import table

RUN = 15
#: Sentences of fewer words are quotations.
LEAST_SENTENCE = 8
#: Share of a sentence's or run's words that may be altered, added or damaged.
ERRORS = 0.2
#: Sentences whose words are alike to this share are versions of one another.
VERSION = 0.7
#: Share of a unit's own windows that an alignment must hold, and one at least; a run with every sixth word altered keeps half.
OWN = 0.2
#: Bound of the items' text that is sent to every task.
MAX_ITEM_CHARS = 20_000_000

# The words of which instructions to examinees are made; a sentence of nothing else is a stock instruction.
STOCK_WORDS = set(
    "a all allowed also and answer answers any are as at attempt be between book booklet box brackets by calculate calculator calculators carefully carry candidates choose clear clearly complete correct diagram diagrams do draw each equal every exam "
    "examination explain fewer following for from full give given graph have in ink instructions is it least less line lines make mark marked marks may method minutes more most must no not note number of on one only or other own page pages paper part parts "
    "pencil pens permitted please point points provide provided question questions quote read reason reasons required right round section sections sentence sentences sheet should show shown space state steps support table terms than the these this three "
    "time to total two unit units use used using want where with words work working write written you your".split()
)

_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,80}>|&(?:nbsp|amp|quot|lt|gt|#\d+);|[​-‏⁠﻿­]")
_BREAK = re.compile(r"(?<=[^\W\d_])[-‐]\s*\n\s*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_APOSTROPHE = re.compile(r"(?<=\w)['’`´](?=\w)")


_ASCII_WORD = re.compile(r"[a-z0-9\x00]+")


def normal_words(text: str, offsets: bool = True) -> tuple[list[str], list[int]]:
    """Words without markup, case, marks and line-break hyphens, and each word's offset in the text if asked for."""
    plain = text.isascii()
    cover = [m.span() for m in _TAG.finditer(text)] if not plain or "<" in text or "&" in text else []
    if "\n" in text and ("-" in text or "‐" in text):
        cover += [m.span() for m in _BREAK.finditer(text)]
    cover.sort()
    pieces, at, skip, done = [], 0, [], 0
    for s, e in cover:
        if s < at:
            continue
        piece = text[at:s] + (" " if text[s] in "<&" else "")
        pieces.append(piece)
        done += len(piece)
        skip.append((done, e))
        at = e
    pieces.append(text[at:])
    flat = _APOSTROPHE.sub("\x00", "".join(pieces))
    if plain and not offsets:
        words = _ASCII_WORD.findall(flat.lower())
        return ([w.replace("\x00", "") for w in words] if "\x00" in flat else words), []
    words, starts, k, shift = [], [], 0, 0
    for m in re.finditer(r"[^\W_\x00](?:[^\W_]|\x00)*", flat):
        while k < len(skip) and skip[k][0] <= m.start():
            shift = skip[k][1] - skip[k][0]
            k += 1
        w = m.group().replace("\x00", "")
        words.append(w.lower() if w.isascii() else unicodedata.normalize("NFKC", w).casefold())
        starts.append(m.start() + shift)
    return words, starts


def is_stock(words: list[str]) -> bool:
    """Whether a sentence is an instruction on how to answer, by its form."""
    return bool(words) and all(w in STOCK_WORDS or w.isdigit() for w in words)


def versions(texts: list[tuple[str, ...]]) -> list[int]:
    """Family of each text: texts of likeness VERSION or more, also through others, by a prefix join on their rarest words."""
    sets = [frozenset(t) for t in texts]
    n = Counter(w for s in sets for w in s)
    order = [sorted(s, key=lambda w: (n[w], w)) for s in sets]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    lists: dict[str, list[int]] = defaultdict(list)
    for k in sorted(range(len(sets)), key=lambda k: (len(sets[k]), k)):
        size, seen = len(sets[k]), set()
        for w in order[k][: size - int(-(-VERSION * size // 1)) + 1]:
            for o in lists[w]:
                if o not in seen and len(sets[o]) >= VERSION * size:
                    seen.add(o)
                    common = len(sets[k] & sets[o])
                    if common >= VERSION * (size + len(sets[o]) - common):
                        up[find(k)] = find(o)
            lists[w].append(k)
    return [find(k) for k in range(len(sets))]


class Items:
    """The automaton, and the units of all items: whole sentences, and joints where a run crosses from one into the next."""

    def __init__(self, rows: list[tuple[int, str]]):
        units: dict[tuple, set[int]] = defaultdict(set)  # (words, border or 0) -> items
        parts, ids = {}, {}
        for i, text in rows:
            own = [w for s in re.split(r"(?<=[.?!])\s+", text or "") if (w := tuple(normal_words(s)[0])) and not is_stock(w)]
            parts[i] = own
            for s in own:
                ids.setdefault(s, len(ids))
                units[s, 0].add(i)
        family = versions(list(ids))
        of: dict[tuple, tuple] = {}  # each unit's words' families
        for s, k in ids.items():
            of[s, 0] = (family[k],) * len(s)
        for i, own in parts.items():
            words = [w for s in own for w in s]
            fam = [family[ids[s]] for s in own for _ in s]
            at = 0
            for s in own[:-1]:
                at += len(s)
                a = max(0, at - RUN + 1)
                key = (tuple(words[a : at + RUN - 1]), at - a)
                units[key].add(i)
                of[key] = tuple(fam[a : at + RUN - 1])
        self.words = [w for w, _ in units]
        self.border = [b for _, b in units]
        self.items = [tuple(sorted(x)) for x in units.values()]
        contexts, places = defaultdict(set), defaultdict(list)
        for u, key in enumerate(units):
            w, fam = key[0], of[key]
            for k in range(len(w) - 2):
                contexts[w[k : k + 3]].add((fam[k], fam[k + 2]))
                places[w[k : k + 3]].append((u, k))
        # A window across two sentences only tells which sentence followed, so it is nobody's own.
        own = {w: p for w, p in places.items() if len(contexts[w]) == 1 and len(set(*contexts[w])) == 1}
        self.own = [[0, *accumulate(w[k : k + 3] in own for k in range(len(w) - 2))] for w in self.words]
        self.need = [min((self._least(u, a, b) for a, b in self._units(u)), default=9e9) for u in range(len(units))]
        self.auto = ahocorasick.Automaton()
        for w, p in own.items():
            key = " " + " ".join(w) + " "
            self.auto.add_word(key, (len(key), tuple(p)))
        self.empty = not own
        if own:
            self.auto.make_automaton()

    def leaks(self, text: str | None) -> list[tuple[int, int, float]]:
        """(item, offset in the text, share of errors) of every item found in a text."""
        if not text or self.empty:
            return []
        words, _ = normal_words(text, offsets=False)
        flat = " " + " ".join(words) + " "
        hits, at, seen = defaultdict(list), 0, 0
        for end, (size, places) in self.auto.iter(flat):
            start = end - size + 1
            seen += flat.count(" ", at, start)
            at = start
            for u, k in places:
                hits[u].append((seen - k, k))
        best: dict[int, tuple[float, int]] = {}
        for u, pairs in hits.items():
            if len(pairs) < self.need[u]:
                continue
            slack, group = 3 + len(self.words[u]) // 5, []
            for d in [*sorted(pairs), (10**9, 0)]:
                if group and d[0] - group[-1][0] > slack:
                    if len(group) >= self.need[u]:
                        a = max(0, group[0][0] - slack)
                        if r := self._aligned(u, {k for _, k in group}, words[a : group[-1][0] + len(self.words[u]) + slack]):
                            for i in self.items[u]:
                                best[i] = min(best.get(i, (9.0, 0)), (r[0], a + r[1]))
                    group = []
                group.append(d)
        if not best:
            return []
        offsets = normal_words(text)[1]
        return [(i, offsets[min(len(offsets) - 1, at)], e) for i, (e, at) in best.items()]

    def _units(self, u: int) -> list[tuple[int, int]]:
        """(start, end) of the stretches of a unit that count: the sentence as a whole, then its runs, or the runs across a border."""
        n, border = len(self.words[u]), self.border[u]
        lo, hi = (max(0, border - RUN + 1), border) if border else (0, n)
        whole = [(0, n)] if not border and n >= LEAST_SENTENCE else []
        return whole + [(a, a + RUN) for a in range(lo, min(hi, n - RUN + 1))]

    def _least(self, u: int, a: int, b: int) -> float:
        """Own windows that an alignment of words a to b must hold; without any it can't be told from its pattern."""
        own = self.own[u][b - 2] - self.own[u][a]
        return max(1, OWN * own) if own else 9e9

    def _aligned(self, u: int, hit: set[int], doc: list[str]) -> tuple[float, int] | None:
        """Share of errors of the sentence, else of the first run of it, found in a stretch of a document, and where."""
        words, known = self.words[u], set(doc)
        there = [0, *accumulate(w in known for w in words)]
        got = [0, *accumulate(k in hit for k in range(len(words)))]
        for a, b in self._units(u):
            if there[b] - there[a] >= (b - a) * (1 - ERRORS) and got[b - 2] - got[a] >= self._least(u, a, b):
                r = _fit(words[a:b], doc)
                if r[0] <= ERRORS:
                    return r
        return None


def _fit(unit: tuple[str, ...], doc: list[str]) -> tuple[float, int]:
    """Fewest edits that turn some stretch of ``doc`` into ``unit``, as a share of its words, and the stretch's start."""
    prev = [(0, j) for j in range(len(doc) + 1)]
    for i, w in enumerate(unit, 1):
        row = [(i, prev[0][1])]
        for j, d in enumerate(doc, 1):
            x = prev[j - 1]
            if w != d:
                y, z = prev[j], row[j - 1]
                if y[0] < x[0]:
                    x = y
                if z[0] < x[0]:
                    x = z
                x = (x[0] + 1, x[1])
            row.append(x)
        prev = row
    n, start = min(prev)
    return n / len(unit), start


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id, start_at, errors), one row per item and document that holds a part of it.

    docs: (doc_id, text); items: (item_id, text), of bounded size (MAX_ITEM_CHARS in all). Null and
    empty texts leak nothing; repeated rows count once; very long texts are scanned as a whole.
    """
    small = items.filter(F.length("text") > 0).select("item_id", "text").distinct()
    if (small.agg(F.sum(F.length("text"))).first()[0] or 0) > MAX_ITEM_CHARS:
        raise ValueError("the items exceed the bound of what is sent to every task")
    known = docs.sparkSession.sparkContext.broadcast(Items(sorted((r[0], r[1]) for r in small.collect())))  # of checked size

    def scan(frames):
        own = known.value
        for pdf in frames:
            out = [(i, d, at, e) for d, t in zip(pdf["doc_id"], pdf["text"]) if isinstance(t, str) for i, at, e in own.leaks(t)]
            yield pd.DataFrame(out, columns=["item_id", "doc_id", "start_at", "errors"]).astype({"item_id": "int64", "doc_id": "int64"})

    texts = docs.filter(F.length("text") > 0).select("doc_id", "text")
    return texts.mapInPandas(scan, "item_id long, doc_id long, start_at long, errors double").dropDuplicates(["item_id", "doc_id"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id) of every leak."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("item_id", "doc_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, split, documents): how many documents hold a part of each item; 0 for items that did not leak."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "split").distinct()
    n = p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.join(n, "item_id", "left").select("item_id", "split", F.coalesce("documents", F.lit(0)).alias("documents"))
