"""Problem 2: personal information in free text.

High-recall generators propose overlapping spans; boosted trees score each span by
format and context features; a calibrated threshold per kind selects the redactions.
The trees learn from spans of which a rule is sure: numbers of a valid shape, with a
cue where the shape alone could be anything, persons of the roster, and look-alikes
after words that announce something else. No rule or feature knows a range of numbers
that is reserved for examples.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.boosting import BoostedTrees, best_threshold
from spindrift.runtime import table

KINDS = ("email", "phone", "identity_number", "street_address", "person_name")
#: Texts from which the trees learn; a fixed bound, chosen by hash over all texts with a digit, @ or capital pair.
TRAIN_TEXTS = 6000
#: Bound of the roster, which is sent to every task.
MAX_ROSTER = 100_000

# Cue words.
CALL_CUES = {"call", "dial", "ring", "number", "tel", "telephone", "text", "helpline", "hotline", "phone", "mobile", "fax", "cell", "whatsapp", "on", "use", "or"}
ID_CUES = {"ssn", "social", "security", "card", "id", "identity", "identification", "passport", "licence", "license", "tax", "cpf", "aadhaar", "ref", "no", "nr", "registry", "register", "registration", "insurance", "nin", "nino", "holder", "document"}
NOT_CUES = {"isbn", "issn", "doi", "version", "release", "table", "figure", "page", "pages", "equation", "ticket", "order", "invoice", "ratio", "sample", "room", "shelf", "chapter", "section", "question", "item", "lot", "batch", "serial", "port", "line", "lines", "counted", "census", "population", "year", "between"}
WORK_WORDS = {
    "theorem", "theorems", "lemma", "conjecture", "method", "methods", "effect", "law", "laws", "test", "review", "journal", "prize", "institute", "university", "press", "algorithm", "equation",
    "model", "criterion", "road", "street", "lane", "ave", "avenue", "court", "novel", "constant", "principle", "paradox", "transform", "distribution", "inequality", "scale", "hypothesis", "cycle", "library", "bridge", "valley", "river",
}
NAME_CUES = {"by", "ask", "contact", "to", "of", "dr", "prof", "mr", "mrs", "ms", "and", "or", "for", "was", "from", "with", "i", "--", "by:", "cc", "dear", "name", "named", "called", "signed", "student", "tutor", "author"}
TITLES = {"dr", "prof", "mr", "mrs", "ms", "herr", "frau", "mme", "sr", "sra", "miss", "sir"}

_CAP = r"[^\W\d_a-zß-öø-ÿ][\w'’̀-ͯ]+"
_WORD = r"[^\W\d_][\w'’̀-ͯ]+"
_AREA = r"(?:\(\d{2,5}\)|\d{2,5})"
#: A town of two words begins with one of these; else the next capital word is something else.
_FIRST = r"(?:Port|Villa|San|Santa|Saint|St\.?|New|Los|Las|El|La|Le|Bad|North|South|East|West|Upper|Lower|Great|Little|Fort|Mount|Lake)"
_PLACE = rf"(?:{_FIRST}[ \t]{_CAP}|{_CAP})"
_FORMS = [
    ("email", r"[\w.+%-]+[ \t]?(?:@|\(at\)|\[at\]|\(AT\)|\[AT\])[ \t]?[\w-]+(?:(?:\.|[ \t]?\[(?:dot|DOT)\][ \t]?|[ \t]?\((?:dot|DOT)\)[ \t]?)[\w-]+)*(?:\.|[ \t]?\[(?:dot|DOT)\][ \t]?|[ \t]?\((?:dot|DOT)\)[ \t]?)[^\W\d_]{2,}"),
    ("email", r"[\w.+%-]+ at [\w-]+(?: dot [\w-]+)+"),
    ("phone", rf"(?<![\w.+-])(?:\+\d{{1,3}}[ .\-/]?|00\d{{1,3}}[ .\-/]?)?{_AREA}[ .\-/]?\d{{3,4}}[ .\-/]?\d{{3,4}}(?:,?[ ]?(?:ext\.?|x)[ ]?\d{{1,5}})?(?![\w-]|\.\d)"),
    ("phone", r"(?<![\w.+-])(?:\+|00)\d{1,3}(?:[ .\-/]?(?:\(\d{1,5}\)|\d{1,5})){2,5}(?![\w-])"),
    ("phone", r"(?<![\w.+-])0\d{4}[ ]\d{6}(?![\w-])|(?<![\w.+-])1\d{10}(?![\w-])"),
    ("identity_number", r"(?<![\w.+-])\d{3}([ -]?)\d{2}\1\d{4}(?![\w-])"),
    ("identity_number", r"(?<![\w.+-])\d{4}[ -]\d{4}[ -]\d{4}(?![\w-])|(?<![\w.+-])\d{12}(?![\w-])"),
    ("identity_number", r"(?<![\w.+-])[A-Z]\d{8}(?![\w-])|(?<![\w.+-])[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-Z](?![\w-])"),
    ("identity_number", r"(?<![\w.+-])\d{3}\.\d{3}\.\d{3}-\d{2}(?![\w-])"),
    ("street_address", rf"(?:(?:Flat|Apt\.?|Unit|Suite)[ ]\d+\w?,?\s)?(?<!\d)\d{{1,5}}[a-z]?[ ](?:[NSEW]\.?[ ])?{_CAP}(?:[ ]{_CAP})?[ ](?:Road|Lane|Court|Street|Avenue|Ave\.?|St\.?|Drive|Close|Square|Way|Rd\.?)(?:,[ ]Apt[ ]?\w+)?(?:,?\s{_PLACE}(?:[ ][A-Z]{{2}}\d{{1,2}}[ ]\d[A-Z]{{2}})?)?"),
    ("street_address", rf"(?<!\d)\d{{1,5}},?[ ](?:bis[ ])?(?:rue|avenue|place|boulevard)[ ](?:de[ ](?:la[ ])?|du[ ])?{_WORD}(?:,\s{_PLACE})?"),
    ("street_address", rf"{_WORD}(?:straße|strasse|weg|gasse|platz)[ ]\d+\w?(?:,\s\d{{5}}\s{_PLACE})?"),
    ("street_address", rf"(?:Calle|Avenida|Rua|Via|Plaza)[ ]{_WORD}(?:[ ]{_CAP})?[ ]\d+(?:,[ ]\d+\.º[ ]\w)?(?:,\s{_PLACE})?"),
    ("street_address", rf"(?<![\d.,:-])\d{{1,4}}[a-z]?[ ]{_WORD}[ ](?:st|rd|ave|ln|road|lane|street)[ ](?:{_FIRST.lower()}[ ]{_WORD}|{_WORD})"),
]


class Lexicon:
    """Names of the roster: given names, family names, and the parts of which family names are made."""

    def __init__(self, people: list[tuple[str, str]]):
        fold = lambda s: unicodedata.normalize("NFC", s).casefold()
        self.given = {fold(g) for g, _ in people if g}
        self.family = {fold(f) for _, f in people if f}
        self.pairs = {(fold(g), fold(f)) for g, f in people if g and f}
        heads, tails = {}, {}
        for f in self.family:
            for k in range(3, len(f) - 2):
                heads.setdefault(f[:k], set()).add(f[k:])
                tails.setdefault(f[k:], set()).add(f[:k])
        # A part counts if it joins several others on both sides.
        self.heads = {h for h, t in heads.items() if len({x for x in t if len(tails[x]) > 2}) > 2}
        self.tails = {t for t, h in tails.items() if len({x for x in h if len(heads[x]) > 2}) > 2}
        given = sorted({v for g, _ in people if g for v in (g, unicodedata.normalize("NFD", g))}, key=len, reverse=True)
        g = "(?i:" + "|".join(map(re.escape, given)) + ")" if given else "(?!)"
        fam = rf"{_WORD}(?:-{_WORD})?"
        cap = rf"{_CAP}(?:-{_CAP})?"
        up = r"[^\W\d_a-zß-öø-ÿ]"
        cue = r"(?:(?<=by )|(?<=by: )|(?<=ask )|(?<=ontact )|(?<=to )|(?<=[DM]r\. )|(?<=rof\. )|(?<=-- )|(?<=and )|(?<=or )|(?<=was )|(?<=of )|(?<=rom )|(?<=ith )|(?<=ear )|(?<=I, ))"
        self.names = re.compile(
            rf"(?<![\w@.+-])(?:{g}(?:\s{up}\.)?\s{fam}|{g}\s{up}\.|{up}\.(?:[ ]?{up}\.)?\s{cap}|{cap},\s(?:{g}|{up}\.)(?:\s{up}\.)?|(?i:{fam}),\s{g}(?:\s{up}\.)?|{cue}{_CAP}(?:\s{up}\.)?,?\s{cap})(?![\w@])"
        )
        #: Without a given name, a text needs an initial or a cue before capital words to match.
        self.hint = re.compile(rf"\.(?<={up}\.)|{cue}{_CAP}(?:\s{up}\.)?,?\s{cap}")
        self.first = tuple(self.given)
        self.seen: dict[str, tuple[bool, bool, bool]] = {}

    def may_name(self, text: str) -> bool:
        """Whether the pattern of names can match at all."""
        low = (text if text.isascii() else unicodedata.normalize("NFC", text)).casefold()
        return any(g in low for g in self.first) or self.hint.search(text) is not None

    def made_up(self, word: str) -> tuple[bool, bool, bool]:
        """Whether a family name is listed, begins and ends with known parts; kept by word, of which a text has few."""
        if (out := self.seen.get(word)) is None:
            w = unicodedata.normalize("NFC", word).casefold()
            known = any(w[:k] in self.heads and w[k:] in self.tails for k in range(3, len(w) - 2))
            out = w in self.family, known, any(w[k:] in self.tails for k in range(1, len(w) - 3))
            if len(self.seen) < 100_000:
                self.seen[word] = out
        return out


_PATTERNS = [(kind, re.compile(p)) for kind, p in _FORMS]
def _holds(*words: str):
    return lambda text: any(w in text for w in words)


#: What a text must hold for a pattern to match, by a piece of the pattern; each test is asked once a text.
_GATES = [
    ("@|", _holds("@", "(at)", "[at]", "(AT)", "[AT]")),
    (" dot ", _holds(" dot ")),
    ("straße", re.compile(r"(?:straße|strasse|weg|gasse|platz) \d").search),
    ("boulevard", _holds("rue ", "avenue ", "place ", "boulevard ")),
    ("Calle", _holds("Calle ", "Avenida ", "Rua ", "Via ", "Plaza ")),
    ("|Close|", _holds(" Road", " Lane", " Court", " Street", " Ave", " St", " Drive", " Close", " Square", " Way", " Rd")),
    ("|ln|", _holds(" st ", " rd ", " ave ", " ln ", " road ", " lane ", " street ")),
    ("", re.compile(r"(?:\d[ .\-/()]{0,2}){6}").search),  # numbers
]
_NEEDS = [next(k for k, (piece, _) in enumerate(_GATES) if piece in p.pattern) for _, p in _PATTERNS]


def spans(text: str, lex: Lexicon) -> list[tuple[str, int, int]]:
    """Overlapping candidate spans (kind, start, end)."""
    out = []
    may = [bool(gate(text)) for _, gate in _GATES]
    for (kind, p), k in zip(_PATTERNS, _NEEDS):
        if may[k]:
            out += [(kind, m.start(), m.end()) for m in p.finditer(text)]
    at = 0 if lex.may_name(text) else len(text)
    while m := lex.names.search(text, at):
        out.append(("person_name", m.start(), m.end()))
        at = m.start() + 1 if m.group()[1:2] == "." else max(m.start() + 1, m.end() - 1)
        while at < len(text) and text[at - 1].isalnum() and text[at].isalnum():
            at += 1
    return out


#: Shapes of numbers, each with whether it is a phone's; of the others, those that are an identity number's without a cue, and with one.
_SHAPES = [
    ("phone", re.compile(r"(?:\+|00)\d{1,3}(?:[ .\-/]?(?:\(\d{1,5}\)|\d{1,5})){1,5}(?:,? ?(?:ext\.?|x) ?\d{1,5})?")),
    ("phone", re.compile(r"(?:1[ .\-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .\-])[2-9]\d\d[ .\-]\d{4}(?:,? ?(?:ext\.?|x) ?\d{1,5})?")),
    ("phone", re.compile(r"1?[2-9]\d\d[2-9]\d{6}|0\d{4} \d{6}|\(?0\d{2,4}\)?[ \-]\d{3,4}[ \-]\d{3,4}")),
    ("sure", re.compile(r"\d{3}[ -]\d{2}[ -]\d{4}")),
    ("sure", re.compile(r"\d{4}[ -]\d{4}[ -]\d{4}")),
    ("sure", re.compile(r"\d{3}\.\d{3}\.\d{3}-\d{2}")),
    ("sure", re.compile(r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]")),
    ("cued", re.compile(r"[A-Z]\d{8}")),
    ("cued", re.compile(r"\d{9}|\d{12}")),
]


_SENTENCE = re.compile(r"[.?!]\s|\n")


def _words(text: str) -> list[str]:
    return [w.strip("():,;.<>") for w in text.split()]


def _cue(left: str) -> str | None:
    """What the nearest cue in the same sentence before a number announces: a call, an identity number, or something else."""
    for w in reversed(_words(_SENTENCE.split(left)[-1])[-3:]):
        for name, cues in (("not", NOT_CUES), ("id", ID_CUES), ("call", CALL_CUES)):
            if w in cues:
                return name
    return None


def features(text: str, kind: str, s: int, e: int, lex: Lexicon) -> list[float]:
    """Binary format and context features of a span."""
    span, left, right = text[s:e], text[max(0, s - 40) : s], text[e : e + 24]
    lw, cue = _words(left.casefold())[-3:], _cue(left.casefold())
    rw = _words(right.casefold())[:2]
    n = sum(c.isdigit() for c in span)
    f = [kind == k for k in KINDS]
    f += [cue == "call", cue == "id", cue == "not", bool(set(lw[-1:]) & NAME_CUES), bool(set(lw[-1:]) & TITLES), lw[-1:] == ["the"]]
    f += [bool(set(rw[:1]) & WORK_WORDS), bool(set(rw) & WORK_WORDS), rw[:2] != [] and rw[0] == "and" and rw[-1] in WORK_WORDS, not left.strip() or left.rstrip(" ")[-1:] in ".?!\n", left[-1:] == "(" and right[:1] == ")"]
    f += [n == 7, n == 8, n == 9, n == 10, n == 11, n == 12, n > 12, span.startswith(("+", "00")), span.startswith("("), "-" in span, " " in span, "." in span, bool(re.search(r"ext|x\d", span)), span[:1].isupper() and n > 4]
    shapes = [p.fullmatch(span) is not None for _, p in _SHAPES] if n > 5 else [False] * len(_SHAPES)
    kinds = {k for (k, _), x in zip(_SHAPES, shapes) if x}
    f += [*shapes, kind == "phone" and "phone" in kinds and "sure" not in kinds, kind == "phone" and ("sure" in kinds or "cued" in kinds), kind == "identity_number" and "sure" in kinds, kind == "identity_number" and "cued" in kinds]
    f += [bool(re.search(r"\d{3,} \d{3}$", span)), "@" in span, kind == "street_address" and bool(re.search(r"\d,? |straße|Calle|rue", span)), bool(re.search(r"[A-Z]\w+$|[A-Z]{2}$", span))]
    if kind == "person_name":
        words = re.findall(r"[^\W\d_][\w'’̀-ͯ]*", span)
        fold = [unicodedata.normalize("NFC", w).casefold() for w in words]
        given = [w in lex.given for w in fold]
        made = [lex.made_up(w) for w in words if len(w) > 2] or [(False, False, False)]
        pairs = any((a, b) in lex.pairs or (b, a) in lex.pairs for a in fold for b in fold)
        initial = any(len(w) == 1 for w in words)
        part = any(m[1] for m in made)
        f += [any(given), any(m[0] for m in made), part, any(m[2] for m in made), pairs, initial, "," in span, "-" in span, span.isupper(), span.islower(), all(w[:1].isupper() for w in words), any(given) and part, initial and part, bool(set(fold) & WORK_WORDS)]
    else:
        f += [False] * 14
    return [float(x) for x in f]


def sure_label(text: str, kind: str, s: int, e: int, lex: Lexicon) -> int | None:
    """1 or 0 where a rule is sure, else None."""
    span, left, right = text[s:e], text[max(0, s - 40) : s].casefold(), text[e : e + 24].casefold()
    cue, rw = _cue(left), _words(right)[:2]
    if kind == "email":
        return 1 if re.search(r"@|at[)\]]| dot ", span) and re.search(r"\.|dot", span.split("@")[-1]) and not re.match(r"\W", span) else 0
    if kind in ("phone", "identity_number"):
        if cue == "not":
            return 0
        shapes = {k for k, p in _SHAPES if p.fullmatch(span)}
        if "sure" in shapes:
            return int(kind == "identity_number")
        if kind == "phone":
            return 1 if "phone" in shapes and cue != "id" else 0 if sum(c.isdigit() for c in span) < 9 or "cued" in shapes else None
        return 1 if "cued" in shapes and (cue == "id" or span[:1].isalpha()) else None
    if kind == "street_address":
        return 0 if cue == "not" or not re.search(r"\d", span) else 1 if e - s > 12 else None
    fold = [unicodedata.normalize("NFC", w).casefold() for w in re.findall(r"[^\W\d_][\w'’̀-ͯ]*", span)]
    if set(rw[:1]) & WORK_WORDS or set(fold) & WORK_WORDS:
        return 0
    family = any(lex.made_up(w)[0] or lex.made_up(w)[1] for w in fold if len(w) > 2)
    if family and (any(w in lex.given for w in fold) or any(len(w) == 1 for w in fold)):
        return 1
    return 0 if not family else None


def train(texts: list[str], people: list[tuple[str, str]]) -> tuple[BoostedTrees, dict[str, float], dict[str, tuple[float, float, int]]]:
    """Trees, one threshold per kind, and per kind (precision, recall, spans) on held-out spans, from the sure spans of at most TRAIN_TEXTS texts."""
    lex, X, y, kinds = Lexicon(people), [], [], []
    for t in texts[:TRAIN_TEXTS]:
        for kind, s, e in spans(t, lex):
            if (lab := sure_label(t, kind, s, e, lex)) is not None:
                X.append(features(t, kind, s, e, lex))
                y.append(lab)
                kinds.append(kind)
    if not y:
        return BoostedTrees(), dict.fromkeys(KINDS, 0.5), {}
    X, y, kinds = np.array(X), np.array(y, float), np.array(kinds)
    held = np.random.default_rng(0).random(len(y)) < 0.25
    model = BoostedTrees().fit(X[~held], y[~held])
    cut, report = {}, {}
    for k in KINDS:
        at = held & (kinds == k)
        score = model.predict(X[at])
        cut[k] = best_threshold(score, y[at])
        hit = float(((score >= cut[k]) & (y[at] == 1)).sum())
        report[k] = (hit / max(1, (score >= cut[k]).sum()), hit / max(1, y[at].sum()), int(at.sum()))
    return model, cut, report


def batch_mentions(texts: list[str | None], lex: Lexicon, model: BoostedTrees, cut: dict[str, float]) -> list[list[tuple[str, int, int]]]:
    """Selected non-overlapping spans of every text, in order; null and empty texts have none. All spans of a batch are scored at once."""
    found = [spans(t, lex) if t else [] for t in texts]
    rows = [features(t, *f, lex) for t, fs in zip(texts, found) for f in fs]
    if not rows:
        return [[] for _ in texts]
    score, at, out = model.predict(np.array(rows)), 0, []
    for fs in found:
        own, at = score[at : at + len(fs)], at + len(fs)
        best = sorted(((p, f) for p, f in zip(own, fs) if p >= cut[f[0]]), key=lambda x: (x[1][0] == "person_name", -(x[1][2] - x[1][1]), -x[0], x[1][1]))
        taken: list[tuple[str, int, int]] = []
        for _, (kind, s, e) in best:
            if all(e <= a or s >= b for _, a, b in taken):
                taken.append((kind, s, e))
        out.append(sorted(taken, key=lambda x: x[1]))
    return out


def mentions(text: str | None, lex: Lexicon, model: BoostedTrees, cut: dict[str, float]) -> list[tuple[str, int, int]]:
    return batch_mentions([text], lex, model, cut)[0]


def redact(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    """The text with every mention replaced by its kind in square brackets."""
    if text is None:
        return None
    out, at = [], 0
    for kind, s, e in found:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


@lru_cache(maxsize=2)
def _lexicon(people: tuple) -> Lexicon:
    return Lexicon(list(people))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, row_key, text) of the three tables; second deliveries count once."""
    c = table(spark, sf_dir, "document_chunks").select(F.lit("document_chunks").alias("tbl"), F.concat("source", F.lit("#"), "chunk_id").alias("row_key"), "text")
    t = table(spark, sf_dir, "chat_turns").select(F.lit("chat_turns").alias("tbl"), F.col("turn_id").cast("string").alias("row_key"), F.col("content").alias("text"))
    m = table(spark, sf_dir, "moderation_reviews").select(F.lit("moderation_reviews").alias("tbl"), F.col("review_id").cast("string").alias("row_key"), F.col("notes").alias("text"))
    return c.union(t).union(m)


def find_mentions(texts: DataFrame, people: DataFrame) -> DataFrame:
    """(tbl, row_key, kind, start_at, end_at, redacted) per mention, from texts (tbl, row_key, text).

    people: (given_name, family_name), a roster of bounded size. Null or empty texts have no
    mention; repeated rows give their mentions once; very long texts are read as a whole.
    """
    roster = tuple(sorted((r[0] or "", r[1] or "") for r in people.select("given_name", "family_name").limit(MAX_ROSTER + 1).collect()))
    if len(roster) > MAX_ROSTER:
        raise ValueError("the roster exceeds the bound of what is sent to every task")
    sample = texts.filter(F.col("text").rlike(r"\d|@|[A-Z]\w+,?\s[A-Z]")).orderBy(F.xxhash64("tbl", "row_key"), "text").limit(TRAIN_TEXTS)
    model, cut, _ = train([r["text"] for r in sample.select("text").collect()], list(roster))

    def scan(frames):
        lex = _lexicon(roster)
        for pdf in frames:
            found = batch_mentions([t if isinstance(t, str) else None for t in pdf["text"]], lex, model, cut)
            rows = [(tbl, key, k, s, e, i) for tbl, key, own in zip(pdf["tbl"], pdf["row_key"], found) for i, (k, s, e) in enumerate(own)]
            yield pd.DataFrame(rows, columns=["tbl", "row_key", "kind", "start_at", "end_at", "nth"])

    out = texts.filter(F.length("text") > 0).mapInPandas(scan, "tbl string, row_key string, kind string, start_at int, end_at int, nth int")
    return out.dropDuplicates(["tbl", "row_key", "kind", "start_at"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row (tbl, row_key, kind, start_at) per mention of personal data."""
    return find_mentions(_texts(spark, sf_dir), table(spark, sf_dir, "roster")).select("tbl", "row_key", "kind", "start_at")


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, row_key, text): every text with typed placeholders; texts without a mention stay as they are."""
    texts = _texts(spark, sf_dir).dropDuplicates(["tbl", "row_key"])
    found = find_mentions(texts, table(spark, sf_dir, "roster")).groupBy("tbl", "row_key").agg(F.sort_array(F.collect_list(F.struct("start_at", "end_at", "kind"))).alias("m"))
    # Pieces between mentions, rebuilt in one pass over the sorted mentions.
    text = F.expr(
        "aggregate(m, named_struct('out', '', 'at', 0), (a, x) -> named_struct('out', concat(a.out, substring(text, a.at + 1, x.start_at - a.at), '[', upper(x.kind), ']'), 'at', x.end_at), a -> concat(a.out, substring(text, a.at + 1)))"
    )
    return texts.join(found, ["tbl", "row_key"], "left").select("tbl", "row_key", F.when(F.col("m").isNull(), F.col("text")).otherwise(text).alias("text"))
