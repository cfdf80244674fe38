"""Problem 10: abusive, hateful or sexual language, by weak supervision.

Lexicon and pattern voters vote on every sentence that holds a voter's word, after disguises are
undone. A generative label model per kind estimates, from the vote patterns of all voted sentences,
each voter's accuracy and which voters hang together. A linear classifier over the votes and the
hashed words of a sentence is trained on the model's posteriors for a bounded sample; it scores all
sentences, with votes or without, and a document's score is that of its worst sentence.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from re import _parser

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.label_model import CorrelatedLabelModel
from spindrift.runtime import cut, table

KINDS = ("abusive", "hateful", "sexual")
#: Score from which a document counts; tests/llm/test_toxic_content.py holds them against doc_labels.
CUTOFF = {"abusive": 0.4, "hateful": 0.7, "sexual": 0.5}
#: Bound of the classifier's sample: voted sentences in hash order, and documents whose other sentences are its background.
TRAIN_SENTENCES, TRAIN_DOCUMENTS = 12_000, 1_500
#: Cells of the hashed words, and the logit from which a word counts as learned, unless over this share of the background's sentences has it.
CELLS, LEARNED, EVERYDAY = 1 << 14, 0.7, 0.0005
#: Weight of a word's feature against a vote's: less, so that a few everyday words can't make up for the lack of votes.
WORD_WEIGHT = 0.35
#: Logit that a sentence must have beyond, if none of a kind's defining voters speaks.
ALONE = 1.0

# Lexicons and patterns of the voters, with their assumed (true positive, false positive) rates.
_PERSON = r"(?:you|your|you're|youre|yourself|u|ur|du|dich|dein\w*|te|tu|ti|tú|toi|vous|seu|sua|você|eres|kamu|mu|lu|dasar)"
#: Ways in which a sentence speaks of a group of people, whatever its name.
_GROUP = r"""\b(?:(?:people|folk|folks|anyone|everyone|those|lot|lots|bunch|family|families|kind|sort) (?:like|of|from) (?:the |these |those )?\w+|(?:that|this|your|their) (?:lot|kind|sort|people|breed)|those people|(?:inferior|superior|lesser|impure) (?:races?|peoples?|blood)|they (?:are|all|only|just|never|always|spread|breed|lie|steal|stink|smell|ruin|infest|bring|deserve|belong|should|must|can(?:no|')?t)|all of them|every last one|(?:\w{3,}(?:s|i|ese|ish)|folk|people|men|women|children) (?:women |men |children |kids )?(?:are|were|should|must|can(?:no|')?t|deserve|belong|never|always|spread|breed|only|all|lie|steal|stink|smell|ruin|infest|own|do not|don't)|(?:keep|kick|send|throw|get|drive|ban|deport|round up|wipe out|exterminate|smell|burn|without|need|let|with|hate|against) (?:out |all |the |these |those |their )*\w{3,}(?:s|i|ese|folk|people|tribes)|(?:los|las|os|as|les|die|diese|alle) \w+ (?:son|deben|sont|doivent|são|devem|sind|müssen|gehören)|orang \w+|foreigners?|immigrants?|migrants?|refugees?|gyps(?:y|ies)|jews?|muslims?|christians?|blacks|whites|asians|natives|extranjeros|étrangers|ausländer|estrangeiros)\b"""
VOTERS = {
    "abusive": {
        "insult": (0.7, 0.02, r"\b(?:idiot\w*|moron\w*|imbecile?s?|imb[eé]cil\w*|cretins?|crétins?|stupid (?:cow|pig|fool|dog|bitch|ass)|you stupid|dumb(?:ass|o)|jackass\w*|ass ?holes?|losers?|fools?|pathetic|worthless|useless|brainless|spineless|half-?wit|dimwit|nitwit|scum\w*|bastards?|bitch\w*|clowns?|freaks?|creeps?|worms?|(?:filthy|dirty|lying|stinking|little|fat|ugly) (?:rat|pig|dog|cow|worm|swine|toad|snake|sack|liar|animal|face)|(?:sack|piece|pile|heap|load) of (?:dirt|shit|crap|trash|garbage|filth)|waste of (?:space|air|oxygen|skin)|(?:trash|garbage|rubbish) (?:human|person)|(?:human|absolute) (?:trash|garbage)|(?:are|is|and so are) (?:you )?(?:trash|garbage|rubbish)|so are you|fuck\w*|shit\w*|damn you|too (?:thick|dumb|stupid|dense) to|trottel|dummkopf|arschloch|erbärmlich\w*|bodoh|goblok|tolol|inútil|tonto|estúpid\w|connard|abruti|burro|disgusting)\b"),
        "threat": (0.5, 0.01, r"\b(?:(?:break|smash|punch|kick|beat|hurt|kill|cut|burn|choke|crush|strangle|slap|hunt|find) (?:you|your|u|ur)|make you (?:bleed|pay|suffer|cry|regret)|you (?:will|'ll|are going to) (?:regret|pay|bleed|suffer|die)|you'?ll (?:regret|pay|bleed|suffer|die)|(?:should|ought to|deserve to) be (?:beaten|whipped|shot|hit|hanged|slapped|flogged)|i know where you|watch your back|choke on|jump off|drop dead|go (?:die|hang|kill)|kill yourself|hope (?:you|your)\b[^.!?]{0,30}\b(?:dies?|rots?|burns?|suffers?|fails?|bleeds?))\b"),
        "dismissal": (0.5, 0.01, r"\b(?:shut (?:up|your)|get lost|go away|piss off|screw you|crawl back|cry (?:somewhere|about|elsewhere|me)|(?:nobody|no ?one) (?:asked|likes|wants|needs|cares|would miss|will miss|can stand|loves)|laughs? at (?:you|your)|never came back|hates? you|cállate|halt (?:die klappe|den mund)|tutup mulut\w*|dégage|ta gueule|ferme-la|cala a boca|ningu[eé]m te \w+|nadie te \w+|verpiss dich|diam kau)\b"),
        "aimed": (0.6, 0.4, rf"\b(?:{_PERSON}|this (?:marker|tutor|teacher|author|student|lecturer|guy|man|woman|person)|human being|tutor|mulutmu|t'es|who writes|what kind of|what a|only an?)\b"),
    },
    "hateful": {
        "group": (0.95, 0.3, _GROUP),
        "degrades": (0.7, 0.1, r"\b(?:animals|beasts|sub-?humans?|less than human|not (?:even )?human|vermin|parasites?|cockroach\w*|rats|pigs|dogs|plague|scum|filth\w*|dirty|unclean|clean class|pure|thieves|criminals|liars|rapists|savages|barbarians|lazy|stink\w*|smell|inferior|disease\w*|infest\w*|by (?:nature|blood|birth)|born \w+|breeds?|steals?|only good for|scrubbing|cages|chains|basura|escoria|ratas|vermine|abschaum|ungeziefer|untermenschen|lixo|sampah|dreck|sale race)\b"),
        "excludes": (0.6, 0.05, r"\b(?:wiped? (?:them )?out|driven out|drive (?:them )?out|exterminat\w*|eradicat\w*|gassed|lynch\w*|(?:keep|kick|get|throw|send|ship) (?:the |these |those |all )?\w+(?: \w+)? (?:away|out|back|off|home)|away from our|out of our|go back to|back in chains|should (?:not|never) (?:vote|breed|be allowed|exist)|(?:let|allow) [\w ]{3,24} (?:vote|breed|in)|never share|(?:do not|don't) (?:need|want)|without (?:the )?\w+(?: \w+)? (?:is|would be|feels)|should be (?:banned|deported|driven|kept|locked|put down|removed)|belong in|not welcome|burn their|deport\w*|largarse|fuera de|gehören weg|ausländer raus|fora daqui)\b"),
    },
    "sexual": {
        "body": (0.6, 0.1, r"\b(?:naked|nudes?|nudity|breasts?|boobs?|tits|thighs|nipples?|bare (?:ass|bodies|skin|breasts)|penis|vagina|cock|dick|pussy|topless|undress\w*|stripp\w+|(?:tore|took|take|rip\w*) off (?:\w+ )?clothes|lick\w*|desnud[ao]s?|nackt\w*|couple nu|telanjang|bugil)\b"),
        "act": (0.6, 0.1, r"\b(?:sex|sexo|sexe|seks|sexual acts?|intercourse|horny|aroused|moan\w*|orgasms?|groan\w*|go deeper|harder and harder|rode (?:her|him)|rough sex|begged (?:him|her)|as (?:he|she) came|making love|plaisir|caliente|heiß\w*|kinky|fetish|fuck\w*|blow ?jobs?|masturbat\w*|seduc\w*|threesome|foreplay)\b"),
        "trade": (0.5, 0.05, r"\b(?:porn\w*|xxx|escorts?|webcam|cam ?girls?|strip ?club|adults? only|grown-?ups only|18\+|explicit (?:photos?|adult|videos?|pics)|uncensored|sin censura|para adultos|réservé aux adultes|coquine|free trial|send nudes|full service|no limits|sans limites|horny singles|hot singles|sexy|hookups?|nur für erwachsene|ohne tabus|dewasa)\b"),
    },
}
#: Voters that define a kind: the others say little alone.
NEEDED = {"abusive": ("insult", "threat", "dismissal"), "hateful": ("degrades", "excludes"), "sexual": ("body", "act", "trade")}
#: Voters against: talk about such language, and technical, medical, scientific, historical or artistic use of the words.
AGAINST = {
    "mention": r"\b(?:the (?:word|term|phrase|insult|slur)s?|as a word|slurs?|insults?|hate speech|speech laws?|offensive|unacceptable|bullying|harassment|quot(?:e[sd]?|ation|ing)|defin(?:es?|ed|ition)|dictionary|polic(?:y|ies)|guidelines?|moderat\w+|report(?:s|ed|ing)?|survey|critici[sz]e\w*|condemn\w*|apologi[sz]e\w*|translat\w+|explains?|teaches|discuss\w*|examples? of|classif\w+|the (?:essay|exam|lecture|study|texts?|play|poem|novel|film))\b",
    "domain": r"\b(?:(?:was|were|is|are) (?:once |first |often |later |usually |commonly )?(?:proposed|defined|used|coined|known|named|introduced|classified|considered|termed|covered|painted|removed|studied|observed|found|written)|biops\w+|tissue|benign|tumou?rs?|cancer|screening|patients?|therap\w+|clinic(?:al)?|anatom\w+|surg\w+|contracepti\w+|reproducti\w+|asexual|organs?|chromosomes?|species|life cycles?|nest\w*|colon(?:y|ies|ial)|birds?|eggs|larvae|hosts?|virus\w*|bacteri\w+|biolog\w+|chemi\w+|physic\w+|singularit\w+|equations?|theorems?|process(?:es)?|threads?|daemons?|servers?|cylinders?|machines?|siege|granary|centur(?:y|ies)|histor\w+|medieval|empire|walled|permits?|settlement|frescos?|paint(?:er|ers|ing|ings)|sculptors?|museums?|statues?|laws?|courts?)\b",
}
_RATE_AGAINST = (0.9, 0.4)
_VOTERS = [(k, n, re.compile(p)) for k in KINDS for n, (_, _, p) in VOTERS[k].items()]
_AGAINST = [re.compile(p) for p in AGAINST.values()]
#: Voters that say little alone: they are asked only where another voter of the kind has a word.
_LATE = ("aimed", "group")
_DEFINING = {kind: [i for i, (k, n, _) in enumerate(_VOTERS) if k == kind and n in NEEDED[kind]] for kind in KINDS}
NAMES = [f"{k}_{n}" for k, n, _ in _VOTERS] + list(AGAINST)

_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e", "+": "t"})
_SPACED_HINT = re.compile(r"[ .\-_*·][^\W\d_][ .\-_*·][^\W\d_](?![^\W_])")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*·]){2,}[^\W\d_](?![^\W_])")
_FILL = re.compile(r"[ .\-_*·]")
_ZERO = re.compile(r"[​-‏⁠﻿­]")
#: A sign or digit behind a letter or at the head of a word; letters three times over.
_ODD = re.compile(r"[0134570@$€!+*#](?:(?<=[^\W\d_].)[0134570@$€!+*#]*[^\W_]|(?<![\w.,:+\-].)[0134570@$€!+*#]*[^\W\d_])")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_TRIPLES = [c * 3 for c in "abcdefghijklmnopqrstuvwxyzáéíóúàèâêôãõäöüßñç"]
_SPLIT = re.compile(r"(?<=[.?!…。！？])[\s\"'”’)]+|\n+")
_WORD = re.compile(r"[^\W\d_]{2,}")


def _expanded(parsed) -> list[str]:
    """What matches of a parsed pattern hold: all ways through its alternatives, a NUL where something free may stand."""
    ways = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "BRANCH":
            more = [x for b in arg[1] for x in _expanded(b)]
        elif name == "SUBPATTERN":
            more = _expanded(arg[-1])
        elif name == "MAX_REPEAT" and arg[1] == 1:
            more = ["", *_expanded(arg[2])]
        elif name == "MAX_REPEAT" and arg[0] > 0:
            more = [x + "\0" for x in _expanded(arg[2])]
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            more = [""]
        else:
            more = ["\0"]
        ways = [w + m for w in ways for m in more]
    return ways


def _literals(pattern: str) -> set[str]:
    """Pieces of which any match of a voter's pattern holds one: the longest piece of every way through it."""
    return {max(w.split("\0"), key=len) for w in _expanded(_parser.parse(pattern))}


def trigger(learned: tuple[str, ...] = ()) -> ahocorasick.Automaton:
    """All words without which no voter that counts alone can vote, and the classifier's own."""
    auto = ahocorasick.Automaton()
    for k in KINDS:
        for n, (_, _, p) in VOTERS[k].items():
            if n not in _LATE:
                for w in _literals(p):
                    auto.add_word(w, 1)
    for w in learned:
        auto.add_word(" " + w, 1)  # behind a blank
    auto.make_automaton()
    return auto


_TRIGGER = trigger()


def _hit(text: str, auto: ahocorasick.Automaton = _TRIGGER) -> bool:
    return next(auto.iter(text), None) is not None


#: Words of all voters, which a disguise may hide.
_VOCABULARY = {w for k, n, r in _VOTERS if n not in _LATE for x in _expanded(_parser.parse(r.pattern)) for w in _WORD.findall(x.replace("\0", " ")) if len(w) > 2}
_STEMS = tuple(sorted(w for w in _VOCABULARY if len(w) > 3))


def _undone(token: str) -> str:
    """A token without stretched letters, leetspeak and stars, if that makes a word of some voter of it; else as it was."""
    core = token.strip(".,;:?\"'()[]")
    forms = [core, core.translate(_LEET)]
    if "*" in core or "#" in core:
        forms += [re.sub(r"[*#]+", v, core) for v in "aeiouy"]
    if re.search(r"(\w)\1\1", core):
        forms += [re.sub(r"(\w)\1{2,}", r, f) for f in forms[:2] for r in (r"\1", r"\1\1")]
    for f in forms[1:]:
        if f in _VOCABULARY or f.startswith(_STEMS):
            return token.replace(core, f)
    return token


def plain(text: str) -> str:
    """A text in lower case without disguises: leetspeak, spaced or dotted letters, stars, stretched letters, odd forms of letters."""
    s = text.lower() if text.isascii() else _ZERO.sub("", unicodedata.normalize("NFKC", text)).lower()
    if _SPACED_HINT.search(s):
        s = _SPACED.sub(lambda m: _FILL.sub("", m.group()), s)
    for odd in (_ODD, _TRIPLE) if any(t in s for t in _TRIPLES) else (_ODD,):
        out, at = [], 0
        for m in odd.finditer(s):
            if m.start() < at:
                continue
            a, b = m.start(), m.end()
            while a > at and not s[a - 1].isspace():
                a -= 1
            while b < len(s) and not s[b].isspace():
                b += 1
            out += [s[at:a], _undone(s[a:b])]
            at = b
        s = "".join([*out, s[at:]]) if out else s
    return s


def sentence_votes(p: str) -> list[int]:
    """1 or 0 of every voter of NAMES for a sentence without disguises."""
    out = [0] * len(NAMES)
    kinds = set()
    for i, (k, n, r) in enumerate(_VOTERS):
        if n not in _LATE and r.search(p):
            out[i] = 1
            kinds.add(k)
    if kinds:
        for i, (k, n, r) in enumerate(_VOTERS):
            if n in _LATE and k in kinds and r.search(p):
                out[i] = 1
        for i, r in enumerate(_AGAINST):
            out[len(_VOTERS) + i] = int(r.search(p) is not None)
    return out


def document_sentences(text: str | None, auto: ahocorasick.Automaton = _TRIGGER) -> list[str]:
    """Sentences, without disguises, that hold a word of a voter; one pass over the document tells whether there are any."""
    if not text:
        return []
    p = plain(text)
    return [s for s in _SPLIT.split(p) if _hit(s, auto)] if _hit(p, auto) else []


def _code(votes: list[int]) -> int:
    return sum(x << k for k, x in enumerate(votes))


def word_cells(sentence: str) -> set[int]:
    return {zlib.crc32(w.encode()) % CELLS for w in _WORD.findall(sentence)}


def kind_posteriors(codes: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Posterior of every kind for vote patterns (as bits) that occur n times: a correlated label model per kind."""
    V = np.stack([codes >> k & 1 for k in range(len(NAMES))], 1) if len(codes) else np.zeros((0, len(NAMES)), int)
    out = {}
    for kind in KINDS:
        own = [i for i, (k, _, _) in enumerate(_VOTERS) if k == kind]
        need = [i for i in own if _VOTERS[i][1] in NEEDED[kind]]
        # The voters against say 1 where the sentence is clean of other use.
        ballots = np.concatenate([V[:, own], 1 - V[:, len(_VOTERS) :]], 1)
        hint = [VOTERS[kind][_VOTERS[i][1]][:2] for i in own] + [_RATE_AGAINST] * len(AGAINST)
        asked = V[:, need].any(1)
        model = CorrelatedLabelModel(hint, prior=0.5, strength=0.3, most=0.8)
        model.fit(ballots[asked], n[asked])
        out[kind] = np.where(asked, model.predict(ballots), 0.0)
    return out


class SentenceClassifier:
    """Logistic regression over votes and hashed words, one set of weights per kind, trained on soft labels."""

    def __init__(self):
        self.w: dict[str, list[float]] = {k: [0.0] * (CELLS + len(NAMES) + 1) for k in KINDS}

    @staticmethod
    def _row(sentence: str, votes: list[int]) -> np.ndarray:
        return np.array([*sorted(word_cells(sentence)), *(CELLS + k for k, x in enumerate(votes) if x), CELLS + len(NAMES)])

    def fit(self, sentences: list[str], votes: list[list[int]], soft: dict[str, np.ndarray], steps: int = 80, l2: float = 0.5) -> SentenceClassifier:
        """soft: posterior of each kind by sentence. Voted sentences count a second time without their votes, so that words learn to stand alone."""
        if not sentences:
            return self
        rows = [self._row(s, v) for s, v in zip(sentences, votes)] + [self._row(s, []) for s, v in zip(sentences, votes) if any(v)]
        voted = np.array([any(v) for v in votes])
        n, at, col = len(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
        x = np.where(col < CELLS, WORD_WEIGHT, 1.0)
        size = CELLS + len(NAMES) + 1
        bound = np.bincount(col, 0.25 * x * np.bincount(at, x)[at], minlength=size) + l2  # of the curvature, by rows
        for kind in KINDS:
            y = np.concatenate([soft[kind], soft[kind][voted]])
            w, v, t = np.zeros(size), np.zeros(size), 1.0
            for _ in range(steps):  # accelerated steps, each within the bound
                p = 1 / (1 + np.exp(-np.clip(np.bincount(at, v[col] * x, minlength=n), -30, 30)))
                new = v - (np.bincount(col, (p - y)[at] * x, minlength=size) + l2 * v) / bound
                grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
                w, v, t = new, new + (t - 1) / grown * (new - w), grown
            self.w[kind] = w.tolist()
        return self

    def learned(self, sentences: list[str], background: list[str] = ()) -> tuple[str, ...]:
        """Words of the sample that speak for a kind by LEARNED or more and are rare in the background."""
        common = Counter(w for s in background for w in set(_WORD.findall(s)))
        words = {w for s in sentences for w in _WORD.findall(s) if len(w) > 3 and common[w] <= EVERYDAY * len(background)}
        return tuple(sorted(w for w in words if max(self.w[k][zlib.crc32(w.encode()) % CELLS] for k in KINDS) * WORD_WEIGHT >= LEARNED))

    def score(self, sentence: str, votes: list[int]) -> dict[str, float]:
        cells, out = word_cells(sentence), {}
        for kind in KINDS:
            w = self.w[kind]
            z = w[-1] + WORD_WEIGHT * sum([w[c] for c in cells]) + sum([w[CELLS + k] for k, x in enumerate(votes) if x])
            if not any(votes[i] for i in _DEFINING[kind]):
                z -= ALONE
            out[kind] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        return out


def document_scores(texts: list[str], model: SentenceClassifier) -> np.ndarray:
    """Highest score of any sentence of each text, by kind; every sentence is scored, voters are asked where a word of theirs stands."""
    sentences, doc, asked = [], [], []
    for k, t in enumerate(texts):
        p = plain(t)
        own = _SPLIT.split(p)
        hit = _hit(p)
        sentences += own
        doc += [k] * len(own)
        asked += [hit and _hit(s) for s in own]
    out = np.zeros((len(texts), len(KINDS)))
    if not sentences:
        return out
    words = [_WORD.findall(s) for s in sentences]
    cell = {w: zlib.crc32(w.encode()) % CELLS for w in set().union(*words)}
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    pairs = np.unique(row * CELLS + np.array([cell[w] for ws in words for w in ws], np.int64))
    row, col = pairs // CELLS, pairs % CELLS
    votes = np.zeros((len(sentences), len(NAMES)))
    for k in np.flatnonzero(asked):
        votes[k] = sentence_votes(sentences[k])
    doc, full = np.array(doc), np.array([s != "" and not s.isspace() for s in sentences])
    for c, kind in enumerate(KINDS):
        w = np.array(model.w[kind])
        z = w[-1] + WORD_WEIGHT * np.bincount(row, w[col], minlength=len(sentences)) + votes @ w[CELLS:-1] - ALONE * (~(votes[:, _DEFINING[kind]] > 0).any(1))
        np.maximum.at(out[:, c], doc[full], (1 / (1 + np.exp(-np.clip(z, -30, 30))))[full])
    return out


def train(voted: DataFrame, docs: DataFrame) -> SentenceClassifier:
    """The classifier. voted: (code, sentence) of all voted sentences; docs: (doc_id, text).

    The label models read the counts of all vote patterns (at most 2 ** voters, a few hundred in
    practice); the classifier reads at most TRAIN_SENTENCES voted sentences and the first 4,000
    characters of TRAIN_DOCUMENTS documents.
    """
    counts = voted.groupBy("code").agg(F.count("*").alias("n")).collect()
    codes, n = np.array([r["code"] for r in counts], np.int64), np.array([r["n"] for r in counts], float)
    soft = kind_posteriors(codes, n)
    at = {int(c): k for k, c in enumerate(codes)}
    sample = [(r["sentence"], r["code"]) for r in voted.orderBy(F.xxhash64("sentence"), "sentence").limit(TRAIN_SENTENCES).collect()]
    rest = docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCUMENTS).select(F.substring("text", 1, 4000).alias("text")).collect()
    plain_ones = [s for r in rest for s in _SPLIT.split(plain(r["text"])) if s.strip() and not any(sentence_votes(s))]
    sentences = [s for s, _ in sample] + plain_ones
    votes = [[c >> k & 1 for k in range(len(NAMES))] for _, c in sample] + [[0] * len(NAMES)] * len(plain_ones)
    y = {k: np.array([soft[k][at[c]] for _, c in sample] + [0.0] * len(plain_ones)) for k in KINDS}
    return SentenceClassifier().fit(sentences, votes, y)


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, score) with the highest score of any sentence, for each kind with one of 0.00005 or more.

    docs: (doc_id, text). Null and empty texts have no row; repeated rows count once; very long
    texts are read as a whole.
    """

    def vote(frames):
        for pdf in frames:
            rows = [(c, s) for t in pdf["text"] for s in document_sentences(t) if (c := _code(sentence_votes(s)))]
            yield pd.DataFrame(rows, columns=["code", "sentence"]).astype({"code": "int64"})

    texts = docs.filter(F.length("text") > 0).select("doc_id", "text")
    model = train(cut(texts.select("text").mapInPandas(vote, "code long, sentence string")), texts)
    known = docs.sparkSession.sparkContext.broadcast(model)  # CELLS weights

    def score(frames):
        for pdf in frames:
            for k in range(0, len(pdf), 256):
                ids, x = pdf["doc_id"].to_numpy()[k : k + 256], document_scores(pdf["text"].tolist()[k : k + 256], known.value)
                d, c = np.nonzero(x >= 5e-5)  # of which four digits show anything
                yield pd.DataFrame({"doc_id": ids[d], "kind": np.array(KINDS, object)[c], "score": x[d, c]})

    return texts.mapInPandas(score, "doc_id long, kind string, score double").groupBy("doc_id", "kind").agg(F.max("score").alias("score"))


def validated_cutoffs(scores: DataFrame, labels: DataFrame) -> dict[str, tuple[float, float]]:
    """(cutoff, F1) of every kind against labels (doc_id, toxic) of any kind: each kind's best, the others at CUTOFF; ties to the one nearest to it.

    A document is toxic if over half of its labels say so. labels is a sample of fixed share that people made; it comes to the driver.
    """
    y = {r["doc_id"]: r["t"] > 0.5 for r in labels.filter("toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("t")).collect()}
    s = {k: dict.fromkeys(y, 0.0) for k in KINDS}
    for r in scores.join(labels.select("doc_id").distinct(), "doc_id").collect():
        s[r["kind"]][r["doc_id"]] = r["score"]
    out = {}
    for kind in KINDS:
        rest = {d for k in KINDS if k != kind for d in y if s[k][d] >= CUTOFF[k]}
        f1 = {}
        for c in [k / 20 for k in range(1, 20)]:
            said = {d for d in y if d in rest or s[kind][d] >= c}
            f1[c] = 2 * sum(y[d] for d in said) / max(1, len(said) + sum(y.values()))
        best = max(f1.values())
        out[kind] = (min((c for c, f in f1.items() if f >= best - 1e-9), key=lambda c: abs(c - CUTOFF[kind])), round(best, 4))
    return out


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kind) of every document with such language."""
    return score_documents(table(spark, sf_dir, "documents")).filter(" or ".join(f"kind = '{k}' and score >= {c}" for k, c in CUTOFF.items())).select("doc_id", "kind")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score, abusive, hateful, sexual) of every document; 0 for null and empty texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").dropDuplicates(["doc_id"])
    s = score_documents(docs).groupBy("doc_id").pivot("kind", list(KINDS)).agg(F.max("score"))
    each = [F.round(F.coalesce(F.col(k), F.lit(0.0)), 4).alias(k) for k in KINDS]
    return docs.select("doc_id").join(s, "doc_id", "left").select("doc_id", F.greatest(*(F.round(F.coalesce(F.col(k), F.lit(0.0)), 4) for k in KINDS)).alias("score"), *each)


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, documents, abusive, hateful, sexual): documents of each source and the share with each kind."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").dropDuplicates(["doc_id"])
    found = p10_found(spark, sf_dir).groupBy("doc_id").pivot("kind", list(KINDS)).agg(F.count(F.lit(1)))
    share = [F.round(F.avg(F.coalesce(F.col(k), F.lit(0)).cast("double")), 6).alias(k) for k in KINDS]
    return docs.join(found, "doc_id", "left").groupBy("source").agg(F.count("*").alias("documents"), *share)
