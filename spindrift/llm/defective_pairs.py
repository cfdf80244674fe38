"""Problem 3: broken prompt and response pairs, by labelling functions and a label model per defect.

Voters that look for different signs of one defect are alternative causes: a text cut within a word
need not also end in a comma, so the silence of the other voters is no vote against it.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.boosting import best_threshold
from spindrift.llm.label_model import LabelModel
from spindrift.llm.truncation import tail_evidence
from spindrift.runtime import cut, table

DEFECTS = ("empty", "copied_question", "refusal", "other_language", "truncated")
#: Voters of each defect and their assumed (true positive, false positive) rates.
VOTERS = {
    "empty": {"no_letter": (0.9, 0.0005), "placeholder": (0.9, 0.0005), "flag_empty": (0.7, 0.05)},
    "copied_question": {"same_words": (0.99, 0.0001), "same_set": (0.95, 0.001)},
    "refusal": {"declines": (0.9, 0.0005), "stands_off": (0.6, 0.01), "flag_meta": (0.6, 0.05), "shape": (0.9, 0.3)},
    "other_language": {"stop_words": (0.95, 0.0005), "letters": (0.8, 0.02)},
    "truncated": {"unknown": (0.9, 0.0005), "open_word": (0.9, 0.001), "cut_mark": (0.9, 0.0005), "open_list": (0.9, 0.0005), "at_limit": (0.9, 0.001)},
}
#: Voters that stand for one cause of a defect, where it has several; an unreliable flag goes with each.
CAUSES = {"empty": [["no_letter", "flag_empty"], ["placeholder", "flag_empty"]], "truncated": [[n] for n in VOTERS["truncated"]]}
#: Highest rate of a defect that a fit may reach: defects are the exception.
MOST = 0.25
#: Posterior above which a defect counts: what validated_cutoffs() gives on the labelled pairs of tests/llm/test_defective_pairs.py.
CUTOFFS = {"empty": 0.5, "copied_question": 0.5, "refusal": 0.5, "other_language": 0.5, "truncated": 0.5}

# Placeholders, stop words, labels and phrases of refusal.
PLACEHOLDERS = {"none", "null", "nil", "nan", "na", "n a", "empty", "no output", "no answer", "no response", "output", "im end", "endoftext", "undefined", "missing", "blank", "tbd", "todo", "eos", "s", "pad"}
STOP = {
    "en": "the of and is in to what how which that for with are an by from on it be as at or this when why would does was has not can",
    "es": "el los las de del que en un una por con para como qué cómo se si también sin al es su entre hay después primero",
    "fr": "le les de des du que et en une par pour avec comment dans sur est quelles quels il aussi sans au aux si puis enfin",
    "pt": "o e os de da dos das que em um uma por com para como se também sem ao é na nas quais são depois não mesmo havendo entre primeiro",
    "de": "der die das den dem des und ist zu ein eine einer wie von mit für auf sie nicht wenn zuerst dann welche auch ohne zur zum nennen hat",
    "id": "yang dan di ke dari untuk dengan pada apa bagaimana itu ini adalah dalam lalu jika juga harus tanpa atau sebagai oleh antara peran",
}
LABELS = {
    "question", "answer", "rewritten", "rewrite", "here", "is", "the", "q", "a", "prompt", "input", "original", "output", "response", "certainly", "sure", "see", "below", "pregunta", "respuesta",
    "frage", "antwort", "réponse", "resposta", "pergunta", "pertanyaan", "jawaban", "task", "your", "of", "course", "again", "repeat", "i", "repeated", "text",
}
DECLINES = re.compile(
    r"(?:\b(?:i|we)\b(?:['’](?:m|d|ll|re))?[^.?!,;]{0,24}\b(?:can(?:not|['’]?t)|can not|unable|not able|won['’]?t|will not|rather not|must|have to|prefer not|do not feel|don['’]t feel|not allowed|not permitted|refuse)\b[^.?!]{0,40}\b(?:answer|help|assist|comply|decline|refuse|provide|rewrite|produce|respond|do this|do that|process|discuss\w*|go into|touch|turn|comfortable|able to|offer|engage|continue|fulfil\w*)\b"
    r"|\b(?:sorry|unfortunately|apolog\w+|regrettabl[ey])\b[^.?!]{0,30}\b(?:can(?:not|['’]?t)|unable|won['’]?t|will not|off limits)\b"
    r"|\bunable to (?:process|comply|help|answer|assist)\b|\b(?:would be|is|am|are) (?:inappropriate|off limits)\b"
    r"|\b(?:request declined|content withheld|withheld by|off limits for me|no rewrite of|prevent me|outside what i am allowed|not something i can|let us talk about something else|would rather skip|i must (?:respectfully )?decline|i won['’]?t touch|have to refuse|can['’]?t answer|do not feel able|inappropriate for me)\b|^\W*(?:declined|refused)\W*$)",
    re.I,
)
LEAD = re.compile(
    r"^\W*(?:i['’]?m (?:sorry|unable|afraid)|sorry|apolog\w+|i apologi[sz]e|regrettabl[ey]|unfortunately|as an? (?:ai|language|study|assistant|large)|hmm|to be safe|thank(?:s| you) for asking|after checking|my guidelines|it would be inappropriate|unable to|no, i|i (?:must|cannot|can['’]?t|won['’]?t|would rather|do not|don['’]?t|have to)|this is not|let us|declined|request|content withheld|can['’]?t|lo siento|no puedo|désolé\w*|je (?:ne peux|suis désolé)|desculpe|não posso|tut mir leid|ich kann|leider|maaf)\b",
    re.I,
)
#: A text without one of these pieces can't match DECLINES.
_DECLINE_PIECES = ("can", "unable", "able to", "won", "will not", "rather", "must", "have to", "prefer", "feel", "allowed", "permitted", "refus", "declin", "withheld", "off limits", "no rewrite of", "prevent me", "outside what", "not something", "something else", "inappropriate")
WORD = re.compile(r"[^\W_]+")
_OF_WORD: dict[str, int] = {}
LANGS = tuple(STOP)
for _i, _l in enumerate(LANGS):
    for _w in STOP[_l].split():
        _OF_WORD[_w] = _OF_WORD.get(_w, 0) | (1 << _i)
SCRIPTS = (("arabic", "؀", "ۿ"), ("devanagari", "ऀ", "ॿ"), ("kana", "぀", "ヿ"), ("han", "一", "鿿"), ("hangul", "가", "힯"), ("cyrillic", "Ѐ", "ӿ"), ("greek", "Ͱ", "Ͽ"))
#: Typical letters and endings that tell the languages apart where stop words are few.
ENDINGS = {
    "es": r"ción\b|[¿¡]|ñ|\b\w+(?:ados|idos|oso)\b|«\w",
    "fr": r"è|ê|œ|\b[ldsnqcjm]['’]|« |eaux?\b|eur\b",
    "pt": r"ã|õ|ção\b|ç\w+o\b",
    "de": r"ß|ä|ü|ung(?:en)?\b|ieren\b",
    "id": r"\b(?:me[nm]|ber|ter|pe[nm])\w{4,}|kan\b|nya\b|ngan\b",
    "en": r"ing\b|ed\b|tion\b|ly\b|\bth",
}
_ENDINGS = {k: re.compile(v, re.I) for k, v in ENDINGS.items()}


def script_of(text: str) -> str | None:
    """The non-Latin script of most letters, or None."""
    if text.isascii():
        return None
    letters = [c for c in text if c.isalpha()]
    for name, a, b in SCRIPTS:
        if sum(a <= c <= b for c in letters) * 2 > len(letters) > 0:
            return "kana" if name == "han" and any("぀" <= c <= "ヿ" for c in letters) else name
    return None


@lru_cache(maxsize=50_000)
def language(text: str) -> tuple[str | None, str | None]:
    """Language by stop words (None unless it leads clearly) and by letters and endings (None where none is typical)."""
    script = script_of(text)
    if script:
        return script, script
    words = WORD.findall(text.lower())
    hits = [0] * len(LANGS)
    for w in words:
        if mask := _OF_WORD.get(w):
            for k in range(len(LANGS)):
                hits[k] += mask >> k & 1
    order = sorted(range(len(LANGS)), key=lambda k: -hits[k])
    stop = LANGS[order[0]] if hits[order[0]] > hits[order[1]] and hits[order[0]] * 8 >= len(words) else None
    typical = {k: len(p.findall(text)) for k, p in _ENDINGS.items()} if stop is None else {stop: 1}
    best = max(typical, key=typical.get)
    return stop, best if typical[best] else None


def _votes(question: str | None, prediction: str | None) -> dict[str, int]:
    """Votes of all text voters: 1, 0 or -1 (abstain)."""
    p, q = prediction or "", question or ""
    low = p.lower()
    pw = WORD.findall(low)
    v = {"no_letter": int(not pw), "placeholder": int(0 < len(pw) <= 2 and " ".join(pw) in PLACEHOLDERS)}
    qw = WORD.findall(q.lower())
    same = same_set = 0
    if qw and pw and len(pw) >= len(qw) >= 1:
        rest, n, i = [], 0, 0
        if pw[:12] == qw[:12] or qw[0] in pw[:8]:
            while i < len(pw):
                if pw[i] == qw[0] and pw[i : i + len(qw)] == qw:
                    n += 1
                    i += len(qw)
                else:
                    rest.append(pw[i])
                    i += 1
            same = int(n > 0 and len(rest) <= 8 and all(w in LABELS for w in rest))
            same_set = int(n > 0 and set(pw) - LABELS == set(qw) - LABELS)
    v["same_words"], v["same_set"] = (same, same_set) if qw else (-1, -1)
    v["declines"] = int(any(x in low for x in _DECLINE_PIECES) and not p.rstrip().endswith("?") and bool(DECLINES.search(p)))
    v["stands_off"] = int(bool(LEAD.match(p)))
    v["shape"] = int(bool(pw) and not p.rstrip().endswith("?"))
    if not qw or not pw or len(pw) < 4 and script_of(p) is None:  # scripts without blanks have few words
        v["stop_words"] = v["letters"] = -1
    else:
        (a, b), (c, d) = language(q), language(p)
        v["stop_words"] = -1 if a is None or c is None else int(a != c)
        v["letters"] = -1 if b is None or d is None or min(len(pw), len(qw)) < 6 else int(b != d)
    return v


def pair_votes(pairs: DataFrame) -> DataFrame:
    """(id, run of voter columns) of pairs (id, question, prediction, flag_meta, flag_empty); one row per id."""
    names = [n for d in ("empty", "copied_question", "refusal", "other_language") for n in VOTERS[d] if not n.startswith("flag_")]

    def vote(frames):
        for pdf in frames:
            rows = [_votes(q if isinstance(q, str) else None, p if isinstance(p, str) else None) for q, p in zip(pdf["question"], pdf["prediction"])]
            out = {n: np.array([r[n] for r in rows], np.int8) for n in names}
            yield pd.DataFrame({"id": pdf["id"], "flag_meta": pdf["flag_meta"], "flag_empty": pdf["flag_empty"]} | out)

    slim = pairs.select("id", "question", "prediction", *(F.coalesce(F.col(f).cast("int"), F.lit(-1)).cast("byte").alias(f) for f in ("flag_meta", "flag_empty")))
    return slim.mapInPandas(vote, "id string, flag_meta byte, flag_empty byte, " + ", ".join(f"{n} byte" for n in names))


def defect_model(defect: str) -> LabelModel:
    """The label model of a defect before its fit."""
    names = list(VOTERS[defect])
    causes = [[names.index(n) for n in c] for c in CAUSES[defect]] if defect in CAUSES else None
    return LabelModel(list(VOTERS[defect].values()), causes=causes, most=MOST)


def validated_cutoffs(rows: list[dict], truth: dict[str, set[str]]) -> dict[str, tuple[float, float, float]]:
    """(cutoff, precision, recall) of every defect on labelled pairs: the cutoff of highest F1, ties to the one nearest to 0.5.

    rows: posteriors by id, as posteriors() gives them; truth: the defects of each labelled id.
    """
    out, known = {}, [r for r in rows if r["id"] in truth]
    for d in DEFECTS:
        score, y = np.array([r[d] for r in known]), np.array([float(d in truth[r["id"]]) for r in known])
        cutoff = best_threshold(score, y)
        said = score > cutoff
        hit = float((said & (y == 1)).sum())
        out[d] = (cutoff, hit / max(1, said.sum()), hit / max(1, y.sum()))
    return out


def posteriors(pairs: DataFrame) -> DataFrame:
    """(id, empty, copied_question, refusal, other_language, truncated): posterior of each defect.

    pairs: (id, question, prediction, flag_meta, flag_empty) and, where known, run_id, whose field
    limit is looked for. A null prediction is empty; a null question copies nothing and has no
    language; repeated rows count once; null ids drop out.
    """
    pairs = pairs.filter(F.col("id").isNotNull())
    run = F.col("run_id") if "run_id" in pairs.columns else F.lit(None).cast("string")
    texts = pairs.select(F.lit("p").alias("tbl"), F.col("id").alias("row_key"), run.alias("run_id"), F.col("prediction").alias("text"))
    tails = tail_evidence(texts).select(F.col("row_key").alias("id"), *(F.col(c).cast("byte").alias(c) for c in VOTERS["truncated"]))
    votes = pair_votes(pairs).dropDuplicates(["id"]).join(tails, "id", "left").fillna(0, list(VOTERS["truncated"]))
    all_voters = [n for d in DEFECTS for n in VOTERS[d]]
    # One number per pattern of all votes; at most 3 ** voters of them are counted and sent back.
    code = sum(((F.col(n).cast("long") + 1) * 3**k for k, n in enumerate(all_voters)), F.lit(0).cast("long"))
    votes = cut(votes.select("id", code.alias("code")))
    patterns = votes.groupBy("code").agg(F.count("*").alias("n")).collect()
    codes, n = np.array([r["code"] for r in patterns], np.int64), np.array([r["n"] for r in patterns], float)
    V = np.stack([codes // 3**k % 3 - 1 for k in range(len(all_voters))], 1) if len(codes) else np.zeros((0, len(all_voters)), int)
    table_, at = {}, 0
    for d in DEFECTS:
        own = V[:, at : at + len(VOTERS[d])]
        at += len(VOTERS[d])
        model = defect_model(d).fit(own, n)
        table_[d] = model.predict(own) * (own[:, [k for k, x in enumerate(VOTERS[d]) if not x.startswith("flag_")]] == 1).any(1)
    rows = [(int(c), *(float(table_[d][i]) for d in DEFECTS)) for i, c in enumerate(codes)]
    known = votes.sparkSession.createDataFrame(rows, "code long, " + ", ".join(f"{d} double" for d in DEFECTS))
    return votes.join(F.broadcast(known), "code").drop("code")  # as many rows as vote patterns


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "predictions").select("id", "run_id", F.col("source_question").alias("question"), "prediction", F.col("meta_response").alias("flag_meta"), F.col("empty_output").alias("flag_empty"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, defect) of every prediction with a defect; of several, the first in the order of DEFECTS."""
    first = F.coalesce(*(F.when(F.col(d) > CUTOFFS[d], F.lit(d)) for d in DEFECTS))
    return posteriors(_pairs(spark, sf_dir)).select("id", first.alias("defect")).filter("defect is not null")


def p3_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, defect, posterior), one row per id and defect above the defect's cutoff: all labels are kept."""
    each = F.explode(F.array(*(F.when(F.col(d) > CUTOFFS[d], F.struct(F.lit(d).alias("defect"), F.round(F.col(d), 4).alias("posterior"))) for d in DEFECTS))).alias("x")
    return posteriors(_pairs(spark, sf_dir)).select("id", each).filter("x is not null").select("id", "x.defect", "x.posterior")
