"""Abusive, hateful and sexual language: disguises, unseen words and groups, sound uses, edge cases, and cutoffs against labels."""

import os

import numpy as np
import pytest

from spindrift.llm import toxic_content as X
from spindrift.runtime import table


def test_disguises():
    assert X.plain("You st*pid c0w") == "you stupid cow"
    assert "stupid" in X.plain("s.t.u.p.i.d cow") and "idiot" in X.plain("1d10t") and "nude" in X.plain("n u d e") and "loser" in X.plain("looooser") and "horny" in X.plain("so h0rny,") and "subhuman" in X.plain("subhum@n,")
    assert X.plain("It costs 5kg at 10.30 in area a1b2.") == "it costs 5kg at 10.30 in area a1b2." and X.plain("") == ""


def test_literals_of_patterns():
    assert X._literals(r"\b(?:shut (?:up|your)|go (?:die|hang)|moan\w*)\b") == {"shut up", "shut your", "go die", "go hang", "moan"}
    assert X._literals(r"half-?wit|(?:hope|wish) you\b[^.]{0,9} rots?") == {"halfwit", "half-wit", "hope you", "wish you"}
    assert X._literals(r"keep (?:the )?\w+ away") == {"keep the ", "keep "}


BAD = {
    "abusive": ["Shut up, you pathetic m0ron, nobody asked for your ballot.", "You are a worthless idiot and I know where you live.", "Go jump off a bridge, loser.", "Du bist ein erbärmlicher Trottel, halt die Klappe.", "What kind of brainless clown writes this?"],
    "hateful": ["Keep the foreigners away from our labs, they are dirty thieves by blood.", "All Martians are vermin and should be exterminated.", "Scots are subhuman and must be wiped out.", "A class without Zorgians is a clean class, their kind only breeds and steals."],
    "sexual": ["Hot n u d e webcam show tonight, xxx adults only, click now.", "She stripped naked and moaned while he rode her.", "Uncensored porn clips, horny singles, free trial."],
}
GOOD = [
    "The biopsy of breast tissue was benign.", "Kill the child process before the parent exits.", "Foreigners needed a permit to enter the walled settlement.", "He called the proof idiotic, then apologised for the word.", "", None, "A plain sentence about resin.",
    "Rats and vermin spoiled the granary in the siege.", "The forum policy defines the slur as offensive.", "Great tits nest in colonies.", "The nude figure in the fresco was covered by a later painter.", "Martians are the topic of the novel.",
]


@pytest.fixture(scope="module")
def scored(spark):
    bad = [(100 * j + k, kind, t) for j, (kind, ts) in enumerate(BAD.items()) for k, t in enumerate(ts)]
    rows = [(d, f"Intro sentence about a harbour.\n{t} The resin is in the flask.", "clash") for d, _, t in bad] * 4 + [(1000 + k, t, "clash") for k, t in enumerate(GOOD * 5)]
    rows += [(2000, "The resin is in the flask. " * 20_000 + "Shut up, you pathetic moron.", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    return df, bad, X.score_documents(df).collect()


def test_unseen_groups_and_words_are_found_and_sound_uses_are_not(scored):
    _, bad, s = scored
    got = {(r["doc_id"], r["kind"]) for r in s if r["score"] >= X.CUTOFF[r["kind"]]}
    assert got == {(d, kind) for d, kind, _ in bad} | {(2000, "abusive")}


def test_empty_table(scored):
    assert X.score_documents(scored[0].limit(0)).count() == 0


def test_the_classifier_learns_words_that_no_voter_knows():
    model = X.SentenceClassifier()
    votes = [0] * len(X.NAMES)
    own = list(votes)
    own[X.NAMES.index("abusive_insult")] = own[X.NAMES.index("abusive_aimed")] = 1
    sentences = [f"what a flumpt no{k}x no{k}y" for k in range(300)] + [f"what a river in va{k} and vb{k}" for k in range(2400)]
    n = 300
    y = np.array([1.0] * n + [0.0] * (len(sentences) - n))
    model.fit(sentences, [own] * n + [votes] * (len(sentences) - n), {"abusive": y, "hateful": y * 0, "sexual": y * 0})
    assert "flumpt" in model.learned(sentences)
    assert model.score("a flumpt", votes)["abusive"] > model.score("a meadow", votes)["abusive"] * 2


def test_correlations_and_size():
    codes = np.array([1, 3, 8, 9, 16, 48, 112, 128, 384])
    n = np.array([40.0, 30, 60, 50, 20, 30, 25, 12, 9])
    a, b = X.kind_posteriors(codes, n), X.kind_posteriors(codes, n * 1000)
    assert all(np.allclose(a[k], b[k]) for k in X.KINDS)  # the same mix gives the same scores at every size
    assert all(len(x) == 0 for x in X.kind_posteriors(np.zeros(0, np.int64), np.zeros(0)).values())


def test_cutoffs_hold_against_labels(spark):
    """On the largest test table with labels: no other cutoff of a kind is better by more than half a point of F1."""
    d = "/root/testdata/sf0.1"
    if not os.path.exists(f"{d}/doc_labels.parquet"):
        pytest.skip("no labels")
    labels = table(spark, d, "doc_labels")
    s = X.score_documents(table(spark, d, "documents").join(labels.select("doc_id").distinct(), "doc_id"))
    got = X.validated_cutoffs(s.persist(), labels)
    assert all(f >= 0.88 for _, f in got.values()), got
    at = {k: max(abs(c - X.CUTOFF[k]), 0) for k, (c, _) in got.items()}
    assert max(at.values()) <= 0.05, got


def test_every_sentence_is_scored_as_by_the_classifier(spark):
    model = X.SentenceClassifier()
    rng = np.random.default_rng(4)
    model.w = {k: rng.normal(0, 0.8, X.CELLS + len(X.NAMES) + 1).tolist() for k in X.KINDS}
    texts = ["The meadow is green. Rain falls on it! Who asked?", "You are a pathetic idiot. The meadow is green.", "...", "meadow"]
    got = X.document_scores(texts, model)
    for t, row in zip(texts, got):
        each = [model.score(s, X.sentence_votes(s)) for s in X._SPLIT.split(X.plain(t)) if s.strip()]
        assert np.allclose(row, [max(e[k] for e in each) for k in X.KINDS])
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, ""])], "doc_id long, text string")
    assert {r["doc_id"] for r in X.score_documents(docs).collect()} == {0, 1, 2, 3}  # also without any voter's word
