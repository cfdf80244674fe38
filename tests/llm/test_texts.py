"""Text operators on small fixtures: nulls, empties, long texts, ties, repeated rows and clashing extra columns."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.llm import chunking as C
from spindrift.llm import defective_pairs as D
from spindrift.llm import eval_leaks as L
from spindrift.llm import personal_data as P
from spindrift.llm import tokenize as K
from spindrift.llm import truncation as T
from spindrift.llm.boosting import BoostedTrees, best_threshold


def test_boosted_trees_learn_an_interaction():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (600, 6)).astype(float)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0)).astype(float)
    m = BoostedTrees().fit(x[:400], y[:400])
    assert ((m.predict(x[400:]) > 0.5) == y[400:]).mean() > 0.97
    assert best_threshold(np.array([0.1, 0.9]), np.array([0.0, 1.0])) == 0.5
    assert BoostedTrees().fit(np.zeros((0, 3)), np.zeros(0)).predict(np.zeros((2, 3))).shape == (2,)


PEOPLE = [(g, a + b) for g in ("Ilse", "Kirit", "Zoë") for a in ("Var", "Okes", "Brin", "Hal") for b in ("holt", "dale", "toft", "gren")]


def test_personal_data(spark):
    texts = [
        "Send it to ilse.varholt@campus.invalid before Friday.", "Call +44 7700 900 731 now.", "Card 666-45-5575 does not open.", "Dr. Ilse Varholt signed the form.",
        "The Varholt theorem still holds.", "Version 10.4.2.118 fixed the bug.", "Postal address: 157 Larkmoor Lane, Merrowby.", "I met Brindale, Kirit there.", "", None,
        "Use @property on the class and a @ 3.5 V supply.", "Ticket 5550142 is closed.",
    ] * 12
    df = spark.createDataFrame([("t", str(k), x, "clash") for k, x in enumerate(texts)], "tbl string, row_key string, text string, kind string")
    people = spark.createDataFrame(PEOPLE, "given_name string, family_name string")
    got = {(int(r["row_key"]), r["kind"], r["start_at"]) for r in P.find_mentions(df.select("tbl", "row_key", "text"), people).collect()}
    want = {(0, "email", 11), (1, "phone", 5), (2, "identity_number", 5), (3, "person_name", 4), (6, "street_address", 16), (7, "person_name", 6)}
    assert {x for x in got if x[0] < 12} == want
    assert P.find_mentions(df.limit(0).select("tbl", "row_key", "text"), people).count() == 0
    assert P.redact("a b c", [("email", 2, 3)]) == "a [EMAIL] c" and P.redact(None, []) is None


def test_numbers_outside_reserved_ranges(spark):
    """The trees learn from shapes and cues, so numbers of any range count; precision and recall per kind on held-out spans."""
    rng = random.Random(6)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    nanp = lambda: f"{rng.randint(2, 9)}{d(2)}{rng.choice('-. ')}{rng.randint(2, 9)}{d(2)}-{d(4)}"
    forms = [
        lambda: f"Call +{rng.randint(20, 98)} {d(3)} {d(4)} {d(3)} today.", lambda: f"Her number is ({rng.randint(2, 9)}{d(2)}) {rng.randint(2, 9)}{d(2)}-{d(4)}.", lambda: f"Ring {nanp()} at noon.",
        lambda: f"SSN {d(3)}-{d(2)}-{d(4)} is on file.", lambda: f"The card {d(4)} {d(4)} {d(4)} is lost.", lambda: f"Passport {rng.choice('ABCDE')}{d(8)} was found.", lambda: f"ID no. {d(9)} was seen.", lambda: f"Tax number {d(3)}.{d(3)}.{d(3)}-{d(2)} is his.",
        lambda: f"Version {d(2)}.{d(1)}.{d(1)}.{d(3)} fixed it.", lambda: f"Order {d(9)} came late.", lambda: f"Sample {d(4)}-{d(4)} is dry.", lambda: f"Ticket {d(7)} is closed.", lambda: f"Mail {rng.choice('abcd')}{d(3)}@inbox.example now.", lambda: f"Ilse {rng.choice(['Varholt', 'Haldale', 'Okesgren'])} wrote it.",
        lambda: f"The {rng.choice(['Varholt', 'Haldale', 'Okesgren'])} theorem holds.", lambda: f"Deliver it to {d(2)} Larkmoor Lane, Merrowby.",
    ]
    texts = [f() for f in forms for _ in range(60)]
    model, cut, report = P.train(texts, PEOPLE)
    assert set(report) == set(P.KINDS) and all(p >= 0.95 and r >= 0.95 for p, r, n in report.values() if n), report
    lex = P.Lexicon(PEOPLE)
    got = {t: [(k, t[a:b]) for k, a, b in P.mentions(t, lex, model, cut)] for t in ("SSN 123-45-6789 is on file.", "Passport C01234567 was lost.", "Call (212) 736-5000 today.", "Ilse Varholt (1234 5678 9012) came.", "Order 219099999 is late.")}
    assert list(got.values()) == [[("identity_number", "123-45-6789")], [("identity_number", "C01234567")], [("phone", "(212) 736-5000")], [("person_name", "Ilse Varholt"), ("identity_number", "1234 5678 9012")], []]


def test_personal_data_in_a_very_long_text(spark):
    lex = P.Lexicon(PEOPLE)
    model, cut, _ = P.train(["Call +44 7700 900 731 now. Ilse Varholt came. The Varholt theorem holds. Version 10.4.2.118 is out."] * 50, PEOPLE)
    long = "word " * 40_000 + "Ilse Varholt"
    assert P.mentions(long, lex, model, cut) == [("person_name", 200_000, 200_012)]


def test_languages():
    assert D.language("Explique por que o sistema não funciona sem o processo rural")[0] == "pt"
    assert D.language("Wie beeinflusst die Karte die Grenze, wenn sie nicht hängt?")[0] == "de"
    assert D.language("")[0] is None


def test_truncation(spark):
    fill = [("t", f"f{k}", "r", "The polymeric alloy joins the buffered resin and the kidney. The kidney stays.") for k in range(60)]
    rows = [
        ("t", "word", "r", "The polymeric alloy joins the buffe"), ("t", "func", "r", "The polymeric alloy joins the kidney and the"), ("t", "comma", "r", "The polymeric alloy joins the kidney,"),
        ("t", "nomark", "r", "The polymeric alloy joins the buffered resin and the kidney"), ("t", "short", "r", "the kidney"), ("t", "null", None, None), ("t", "empty", "r", ""), ("t", "tag", "r", "The polymeric alloy joins the kidney.<|im_end|>"),
        ("t", "word", "r", "The polymeric alloy joins the buffe"), ("t", "bad", None, "The polymeric alloy joins the resin and th�"),
    ]
    df = spark.createDataFrame(fill + rows, "tbl string, row_key string, run_id string, text string")
    assert sorted(r["row_key"] for r in T.truncated(df).collect()) == ["bad", "comma", "func", "word"]
    assert T.truncated(df.limit(0)).count() == 0


def test_texts_pile_up_at_a_field_limit(spark):
    rng = random.Random(8)
    nouns = ["alloy", "resin", "kidney", "buffer", "meadow", "census", "harbour", "lens"]
    text = lambda n: " ".join(f"The {rng.choice(nouns)} joins the {rng.choice(nouns)} and a {rng.choice(nouns)}." for _ in range(n))
    rows = [("t", f"w{k}", f"run{k % 2}", text(rng.randint(2, 5))) for k in range(300)]
    rows += [("t", f"c{k}", "run0", (text(4) + " And more.")[:70].rstrip(".") ) for k in range(80)]
    rows += [("t", "whole", "run0", "The resin joins the lens. The alloy and the harbour stay near a kidney"), ("t", "other", "run1", "The resin joins the lens. The alloy and the harbour stay near a kidney")]
    rows += [("t", f"s{k}", "run1", "the resin and the lens beside a kidney") for k in range(50)] + [("t", "long", "run1", "x" * 200_000 + " The resin.")]
    df = spark.createDataFrame(rows, "tbl string, row_key string, run_id string, text string")
    got = {r["row_key"]: r for r in T.tail_evidence(df).collect()}
    assert got["whole"]["at_limit"] and not got["other"]["at_limit"]
    assert not any(got[f"s{k}"]["at_limit"] for k in range(50))


def test_chunks_are_within_limits_and_share_their_overlap():
    rng = random.Random(2)
    words = ["alpha", "beta,", "gamma.", "delta\n\n", "epsilon", "é́clair", "長い文。"]
    for n in (0, 10, 500, 5000, 60_000):
        text = ""
        while len(text) < n:
            text += rng.choice(words) + rng.choice([" ", " ", "", "\n"])
        got = C.pieces(text, 800, 80)
        assert got[0][0] == 0 and got[-1][1] == len(text)
        assert all(b - a <= 800 for a, b in got)
        assert all(x[1] - y[0] == 80 for x, y in zip(got, got[1:]))
        assert "".join(text[a + (80 if k else 0) : b] for k, (a, b) in enumerate(got)) == text
    assert C.pieces("x" * 3000, 800, 80)[0] == (0, C.pieces("x" * 3000, 800, 80)[0][1])


def test_an_edit_moves_only_cuts_near_it():
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", ".", ","]) for _ in range(6000))
    a = set(C.cuts(text, 1500, 120))
    b = {x - 4 for x in C.cuts("new " + text, 1500, 120)}
    assert len(a & b) > 0.6 * len(a)


def test_pieces_are_not_all_of_the_least_size():
    rng = random.Random(7)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(20_000))
    for limit in (1000, 5000):
        sizes = [b - a for a, b in C.pieces(text, limit, 0)[:-1]]
        assert 0.45 * limit < sum(sizes) / len(sizes) < 0.8 * limit and max(sizes) <= limit


def test_chunking_edge_rows(spark):
    items = spark.createDataFrame([("s", 1, None, "text", "a " * 900), ("s", 1, None, "text", "a " * 900), ("s", 2, 3, "film", "b" * 9000), ("s", 3, 1, "text", None), ("s", 4, 1, "text", "")], "source string, chunk_id int, page int, modality string, text string")
    limits = spark.createDataFrame([("text", 1500, 120)], "modality string, max_chars int, overlap_chars int")
    got = [(r["chunk_id"], r["pieces"]) for r in C.split_items(items, limits).filter("piece = 0").orderBy("chunk_id").collect()]
    assert got == [(1, 2), (2, 1), (4, 1)]
    assert C.split_items(items.limit(0), limits).count() == 0


def test_encoding_equals_the_reference_library(spark):
    import public_tokenizers
    import tiktoken

    ranks = dict(K.read_ranks(K.ranks_path()))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "Hello world's end", " \n\n  two\tspaces 　", "naïve café 北京 😀😀", "x" * 300, "a" + "́" * 5, "1234567 99", "<|endoftext|>", "don't WE'LL", "​ zero", "tail   ", "".join(random.Random(3).choice("abcdeé") for _ in range(100_000)), "ab" * 2000, "" .join(random.Random(4).choice("etaoinshr") for _ in range(129))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    ids = K.encode(df.union(df))
    got = {r["doc_id"]: r["ids"] for r in ids.collect()}
    assert got == {k: enc.encode_ordinary(t or "") for k, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in K.decode(ids).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    assert K.encode(df.limit(0)).count() == 0


ITEM = "Critics of the harbour plan cite the embedded parser; meanwhile somebody sold the allergic ward by candlelight, and the censored percentile was abandoned for good."


def test_leaks(spark):
    stock = " Show all working and state your units."
    items = [(1, ITEM + stock), (2, "Half the crew mistook the carved statue for a sealed ordinance while bells rang for the missing pulse." + stock), (3, "Thirty coins bought a skewed dataset and half a gilded mural but never once consulted the cohort." + stock), (4, None)]
    damaged = ITEM.replace("plan", "p1an").replace("somebody", "someone").replace("for good", "for ever")
    docs = [
        (10, "Before. " + ITEM.upper() + " After."), (11, "Intro <p>" + damaged.replace(" ", "  ") + "</p>"), (12, "cite the embedded parser; meanwhile somebody sold"), (13, stock * 3), (14, None), (15, ""),
        (16, "x " * 30_000 + ITEM), (17, "Critics of the harbour plan cite the taxed levy; meanwhile somebody sold the woven novel by candlelight, and the rural market was ruined."), (10, "Before. " + ITEM.upper() + " After."),
        (18, ITEM.replace("candlelight", "candle-\nlight").replace("percentile", "percen-\ntile")),
    ]
    found = L.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["item_id"], r["doc_id"]) for r in found} == {(1, 10), (1, 11), (1, 16), (1, 18)}
    at = {r["doc_id"]: r["start_at"] for r in found}
    assert at[10] == 8 and at[16] == 60_000
    none = spark.createDataFrame([], "item_id long, text string")
    assert L.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0


def test_a_passage_of_many_items_and_sentences_of_one_pattern(spark):
    passage = "Ferry logs never name the diplomatic council directly; afterwards a clerk hid the judicial record inside the polymeric isotope."
    asks = ["Which council does the passage leave out of its account of the harbour?", "Who hid the record, and where was it hidden by that clerk?", "Why would a clerk of the harbour hide a record at all?"]
    items = [(k, f"{passage} {a} Answer every part in complete sentences.") for k, a in enumerate(asks)]
    items += [(3 + k, f"Critics of the {a} plan cite the {b}; meanwhile somebody sold the {c} by candlelight, and the {d} was abandoned for good.") for k, (a, b, c, d) in enumerate([("harbour", "embedded parser", "allergic ward", "censored percentile"), ("railway", "pardoned ballot", "viscous coil", "disputed referendum"), ("market", "carved stanza", "walled caravan", "cached directory")])]
    docs = [
        (1, "Intro. " + passage), (2, passage.replace("clerk", "c1erk").replace("directly", "ever")), (3, "Answer every part in complete sentences. " * 5), (4, items[4][1].upper()),
        (5, "Critics of the bridge plan cite the frozen budget; meanwhile somebody sold the mural by candlelight, and the novel was abandoned for good."), (6, passage + " " + items[5][1]),
    ]
    found = L.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(i, d) for d in (1, 2, 6) for i in (0, 1, 2)} | {(4, 4), (5, 6)}
    assert {(r["item_id"], r["doc_id"]) for r in found} == want
    assert L.is_stock("marks are shown in brackets at right".split()) and not L.is_stock("who hid the record and where".split())
