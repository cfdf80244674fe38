"""Operators against brute force and golden values on small fixtures, with nulls, empties, ties and empty tables."""

import difflib
import json

import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.functions import vectors as V
from spindrift.operators import partition as P
from spindrift.operators.metrics import calibration_bin, token_f1
from spindrift.operators.retrieval import context_budget, word_windows
from spindrift.operators.sequences import lcs_length, merge_overlaps, overlap_scores, sequence_ratio
from spindrift.sources import io


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first()["x"]


def test_ngrams_of_short_texts_are_empty(spark):
    assert one(spark, X.ngrams(X.tokens(F.col("t")), 5), t="one two three") == []
    assert one(spark, X.ngrams(X.tokens(F.col("t")), 2), t="One two, three") == ["one two", "two three"]


def test_jaccard_of_empty_sets(spark):
    a, b = X.token_set(F.col("a")), X.token_set(F.col("b"))
    assert one(spark, X.jaccard(a, b), a="", b="") == 1.0
    assert one(spark, X.jaccard(a, b), a="x", b="") == 0.0
    assert one(spark, X.jaccard(a, b), a="x y", b="y z") == pytest.approx(1 / 3)


def test_word_windows(spark):
    df = spark.createDataFrame([("d", "one two three four five six"), ("e", "")], "k string, text string")
    got = word_windows(df, ["k"], 5, 1).filter("k = 'd'").orderBy("piece").collect()
    assert [r["words"] for r in got] == [5, 2]


def test_budget_stop_is_sticky_and_first_row_stays(spark):
    df = spark.createDataFrame([("a", 1, 5000), ("a", 2, 10), ("b", 1, 10), ("b", 2, 90), ("b", 3, 1)], "g string, o int, chars long")
    got = {(r["g"], r["o"]) for r in context_budget(df, "g", "o", 99).collect()}
    assert got == {("a", 1), ("b", 1)}


def test_token_f1(spark):
    assert one(spark, token_f1(F.col("a"), F.col("b")), a="paris", b="paris") == 1.0
    assert one(spark, token_f1(F.col("a"), F.col("b")), a="", b="") == 1.0
    assert one(spark, token_f1(F.col("a"), F.col("b")), a="x x y", b="x z") == pytest.approx(0.4)


def test_calibration_edges(spark):
    got = [spark.range(1).select(calibration_bin(F.lit(c)).alias("b")).first()["b"] for c in (0.0, 0.3, 0.6, 0.7, 0.99, 1.0)]
    assert got == [0, 2, 5, 6, 9, 9]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.5, 0.5])], "v array<double>, p array<double>")
    r = df.select(V.norm(F.col("v")).alias("n"), V.entropy(F.col("p")).alias("h"), V.jensen_shannon(F.col("p"), F.col("p")).alias("j")).first()
    assert r["n"] == pytest.approx(5) and r["h"] == pytest.approx(1) and r["j"] == pytest.approx(0)


def test_hash_rank_is_a_permutation_with_nulls_and_hot_groups(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, "hot").alias("g"))
    got = P.hash_rank(df, ["g"], F.md5(F.col("id").cast("string")), "id").collect()
    for g in ("hot", None):
        ranks = sorted(r["rank"] for r in got if r["g"] == g)
        assert ranks == list(range(1, len(ranks) + 1))
    assert len(got) == 500


def test_largest_remainder():
    assert P.largest_remainder([1, 1, 1], 10) == [4, 3, 3]
    assert P.largest_remainder([], 0) == []


def test_sequence_scores(spark):
    assert lcs_length(list("abcbdab"), list("bdcaba")) == 4
    assert lcs_length([], ["a"]) == 0
    df = spark.createDataFrame([("1", "the cat sat", "the cat sat"), ("2", "", "")], "id string, prediction string, reference string")
    got = {r["id"]: r for r in overlap_scores(df).collect()}
    assert got["1"]["rouge1"] == 1.0 and got["1"]["rouge_l"] == 1.0 and got["2"]["rouge_l"] == 0.0
    r = sequence_ratio(spark.createDataFrame([("abcd", "bcde")], "a string, b string"), "a", "b").first()["ratio"]
    assert r == difflib.SequenceMatcher(None, "abcd", "bcde").ratio()


def test_merge_joins_shared_runs_once(spark):
    run = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [("s", 1, 2, f"{run} end"), ("s", None, 1, f"start {run}"), ("s", 1, 2, f"{run} end"), ("t", 1, 1, None)]
    df = spark.createDataFrame(rows, "source string, page int, chunk_id int, text string")
    got = {r["source"]: r["merged"] for r in merge_overlaps(df).collect()}
    assert got["s"] == f"start {run} end" and got["t"] == ""


def test_sources(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"a": 1}\n{"a": 2}\n')
    bad.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert io.read_jsonl(spark, str(good), "a int").count() == 2
    with pytest.raises(ValueError):
        io.read_jsonl(spark, str(bad), "a int")
    assert io.read_jsonl(spark, str(bad), "a int", strict=False).count() == 2
    (tmp_path / "arr.json").write_text(json.dumps([{"a": 1}, {"a": 2}, {"a": 3}]))
    assert io.read_json_array(spark, str(tmp_path / "arr.json"), "a int").count() == 3
    (tmp_path / "x.csv").write_text("text,label\nhello,Apply\n,Apply\nbye,Other\n")
    assert io.read_labelled_csv(spark, str(tmp_path / "x.csv"), "text", "label", ["Apply"]).count() == 1
    assert [r["text"] for r in io.read_text_csv(spark, str(tmp_path / "x.csv"), ["text"]).collect()] == ["hello", "", "bye"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes(b"caf\xc3\xa9 \xff!")
    assert io.read_texts(spark, str(tmp_path / "t")).first()["text"] == "café !"
    pages = io.with_parser(spark.read.format("binaryFile").load(str(tmp_path / "t")), lambda b: b.decode("utf-8", "ignore").split(" "))
    assert [(r["page"], r["text"]) for r in pages.collect()] == [(1, "café"), (2, "!")]
    h = io.file_hashes(spark, str(tmp_path / "t"))
    assert io.check_manifest(h, h).count() == 0
    assert io.check_manifest(h, h.withColumn("sha256", F.lit("0"))).first()["violation"] == "changed"
    with pytest.raises(ValueError):
        io.read_tasks(spark, str(tmp_path), "id string", ["nope"], {"qa"})


def test_top_matches_over_many_blocks(spark, monkeypatch):
    import numpy as np

    from spindrift.operators import retrieval as R

    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    monkeypatch.setattr(R, "CORPUS_BLOCK", 30)
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (200, 4)).astype(float)  # many ties
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {(r["q"], r["v"], r["r"]) for r in R.top_matches(df.filter("vec_id % 20 = 0"), df, 5).collect()}
    want = set()
    for q in range(0, 200, 20):
        order = sorted((k for k in range(200) if k != q), key=lambda k: (-float(v[q] @ v[k]), k))[:5]
        want |= {(q, k, i + 1) for i, k in enumerate(order)}
    assert got == want
    assert R.top_matches(df.limit(0), df, 5).count() == 0
