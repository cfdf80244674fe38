"""Similarity join and components against brute force; near-duplicate and split operators on edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spindrift.llm import sets as S
from spindrift.llm.near_duplicates import key_groups, text_groups
from spindrift.llm.splits import allot_bins, assign_splits, largest_differencing, linked_groups, plan_bins

WORDS = re.compile(r"[^\W_]+")


def brute(sets, t):
    out, items = set(), sorted(sets.items())
    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1 :]:
            if x and y and len(x & y) >= t * len(x | y) - 1e-12:
                out.add((a, b))
    return out


def make(n, vocabulary, seed, low=3, high=40):
    rng, sets = random.Random(seed), {}
    words = [rng.getrandbits(62) for _ in range(vocabulary)]
    while len(sets) < n:
        if sets and rng.random() < 0.4:
            s = set(rng.choice(list(sets.values())))
            for _ in range(rng.randint(0, 4)):
                (s.discard if rng.random() < 0.5 else s.add)(rng.choice(words))
        else:
            s = set(rng.sample(words, rng.randint(low, high)))
        if s and frozenset(s) not in set(sets.values()):
            sets[len(sets) * 7 + 1] = frozenset(s)
    return sets


@pytest.mark.parametrize("vocabulary,t,seed", [(60, 0.8, 1), (400, 0.8, 2), (60, 0.6, 3), (5000, 0.9, 4)])
def test_join_finds_every_pair(spark, vocabulary, t, seed):
    sets = make(300, vocabulary, seed, high=min(40, vocabulary))
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "sid long, toks array<long>")
    got = {(r["a"], r["b"]) for r in S.similar_sets(df, t).collect()}
    assert got == brute(sets, t)


def test_long_lists_are_split_into_block_pairs(spark, monkeypatch):
    sets = make(250, 40, 5, high=30)
    monkeypatch.setattr(S, "LIST_BLOCK", 40)
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "sid long, toks array<long>")
    assert {(r["a"], r["b"]) for r in S.similar_sets(df, 0.8).collect()} == brute(sets, 0.8)


def test_large_list_path_matches_small(spark):
    common = list(range(1, 13))
    sets = {k: frozenset([*common, 1000 + k % 400, 2000 + k % 17]) for k in range(1, 420)}
    sets = {k: v for k, v in sets.items()}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "sid long, toks array<long>")
    assert {(r["a"], r["b"]) for r in S.similar_sets(df, 0.8).collect()} == brute(sets, 0.8)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(-400, 400), rng.randint(-400, 400)) for _ in range(330)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5200)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert S.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_edge_cases(spark):
    a = " ".join(f"w{k}" for k in range(20))
    rows = [("f", "1", a), ("f", "1", a), ("f", "2", a.upper() + "!"), ("f", "3", a + " extra"), ("g", "4", a), ("f", "5", None), ("f", "6", ""), ("f", None, a), ("f", "7", "... --")]
    members, links = text_groups(spark.createDataFrame(rows, "field string, key string, text string"))
    sid = {(r["field"], r["key"]): r["sid"] for r in members.collect()}
    assert set(sid) == {("f", "1"), ("f", "2"), ("f", "3"), ("g", "4")}
    assert sid["f", "1"] == sid["f", "2"] != sid["g", "4"]
    assert [{r["a"], r["b"]} for r in links.collect()] == [{sid["f", "1"], sid["f", "3"]}]
    members, links = text_groups(spark.createDataFrame([], "field string, key string, text string"))
    assert members.count() == 0 and links.count() == 0


def test_linked_groups(spark):
    q = "why does the alpine lichen change the cached queue although the rotor stays still"
    rows = [("a", "s1", "one two three"), ("b", "s1", None), ("b", "s1", None), ("c", None, q), ("d", "s2", q + " today"), ("e", None, None), ("f", None, ""), (None, "s1", q), ("g", "s3", "far away")]
    got = {r["id"]: r["group_id"] for r in linked_groups(spark.createDataFrame(rows, "id string, source string, question string"), 0.8).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e", "f": "f", "g": "g"}
    assert linked_groups(spark.createDataFrame([], "id string, source string, question string"), 0.8).count() == 0


def test_a_key_with_two_texts_joins_their_groups(spark):
    one, two = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))
    rows = [("f", "a", one), ("f", "b", one + " x"), ("f", "b", two), ("f", "c", two + " y"), ("f", "d", "far away"), ("g", "a", two), ("f", "b", two)]
    got = {(r["field"], r["key"]): r["group_id"] for r in key_groups(*text_groups(spark.createDataFrame(rows, "field string, key string, text string"))).collect()}
    assert got == {("f", "a"): "a", ("f", "b"): "a", ("f", "c"): "a", ("f", "d"): "d", ("g", "a"): "a"}


def test_an_id_with_two_sources_joins_their_groups(spark):
    rows = [("a", "s1", "one"), ("b", "s1", "two"), ("c", "s2", "three"), ("d", "s2", None), ("e", "s1", "four"), ("e", "s2", "four"), ("f", "s3", "five"), ("g", None, "six seven"), ("g", "s3", "six seven"), ("h", None, None)]
    got = {r["id"]: r["group_id"] for r in linked_groups(spark.createDataFrame(rows, "id string, source string, question string"), 0.8).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "a", "f": "f", "g": "f", "h": "h"}


def test_largest_differencing_balances():
    w = [8, 7, 6, 5, 4]
    bins = largest_differencing(w, 2)
    loads = [sum(x for x, b in zip(w, bins) if b == k) for k in (0, 1)]
    assert sorted(loads) == [14, 16]
    assert largest_differencing([], 3) == []
    runs, loads = plan_bins([(1, 1000), (50, 3), (400, 1)], 10)
    assert sum(loads) == 1550 and max(loads) == 500 or max(loads) < 520
    split = allot_bins(loads, [("train", 0.7), ("validation", 0.15), ("test", 0.15)])
    total = {s: sum(x for x, y in zip(loads, split) if y == s) for s in set(split)}
    assert abs(total["train"] / 1550 - 0.7) < 0.05


def test_splits_never_part_a_group(spark):
    rows = [(f"{k:04d}", f"{k - k % 7:04d}") for k in range(700)] + [(f"x{k:03d}", "x000") for k in range(300)]
    g = spark.createDataFrame(rows, "id string, group_id string")
    g = g.join(g.groupBy("group_id").agg(F.count("*").alias("size")), "group_id").select("id", "group_id", "size")
    shares = spark.createDataFrame([("train", 0.7), ("validation", 0.15), ("test", 0.15)], "split string, share double")
    got = assign_splits(g, shares).collect()
    assert len(got) == 1000 and len({r["id"] for r in got}) == 1000
    assert all(len({r["split"] for r in got if r["group_id"] == x}) == 1 for x in {r["group_id"] for r in got})
    n = sum(r["split"] == "train" for r in got)
    assert 680 <= n <= 720


def test_words_of_a_text_are_found_once_and_short_texts_drop_out(spark):
    from spindrift.llm.near_duplicates import text_sets

    rows = [("q", "a", "one two"), ("p", "b", "one two"), ("p", "c", "One, two THREE three"), ("q", "d", " ?"), ("q", None, "one"), ("q", "e", None)]
    df = spark.createDataFrame(rows, "field string, key string, text string").repartition(2)
    got = text_sets(df, F.when(F.col("field") == "q", 1).otherwise(3))
    assert {(r["field"], r["key"], len(r["toks"])) for r in got.collect()} == {("q", "a", 2), ("p", "c", 3)}
    assert {r["key"] for r in text_sets(df).collect()} == {"a", "b", "c"}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
