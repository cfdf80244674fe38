"""Core queries that have no SQL, against known answers and plain Python."""

import difflib
import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from spindrift import catalog
from spindrift.runtime import table


def rows(spark, data, name):
    return catalog.QUERIES[name](spark, data).collect()


def test_hashed_features(spark, data):
    want = {}
    for r in table(spark, data, "eval_items").collect():
        w = re.findall("[a-z0-9]+", r["text"].lower())
        grams = {" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)}
        want[str(r["item_id"])] = len({int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little") % 2048 for g in grams})
    assert {r["id"]: r["features"] for r in rows(spark, data, "n12_hashed_features")} == want


def test_perturbed_queries(spark, data):
    got = {r["vec_id"]: r["shift"] for r in rows(spark, data, "n03_perturbed_queries")}
    e = table(spark, data, "embeddings").select("vec_id", "embedding").first()
    v = np.array(e["embedding"], float)
    w = v + np.random.default_rng(int.from_bytes(hashlib.sha256(f"7:{e['vec_id']}".encode()).digest()[:8], "little") % 2**32).normal(0.0, 0.02, len(v))
    assert got[e["vec_id"]] == pytest.approx(np.linalg.norm(w / np.linalg.norm(w) - v), abs=1e-5)
    assert len(got) == table(spark, data, "embeddings").count()


def test_verbatim_rewrites(spark, data):
    norm = lambda t: re.sub(r"^\S+ ", "", re.sub("[^a-z0-9]+", " ", t.lower()).strip(" "))
    p = table(spark, data, "predictions").filter("task = 'bloom_rewrite' and prediction is not null and source_question is not null").select("id", "source_question", "prediction").distinct().collect()
    want = {r["id"] for r in p if difflib.SequenceMatcher(None, norm(r["source_question"]), norm(r["prediction"])).ratio() >= 0.94}
    got = rows(spark, data, "pr13_verbatim_rewrites")
    assert len(got) == len(p) and {r["id"] for r in got if r["verbatim"]} == want


def test_bootstrap_interval(spark, data):
    r = rows(spark, data, "a11_bootstrap")[0]
    k = rows(spark, data, "a05_ordinal")[0]
    assert r["low"] <= r["mean"] <= r["high"] and r["high"] - r["low"] < 0.4 and k["n"] > 0
    assert [tuple(r)] == [tuple(x) for x in rows(spark, data, "a11_bootstrap")]  # the same at every run


def test_overlap_scores(spark, data):
    p = {r["id"]: r for r in table(spark, data, "predictions").filter("task = 'summarization' and prediction is not null and reference is not null").collect()}
    got = rows(spark, data, "a15_rouge")
    assert len(got) == len(p)
    for r in got:
        a, b = (re.findall("[a-z0-9]+", p[r["id"]][c].lower()) for c in ("prediction", "reference"))
        for n, name in ((1, "rouge1"), (2, "rouge2")):
            x, y = (Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) for w in (a, b))
            total = sum(x.values()) + sum(y.values())
            assert r[name] == pytest.approx(2 * sum((x & y).values()) / total if total else float(a == b), abs=1e-6)


def test_capped_scan_is_a_repeatable_sample(spark, data):
    a, b = rows(spark, data, "s11_capped_scan"), rows(spark, data, "s11_capped_scan")
    assert a == b and len({r["doc_id"] for r in a}) == min(50, table(spark, data, "documents").count())


def test_dirichlet_clients_hold_every_row_once(spark, data):
    got = catalog.QUERIES["w16_dirichlet"](spark, data)
    key = got.columns[0]
    assert got.count() == got.select(key).distinct().count() > 0
    assert got.select("client").distinct().count() > 1


def test_models(spark, data):
    guard = sorted(rows(spark, data, "m01_federated_guard"), key=lambda r: r["round"])
    assert [r["round"] for r in guard] == [0, 1, 2] and guard[-1]["loss"] < guard[0]["loss"]
    base = rows(spark, data, "m03_linear_baseline")[0]
    assert base["n"] > 0 and 0 <= base["accuracy"] <= 1


def test_merged_sources_hold_the_first_text(spark, data):
    got = {r["source"]: r for r in rows(spark, data, "w07_merged_sources")}
    chunks = table(spark, data, "document_chunks").filter("source is not null")
    assert set(got) == {r["source"] for r in chunks.select("source").distinct().collect()}
    assert all(len(r["merged"]) <= 9000 for r in got.values())
    s = min(got)
    first = min((r for r in chunks.filter(chunks.source == s).collect() if (r["text"] or "").split()), key=lambda r: (r["page"] or 0, r["chunk_id"]))
    assert got[s]["merged"].startswith(" ".join(first["text"].split())[:200])
