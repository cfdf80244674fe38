"""Queries over whole tables: nothing is cut by source, run, label, language or character set before the work."""

import difflib
import hashlib
import re
from collections import Counter

from spindrift import catalog
from spindrift.functions import text as X
from spindrift.operators import sequences
from spindrift.runtime import table


def words(text):
    return re.findall("[a-z0-9]+", text.lower())


def test_items_meet_the_documents_of_every_source(spark, data):
    docs = {r["doc_id"]: Counter(words(r["text"])) for r in table(spark, data, "documents").filter("text is not null").collect()}
    items = {r["item_id"]: Counter(words(r["text"])) for r in table(spark, data, "eval_items").collect()}
    want = set()
    for i, a in items.items():
        shared = sorted((-sum((a & b).values()), k) for k, b in docs.items() if a & b)[:3]
        want |= {(i, k, -n) for n, k in shared}
    got = {(r["item_id"], r["doc_id"], r["shared"]) for r in catalog.QUERIES["t17_multiset_overlap"](spark, data).collect()}
    assert got == want
    sources = table(spark, data, "documents").select("doc_id", "source")
    for name in ("t17_multiset_overlap", "j10_lexical_rank"):
        assert catalog.QUERIES[name](spark, data).join(sources, "doc_id").filter("source != 'papers-final'").count(), name
    assert {r["doc_id"] for r in catalog.QUERIES["t05_concept_ratio"](spark, data).collect()} == set(docs)


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def question_pairs(norms):
    """Pairs (i, j), i before j by key, of one family by words or by the sequence ratio."""
    out, stop = set(), set(X.GROUPING_STOPWORDS)
    tokens = [{w for w in n.split() if len(w) > 2 and w not in stop} for n in norms]
    for i, a in enumerate(norms):
        for j in range(i + 1, len(norms)):
            b, like = norms[j], likeness(tokens[i], tokens[j])
            gap, family = abs(len(a) - len(b)), min(len(tokens[i]), len(tokens[j])) >= 4 and len(tokens[i] & tokens[j]) >= 3 and like >= 0.8
            ratio = gap <= max(40, 0.45 * max(len(a), len(b), 1)) and not (like < 0.25 and gap > 12) and difflib.SequenceMatcher(None, a, b).ratio() >= 0.9
            if family or ratio:
                out.add((i, j))
    return out


def key(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_question_families_of_all_runs_by_words_and_by_sequence(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(sequences, "TEXT_BLOCK", 7)  # several blocks of one length
    base = [r[0] for r in table(spark, data, "predictions").filter("source_question is not null").select("source_question").distinct().orderBy("source_question").limit(50).collect()]
    damaged = [re.sub(r"([a-z]{2})([a-z])([a-z]{3,})", r"\1\2\2\3", q, count=7) for q in base[:12]]  # seven words of each
    short = ["Why?", "why", "Name the fungi", "Name the fungus", "", "?", "12 apples", "12 apple", "x" * 300, "x" * 290 + "y" * 10]
    rows = [(q, f"run-{k % 3}") for k, q in enumerate(dict.fromkeys([*base, *damaged, *short]))]
    spark.createDataFrame(rows, "source_question string, run_id string").write.parquet(f"{tmp_path}/predictions.parquet")
    norm = {q: " ".join(words(q)) for q, _ in rows}
    norms = sorted(set(norm.values()), key=key)
    want = question_pairs(norms)
    got = {(r["a"], r["b"]) for r in catalog.QUERIES["j07_question_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(key(norms[i]), key(norms[j])) for i, j in want}
    tokens = [{w for w in n.split() if len(w) > 2} for n in norms]
    assert any(likeness(tokens[i], tokens[j]) < 0.8 for i, j in want)  # by the ratio alone
    root = list(range(len(norms)))
    for i, j in want:
        root = [root[i] if x == root[j] else x for x in root]
    families: dict = {}
    for q, n in norm.items():
        families.setdefault(root[norms.index(n)], set()).add(key(q))
    found: dict = {}
    for r in catalog.QUERIES["j07_question_families"](spark, str(tmp_path)).collect():
        found.setdefault(r["family"], set()).add(r["question"])
    assert found == {min(x): x for x in families.values()}


def test_the_ratio_is_computed_once_and_behind_the_filters(spark, data):
    plan = catalog.QUERIES["j07_question_pairs"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "array_intersect" in plan.split("ArrowEvalPython")[1]


def test_heads_and_tails_rule_out_no_pair_that_reaches_the_ratio():
    import random

    import numpy as np

    rng, letters = random.Random(5), "abcdefgh 12"
    texts = []
    for n in (40, 90, 165, 310):
        for _ in range(12):
            t = [rng.choice(letters) for _ in range(n + rng.randint(0, 9))]
            texts.append("".join(t))
            for share in (0.02, 0.05, 0.1):  # at one place or all over
                u = list(t)
                k = rng.randrange(len(u))
                del u[k : k + int(share * n)]
                texts.append("".join(u))
                texts.append("".join(c if rng.random() > share else c + rng.choice(letters) for c in t))
    codes, size = sequences._codes(texts)
    for own in (np.flatnonzero((size > lo) & (size < hi)) for lo, hi in ((30, 60), (70, 110), (130, 200), (250, 400))):
        a, b = (x.ravel() for x in np.meshgrid(own, own))
        a, b = a[a < b], b[a < b]
        may = sequences._may_reach(codes, size, a, b, 0.9)
        lcs = np.array([sequences.lcs_length(list(texts[i]), list(texts[j])) for i, j in zip(a, b)])
        assert (sequences._lcs_of_pairs(codes, codes, a, b) == lcs).all()
        assert may[2 * lcs >= 0.9 * (size[a] + size[b])].all()
        assert not may.all() or size[own].min() < 60


def test_missing_neighbours_leave_few_pairs_and_lose_none_that_reaches_the_ratio(monkeypatch):
    import random

    import numpy as np

    rng, letters = random.Random(7), "abcdefghijklmnopqrstuvwxyz 0123456789"
    slots = [["".join(rng.choices(letters[:26], k=rng.randint(5, 12))) for _ in range(20)] for _ in range(10)]
    form = "show how a {} {} could be run with the {} {} of a {} {} next to a {} {} and one {} {}"
    texts = {form.format(*(rng.choice(s) for s in slots)) for _ in range(110)}
    texts |= {"x", "12 apples", "12 apple", "x" * 300, "x" * 290 + "y" * 10, "y " * 150 + "z", "z" + " y" * 150, *("".join(rng.choices(letters[:5], k=n)) for n in (2, 3, 20, 22))}
    for t in sorted(texts):
        for share in (0.02, 0.05, 0.08):  # at one place, all over, from head to tail
            k, n = rng.randrange(len(t)), max(1, int(share * len(t)))
            texts |= {t[:k] + t[k + n :], "".join(c if rng.random() > share else rng.choice(letters) + c for c in t), t[n:] + " " + t[:n]}
    texts = sorted({" ".join(t.split()) for t in texts} - {""})
    codes, size = sequences._codes(texts)
    order = np.argsort(size, kind="stable")
    a, b = np.triu_indices(len(texts), 1)
    like = np.abs(size[a] - size[b]) <= 0.1 * (size[a] + size[b])
    a, b = a[like], b[like]
    near = np.concatenate([2 * sequences._lcs_of_pairs(codes, codes, p, q) >= 0.9 * (size[p] + size[q]) - 1e-9 for p, q in zip(np.array_split(a, 200), np.array_split(b, 200))])
    want = set(zip(a[near].tolist(), b[near].tolist()))
    assert len(want) > 600
    for chunk, table in ((4096, 1 << 24), (700, 1)):
        monkeypatch.setattr(sequences, "CHUNK", chunk)
        monkeypatch.setattr(sequences, "TABLE", table)
        got = [(p, q) for u, v in sequences._few_missing(codes, size, order, order, 0.9) for p, q in zip(u.tolist(), v.tolist())]
        found = {(min(x), max(x)) for x in got}
        assert len(found) == len(got) and want <= found
        assert len(found - want) < 0.01 * len(a)
        even, odd = order[order % 2 == 0], order[order % 2 == 1]
        across = {(p, q) for u, v in sequences._few_missing(codes, size, even, odd, 0.9) for p, q in zip(u.tolist(), v.tolist())}
        assert {(p, q) if p % 2 == 0 else (q, p) for p, q in want if p % 2 != q % 2} <= across


def test_families_by_words_of_short_and_of_long_sets(spark, tmp_path):
    import random

    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("bcdfghjklm", k=6)) for _ in range(70)]
    questions = set()
    for n in (4, 5, 9, 15, 26, 32, 33, 36, 40, 41, 45, 50):  # keys change from two words to one between 32 and 41
        for _ in range(3):
            base = rng.sample(vocabulary, n)
            for part in range(5):
                rest = [w for w in vocabulary if w not in base]
                gone, new = rng.randint(0, n // 9), rng.randint(0, n // 9 + 1)
                own = base[gone:] + rng.sample(rest, new)
                questions.add(" ".join(rng.sample(own, len(own))))
    spark.createDataFrame([(q,) for q in sorted(questions)], "source_question string").write.parquet(f"{tmp_path}/predictions.parquet")
    norms = sorted(questions, key=key)
    want = {(key(norms[i]), key(norms[j])) for i, j in question_pairs(norms)}
    sizes = {key(n): len(n.split()) for n in norms}
    assert any(sizes[a] <= 32 for a, _ in want) and any(min(sizes[a], sizes[b]) <= 40 < max(sizes[a], sizes[b]) for a, b in want)
    assert {(r["a"], r["b"]) for r in catalog.QUERIES["j07_question_pairs"](spark, str(tmp_path)).collect()} == want
