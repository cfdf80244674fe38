"""Label models, and defects of pairs on labelled fixtures: every defect's cutoff is the one that the fixture validates."""

import numpy as np
import pytest

from spindrift.llm import defective_pairs as D
from spindrift.llm.label_model import CorrelatedLabelModel, LabelModel


def test_label_model_finds_reliable_voters():
    import numpy as np

    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.1
    votes = np.stack([np.where(rng.random(4000) < a, y, ~y) for a in (0.99, 0.9, 0.85)], 1).astype(int)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    m = LabelModel([(0.8, 0.1)] * 3, prior=0.2).fit(patterns, n.astype(float))
    p = {tuple(v): q for v, q in zip(patterns, m.predict(patterns))}
    assert np.mean([(p[tuple(v)] > 0.5) == t for v, t in zip(votes, y)]) > 0.97
    assert abs(m.prior - 0.1) < 0.04


def test_one_reliable_voter_of_alternative_causes_carries_a_case():
    m = D.defect_model("truncated")
    names = list(D.VOTERS["truncated"])
    alone = np.eye(len(names), dtype=int)
    V = np.vstack([alone, alone[0] + alone[1], alone[0] * 0])
    n = np.array([100, 80, 20, 60, 5, 10, 9725], float)
    for scale in (1, 1000):
        p = D.defect_model("truncated").fit(V, n * scale).predict(V)
        assert (p[:5] > D.CUTOFFS["truncated"]).all() and p[5] > p[:2].max() and p[6] < 0.05
    one = LabelModel(list(D.VOTERS["truncated"].values())).fit(V, n).predict(V)
    assert one[1] < 0.5  # where silence is a no, the voters that fire most veto the others
    assert m.prior == pytest.approx(0.05)


def test_a_fit_without_cases_stays_at_its_prior():
    m = D.defect_model("refusal").fit(np.zeros((1, 4), int), np.array([1000.0]))
    assert m.prior < 0.05 and m.predict(np.zeros((1, 4), int))[0] < 0.05
    assert len(D.defect_model("refusal").predict(np.zeros((0, 4), int))) == 0


def test_correlated_voters_count_as_one():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.2
    a = np.where(rng.random(20_000) < 0.85, y, ~y)
    b = np.where(rng.random(20_000) < 0.98, a, ~a)  # all but a copy of the first
    c = np.where(rng.random(20_000) < 0.85, y, ~y)
    V, n = np.unique(np.stack([a, b, c], 1).astype(int), axis=0, return_counts=True)
    hint = [(0.8, 0.2)] * 3
    m = CorrelatedLabelModel(hint, prior=0.2).fit(V, n.astype(float))
    assert (0, 1) in m.pairs() and len(m.pairs()) == 1
    p = dict(zip(map(tuple, V), m.predict(V)))
    q = dict(zip(map(tuple, V), LabelModel(hint, prior=0.2).fit(V, n.astype(float)).predict(V)))
    assert p[1, 1, 0] < q[1, 1, 0]  # two voices of one mind are not two witnesses
    assert p[1, 1, 1] > 0.5 > p[0, 0, 0]


Q = "What is the alpine meadow called when a paged directory appears beside the rationed workshop?"
ES = "¿Cómo se explica que el mercado rural no funcione sin la red pública del pueblo?"
DE = "Wie beeinflusst die alte Karte die Grenze, wenn sie nicht an der Wand hängt?"
FR = "Comment la prairie alpine change-t-elle le réseau public du village dans la vallée ?"
#: (question, prediction, defects)
LABELLED = [
    (Q, "Which paged directory belongs to the alpine meadow and the rationed workshop?", ""), (Q, "the alpine meadow", ""), (Q, "Meadow.", ""), (None, "A sound summary of the paper is here.", ""),
    (Q, "Sure! Here is the rewritten question: Which meadow is near the rationed workshop?", ""), (Q, "The directory can not be seen, yet the workshop opens.", ""), (Q, "The alpine meadow and the rationed workshop are near the meadow", ""),
    (ES, "El mercado rural no funciona porque la red pública del pueblo está cerrada.", ""), (DE, "Die alte Karte zeigt die Grenze auch dann, wenn sie nicht an der Wand hängt.", ""), (FR, "La prairie alpine change le réseau public du village par ses chemins.", ""),
    (Q, "Explain what the alpine meadow is called when a paged directory appears beside a rationed workshop.", ""), (Q, "No, the meadow is not near.", ""), (Q, "42", ""), (Q, "None of the meadows is near the workshop.", ""),
    (Q, " \n", "empty"), (Q, None, "empty"), (Q, "N/A", "empty"), (Q, "-", "empty"), (Q, "null", "empty"), (Q, "[no output]", "empty"), (Q, "...", "empty"), (ES, "None", "empty"), (None, "", "empty"),
    (Q, "I'm unable to comply.", "refusal"), (Q, "I'm sorry, but I can't help with that request.", "refusal"), (Q, "As an AI language model, I cannot answer this question.", "refusal"), (Q, "Unfortunately, I am not able to provide an answer here.", "refusal"),
    (Q, "Sorry, I cannot assist with this.", "refusal"), (Q, "I must decline to answer this one.", "refusal"),
    (Q, 'Question: "' + Q.upper() + '"', "copied_question"), (Q, Q, "copied_question"), (Q, Q + " " + Q, "copied_question"), (Q, Q.rstrip("?"), "copied_question"), (ES, "Pregunta: " + ES, "copied_question"), (DE, DE.lower(), "copied_question"),
    (Q, "Quelles sont les conséquences de la prairie pour le marché rural et le réseau public ?", "other_language"), (Q, "Die alte Karte zeigt die Grenze auch dann, wenn sie nicht an der Wand hängt.", "other_language"),
    (ES, "The rural market is closed because the public network of the village does not work.", "other_language"), (FR, "El mercado rural no funciona porque la red pública del pueblo está cerrada.", "other_language"), (Q, "阿尔卑斯山的草地靠近作坊,因此目录是分页的。", "other_language"),
    (Q, "Which paged directory belongs to the alpine mead", "truncated"), (Q, "Which paged directory belongs to the alpine meadow and the", "truncated"), (Q, "Which paged directory belongs to the alpine meadow,", "truncated"), (Q, "Which paged directory belongs to the rationed works", "truncated"),
    (Q, "The alpine meadow number five and the rationed workshop are near th", "truncated"), (Q, "The paged directory of the alpine", "truncated"),
]


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(f"x{k:02d}", q, p, None, None) for k, (q, p, _) in enumerate(LABELLED)]
    rows += rows[:3]  # second deliveries
    rows += [(f"fill{k}", Q, f"The alpine meadow number {k} and the rationed workshop of a paged directory are near the meadow. A directory is in the alpine workshop.", k % 9 == 0, k % 30 == 0) for k in range(1500)]
    df = spark.createDataFrame(rows, "id string, question string, prediction string, flag_meta boolean, flag_empty boolean")
    return D.posteriors(df).collect(), {f"x{k:02d}": {d} - {""} for k, (_, _, d) in enumerate(LABELLED)}


def test_cutoffs_are_the_validated_ones(labelled):
    rows, truth = labelled
    assert len(rows) == len(LABELLED) + 1500
    got = D.validated_cutoffs(rows, truth)
    wrong = [(LABELLED[int(r["id"][1:])][1], {d: round(r[d], 3) for d in D.DEFECTS if r[d] > 0.01}) for r in rows if r["id"] in truth and {d for d in D.DEFECTS if r[d] > D.CUTOFFS[d]} != truth[r["id"]]]
    assert not wrong
    assert {d: c for d, (c, _, _) in got.items()} == D.CUTOFFS
    assert all(p == 1 and r == 1 for _, p, r in got.values())


def test_rows_without_a_defect_have_none(labelled):
    assert not [r["id"] for r in labelled[0] if r["id"].startswith("fill") and any(r[d] > D.CUTOFFS[d] for d in D.DEFECTS)]


def test_empty_table(spark):
    assert D.posteriors(spark.createDataFrame([], "id string, question string, prediction string, flag_meta boolean, flag_empty boolean")).count() == 0
