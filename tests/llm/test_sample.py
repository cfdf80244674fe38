"""Quota sample: flow, floors, shortfalls, and the pN queries' SQL."""

import glob
import itertools
import os
import random

import duckdb
import pytest
from compare import differences

from spindrift.llm import quota_sample as Q
from spindrift.llm.queries import ORACLES, QUERIES


def test_quotas_meet_targets_and_show_shortfalls():
    cells = [(1, "a", "x", "y", 100, 5, 20), (2, "a", "x", "z", 5, 2, 12), (3, "b", "", "", 50, 18, 18), (4, "b", "", "q", 0, 3, 3)]
    got = Q.plan_quotas(cells, 60)
    assert {m: lack for m, (_, lack) in got.items()} == {1: 0, 2: 7, 3: 0, 4: 3}
    assert got[2][0] == 5 and got[4][0] == 0 and sum(q for q, _ in got.values()) == 60
    assert got[1][0] >= 20 and got[3][0] >= 18
    assert Q.plan_quotas([], 10) == {}
    assert Q.plan_quotas([(1, "a", "", "", 3, 0, 10)], 100) == {1: (3, 7)}


def test_floors_go_first_where_the_total_is_small():
    cells = [(1, "a", "x", "y", 50, 2, 40), (2, "a", "x", "z", 50, 12, 12), (3, "a", "w", "y", 3, 5, 5)]
    got = Q.plan_quotas(cells, 20)
    assert got == {1: (5, 0), 2: (12, 0), 3: (3, 2)}
    assert sum(q for q, _ in Q.plan_quotas(cells, 4).values()) == 17  # all floors


def cost_of(cells, quota, margin=Q.MARGIN):
    """Least cost of a quota, from the definition of the costs."""
    total, rows, cols = 0, {}, {}
    for (_, t, a, b, _, floor, want), q in zip(cells, quota):
        over, size, n = max(0, q - want), max(1, want // 20), 0
        total += Q.TARGET * max(0, min(q, want) - min(floor, want))
        while over > 0:
            take = min(over, size) if n < 39 else over
            total += take * (Q.OVER + Q.STEP * n)
            over, n = over - take, n + 1
        for side, level in ((rows, a), (cols, b)):
            side.setdefault((t, level), [0, 0])
            side[t, level][0] += q
            side[t, level][1] += want
    return total + margin * sum(max(0, q - want) for side in (rows, cols) for q, want in side.values())


def test_flow_against_brute_force():
    rng, bound = random.Random(4), 0
    for _ in range(240):
        cells = [(2 * i + j, "t", "ab"[i], "xy"[j], rng.randint(0, 7), rng.randint(0, 2), rng.randint(0, 5)) for i in (0, 1) for j in (0, 1)]
        cells = [(*c[:6], max(c[5], c[6])) for c in cells]
        total = rng.randint(0, 18)
        got = Q.plan_quotas(cells, total)
        for c in cells:
            assert got[c[0]][1] == max(0, c[6] - c[4]) and got[c[0]][0] <= c[4]
        quota = [got[c[0]][0] for c in cells]
        size = max(min(total, sum(c[4] for c in cells)), sum(min(c[4], c[5]) for c in cells))
        ways = [w for w in itertools.product(*(range(c[4] + 1) for c in cells)) if sum(w) == size]
        assert sum(quota) == size and cost_of(cells, quota) == min(cost_of(cells, w) for w in ways)
        free = min(ways, key=lambda w: cost_of(cells, w, 0))
        bound += cost_of(cells, free) > cost_of(cells, quota)
    assert bound > 1  # cases in which the margins decide


def test_draw_is_exact_and_repeatable(spark):
    rows = spark.createDataFrame([(f"{k}", k % 3 or None) for k in range(900)], "id string, mix_id int")
    plan = [(1, 300, 120, 120, 0), (2, 300, 7, 7, 0)]
    a = sorted(map(tuple, Q.draw(rows, plan).collect()))
    assert a == sorted(map(tuple, Q.draw(rows.repartition(7), plan).collect()))
    assert sum(m == 1 for _, m in a) == 120 and sum(m == 2 for _, m in a) == 7 and len({i for i, _ in a}) == 127


def test_cells_compare_levels_loosely(spark):
    recs = [("1", "bloom_rewrite", " REMEMBER ", "apply"), ("1", "bloom_rewrite", " REMEMBER ", "apply"), ("2", "bloom_rewrite", None, "Apply"), ("3", "qa", None, None), ("4", "other", "x", "y"), (None, "qa", None, None)]
    mix = spark.createDataFrame([(1, "bloom_rewrite", "Remember", "Apply", 0.5, 1), (2, "qa", "none", "none", 0.5, 1)], "mix_id int, task string, source_level string, target_level string, share double, min_rows int")
    df = spark.createDataFrame(recs, "id string, task string, source_level string, target_level string")
    assert {r["id"]: r["mix_id"] for r in Q.cell_rows(df, mix).collect()} == {"1": 1, "2": None, "3": 2, "4": None}
    assert Q.cell_rows(df.limit(0), mix).count() == 0


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, data, name):
    columns, ours, theirs, _ = differences(spark, con, QUERIES[name], ORACLES[name], data)
    assert columns and not ours and not theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0
