"""Problem 5: a sample that matches target category proportions, by min-cost flow on cell counts."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.runtime import cut, table

FRACTION = 5
#: Costs of a unit: within a cell's target beyond its floor, beyond the target (and STEP more for every twentieth of it), beyond
#: a margin of task and level, and on a slack arc. Floors are free, so they are filled first.
TARGET, OVER, STEP, MARGIN, SLACK = 1_000, 100_000, 50, 10_000, 10_000_000
_SLOTS = 256


class Flow:
    """Successive shortest paths with potentials on a small integer network."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to, self.cap, self.cost = [], [], []

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def used(self, k: int) -> int:
        return self.cap[k ^ 1]

    def run(self, s: int, t: int, want: int) -> int:
        """Send up to ``want`` units at least cost; costs are non-negative at the start."""
        sent, high = 0, [0] * len(self.arcs)
        while sent < want:
            dist, via = [math.inf] * len(self.arcs), [-1] * len(self.arcs)
            dist[s], heap = 0, [(0, s)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > dist[x]:
                    continue
                for k in self.arcs[x]:
                    if self.cap[k] and d + (w := self.cost[k] + high[x] - high[self.to[k]]) < dist[self.to[k]]:
                        dist[self.to[k]], via[self.to[k]] = d + w, k
                        heapq.heappush(heap, (d + w, self.to[k]))
            if math.isinf(dist[t]):
                break
            high = [h + d if not math.isinf(d) else h for h, d in zip(high, dist)]
            step, x = want - sent, t
            while x != s:
                step, x = min(step, self.cap[via[x]]), self.to[via[x] ^ 1]
            x = t
            while x != s:
                self.cap[via[x]] -= step
                self.cap[via[x] ^ 1] += step
                x = self.to[via[x] ^ 1]
            sent += step
        return sent


Cell = tuple[int, str, str, str, int, int, int]  # mix_id, task, source level, target level, available, floor, needed


def _network(cells: list[Cell], slack: bool) -> tuple[Flow, dict[int, int], dict[int, int]]:
    """The flow network, and each cell's availability and slack arcs.

    Source -> rows (task, source level) -> cells -> columns (task, target level) -> sink. Arcs of
    rows and columns carry the margins, the sums of what their cells need, and beyond them a cost.
    Arcs into a cell carry its floor, its target and, ever dearer, more; the arc out of it carries
    what is available, and with ``slack`` another one takes what isn't.
    """
    rows, cols = sorted({(c[1], c[2]) for c in cells}), sorted({(c[1], c[3]) for c in cells})
    at = {("r", *x): 2 + k for k, x in enumerate(rows)} | {("c", *x): 2 + len(rows) + k for k, x in enumerate(cols)}
    flow, own, miss = Flow(2 + len(rows) + len(cols) + 2 * len(cells)), {}, {}
    every = sum(c[4] + c[6] for c in cells)
    for r in rows:
        flow.arc(0, at["r", *r], sum(c[6] for c in cells if (c[1], c[2]) == r), 0)
        flow.arc(0, at["r", *r], every, MARGIN)
    for c in cols:
        flow.arc(at["c", *c], 1, sum(x[6] for x in cells if (x[1], x[3]) == c), 0)
        flow.arc(at["c", *c], 1, every, MARGIN)
    for k, (m, task, a, b, have, floor, want) in enumerate(cells):
        into, out = 2 + len(rows) + len(cols) + 2 * k, 3 + len(rows) + len(cols) + 2 * k
        flow.arc(at["r", task, a], into, min(floor, want), 0)
        flow.arc(at["r", task, a], into, want - min(floor, want), TARGET)
        left, size = max(0, have - want), max(1, want // 20)
        for n in range(40):
            take = min(left, size) if n < 39 else left
            if take > 0 and not slack:
                flow.arc(at["r", task, a], into, take, OVER + STEP * n)
                left -= take
        own[m] = flow.arc(into, out, have, 0)
        if slack:
            miss[m] = flow.arc(into, out, want, SLACK)
        flow.arc(out, at["c", task, b], have + want, 0)
    return flow, own, miss


def plan_quotas(cells: list[Cell], total: int) -> dict[int, tuple[int, int]]:
    """mix_id -> (quota, shortfall) for a sample of ``total``.

    Shortfalls: all needs are sent through the network, and what flows over a cell's slack arc
    can't be met. Quotas: ``total`` units, or as many as all available floors take if that is
    more, at least cost; where targets do not fit into the total, floors go first, and what short
    cells leave over goes to cells whose margins have room before it exceeds one.
    """
    flow, _, miss = _network(cells, slack=True)
    flow.run(0, 1, sum(c[6] for c in cells))
    short = {m: flow.used(k) for m, k in miss.items()}
    flow, own, _ = _network(cells, slack=False)
    flow.run(0, 1, max(min(total, sum(c[4] for c in cells)), sum(min(c[4], c[5]) for c in cells)))
    return {m: (flow.used(own[m]), short[m]) for m in own}


def cell_rows(records: DataFrame, mix: DataFrame) -> DataFrame:
    """(id, mix_id): the category of each distinct id; levels are compared without case and outer spaces; mix_id is null outside."""
    level = lambda c: F.coalesce(F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))), F.lit(""))
    named = F.col("task") == "bloom_rewrite"
    r = records.filter(F.col("id").isNotNull()).select(
        "id",
        F.col("task").alias("t"),
        F.when(named, level(F.col("source_level"))).otherwise("none").alias("a"),
        F.when(named, level(F.col("target_level"))).otherwise("none").alias("b"),
    )
    m = mix.select("mix_id", F.col("task").alias("t"), level(F.col("source_level")).alias("a"), level(F.col("target_level")).alias("b")).dropDuplicates(["t", "a", "b"])
    r = r.groupBy("id").agg(F.min(F.struct("t", "a", "b")).alias("c")).select("id", "c.*")
    return r.join(m, ["t", "a", "b"], "left").select("id", "mix_id")


def quotas(rows: DataFrame, mix: DataFrame, fraction: int = FRACTION) -> list[tuple]:
    """(mix_id, available, needed, quota, shortfall) of every category of ``mix``; its rows are a fixed table."""
    counts = {r["mix_id"]: r["n"] for r in rows.groupBy("mix_id").agg(F.count("*").alias("n")).collect()}
    size = sum(counts.values()) // fraction
    wanted = mix.select("mix_id", "task", "source_level", "target_level", "share", "min_rows").dropDuplicates(["mix_id"]).orderBy("mix_id").collect()
    cells = []
    for r in wanted:
        floor = r["min_rows"] or 0
        levels = [(r[c] or "").strip().lower() for c in ("source_level", "target_level")]
        cells.append((r["mix_id"], r["task"], *levels, counts.get(r["mix_id"], 0), floor, max(floor, math.floor((r["share"] or 0) * size + 0.5))))
    got = plan_quotas(cells, size)
    return [(c[0], c[4], c[6], *got[c[0]]) for c in cells]


def draw(rows: DataFrame, plan: list[tuple], seed: int = 5) -> DataFrame:
    """(id, mix_id) of exactly the quota of each category, at random by hash.

    The rank within a category is put together from counts by slot, so that no task holds a whole category.
    """
    spark = rows.sparkSession
    want = spark.createDataFrame([(p[0], int(p[3])) for p in plan], "mix_id int, quota long")
    at = F.xxhash64(F.lit(seed), "id")
    r = rows.filter("mix_id is not null").select("id", "mix_id", at.alias("h"), F.shiftright(at, 56).alias("slot"))
    slots = r.groupBy("mix_id", "slot").agg(F.count("*").alias("n"))
    before = slots.select("mix_id", "slot", (F.sum("n").over(W.partitionBy("mix_id").orderBy("slot")) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy("mix_id", "slot").orderBy("h", "id"))
    return r.withColumn("rank", rank).join(F.broadcast(before.join(want, "mix_id")), ["mix_id", "slot"]).filter("rank + before <= quota").select("id", "mix_id")  # mix cells x 256 slots


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "predictions").select("id", "task", F.col("source_bloom_level").alias("source_level"), F.col("target_bloom_level").alias("target_level"))
    mix = table(spark, sf_dir, "target_mix")
    return cell_rows(p, mix), mix


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mix_id) of every category whose slack arc carries flow: its target can't be met."""
    rows, mix = _rows(spark, sf_dir)
    return spark.createDataFrame([(p[0],) for p in quotas(rows, mix) if p[4] > 0], "mix_id int")


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, mix_id) of a sample of a fifth of the ids by the quotas."""
    rows, mix = _rows(spark, sf_dir)
    rows = cut(rows)
    return draw(rows, quotas(rows, mix))
