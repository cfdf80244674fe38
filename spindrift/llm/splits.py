"""Problem 1: train, validation and test splits that keep related records together.

Records that share a source, or whose questions are alike, form components. Components are
combined into many nearly equal bins by largest differencing, and whole bins go to splits by
target proportion. Only the histogram of component sizes (at most sqrt(2n) rows for n records)
comes to the driver; which component goes into which bin is decided where the rows are.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.llm.sets import components, set_id, similar_sets, token_hashes
from spindrift.runtime import cut, table

BINS = 60


def largest_differencing(weights: list[int], bins: int) -> list[int]:
    """Bin of each weight: the two partial assignments of widest spread are joined, heavy bins with light ones.

    Each heap entry is a vector of bin loads, largest first, with the items in each. Equal weights
    start out side by side in one vector, so there is one vector per weight and ``bins`` items of it.
    """
    if not weights:
        return []
    heap, by_weight = [], {}
    for i, w in enumerate(weights):
        by_weight.setdefault(w, []).append(i)
    for w, items in by_weight.items():
        for a in range(0, len(items), bins):
            own = items[a : a + bins]
            heap.append((-w if len(own) < bins else 0, own[0], [(w, [i]) for i in own] + [(0, [])] * (bins - len(own))))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda t: -t[0])
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], i, joined))
    out = [0] * len(weights)
    for k, (_, items) in enumerate(heap[0][2]):
        for i in items:
            out[i] = k
    return out


def plan_bins(histogram: list[tuple[int, int]], bins: int) -> tuple[list[tuple[int, int, int]], list[int]]:
    """(size, first rank, bin) runs for a size histogram, and the bins' loads.

    Equal sizes cancel: every bin takes count // bins components of a size; the fewer than ``bins``
    left of each size go through largest differencing.
    """
    rest, loads, runs = [], [0] * bins, []
    for size, count in sorted(histogram, reverse=True):
        for k in range(count % bins):
            rest.append((size, k))
        for k in range(bins):
            loads[k] += size * (count // bins)
    for (size, k), b in zip(rest, largest_differencing([s for s, _ in rest], bins)):
        runs.append((size, k, b))
        loads[b] += size
    return runs, loads


def allot_bins(loads: list[int], shares: list[tuple[str, float]]) -> list[str]:
    """Split of each bin: heaviest bin first, each to the split that lacks most of its target."""
    total, names = sum(loads), sorted(shares, key=lambda s: (-s[1], s[0]))
    scale = sum(s for _, s in shares) or 1
    lack = {n: total * s / scale for n, s in names}
    out = [""] * len(loads)
    for b in sorted(range(len(loads)), key=lambda b: (-loads[b], b)):
        best = max(names, key=lambda n: lack[n[0]])[0]
        out[b], lack[best] = best, lack[best] - loads[b]
    return out


def linked_groups(records: DataFrame, likeness: float) -> DataFrame:
    """(id, group_id) for every distinct id of records (id, source, question).

    Ids of one source, or of questions whose word sets are alike by ``likeness`` or more, also
    through others, share a group; group_id is its smallest id. An id with several sources or
    questions joins their groups. A null source or a question without words links nothing;
    repeated rows count once; an empty table gives no row.
    """
    r = records.filter(F.col("id").isNotNull()).select(
        "id",
        F.when(F.col("source").isNotNull(), F.xxhash64(F.lit("s"), "source")).alias("s"),
        "question",
    )
    pairs = r.groupBy("s", "question").agg(F.count("*").alias("n")).withColumn("toks", token_hashes(F.col("question")))
    pairs = cut(pairs.select("s", "question", F.when(F.size("toks") > 0, F.col("toks")).alias("toks")).withColumn("q", F.when(F.col("toks").isNotNull(), set_id(F.col("toks")))))
    sets = cut(pairs.filter("q is not null").select(F.col("q").alias("sid"), "toks").dropDuplicates(["sid"]))
    like = similar_sets(sets, likeness).select(F.col("a").alias("u"), F.col("b").alias("v"))
    own = pairs.filter("s is not null and q is not null").select(F.col("s").alias("u"), F.col("q").alias("v"))
    null = F.lit(0)
    node = pairs.select("s", "question", F.coalesce("s", "q").alias("node"))
    left = cut(r.select("id", F.coalesce("s", null).alias("s"), F.coalesce(F.xxhash64("question"), null).alias("k")).distinct())
    # An id is a node of its own where it comes with more than one source or question.
    several = left.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    held = left.join(several, "id").join(node.select(F.coalesce("s", null).alias("s"), F.coalesce(F.xxhash64("question"), null).alias("k"), "node").distinct(), ["s", "k"])
    bound = held.filter("node is not null").select(F.xxhash64(F.lit("id"), "id").alias("u"), F.col("node").alias("v"))
    roots = components(like.union(own).union(bound).distinct())
    named = node.join(roots, "node", "left").select("s", "question", F.coalesce("root", "node").alias("root"))
    right = named.select(F.coalesce("s", null).alias("s"), F.coalesce(F.xxhash64("question"), null).alias("k"), "root").distinct()
    placed = left.join(right, ["s", "k"], "left").groupBy("id").agg(F.min("root").alias("root"))
    placed = cut(placed.withColumn("root", F.coalesce("root", F.xxhash64(F.lit("i"), "id"))))
    first = placed.groupBy("root").agg(F.min("id").alias("group_id"), F.count("*").alias("size"))
    return placed.join(first, "root").select("id", "group_id", "size")


def assign_splits(groups: DataFrame, shares: DataFrame, bins: int = BINS) -> DataFrame:
    """(id, group_id, split) of groups (id, group_id, size) by shares (split, share)."""
    spark = groups.sparkSession
    comp = groups.filter("id = group_id").select("group_id", "size")
    histogram = [(r["size"], r["n"]) for r in comp.groupBy("size").agg(F.count("*").alias("n")).collect()]
    runs, loads = plan_bins(histogram, bins)
    split = allot_bins(loads, [(r["split"], r["share"]) for r in shares.dropDuplicates(["split"]).collect()])
    counts = dict(histogram)
    plan = spark.createDataFrame([(s, k, split[b]) for s, k, b in runs], "size long, rank long, split string")
    by_bin = F.element_at(F.array(*[F.lit(s) for s in split]), (F.col("rank") % bins + 1).cast("int"))
    # A rank within a size without one task for all components of that size: count by slot first, then offset.
    slot = F.pmod(F.xxhash64("group_id"), F.lit(max(256, sum(counts.values()) // 100_000)))
    slots = comp.groupBy("size", slot.alias("slot")).agg(F.count("*").alias("n"))
    before = slots.select("size", "slot", (F.sum("n").over(W.partitionBy("size").orderBy("slot")) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy("size", "slot").orderBy("group_id")) - 1
    ranked = comp.withColumn("slot", slot).withColumn("rank", rank).join(before, ["size", "slot"]).select("group_id", "size", (F.col("rank") + F.col("before")).alias("rank"))
    even = spark.createDataFrame([(s, n // bins * bins) for s, n in counts.items()], "size long, even long")
    ranked = ranked.join(even, "size").withColumn("left", F.col("rank") - F.col("even"))
    placed = ranked.join(plan.withColumnRenamed("rank", "left").withColumnRenamed("split", "own"), ["size", "left"], "left")
    splits = placed.select("group_id", F.coalesce("own", by_bin).alias("split"))
    return groups.select("id", "group_id").join(splits, "group_id").select("id", "group_id", "split")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "predictions").select("id", F.col("source_id").alias("source"), F.col("source_question").alias("question"))
    likeness = table(spark, sf_dir, "grouping_thresholds").agg(F.max("family_jaccard")).first()[0]
    return linked_groups(p, likeness)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, group_id) of every prediction that is linked with another id."""
    return _groups(spark, sf_dir).filter("size > 1").select("id", "group_id")


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, group_id, split) of every prediction; a group never parts."""
    return assign_splits(cut(_groups(spark, sf_dir)), table(spark, sf_dir, "split_shares"))
