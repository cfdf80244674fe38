"""Splits, partitions, caps and samples by hash order; a rank in a large group comes from counts by slot, not from one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOTS = 256


def hash_rank(df: DataFrame, by: list[str], order: Column, tie: str, name: str = "rank") -> DataFrame:
    """Adds the 1-based rank in hex hash order within ``by``.

    The first two hex digits split each group into slots; ranks are counted within a slot and
    shifted by the counts of the slots before, so a group with a third of all rows is spread out.
    """
    x = df.withColumn("_h", order).withColumn("_slot", F.substring("_h", 1, 2))
    n = x.groupBy(*by, "_slot").agg(F.count("*").alias("_n"))
    before = n.select(*by, "_slot", (F.sum("_n").over(W.partitionBy(*by).orderBy("_slot")) - F.col("_n")).alias("_before"))
    r = x.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_slot").orderBy("_h", tie)))
    on = [r["_slot"] == before["_slot"], *[r[c].eqNullSafe(before[c]) for c in by]]
    cols = [r[c] for c in df.columns]
    return r.join(before, on).select(*cols, (F.col("_r") + F.col("_before")).alias(name))


def group_sizes(df: DataFrame, by: list[str], name: str = "size") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(name))


def stratified_split(df: DataFrame, key: str, stratum: str, train: float, validation: float) -> DataFrame:
    """(key, stratum, split): per stratum in hash order, round(train * n) rows and round(validation * n) rows, the rest is test."""
    r = hash_rank(df.select(key, stratum), [stratum], F.md5(F.col(key).cast("string")), key)
    r = r.join(F.broadcast(group_sizes(df, [stratum], "n")), stratum)  # one row per stratum
    a, b = F.bround(train * F.col("n")), F.bround(train * F.col("n")) + F.bround(validation * F.col("n"))
    return r.select(key, stratum, F.when(F.col("rank") <= a, "train").when(F.col("rank") <= b, "validation").otherwise("test").alias("split"))


def capped(df: DataFrame, key: str, by: str, most: int) -> DataFrame:
    return hash_rank(df, [by], F.md5(F.col(key).cast("string")), key).filter(F.col("rank") <= most).drop("rank")


def dealt(df: DataFrame, key: str, by: str, hands: int) -> DataFrame:
    """Adds ``hand``: rows of each group dealt round robin in hash order."""
    return hash_rank(df, [by], F.md5(F.col(key).cast("string")), key).withColumn("hand", (F.col("rank") - 1) % hands).drop("rank")


def largest_remainder(weights: list[float], total: int) -> list[int]:
    """Integer quotas that add up to ``total``: floors first, then the largest remainders."""
    whole = sum(weights) or 1.0
    exact = [w / whole * total for w in weights]
    out = [int(x) for x in exact]
    for k in sorted(range(len(out)), key=lambda k: (out[k] - exact[k], k))[: total - sum(out)]:
        out[k] += 1
    return out


def dirichlet_clients(df: DataFrame, key: str, label: str, clients: int, alpha: float, seed: int = 7) -> DataFrame:
    """(key, label, client): per label, client shares drawn from a Dirichlet; quotas by largest remainder over the hash order.

    The labels and their counts, a small table, decide the quotas on the driver.
    """
    import numpy as np

    counts = sorted((r[label], r["n"]) for r in group_sizes(df, [label], "n").collect())
    rng, rows = np.random.default_rng(seed), []
    for lab, n in counts:
        at = 0
        for c, q in enumerate(largest_remainder(list(rng.dirichlet([alpha] * clients)), n)):
            rows.append((lab, c, at, at + q))
            at += q
    kind = dict(df.dtypes)[label]
    quota = df.sparkSession.createDataFrame(rows, f"l {kind}, client int, a long, b long")
    r = hash_rank(df.select(key, label), [label], F.md5(F.col(key).cast("string")), key)
    return r.join(F.broadcast(quota), (F.col(label) == F.col("l")) & (F.col("rank") > F.col("a")) & (F.col("rank") <= F.col("b"))).select(key, label, "client")  # labels x clients rows
