"""Aggregation of client updates: weighted means, clipping, masks, budgets and a small federated model."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.runtime import cut


def _positions(df: DataFrame) -> DataFrame:
    return df.select("client", F.posexplode("embedding").alias("pos", "v"))


def client_means(df: DataFrame) -> DataFrame:
    return _positions(df).groupBy("client", "pos").agg(F.avg(F.col("v").cast("double")).alias("a"))


def weighted_average(df: DataFrame) -> DataFrame:
    """(pos, value): client means weighted by the clients' rows."""
    n = df.groupBy("client").agg(F.count("*").alias("n"))
    m = client_means(df).join(F.broadcast(n), "client")  # one row per client
    return m.groupBy(F.col("pos").cast("long").alias("pos")).agg(F.round(F.sum(F.col("n") * F.col("a")) / F.sum("n"), 5).alias("value"))


def delta_norms(df: DataFrame, limit: float) -> DataFrame:
    """(client, norm, scale): norm of each client's mean against the mean of means, and the factor that clips it."""
    m = client_means(df)
    g = m.groupBy("pos").agg(F.avg("a").alias("g"))
    t = m.join(g, "pos").groupBy("client").agg(F.sqrt(F.sum(F.pow(F.col("a") - F.col("g"), 2))).alias("n"))
    return t.select("client", F.round("n", 5).alias("norm"), F.round(F.least(F.lit(1.0), limit / F.greatest("n", F.lit(1e-12))), 5).alias("scale"))


def epsilon(clients: DataFrame, batch: int, steps: int, sigma: float, delta: float) -> DataFrame:
    """(client, n, steps, epsilon, simple): least Renyi bound over orders 2 to 64, and the simple estimate."""
    q = F.least(F.lit(1.0), batch / F.col("n"))
    log = float(np.log(1 / delta))
    a = clients.withColumn("q", q).withColumn("al", F.explode(F.sequence(F.lit(2), F.lit(64))))
    e = steps * F.col("q") * F.col("q") * F.col("al") / (2 * sigma * sigma) + log / (F.col("al") - 1)
    simple = F.min("q") * float(np.sqrt(2 * steps * log)) / sigma
    return a.groupBy("client", "n").agg(F.ceil(F.ceil(F.first("n") / float(batch)) * 3).alias("steps"), F.round(F.min(e), 6).alias("epsilon"), F.round(simple, 6).alias("simple"))


def pair_mask(a, b, size: int) -> np.ndarray:
    """The mask that a pair of clients shares, from a hash of the sorted pair."""
    seed = hashlib.sha256("|".join(sorted((str(a), str(b)))).encode()).digest()
    return np.random.default_rng(int.from_bytes(seed[:8], "big")).normal(size=size)


def masked_totals(df: DataFrame) -> DataFrame:
    """(pos, total, cancels): sums of masked client sums, and whether the masks cancel within 1e-4. The client list is small."""
    clients = sorted(r[0] for r in df.select("client").distinct().collect())
    sums = _positions(df).groupBy("client", "pos").agg(F.sum(F.col("v").cast("double")).alias("v"))

    def mask(frames):
        for pdf in frames:
            pdf = pdf.copy()
            total = {}
            for c in pdf["client"].unique():
                total[c] = sum(((1 if c < o else -1) * pair_mask(c, o, 4096) for o in clients if o != c), np.zeros(4096))
            pdf["masked"] = [v + total[c][p] for c, p, v in zip(pdf["client"], pdf["pos"], pdf["v"])]
            yield pdf

    m = sums.mapInPandas(mask, "client long, pos int, v double, masked double")
    return m.groupBy(F.col("pos").cast("long").alias("pos")).agg(F.round(F.sum("v"), 4).alias("total"), (F.abs(F.sum("v") - F.sum("masked")) <= 1e-4).alias("cancels"))


def federated_logistic(docs: DataFrame, rounds: int, clients: int = 4, size: int = 2048, rate: float = 0.5, clip: float = 1.0, noise: float = 0.01) -> DataFrame:
    """(round, accuracy, loss). Every round each client takes a gradient over its rows, clipped and noised; the server averages by rows.

    Gradients are summed by mapInPandas, so a client's rows need not be in one task; only one vector per client and partition is sent.
    """
    from spindrift.operators.sequences import hashed_features

    spark = docs.sparkSession
    f = hashed_features(docs.select(F.col("doc_id").alias("id"), "text"), size).join(docs.select(F.col("doc_id").cast("string").alias("id"), "y"), "id")
    f = f.withColumn("client", F.pmod(F.xxhash64("id"), F.lit(clients))).select("client", "y", F.map_keys("features").alias("k"), F.map_values("features").alias("v")).cache()
    w, b, out = np.zeros(size), 0.0, []
    for r in range(rounds):

        def grad(frames, w=w, b=b):
            g = {}
            for pdf in frames:
                for c, y, k, v in zip(pdf["client"], pdf["y"], pdf["k"], pdf["v"]):
                    z = float(np.clip(w[k] @ v + b, -30, 30))
                    p = 1 / (1 + np.exp(-z))
                    a = g.setdefault(c, [np.zeros(size + 1), 0, 0, 0.0])
                    np.add.at(a[0], k, (p - y) * np.asarray(v))
                    a[0][size] += p - y
                    a[1] += 1
                    a[2] += int((p >= 0.5) == (y >= 0.5))
                    a[3] -= float(np.log(max(p if y >= 0.5 else 1 - p, 1e-9)))
            yield pd.DataFrame([(c, a[0].tolist(), a[1], a[2], a[3]) for c, a in g.items()], columns=["client", "g", "n", "hit", "loss"])

        # Partitions are added up where they are: one row per client and position comes to the driver.
        parts = cut(f.mapInPandas(grad, "client long, g array<double>, n long, hit long, loss double"))
        rows = parts.groupBy("client").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"), F.sum("loss").alias("loss")).collect()
        by = {x["client"]: [np.zeros(size + 1), x["n"]] for x in rows}
        for x in parts.select("client", F.posexplode("g").alias("pos", "v")).groupBy("client", "pos").agg(F.sum("v").alias("v")).collect():
            by[x["client"]][0][x["pos"]] = x["v"]
        n = sum(a[1] for a in by.values()) or 1
        out.append((r, sum(x["hit"] for x in rows) / n, sum(x["loss"] for x in rows) / n))
        step = np.zeros(size + 1)
        for c, (g, m) in sorted(by.items()):
            g = -rate * g / max(m, 1)
            g *= min(1.0, clip / max(np.linalg.norm(g), 1e-12))
            g += np.random.default_rng([r, int(c)]).normal(scale=noise, size=size + 1) / size
            step += m / n * g
        w, b = w + step[:size], b + step[size]
    f.unpersist()
    return spark.createDataFrame([(a, round(float(x), 6), round(float(y), 6)) for a, x, y in out], "round int, accuracy double, loss double")


def linear_baseline(docs: DataFrame) -> DataFrame:
    """(n, accuracy) of TF-IDF over words and word pairs with a multinomial linear model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, StringIndexer

    from spindrift.functions import text as X

    t = docs.filter("content_type is not null").withColumn("w", F.concat(X.tokens(F.col("text")), X.ngrams(X.tokens(F.col("text")), 2)))
    fit, held = t.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), t.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)
    stages = [StringIndexer(inputCol="content_type", outputCol="label", handleInvalid="skip"), HashingTF(inputCol="w", outputCol="tf", numFeatures=4096), IDF(inputCol="tf", outputCol="features", minDocFreq=2), LogisticRegression(maxIter=10, regParam=0.05)]
    p = Pipeline(stages=stages).fit(fit).transform(held)
    return p.agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("prediction")).cast("double")), 6).alias("accuracy"))
