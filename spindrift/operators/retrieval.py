"""Retrieval: exact nearest vectors, re-ranking, lexical scores, windows and budgets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions import text as X

#: Rows of a block of queries and of a block of the corpus; a task multiplies one of each.
QUERY_BLOCK, CORPUS_BLOCK = 4096, 32_768
#: Rows of items' terms up to which they are sent to every task.
ITEM_TERMS = 1_000_000


def top_matches(queries: DataFrame, corpus: DataFrame, k: int, nearest: bool = False) -> DataFrame:
    """(q, v, s, r): the k best rows of the corpus for every query, ties by id, the query itself left out.

    queries, corpus: (vec_id, embedding). Both are cut into blocks by hash; every pair of blocks is
    one matrix product in one task and sends k rows per query on, so neither side is broadcast and
    no task sees more than two blocks. s is the dot product, or the squared distance if ``nearest``.
    """
    nq, nc = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-corpus.count() // CORPUS_BLOCK))
    cols = ["vec_id", "embedding"]
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(*cols, block(nq).alias("qb")).withColumn("cb", each(nc))
    c = corpus.select(*cols, block(nc).alias("cb")).withColumn("qb", each(nq))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "v": [], "s": []}).astype({"q": "int64", "v": "int64"})
        A, B, ids = np.stack(a["embedding"]).astype(float), np.stack(b["embedding"]).astype(float), b["vec_id"].to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for x in range(0, len(A), 256):
            S = A[x : x + 256] @ B.T
            S = np.round((A[x : x + 256] ** 2).sum(1)[:, None] + (B**2).sum(1) - 2 * S, 5) if nearest else -np.round(S, 6)
            for q_id, row in zip(a["vec_id"].to_numpy()[x : x + 256], S):
                row = np.where(ids == q_id, np.inf, row)
                edge = np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1]
                near = np.flatnonzero(row <= edge)
                near = near[np.lexsort((ids[near], row[near]))][:k]
                near = near[np.isfinite(row[near])]
                out.append((np.full(len(near), q_id), ids[near], row[near]))
        q_ids, v_ids, scores = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"q": q_ids, "v": v_ids, "s": scores}).astype({"q": "int64", "v": "int64"})

    x = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(best, "q long, v long, s double")
    x = x.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("s", "v"))).filter(F.col("r") <= k)
    return x if nearest else x.withColumn("s", -F.col("s"))


def nearest_vectors(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(q, v, dist): the k rows of least squared distance of each query, ties by id."""
    return top_matches(queries, corpus, k, nearest=True).select("q", "v", F.col("s").alias("dist"))


def relevant_matches(queries: DataFrame, corpus: DataFrame, pool: int, least: float) -> DataFrame:
    """(q, v, cosine): of each query's pool the rows of ``least`` or more, or the best one if there is none."""
    x = top_matches(queries, corpus, pool)
    top = x.withColumn("top", F.max("s").over(W.partitionBy("q")))  # at most ``pool`` rows
    return top.filter((F.col("s") >= least) | ((F.col("top") < least) & (F.col("r") == 1))).select("q", "v", F.col("s").alias("cosine"))


def privacy_rerank(queries: DataFrame, corpus: DataFrame, pool: int, temperature: float, weight: float) -> DataFrame:
    """(q, v, risk, score, rank): cosine of the pool minus ``weight`` times its softmax over the pool."""
    x = top_matches(queries, corpus, pool).select("q", "v", F.col("s").alias("c"))
    by = W.partitionBy("q")
    x = x.withColumn("e", F.exp((F.col("c") - F.max("c").over(by)) / temperature))
    x = x.withColumn("risk", F.col("e") / F.sum("e").over(by))
    x = x.withColumn("score", F.round(F.col("c") - weight * F.col("risk"), 5))
    return x.select("q", "v", F.round("risk", 5).alias("risk"), "score", F.row_number().over(by.orderBy(F.desc("score"), F.desc("c"), "v")).cast("long").alias("rank"))


def retrieval_quality(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """One row (queries, hit_at_1, hit_at_3, mrr); a hit has the query's label."""
    x = top_matches(queries, corpus, k).select("q", "v", "r")
    x = x.join(corpus.select(F.col("vec_id").alias("v"), "label"), "v").join(queries.select(F.col("vec_id").alias("q"), F.col("label").alias("q_label")), "q")
    hit = F.col("label") == F.col("q_label")
    g = x.groupBy("q").agg(F.max(F.when(hit & (F.col("r") <= 1), 1).otherwise(0)).alias("h1"), F.max(F.when(hit & (F.col("r") <= 3), 1).otherwise(0)).alias("h3"), F.coalesce(1.0 / F.min(F.when(hit, F.col("r"))), F.lit(0.0)).alias("rr"))
    return g.agg(F.count("*").alias("queries"), F.round(F.avg("h1"), 6).alias("hit_at_1"), F.round(F.avg("h3"), 6).alias("hit_at_3"), F.round(F.avg("rr"), 6).alias("mrr"))


def lexical_rank(items: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, score): the dot product weighs terms once by idf, the norms by its square; plus 0.15 of the shared terms' share.

    Documents stay on their doc_id's task; the items' weighted terms go to them if they are at most
    ITEM_TERMS rows, so pairs are scored without a shuffle of their shared terms.
    """
    from spindrift.operators.similarity import term_counts

    tf = term_counts(docs.select("doc_id", "text").repartition("doc_id"), "doc_id")
    q = term_counts(items, "item_id").withColumnRenamed("n", "f")
    n = docs.filter("text is not null").count()
    idf = tf.groupBy("t").agg((F.log((n + 1) / (F.count("*") + 0.5)) + 1).alias("idf"))
    unseen = F.log(F.lit((n + 1) / 0.5)) + 1
    qn = q.join(idf, "t", "left").groupBy("item_id").agg(F.sqrt(F.sum(F.pow(F.col("f") * F.coalesce("idf", unseen), 2))).alias("qn"), F.count("*").alias("qt"))
    dn = tf.join(idf, "t").groupBy("doc_id").agg(F.sqrt(F.sum(F.pow(F.col("n") * F.col("idf"), 2))).alias("dn"))
    weighed = q.join(idf, "t")
    if q.count() <= ITEM_TERMS:
        weighed = F.broadcast(weighed)
    s = tf.join(weighed, "t").groupBy("item_id", "doc_id").agg(F.sum(F.col("f") * F.col("n") * F.col("idf")).alias("dot"), F.count("*").alias("common"))
    score = F.round(F.col("dot") / (F.col("qn") * F.col("dn")) + 0.15 * F.col("common") / F.col("qt"), 5)
    x = s.join(qn, "item_id").join(dn, "doc_id").select("item_id", "doc_id", score.alias("score"))
    return x.withColumn("r", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))).filter(F.col("r") <= k).drop("r")


def word_windows(df: DataFrame, keys: list[str], size: int, overlap: int) -> DataFrame:
    """(keys, piece, words, h): windows of ``size`` words every size - overlap words; short last windows stay."""
    step = size - overlap
    w = df.select(*keys, F.split(F.trim(F.regexp_replace("text", "[ \\t\\r\\n]+", " ")), " ").alias("w"))
    at = F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))).alias("i")
    x = w.filter(F.size("w") > 0).select(*keys, "w", at).withColumn("p", F.slice("w", F.col("i") + 1, F.lit(size)))
    return x.select(*keys, (F.col("i") / step).cast("long").alias("piece"), F.size("p").cast("long").alias("words"), F.md5(F.array_join("p", " ")).alias("h"))


def context_budget(df: DataFrame, group: str, order: str, most: int, block: int = 256) -> DataFrame:
    """(group, order, chars, total): rows of each group up to the first that would pass the budget; the first row always stays.

    Running totals are put together from blocks of ``block`` values of the whole number ``order``, so a group with most of
    all rows is not summed up in one task, and the place where it stops is an aggregate.
    """
    x = df.select(group, order, "chars").withColumn("_b", F.floor(F.col(order) / block))
    sums = x.groupBy(group, "_b").agg(F.sum("chars").alias("_s"), F.min(order).alias("_o"))
    over = W.partitionBy(group).orderBy("_b")
    sums = sums.select(F.col(group).alias("_g"), F.col("_b").alias("_k"), (F.sum("_s").over(over) - F.col("_s")).alias("_before"), F.min("_o").over(W.partitionBy(group)).alias("_first"))
    run = W.partitionBy(group, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("_t", F.sum("chars").over(run))
    r = x.join(sums, x[group].eqNullSafe(sums["_g"]) & (x["_b"] == sums["_k"])).withColumn("total", F.col("_t") + F.col("_before"))
    stop = r.filter((F.col("total") > most) & (F.col(order) > F.col("_first"))).groupBy(F.col(group).alias("_h")).agg(F.min(order).alias("_stop"))
    r = r.select(group, order, "chars", "total").join(stop, F.col(group).eqNullSafe(F.col("_h")), "left")
    return r.filter(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).select(group, order, "chars", "total")


def extractive_sentences(df: DataFrame, keys: list[str], top: int) -> DataFrame:
    """(keys, sentence, score): sentences by their terms' sentence frequency and a bonus for early ones; rows with a null key drop out.

    Frequencies are counted on the tasks that hold the keys' rows: no join, so none that could become a broadcast through the driver.
    """
    parts = F.split("text", r"(?<=[.!?])\s+")
    s = df.dropna(subset=keys).select(*keys, F.posexplode(parts).alias("p", "sent")).withColumn("i", F.col("p") + 1)
    s = s.withColumn("w", F.array_distinct(F.filter(X.tokens(F.col("sent")), lambda w: F.length(w) > 2))).filter(F.size("w") >= 5)
    t = s.select(*keys, "i", F.explode("w").alias("t"))
    sc = t.withColumn("n", F.count("*").over(W.partitionBy(*keys, "t"))).groupBy(*keys, "i").agg(F.avg("n").alias("a"))
    sc = sc.withColumn("score", F.round(F.col("a") * 0.8 + 0.2 / (1.0 + (F.col("i") - 1) * 0.35), 6))
    r = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "i"))
    return sc.withColumn("r", r).filter(F.col("r") <= top).select(*keys, F.col("i").cast("long").alias("sentence"), "score")
