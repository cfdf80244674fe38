"""Similarity joins on tokens and n-grams; equi-joins on the shared piece, counts combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions import text as X


def term_counts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return df.filter(F.col(text).isNotNull()).select(key, F.explode(X.tokens(F.col(text))).alias("t")).groupBy(key, "t").agg(F.count("*").alias("n"))


def gram_rows(df: DataFrame, key: str, n: int, text: str = "text") -> DataFrame:
    """(key, gram), distinct."""
    return df.filter(F.col(text).isNotNull()).select(key, F.explode(X.ngram_set(X.tokens(F.col(text)), n)).alias("gram"))


def multiset_overlap(items: DataFrame, docs: DataFrame, top: int) -> DataFrame:
    """Sum of the smaller counts over the item's length; the ``top`` documents of each item, ties by doc_id.

    Documents stay on their doc_id's task, so the pairs are added up without a shuffle of their shared terms.
    """
    a, b = term_counts(items, "item_id"), term_counts(docs.select("doc_id", "text").repartition("doc_id"), "doc_id").withColumnRenamed("n", "m")
    total = a.groupBy("item_id").agg(F.sum("n").alias("total"))
    pairs = a.join(b, "t").groupBy("item_id", "doc_id").agg(F.sum(F.least("n", "m")).alias("shared"))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id"))
    best = pairs.withColumn("r", rank).filter(F.col("r") <= top)
    return best.join(total, "item_id").select("item_id", "doc_id", "shared", F.round(F.col("shared") / F.col("total"), 6).alias("ratio"))


def gram_containment(items: DataFrame, docs: DataFrame, n: int, least: float) -> DataFrame:
    """(item_id, doc_id, shared, total, containment) of items whose n-grams a document holds to a share of ``least`` or more."""
    a = gram_rows(items, "item_id", n)
    total = a.groupBy("item_id").agg(F.count("*").alias("total"))
    shared = a.join(gram_rows(docs, "doc_id", n), "gram").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    c = F.col("shared") / F.col("total")
    return shared.join(total, "item_id").filter(c >= least).select("item_id", "doc_id", "shared", "total", F.round(c, 6).alias("containment"))


def shared_runs(items: DataFrame, docs: DataFrame, n: int = 8) -> DataFrame:
    """Pairs with a common token run of n or more: exactly those that share an n-gram."""
    return gram_rows(items, "item_id", n).join(gram_rows(docs, "doc_id", n), "gram").select("item_id", "doc_id").distinct()


def longest_runs(items: DataFrame, docs: DataFrame, n: int = 8) -> DataFrame:
    """(item_id, doc_id, run): the longest run of common tokens of pairs that share one of n or more.

    n-grams are joined with their places; in a run they follow each other on one diagonal.
    """
    placed = lambda df, key, at: df.filter("text is not null").select(key, "text").distinct().select(key, F.posexplode(X.ngrams(X.tokens(F.col("text")), n)).alias(at, "gram"))
    m = placed(items, "item_id", "i").join(placed(docs, "doc_id", "j"), "gram").select("item_id", "doc_id", "i", (F.col("i") - F.col("j")).alias("d"))
    run = F.col("i") - F.row_number().over(W.partitionBy("item_id", "doc_id", "d").orderBy("i"))
    r = m.withColumn("g", run).groupBy("item_id", "doc_id", "d", "g").agg((F.count("*") + (n - 1)).alias("run"))
    return r.groupBy("item_id", "doc_id").agg(F.max("run").alias("run"))


def banded_pairs(df: DataFrame, key: str, band: int, least: float) -> DataFrame:
    """Pairs within ``band`` places of each other in key order with content likeness ``least`` or more.

    The band is an equi-join on block numbers, so no task compares more than two blocks.
    """
    w = df.select(key, X.content_tokens(F.col("text"), X.VALIDATION_STOPWORDS).alias("s"))
    block = F.floor(F.col(key) / (band + 1))
    a = w.select(F.col(key).alias("a"), F.col("s").alias("sa"), F.explode(F.array(block, block + 1)).alias("block"))
    b = w.select(F.col(key).alias("b"), F.col("s").alias("sb"), block.alias("block"))
    p = a.join(b, "block").filter((F.col("b") > F.col("a")) & (F.col("b") - F.col("a") <= band))
    return p.withColumn("likeness", X.jaccard(F.col("sa"), F.col("sb"))).filter(F.col("likeness") >= least).select("a", "b", F.round("likeness", 6).alias("likeness"))
