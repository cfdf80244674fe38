"""Evaluation metrics as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two texts' word multisets; 1 if both are empty. The common count is that of sorted runs."""
    wa, wb = F.filter(F.split(a, " "), lambda w: w != ""), F.filter(F.split(b, " "), lambda w: w != "")
    count = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    common = F.aggregate(F.array_intersect(wa, wb), F.lit(0), lambda s, w: s + F.least(count(wa, w), count(wb, w)))
    return F.when((F.size(wa) == 0) & (F.size(wb) == 0), 1.0).otherwise(2.0 * common / (F.size(wa) + F.size(wb)))


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(gold, predicted, n) with MISSING for a null prediction."""
    return df.groupBy(F.col(gold).alias("gold"), F.coalesce(F.col(predicted), F.lit("MISSING")).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) on a label spine; 0 where a denominator is 0."""
    tp = cells.filter("gold = predicted").select(F.col("gold").alias("label"), F.col("n").alias("tp"))
    g = cells.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"))
    p = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    r = labels.select("label").join(tp, "label", "left").join(g, "label", "left").join(p, "label", "left")
    r = r.select("label", ratio(z("tp"), z("said")).alias("precision"), ratio(z("tp"), z("support")).alias("recall"), z("support").cast("long").alias("support"))
    both = F.col("precision") + F.col("recall")
    return r.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both))


def kappas(cells: DataFrame, codes: DataFrame) -> DataFrame:
    """One row (n, accuracy, kappa, weighted_kappa) from a confusion matrix and label codes 0 to k - 1."""
    k = codes.count()
    c = cells.join(codes.select(F.col("label").alias("gold"), F.col("code").alias("i")), "gold").join(codes.select(F.col("label").alias("predicted"), F.col("code").alias("j")), "predicted")
    row, col = c.groupBy("i").agg(F.sum("n").alias("ri")), c.groupBy("j").agg(F.sum("n").alias("cj"))
    w = F.pow(F.col("i") - F.col("j"), 2) / float((k - 1) ** 2)
    seen = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("i") == F.col("j"), F.col("n")).otherwise(0)).alias("agree"), F.sum(w * F.col("n")).alias("o"))
    due = row.join(col).agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("ri") * F.col("cj")).otherwise(0)).alias("chance"), F.sum(w * F.col("ri") * F.col("cj")).alias("e"))  # k x k cells
    x = seen.join(due)
    po, pe = F.col("agree") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return x.select("n", F.round(po, 6).alias("accuracy"), F.round((po - pe) / (1 - pe), 6).alias("kappa"), F.round(1 - F.col("o") / (F.col("e") / F.col("n")), 6).alias("weighted_kappa"))


#: Edges of ten equal calibration bins as floating-point steps give them, not as decimals.
EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]


def calibration_bin(c: Column) -> Column:
    """Bin 0 to 9 by the edge table; the last bin is closed."""
    out = F.lit(0)
    for k, edge in enumerate(EDGES[1:-1], 1):
        out = F.when(c >= edge, k).otherwise(out)
    return out.cast("long")


def nearest_rank(values: Column, q: float) -> Column:
    """Element at round(q * (n - 1)), half to even, of sorted values."""
    s = F.sort_array(values)
    return F.element_at(s, (F.bround(F.lit(q) * (F.size(s) - 1)).cast("int") + 1))


def rank_in(df: DataFrame, by: list, order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
