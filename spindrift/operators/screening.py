"""Leakage of protected texts into others, and the ordered rule cascades with a reason and a risk that read it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.operators.similarity import gram_rows, term_counts

# Thresholds of the cascades.
SPAN, GRAM = 8, 5
ARTIFACT_OVERLAP, CONTAINMENT, CONCEPTS, QUERY_OVERLAP, OUTPUT_OVERLAP = 0.12, 0.35, 0.62, 0.85, 0.55


def leakage(texts: DataFrame, key: str, protected: DataFrame, of: str) -> DataFrame:
    """(key, tokens, overlap, span, containment, concepts, concept_ratio) of texts (key, text) against the union of protected (of, text).

    overlap: multiset overlap over the text's tokens; span: whether SPAN tokens in a row are shared;
    containment: share of the text's GRAM-grams that are protected; concept_ratio: share of its
    concepts. All are equi-joins on the shared piece. Empty texts have zeros; null texts too.
    """
    t = texts.select(key, F.coalesce("text", F.lit("")).alias("text"))
    span = gram_rows(t, key, SPAN).join(gram_rows(protected, of, SPAN).select("gram").distinct(), "gram").select(key, F.lit(True).alias("span")).distinct()
    known = gram_rows(protected, of, GRAM).select("gram", F.lit(1).alias("k")).distinct()
    five = gram_rows(t, key, GRAM).join(known, "gram", "left").groupBy(key).agg(F.avg(F.coalesce("k", F.lit(0))).alias("c"))
    m = term_counts(protected, of).groupBy("t").agg(F.sum("n").alias("m"))
    o = term_counts(t, key).join(m, "t", "left").groupBy(key).agg((F.sum(F.least("n", F.coalesce("m", F.lit(0)))) / F.sum("n")).alias("o"), F.sum("n").alias("tokens"))
    own = protected.filter("text is not null").select(F.explode(X.concept_tokens(F.col("text"))).alias("w")).distinct().withColumn("p", F.lit(1))
    con = t.select(key, F.explode(X.concept_tokens(F.col("text"))).alias("w")).join(own, "w", "left")
    con = con.groupBy(key).agg(F.count("*").alias("concepts"), (F.sum(F.coalesce("p", F.lit(0))) / F.count("*")).alias("r"))
    j = t.join(span, key, "left").join(five, key, "left").join(o, key, "left").join(con, key, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(
        key, "text", z("tokens").alias("tokens"), z("o").cast("double").alias("overlap"), F.coalesce("span", F.lit(False)).alias("span"),
        z("c").cast("double").alias("containment"), z("concepts").alias("concepts"), z("r").cast("double").alias("concept_ratio"),
    )


def _first(rules: list[tuple], other: tuple) -> tuple:
    """Reason and risk of the first rule (condition, reason, risk) that holds."""
    reason, risk = F.lit(other[0]), other[1]
    for on, name, x in reversed(rules):
        reason, risk = F.when(on, F.lit(name) if isinstance(name, str) else name).otherwise(reason), F.when(on, x).otherwise(risk)
    return reason, risk


def screen(queries: DataFrame, key: str, protected: DataFrame, of: str, risks: list[str], artifacts: list[str]) -> DataFrame:
    """(key, reason, risk, names_artifact) of queries (key, text): risky wording first, then what they share with the protected texts."""
    low = F.lower("text")
    hits = sum((F.when(low.rlike(p), 1).otherwise(0) for p in risks), F.lit(0))
    named = F.lit(False)
    for p in artifacts:
        named = named | low.rlike(p)
    x = leakage(queries, key, protected, of).withColumn("hits", hits).withColumn("named", named)
    named, overlap = F.col("named"), F.col("overlap")
    rules = [
        (F.trim("text") == "", "empty_query", F.lit(1.0)),
        (F.col("hits") > 0, "reconstruction_intent_detected", F.least(F.lit(1.0), 0.2 * F.col("hits"))),
        (named & (overlap >= ARTIFACT_OVERLAP), "artifact_reference_with_overlap", overlap),
        (F.col("span"), "protected_span_in_query", F.lit(1.0)),
        (named & (F.col("containment") >= CONTAINMENT), "protected_ngram_query", F.col("containment")),
        (named & (F.col("concept_ratio") >= CONCEPTS), "protected_semantic_query", F.col("concept_ratio")),
        ((overlap >= QUERY_OVERLAP) & (F.col("tokens") >= SPAN), "query_overlap_high", overlap),
    ]
    reason, risk = _first(rules, ("ok", overlap))
    return x.select(key, reason.alias("reason"), F.round(risk, 6).alias("risk"), named.alias("names_artifact"))


def screen_outputs(outputs: DataFrame, key: str, protected: DataFrame, of: str) -> DataFrame:
    """(key, reason, risk) of outputs (key, staff, text): copied runs, n-grams, concepts (only for readers who aren't staff) and overlap."""
    x = leakage(outputs, key, protected, of).join(outputs.select(key, "staff"), key)
    staff, c, o = F.col("staff"), F.col("containment"), F.col("overlap")
    either = lambda a, b: F.when(staff, F.lit(a)).otherwise(F.lit(b))
    rules = [
        (F.col("span"), either("teacher_output_copied_protected_span", "protected_span_copied"), F.lit(1.0)),
        ((c >= CONTAINMENT) & (F.col("tokens") >= GRAM), either("teacher_output_copied_protected_ngram", "protected_ngram_copied"), c),
        (~staff & (F.col("concept_ratio") >= CONCEPTS) & (F.col("concepts") >= 4), "protected_semantic_leakage", F.col("concept_ratio")),
        ((o >= OUTPUT_OVERLAP) & (F.col("tokens") >= SPAN), either("teacher_output_high_protected_overlap", "protected_overlap_high"), o),
    ]
    reason, risk = _first(rules, ("ok", F.greatest(o, c)))
    return x.select(key, reason.alias("reason"), F.round(risk, 6).alias("risk"))
