"""Problem 6: texts cut off by field limits or broken transfers.

The corpus vocabulary becomes a trie, kept as a table of prefixes so that it is distributed:
a text is cut if its final token is an unknown proper prefix of known words, if it ends in a
word that never ends a sentence, or in a mark that announces more. Length evidence works both
ways: texts without an end pile up at the field limit of their source, and are cut whatever
their last word is; in a text of few words only an unknown prefix or a cut mark counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.runtime import cut, table

#: A token counts as unknown if the words it begins are this many times as frequent, its own count raised by SMOOTH.
UNKNOWN_RATIO, SMOOTH = 40, 0.05
#: A word that ends a sentence in under END_RATE of its occurrences can't end a text; WEIGHT occurrences at the
#: corpus's rate of sentence ends are added to each word's own, so that a rare word needs more than its own absence.
END_RATE, WEIGHT = 0.004, 2.5
#: A length is a field limit of a source if LIMIT_RATIO times as many unended texts have it as have each of the
#: lengths within NEAR of it, and the surplus is over LIMIT_SIGMA standard deviations.
NEAR, LIMIT_RATIO, LIMIT_SIGMA = 10, 4, 4
#: Texts of fewer words are short answers.
SHORT = 6

# What may follow the last sentence without being part of it; marks that end a text.
TRAILER = r"""(?:[\s​ ]|<\|[a-z_]+\|>|[:;]-?[)(DP]|\[\d+\]|\(\d+ (?:marks?|points?)\)|["'”’»“])+$"""
END_MARKS = r"[.?!。？！؟।…:)\]}]"
TOKEN = r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}]+)?"


def _closed(text) -> F.Column:
    """Whether a text ends in a sentence's mark, and not in dots; most do, and need no further look."""
    return F.substring(text, -1, 1).isin(".", "?", "!") & ~F.endswith(text, F.lit(".."))


def _core(text) -> F.Column:
    return F.when(_closed(text), text).otherwise(F.regexp_replace(text, TRAILER, ""))


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, n, ended): how often a word occurs before the last word of a text or before an end mark, and the latter alone."""
    token = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"{TOKEN}(?:[.?!]|(?=[^\p{{L}}\p{{M}}\p{{N}}.?!]))"), F.lit(0))).alias("token")
    # The last word has no following character once the trailer is gone, so an unmarked last word isn't counted.
    words = texts.select(_core(F.col("text")).alias("text")).select(token)
    ended = F.col("token").rlike(r"[.?!]$")
    counted = words.groupBy("token").agg(F.count("*").alias("n"))
    return counted.select(F.regexp_replace("token", r"[.?!]$", "").alias("word"), "n", F.when(ended, F.col("n")).otherwise(0).alias("e")).groupBy("word").agg(F.sum("n").alias("n"), F.sum("e").alias("ended"))


def field_limits(unended: DataFrame) -> DataFrame:
    """(of, source, limit): lengths at which the unended texts (tbl, run_id, full, h, seen) of a source pile up.

    h tells texts apart, as one text that recurs is no pile; seen says whether a text's last word shows
    a cut, as most words of a pile at a limit do, and those of many short answers don't.
    """
    n = unended.groupBy("tbl", "run_id", "full").agg(F.countDistinct("h").alias("n"), F.avg(F.col("seen").cast("int")).alias("seen"))  # a row per source and length
    around = F.sum("n").over(W.partitionBy("tbl", "run_id").orderBy("full").rangeBetween(-NEAR, NEAR)) - F.col("n")
    n, mean = n.withColumn("mean", around / F.lit(2.0 * NEAR)), F.col("mean")
    pile = (F.col("n") > LIMIT_RATIO * mean) & (F.col("n") - mean > LIMIT_SIGMA * F.sqrt(mean + 1)) & (F.col("seen") >= 0.5)
    return n.filter(pile).select(F.col("tbl").alias("of"), F.col("run_id").alias("source"), F.col("full").alias("limit"))


def tail_evidence(texts: DataFrame) -> DataFrame:
    """(tbl, row_key, run_id, unknown, open_word, cut_mark, open_list, at_limit): votes for every text that doesn't end in an end mark.

    texts: (tbl, row_key, run_id, text). Null, empty and marked texts have no row; repeated rows count once, in the vocabulary too.
    """
    texts = texts.select("tbl", "row_key", "run_id", "text").distinct()
    words = F.size(F.split(F.trim("core"), r"\s+"))
    raw = (
        texts.filter(F.col("text").isNotNull() & ~_closed(F.col("text")))
        .withColumn("core", _core(F.col("text")))
        .filter((F.length("core") > 0) & (~F.col("core").rlike(END_MARKS + "$") | F.col("core").rlike(r"(?:\w|,) ?(?:\.\.\.|…)$")))
        .dropDuplicates(["tbl", "row_key"])
        .withColumn("last", F.lower(F.regexp_extract("core", rf"({TOKEN})\W*$", 1)))
        .withColumn("size", words)
        .withColumn("cut_mark", F.col("core").rlike(r"(?:[,;�…\-–—/(\[{«]|\.\.\.)$"))
        .withColumn(
            "open_list",  # a list of noun phrases whose last item isn't joined to the others
            F.col("core").rlike(r",\s+(?:the|a|an|el|la|los|las|le|les|o|os|as|der|die|das|den|einem?|une?|un|uma?)\s+[^,.?!:;]*$")
            & ~F.regexp_extract("core", r",\s+([^,]*)$", 1).rlike(r"(?i)\b(?:and|or|nor|but|is|are|was|were|be|has|had|have|does|do|did|can|could|will|would|must|may|might|remain\w*|stay\w*|show\w*|y|e|et|und|dan|ou|o|u|[\w]+(?:s|ed) the)\b"),
        )
    )
    raw = cut(raw.select("tbl", "row_key", "run_id", "last", "size", "cut_mark", "open_list", F.length("core").alias("chars"), F.length("text").alias("full"), F.xxhash64("text").alias("h")))
    vocab = cut(vocabulary(texts))
    asked = raw.select("last").filter("last != ''").distinct()
    # Only depths of the trie at which a last word can end, so a run of a million letters has a few prefixes only.
    depths = F.array(*[F.lit(r[0]) for r in asked.select(F.length("last")).distinct().collect()]).cast("array<int>")
    lens = F.filter(depths, lambda k: k < F.length("word"))
    trie = vocab.filter(F.length("word") > 1).select(F.explode(F.transform(lens, lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("last"), "n").groupBy("last").agg(F.sum("n").alias("longer"))
    base = vocab.agg(F.sum("ended") / F.sum("n")).first()[0] or 0.0  # the corpus's rate of sentence ends, one number
    n, longer = F.coalesce("n", F.lit(0)), F.coalesce("longer", F.lit(0))
    stats = (
        asked.join(vocab.withColumnRenamed("word", "last"), "last", "left")
        .join(trie, "last", "left")
        .select(
            "last",
            (longer > UNKNOWN_RATIO * (n + SMOOTH)).alias("unknown"),
            ((n > 0) & (F.coalesce("ended", F.lit(0)) + WEIGHT * base < END_RATE * (n + WEIGHT))).alias("open_word"),
        )
    )
    long = F.col("size") >= SHORT
    votes = {
        "unknown": F.coalesce("unknown", F.lit(False)) & ((F.col("size") >= 3) | (F.col("chars") >= 12)),
        "open_word": F.coalesce("open_word", F.lit(False)) & long,
        "cut_mark": F.col("cut_mark") & (F.col("last") != ""),
        "open_list": F.col("open_list") & long,
    }
    voted = cut(raw.join(stats, "last", "left").withColumns(votes).withColumn("seen", F.expr("unknown or open_word or cut_mark or open_list")))
    limits = field_limits(voted.filter(long))
    same = (F.col("tbl") == F.col("of")) & F.col("run_id").eqNullSafe(F.col("source")) & (F.col("full") == F.col("limit"))
    return voted.join(limits, same, "left").select("tbl", "row_key", "run_id", *votes, (F.col("limit").isNotNull() & long).alias("at_limit"), "last")


def truncated(texts: DataFrame) -> DataFrame:
    """Rows (tbl, row_key, run_id) of texts cut off before their end."""
    return tail_evidence(texts).filter("unknown or open_word or cut_mark or open_list or at_limit").select("tbl", "row_key", "run_id")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "predictions").select(F.lit("predictions").alias("tbl"), F.col("id").alias("row_key"), "run_id", F.col("prediction").alias("text"))
    d = table(spark, sf_dir, "target_rewrite_diagnostic").select(F.lit("target_rewrite_diagnostic").alias("tbl"), F.col("diag_id").alias("row_key"), "run_id", F.col("raw_output").alias("text"))
    return p.union(d)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, row_key) of every prediction and raw output that was cut off."""
    return truncated(_texts(spark, sf_dir)).select("tbl", "row_key")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, texts, cut, rate): distinct texts' rows of each run and the share cut off; runs without a case have 0."""
    texts = _texts(spark, sf_dir)
    all_rows = texts.filter(F.col("text").isNotNull()).groupBy("run_id").agg(F.countDistinct("tbl", "row_key").alias("texts"))
    cases = truncated(texts).groupBy("run_id").agg(F.count("*").alias("cut"))
    n = F.coalesce("cut", F.lit(0))
    return all_rows.join(cases, all_rows.run_id.eqNullSafe(cases.run_id), "left").select(all_rows.run_id, "texts", n.alias("cut"), F.round(n / F.col("texts"), 6).alias("rate"))
