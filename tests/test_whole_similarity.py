"""Summaries of every source and places of every row."""

import hashlib
import re

from pyspark.sql import functions as F

from spindrift import catalog
from spindrift.runtime import table


def test_every_source_has_summaries(spark, data):
    got = catalog.QUERIES["w09_extractive_summary"](spark, data)
    assert got.filter("source != 'library/handbook_all.pdf'").count()
    assert got.groupBy("source", "chunk_id").count().filter("count > 2").count() == 0


def test_every_row_of_a_label_has_a_place(spark, data):
    e = table(spark, data, "embeddings").filter("label is not null")
    got = catalog.QUERIES["w05_diversified"](spark, data)
    assert got.count() == e.count() and got.select("vec_id").distinct().count() == e.count()
    heads = got.filter("place = 1").select("label", "vec_id").collect()
    assert {tuple(r) for r in heads} == {tuple(r) for r in e.groupBy("label").agg(F.min("vec_id")).collect()}


def test_chunks_in_any_characters_have_windows(spark, tmp_path):
    texts = ["caf\u00e9 " * 70, " na\u00efve\tword\u00a0pair\n\u65e5\u672c ", "plain words", None]
    rows = [("s", k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "source string, chunk_id int, text string").write.parquet(f"{tmp_path}/document_chunks.parquet")
    want = set()
    for _, k, t in rows[:3]:
        w = re.sub("[ \t\r\n]+", " ", t).strip(" ").split(" ")
        for i in range(0, len(w), 48):
            p = w[i : i + 64]
            want.add(("s", k, i // 48, len(p), hashlib.md5(" ".join(p).encode()).hexdigest()))
    assert {tuple(r) for r in catalog.QUERIES["w06_word_windows"](spark, str(tmp_path)).collect()} == want


def test_summaries_need_no_join(spark, tmp_path):
    text = "Alpha beta gamma delta epsilon. Alpha beta gamma delta omega. Tiny one. Other words stand here alone today."
    rows = [("s", 1, text), ("s", None, text), (None, 2, text), ("s", 3, None)]
    spark.createDataFrame(rows, "source string, chunk_id int, text string").write.parquet(f"{tmp_path}/document_chunks.parquet")
    got = catalog.QUERIES["w09_extractive_summary"](spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {("s", 1, 1, 1.64), ("s", 1, 2, round(0.8 * 1.8 + 0.2 / 1.35, 6))}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
