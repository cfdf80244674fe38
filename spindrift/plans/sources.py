"""Round trips through sources and sinks, in the shared folder, and a stream (S rows)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spindrift.plans.registry import query
from spindrift.runtime import ensure_checkpoint_dir, table
from spindrift.sources import io
from spindrift.streaming.windows import daily_counts


def _folder(s, name):
    ensure_checkpoint_dir(s)
    return f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


@query("s12_task_layout", "S1 S2 S12 S13 G4 G5", """
select distinct id, task, case when ('0x'||md5(id)[1:8])::bigint%10<8 then 'train' else 'test' end as split, md5(coalesce(prediction,'')) as h from predictions where task in ('qa','summarization')""")
def task_layout(s, d):
    p = table(s, d, "predictions").select("id", "task", F.when(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long") % 10 < 8, "train").otherwise("test").alias("split"), F.md5(F.coalesce("prediction", F.lit(""))).alias("h")).distinct()
    path = _folder(s, "tasks")
    io.write_tasks(p, path)
    return io.read_tasks(s, path, "id string, task string, split string, h string", ["qa", "summarization"], {"qa", "summarization", "bloom_rewrite"}).select("id", "task", "split", "h")


@query("s14_vector_store", "S14 S15", "select label, count(*)::bigint as n from embeddings group by 1")
def vector_store(s, d):
    path = _folder(s, "vectors")
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("index_text"), F.col("label").alias("return_text"), "embedding")
    io.save_vectors(e, path, "unit-64")
    return io.load_vectors(s, path, "unit-64").groupBy(F.col("return_text").alias("label")).agg(F.count("*").alias("n"))


@query("s09_flattened_questions", "S3 S9 R36", """
select distinct id, context, reference as answer, strpos(context, reference)>0 as found from predictions where task='qa' and context is not null and reference is not null and source_question is not null""")
def flattened(s, d):
    """Nests the questions as articles, writes and reads them as JSON, and flattens them again."""
    p = table(s, d, "predictions").filter("task = 'qa' and context is not null and reference is not null and source_question is not null").select("id", "context", "source_question", "reference", "run_id").distinct()
    answer = F.struct(F.col("reference").alias("text"), (F.position(F.col("reference"), F.col("context")) - 1).alias("answer_start"))
    qa = F.struct(F.col("id").alias("id"), F.col("source_question").alias("question"), F.array(answer).alias("answers"))
    para = F.struct(F.col("context").alias("context"), F.array(qa).alias("qas"))
    nested = p.select(F.array(F.struct(F.col("run_id").alias("title"), F.array(para).alias("paragraphs"))).alias("data"))
    path = _folder(s, "nested")
    nested.write.json(path)
    f = io.flatten_questions(io.read_jsonl(s, path, io.QUESTION_SET, strict=False))
    return f.select("id", "context", F.col("answers").getItem(0).alias("answer"), (F.col("answer_start") >= 0).alias("found"))


@query("s05_csv_round_trip", "S4 S5 S17", "select run_id, model_name, quantization, n_ctx::varchar as n_ctx from eval_runs")
def csv_round_trip(s, d):
    path = _folder(s, "runs")
    table(s, d, "eval_runs").select("run_id", "model_name", "quantization", "n_ctx").write.option("header", True).csv(path)
    return io.read_text_csv(s, path, ["run_id", "model_name", "quantization", "n_ctx"])


@query("s11_capped_scan", "S11")
def capped_scan(s, d):
    return io.capped_scan(table(s, d, "documents").select("doc_id", "source"), "doc_id", 50)


@query("st01_daily_counts", "2.10", "select strftime(ts,'%Y-%m-%d') as day, event_type, count(*)::bigint as n, round(sum(value),2) as total from events group by all")
def daily(s, d):
    """The events table read as a stream, in one-day windows with a watermark, written to the shared folder."""
    return daily_counts(s, d, _folder(s, "stream"))
