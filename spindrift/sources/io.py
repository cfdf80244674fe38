"""Sources and sinks: JSON lines, JSON arrays, CSV, whole texts, nested question sets, task layouts and vector stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """One object per line; bad JSON fails. Strict: blank lines fail too, else they are skipped."""
    if strict:
        blank = spark.read.text(path).filter(F.length(F.trim("value")) == 0).limit(1).count()
        if blank:
            raise ValueError(f"blank line in {path}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The whole file is one array of objects."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_labelled_csv(spark: SparkSession, path: str, text: str, label: str, labels: list[str]) -> DataFrame:
    """Rows with a text and an allowed label."""
    return spark.read.option("header", True).csv(path).na.drop(subset=[text, label]).filter(F.col(label).isin(labels))


def read_text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings, empty kept as empty; a missing column fails."""
    df = spark.read.option("header", True).option("nullValue", "\x00").option("emptyValue", "").csv(path)
    if lost := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns missing in {path}: {lost}")
    return df.select(*columns).na.fill("")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of whole files; bytes that are not UTF-8 are dropped."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("source"), F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit("")).alias("text"))


def with_parser(files: DataFrame, parse) -> DataFrame:
    """(source, page, text) of binary files (path, content) through an injected parser: bytes to a list of page texts. For PDF and images."""
    import pandas as pd

    def run(frames):
        for pdf in frames:
            rows = [(p, k, t) for p, c in zip(pdf["path"], pdf["content"]) for k, t in enumerate(parse(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["source", "page", "text"])

    return files.select("path", "content").mapInPandas(run, "source string, page int, text string")


QUESTION_SET = "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:array<struct<text:string,answer_start:int>>>>>>>>"


def flatten_questions(nested: DataFrame) -> DataFrame:
    """(id, title, context, question, answers, answer_start): articles to paragraphs to questions, answers stay a list."""
    a = nested.select(F.explode("data").alias("a")).select("a.title", F.explode("a.paragraphs").alias("p"))
    q = a.select("title", "p.context", F.explode("p.qas").alias("q"))
    return q.select("q.id", "title", "context", "q.question", F.col("q.answers.text").alias("answers"), F.col("q.answers.answer_start").getItem(0).alias("answer_start"))


def write_tasks(df: DataFrame, path: str) -> None:
    """JSON lines by task and split; a reader of some tasks opens only their folders."""
    df.write.mode("overwrite").partitionBy("task", "split").json(path)


def read_tasks(spark: SparkSession, path: str, schema: str, tasks: list[str], known: set[str]) -> DataFrame:
    """Rows of the requested tasks, sorted by task and id; an unknown task fails."""
    if wrong := set(tasks) - known:
        raise ValueError(f"unknown tasks: {sorted(wrong)}")
    return spark.read.schema(schema).json(path).filter(F.col("task").isin(tasks)).orderBy("task", "id")


def capped_scan(df: DataFrame, key: str, most: int, seed: int = 7) -> DataFrame:
    """A sample of ``most`` rows in hash order; top-k, not a sort."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(most)


def save_vectors(df: DataFrame, path: str, model: str) -> None:
    """(doc_id, index_text, return_text, embedding) and a one-row configuration."""
    df.write.mode("overwrite").parquet(f"{path}/vectors")
    row = df.agg(F.count("*").alias("rows"), F.max(F.size("embedding")).alias("width")).withColumn("model", F.lit(model))
    row.write.mode("overwrite").parquet(f"{path}/config")


def load_vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The vectors, if model, row count and width are as saved."""
    df, c = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/config").first()
    n = df.agg(F.count("*").alias("rows"), F.max(F.size("embedding")).alias("width")).first()
    if c is None or c["model"] != model or (c["rows"], c["width"]) != (n["rows"], n["width"]):
        raise ValueError("the vector store does not match its configuration")
    return df


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def check_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, violation) of files against a manifest (path, sha256); no row is a pass."""
    m = manifest.select("path", F.col("sha256").alias("want"))
    j = files.select("path", "sha256").join(m, "path", "full_outer")
    why = F.when(F.col("want").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("want"), "changed")
    return j.select("path", why.alias("violation")).filter("violation is not null")
