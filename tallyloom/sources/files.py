"""Files as documents, evaluation runs, and the append-only sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import scoring

C = F.col
KINDS = {"html": "html", "htm": "html", "csv": "csv", "txt": "text", "md": "text", "json": "text", "xml": "text", "pdf": "pdf"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, paper_id, file_type, kind, content of the text files below a path; kind is null for unknown types, files of no bytes are not listed."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), C("content").cast("string").alias("content"))
    ext = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), ext)
    return df.select("path", F.regexp_replace("name", r"\.[A-Za-z0-9]+$", "").alias("paper_id"), ext.alias("file_type"), kind.alias("kind"), "content")


def source_of(papers: DataFrame, files: DataFrame) -> DataFrame:
    """paper_id, path: the file of the same name, else one whose name without punctuation starts alike; PDF first, then the shortest name.

    Names of fewer than five characters only match exactly. Prefixes of five
    characters are the join key, so papers never meet all files.
    """
    n = lambda c: X.alnum_key(F.regexp_replace(c, r"\.[A-Za-z0-9]+$", ""))
    p = papers.select("paper_id", n(C("paper_id")).alias("a")).withColumn("key", F.substring("a", 1, 5))
    f = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name")).withColumn("b", n(C("name"))).withColumn("key", F.substring("b", 1, 5))
    stem = F.regexp_replace("name", r"\.[A-Za-z0-9]+$", "")
    exact = (stem == C("paper_id")) | (C("name") == C("paper_id"))
    near = (F.length("a") >= 5) & (F.length("b") >= 5) & (F.startswith(C("a"), C("b")) | F.startswith(C("b"), C("a")))
    j = p.join(f, "key").where(exact | near)
    w = Window.partitionBy("paper_id").orderBy(F.when(exact, 0).otherwise(1), F.when(F.lower("name").endswith(".pdf"), 0).otherwise(1), F.length("name"), "path")
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("paper_id", "path")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per result of the run files below a path, newest run first by name, five-dimension runs before others."""
    df = spark.read.option("multiLine", "true").json(path).withColumn("file", C("_metadata.file_name"))
    return df.withColumn("priority", F.when(C("file").startswith("eval50_"), 0).otherwise(1)).select("file", "priority", "run_timestamp", F.explode("results").alias("r")).select("file", "priority", "run_timestamp", "r.*")


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def write_run(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)


def query_log(queries: DataFrame) -> DataFrame:
    """Log rows from (query_type, paper_id, top_k, query, scores, retrieval_ms, llm_ms, model, answer)."""
    return queries.select(
        F.current_timestamp().alias("timestamp"), "query_type", "paper_id", "top_k", F.substring("query", 1, 120).alias("query_preview"), F.size("scores").alias("num_chunks_retrieved"),
        F.struct(scoring.similarity_summary(C("scores"))["avg"].alias("avg"), scoring.similarity_summary(C("scores"))["min"].alias("min"), scoring.similarity_summary(C("scores"))["max"].alias("max"), C("scores").alias("all")).alias("similarity_scores"),
        F.struct(C("retrieval_ms").alias("retrieval"), C("llm_ms").alias("llm"), (C("retrieval_ms") + C("llm_ms")).alias("total")).alias("latency_ms"), "model", F.length("answer").alias("answer_length_chars"),
    )


def redaction_log(texts: DataFrame, source: str, text: str = "text") -> DataFrame:
    """Audit rows: entity type and count, and the first 80 characters after redaction."""
    e = texts.select(F.explode(X.redaction_counts(C(text))).alias("e"), F.substring(X.redact(C(text)), 1, 80).alias("snippet"))
    return e.select(F.current_timestamp().alias("ts"), F.lit(source).alias("source"), "e.entity_type", "e.occurrences", F.lit("regex").alias("engine"), "snippet")


def append_log(rows: DataFrame, path: str) -> None:
    """Appends rows of `query_log` or `redaction_log` as JSON lines; a stream hands each batch to it."""
    rows.write.mode("append").json(path)


def run_envelope(results: DataFrame, *, mode: str, model: str | None = None) -> DataFrame:
    """One row: run_timestamp, mode, model, cases, rate and the results, ordered by their first column, as run files hold them.

    A run file is one document by its format; runs too large for one are
    written with `write_run`, one row a result.
    """
    first = results.columns[0]
    packed = F.array_sort(F.collect_list(F.struct(first, *[c for c in results.columns if c != first]))).alias("results")
    return results.agg(packed, F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed")).select(F.current_timestamp().alias("run_timestamp"), F.lit(mode).alias("mode"), F.lit(model).cast("string").alias("model"), "total", F.round(F.try_divide(100.0 * C("passed"), "total"), 1).alias("pass_pct"), "results")


def export_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """Those of the columns that exist, as CSV with a header."""
    df.select(*[c for c in columns if c in df.columns]).write.mode("overwrite").option("header", "true").csv(path)


def friendly_error(message: Column) -> Column:
    """Class of a failed upload."""
    m = F.lower(message)
    # What a message contains, in the order in which it is looked for.
    rules = (("file_missing", "file not found"), ("permission", "permission denied"), ("storage_full", "no space left|disk full"), ("timeout", "timeout|timed out"), ("memory", "memory|oom"), ("ocr", "tesseract|ocr"), ("index", "chromadb|vector|embedding"), ("database", "postgres|database|psycopg"), ("model", "groq|llm|api"))
    out = F.lit("other")
    for name, pattern in reversed(rules):
        out = F.when(m.rlike(pattern), name).otherwise(out)
    return out
