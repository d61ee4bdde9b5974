"""Summaries of evaluation results: pass rates, dimensions, confusion counts, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import numbers

C = F.col


def status(error: Column, graded: Column, passed: Column) -> Column:
    return F.when(error.isNotNull(), "ERROR").when(~F.coalesce(graded, F.lit(False)), "UNGRADED").when(passed, "PASS").otherwise("FAIL")


def overall(flags: Sequence[Column]) -> Column:
    """True if at least one flag applies and all that apply hold; nulls don't apply."""
    known = F.array_compact(F.array(*flags))
    return (F.size(known) > 0) & F.forall(known, lambda x: x)


def pass_rates(results: DataFrame, *by: str, flag: str = "passed") -> DataFrame:
    """total, passed and accuracy over the rows where the flag is known."""
    return results.groupBy(*by).agg(F.count(flag).alias("total"), F.count_if(C(flag)).alias("passed"), numbers.pass_rate(C(flag)).alias("accuracy"))


def dimension_table(results: DataFrame, dimensions: Sequence[str], *by: str) -> DataFrame:
    """`pass_rates` of each dimension, one row a dimension."""
    return pass_rates(results.unpivot(list(by), list(dimensions), "dimension", "ok"), *by, "dimension", flag="ok")


def score_matrix(results: DataFrame, category: str, dimensions: Sequence[str]) -> DataFrame:
    """Accuracy by category (rows) and dimension (columns); cells without a known flag are null."""
    cell = lambda d: F.when(F.count(d) > 0, numbers.pass_rate(C(d))).alias(d)
    return results.groupBy(category).agg(*[cell(d) for d in dimensions])


def confusion(results: DataFrame, actual: Column, expected: Column) -> DataFrame:
    """One row with the four counts."""
    a, e = F.coalesce(actual, F.lit(False)), F.coalesce(expected, F.lit(False))
    return results.agg(F.count_if(a & e).alias("true_positive"), F.count_if(a & ~e).alias("false_positive"), F.count_if(~a & e).alias("false_negative"), F.count_if(~a & ~e).alias("true_negative"))


def latency(results: DataFrame, *by: str, column: str = "latency_ms") -> DataFrame:
    """Average (whole ms), least and greatest latency; null and 0 don't count."""
    v = F.when(C(column) != 0, C(column))
    return results.groupBy(*by).agg(F.round(F.avg(v)).cast("long").alias("avg_ms"), F.min(v).alias("min_ms"), F.max(v).alias("max_ms"))


def histogram(results: DataFrame, column: str, buckets: Sequence[int]) -> DataFrame:
    """Count of each bucket, with 0 for those that no row falls in."""
    spark = results.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(b) for b in buckets])).alias("bucket"))
    have = results.groupBy(C(column).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(have, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def rollup(results: DataFrame, category: str, flag: str, *more: str) -> DataFrame:
    """Totals and accuracy at every level of a rollup in one pass; `level` is the number of rolled-up columns."""
    return results.rollup(category, *more).agg(F.count(flag).alias("total"), F.count_if(C(flag)).alias("passed"), numbers.pass_rate(C(flag)).alias("accuracy"), F.grouping_id().alias("level"))


def similarity_summary(scores: Column) -> Column:
    """struct<avg, min, max> of an array of scores to four decimals, zeros for an empty one."""
    n = F.size(F.coalesce(scores, F.array().cast("array<double>")))
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / n
    pick = lambda c: F.when(n > 0, F.round(c, 4)).otherwise(F.lit(0.0))
    return F.struct(pick(mean).alias("avg"), pick(F.array_min(scores)).alias("min"), pick(F.array_max(scores)).alias("max"))


def sampled_positions(chunks: DataFrame, document: str, order: str, first: int = 200) -> DataFrame:
    """Three spaced samples of a document's first chunks: those at 0, n/3 and 2n/3."""
    from pyspark.sql import Window

    w = Window.partitionBy(document)
    df = chunks.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).where(C("_i") < first).withColumn("_n", F.count(F.lit(1)).over(w))
    third = F.floor(C("_n") / 3)
    return df.where((C("_i") == 0) | (C("_i") == third) | (C("_i") == F.floor(2 * C("_n") / 3))).drop("_i", "_n")


def filtered(results: DataFrame, *, outcome: str | None = None, category: str | None = None, dimension: str | None = None, text: str | None = None, flag: str = "passed", in_text: str = "question") -> DataFrame:
    """Results of an outcome (pass, fail, abstention, hallucination), a category, with a known dimension, or with a text in the question, whatever its case.

    The flag falls back to `passed` where it is null. Abstention needs
    abstention_expected, hallucination needs has_hallucination.
    """
    df = results
    if outcome in ("pass", "fail"):
        ok = F.coalesce(C(flag), C("passed"), F.lit(False))
        df = df.where(ok if outcome == "pass" else ~ok)
    elif outcome:
        df = df.where(F.coalesce(C({"abstention": "abstention_expected", "hallucination": "has_hallucination"}[outcome]), F.lit(False)))
    if category:
        df = df.where(C("category") == category)
    if dimension:
        df = df.where(C(dimension).isNotNull())
    if text:
        df = df.where(F.contains(F.lower(in_text), F.lit(text.lower())))
    return df


def chosen_cases(cases: DataFrame, *, category: str | None = None, dimension: str | None = None, paper: str | None = None, first: int | None = None, order: str = "id") -> DataFrame:
    """Cases of a category, with a dimension among theirs, of documents whose id holds a text; the first of them by id if a number is given."""
    df = cases
    if category:
        df = df.where(C("category") == category)
    if dimension:
        df = df.where(F.array_contains("eval_dimensions", dimension))
    if paper:
        df = df.where(F.contains(F.lower("paper_id"), F.lit(paper.lower())))
    return df.orderBy(order).limit(first) if first else df


def in_first_appearance(results: DataFrame, category: str, position: str) -> DataFrame:
    """Categories in the order in which they first appear."""
    return results.groupBy(category).agg(F.min(position).alias("first_at")).orderBy("first_at", category)


def weakest_first(results: DataFrame, category: str, flag: str = "passed") -> DataFrame:
    return pass_rates(results, category, flag=flag).orderBy("accuracy", category)
