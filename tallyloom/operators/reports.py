"""Summaries of whole runs, of judged answers and of checkers, and grouped totals at several levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import numbers

C = F.col


def run_summary(results: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """One row on a run: cases and overall rate, each dimension's total, passed and rate, abstention, hallucination, latency and empty answers.

    results: overall_pass, the dimensions, abstention_expected,
    abstention_accuracy, has_hallucination, latency_ms, empty_answer. Null
    flags don't count in a dimension; in overall_pass they count as failed.
    """
    of = lambda d: [F.count(d).alias(f"{d}_total"), F.count_if(C(d)).alias(f"{d}_passed"), numbers.pass_rate(C(d)).alias(f"{d}_pct")]
    expected = F.coalesce("abstention_expected", F.lit(False))
    ms = F.when(C("latency_ms") != 0, C("latency_ms"))
    return results.agg(
        F.count(F.lit(1)).alias("total_cases"), numbers.pass_rate(F.coalesce("overall_pass", F.lit(False))).alias("overall_pct"), *[x for d in dimensions for x in of(d)],
        F.count_if(expected).alias("to_abstain"), F.count_if(expected & C("abstention_accuracy")).alias("abstained"), F.count_if(~expected & ~C("abstention_accuracy")).alias("false_abstentions"),
        *hallucinations(), F.coalesce(F.round(F.avg(ms)).cast("long"), F.lit(0)).alias("avg_ms"), F.coalesce(F.min(ms), F.lit(0)).alias("min_ms"), F.coalesce(F.max(ms), F.lit(0)).alias("max_ms"), F.count_if("empty_answer").alias("empty_answers"),
    )


def hallucinations(flag: str = "has_hallucination") -> list[Column]:
    """Aggregates: how many answers a judge looked at, and in how many it found something made up."""
    return [F.count(flag).alias("judged"), F.count_if(C(flag)).alias("hallucinated")]


def qualitative(results: DataFrame, *by: str) -> DataFrame:
    """Graded and ungraded cases, pass rate, mean faithfulness and relevance to two decimals, and hallucinations among the graded.

    Graded is what has no error and isn't marked as ungraded.
    """
    ok = F.coalesce("graded", F.lit(True)) & C("error").isNull()
    mean = lambda c: F.round(F.avg(F.when(ok, C(c))), 2).alias(f"mean_{c}")
    passed = F.when(ok, F.coalesce("passed", F.lit(False)))
    return results.groupBy(*by).agg(F.count_if(ok).alias("graded"), F.count_if(~ok).alias("ungraded"), numbers.pass_rate(passed).alias("pass_pct"), mean("faithfulness"), mean("relevance"), F.count_if(ok & C("has_hallucination")).alias("hallucinated"))


def mean_error(results: DataFrame, *by: str, column: str = "relative_error_pct") -> DataFrame:
    """Mean, least and greatest of the known errors, to three decimals, and how many there are."""
    v = C(column)
    return results.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 3).alias("mean"), F.round(F.min(v), 3).alias("least"), F.round(F.max(v), 3).alias("greatest"))


def checker_errors(results: DataFrame, said: Column, true: Column, *by: str) -> DataFrame:
    """False positives and negatives of a checker on labelled cases; unlabelled ones don't count."""
    s = F.coalesce(said, F.lit(False))
    return results.groupBy(*by).agg(F.count(true).alias("labelled"), F.count_if(s & ~true).alias("false_positives"), F.count_if(~s & true).alias("false_negatives"))


def cube(results: DataFrame, columns: Sequence[str], flag: str) -> DataFrame:
    """Totals and rates of every combination of the columns in one pass; `level` tells which are rolled up."""
    return results.cube(*columns).agg(F.count(flag).alias("total"), numbers.pass_rate(C(flag)).alias("accuracy"), F.grouping_id().alias("level"))


def grouping_sets(results: DataFrame, sets: Sequence[Sequence[str]], columns: Sequence[str], flag: str) -> DataFrame:
    """As `cube`, for the given sets of columns only."""
    return results.groupingSets([[C(c) for c in s] for s in sets], *[C(c) for c in columns]).agg(F.count(flag).alias("total"), numbers.pass_rate(C(flag)).alias("accuracy"), F.grouping_id().alias("level"))


def sketches(df: DataFrame, *by: str, distinct: str, value: str) -> DataFrame:
    """Approximate number of different values and quantiles by mergeable sketches (relative error of 1 %)."""
    return df.groupBy(*by).agg(F.approx_count_distinct(distinct, 0.01).alias("about"), F.percentile_approx(value, [0.25, 0.5, 0.75], 10_000).alias("quartiles"))


def standings(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, groups: int = 4) -> DataFrame:
    """Where each row stands in its group: n-tile, percent rank, cumulative share, second value, and the sum of values within a tenth below it."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(*order)
    near = Window.partitionBy(*by).orderBy(value).rangeBetween(-10, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select(
        "*", F.ntile(groups).over(w).alias("tile"), F.round(F.percent_rank().over(w), 6).alias("percent_rank"), F.round(F.cume_dist().over(w), 6).alias("cume_dist"), F.nth_value(value, 2).over(whole).alias("second"), F.count(value).over(near).alias("near_below"),
    )
