"""Golden cases, five-dimension scores and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import numbers
from tallyloom.operators import attribution, scoring

C = F.col
# Phrases by which an answer declines.
DECLINES = (
    "i don't have", "i do not have", "not available", "not disclosed", "not provided", "not found", "cannot find", "cannot determine", "no information", "not in the filing", "not in the document",
    "cannot answer", "unable to answer", "not mentioned", "not reported", "does not provide", "does not disclose", "not specified", "not stated", "outside the scope", "not covered", "insufficient information",
    "no data", "no record", "not accessible", "beyond the information", "not part of", "i cannot", "i'm unable", "insufficient context", "please note that", "the filing does not", "do not contain",
    "does not contain", "have not occurred", "has not occurred", "not occurred", "not been filed", "unavailable in", "cannot provide information",
)
# The golden set's question by field, and for other fields.
GOLDEN_QUESTIONS = {
    "revenue": "What was {name}'s ({ticker}) total revenue in {period}?",
    "net_income": "What was the net income for {ticker} in {period}?",
    "operating_income": "What was {ticker}'s operating income in {period}?",
    "gross_profit": "What was {ticker}'s gross profit in {period}?",
    "eps_basic": "What was the basic earnings per share (EPS) for {ticker} in {period}?",
    "operating_cash_flow": "What was the operating cash flow reported by {ticker} for {period}?",
    "long_term_debt": "What was the total long-term debt for {ticker} in {period}?",
    "total_assets": "What was the total asset value reported by {ticker} in {period}?",
}
GOLDEN_OTHER = "What was the {field} for {ticker} in {period}?"
DIMENSIONS = ("retrieval_accuracy", "numerical_accuracy", "calculation_accuracy", "groundedness_accuracy", "abstention_accuracy")
_JUDGE = "faithfulness_score int, relevance_score int, groundedness_score int, has_hallucination boolean, judge_used_fallback boolean, reasoning string"


def declines(answer: Column) -> Column:
    """Whether an answer holds one of the declining phrases."""
    return F.coalesce(F.lower(answer).rlike("|".join(DECLINES)), F.lit(False))


def judge_scores(reply: Column) -> Column:
    """Scores in the first braces of a judge's reply; without any, a fallback that grades nothing."""
    found = F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\{.*?\}", 0), F.lit("")), _JUDGE)
    ok = found.isNotNull() & (found["relevance_score"].isNotNull() | found["groundedness_score"].isNotNull() | found["faithfulness_score"].isNotNull())
    get = lambda n, other: F.when(ok, F.coalesce(found[n], F.lit(other))).otherwise(F.lit(other))
    return F.struct(
        F.when(ok, found["faithfulness_score"]).alias("faithfulness_score"), F.when(ok, found["relevance_score"]).alias("relevance_score"), F.when(ok, found["groundedness_score"]).alias("groundedness_score"),
        F.when(ok, get("has_hallucination", True)).otherwise(F.lit(None).cast("boolean")).alias("has_hallucination"), F.when(ok, get("judge_used_fallback", False)).otherwise(F.lit(True)).alias("judge_used_fallback"),
    )


def questions_in(reply: Column) -> Column:
    """Array of the questions in the first brackets of a reply; empty if there are none."""
    found = F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\[.*?\]", 0), F.lit("")), "array<string>")
    return F.coalesce(found, F.array().cast("array<string>"))


def score_cases(cases: DataFrame, key: str = "id") -> DataFrame:
    """The five nullable dimensions of each case, and overall_pass.

    cases: key, model_answer, ground_truth_value, tolerance_pct, canonical_field,
    fiscal_period, eval_dimensions, abstention_expected, similarities (array)
    and judge (struct of `judge_scores`). Dimensions that a case doesn't name
    are null. A blank answer fails retrieval and leaves the rest null.
    """
    tol = lambda other: F.coalesce(F.nullif(C("tolerance_pct"), F.lit(0.0)), F.lit(other)) / 100
    rows = cases.withColumn("_num_tol", F.when(F.array_contains("eval_dimensions", "numerical_accuracy"), tol(2.0)).otherwise(tol(5.0)))
    # one pass at the widest tolerance; a match is the smallest error, so a narrower tolerance compares that error
    checked = attribution.check_answers(rows, key, tolerance=1.0).select(key, C("relative_error_pct").alias("_err"))
    r = rows.join(checked, key)
    named = lambda d: F.array_contains("eval_dimensions", d)
    blank = ~F.coalesce("model_answer", F.lit("")).rlike(r"(?U)\S")
    expected = F.coalesce("abstention_expected", F.lit(False))
    fallback = F.coalesce(C("judge.judge_used_fallback"), F.lit(True))
    sims = F.coalesce("similarities", F.array().cast("array<double>"))
    mean = F.try_divide(F.aggregate(sims, F.lit(0.0), lambda a, x: a + x), F.size(sims))
    retrieved = (F.size(sims) > 0) & (F.coalesce(mean, F.lit(0.0)) >= 0.3) & (fallback | (F.coalesce(C("judge.relevance_score"), F.lit(0)) >= 3) | expected)
    close = F.coalesce(C("_err") <= C("_num_tol") * 100, F.lit(False))
    has = C("ground_truth_value").isNotNull()
    dims = {
        "retrieval_accuracy": retrieved,
        "numerical_accuracy": F.when(has, close),
        "calculation_accuracy": F.when(has, close).otherwise(~fallback & (F.coalesce(C("judge.faithfulness_score"), F.lit(0)) >= 3)),
        "groundedness_accuracy": F.when(~fallback, (F.coalesce(C("judge.groundedness_score"), F.lit(0)) >= 4) & ~F.coalesce(C("judge.has_hallucination"), F.lit(True))),
        "abstention_accuracy": F.when(expected, declines(C("model_answer"))).otherwise(~declines(C("model_answer"))),
    }
    cols = {d: F.when(named(d), F.when(blank, F.lit(False) if d == "retrieval_accuracy" else F.lit(None).cast("boolean")).otherwise(v)) for d, v in dims.items()}
    return r.select(key, *[v.alias(d) for d, v in cols.items()]).withColumn("overall_pass", scoring.overall([C(d) for d in DIMENSIONS]))


def golden_set(best: DataFrame) -> DataFrame:
    """Quantitative cases from the facts that the golden rule chose, numbered by ticker, period and field."""
    q = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in GOLDEN_QUESTIONS.items() for x in kv]), C("canonical_field")), F.lit(GOLDEN_OTHER))
    for slot, c in (("{name}", C("name")), ("{ticker}", C("ticker")), ("{period}", C("fiscal_period")), ("{field}", F.replace("canonical_field", F.lit("_"), F.lit(" ")))):
        q = F.replace(q, F.lit(slot), c)
    # numbers run over all cases; ranks within a ticker are added to the counts of the earlier tickers
    before = best.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("ticker").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("ticker").orderBy("fiscal_period", "canonical_field"))
    b = best.withColumn("_own", own).join(before, "ticker")
    return b.select(
        F.concat(F.lower("ticker"), F.lit("_"), F.lower("fiscal_period"), F.lit("_"), "canonical_field", F.lit("_"), F.when(C("_before") + C("_own") < 1000, F.lpad((C("_before") + C("_own")).cast("string"), 3, "0")).otherwise((C("_before") + C("_own")).cast("string"))).alias("id"),
        "ticker", "fiscal_period", "canonical_field", q.alias("question"), C("value").alias("ground_truth_value"), C("unit").alias("ground_truth_unit"), numbers.long_money(C("value"), C("canonical_field"), C("unit")).alias("ground_truth_formatted"), "period_end",
    )


def win_counts(pairs: DataFrame, a: str, b: str, margin: float = 0.005) -> DataFrame:
    """How often score a or b is ahead by more than a margin."""
    side = F.when(C(a) > C(b) + margin, "a").when(C(b) > C(a) + margin, "b").otherwise("tie")
    return pairs.where(C(a).isNotNull() & C(b).isNotNull()).groupBy(side.alias("winner")).agg(F.count(F.lit(1)).alias("n"))
