"""What a question asks for: numbers, periods, companies, and whether filings can answer it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.fixed import GENERIC_NAME_WORDS, NUMERIC_INTENT, OUT_OF_SCOPE, QUESTIONS
from tallyloom.functions import periods

C = F.col


def wants_number(question: Column) -> Column:
    return F.coalesce(question.rlike(rf"(?i)\b({NUMERIC_INTENT})\b"), F.lit(False))


def out_of_scope(question: Column) -> Column:
    """Category of the first rule that the question meets, else null."""
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(OUT_OF_SCOPE):
        out = F.when(q.rlike("(?i)" + pattern), F.lit(name)).otherwise(out)
    return out


def future_years(question: Column, latest_end: Column) -> Column:
    """Sorted years named in the question after the year of the latest reported period."""
    return F.array_sort(F.array_distinct(F.filter(periods.years_mentioned(F.lower(question)), lambda y: y > F.year(latest_end))))


def abstention(question: Column, latest_end: Column, attached: Column | None = None) -> Column:
    """Category of a question that must not be answered, else null. Attached documents lift the rule on periods."""
    rule = out_of_scope(question)
    late = latest_end.isNotNull() & (F.size(future_years(question, latest_end)) > 0)
    if attached is not None:
        late = late & ~F.coalesce(attached, F.lit(False))
    return F.coalesce(rule, F.when(late, F.lit("non_existent_period")))


def name_word(name: Column) -> Column:
    """The first word of a company name that identifies it."""
    ws = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("([a-z]{3,})"), 1)
    return F.get(F.filter(ws, lambda w: ~w.isin(*GENERIC_NAME_WORDS)), F.lit(0))


def company_of_question(questions: DataFrame, companies: DataFrame, key: str, text: str) -> DataFrame:
    """key, ticker: the first company by ticker whose ticker or name word stands in the question.

    The words of a question are looked up by hash joins, never against every company.
    """
    names = companies.where("ticker is not null and ticker <> ''").select(F.upper("ticker").alias("ticker"), name_word(C("name")).alias("word"))
    as_is = questions.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9_]+)"), 1))).alias("w"))
    lower = as_is.select(key, F.lower("w").alias("w")).distinct()
    by_ticker = as_is.join(names.select(C("ticker").alias("w"), "ticker").distinct(), "w").select(key, "ticker")
    by_name = lower.join(names.where("word is not null").select(C("word").alias("w"), "ticker").distinct(), "w").select(key, "ticker")
    return by_ticker.union(by_name).groupBy(key).agg(F.min("ticker").alias("ticker"))


def resolve_scope(questions: DataFrame, companies: DataFrame, key: str = "query_id", text: str = "question") -> DataFrame:
    """Ticker and period of each question: as given, else from the document's name, else from its words.

    questions: key, text, and any of paper_id, ticker, fiscal_period.
    """
    have = set(questions.columns)
    col = lambda n: F.nullif(C(n), F.lit("")) if n in have else F.lit(None).cast("string")
    meta = periods.filing_metadata(col("paper_id"))
    q = questions.select(key, C(text).alias("_q"), F.coalesce(col("ticker"), meta["ticker"]).alias("_t"), F.coalesce(col("fiscal_period"), meta["fiscal_period"], periods.period_from_query(C(text))).alias("fiscal_period"))
    found = company_of_question(q, companies, key, "_q")
    return q.join(found, key, "left").select(key, F.coalesce("_t", "ticker").alias("ticker"), "fiscal_period")


def retrieval_scope(ticker: Column, period: Column) -> tuple[Column, Column]:
    """Compound tickers cut at `_`; ranges and relative periods as null."""
    vague = period.contains("_to_") | period.isin("multi_year", "most_recent", "ambiguous_fy_vs_cy")
    return F.element_at(F.split(ticker, "_"), 1), F.when(~vague, period)


def question_text(field: Column, name: Column, ticker: Column, period: Column) -> Column:
    """The question of a field; null for fields without one."""
    template = F.element_at(F.create_map(*[F.lit(x) for kv in QUESTIONS.items() for x in kv]), field)
    for slot, c in (("{name}", name), ("{ticker}", ticker), ("{period}", period)):
        template = F.replace(template, F.lit(slot), c)
    return template
