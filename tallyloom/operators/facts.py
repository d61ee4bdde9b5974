"""Operators on reported facts: joins, choosers, periods, indicators and keyed writes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.fixed import DEFAULT_FIELDS, TAG_FIELDS
from tallyloom.functions import numbers, periods
from tallyloom.schemas import NATURAL_KEY

C = F.col


def with_filings(facts: DataFrame, filings: DataFrame, companies: DataFrame) -> DataFrame:
    """Facts with their filing's form, label and date and their company's ticker, name and market.

    Dimensions are broadcast where the session's threshold allows, which checks their size.
    """
    fl = filings.select("filing_id", "company_id", "form_type", "fiscal_period", "filed_date")
    co = companies.select("company_id", "ticker", "name", "market")
    return facts.join(fl, "filing_id").join(co, "company_id")


def landed(facts: DataFrame) -> DataFrame:
    """Facts as they are stored: a value that is no number is no value."""
    return facts.withColumn("value", F.when(~F.isnan("value"), C("value")))


def reported(df: DataFrame, *, ticker: str | None = None, fields: Sequence[str] | None = DEFAULT_FIELDS, period: str | None = None, dated: bool = False) -> DataFrame:
    """Facts with a value, and those conditions that are given."""
    tests = [C("value").isNotNull() & ~F.isnan("value")]
    if ticker is not None:
        tests.append(C("ticker") == ticker)
    if fields is not None:
        tests.append(C("canonical_field").isin(*fields))
    if period is not None:
        tests.append(C("fiscal_period") == period)
    if dated:
        tests.append(C("period_end").isNotNull())
    return df.where(reduce(Column.__and__, tests))


def _first(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")


def best_fact(df: DataFrame, rule: str = "reader") -> DataFrame:
    """One fact per ticker, period label and field.

    reader: smallest |duration - usual length| (0 where either is unknown), then
    the latest period end, the longest duration and the largest id. eval: the
    same without the duration. dashboard: an unknown duration counts as -1 day,
    labels that aren't periods come last, ties go by tag. golden: the longest
    span (0 without a start), then the latest end and the larger value.
    """
    usual = periods.expected_days(C("fiscal_period"))
    penalty = F.when(C("duration_days").isNull() | usual.isNull(), F.lit(0)).otherwise(F.abs(C("duration_days") - usual))
    end = C("period_end").desc_nulls_last()
    orders = {
        "reader": [penalty.asc(), end, C("duration_days").desc_nulls_last(), C("fact_id").desc()],
        "eval": [penalty.asc(), end, C("fact_id").desc()],
        "dashboard": [F.abs(F.coalesce("duration_days", F.lit(-1)) - usual).asc_nulls_last(), end, C("tag").asc(), C("fact_id").desc()],
        "golden": [F.coalesce(F.datediff("period_end", "period_start"), F.lit(0)).desc(), end, C("value").desc(), C("fact_id").desc()],
    }
    return _first(df, ["ticker", "fiscal_period", "canonical_field"], orders[rule])


def canonical_field(tag: Column) -> Column:
    """Field of a tag with or without prefix; unknown tags in lower camel case."""
    short = F.element_at(F.split(tag, ":"), -1)
    known = F.create_map(*[F.lit(x) for kv in TAG_FIELDS.items() for x in kv])
    return F.coalesce(F.element_at(known, short), F.concat(F.lower(F.substring(short, 1, 1)), F.substr(short, F.lit(2))))


def available_periods(facts: DataFrame, filings: DataFrame, companies: DataFrame) -> DataFrame:
    """Latest period end of each label of a company, labels without facts included."""
    fl = companies.select("company_id", "ticker").join(filings.select("filing_id", "company_id", "fiscal_period"), "company_id")
    return fl.join(facts.groupBy("filing_id").agg(F.max("period_end").alias("period_end")), "filing_id", "left").groupBy("ticker", "fiscal_period").agg(F.max("period_end").alias("latest_end"))


def nearest_period(df: DataFrame, day: str) -> DataFrame:
    """Per ticker the label whose facts end nearest to a day; ties go to the later end, then the label."""
    by = df.where("period_end is not null").groupBy("ticker", "fiscal_period").agg(F.min(F.abs(F.datediff("period_end", F.lit(day).cast("date")))).alias("days_off"), F.max("period_end").alias("latest_end"))
    return _first(by, ["ticker"], [C("days_off").asc(), C("latest_end").desc(), C("fiscal_period").asc()])


def periods_newest_first(best: DataFrame) -> DataFrame:
    """ticker, fiscal_period, latest_end, place: the labels of a ticker by their latest period end, the newest first, ties by label."""
    by = best.groupBy("ticker", "fiscal_period").agg(F.max("period_end").alias("latest_end"))
    return by.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy(C("latest_end").desc_nulls_last(), C("fiscal_period").asc())))


def periods_of_questions(questions: DataFrame, best: DataFrame, newest: int = 3) -> DataFrame:
    """query_id, ticker, fiscal_period, place: the labels whose facts a question is answered from.

    questions: query_id, ticker, question and, where known, fiscal_period. The
    named period stands alone if the ticker has it. Otherwise labels of the
    years that the question mentions count (all labels if it mentions none),
    quarters only if they are the mentioned one; annual labels pass any
    quarter. If nothing is left, the newest labels count.
    """
    p = periods_newest_first(best)
    label = periods.parse_period_label(C("fiscal_period"))
    asked = F.lower(F.coalesce("question", F.lit("")))
    q = questions.select("query_id", "ticker", C("fiscal_period").alias("_named") if "fiscal_period" in questions.columns else F.lit(None).cast("string").alias("_named"), periods.years_mentioned(asked).alias("_years"), F.nullif(F.regexp_extract(asked, r"\bq([1-4])\b", 1), F.lit("")).cast("int").alias("_quarter"))
    fits = label.isNotNull() & ((F.size("_years") == 0) | F.array_contains("_years", label["year"])) & (C("_quarter").isNull() | (label["kind"] != "Q") | (label["quarter"] == C("_quarter")))
    j = q.join(p, "ticker").withColumn("_rule", F.when(C("fiscal_period") == C("_named"), 0).when(F.coalesce(fits, F.lit(False)), 1).when(C("place") <= newest, 2))
    j = j.where("_rule is not null").withColumn("_best", F.min("_rule").over(Window.partitionBy("query_id")))
    return j.where((C("_rule") == C("_best")) | ((C("_best") == 2) & (C("place") <= newest))).select("query_id", "ticker", "fiscal_period", "place")


def get_or_create(existing: DataFrame, wanted: DataFrame, key: Sequence[str], ident: str) -> DataFrame:
    """The wanted keys with their id: that of the stored row, or one after the greatest id for new ones, in the order of their keys.

    Keys are compared with nulls alike; `created` tells the new ones. New ids
    are ranks within hash buckets added to the counts of the buckets before,
    so no task numbers all rows.
    """
    w = wanted.select(*key).distinct()
    have = existing.groupBy(*key).agg(F.min(ident).alias(ident))
    j = w.alias("l").join(have.alias("r"), same_key(key), "left").select(*[C(f"l.{k}").alias(k) for k in key], C(f"r.{ident}").alias(ident))
    new = j.where(C(ident).isNull()).drop(ident).withColumn("_b", F.pmod(F.xxhash64(*key), F.lit(64)))
    counts = new.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # at most 64 rows
    top = existing.agg(F.coalesce(F.max(ident), F.lit(0)).alias("_top"))  # one row
    ranked = new.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*key))).join(before, "_b").crossJoin(F.broadcast(top))
    made = ranked.select(*key, (C("_top") + C("_before") + C("_r")).cast(dict(existing.dtypes)[ident]).alias(ident), F.lit(True).alias("created"))
    return j.where(C(ident).isNotNull()).withColumn("created", F.lit(False)).unionByName(made)


def latest_and_prior(best: DataFrame) -> DataFrame:
    """Per ticker and field the latest value, the one before and the change in per cent."""
    w = Window.partitionBy("ticker", "canonical_field").orderBy(C("period_end").asc_nulls_first(), C("fiscal_period").asc(), C("fact_id").asc())
    df = best.withColumn("prior_value", F.lag("value").over(w)).withColumn("_back", F.row_number().over(Window.partitionBy("ticker", "canonical_field").orderBy(C("period_end").desc_nulls_last(), C("fiscal_period").desc(), C("fact_id").desc())))
    return df.where("_back = 1").select("ticker", "canonical_field", "fiscal_period", "value", "prior_value", F.round(numbers.change_pct(C("prior_value"), C("value")), 4).alias("prior_delta_pct"))


def wide(best: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per ticker and label with a column for each field."""
    cell = lambda f: F.max(F.when(C("canonical_field") == f, C("value"))).alias(f)
    return best.where(C("canonical_field").isin(*fields)).groupBy("ticker", "fiscal_period").agg(*[cell(f) for f in fields])


def margins(best: DataFrame) -> DataFrame:
    """Gross, net and operating margins of the labels that have revenue, gross profit and net income."""
    w = wide(best, ["revenue", "gross_profit", "net_income", "operating_income"]).where("revenue is not null and gross_profit is not null and net_income is not null")
    pct = lambda c: F.round(F.try_divide(C(c), C("revenue")) * 100, 2)
    return w.select("ticker", "fiscal_period", pct("gross_profit").alias("gross_margin"), pct("net_income").alias("net_margin"), pct("operating_income").alias("operating_margin"))


def trailing(best: DataFrame, quarters: int = 4) -> DataFrame:
    """Sum of the last `quarters` quarterly values of each ticker and field; null until there are as many."""
    q = best.where(C("fiscal_period").rlike("^Q[1-4]FY")).select("ticker", "canonical_field", "fiscal_period", "period_end", "value", "fact_id")
    w = Window.partitionBy("ticker", "canonical_field").orderBy("period_end", "fiscal_period", "fact_id").rowsBetween(1 - quarters, 0)
    return q.select("ticker", "canonical_field", "fiscal_period", F.when(F.count("value").over(w) == quarters, F.round(F.sum("value").over(w), 2)).alias("trailing_sum"))


def keep_earliest(facts: DataFrame) -> DataFrame:
    """One fact per natural key (nulls alike): the one with the smallest id."""
    return _first(facts, list(NATURAL_KEY), [C("fact_id").asc()])


def same_key(key: Sequence[str], left: str = "l", right: str = "r") -> Column:
    return reduce(Column.__and__, [C(f"{left}.{k}").eqNullSafe(C(f"{right}.{k}")) for k in key])


def insert_ignore(existing: DataFrame, new: DataFrame, key: Sequence[str] = NATURAL_KEY, first: str = "fact_id") -> DataFrame:
    """The rows of `new` that an insert without conflict would add: new keys, the first row of each."""
    own = _first(new, list(key), [C(first).asc()])
    return own.alias("l").join(existing.select(*key).distinct().alias("r"), same_key(key), "left_anti")


def visible_facts(facts: DataFrame, filings: DataFrame, user: str) -> DataFrame:
    """Facts of filings that are the user's own or nobody's."""
    own = filings.where((C("user_id") == user) | C("user_id").isNull()).select("filing_id")
    return facts.join(own, "filing_id", "left_semi")


def cascade_delete(facts: DataFrame, filings: DataFrame, company_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Filings and facts that are left when the companies are deleted."""
    fl = filings.join(company_ids.select("company_id"), "company_id", "left_anti")
    gone = filings.join(company_ids.select("company_id"), "company_id", "left_semi").select("filing_id")
    return fl, facts.join(gone, "filing_id", "left_anti")


def context_block(best: DataFrame, companies: DataFrame) -> DataFrame:
    """Per ticker and label the facts as text lines, fields in alphabetical order."""
    line = numbers.fact_line(numbers.title(C("canonical_field")), C("value"), C("unit"))
    rows = best.groupBy("ticker", "fiscal_period").agg(F.array_sort(F.collect_list(F.struct("canonical_field", line.alias("line")))).alias("l"))
    rule = "─" * 62
    return rows.join(companies.select("ticker", "name"), "ticker").select("ticker", "fiscal_period", F.concat(C("name"), F.lit(" ("), C("ticker"), F.lit(") "), C("fiscal_period"), F.lit(f"\n{rule}\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("block"))
