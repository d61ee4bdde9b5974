"""Fiscal period labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.fixed import EXPECTED_DAYS, NAME_TICKERS

_QUARTER = r"(?i)^\s*Q([1-4])\s*-?\s*(?:FY\s*)?(\d{4})\s*$"
_YEAR = r"(?i)^\s*(?:FY|CY)\s*-?\s*(\d{4})\s*$"


def _got(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def to_date(c: Column) -> Column:
    """The date in the first ten characters, null if they are none."""
    return F.try_to_date(F.substring(F.trim(c), 1, 10), "yyyy-MM-dd")


def parse_period_label(c: Column) -> Column:
    """struct<kind, quarter, year> of `FY2025`, `Q2FY2026` and the like; null for other texts."""
    q, y = _got(c, _QUARTER, 1), _got(c, _QUARTER, 2)
    fy = _got(c, _YEAR)
    return F.when(q.isNotNull(), F.struct(F.lit("Q").alias("kind"), q.cast("int").alias("quarter"), y.cast("int").alias("year"))).when(fy.isNotNull(), F.struct(F.lit("FY").alias("kind"), F.lit(None).cast("int").alias("quarter"), fy.cast("int").alias("year")))


def expected_days(label: Column) -> Column:
    """Usual length of the labelled period in days, null if the label is none."""
    return F.when(label.rlike(_QUARTER), F.lit(EXPECTED_DAYS["Q"])).when(label.rlike(_YEAR), F.lit(EXPECTED_DAYS["FY"]))


def infer_fiscal_period(end: Column, form: Column, fy: Column | None = None, fp: Column | None = None) -> Column:
    """Label of a period: the filing's own year and period win, then the end date by kind of form."""
    form = F.upper(F.coalesce(form, F.lit("")))
    annual, quarterly = form.rlike("10-K|20-F|40-F|AOC-4"), form.contains("10-Q")
    by_date = F.when(annual, F.concat(F.lit("FY"), F.year(end))).when(quarterly, F.concat(F.lit("Q"), F.quarter(end), F.lit("FY"), F.year(end)))
    if fy is None:
        return by_date
    p = F.upper(F.trim(F.coalesce(fp if fp is not None else F.lit(None).cast("string"), F.lit(""))))
    known = fy.isNotNull() & (fy != 0)
    return F.when(known & p.isin("Q1", "Q2", "Q3", "Q4"), F.concat(p, F.lit("FY"), fy)).when(known & p.isin("FY", "CY") & annual, F.concat(F.lit("FY"), fy)).otherwise(by_date)


def period_from_query(c: Column) -> Column:
    """The period that a question names: a quarter and year, a fiscal year, or a year."""
    t = F.lower(c)
    quarter = r"\bq\s*([1-4])\s*(?:of\s*)?(?:fy\s*|fiscal\s*(?:year\s*)?)?(\d{4})\b"
    q, y = _got(t, quarter, 1), _got(t, quarter, 2)
    return F.coalesce(F.concat(F.lit("Q"), q, F.lit("FY"), y), F.concat(F.lit("FY"), _got(t, r"\b(?:fy|fiscal\s*(?:year\s*)?)\s*(\d{4})\b")), F.concat(F.lit("FY"), _got(t, r"\b(20\d{2})\b")))


def years_mentioned(c: Column) -> Column:
    """All years 20xx that stand alone in a text, in their order."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b(20\d{2})\b"), 1), lambda y: y.cast("int"))


def period_sort_key(label: Column) -> Column:
    """struct<year, within>: a fiscal year sorts as its fourth quarter, other texts first."""
    p = parse_period_label(label)
    return F.struct(F.coalesce(p["year"], F.lit(0)).alias("year"), F.when(p["kind"] == "FY", 4).otherwise(F.coalesce(p["quarter"], F.lit(0))).alias("within"))


def filing_metadata(name: Column) -> Column:
    """struct<ticker, fiscal_period, form_type> read from a document's name."""
    clean = F.lower(name)
    for ext in (".html", ".htm", ".pdf", ".md", ".txt"):
        clean = F.replace(clean, F.lit(ext), F.lit(""))
    clean = F.trim(clean)
    form = F.when(clean.rlike("10-k|[_-]10k"), "10-K").when(clean.rlike("10-q|[_-]10q"), "10-Q").when(clean.rlike("8-k|[_-]8k"), "8-K")
    known = F.create_map(*[F.lit(x) for kv in NAME_TICKERS.items() for x in kv])
    prefix = _got(clean, r"^([a-z]+)[-_]\d{8}")
    end = F.try_to_date(_got(clean, r"^[a-z]+[-_](\d{8})"), "yyyyMMdd")
    annual = F.month(end).isin(6, 9, 12) & (F.dayofmonth(end) >= 25)
    effective = F.coalesce(form, F.when(annual, "10-K").otherwise("10-Q"))
    word = F.lit(None).cast("string")
    for w, t in reversed(NAME_TICKERS.items()):  # the first word of the table wins
        word = F.when(clean.contains(w), F.lit(t)).otherwise(word)
    plain = F.when(clean.rlike("^[a-z]{1,5}$"), F.upper(clean))
    return F.struct(
        F.coalesce(F.element_at(known, clean), F.when(prefix.isNotNull(), F.coalesce(F.element_at(known, prefix), F.upper(prefix))), word, plain).alias("ticker"),
        F.when(F.element_at(known, clean).isNull() & prefix.isNotNull(), infer_fiscal_period(end, effective)).alias("fiscal_period"),
        F.when(F.element_at(known, clean).isNull() & prefix.isNotNull(), effective).otherwise(form).alias("form_type"),
    )
