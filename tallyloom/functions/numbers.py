"""Numbers: formatting, changes, errors and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_error(value: Column, truth: Column) -> Column:
    return F.when(truth != 0, F.abs(value - truth) / F.abs(truth)).otherwise(F.abs(value))


def change_pct(before: Column, after: Column) -> Column:
    """Change in per cent of the earlier absolute value; null if that is zero."""
    return F.try_divide(after - before, F.abs(before)) * 100


def short_money(c: Column) -> Column:
    """1.23T, 4.5B, 6.7M with a dollar sign; N/A for null."""
    a = F.abs(c)
    return (
        F.when(c.isNull() | F.isnan(c), "N/A")
        .when(a >= 1e12, F.concat(F.lit("$"), F.format_number(c / 1e12, 2), F.lit("T")))
        .when(a >= 1e9, F.concat(F.lit("$"), F.format_number(c / 1e9, 1), F.lit("B")))
        .when(a >= 1e6, F.concat(F.lit("$"), F.format_number(c / 1e6, 1), F.lit("M")))
        .otherwise(F.concat(F.lit("$"), F.format_number(c, 0)))
    )


def long_money(c: Column, field: Column, unit: Column) -> Column:
    """A figure as a golden case prints it."""
    a = F.abs(c)
    scaled = lambda d, w: F.concat(F.lit("$"), F.replace(F.format_number(c / d, 2), F.lit(","), F.lit("")), F.lit(f" {w} ("), F.format_number(c, 0), F.lit(" "), unit, F.lit(")"))
    return F.when(field == "eps_basic", F.concat(F.lit("$"), F.format_number(c, 2))).when(a >= 1e12, scaled(1e12, "trillion")).when(a >= 1e9, scaled(1e9, "billion")).when(a >= 1e6, scaled(1e6, "million")).otherwise(F.concat(F.format_number(c, 2), F.lit(" "), unit))


def pass_rate(flag: Column) -> Column:
    """Share of true among non-null flags in per cent, one decimal; 0 if there are none (an aggregate)."""
    return F.coalesce(F.round(F.try_divide(100.0 * F.count_if(flag), F.count(flag)), 1), F.lit(0.0))


def accuracy_band(c: Column) -> Column:
    return F.when(c >= 75, "good").when(c >= 50, "fair").otherwise("poor")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two numeric arrays; null if either has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def padded(c: Column, width: int, left: bool = False) -> Column:
    """Padded with blanks, never cut."""
    pad = F.lpad if left else F.rpad
    return F.when(F.length(c) >= width, c).otherwise(pad(c, width, " "))


def fact_line(label: Column, value: Column, unit: Column) -> Column:
    """`label value unit` in columns: two decimals from one up, four below."""
    v = F.when(F.abs(value) >= 1, F.format_number(value, 2)).otherwise(F.regexp_replace(F.format_number(value, 4), ",", ""))
    return F.concat(F.lit("  "), padded(label, 30), F.lit(" "), padded(v, 18, True), F.lit(" "), F.coalesce(unit, F.lit("")))
