"""Chart specifications inside answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPEC = "type string, title string, x array<string>, series array<struct<name: string, values: array<string>, color: string>>, x_label string, y_label string, currency string"
_PLACES = (r"(?s)```(?:chart_data)\s*\n?(.*?)```", r"(?s)```chart_data\s*\n?(\{.*)\s*$", r"(?s)```(?:json)?\s*\n?(\{\s*\"type\"\s*:.*?\"series\"\s*:.*?)\s*```")


def extract(answer: Column) -> Column:
    """The chart of an answer as a struct, null without one or if it is broken.

    Unknown types become bar, names and title have defaults, values that are
    no numbers become 0. A chart needs a series and labels.
    """
    found = F.coalesce(*[F.nullif(F.regexp_extract(answer, p, 1), F.lit("")) for p in _PLACES])
    j = F.from_json(F.regexp_replace(F.trim(found), r",\s*([\]}])", "$1"), _SPEC)
    kind = F.lower(F.coalesce(j["type"], F.lit("bar")))
    number = lambda v: F.coalesce(F.trim(F.replace(v, F.lit(","), F.lit(""))).try_cast("double"), F.lit(0.0))
    series = F.transform(j["series"], lambda s, i: F.struct(F.coalesce(s["name"], F.concat(F.lit("Series "), i + 1)).alias("name"), F.transform(F.coalesce(s["values"], F.array().cast("array<string>")), number).alias("values"), s["color"].alias("color")))
    chart = F.struct(F.when(kind.isin("bar", "line", "area", "pie"), kind).otherwise("bar").alias("type"), F.coalesce(j["title"], F.lit("Financial Metrics")).alias("title"), j["x"].alias("x"), series.alias("series"), j["x_label"].alias("x_label"), j["y_label"].alias("y_label"), j["currency"].alias("currency"))
    even = F.forall(series, lambda s: F.size(s["values"]) == F.size(j["x"]))
    return F.when(j.isNotNull() & (F.size(F.coalesce(j["series"], F.array().cast("array<struct<name:string,values:array<string>,color:string>>"))) > 0) & (F.size(F.coalesce(j["x"], F.array().cast("array<string>"))) > 0) & even, chart)


def grounded(labels: Column, known_periods: Column) -> Column:
    """Whether any label of the x axis and any known period contain one another, without case, dashes and blanks."""
    n = lambda c: F.regexp_replace(F.upper(c), "[- ]", "")
    return F.exists(labels, lambda a: F.exists(known_periods, lambda p: F.contains(n(a), n(p)) | F.contains(n(p), n(a))))
