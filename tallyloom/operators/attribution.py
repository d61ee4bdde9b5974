"""Checking of numbers in free-text answers against a known value, with and without attribution.

Everything is column expressions. The places of numbers, names and periods
come from the texts between the matches of a pattern, and only numbers within
the tolerance are looked at further, each with the lines around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.fixed import DERIVED_FIELDS, DERIVED_SUFFIXES, FIELD_ALIASES, FOLD_FROM, FOLD_TO, MAGNITUDES, NOISE_FLOOR, TOLERANCE, WINDOW_LINES

# How numbers and periods are written.
NUMBER = r"\$?\s*([\d,]+\.?\d*)\s*(?:(trillion|billion|million|thousand|[TBMK])\b)?"
PERIOD = r"\b(FY\s*\d{4}|Q[1-4]\s*FY\s*\d{4}|fiscal\s+\d{4}|(?:fiscal\s+year\s+)?\d{4})\b"
#: Every name with its field, as it reads once a text is folded; of one name the first field counts.
NAMED = {n.translate(str.maketrans(FOLD_FROM, FOLD_TO)): f for f in reversed(FIELD_ALIASES) for n in FIELD_ALIASES[f]}
#: Longer names first, so that "cost of revenue" hides the "revenue" in it.
NAME = "|".join(n.replace(".", r"\.") for n in sorted(NAMED, key=lambda n: (-len(n), n)))
#: Fields that have names of their own, and the derived ones with their base.
BASES = DERIVED_FIELDS | {f: f for f in FIELD_ALIASES}


def resolve_field(name: str | None) -> str:
    """The field with names of its own behind a reported or derived field; '' if there is none."""
    known = BASES.get(name or "")
    if known is None and name:
        known = next((f for f in FIELD_ALIASES for x in DERIVED_SUFFIXES if f + x == name), None)
    return known or ""


def resolved(field: Column) -> Column:
    """`resolve_field` of a column."""
    every = {f + x: f for f in FIELD_ALIASES for x in DERIVED_SUFFIXES} | BASES
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in every.items() for x in kv]), F.coalesce(field, F.lit(""))), F.lit(""))


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of the matches of a pattern, offsets from 0."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("b"), m.alias("m")))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    step = lambda acc, x: F.struct((acc["at"] + x["b"] + F.length(x["m"])).alias("at"), F.array_append(acc["out"], F.struct((acc["at"] + x["b"]).alias("start"), (acc["at"] + x["b"] + F.length(x["m"])).alias("end"), x["m"].alias("found"))).alias("out"))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def nearest(spans: Column, at: Column) -> Column:
    """struct<distance, start, found> of the span next to an offset, the first of equals; null if there is none."""
    return F.array_min(F.transform(spans, lambda p: F.struct(F.greatest(at - p["end"], p["start"] - at, F.lit(0)).alias("distance"), p["start"].alias("start"), p["found"].alias("found"))))


def folded(c: Column) -> Column:
    """The text with its dashes, blanks and quotes folded, and every line end as a line feed."""
    return F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), FOLD_FROM, FOLD_TO), "\\r\\n?|[\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]", "\n")


def _year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\d{4}", 0), F.lit("")).cast("int")


def check_answers(answers: DataFrame, key: str = "result_id", *, tolerance: float = TOLERANCE, attributed: bool = True) -> DataFrame:
    """key, passed, best_match, relative_error_pct, attribution_checked and attribution_match of each answer.

    answers: key, model_answer, ground_truth_value, canonical_field,
    fiscal_period. A number passes if it lies within the tolerance, the nearest
    name in the lines around it is one of the field's, and no other year stands
    nearer than the expected one unless that is named in the same lines. Of
    those that pass the one with the smallest error counts, the first of
    equals. Fields without names, or attributed=False, leave only the
    tolerance. Signs are never read. Null answers and truths don't pass.
    """
    C = F.col
    rows = answers.select(C(key).alias("_key"), folded(C("model_answer")).alias("_t"), C("ground_truth_value").cast("double").alias("_v"), resolved(C("canonical_field")).alias("_own") if attributed else F.lit("").alias("_own"), _year(C("fiscal_period")).alias("_year"))
    found = F.regexp_extract_all("_t", F.lit("(?i)" + NUMBER), 0)
    error = lambda v: F.when(C("_v") != 0, F.abs(v - C("_v")) / F.abs("_v")).otherwise(F.abs(v))
    measured = rows.withColumns({"_n": _scaled("_t"), "_m": found, "_b": F.split("_t", "(?i)" + NUMBER, -1)})
    near = F.filter(F.transform("_n", lambda v, i: F.struct(error(v).alias("err"), i.alias("i"), v.alias("v"))), lambda x: x["v"].isNotNull() & (x["v"] > NOISE_FLOOR) & (x["err"] <= tolerance))
    length = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
    # the offset of a match: all texts before it and all earlier matches
    placed = measured.withColumn("_c", F.transform(near, lambda x: F.struct(x["err"].alias("err"), x["v"].alias("v"), (length(F.slice("_b", 1, x["i"] + 1)) + length(F.slice("_m", 1, x["i"]))).alias("at"))))
    one = placed.select("_key", "_own", "_year", "_t", F.explode_outer("_c").alias("c")).select("_key", "_own", "_year", "_t", "c.*")
    lines = F.split("_t", "\n", -1)
    line = F.length(F.regexp_replace(F.substring("_t", F.lit(1), C("at")), "[^\n]", ""))
    low = F.greatest(line - WINDOW_LINES, F.lit(0))
    before = F.slice(lines, F.lit(1), low)
    one = one.withColumns({"_w": F.when(C("_own") != "", F.array_join(F.slice(lines, low + 1, line - low + 1 + WINDOW_LINES), "\n")), "_at": C("at") - length(before) - low})
    name = nearest(places(C("_w"), "(?i)" + NAME), C("_at"))
    named = F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv])
    one = one.withColumns({"_name": F.when(C("err").isNotNull() & (C("_own") != ""), name["found"]), "_years": F.when(C("_year").isNotNull() & C("err").isNotNull() & (C("_own") != ""), places(C("_w"), "(?i)" + PERIOD))})
    year_ok = (
        C("_years").isNull() | (F.size("_years") == 0)
        | F.exists("_years", lambda p: _year(p["found"]) == C("_year"))
        | (_year(nearest(C("_years"), C("_at"))["found"]) == C("_year"))
    )
    ok = C("err").isNotNull() & ((C("_own") == "") | (F.coalesce(F.element_at(named, F.lower("_name")) == C("_own"), F.lit(False)) & year_ok))
    best = F.min(F.when(ok, F.struct("err", "at", "v", "_name"))).alias("b")
    out = one.groupBy("_key").agg(F.max("_own").alias("_own"), best)
    return out.select(
        C("_key").alias(key), C("b").isNotNull().alias("passed"), C("b.v").alias("best_match"), F.round(C("b.err") * 100, 3).alias("relative_error_pct"), (C("_own") != "").alias("attribution_checked"), C("b._name").alias("attribution_match"),
    )


def _scaled(c: Column | str) -> Column:
    """Array of the values of all matches of NUMBER in a folded text, null where it isn't one."""
    digits, words = (F.regexp_extract_all(c, F.lit("(?i)" + NUMBER), k) for k in (1, 2))
    scale = F.create_map(*[F.lit(x) for kv in MAGNITUDES.items() for x in kv])
    return F.zip_with(digits, words, lambda d, w: F.replace(d, F.lit(","), F.lit("")).try_cast("double") * F.coalesce(F.element_at(scale, F.lower(w)), F.lit(1.0)))


def number_values(c: Column) -> Column:
    """Array of the numbers of a text above the noise floor, scaled by their magnitude words."""
    t = F.translate(F.coalesce(c, F.lit("")), FOLD_FROM, FOLD_TO)
    return F.filter(_scaled(t), lambda v: v.isNotNull() & (v > NOISE_FLOOR))


def unattributed(c: Column, truth: Column) -> Column:
    """Smallest relative error of any number of the text; null if it has none."""
    return F.array_min(F.transform(number_values(c), lambda v: F.when(truth != 0, F.abs(v - truth) / F.abs(truth)).otherwise(F.abs(v))))
