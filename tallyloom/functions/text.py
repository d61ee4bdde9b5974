"""Text expressions: hashes, cells, units, scopes, labels and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.fixed import PII

#: Unicode white space collapses to one blank.
_WHITE = r"(?U)\s+"


def squeeze(c: Column) -> Column:
    """Runs of any white space as one blank, outer blanks cut, null as ''."""
    return F.coalesce(F.trim(F.regexp_replace(c, _WHITE, " ")), F.lit(""))


def content_hash(c: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the squeezed text in lower case."""
    return F.substring(F.sha1(F.lower(squeeze(c)).cast("binary")), 1, 16)


def words_of(c: Column) -> Column:
    """Array of the words between white space; empty for null and blank texts."""
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def statement_scope(c: Column) -> Column:
    t = F.lower(F.coalesce(c, F.lit("")))
    return F.when(t.rlike("parent company only|standalone|unconsolidated|company only"), "standalone").when(t.contains("consolidated"), "consolidated").otherwise("unspecified")


_PER_SHARE = r"except\s+(?:per\s+)?share(?:\s+amounts?|\s+data)?"
# Declarations of units, in the order in which they are tried.
UNIT_PATTERNS = (
    rf"\(?\s*(?:in|amounts?\s+in|dollars?\s+in|\$|usd|rs\.?|inr|eur|gbp)?\s*(?:billions?|millions?|thousands?|crores?|lakhs?)(?:\s*,?\s*{_PER_SHARE})?\s*\)?",
    r"\(?\s*(?:in|amounts?\s+in)?\s*(?:shares|units|percentage|basis\s+points)\s*\)?",
    rf"\(?\s*{_PER_SHARE}\s*\)?",
)


def unit_context(c: Column) -> Column:
    """The first declaration of units under 80 characters, without brackets; null if there is none."""
    found = [F.regexp_replace(F.regexp_extract(c, "(?i)" + p, 0), r"^[()\s]+|[()\s]+$", "") for p in UNIT_PATTERNS]
    return F.coalesce(*[F.when(c.rlike("(?i)" + p) & (F.length(x) < 80), x) for p, x in zip(UNIT_PATTERNS, found)])


def is_footnote(c: Column) -> Column:
    return F.trim(c).rlike(r"(?i)^(?:\*+|\(\s*[\d\w]+\s*\)|\[\s*[\d\w]+\s*\]|note\s*[\d\w]*:?|see accompanying notes)")


def header_key(c: Column) -> Column:
    """Key of a short line: lower case, without page numbers at its ends and without outer dots and dashes."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"^\d{1,4}[\s.·\-–—]+|[\s.·\-–—]+\d{1,4}$", "")
    return F.regexp_replace(F.regexp_replace(t, _WHITE, " "), r"^[ .·\-–—]+|[ .·\-–—]+$", "")


def alnum_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def looks_like_table(c: Column) -> Column:
    """Whether a line of the text separates the head of a Markdown table."""
    return F.coalesce(c, F.lit("")).rlike(r"(?m)^\s*\|(?:\s*:?-{3,}:?\s*\|)+")


def _present(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def source_label(page: Column, section: Column, is_table: Column, caption: Column) -> Column:
    """Where a chunk stands, for people."""
    parts = (F.when(page != 0, F.concat(F.lit("Page "), page)), F.nullif(section, F.lit("")), F.when(is_table, F.coalesce(F.concat(F.lit("Table: "), F.nullif(caption, F.lit(""))), F.lit("Table"))))
    return F.coalesce(F.nullif(F.concat_ws(" | ", *parts), F.lit("")), F.lit("Section not available"))


def provenance(page: Column, section: Column, is_table: Column, caption: Column, units: Column) -> Column:
    """Where a source stands, as a prompt cites it."""
    parts = (
        F.when(page != 0, F.concat(F.lit("Page "), page)),
        F.concat(F.lit("Section: "), _present(section)),
        F.when(is_table, F.concat(F.lit("Table: "), F.coalesce(_present(caption), F.lit("untitled")))),
        F.when(is_table, F.concat(F.lit("Units: "), _present(units))),
    )
    return F.coalesce(F.nullif(F.concat_ws(" | ", *parts), F.lit("")), F.lit("unknown location"))


def citation_label(ticker: Column, form: Column, paper: Column, page: Column, section: Column, is_table: Column) -> Column:
    """Short badge such as `AAPL 10-K · p. 42`."""
    left = F.concat_ws(" ", F.nullif(F.upper(ticker), F.lit("")), F.nullif(F.upper(form), F.lit("")))
    stem = F.regexp_replace(F.coalesce(F.nullif(paper, F.lit("")), F.lit("Document")), r"(?<=.)\.[^.]*$", "")
    right = F.when(page != 0, F.concat(F.lit("p. "), page)).when(F.nullif(section, F.lit("")).isNotNull(), F.substring(section, 1, 28)).when(is_table, "Table").otherwise("source")
    return F.concat(F.coalesce(F.nullif(left, F.lit("")), stem), F.lit(" · "), right)


#: Matches where any type of personal data does; a text without a match needs no pattern of its own.
ANY_PII = "|".join(f"(?:{pattern})" for _, pattern, _ in PII)


def redact(c: Column) -> Column:
    """The text with personal data replaced, each pattern seeing what the earlier ones left."""
    out = c
    for _, pattern, mark in PII:
        out = F.regexp_replace(out, pattern, mark)
    return F.when(c.rlike(ANY_PII), out).otherwise(c)


def redacted(df: DataFrame, column: str) -> DataFrame:
    """`df` with the column redacted and `redactions`, the counts of `redaction_counts`.

    For tables: each pattern is one step of its own, so a text is searched
    twice a pattern, where `redact` and `redaction_counts` beside each other
    start anew for every type.
    """
    have = list(df.columns)
    df = df.withColumn("_t0", F.col(column))
    for k, (name, pattern, mark) in enumerate(PII):
        n = F.regexp_count(f"_t{k}", F.lit(pattern)).alias(f"_n{k}")
        df = df.select(*have, *[f"_n{i}" for i in range(k)], f"_t{k}", n).withColumn(f"_t{k + 1}", F.when(F.col(f"_n{k}") > 0, F.regexp_replace(f"_t{k}", pattern, mark)).otherwise(F.col(f"_t{k}"))).drop(f"_t{k}")
    found = F.array(*[F.struct(F.lit(name).alias("entity_type"), F.coalesce(f"_n{k}", F.lit(0)).alias("occurrences")) for k, (name, *_) in enumerate(PII)])
    return df.select(*[F.col(f"_t{len(PII)}").alias(c) if c == column else F.col(c) for c in have], F.filter(found, lambda x: x["occurrences"] > 0).alias("redactions"))


def redaction_counts(c: Column) -> Column:
    """array<struct<entity_type, occurrences>> of what `redact` replaces; types without any are left out."""
    out, run = [], F.coalesce(c, F.lit(""))
    for name, pattern, mark in PII:
        out.append(F.struct(F.lit(name).alias("entity_type"), F.regexp_count(run, F.lit(pattern)).alias("occurrences")))
        run = F.regexp_replace(run, pattern, mark)
    found = F.filter(F.array(*out), lambda x: x["occurrences"] > 0)
    return F.when(F.coalesce(c, F.lit("")).rlike(ANY_PII), found).otherwise(F.array().cast("array<struct<entity_type:string,occurrences:int>>"))


def clip(c: Column, limit: int, marker: str = "\n...\n") -> Column:
    """Texts over `limit` characters as their first 70 % and last 30 % with a marker between."""
    head = int(limit * 0.7)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(marker), F.substring(c, -(limit - head), limit - head)))


def safe_file_name(c: Column) -> Column:
    """A file name without path and odd characters; unknown extensions become .txt."""
    base = F.element_at(F.split(F.coalesce(c, F.lit("")), r"[/\\]"), -1)
    ext = F.lower(F.regexp_extract(base, r"(\.[A-Za-z0-9]+)$", 1))
    stem = F.regexp_replace(F.regexp_replace(base, r"\.[A-Za-z0-9]+$", ""), r"[^A-Za-z0-9_\-]+", "_")
    stem = F.coalesce(F.nullif(F.substring(F.regexp_replace(stem, r"^_+|_+$", ""), 1, 100), F.lit("")), F.lit("document"))
    return F.concat(stem, F.when(ext.isin(".pdf", ".html", ".htm", ".json", ".csv", ".txt"), ext).otherwise(".txt"))


def upload_problem(name: Column, size: Column, mime: Column, max_mb: int = 100) -> Column:
    """Why a file isn't taken: too_large, mime or extension; null if it is."""
    ext = F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))
    return (
        F.when(size > max_mb * 1024 * 1024, "too_large")
        .when(mime.isNotNull() & (mime != "") & ~mime.isin("application/pdf", "text/html", "application/xhtml+xml", "application/json", "text/csv", "text/plain"), "mime")
        .when(~ext.isin(".pdf", ".html", ".htm", ".json", ".csv", ".txt"), "extension")
    )


def visible_answer(c: Column) -> Column:
    """An answer without chart blocks, closed ones first, then one left open at the end."""
    t = F.regexp_replace(c, r"(?s)```chart_data\s*\n?.*?```", "")
    return F.trim(F.regexp_replace(t, r"(?s)```chart_data.*$", ""), F.lit(" \t\r\n"))
