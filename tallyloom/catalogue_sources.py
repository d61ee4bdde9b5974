"""Queries over sources: register JSON, instance documents, pages, grids and files, landed from the test tables and read back.

Each query first writes the facts as a source would land them and then reads
them with the operator; the SQL states the rows from the tables themselves.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.catalogue import _VALUED, _joined, _pairs, query
from tallyloom.fixed import PII, TAG_FIELDS
from tallyloom.functions import text as X
from tallyloom.operators import facts, matching, tables
from tallyloom.plans import ingest
from tallyloom.plans.ingest import Page
from tallyloom.session import read_table
from tallyloom.sources import edgar

C = F.col
_SHORT = "split_part(tag, ':', -1)"
_FIELD = f"coalesce(({_pairs(TAG_FIELDS)})[{_SHORT}], lower({_SHORT}[1]) || {_SHORT}[2:])"


def _valued(s, d) -> DataFrame:
    return facts.reported(_joined(s, d), fields=None)


# ---------------------------------------------------------------- register


@query(
    f"""SELECT ticker, name AS company_name, 'us-gaap:' || {_SHORT} AS tag, {_FIELD} AS canonical_field, value,
    CASE WHEN regexp_matches(unit, '^\\s*[A-Za-z0-9:]+\\s*/\\s*[A-Za-z0-9:]+\\s*$') THEN split_part(trim(unit), '/', 1) || '/' || CASE WHEN lower(split_part(trim(unit), '/', 2)) IN ('share', 'shares') THEN 'share' ELSE split_part(trim(unit), '/', 2) END ELSE trim(unit) END AS unit,
    period_start, period_end, form_type, date_diff('day', period_start, period_end)::INT AS duration_days, period_start IS NULL AS is_instant,
    CASE WHEN fact_id % 2 = 0 AND fiscal_period LIKE 'Q%' THEN fiscal_period WHEN fact_id % 2 = 0 THEN fiscal_period ELSE 'FY' || year(period_end) END AS fiscal_period
    FROM ({_VALUED}) WHERE tag IS NOT NULL AND unit IS NOT NULL AND period_end IS NOT NULL AND form_type LIKE '%10-K%'"""
)
def company_facts(s, d):
    """Company facts: every second fact names the filing's own year and period, every third point in time gives `instant` alone."""
    v = _valued(s, d).where("tag is not null and unit is not null")
    named = C("fact_id") % 2 == 0
    alone = C("period_start").isNull() & (C("fact_id") % 3 == 0)
    fact = F.struct(
        C("period_start").cast("string").alias("start"), F.when(~alone, C("period_end").cast("string")).alias("end"), F.when(alone, C("period_end").cast("string")).alias("instant"), C("value").alias("val"),
        F.when(named, F.regexp_extract("fiscal_period", r"(\d{4})$", 1).cast("int")).alias("fy"), F.when(named, F.regexp_extract("fiscal_period", r"^(Q\d|FY)", 1)).alias("fp"), C("form_type").alias("form"),
    )
    entries = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    lists = v.groupBy("ticker", "name", F.element_at(F.split("tag", ":"), -1).alias("t"), "unit").agg(F.collect_list(fact).alias("l"))
    tags = lists.groupBy("ticker", "name", "t").agg(entries("unit", "l").alias("units"))
    landed = tags.groupBy("ticker", "name").agg(entries("t", F.struct("units")).alias("m")).select("ticker", F.to_json(F.struct(C("name").alias("entityName"), F.struct(C("m").alias("us-gaap")).alias("facts"))).alias("json"))
    return edgar.company_facts(landed, "10-K", key="ticker")


@query(
    """WITH z AS (SELECT ticker, name, form_type, filed_date::VARCHAR AS filed, CASE WHEN filing_id % 2 = 0 THEN filed_date::VARCHAR ELSE coalesce(nullif(substring(fiscal_period, length(fiscal_period) - 3), '') || '-12-31', filed_date::VARCHAR) END AS report, filing_id FROM filings JOIN companies USING (company_id) WHERE form_type IN ('10-K', '10-K/A', '20-F', '20-F/A'))
    SELECT ticker, name AS company_name, form_type AS form, filed AS filing_date, report AS report_date, '000' || filing_id || '24' AS accession, 'doc' || filing_id || '.htm' AS document FROM z
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY CASE WHEN coalesce(contains(report, '2023') OR contains(filed, '2023'), contains(report, '2023'), contains(filed, '2023'), false) THEN 0 ELSE 1 END, filing_id) = 1"""
)
def primary_filings(s, d):
    """Submissions: the annual report of 2023 of each company, else its first."""
    f = read_table(s, d, "filings").join(read_table(s, d, "companies").select("company_id", "ticker", "name"), "company_id")
    end = F.concat(F.substring("fiscal_period", -4, 4), F.lit("-12-31"))
    row = F.struct("filing_id", C("form_type").alias("form"), C("filed_date").cast("string").alias("filingDate"), F.when(C("filing_id") % 2 == 0, "").otherwise(end).alias("reportDate"), F.concat(F.lit("000-"), "filing_id", F.lit("-24")).alias("accessionNumber"), F.concat(F.lit("doc"), "filing_id", F.lit(".htm")).alias("primaryDocument"))
    g = f.groupBy("ticker", "name").agg(F.array_sort(F.collect_list(row)).alias("l"))
    recent = F.struct(*[C(f"l.{n}").alias(n) for n in ("form", "filingDate", "reportDate", "accessionNumber", "primaryDocument")])
    landed = g.select("ticker", F.to_json(F.struct("name", F.struct(recent.alias("recent")).alias("filings")), {"ignoreNullFields": "false"}).alias("json"))
    return edgar.primary_filing(landed, "10-K", 2023, key="ticker")


@query(
    """WITH q AS (SELECT lower(ticker) AS query FROM companies WHERE cik IS NOT NULL UNION SELECT split_part(lower(name), ' ', 1) || ' ' || split_part(lower(name), ' ', 2) FROM companies), e AS (SELECT upper(ticker) AS t, lower(name) AS title, lpad(cik, 10, '0') AS cik, company_id FROM companies WHERE cik IS NOT NULL),
    h AS (SELECT query, 1 AS rank, company_id, cik FROM q JOIN e ON upper(trim(query)) = t), f AS (SELECT query, 2, company_id, cik FROM q JOIN e ON contains(title, query) OR contains(query, title) WHERE query NOT IN (SELECT query FROM h))
    SELECT query, cik FROM (SELECT * FROM h UNION ALL SELECT * FROM f) QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank, company_id) = 1"""
)
def cik_lookup(s, d):
    """The register of tickers, asked by tickers and by the first two words of names."""
    c = read_table(s, d, "companies")
    known = c.where("cik is not null")
    names = known.select(F.lower("ticker").alias("query")).union(c.select(F.array_join(F.slice(F.split(F.lower("name"), " "), 1, 2), " "))).distinct()
    sorted_ = F.array_sort(F.collect_list(F.struct("company_id", "ticker", "name", C("cik").cast("long").alias("cik"))))
    landed = known.agg(sorted_.alias("l")).select(F.to_json(F.map_from_entries(F.transform("l", lambda x: F.struct(x["company_id"].cast("string"), F.struct(x["ticker"].alias("ticker"), x["name"].alias("title"), x["cik"].alias("cik_str")))))).alias("json"))
    return edgar.cik_of(names, landed)


@query(
    f"""SELECT 'filing-' || filing_id AS path, 'us-gaap:' || {_SHORT} AS tag, {_FIELD} AS canonical_field, value, CASE WHEN unit IS NULL THEN 'USD' WHEN lower(unit) LIKE '%/share' THEN 'USD/share' ELSE 'EUR' END AS unit, CASE WHEN NOT coalesce(is_instant, false) THEN period_start END AS period_start, period_end,
    CASE WHEN NOT coalesce(is_instant, false) THEN date_diff('day', period_start, period_end)::INT END AS duration_days, coalesce(is_instant, false) OR period_start IS NULL AS is_instant FROM ({_VALUED}) WHERE tag IS NOT NULL AND fact_id % 5 <> 0"""
)
def instance_facts(s, d):
    """Instance documents, one a filing; every fifth fact stands in a context with a segment and is left out."""
    v = _valued(s, d).where("tag is not null")
    x = lambda n, c: F.concat(F.lit(f"<{n}>"), F.coalesce(c.cast("string"), F.lit("")), F.lit(f"</{n}>"))
    point = F.coalesce("is_instant", F.lit(False)) | C("period_start").isNull()
    period = F.when(point, x("instant", C("period_end"))).otherwise(F.concat(x("startDate", C("period_start")), x("endDate", C("period_end"))))
    context = F.concat(F.lit('<context id="c'), "fact_id", F.lit('"><entity>'), F.when(C("fact_id") % 5 == 0, "<segment/>").otherwise(""), F.lit("</entity><period>"), period, F.lit("</period></context>"))
    measure = F.when(F.lower("unit").endswith("/share"), "<divide><measure>iso4217:USD</measure><measure>xbrli:shares</measure></divide>").otherwise("<measure>iso4217:EUR</measure>")
    unit = F.when(C("unit").isNotNull(), F.concat(F.lit('<unit id="u'), "fact_id", F.lit('">'), measure, F.lit("</unit>"))).otherwise("")
    name = F.concat(F.lit("g:"), F.element_at(F.split("tag", ":"), -1))
    fact = F.concat(F.lit("<"), name, F.lit(' contextRef="c'), "fact_id", F.lit('"'), F.when(C("unit").isNotNull(), F.concat(F.lit(' unitRef="u'), "fact_id", F.lit('"'))).otherwise(""), F.lit(">"), C("value").cast("string"), F.lit("</"), name, F.lit(">"))
    body = v.groupBy("filing_id").agg(F.concat_ws("", F.collect_list(F.concat(context, unit, fact))).alias("b"))
    landed = body.select(F.concat(F.lit("filing-"), "filing_id").alias("path"), F.concat(F.lit('<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:g="http://fasb.org/us-gaap/2023">'), "b", F.lit("</xbrl>")).alias("xml"))
    return edgar.instances(landed)


# ---------------------------------------------------------------- pages and grids

_GRID = f"SELECT filing_id, fiscal_period, canonical_field, max(value) AS v FROM ({_VALUED}) WHERE abs(value) >= 1 AND length(trim(canonical_field)) > 0 GROUP BY ALL"
_LINE = r"'| ' || trim(regexp_replace(canonical_field, '\s+', ' ', 'g')) || ' | ' || format('{:,.2f}', v) || ' |'"
_FULL = f"g AS ({_GRID}), n AS (SELECT filing_id FROM g GROUP BY 1 HAVING count(*) >= 3)"


def _grids(s, d) -> DataFrame:
    """filing_id, fiscal_period and the sorted (field, value text) of filings with at least three fields."""
    v = _valued(s, d).where("abs(value) >= 1 and length(trim(canonical_field)) > 0").groupBy("filing_id", "fiscal_period", "canonical_field").agg(F.max("value").alias("v"))
    return v.groupBy("filing_id", "fiscal_period").agg(F.array_sort(F.collect_list(F.struct("canonical_field", F.format_number("v", 2).alias("v")))).alias("l")).where(F.size("l") >= 3)


_PROSE = "The figures below are those of the filing as it was handed in and they were not changed in any way before this page was written for its readers"
_OUT = ("paper_id", "chunk_id", "is_table", "section", "unit_context", "page_number")


def _chunks(files: DataFrame, **how) -> DataFrame:
    return ingest.document_chunks(files, **how).select(*_OUT, F.coalesce("problem", F.lit("")).alias("problem"), F.md5("text").alias("text_md5"), "word_count", "content_hash")


def _files(df: DataFrame, kind: str, ext: str, content) -> DataFrame:
    return df.select(F.concat(F.lit("filing-"), "filing_id").alias("paper_id"), F.lit(ext).alias("file_type"), F.lit(kind).alias("kind"), content.alias("content"))


_HASH = r"substring(sha1(lower(trim(regexp_replace(t, '\s+', ' ', 'g')))), 1, 16) AS content_hash"
_WORDS_OF = r"len(regexp_extract_all(t, '\S+'))::INT AS word_count"


def _table_sql(head: str, tail: str = "") -> str:
    return f"SELECT filing_id, {head} || chr(10) || '| Item | ' || fiscal_period || ' |' || chr(10) || '| --- | --- |' || chr(10) || string_agg({_LINE}, chr(10) ORDER BY canonical_field){tail} AS t FROM g JOIN n USING (filing_id) GROUP BY filing_id, fiscal_period"


@query(
    f"""WITH {_FULL}, x AS (SELECT filing_id, 0 AS chunk_id, false AS is_table, '' AS unit_context, 'Item 8. Statements {_PROSE}' AS t FROM n UNION ALL SELECT filing_id, 1, true, '(in millions)', t FROM ({_table_sql("'[Figures of ' || filing_id || ' (in millions) | Unit Context: in millions]'")}))
    SELECT 'filing-' || filing_id AS paper_id, chunk_id::INT AS chunk_id, is_table, 'Item 8. Statements' AS section, CASE WHEN is_table THEN 'in millions' ELSE '' END AS unit_context, NULL::INT AS page_number, '' AS problem, md5(t) AS text_md5, {_WORDS_OF}, {_HASH} FROM x"""
)
def html_chunks(s, d):
    """Pages with a heading, a paragraph and a table with a caption, as chunks."""
    g = _grids(s, d)
    rows = F.concat_ws("", F.transform("l", lambda x: F.concat(F.lit("<tr><td>"), x["canonical_field"], F.lit('</td><td colspan="2">'), x["v"], F.lit("</td></tr>"))))
    page = F.concat(F.lit(f"<html><head><title>x</title></head><body><h2>Item 8. Statements</h2><p>{_PROSE}</p><table><caption>Figures of "), "filing_id", F.lit(" (in millions)</caption><tr><th>Item</th><th>"), "fiscal_period", F.lit("</th></tr>"), rows, F.lit("</table></body></html>"))
    return _chunks(_files(g, "html", "html", page))


@query(
    f"""WITH {_FULL}, x AS ({_table_sql("'[filing-' || filing_id || ']'")}) SELECT 'filing-' || filing_id AS paper_id, 0::INT AS chunk_id, true AS is_table, '' AS section, '' AS unit_context, NULL::INT AS page_number, '' AS problem, md5(t) AS text_md5, {_WORDS_OF}, {_HASH} FROM x
    UNION ALL SELECT 'filing-' || filing_id, NULL, NULL, NULL, NULL, NULL, 'too_few_rows', NULL, NULL, NULL FROM n"""
)
def csv_chunks(s, d):
    """Delimited files as chunks; files of one line are reported, not lost."""
    g = _grids(s, d)
    lines = F.concat(F.lit("Item,"), "fiscal_period", F.lit("\n"), F.array_join(F.transform("l", lambda x: F.concat(x["canonical_field"], F.lit(',"'), x["v"], F.lit('"'))), "\n"))
    return _chunks(_files(g, "csv", "csv", lines).union(_files(g, "csv", "csv", F.lit("Item,only a head"))))


@query(
    f"""WITH {_FULL}, h AS (SELECT filing_id FROM g GROUP BY 1 HAVING count(*) FILTER (canonical_field < 'n') >= 3 AND count(*) FILTER (canonical_field >= 'n') >= 3), x AS (
    SELECT filing_id, 0 AS chunk_id, false AS is_table, '' AS unit_context, 1 AS page_number, 'Item 8. Statements (in millions) Statement of ' || filing_id AS t FROM h UNION ALL SELECT filing_id, 1, true, 'in millions', 1, t FROM ({_table_sql("'[Statement of ' || filing_id || ' | Unit Context: in millions | Pages: 1-2]'", " || chr(10) || chr(10) || 'Footnotes:' || chr(10) || '- (1) As handed in.'")}) WHERE filing_id IN (SELECT filing_id FROM h)
    UNION ALL SELECT filing_id, 2, false, '', 2, '(1) As handed in.' FROM h UNION ALL SELECT filing_id, 3, false, '', 3, 'Text that was read from a scan, of more than fifty characters in all.' FROM h)
    SELECT 'filing-' || filing_id AS paper_id, chunk_id::INT AS chunk_id, is_table, 'Item 8. Statements' AS section, unit_context, page_number::INT AS page_number, '' AS problem, md5(t) AS text_md5, {_WORDS_OF}, {_HASH} FROM x"""
)
def pdf_chunks(s, d):
    """Scanned pages with boxes: a table that goes on over two pages with caption, units and footnote, and a page that only a text recogniser reads."""
    g = _grids(s, d)
    first, rest = F.filter("l", lambda x: x["canonical_field"] < "n"), F.filter("l", lambda x: x["canonical_field"] >= "n")
    g = g.withColumns({"a": first, "b": rest}).where((F.size("a") >= 3) & (F.size("b") >= 3))
    content = F.to_json(F.struct(C("filing_id"), C("fiscal_period"), C("a"), C("b")))

    def scan(content: str) -> list[Page]:
        x = json.loads(content)
        grid = lambda rows: [["Item", x["fiscal_period"]], *([r["canonical_field"], r["v"]] for r in rows)]
        one = Page(1, [((0, 0, 90, 10), "Item 8.  Statements"), ((0, 40, 90, 50), "(in millions)"), ((0, 60, 90, 70), f"Statement of {x['filing_id']}"), ((5, 110, 20, 120), "a cell, inside")], [((0, 80, 100, 200), grid(x["a"]), [])])
        two = Page(2, [((0, 210, 90, 220), "(1) As handed in.")], [((0, 80, 100, 200), grid(x["b"]), [])])
        return [one, two, Page(3, [], []), Page(4, [], [])]

    read = lambda content, page: "Text that was read from a scan, of more than fifty characters in all." if page == 3 else "too short"
    return _chunks(_files(g, "pdf", "pdf", content), pdf=scan, ocr=read)


@query(
    r"""WITH c AS (SELECT DISTINCT id, content FROM chunks WHERE is_table), l AS (SELECT id, list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^\s*\|.*\|\s*$')) AS l FROM c),
    r AS (SELECT id, list_transform(list_filter(l, lambda x: NOT regexp_matches(x, '^[\s|:-]+$')), lambda x: list_transform(string_split(trim(trim(x), '|'), '|'), lambda y: trim(regexp_replace(y, '\s+', ' ', 'g')))) AS r FROM l)
    SELECT id, len(r) - 1 AS body_rows, len(r[1]) AS columns, array_to_string(r[1], ' / ') AS header, md5(array_to_string(list_transform(r[2:], lambda x: array_to_string(x, ' / ')), ' // ')) AS body_md5 FROM r WHERE len(r) > 1"""
)
def table_grids(s, d):
    """Tables in Markdown as grids: header, body and their size."""
    out = "id string, body_rows long, columns long, header string, body string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = tables.table_block(tables.markdown_grid(content))
                if t and t["rows"]:
                    rows.append((i, len(t["rows"]), len(t["headers"]), " / ".join(t["headers"]), " // ".join(" / ".join(r) for r in t["rows"])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["id", "body_rows", "columns", "header", "body"])

    c = read_table(s, d, "chunks").where("is_table").select("id", "content").distinct()
    return c.mapInArrow(run, out).select("id", "body_rows", "columns", "header", F.md5("body").alias("body_md5"))


@query(
    r"""WITH w AS (SELECT doc_id, text, list_filter(string_split(trim(regexp_replace(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
    p AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 300 THEN 1 ELSE ceil((len(w) - 300) / 270)::INT + 1 END)) AS k FROM w WHERE len(w) > 0),
    t AS (SELECT doc_id, k, w[k * 270 + 1 : k * 270 + 300] AS x FROM p) SELECT doc_id, k::INT AS chunk_id, len(x)::INT AS word_count, md5(array_to_string(x, ' ')) AS text_md5, substring(sha1(lower(array_to_string(x, ' '))), 1, 16) AS content_hash FROM t"""
)
def document_texts(s, d):
    """The ingestion plan over plain texts: the text, size and hash of every chunk."""
    docs = read_table(s, d, "documents").select(C("doc_id").cast("string").alias("paper_id"), F.lit("txt").alias("file_type"), F.lit("text").alias("kind"), C("text").alias("content"))
    return ingest.document_chunks(docs).where("problem is null").select(C("paper_id").cast("long").alias("doc_id"), "chunk_id", "word_count", F.md5("text").alias("text_md5"), "content_hash")


# ---------------------------------------------------------------- redaction


def _planted(text: str, key: str) -> str:
    """A text with one item of every type of personal data, told apart by a number."""
    n = f"lpad(({key} % 1000)::VARCHAR, 3, '0')"
    parts = ["' SSN '", n, "'-45-6789 EIN 12-'", n, "'4567 ref 021'", n, "'021 card 4111 1111 1111 1'", n, "' IBAN DE89370400440532013'", n, "' mail a'", n, "'@b.co call (212) '", n, "'-0199 host 10.0.0.'", f"({key} % 200)::VARCHAR", "' pass C12345'", n, "' Acct: '", n, "'4567 '"]
    return f"coalesce({text}, '') || " + " || ".join(parts)


def _redaction_sql() -> str:
    run, cols = "x0", []
    steps = []
    for k, (name, pattern, mark) in enumerate(PII):
        p = pattern.replace("'", "''")
        cols.append(f"len(regexp_extract_all(x{k}, '{p}')) AS {name.lower()}")
        steps.append(f"regexp_replace(x{k}, '{p}', '{mark}', 'g')")
        run = f"x{k + 1}"
    inner = f"SELECT doc_id, {_planted('text', 'doc_id')} AS x0 FROM documents"
    for k, step in enumerate(steps):
        inner = f"SELECT *, {step} AS x{k + 1} FROM ({inner})"
    return f"SELECT doc_id, md5({run}) AS redacted_md5, {', '.join(cols)} FROM ({inner})"


@query(_redaction_sql())
def redacted_texts(s, d):
    """All texts, with one item of each of the ten types added, redacted; how often each type was replaced."""
    n = F.lpad((C("doc_id") % 1000).cast("string"), 3, "0")
    lit = F.lit
    added = F.concat(F.coalesce("text", lit("")), lit(" SSN "), n, lit("-45-6789 EIN 12-"), n, lit("4567 ref 021"), n, lit("021 card 4111 1111 1111 1"), n, lit(" IBAN DE89370400440532013"), n, lit(" mail a"), n, lit("@b.co call (212) "), n, lit("-0199 host 10.0.0."), (C("doc_id") % 200).cast("string"), lit(" pass C12345"), n, lit(" Acct: "), n, lit("4567 "))
    r = X.redacted(read_table(s, d, "documents").select("doc_id", added.alias("t")), "t").select("doc_id", F.md5("t").alias("redacted_md5"), C("redactions").alias("c"))
    of = lambda name: F.coalesce(F.get(F.filter("c", lambda x: x["entity_type"] == name), lit(0))["occurrences"], lit(0)).cast("long")
    return r.select("doc_id", "redacted_md5", *[of(name).alias(name.lower()) for name, *_ in PII])


# ---------------------------------------------------------------- passages on pages

_TOKENS = r"""list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9.,%$€£''\-]*'), lambda t: regexp_replace(lower(t), '^[.,;:()\[\]''"]+|[.,;:()\[\]''"]+$', '', 'g')), lambda t: t <> '')"""


@query(f"SELECT doc_id, len(t) AS tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL)")
def text_tokens(s, d):
    t = read_table(s, d, "documents").where("text is not null").select("doc_id", matching.tokens(C("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(f"SELECT doc_id::VARCHAR AS key, 1::INT AS run_no, 0::INT AS passage_at, 5::INT AS page_at, 20::INT AS size FROM (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL) WHERE len(t) >= 30 AND len(list_distinct(t[1:45])) = len(t[1:45])")
def passage_runs(s, d):
    """Where twenty tokens of a text stand in it; asked of texts whose first tokens all differ, so that there is one answer."""
    t = read_table(s, d, "documents").where("text is not null").select("doc_id", matching.tokens(C("text")).alias("t")).where((F.size("t") >= 30) & (F.size(F.array_distinct(F.slice("t", 1, 45))) == F.size(F.slice("t", 1, 45))))
    return matching.longest_runs(t.select(C("doc_id").alias("key"), F.array_join(F.slice("t", 6, 20), " ").alias("passage"), F.array_join("t", " ").alias("page")))
