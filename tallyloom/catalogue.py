"""The catalogue of queries over the driver's tables, each with the SQL that states it.

A query is registered with its SQL; where SQL can't state it (stateful or
positional operators) it has none and is tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.fixed import DEFAULT_FIELDS, DERIVED_SUFFIXES, FIELD_ALIASES, FOLD_FROM, FOLD_TO, GENERIC_NAME_WORDS, MAGNITUDES, NAME_TICKERS, NOISE_FLOOR, NUMERIC_INTENT, OUT_OF_SCOPE, PII, QUESTIONS, TAG_FIELDS, TOLERANCE, WINDOW_LINES
from tallyloom.functions import numbers, periods
from tallyloom.functions import text as X
from tallyloom.operators import attribution, chunking, facts, retrieval, routing, scoring
from tallyloom.session import read_table

C = F.col
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


def _list(words) -> str:
    return ", ".join("'" + str(w).replace("'", "''") + "'" for w in words)


def _pairs(d: dict) -> str:
    text = lambda x: "'" + str(x).replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in d.items()) + "}"


# ---------------------------------------------------------------- facts

_JOINED = "SELECT ff.*, fi.company_id, fi.form_type, fi.fiscal_period, fi.filed_date, c.ticker, c.name, c.market FROM financial_facts ff JOIN filings fi USING (filing_id) JOIN companies c USING (company_id)"
_VALUED = f"SELECT * FROM ({_JOINED}) WHERE value IS NOT NULL AND NOT isnan(value)"
_REPORTED = f"{_VALUED} AND canonical_field IN ({_list(DEFAULT_FIELDS)})"
_USUAL = r"CASE WHEN regexp_matches(fiscal_period, '(?i)^\s*Q[1-4]\s*-?\s*(FY\s*)?\d{4}\s*$') THEN 91 WHEN regexp_matches(fiscal_period, '(?i)^\s*(FY|CY)\s*-?\s*\d{4}\s*$') THEN 365 END"
_PENALTY = f"coalesce(abs(duration_days - ({_USUAL})), 0)"
_BEST_COLUMNS = ["ticker", "fiscal_period", "canonical_field", "value", "unit", "period_end", "duration_days", "fact_id"]


def _best_sql(order: str, source: str = _REPORTED, columns: str = ", ".join(_BEST_COLUMNS)) -> str:
    return f"SELECT {columns} FROM ({source}) QUALIFY row_number() OVER (PARTITION BY ticker, fiscal_period, canonical_field ORDER BY {order}) = 1"


_READER = f"{_PENALTY}, period_end DESC NULLS LAST, duration_days DESC NULLS LAST, fact_id DESC"
_BEST = _best_sql(_READER)


def _joined(s: SparkSession, d: str) -> DataFrame:
    return facts.with_filings(read_table(s, d, "financial_facts"), read_table(s, d, "filings"), read_table(s, d, "companies"))


def _best(s: SparkSession, d: str, rule: str = "reader") -> DataFrame:
    return facts.best_fact(facts.reported(_joined(s, d)), rule)


@query(_BEST)
def best_fact_reader(s, d):
    return _best(s, d).select(*_BEST_COLUMNS)


@query(_best_sql(f"{_PENALTY}, period_end DESC NULLS LAST, fact_id DESC"))
def best_fact_eval(s, d):
    return _best(s, d, "eval").select(*_BEST_COLUMNS)


@query(_best_sql(f"abs(coalesce(duration_days, -1) - ({_USUAL})) NULLS LAST, period_end DESC NULLS LAST, tag, fact_id DESC", f"{_REPORTED} AND period_end IS NOT NULL"))
def best_fact_dashboard(s, d):
    return facts.best_fact(facts.reported(_joined(s, d), dated=True), "dashboard").select(*_BEST_COLUMNS)


@query(_best_sql("coalesce(date_diff('day', period_start, period_end), 0) DESC, period_end DESC NULLS LAST, value DESC, fact_id DESC"))
def best_fact_golden(s, d):
    return _best(s, d, "golden").select(*_BEST_COLUMNS)


@query(f"SELECT ticker, fiscal_period, canonical_field, tag, value, period_end FROM ({_VALUED}) WHERE market = 'US' AND fiscal_period LIKE 'FY%' AND canonical_field IN ('revenue', 'net_income', 'total_assets') AND period_end IS NOT NULL")
def facts_for_ticker_period(s, d):
    df = facts.reported(_joined(s, d), fields=("revenue", "net_income", "total_assets"), dated=True)
    return df.where((C("market") == "US") & C("fiscal_period").startswith("FY")).select("ticker", "fiscal_period", "canonical_field", "tag", "value", "period_end")


@query("SELECT c.ticker, fi.fiscal_period, max(ff.period_end) AS latest_end FROM filings fi JOIN companies c USING (company_id) LEFT JOIN financial_facts ff USING (filing_id) GROUP BY 1, 2")
def available_periods(s, d):
    return facts.available_periods(read_table(s, d, "financial_facts"), read_table(s, d, "filings"), read_table(s, d, "companies"))


@query(f"SELECT ticker, max(period_end) AS latest_end FROM ({_JOINED}) GROUP BY ticker UNION ALL SELECT '*', max(period_end) FROM financial_facts")
def latest_period_end(s, d):
    every = read_table(s, d, "financial_facts").agg(F.max("period_end").alias("latest_end")).select(F.lit("*").alias("ticker"), "latest_end")
    return _joined(s, d).groupBy("ticker").agg(F.max("period_end").alias("latest_end")).union(every)


@query(
    f"""WITH b AS (SELECT ticker, fiscal_period, min(abs(date_diff('day', period_end, DATE '2024-09-28'))) AS days_off, max(period_end) AS latest_end
    FROM ({_JOINED}) WHERE period_end IS NOT NULL GROUP BY 1, 2)
    SELECT ticker, fiscal_period, days_off, latest_end FROM b QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY days_off, latest_end DESC, fiscal_period) = 1"""
)
def nearest_period_to_date(s, d):
    return facts.nearest_period(_joined(s, d), "2024-09-28")


@query(f"SELECT ticker, name, market, form_type, fiscal_period, canonical_field, unit, period_start, period_end, max(value) AS value FROM ({_VALUED}) GROUP BY ALL")
def golden_fact_groups(s, d):
    by = ["ticker", "name", "market", "form_type", "fiscal_period", "canonical_field", "unit", "period_start", "period_end"]
    return facts.reported(_joined(s, d), fields=None).groupBy(*by).agg(F.max("value").alias("value"))


@query(f"SELECT DISTINCT ticker, fiscal_period, canonical_field, tag, value, unit, period_end, duration_days FROM ({_VALUED}) WHERE period_end IS NOT NULL")
def distinct_facts(s, d):
    return facts.reported(_joined(s, d), fields=None, dated=True).select("ticker", "fiscal_period", "canonical_field", "tag", "value", "unit", "period_end", "duration_days").distinct()


@query("SELECT ticker, name, market, sector FROM companies")
def available_companies(s, d):
    return read_table(s, d, "companies").select("ticker", "name", "market", "sector").orderBy("ticker")


@query(
    f"""WITH b AS ({_BEST}), w AS (SELECT *, lag(value) OVER (PARTITION BY ticker, canonical_field ORDER BY period_end NULLS FIRST, fiscal_period, fact_id) AS prior_value,
    row_number() OVER (PARTITION BY ticker, canonical_field ORDER BY period_end DESC NULLS LAST, fiscal_period DESC, fact_id DESC) AS back FROM b)
    SELECT ticker, canonical_field, fiscal_period, value, prior_value, round(CASE WHEN prior_value <> 0 THEN (value - prior_value) / abs(prior_value) * 100 END, 4) AS prior_delta_pct FROM w WHERE back = 1"""
)
def kpi_latest_vs_prior(s, d):
    return facts.latest_and_prior(_best(s, d))


def _pivot_sql(fields) -> str:
    return f"SELECT ticker, fiscal_period, {', '.join(f"max(value) FILTER (canonical_field = '{f}') AS {f}" for f in fields)} FROM ({_BEST}) GROUP BY 1, 2"


@query(
    f"""WITH w AS ({_pivot_sql(("revenue", "gross_profit", "net_income", "operating_income"))})
    SELECT ticker, fiscal_period, round(CASE WHEN revenue <> 0 THEN gross_profit / revenue END * 100, 2) AS gross_margin, round(CASE WHEN revenue <> 0 THEN net_income / revenue END * 100, 2) AS net_margin,
    round(CASE WHEN revenue <> 0 THEN operating_income / revenue END * 100, 2) AS operating_margin FROM w WHERE revenue IS NOT NULL AND gross_profit IS NOT NULL AND net_income IS NOT NULL"""
)
def margin_table(s, d):
    return facts.margins(_best(s, d))


@query(f"WITH b AS ({_BEST}) SELECT ticker, fiscal_period, value AS net_income FROM b WHERE canonical_field = 'net_income' AND (ticker, fiscal_period) IN (SELECT (ticker, fiscal_period) FROM b WHERE canonical_field = 'operating_cash_flow')")
def cashflow_vs_income(s, d):
    b = _best(s, d)
    cash = b.where("canonical_field = 'operating_cash_flow'").select("ticker", "fiscal_period")
    return b.where("canonical_field = 'net_income'").join(cash, ["ticker", "fiscal_period"], "left_semi").select("ticker", "fiscal_period", C("value").alias("net_income"))


_SHORT = "split_part(tag, ':', -1)"


@query(f"SELECT tag, coalesce(({_pairs(TAG_FIELDS)})[{_SHORT}], lower({_SHORT}[1]) || {_SHORT}[2:]) AS field, count(*) AS n FROM financial_facts GROUP BY 1, 2")
def canonicalise_tags(s, d):
    return read_table(s, d, "financial_facts").groupBy("tag", facts.canonical_field(C("tag")).alias("field")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT form_type, period_end, CASE WHEN regexp_matches(upper(form_type), '10-K|20-F|40-F|AOC-4') THEN 'FY' || year(period_end) WHEN contains(upper(form_type), '10-Q') THEN 'Q' || quarter(period_end) || 'FY' || year(period_end) END AS label, count(*) AS n
    FROM ({_JOINED}) GROUP BY ALL"""
)
def infer_fiscal_period(s, d):
    return _joined(s, d).groupBy("form_type", "period_end").agg(F.count(F.lit(1)).alias("n")).select("form_type", "period_end", periods.infer_fiscal_period(C("period_end"), C("form_type")).alias("label"), "n")


_QRE, _FRE = r"(?i)^\s*Q([1-4])\s*-?\s*(?:FY\s*)?(\d{4})\s*$", r"(?i)^\s*(?:FY|CY)\s*-?\s*(\d{4})\s*$"


@query(
    f"""WITH p AS (SELECT DISTINCT fiscal_period AS label FROM (SELECT fiscal_period FROM filings UNION ALL SELECT fiscal_period FROM chunks UNION ALL SELECT fiscal_period FROM documents)),
    x AS (SELECT label, regexp_matches(label, '{_QRE}') AS q, regexp_matches(label, '{_FRE}') AS f FROM p)
    SELECT label, CASE WHEN q THEN 'Q' WHEN f THEN 'FY' END AS kind, CASE WHEN q THEN regexp_extract(label, '{_QRE}', 1)::INT END AS quarter,
    CASE WHEN q THEN regexp_extract(label, '{_QRE}', 2)::INT WHEN f THEN regexp_extract(label, '{_FRE}', 1)::INT END AS year,
    CASE WHEN q THEN regexp_extract(label, '{_QRE}', 2)::INT WHEN f THEN regexp_extract(label, '{_FRE}', 1)::INT ELSE 0 END AS sort_year,
    CASE WHEN q THEN regexp_extract(label, '{_QRE}', 1)::INT WHEN f THEN 4 ELSE 0 END AS sort_within, CASE WHEN q THEN 91 WHEN f THEN 365 END AS usual_days FROM x"""
)
def parse_period_labels(s, d):
    labels = read_table(s, d, "filings").select("fiscal_period").union(read_table(s, d, "chunks").select("fiscal_period")).union(read_table(s, d, "documents").select("fiscal_period")).distinct()
    p, k, c = periods.parse_period_label(C("fiscal_period")), periods.period_sort_key(C("fiscal_period")), C("fiscal_period")
    return labels.select(c.alias("label"), p["kind"].alias("kind"), p["quarter"].alias("quarter"), p["year"].alias("year"), k["year"].alias("sort_year"), k["within"].alias("sort_within"), periods.expected_days(c).alias("usual_days"))


_KEY = "filing_id, tag, unit, period_start, period_end"


@query(f"SELECT fact_id, {_KEY}, CASE WHEN NOT isnan(value) THEN value END AS value FROM financial_facts QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY fact_id) = 1")
def natural_key_dedupe(s, d):
    return facts.keep_earliest(facts.landed(read_table(s, d, "financial_facts"))).select("fact_id", *facts.NATURAL_KEY, "value")


@query(f"SELECT a.fact_id FROM financial_facts a WHERE EXISTS (SELECT 1 FROM financial_facts b WHERE a.fact_id > b.fact_id AND {' AND '.join(f'a.{k} IS NOT DISTINCT FROM b.{k}' for k in facts.NATURAL_KEY)})")
def natural_key_duplicates(s, d):
    f = read_table(s, d, "financial_facts")
    return f.select("fact_id").join(facts.keep_earliest(f).select("fact_id"), "fact_id", "left_anti")


@query(
    f"""WITH o AS (SELECT ff.* FROM financial_facts ff JOIN filings USING (filing_id) WHERE form_type LIKE '10-K%'), n AS (SELECT * FROM financial_facts QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY fact_id) = 1)
    SELECT n.fact_id, n.filing_id, n.tag, CASE WHEN NOT isnan(n.value) THEN n.value END AS value FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE {' AND '.join(f'n.{k} IS NOT DISTINCT FROM o.{k}' for k in facts.NATURAL_KEY)})"""
)
def insert_ignore(s, d):
    """All facts are loaded again where those of annual filings are already stored."""
    f = facts.landed(read_table(s, d, "financial_facts"))
    annual = read_table(s, d, "filings").where(C("form_type").startswith("10-K")).select("filing_id")
    return facts.insert_ignore(f.join(annual, "filing_id", "left_semi"), f).select("fact_id", "filing_id", "tag", "value")


@query("SELECT ff.fact_id, ff.filing_id FROM financial_facts ff WHERE filing_id IN (SELECT filing_id FROM filings WHERE user_id IS NULL OR user_id = (SELECT min(user_id) FROM filings))")
def rls_facts(s, d):
    fl = read_table(s, d, "filings")
    user = fl.agg(F.min("user_id")).first()[0]
    return facts.visible_facts(read_table(s, d, "financial_facts"), fl, user).select("fact_id", "filing_id")


@query(
    """WITH gone AS (SELECT filing_id FROM filings WHERE company_id IN (SELECT company_id FROM companies WHERE market = 'IN'))
    SELECT 'filing' AS kind, filing_id AS id FROM filings WHERE filing_id NOT IN (SELECT filing_id FROM gone) UNION ALL SELECT 'fact', fact_id FROM financial_facts WHERE filing_id NOT IN (SELECT filing_id FROM gone)"""
)
def cascade_delete(s, d):
    fl, ff = facts.cascade_delete(read_table(s, d, "financial_facts"), read_table(s, d, "filings"), read_table(s, d, "companies").where("market = 'IN'"))
    return fl.select(F.lit("filing").alias("kind"), C("filing_id").alias("id")).union(ff.select(F.lit("fact"), "fact_id"))


@query(
    f"""WITH q AS (SELECT * FROM ({_BEST}) WHERE regexp_matches(fiscal_period, '^Q[1-4]FY'))
    SELECT ticker, canonical_field, fiscal_period, CASE WHEN count(value) OVER w = 4 THEN round(sum(value) OVER w, 2) END AS trailing_sum FROM q
    WINDOW w AS (PARTITION BY ticker, canonical_field ORDER BY period_end, fiscal_period, fact_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""
)
def trailing_four_quarters(s, d):
    return facts.trailing(_best(s, d))


@query(
    f"""WITH b AS (SELECT ticker, canonical_field, year(period_end) AS y, value FROM ({_BEST}) WHERE fiscal_period LIKE 'FY%' AND period_end IS NOT NULL),
    e AS (SELECT ticker, canonical_field, min(y) AS y0, max(y) AS y1, arg_min(value, (y, value)) AS v0, arg_max(value, (y, value)) AS v1 FROM b GROUP BY 1, 2)
    SELECT ticker, canonical_field, y0 AS first_year, y1 AS last_year, CASE WHEN y1 > y0 AND v0 > 0 AND v1 > 0 THEN round((pow(v1 / v0, 1.0 / (y1 - y0)) - 1) * 100, 4) END AS cagr_pct FROM e"""
)
def growth_rates(s, d):
    b = _best(s, d).where(C("fiscal_period").startswith("FY") & C("period_end").isNotNull()).select("ticker", "canonical_field", F.year("period_end").alias("y"), "value")
    e = b.groupBy("ticker", "canonical_field").agg(F.min("y").alias("first_year"), F.max("y").alias("last_year"), F.min_by("value", F.struct("y", "value")).alias("v0"), F.max_by("value", F.struct("y", "value")).alias("v1"))
    n = C("last_year") - C("first_year")
    return e.select("ticker", "canonical_field", "first_year", "last_year", F.when((n > 0) & (C("v0") > 0) & (C("v1") > 0), F.round((F.pow(C("v1") / C("v0"), 1.0 / n) - 1) * 100, 4)).alias("cagr_pct"))


@query(f"SELECT form_type, market, count(*) AS facts, count(DISTINCT ticker) AS companies, grouping_id(market, form_type)::BIGINT AS level FROM ({_VALUED}) GROUP BY ROLLUP (market, form_type)")
def facts_rollup(s, d):
    return facts.reported(_joined(s, d), fields=None).rollup("market", "form_type").agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("ticker").alias("companies"), F.grouping_id().alias("level"))


_FACT_LINE = "'  ' || CASE WHEN length(label) >= 30 THEN label ELSE rpad(label, 30, ' ') END || ' ' || CASE WHEN length(v) >= 18 THEN v ELSE lpad(v, 18, ' ') END || ' ' || coalesce(unit, '')"
_LABEL = "array_to_string(list_transform(string_split(replace(canonical_field, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_BLOCKS = f"""SELECT ticker, fiscal_period, any_value(name) || ' (' || ticker || ') ' || fiscal_period || chr(10) || repeat('─', 62) || chr(10) || string_agg({_FACT_LINE}, chr(10) ORDER BY canonical_field) AS block
    FROM (SELECT b.*, c.name, {_LABEL} AS label, CASE WHEN abs(value) >= 1 THEN format('{{:,.2f}}', value) ELSE format('{{:.4f}}', value) END AS v FROM ({_BEST}) b JOIN companies c USING (ticker)) GROUP BY ticker, fiscal_period"""


@query(f"SELECT ticker, fiscal_period, md5(block) AS block_md5, length(block) AS chars FROM ({_BLOCKS})")
def facts_context_block(s, d):
    b = facts.context_block(_best(s, d), read_table(s, d, "companies"))
    return b.select("ticker", "fiscal_period", F.md5("block").alias("block_md5"), F.length("block").cast("long").alias("chars"))


@query(f"SELECT ticker, fiscal_period, canonical_field, replace(replace(replace(({_pairs(QUESTIONS)})[canonical_field], '{{name}}', name), '{{ticker}}', ticker), '{{period}}', fiscal_period) AS question FROM ({_best_sql(_READER, columns='ticker, name, fiscal_period, canonical_field')}) WHERE canonical_field IN ({_list(QUESTIONS)})")
def generated_questions(s, d):
    b = _best(s, d).where(C("canonical_field").isin(*QUESTIONS))
    return b.select("ticker", "fiscal_period", "canonical_field", routing.question_text(C("canonical_field"), C("name"), C("ticker"), C("fiscal_period")).alias("question"))


# ---------------------------------------------------------------- chunks and documents

_JVM_WHITE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _squeezed(col: str) -> str:
    return f"trim(regexp_replace({col}, '{_JVM_WHITE}', ' ', 'g'))"



@query(
    f"""WITH w AS (SELECT doc_id, list_filter(string_split({_squeezed('text')}, ' '), lambda x: x <> '') AS w FROM documents),
    p AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 300 THEN 1 ELSE ceil((len(w) - 300) / 270)::INT + 1 END)) AS chunk_no FROM w WHERE len(w) > 0)
    SELECT doc_id, chunk_no::INT AS chunk_no, len(w[chunk_no * 270 + 1 : chunk_no * 270 + 300])::INT AS word_count, md5(array_to_string(w[chunk_no * 270 + 1 : chunk_no * 270 + 300], ' ')) AS text_md5 FROM p"""
)
def chunk_windows(s, d):
    return chunking.word_windows(read_table(s, d, "documents"), "doc_id", "text").select("doc_id", "chunk_no", "word_count", F.md5("text").alias("text_md5"))


@query(
    f"""WITH h AS (SELECT id, paper_id, substring(sha1(lower({_squeezed('content')})), 1, 16) AS content_hash FROM chunks WHERE content IS NOT NULL GROUP BY ALL),
    k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY paper_id, content_hash ORDER BY id) = 1)
    SELECT id, paper_id, content_hash, (row_number() OVER (PARTITION BY paper_id ORDER BY id) - 1)::INT AS chunk_id FROM k"""
)
def content_hash_dedupe(s, d):
    df = read_table(s, d, "chunks").where("content is not null").select("id", "paper_id", "content").distinct()
    return chunking.first_of_hash(df, "paper_id", "id", "content").select("id", "paper_id", "content_hash", "chunk_id")


@query("SELECT paper_id, ticker, fiscal_period, count(*) AS chunk_count FROM chunks GROUP BY ALL")
def doc_chunk_counts(s, d):
    return read_table(s, d, "chunks").groupBy("paper_id", "ticker", "fiscal_period").agg(F.count(F.lit(1)).alias("chunk_count"))


@query("SELECT DISTINCT paper_id FROM chunks WHERE user_id = (SELECT min(user_id) FROM chunks)")
def user_documents(s, d):
    c = read_table(s, d, "chunks")
    return c.where(C("user_id") == c.agg(F.min("user_id")).first()[0]).select("paper_id").distinct()


_KEYED = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(line)), '^\d{1,4}[\s.·\-–—]+|[\s.·\-–—]+\d{1,4}$', '', 'g'), '[\s\x{A0}]+', ' ', 'g'), '^[ .·\-–—]+|[ .·\-–—]+$', '', 'g')"


@query(
    f"""WITH l AS (SELECT DISTINCT id, paper_id, page_number, content FROM chunks), x AS (SELECT paper_id, page_number, unnest(string_split(content, chr(10))) AS line FROM l),
    s AS (SELECT paper_id, page_number, {_KEYED} AS key FROM x WHERE trim(line) <> '' AND len(list_filter(string_split({_squeezed('line')}, ' '), lambda w: w <> '')) <= 12),
    g AS (SELECT paper_id, key, count(*) AS occurrences, count(DISTINCT page_number) AS pages FROM s WHERE key <> '' GROUP BY 1, 2)
    SELECT paper_id, md5(key) AS key, occurrences, pages FROM g WHERE CASE WHEN pages > 0 THEN pages ELSE occurrences END >= 3"""
)
def boilerplate_lines(s, d):
    c = read_table(s, d, "chunks").select("id", "paper_id", "page_number", "content").distinct()
    lines = c.select("paper_id", "page_number", F.explode(F.split("content", "\n")).alias("line"))
    return chunking.running_lines(lines).select("paper_id", F.md5("key").alias("key"), "occurrences", "pages")


@query("SELECT id, CASE WHEN regexp_matches(lower(content), 'parent company only|standalone|unconsolidated|company only') THEN 'standalone' WHEN contains(lower(content), 'consolidated') THEN 'consolidated' ELSE 'unspecified' END AS scope, regexp_matches(trim(content), '(?i)^(?:\\*+|\\(\\s*[\\d\\w]+\\s*\\)|\\[\\s*[\\d\\w]+\\s*\\]|note\\s*[\\d\\w]*:?|see accompanying notes)') AS footnote FROM chunks WHERE content IS NOT NULL".replace("\\\\", "\\"))
def statement_scope(s, d):
    return read_table(s, d, "chunks").where("content is not null").select("id", X.statement_scope(C("content")).alias("scope"), X.is_footnote(C("content")).alias("footnote"))


def _unit_sql(col: str) -> str:
    got = [f"regexp_replace(regexp_extract({col}, '(?i){p}', 0), '^[()\\s]+|[()\\s]+$', '', 'g')".replace("\\\\", "\\") for p in X.UNIT_PATTERNS]
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({col}, '(?i){p}') AND length({g}) < 80 THEN {g} END" for p, g in zip(X.UNIT_PATTERNS, got)) + ")"


@query(f"SELECT table_caption, {_unit_sql('table_caption')} AS units, count(*) AS n FROM chunks WHERE table_caption <> '' GROUP BY 1, 2")
def unit_context(s, d):
    c = read_table(s, d, "chunks").where("table_caption <> ''").groupBy("table_caption").agg(F.count(F.lit(1)).alias("n"))
    return c.select("table_caption", X.unit_context(C("table_caption")).alias("units"), "n")


@query(r"SELECT id, coalesce(is_table, regexp_matches(content, '(?m)^\s*\|(?:\s*:?-{3,}:?\s*\|)+')) AS is_table FROM chunks WHERE content IS NOT NULL")
def table_backfill(s, d):
    return read_table(s, d, "chunks").where("content is not null").select("id", F.coalesce("is_table", X.looks_like_table(C("content"))).alias("is_table"))


def _redaction_sql() -> str:
    inner = "SELECT doc_id, text AS x0 FROM documents WHERE text IS NOT NULL"
    for k, (_, pattern, mark) in enumerate(PII):  # each pattern sees what the earlier ones left
        inner = f"SELECT *, regexp_replace(x{k}, '{pattern}', '{mark}', 'g') AS x{k + 1} FROM ({inner})"
    each = ", ".join(f"{{'entity_type': '{n}', 'occurrences': len(regexp_extract_all(x{k}, '{p}'))::INT}}" for k, (n, p, _) in enumerate(PII))
    return f"SELECT doc_id, e.entity_type, e.occurrences FROM (SELECT doc_id, unnest([{each}]) AS e FROM ({inner})) WHERE e.occurrences > 0 UNION ALL SELECT -1, 'documents', count(*)::INT FROM documents"


@query(_redaction_sql())
def redaction_counts(s, d):
    docs = read_table(s, d, "documents")
    rows = docs.where("text is not null").select("doc_id", F.explode(X.redaction_counts(C("text"))).alias("e")).select("doc_id", "e.*")
    return rows.union(docs.agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit(-1).cast("long"), F.lit("documents"), "n"))


_META_CLEAN = "trim(replace(replace(replace(replace(replace(lower(paper_id), '.html', ''), '.htm', ''), '.pdf', ''), '.md', ''), '.txt', ''))"


_NAMES_LIST = "[" + ", ".join(f"{{'w': '{w}', 't': '{t}'}}" for w, t in NAME_TICKERS.items()) + "]"
_FILE_NAMES = f"SELECT DISTINCT paper_id FROM chunks UNION SELECT lower(split_part(name, ' ', 1)) || CASE company_id % 4 WHEN 0 THEN '_annual_10k.pdf' WHEN 1 THEN '.htm' WHEN 2 THEN ' tesla 8-K 2020.txt' ELSE '' END FROM companies UNION SELECT lower(ticker) FROM companies UNION SELECT w.w FROM (SELECT unnest({_NAMES_LIST}) AS w) UNION SELECT w.w || '-20230930-10q.html' FROM (SELECT unnest({_NAMES_LIST}) AS w)"


@query(
    rf"""WITH p AS (SELECT paper_id, {_META_CLEAN} AS c FROM ({_FILE_NAMES})), x AS (SELECT *, ({_pairs(NAME_TICKERS)})[c] AS exact, nullif(regexp_extract(c, '^([a-z]+)[-_]\d{{8}}', 1), '') AS prefix, list_filter({_NAMES_LIST}, lambda n: contains(c, n.w))[1].t AS word,
    try_strptime(nullif(regexp_extract(c, '^[a-z]+[-_](\d{{8}})', 1), ''), '%Y%m%d')::DATE AS e, CASE WHEN regexp_matches(c, '10-k|[_-]10k') THEN '10-K' WHEN regexp_matches(c, '10-q|[_-]10q') THEN '10-Q' WHEN regexp_matches(c, '8-k|[_-]8k') THEN '8-K' END AS form FROM p),
    f AS (SELECT *, exact IS NULL AND prefix IS NOT NULL AS dated, coalesce(form, CASE WHEN month(e) IN (6, 9, 12) AND day(e) >= 25 THEN '10-K' ELSE '10-Q' END) AS ff FROM x)
    SELECT paper_id, coalesce(exact, ({_pairs(NAME_TICKERS)})[prefix], upper(prefix), word, CASE WHEN regexp_matches(c, '^[a-z]{{1,5}}$') THEN upper(c) END) AS ticker,
    CASE WHEN dated AND ff = '10-K' THEN 'FY' || year(e) WHEN dated AND ff = '10-Q' THEN 'Q' || quarter(e) || 'FY' || year(e) END AS fiscal_period, CASE WHEN dated THEN ff ELSE form END AS form_type FROM f"""
)
def filename_metadata(s, d):
    """All papers, and names made of company names, tickers and known words."""
    c = read_table(s, d, "companies")
    first = F.lower(F.get(F.split("name", " "), F.lit(0)))
    k = C("company_id") % 4
    made = F.concat(first, F.when(k == 0, "_annual_10k.pdf").when(k == 1, ".htm").when(k == 2, " tesla 8-K 2020.txt").otherwise(""))
    words = s.createDataFrame([(w,) for w in NAME_TICKERS], "paper_id string")
    p = read_table(s, d, "chunks").select("paper_id").union(c.select(made)).union(c.select(F.lower("ticker"))).union(words).union(words.select(F.concat("paper_id", F.lit("-20230930-10q.html")))).distinct()
    return p.select("paper_id", periods.filing_metadata(C("paper_id")).alias("m")).select("paper_id", "m.*")


@query(
    """WITH o AS (SELECT id, any_value(ticker) AS ticker, any_value(word_count) AS word_count, any_value(section) AS section, any_value(is_table) AS is_table, any_value(page_number) AS page FROM (SELECT DISTINCT id, ticker, word_count, section, is_table, page_number FROM chunks) GROUP BY id HAVING count(*) = 1),
    a AS (SELECT * FROM o WHERE NOT is_table), n AS (SELECT id, 'NEW' AS ticker, word_count + 1 AS word_count, 'new ' || section AS section FROM o WHERE page IS NOT NULL)
    SELECT coalesce(a.id, n.id) AS id, CASE WHEN a.id IS NULL THEN n.ticker ELSE a.ticker END AS ticker, CASE WHEN n.id IS NULL THEN a.word_count ELSE n.word_count END AS word_count, CASE WHEN n.id IS NULL THEN a.section ELSE n.section END AS section FROM a FULL JOIN n ON a.id = n.id"""
)
def upsert_chunks(s, d):
    """Stored texts meet a new delivery of all chunks with a page: texts among them are updated, tables are added."""
    columns = ("ticker", "word_count", "section", "is_table", "page_number")
    o = read_table(s, d, "chunks").select("id", *columns).distinct()
    one = o.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *[F.any_value(c).alias(c) for c in columns]).where("n = 1")
    old = one.where("not is_table").select("id", "ticker", "word_count", "section")
    new = one.where("page_number is not null").select("id", F.lit("NEW").alias("ticker"), (C("word_count") + 1).alias("word_count"), F.concat(F.lit("new "), "section").alias("section"))
    return chunking.upsert(old, new)


@query(
    """SELECT id, CASE WHEN coalesce(upper(ticker), '') || coalesce(upper(form_type), '') = '' THEN regexp_replace(paper_id, '(.)\\.[^.]*$', '\\1') ELSE concat_ws(' ', nullif(upper(ticker), ''), nullif(upper(form_type), '')) END || ' · ' ||
    CASE WHEN page_number <> 0 THEN 'p. ' || page_number WHEN section <> '' THEN substring(section, 1, 28) WHEN is_table THEN 'Table' ELSE 'source' END AS label,
    coalesce(nullif(concat_ws(' | ', CASE WHEN page_number <> 0 THEN 'Page ' || page_number END, nullif(section, ''), CASE WHEN is_table THEN coalesce('Table: ' || nullif(table_caption, ''), 'Table') END), ''), 'Section not available') AS place FROM chunks"""
)
def citation_labels(s, d):
    c = read_table(s, d, "chunks")
    return c.select("id", X.citation_label(C("ticker"), C("form_type"), C("paper_id"), C("page_number"), C("section"), C("is_table")).alias("label"), X.source_label(C("page_number"), C("section"), C("is_table"), C("table_caption")).alias("place"))


@query(
    """WITH r AS (SELECT paper_id, id, page_number, section, is_table, table_caption, unit_context, content, row_number() OVER (PARTITION BY paper_id ORDER BY id) AS rank FROM (SELECT DISTINCT id, paper_id, page_number, section, is_table, table_caption, unit_context, content FROM chunks)),
    b AS (SELECT paper_id, rank, '[Source ' || rank || ' | Document: ' || coalesce(nullif(paper_id, ''), 'Unknown Document') || ' | ' || coalesce(nullif(concat_ws(' | ', CASE WHEN page_number <> 0 THEN 'Page ' || page_number END, 'Section: ' || nullif(trim(section), ''),
    CASE WHEN is_table THEN 'Table: ' || coalesce(nullif(trim(table_caption), ''), 'untitled') END, CASE WHEN is_table THEN 'Units: ' || nullif(trim(unit_context), '') END), ''), 'unknown location') || ']' || chr(10) || trim(content) AS t FROM r WHERE rank <= 3)
    SELECT paper_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM b GROUP BY 1"""
)
def context_format(s, d):
    c = read_table(s, d, "chunks").select("id", "paper_id", "page_number", "section", "is_table", "table_caption", "unit_context", "content").distinct()
    top = c.withColumn("rank", F.row_number().over(Window.partitionBy("paper_id").orderBy("id"))).where("rank <= 3")
    top = top.withColumn("doc", C("paper_id"))
    return retrieval.format_context(top, "doc").select(C("doc").alias("paper_id"), F.md5("context").alias("context_md5"))


# ---------------------------------------------------------------- vectors

_V0 = "(SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"
_SIM = f"list_inner_product(embedding::DOUBLE[], {_V0}::DOUBLE[]) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_inner_product({_V0}::DOUBLE[], {_V0}::DOUBLE[]))"


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    """Vectors with metadata from their label, and the first of them as the question."""
    e = read_table(s, d, "embeddings").withColumns({"is_table": C("label") % 2 == 0, "statement_scope": F.when(C("label") % 3 == 0, "consolidated").otherwise("unspecified"), "fiscal_period": F.concat(F.lit("FY"), 2020 + C("label") % 5), "ticker": F.upper(F.concat(F.lit("t"), C("label") % 4)), "paper_id": F.concat(F.lit("p"), C("label"))})
    return e, e.orderBy("vec_id").select("embedding").first()[0]


_EMB = "SELECT *, label % 2 = 0 AS is_table, CASE WHEN label % 3 = 0 THEN 'consolidated' ELSE 'unspecified' END AS statement_scope, 'FY' || (2020 + label % 5) AS fiscal_period, 'T' || (label % 4) AS ticker FROM embeddings"


def _topk_sql(where: str, k: int) -> str:
    return f"SELECT vec_id, similarity FROM (SELECT vec_id, round(sim, 4) AS similarity FROM (SELECT vec_id, {_SIM} AS sim FROM ({_EMB}) WHERE {where}) ORDER BY sim DESC, vec_id LIMIT {k})"


@query(_topk_sql("true", 10))
def vector_topk(s, d):
    e, v = _vectors(s, d)
    return retrieval.top_k(e, v, 10, key="vec_id").select("vec_id", "similarity")


@query(_topk_sql("ticker = 'T1' AND fiscal_period = 'FY2021' AND NOT is_table", 10))
def vector_topk_filtered(s, d):
    e, v = _vectors(s, d)
    return retrieval.top_k(e, v, 10, where=retrieval.metadata_filter(ticker="t1", period="FY2021", is_table=False), key="vec_id").select("vec_id", "similarity")


@query(f"SELECT * FROM ({_topk_sql('is_table', 50)}) UNION ALL SELECT * FROM ({_topk_sql('NOT is_table', 5)})")
def vector_table_first(s, d):
    e, v = _vectors(s, d)
    return retrieval.table_first(e, v, 5, key="vec_id").select("vec_id", "similarity")


_LEVELS = ["ticker = 'T2' AND fiscal_period = 'FY2024' AND statement_scope = 'standalone' AND is_table", "ticker = 'T2' AND fiscal_period = 'FY2024' AND is_table", "ticker = 'T2' AND is_table", "ticker = 'T2' AND fiscal_period = 'FY2024' AND statement_scope = 'standalone'"]


@query(
    f"""WITH e AS ({_EMB}), l AS (SELECT CASE {' '.join(f'WHEN EXISTS (SELECT 1 FROM e WHERE {c}) THEN {i}' for i, c in enumerate(_LEVELS))} END AS level)
    SELECT vec_id, similarity, level FROM (SELECT vec_id, round({_SIM}, 4) AS similarity, {_SIM} AS sim, level FROM e, l WHERE CASE level {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(_LEVELS))} END ORDER BY sim DESC, vec_id LIMIT 5)"""
)
def vector_ladder(s, d):
    e, v = _vectors(s, d)
    levels = retrieval.relaxation(ticker="T2", period="FY2024", scope="standalone", is_table=True)
    return retrieval.ladder(e, v, 5, levels, key="vec_id").select("vec_id", "similarity", "level")


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm FROM embeddings")
def vector_norms(s, d):
    e = read_table(s, d, "embeddings")
    return e.select("vec_id", F.round(F.sqrt(numbers.dot(C("embedding"), C("embedding"))), 4).alias("norm"))


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, list_inner_product(embedding::DOUBLE[], v) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_inner_product(v, v)) AS sim FROM embeddings, q)
    SELECT query_id, vec_id, rank::INT AS rank, round(sim, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
)
def vector_topk_of_each(s, d):
    e = read_table(s, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(C("vec_id").alias("query_id"), C("embedding").alias("vector"))
    return retrieval.top_k_of_each(e, q, 5, key="vec_id")


@query("(SELECT DISTINCT 'both' AS side, paper_id FROM chunks WHERE is_table INTERSECT SELECT DISTINCT 'both', paper_id FROM chunks WHERE NOT is_table) UNION ALL (SELECT 'tables only', paper_id FROM chunks WHERE is_table EXCEPT SELECT 'tables only', paper_id FROM chunks WHERE NOT is_table) UNION ALL (SELECT 'texts only', paper_id FROM chunks WHERE NOT is_table EXCEPT SELECT 'texts only', paper_id FROM chunks WHERE is_table)")
def papers_intersect_except(s, d):
    c = read_table(s, d, "chunks")
    t, x = c.where("is_table").select("paper_id"), c.where("not is_table").select("paper_id")
    side = lambda df, n: df.select(F.lit(n).alias("side"), "paper_id")
    return side(t.intersect(x), "both").union(side(t.subtract(x), "tables only")).union(side(x.subtract(t), "texts only"))


# ---------------------------------------------------------------- questions and answers

_NUMERIC_RE = rf"(?i)\b({NUMERIC_INTENT})\b"
_SCOPE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(trim(question)), '(?i){p}') THEN '{n}'" for n, p in OUT_OF_SCOPE) + " END"


@query(f"SELECT result_id, coalesce(regexp_matches(question, '{_NUMERIC_RE}'), false) AS numeric, {_SCOPE_SQL} AS out_of_scope FROM eval_results")
def question_intent(s, d):
    return read_table(s, d, "eval_results").select("result_id", routing.wants_number(C("question")).alias("numeric"), routing.out_of_scope(C("question")).alias("out_of_scope"))


_PFQ = (r"\bq\s*([1-4])\s*(?:of\s*)?(?:fy\s*|fiscal\s*(?:year\s*)?)?(\d{4})\b", r"\b(?:fy|fiscal\s*(?:year\s*)?)\s*(\d{4})\b", r"\b(20\d{2})\b")
_PERIOD_SQL = f"coalesce('Q' || nullif(regexp_extract(lower(question), '{_PFQ[0]}', 1), '') || 'FY' || regexp_extract(lower(question), '{_PFQ[0]}', 2), 'FY' || nullif(regexp_extract(lower(question), '{_PFQ[1]}', 1), ''), 'FY' || nullif(regexp_extract(lower(question), '{_PFQ[2]}', 1), ''))"


@query(
    f"""SELECT result_id, {_PERIOD_SQL} AS period,
    len(list_distinct(list_filter(regexp_extract_all(lower(coalesce(question, '')), '{_PFQ[2]}', 1)::INT[], lambda y: y > 2021)))::INT AS future_years FROM eval_results"""
)
def question_periods(s, d):
    q = read_table(s, d, "eval_results")
    return q.select("result_id", periods.period_from_query(C("question")).alias("period"), F.size(routing.future_years(F.coalesce("question", F.lit("")), F.lit("2021-12-31").cast("date"))).alias("future_years"))


_GENERIC_LIST = f"[{_list(GENERIC_NAME_WORDS)}]"


@query(
    f"""WITH c AS (SELECT upper(ticker) AS ticker, list_filter(regexp_extract_all(lower(name), '([a-z]{{3,}})', 1), lambda w: NOT list_contains({_GENERIC_LIST}, w))[1] AS word FROM companies WHERE ticker <> ''),
    w AS (SELECT result_id, unnest(list_distinct(regexp_extract_all(question, '([A-Za-z0-9_]+)', 1))) AS w FROM eval_results WHERE question IS NOT NULL)
    SELECT result_id, min(c.ticker) AS ticker FROM w JOIN c ON w.w = c.ticker OR lower(w.w) = c.word GROUP BY 1"""
)
def ticker_from_question(s, d):
    return routing.company_of_question(read_table(s, d, "eval_results"), read_table(s, d, "companies"), "result_id", "question")


_NUM_SQL = r"(?i)\$?\s*([\d,]+\.?\d*)\s*(?:(trillion|billion|million|thousand|[TBMK])\b)?"
_FOLDED = "translate(model_answer, '" + FOLD_FROM.replace("'", "''") + "', '" + FOLD_TO.replace("'", "''") + "')"


@query(
    f"""WITH n AS (SELECT result_id, ground_truth_value AS t, regexp_extract_all({_FOLDED}, '{_NUM_SQL}', 1) AS d, regexp_extract_all({_FOLDED}, '{_NUM_SQL}', 2) AS u FROM eval_results WHERE model_answer IS NOT NULL),
    v AS (SELECT result_id, t, list_filter(list_transform(range(1, len(d) + 1), lambda i: TRY_CAST(replace(d[i], ',', '') AS DOUBLE) * CASE lower(u[i]) WHEN 'trillion' THEN 1e12 WHEN 't' THEN 1e12 WHEN 'billion' THEN 1e9 WHEN 'b' THEN 1e9 WHEN 'million' THEN 1e6 WHEN 'm' THEN 1e6 WHEN 'thousand' THEN 1e3 WHEN 'k' THEN 1e3 ELSE 1 END), lambda x: x > 0.01) AS v FROM n)
    SELECT result_id, len(v)::INT AS numbers, round(list_max(v), 2) AS largest, round(list_min(list_transform(v, lambda x: CASE WHEN t <> 0 THEN abs(x - t) / abs(t) ELSE abs(x) END)) * 100, 3) AS best_error_pct FROM v"""
)
def number_check(s, d):
    r = read_table(s, d, "eval_results").where("model_answer is not null")
    v = attribution.number_values(C("model_answer"))
    return r.select("result_id", F.size(v).alias("numbers"), F.round(F.array_max(v), 2).alias("largest"), F.round(attribution.unattributed(C("model_answer"), C("ground_truth_value")) * 100, 3).alias("best_error_pct"))


_ERR = "CASE WHEN truth <> 0 THEN abs({0} - truth) / abs(truth) ELSE abs({0}) END"
_SCALE = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in MAGNITUDES.items())
_BASES = {f + x: f for f in FIELD_ALIASES for x in DERIVED_SUFFIXES} | attribution.BASES


def _quoted(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


def _places_sql(source: str, text: str, pattern: str, keep: str) -> str:
    """One row a match of a pattern: its number, start and end (from 0) and text."""
    parts = f"SELECT {keep}, {text} AS pt, regexp_extract_all({text}, {_quoted(pattern)}, 0) AS pm, regexp_split_to_array({text}, {_quoted(pattern)}) AS pb FROM {source}"
    each = f"SELECT {keep}, pm, pb, unnest(range(1, len(pm) + 1)) AS i FROM ({parts})"
    return f"SELECT {keep}, i, pm[i] AS found, list_sum(list_transform(pb[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(pm[1:i - 1], lambda x: length(x))), 0) AS start_at FROM ({each})"


def _attributed_sql(tolerance: float = TOLERANCE) -> str:
    return f"""WITH a AS (SELECT result_id, {_FOLDED.replace('model_answer', "coalesce(model_answer, '')")} AS t, ground_truth_value AS truth, coalesce(({_pairs(_BASES)})[canonical_field], '') AS own, nullif(regexp_extract(fiscal_period, '[0-9]{{4}}', 0), '')::INT AS y FROM eval_results),
    n AS (SELECT *, TRY_CAST(replace(regexp_extract(found, {_quoted(attribution.NUMBER)}, 1), ',', '') AS DOUBLE) * CASE lower(regexp_extract(found, {_quoted(attribution.NUMBER)}, 2)) {_SCALE} ELSE 1.0 END AS v FROM ({_places_sql('a', 't', attribution.NUMBER, 'result_id, t, truth, own, y')})),
    c AS (SELECT result_id, t, own, y, v, {_ERR.format('v')} AS err, start_at::INT AS pos, length(regexp_replace(substring(t, 1, start_at::INT), '[^\n]', '', 'g')) AS line FROM n WHERE v > {NOISE_FLOOR} AND {_ERR.format('v')} <= {tolerance}),
    w AS (SELECT *, greatest(line - {WINDOW_LINES}, 0) AS low FROM c), x AS (SELECT *, array_to_string(string_split(t, chr(10))[low + 1 : line + {WINDOW_LINES} + 1], chr(10)) AS win, pos - coalesce(list_sum(list_transform(string_split(t, chr(10))[1:low], lambda q: length(q))), 0) - low AS rel FROM w),
    nm AS (SELECT result_id, pos, found, row_number() OVER (PARTITION BY result_id, pos ORDER BY greatest(rel - start_at - length(found), start_at - rel, 0), start_at) AS k FROM ({_places_sql('x', 'win', attribution.NAME, 'result_id, pos, rel')})),
    yr AS (SELECT result_id, pos, bool_or(yy = y) AS has, arg_min(yy, (greatest(rel - start_at - length(found), start_at - rel, 0), start_at)) = any_value(y) AS nearest FROM (SELECT *, regexp_extract(found, '[0-9]{{4}}', 0)::INT AS yy FROM ({_places_sql('x', 'win', attribution.PERIOD, 'result_id, pos, rel, y')})) GROUP BY 1, 2),
    ok AS (SELECT x.result_id, x.err, x.pos, x.v, CASE WHEN own <> '' THEN nm.found END AS name FROM x LEFT JOIN nm ON nm.result_id = x.result_id AND nm.pos = x.pos AND nm.k = 1 LEFT JOIN yr ON yr.result_id = x.result_id AND yr.pos = x.pos
    WHERE own = '' OR (coalesce(({_pairs(attribution.NAMED)})[lower(nm.found)] = own, false) AND (x.y IS NULL OR yr.has IS NULL OR yr.has OR yr.nearest))),
    b AS (SELECT result_id, arg_min((v, err, name), (err, pos)) AS b FROM (SELECT result_id, v, err, pos, coalesce(name, '') AS name FROM ok) GROUP BY 1)
    SELECT a.result_id, b.b IS NOT NULL AS passed, b.b[1] AS best_match, round(b.b[2] * 100, 3) AS relative_error_pct, own <> '' AS attribution_checked, nullif(b.b[3], '') AS attribution_match FROM a LEFT JOIN b USING (result_id)"""


@query(_attributed_sql())
def attributed_check(s, d):
    return attribution.check_answers(read_table(s, d, "eval_results"))


# ---------------------------------------------------------------- evaluation reports

_RATE = "coalesce(round(100.0 * count_if({0}) / nullif(count({0}), 0), 1), 0)"


@query(f"SELECT ticker, count(passed) AS total, count_if(passed)::BIGINT AS passed, {_RATE.format('passed')} AS accuracy FROM eval_results WHERE error IS NULL GROUP BY 1")
def pass_rate_by_ticker(s, d):
    return scoring.pass_rates(read_table(s, d, "eval_results").where("error is null"), "ticker")


_DIMS = ("passed", "attribution_checked", "attribution_match")


@query(" UNION ALL ".join(f"SELECT mode, '{x}' AS dimension, count({x}) AS total, count_if({x})::BIGINT AS passed, {_RATE.format(x)} AS accuracy FROM eval_results GROUP BY mode" for x in _DIMS))
def dimension_accuracy(s, d):
    return scoring.dimension_table(read_table(s, d, "eval_results"), _DIMS, "mode")


@query("SELECT canonical_field, " + ", ".join(f"CASE WHEN count({x}) > 0 THEN {_RATE.format(x)} END AS {x}" for x in _DIMS) + " FROM eval_results GROUP BY 1")
def score_matrix(s, d):
    return scoring.score_matrix(read_table(s, d, "eval_results"), "canonical_field", _DIMS)


@query("SELECT count_if(a AND e)::BIGINT AS true_positive, count_if(a AND NOT e)::BIGINT AS false_positive, count_if(NOT a AND e)::BIGINT AS false_negative, count_if(NOT a AND NOT e)::BIGINT AS true_negative FROM (SELECT coalesce(error = 'abstained', false) AS a, coalesce(sources_returned = 0, false) AS e FROM eval_results)")
def abstention_confusion(s, d):
    return scoring.confusion(read_table(s, d, "eval_results"), C("error") == "abstained", C("sources_returned") == 0)


@query("SELECT mode, round(avg(nullif(latency_ms, 0)))::BIGINT AS avg_ms, min(nullif(latency_ms, 0)) AS min_ms, max(nullif(latency_ms, 0)) AS max_ms FROM eval_results GROUP BY 1")
def latency_stats(s, d):
    return scoring.latency(read_table(s, d, "eval_results"), "mode")


@query("SELECT b::INT AS bucket, count(sources_returned) AS n FROM range(0, 11) t(b) LEFT JOIN eval_results ON sources_returned = b GROUP BY 1")
def source_histogram(s, d):
    return scoring.histogram(read_table(s, d, "eval_results"), "sources_returned", range(11))


@query(f"SELECT mode, ticker, count(passed) AS total, count_if(passed)::BIGINT AS passed, {_RATE.format('passed')} AS accuracy, grouping_id(mode, ticker)::BIGINT AS level FROM eval_results GROUP BY ROLLUP (mode, ticker)")
def result_rollup(s, d):
    return scoring.rollup(read_table(s, d, "eval_results"), "mode", "passed", "ticker")


@query("SELECT result_id, CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN passed IS NULL THEN 'UNGRADED' WHEN passed THEN 'PASS' ELSE 'FAIL' END AS status, coalesce(list_bool_and(list_filter([passed, attribution_match], lambda x: x IS NOT NULL)), false) AS overall FROM eval_results")
def result_status(s, d):
    r = read_table(s, d, "eval_results")
    return r.select("result_id", scoring.status(C("error"), C("passed").isNotNull(), C("passed")).alias("status"), scoring.overall([C("passed"), C("attribution_match")]).alias("overall"))


@query("SELECT run_day, total, passed, accuracy FROM (SELECT run_timestamp::DATE AS run_day, count(passed) AS total, count_if(passed)::BIGINT AS passed, " + _RATE.format("passed") + " AS accuracy FROM eval_results GROUP BY 1)")
def daily_pass_rate(s, d):
    return scoring.pass_rates(read_table(s, d, "eval_results").withColumn("run_day", F.to_date("run_timestamp")), "run_day")


def queries() -> dict[str, Query]:
    from tallyloom import catalogue_more, catalogue_reports, catalogue_sources  # noqa: F401  register further queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
