"""Queries over joins in time, keyed creation, run reports and selections of periods and cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalogue import _BEST, _EMB, _JOINED, _RATE, _SIM, _VALUED, _best, _joined, _vectors, query
from tallyloom.operators import facts, joins, reports, retrieval, scoring
from tallyloom.session import read_table

C = F.col


def _results(s, d):
    """Stored results with the columns of judged runs, shaped from what is stored."""
    return read_table(s, d, "eval_results").withColumns({
        "category": F.coalesce("mode", F.lit("other")), "overall_pass": F.when(C("sources_returned") != 3, C("passed")), "abstention_expected": C("error") == "abstained", "abstention_accuracy": F.when(C("error").isNotNull(), C("error") == "abstained").otherwise(C("sources_returned") != 1),
        "has_hallucination": F.when(C("latency_ms").isNotNull(), C("sources_returned") == 2), "empty_answer": ~F.coalesce("model_answer", F.lit("")).rlike(r"\w"), "graded": C("sources_returned") != 4, "faithfulness": C("result_id") % 6, "relevance": C("result_id") % 5,
    })


_RESULTS = """(SELECT *, coalesce(mode, 'other') AS category, CASE WHEN sources_returned <> 3 THEN passed END AS overall_pass, error = 'abstained' AS abstention_expected, CASE WHEN error IS NOT NULL THEN error = 'abstained' ELSE sources_returned <> 1 END AS abstention_accuracy,
    CASE WHEN latency_ms IS NOT NULL THEN sources_returned = 2 END AS has_hallucination, NOT regexp_matches(coalesce(model_answer, ''), '[A-Za-z0-9_]') AS empty_answer, sources_returned <> 4 AS graded, result_id % 6 AS faithfulness, result_id % 5 AS relevance FROM eval_results)"""
_OF = "count({0}) AS {0}_total, count_if({0})::BIGINT AS {0}_passed, " + _RATE + " AS {0}_pct"


# ---------------------------------------------------------------- joins


@query(
    f"""SELECT fact_id, j.fiscal_period AS as_of_period, j.filing_id AS as_of_filing FROM (SELECT fact_id, company_id, period_end FROM ({_JOINED})) f
    LEFT JOIN LATERAL (SELECT fiscal_period, filing_id FROM filings g WHERE g.company_id = f.company_id AND g.filed_date <= f.period_end ORDER BY filed_date DESC, fiscal_period DESC, filing_id DESC LIMIT 1) j ON true"""
)
def as_of_filing(s, d):
    """The filing that was the latest of its company when a fact's period ended."""
    fl = read_table(s, d, "filings")
    f = read_table(s, d, "financial_facts").join(fl.select("filing_id", "company_id"), "filing_id").join(read_table(s, d, "companies").select("company_id"), "company_id").select("fact_id", "company_id", "period_end")
    right = fl.select("company_id", "filed_date", C("fiscal_period").alias("as_of_period"), C("filing_id").alias("as_of_filing"))
    return joins.as_of(f, right, ["company_id"], "period_end", "filed_date", ["as_of_period", "as_of_filing"]).select("fact_id", "as_of_period", "as_of_filing")


@query("SELECT l.filing_id, f.fact_id FROM filings l JOIN filings o ON o.company_id = l.company_id JOIN financial_facts f ON f.filing_id = o.filing_id AND l.filed_date BETWEEN f.period_start AND f.period_end")
def filings_within_periods(s, d):
    """Facts whose period holds the day on which another filing of the company was filed."""
    fl = read_table(s, d, "filings")
    spans = read_table(s, d, "financial_facts").select("fact_id", "filing_id", "period_start", "period_end").join(fl.select("filing_id", "company_id"), "filing_id").drop("filing_id")
    return joins.within(fl.select("filing_id", "company_id", "filed_date"), spans, ["company_id"], "filed_date", "period_start", "period_end").select("filing_id", "fact_id")


@query(
    """WITH a AS (SELECT ticker, fiscal_period, count(*) AS filings FROM filings JOIN companies USING (company_id) GROUP BY ALL), b AS (SELECT upper(trim(ticker)) AS ticker, fiscal_period, count(*) AS chunks FROM chunks WHERE trim(ticker) <> '' GROUP BY ALL)
    SELECT ticker, fiscal_period, filings, chunks, CASE WHEN filings IS NULL THEN 'right' WHEN chunks IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b USING (ticker, fiscal_period) WHERE fiscal_period IS NOT NULL"""
)
def filings_and_chunks(s, d):
    """Filings and chunks by company and period, those without a partner included."""
    a = read_table(s, d, "filings").join(read_table(s, d, "companies").select("company_id", "ticker"), "company_id").groupBy("ticker", "fiscal_period").agg(F.count(F.lit(1)).alias("filings"))
    b = read_table(s, d, "chunks").withColumn("ticker", F.upper(F.trim("ticker"))).where("ticker <> ''").groupBy("ticker", "fiscal_period").agg(F.count(F.lit(1)).alias("chunks"))
    return joins.matched(a, b, ["ticker", "fiscal_period"]).where("fiscal_period is not null")


@query("SELECT company_id, form_type, fiscal_period, min(filing_id) FILTER (source_url IS NULL) AS stored_id, min(filing_id) FILTER (source_url IS NULL) IS NULL AS created FROM filings GROUP BY 1, 2, 3")
def get_or_create_filings(s, d):
    """Filings (company, form, period) of a load of all, where those without an address are stored: their ids, and which are created."""
    f = read_table(s, d, "filings")
    key = ["company_id", "form_type", "fiscal_period"]
    got = facts.get_or_create(f.where("source_url is null"), f, key, "filing_id")
    return got.select(*key, F.when(~C("created"), C("filing_id")).alias("stored_id"), "created")


@query("SELECT count(*) AS keys, count(*) AS ids, count_if(stored IS NULL)::BIGINT AS created, min(top) + 1 AS first_new, min(top) + count_if(stored IS NULL)::BIGINT AS last_new FROM (SELECT ticker, min(company_id) FILTER (market = 'US') AS stored, (SELECT max(company_id) FROM companies WHERE market = 'US') AS top FROM companies GROUP BY 1)")
def get_or_create_companies(s, d):
    """Companies of a load of all, where those of one market are stored: new ids follow on without a gap or a repeat."""
    c = read_table(s, d, "companies")
    got = facts.get_or_create(c.where("market = 'US'"), c, ["ticker"], "company_id")
    new = F.when(C("created"), C("company_id"))
    return got.agg(F.count(F.lit(1)).alias("keys"), F.count_distinct("company_id").alias("ids"), F.count_if("created").alias("created"), F.min(new).alias("first_new"), F.max(new).alias("last_new"))


# ---------------------------------------------------------------- periods


@query(f"SELECT ticker, fiscal_period, latest_end, place FROM (SELECT ticker, fiscal_period, max(period_end) AS latest_end, row_number() OVER (PARTITION BY ticker ORDER BY max(period_end) DESC NULLS LAST, fiscal_period) AS place FROM ({_BEST}) GROUP BY 1, 2) WHERE place <= 3")
def newest_periods(s, d):
    return facts.periods_newest_first(_best(s, d)).where("place <= 3")


@query(
    f"""WITH p AS (SELECT ticker, fiscal_period, row_number() OVER (PARTITION BY ticker ORDER BY max(period_end) DESC NULLS LAST, fiscal_period) AS place FROM ({_BEST}) GROUP BY 1, 2),
    q AS (SELECT result_id AS query_id, ticker, lower(coalesce(question, '')) AS t, CASE WHEN result_id % 3 = 0 THEN fiscal_period END AS named FROM eval_results),
    x AS (SELECT query_id, ticker, named, regexp_extract_all(t, '\\b(20\\d{{2}})\\b', 1) AS years, nullif(regexp_extract(t, '\\bq([1-4])\\b', 1), '') AS qq FROM q),
    j AS (SELECT query_id, ticker, fiscal_period, place, CASE WHEN fiscal_period = named THEN 0 WHEN (len(years) = 0 OR list_contains(years, right(fiscal_period, 4))) AND (qq IS NULL OR fiscal_period NOT LIKE 'Q%' OR fiscal_period[2] = qq) THEN 1 WHEN place <= 3 THEN 2 END AS rule FROM x JOIN p USING (ticker)),
    m AS (SELECT *, min(rule) OVER (PARTITION BY query_id) AS least FROM j WHERE rule IS NOT NULL) SELECT query_id, ticker, fiscal_period, place FROM m WHERE rule = least OR (least = 2 AND place <= 3)"""
)
def question_fact_periods(s, d):
    """The labels whose facts each stored question is answered from; every third question names its period."""
    q = read_table(s, d, "eval_results").select(C("result_id").alias("query_id"), "ticker", "question", F.when(C("result_id") % 3 == 0, C("fiscal_period")).alias("fiscal_period"))
    return facts.periods_of_questions(q, _best(s, d))


@query(
    f"""SELECT fact_id, ntile(4) OVER w AS tile, round(percent_rank() OVER w, 6) AS percent_rank, round(cume_dist() OVER w, 6) AS cume_dist, nth_value(duration_days, 2) OVER (PARTITION BY ticker ORDER BY duration_days, fact_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second,
    count(duration_days) OVER (PARTITION BY ticker ORDER BY duration_days RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS near_below FROM ({_VALUED}) WHERE duration_days IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY duration_days, fact_id)"""
)
def duration_standings(s, d):
    """How long each fact's period is among those of its company."""
    f = facts.reported(_joined(s, d), fields=None).where("duration_days is not null").select("fact_id", "ticker", "duration_days")
    return reports.standings(f, ["ticker"], [C("duration_days"), C("fact_id")], "duration_days").drop("ticker", "duration_days")


# ---------------------------------------------------------------- runs


@query(
    f"""SELECT count(*) AS total_cases, {_RATE.format('coalesce(overall_pass, false)')} AS overall_pct, {_OF.format('attribution_checked')}, {_OF.format('attribution_match')}, count_if(coalesce(abstention_expected, false))::BIGINT AS to_abstain, count_if(coalesce(abstention_expected, false) AND abstention_accuracy)::BIGINT AS abstained,
    count_if(NOT coalesce(abstention_expected, false) AND NOT abstention_accuracy)::BIGINT AS false_abstentions, count(has_hallucination) AS judged, count_if(has_hallucination)::BIGINT AS hallucinated, coalesce(round(avg(nullif(latency_ms, 0)))::BIGINT, 0) AS avg_ms, coalesce(min(nullif(latency_ms, 0)), 0) AS min_ms, coalesce(max(nullif(latency_ms, 0)), 0) AS max_ms, count_if(empty_answer)::BIGINT AS empty_answers FROM {_RESULTS}"""
)
def run_summary(s, d):
    return reports.run_summary(_results(s, d), ["attribution_checked", "attribution_match"])


@query(f"SELECT category, count(has_hallucination) AS judged, count_if(has_hallucination)::BIGINT AS hallucinated FROM {_RESULTS} GROUP BY 1")
def hallucination_counts(s, d):
    return _results(s, d).groupBy("category").agg(*reports.hallucinations())


@query(
    f"""SELECT category, count_if(ok)::BIGINT AS graded, count_if(NOT ok)::BIGINT AS ungraded, coalesce(round(100.0 * count_if(ok AND coalesce(passed, false)) / nullif(count_if(ok), 0), 1), 0) AS pass_pct, round(avg(faithfulness) FILTER (ok), 2) AS mean_faithfulness, round(avg(relevance) FILTER (ok), 2) AS mean_relevance, count_if(ok AND has_hallucination)::BIGINT AS hallucinated
    FROM (SELECT *, coalesce(graded, true) AND error IS NULL AS ok FROM {_RESULTS}) GROUP BY 1"""
)
def qualitative_means(s, d):
    return reports.qualitative(_results(s, d), "category")


@query("SELECT ticker, count(*) AS n, round(avg(relative_error_pct), 3) AS mean, round(min(relative_error_pct), 3) AS least, round(max(relative_error_pct), 3) AS greatest FROM eval_results WHERE relative_error_pct IS NOT NULL AND NOT isnan(relative_error_pct) GROUP BY 1")
def mean_errors(s, d):
    return reports.mean_error(read_table(s, d, "eval_results"), "ticker")


@query("SELECT mode, count(attribution_match) AS labelled, count_if(passed AND NOT attribution_match)::BIGINT AS false_positives, count_if(NOT coalesce(passed, false) AND attribution_match)::BIGINT AS false_negatives FROM eval_results GROUP BY 1")
def checker_errors(s, d):
    """How often the stored verdict disagrees with the stored attribution."""
    return reports.checker_errors(read_table(s, d, "eval_results"), C("passed"), C("attribution_match"), "mode")


@query(
    "SELECT result_id, round(avg(v), 4) AS avg, round(min(v), 4) AS min, round(max(v), 4) AS max FROM (SELECT result_id, unnest(list_transform(range(1, greatest(sources_returned, 1) + 1), lambda i: 0.9 - i / 20.0)) AS v FROM eval_results WHERE sources_returned > 0) GROUP BY 1 UNION ALL SELECT result_id, 0, 0, 0 FROM eval_results WHERE sources_returned IS NULL OR sources_returned <= 0"
)
def context_similarity(s, d):
    """Mean, least and greatest similarity of each answer's sources; zeros where there are none."""
    r = read_table(s, d, "eval_results")
    sims = F.when(C("sources_returned") > 0, F.transform(F.sequence(F.lit(1), F.greatest(C("sources_returned"), F.lit(1))), lambda i: 0.9 - i / 20.0)).otherwise(F.array().cast("array<double>"))
    return r.select("result_id", scoring.similarity_summary(sims).alias("x")).select("result_id", "x.*")


@query(f"SELECT mode, ticker, canonical_field, count(passed) AS total, {_RATE.format('passed')} AS accuracy, grouping_id(mode, ticker, canonical_field)::BIGINT AS level FROM eval_results GROUP BY CUBE (mode, ticker, canonical_field)")
def result_cube(s, d):
    return reports.cube(read_table(s, d, "eval_results"), ["mode", "ticker", "canonical_field"], "passed")


@query(f"SELECT mode, ticker, canonical_field, count(passed) AS total, {_RATE.format('passed')} AS accuracy, grouping_id(mode, ticker, canonical_field)::BIGINT AS level FROM eval_results GROUP BY GROUPING SETS ((mode, ticker), (canonical_field), ())")
def result_grouping_sets(s, d):
    return reports.grouping_sets(read_table(s, d, "eval_results"), [["mode", "ticker"], ["canonical_field"], []], ["mode", "ticker", "canonical_field"], "passed")


@query("SELECT event_type, true AS distinct_ok, true AS quartiles_ok FROM events GROUP BY 1")
def sketched_events(s, d):
    """Sketches against exact figures: users within 5 %, quartiles within two points of their rank."""
    e = read_table(s, d, "events")
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), *[F.percentile("value", q).alias(f"q{i}") for i, q in enumerate((0.23, 0.27, 0.48, 0.52, 0.73, 0.77))])
    j = reports.sketches(e, "event_type", distinct="user_id", value="value").join(exact, "event_type")
    between = lambda i: F.get("quartiles", F.lit(i)).between(C(f"q{2 * i}"), C(f"q{2 * i + 1}"))
    return j.select("event_type", (F.abs(C("about") - C("users")) <= 0.05 * C("users")).alias("distinct_ok"), (between(0) & between(1) & between(2)).alias("quartiles_ok"))


@query(
    " UNION ALL ".join(f"SELECT '{n}' AS filter, result_id FROM {_RESULTS} WHERE {w}" for n, w in (
        ("pass", "coalesce(overall_pass, passed, false)"), ("fail", "NOT coalesce(overall_pass, passed, false)"), ("abstention", "abstention_expected"), ("hallucination", "has_hallucination"), ("category", "category = 'quantitative'"), ("dimension", "attribution_match IS NOT NULL"), ("text", "contains(lower(question), 'net income')")))
)
def result_filters(s, d):
    """What each filter of a results page leaves."""
    r = _results(s, d)
    kinds = {"pass": {"outcome": "pass", "flag": "overall_pass"}, "fail": {"outcome": "fail", "flag": "overall_pass"}, "abstention": {"outcome": "abstention"}, "hallucination": {"outcome": "hallucination"}, "category": {"category": "quantitative"}, "dimension": {"dimension": "attribution_match"}, "text": {"text": "Net Income"}}
    out = None
    for n, how in kinds.items():
        df = scoring.filtered(r, **how).select(F.lit(n).alias("filter"), "result_id")
        out = df if out is None else out.union(df)
    return out


@query("SELECT id FROM (SELECT result_id AS id, coalesce(mode, 'other') AS category, lower(ticker) || '_' || fiscal_period AS paper_id, CASE WHEN passed IS NULL THEN [] WHEN attribution_checked THEN ['numerical_accuracy', 'groundedness_accuracy'] ELSE ['numerical_accuracy'] END AS dims FROM eval_results) WHERE category = 'quantitative' AND list_contains(dims, 'groundedness_accuracy') AND contains(lower(paper_id), 'fy20') ORDER BY id LIMIT 100")
def chosen_cases(s, d):
    """The first hundred cases of a category with a dimension whose document's name holds a text."""
    dims = F.when(C("passed").isNull(), F.array().cast("array<string>")).when(C("attribution_checked"), F.array(F.lit("numerical_accuracy"), F.lit("groundedness_accuracy"))).otherwise(F.array(F.lit("numerical_accuracy")))
    c = read_table(s, d, "eval_results").select(C("result_id").alias("id"), F.coalesce("mode", F.lit("other")).alias("category"), F.concat(F.lower("ticker"), F.lit("_"), "fiscal_period").alias("paper_id"), dims.alias("eval_dimensions"))
    return scoring.chosen_cases(c, category="quantitative", dimension="groundedness_accuracy", paper="FY20", first=100).select("id")


# ---------------------------------------------------------------- retrieval


@query(
    f"""WITH p AS (SELECT vec_id, {_SIM} AS sim, label FROM ({_EMB}) WHERE ticker = 'T1' AND fiscal_period = 'FY2021' ORDER BY sim DESC, vec_id LIMIT 50)
    SELECT vec_id, round(sim * (1 + label % 3), 4) AS rerank_score FROM p ORDER BY rerank_score DESC, vec_id LIMIT 5"""
)
def two_stage_retrieval(s, d):
    """The pool of candidates by similarity, then the best by a scorer, here the similarity weighted by the label."""
    e, v = _vectors(s, d)
    sim = retrieval.numbers.cosine(C("embedding"), F.array(*[F.lit(float(x)) for x in v]))
    scorer = lambda hits: hits.withColumn("rerank_score", sim * (1 + C("label") % 3))
    return retrieval.retrieve(e, v, 5, ticker="t1", period="FY2021", scorer=scorer, key="vec_id").select("vec_id", "rerank_score")
