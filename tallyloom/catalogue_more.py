"""Further queries: tables as grids, charts, plans, logs and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalogue import _BEST, _BLOCKS, _EMB, _JVM_WHITE, _JOINED as _RAW, _PERIOD_SQL, _SCOPE_SQL, _SIM, _SQL, _attributed_sql, _best, _best_sql, _joined, _pairs, _vectors, query
from tallyloom.functions import charts
from tallyloom.functions import text as X
from tallyloom.operators import ann, evaluation, facts, lexical, retrieval, scoring
from tallyloom.plans import answering, ingest
from tallyloom.session import read_table
from tallyloom.streaming import state, windows

C = F.col


@query("SELECT time_bucket(INTERVAL '1 hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(s, d):
    return windows.tumbling(windows.with_time(read_table(s, d, "events")), "1 hour", "event_type").withColumns({"total": F.round("total", 2), "window_start": C("window_start").cast("timestamp_ntz")})


@query("SELECT b + h * INTERVAL '30 minutes' AS window_start, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT time_bucket(INTERVAL '30 minutes', ts)::TIMESTAMP - INTERVAL '30 minutes' AS b, value FROM events), (VALUES (0), (1)) t(h) GROUP BY 1")
def event_sliding_windows(s, d):
    return windows.tumbling(windows.with_time(read_table(s, d, "events")), "1 hour", slide="30 minutes").withColumns({"total": F.round("total", 2), "window_start": C("window_start").cast("timestamp_ntz")})


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts)::TIMESTAMP AS session_start, (max(ts) + INTERVAL '30 minutes')::TIMESTAMP AS session_end, count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(s, d):
    return windows.sessions(windows.with_time(read_table(s, d, "events")), "30 minutes", "user_id").withColumns({c: C(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


_LOG = "SELECT *, epoch_us(ts) / 1e6 AS seconds, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, event_id) AS n FROM events WHERE user_id IS NOT NULL"


@query(
    f"""WITH RECURSIVE l AS MATERIALIZED ({_LOG}), t AS (SELECT user_id, seconds, event_id, n, 3.0::DOUBLE - 1 AS tokens, true AS allowed FROM l WHERE n = 1 UNION ALL
    SELECT user_id, seconds, event_id, n, CASE WHEN have >= 1.0 THEN have - 1 ELSE have END, have >= 1.0 FROM (SELECT l.user_id, l.seconds, l.event_id, l.n, least(3.0::DOUBLE, t.tokens + (l.seconds - t.seconds) * (3.0::DOUBLE / 3600.0::DOUBLE)) AS have FROM t JOIN l ON l.user_id = t.user_id AND l.n = t.n + 1))
    SELECT user_id, seconds, event_id, allowed FROM t"""
)
def token_bucket(s, d):
    return state.rate_limited(read_table(s, d, "events"), capacity=3.0, window=3600.0)


@query(
    f"""WITH RECURSIVE l AS MATERIALIZED ({_LOG}), t AS (SELECT user_id, seconds, event_id, n, event_type AS served, seconds AS at_s, true AS fetched FROM l WHERE n = 1 UNION ALL
    SELECT l.user_id, l.seconds, l.event_id, l.n, CASE WHEN l.seconds - t.at_s >= 7200 THEN l.event_type ELSE t.served END, CASE WHEN l.seconds - t.at_s >= 7200 THEN l.seconds ELSE t.at_s END, l.seconds - t.at_s >= 7200 FROM t JOIN l ON l.user_id = t.user_id AND l.n = t.n + 1)
    SELECT user_id, seconds, event_id, CASE WHEN fetched THEN 'fetched:' ELSE 'cached:' END || served AS served FROM t"""
)
def cached_reads(s, d):
    """Each user's events read through a cache of two hours."""
    return state.cached_reads(read_table(s, d, "events"), "user_id", "ts", "event_id", "event_type", ttl=7200.0)


@query(
    """WITH r AS (SELECT user_id, ts::DATE AS day, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) AS n FROM events), g AS (SELECT user_id, day, min(n) FILTER (ok) AS hit, max(n) AS most FROM r WHERE n <= 3 GROUP BY ALL)
    SELECT user_id, day, coalesce(hit, most)::INT AS tried, CASE coalesce(hit, most) WHEN 1 THEN 0.0 WHEN 2 THEN 2.0 ELSE 6.0 END::DOUBLE AS waited, hit IS NOT NULL AS answered FROM g"""
)
def retried_calls(s, d):
    """Each user's events of a day as attempts of one call."""
    e = read_table(s, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", (C("event_type") != "error").alias("ok"))
    return state.retried(e, ["user_id", "day"], "event_id", "ok")


@query(
    f"""WITH RECURSIVE l AS MATERIALIZED ({_LOG}), t AS (SELECT user_id, seconds, event_id, n, CASE WHEN event_type <> 'error' THEN 'CLOSED' WHEN 1 >= 2 THEN 'OPEN' ELSE 'CLOSED' END AS state, CASE WHEN event_type <> 'error' THEN 0 ELSE 1 END AS failed, 0.0::DOUBLE AS opened, true AS admitted FROM l WHERE n = 1 UNION ALL
    SELECT user_id, seconds, event_id, n, CASE WHEN NOT let THEN state WHEN ok THEN 'CLOSED' WHEN half OR failed + 1 >= 2 THEN 'OPEN' ELSE 'CLOSED' END, CASE WHEN NOT let THEN failed WHEN ok THEN 0 ELSE failed + 1 END, CASE WHEN let AND NOT ok AND (half OR failed + 1 >= 2) THEN seconds ELSE opened END, let
    FROM (SELECT l.user_id, l.seconds, l.event_id, l.n, l.event_type <> 'error' AS ok, t.state, t.failed, t.opened, NOT (t.state = 'OPEN' AND l.seconds - t.opened < 3600.0) AS let, t.state = 'OPEN' AS half FROM t JOIN l ON l.user_id = t.user_id AND l.n = t.n + 1))
    SELECT user_id, seconds, event_id, CASE WHEN admitted THEN 'admitted:' ELSE 'refused:' END || state AS outcome FROM t"""
)
def circuit_breaker(s, d):
    e = read_table(s, d, "events").withColumn("ok", C("event_type") != "error")
    return state.breaker_states(e, "user_id", "ts", "event_id", "ok", failures=2, rest=3600.0)


@query(
    f"""WITH b AS ({_BEST}) SELECT ticker, fiscal_period, 'line' AS type, ticker || ' key figures' AS title, list(canonical_field ORDER BY canonical_field)[1] AS first_label, count(*)::INT AS labels, round(sum(value), 2) AS total FROM b GROUP BY 1, 2"""
)
def chart_extract(s, d):
    """Charts written into answer texts and read back; large values are written with thousands separators."""
    b = _best(s, d).groupBy("ticker", "fiscal_period").agg(F.array_sort(F.collect_list(F.struct("canonical_field", "value"))).alias("l"))
    num = F.transform("l", lambda x: x["value"])
    spec = F.struct(F.lit("LINE").alias("type"), F.concat("ticker", F.lit(" key figures")).alias("title"), F.transform("l", lambda x: x["canonical_field"]).alias("x"), F.array(F.struct(F.lit("FY").alias("name"), num.alias("values"))).alias("series"))
    answer = F.concat(F.lit("Here it is.\n```chart_data\n"), F.regexp_replace(F.to_json(spec), r"\}$", ",}"), F.lit("\n```\nDone."))
    c = b.select("ticker", "fiscal_period", charts.extract(answer).alias("c"))
    return c.select("ticker", "fiscal_period", "c.type", "c.title", C("c.x")[0].alias("first_label"), F.size("c.x").alias("labels"), F.round(F.aggregate(C("c.series")[0]["values"], F.lit(0.0), lambda a, v: a + v), 2).alias("total"))


@query("WITH r AS (SELECT id, paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY paper_id) AS n FROM (SELECT DISTINCT id, paper_id FROM chunks)), f AS (SELECT id, paper_id, i, count(*) OVER (PARTITION BY paper_id) AS n FROM r WHERE i < 200) SELECT id, paper_id FROM f WHERE i IN (0, n // 3, (2 * n) // 3)")
def sampled_chunks(s, d):
    return scoring.sampled_positions(read_table(s, d, "chunks").select("id", "paper_id").distinct(), "paper_id", "id")


@query("SELECT 'quantitative' AS track, result_id, latency_ms, NULL::BIGINT AS faithfulness FROM eval_results WHERE mode = 'quantitative' UNION ALL SELECT 'other', result_id, NULL, length(model_answer) % 6 FROM eval_results WHERE mode IS DISTINCT FROM 'quantitative'")
def merged_tracks(s, d):
    """Tracks with different columns one after the other."""
    r = read_table(s, d, "eval_results")
    a = r.where("mode = 'quantitative'").select(F.lit("quantitative").alias("track"), "result_id", "latency_ms")
    b = r.where("mode is distinct from 'quantitative'").select(F.lit("other").alias("track"), "result_id", (F.length("model_answer") % 6).cast("long").alias("faithfulness"))
    return a.unionByName(b, allowMissingColumns=True)


@query(r"SELECT result_id, md5(v) AS visible, length(v) AS chars FROM (SELECT result_id, trim(regexp_replace(regexp_replace(model_answer, '```chart_data\s*\n?.*?```', '', 'gs'), '```chart_data.*$', '', 'gs'), ' ' || chr(9) || chr(10) || chr(13)) AS v FROM eval_results WHERE model_answer IS NOT NULL)")
def visible_texts(s, d):
    """What is left of each answer, as its md5 and length."""
    r = read_table(s, d, "eval_results").where("model_answer is not null").select("result_id", X.visible_answer(C("model_answer")).alias("v"))
    return r.select("result_id", F.md5("v").alias("visible"), F.length("v").cast("long").alias("chars"))


@query(
    f"""WITH q AS (SELECT result_id, question, {_PERIOD_SQL} AS period FROM eval_results WHERE question IS NOT NULL), t AS ({_SQL['ticker_from_question']}), ends AS (SELECT ticker, max(period_end) AS e FROM ({_RAW}) GROUP BY 1), every AS (SELECT max(period_end) AS e FROM financial_facts),
    r AS (SELECT q.result_id, question, t.ticker, period, CASE WHEN t.ticker IS NULL THEN every.e ELSE ends.e END AS latest FROM q LEFT JOIN t USING (result_id) LEFT JOIN ends ON ends.ticker = t.ticker, every),
    k AS (SELECT * FROM r WHERE {_SCOPE_SQL} IS NULL AND NOT coalesce(latest IS NOT NULL AND len(list_filter(regexp_extract_all(lower(question), '\\b(20\\d{{2}})\\b', 1)::INT[], lambda y: y > year(latest))) > 0, false))
    SELECT result_id AS query_id, md5(concat_ws(chr(10) || chr(10), b.block, 'Question: ' || question)) AS prompt_md5 FROM k LEFT JOIN ({_BLOCKS}) b ON b.ticker = k.ticker AND b.fiscal_period = k.period"""
)
def question_prompts(s, d):
    """Routing, abstention, facts block and prompt of every stored question."""
    q = read_table(s, d, "eval_results").where("question is not null").select(C("result_id").alias("query_id"), "question")
    ff, fl, co = (read_table(s, d, t) for t in ("financial_facts", "filings", "companies"))
    route = answering.routed(q, ff, fl, co)
    return answering.prompts(route, facts.context_block(_best(s, d), co)).select("query_id", F.md5("prompt").alias("prompt_md5"))


@query(
    """WITH x AS (SELECT ticker, max(period_end) AS e FROM financial_facts JOIN filings USING (filing_id) JOIN companies USING (company_id) GROUP BY 1)
    SELECT ticker, fiscal_period, count(*) AS facts, count(DISTINCT canonical_field) AS fields, bool_or(year(period_end) = year(e)) AS in_latest_year FROM financial_facts JOIN filings USING (filing_id) JOIN companies USING (company_id) JOIN x USING (ticker) GROUP BY 1, 2"""
)
def period_coverage(s, d):
    j = _joined(s, d)
    latest = j.groupBy("ticker").agg(F.max("period_end").alias("e"))
    return j.join(latest, "ticker").groupBy("ticker", "fiscal_period").agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("canonical_field").alias("fields"), F.bool_or(F.year("period_end") == F.year("e")).alias("in_latest_year"))


_GOLDEN = _best_sql("coalesce(date_diff('day', period_start, period_end), 0) DESC, period_end DESC NULLS LAST, value DESC, fact_id DESC", columns="*")
_HUMAN = (
    "CASE WHEN canonical_field = 'eps_basic' THEN '$' || format('{:,.2f}', value) WHEN abs(value) >= 1e12 THEN '$' || format('{:.2f}', value / 1e12) || ' trillion (' || format('{:,.0f}', value) || ' ' || unit || ')' "
    "WHEN abs(value) >= 1e9 THEN '$' || format('{:.2f}', value / 1e9) || ' billion (' || format('{:,.0f}', value) || ' ' || unit || ')' WHEN abs(value) >= 1e6 THEN '$' || format('{:.2f}', value / 1e6) || ' million (' || format('{:,.0f}', value) || ' ' || unit || ')' "
    "ELSE format('{:,.2f}', value) || ' ' || unit END"
)


@query(
    f"""SELECT lower(ticker) || '_' || lower(fiscal_period) || '_' || canonical_field || '_' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS id, ticker, fiscal_period, canonical_field,
    replace(replace(replace(replace(coalesce(({_pairs(evaluation.GOLDEN_QUESTIONS)})[canonical_field], '{evaluation.GOLDEN_OTHER}'), '{{name}}', name), '{{ticker}}', ticker), '{{period}}', fiscal_period), '{{field}}', replace(canonical_field, '_', ' ')) AS question,
    value AS ground_truth_value, unit AS ground_truth_unit, {_HUMAN} AS ground_truth_formatted, period_end FROM (SELECT *, row_number() OVER (ORDER BY ticker, fiscal_period, canonical_field) AS n FROM ({_GOLDEN}))"""
)
def golden_set(s, d):
    return evaluation.golden_set(facts.best_fact(facts.reported(_joined(s, d)), "golden"))


_TERMS = ("revenue", "currency", "translation")


@query(
    f"""WITH w AS (SELECT id, regexp_extract_all(lower(coalesce(content, '')), '([a-z0-9]+)', 1) AS w FROM (SELECT DISTINCT id, content FROM chunks)), t AS (SELECT id, len(w) AS n, {', '.join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(_TERMS))} FROM w),
    s AS (SELECT count(*) AS docs, avg(n) AS a, {', '.join(f'count_if(t{i} > 0) AS d{i}' for i in range(3))} FROM t),
    x AS (SELECT id, {' + '.join(f'ln(1 + (docs - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * n / a))' for i in range(3))} AS score FROM t, s)
    SELECT id, round(score, 4) AS score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM x WHERE score > 0 ORDER BY score DESC, id LIMIT 20"""
)
def bm25_topk(s, d):
    return lexical.bm25(read_table(s, d, "chunks").select("id", "content").distinct(), _TERMS, 20)


@query(
    f"""WITH s AS (SELECT vec_id, {_SIM} AS sim, label FROM embeddings), a AS (SELECT vec_id, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM s QUALIFY rank <= 20), b AS (SELECT vec_id, row_number() OVER (ORDER BY label, vec_id) AS rank FROM s QUALIFY rank <= 20)
    SELECT vec_id, round(sum(1.0 / (rank + 60)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1 ORDER BY score DESC, vec_id LIMIT 10"""
)
def rank_fusion(s, d):
    """Two rankings of vectors fused; of equal scores the smaller id comes first."""
    e, v = _vectors(s, d)
    w = F.row_number().over
    from pyspark.sql import Window

    a = retrieval.top_k(e, v, 20, key="vec_id").withColumn("rank", w(Window.orderBy(C("similarity").desc(), "vec_id")))
    b = e.orderBy("label", "vec_id").limit(20).withColumn("rank", w(Window.orderBy("label", "vec_id")))
    return lexical.fuse([a, b], 10, key="vec_id")


@query()
def approximate_topk(s, d):
    """Nearest cells of every vector, for each whose id is divisible by 50; recall against the scan is tested and stated by `index_recall`."""
    e = read_table(s, d, "embeddings")
    ix = ann.CellIndex.fit(e, "vec_id")
    questions = e.where("vec_id % 50 = 0").select(C("vec_id").alias("query_id"), C("embedding").alias("vector"))
    return ix.search_each(ix.build(e, "vec_id"), questions, 10, "vec_id")


@query("SELECT count(*) AS questions, true AS recall_ok, (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) AS indexed FROM embeddings WHERE vec_id % 50 = 0")
def index_recall(s, d):
    """Whether the index finds at least nine tenths of what the scan finds, and how many rows it holds."""
    e = read_table(s, d, "embeddings")
    questions = e.where("vec_id % 50 = 0").select(C("vec_id").alias("query_id"), C("embedding").alias("vector"))
    index = ann.CellIndex.fit(e, "vec_id").build(e, "vec_id")
    exact, got = retrieval.top_k_of_each(e, questions, 10, key="vec_id"), approximate_topk(s, d)
    j = exact.select("query_id", "vec_id").join(got.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    found = j.agg(F.count_distinct("query_id").alias("questions"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_ok"))
    return found.crossJoin(F.broadcast(index.agg(F.count_distinct("vec_id").alias("indexed"))))  # one row each


@query("SELECT result_id, coalesce(regexp_matches(lower(model_answer), '" + "|".join(p.replace("'", "''") for p in evaluation.DECLINES) + "'), false) AS declines FROM eval_results")
def declining_answers(s, d):
    return read_table(s, d, "eval_results").select("result_id", evaluation.declines(C("model_answer")).alias("declines"))


@query(
    f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, CASE WHEN label % 5 > 0 THEN 'T' || (label % 4) END AS t, 'FY' || (2020 + label % 7) AS p FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, vec_id, list_inner_product(embedding::DOUBLE[], v) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_inner_product(v, v)) AS sim, CASE WHEN t IS NULL THEN 0 WHEN fiscal_period = p THEN 0 ELSE 1 END AS rung FROM ({_EMB}) e JOIN q ON q.t IS NULL OR q.t = e.ticker),
    r AS (SELECT *, min(rung) OVER (PARTITION BY query_id) AS least FROM s) SELECT query_id, vec_id, (row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id))::INT AS rank, round(sim, 4) AS similarity FROM r WHERE rung = least QUALIFY rank <= 3"""
)
def question_hits(s, d):
    """Sources of a table of questions: of the company and period where given, else of the company, else of all."""
    e, _ = _vectors(s, d)
    q = e.where("vec_id % 50 = 0").select(C("vec_id").alias("query_id"), F.when(C("label") % 5 > 0, C("ticker")).alias("ticker"), F.concat(F.lit("FY"), 2020 + C("label") % 7).alias("fiscal_period"), C("embedding").alias("vector"))
    return answering.hits_of(q, e, 3, key="vec_id").select("query_id", "vec_id", "rank", F.round("similarity", 4).alias("similarity"))


@query("SELECT winner, count(*) AS n FROM (SELECT CASE WHEN best_match > ground_truth_value + 0.005 THEN 'a' WHEN ground_truth_value > best_match + 0.005 THEN 'b' ELSE 'tie' END AS winner FROM eval_results WHERE best_match IS NOT NULL AND ground_truth_value IS NOT NULL) GROUP BY 1")
def win_counts(s, d):
    return evaluation.win_counts(read_table(s, d, "eval_results"), "best_match", "ground_truth_value")


_GRADED = f"""WITH c AS ({_attributed_sql(1.0)}), r AS (SELECT e.*, c.relative_error_pct AS err, NOT regexp_matches(coalesce(model_answer, ''), '{_JVM_WHITE.replace("[", "[^", 1).rstrip("+")}') AS blank, coalesce(error = 'abstained', false) AS expected, e.passed IS NULL AS fallback, 0.9 - (greatest(coalesce(sources_returned, 1), 1) + 1) / 40.0 AS mean, e.ground_truth_value IS NOT NULL AS has,
    coalesce(c.relative_error_pct <= coalesce(nullif(tolerance_pct, 0), 2.0), false) AS near, coalesce(regexp_matches(lower(model_answer), '{"|".join(p.replace("'", "''") for p in evaluation.DECLINES)}'), false) AS declined FROM eval_results e JOIN c USING (result_id)),
    d AS (SELECT result_id AS id, CASE WHEN blank THEN false ELSE mean >= 0.3 END AS retrieval_accuracy, CASE WHEN NOT blank AND has THEN near END AS numerical_accuracy, CASE WHEN NOT blank THEN CASE WHEN has THEN near ELSE NOT fallback END END AS calculation_accuracy, CASE WHEN NOT blank AND NOT fallback THEN true END AS groundedness_accuracy,
    CASE WHEN NOT blank THEN expected = declined END AS abstention_accuracy FROM r)"""


@query(f"{_GRADED} SELECT *, list_bool_and(list_filter([retrieval_accuracy, numerical_accuracy, calculation_accuracy, groundedness_accuracy, abstention_accuracy], lambda x: x IS NOT NULL)) AS overall_pass FROM d")
def scored_cases(s, d):
    """Five dimensions of stored results, with similarities and judge scores shaped from their columns."""
    r = read_table(s, d, "eval_results").select(
        C("result_id").alias("id"), "model_answer", "ground_truth_value", "tolerance_pct", "canonical_field", "fiscal_period", F.array(*[F.lit(x) for x in evaluation.DIMENSIONS]).alias("eval_dimensions"),
        (C("error") == "abstained").alias("abstention_expected"), F.transform(F.sequence(F.lit(1), F.greatest(C("sources_returned"), F.lit(1))), lambda i: 0.9 - i / 20.0).alias("similarities"),
        evaluation.judge_scores(F.when(C("passed").isNotNull(), F.lit('ok {"relevance_score": 4, "groundedness_score": 4, "faithfulness_score": 3, "has_hallucination": false} end'))).alias("judge"),
    )
    return evaluation.score_cases(r)
