"""Plans from end to end: loading files and facts, answering questions, reports, joins in time."""

import datetime

from pyspark.sql import functions as F

from tallyloom.operators import facts, joins, matching, reports, retrieval, scoring
from tallyloom.plans import answering, ingest
from tallyloom.session import read_table
from tallyloom.sources import files
from tallyloom.sources.storage import ChunkStore


def test_load_counts_stores_and_skips(spark, tmp_path):
    rows = [("zfeun_20200331_10q", "txt", "text", "Sales of the unit rose in the quarter. " * 20), ("odd", "bin", None, "x"), ("empty", "txt", "text", "")]
    df = spark.createDataFrame(rows, "paper_id string, file_type string, kind string, content string")
    ff = spark.createDataFrame([(1, 5, "t", "USD", None, None, float("nan")), (2, 5, "t", "USD", None, None, 3.0)], "fact_id long, filing_id long, tag string, unit string, period_start date, period_end date, value double")
    store, landed = ChunkStore(spark, f"file://{tmp_path}/store"), []
    run = lambda **how: {r.track: (r.documents, r.rows) for r in ingest.load(df, store, "u", facts=ff, write_facts=lambda d: landed.append(d.collect()), **how).collect()}
    assert run(dry_run=True) == {"chunks": (1, 1), "problems": (2, 2), "facts": (1, 1)} and store.read().count() == 0 and not landed
    assert set(run(skip_facts=True)) == {"chunks", "problems"} and store.count("u") == 1
    assert set(run(skip_chunks=True)) == {"facts"} and [(r.fact_id, r.value) for r in landed[0]] == [(1, None)]
    assert run(skip_chunks=True, skip_facts=True) == {}


def test_questions_to_answers(spark, sf):
    ff, fl, co = (read_table(spark, sf, t) for t in ("financial_facts", "filings", "companies"))
    ticker = co.orderBy("company_id").first().ticker
    chunks = spark.createDataFrame([(f"c{k}", ticker if k < 4 else "ZZZ", "FY2020" if k % 2 else "FY2019", "p", k, "s", False, "", "", f"text {k}", [1.0, float(k)]) for k in range(6)], "id string, ticker string, fiscal_period string, paper_id string, page_number int, section string, is_table boolean, table_caption string, unit_context string, content string, embedding array<double>")
    q = spark.createDataFrame([(1, f"What was {ticker} revenue for FY2020?", [1.0, 1.0]), (2, "What is the stock price?", [1.0, 1.0]), (3, "Tell me something general", [0.0, 1.0])], "query_id long, question string, vector array<double>")
    model = lambda d: d.select("query_id", F.concat(F.lit("seen: "), "prompt").alias("answer"))
    got = {r.query_id: r for r in answering.generated(q, chunks, ff, fl, co, [model], k=2).collect()}
    assert got[2].abstain == "market_data" and got[2].answer is None
    assert "text 1" in got[1].answer and "text 3" in got[1].answer and "text 0" not in got[1].answer and got[1].answer.endswith(f"Question: What was {ticker} revenue for FY2020?") and got[1].model_no == 1
    assert "text 5" in got[3].answer and got[3].text.startswith("seen: ")
    assert answering.generated(q.limit(0), chunks, ff, fl, co, [model]).count() == 0


def test_reports_of_documents(spark):
    c = spark.createDataFrame([(f"c{k}", "p" if k < 8 else "q", k, "", False, "", "", f"text {k}", [1.0, float(k)]) for k in range(9)], "id string, paper_id string, page_number int, section string, is_table boolean, table_caption string, unit_context string, content string, embedding array<double>")
    papers = spark.createDataFrame([("p", [0.0, 1.0]), ("q", [1.0, 0.0]), ("none", [1.0, 0.0])], "paper_id string, vector array<double>")
    got = {r.paper_id: r.prompt for r in answering.report_prompts(papers, c).collect()}
    assert got["p"].count("[Source") == 6 and got["q"].count("[Source") == 1 and got["none"] == answering.REPORT


def test_two_stage_retrieval_and_document_scope(spark):
    c = spark.createDataFrame([(f"c{k}", "u", "p" if k < 3 else "q", "T", "FY2020", "unspecified", k % 2 == 0, [1.0, float(k)]) for k in range(6)], "id string, user_id string, paper_id string, ticker string, fiscal_period string, statement_scope string, is_table boolean, embedding array<double>")
    ids = lambda **how: [r.id for r in retrieval.retrieve(c, [0.0, 1.0], 2, **how).collect()]
    assert ids() == ["c5", "c4"] and ids(paper="p", ticker="OTHER", period="FY1999") == ["c2", "c1"]
    scorer = lambda h: h.withColumn("rerank_score", -F.col("similarity"))
    assert ids(scorer=scorer) == ["c0", "c1"] and set(ids(prefer_tables=True)) == {"c5", "c4"}


def test_as_of_ties_nulls_and_empty_sides(spark):
    d = datetime.date
    left = spark.createDataFrame([(1, "a", d(2020, 1, 5)), (2, "a", d(2019, 1, 1)), (3, "a", None), (4, "b", d(2020, 1, 5)), (5, None, d(2020, 1, 5))], "i int, k string, t date")
    right = spark.createDataFrame([("a", d(2020, 1, 5), "x", 1), ("a", d(2020, 1, 5), "y", 2), ("a", d(2020, 1, 6), "z", 3), ("a", None, "n", 4), (None, d(2020, 1, 1), "null", 5)], "k string, at date, v string, n int")
    got = {r.i: (r.v, r.n) for r in joins.as_of(left, right, ["k"], "t", "at", ["v", "n"]).collect()}
    assert got == {1: ("y", 2), 2: (None, None), 3: (None, None), 4: (None, None), 5: ("null", 5)}
    assert joins.as_of(left, right.limit(0), ["k"], "t", "at", ["v"]).where("v is not null").count() == 0 and joins.as_of(left.limit(0), right, ["k"], "t", "at", ["v"]).count() == 0


def test_within_bucket_edges(spark):
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(n)
    points = spark.createDataFrame([(k, "a", day(k)) for k in range(0, 130)] + [(999, "a", None)], "p int, k string, t date")
    spans = spark.createDataFrame([(1, "a", day(0), day(0)), (2, "a", day(30), day(100)), (3, "a", day(50), day(40)), (4, "b", day(0), day(200)), (5, "a", None, day(9))], "s int, k string, a date, b date")
    got = {(r.p, r.s) for r in joins.within(points, spans, ["k"], "t", "a", "b").collect()}
    assert got == {(0, 1)} | {(k, 2) for k in range(30, 101)}


def test_get_or_create_numbers_without_gaps(spark):
    have = spark.createDataFrame([(7, "a"), (3, "a"), (5, None)], "id long, k string")
    want = spark.createDataFrame([("a",), ("a",), (None,)] + [(f"n{k}",) for k in range(50)], "k string")
    got = facts.get_or_create(have, want, ["k"], "id").collect()
    assert {(r.k, r.id) for r in got if not r.created} == {("a", 3), (None, 5)} and sorted(r.id for r in got if r.created) == list(range(8, 58))
    empty = facts.get_or_create(have.limit(0), want, ["k"], "id").collect()
    assert sorted(r.id for r in empty) == list(range(1, 53))


def test_run_reports_of_nothing(spark):
    r = spark.createDataFrame([], "overall_pass boolean, dim boolean, abstention_expected boolean, abstention_accuracy boolean, has_hallucination boolean, latency_ms int, empty_answer boolean")
    got = reports.run_summary(r, ["dim"]).first()
    assert (got.total_cases, got.overall_pct, got.dim_total, got.avg_ms, got.min_ms) == (0, 0.0, 0, 0, 0)
    f = spark.createDataFrame([(1, None, True, True), (2, False, True, None), (3, True, None, None)], "id int, overall boolean, passed boolean, has_hallucination boolean")
    ids = lambda **how: [x.id for x in scoring.filtered(f, flag="overall", **how).orderBy("id").collect()]
    assert ids(outcome="pass") == [1, 3] and ids(outcome="fail") == [2] and ids(outcome="hallucination") == [1]


def test_logs_are_appended(spark, tmp_path):
    log = spark.createDataFrame([("q", "p", 3, "x" * 200, [0.5, 0.25], 10, 20, "m", "abc")], "query_type string, paper_id string, top_k int, query string, scores array<double>, retrieval_ms int, llm_ms int, model string, answer string")
    for _ in range(2):
        files.append_log(files.query_log(log), str(tmp_path / "log"))
    got = spark.read.json(str(tmp_path / "log"))
    assert got.count() == 2 and got.first().latency_ms.total == 30 and len(got.first().query_preview) == 120
    run = files.run_envelope(spark.createDataFrame([(2, True), (1, None)], "id int, passed boolean"), mode="m").first()
    assert (run.total, run.pass_pct, [x.id for x in run.results]) == (2, 50.0, [1, 2])


def test_passages_on_pages(spark):
    df = spark.createDataFrame([("a", "Net sales, rose (by) 5% in Q1.", "Intro text. Net sales rose by 5% in q1 and more"), ("b", "x y", "x y"), ("c", None, "text"), ("d", "", None)], "key string, passage string, page string")
    assert [tuple(r) for r in matching.longest_runs(df).collect()] == [("a", 1, 0, 2, 7)]
    at = [(10.0 * k, 0.0, 10.0 * k + 8, 9.0) for k in range(5)] + [(0.0, 20.0, 8.0, 29.0), (200.0, 20.0, 208.0, 29.0), (300.0, 20.0, 301.0, 29.0)]
    assert matching.boxes([(0, 1, 6)], at) == [(10.0, 0.0, 48.0, 9.0), (0.0, 20.0, 8.0, 29.0), (200.0, 20.0, 208.0, 29.0)]
    assert matching.boxes([(0, 7, 1)], at) == []


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_of_joins_and_aggregates(spark, sf):
    from tallyloom import catalogue

    q = catalogue.queries()
    as_of = plan(q["as_of_filing"](spark, sf))
    assert "NestedLoop" not in as_of and "CartesianProduct" not in as_of and as_of.count("Window") >= 1
    within = plan(q["filings_within_periods"](spark, sf))
    assert "NestedLoop" not in within and "CartesianProduct" not in within
    for name in ("run_summary", "mean_errors", "hallucination_counts", "doc_chunk_counts"):
        text = plan(q[name](spark, sf))
        assert text.count("HashAggregate") >= 2 and "SortAggregate" not in text, name  # partial and final
    best = plan(q["best_fact_reader"](spark, sf))
    assert "BroadcastHashJoin" in best and "SortMergeJoin" not in best  # dimensions under the threshold
    for name in ("cik_lookup", "vector_topk_of_each", "question_hits", "attributed_check"):
        assert "CartesianProduct" not in plan(q[name](spark, sf)), name
    assert "MapInArrow" not in plan(q["attributed_check"](spark, sf)) and "MapInArrow" not in plan(q["facts_context_block"](spark, sf))
