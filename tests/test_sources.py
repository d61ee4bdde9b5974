"""Landed files and documents."""

import json

from pyspark.sql import functions as F

from tallyloom.plans import answering, ingest
from tallyloom.sources import edgar, files, html
from tallyloom.streaming import windows

HTML = "<html><head><title>t</title></head><body><h1>Item 7. Discussion</h1><p>Sales rose in the year, and so did the cost of everything we bought from our many suppliers.</p><div><p>Income statement</p><p>(in millions)</p><table><tr><td colspan=2>Item</td><td>2024</td><td>2023</td></tr><tr><td>Sales</td><td>1,234.5</td><td>1,100.1</td></tr><tr><td>Cost</td><td>900.0</td><td>800.0</td></tr><tr><td>(1) restated</td></tr></table></div><script>x()</script><table><tr><td>Layout</td><td>only</td></tr></table><p>Mail a@b.co.</p></body></html>"


def test_html_blocks():
    b = html.blocks(HTML)
    assert [x["kind"] for x in b] == ["text", "table", "text", "text"] and all(x["section"] == "Item 7. Discussion" for x in b)
    assert (b[1]["caption"], b[1]["units"], b[1]["headers"], b[1]["footnotes"]) == ("Income statement", "in millions", ["Item", "2024", "2023"], ["(1) restated"])
    assert b[2]["text"] == "Layout only" and "x()" not in html.flat_text(HTML)
    assert html.problem("<p>too short") == "near_empty" and html.problem("<p>loadViewer " + "word " * 50) == "viewer_stub" and html.problem(HTML) is None
    assert html.blocks("") == [] and html.blocks("<p>a<p>b</div></td>") != []


def test_files_to_stored_chunks(spark, tmp_path):
    (tmp_path / "aapl-20250927.html").write_text(HTML)
    (tmp_path / "ba_20260630_10q.csv").write_text("Item,2024\nSales,\"1,234.50\"\nCost,900.10\n")
    (tmp_path / "notes.json").write_text(json.dumps({"a": [1, 2]}))
    (tmp_path / "odd.xyz").write_text("x")
    (tmp_path / "empty.txt").write_text(" \n")
    chunks = ingest.document_chunks(files.read_files(spark, str(tmp_path))).cache()
    assert {(r.paper_id, r.problem) for r in ingest.quarantined(chunks).collect()} == {("odd", "unknown_type"), ("empty", "empty")}
    stored = ingest.stored_chunks(chunks, "u1").collect()
    by = {r.paper_id: r for r in stored}
    assert by["aapl-20250927"].ticker == "AAPL" and by["aapl-20250927"].fiscal_period == "FY2025" and by["ba_20260630_10q"].is_table and by["notes"].content == '{ "a": [ 1, 2 ] }'
    assert any("[EMAIL]" in r.content for r in stored) and not any("a@b.co" in r.content for r in stored)
    found = files.source_of(spark.createDataFrame([("aapl20250927 report",), ("zz",)], "paper_id string"), files.read_files(spark, str(tmp_path)).select("path"))
    assert [(r.paper_id, r.path.rsplit("/", 1)[1]) for r in found.collect()] == [("aapl20250927 report", "aapl-20250927.html")]
    chunks.unpersist()


def test_company_facts(spark):
    f = lambda **k: {"form": "10-K", "fy": 2024, "fp": "FY", "val": 1.0} | k
    doc = {"entityName": "Acme", "facts": {"us-gaap": {
        "Revenues": {"units": {"USD": [f(start="2023-10-01", end="2024-09-28", val=5.0), f(start="2024-07-01", end="2024-09-28", form="10-K/A"), f(start="bad", end="2024-09-28"), f(end="nope"), f(start="2024-01-01", end="2024-03-31", form="10-Q", fp="Q1")]}},
        "EarningsPerShareDiluted": {"units": {"USD/shares": [f(start="2023-10-01", end="2024-09-28", val=None)]}}, "OddThing": {"units": {"pure": [f(instant="2024-09-28", fy=None, fp=None)]}}}}}
    landed = spark.createDataFrame([("1", json.dumps(doc)), ("2", "{}"), ("3", "broken")], "cik string, json string")
    rows = {(r.tag, r.form_type): r for r in edgar.company_facts(landed).collect()}
    assert len(rows) == 4
    r = rows["us-gaap:Revenues", "10-K"]
    assert (r.canonical_field, r.duration_days, r.is_instant, r.fiscal_period, r.value) == ("revenue", 363, False, "FY2024", 5.0)
    e, o = rows["us-gaap:EarningsPerShareDiluted", "10-K"], rows["us-gaap:OddThing", "10-K"]
    assert (e.unit, e.value) == ("USD/share", 0.0) and (o.canonical_field, o.is_instant, o.duration_days, o.fiscal_period) == ("oddThing", True, None, "FY2024")


def test_register_lookups(spark):
    tick = spark.createDataFrame([(json.dumps({"0": {"ticker": "ACM", "title": "Acme Corp", "cik_str": 12}, "1": {"ticker": "BB", "title": "Big Bank", "cik_str": 7}}),)], "json string")
    got = {r["query"]: r.cik for r in edgar.cik_of(spark.createDataFrame([("acm",), ("big bank of x",), ("none",)], "query string"), tick).collect()}
    assert got == {"acm": "0000000012", "big bank of x": "0000000007"}
    recent = {"form": ["8-K", "10-K/A", "10-K"], "filingDate": ["2025-02-01", "2025-01-15", "2024-01-20"], "reportDate": ["", "2024-12-31", "2023-12-31"], "accessionNumber": ["0-1", "0-2", "0-3"], "primaryDocument": ["a", "b", "c"]}
    landed = spark.createDataFrame([("1", 0, json.dumps({"name": "Acme", "filings": {"recent": recent}}))], "cik string, part int, json string")
    pick = lambda y: edgar.primary_filing(landed, "10-k", y).first()
    assert pick(None).document == "b" and pick(2023).document == "c" and pick(1999).document == "b" and pick(2023).accession == "03"


def test_instance_documents(spark):
    xml = """<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:g="http://fasb.org/us-gaap/2026" xmlns:i="http://xbrl.ifrs.org/taxonomy/2025">
    <context id="d"><entity><identifier>1</identifier></entity><period><startDate>2024-01-01</startDate><endDate>2024-12-31</endDate></period></context>
    <context id="s"><entity><segment>x</segment></entity><period><instant>2024-12-31</instant></period></context><context id="p"><entity/><period><instant>2024-12-31</instant></period></context>
    <unit id="u"><measure>iso4217:USD</measure></unit><unit id="e"><divide><unitNumerator><measure>iso4217:USD</measure></unitNumerator><unitDenominator><measure>xbrli:shares</measure></unitDenominator></divide></unit>
    <g:Revenues contextRef="d" unitRef="u">100</g:Revenues><g:Assets contextRef="p" unitRef="none">7.5</g:Assets><g:Assets contextRef="s" unitRef="u">1</g:Assets><g:EarningsPerShareBasic contextRef="d" unitRef="e">1.5</g:EarningsPerShareBasic><g:Policy contextRef="d">text</g:Policy><i:Revenue contextRef="d" unitRef="u">9</i:Revenue></xbrl>"""
    broken = edgar.broken_instances(spark.createDataFrame([("a.xml", xml), ("b.xml", "<broken"), ("c.xml", None)], "path string, xml string")).collect()
    assert sorted(r.path for r in broken) == ["b.xml", "c.xml"] and all(r.problem.startswith("broken: ") for r in broken)
    rows = {r.tag: r for r in edgar.instances(spark.createDataFrame([("a.xml", xml), ("b.xml", "<broken"), ("c.xml", None)], "path string, xml string")).collect()}
    assert set(rows) == {"us-gaap:Revenues", "us-gaap:Assets", "us-gaap:EarningsPerShareBasic"}
    assert (rows["us-gaap:Revenues"].duration_days, rows["us-gaap:Assets"].unit, rows["us-gaap:EarningsPerShareBasic"].unit, rows["us-gaap:Assets"].canonical_field) == (365, "USD", "USD/share", "total_assets")


def test_runs_logs_and_exports(spark, tmp_path):
    for name, n in (("eval50_b", 2), ("eval_a", 1)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"run_timestamp": "2026-01-01T00:00:00", "summary": {}, "results": [{"id": k, "passed": True} for k in range(n)]}))
    runs = files.read_runs(spark, str(tmp_path)).orderBy("priority", F.desc("file")).collect()
    assert [(r.file, r.id) for r in runs] == [("eval50_b.json", 0), ("eval50_b.json", 1), ("eval_a.json", 0)]
    q = spark.createDataFrame([("qa", "p", 3, "q" * 200, [0.5, 0.7], 10.0, 20.0, "m", "answer")], "query_type string, paper_id string, top_k int, query string, scores array<double>, retrieval_ms double, llm_ms double, model string, answer string")
    r = files.query_log(q).first()
    assert (len(r.query_preview), r.num_chunks_retrieved, r.similarity_scores.avg, r.latency_ms.total, r.answer_length_chars) == (120, 2, 0.6, 30.0, 6)
    log = files.redaction_log(spark.createDataFrame([("mail a@b.co and c@d.org",), ("none",), (None,)], "text string"), "test").collect()
    assert [(x.entity_type, x.occurrences, x.snippet) for x in log] == [("EMAIL", 2, "mail [EMAIL] and [EMAIL]")]
    files.export_csv(q, ["model", "gone"], str(tmp_path / "out"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).columns == ["model"]
    assert [x[0] for x in spark.createDataFrame([("Disk full",), ("Timed out",), ("?",)], "m string").select(files.friendly_error(F.col("m"))).collect()] == ["storage_full", "timeout", "other"]


def test_prompts_and_finished_answers(spark):
    co = spark.createDataFrame([(1, "AA", "Acme", "US")], "company_id long, ticker string, name string, market string")
    fl = spark.createDataFrame([(1, 1, "10-K", "FY2024", None)], "filing_id long, company_id long, form_type string, fiscal_period string, filed_date date")
    ff = spark.createDataFrame([(1, 1, "2024-12-31")], "fact_id long, filing_id long, e string").select("fact_id", "filing_id", F.col("e").cast("date").alias("period_end"))
    q = spark.createDataFrame([(1, "What was AA revenue in FY2024?"), (2, "AA stock price?"), (3, "acme in 2031")], "query_id int, question string")
    route = answering.routed(q, ff, fl, co)
    assert {(r.query_id, r.ticker, r.abstain) for r in route.collect()} == {(1, "AA", None), (2, "AA", "market_data"), (3, "AA", "non_existent_period")}
    blocks = spark.createDataFrame([("AA", "FY2024", "FACTS")], "ticker string, fiscal_period string, block string")
    assert [tuple(r) for r in answering.prompts(route, blocks).collect()] == [(1, "FACTS\n\nQuestion: What was AA revenue in FY2024?")]
    a = spark.createDataFrame([(1, "AA", 'x ```chart_data\n{"type":"bar","x":["FY2024"],"series":[{"values":[1]}]}\n```'), (2, "ZZ", "plain")], "query_id int, ticker string, answer string")
    assert {(r.query_id, r.text, r.chart_grounded) for r in answering.finished(a, blocks).collect()} == {(1, "x", True), (2, "plain", False)}


def test_incremental_ingestion(spark, tmp_path):
    src, seen = str(tmp_path / "src"), []
    spark.range(3).write.parquet(src)
    run = lambda: windows.ingest(spark, src, "id long", str(tmp_path / "cp"), lambda df, i: seen.extend(r.id for r in df.collect())).awaitTermination(60)
    run()
    spark.range(3, 5).write.mode("append").parquet(src)
    run()
    run()
    assert sorted(seen) == [0, 1, 2, 3, 4]
