"""Facts, chunks, retrieval, tables and scoring on small fixtures."""

from datetime import date as D

from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.operators import chunking, facts, retrieval, routing, scoring, tables

FACT = "fact_id long, filing_id long, tag string, canonical_field string, value double, unit string, period_start date, period_end date, duration_days int, is_instant boolean, source_page string, ticker string, fiscal_period string"


def fact(i, days, end, value=1.0, label="FY2024", tag="t", start=None):
    return (i, 1, tag, "revenue", value, "USD", start, end, days, days is None, None, "AA", label)


def test_choosers(spark):
    rows = [fact(1, 91, D(2024, 9, 28)), fact(2, 364, D(2024, 9, 28)), fact(3, 364, D(2023, 9, 30)), fact(4, None, D(2022, 1, 1)), fact(5, 364, D(2024, 9, 28), tag="a")]
    df = spark.createDataFrame(rows, FACT)
    best = lambda rule, d=df: [r.fact_id for r in facts.best_fact(d, rule).collect()]
    assert best("reader") == [4] and best("eval") == [4]  # an unknown duration has no penalty
    assert best("dashboard") == [5] and best("golden") == [5]
    assert best("reader", df.where("fact_id <> 4")) == [5]
    shuffled = df.repartition(7)
    assert all(best(r, shuffled) == best(r) for r in ("reader", "eval", "dashboard", "golden"))
    assert best("reader", df.limit(0)) == []


def test_keyed_writes_are_idempotent(spark):
    rows = [fact(1, 91, D(2024, 9, 28)), fact(2, 91, D(2024, 9, 28)), fact(3, None, None), fact(4, None, None)]
    df = spark.createDataFrame(rows, FACT)
    assert sorted(r.fact_id for r in facts.keep_earliest(df).collect()) == [1, 3]
    new = facts.insert_ignore(df.limit(0), df)
    assert sorted(r.fact_id for r in new.collect()) == [1, 3] and facts.insert_ignore(new, df).count() == 0
    old = spark.createDataFrame([("a", "T", "x", 1), ("b", "T", None, 2)], "id string, ticker string, content string, word_count int")
    fresh = spark.createDataFrame([("b", "N", "y", 3), ("c", "N", None, 4)], old.schema)
    up = chunking.upsert(old, fresh)
    assert sorted(tuple(r) for r in up.collect()) == [("a", "T", "x", 1), ("b", "T", "y", 3), ("c", "N", None, 4)]
    assert sorted(tuple(r) for r in chunking.upsert(up, fresh).collect()) == sorted(tuple(r) for r in up.collect())


def test_drifted_schema(spark):
    df = spark.createDataFrame([(1, 2, "t")], "fact_id long, filing_id int, extra string")
    got = schemas.conform(df, schemas.FACTS)
    assert got.schema.names == schemas.FACTS.names and got.first().duration_days is None
    c = schemas.with_defaults(spark.createDataFrame([(None, None)], "ticker string, is_table boolean")).first()
    assert (c.ticker, c.is_table) == ("", False)


def test_growth_and_trailing(spark):
    q = [(k, 1, "t", "revenue", float(k), "USD", None, D(2024, 3 * k, 28) if k < 5 else D(2025, 3, 28), 91, False, None, "AA", f"Q{(k - 1) % 4 + 1}FY{2024 + (k > 4)}") for k in range(1, 6)]
    df = spark.createDataFrame(q, FACT)
    assert [r.trailing_sum for r in facts.trailing(df).orderBy("fiscal_period").collect()] == [None, 14.0, None, None, 10.0]
    k = facts.latest_and_prior(df).first()
    assert (k.value, k.prior_value, k.prior_delta_pct) == (5.0, 4.0, 25.0)


def test_ladder_takes_the_first_rung_that_any_chunk_meets(spark):
    rows = [("a", "T", "FY1", "consolidated", True, [1.0, 0.0]), ("b", "T", "FY2", "unspecified", False, [0.0, 1.0]), ("c", "U", "FY1", "unspecified", True, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, ticker string, fiscal_period string, statement_scope string, is_table boolean, embedding array<double>")
    run = lambda **f: [(r.id, r.level) for r in retrieval.ladder(df, [1.0, 0.0], 5, retrieval.relaxation(**f)).collect()]
    assert run(ticker="t", period="FY1", scope="consolidated", is_table=True) == [("a", 0)]
    assert run(ticker="t", period="FY1", scope="standalone", is_table=True) == [("a", 1)]
    assert run(ticker="t", period="FY9", scope="standalone", is_table=True) == [("a", 2)]
    assert run(ticker="t", period="FY2", scope="unspecified", is_table=True) == [("a", 2)]
    assert run(ticker="u", period="FY9", is_table=False) == [("c", 4)] and run(ticker="x") == []
    both = retrieval.table_first(df, [1.0, 0.0], 1)
    assert {(r.id, r.group_no) for r in both.collect()} == {("a", 0), ("c", 0), ("b", 1)}
    assert [r.id for r in retrieval.rerank(df.withColumn("similarity", F.lit(0.5)), lambda h: h.withColumn("rerank_score", F.length("ticker") + F.ascii("id")), 2).collect()] == ["c", "b"]


def test_companies_and_scope_of_questions(spark):
    co = spark.createDataFrame([(1, "ZZT", "The Apple Holdings"), (2, "BB", "Global Bank"), (3, None, "None")], "company_id long, ticker string, name string")
    q = spark.createDataFrame([(1, "How is ZZT doing in Q2 2024?", None), (2, "apple sales?", None), (3, "zzt", None), (4, None, None), (5, "what?", "bb_20240630_10q")], "query_id int, question string, paper_id string")
    got = {r.query_id: (r.ticker, r.fiscal_period) for r in routing.resolve_scope(q, co).collect()}
    assert got == {1: ("ZZT", "Q2FY2024"), 2: ("ZZT", None), 3: (None, None), 4: (None, None), 5: ("BB", "Q2FY2024")}
    cases = [("Current share price?", "market_data"), ("revenue guidance", "future_guidance"), ("headcount per division", "non_disclosed_metric"), ("sales in 2030", "non_existent_period"), ("sales in 2024", None), (None, None)]
    df = spark.createDataFrame([(a,) for a, _ in cases], "q string")
    assert [r[0] for r in df.select(routing.abstention(F.col("q"), F.lit("2024-12-31").cast("date"))).collect()] == [c for _, c in cases]
    t, p = routing.retrieval_scope(F.lit("AAPL_MSFT"), F.lit("FY2023_to_FY2024"))
    assert tuple(spark.range(1).select(t, p).first()) == ("AAPL", None)


def test_scores(spark):
    df = spark.createDataFrame([("x", True, None, 10), ("x", False, True, 0), ("y", None, None, None)], "cat string, a boolean, b boolean, latency_ms int")
    assert {(r.cat, r.total, r.passed, r.accuracy) for r in scoring.pass_rates(df, "cat", flag="a").collect()} == {("x", 2, 1, 50.0), ("y", 0, 0, 0.0)}
    assert {(r.cat, r.a, r.b) for r in scoring.score_matrix(df, "cat", ["a", "b"]).collect()} == {("x", 50.0, 100.0), ("y", None, None)}
    assert tuple(scoring.latency(df).first()) == (10, 10, 10)
    assert [r.n for r in scoring.histogram(df.withColumn("s", F.lit(3)), "s", range(1, 6)).orderBy("bucket").collect()] == [0, 0, 3, 0, 0]
    o = df.select(scoring.overall([F.col("a"), F.col("b")])).collect()
    assert [r[0] for r in o] == [True, False, False]
    s = spark.createDataFrame([([0.5, 0.25],), ([],)], "v array<double>").select(scoring.similarity_summary(F.col("v")).alias("s")).collect()
    assert [tuple(r.s) for r in s] == [(0.375, 0.25, 0.5), (0.0, 0.0, 0.0)]


def test_running_lines(spark):
    rows = [("p", n, t) for n in (1, 2, 3) for t in (f"ACME Review {n}", str(n), f"real text on page {n} about many different things")] + [("p", 1, ""), ("q", None, "Foot"), ("q", None, "Foot"), ("q", None, "Foot"), ("q", None, None)]
    df = spark.createDataFrame(rows, "paper_id string, page_number int, line string")
    left = {r.line for r in chunking.drop_running_lines(df).collect()}
    assert not {"ACME Review 1", "1", "Foot"} & left and len([x for x in left if x and x.startswith("real")]) == 3


def test_tables():
    grid = [["", "Three Months Ended", ""], ["Line Item", "June 30, 2024", "June 30, 2023"], ["Sales|net", "1,234.50", "1,100.25"], ["", "", ""], ["Cost", "900.10", "800.20"]]
    t = tables.table_block(grid, "Income statement (in millions)", page=3)
    assert t["headers"] == ["Line Item", "Three Months Ended - June 30, 2024", "Three Months Ended - June 30, 2023"] and len(t["rows"]) == 2
    spacer = tables.table_block([["Item", "", "2024", "2023"], ["Sales", "", "1,234.5", "1.0"], ["Cost", "", "9.5", "2.0"]])
    assert spacer["headers"] == ["Item", "2024", "2023"]
    bare = tables.table_block([["Sales", "1,234.5"], ["Cost", "9.5"]])
    assert bare["headers"] == ["Particulars", "Col_2"] or bare["headers"][0] == "Particulars"
    assert tables.is_statement(grid) and not tables.is_statement([["Name", "Street"], ["A", "B"]]) and tables.table_block([["", None]]) is None
    one = tables.markdown_chunks(t)
    assert len(one) == 1 and "Sales\\|net" in one[0]["text"] and "Page: 3" in one[0]["text"]
    long = t | {"rows": [[f"Item {k}", "1,000.00", "2,000.00"] for k in range(200)], "footnotes": ["(1) note"]}
    parts = tables.markdown_chunks(long, 120)
    assert len(parts) > 5 and all(p["text"].splitlines()[1] == one[0]["text"].splitlines()[1] for p in parts) and parts[-1]["text"].endswith("- (1) note") and sum(p["text"].count("| Item ") for p in parts) == 200
    assert f"(Part 1/{len(parts)})" in parts[0]["text"] and all(p["word_count"] <= 120 + 20 for p in parts)
    nxt = long | {"page": 4, "last_page": 4, "rows": [["x", "1.0", "2.0"]], "footnotes": ["(1) note", "(2) more"]}
    s = tables.stitch([long, nxt, {"kind": "text", "text": "x", "page": 4, "section": ""}, nxt | {"page": 5, "last_page": 5}])
    assert [b["kind"] for b in s] == ["table", "text", "table"] and len(s[0]["rows"]) == 201 and s[0]["last_page"] == 4 and s[0]["footnotes"] == ["(1) note", "(2) more"]
    assert tables.spread_hint(["Stand", "dalone", "", "Consol", "idated"], 5) == ["Standalone", "Standalone", "", "Consolidated", "Consolidated"]


def test_pages_and_packing():
    table = ((0, 100, 200, 200), [["Item", "2024"], ["Sales", "1,234.5"], ["Cost", "900.5"]], [])
    texts = [((0, 80, 100, 90), "Income statement"), ((0, 60, 100, 70), "(in thousands)"), ((10, 120, 50, 130), "1,234.5"), ((0, 210, 90, 220), "(1) restated"), ((0, 10, 90, 20), "Item 7. Discussion")]
    blocks, section = tables.page_blocks(2, texts, [table])
    assert section == "Item 7. Discussion" and [b["kind"] for b in blocks] == ["text", "text", "text", "table", "text"]
    t = blocks[3]
    assert (t["caption"], t["units"], t["footnotes"]) == ("Income statement", "in thousands", ["(1) restated"])
    small = [{"kind": "text", "text": f"w{k} " * 100, "page": 1, "section": ""} for k in range(4)] + [{"kind": "text", "text": "other page", "page": 2, "section": ""}]
    assert [len(b["text"].split()) for b in tables.pack(small, 300)] == [300, 100, 2]
    assert tables.chunk_blocks([]) == [] and tables.chunk_blocks([{"kind": "text", "text": "7", "page": 1, "section": ""}]) == []
