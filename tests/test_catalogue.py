"""Every query of the catalogue against its SQL, and the plans of some."""

import datetime
import decimal
import hashlib
import math
import re
from pathlib import Path

import duckdb
import pytest

from tallyloom import catalogue
from tallyloom.fixed import PII

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def value(v):
    if isinstance(v, decimal.Decimal | float):
        return None if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in SQL:
        assert rows
        return
    got = duck.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    real = {c for c, t in df.dtypes if t == "double"}
    key = lambda d: tuple(str(value(float(d[c]) if c in real and d[c] is not None else d[c])) for c in columns)
    assert sorted(key(r.asDict()) for r in rows) == sorted(key(dict(zip(names, r))) for r in got.fetchall())


def test_redaction_counts_of_all_types(spark, tmp_path):
    texts = ["SSN 123-45-6789, EIN 12-3456789", "routing 021000021", "card 4111 1111 1111 1111", "IBAN DE89370400440532013000", "a@b.co and c@d.org", "call (212) 555-0199 or +1 212-555-0100", "host 10.0.0.1", "passport C12345678", "Acct: 12-34567 8", "no case", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {(-1, "documents", len(texts))}
    for k, t in enumerate(texts):
        for name, pattern, mark in PII:
            t, n = re.subn(pattern, mark, t or "")
            want |= {(k, name, n)} if n else set()
    assert {name for _, name, _ in want} == {name for name, *_ in PII} | {"documents"}
    rows = [tuple(r) for r in QUERIES["redaction_counts"](spark, str(tmp_path)).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_visible_texts_show_what_is_removed(spark, tmp_path):
    answers = {1: "Up.\n```chart_data\n{1}\n```\nDone.", 2: "Up. ```chart_data {1", 3: "Plain. ", 4: "```chart_data\n{}```", 5: None}
    want = {1: "Up.\n\nDone.", 2: "Up.", 3: "Plain.", 4: ""}
    spark.createDataFrame(list(answers.items()), "result_id long, model_answer string").write.parquet(str(tmp_path / "eval_results.parquet"))
    rows = {tuple(r) for r in QUERIES["visible_texts"](spark, str(tmp_path)).collect()}
    assert rows == {(k, hashlib.md5(v.encode()).hexdigest(), len(v)) for k, v in want.items()}
    c = duckdb.connect()
    c.execute(f"create view eval_results as select * from '{tmp_path}/eval_results.parquet/*.parquet'")
    assert set(c.execute(SQL["visible_texts"]).fetchall()) == rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf):
    best = plan(QUERIES["best_fact_reader"](spark, sf))
    assert "WindowGroupLimit" in best and "BroadcastHashJoin" in best and "PushedFilters: [IsNotNull" in best
    top = plan(QUERIES["vector_topk"](spark, sf))
    assert "TakeOrderedAndProject" in top
    for name, f in QUERIES.items():
        text = plan(f(spark, sf))
        assert "BatchEvalPython" not in text and "CartesianProduct" not in text, name
    pruned = plan(QUERIES["doc_chunk_counts"](spark, sf))
    assert "content" not in pruned.split("ReadSchema")[1]


def test_the_core_stands_without_the_optional_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['tallyloom.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('p1_') for k in e.queries())"
    root = Path(__file__).resolve().parent.parent
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0
