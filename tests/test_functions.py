"""Column functions against literal examples and independent Python restatements on random texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.fixed import PII
from tallyloom.functions import charts, numbers, periods
from tallyloom.functions import text as X
from tallyloom.operators import chunking, tables


def apply(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_periods(spark):
    labels = ["FY2025", "Q2FY2026", "q3-2024", "CY 2020", "H1FY2024", None, ""]
    got = apply(spark, labels, periods.parse_period_label)
    assert [g and tuple(g) for g in got] == [("FY", None, 2025), ("Q", 2, 2026), ("Q", 3, 2024), ("FY", None, 2020), None, None, None]
    assert apply(spark, labels, periods.expected_days) == [365, 91, 91, 365, None, None, None]
    assert [tuple(x) for x in apply(spark, labels, periods.period_sort_key)] == [(2025, 4), (2026, 2), (2024, 3), (2020, 4), (0, 0), (0, 0), (0, 0)]
    asked = ["Revenue in Q2 of fiscal year 2024?", "fy 2023 sales", "what about 2022", "nothing", None]
    assert apply(spark, asked, periods.period_from_query) == ["Q2FY2024", "FY2023", "FY2022", None, None]
    assert apply(spark, ["2020, 2021 and 120222", None], periods.years_mentioned) == [[2020, 2021], []]
    assert [str(d) if d else None for d in apply(spark, ["2024-09-28T00:00", " 2024-01-31", "x", None], periods.to_date)] == ["2024-09-28", "2024-01-31", None, None]


def test_inferred_periods(spark):
    rows = [("2024-09-28", "10-K", 2024, "FY"), ("2024-06-29", "10-Q", 2024, "Q3"), ("2024-06-29", "10-Q/A", None, None), ("2024-09-28", "20-F", None, None), ("2024-09-28", "8-K", None, None), ("2024-06-29", "10-Q", 2024, "FY"), (None, "10-K", None, None)]
    df = spark.createDataFrame(rows, "e string, form string, fy int, fp string")
    got = [r[0] for r in df.select(periods.infer_fiscal_period(F.col("e").cast("date"), F.col("form"), F.col("fy"), F.col("fp"))).collect()]
    assert got == ["FY2024", "Q3FY2024", "Q2FY2024", "FY2024", None, "Q2FY2024", None]


@pytest.mark.parametrize(
    ("name", "want"),
    [("aapl-20250927", ("AAPL", "FY2025", "10-K")), ("ba_20260630_10q", ("BA", "Q2FY2026", "10-Q")), ("jpm_20251231_10k", ("JPM", "FY2025", "10-K")), ("microsoft", ("MSFT", None, None)), ("Alibaba-annual.pdf", ("BA", None, None)), ("xyz", ("XYZ", None, None)), ("quarterly report 8-k", (None, None, "8-K")), ("aapl-20251399", ("AAPL", None, "10-Q")), (None, (None, None, None))],
)
def test_file_names(spark, name, want):
    assert tuple(apply(spark, [name], periods.filing_metadata)[0]) == want


def random_texts(n=300, seed=1):
    rng = random.Random(seed)
    parts = ["word", "Ünï", " ", "  ", "\n", "\t", "\xa0", "12-3456789", "123-45-6789", "a@b.co", "10.0.0.1", "(555) 123-4567", "4111 1111 1111 1111", "DE44500105175407324931", "A12345678", "Acct: 1234 5678", "Note 3", "consolidated", "(in millions)", "|"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(n)] + ["", None, "x " * 20_000]


def test_hash_words_and_redaction_match_python(spark):
    texts = random_texts()
    sha = lambda t: hashlib.sha1(" ".join((t or "").split()).lower().encode()).hexdigest()[:16]
    assert apply(spark, texts, X.content_hash) == [sha(t) for t in texts] == [tables.hash_of(t) for t in texts]
    assert apply(spark, texts, X.words_of) == [(t or "").split() for t in texts]

    def redacted(t):
        counts = {}
        for name, p, mark in PII:
            n = len(re.findall(p, t))
            if n:
                counts[name] = n
            t = re.sub(p, mark, t)
        return t, counts

    ascii_texts = [t for t in texts if t and t.isascii()]
    assert apply(spark, ascii_texts, X.redact) == [redacted(t)[0] for t in ascii_texts]
    assert [{e.entity_type: e.occurrences for e in r} for r in apply(spark, ascii_texts, X.redaction_counts)] == [redacted(t)[1] for t in ascii_texts]
    assert apply(spark, [None], X.redact) == [None]


def test_text_labels(spark):
    assert apply(spark, ["(In millions, except per share amounts)", "Dollars in thousands", "plain", "", None], X.unit_context) == ["In millions, except per share amounts", "Dollars in thousands", None, None, None]
    texts = random_texts(80, 2)
    assert [u or "" for u in apply(spark, texts, X.unit_context)] == [tables.units_in(t) for t in texts]
    assert apply(spark, texts, X.statement_scope) == [tables.scope_of(t) for t in texts]
    assert apply(spark, ["Unconsolidated", "Consolidated statements", "x", None], X.statement_scope) == ["standalone", "consolidated", "unspecified", "unspecified"]
    assert apply(spark, ["(1) restated", "* see", "Note 4: x", "plain"], X.is_footnote) == [True, True, True, False]
    assert apply(spark, ["12 Annual Review – 2025 5", "7", "ACME  report 12"], X.header_key) == ["annual review – 2025", "7", "acme report"]
    assert apply(spark, ["../../etc/pass wd.exe", "Q1 report.PDF", None, "a/b\\c d.csv"], X.safe_file_name) == ["pass_wd.txt", "Q1_report.pdf", "document.txt", "c_d.csv"]
    assert apply(spark, ["a ```chart_data\n{}\n``` b", "a ```chart_data\n{", "plain"], X.visible_answer) == ["a  b", "a", "plain"]
    assert apply(spark, ["x" * 100, "y" * 5], lambda c: F.length(X.clip(c, 50, "-"))) == [51, 5]


def test_numbers(spark):
    df = spark.createDataFrame([(110.0, 100.0, [1.0, 0.0], [1.0, 1.0]), (5.0, 0.0, [0.0, 0.0], [1.0, 1.0]), (None, 1.0, None, None)], "v double, t double, a array<double>, b array<double>")
    r = df.select(numbers.relative_error(F.col("v"), F.col("t")), numbers.change_pct(F.col("t"), F.col("v")), F.round(numbers.cosine(F.col("a"), F.col("b")), 4)).collect()
    assert [tuple(x) for x in r] == [(pytest.approx(0.1), pytest.approx(10.0), 0.7071), (5.0, None, None), (None, None, None)]
    assert apply(spark, [1.5e12, 2.34e9, 5e6, 12.0, None], numbers.short_money, "double") == ["$1.50T", "$2.3B", "$5.0M", "$12", "N/A"]
    line = spark.range(1).select(numbers.fact_line(F.lit("a" * 40), F.lit(1234.5), F.lit("USD")), numbers.fact_line(F.lit("x"), F.lit(0.12345), F.lit(None).cast("string"))).first()
    assert line[0] == "  " + "a" * 40 + " " + "1,234.50".rjust(18) + " USD" and line[1] == "  " + "x".ljust(30) + " " + "0.1235".rjust(18) + " " or line[1].strip().endswith("0.1234")


def test_windows_cover_all_words(spark):
    rng = random.Random(2)
    texts = [(k, " ".join(f"w{j}" for j in range(n))) for k, n in enumerate([0, 1, 299, 300, 301, 570, 571, 840, 841, *(rng.randrange(1500) for _ in range(10))])] + [(99, None), (98, " \n ")]
    df = spark.createDataFrame(texts, "k int, t string")
    got = {}
    for r in chunking.word_windows(df, "k", "t").orderBy("k", "chunk_no").collect():
        got.setdefault(r.k, []).append(r.text.split())
    for k, t in texts:
        ws, want = (t or "").split(), []
        for i in range(0, len(ws), 270):
            want.append(ws[i : i + 300])
            if i + 300 >= len(ws):
                break
        assert got.get(k, []) == want


def test_charts(spark):
    good = 'Text ```chart_data\n{"type": "Area", "x": ["FY23", 24], "series": [{"values": ["1,200", "bad"]}],}\n``` more'
    fallback = '```json\n{"type": "pie", "x": ["a"], "series": [{"name": "n", "values": [1]}]}\n```'
    broken = ["```chart_data\n{not json}\n```", "no chart", None, '```chart_data\n{"x": ["a"], "series": []}\n```', '```chart_data\n{"type": "weird", "x": ["a", "b"], "series": [{"values": [1]}]}\n```']
    a, b, *rest = apply(spark, [good, fallback, *broken], charts.extract)
    assert (a.type, a.title, a.x, a.series[0].name, a.series[0]["values"]) == ("area", "Financial Metrics", ["FY23", "24"], "Series 1", [1200.0, 0.0])
    assert b.type == "pie" and b.series[0]["values"] == [1.0] and rest == [None] * 5
    df = spark.createDataFrame([(["FY 2024", "x"], ["fy-2024"]), (["z"], ["FY2024"])], "x array<string>, p array<string>")
    assert [r[0] for r in df.select(charts.grounded(F.col("x"), F.col("p"))).collect()] == [True, False]
