"""Numbers of answers against known cases."""

import pytest

from tallyloom.operators import attribution

# Figures in billions (eps in dollars) of fiscal year 2024.
T = {"revenue": 391.035e9, "net_income": 93.736e9, "operating_cash_flow": 118.254e9, "total_assets": 364.98e9, "eps_diluted": 6.08, "capex": 9.447e9, "gross_profit": 180.683e9, "rd_expense": 31.37e9, "operating_income": 123.216e9}

# Field, answer, and whether an attributed check passes.
WRONG_FIELD_OR_PERIOD = [
    ("revenue", "Apple's cost of revenue for FY2024 was $391.04 billion."),
    ("net_income", "Apple's cost of revenue in FY2024 was approximately $93.74 billion."),
    ("operating_income", "Apple's gross profit for FY2024 was $123.22 billion."),
    ("operating_cash_flow", "Apple's net income for FY2024 was $118.25 billion."),
    ("total_assets", "Apple reported total liabilities of $364.98 billion at the end of FY2024."),
    ("revenue", "Apple's gross profit for FY2024 was $391.04 billion."),
    ("capex", "Apple paid $9.45 billion in dividends in FY2024."),
    ("eps_diluted", "Apple's basic EPS for FY2024 was $6.08."),
    ("revenue", "Apple's revenue in FY2023 was $391.04 billion."),
    ("net_income", "Apple's net income in FY2023 was $93.74 billion."),
    ("operating_cash_flow", "Apple generated operating cash flow of $118.25 billion in FY2023."),
    ("total_assets", "Total assets were $364.98 billion at the end of fiscal year 2023."),
    ("gross_profit", "Apple's cost of revenue in FY2024 was $180.68 billion."),
    ("rd_expense", "Apple's selling, general and administrative expense for FY2024 was $31.37 billion."),
    ("capex", "Capital expenditures in FY2022 were $9.45 billion."),
]
LABELLED = [
    ("revenue", "Apple's total revenue for FY2024 was $391.04 billion, driven by strong iPhone and Services growth.", True),
    ("revenue", "Apple reported net sales of $391 billion in fiscal 2024.", True),
    ("revenue", "In FY2023 Apple had revenue of $383.29 billion. The following year revenue grew to $391.04 billion in FY2024.", True),
    ("revenue", "Cost of sales for FY2024 was $210.4 billion. Operating income reached $123.2 billion.", False),
    ("net_income", "Apple's net income for FY2024 was approximately $93.7 billion.", True),
    ("net_income", "Apple's net income in FY2023 was $96.99 billion.", False),
    ("net_income", "The bottom-line earnings for Apple in fiscal year 2024 came to $93.736 billion.", True),
    ("operating_cash_flow", "Net cash provided by operating activities was $118.25 billion in FY2024.", True),
    ("operating_cash_flow", "Apple's net income was $118.25 billion in FY2024.", False),
    ("total_assets", "Apple's total assets were $364.98 billion as of September 28, 2024.", True),
    ("total_assets", "Total liabilities were $364.98 billion at the end of FY2024.", False),
    ("eps_diluted", "Apple's diluted earnings per share for FY2024 was $6.08.", True),
    ("eps_diluted", "Apple's basic EPS was $6.08 and diluted EPS was $6.08 in FY2024.", True),
    ("capex", "Apple spent $9.45 billion on capital expenditures in FY2024.", True),
    ("capex", "Dividends paid by Apple in FY2024 amounted to $9.45 billion.", False),
    ("gross_profit", "Apple's gross profit in FY2024 was $180.68 billion, representing a 46.2% gross margin.", True),
    ("rd_expense", "Research and development expense totalled $31.37 billion in fiscal 2024.", True),
    ("rd_expense", "SG&A was $31.37 billion in FY2024.", False),
    ("operating_income", "Apple's income from operations for FY2024 was approximately $123.2 billion.", True),
    ("revenue", "I don't have specific figures for Apple's FY2024 revenue in the retrieved context.", False),
]


def passed(spark, cases, **how):
    rows = [(k, a, T[f], f, "FY2024") for k, (f, a, *_) in enumerate(cases)]
    df = spark.createDataFrame(rows, "result_id long, model_answer string, ground_truth_value double, canonical_field string, fiscal_period string")
    got = {r.result_id: r.passed for r in attribution.check_answers(df, **how).collect()}
    return [got[k] for k in range(len(cases))]


def test_none_of_the_wrong_answers_passes_with_attribution_and_all_do_without(spark):
    assert not any(passed(spark, WRONG_FIELD_OR_PERIOD))
    assert all(passed(spark, WRONG_FIELD_OR_PERIOD, attributed=False))


def test_labelled_answers_have_no_false_verdict(spark):
    assert passed(spark, LABELLED) == [v for *_, v in LABELLED]
    plain = passed(spark, LABELLED, attributed=False)
    assert sum(p and not v for p, (*_, v) in zip(plain, LABELLED)) == 4


@pytest.mark.parametrize(("name", "field"), [("revenue", "revenue"), ("fcf_and_pct_revenue", "free_cash_flow"), ("cash_trend", "cash"), ("other_trend", ""), ("", ""), (None, "")])
def test_resolved_fields(name, field):
    assert attribution.resolve_field(name) == field


def test_rows_nulls_and_native_numbers(spark):
    rows = [(1, LABELLED[0][1], T["revenue"], "revenue", "FY2024"), (2, None, 1.0, "revenue", None), (3, "", 1.0, None, None), (4, "x 5 billion", None, "revenue", None), (5, "about 1,234.5 thousand or 7", 1234500.0, "odd", "FY2024")]
    df = spark.createDataFrame(rows, "result_id long, model_answer string, ground_truth_value double, canonical_field string, fiscal_period string")
    got = {r.result_id: r for r in attribution.check_answers(df).collect()}
    assert got[1].passed and got[1].attribution_match.lower() == "total revenue" and not any(got[i].passed for i in (2, 3, 4)) and got[5].passed and not got[5].attribution_checked
    native = {r[0]: r[1] for r in df.select("result_id", attribution.number_values(df.model_answer)).collect()}
    assert native[5] == [1234500.0, 7.0] and native[2] == []
    assert native[1] == [2024.0, 391.04e9]
