"""Word lists, tables, patterns and constants that results depend on."""

# US-GAAP tag to canonical field.
TAG_FIELDS: dict[str, str] = {
    "Revenues": "revenue",
    "RevenueFromContractWithCustomerExcludingAssessedTax": "revenue",
    "SalesRevenueNet": "revenue",
    "RevenueFromContractWithCustomerIncludingAssessedTax": "revenue",
    "GrossProfit": "gross_profit",
    "CostOfRevenue": "cost_of_revenue",
    "CostOfGoodsAndServicesSold": "cost_of_revenue",
    "CostOfGoodsSold": "cost_of_revenue",
    "OperatingIncomeLoss": "operating_income",
    "OperatingExpenses": "operating_expenses",
    "ResearchAndDevelopmentExpense": "rd_expense",
    "SellingGeneralAndAdministrativeExpense": "sga_expense",
    "SellingAndMarketingExpense": "marketing_expense",
    "GeneralAndAdministrativeExpense": "ga_expense",
    "NetIncomeLoss": "net_income",
    "ProfitLoss": "net_income",
    "NetIncomeLossAvailableToCommonStockholdersBasic": "net_income",
    "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments": "pretax_income",
    "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest": "pretax_income",
    "IncomeTaxExpenseBenefit": "income_tax_expense",
    "InterestExpense": "interest_expense",
    "InterestAndDebtExpense": "interest_expense",
    "InterestIncomeExpenseNet": "interest_income",
    "InvestmentIncomeNonoperating": "interest_income",
    "DepreciationDepletionAndAmortization": "depreciation_amortization",
    "DepreciationAndAmortization": "depreciation_amortization",
    "Depreciation": "depreciation_amortization",
    "AmortizationOfIntangibleAssets": "depreciation_amortization",
    "EarningsPerShareBasic": "eps_basic",
    "EarningsPerShareDiluted": "eps_diluted",
    "CommonStockSharesOutstanding": "shares_outstanding",
    "WeightedAverageNumberOfSharesOutstandingBasic": "shares_outstanding",
    "WeightedAverageNumberOfDilutedSharesOutstanding": "shares_outstanding",
    "Assets": "total_assets",
    "AssetsCurrent": "current_assets",
    "CashAndCashEquivalentsAtCarryingValue": "cash",
    "CashAndCashEquivalentsAtCarryingValueIncludingCashEquivalents": "cash",
    "CashCashEquivalentsAndShortTermInvestments": "cash_and_investments",
    "ShortTermInvestments": "short_term_investments",
    "MarketableSecuritiesCurrent": "short_term_investments",
    "AccountsReceivableNetCurrent": "accounts_receivable",
    "InventoryNet": "inventory",
    "OtherAssetsCurrent": "other_current_assets",
    "PropertyPlantAndEquipmentNet": "ppe_net",
    "Goodwill": "goodwill",
    "IntangibleAssetsNetExcludingGoodwill": "intangible_assets",
    "DeferredTaxAssetsNet": "deferred_tax_assets",
    "OtherAssetsNoncurrent": "other_noncurrent_assets",
    "Liabilities": "total_liabilities",
    "LiabilitiesCurrent": "current_liabilities",
    "AccountsPayableCurrent": "accounts_payable",
    "AccruedLiabilitiesCurrent": "accrued_liabilities",
    "DeferredRevenueCurrent": "deferred_revenue_current",
    "LongTermDebt": "long_term_debt",
    "LongTermDebtNoncurrent": "long_term_debt",
    "DeferredTaxLiabilitiesNet": "deferred_tax_liabilities",
    "OtherLiabilitiesNoncurrent": "other_noncurrent_liabilities",
    "StockholdersEquity": "stockholders_equity",
    "CommonStockValue": "common_stock",
    "RetainedEarningsAccumulatedDeficit": "retained_earnings",
    "AccumulatedOtherComprehensiveIncomeLossNetOfTax": "accumulated_oci",
    "NetCashProvidedByUsedInOperatingActivities": "operating_cash_flow",
    "NetCashProvidedByUsedInInvestingActivities": "investing_cash_flow",
    "NetCashProvidedByUsedInFinancingActivities": "financing_cash_flow",
    "PaymentsToAcquirePropertyPlantAndEquipment": "capex",
    "PaymentsForRepurchaseOfCommonStock": "share_repurchases",
    "ProceedsFromIssuanceOfCommonStock": "stock_issuance",
    "PaymentsOfDividendsCommonStock": "dividends_paid",
    "PaymentsOfDividends": "dividends_paid",
    "ProceedsFromLongTermDebt": "debt_issuance",
    "RepaymentsOfLongTermDebt": "debt_repayment",
    "OtherIncomeExpenseNet": "other_income_net",
    "IncomeLossFromDiscontinuedOperationsNetOfTax": "discontinued_operations",
    "BookValuePerShare": "book_value_per_share",
}

# The fields that a facts block shows.
DEFAULT_FIELDS = (
    "revenue", "gross_profit", "cost_of_revenue", "operating_income", "operating_expenses", "rd_expense", "sga_expense", "pretax_income", "income_tax_expense",
    "net_income", "eps_basic", "eps_diluted", "shares_outstanding", "total_assets", "current_assets", "cash", "cash_and_investments", "total_liabilities",
    "current_liabilities", "long_term_debt", "stockholders_equity", "operating_cash_flow", "investing_cash_flow", "financing_cash_flow", "capex", "share_repurchases", "dividends_paid",
)

# Company word in a file name to ticker; the first word found wins.
NAME_TICKERS: dict[str, str] = {
    "tesla": "TSLA", "tsla": "TSLA", "microsoft": "MSFT", "msft": "MSFT", "apple": "AAPL", "aapl": "AAPL", "amazon": "AMZN", "amzn": "AMZN", "google": "GOOGL",
    "alphabet": "GOOGL", "googl": "GOOGL", "meta": "META", "facebook": "META", "nvidia": "NVDA", "nvda": "NVDA", "jpmc": "JPM", "jpmorgan": "JPM", "jpm": "JPM",
    "boeing": "BA", "ba": "BA", "berkshire": "BRK-B", "asml": "ASML", "baba": "BABA", "alibaba": "BABA",
}

# Words of a company name that don't identify it.
GENERIC_NAME_WORDS = (
    "the", "inc", "incorporated", "corp", "corporation", "company", "co", "group", "holding", "holdings", "ltd", "plc", "limited", "international", "business",
    "machines", "general", "american", "united", "national", "standard", "global", "financial", "industries", "systems", "technologies", "solutions", "services",
    "products", "partners", "capital", "trust", "bank", "energy", "health",
)

# Expressions of a question that asks for a number.
NUMERIC_INTENT = (
    "revenue|revenues|sales|net income|operating income|gross profit|earnings|eps|earnings per share|margin|margins|cash flow|free cash flow|capex|capital expenditures?|"
    "r&d|research and development|total assets|assets|liabilities|debt|equity|dividends?|buybacks?|repurchases?|inventory|receivables|how much|what was the|year over year|yoy"
)

# Questions that no filing answers, in the order in which they are tried.
OUT_OF_SCOPE: tuple[tuple[str, str], ...] = (
    ("market_data", r"\b(stock price|share price|closing price|market price|trading price|share quote)\b"),
    ("future_guidance", r"\b(?:revenue|earnings|sales|profit)\s+(?:guidance|outlook|forecast)\b|\bguidance\s+for\s+(?:fy\s*)?20\d\d\b"),
    ("non_disclosed_metric", r"\b(?:number of employees|headcount|staff)\s+(?:per|by|in each)\s+(?:product\s+)?division\b|\bemployees\s+per\s+division\b"),
)

# Personal data patterns, applied in this order, with their placeholders.
PII: tuple[tuple[str, str, str], ...] = (
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    ("EIN", r"\b\d{2}-\d{7}\b", "[EIN]"),
    ("ABA_ROUTING", r"\b(?:0[0-9]|1[0-2]|2[1-9]|3[0-2])\d{7}\b", "[ROUTING]"),
    ("CREDIT_CARD", r"\b(?:\d[ -]?){13,16}\b", "[CARD]"),
    ("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", "[IBAN]"),
    ("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
    ("PHONE", r"\b(?:\+1[\s.\-]?)?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}\b", "[PHONE]"),
    ("IPv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP]"),
    ("PASSPORT", r"\b[A-Z]\d{8}\b", "[PASSPORT]"),
    ("ACCOUNT_REF", r"(?i)\bAcct(?:ount)?\s*[:#]?\s*\d[\d\- ]{6,}\b", "[ACCOUNT]"),
)

# How an answer names a field.
FIELD_ALIASES: dict[str, tuple[str, ...]] = {
    "revenue": ("revenue", "net sales", "total net sales", "total revenue", "net revenue", "top-line", "top line", "sales"),
    "cost_of_revenue": ("cost of revenue", "cost of sales", "cost of goods sold", "cogs", "cost of products", "cost of services"),
    "gross_profit": ("gross profit",),
    "rd_expense": ("research and development", "r&d", "r & d", "research & development", "r and d"),
    "sga_expense": ("selling, general and administrative", "sg&a", "sga", "selling general administrative"),
    "operating_expenses": ("operating expenses", "total operating expenses", "opex"),
    "operating_income": ("operating income", "income from operations", "operating profit", "ebit"),
    "pretax_income": ("pretax income", "pre-tax income", "income before taxes", "income before provision", "earnings before taxes"),
    "income_tax_expense": ("income tax", "provision for income taxes", "tax expense", "income taxes", "tax provision"),
    "net_income": ("net income", "net earnings", "net profit", "bottom line", "bottom-line earnings", "profit"),
    "eps_basic": ("basic earnings per share", "basic eps", "eps basic", "basic net income per share"),
    "eps_diluted": ("diluted earnings per share", "diluted eps", "eps diluted", "diluted net income per share"),
    "cash": ("cash and cash equivalents", "cash equivalents", "cash and short-term investments", "cash balance"),
    "current_assets": ("current assets", "total current assets"),
    "total_assets": ("total assets", "assets"),
    "current_liabilities": ("current liabilities", "total current liabilities"),
    "long_term_debt": ("long-term debt", "long term debt", "term debt", "long-term notes", "senior notes"),
    "total_liabilities": ("total liabilities", "liabilities"),
    "stockholders_equity": ("shareholders equity", "stockholders equity", "shareholders' equity", "stockholders' equity", "total equity", "equity"),
    "operating_cash_flow": ("operating cash flow", "cash from operations", "net cash from operating activities", "net cash provided by operating activities", "net cash generated by operating activities", "cash generated by operating activities", "cash generated from operations", "net cash flows from operating activities", "net cash provided by operations"),
    "capex": ("capital expenditures", "capex", "property plant and equipment", "purchases of property", "payments for property", "capital spending"),
    "share_repurchases": ("share repurchases", "buybacks", "stock repurchases", "repurchase of common stock", "common stock repurchased"),
    "dividends_paid": ("dividends paid", "dividends", "cash dividends", "dividend payments"),
    "gross_margin_pct": ("gross margin", "gross margin percentage", "gross profit margin"),
    "operating_margin_pct": ("operating margin", "operating margin percentage", "operating profit margin"),
    "net_income_margin": ("net margin", "net profit margin", "net income margin"),
    "current_ratio": ("current ratio",),
    "debt_to_equity": ("debt-to-equity", "debt to equity", "debt/equity ratio"),
    "roe": ("return on equity", "roe"),
    "free_cash_flow": ("free cash flow", "fcf"),
}

# Derived measures and the field that their number is attached to.
DERIVED_FIELDS: dict[str, str] = {
    "revenue_yoy_growth": "revenue", "revenue_ttm": "revenue", "revenue_q4fy24": "revenue", "revenue_h1fy24": "revenue", "revenue_2023_ambiguous": "revenue",
    "revenue_unit_clarification": "revenue", "revenue_projected_fy2027": "revenue", "revenue_comparison": "revenue", "revenue_3yr_trend": "revenue",
    "revenue_guidance_fy2025": "revenue", "services_revenue_share_trend": "revenue", "services_revenue_fy2023_derived": "revenue",
    "net_income_most_recent": "net_income", "net_income_yoy_change": "net_income", "net_income_vs_ocf": "net_income", "eps_diluted_cross_check": "eps_diluted",
    "eps_diluted_trend": "eps_diluted", "capex_yoy": "capex", "long_term_debt_trend": "long_term_debt", "long_term_debt_comparison": "long_term_debt",
    "cash_comparison": "cash", "fcf_and_pct_revenue": "free_cash_flow", "free_cash_flow_trend": "free_cash_flow", "rd_pct_revenue_comparison": "rd_expense",
    "gross_margin_yoy": "gross_margin_pct", "operating_income_yoy": "operating_income", "operating_income_trend": "operating_income",
}
DERIVED_SUFFIXES = ("_yoy_growth", "_yoy", "_trend", "_comparison", "_most_recent", "_cross_check", "_ambiguous", "_unit_clarification", "_analysis", "_derived", "_share_trend", "_pct_revenue", "_factcheck")

# Characters folded one to one before numbers and names are looked for.
FOLD_FROM = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212-\u00a0\u2007\u2009\u202f\u2018\u2019\u201c\u201d"
FOLD_TO = " " * 12 + "''\"\""
MAGNITUDES = {"trillion": 1e12, "t": 1e12, "billion": 1e9, "b": 1e9, "million": 1e6, "m": 1e6, "thousand": 1e3, "k": 1e3}

# Question by field.
QUESTIONS: dict[str, str] = {
    "revenue": "What was {name}'s total revenue (net sales) for {period}?",
    "cost_of_revenue": "What was {name}'s cost of revenue (cost of sales) in {period}?",
    "gross_profit": "What was the gross profit for {ticker} in {period}?",
    "rd_expense": "What was {name}'s research and development (R&D) expense in {period}?",
    "sga_expense": "What was {name}'s SG&A expense in {period}?",
    "operating_expenses": "What were the total operating expenses reported by {ticker} in {period}?",
    "operating_income": "What was {name}'s operating income in {period}?",
    "pretax_income": "What was {name}'s income before taxes (pre-tax income) in {period}?",
    "income_tax_expense": "What was the provision for income taxes for {ticker} in {period}?",
    "net_income": "What was the net income reported by {name} ({ticker}) for {period}?",
    "eps_basic": "What was the basic earnings per share (EPS) for {ticker} in {period}?",
    "eps_diluted": "What was the diluted earnings per share (EPS) for {ticker} in {period}?",
    "cash": "What was the cash and cash equivalents balance for {ticker} at the end of {period}?",
    "current_assets": "What were the total current assets for {name} in {period}?",
    "total_assets": "What were the total assets of {name} as of the end of {period}?",
    "current_liabilities": "What were the total current liabilities for {name} in {period}?",
    "long_term_debt": "What is the total long-term debt reported by {ticker} in {period}?",
    "total_liabilities": "What were the total liabilities reported by {ticker} for {period}?",
    "stockholders_equity": "What was the total shareholders' equity for {name} at the end of {period}?",
    "operating_cash_flow": "What was the net cash from operating activities for {ticker} in {period}?",
    "capex": "What were the capital expenditures (payments for property, plant, and equipment) for {ticker} in {period}?",
    "share_repurchases": "How much did {name} spend on share repurchases (buybacks) in {period}?",
    "dividends_paid": "How much did {ticker} pay in dividends in {period}?",
}

EXPECTED_DAYS = {"FY": 365, "Q": 91}
CHUNK_WORDS = 300
CHUNK_OVERLAP = 0.10
BOILERPLATE_WORDS = 12
BOILERPLATE_PAGES = 3
TOLERANCE = 0.02
NOISE_FLOOR = 0.01
WINDOW_LINES = 2
