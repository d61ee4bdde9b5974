"""Schemas of the filing model, and reading of tables whose columns have drifted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def _struct(spec: str) -> T.StructType:
    """A flat schema from `name type, ...`; no session is needed."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in spec.split(", "))])


COMPANIES = _struct("company_id long, ticker string, name string, cik string, market string, sector string, user_id string")
FILINGS = _struct("filing_id long, company_id long, form_type string, fiscal_period string, filed_date date, source_url string, user_id string")
FACTS = _struct("fact_id long, filing_id long, tag string, canonical_field string, value double, unit string, period_start date, period_end date, duration_days int, is_instant boolean, source_page string")
CHUNKS = _struct(
    "id string, user_id string, paper_id string, ticker string, fiscal_period string, form_type string, page_number int, word_count int, file_type string, is_table boolean, "
    "unit_context string, table_caption string, section string, statement_scope string, content_hash string, content string, created_at timestamp"
)
QUERY_LOG = _struct("timestamp timestamp, query_type string, paper_id string, top_k int, query_preview string, num_chunks_retrieved int, model string, answer_length_chars int")
QUERY_LOG.add("similarity_scores", T.StructType([T.StructField(n, T.DoubleType()) for n in ("avg", "min", "max")] + [T.StructField("all", T.ArrayType(T.DoubleType()))]))
QUERY_LOG.add("latency_ms", T.StructType([T.StructField(n, T.DoubleType()) for n in ("retrieval", "llm", "total")]))
REDACTION_LOG = _struct("ts timestamp, source string, entity_type string, occurrences int, engine string, snippet string")
NATURAL_KEY = ("filing_id", "tag", "unit", "period_start", "period_end")
#: What a chunk without the column, or with null in it, is read as.
CHUNK_DEFAULTS = {"ticker": "", "fiscal_period": "", "form_type": "", "is_table": False, "unit_context": "", "table_caption": "", "section": "", "statement_scope": "unspecified"}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order: those that `df` lacks as typed nulls, further ones left out."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def with_defaults(chunks: DataFrame) -> DataFrame:
    """Chunks with CHUNK_DEFAULTS in place of nulls."""
    return chunks.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in CHUNK_DEFAULTS.items() if c in chunks.columns})
