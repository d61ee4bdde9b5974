"""Files to stored chunks: parse, chunk, drop repeats, redact, describe."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.fixed import CHUNK_OVERLAP, CHUNK_WORDS
from tallyloom.functions import periods
from tallyloom.functions import text as X
from tallyloom.operators import chunking
from tallyloom.operators import facts as fact_rows
from tallyloom.operators import tables
from tallyloom.session import materialize
from tallyloom.sources import html

C = F.col
_CHUNK = pa.schema(
    [("paper_id", pa.string()), ("file_type", pa.string()), ("problem", pa.string()), ("chunk_id", pa.int32()), ("text", pa.string()), ("word_count", pa.int32()), ("page_number", pa.int32()), ("is_table", pa.bool_()), ("table_caption", pa.string()), ("unit_context", pa.string()), ("section", pa.string()), ("statement_scope", pa.string()), ("content_hash", pa.string())]
)
SCHEMA = "paper_id string, file_type string, problem string, chunk_id int, text string, word_count int, page_number int, is_table boolean, table_caption string, unit_context string, section string, statement_scope string, content_hash string"

class Page(NamedTuple):
    """What a scanner found on one page: texts with their boxes, and tables as box, grid and detected header."""

    number: int
    texts: list[tuple[tables.Box, str]]
    tables: list[tuple[tables.Box, tables.Grid, list[str]]]


#: Scans the content of a PDF into pages, and reads the text of one page without any; none is shipped.
PdfReader = Callable[[str], list[Page]]
TextReader = Callable[[str, int], str]
OCR_LEAST_CHARS = 50


def scanned_blocks(content: str, pdf: PdfReader, ocr: TextReader | None = None) -> list[dict]:
    """Blocks of all pages in reading order, tables stitched over page ends.

    A text reader is asked only for pages with neither text nor table; what it
    gives counts from OCR_LEAST_CHARS characters on. Sections carry on.
    """
    out: list[dict] = []
    section = ""
    for page in pdf(content):
        if page.texts or page.tables:
            found, section = tables.page_blocks(page.number, page.texts, page.tables, section)
            out += found
        elif ocr and len(text := (ocr(content, page.number) or "").strip()) >= OCR_LEAST_CHARS:
            out.append({"kind": "text", "text": text, "page": page.number, "section": section})
    return tables.stitch(out)


def blocks_of(kind: str | None, name: str, content: str, file_type: str = "", pdf: PdfReader | None = None, ocr: TextReader | None = None) -> tuple[list[dict], str | None]:
    """Blocks of one file and what is wrong with it (unknown_type, viewer_stub, near_empty, too_few_rows, no_reader)."""
    if kind == "html":
        wrong = html.problem(content)
        return ([], wrong) if wrong else (html.blocks(content), None)
    if kind == "csv":
        rows = [r for r in csv.reader(io.StringIO(content)) if any(c.strip() for c in r)]
        block = tables.table_block(rows, name.replace("_", " ")) if len(rows) > 1 else None
        return ([block], None) if block else ([], "too_few_rows")
    if kind == "text":
        if file_type in ("json", "xml"):
            try:
                content = json.dumps(json.loads(content), indent=2)
            except ValueError:
                pass
        return [{"kind": "text", "text": content, "page": None, "section": ""}], None
    if kind == "pdf":
        return (scanned_blocks(content, pdf, ocr), None) if pdf else ([], "no_reader")
    return [], "unknown_type"


def document_chunks(files: DataFrame, *, size: int = CHUNK_WORDS, overlap: float = CHUNK_OVERLAP, pdf: PdfReader | None = None, ocr: TextReader | None = None) -> DataFrame:
    """Chunks of files (paper_id, file_type, kind, content); a file that gives none comes out as one row with its problem.

    One document is one row, so no grouping is needed; broken files never stop
    the job. Plain texts are one block, whose windows are column expressions;
    the other kinds need their trees and grids and go through Python.
    """
    plain = (C("kind") == "text") & ~F.coalesce(C("file_type").isin("json", "xml"), F.lit(False))
    return _plain_chunks(files.where(plain), size, overlap).unionByName(_block_chunks(files.where(~F.coalesce(plain, F.lit(False))), size, overlap, pdf, ocr))


def _plain_chunks(files: DataFrame, size: int, overlap: float) -> DataFrame:
    """A bare page number is no text; see `tables.without_running_lines`."""
    text = F.coalesce("content", F.lit(""))
    f = files.select("paper_id", "file_type", F.when(~F.trim(text).rlike(r"(?U)^\s*\d{1,4}\s*$"), text).otherwise("").alias("text"))
    found = chunking.word_windows(f.withColumn("_of", F.struct("paper_id", "file_type")), "_of", "text", size, overlap)
    none = lambda kind: F.lit(None).cast(kind)
    made = found.select(
        C("_of.paper_id").alias("paper_id"), C("_of.file_type").alias("file_type"), none("string").alias("problem"), C("chunk_no").cast("int").alias("chunk_id"), "text", C("word_count").cast("int").alias("word_count"), none("int").alias("page_number"), F.lit(False).alias("is_table"),
        F.lit("").alias("table_caption"), F.lit("").alias("unit_context"), F.lit("").alias("section"), X.statement_scope(C("text")).alias("statement_scope"), X.content_hash(C("text")).alias("content_hash"),
    )
    empty = f.where(F.size(X.words_of(C("text"))) == 0).select("paper_id", "file_type", F.lit("empty").alias("problem"))
    return made.unionByName(empty, allowMissingColumns=True)


def _block_chunks(files: DataFrame, size: int, overlap: float, pdf: PdfReader | None, ocr: TextReader | None) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, ext, kind, content in zip(*(b.column(i).to_pylist() for i in range(4))):
                try:
                    found, wrong = blocks_of(kind, name or "", content or "", ext or "", pdf, ocr)
                    rows = tables.chunk_blocks(found, size, overlap)
                except Exception as e:  # noqa: BLE001 - quarantined with its reason
                    rows, wrong = [], f"broken: {type(e).__name__}"
                base = {"paper_id": name, "file_type": ext}
                out = [base | r for r in rows] or [base | {"problem": wrong or "empty"}]
                yield pa.RecordBatch.from_pylist(out, schema=_CHUNK)

    return files.select("paper_id", "file_type", "kind", "content").mapInArrow(run, SCHEMA)


def stored_chunks(chunks: DataFrame, user_id: str) -> DataFrame:
    """Rows of the chunk table: repeats within a document dropped, renumbered, redacted after hashing, described by file name."""
    good = chunks.where("problem is null")
    first = good.withColumn("_k", F.row_number().over(Window.partitionBy("paper_id", "content_hash").orderBy("chunk_id"))).where("_k = 1")
    first = first.withColumn("chunk_id", F.row_number().over(Window.partitionBy("paper_id").orderBy("chunk_id")) - 1)
    meta = periods.filing_metadata(C("paper_id"))
    return first.select(
        F.concat("paper_id", F.lit("_chunk_"), "chunk_id").alias("id"), F.lit(user_id).alias("user_id"), "paper_id", F.coalesce(meta["ticker"], F.lit("")).alias("ticker"), F.coalesce(meta["fiscal_period"], F.lit("")).alias("fiscal_period"), F.coalesce(meta["form_type"], F.lit("")).alias("form_type"),
        "page_number", "word_count", "file_type", "is_table", "unit_context", "table_caption", "section", "statement_scope", "content_hash", X.redact(C("text")).alias("content"), F.current_timestamp().alias("created_at"),
    )


def quarantined(chunks: DataFrame) -> DataFrame:
    return chunks.where("problem is not null").select("paper_id", "file_type", "problem")


def load(files: DataFrame, store, user_id: str, *, facts: DataFrame | None = None, write_facts: Callable[[DataFrame], None] | None = None, skip_chunks: bool = False, skip_facts: bool = False, dry_run: bool = False, **how) -> DataFrame:
    """Loads files and facts at once; one row a track (chunks, facts, problems) with how many documents and rows it has.

    store: a `ChunkStore`; documents replace what it holds of them. facts go to
    `write_facts`, NaN values as none. Either track can be left out. A dry run
    only counts.
    """
    counts = []
    if not skip_chunks:
        made = materialize(document_chunks(files, **how), "load-chunks")
        rows = stored_chunks(made, user_id)
        if not dry_run:
            store.replace(rows)
        counts += [rows.agg(F.lit("chunks").alias("track"), F.count_distinct("paper_id").alias("documents"), F.count(F.lit(1)).alias("rows")), quarantined(made).agg(F.lit("problems").alias("track"), F.count_distinct("paper_id").alias("documents"), F.count(F.lit(1)).alias("rows"))]
    if not skip_facts and facts is not None:
        landed = fact_rows.keep_earliest(fact_rows.landed(facts))
        if not dry_run and write_facts:
            write_facts(landed)
        counts.append(landed.agg(F.lit("facts").alias("track"), F.count_distinct("filing_id").alias("documents"), F.count(F.lit(1)).alias("rows")))
    return reduce(DataFrame.union, counts) if counts else files.sparkSession.createDataFrame([], "track string, documents long, rows long")
