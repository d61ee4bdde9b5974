"""Documents to chunks: windows, hashes, duplicates, running headers and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.fixed import BOILERPLATE_PAGES, BOILERPLATE_WORDS, CHUNK_OVERLAP, CHUNK_WORDS
from tallyloom.functions import text as X

C = F.col


def word_windows(df: DataFrame, key: str, text: str, size: int = CHUNK_WORDS, overlap: float = CHUNK_OVERLAP) -> DataFrame:
    """key, chunk_no from 0, word_count, text: windows of `size` words that share `overlap` with the next.

    The last window is the first that reaches the end; texts without a word
    have none. The number of windows is computed, so nothing is generated to
    be thrown away.
    """
    step = max(1, size - int(size * overlap))
    w = df.select(F.col(key), X.words_of(C(text)).alias("_w")).where(F.size("_w") > 0)
    n = F.size("_w")
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(step)) + 1).cast("int")
    w = w.select(key, "_w", F.posexplode(F.sequence(F.lit(0), count - 1)).alias("_p", "chunk_no"))
    part = F.slice("_w", C("chunk_no") * step + 1, size)
    return w.select(key, "chunk_no", F.size(part).alias("word_count"), F.array_join(part, " ").alias("text"))


def first_of_hash(df: DataFrame, document: str, order: str, text: str) -> DataFrame:
    """Keeps a document's first chunk of each content hash and numbers what is left from 0."""
    h = df.withColumn("content_hash", X.content_hash(C(text)))
    h = h.withColumn("_k", F.row_number().over(Window.partitionBy(document, "content_hash").orderBy(order))).where("_k = 1").drop("_k")
    return h.withColumn("chunk_id", F.row_number().over(Window.partitionBy(document).orderBy(order)) - 1)


def running_lines(lines: DataFrame, document: str = "paper_id", page: str = "page_number", text: str = "line") -> DataFrame:
    """document, key, occurrences, pages of the short lines that repeat on several pages.

    Lines without a page count by occurrence.
    """
    short = lines.where((F.trim(text) != "") & (F.size(X.words_of(C(text))) <= BOILERPLATE_WORDS)).withColumn("key", X.header_key(C(text))).where("key <> ''")
    per_page = short.groupBy(document, "key", page).agg(F.count(F.lit(1)).alias("n"))
    by = per_page.groupBy(document, "key").agg(F.sum("n").alias("occurrences"), F.count(page).alias("pages"))
    return by.where(F.when(C("pages") > 0, C("pages")).otherwise(C("occurrences")) >= BOILERPLATE_PAGES)


def drop_running_lines(lines: DataFrame, document: str = "paper_id", page: str = "page_number", text: str = "line") -> DataFrame:
    """The lines without running headers and bare page numbers."""
    bad = running_lines(lines, document, page, text).select(document, C("key").alias("_key"))
    short = F.size(X.words_of(C(text))) <= BOILERPLATE_WORDS
    kept = lines.where(~F.trim(text).rlike(r"^\d{1,4}$")).withColumn("_key", F.when(short, X.header_key(C(text))))
    return kept.join(bad, [document, "_key"], "left_anti").drop("_key")


#: What an upsert overwrites; ticker, period, form, file type and owner stay.
UPDATED = ("content", "page_number", "word_count", "is_table", "unit_context", "table_caption", "section", "statement_scope", "content_hash")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", updated: Sequence[str] = UPDATED) -> DataFrame:
    """Old rows with the updated columns of the new row of their key, and the new rows of other keys.

    Both sides have one row a key and the same columns.
    """
    j = old.withColumn("_has_old", F.lit(True)).alias("o").join(new.withColumn("_has_new", F.lit(True)).alias("n"), key, "full_outer")
    hit, was = C("_has_new").isNotNull(), C("_has_old").isNotNull()
    pick = lambda c: F.when(hit & (~was | F.lit(c in updated)), C(f"n.{c}")).otherwise(C(f"o.{c}")).alias(c)
    return j.select(*[C(key) if c == key else pick(c) for c in old.columns])


def replace_documents(old: DataFrame, new: DataFrame, document: str = "paper_id") -> DataFrame:
    """The old chunks of other documents and all new chunks: no stale chunk of a document that shrank stays."""
    return old.join(new.select(document).distinct(), document, "left_anti").unionByName(new)
