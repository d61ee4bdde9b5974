"""Problem 4: oversized chunks cut at natural boundaries.

Method: every gap between two words has a boundary strength. A sparse table
over the strengths (tied strengths rank by position, so ties break rightward)
answers in constant time which cut is strongest in a piece's permissible
window of lengths; the next piece starts `overlap` words before the cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm._shared import WHITE, file_kind, maybe_broadcast, slices, texts_of

TOKEN = re.compile(r"\S+")
_CLOSERS = "\"'”’»)]}*_`"
_PIECES = pa.schema([("id", pa.string()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("page_number", pa.int32()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("max_size", pa.int32()), ("text", pa.string())])
SCHEMA = "id string, piece_no int, n_pieces int, page_number int, first_word int, n_words int, max_size int, text string"
#: A piece that is not the last has at least this share of the limit.
LEAST_SHARE = 0.5
#: Kinds with a limit of their own up to which the table of limits is broadcast.
BROADCAST_KINDS = 100_000


def strengths(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Strength of the cut after each word but the last.

    6 blank line, 5 line end, 4 sentence end before a capital, digit or
    opening mark, 3 other sentence end, 2 colon, semicolon or dash, 1 comma or
    closing bracket, 0 none.
    """
    out = np.zeros(max(len(spans) - 1, 0), np.int64)
    for i in range(len(out)):
        end, start = spans[i][1], spans[i + 1][0]
        gap = text[end:start]
        breaks = sum(map(gap.count, "\n\u2028\u2029")) or gap.count("\r")
        if breaks:
            out[i] = 6 if breaks > 1 else 5
            continue
        last = text[end - 1]
        if last in _CLOSERS:
            core = text[spans[i][0] : end].rstrip(_CLOSERS)
            bracket, last = last in ")]}", core[-1:] or last
        else:
            bracket = False
        if last in ".!?…":
            nxt = text[start]
            out[i] = 4 if nxt.isupper() or nxt.isdigit() or nxt in "\"'“‘«([-*•|" else 3
        elif last in ":;–—" or text[spans[i][0] : end] == "-":
            out[i] = 2
        elif last == "," or bracket:
            out[i] = 1
    return out


class RangeMaximum:
    """Sparse table: the position of the greatest value in any range, the rightmost of equals."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = max(len(values), 1)
        self.levels = [values.astype(np.int64) * self.n + np.arange(len(values))]
        width = 1
        while 2 * width <= len(values):
            low = self.levels[-1]
            self.levels.append(np.maximum(low[:-width], low[width:]))
            width *= 2

    def query(self, lo: int, hi: int) -> int:
        """Position in lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        return int(max(self.levels[k][lo], self.levels[k][hi - (1 << k) + 1])) % self.n


def cut_points(strength: np.ndarray, n: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(first, end) word positions of the pieces of a text of n words."""
    if n <= limit:
        return [(0, n)]
    overlap = max(0, min(overlap, limit - 1))
    least = min(limit, max(overlap + 1, int(limit * LEAST_SHARE)))
    table, out, start = RangeMaximum(strength), [], 0
    while n - start > limit:
        end = table.query(start + least - 1, start + limit - 1) + 1
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(first word, number of words, text) of each piece."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    if len(spans) <= limit or limit < 1:
        return [(0, len(spans), text)]
    return [(a, b - a, text[spans[a][0] : spans[b - 1][1]]) for a, b in cut_points(strengths(text, spans), len(spans), limit, overlap)]


def _split(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "content", 8_000_000):
        rows = []
        for i, page, limit, overlap, t in zip(*(b.column(k).to_pylist() for k in range(4)), texts_of(b, "content")):
            over = limit is not None and len(t.split()) > limit
            if over:
                pieces = split_text(t, limit, overlap or 0)
            elif whole:
                pieces = [(0, len(t.split()), t)]
            else:
                continue
            rows += [(i, k + 1, len(pieces), page, f, n, limit, x) for k, (f, n, x) in enumerate(pieces)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)


def pieces(chunks: DataFrame, limits: DataFrame, *, whole: bool = False) -> DataFrame:
    """The pieces of chunks over the limit of their kind; with `whole`, the other chunks as one piece too.

    chunks: id, content, file_type, page_number; limits: item_kind, size_unit,
    max_size, overlap_size (of several rows of a kind the largest). Words are
    separated by any white space. Kinds without a limit of their own take that
    of `other`; if there is none, nothing is cut. Null contents and ids are
    left out; an id delivered twice comes out once. Consecutive pieces share
    exactly overlap_size words (fewer only if the limit leaves no room).
    """
    own = limits.where("size_unit = 'words' and max_size is not null").groupBy(F.lower("item_kind").alias("kind")).agg(F.max(F.struct("max_size", "overlap_size")).alias("own"))
    other = own.where("kind = 'other'").first()
    most, overlap = (other.own.max_size, other.own.overlap_size) if other else (None, None)
    kinds = chunks.select("id", F.col("page_number").cast("int").alias("page_number"), file_kind(F.col("file_type")).alias("kind"), "content").where("id is not null and content is not null")
    rows = kinds.join(maybe_broadcast(own, BROADCAST_KINDS), "kind", "left").select(
        "id", "page_number", F.coalesce("own.max_size", F.lit(most)).cast("int").alias("max_size"), F.when(F.col("own").isNotNull(), F.col("own.overlap_size")).otherwise(F.lit(overlap)).cast("int").alias("overlap_size"), "content",
    )
    if not whole:  # n words need at least 2 n - 1 characters
        rows = rows.where(F.length("content") > 2 * F.col("max_size"))
    return rows.mapInArrow(partial(_split, whole=whole), SCHEMA).dropDuplicates(["id", "piece_no"])


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """The ids of the chunks that had to be cut."""
    return pieces(chunks, limits).where("piece_no = 1 and n_pieces > 1").select("id")


def rejoined(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """id, n_words, words_md5, fits, least_shared, most_shared of each cut chunk, put together again from its pieces.

    The overlap of every piece but the first is dropped; the words that are
    left are those of the chunk. fits: no piece is over the limit;
    least_shared, most_shared: words that consecutive pieces have in common.
    """
    p = pieces(chunks, limits)
    words_ = F.filter(F.split("text", rf"[{WHITE}]+"), lambda w: w != "")
    start = F.lag("first_word").over(w := Window.partitionBy("id").orderBy("piece_no"))
    shared = F.lag("n_words").over(w) + start - F.col("first_word")
    p = p.withColumn("shared", shared).withColumn("own", F.slice(words_, F.coalesce("shared", F.lit(0)) + 1, F.col("n_words")))
    return p.groupBy("id").agg(
        F.sum(F.size("own")).alias("n_words"), F.md5(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "own"))), lambda x: x["own"])), " ")).alias("words_md5"), (F.max("n_words") <= F.max("max_size")).alias("fits"), F.min("shared").alias("least_shared"), F.max("shared").alias("most_shared"),
    )
