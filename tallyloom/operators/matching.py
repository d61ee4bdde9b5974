"""Where a passage stands on a page: tokens, their longest common runs, and the boxes to mark."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what a token is.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9.,%$€£'\-]*"
#: Runs of fewer tokens say nothing, and only the longest few are shown.
LEAST_RUN, MOST_RUNS, MOST_BOXES = 3, 3, 12
#: Boxes on one line at most so far apart (points) become one.
LINE_GAP, WORD_GAP = 4.0, 60.0
_RUNS = pa.schema([("key", pa.string()), ("run_no", pa.int32()), ("passage_at", pa.int32()), ("page_at", pa.int32()), ("size", pa.int32())])

Box = tuple[float, float, float, float]


def tokens(c: Column) -> Column:
    """The tokens of a text in lower case, without the marks around them; none for null."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), 0)
    return F.filter(F.transform(found, lambda t: F.regexp_replace(F.lower(t), r"""^[.,;:()\[\]'"]+|[.,;:()\[\]'"]+$""", "")), lambda t: t != "")


def runs(passage: list[str], page: list[str], least: int = LEAST_RUN, most: int = MOST_RUNS) -> list[tuple[int, int, int]]:
    """(place in the passage, place on the page, size) of the longest common runs, the longest first, then by place in the passage."""
    blocks = [b for b in SequenceMatcher(None, passage, page, autojunk=False).get_matching_blocks() if b.size >= least]
    return [(b.a, b.b, b.size) for b in sorted(blocks, key=lambda b: (-b.size, b.a))[:most]]


def boxes(places: list[tuple[int, int, int]], at: list[Box]) -> list[Box]:
    """The boxes of the runs' tokens on the page, neighbours on a line merged; slivers and all but the first few are left out."""
    out: list[Box] = []
    for _, start, size in places:
        open_: Box | None = None
        for x0, y0, x1, y1 in at[start : start + size]:
            if open_ and abs(y0 - open_[1]) < LINE_GAP and x0 - open_[2] < WORD_GAP:
                open_ = (min(open_[0], x0), min(open_[1], y0), max(open_[2], x1), max(open_[3], y1))
            else:
                out += [open_] if open_ else []
                open_ = (x0, y0, x1, y1)
        out += [open_] if open_ else []
    return [b for b in out if b[2] - b[0] > 2 and b[3] - b[1] > 2][:MOST_BOXES]


def _runs(batches: Iterator[pa.RecordBatch], least: int, most: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(k, n, *r) for k, p, q in zip(*(b.column(i).to_pylist() for i in range(3))) for n, r in enumerate(runs(p, q, least, most), 1)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RUNS)], schema=_RUNS)


def longest_runs(pairs: DataFrame, *, least: int = LEAST_RUN, most: int = MOST_RUNS) -> DataFrame:
    """key, run_no, passage_at, page_at, size of the longest common runs of every passage and page (key, passage, page as texts)."""
    rows = pairs.select(F.col("key").cast("string").alias("key"), tokens(F.col("passage")).alias("p"), tokens(F.col("page")).alias("q"))
    return rows.mapInArrow(partial(_runs, least=least, most=most), "key string, run_no int, passage_at int, page_at int, size int")
