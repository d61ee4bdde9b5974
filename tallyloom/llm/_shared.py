"""Words, hashes and Arrow helpers that the operators of this package share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import materialize

#: A word is a maximal run of letters or digits, in lower case.
WORD = re.compile(r"[^\W_]+")
#: White space as `str.split()` sees it, for the JVM's and Python's regexes.
WHITE = "\\t-\\r\\x1c-\\x20\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

U64 = np.uint64


class WordHashes(dict):
    """Word -> 64-bit hash; emptied by the caller when it has grown large."""

    def __missing__(self, w: str) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        self[w] = h
        return h

    LIMIT = 400_000

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the public murmur3 constants)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def texts_of(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, max_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most about `max_chars` of `column` (a row is never cut)."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        lens = np.asarray(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False))
        ends = np.cumsum(lens.astype(np.int64))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_chars, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether a written table has at most `max_rows` rows: the check before any broadcast."""
    return df.limit(max_rows + 1).count() <= max_rows


def maybe_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """`df`, to be broadcast if its counted rows allow it; otherwise joined by a shuffle."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def file_kind(c: Column) -> Column:
    """file_type without case, outer blanks and a leading dot; missing or empty: other."""
    k = F.regexp_replace(F.lower(F.trim(c)), r"^\.", "")
    return F.when(k.isNull() | (F.trim(k) == ""), F.lit("other")).otherwise(F.trim(k))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of each connected component. edges: u, v of one type.

    Alternating large-star and small-star steps (Kiveris et al., 2014); each
    round is written to the shared folder with, for every edge, whether it is
    new, so that the end is seen by counting. Nodes with no edge don't come out.
    """
    cur = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc-0")
    for k in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every larger neighbour moves to the smallest of the neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours and the node itself move to the smallest
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        # edges of this round (1) and of the last (2): settled if every edge stands in both
        marked = small.select("u", "v", F.lit(1).alias("b")).union(cur.select("u", "v", F.lit(2).alias("b"))).groupBy("u", "v").agg(F.bit_or("b").alias("b"))
        marked = materialize(marked, f"cc-{k + 1}")
        cur, settled = marked.where("b <> 2").select("u", "v"), marked.where("b <> 3").isEmpty()
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = cur.groupBy("u").agg(F.min("v").alias("root"))
    return stars.select(F.col("u").alias("node"), "root").union(stars.select(F.col("root").alias("node"), "root").distinct())
