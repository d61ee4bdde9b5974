"""Problem 6: texts packed into containers of a fixed number of tokens.

Method: hierarchical multi-length packing. Items are routed to tiers by
context size (the capacity, its half, quarter and so on). Long windows come
first; the gap of a window is filled from its own tier and then from shorter
tiers, always with the longest item that fits; what is left of a tier is
packed likewise. Containers are dealt to step groups in turn, so that all
groups hold the same mix of tiers and nearly the same number of tokens.

The packing is planned on the histogram of lengths, which has at most as many
entries as the container has tokens whatever the number of documents. A plan
is a list of patterns with multiplicities; an item finds its container from
its length and its rank among the items of that length. Ranks are taken within
buckets of a hash and added to the counts of the earlier buckets, so a length
that a third of all items share is still spread over all tasks.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm._shared import slices, texts_of
from tallyloom.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public byte-level vocabulary splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same split for texts of ASCII characters only, for Python's faster regex module.
_ASCII_SPLIT = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+""")
STEP_GROUP = 64
BUCKET_ITEMS = 50_000
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("token_start", pa.int64()), ("n_tokens", pa.int32()), ("all_tokens", pa.int64())])


class TokenCounter:
    """Number of tokens of a text; counts of split pieces are remembered."""

    LIMIT = 300_000

    def __init__(self, path: str) -> None:
        import tiktoken
        from pyspark import SparkFiles

        # a vocabulary that the driver shipped with addFile has no path of its own on an executor
        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        encode = self._encode

        class Counts(dict):
            def __missing__(self, piece: str) -> int:
                n = len(encode(piece))
                self[piece] = n
                return n

        self._counts = Counts()

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if not text.isascii():
            return len(self._encode(text))
        if len(self._counts) > self.LIMIT:
            self._counts.clear()
        return sum(map(self._counts.__getitem__, _ASCII_SPLIT.findall(text)))


def _items(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    count = TokenCounter(path)
    for b in slices(batches, "text"):
        ids = b.column(0).to_numpy()
        n = np.fromiter(map(count, texts_of(b, "text")), np.int64, b.num_rows)
        pieces = np.maximum(-(-n // capacity), 1)
        row = np.repeat(np.arange(len(n)), pieces)
        no = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = no * capacity
        size = np.minimum(n[row] - start, capacity)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row], pa.int64()), pa.array(no + 1, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(n[row], pa.int64())], schema=_PIECES)


def plan(histogram: dict[int, int], capacity: int, tiers: int = 4) -> tuple[np.ndarray, int]:
    """Segments (length, rank from, container base, items a container, slot start) and the number of containers.

    Rank r of a length lies in the last segment from <= r; its container is
    base + (r - from) // items, its start in the container slot + ((r - from)
    % items) * length. Each pattern uses up at least one length, so there are
    at most as many patterns as lengths.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, k in histogram.items():
        if n > 0:
            left[n] = k
    bounds = [capacity >> t for t in range(tiers)] + [0]
    used, segments, containers = np.zeros_like(left), [], 0
    for tier in range(tiers):
        while True:
            own = np.flatnonzero(left[bounds[tier + 1] + 1 : bounds[tier] + 1])
            if not len(own):
                break
            longest = int(own[-1]) + bounds[tier + 1] + 1
            pattern, gap, free = [(longest, 1)], capacity - longest, left.copy()
            free[longest] -= 1
            for below in range(tier, tiers):  # the window's own tier, then shorter ones
                while gap > bounds[below + 1]:
                    fit = np.flatnonzero(free[bounds[below + 1] + 1 : min(gap, bounds[below]) + 1])
                    if not len(fit):
                        break
                    n = int(fit[-1]) + bounds[below + 1] + 1
                    k = int(min(free[n], gap // n))
                    pattern.append((n, k))
                    free[n] -= k
                    gap -= n * k
            need: dict[int, int] = {}
            for n, k in pattern:
                need[n] = need.get(n, 0) + k
            times = min(int(left[n]) // k for n, k in need.items())
            slot = 0
            for n, k in need.items():
                segments.append((n, int(used[n]), containers, k, slot))
                slot += n * k
                used[n] += times * k
                left[n] -= times * k
            containers += times
    return np.array(segments, np.int64).reshape(-1, 5), containers


def _assign(batches: Iterator[pd.DataFrame], segments: np.ndarray, stride: int, groups: int) -> Iterator[pd.DataFrame]:
    key = segments[:, 0] * stride + segments[:, 1]
    order = np.argsort(key, kind="stable")
    seg, key = segments[order], key[order]
    for b in batches:
        n, r = b["n_tokens"].to_numpy(np.int64), b["rank"].to_numpy(np.int64)
        if len(seg):
            s = seg[np.maximum(np.searchsorted(key, n * stride + r, side="right") - 1, 0)]
            container = s[:, 2] + (r - s[:, 1]) // s[:, 3]
            slot = s[:, 4] + (r - s[:, 1]) % s[:, 3] * n
        else:
            container = slot = np.zeros(len(b), np.int64)
        out = b[["doc_id", "piece_no", "token_start", "n_tokens"]].copy()
        for c, v in (("container_id", container), ("slot_start", slot), ("step_group", container % groups)):
            out[c] = pd.Series(v, index=b.index, dtype="Int64").mask(b["n_tokens"] == 0)
        yield out


def pack(documents: DataFrame, limits: DataFrame, *, tokenizer: str | None = None, tiers: int = 4, step_group: int = STEP_GROUP) -> DataFrame:
    """doc_id, piece_no, token_start, n_tokens, container_id, slot_start, step_group.

    One row per document; only a document of more tokens than the container
    holds is divided, into full pieces and one rest. Documents without a token
    (null or empty text) come out with null container_id. Rows without an id
    are left out; a repeated id is packed once, with its longest text.
    Containers have the max_size of the limit `container`; each step group
    has at most `step_group` containers and all have nearly the same tokens.
    The vocabulary's path is a parameter, else the setting
    spark.tallyloom.tokenizer; executors need the file or get it by addFile.
    """
    tokenizer = tokenizer or documents.sparkSession.conf.get("spark.tallyloom.tokenizer", TOKENIZER)
    row = limits.where("lower(item_kind) = 'container' and size_unit = 'tokens' and max_size > 0").agg(F.max("max_size").alias("n")).first()
    if row.n is None:
        raise ValueError("size_limits has no row for the container")
    capacity = int(row.n)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    items = docs.mapInArrow(partial(_items, path=tokenizer, capacity=capacity), "doc_id long, piece_no int, token_start long, n_tokens int, all_tokens long")
    # a repeated id is packed once: its longest text has every piece number that its other texts have
    items = items.groupBy("doc_id", "piece_no").agg(F.max(F.struct("all_tokens", "token_start", "n_tokens")).alias("x"))
    items = materialize(items.select("doc_id", "piece_no", "x.token_start", "x.n_tokens"), "p6-items")
    total = items.count()
    buckets = max(8, -(-total // BUCKET_ITEMS))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(buckets)))
    counts = materialize(items.groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("k")), "p6-counts")
    histogram = {r.n_tokens: r.k for r in counts.groupBy("n_tokens").agg(F.sum("k").alias("k")).collect()}  # at most capacity + 1 rows
    segments, containers = plan(histogram, capacity, tiers)
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_tokens", "bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece_no"))
    ranked = items.withColumn("within", within).join(offsets, ["n_tokens", "bucket"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    stride = max(histogram.values(), default=0) + 1
    groups = max(1, -(-containers // step_group))
    schema = "doc_id long, piece_no int, token_start long, n_tokens int, container_id long, slot_start long, step_group long"
    return ranked.mapInPandas(partial(_assign, segments=segments, stride=stride, groups=groups), schema)


def packed(placed: DataFrame, capacity: int) -> DataFrame:
    """One row on a packing: documents, pieces, containers over the capacity, slots that overlap or leave a hole, and whether at least 99 % is used."""
    w = Window.partitionBy("container_id").orderBy("slot_start", "doc_id", "piece_no")
    put = placed.where("container_id is not null").withColumn("gap", F.col("slot_start") - F.coalesce(F.lag(F.col("slot_start") + F.col("n_tokens")).over(w), F.lit(0)))
    each = put.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count_if(F.col("gap") != 0).alias("bad"))
    pieces = placed.agg(F.count_distinct("doc_id").alias("documents"), (F.count(F.lit(1)) - F.count_distinct("doc_id", "piece_no")).alias("repeated"))
    return each.agg(F.count_if(F.col("used") > capacity).alias("over"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_slots"), (F.sum("used") >= 0.99 * capacity * (F.count(F.lit(1)) - 1)).alias("full")).crossJoin(pieces)  # one row each
