"""Problem 7: passages of evaluation items that stand in documents.

Method: training suffix arrays. The documents of a shard (a bounded slice of a
partition) become one array of word numbers, words that no item uses being 0.
A match holds only words of the items, so the suffix array is built over the
runs of such words that are long enough, which drops nothing. Every suffix of
every item is then binary-searched in the shard's suffix array, all suffixes
at once; the range that shares the least number of words is extended to the
longest verbatim match and its place.

Items are broadcast in blocks of at most `block` items, each block against all
rows, so the broadcast size is bounded whatever the number of items.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import slices, texts_of, words

MIN_WORDS = 12
BLOCK_ITEMS = 20_000
SHARD_CHARS = 6_000_000
SCHEMA = "doc_id long, item_id long, doc_word int, item_word int, n_words int"
_MATCHES = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_word", pa.int32()), ("item_word", pa.int32()), ("n_words", pa.int32())])


class _Vocabulary(dict):
    def __missing__(self, w: str) -> int:
        return 0


def suffix_array(a: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `a` ordered by their next `depth` values or more (prefix doubling)."""
    rank = np.unique(a, return_inverse=True)[1].astype(np.int64)
    done = 1
    while True:
        nxt = np.full(len(a), -1, np.int64)
        nxt[: len(a) - done] = rank[done:] if done < len(a) else []
        order = np.lexsort((nxt, rank))
        if 2 * done >= depth:
            return order
        r, n = rank[order], nxt[order]
        rank = np.empty_like(rank)
        rank[order] = np.concatenate(([0], np.cumsum((r[1:] != r[:-1]) | (n[1:] != n[:-1]))))
        if rank.max() == len(a) - 1:
            return order
        done *= 2


def _compare(a: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the window of `a` at `at` lies before, within or after the rows of q."""
    idx = at[:, None] + np.arange(q.shape[1])
    diff = a[idx] - q
    first = (diff != 0).argmax(axis=1)
    return np.sign(diff[np.arange(len(q)), first])


def search(a: np.ndarray, order: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q the half-open range of `order` whose windows equal it."""
    bounds = []
    for upper in (False, True):
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(order), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            c = np.full(len(q), 1)
            c[open_] = _compare(a, order[mid[open_]], q[open_])
            right = open_ & ((c <= 0) if upper else (c < 0))
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        bounds.append(lo)
    return bounds[0], bounds[1]


class _Items:
    """Word numbers of the items and their suffixes of at least `least` words."""

    def __init__(self, items: list[tuple[int, str]], least: int) -> None:
        self.least, self.vocabulary = least, _Vocabulary()
        flat, owner, place, suffixes = [], [], [], []
        for item, text in items:
            ws = words(text)
            suffixes += range(len(flat), len(flat) + len(ws) - least + 1)
            for k, w in enumerate(ws):
                flat.append(self.vocabulary.setdefault(w, len(self.vocabulary) + 1))
                owner.append(item)
                place.append(k)
            flat.append(-1)  # ends the item
            owner.append(item)
            place.append(-1)
        self.flat, self.owner, self.place = np.array(flat, np.int64), np.array(owner, np.int64), np.array(place, np.int64)
        self.suffixes = np.array(suffixes, np.int64)
        self.heads = self.flat[self.suffixes[:, None] + np.arange(least)] if len(suffixes) else np.empty((0, least), np.int64)


def _longest(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, least: int) -> np.ndarray:
    """Number of equal values from a[at] and b[bt] on; `least` are known to be equal."""
    n = np.full(len(at), least)
    live = np.arange(len(at))
    while len(live):
        x, y = at[live] + n[live], bt[live] + n[live]
        ok = (x < len(a)) & (y < len(b))
        ok[ok] = a[x[ok]] == b[y[ok]]
        live = live[ok]
        n[live] += 1
    return n


def shard_matches(ids: np.ndarray, texts: list[str | None], items: _Items) -> list[np.ndarray]:
    """Maximal matches of a shard: doc, item, doc word, item word, number of words."""
    least = items.least
    lists = [words(t) for t in texts]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists)) + 1  # one separator each
    flat = np.fromiter((items.vocabulary[w] for ws in lists for w in (*ws, "")), np.int64, int(lengths.sum()))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    known = flat > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
    first, end = edge[::2], edge[1::2]
    long = end - first >= least
    first, end = first[long], end[long]
    if not len(first):
        return [np.empty(0, np.int64)] * 5
    # the runs, each ended by a zero, and where each word stood
    sizes = end - first + 1
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    where = np.repeat(first - base, sizes) + np.arange(sizes.sum())
    a = flat[np.minimum(where, len(flat) - 1)]
    a[base + sizes - 1] = 0
    begin = np.concatenate([np.arange(b, b + s - least) for b, s in zip(base, sizes)])
    order = suffix_array(a, least)
    fits = np.zeros(len(a), bool)
    fits[begin] = True
    order = order[fits[order]]
    lo, hi = search(a, order, items.heads)
    hit = np.flatnonzero(hi > lo)
    n = (hi - lo)[hit]
    at = order[np.repeat(lo[hit] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
    bt = items.suffixes[np.repeat(hit, n)]
    maximal = (at == 0) | (bt == 0)  # not the continuation of an earlier match
    maximal |= a[at - 1] != items.flat[bt - 1]
    at, bt = at[maximal], bt[maximal]
    size = _longest(a, at, items.flat, bt, least)
    pos = where[at]
    doc = np.searchsorted(starts, pos, side="right") - 1
    return [ids[doc], items.owner[bt], pos - starts[doc], items.place[bt], size]


def _matches(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]], least: int) -> Iterator[pa.RecordBatch]:
    index = _Items(items, least)
    for b in slices(batches, "text", SHARD_CHARS):
        found = shard_matches(b.column(0).to_numpy(), texts_of(b, "text"), index)
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, _MATCHES)], schema=_MATCHES)


def matches(documents: DataFrame, items: DataFrame, *, least: int = MIN_WORDS, block: int = BLOCK_ITEMS) -> DataFrame:
    """Every maximal verbatim run of at least `least` words: doc_id, item_id, doc_word, item_word, n_words.

    documents: doc_id, text; items: item_id, item_text. Null texts and ids
    have no matches; repeated rows give one match.
    """
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    rows = items.select("item_id", "item_text").where("item_id is not null and item_text is not null").distinct()
    blocks = max(1, -(-rows.count() // block))
    out = None
    for k in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        part = [(r.item_id, r.item_text) for r in own.collect()]  # a block of the items, never documents
        m = docs.mapInArrow(partial(_matches, items=part, least=least), SCHEMA)
        out = m if out is None else out.union(m)
    return out.distinct()


def leaks(documents: DataFrame, items: DataFrame, **how) -> DataFrame:
    """doc_id, item_id: the items that each affected document leaks."""
    return matches(documents, items, **how).select("doc_id", "item_id").distinct()


def without_leaks(documents: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The documents without those that are affected, all columns kept."""
    return documents.join(leaks(documents, items, **how).select("doc_id").distinct(), "doc_id", "left_anti")
