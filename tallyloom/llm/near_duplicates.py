"""Problem 1: groups of chunks that hold nearly the same content.

Method: anchor-point covering. A content's fingerprint is, for each of
`tables` tables, a word of seven symbols; the symbols are minima of hashes over
the content's sequences of three words, so two contents share a symbol with a
probability equal to their similarity.

The covering code is the Hamming code of length seven. A codeword of weight
four names the symbols that an anchor leaves open; the anchor keeps the other
three. Every fingerprint is replicated to all of its seven anchors, which lie
at distance four, the covering radius of the anchors, and none lies nearer.
The threshold is two symbols: every set of at most two of the seven places is
covered by a codeword of weight four, so two fingerprints that differ in no
more places share an anchor, and so do most that differ in three (both are
tested over all patterns). Over an alphabet of 2**64 symbols the ball of radius
plus threshold holds endlessly many anchors; the code is chosen so that the
radius alone gives the guarantee.

Within an anchor, members are compared by a 128-bit signature of 32 symbols of
four bits, and whatever passes is checked exactly on the texts.

Every sequence counts, however many contents hold it: which ones tell copies
apart can't be decided for one content alone, since in a large group of copies
the sequences that make two of them alike are the common ones. Three symbols
that must agree keep most contents apart that share stock phrases only.

Contents with the same words form a class, represented once, so copies cost
nothing per pair. Anchors with more than `block` classes are found by counts
of hash cells and then exactly; they are split into blocks before any task
gathers them, and each pair of blocks is a join key of its own, so that no task
holds more than two blocks of an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm._shared import U64, WordHashes, components, maybe_broadcast, mix, slices, texts_of, words
from tallyloom.session import materialize

SHINGLE = 3
SIMILARITY = 0.5
#: At similarity 0.5, 0.6, 0.7 a pair shares an anchor with probability 0.969, 0.997, 0.9999.
TABLES = 5
SYMBOLS = 7
#: Places of the symbols that each anchor keeps: three whose numbers cancel each other, which are the places that the codewords of weight four leave out.
KEPT = [(a - 1, b - 1, (a ^ b) - 1) for a in range(1, 8) for b in range(a + 1, 8) if a ^ b > b]
#: Mean number of keys in a cell of the counts that find crowded anchors.
CELL = 512
#: Symbols of the signature, four bits each, and how many of them must agree before the texts are compared:
#: at similarity 0.6 the mean is 20 with a deviation of 2.7, at 0.1 it is 5.
SIGNATURE = 32
LEAST_AGREEING = 11
BLOCK = 2_000
BROADCAST_ROWS = 100_000

_FEATURES = pa.schema([("id", pa.string()), ("c1", pa.int64()), ("c2", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("anchors", pa.list_(pa.int64()))])


def _sequences(flat: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a text, and how many each text has."""
    n = len(flat) - size + 1
    counts = np.maximum(lengths - size + 1, 0)
    if n <= 0:
        return np.empty(0, U64), counts
    h = np.zeros(n, U64)
    for i in range(size):
        h = h * U64(0x9E3779B97F4A7C15) + flat[i : i + n]
    ends = np.cumsum(lengths)
    last = np.repeat(ends, lengths)[:n]  # the end of the text that a position belongs to
    return mix(h[np.arange(n) + size <= last]), counts


def _minima(values: np.ndarray, starts: np.ndarray, multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.empty((len(starts), len(multipliers)), U64)
    for j in range(len(multipliers)):
        out[:, j] = np.minimum.reduceat(values * multipliers[j] + offsets[j], starts)
    return out


def anchor_keys(symbols: np.ndarray) -> np.ndarray:
    """Keys of the anchors of each fingerprint. symbols: rows x tables x SYMBOLS."""
    n, tables, _ = symbols.shape
    out = np.empty((n, tables, len(KEPT)), U64)
    for k, places in enumerate(KEPT):
        name = mix(np.arange(tables, dtype=U64) * U64(len(KEPT)) + U64(k + 1))  # of the table and the places
        for place in places:
            name = mix(name + symbols[:, :, place])
        out[:, :, k] = name
    return out.reshape(n, tables * len(KEPT))


def _hashed(batch: pa.RecordBatch, hashes: WordHashes, size: int) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    lists = [words(t) for t in texts_of(batch, "content")]
    lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = hashes.of([w for ws in lists for w in ws])
    return lists, *_sequences(flat, lengths, size)


def _features(batches: Iterator[pa.RecordBatch], tables: int, size: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(20250101)
    n_sym, n_all, n_keys = tables * SYMBOLS, max(tables * SYMBOLS, SIGNATURE), tables * len(KEPT)
    mult = rng.integers(0, 1 << 63, n_all, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    offs = rng.integers(0, 1 << 63, n_all, dtype=np.int64).astype(U64) * U64(2)
    place = U64(4) * np.arange(16, dtype=U64)
    hashes = WordHashes()
    for b in slices(batches, "content", 1_500_000):
        lists, seqs, counts = _hashed(b, hashes, size)
        digest = [xxhash.xxh3_128_digest("\n".join(w)) for w in lists]
        cls = np.frombuffer(b"".join(digest), dtype=np.int64).reshape(-1, 2)
        has = counts > 0
        k = int(has.sum())
        sigs, anchors = np.zeros((len(lists), 2), np.int64), np.empty((0, n_keys), U64)
        if k:
            own = counts[has]
            starts = np.concatenate(([0], np.cumsum(own)[:-1]))
            mins = _minima(seqs, starts, mult, offs)
            bits = mix(mins[:, :SIGNATURE]) & U64(15)
            sigs[has, 0] = (bits[:, :16] << place).sum(axis=1, dtype=U64).view(np.int64)
            sigs[has, 1] = (bits[:, 16:] << place).sum(axis=1, dtype=U64).view(np.int64)
            anchors = anchor_keys(mins[:, :n_sym].reshape(k, tables, SYMBOLS))
        offsets = np.concatenate(([0], np.cumsum(np.where(has, n_keys, 0)))).astype(np.int32)
        column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(anchors.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls[:, 0]), pa.array(cls[:, 1]), pa.array(sigs[:, 0]), pa.array(sigs[:, 1]), column], schema=_FEATURES)


def _agreeing(x: str, y: str) -> Column:
    """How many of the 16 four-bit symbols of two longs agree."""
    d = F.col(x).bitwiseXOR(F.col(y))
    d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
    d = d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111))
    return F.lit(16) - F.bit_count(d)


def _exact(batches: Iterator[pa.RecordBatch], size: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose common sequences are at least `similarity` of all sequences of the two."""

    def grams(t: str) -> set:
        w = words(t)
        return set(zip(*(w[i:] for i in range(size))))

    for b in batches:
        keep = []
        for x, y in zip(texts_of(b, "text_a"), texts_of(b, "text_b")):
            p, q = grams(x), grams(y)
            common = len(p & q)
            keep.append(common > 0 and common >= similarity * (len(p) + len(q) - common))
        yield b.filter(pa.array(keep, pa.bool_())).select(["a1", "a2", "b1", "b2"])


def crowded(feats: DataFrame, at: DataFrame, block: int) -> DataFrame | None:
    """anchor, n: the anchors with at least `block` classes; None if there are none.

    Keys are first counted in cells, a table of a fixed share of their number
    that partial sums keep small in every task; only the keys of cells that
    hold as many are counted one by one.
    """
    rows = feats.where(F.size("anchors") > 0).count()
    cells = 1 << max(12, (rows * TABLES * len(KEPT) // CELL).bit_length())
    cell = lambda c: F.pmod(c, F.lit(cells))
    full = feats.select(F.explode("anchors").alias("anchor")).groupBy(cell(F.col("anchor")).alias("cell")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(block, 2)).select("cell")
    full = materialize(full, "p1-cells")
    if full.isEmpty():
        return None
    hot = at.withColumn("cell", cell(F.col("anchor"))).join(maybe_broadcast(full, BROADCAST_ROWS), "cell").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(block, 2))
    hot = materialize(hot, "p1-crowded")
    return None if hot.isEmpty() else hot


def similarity_links(chunks: DataFrame, *, size: int = SHINGLE, similarity: float = SIMILARITY, tables: int = TABLES, agreeing: int = LEAST_AGREEING, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Members (id, c1, c2) and the links (a1, a2, b1, b2) between classes of equal word sequences.

    chunks: id string, content string; further columns are ignored. Rows
    without an id are left out, rows with the same id count once. Contents
    that are null or have fewer than `size` words have no sequence and are in
    no link; they are members of the class of their (possibly empty) words.
    """
    rows = chunks.select("id", "content").where(F.col("id").isNotNull())
    feats = rows.mapInArrow(partial(_features, tables=tables, size=size), "id string, c1 long, c2 long, s1 long, s2 long, anchors array<long>")
    feats = materialize(feats.withColumn("row", F.monotonically_increasing_id()), "p1-features")
    # one row of each class; only classes with copies need a look
    copied = feats.where(F.size("anchors") > 0).groupBy("c1", "c2").agg(F.min("row").alias("first"), F.max("row").alias("_last")).where("first <> _last").drop("_last")
    classes = feats.where(F.size("anchors") > 0).join(maybe_broadcast(materialize(copied, "p1-copied"), BROADCAST_ROWS), ["c1", "c2"], "left").where("first is null or row = first")
    at = classes.select("c1", F.explode("anchors").alias("anchor"))
    hot = crowded(feats, at, block)
    counted = F.count(F.lit(1)).over(Window.partitionBy("anchor"))
    if hot is None:
        crowd = at.withColumn("n", counted).where("n > 1")
    else:  # crowded anchors are never gathered; the others have fewer than `block` classes
        hot = maybe_broadcast(hot, BROADCAST_ROWS)
        rest = at.join(hot.select("anchor"), "anchor", "left_anti").select(*at.columns)
        crowd = rest.withColumn("n", counted).where("n > 1").union(at.join(hot, "anchor").select(*at.columns, "n"))
    # up to here 64 bits name a class; classes that share them all go on from here, so nothing is mixed up or lost
    crowd = materialize(crowd, "p1-anchors").join(classes.select("c1", "c2", "s1", "s2"), "c1")
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("c1", "c2"), parts).cast("int")
    # a class of block i meets block j in the cell (min, max); both sides list the cells of their block
    cells = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(mine, j).alias("lo"), F.greatest(mine, j).alias("hi")))
    crowd = crowd.select("anchor", "c1", "c2", "s1", "s2", F.explode(cells).alias("cell")).select("anchor", "c1", "c2", "s1", "s2", "cell.lo", "cell.hi")
    l, r = crowd.alias("l"), crowd.alias("r")
    pairs = l.join(r, ["anchor", "lo", "hi"]).where((F.col("l.c1") < F.col("r.c1")) | ((F.col("l.c1") == F.col("r.c1")) & (F.col("l.c2") < F.col("r.c2"))))
    pairs = pairs.where(_agreeing("l.s1", "r.s1") + _agreeing("l.s2", "r.s2") >= agreeing)
    pairs = pairs.select(F.col("l.c1").alias("a1"), F.col("l.c2").alias("a2"), F.col("r.c1").alias("b1"), F.col("r.c2").alias("b2")).distinct()
    pairs = materialize(pairs, "p1-candidates")
    ends = pairs.select(F.col("a1").alias("c1"), F.col("a2").alias("c2")).union(pairs.select("b1", "b2")).distinct()
    reps = materialize(ends.join(feats.select("id", "c1", "c2"), ["c1", "c2"]).groupBy("c1", "c2").agg(F.min("id").alias("id")), "p1-reps")
    # the texts of candidates only; a large set of candidates is joined by a shuffle
    texts = materialize(rows.join(maybe_broadcast(reps, BROADCAST_ROWS), "id").dropDuplicates(["id"]).select("c1", "c2", "content"), "p1-texts")
    x = texts.select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("content").alias("text_a"))
    y = texts.select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("content").alias("text_b"))
    both = pairs.join(x, ["a1", "a2"]).join(y, ["b1", "b2"]).select("a1", "a2", "b1", "b2", "text_a", "text_b")
    links = materialize(both.mapInArrow(partial(_exact, size=size, similarity=similarity), "a1 long, a2 long, b1 long, b2 long"), "p1-links")
    members = feats.select("id", "c1", "c2", (F.size("anchors") > 0).alias("has")).distinct()
    return members, links


def similar_pairs(chunks: DataFrame, **how) -> DataFrame:
    """id_a, id_b with id_a < id_b of all chunks whose contents are nearly the same, copies included."""
    members, links = similarity_links(chunks, **how)
    m = members.where("has")
    shared = m.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c1", "c2")
    copies = m.join(shared, ["c1", "c2"])
    same = copies.select("c1", "c2", F.col("id").alias("id_a")).join(copies.select("c1", "c2", F.col("id").alias("id_b")), ["c1", "c2"]).where("id_a < id_b").select("id_a", "id_b")
    a = m.select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("id").alias("x"))
    b = m.select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("id").alias("y"))
    cross = links.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return same.union(cross)


def duplicate_groups(chunks: DataFrame, **how) -> DataFrame:
    """id, group_id (smallest id of the group), class_id, links: one row per chunk, linear in the chunks.

    links counts the other classes that are linked to the chunk's class.
    """
    members, links = similarity_links(chunks, **how)
    key = lambda p: F.concat_ws(":", F.lpad(F.hex(f"{p}1"), 16, "0"), F.lpad(F.hex(f"{p}2"), 16, "0"))
    named = materialize(links.select(key("a").alias("u"), key("b").alias("v")), "p1-edges")
    root = components(named)
    degree = named.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    m = members.select("id", key("c").alias("class_id"), "has")
    # texts without any sequence stand alone
    m = m.withColumn("class_id", F.when(F.col("has"), F.col("class_id")).otherwise(F.concat(F.lit("id:"), F.col("id"))))
    m = m.join(root.withColumnRenamed("node", "class_id"), "class_id", "left").join(degree.withColumnRenamed("node", "class_id"), "class_id", "left")
    m = m.select("id", "class_id", F.coalesce("root", "class_id").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    first = m.groupBy("root").agg(F.min("id").alias("group_id"))
    return m.join(first, "root").select("id", "group_id", "class_id", "links")
