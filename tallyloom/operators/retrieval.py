"""Filtered cosine search, relaxation of filters, table-first merging and citations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyloom.functions import numbers, text as X

C = F.col


def candidate_pool(k: int) -> int:
    return max(10 * k, 50)


def metadata_filter(*, user: str | None = None, paper: str | None = None, ticker: str | None = None, period: str | None = None, scope: str | None = None, is_table: bool | None = None) -> Column:
    """Conjunction of the conditions that are given. A named document makes ticker and period void."""
    tests = [F.lit(True)]
    if user is not None:
        tests.append(C("user_id") == user)
    if paper:
        tests.append(C("paper_id") == paper)
    else:
        if ticker:
            tests.append(C("ticker") == ticker.upper())
        if period:
            tests.append(C("fiscal_period") == period)
    if scope:
        tests.append(C("statement_scope") == scope.lower())
    if is_table is not None:
        tests.append(C("is_table") == is_table)
    return reduce(Column.__and__, tests)


def is_uuid(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))


def score(chunks: DataFrame, vector: Sequence[float], column: str = "embedding") -> DataFrame:
    """Chunks with `similarity`, the cosine to one vector, unrounded."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    return chunks.withColumn("similarity", numbers.cosine(C(column), q))


def top_k(chunks: DataFrame, vector: Sequence[float], k: int, *, where: Column | None = None, key: str = "id", column: str = "embedding") -> DataFrame:
    """The k most similar chunks, ties by key; filters come before the scores. Similarity is rounded at the end."""
    df = chunks if where is None else chunks.where(where)
    best = score(df, vector, column).where("similarity is not null").orderBy(C("similarity").desc(), C(key).asc()).limit(k)
    return best.withColumn("similarity", F.round("similarity", 4)).withColumn("distance", F.round(1 - C("similarity"), 4))


#: Questions that a task scores at once.
QUESTION_BLOCK = 2_000


def top_k_of_each(chunks: DataFrame, questions: DataFrame, k: int, *, key: str = "id", query: str = "query_id", block: int = QUESTION_BLOCK) -> DataFrame:
    """The k most similar chunks of every question (query_id, vector), ties by key.

    Questions go to the tasks in counted blocks of at most `block`. A task
    scores a batch of chunks against a block as one matrix product and keeps k
    chunks a question of what it has seen, so that only these leave it; the
    last rank sees k rows a question and task.
    """
    blocks = max(1, -(-questions.count() // block))
    order = [C("similarity").desc(), C(key).asc()]
    kinds, asked = dict(chunks.dtypes)[key], dict(questions.dtypes)[query]
    out = None
    for i in range(blocks):
        own = questions if blocks == 1 else questions.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == i)
        rows = own.where("vector is not null").select(query, "vector").collect()  # at most a block of questions
        ids, vectors = [r[0] for r in rows], np.array([r[1] for r in rows], float)
        best = chunks.where(C("embedding").isNotNull()).select(key, "embedding").mapInArrow(partial(best_of_task, ids=ids, vectors=vectors, k=k, names=(query, key), asked_kind=to_arrow_type(questions.schema[query].dataType)), f"{query} {asked}, {key} {kinds}, similarity double")
        df = best.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(C("rank") <= k)
        df = df.select(query, key, "rank", F.round("similarity", 4).alias("similarity"))
        out = df if out is None else out.union(df)
    return out


def best_of_task(batches: Iterator[pa.RecordBatch], ids: list, vectors: np.ndarray, k: int, names: tuple[str, str], asked_kind: pa.DataType, wanted: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """For each question the k best of a task's chunks; `wanted` tells by question which cells (the third column) count."""
    if not len(ids):
        return
    lengths = np.sqrt((vectors**2).sum(axis=1))
    held: list[list[tuple]] = [[] for _ in ids]
    kind = None
    for b in batches:
        if not b.num_rows:
            continue
        kind = b.schema.field(0).type
        keys, v = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), float)
        norm = np.sqrt((v**2).sum(axis=1))[None, :] * lengths[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = np.where(norm > 0, vectors @ v.T / norm, -np.inf)
        if wanted is not None:
            sim = np.where(wanted[:, b.column(2).to_numpy()], sim, -np.inf)
        if sim.shape[1] > k:  # all that reach the k-th similarity, so that ties are decided by key
            bar = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
        else:
            bar = np.full(len(ids), -np.inf)
        for q, least in enumerate(bar):
            at = np.flatnonzero((sim[q] >= least) & np.isfinite(sim[q]))
            held[q] = sorted(held[q] + [(-float(sim[q, j]), keys[j]) for j in at])[:k]
    rows = [(ids[q], key, -s) for q, own in enumerate(held) for s, key in own]
    if rows:
        asked, keys, sims = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(asked, asked_kind), pa.array(keys, kind), pa.array(sims, pa.float64())], names=[*names, "similarity"])


def ladder(chunks: DataFrame, vector: Sequence[float], k: int, levels: Sequence[Column], *, key: str = "id") -> DataFrame:
    """Top k of the first filter that any chunk meets, in one scan.

    Every chunk gets the set of levels it meets; the level that counts is the
    smallest over all chunks. Levels need not be nested.
    """
    met = F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(levels)]))
    tagged = chunks.withColumn("_met", met).where(F.size("_met") > 0)
    lowest = tagged.agg(F.min(F.array_min("_met")).alias("_level"))
    df = tagged.crossJoin(F.broadcast(lowest)).where(F.array_contains("_met", C("_level")))  # one row
    return top_k(df.withColumn("level", C("_level")).drop("_met", "_level"), vector, k, key=key)


def relaxation(*, paper: str | None = None, ticker: str | None = None, period: str | None = None, scope: str | None = None, is_table: bool | None = None) -> list[Column]:
    """As given; without scope; without period and scope; as given but any kind of chunk; without a document, the company alone."""
    base = {"paper": paper, "ticker": ticker, "period": period, "scope": scope, "is_table": is_table}
    rungs = [{}, {"scope": None}, {"scope": None, "period": None}, {"is_table": None}]
    if ticker and not paper:
        rungs.append({"period": None, "scope": None, "is_table": None})
    return [metadata_filter(**(base | d)) for d in rungs]


def merge_unique(groups: Sequence[DataFrame], key: str = "id", order: str = "similarity") -> DataFrame:
    """The groups one after the other, each key once, where it first stands."""
    parts = [g.withColumn("_g", F.lit(i)) for i, g in enumerate(groups)]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_g", C(order).desc()))).where("_r = 1").drop("_r").withColumnRenamed("_g", "group_no")


def table_first(chunks: DataFrame, vector: Sequence[float], k: int, *, key: str = "id", pool: int | None = None) -> DataFrame:
    """The best tables of the candidate pool, then the best texts, each chunk once."""
    tables = top_k(chunks, vector, pool or candidate_pool(k), where=C("is_table"), key=key)
    return merge_unique([tables, top_k(chunks, vector, k, where=~C("is_table"), key=key)], key)


def rerank(hits: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None, k: int, *, key: str = "id") -> DataFrame:
    """The k best by the scorer's `rerank_score`; without a scorer the k most similar."""
    scored = scorer(hits).withColumn("rerank_score", F.round("rerank_score", 4)) if scorer else hits
    return scored.orderBy(C("rerank_score" if scorer else "similarity").desc(), C(key).asc()).limit(k)


def retrieve(chunks: DataFrame, vector: Sequence[float], k: int = 3, *, paper: str | None = None, ticker: str | None = None, period: str | None = None, scope: str | None = None, prefer_tables: bool = False, scorer: Callable[[DataFrame], DataFrame] | None = None, key: str = "id") -> DataFrame:
    """Two stages: a pool of candidates by similarity, under filters that are relaxed until something is found, then the k best by the scorer.

    A named document makes ticker and period void. With prefer_tables the pool
    holds tables first and then the k best texts, so that tables aren't crowded
    out by prose that names the same measure.
    """
    given = dict(paper=paper, ticker=None if paper else ticker, period=None if paper else period, scope=scope)
    pool = candidate_pool(k)
    if prefer_tables:
        t = ladder(chunks, vector, pool, relaxation(**given, is_table=True), key=key)
        hits = merge_unique([t, ladder(chunks, vector, k, relaxation(**given, is_table=False), key=key)], key)
    else:
        hits = ladder(chunks, vector, pool, relaxation(**given), key=key)
    return rerank(hits, scorer, k, key=key)


def format_context(hits: DataFrame, by: str, rank: str = "rank") -> DataFrame:
    """Per question the numbered sources as one text; at most k sources a question."""
    place = X.provenance(C("page_number"), C("section"), C("is_table"), C("table_caption"), C("unit_context"))
    doc = F.coalesce(F.nullif(C("paper_id"), F.lit("")), F.lit("Unknown Document"))
    block = F.concat(F.lit("[Source "), C(rank), F.lit(" | Document: "), doc, F.lit(" | "), place, F.lit("]\n"), F.trim(C("content")))
    rows = hits.withColumn("_b", block).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(C(rank).alias("r"), C("_b").alias("b")))).alias("l"))
    return rows.select(by, F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("context"))


def numbered_citations(sources: DataFrame, by: str, rank: str = "rank") -> DataFrame:
    """Citation badges; a badge that recurs within an answer gets its number."""
    label = X.citation_label(C("ticker"), C("form_type"), C("paper_id"), C("page_number"), C("section"), C("is_table"))
    df = sources.withColumn("_l", label).withColumn("_n", F.row_number().over(Window.partitionBy(by, "_l").orderBy(rank)))
    return df.select(by, rank, F.when(C("_n") > 1, F.concat("_l", F.lit(" ("), "_n", F.lit(")"))).otherwise(C("_l")).alias("label"))


def compare(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Side by side: key, rank_a, rank_b and where the key stands (both, a only, b only)."""
    j = a.select(key, C("rank").alias("rank_a")).join(b.select(key, C("rank").alias("rank_b")), key, "full_outer")
    return j.withColumn("found_by", F.when(C("rank_a").isNull(), "b only").when(C("rank_b").isNull(), "a only").otherwise("both"))
