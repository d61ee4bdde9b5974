"""Word search over chunks (BM25) and fusion of rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col
TOKEN = "[a-z0-9]+"


def bm25(chunks: DataFrame, terms: Sequence[str], k: int, *, key: str = "id", text: str = "content", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score, rank of the k best chunks for the terms; ties by key.

    One scan counts the terms of each chunk inside the JVM; the statistics are
    one row, so nothing but the k best rows of each partition moves.
    """
    ts = list(dict.fromkeys(t.lower() for t in terms))
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), 1)
    tf = [(F.size("_w") - F.size(F.array_remove("_w", t))).alias(f"_t{i}") for i, t in enumerate(ts)]
    df = chunks.select(key, words.alias("_w")).select(key, F.size("_w").alias("_n"), *tf)
    stats = df.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_n").alias("_avg"), *[F.count_if(C(f"_t{i}") > 0).alias(f"_d{i}") for i in range(len(ts))])
    df = df.crossJoin(F.broadcast(stats))  # one row
    part = lambda i: F.log(1 + (C("_docs") - C(f"_d{i}") + 0.5) / (C(f"_d{i}") + 0.5)) * C(f"_t{i}") * (k1 + 1) / (C(f"_t{i}") + k1 * (1 - b + b * C("_n") / C("_avg")))
    score = sum((part(i) for i in range(1, len(ts))), part(0))
    best = df.withColumn("score", score).where("score > 0").orderBy(C("score").desc(), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(C("score").desc(), key))).select(key, F.round("score", 4).alias("score"), "rank")


def fuse(rankings: Sequence[DataFrame], k: int, *, key: str = "id", constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings (key, rank): key, score of the k best."""
    df = rankings[0].select(key, "rank")
    for r in rankings[1:]:
        df = df.unionByName(r.select(key, "rank"))
    return df.groupBy(key).agg(F.round(F.sum(1 / (C("rank") + constant)), 6).alias("score")).orderBy(C("score").desc(), key).limit(k)
