"""Approximate cosine search: vectors in the cells of their nearest centres, of which a question looks at the nearest few.

The exact scan (`retrieval.top_k`) is the contract. The index trades recall
for work: centres and the number of cells to look at are fitted on a bounded
sample, every row is indexed, and tests hold its recall against the scan. How
much it saves depends on the vectors: where they lie in groups a few cells
hold nearly all neighbours; vectors without any structure need about half of
all cells for nine tenths of the neighbours, whatever the index.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyloom.operators import retrieval

C = F.col
#: Vectors of which the index is fitted.
SAMPLE_ROWS = 10_000


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v**2).sum(axis=1, keepdims=True))
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


class CellIndex:
    """`cells` centres on the unit sphere and `probes`, the number of cells that a question looks at."""

    def __init__(self, centres: np.ndarray, probes: int) -> None:
        self.centres, self.probes = centres, probes

    @classmethod
    def fit(cls, chunks: DataFrame, key: str = "id", column: str = "embedding", *, cells: int | None = None, recall: float = 0.95, k: int = 10, rounds: int = 12, sample: int = SAMPLE_ROWS, seed: int = 7) -> CellIndex:
        """Spherical k-means on at most `sample` vectors, chosen by the hash of their key; as many probes as a fifth of the sample, asked against the rest, needs for the recall."""
        rows = chunks.where(C(column).isNotNull()).orderBy(F.xxhash64(key), key).select(column).limit(sample).collect()
        v = _unit(np.array([r[0] for r in rows], float)) if rows else np.zeros((0, 1))
        if len(v) < 20:
            return cls(v[:1] if len(v) else np.zeros((1, 1)), 1)
        asked, known = v[: len(v) // 5], v[len(v) // 5 :]
        n = min(cells or max(4, int(len(known) ** 0.5)), len(known))
        centres = known[np.random.default_rng(seed).choice(len(known), n, replace=False)]
        for _ in range(rounds):
            at = (known @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, at, known)
            centres = np.where((np.bincount(at, minlength=n) > 0)[:, None], _unit(sums), centres)
        at = (known @ centres.T).argmax(axis=1)
        best = np.argsort(-(asked @ known.T), axis=1)[:, :k]
        order = np.argsort(-(asked @ centres.T), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(n)[None, :], axis=1)
        needed = np.take_along_axis(place, at[best], axis=1) + 1  # probes after which a neighbour is seen
        share = np.sort(needed, axis=None)
        return cls(centres, int(share[min(int(np.ceil(recall * len(share))), len(share)) - 1]))

    def cells_of(self, vectors: np.ndarray) -> np.ndarray:
        """The nearest cells of each vector, the nearest first."""
        return np.argsort(-(_unit(vectors) @ self.centres.T), axis=1, kind="stable")[:, : self.probes]

    def build(self, chunks: DataFrame, key: str = "id", column: str = "embedding") -> DataFrame:
        """key, embedding, cell: every row with a vector in its nearest cell. Written with `partitionBy("cell")`, only the cells asked for are read."""
        kinds = dict(chunks.dtypes)
        nearest = CellIndex(self.centres, 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    at = nearest.cells_of(np.array(b.column(1).to_pylist(), float))[:, 0]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int32())], names=[key, "embedding", "cell"])

        return chunks.where(C(column).isNotNull()).select(key, column).mapInArrow(run, f"{key} {kinds[key]}, embedding {kinds[column]}, cell int")

    def search(self, index: DataFrame, vector: Sequence[float], k: int, key: str = "id") -> DataFrame:
        """The k most similar of the rows in the question's cells, scored exactly."""
        cells = [int(c) for c in self.cells_of(np.array([vector], float))[0]]
        return retrieval.top_k(index.where(C("cell").isin(cells)), vector, k, key=key).select(key, "similarity")

    def search_each(self, index: DataFrame, questions: DataFrame, k: int, key: str = "id", block: int = retrieval.QUESTION_BLOCK) -> DataFrame:
        """query_id, key, rank, similarity: as `search`, for every question of a table (query_id, vector), in counted blocks."""
        blocks = max(1, -(-questions.count() // block))
        order = [C("similarity").desc(), C(key).asc()]
        kinds, asked = dict(index.dtypes)[key], dict(questions.dtypes)["query_id"]
        out = None
        for i in range(blocks):
            own = questions if blocks == 1 else questions.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
            rows = own.where("vector is not null").select("query_id", "vector").collect()  # at most a block of questions
            vectors = np.array([r[1] for r in rows], float)
            wanted = np.zeros((len(rows), len(self.centres)), bool)
            if rows:
                np.put_along_axis(wanted, self.cells_of(vectors), True, axis=1)
            used = index.where(C("cell").isin([int(c) for c in np.flatnonzero(wanted.any(axis=0))]))
            best = used.select(key, "embedding", "cell").mapInArrow(partial(retrieval.best_of_task, ids=[r[0] for r in rows], vectors=vectors, k=k, names=("query_id", key), asked_kind=to_arrow_type(questions.schema["query_id"].dataType), wanted=wanted), f"query_id {asked}, {key} {kinds}, similarity double")
            df = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(C("rank") <= k)
            df = df.select("query_id", key, "rank", F.round("similarity", 4).alias("similarity"))
            out = df if out is None else out.union(df)
        return out

    def touched(self, index: DataFrame, questions: DataFrame) -> float:
        """The mean share of the index's rows that a question looks at."""
        sizes = np.zeros(len(self.centres))
        for r in index.groupBy("cell").count().collect():  # one row a cell
            sizes[r.cell] = r["count"]
        rows = questions.where("vector is not null").select("vector").limit(retrieval.QUESTION_BLOCK).collect()
        return float(sizes[self.cells_of(np.array([r[0] for r in rows], float))].sum(axis=1).mean() / max(sizes.sum(), 1)) if rows else 0.0
