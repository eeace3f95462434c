"""Exact and partition-routed nearest-neighbour search.

Hits are rows (qid, doc_id, score, rank, source); rank counts from 1. Ties go to the
smaller doc_id. Larger scores are nearer for every metric: the inner product, or minus
the squared distance.

Vectors are scored by matrix products in Arrow batches. Queries come in blocks of about
`QUERY_BLOCK`, each fetched as one Arrow table. One block is a lazy plan; of several, each is
searched and its hits are written before the next is fetched, so neither the driver nor a
task ever holds more than one. Each task sends at most k rows for each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

QUERY_BLOCK = 4096
_CELLS = 4_000_000
HITS = "qid long, doc_id long, score double"


def ranked(hits: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k of each query with their rank, by score unless `order` is given; ties go to the smaller doc_id."""
    by = order or (F.round("score", 9).desc(), F.col("doc_id"))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*by))).where(F.col("rank") <= k)


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of an Arrow list column as a float64 matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, dim or 0)


def _scores(vectors: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    if metric == "ip":
        return vectors @ queries.T
    return 2 * (vectors @ queries.T) - (vectors**2).sum(axis=1)[:, None] - (queries**2).sum(axis=1)


def _best(s: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's scores and ids the first k by (score, smaller id)."""
    r = np.round(s, 9)
    if s.shape[1] <= 4 * k:
        order = np.lexsort((d, -r), axis=1)[:, :k]
    else:
        kth = np.partition(r, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        order = np.empty((len(s), k), dtype=np.int64)
        for q in range(len(s)):
            c = np.flatnonzero(r[q] >= kth[q])
            order[q] = c[np.lexsort((d[q, c], -r[q, c]))[:k]]
    return np.take_along_axis(s, order, axis=1), np.take_along_axis(d, order, axis=1)


class Best:
    """The first k of what was added for each query."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.scores, self.docs = np.empty((len(ids), 0)), np.empty((len(ids), 0), dtype=np.int64)
        #: Documents that are scored at once.
        self.step = max(1, _CELLS // max(len(ids), 1))

    def add(self, scores: np.ndarray, docs: np.ndarray, again: bool = False) -> None:
        """scores: a row for each query, a column for each of docs, which are distinct; again: some may have been added before."""
        d = np.broadcast_to(docs, scores.shape)
        if again:
            scores, d = _best(scores, d, self.k)
            scores[(d[:, :, None] == self.docs[:, None, :]).any(axis=2)] = -np.inf
        self.scores, self.docs = _best(np.concatenate((self.scores, scores), axis=1), np.concatenate((self.docs, d), axis=1), self.k)

    def add_rows(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """As add(), with documents of its own for each query, none of them added before."""
        self.scores, self.docs = _best(np.concatenate((self.scores, scores), axis=1), np.concatenate((self.docs, docs), axis=1), self.k)

    def hits(self) -> Iterator[pa.RecordBatch]:
        n = self.scores.shape[1]
        real = (self.scores > -np.inf).ravel()
        if real.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)[real]), pa.array(self.docs.ravel()[real]), pa.array(self.scores.ravel()[real].astype(np.float64))], names=["qid", "doc_id", "score"])


def by_blocks(queries: DataFrame, search: Callable[[pa.Table], DataFrame | None], block: int = QUERY_BLOCK) -> DataFrame:
    """What search gives for the queries, block by block; queries has a column qid."""
    spark = queries.sparkSession
    first = queries.limit(block + 1).toArrow()
    if first.num_rows <= block:
        found = search(first) if first.num_rows else None
        return spark.createDataFrame([], HITS) if found is None else found
    queries = stored(queries)
    blocks = -(-queries.count() // block)
    parts = []
    for no in range(blocks):
        table = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == no).toArrow()
        found = search(table) if table.num_rows else None
        if found is not None:
            parts.append(stored(found))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], HITS)


def with_vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of a block (qid, vector)."""
    return table.column("qid").to_numpy().astype(np.int64), matrix(table.column("vector").combine_chunks())


def _nearest(ids: np.ndarray, queries: np.ndarray, k: int, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(ids, k)
        for b in batches:
            docs, vectors = b.column(0).to_numpy(), matrix(b.column(1), queries.shape[1])
            for at in range(0, len(docs), best.step):
                best.add(_scores(vectors[at : at + best.step], queries, metric).T, docs[at : at + best.step])
        yield from best.hits()

    return run


def flat_knn(corpus: DataFrame, queries: DataFrame, k: int = 10, metric: str = "ip", source: str = "dense", block: int = QUERY_BLOCK) -> DataFrame:
    """The exact k nearest of corpus (doc_id, vector) for each of queries (qid, vector). Rows without a vector have no neighbours and are none."""
    rows = corpus.select("doc_id", "vector").where("vector is not null")

    def search(table: pa.Table) -> DataFrame:
        ids, vectors = with_vectors(table)
        return rows.where(F.size("vector") == vectors.shape[1]).mapInArrow(_nearest(ids, vectors, k, metric), HITS)

    return ranked(by_blocks(queries.where("vector is not null").select("qid", "vector"), search, block), k).withColumn("source", F.lit(source))


def score_pairs(pairs: DataFrame, metric: str = "ip") -> DataFrame:
    """pairs (..., a, b) with score, in Arrow batches; a and b are dropped."""
    keep = [f for f in pairs.schema.fields if f.name not in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = matrix(batch.column("a")), matrix(batch.column("b"))
            s = (a * b).sum(axis=1) if metric == "ip" else -((a - b) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(s, pa.float64())], names=[*(f.name for f in keep), "score"])

    return pairs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", score double")


def rescore(hits: DataFrame, corpus: DataFrame, queries: DataFrame, candidates: int = 100, k: int = 10, metric: str = "ip") -> DataFrame:
    """The first `candidates` hits of each query scored anew with full vectors, best k; ties go to the smaller doc_id."""
    some = hits.where(F.col("rank") <= candidates).select("qid", "doc_id")
    pairs = some.join(corpus.select("doc_id", F.col("vector").alias("a")), "doc_id").join(queries.select("qid", F.col("vector").alias("b")), "qid")
    return ranked(score_pairs(pairs, metric), k).withColumn("source", F.lit("dense"))


def merge(*lists: DataFrame, k: int = 10) -> DataFrame:
    """Several hit lists as one: of a document that is in more than one, its highest score."""
    all_hits = reduce(DataFrame.unionByName, [x.select("qid", "doc_id", "score", "source") for x in lists])
    return ranked(all_hits.groupBy("qid", "doc_id").agg(F.max("score").alias("score"), F.max_by("source", "score").alias("source")), k)
