"""Approximate search on neighbour graphs, shard by shard.

A shard is a run of up to `SHARD` vectors with a graph: each vector's `m` nearest in the shard
(found exactly, by matrix products), those that have it among theirs, and a few drawn ones that
keep the graph in one piece. A search walks all queries of a block through a shard's graph at
once: of the `ef` best vectors seen so far the best unvisited one is visited, until none is
left. Hits of all shards are merged, so recall doesn't fall with their number, and shards can
be searched anywhere.

An index is a table of shards (shard, ids, dim, vectors, links), written as Parquet with a row
of settings beside it. Vectors of another length than the index's are left out. A Python worker
holds one shard and `_CELLS` scores at a time, however many shards its task has: search() writes
the hits of each block of queries, and shards that aren't in files yet should be stored() first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import one_row_batches, stored
from .dense import HITS, QUERY_BLOCK, Best, _scores, by_blocks, matrix, ranked, with_vectors

SHARD, M, EF, DRAWN, ENTRIES = 8192, 16, 64, 4, 8
#: Scores that are computed at once.
_CELLS = 2_000_000
_COLUMNS = "ids array<bigint>, dim int, vectors binary, links binary"


def linked(vectors: np.ndarray, m: int, metric: str, seed: int = 42) -> np.ndarray:
    """(rows, links) numbers of linked vectors, -1 where there are fewer."""
    n = len(vectors)
    m = min(m, n - 1)
    near = np.empty((n, m), dtype=np.int32)
    step = max(1, _CELLS // n)
    for at in range(0, n, step):
        s = _scores(vectors[at : at + step], vectors, metric)
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        near[at : at + step] = np.argpartition(-s, m - 1, axis=1)[:, :m] if m else 0
    rng = np.random.default_rng(seed)
    one = np.concatenate((np.repeat(np.arange(n), m), np.repeat(np.arange(n), DRAWN)))
    two = np.concatenate((near.ravel(), rng.integers(0, n, n * DRAWN)))
    # Both directions, each link once; beside the m nearest, of those that point to a popular vector as many as fit.
    pairs = np.unique(np.concatenate((one * n + two, two * n + one)))
    a, b = np.divmod(pairs, n)
    a, b = a[a != b], b[a != b]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((n, 2 * m + 2 * DRAWN), -1, dtype=np.int32)
    keep = place < out.shape[1]
    out[a[keep], place[keep]] = b[keep]
    return np.concatenate((near, np.where((out[:, :, None] == near[:, None, :]).any(axis=2), -1, out)), axis=1)


def walk(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, ef: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, scores) of up to ef near vectors of each query; -1 and -inf where there are fewer."""
    n, q = len(vectors), len(queries)
    entries = np.unique(np.linspace(0, n - 1, ENTRIES).astype(np.int64))
    seen = np.zeros((q, n), dtype=bool)
    seen[:, entries] = True
    ids, s = np.tile(entries, (q, 1)), _scores(vectors[entries], queries, metric).T.copy()
    done = np.zeros(ids.shape, dtype=bool)
    while True:
        open_ = np.where(done, -np.inf, s)
        best = open_.argmax(axis=1)
        act = np.flatnonzero(open_[np.arange(q), best] > -np.inf)
        if not len(act):
            return ids, s
        done[act, best[act]] = True
        near = links[ids[act, best[act]]]
        fresh = (near >= 0) & ~seen[act[:, None], near]
        row, column = np.nonzero(fresh)
        seen[act[row], near[row, column]] = True
        new_s = np.full((q, near.shape[1]), -np.inf)
        a, b = queries[act[row]], vectors[near[row, column]]
        new_s[act[row], column] = (a * b).sum(axis=1) if metric == "ip" else -((a - b) ** 2).sum(axis=1)
        new_ids = np.full(new_s.shape, -1, dtype=np.int64)
        new_ids[act] = near
        ids, s, done = np.concatenate((ids, new_ids), axis=1), np.concatenate((s, new_s), axis=1), np.concatenate((done, np.isneginf(new_s)), axis=1)
        if ids.shape[1] > ef:
            keep = np.argpartition(-s, ef - 1, axis=1)[:, :ef]
            ids, s, done = (np.take_along_axis(x, keep, axis=1) for x in (ids, s, done))


def build(corpus: DataFrame, m: int = M, metric: str = "ip", shard: int = SHARD) -> DataFrame:
    """The shards of corpus (doc_id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0

        def out() -> pa.RecordBatch:
            v = np.concatenate(parts).astype(np.float32)
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids)], pa.list_(pa.int64())), pa.array([v.shape[1]], pa.int32()), pa.array([v.tobytes()], pa.binary()), pa.array([linked(v.astype(np.float64), m, metric).tobytes()], pa.binary())], names=["ids", "dim", "vectors", "links"])

        for b in batches:
            docs, v = b.column(0).to_numpy(), matrix(b.column(1))
            for at in range(0, len(docs), shard):
                if held and (held >= shard or v.shape[1] != parts[0].shape[1]):
                    yield out()
                    ids, parts, held = [], [], 0
                ids.append(docs[at : at + shard].astype(np.int64))
                parts.append(v[at : at + shard])
                held += len(ids[-1])
        if held:
            yield out()

    return corpus.where("vector is not null").select("doc_id", "vector").mapInArrow(run, _COLUMNS)


def search(shards: DataFrame, queries: DataFrame, k: int = 10, ef: int = EF, metric: str = "ip", block: int = QUERY_BLOCK // 8) -> DataFrame:
    """Hits of queries (qid, vector) among the shards' vectors; a larger ef finds more."""

    def nearest(table: pa.Table) -> DataFrame:
        ids, asked = with_vectors(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(ids, k)
            for b in batches:
                for row in range(b.num_rows):
                    docs = b.column(0)[row].values.to_numpy()
                    v = np.frombuffer(b.column(2)[row].as_py(), dtype=np.float32).reshape(len(docs), -1).astype(np.float64)
                    links = np.frombuffer(b.column(3)[row].as_py(), dtype=np.int32).reshape(len(docs), -1)
                    found, s = walk(v, links, asked, max(ef, k), metric)
                    s[found < 0] = -np.inf
                    best.add_rows(s, docs[found])
            yield from best.hits()

        with one_row_batches(shards.sparkSession):
            return stored(shards.where(F.col("dim") == asked.shape[1]).select("ids", "dim", "vectors", "links").mapInArrow(run, HITS))

    return ranked(by_blocks(queries.where("vector is not null").select("qid", "vector"), nearest, block), k).withColumn("source", F.lit("dense"))


def save(shards: DataFrame, path: str, m: int = M, ef: int = EF, metric: str = "ip") -> None:
    """Writes the shards, and one row of settings: n, dim, m, ef, metric."""
    shards.write.mode("overwrite").parquet(f"{path}/shards")
    written = shards.sparkSession.read.parquet(f"{path}/shards")
    stats(written).withColumns({"m": F.lit(m), "ef": F.lit(ef), "metric": F.lit(metric)}).write.mode("overwrite").json(f"{path}/meta")


def stats(shards: DataFrame) -> DataFrame:
    """(n, dim, shards, bytes): one row."""
    return shards.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"), F.max("dim").alias("dim"), F.count("*").alias("shards"), F.coalesce(F.sum(F.length("vectors") + F.length("links")), F.lit(0)).alias("bytes"))


def search_saved(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, ef: int | None = None) -> DataFrame:
    """As search(), on a written index with its settings."""
    meta = spark.read.json(f"{path}/meta").first()
    return search(spark.read.parquet(f"{path}/shards"), queries, k, ef or meta["ef"], meta["metric"])
