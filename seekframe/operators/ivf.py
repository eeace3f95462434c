"""Partitioned search: centroids, overlapping assignment, routing, and the search itself.

Centroids are a table (partition_id, centroid) of at most a few thousand rows, whatever
the corpus; they are collected and broadcast. Assignment, routing and search use the same
metric throughout. Assigned vectors are rows (doc_id, partition_id, vector), so a search
needs no join: a task multiplies what a batch has of a partition with the queries that probe
it, and no vector is shuffled. Written by partition_id, only the routed partitions are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dense import HITS, QUERY_BLOCK, Best, _scores, by_blocks, matrix, ranked, with_vectors
from .workload import hashed_sample

SAMPLE = 200_000
MAX_CENTROIDS = 65_536


def kmeans_centroids(corpus: DataFrame, k: int = 16, iterations: int = 25, seed: int = 42, sample: int = SAMPLE) -> DataFrame:
    """(partition_id, centroid), ids from 0, by cosine k-means on about `sample` vectors at most, those with the smallest hashes of their ids."""
    some = hashed_sample(corpus.where("vector is not null").select("doc_id", "vector"), sample, seed=seed)
    model = KMeans(k=k, maxIter=iterations, seed=seed, distanceMeasure="cosine", featuresCol="v").fit(some.select(array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("v")))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return corpus.sparkSession.createDataFrame(rows, "partition_id int, centroid array<double>")


def fixed(centroids: DataFrame) -> DataFrame:
    """The same centroids, computed once; there are at most MAX_CENTROIDS."""
    ids, c = _centroids(centroids)
    return centroids.sparkSession.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, c)], "partition_id int, centroid array<double>")


def _centroids(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = table.orderBy("partition_id").limit(MAX_CENTROIDS + 1).collect()
    if len(rows) > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    return np.array([r.partition_id for r in rows], dtype=np.int32), np.array([r.centroid for r in rows], dtype=np.float64)


def _nearest_centroids(vectors: np.ndarray, ids: np.ndarray, c: np.ndarray, n: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(place of each of the n nearest centroids in ids, scores); ties go to the smaller partition, as ids ascend."""
    s = _scores(vectors, c, metric)
    r = np.round(s, 9)
    if n < len(ids):
        kth = np.partition(r, len(ids) - n, axis=1)[:, len(ids) - n, None]
        # All above the n-th score, and of those equal to it the first.
        rank = np.where(r > kth, 2, np.where(r == kth, 1, 0))
        order = np.argsort(-rank, axis=1, kind="stable")[:, :n]
        inner = np.argsort(-np.take_along_axis(r, order, axis=1), axis=1, kind="stable")
        order = np.take_along_axis(order, inner, axis=1)
    else:
        order = np.argsort(-r, axis=1, kind="stable")[:, :n]
    return order, np.take_along_axis(s, order, axis=1)


def scored_centroids(vectors: DataFrame, centroids: DataFrame, top: int, key: str = "doc_id", metric: str = "ip", keep_vector: bool = False) -> DataFrame:
    """(key, partition_id, score, place): the `top` nearest centroids of each vector; place counts from 1, ties go to the smaller partition. With keep_vector the vector too."""
    ids, c = _centroids(centroids)
    kind = vectors.schema[key].dataType.simpleString()
    n = min(top, len(ids))
    more = f", vector {vectors.schema['vector'].dataType.simpleString()}" if keep_vector else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            order, s = _nearest_centroids(matrix(b.column(1)), ids, c, n, metric)
            rows = pa.array(np.repeat(np.arange(b.num_rows), n))
            columns = [b.column(0).take(rows), pa.array(ids[order].ravel()), pa.array(s.ravel()), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), b.num_rows))]
            yield pa.RecordBatch.from_arrays([*columns, *([b.column(1).take(rows)] if keep_vector else [])], names=[key, "partition_id", "score", "place", *(["vector"] if keep_vector else [])])

    return vectors.where("vector is not null").select(key, "vector").mapInArrow(run, f"{key} {kind}, partition_id int, score double, place int{more}")


def assign(corpus: DataFrame, centroids: DataFrame, overlap: int = 1, metric: str = "ip") -> DataFrame:
    """(doc_id, partition_id, vector): each vector in its `overlap` nearest partitions."""
    return scored_centroids(corpus, centroids, overlap, metric=metric, keep_vector=True).select("doc_id", "partition_id", "vector")


def route(queries: DataFrame, centroids: DataFrame, nprobe: int = 8, adaptive_gap: float | None = None, metric: str = "ip") -> DataFrame:
    """(qid, partition_id, score, place): the partitions that each query probes.

    With adaptive_gap, a query stops at the first place from max(1, nprobe // 4) and 2 on
    whose score is more than the gap below that of the place before; that place still counts.
    """
    routes = scored_centroids(queries, centroids, nprobe, "qid", metric)
    if adaptive_gap is None:
        return routes
    w = Window.partitionBy("qid").orderBy("place")
    gap = F.lag("score").over(w) - F.col("score")
    stops = F.when((F.col("place") >= max(2, nprobe // 4)) & (gap > adaptive_gap), F.col("place"))
    routes = routes.withColumn("stop", stops).withColumn("stop", F.min("stop").over(Window.partitionBy("qid")))
    return routes.where(F.col("stop").isNull() | (F.col("place") <= F.col("stop"))).drop("stop")


def search(assigned: DataFrame, queries: DataFrame, routes: DataFrame, k: int = 10, metric: str = "ip", block: int = QUERY_BLOCK) -> DataFrame:
    """Hits among assigned (doc_id, partition_id, vector) from the routed partitions; a vector that is in several of them counts once."""
    asked = queries.where("vector is not null").select("qid", "vector").join(routes.groupBy("qid").agg(F.sort_array(F.collect_set("partition_id")).alias("probes")), "qid")

    def nearest(table: pa.Table) -> DataFrame:
        ids, vectors = with_vectors(table)
        probes = table.column("probes").combine_chunks()
        which, partitions = np.repeat(np.arange(len(ids)), probes.value_lengths().to_numpy()), probes.flatten().to_numpy()
        order = np.argsort(partitions, kind="stable")
        which, partitions = which[order], partitions[order]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(ids, k)
            for b in batches:
                docs, own, v = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2), vectors.shape[1])
                for at in range(0, len(docs), best.step):
                    stop = min(at + best.step, len(docs))
                    d, first, of = np.unique(docs[at:stop], return_index=True, return_inverse=True)
                    s = np.full((len(ids), len(d)), -np.inf)
                    for p in np.unique(own[at:stop]):
                        asking = which[np.searchsorted(partitions, p) : np.searchsorted(partitions, p, side="right")]
                        mine = np.flatnonzero(own[at:stop] == p)
                        if len(asking):
                            s[np.ix_(asking, of[mine])] = _scores(v[at:stop][mine], vectors[asking], metric).T
                    best.add(s, d, again=True)
            yield from best.hits()

        rows = assigned.select("doc_id", "partition_id", "vector").where(F.size("vector") == vectors.shape[1])
        return rows.mapInArrow(run, HITS)

    found = by_blocks(asked, nearest, block).groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
    return ranked(found, k).withColumn("source", F.lit("dense"))


def save(assigned: DataFrame, centroids: DataFrame, path: str, nprobe: int = 8, metric: str = "ip") -> None:
    """Writes an index: assigned vectors by partition, centroids, and one row of settings."""
    assigned.repartition("partition_id").write.mode("overwrite").partitionBy("partition_id").parquet(f"{path}/vectors")
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    centroids.agg(F.count("*").alias("n_partitions"), F.lit(nprobe).alias("nprobe"), F.lit(metric).alias("metric")).write.mode("overwrite").json(f"{path}/meta")


def search_saved(spark, path: str, queries: DataFrame, nprobe: int | None = None, k: int = 10, adaptive_gap: float | None = None) -> DataFrame:
    """As search(), on a written index and by its metric. Only the routed partitions are read."""
    meta = spark.read.json(f"{path}/meta").first()
    routes = route(queries, spark.read.parquet(f"{path}/centroids"), nprobe or meta["nprobe"], adaptive_gap, meta["metric"])
    wanted = [r.partition_id for r in routes.select("partition_id").distinct().collect()]
    stored = spark.read.parquet(f"{path}/vectors").where(F.col("partition_id").isin(wanted))
    return search(stored, queries, routes, k, meta["metric"])


def sizes(assigned: DataFrame) -> DataFrame:
    """(least, median, most): rows of a partition."""
    n = assigned.groupBy("partition_id").agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"))
