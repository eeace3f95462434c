"""Embedding of passages by a pluggable encoder, in chunks that a later run takes up again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import valid_vectors

CHUNK = 100_000


def embed(passages: DataFrame, encode: Callable[[list[str]], np.ndarray], dim: int, batch: int = 256, before: Callable[[], object] | None = None) -> DataFrame:
    """(doc_id, vector) of passages (doc_id, text): normalised vectors, `batch` texts at a time.

    `before` is called before each batch, such as sources.system.wait_for_room.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                if before is not None:
                    before()
                v = np.asarray(encode([t or "" for t in part.column(1).to_pylist()]), dtype=np.float32).reshape(-1, dim)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(v), pa.list_(pa.float32()))], names=["doc_id", "vector"])

    return passages.select("doc_id", "text").mapInArrow(run, "doc_id long, vector array<float>")


def embed_resumable(passages: DataFrame, encode: Callable[[list[str]], np.ndarray], dim: int, path: str, chunk: int = CHUNK) -> DataFrame:
    """As embed(), written to path by chunks of ids. Chunks that are there whole and sound aren't embedded again; others are replaced.

    Gives all vectors, in id order within chunks.
    """
    spark = passages.sparkSession
    wanted = passages.withColumn("chunk", F.floor(F.col("doc_id") / chunk).cast("long"))
    try:
        stored = valid_vectors(spark.read.schema("doc_id long, vector array<float>, chunk long").parquet(path), dim)
        sizes = wanted.groupBy("chunk").agg(F.count("*").alias("n"))
        done = stored.groupBy("chunk").agg(F.count("*").alias("n")).join(sizes, ["chunk", "n"]).select("chunk")
        todo = wanted.join(done, "chunk", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = wanted
    rows = embed(todo, encode, dim).withColumn("chunk", F.floor(F.col("doc_id") / chunk).cast("long"))
    rows.repartition("chunk").sortWithinPartitions("chunk", "doc_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)
    return spark.read.schema("doc_id long, vector array<float>, chunk long").parquet(path).select("doc_id", "vector")
