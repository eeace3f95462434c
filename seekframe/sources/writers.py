"""Writers of corpora, queries, workloads, indexes, results and manifests.

Tables go through Spark's committer, which makes each appear whole or not at all. Single
files (.npy, .fbin) are streamed part by part through the store's own file system, under
another name until they are whole.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.workload import contiguous, numbered_queries, remapped_qrels


def write_corpus(df: DataFrame, path: str, *order: str) -> None:
    """Parquet (zstd) with idx counting from 0 in the given order."""
    contiguous(df, *order).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_results(results: DataFrame, root: str, stage: str, config: str, stamp: str) -> str:
    """JSON under root/stage/config/stamp."""
    path = f"{root}/{stage}/{config}/{stamp}"
    results.write.mode("overwrite").json(path)
    return path


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def fbin_parts(vectors: DataFrame) -> DataFrame:
    """(first_id, content) of (doc_id, vector): little-endian 32-bit rows in id order, in parts of up to 4096 rows.

    fbin_header and the parts by first_id, one after the other, are the file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4")
                yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), pa.array([values.tobytes()], pa.binary())], names=["first_id", "content"])

    rows = vectors.select("doc_id", "vector").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return rows.mapInArrow(run, "first_id long, content binary")


def fbin_header(vectors: DataFrame) -> bytes:
    """Rows and length of a vector, as two little-endian 32-bit integers."""
    r = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    return struct.pack("<ii", r.n, r.d or 0)


def read_fbin(content: bytes) -> np.ndarray:
    n, d = struct.unpack("<ii", content[:8])
    return np.frombuffer(content, dtype="<f4", offset=8).reshape(n, d)


def write_ground_truth(truth: DataFrame, path: str) -> DataFrame:
    """Writes (qid, rank, doc_id) of exact hits; gives the manifest of what was written."""
    truth.select("qid", "rank", "doc_id").write.mode("overwrite").parquet(path)
    return manifest(truth.sparkSession, path)


def write_file(spark: SparkSession, path: str, parts: Iterable[bytes]) -> int:
    """Writes parts one after the other to a file of any store that Spark knows; it has its name once it is whole. Gives its length."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(hadoop)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out, n = fs.create(part, True), 0
    try:
        for content in parts:
            out.write(bytearray(content))
            n += len(content)
        out.close()
        if fs.exists(target):
            fs.delete(target, False)
        if not fs.rename(part, target):
            raise OSError(f"{path} can't be written")
    except BaseException:
        out.close()
        fs.delete(part, False)
        raise
    return n


def _contents(vectors: DataFrame) -> Iterator[bytes]:
    for r in fbin_parts(vectors).orderBy("first_id").toLocalIterator():
        yield bytes(r.content)


def write_fbin(vectors: DataFrame, path: str) -> int:
    """One .fbin file of (doc_id, vector), in id order: row count and length, then 32-bit rows. Gives its bytes."""
    return write_file(vectors.sparkSession, path, (x for y in ([fbin_header(vectors)], _contents(vectors)) for x in y))


def write_npy(vectors: DataFrame, path: str) -> int:
    """One .npy file of (doc_id, vector): a 32-bit matrix in id order. Gives its bytes."""
    n, d = struct.unpack("<ii", fbin_header(vectors))
    header = io.BytesIO()
    np.lib.format.write_array_header_1_0(header, {"descr": "<f4", "fortran_order": False, "shape": (n, d)})
    return write_file(vectors.sparkSession, path, (x for y in ([header.getvalue()], _contents(vectors)) for x in y))


def write_queries(queries: DataFrame, qrels: DataFrame, docs: DataFrame, path: str) -> DataFrame:
    """Writes numbered queries, judgements of known queries and documents, and one row of counts, which it gives.

    queries (query_id, text); qrels (query_id, doc_key, score); docs (doc_key, idx).
    """
    spark = queries.sparkSession
    numbered_queries(queries).write.mode("overwrite").parquet(f"{path}/queries")
    numbered = spark.read.parquet(f"{path}/queries")
    kept, dropped = remapped_qrels(qrels, numbered, docs)
    kept.write.mode("overwrite").parquet(f"{path}/qrels")
    counts = numbered.agg(F.count("*").alias("queries")).crossJoin(spark.read.parquet(f"{path}/qrels").agg(F.count("*").alias("qrels"), F.countDistinct("qidx").alias("judged"))).crossJoin(dropped)
    counts.write.mode("overwrite").json(f"{path}/counts")
    return spark.read.json(f"{path}/counts").select("queries", "qrels", "judged", "dropped")


def write_workload(stream: DataFrame, path: str, name: str, **settings) -> DataFrame:
    """Writes requests (seq, qidx) in order and their settings as JSON beside them; gives the manifest of both."""
    spark = stream.sparkSession
    stream.repartitionByRange("seq").sortWithinPartitions("seq").write.mode("overwrite").parquet(f"{path}/{name}")
    found = spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n"), F.countDistinct("qidx").alias("distinct")).first()
    write_file(spark, f"{path}/{name}.json", [json.dumps({"name": name, "n_queries": found.n, "distinct": found.distinct} | settings, sort_keys=True).encode()])
    return manifest(spark, f"{path}/{name}").unionByName(manifest(spark, f"{path}/{name}.json"))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """A store of 32-bit vectors for lookups by id: in id order, so that a lookup reads the row groups of its ids only."""
    rows = vectors.select("doc_id", F.col("vector").cast("array<float>").alias("vector"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(path)


def vector_rows(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """(doc_id, vector) of some ids of a store; unknown ids give no row."""
    return spark.read.parquet(path).where(F.col("doc_id").isin([int(i) for i in ids]))
