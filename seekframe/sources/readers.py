"""Readers of corpora, queries, judgements and vectors. Everything goes through Spark's sources, so any store that it reads will do."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    return spark.read.parquet(path).select(*(columns or ["*"]))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, title, text) of JSON lines, gzipped or not; the id is _id or else id, a null title or text is empty."""
    raw = spark.read.schema("_id string, id string, title string, text string").json(path)
    empty = F.lit("")
    return raw.select(F.coalesce("_id", "id").alias("doc_key"), F.coalesce("title", empty).alias("title"), F.coalesce("text", empty).alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_key, score) of tab-separated judgements; header lines and rows of under three fields fall away."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(f) >= 3)
    rows = rows.select(F.get(f, F.lit(0)).alias("query_id"), F.get(f, F.lit(1)).alias("doc_key"), F.element_at(f, -1).try_cast("int").alias("score"))
    return rows.where("score is not null")


def discover(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """{"corpus": files, "queries": files} under root, by "corpus" or "quer" in the path; Parquet where there is any, else JSON lines."""
    files = [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path").orderBy("path").toLocalIterator()]
    out = {}
    for kind, word in (("corpus", "corpus"), ("queries", "quer")):
        mine = [p for p in files if word in p.rsplit("//", 1)[-1].lower()]
        parquet = [p for p in mine if p.endswith(".parquet")]
        out[kind] = parquet or [p for p in mine if p.endswith((".jsonl", ".jsonl.gz", ".json", ".json.gz"))]
    return out


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, vector) of .npy matrices: rows are numbered from 0 within each file, with its path as `file`. A file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1)):
                m = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                for at in range(0, len(m), 4096):
                    part = np.ascontiguousarray(m[at : at + 4096], dtype=np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(list(part), pa.list_(pa.float32()))], names=["file", "doc_id", "vector"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, doc_id long, vector array<float>")


def read_config(spark: SparkSession, path: str) -> dict:
    """A pipeline's configuration from YAML or JSON, a mapping with a name; from any store that Spark reads."""
    text = bytes(spark.read.format("binaryFile").load(path).first().content).decode()
    try:
        import yaml
    except ImportError:
        found = json.loads(text)
    else:
        found = yaml.safe_load(text)
    if not isinstance(found, dict) or "name" not in found:
        raise ValueError(f"{path} must be a mapping with a name")
    return found


def valid_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector has the right length and no missing value."""
    return vectors.where((F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
