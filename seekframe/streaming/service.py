"""Search requests as a stream: JSON lines in, JSON lines out, through any pipeline.

A request is {"request": id, "qidx": n} or {"request": id, "text": ..., "vector": [...]}; qidx
counts around the pool of known queries. A response is {"request", "hits": [{"doc_id",
"score", "rank"}], "error"}. Requests that can't be answered get an error, never silence.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.workload import wrapped

REQUEST = "request long, qidx long, text string, vector array<float>, k int"


def parsed(lines: DataFrame) -> DataFrame:
    """(value, request, qidx, text, vector, k) of lines (value)."""
    return lines.withColumn("r", F.from_json("value", REQUEST)).select("value", "r.*")


def resolved(requests: DataFrame, pool: DataFrame, size: int) -> DataFrame:
    """requests with the text and vector of their qidx in pool (qidx, text, vector), where they have none of their own."""
    known = pool.select(F.col("qidx").alias("of"), F.col("text").alias("t"), F.col("vector").alias("v"))
    rows = requests.join(known, wrapped(F.col("qidx"), size) == F.col("of"), "left")
    return rows.select("value", "request", F.coalesce("text", "t").alias("text"), F.coalesce("vector", "v").alias("vector"), "k")


def answered(requests: DataFrame, search: Callable[[DataFrame, int], DataFrame], k: int = 10) -> DataFrame:
    """(value) of requests (value, request, text, vector, k): one JSON line for each."""
    fine = F.col("request").isNotNull() & (F.col("text").isNotNull() | F.col("vector").isNotNull())
    hits = search(requests.where(fine).select(F.col("request").alias("qid"), "text", "vector"), k)
    lists = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("hits"))
    rows = requests.join(lists, F.col("request") == F.col("qid"), "left")
    some = F.slice(F.coalesce("hits", F.array().cast("array<struct<rank:int,doc_id:bigint,score:double>>")), 1, F.greatest(F.coalesce("k", F.lit(k)), F.lit(0)))
    error = F.when(F.col("request").isNull(), F.lit("a request needs a number")).when(~fine, F.lit("a request needs a text, a vector or a known qidx"))
    return rows.select(F.to_json(F.struct("request", F.when(fine, some).alias("hits"), error.alias("error"))).alias("value"))


def serve(spark: SparkSession, requests: str, responses: str, checkpoint: str, search: Callable[[DataFrame, int], DataFrame], pool: DataFrame, k: int = 10, files_per_trigger: int = 16) -> StreamingQuery:
    """Answers what is there and stops; call again for more. A batch that is run again replaces its responses."""
    size = max(pool.count(), 1)

    def batch(lines: DataFrame, number: int) -> None:
        out = answered(resolved(parsed(lines), pool, size), search, k)
        out.write.mode("overwrite").text(f"{responses}/batch={number}")

    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(requests)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load(spark: SparkSession, rate: int, pool: int, path: str, checkpoint: str) -> StreamingQuery:
    """Open-loop load: `rate` requests a second, as request files (JSON lines) under path, until the query is stopped."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", rate).load()
    lines = rows.select(F.to_json(F.struct(F.col("value").alias("request"), wrapped(F.col("value"), pool).alias("qidx"))).alias("value"))
    return lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).start()


def closed_loop(search: Callable[[int], object], requests: list[int], slo: float = float("inf")) -> list[tuple[int, float, bool]]:
    """(qidx, milliseconds, ok) of requests asked one after the other; one that raises or takes longer than slo isn't ok."""
    out = []
    for q in requests:
        start, ok = time.perf_counter(), True
        try:
            search(q)
        except Exception:
            ok = False
        took = (time.perf_counter() - start) * 1000
        out.append((q, took, ok and took <= slo))
    return out
