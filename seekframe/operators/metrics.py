"""Retrieval metrics as joins and aggregations.

hits: (qid, doc_id, rank). qrels: (qid, doc_id, grade); every row is a relevant document
whatever its grade. truth: (qid, doc_id, rank). Metrics of single queries come as
(qid, value); queries without qrels have no value, queries without hits have 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first(hits: DataFrame, k: int) -> DataFrame:
    if k <= 0:
        raise ValueError("k must be positive")
    return hits.where(F.col("rank") <= k)


def _by_query(judged: DataFrame, values: DataFrame) -> DataFrame:
    return judged.select("qid").distinct().join(values, "qid", "left").select("qid", F.coalesce("value", F.lit(0.0)).alias("value"))


def ann_recall(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Share of the k true neighbours that are among the first k hits; always over k."""
    both = _first(hits, k).select("qid", "doc_id").distinct().join(_first(truth, k).select("qid", "doc_id").distinct(), ["qid", "doc_id"])
    return _by_query(truth, both.groupBy("qid").agg((F.count("*") / F.lit(float(k))).alias("value")))


def precision(hits: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Relevant among the first k, over k; a repeated hit counts each time."""
    found = _first(hits, k).join(qrels.select("qid", "doc_id").distinct(), ["qid", "doc_id"])
    return _by_query(qrels, found.groupBy("qid").agg((F.count("*") / F.lit(float(k))).alias("value")))


def recall(hits: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Share of a query's relevant documents that are among the first k."""
    relevant = qrels.select("qid", "doc_id").distinct()
    found = _first(hits, k).select("qid", "doc_id").distinct().withColumn("hit", F.lit(1))
    return relevant.join(found, ["qid", "doc_id"], "left").groupBy("qid").agg((F.count("hit") / F.count("*")).alias("value"))


def mrr(hits: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """1 / rank of the first relevant hit among the first k."""
    found = _first(hits, k).join(qrels.select("qid", "doc_id").distinct(), ["qid", "doc_id"])
    return _by_query(qrels, found.groupBy("qid").agg((F.lit(1.0) / F.min("rank")).alias("value")))


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def ndcg(hits: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Discounted gain of the first k over that of the ideal order of all grades; 0 if the ideal is 0."""
    grades = qrels.groupBy("qid", "doc_id").agg(F.max("grade").alias("grade"))
    got = _first(hits, k).join(grades, ["qid", "doc_id"]).groupBy("qid").agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "doc_id"))
    ideal = grades.withColumn("place", order).where(F.col("place") <= k).groupBy("qid").agg(F.sum(gain(F.col("grade"), F.col("place"))).alias("idcg"))
    return ideal.join(got, "qid", "left").select("qid", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("value"))


def mean(values: DataFrame, name: str = "value") -> DataFrame:
    return values.agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias(name))


def over_workload(workload: DataFrame, values: DataFrame) -> DataFrame:
    """Mean over the workload's requests: a query asked twice counts twice."""
    return mean(workload.select("qid").join(values, "qid"))


def latency(samples: DataFrame, *by: str, value: str = "value", accuracy: int | None = None) -> DataFrame:
    """p50, p95, p99 (interpolated) and mean; zeros without samples.

    Exact percentiles keep a count of each distinct value of a group in one task. Where a group
    has too many for that, give an accuracy: ranks are then off by at most 1 / accuracy.
    """
    share = [0.5, 0.95, 0.99]
    p = F.percentile(value, F.array(*map(F.lit, share))) if accuracy is None else F.percentile_approx(value, share, accuracy)
    zero = F.lit(0.0)
    return samples.groupBy(*by).agg(p.alias("p"), F.avg(value).alias("m")).select(*by, *(F.coalesce(F.get("p", F.lit(i)), zero).alias(n) for i, n in enumerate(("p50", "p95", "p99"))), F.coalesce("m", zero).alias("mean"))


def evaluate(hits: DataFrame, qrels: DataFrame, k: int = 10, recall_k: int = 100) -> DataFrame:
    """One row for each judged query: precision, mrr, ndcg at k, recall at recall_k."""
    parts = {"precision": precision(hits, qrels, k), "mrr": mrr(hits, qrels, k), "ndcg": ndcg(hits, qrels, k), "recall": recall(hits, qrels, recall_k)}
    out = qrels.select("qid").distinct()
    for name, values in parts.items():
        out = out.join(values.withColumnRenamed("value", name), "qid")
    return out
