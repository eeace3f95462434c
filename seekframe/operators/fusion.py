"""Fusion of hit lists by reciprocal ranks or by weighted, normalised scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def reciprocal(rank: Column, k: int = RRF_K) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def rrf(*lists: DataFrame, rrf_k: int = RRF_K, k: int = 10) -> DataFrame:
    """Sum of 1 / (rrf_k + rank) over the lists. Ties go to the better rank in the first list, then the second, and so on."""
    parts = [x.select("qid", "doc_id", F.lit(i).alias("list"), "rank") for i, x in enumerate(lists)]
    firsts = [F.min(F.when(F.col("list") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(lists))]
    fused = reduce(DataFrame.unionByName, parts).groupBy("qid", "doc_id").agg(F.sum(reciprocal(F.col("rank"), rrf_k)).alias("score"), *firsts)
    order = [F.round("score", 12).desc(), *(F.col(f"r{i}").asc_nulls_last() for i in range(len(lists))), F.col("doc_id")]
    fused = fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= k)
    return fused.select("qid", "doc_id", "score", "rank", F.lit("fused").alias("source"))


def min_max(hits: DataFrame) -> DataFrame:
    """hits with their score between 0 and 1 within the query's list; a list of equal scores is all 0."""
    w = Window.partitionBy("qid")
    low, span = F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)
    return hits.withColumn("score", (F.col("score") - low) / F.when(span == 0, 1.0).otherwise(span))


def weighted(dense: DataFrame, sparse: DataFrame, w_dense: float = 0.5, w_sparse: float = 0.5, k: int = 10) -> DataFrame:
    """Weighted sum of both lists' normalised scores; a list without the document gives 0."""
    parts = [min_max(x).select("qid", "doc_id", (F.lit(w) * F.col("score")).alias("part")) for x, w in ((dense, float(w_dense)), (sparse, float(w_sparse)))]
    fused = parts[0].unionByName(parts[1]).groupBy("qid", "doc_id").agg(F.sum("part").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "doc_id", "score", "rank", F.lit("fused").alias("source"))
