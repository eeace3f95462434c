"""Reranking of the first hits by a pluggable scorer of (query text, passage) pairs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut_for_rerank, tokens
from ..session import stored


def lexical_overlap(query: Column, passage: Column) -> Column:
    """Share of the query's distinct tokens that the passage has; a stand-in scorer that needs no model."""
    q = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(q, tokens(passage))) / F.greatest(F.size(q), F.lit(1))


def batch_scorer(score: Callable[[pd.Series, pd.Series], pd.Series]) -> Callable[[Column, Column], Column]:
    """A scorer from a function of whole batches, such as a cross-encoder's predict."""
    return F.pandas_udf(score, "double")


def rerank(hits: DataFrame, queries: DataFrame, passages: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_overlap, depth: int = 50, k: int = 10, max_length: int = 256) -> DataFrame:
    """The first `depth` hits scored anew, best k; ties keep their order. A missing passage counts as empty; depth below k shortens the result.

    Hits are written first: by the size of their files the passages' ids are looked up by broadcast, and only cut passages that are hits are shuffled.
    """
    some = stored(hits.where(F.col("rank") <= depth).select("qid", "doc_id", F.col("rank").alias("was")))
    found = passages.select("doc_id", cut_for_rerank("text", max_length).alias("p")).join(some.select("doc_id"), "doc_id", "left_semi")
    some = some.join(queries.select("qid", F.col("text").alias("q")), "qid").join(stored(found), "doc_id", "left")
    scored = some.select("qid", "doc_id", "was", scorer(F.col("q"), F.coalesce("p", F.lit(""))).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "was")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "doc_id", "score", "rank", F.lit("reranked").alias("source"))
