"""What is shuffled and held must not grow with matches, postings, passages or shards."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekframe.operators import graph, rerank, sparse
from seekframe.plans import catalog, pipeline


def shuffled(spark, run) -> int:
    """Bytes that the stages of run() write for shuffles."""
    store, gw = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def total() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, gw.new_array(gw.jvm.double, 0), gw.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def texts(spark, copies: int):
    """copies times 500 texts of the same 60 words."""
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(F.col("id") % 500, i), F.lit(60)).cast("string"))), " ")
    return spark.range(0, 500 * copies, 1, 4).select(F.col("id").alias("doc_id"), words.alias("text"))


def asked(spark):
    return spark.createDataFrame([(q, " ".join(f"w{w}" for w in range(q, q + 20))) for q in range(20)], "qid long, text string")


def test_bm25_shuffles_no_postings_or_matches(spark):
    one, eight = (shuffled(spark, lambda: sparse.bm25(texts(spark, n), asked(spark)).collect()) for n in (1, 8))
    assert eight < 2 * one


def test_bm25_takes_ids_of_any_type_and_equal_scores_go_to_the_smaller(spark):
    docs, queries = texts(spark, 3), asked(spark)
    want = [(r.qid, r.doc_id, round(r.score, 9), r["rank"]) for r in sparse.bm25(docs, queries, 7).orderBy("qid", "rank").collect()]
    assert len(want) == 140 and any(a[:1] == b[:1] and a[2] == b[2] and a[1] < b[1] for a, b in zip(want, want[1:]))
    named = docs.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 6, "0"))
    got = sparse.bm25(named, queries.withColumn("qid", F.lpad(F.col("qid").cast("string"), 3, "0")), 7).orderBy("qid", "rank").collect()
    assert [(int(r.qid), int(r.doc_id), round(r.score, 9), r["rank"]) for r in got] == want


def test_bm25_leaves_out_texts_without_an_id(spark):
    docs = spark.createDataFrame([(1, "red fish"), (None, "red red"), (2, "dogs"), (3, "cats")], "doc_id long, text string")
    assert [r.doc_id for r in sparse.bm25(docs, spark.createDataFrame([(1, "red")], "qid long, text string")).collect()] == [1]


def test_bm25_of_many_blocks_equals_one(spark, monkeypatch):
    docs, queries = texts(spark, 1), asked(spark).unionByName(spark.createDataFrame([(99, "unknown")], "qid long, text string"))
    want = sparse.bm25(docs, queries, 5).orderBy("qid", "rank").collect()
    by_blocks = sparse.by_blocks
    monkeypatch.setattr(sparse, "by_blocks", lambda q, f: by_blocks(q, f, 3))
    monkeypatch.setattr(sparse, "_CELLS", 500)
    got = sparse.bm25(docs, queries, 5).orderBy("qid", "rank").collect()
    assert [(r.qid, r.doc_id, r["rank"]) for r in got] == [(r.qid, r.doc_id, r["rank"]) for r in want]
    assert [r.score for r in got] == pytest.approx([r.score for r in want])
    assert sparse.bm25(docs, queries.where("qid = 99").crossJoin(spark.range(7)).selectExpr("id as qid", "text"), 5).count() == 0


@pytest.mark.parametrize("name", ["o1_set_operations", "a9_retrieval_metrics", "a14_mean_over_workload"])
def test_hits_that_are_read_often_are_searched_once(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "tf" not in plan


def test_hybrid_lists_are_searched_once(spark):
    vectors = spark.range(20).select(F.col("id").alias("qid"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("vector"))
    config = {"name": "h", "dense": {"index": "flat"}, "sparse": {"b": 0.75}, "fusion": {"type": "rrf"}}
    found = pipeline.Pipeline(config, vectors.withColumnRenamed("qid", "doc_id"), texts(spark, 1)).search(asked(spark).join(vectors, "qid"))
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 200


def test_rerank_shuffles_only_passages_that_are_hits(spark):
    hits = spark.createDataFrame([(q, 3 * q + i, 1.0, i + 1, "x") for q in range(20) for i in range(3)], "qid long, doc_id long, score double, rank int, source string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40k")
    try:
        one, eight = (shuffled(spark, lambda: rerank.rerank(hits, asked(spark), texts(spark, n)).collect()) for n in (1, 8))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert eight < 2 * max(one, 1)


def test_graph_search_gets_one_shard_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(7)
    corpus = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(120, 8)))], "doc_id long, vector array<double>")
    name, rows, stored = "spark.sql.execution.arrow.maxRecordsPerBatch", [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: rows.append(spark.conf.get(name)) or stored(df))
    was = spark.conf.get(name)
    found = graph.search(graph.build(corpus, 4, shard=20), corpus.limit(5).withColumnRenamed("doc_id", "qid"), 3)
    assert rows == ["1"] and spark.conf.get(name) == was
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 15


def test_links_do_not_depend_on_how_many_are_scored_at_once(monkeypatch):
    vectors = np.random.default_rng(7).normal(size=(90, 8))
    want = graph.linked(vectors, 5, "ip")
    monkeypatch.setattr(graph, "_CELLS", 700)
    assert np.array_equal(np.sort(graph.linked(vectors, 5, "ip"), axis=1), np.sort(want, axis=1))
