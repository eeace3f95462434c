from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seekframe.operators import dense, fusion, ivf, quantize, rerank, sparse
from seekframe.plans import pipeline

RNG = np.random.default_rng(3)
VECTORS = RNG.normal(size=(120, 16))
VECTORS /= np.linalg.norm(VECTORS, axis=1, keepdims=True)
VECTORS[77] = VECTORS[5]  # a tie


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(VECTORS)] + [(500, None)], "doc_id long, vector array<double>").repartition(5)


@pytest.fixture(scope="module")
def asked(corpus):
    return corpus.where("doc_id < 12").withColumnRenamed("doc_id", "qid")


def lists(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append(r.doc_id)
    return out


def brute(score, k, n=12):
    return {q: [int(i) for i in np.lexsort((np.arange(len(VECTORS)), -np.round(score[q], 9)))[:k]] for q in range(n)}


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_flat_knn_equals_brute_force(corpus, asked, metric):
    s = VECTORS[:12] @ VECTORS.T if metric == "ip" else -((VECTORS[:12, None] - VECTORS[None]) ** 2).sum(axis=2)
    assert lists(dense.flat_knn(corpus, asked, 7, metric, block=5)) == brute(s, 7)


def test_k_larger_than_corpus_and_no_queries(corpus, asked):
    assert len(lists(dense.flat_knn(corpus, asked.where("qid = 0"), 500))[0]) == 120
    assert dense.flat_knn(corpus, asked.where("qid < 0"), 5).count() == 0


def test_probing_all_partitions_is_exact(spark, corpus, asked, tmp_path):
    cents = spark.createDataFrame([(i, [float(x) for x in VECTORS[i * 7]]) for i in range(6)], "partition_id int, centroid array<double>")
    exact = lists(dense.flat_knn(corpus, asked, 5))
    for overlap in (1, 3):
        assigned = ivf.assign(corpus, cents, overlap)
        assert lists(ivf.search(assigned, asked, ivf.route(asked, cents, 6), 5)) == exact
        few = lists(ivf.search(assigned, asked, ivf.route(asked, cents, 2), 5))
        assert all(few[q][0] == exact[q][0] for q in few)
    ivf.save(assigned, cents, str(tmp_path / "ix"), nprobe=6)
    assert lists(ivf.search_saved(spark, str(tmp_path / "ix"), asked, k=5)) == exact


def test_adaptive_routing_keeps_the_place_after_the_gap(spark, asked):
    cents = spark.createDataFrame([(i, [float(x) for x in VECTORS[i]]) for i in range(10)], "partition_id int, centroid array<double>")
    got = {q: [] for q in range(12)}
    for r in ivf.route(asked, cents, 8, 0.15).orderBy("place").collect():
        got[r.qid].append(r.partition_id)
    for q in range(12):
        s = VECTORS[:10] @ VECTORS[q]
        order = np.argsort(-s, kind="stable")
        want = [int(order[0])]
        for i in range(1, 8):
            want.append(int(order[i]))
            if s[order[i - 1]] - s[order[i]] > 0.15 and len(want) >= 2:
                break
        assert got[q] == want


def test_kmeans_search_reaches_the_recall_floor(corpus, asked):
    cents = ivf.kmeans_centroids(corpus, 8)
    found = lists(ivf.search(ivf.assign(corpus, cents, 2), asked, ivf.route(asked, cents, 6), 10))
    exact = lists(dense.flat_knn(corpus, asked, 10))
    assert np.mean([len(set(found[q]) & set(exact[q])) / 10 for q in exact]) >= 0.9


def test_hamming_and_product_codes(corpus, asked):
    bits = VECTORS >= 0
    assert lists(quantize.hamming_knn(quantize.binary(corpus.where("vector is not null")), asked, 6)) == brute(-(bits[:12, None] != bits[None]).sum(axis=2).astype(float), 6)
    codes = quantize.ProductCodes.train(corpus, m=4, bits=4)
    stored = {r.doc_id: r.code for r in codes.encode(corpus).collect()}
    decoded = np.stack([np.concatenate([codes.books[j, c] for j, c in enumerate(stored[i])]) for i in range(120)])
    assert lists(codes.knn(codes.encode(corpus), asked, 5)) == brute(VECTORS[:12] @ decoded.T, 5)
    with pytest.raises(ValueError):
        quantize.ProductCodes.train(corpus, m=5)


def test_rescoring_ranks_by_full_vectors(corpus, asked):
    coarse = quantize.hamming_knn(quantize.binary(corpus.where("vector is not null")), asked, 120)
    assert lists(dense.rescore(coarse, corpus, asked, 120, 5)) == lists(dense.flat_knn(corpus, asked, 5))


def hits(spark, rows):
    return spark.createDataFrame(rows, "qid long, doc_id long, score double, rank int, source string")


def test_merge_keeps_the_highest_score(spark):
    a = hits(spark, [(1, 10, 0.5, 1, "dense"), (1, 11, 0.4, 2, "dense")])
    b = hits(spark, [(1, 10, 0.8, 1, "dense"), (1, 12, 0.1, 2, "dense")])
    got = dense.merge(a, b, k=3).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(10, 0.8), (11, 0.4), (12, 0.1)]


def test_rrf_prefers_shared_and_breaks_ties_by_the_first_list(spark):
    a = hits(spark, [(1, 1, 9.0, 1, "dense"), (1, 2, 8.0, 2, "dense")])
    b = hits(spark, [(1, 2, 3.0, 1, "bm25"), (1, 3, 2.0, 2, "bm25")])
    assert lists(fusion.rrf(a, b)) == {1: [2, 1, 3]}
    assert lists(fusion.rrf(a.limit(1), b.limit(1))) == {1: [1, 2]}


def test_weighted_with_equal_scores_and_an_empty_list(spark):
    a = hits(spark, [(1, 1, 5.0, 1, "dense"), (1, 2, 5.0, 2, "dense")])
    got = fusion.weighted(a, a.where("false")).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(1, 0.0), (2, 0.0)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.permutations(range(6)), st.permutations(range(6)))
def test_rrf_scores_do_not_depend_on_the_order_of_lists(spark, p, q):
    a, b = ([(1, d, 1.0, i + 1, "x") for i, d in enumerate(x)] for x in (p, q))
    one, two = ({r.doc_id: round(r.score, 12) for r in fusion.rrf(*x).collect()} for x in ((hits(spark, a), hits(spark, b)), (hits(spark, b), hits(spark, a))))
    assert one == two


DOCS = [(0, "red fish blue fish"), (1, "one fish"), (2, "two dogs"), (3, ""), (4, None), (5, "red red red")]


def test_bm25_by_hand(spark):
    import math

    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "red red fish"), (2, "unknown"), (3, ""), (4, None)], "qid long, text string")
    got = {r.doc_id: r.score for r in sparse.bm25(docs, queries).where("qid = 1").collect()}
    toks = {i: (t or "").split() for i, t in DOCS}
    n, avg = 6, sum(map(len, toks.values())) / 6
    df = {w: sum(w in t for t in toks.values()) for w in {w for t in toks.values() for w in t}}
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    for i, t in toks.items():
        s = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in ("red", "red", "fish") if w in t)
        assert got.get(i, 0.0) == pytest.approx(s)
    assert sparse.bm25(docs, queries).where("qid > 1").count() == 0
    assert lists(sparse.bm25(docs, queries, 3, fill_zero=True))[2] == [0, 1, 2]


def test_rerank_with_missing_passage_and_short_depth(spark):
    h = hits(spark, [(1, 0, 3.0, 1, "bm25"), (1, 9, 2.0, 2, "bm25"), (1, 1, 1.0, 3, "bm25")])
    queries = spark.createDataFrame([(1, "one fish")], "qid long, text string")
    passages = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert lists(rerank.rerank(h, queries, passages)) == {1: [1, 0, 9]}
    assert lists(rerank.rerank(h, queries, passages, depth=2)) == {1: [0, 9]}
    assert lists(rerank.rerank(h, queries, passages, rerank.batch_scorer(lambda q, p: p.str.len().astype(float)))) == {1: [0, 1, 9]}


def test_pipeline_passes_on_the_list_that_there_is(spark, corpus):
    asked = spark.createDataFrame([(1, "red fish", None), (2, None, [float(x) for x in VECTORS[3]]), (3, "one fish", [float(x) for x in VECTORS[4]])], "qid long, text string, vector array<double>")
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    p = pipeline.Pipeline({"name": "x", "dense": {"index": "flat"}, "sparse": {"k1": 1.5}, "fusion": {"type": "weighted"}, "rescoring": "none"}, corpus, docs)
    got = {r.qid: r.source for r in p.search(asked, 2).select("qid", "source").distinct().collect()}
    assert got == {1: "bm25", 2: "dense", 3: "fused"}
    assert "rescoring" not in p.config
    with pytest.raises(ValueError):
        pipeline.Pipeline({"dense": {}})
    assert len(pipeline.config_hash({"b": 1, "a": 2})) == 16 and pipeline.config_hash({"b": 1, "a": 2}) == pipeline.config_hash({"a": 2, "b": 1})


def test_exact_cache_searches_a_text_once(spark):
    q = spark.createDataFrame([(1, "Red  fish"), (2, "red fish "), (3, "")], "qid long, text string")
    reps, members = pipeline.distinct_queries(q)
    assert {r.qid for r in reps.collect()} == {1, 3} and {(r.qid, r.rep) for r in members.collect()} == {(1, 1), (2, 1), (3, 3)}
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    found = lists(pipeline.Pipeline({"name": "c", "sparse": {"b": 0.75}, "cache": {"exact": True}}, passages=docs).search(q))
    assert found[1] == found[2] and 3 not in found


def test_graph_search(spark, corpus, asked, tmp_path):
    from seekframe.operators import graph

    for metric in ("ip", "l2"):
        shards = graph.build(corpus, 6, metric, shard=50)
        found, exact = lists(graph.search(shards, asked, 10, 40, metric)), lists(dense.flat_knn(corpus, asked, 10, metric))
        assert np.mean([len(set(found[q]) & set(exact[q])) / 10 for q in exact]) >= 0.9
    graph.save(shards, str(tmp_path / "g"), 6, 40, "l2")
    assert lists(graph.search_saved(spark, str(tmp_path / "g"), asked)) == found
    r = graph.stats(spark.read.parquet(str(tmp_path / "g/shards"))).first()
    assert r.n == 120 and r.bytes > 0
    one = corpus.where("doc_id = 3")
    assert lists(graph.search(graph.build(one), asked.where("qid = 0"), 5)) == {0: [3]}
    assert graph.search(graph.build(corpus.where("false")), asked, 5).count() == 0


def test_recall_at_the_registered_settings(spark, sf):
    from seekframe.plans import catalog

    exact = lists(catalog.QUERIES["r1_flat_knn"](spark, sf))
    for name in ("r2_ann_kmeans", "r2_graph_knn", "r9_product_codes_knn"):
        found = lists(catalog.QUERIES[name](spark, sf))
        assert np.mean([len(set(found.get(q, [])) & set(exact[q])) / 10 for q in exact]) >= 0.9, name


def test_partition_search_by_distance_and_over_batches(spark, corpus, asked):
    cents = ivf.kmeans_centroids(corpus, 8)
    exact = lists(dense.flat_knn(corpus, asked, 10, "l2"))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a vector's partitions come in different batches
    try:
        found = lists(ivf.search(ivf.assign(corpus, cents, 3, "l2"), asked, ivf.route(asked, cents, 8, metric="l2"), 10, "l2", block=5))
        assert found == exact
        few = lists(ivf.search(ivf.assign(corpus, cents, 2, "l2"), asked, ivf.route(asked, cents, 5, metric="l2"), 10, "l2"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert np.mean([len(set(few[q]) & set(exact[q])) / 10 for q in exact]) >= 0.9


def test_strict_calls_and_unknown_indexes_raise(spark, corpus, asked):
    p = pipeline.Pipeline({"name": "g", "dense": {"index": "graph"}}, corpus)
    rows = asked.withColumn("text", F.lit(None).cast("string"))
    assert lists(p.search(rows, 3)).keys() == lists(dense.flat_knn(corpus, asked, 3)).keys()
    with pytest.raises(ValueError):
        p.search(rows.withColumn("vector", F.lit(None).cast("array<double>")), 3, strict=True)
    with pytest.raises(ValueError):
        pipeline.Pipeline({"name": "g", "dense": {"index": "tree"}}, corpus).search(rows, 3)


def test_requests_as_a_stream(spark, corpus, asked, tmp_path):
    import json
    import time

    from seekframe.streaming import service

    pool = asked.select(F.col("qid").alias("qidx"), F.lit(None).cast("string").alias("text"), F.col("vector").cast("array<float>").alias("vector"))
    p = pipeline.Pipeline({"name": "flat", "dense": {"index": "flat"}}, corpus)
    (tmp_path / "in").mkdir()
    lines = [{"request": 7, "qidx": 3}, {"request": 8, "qidx": 15, "k": 2}, {"request": 9}, "no json"]
    (tmp_path / "in" / "a").write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines))
    service.serve(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), p.search, pool, 5).awaitTermination(120)
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    by = {x.get("request"): x for x in got}
    exact = lists(dense.flat_knn(corpus, asked, 5))
    assert [h["doc_id"] for h in by[7]["hits"]] == exact[3] and [h["doc_id"] for h in by[8]["hits"]] == exact[3][:2]
    assert "error" in by[9] and "error" in by[None] and len(got) == 4
    stream = service.load(spark, 50, 4, str(tmp_path / "load"), str(tmp_path / "cp2"))
    try:
        for _ in range(60):
            time.sleep(0.5)
            if (tmp_path / "load" / "_spark_metadata").exists() and spark.read.text(str(tmp_path / "load")).count():
                break
    finally:
        stream.stop()
    assert {json.loads(r.value)["qidx"] for r in spark.read.text(str(tmp_path / "load")).collect()} <= {0, 1, 2, 3}
    took = service.closed_loop(lambda q: 1 / q, [1, 0], 1000.0)
    assert [ok for _, _, ok in took] == [True, False]
