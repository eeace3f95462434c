from __future__ import annotations

import random

import pytest

from seekframe.operators import caches, metrics, workload
from seekframe.streaming import replay


def ranks(spark, ids, qid=1):
    return spark.createDataFrame([(qid, d, i + 1) for i, d in enumerate(ids)], "qid long, doc_id long, rank int")


def qrels(spark, grades, qid=1):
    return spark.createDataFrame([(qid, d, g) for d, g in grades.items()], "qid long, doc_id long, grade int")


def value(df):
    return df.where("qid = 1").first()["value"]


def test_metrics_by_hand(spark):
    assert value(metrics.ann_recall(ranks(spark, [1, 2, 3]), ranks(spark, [3, 2, 1]), 3)) == 1.0
    assert value(metrics.ann_recall(ranks(spark, [1, 2, 9]), ranks(spark, [1, 2, 3]), 3)) == pytest.approx(2 / 3)
    q = qrels(spark, {2: 1, 4: 1, 9: 1})
    h = ranks(spark, [1, 2, 3, 4])
    assert value(metrics.precision(h, q, 4)) == 0.5
    assert value(metrics.precision(h, q, 10)) == pytest.approx(0.2)
    assert value(metrics.recall(h, q, 2)) == pytest.approx(1 / 3)
    assert value(metrics.mrr(ranks(spark, [5, 6, 7, 2]), q, 10)) == 0.25
    assert value(metrics.mrr(ranks(spark, [5, 6]), q, 10)) == 0.0
    assert value(metrics.ndcg(ranks(spark, [1, 2]), qrels(spark, {1: 3, 2: 1}), 10)) == pytest.approx(1.0)
    assert value(metrics.ndcg(ranks(spark, [1, 2]), qrels(spark, {1: 0}), 10)) == 0.0
    with pytest.raises(ValueError):
        metrics.precision(h, q, 0)


def test_latency_and_workload_means(spark):
    r = metrics.latency(spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40, 50)], "value double")).first()
    assert (r.p50, r["mean"]) == (30.0, 30.0)
    r = metrics.latency(spark.createDataFrame([], "value double")).first()
    assert (r.p50, r.p99, r["mean"]) == (0.0, 0.0, 0.0)
    w = spark.createDataFrame([(1,), (1,), (2,), (3,)], "qid long")
    v = spark.createDataFrame([(1, 1.0), (2, 0.0)], "qid long, value double")
    assert metrics.over_workload(w, v).first()["value"] == pytest.approx(2 / 3)


def trace(spark, n=400, workers=3):
    r = random.Random(5)
    rows = [(r.randrange(workers), i, r.choice(["", None, *(f"Q {j}" for j in range(25))])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "worker long, seq long, text string").repartition(4)


def simulated(rows, size):
    kept, out = {}, {}
    for w, i, t in rows:
        k = (t or "").lower()
        mine = kept.setdefault(w, [])
        if not k:
            out[i] = None
            continue
        out[i] = k in mine
        if k in mine:
            mine.remove(k)
        mine.append(k)
        del mine[:-size]
    return out


@pytest.mark.parametrize("size", [3, 1000])
def test_exact_replay_equals_a_simulation(spark, size):
    rows, df = trace(spark)
    assert {r.seq: r.hit for r in caches.replay_exact(df, size).collect()} == simulated(rows, size)


def test_streaming_replay_equals_batch(spark, tmp_path):
    rows, df = trace(spark, 120)
    for part in range(3):
        df.where(f"seq div 40 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        replay.write(replay.replay_exact(replay.requests(spark, str(tmp_path / "in")), 4), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {r.seq: r.hit for r in spark.read.parquet(str(tmp_path / "out")).collect()} == simulated(rows, 4)


def test_unbounded_hits_are_an_upper_bound(spark):
    from pyspark.sql import functions as F

    from seekframe.functions.text import query_key

    rows, df = trace(spark, workers=1)
    free = {r.seq: r.hit for r in caches.unbounded_hits(df, query_key(F.col("text"))).collect()}
    assert free == simulated(rows, 10**6)
    assert sum(bool(x) for x in simulated(rows, 5).values()) <= sum(bool(x) for x in free.values())
    r = caches.hit_rate(caches.unbounded_hits(df, query_key(F.col("text")))).first()
    assert r.hits + r.misses == sum(x is not None for x in free.values())


def test_semantic_cache_is_first_in_first_out(spark):
    c = caches.SemanticCache(2, 0.99)
    import numpy as np

    a, b, d = (np.eye(3, dtype=np.float32)[i] for i in range(3))
    assert [c.ask(x) for x in (None, a, a, b, d, a, d)] == [False, False, True, False, False, False, True]


def test_partition_policies():
    lru = caches.PartitionCache(20, "lru")
    assert [lru.ask(p, 10) for p in (1, 2, 1, 3, 2)] == [(False, 0), (False, 0), (True, 0), (False, 1), (False, 1)]
    lfu = caches.PartitionCache(20, "lfu")
    [lfu.ask(p, 10) for p in (1, 1, 2, 3)]
    assert set(lfu.meta) == {1, 3}
    cost = caches.PartitionCache(30, "cost")
    [cost.ask(p, n) for p, n in ((1, 20), (2, 10), (3, 10))]
    assert set(cost.meta) == {2, 3}
    big = caches.PartitionCache(5, "lru", frozenset({1}))
    assert big.ask(1, 10) == (False, 0) and big.ask(2, 10) == (False, 0) and set(big.meta) == {1, 2}
    with pytest.raises(ValueError):
        caches.PartitionCache(1, "mru")


def test_prefetch(spark):
    probes = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 2), (3, 0), (3, 1)], "request long, partition_id int")
    assert {(r.a, r.b): r.n for r in caches.co_access(probes).collect()} == {(0, 1): 2, (1, 0): 2, (0, 2): 1, (2, 0): 1}
    cents = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0])], "partition_id int, centroid array<double>")
    # Request 2 sees what came before it and itself, not request 3.
    assert {(r.request, r.target) for r in caches.prefetch_targets(probes, cents, "history", 1).collect()} == {(2, 1)}
    with pytest.raises(ValueError):
        caches.prefetch_targets(probes, cents, "oracle")
    assert caches.prefetch_targets(probes, cents, "none").count() == 0
    assert {(r.partition_id, r.related) for r in caches.neighbours(cents, 1).collect()} == {(0, 1), (1, 0), (2, 1)}


@pytest.mark.parametrize("block", [7, 100_000])
def test_history_sees_no_later_request(spark, block):
    r = random.Random(3)
    asked = {i * 2: sorted(r.sample(range(9), r.randrange(1, 5))) for i in range(60)}
    seen, expected = {}, set()
    for i, parts in asked.items():
        for a in parts:
            for b in parts:
                if a != b:
                    seen.setdefault(a, {})[b] = seen.get(a, {}).get(b, 0) + 1
        for a in parts:
            expected |= {(i, b) for b, _ in sorted(seen.get(a, {}).items(), key=lambda x: (-x[1], x[0]))[:2]}
    probes = spark.createDataFrame([(i, p) for i, parts in asked.items() for p in parts], "request long, partition_id int").repartition(5)
    assert {(x.request, x.target) for x in caches.history_targets(probes, 2, block).collect()} == expected


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_are_gapless_at_any_size(spark, adaptive):
    from pyspark.sql import functions as F

    was = {n: spark.conf.get(n) for n in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        n = 420_000
        rows = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("key"), F.repeat(F.lit("text "), 12).alias("text"), F.lit(1).alias("part"))
        found = workload.contiguous(rows, "key")
        r = found.select("idx").agg(F.count("*").alias("n"), F.max("idx").alias("top"), F.countDistinct("idx").alias("d")).first()
        assert (r.n, r.top, r.d) == (n, n - 1, n) and found.columns == ["key", "text", "part", "idx"]
        ends = found.where("idx in (0, 1, 419999)").orderBy("idx").select("key")
        keys = rows.select("key").orderBy("key")
        assert [x.key for x in ends.collect()][:2] == [x.key for x in keys.limit(2).collect()]
        part = workload.subset(rows, rows.limit(3).select("key"), 1000, key="key")
        r = part.agg(F.count("*").alias("n"), F.max("sub_idx").alias("top"), F.countDistinct("key").alias("d")).first()
        assert (r.n, r.top, r.d) == (1000, 999, 1000)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_workloads(spark):
    w = {r["rank"]: r.weight for r in workload.zipf_weights(spark, 4, 1.0).collect()}
    assert sum(w.values()) == pytest.approx(1) and w[1] / w[4] == pytest.approx(4)
    with pytest.raises(ValueError):
        workload.zipf_weights(spark, 4, 0)
    n = sorted((r["count"] for r in workload.zipf(spark, 5000, 50, 1.2).groupBy("qidx").count().collect()), reverse=True)
    assert sum(n) == 5000 and n[0] > 5 * n[len(n) // 2]
    assert workload.uniform(spark, 300, 7).agg({"qidx": "max"}).first()[0] <= 6


def test_preparation(spark):
    docs = spark.createDataFrame([(f"d{i}", i * 3) for i in range(50)], "doc_key string, doc_id long").repartition(4)
    assert {r.doc_id: r.idx for r in workload.contiguous(docs, "doc_id").collect()} == {i * 3: i for i in range(50)}
    q = workload.numbered_queries(spark.createDataFrame([("10", "x"), ("9", "y"), ("2", "z")], "query_id string, text string"))
    assert [r.query_id for r in q.orderBy("qidx").collect()] == ["2", "9", "10"]
    judged = spark.createDataFrame([("9", "d1", 1), ("9", "nope", 1), ("77", "d1", 2)], "query_id string, doc_key string, score int")
    kept, dropped = workload.remapped_qrels(judged, q, workload.contiguous(docs, "doc_id"))
    assert [(r.qidx, r.idx) for r in kept.collect()] == [(1, 1)] and dropped.first().dropped == 2
    need = docs.where("doc_id in (0, 147)").select("doc_id")
    part = workload.subset(docs, need, 10).collect()
    assert len(part) == 10 and {0, 147} <= {r.doc_id for r in part} and sorted(r.sub_idx for r in part) == list(range(10))
    with pytest.raises(ValueError):
        workload.subset(docs, need, 1)


def test_capacity(spark):
    rows = [(s, i >= bad, float(i), 2.0) for s, bad in ((1, 0), (2, 0), (3, 5), (4, 0)) for i in range(10)]
    steps = workload.load_steps(spark.createDataFrame(rows, "step int, ok boolean, latency double, seconds double"), 100.0)
    assert {r.step: r.passes for r in steps.collect()} == {1: True, 2: True, 3: False, 4: True}
    assert workload.sustainable(steps).first().step == 2
    use = spark.createDataFrame([(1, 5, 10.0, 100), (2, 9, 30.0, 160)], "ts int, rss long, cpu double, read_sectors long")
    r = workload.resource_use(use).first()
    assert (r.peak_rss, r.mean_cpu, r.read_bytes) == (9, 20.0, 60 * 512)
