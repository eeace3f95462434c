from __future__ import annotations

import gzip
import hashlib
import io
import json

import numpy as np
import pytest

from seekframe.sources import readers, writers


def test_jsonl_and_qrels(spark, tmp_path):
    (tmp_path / "corpus").mkdir()
    with gzip.open(tmp_path / "corpus" / "a.jsonl.gz", "wt") as f:
        f.write('{"_id": "x", "title": null, "text": "t"}\n\n{"id": "y", "title": "T"}\n')
    got = {r.doc_key: (r.title, r.text) for r in readers.read_jsonl(spark, str(tmp_path / "corpus")).where("doc_key is not null").collect()}
    assert got == {"x": ("", "t"), "y": ("T", "")}
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\n1\td1\t2\nbroken\n2\td2\t0\n")
    assert [(r.query_id, r.doc_key, r.score) for r in readers.read_qrels(spark, str(tmp_path / "q.tsv")).orderBy("query_id").collect()] == [("1", "d1", 2), ("2", "d2", 0)]
    (tmp_path / "queries.jsonl").write_text(json.dumps({"_id": "1"}))
    found = readers.discover(spark, str(tmp_path))
    assert len(found["queries"]) == 1 and found["corpus"][0].endswith("a.jsonl.gz")


def test_vectors_in_and_out(spark, tmp_path):
    m = np.random.default_rng(0).normal(size=(30, 8)).astype(np.float32)
    np.save(tmp_path / "v.npy", m)
    v = readers.read_npy(spark, str(tmp_path / "v.npy"))
    assert readers.valid_vectors(v, 8).count() == 30 and readers.valid_vectors(v, 7).count() == 0
    parts = writers.fbin_parts(v.drop("file").repartition(3)).orderBy("first_id").collect()
    out = io.BytesIO(writers.fbin_header(v) + b"".join(bytes(p.content) for p in parts)).getvalue()
    assert np.array_equal(writers.read_fbin(out), m)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "k string, n long")
    writers.write_corpus(df, str(tmp_path / "c"), "k")
    assert {r.k: r.idx for r in spark.read.parquet(str(tmp_path / "c")).collect()} == {"a": 0, "b": 1}
    p = writers.write_results(df, str(tmp_path / "r"), "01", "flat", "t")
    assert spark.read.json(p).count() == 2
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "f").write_bytes(b"abc")
    r = writers.manifest(spark, str(tmp_path / "m")).first()
    assert (r.bytes, r.sha256) == (3, hashlib.sha256(b"abc").hexdigest())


def test_embedding_takes_up_where_it_stopped(spark, tmp_path):
    from seekframe.sources.embedding import embed_resumable

    docs = spark.createDataFrame([(i, f"text {i}" if i % 7 else None) for i in range(25)], "doc_id long, text string")
    encode = lambda texts: np.array([[len(t), 1.0, 2.0] for t in texts])
    path = str(tmp_path / "e")
    embed_resumable(docs.where("doc_id < 12"), encode, 3, path, chunk=10)
    marked = lambda texts: np.array([[0.0, 0.0, 1.0] for _ in texts])
    got = {r.doc_id: list(r.vector) for r in embed_resumable(docs, marked, 3, path, chunk=10).collect()}
    assert len(got) == 25
    assert all(got[i][1] > 0 for i in range(10)) and all(got[i] == [0.0, 0.0, 1.0] for i in range(10, 25))


def test_ground_truth(spark, tmp_path):
    t = spark.createDataFrame([(1, 1, 5, 0.5)], "qid long, rank int, doc_id long, score double")
    assert writers.write_ground_truth(t, str(tmp_path / "t")).count() >= 1


def test_single_files(spark, tmp_path):
    m = np.random.default_rng(1).normal(size=(50, 4)).astype(np.float32)
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "doc_id long, vector array<float>").repartition(4)
    n = writers.write_npy(v, str(tmp_path / "v.npy"))
    assert np.array_equal(np.load(tmp_path / "v.npy"), m) and (tmp_path / "v.npy").stat().st_size == n
    writers.write_fbin(v, str(tmp_path / "v.fbin"))
    writers.write_fbin(v, str(tmp_path / "v.fbin"))
    assert np.array_equal(writers.read_fbin((tmp_path / "v.fbin").read_bytes()), m)

    def broken():
        yield b"some"
        raise RuntimeError

    with pytest.raises(RuntimeError):
        writers.write_file(spark, str(tmp_path / "x"), broken())
    assert not [p for p in tmp_path.iterdir() if p.name.lstrip(".").startswith("x")]


def test_queries_workloads_and_vector_stores(spark, tmp_path):
    queries = spark.createDataFrame([("10", "x"), ("9", "y")], "query_id string, text string")
    qrels = spark.createDataFrame([("9", "a", 1), ("9", "gone", 1), ("10", "a", 2)], "query_id string, doc_key string, score int")
    docs = spark.createDataFrame([("a", 0)], "doc_key string, idx long")
    r = writers.write_queries(queries, qrels, docs, str(tmp_path / "q")).first()
    assert (r.queries, r.qrels, r.judged, r.dropped) == (2, 2, 2, 1)
    assert [x.query_id for x in spark.read.parquet(str(tmp_path / "q/queries")).orderBy("qidx").collect()] == ["9", "10"]
    from seekframe.operators import workload

    found = writers.write_workload(workload.uniform(spark, 100, 7), str(tmp_path / "w"), "uniform", seed=42)
    assert found.count() >= 2 and json.loads((tmp_path / "w/uniform.json").read_text())["n_queries"] == 100
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "doc_id long, vector array<double>")
    writers.write_vectors(v, str(tmp_path / "s"))
    assert {x.doc_id: list(x.vector) for x in writers.vector_rows(spark, str(tmp_path / "s"), [3, 39, 99]).collect()} == {3: [3.0, 1.0], 39: [39.0, 1.0]}


def test_configurations(spark, tmp_path):
    from seekframe.plans import pipeline

    (tmp_path / "a.yaml").write_text("name: a\ndense: {index: flat}\nsparse: null\n")
    c = readers.read_config(spark, str(tmp_path / "a.yaml"))
    assert c == {"name": "a", "dense": {"index": "flat"}, "sparse": None}
    # Fixed value: of the lines dense:, index, name, sparse in this order.
    assert pipeline.config_hash(c) == pipeline.config_hash(dict(reversed(c.items()))) == hashlib.sha256(b"dense:\n  index: flat\nname: a\nsparse: null\n").hexdigest()[:16]
    (tmp_path / "b.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        readers.read_config(spark, str(tmp_path / "b.yaml"))


def test_system(spark):
    from seekframe.operators import workload
    from seekframe.sources import system

    r = workload.resource_use(system.samples(spark, 2, 0.01)).first()
    assert r.peak_rss > 1 << 20 and r.read_bytes >= 0
    pauses, answers = [], iter([True, True, True, False])
    assert system.wait_for_room(lambda: next(answers), sleep=pauses.append) == sum(pauses) and pauses == [1.0, 1.5, 2.25]
    assert isinstance(system.strained(), bool)
