"""Registered queries of the retrieval operators, each with its DuckDB SQL.

Searches ask for every row whose id is divisible by 50, against all rows: vectors of
`embeddings`, and the texts of `benchmark` (all of them) against `documents`. Scores are
rounded to six places, since sums over shuffled rows differ in the last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import caches, dense, fusion, graph, ivf, metrics, quantize, rerank, sparse, workload
from ..session import stored
from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- inputs ----


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).where("doc_id % 50 = 0").withColumnRenamed("doc_id", "qid")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", "text")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _label_centroids(spark: SparkSession, d: str) -> DataFrame:
    """The normalised mean vector of each label: deterministic stand-ins for trained centroids."""
    parts = _table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    listed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("l"))
    return ivf.fixed(listed.select(F.col("label").alias("partition_id"), V.normalised(F.col("l.m")).alias("centroid")))


def _hits(h: DataFrame) -> DataFrame:
    return h.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank", "source")


def _trace(spark: SparkSession, d: str) -> DataFrame:
    """The events as requests: seq by time, worker by user, the text and vector asked for."""
    e = _table(spark, d, "events")
    return workload.contiguous(e.select("ts", "event_id", "user_id", "props", "event_type"), "ts", "event_id", name="seq").withColumn("worker", F.pmod("user_id", F.lit(8)))


# ---- SQL that several oracles share ----

_KNN = """q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
e AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, label FROM embeddings)"""
_TOP = "row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id)"


def _top_sql(scored: str, source: str, k: int = 10, name: str = "hits") -> str:
    return f"{name} AS (SELECT * FROM (SELECT qid, doc_id, score, {_TOP} AS rank, '{source}' AS source FROM ({scored})) WHERE rank <= {k})"


_OUT = "SELECT qid, doc_id, round(score, 6) AS score, rank, source FROM hits"
_DOT = "SELECT qid, doc_id, list_dot_product(q.v, e.v) AS score FROM q, e"
_BM25 = """tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
posts AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2),
len AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM st) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS r FROM posts GROUP BY 1),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25::DOUBLE * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY 1, 2),
bm AS (SELECT qid, p.doc_id, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM qt JOIN posts p USING (term) JOIN idf USING (term) JOIN len ON len.doc_id = p.doc_id, st GROUP BY 1, 2)"""
_CENTROIDS = """means AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, len(embedding) + 1) t(i) GROUP BY 1, 2),
mv AS (SELECT label, list(m ORDER BY i) AS m FROM means GROUP BY 1),
c AS (SELECT label AS partition_id, list_transform(m, lambda x: x / (sqrt(list_dot_product(m, m)) + 1e-8)) AS cv FROM mv)"""
_ROUTES = "routes AS (SELECT qid, partition_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, partition_id) AS place FROM (SELECT qid, partition_id, list_dot_product(q.v, cv) AS score FROM q, c))"
_ASSIGNED = "a AS (SELECT doc_id, partition_id FROM (SELECT doc_id, partition_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(list_dot_product(e.v, cv), 9) DESC, partition_id) AS place FROM e, c) WHERE place <= 2)"
_SPARSE = _top_sql("SELECT * FROM bm", "bm25", 100, "sp")
_QRELS = "qrels AS (SELECT qid, doc_id, greatest(quality * 2 - toxic, 0) AS grade FROM sp JOIN labels USING (doc_id))"
_EVENTS = "tr AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, user_id, props, event_type, user_id % 8 AS worker FROM events)"


# ---- expressions ----


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_distinct FROM documents")
def p1_tokenise(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query("SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS key_md5 FROM documents")
def p2_query_key(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.query_key(F.col("text"))).alias("key_md5"))


@query("SELECT doc_id, md5(trim(source || ' ' || text)) AS passage_md5, md5(text) AS bare_md5, md5(substr(text, 1, 1024)) AS cut_md5 FROM documents")
def p3_passages(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return docs.select("doc_id", F.md5(T.passage(F.col("source"), F.col("text"))).alias("passage_md5"), F.md5(T.passage_to_embed(F.lit(""), F.col("text"))).alias("bare_md5"), F.md5(T.cut_for_rerank(F.col("text"))).alias("cut_md5"))


@query(f"WITH {_KNN} SELECT doc_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_sum(list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-8))), 6) AS sum_normalised FROM e")
def p8_normalise(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vector")
    return _vectors(spark, d).select("doc_id", F.round(V.norm(v), 6).alias("norm"), F.round(F.aggregate(V.normalised(v), F.lit(0.0), lambda a, x: a + x), 6).alias("sum_normalised"))


_SQ8 = "codes AS (SELECT doc_id, v, list_min(v) AS low, greatest(list_max(v) - list_min(v), 1e-8) AS span FROM e), sq AS (SELECT doc_id, v, low, span, list_transform(v, lambda x: round_even((x - low) / span * 255, 0)::INT) AS code FROM codes)"


@query(f"WITH {_KNN}, {_SQ8} SELECT doc_id, array_to_string(code, ',') AS code, round(low, 6) AS low, round(span, 6) AS span FROM sq")
def p9_sq8_encode(spark: SparkSession, d: str) -> DataFrame:
    c = quantize.sq8(_vectors(spark, d))
    return c.select("doc_id", F.array_join(F.transform(F.col("code.codes"), lambda x: x.cast("string")), ",").alias("code"), F.round("code.low", 6).alias("low"), F.round("code.span", 6).alias("span"))


@query(f"WITH {_KNN} SELECT doc_id, array_to_string(list_transform(v, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '') AS bits FROM e")
def p11_binary_encode(spark: SparkSession, d: str) -> DataFrame:
    words = F.transform(V.bit_words(F.col("vector")), lambda w: F.lpad(F.bin(w), 64, "0"))
    return _vectors(spark, d).select("doc_id", F.substring(F.array_join(words, ""), F.lit(1), F.size("vector")).alias("bits"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def p15_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("hash"))


@query("WITH w AS (SELECT s, r, pow(r::DOUBLE, -s) AS w FROM (VALUES (0.8::DOUBLE), (1.0::DOUBLE), (1.2::DOUBLE)) t(s), range(1, 201) u(r)) SELECT s, r AS rank, round(w / sum(w) OVER (PARTITION BY s), 9) AS weight FROM w")
def p18_zipf_weights(spark: SparkSession, d: str) -> DataFrame:
    parts = [workload.zipf_weights(spark, 200, s).select(F.lit(s).alias("s"), "rank", F.round("weight", 9).alias("weight")) for s in workload.ZIPF]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT label, floor(count(*) * 64 * 4 * 1.5)::BIGINT + 1048576 AS bytes FROM embeddings GROUP BY 1")
def p21_partition_bytes(spark: SparkSession, d: str) -> DataFrame:
    g = _table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"))
    return g.select("label", V.partition_bytes(F.col("n"), F.col("dim")).alias("bytes"))


# ---- dense retrieval ----


@query(f"WITH {_KNN}, {_top_sql(_DOT, 'dense')} {_OUT}")
def r1_flat_knn(spark: SparkSession, d: str) -> DataFrame:
    return _hits(dense.flat_knn(_vectors(spark, d), _asked(spark, d)))


@query(f"WITH {_KNN}, {_top_sql('SELECT qid, doc_id, -list_sum(list_transform(list_zip(q.v, e.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS score FROM q, e', 'dense')} {_OUT}")
def r1_flat_knn_l2(spark: SparkSession, d: str) -> DataFrame:
    return _hits(dense.flat_knn(_vectors(spark, d), _asked(spark, d), metric="l2"))


@query()
def r2_ann_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Approximate search over k-means partitions (stands in for a graph index); tested for recall."""
    c, q = _vectors(spark, d), _asked(spark, d)
    centroids = ivf.kmeans_centroids(c)
    return _hits(ivf.search(ivf.assign(c, centroids, 2), q, ivf.route(q, centroids, 8)))


@query(f"WITH {_KNN}, {_CENTROIDS}, {_ROUTES}, {_ASSIGNED}, {_top_sql('SELECT DISTINCT qid, doc_id, list_dot_product(q.v, e.v) AS score FROM routes JOIN a USING (partition_id) JOIN e USING (doc_id) JOIN q USING (qid) WHERE place <= 3', 'dense')} {_OUT}")
def r3_partitioned_knn(spark: SparkSession, d: str) -> DataFrame:
    c, q, cents = _vectors(spark, d), _asked(spark, d), _label_centroids(spark, d)
    return _hits(ivf.search(ivf.assign(c, cents, 2), q, ivf.route(q, cents, 3)))


@query(f"WITH {_KNN}, {_CENTROIDS}, {_ROUTES} SELECT qid, partition_id, round(score, 6) AS score, place FROM routes WHERE place <= 4")
def r4_route_fixed(spark: SparkSession, d: str) -> DataFrame:
    return ivf.route(_asked(spark, d), _label_centroids(spark, d), 4).select("qid", "partition_id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query(f"""WITH {_KNN}, {_CENTROIDS}, {_ROUTES},
g AS (SELECT *, lag(score) OVER (PARTITION BY qid ORDER BY place) - score AS gap FROM routes WHERE place <= 8),
s AS (SELECT *, min(CASE WHEN place >= 2 AND gap > 0.1::DOUBLE THEN place END) OVER (PARTITION BY qid) AS stop FROM g)
SELECT qid, partition_id, round(score, 6) AS score, place FROM s WHERE stop IS NULL OR place <= stop""")
def r4_route_adaptive(spark: SparkSession, d: str) -> DataFrame:
    return ivf.route(_asked(spark, d), _label_centroids(spark, d), 8, 0.1).select("qid", "partition_id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query(f"WITH {_KNN}, {_CENTROIDS}, {_ASSIGNED} SELECT min(n) AS least, median(n)::DOUBLE AS median, max(n) AS most FROM (SELECT count(*) AS n FROM a GROUP BY partition_id)")
def a7_partition_sizes(spark: SparkSession, d: str) -> DataFrame:
    return ivf.sizes(ivf.assign(_vectors(spark, d), _label_centroids(spark, d), 2))


@query(f"WITH {_KNN}, {_SQ8}, {_top_sql('SELECT qid, doc_id, list_dot_product(q.v, list_transform(code, lambda c: c / 255::DOUBLE * span + low)) AS score FROM q, sq', 'dense')} {_OUT}")
def r7_sq8_knn(spark: SparkSession, d: str) -> DataFrame:
    return _hits(quantize.sq8_knn(quantize.sq8(_vectors(spark, d)), _asked(spark, d)))


_HAMMING = "SELECT qid, doc_id, -list_sum(list_transform(list_zip(q.v, e.v), lambda p: CASE WHEN (p[1] >= 0) <> (p[2] >= 0) THEN 1 ELSE 0 END))::DOUBLE AS score FROM q, e"


@query(f"WITH {_KNN}, {_top_sql(_HAMMING, 'dense')} {_OUT}")
def r8_hamming_knn(spark: SparkSession, d: str) -> DataFrame:
    return _hits(quantize.hamming_knn(quantize.binary(_vectors(spark, d)), _asked(spark, d)))


@query()
def r2_graph_knn(spark: SparkSession, d: str) -> DataFrame:
    """Approximate search on neighbour graphs; tested for recall."""
    return _hits(graph.search(stored(graph.build(_vectors(spark, d))), _asked(spark, d)))


@query()
def r9_product_codes_knn(spark: SparkSession, d: str) -> DataFrame:
    """The hundred best by product codes, rescored; tested for recall, and the codes against brute force over the decoded vectors."""
    c, q = _vectors(spark, d), _asked(spark, d)
    codes = quantize.ProductCodes.train(c, m=16, bits=8)
    return _hits(dense.rescore(codes.knn(codes.encode(c), q, 100), c, q, 100))


@query(f"WITH {_KNN}, {_top_sql(_HAMMING, 'dense', 50, 'coarse')}, {_top_sql('SELECT qid, doc_id, list_dot_product(q.v, e.v) AS score FROM coarse JOIN q USING (qid) JOIN e USING (doc_id)', 'dense')} {_OUT}")
def r10_rescore(spark: SparkSession, d: str) -> DataFrame:
    c, q = _vectors(spark, d), _asked(spark, d)
    return _hits(dense.rescore(quantize.hamming_knn(quantize.binary(c), q, 50), c, q, 50))


@query(f"""WITH {_KNN}, {_SQ8}, {_top_sql(_DOT, 'dense', 10, 'one')},
{_top_sql('SELECT qid, doc_id, list_dot_product(q.v, list_transform(code, lambda c: c / 255::DOUBLE * span + low)) AS score FROM q, sq', 'dense', 10, 'two')},
{_top_sql('SELECT qid, doc_id, max(score) AS score FROM (SELECT qid, doc_id, score FROM one UNION ALL SELECT qid, doc_id, score FROM two) GROUP BY 1, 2', 'dense')} {_OUT}""")
def r5_merge(spark: SparkSession, d: str) -> DataFrame:
    c, q = _vectors(spark, d), _asked(spark, d)
    return _hits(dense.merge(dense.flat_knn(c, q), quantize.sq8_knn(quantize.sq8(c), q)))


# ---- lexical retrieval, fusion, reranking ----


@query(f"WITH {_BM25} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM raw) AS n_terms, (SELECT sum(df) FROM raw)::BIGINT AS n_postings FROM st")
def a5_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    terms = sparse.document_frequencies(sparse.counted(docs)).agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))
    return sparse.corpus_stats(docs).crossJoin(terms).select("n", F.round("avgdl", 6).alias("avgdl"), "n_terms", "n_postings")


@query(f"WITH {_BM25}, {_top_sql('SELECT * FROM bm', 'bm25')} {_OUT}")
def r6_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _hits(sparse.bm25(_docs(spark, d), _texts(spark, d)))


_BOTH = f"""{_KNN}, {_BM25}, {_SPARSE},
dq AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
{_top_sql('SELECT qid, doc_id, list_dot_product(dq.v, e.v) AS score FROM dq, e', 'dense', 100, 'de')}"""


def _pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Dense and lexical lists of 100 for the queries of benchmark; query i has vector i (a made-up pairing)."""
    texts = _texts(spark, d)
    q = _vectors(spark, d).withColumnRenamed("doc_id", "qid").join(texts.select("qid"), "qid", "left_semi")
    return dense.flat_knn(_vectors(spark, d), q, 100), sparse.bm25(_docs(spark, d), texts, 100)


_RRF = """f AS (SELECT qid, doc_id, sum(1::DOUBLE / (60 + rank)) AS score, min(CASE WHEN l = 0 THEN rank END) AS r0, min(CASE WHEN l = 1 THEN rank END) AS r1
  FROM (SELECT 0 AS l, qid, doc_id, rank FROM de UNION ALL SELECT 1, qid, doc_id, rank FROM sp) GROUP BY 1, 2),
fused AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, r0 NULLS LAST, r1 NULLS LAST, doc_id) AS rank, 'fused' AS source FROM f))"""


@query(f"WITH {_BOTH}, {_RRF} SELECT qid, doc_id, round(score, 6) AS score, rank, source FROM fused WHERE rank <= 10")
def r11_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _hits(fusion.rrf(*_pair(spark, d)))


_MINMAX = "SELECT qid, doc_id, (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END AS s FROM {} WINDOW w AS (PARTITION BY qid)"


@query(f"WITH {_BOTH}, {_top_sql('SELECT qid, doc_id, sum(0.5::DOUBLE * s) AS score FROM (' + _MINMAX.format('de') + ' UNION ALL ' + _MINMAX.format('sp') + ') GROUP BY 1, 2', 'fused')} {_OUT}")
def r12_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _hits(fusion.weighted(*_pair(spark, d)))


@query(f"WITH {_BM25}, {_SPARSE}, n AS ({_MINMAX.format('sp')}) SELECT qid, doc_id, round(s, 6) AS score FROM n")
def p23_min_max(spark: SparkSession, d: str) -> DataFrame:
    return fusion.min_max(sparse.bm25(_docs(spark, d), _texts(spark, d), 100)).select("qid", "doc_id", F.round("score", 6).alias("score"))


_OVERLAP = "len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(substr(t.text, 1, 1024)), '[a-z0-9]+')))) / greatest(len(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+'))), 1)::DOUBLE"


@query(f"WITH {_BM25}, {_SPARSE}, r AS (SELECT qid, sp.doc_id, {_OVERLAP} AS score, rank AS was FROM sp JOIN benchmark b ON item_id = qid JOIN documents t ON t.doc_id = sp.doc_id WHERE rank <= 50) SELECT * FROM (SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, was) AS rank, 'reranked' AS source FROM r) WHERE rank <= 10")
def r13_rerank(spark: SparkSession, d: str) -> DataFrame:
    texts, docs = _texts(spark, d), _docs(spark, d)
    return _hits(rerank.rerank(sparse.bm25(docs, texts, 100), texts, docs))


@query(f"WITH {_BOTH}, {_RRF}, r AS (SELECT qid, fused.doc_id, {_OVERLAP.replace('substr(t.text', 'substr(coalesce(t.text, {0})'.format(chr(39) * 2))} AS score, rank AS was FROM fused JOIN benchmark b ON item_id = qid LEFT JOIN documents t ON t.doc_id = fused.doc_id WHERE rank <= 50) SELECT * FROM (SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, was) AS rank, 'reranked' AS source FROM r) WHERE rank <= 10")
def r20_hybrid_pipeline(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d).withColumnRenamed("doc_id", "qid")
    asked = _texts(spark, d).join(vectors, "qid")
    config = {"name": "hybrid", "dense": {"index": "flat"}, "sparse": {"b": 0.75}, "fusion": {"type": "rrf"}, "rescoring": "none", "rerank": {"depth": 50}, "cache": {"exact": True}}
    return _hits(pipeline.Pipeline(config, _vectors(spark, d), _docs(spark, d)).search(asked))


# ---- metrics ----


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lexical hits, searched once and written, and grades from labels for those that have any."""
    hits = stored(sparse.bm25(_docs(spark, d), _texts(spark, d), 100))
    grades = _table(spark, d, "labels").select("doc_id", F.greatest(F.col("quality") * 2 - F.col("toxic"), F.lit(0)).alias("grade"))
    return hits, stored(hits.join(grades, "doc_id").select("qid", "doc_id", "grade"))


@query(f"""WITH {_KNN}, {_top_sql(_DOT, 'dense', 10, 'truth')}, {_top_sql(_HAMMING, 'dense', 10, 'got')}
SELECT qid, (SELECT count(*) FROM got g JOIN truth t2 USING (qid, doc_id) WHERE g.qid = q.qid) / 10::DOUBLE AS recall FROM q""")
def a8_ann_recall(spark: SparkSession, d: str) -> DataFrame:
    c, q = _vectors(spark, d), _asked(spark, d)
    return metrics.ann_recall(quantize.hamming_knn(quantize.binary(c), q), dense.flat_knn(c, q), 10).withColumnRenamed("value", "recall")


@query(f"""WITH {_BM25}, {_SPARSE}, {_QRELS}, j AS (SELECT DISTINCT qid FROM qrels), h AS (SELECT sp.qid, sp.doc_id, rank, grade FROM sp JOIN qrels USING (qid, doc_id)),
i AS (SELECT qid, sum((pow(2, grade) - 1) / log2(place + 1)) AS idcg FROM (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc_id) AS place FROM qrels) WHERE place <= 10 GROUP BY 1),
m AS (SELECT qid, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) / 10::DOUBLE AS precision, coalesce(1::DOUBLE / min(CASE WHEN rank <= 10 THEN rank END), 0) AS mrr, sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rank <= 50 THEN 1 ELSE 0 END) / count(*)::DOUBLE AS recall FROM h GROUP BY 1)
SELECT qid, round(precision, 6) AS precision, round(mrr, 6) AS mrr, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg, round(recall, 6) AS recall FROM m JOIN i USING (qid)""")
def a9_retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    hits, qrels = _judged(spark, d)
    out = metrics.evaluate(hits, qrels, 10, 50)
    return out.select("qid", *(F.round(c, 6).alias(c) for c in ("precision", "mrr", "ndcg", "recall")))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def a13_latency(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.latency(_table(spark, d, "events"), "event_type")
    return out.select("event_type", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "mean")))


@query(f"WITH {_BM25}, {_SPARSE}, {_QRELS}, h AS (SELECT qid, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) / 10::DOUBLE AS v FROM sp JOIN qrels USING (qid, doc_id) GROUP BY 1), w AS (SELECT user_id % 40 AS qid FROM events) SELECT round(avg(v), 6) AS precision FROM w JOIN h USING (qid)")
def a14_mean_over_workload(spark: SparkSession, d: str) -> DataFrame:
    hits, qrels = _judged(spark, d)
    w = _table(spark, d, "events").select(F.pmod("user_id", F.lit(40)).alias("qid"))
    return metrics.over_workload(w, metrics.precision(hits, qrels, 10)).select(F.round("value", 6).alias("precision"))


# ---- caches and workloads ----


@query(f"WITH {_EVENTS}, h AS (SELECT worker, row_number() OVER (PARTITION BY props ORDER BY seq) > 1 AS hit FROM tr) SELECT worker, sum(hit::INT)::BIGINT AS hits, sum(1 - hit::INT)::BIGINT AS misses, round(avg(hit::INT), 6) AS hit_rate FROM h GROUP BY 1")
def r14_exact_cache_unbounded(spark: SparkSession, d: str) -> DataFrame:
    out = caches.hit_rate(caches.unbounded_hits(_trace(spark, d), T.query_key(F.col("props"))), "worker")
    return out.select("worker", "hits", "misses", F.round("hit_rate", 6).alias("hit_rate"))


@query(f"""WITH {_EVENTS}, u AS (SELECT worker, seq, props, max(seq) OVER (PARTITION BY worker, props ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM tr),
others AS (SELECT u.worker, u.seq, count(*) AS n FROM u JOIN u o ON o.worker = u.worker AND o.seq > u.was AND o.seq < u.seq AND (o.was IS NULL OR o.was <= u.was) GROUP BY 1, 2),
h AS (SELECT worker, was IS NOT NULL AND coalesce(n, 0) < 40 AS hit FROM u LEFT JOIN others USING (worker, seq))
SELECT worker, sum(hit::INT)::BIGINT AS hits, sum(1 - hit::INT)::BIGINT AS misses, avg(hit::INT) AS hit_rate FROM h GROUP BY 1""")
def t1_exact_cache_replay(spark: SparkSession, d: str) -> DataFrame:
    return caches.hit_rate(caches.replay_exact(_trace(spark, d).withColumn("text", F.col("props")), size=40), "worker")


_STEPS_OF = "r AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY seq) AS step FROM tr)"


@query(f"""WITH RECURSIVE {_KNN}, {_EVENTS}, {_STEPS_OF},
near AS MATERIALIZED (SELECT x.doc_id AS user_id, list(y.doc_id) AS ids FROM e x JOIN e y ON list_dot_product(x.v::FLOAT[], y.v::FLOAT[]) >= 0.95 GROUP BY 1),
w AS MATERIALIZED (SELECT worker, step, user_id, ids FROM r LEFT JOIN near USING (user_id)),
s AS (SELECT DISTINCT worker, 0::BIGINT AS step, 0::BIGINT AS hits, 0::BIGINT AS misses, []::BIGINT[] AS kept FROM r
  UNION ALL SELECT s.worker, w.step, hits + hit::INT, misses + 1 - hit::INT, CASE WHEN hit OR ids IS NULL THEN kept ELSE list_append(kept, user_id)[-100:] END
  FROM s JOIN (SELECT * FROM w) w ON w.worker = s.worker AND w.step = s.step + 1, LATERAL (SELECT ids IS NOT NULL AND list_has_any(kept, ids) AS hit) h)
SELECT worker, hits, misses, hits / (hits + misses)::DOUBLE AS hit_rate FROM s QUALIFY row_number() OVER (PARTITION BY worker ORDER BY step DESC) = 1""")
def r15_semantic_cache_replay(spark: SparkSession, d: str) -> DataFrame:
    v = _table(spark, d, "embeddings").select(F.col("vec_id").alias("user_id"), F.col("embedding").alias("vector"))
    return caches.hit_rate(caches.replay_semantic(_trace(spark, d).join(v, "user_id", "left"), size=100, threshold=0.95), "worker")


@query(f"""WITH RECURSIVE {_EVENTS}, {_STEPS_OF},
sz AS (SELECT user_id % 64 AS p, count(*) * 1000 AS bytes FROM events GROUP BY 1),
w AS MATERIALIZED (SELECT worker, step, user_id % 64 AS p, bytes FROM r JOIN sz ON sz.p = user_id % 64),
s AS (SELECT DISTINCT worker, policy, 0::BIGINT AS step, 0::BIGINT AS hits, 0::BIGINT AS evictions, []::STRUCT(a DOUBLE, b BIGINT, p BIGINT, uses BIGINT, last BIGINT, born BIGINT, bytes BIGINT)[] AS kept FROM r, (VALUES ('lru'), ('lfu'), ('cost')) t(policy)
  UNION ALL SELECT s.worker, policy, w.step, hits + hit::INT, evictions + gone,
    list_sort(list_transform(list_append(list_filter(ordered, lambda x, i: i > gone AND x.p <> w.p), {{'a': 0::DOUBLE, 'b': 0::BIGINT, 'p': w.p, 'uses': was.uses + 1, 'last': w.step, 'born': was.born, 'bytes': w.bytes}}),
      lambda x: {{'a': CASE policy WHEN 'lru' THEN x.last WHEN 'lfu' THEN x.uses ELSE x.uses / greatest(x.bytes, 1)::DOUBLE END, 'b': CASE policy WHEN 'cost' THEN x.born WHEN 'lfu' THEN x.last ELSE 0 END, 'p': x.p, 'uses': x.uses, 'last': x.last, 'born': x.born, 'bytes': x.bytes}}))
  FROM s JOIN (SELECT * FROM w) w ON w.worker = s.worker AND w.step = s.step + 1,
    LATERAL (SELECT kept AS ordered, coalesce(list_filter(kept, lambda x: x.p = w.p)[1].uses, 0) AS uses, coalesce(list_filter(kept, lambda x: x.p = w.p)[1].born, w.step) AS born) was,
    LATERAL (SELECT was.uses > 0 AS hit) h,
    LATERAL (SELECT CASE WHEN hit THEN 0 ELSE coalesce(list_min(list_filter(range(0, len(kept) + 1), lambda i: coalesce(list_sum(list_transform(kept[i + 1:], lambda x: x.bytes)), 0) + w.bytes <= 600000)), len(kept)) END AS gone) g)
SELECT worker, hits, evictions, policy FROM s QUALIFY row_number() OVER (PARTITION BY worker, policy ORDER BY step DESC) = 1""")
def r16_partition_cache_replay(spark: SparkSession, d: str) -> DataFrame:
    sizes = _table(spark, d, "events").groupBy(F.pmod("user_id", F.lit(64)).alias("partition_id")).agg((F.count("*") * 1000).alias("bytes"))
    trace = _trace(spark, d).withColumn("partition_id", F.pmod("user_id", F.lit(64))).join(sizes, "partition_id")
    parts = [caches.replay_partitions(trace, 600_000, p).groupBy("worker").agg(F.count_if("hit").alias("hits"), F.sum("evictions").alias("evictions")).withColumn("policy", F.lit(p)) for p in ("lru", "lfu", "cost")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {_KNN}, {_CENTROIDS}, {_ROUTES}, p AS (SELECT qid AS request, partition_id FROM routes WHERE place <= 3) SELECT x.partition_id AS a, y.partition_id AS b, count(*) AS n FROM p x JOIN p y USING (request) WHERE x.partition_id <> y.partition_id GROUP BY 1, 2")
def r18_co_access(spark: SparkSession, d: str) -> DataFrame:
    return caches.co_access(ivf.route(_asked(spark, d), _label_centroids(spark, d), 3).select(F.col("qid").alias("request"), "partition_id"))


@query(f"WITH {_KNN}, {_CENTROIDS}, s AS (SELECT x.partition_id, y.partition_id AS related, list_dot_product(x.cv, y.cv) AS score FROM c x, c y WHERE x.partition_id <> y.partition_id) SELECT * FROM (SELECT partition_id, related, round(score, 6) AS score, row_number() OVER (PARTITION BY partition_id ORDER BY round(score, 9) DESC, related) AS place FROM s) WHERE place <= 2")
def r18_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return caches.neighbours(_label_centroids(spark, d)).select("partition_id", "related", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query(f"""WITH {_KNN}, {_CENTROIDS}, {_ROUTES}, p AS (SELECT qid AS request, partition_id AS a FROM routes WHERE place <= 3),
pairs AS (SELECT x.request, x.a, y.a AS b FROM p x JOIN p y USING (request) WHERE x.a <> y.a),
so_far AS (SELECT p.request, p.a, b, count(*) AS n FROM p JOIN pairs q ON q.a = p.a AND q.request <= p.request GROUP BY 1, 2, 3),
hist AS (SELECT request, b AS target FROM so_far QUALIFY row_number() OVER (PARTITION BY request, a ORDER BY n DESC, b) <= 2),
s AS (SELECT x.partition_id AS a, y.partition_id AS b, list_dot_product(x.cv, y.cv) AS score FROM c x, c y WHERE x.partition_id <> y.partition_id),
nb AS (SELECT a, b FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(score, 9) DESC, b) <= 2)
SELECT request, target FROM (SELECT request, target FROM hist UNION SELECT request, b FROM p JOIN nb USING (a)) ANTI JOIN p ON p.request = request AND p.a = target""".replace("ANTI JOIN p ON p.request = request AND p.a = target", "t WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.request = t.request AND p.a = t.target)"))
def r18_prefetch_targets(spark: SparkSession, d: str) -> DataFrame:
    cents = _label_centroids(spark, d)
    return caches.prefetch_targets(ivf.route(_asked(spark, d), cents, 3).select(F.col("qid").alias("request"), "partition_id"), cents)


@query("""WITH pool AS (SELECT count(*) AS n FROM benchmark), k AS (SELECT range AS q FROM range(0, (SELECT n FROM pool))),
o AS (SELECT q AS qidx, row_number() OVER (ORDER BY md5('42:' || q), q) AS r FROM k),
w AS (SELECT qidx, r, sum(1 / r::DOUBLE) OVER (ORDER BY r) / (SELECT sum(1 / r::DOUBLE) FROM o) AS until, r = (SELECT n FROM pool) AS last FROM o),
u AS (SELECT ('0x' || substr(md5('43:' || range), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS u FROM range(0, 10000)),
d AS (SELECT (SELECT min(r) FROM w WHERE u.u < until OR last) AS r FROM u)
SELECT qidx::INT AS qidx, count(*) AS requests FROM d JOIN w USING (r) GROUP BY 1""")
def t5_zipf_workload(spark: SparkSession, d: str) -> DataFrame:
    pool = _table(spark, d, "benchmark").count()
    return workload.zipf(spark, 10_000, pool, 1.0).groupBy("qidx").agg(F.count("*").alias("requests"))


@query("SELECT event_id, user_id % 40 AS qidx FROM events")
def p19_wrapped(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select("event_id", workload.wrapped(F.col("user_id"), 40).alias("qidx"))


@query(f"WITH {_KNN}, {_top_sql(_DOT, 'dense', 20)} SELECT qid, hits.doc_id // 2 AS doc_id, round(score, 6) AS score, rank FROM hits WHERE hits.doc_id < 300")
def f6_remapped_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits with local numbers, renamed by a table that ends before some of them."""
    ids = spark.range(300).select(F.col("id").alias("local"), F.floor(F.col("id") / 2).cast("long").alias("doc_id"))
    hits = workload.remapped_hits(dense.flat_knn(_vectors(spark, d), _asked(spark, d), 20), ids)
    return hits.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id, lang FROM documents")
def k1_numbered_corpus(spark: SparkSession, d: str) -> DataFrame:
    return workload.contiguous(_table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("idx", "doc_id", "lang")


@query("SELECT row_number() OVER (ORDER BY length(item_id::VARCHAR), item_id::VARCHAR) - 1 AS qidx, item_id::VARCHAR AS query_id FROM benchmark")
def w11_numbered_queries(spark: SparkSession, d: str) -> DataFrame:
    q = _table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    return workload.numbered_queries(q).select(F.col("qidx").cast("long").alias("qidx"), "query_id")


@query("WITH q AS (SELECT item_id::VARCHAR AS query_id, row_number() OVER (ORDER BY length(item_id::VARCHAR), item_id::VARCHAR) - 1 AS qidx FROM benchmark), l AS (SELECT (doc_id % 60)::VARCHAR AS query_id, doc_id, quality FROM labels) SELECT qidx, query_id, doc_id, quality AS score FROM l JOIN q USING (query_id)")
def j10_remapped_qrels(spark: SparkSession, d: str) -> DataFrame:
    q = workload.numbered_queries(_table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text"))
    qrels = _table(spark, d, "labels").select((F.col("doc_id") % 60).cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("doc_key"), F.col("quality").alias("score"))
    docs = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), F.col("doc_id").alias("idx"))
    kept, _ = workload.remapped_qrels(qrels, q, docs)
    return kept.select(F.col("qidx").cast("long").alias("qidx"), "query_id", F.col("idx").alias("doc_id"), F.col("score").cast("int").alias("score"))


@query("""WITH need AS (SELECT DISTINCT doc_id FROM labels JOIN documents USING (doc_id) WHERE toxic = 1),
rest AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) AS place FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
kept AS (SELECT doc_id FROM need UNION ALL SELECT doc_id FROM rest WHERE place <= (SELECT count(*) // 2 FROM documents) - (SELECT count(DISTINCT doc_id) FROM labels WHERE toxic = 1))
SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS sub_idx FROM kept JOIN documents USING (doc_id)""")
def u1_subset(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", "lang")
    needed = _table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return workload.subset(docs, needed, docs.count() // 2)


_STEPS = "st AS (SELECT (event_id // 1000) AS step, count(*) AS requests, sum((event_type <> 'error')::INT) / 60::DOUBLE AS qps, coalesce(quantile_cont(CASE WHEN event_type <> 'error' THEN value END, 0.99), 0) AS p99, avg((event_type = 'error')::INT) AS error_rate FROM events GROUP BY 1)"


def _load(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    return e.select(F.floor(F.col("event_id") / 1000).alias("step"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency"), F.lit(60.0).alias("seconds"))


@query(f"WITH {_STEPS} SELECT step, requests, round(qps, 6) AS qps, round(p99, 6) AS p99, round(error_rate, 6) AS error_rate, p99 <= 5000 AND error_rate <= 0.25 AS passes FROM st")
def a15_load_steps(spark: SparkSession, d: str) -> DataFrame:
    out = workload.load_steps(_load(spark, d), 5000.0, 0.25)
    return out.select("step", "requests", *(F.round(c, 6).alias(c) for c in ("qps", "p99", "error_rate")), "passes")


@query(f"WITH {_STEPS}, p AS (SELECT step, requests, min((p99 <= 5000 AND error_rate <= 0.25)::INT) OVER (ORDER BY step) AS so_far FROM st) SELECT step, requests FROM p WHERE so_far = 1 ORDER BY step DESC LIMIT 1")
def a19_sustainable(spark: SparkSession, d: str) -> DataFrame:
    return workload.sustainable(workload.load_steps(_load(spark, d), 5000.0, 0.25)).select("step", "requests")


@query(f"""WITH {_BOTH} SELECT qid, count(*) FILTER (in_d) AS n_dense, count(*) FILTER (in_s) AS n_sparse, count(*) AS n_union, count(*) FILTER (in_d AND in_s) AS n_both, count(*) FILTER (in_d AND NOT in_s) AS n_dense_only
FROM (SELECT qid, doc_id, bool_or(l = 0) AS in_d, bool_or(l = 1) AS in_s FROM (SELECT 0 AS l, qid, doc_id FROM de UNION ALL SELECT 1, qid, doc_id FROM sp) GROUP BY 1, 2) GROUP BY 1""")
def o1_set_operations(spark: SparkSession, d: str) -> DataFrame:
    one, two = (stored(x.select("qid", "doc_id")) for x in _pair(spark, d))
    parts = {"n_dense": one, "n_sparse": two, "n_union": one.union(two).distinct(), "n_both": one.intersect(two), "n_dense_only": one.exceptAll(two)}
    out = one.union(two).select("qid").distinct()
    for name, p in parts.items():
        out = out.join(p.groupBy("qid").agg(F.count("*").alias(name)), "qid", "left")
    return out.select("qid", *(F.coalesce(n, F.lit(0)).alias(n) for n in parts))
