"""A retrieval pipeline put together from a configuration: caches, retrievers, fusion, reranking.

Configuration (a mapping, as read from YAML or JSON; all parts but name are optional):

    name: hybrid
    dense: {index: flat | ivf | graph, metric: ip | l2, partitions, overlap, nprobe, adaptive_gap, m, ef}
    sparse: {k1, b, epsilon, fill_zero}
    fusion: {type: rrf | weighted, k, w_dense, w_sparse}
    rescoring: {candidates: 100}
    rerank: {depth: 50, max_length: 256}
    cache: {exact: true}
    candidate_k: 100

"none" stands for a part that is left out. One batch of queries (qid, text, vector) is one
plan; a query without a vector has no dense hits, one without text no sparse hits, and
fusion passes on whichever list there is.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_key
from ..operators import dense, fusion, graph, ivf, rerank, sparse
from ..session import stored

OFF = (None, False, "none", {})


def checked(config: dict) -> dict:
    if not isinstance(config, dict) or not config.get("name"):
        raise ValueError("a configuration is a mapping with a name")
    return {k: v for k, v in config.items() if v not in OFF}


def config_hash(config: dict) -> str:
    """First 16 hex digits of the SHA-256 of the configuration as YAML with sorted keys (JSON where there is no YAML library)."""
    try:
        import yaml
    except ImportError:
        text = json.dumps(config, sort_keys=True)
    else:
        text = yaml.safe_dump(config, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def required(queries: DataFrame, *columns: str) -> DataFrame:
    """queries, if every row has these; else ValueError. For calls of single queries, where leaving a row out would hide a mistake."""
    for c in columns:
        if queries.where(F.col(c).isNull()).limit(1).count():
            raise ValueError(f"a query has no {c}")
    return queries


def distinct_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(representatives, membership): with an exact cache every text is searched once; membership is (qid, rep). The cache looks at the text alone."""
    key = query_key(F.col("text"))
    rep = F.when(key == "", F.col("qid")).otherwise(F.min("qid").over(Window.partitionBy(key)))
    named = queries.withColumn("rep", rep)
    return named.where("qid = rep").drop("rep"), named.select("qid", "rep")


@dataclass
class Pipeline:
    config: dict
    corpus: DataFrame | None = None  # doc_id, vector
    passages: DataFrame | None = None  # doc_id, text
    centroids: DataFrame | None = None
    scorer: Callable = rerank.lexical_overlap
    graph: DataFrame | None = None  # shards of operators.graph

    def __post_init__(self) -> None:
        self.config = checked(self.config)

    def _dense(self, queries: DataFrame, k: int) -> DataFrame:
        c = self.config["dense"]
        metric = c.get("metric", "ip")
        if c.get("index", "flat") == "flat":
            return dense.flat_knn(self.corpus, queries, k, metric)
        if c["index"] == "graph":
            if self.graph is None:
                self.graph = stored(graph.build(self.corpus, c.get("m", graph.M), metric))
            return graph.search(self.graph, queries, k, c.get("ef", graph.EF), metric)
        if c["index"] != "ivf":
            raise ValueError(f"no such index: {c['index']}")
        if self.centroids is None:
            self.centroids = ivf.kmeans_centroids(self.corpus, c.get("partitions", 16))
        assigned = ivf.assign(self.corpus, self.centroids, c.get("overlap", 1), metric)
        return ivf.search(assigned, queries, ivf.route(queries, self.centroids, c.get("nprobe", 8), c.get("adaptive_gap"), metric), k, metric)

    def search(self, queries: DataFrame, k: int = 10, strict: bool = False) -> DataFrame:
        """Hits (qid, doc_id, score, rank, source) of queries (qid, text, vector). strict: a query that lacks what a retriever needs raises."""
        c = self.config
        if strict:
            required(queries, *(["vector"] if "dense" in c else []), *(["text"] if "sparse" in c else []))
        if "cache" in c and c["cache"].get("exact"):
            asked, members = distinct_queries(queries)
            hits = self._search(asked, k).withColumnRenamed("qid", "rep")
            return members.join(hits, "rep").drop("rep")
        return self._search(queries, k)

    def _search(self, queries: DataFrame, k: int) -> DataFrame:
        c = self.config
        fetch = max(k, c.get("candidate_k", 100), c.get("rerank", {}).get("depth", 0), c.get("rescoring", {}).get("candidates", 0))
        lists = []
        if "dense" in c:
            asked = queries.where("vector is not null").select("qid", "vector")
            hits = self._dense(asked, fetch)
            if "rescoring" in c:
                hits = dense.rescore(hits, self.corpus, asked, c["rescoring"].get("candidates", 100), fetch, c["dense"].get("metric", "ip"))
            lists.append(hits)
        if "sparse" in c:
            s = c["sparse"] if isinstance(c["sparse"], dict) else {}
            lists.append(sparse.bm25(self.passages, queries.where("coalesce(text, '') <> ''").select("qid", "text"), fetch, **s))
        if not lists:
            raise ValueError("neither dense nor sparse is configured")
        hits = lists[0] if len(lists) == 1 else self._fused(*lists, fetch)
        if "rerank" in c:
            return rerank.rerank(hits, queries, self.passages, self.scorer, c["rerank"].get("depth", 50), k, c["rerank"].get("max_length", 256))
        return hits.where(F.col("rank") <= k)

    def _fused(self, first: DataFrame, second: DataFrame, k: int) -> DataFrame:
        """Fusion where both lists have hits; else the list that has, with its own scores. Both are written first, as each is read several times."""
        f = self.config.get("fusion", {})
        first, second = stored(first), stored(second)
        both = first.select("qid").distinct().join(second.select("qid").distinct(), "qid")
        one, two = first.join(both, "qid", "left_semi"), second.join(both, "qid", "left_semi")
        if f.get("type") == "weighted":
            fused = fusion.weighted(one, two, f.get("w_dense", 0.5), f.get("w_sparse", 0.5), k)
        else:
            fused = fusion.rrf(one, two, rrf_k=f.get("k", fusion.RRF_K), k=k)
        alone = [x.join(both, "qid", "left_anti").select("qid", "doc_id", "score", "rank", "source") for x in (first, second)]
        return fused.unionByName(alone[0]).unionByName(alone[1])
