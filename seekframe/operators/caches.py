"""Result caches and the partition cache, replayed over a trace of requests.

Such caches are sequential: whether a request hits depends on all before it. A trace is
replayed by worker, as servers with several processes keep a cache each: requests of a
worker are read in order as a stream of Arrow batches, and the task holds the cache only,
never the trace. Questions without a size limit need no replay and are window functions.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_key

MIB = 1 << 20


def unbounded_hits(trace: DataFrame, key: Column) -> DataFrame:
    """trace (seq, ...) with hit: whether the key came before. A null or empty key bypasses the cache: hit is null."""
    some = key != ""
    seen = F.row_number().over(Window.partitionBy(key).orderBy("seq")) > 1
    return trace.withColumn("hit", F.when(some, seen))


def hit_rate(replayed: DataFrame, *by: str) -> DataFrame:
    """hits / (hits + misses); 0 without either. Bypassed requests count as neither."""
    hits, known = F.count_if(F.coalesce("hit", F.lit(False))), F.count("hit")
    return replayed.groupBy(*by).agg(hits.alias("hits"), (known - hits).alias("misses"), F.when(known > 0, hits / known).otherwise(0.0).alias("hit_rate"))


class ExactCache:
    """Least recently used texts, at most `size`; a hit moves to the front."""

    def __init__(self, size: int):
        self.size, self.kept = size, OrderedDict()

    def ask(self, key: str | None) -> bool | None:
        if not key:
            return None
        if key in self.kept:
            self.kept.move_to_end(key)
            return True
        self.kept[key] = True
        while len(self.kept) > self.size:
            self.kept.popitem(last=False)
        return False


class SemanticCache:
    """The last `size` stored vectors; a request hits if its best inner product reaches the threshold. Hits aren't stored; without a vector it's a miss."""

    def __init__(self, size: int, threshold: float):
        self.size, self.threshold = size, threshold
        self.rows, self.n = None, 0

    def ask(self, vector: np.ndarray | None) -> bool:
        if vector is None:
            return False
        if self.n and float((self.rows[: min(self.n, self.size)] @ vector).max()) >= self.threshold:
            return True
        if self.rows is None:
            self.rows = np.zeros((self.size, len(vector)), dtype=np.float32)
        self.rows[self.n % self.size] = vector
        self.n += 1
        return False


class PartitionCache:
    """Partitions in memory under a byte budget. Policies: lru, lfu (then least recent), cost (least uses a byte, then first loaded).

    Pinned partitions stay. If nothing can go, or a partition is larger than the budget, it is admitted over the budget.
    """

    def __init__(self, budget: int, policy: str = "lru", pinned: frozenset[int] = frozenset()):
        if policy not in ("lru", "lfu", "cost"):
            raise ValueError(f"no such policy: {policy}")
        self.budget, self.policy, self.pinned = budget, policy, pinned
        self.meta: dict[int, list[int]] = {}  # partition: [uses, last use, bytes]
        self.used = self.evictions = self.clock = 0

    def _victim(self) -> int | None:
        free = [(p, m) for p, m in self.meta.items() if p not in self.pinned]
        if not free:
            return None
        order: dict[str, Callable] = {"lru": lambda x: (x[1][1], x[0]), "lfu": lambda x: (x[1][0], x[1][1], x[0]), "cost": lambda x: x[1][0] / max(x[1][2], 1)}
        return min(free, key=order[self.policy])[0]

    def ask(self, partition: int, size: int) -> tuple[bool, int]:
        """(whether it was there, evictions that this made)."""
        self.clock += 1
        if partition in self.meta:
            m = self.meta[partition]
            m[0], m[1] = m[0] + 1, self.clock
            return True, 0
        gone = 0
        while self.used + size > self.budget and (v := self._victim()) is not None:
            self.used -= self.meta.pop(v)[2]
            gone += 1
        self.meta[partition] = [1, self.clock, size]
        self.used += size
        self.evictions += gone
        return False, gone


def _replay(trace: DataFrame, columns: list[str], make: Callable, ask: Callable, out: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """Rows of trace (worker, seq, ...) in order, each with what `ask` gives for its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, cache = object(), None
        for b in batches:
            got = []
            for w, *values in zip(b.column(0).to_pylist(), *(b.column(i + 2).to_pylist() for i in range(len(columns)))):
                if w != worker:
                    worker, cache = w, make()
                got.append(ask(cache, *values))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([g[i] for g in got], kind) for i, (_, kind, _) in enumerate(out))], names=["worker", "seq", *(n for n, _, _ in out)])

    rows = trace.select("worker", "seq", *columns).repartition("worker").sortWithinPartitions("worker", "seq")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"worker {kinds['worker']}, seq {kinds['seq']}, " + ", ".join(f"{n} {sql}" for n, _, sql in out))


_HIT = [("hit", pa.bool_(), "boolean")]


def replay_exact(trace: DataFrame, size: int = 10_000) -> DataFrame:
    """(worker, seq, hit) of trace (worker, seq, text): an exact result cache for each worker."""
    return _replay(trace.withColumn("key", query_key(F.col("text"))), ["key"], lambda: ExactCache(size), lambda c, key: (c.ask(key),), _HIT)


def replay_semantic(trace: DataFrame, size: int = 5_000, threshold: float = 0.95) -> DataFrame:
    """(worker, seq, hit) of trace (worker, seq, vector): a semantic cache for each worker."""
    return _replay(trace, ["vector"], lambda: SemanticCache(size, threshold), lambda c, v: (c.ask(None if v is None else np.array(v, dtype=np.float32)),), _HIT)


def replay_partitions(trace: DataFrame, budget: int, policy: str = "lru", pinned: frozenset[int] = frozenset()) -> DataFrame:
    """(worker, seq, hit, evictions) of trace (worker, seq, partition_id, bytes)."""
    return _replay(trace, ["partition_id", "bytes"], lambda: PartitionCache(budget, policy, pinned), lambda c, p, n: c.ask(p, n), [*_HIT, ("evictions", pa.int32(), "int")])


def co_access(probes: DataFrame) -> DataFrame:
    """(a, b, n): how many requests of probes (request, partition_id) went to both partitions, in each order."""
    p = probes.distinct()
    pairs = p.select("request", F.col("partition_id").alias("a")).join(p.select("request", F.col("partition_id").alias("b")), "request")
    return pairs.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def co_accessed(probes: DataFrame, k: int = 2) -> DataFrame:
    """(partition_id, related, n, place): the k partitions most often probed together with each; ties go to the smaller."""
    w = Window.partitionBy("a").orderBy(F.desc("n"), "b")
    return co_access(probes).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(F.col("a").alias("partition_id"), F.col("b").alias("related"), "n", "place")


def neighbours(centroids: DataFrame, k: int = 2) -> DataFrame:
    """(partition_id, related, score, place): the k nearest other centroids of each."""
    from .ivf import scored_centroids

    near = scored_centroids(centroids.select(F.col("partition_id").alias("p"), F.col("centroid").alias("vector")), centroids, k + 1, "p")
    w = Window.partitionBy("p").orderBy("place")
    near = near.where(F.col("p") != F.col("partition_id")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return near.select(F.col("p").alias("partition_id"), F.col("partition_id").alias("related"), "score", "place")


def history_targets(probes: DataFrame, k: int = 2, block: int = 100_000) -> DataFrame:
    """(request, target): for each probed partition of a request the k others most often probed together with it up to then, this request included; ties go to the smaller.

    Requests (numbers, in the order of their coming) are dealt into blocks of `block`, so a
    partition that most requests probe is no single task's: what came before a block is
    summed first, and the block starts from these sums.
    """
    p = probes.select("request", "partition_id").distinct()
    kind = p.schema["request"].dataType.simpleString()
    both = p.groupBy("request").agg(F.sort_array(F.collect_set("partition_id")).alias("all")).withColumn("block", F.floor(F.col("request") / block).cast("long"))
    each = both.select("request", "block", F.explode("all").alias("a"), "all")
    pairs = each.select("block", "a", F.explode("all").alias("b")).where("a <> b").groupBy("block", "a", "b").agg(F.count("*").alias("n"))
    so_far = pairs.withColumn("n", F.sum("n").over(Window.partitionBy("a", "b").orderBy("block")))
    # A block in which the partition is probed starts from the sums at the end of the last such block before it.
    blocks = each.select("a", "block").distinct()
    blocks = blocks.withColumn("before", F.lag("block").over(Window.partitionBy("a").orderBy("block"))).where("before is not null")
    ends = Window.partitionBy("a", "b").orderBy("block")
    spans = so_far.withColumn("until", F.lead("block").over(ends))
    starts = blocks.alias("x").join(spans.alias("s"), (F.col("x.a") == F.col("s.a")) & (F.col("s.block") <= F.col("x.before")) & (F.col("s.until").isNull() | (F.col("s.until") > F.col("x.before"))))
    starts = starts.groupBy("x.a", "x.block").agg(F.collect_list(F.struct("s.b", "s.n")).alias("l")).select(F.lit(None).cast(kind).alias("request"), "a", "block", F.col("l.b").cast("array<int>").alias("others"), F.col("l.n").alias("counts"))
    asked = each.select("request", "a", "block", F.array_except("all", F.array("a")).cast("array<int>").alias("others"), F.lit(None).cast("array<bigint>").alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, {}
        for b in batches:
            requests, targets = [], []
            for request, a, block_no, others, known in zip(*(c.to_pylist() for c in b.columns)):
                if (a, block_no) != now:
                    now, counts = (a, block_no), {}
                if known is not None:
                    counts.update(zip(others, known))
                    continue
                for o in others:
                    counts[o] = counts.get(o, 0) + 1
                for t in heapq.nsmallest(k, counts.items(), key=lambda x: (-x[1], x[0])):
                    requests.append(request)
                    targets.append(t[0])
            yield pa.RecordBatch.from_arrays([pa.array(requests, b.schema.field(0).type), pa.array(targets, pa.int32())], names=["request", "target"])

    rows = asked.unionByName(starts).repartition("a", "block").sortWithinPartitions("a", "block", F.col("request").asc_nulls_first())
    return rows.select("request", "a", "block", "others", "counts").mapInArrow(run, f"request {kind}, target int").distinct()


def prefetch_targets(probes: DataFrame, centroids: DataFrame, strategy: str = "both", k: int = 2) -> DataFrame:
    """(request, target): partitions to load ahead for each request, without those that it probes itself.

    neighbour: the nearest centroids of each probed one; history: those most often probed together so far; both; none.
    """
    if strategy not in ("neighbour", "history", "both", "none"):
        raise ValueError(f"no such strategy: {strategy}")
    own = probes.select("request", F.col("partition_id").cast("int").alias("target")).distinct()
    parts = []
    if strategy in ("neighbour", "both"):
        near = neighbours(centroids, k).select("partition_id", F.col("related").cast("int").alias("target"))
        parts.append(probes.join(near, "partition_id").select("request", "target"))
    if strategy in ("history", "both"):
        parts.append(history_targets(probes, k))
    if not parts:
        return own.where(F.lit(False))
    return reduce(DataFrame.unionByName, parts).distinct().join(own, ["request", "target"], "left_anti")
