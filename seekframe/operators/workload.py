"""Workloads of queries, data preparation, and load-test arithmetic."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared

# The usual exponents of skewed workloads.
ZIPF = (0.8, 1.0, 1.2)


def _positive(s: float) -> float:
    if s <= 0:
        raise ValueError("s must be positive")
    return float(s)


def zipf_weights(spark: SparkSession, n: int, s: float) -> DataFrame:
    """(rank, weight): r ** -s for the ranks 1 to n, summing to 1."""
    ranks = spark.range(1, n + 1).select(F.col("id").alias("rank"), F.pow(F.col("id").cast("double"), F.lit(-_positive(s))).alias("w"))
    return ranks.crossJoin(F.broadcast(ranks.agg(F.sum("w").alias("total")))).select("rank", (F.col("w") / F.col("total")).alias("weight"))


def uniform(spark: SparkSession, n: int, pool: int, seed: int = 42) -> DataFrame:
    """(seq, qidx): n requests, each query of the pool as likely as any."""
    return spark.range(n).select(F.col("id").alias("seq"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(pool)).cast("int").alias("qidx"))


def _hex_draw(*keys: Column) -> Column:
    """The first 13 hex digits of an MD5, a number under 2**52, over 2**52: any part of a workload can be drawn again alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *keys)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def zipf(spark: SparkSession, n: int, pool: int, s: float, seed: int = 42) -> DataFrame:
    """(seq, qidx): n requests; query weights fall with a shuffled rank. Ranks and draws go by hash; the pool's weights are one array of `pool` numbers."""
    weights = np.arange(1, pool + 1, dtype=np.float64) ** -_positive(s)
    until = np.cumsum(weights / weights.sum())[:-1]
    order = np.array(sorted(range(pool), key=lambda q: (hashlib.md5(f"{seed}:{q}".encode()).hexdigest(), q)), dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(order[np.searchsorted(until, b.column(1).to_numpy(), side="right")])], names=["seq", "qidx"])

    return spark.range(n).select("id", _hex_draw(F.lit(seed + 1), F.col("id")).alias("u")).mapInArrow(run, "seq long, qidx int")


def hashed_sample(df: DataFrame, size: int, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """About `size` rows of df, those with the smallest hashes of their key; all rows if there are no more. No task sees more than its share."""
    n = df.count()
    if n <= size:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) < int(size / n * (1 << 40)))


def contiguous(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """df with 0, 1, 2, ... in the given order, numbered range by range: no task sees more than its range.

    The ranges are written out once. Planned twice, they would be cut at other places for the rows
    than for their sizes.
    """
    place = F.monotonically_increasing_id()  # the partition's number, then 33 bits for the place in it
    rows = shared(df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.struct("*").alias("row"), place.alias("place")))
    rows = rows.select("row", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    before = sizes.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").select("row.*", (F.col("before") + F.col("at")).alias(name))


def numbered_queries(queries: DataFrame) -> DataFrame:
    """(qidx, query_id, text): ids by length, then value, numbered from 0."""
    sized = queries.select("query_id", "text", F.length("query_id").alias("id_length"))
    return contiguous(sized, "id_length", "query_id", name="qidx").select("qidx", "query_id", "text")


def remapped_qrels(qrels: DataFrame, queries: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): qrels (query_id, doc_key, score) with qidx and idx where both are known, and how many rows weren't."""
    q, d = queries.select("query_id", "qidx"), docs.select("doc_key", "idx")
    kept = qrels.join(q, "query_id").join(d, "doc_key").select("qidx", "query_id", "idx", "doc_key", F.col("score").cast("tinyint").alias("score"))
    known = qrels.join(q, "query_id", "left").join(d, "doc_key", "left")
    return kept, known.agg(F.count_if(F.col("qidx").isNull() | F.col("idx").isNull()).alias("dropped"))


def wrapped(qidx: Column, pool: int) -> Column:
    """A request's query, whatever its number: counted around a pool of queries."""
    return F.pmod(qidx, F.lit(pool))


def remapped_hits(hits: DataFrame, ids: DataFrame) -> DataFrame:
    """hits with local numbers as doc_id, named by ids (local, doc_id); numbers beyond the table fall away."""
    return hits.withColumnRenamed("doc_id", "local").join(ids.select("local", "doc_id"), "local").drop("local")


def _hash_limit(hashes: DataFrame, n: int, digits: int = 3, levels: int = 2) -> tuple[str, int]:
    """(prefix, m) for a column h of hex digits: the n smallest are all below the prefix, and the m smallest that begin with it.

    One histogram of 16**digits prefixes for each level; what begins with the last prefix is one in 16**(digits * levels).
    """
    prefix = ""
    for level in range(levels):
        begin = F.substring("h", 1, digits * (level + 1))
        counts = hashes.where(F.col("h").startswith(prefix)).groupBy(begin.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
        for r in counts:
            if r.n > n or r is counts[-1]:
                prefix = r.p
                break
            n -= r.n
    return prefix, n


def subset(corpus: DataFrame, required: DataFrame, size: int, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """All required documents and others by a seeded hash up to `size`, numbered by key as sub_idx. Size of the corpus or more: all of it."""
    needed = required.select(key).distinct()
    n = needed.count()
    if n > size:
        raise ValueError(f"{n} documents are required, more than {size}")
    others = corpus.join(needed, key, "left_anti").withColumn("h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))))
    prefix, m = _hash_limit(others.select("h"), size - n)
    last = others.where(F.col("h").startswith(prefix)).orderBy("h", key).limit(m)
    others = others.where(F.col("h") < prefix).unionByName(last).drop("h")
    return contiguous(corpus.join(needed, key, "left_semi").unionByName(others), key, name="sub_idx")


def error_rate(ok: Column) -> Column:
    """Failed over all; 0 without requests."""
    return F.count_if(~ok) / F.greatest(F.count("*"), F.lit(1))


def load_steps(samples: DataFrame, slo: float, max_errors: float = 0.01, accuracy: int | None = None) -> DataFrame:
    """(step, requests, qps, p99, error_rate, passes) of samples (step, ok, latency, seconds): seconds is how long the step was held.

    accuracy: as in metrics.latency.
    """
    took = F.when(F.col("ok"), F.col("latency"))
    p99 = F.coalesce(F.percentile(took, F.lit(0.99)) if accuracy is None else F.percentile_approx(took, 0.99, accuracy), F.lit(0.0))
    out = samples.groupBy("step").agg(F.count("*").alias("requests"), (F.count_if("ok") / F.max("seconds")).alias("qps"), p99.alias("p99"), error_rate(F.col("ok")).alias("error_rate"))
    return out.withColumn("passes", (F.col("p99") <= slo) & (F.col("error_rate") <= max_errors))


def sustainable(steps: DataFrame) -> DataFrame:
    """The last step before the first that fails; no row if the first fails."""
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("so_far", F.min(F.col("passes").cast("int")).over(w)).where("so_far = 1").orderBy(F.desc("step")).limit(1).drop("so_far")


def resource_use(samples: DataFrame) -> DataFrame:
    """(peak_rss, mean_cpu, read_bytes) of samples (ts, rss, cpu, read_sectors) of 512 bytes."""
    return samples.agg(F.max("rss").alias("peak_rss"), F.avg("cpu").alias("mean_cpu"), ((F.max_by("read_sectors", "ts") - F.min_by("read_sectors", "ts")) * 512).alias("read_bytes"))
