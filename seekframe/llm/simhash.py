"""64-bit SimHash with an exact similarity search by covering bit masks.

Fingerprints of `shingle` consecutive words are combined by majority into 64 bits. Two
documents are linked if their fingerprints differ in at most `radius` bits.

Search. With r = radius, every bit position gets a non-zero vector of r + 1 bits, and
each of the 2**(r+1) - 1 non-zero vectors v gives one mask: the positions whose vector
has an odd inner product with v. The vectors of r differing positions span at most r
dimensions, so some v is orthogonal to them all: under v's mask the two fingerprints are
equal, and they meet in that table's bucket. No pair within the radius is lost.

Scale. Equal fingerprints are merged first (map-side minimum), so a group of exact
copies is one row. Buckets are read as sorted runs in Arrow batches; a run longer than
`RUN_LIMIT` distinct fingerprints isn't held but sent on to another round of masks drawn
anew, where its members still meet by the same argument. A bucket gives a star of links
to each of its local components, never all pairs. Components are found by alternating
large-star and small-star steps, each cut off by a checkpoint.

Cases. Null text counts as empty; a text without words has fingerprint 0 and is linked
like any other. Fewer words than a shingle make one shingle. Rows that repeat an id each
give a row. A null id is never a component's id unless all ids in it are null. An empty
table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_empty, narrow, shared

SEED = 42
RUN_LIMIT, HOT_SHARE = 4096, 1000
ROUNDS_LIMIT = 60
_CHUNK = 1 << 16


def simhash64(text: bytes, shingle: int = 4) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(line, SEED)]
    else:
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        starts.append(at)
        hashes = [digest(line[s : e - 1], SEED) for s, e in zip(starts, starts[shingle:])]
    return majority(np.array(hashes, dtype="<u8"))


def majority(values: np.ndarray) -> int:
    """The bits that more than half of some 64-bit hashes have; 0 for none."""
    if not len(values):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(values), _CHUNK):
        part = values[i : i + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): one row for each row of df; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fp = np.fromiter((simhash64(t.as_py(), shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = narrow(df, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def covering_masks(radius: int, round_no: int = 0) -> list[int]:
    """The masks as unsigned 64-bit integers; round_no deals the positions' vectors anew."""
    n = (1 << (radius + 1)) - 1
    vectors = [1 + i % n for i in range(64)]
    random.Random(1000 + round_no).shuffle(vectors)
    return [sum(1 << i for i, p in enumerate(vectors) if (p & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _buckets(fp: Column, radius: int, round_no: int, parent: Column | None) -> Column:
    keys = [
        F.xxhash64(*([parent] if parent is not None else []), F.lit(t), fp.bitwiseAND(F.lit(_signed(m)).cast("long")))
        for t, m in enumerate(covering_masks(radius, round_no))
    ]
    return F.explode(F.array(*keys))


def _star(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) of each local component of more than one fingerprint."""
    left = np.sort(fps)
    members, roots = [], []
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count((left ^ queue.pop()).view(np.uint64)) <= radius
            if near.any():
                new = left[near]
                queue.extend(new)
                members.append(new)
                roots.append(np.full(len(new), root))
                left = left[~near]
    if not members:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(members), np.concatenate(roots)


def _links_of(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal keys."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
    size = ends - starts
    two = starts[size == 2]
    a, b = fps[two], fps[two + 1]
    ok = (np.bitwise_count((a ^ b).view(np.uint64)) <= radius) & (a != b)
    out_a, out_b = [np.maximum(a, b)[ok]], [np.minimum(a, b)[ok]]
    for s, e in zip(starts[size > 2], ends[size > 2]):
        m, r = _star(fps[s:e], radius)
        out_a.append(m)
        out_b.append(r)
    return np.concatenate(out_a), np.concatenate(out_b)


def _scan(radius: int, limit: int):
    """Reads (bucket, fp) sorted by bucket; gives links (a, b), and (bucket, fp) of runs over the limit as `more`."""

    def batch(a: np.ndarray, b: np.ndarray, more: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), more))], names=["a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        hot = None
        for x in batches:
            k, f = x.column(0).to_numpy(), x.column(1).to_numpy()
            if hot is not None:
                n = int(np.searchsorted(k, hot, side="right"))
                if n:
                    yield batch(k[:n], f[:n], True)
                    k, f = k[n:], f[n:]
            if not len(k):
                continue
            hot = None
            keys, fps = np.concatenate((keys, k)), np.concatenate((fps, f))
            last = int(np.searchsorted(keys, keys[-1], side="left"))
            if last:
                yield from settle(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
            if len(keys) > limit:
                yield batch(keys, fps, True)
                hot, keys, fps = keys[-1], keys[:0], fps[:0]
        if len(keys):
            yield from settle(keys, fps)

    def settle(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
        long = n[at] > limit
        if long.any():
            yield batch(keys[long], fps[long], True)
            keys, fps = keys[~long], fps[~long]
        if len(keys) > 1:
            a, b = _links_of(keys, fps, radius)
            if len(a):
                yield batch(a, b, False)

    return run


def links(fps: DataFrame, radius: int = 4, limit: int = RUN_LIMIT) -> DataFrame:
    """(a, b), a > b: links between distinct fingerprints whose components are those of all pairs within the radius. fps: distinct column fp."""
    rows = fps.select("fp", _buckets(F.col("fp"), radius, 0, None).alias("bucket"))
    found: DataFrame | None = None
    for round_no in range(1, ROUNDS_LIMIT):
        out = shared(rows.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_scan(radius, limit), "a long, b long, more boolean"))
        edges = out.where("not more").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        more = out.where("more").select(F.col("a").alias("parent"), F.col("b").alias("fp"))
        if is_empty(more):
            return found.distinct()
        rows = more.select("fp", _buckets(F.col("fp"), radius, round_no, F.col("parent")).alias("bucket"))
    raise RuntimeError("a bucket of distinct fingerprints didn't split")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the edges (a, b), a > b, with the smallest node that it reaches."""
    now, sign = shared(edges), None
    for _ in range(ROUNDS_LIMIT):
        both = now.union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a > b").distinct()
        now = shared(small)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == sign:
            break
        sign = new
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4, limit: int = RUN_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that can be reached by links."""
    rows = shared(fingerprints(df, id_col, text_col, shingle))
    merged = shared(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    nodes = connected(links(merged.select("fp"), radius, limit)).join(merged, F.col("node") == F.col("fp")).select("fp", "root", "least")
    roots = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = nodes.join(roots, "root").select("fp", "component_id")
    groups = shared(merged.join(linked, "fp", "left").where("copies > 1 or component_id is not null").select("fp", "copies", F.coalesce("component_id", "least").alias("gid")))
    return with_groups(rows, groups, "fp").select("doc_id", "fp", F.coalesce("gid", "doc_id").alias("component_id"))


def with_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows left join groups (key, copies, gid), one row of groups for a key.

    A key that has a thousandth of all rows or more is one of a thousand at most: these are
    broadcast, so the rows of a hot key never meet in one task.
    """
    limit = max(rows.count() // HOT_SHARE, 1)
    hot = F.broadcast(groups.where(F.col("copies") >= limit).select(key, F.col("gid").alias("hot_gid"), F.lit(True).alias("hot")))
    both = rows.join(hot, key, "left")
    rest = both.where("hot is null").drop("hot", "hot_gid").join(groups.where(F.col("copies") < limit).select(key, "gid"), key, "left")
    return rest.unionByName(both.where("hot").withColumnRenamed("hot_gid", "gid").drop("hot"))


def fp_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """df with one row of each component: the one with the smallest id. Rows with a null id can't be ranked and all stay."""
    found = components(df, id_col, text_col, radius, shingle)
    keep = shared(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")))
    ids = keep.select(F.col("doc_id").alias("__keep"))
    kept = df.join(ids, F.col(f"`{id_col}`") == F.col("__keep"), "left_semi")
    if not is_empty(keep.where("n > 1")):
        kept = kept.dropDuplicates([id_col])
    return kept.unionByName(df.where(F.col(f"`{id_col}`").isNull()))
