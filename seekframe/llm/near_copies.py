"""Near copies: documents whose sets of five consecutive words have a Jaccard similarity of `LEAST` or more.

Groups come from two searches. SimHash fingerprints of the sets link within `RADIUS`
bits, by covering masks, without a miss (see simhash). But texts of similarity 0.8 differ in
about ten bits of 64, which no affordable number of masks covers; so there is a second
search. The smallest values of `BANDS * ROWS` hash functions over a text's shingles
make its signature; each band of it gives a bucket. Two texts of similarity s meet in
a bucket with probability 1 - (1 - s**ROWS)**BANDS, more than 0.9999 from 0.8 on. What meets
in a bucket, of any size, or is linked by fingerprints, and so on from one to the next, is a group.

Check. Within a group all pairs that nothing connects yet are compared by their whole sets of
shingle hashes (64 bits); only pairs of similarity `LEAST` or more link. A component of links
keeps one document. No partner in a group or bucket is passed over.

Scale. Texts with equal sets are merged first. A group goes in blocks of `BLOCK` hashes (a
text counts `EACH` more); all pairs of a block are compared at once, by products of matrices.
First each block is tried by itself, dealt by size, then by hash: most of a large group is one
component after that. Then all pairs of blocks are tried, but for those that are one component
already or whose sizes can't be similar. So a group that is one component costs in proportion to
its size; texts that are alike enough to meet but not to link cost a block's size less than their square.

Cases. As in simhash: null text counts as empty; texts without words are equal. Fewer
words than a shingle make one shingle. Rows with a null id all stay. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import is_empty, let_go, narrow, shared
from .simhash import connected, links, majority, with_groups

SHINGLE, LEAST, RADIUS = 5, 0.8, 4
BANDS, ROWS = 20, 4
#: Shingles of a block, and what a text counts beside its own.
BLOCK, EACH = 500_000, 500
#: Shingles of more texts of a block are counted by products of matrices, so many at a time.
RARE, COLUMNS = 16, 1024
#: So many links are connected in one task, which saves a shuffle for each step.
FEW = 500_000
SEED = 42
_SIZE = BANDS * ROWS
_CHUNK = 1 << 12

_draw = np.random.default_rng(SEED)
_FACTOR = _draw.integers(0, 1 << 63, _SIZE, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_ADDED = _draw.integers(0, 1 << 63, _SIZE, dtype=np.uint64)[:, None]


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's shingles."""
    words = text.lower().split()
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(line, SEED)] if words else [], dtype=np.uint64)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    return np.unique(np.fromiter((digest(line[s : e - 1], SEED) for s, e in zip(starts, starts[size:])), dtype=np.uint64, count=len(words) - size + 1))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The upper halves of the smallest values of all hash functions."""
    out = np.full(_SIZE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), _CHUNK):
        out = np.minimum(out, (hashes[None, i : i + _CHUNK] * _FACTOR + _ADDED).min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32)


def _profiles(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, fp, signature): node is the hash of the whole set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("near_copies")
        for b in batches:
            nodes, fps, signatures = [], [], []
            for t in b.column(1).cast(pa.binary()):
                h = shingles(t.as_py())
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                fps.append(majority(h))
                signatures.append(signature(h).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (nodes, fps)), pa.array(signatures, pa.binary())], names=["doc_id", "node", "fp", "signature"])

    rows = narrow(df, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, node long, fp long, signature binary")


def _met(rows: DataFrame) -> DataFrame:
    """(a, b), a > b: nodes that share a bucket, each with the smallest one there. rows: node, signature."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = np.uint64(32)
        salt = (np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        # Some rows at a time: each becomes `BANDS` rows.
        for b in (x.slice(at, 1000) for x in batches for at in range(0, x.num_rows, 1000)):
            s = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            bucket = np.broadcast_to(salt, s.shape[:2]).copy()
            for i in range(ROWS):
                bucket = (bucket ^ s[:, :, i]) * np.uint64(0xD6E8FEB86659FD93)
                bucket ^= bucket >> half
            yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel().view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["bucket", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes = np.empty(0, np.int64), np.empty(0, np.int64)
        for x in batches:
            if not x.num_rows:
                continue
            # What is carried on is the first row of the last bucket.
            keys, nodes = np.concatenate((keys, x.column(0).to_numpy())), np.concatenate((nodes, x.column(1).to_numpy()))
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            least = np.repeat(nodes[starts], np.diff(np.append(starts, len(keys))))
            more = nodes != least
            yield pa.RecordBatch.from_arrays([pa.array(nodes[more]), pa.array(least[more])], names=["a", "b"])
            keys, nodes = keys[starts[-1] : starts[-1] + 1], nodes[starts[-1] : starts[-1] + 1]

    buckets = rows.select("node", "signature").mapInArrow(dealt, "bucket long, node long")
    return buckets.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(run, "a long, b long")


def _by_fingerprint(merged: DataFrame) -> DataFrame:
    """(a, b), a > b: nodes with equal fingerprints, each with the smallest of them; and the smallest ones of linked fingerprints. They join groups, in which all pairs are compared."""
    first = shared(merged.groupBy("fp").agg(F.min("node").alias("node")))
    same = merged.select("fp", F.col("node").alias("n")).join(first, "fp").where("n != node").select(F.col("n").alias("x"), F.col("node").alias("y"))
    near = links(first.select("fp"), RADIUS)
    near = near.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select("x", "y")
    return same.union(near).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """[i, j]: how many values two different sets share."""
    n, size = len(sets), [len(x) for x in sets]
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)
    count = np.diff(np.append(starts, len(values)))
    number, held = np.repeat(np.arange(len(count)), count), np.repeat(count, count)
    few = (held > 1) & (held <= RARE)
    at, who = number[few], owner[few]
    common = np.zeros(n * n, dtype=np.float32)
    for d in range(1, RARE):
        same = np.flatnonzero(at[d:] == at[:-d])
        if not len(same):
            break
        common += np.bincount(who[d:][same] * n + who[:-d][same], minlength=n * n)
    common = common.reshape(n, n)
    common = common + common.T
    often = np.flatnonzero(count > RARE)
    for lo in range(0, len(often), COLUMNS):
        part = often[lo : lo + COLUMNS]
        column = np.repeat(np.arange(len(part)), count[part])
        rows = owner[np.flatnonzero((held > RARE) & (number >= part[0]) & (number <= part[-1]))]
        m = np.zeros((n, len(part)), dtype=np.float32)
        m[rows, column] = 1
        common += m @ m.T
    return common


def joined(roots: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), a > b: roots, and the smallest root that pairs of similarity LEAST connect each to. All pairs with different roots are compared."""
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if roots.min() < roots.max():
        common, size = _common(sets), np.array([len(x) for x in sets], dtype=np.float64)
        near = roots[:, None] == roots[None, :]
        for at in range(0, len(sets), 256):
            both = common[at : at + 256]
            near[at : at + 256] |= both / np.maximum(size[at : at + 256, None] + size[None, :] - both, 1) >= LEAST
        left = np.argsort(roots, kind="stable")
        while len(left):
            found = todo = left[:1]
            left = left[1:]
            while len(todo) and len(left):
                hit = near[np.ix_(todo, left)].any(axis=0)
                todo, left = left[hit], left[~hit]
                found = np.append(found, todo)
            more = np.unique(roots[found])[1:]
            out_a.append(more)
            out_b.append(np.full(len(more), roots[found[0]]))
    return np.concatenate(out_a), np.concatenate(out_b)


def _tried(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b), a > b: roots that are connected by pairs of a unit. rows: unit, node, root."""

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        units, roots, values = t.column("unit").to_numpy(), t.column("root").to_numpy(), t.column("hashes").to_pylist()
        cuts = [0, *(np.flatnonzero(units[1:] != units[:-1]) + 1).tolist(), len(units)]
        for s, e in zip(cuts, cuts[1:]):
            a, b = joined(roots[s:e], [np.frombuffer(x, np.uint64) for x in values[s:e]])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for x in batches:
            if not x.num_rows:
                continue
            t = pa.Table.from_batches([x])
            t = pa.concat_tables([held, t]) if held else t
            units = t.column("unit").to_numpy()
            last = int(np.searchsorted(units, units[-1]))
            if last:
                yield from found(t.slice(0, last))
            held = t.slice(last)
        if held:
            yield from found(held)

    both = rows.select("unit", "node", "root").join(sets, "node").select("unit", "root", "hashes")
    return shared(both.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long"))


def _roots(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root): as connected(); edges may repeat."""
    edges = shared(edges)
    if edges.count() > few:
        return connected(edges.distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(batches, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        n = both.num_rows
        nodes, at = np.unique(np.concatenate((both.column(0).to_numpy(), both.column(1).to_numpy())), return_inverse=True)
        a, b = at[:n], at[n:]
        old, root = None, np.arange(len(nodes))
        while old is None or (root != old).any():
            old, root = root, root.copy()
            least = np.minimum(old[a], old[b])
            for x in (a, b, old[a], old[b]):
                np.minimum.at(root, x, least)
            root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def _merged(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows with the roots that edges of roots give them."""
    if is_empty(edges):
        return rows
    new = _roots(edges).toDF("root", "to")
    return shared(rows.join(new, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to"))


def _linked(groups: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """(node, root): root is the smallest node reached by pairs of similarity LEAST. groups: (node, grp)."""

    def dealt(rows: DataFrame, *order) -> DataFrame:
        # Only numbers of a group meet here, not its sets.
        so_far = F.sum(F.col("size") + EACH).over(Window.partitionBy("grp").orderBy(*order, "node"))
        return rows.withColumn("block", F.floor(so_far / block))

    rows = groups.join(sets.select("node", (F.octet_length("hashes") / 8).cast("long").alias("size")), "node").withColumn("root", F.col("node"))
    rows = shared(dealt(rows, "size"))
    large = shared(rows.where("block > 0").select("grp").distinct())
    unit = F.xxhash64("grp", "block")
    rows = _merged(rows, _tried(rows.withColumn("unit", unit), sets)).drop("block")
    done = rows.select("node", "root")
    if is_empty(large):
        return done
    done = rows.join(large, "grp", "left_anti").select("node", "root")
    rows = rows.join(large, "grp", "left_semi")
    rows = _merged(rows, _tried(dealt(rows, F.xxhash64("node")).withColumn("unit", unit), sets))
    # The rest: all pairs of blocks. Texts of one component stand together, so most blocks of a large one need no comparison among themselves.
    of_root = F.count("*").over(Window.partitionBy("root"))
    rows = shared(dealt(rows.withColumn("n", of_root), F.desc("n"), "root", "size").drop("n"))
    blocks = shared(rows.groupBy("grp", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.min("root").alias("r0"), F.max("root").alias("r1")))
    a, b = blocks.alias("a"), blocks.alias("b")
    like = (F.col("a.hi") >= F.col("b.lo") * (LEAST - 1e-9)) & (F.col("b.hi") >= F.col("a.lo") * (LEAST - 1e-9))
    whole = F.least("a.r0", "b.r0") == F.greatest("a.r1", "b.r1")
    pairs = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.block") <= F.col("b.block")) & like & ~whole).select("a.grp", F.col("a.block").alias("x"), F.col("b.block").alias("y"))
    units = pairs.select("grp", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"), F.xxhash64("grp", "x", "y").alias("unit"))
    return done.unionByName(_merged(rows, _tried(rows.join(units, ["grp", "block"]), sets)).select("node", "root"))


def _sets(df: DataFrame, nodes: DataFrame, merged: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, hashes) of the wanted nodes, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py()) for t in b.column(1).cast(pa.binary())]
            nodes = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in found], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array([h.tobytes() for h in found], pa.binary())], names=["node", "hashes"])

    wanted = merged.join(nodes, "node").select(F.col("least").alias("wid"), F.col("node").alias("wanted"))
    rows = narrow(df, id_col, text_col).join(wanted, F.col("doc_id") == F.col("wid")).select("wanted", "text")
    # Rows that share an id may have other texts: only the one that made the node counts.
    return shared(rows.mapInArrow(run, "node long, hashes binary").dropDuplicates(["node"]))


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) of the rows with an id: the smallest doc_id that can be reached by links."""
    df = df.where(F.col(f"`{id_col}`").isNotNull())
    rows = shared(_profiles(df, id_col, text_col))
    merged = shared(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("fp").alias("fp"), F.first("signature").alias("signature")))
    groups = shared(_roots(_met(merged).union(_by_fingerprint(merged))).toDF("node", "grp"))
    roots = _linked(groups, _sets(df, groups.select("node"), merged, id_col, text_col), block)
    linked = roots.join(merged.select("node", "least"), "node")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    gid = linked.join(ids, "root").select("node", "component_id")
    names = shared(merged.select("node", "least", "copies").join(gid, "node", "left").select("node", "copies", F.coalesce("component_id", "least").alias("gid")))
    return with_groups(rows.select("doc_id", "node"), names, "node").select("doc_id", F.col("gid").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each component: the one with the smallest id. Rows with a null id can't be ranked and all stay."""
    found = components(df, id_col, text_col)
    keep = shared(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")))
    kept = df.join(keep.select(F.col("doc_id").alias("__keep")), F.col(f"`{id_col}`") == F.col("__keep"), "left_semi")
    if not is_empty(keep.where("n > 1")):
        kept = kept.dropDuplicates([id_col])
    return kept.unionByName(df.where(F.col(f"`{id_col}`").isNull()))
