from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seekframe.llm import simhash

from .conftest import prose


def brute(text: str) -> int:
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(fps: dict) -> dict:
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(fps), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 4:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_every_pair_within_the_radius_meets_under_a_mask():
    r = random.Random(1)
    for round_no in range(3):
        masks = simhash.covering_masks(4, round_no)
        assert len(masks) == 31
        for _ in range(300):
            diff = sum(1 << b for b in r.sample(range(64), 4))
            assert any(diff & m == 0 for m in masks)


def test_components_equal_brute_force(table, odd_rows):
    base = prose(1, 400)
    near = [(100 + i, base.replace("river", f"river{i}", 1)) for i in range(12)]
    rows = odd_rows + near + [(200 + i, prose(1000 + i, 50)) for i in range(20)]
    got = simhash.components(table(rows)).collect()
    assert len(got) == len(rows)
    fps = {i: brute(t or "") for i, t in rows if i is not None}
    want = classes(fps)
    for r in got:
        if r.doc_id is not None:
            assert (r.fp % (1 << 64), r.component_id) == (fps[r.doc_id], want[r.doc_id])


def test_runs_over_the_limit_are_dealt_again(spark):
    r = random.Random(2)
    centre = r.getrandbits(64)
    values = {centre} | {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))) for _ in range(300)} | {r.getrandbits(64) for _ in range(100)}
    fps = {i: v for i, v in enumerate(sorted(values))}
    signed = [(int(np.uint64(v).view(np.int64)),) for v in fps.values()]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), 4, limit=8)
    roots = {x.node: x.root for x in simhash.connected(edges).collect()}
    want = classes(fps)
    groups = {}
    for (s,), i in zip(signed, fps):
        groups.setdefault(roots.get(s, s), set()).add(i)
    assert {frozenset(g) for g in groups.values()} == {frozenset(i for i in fps if want[i] == w) for w in set(want.values())}


def test_long_chains_are_one_component(spark):
    chain = [(i + 1, i) for i in range(200)] + [(1000, 999)]
    got = {x.node: x.root for x in simhash.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1000] == 999


def test_keep_one_and_empty_table(table):
    rows = [(3, prose(1, 60)), (1, prose(1, 60)), (1, prose(1, 60)), (2, prose(2, 60)), (None, prose(1, 60))]
    kept = simhash.keep_one(table(rows))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, None] and kept.columns == table(rows).columns
    assert simhash.components(table(rows).where("false")).count() == 0
    assert simhash.keep_one(table(rows).where("false")).count() == 0


@pytest.mark.parametrize("text", ["", "a", "a b c", "a b c d", "A b c D e", "é x y z w"])
def test_fingerprint_of_short_texts(text):
    assert simhash.simhash64(text.encode()) == brute(text)


def test_hex_form(spark):
    r = spark.createDataFrame([(-1,), (5,)], "fp long").select(simhash.fp_hex(F.col("fp")).alias("h")).collect()
    assert [x.h for x in r] == ["f" * 16, "0" * 15 + "5"]
