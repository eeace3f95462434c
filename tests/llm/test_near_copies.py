from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from seekframe.llm import near_copies

from .conftest import prose

def brute(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

def similarity(a: str, b: str) -> float:
    x, y = brute(a), brute(b)
    return len(x & y) / len(x | y)

def edited(text: str, seed: int, edits: int) -> str:
    r, w = random.Random(seed), text.split()
    for i in r.sample(range(len(w)), edits):
        w[i] = f"new{seed}x{i}"
    return " ".join(w)

def test_stage_drops_near_copies_and_nothing_else(spark, table, tmp_path):
    rows = [(i, prose(i, 300)) for i in range(40)]
    rows += [(100 + i, edited(t, i, 6 if i % 2 else 16)) for i, t in rows]
    rows += [(200 + i, edited(rows[0][1], 1000 + i, 2)) for i in range(60)]
    df = table(rows).select(*corpus_pipeline.COLUMNS)
    got = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, df, str(tmp_path)).collect()}
    text = dict(rows)
    near = {100 + i for i in range(40) if similarity(text[i], text[100 + i]) >= 0.8} | {200 + i for i in range(60)}
    assert 15 <= len([i for i in near if i < 200]) <= 25
    assert got == set(text) - near

def test_odd_rows(table, odd_rows):
    kept = near_copies.keep_one(table(odd_rows))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 4, 5, 7, 8, 9, 10, 11, None], key=str)
    assert kept.columns == table(odd_rows).columns
    assert near_copies.keep_one(table(odd_rows).where("false")).count() == 0

def test_large_groups_lose_no_component(spark):
    """1,500 edits of one text, as many as 14 words in 300 each: all links against all pairs."""
    import numpy as np

    r, base = random.Random(4), prose(0, 300)
    texts = [base] + [edited(base, i, r.randrange(3, 15)) for i in range(1, 1500)]
    sets = [brute(t) for t in texts]
    known = {s: i for i, s in enumerate(sorted(sets[0]))}
    m = np.zeros((len(sets), len(known)), dtype=np.float32)
    for i, s in enumerate(sets):
        m[i, [known[x] for x in s if x in known]] = 1
    size = np.array([len(s) for s in sets], dtype=np.float32)
    common = m @ m.T
    near = common / (size[:, None] + size[None, :] - common) >= 0.8
    np.fill_diagonal(near, True)
    root = np.arange(len(sets))
    while True:
        new = np.array([root[near[i]].min() for i in range(len(sets))])
        new = np.minimum(new, root)
        if (new == root).all():
            break
        root = new
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {x.doc_id: x.component_id for x in near_copies.components(df).collect()}
    assert len(set(root.tolist())) > 20
    missed = [i for i in range(len(sets)) if got[i] != root[i]]

    assert all(got[i] >= root[i] for i in missed) and len(missed) <= 12, len(missed)

def all_pairs(texts):
    """The smallest number that each text reaches by pairs of similarity 0.8."""
    sets, root, changed = [brute(t) for t in texts], list(range(len(texts))), True
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    while changed:
        changed = False
        for i, j in near:
            if root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                changed = True
    return root

@pytest.mark.parametrize("block", [near_copies.BLOCK, 60_000])
def test_no_partner_of_a_large_group_is_passed_over(spark, block):
    """700 edits of one text: each text's component against all pairs, in one block and in several."""
    r, base = random.Random(4), prose(0, 300)
    texts = [base] + [edited(base, i, r.randrange(3, 9)) for i in range(1, 700)]
    texts = texts[1:] + texts[:1]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {x.doc_id: x.component_id for x in near_copies.components(df, block=block).collect()}
    assert [got[i] for i in range(len(texts))] == all_pairs(texts)

def test_texts_of_a_block_link_without_the_smallest_one():
    """Of equal fingerprints the smallest node is like none of the others, which are alike."""
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 500, 505, 510, 900)] + [np.empty(0, np.uint64)]
    a, b = near_copies.joined(np.arange(6), sets)
    assert list(zip(a.tolist(), b.tolist())) == [(2, 1), (3, 1)]
    many = [np.append(np.arange(100), [1000 + i, 2000 + i % 20]).astype(np.uint64) for i in range(40)]
    common = near_copies._common(many)
    assert all(common[i, j] == len(np.intersect1d(many[i], many[j])) for i in range(40) for j in range(i))

def test_links_connect_alike_in_one_task_and_in_many(spark):
    r = random.Random(3)
    edges = [(i + r.randrange(1, 40), i) for i in r.choices(range(-1000, 1000), k=900)] + [(i + 1, i) for i in range(5000, 5300)]
    df = spark.createDataFrame(edges + edges[:50], "a long, b long").repartition(3)
    one, many = ({x.node: x.root for x in near_copies._roots(df, few).collect()} for few in (10_000, 0))
    assert one == many and one[5300] == 5000 and len(set(one.values())) > 50
    assert near_copies._roots(df.where("false")).count() == 0
