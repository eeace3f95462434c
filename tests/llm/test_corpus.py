from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seekframe.llm import lm_scoring, queries, substring_dedup, syncmers, topk_search, toxicity
from seekframe.llm.common import running_starts, words_of

from .conftest import prose


def test_running_starts(spark):
    rows = [(0, []), (1, [3]), (2, [5] * 700)]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, l array<int>").select("i", running_starts(F.col("l")).alias("s")).collect()}
    assert got[0] == [] and got[1] == [0] and got[2] == [5 * i for i in range(700)]


# ---- toxicity ----


def labelled(n=240):
    bad = ["vileword", "hatefulness", "scumbagger", "grossthing"]
    rows, labels = [], []
    for i in range(n):
        r = random.Random(i)
        words = prose(i, r.randint(20, 300)).split()
        toxic = i % 4 == 0
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, table, odd_rows):
    rows, labels = labelled()
    df, lab = table(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(df, lab)
    got = toxicity.score(df, model, out="p").select("doc_id", "p", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    unseen = [r for r in got if r.h]
    assert 60 < len(unseen) < 100
    assert np.mean([(r.p >= 0.7) == (r.doc_id % 4 == 0) for r in unseen]) >= 0.95
    words = model.word_scores()
    assert words["hatefulnes"] > words["river"] + 20 and words["scumbaggers"] > words["stone"] + 20
    odd = toxicity.score(table(odd_rows), model, out="p").collect()
    assert len(odd) == len(odd_rows) and all(0 <= r.p <= 1 for r in odd) and all(r.p < 0.7 for r in odd if not (r.text or "").strip())
    assert toxicity.score(df.where("false"), model, out="p").count() == 0


def test_toxicity_without_labels(spark, table):
    none = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(table([(1, "a b"), (2, "c d")]), none)
    assert [r.p for r in toxicity.score(table([(1, "a b"), (2, None)]), model, out="p").collect()] == [0.0, 0.0]


def test_toxic_word_late_in_a_long_run():
    rows, labels = labelled(80)
    model = toxicity.fit([t for _, t in rows], [y for *_, y in labels], rounds=60)
    clean = "_".join(["river", "stone", "meadow", "copper"] * 20)
    words = model.word_scores()
    assert words[clean + "_hatefulness_" + clean] > words[clean + "_" + clean]
    assert toxicity.ngram_ids("a" * 70 + "b" * 9) != toxicity.ngram_ids("a" * 70 + "c" * 9)


def test_training_on_few_texts_settles_whatever_the_start():
    """Rounding, which differs from one processor to another, changes as much as another seed does."""
    rows, labels = labelled(80)
    clean = "_".join(["river", "stone", "meadow", "copper"] * 20)
    for seed in range(8):
        model = toxicity.fit([t for _, t in rows], [y for *_, y in labels], rounds=60, seed=seed)
        words = model.word_scores()
        assert np.mean([(toxicity.score_text(t, model.bias, words) >= 0.7) == y for (_, t), (*_, y) in zip(rows, labels)]) >= 0.95, seed
        assert words[clean + "_hatefulness_" + clean] > words[clean + "_" + clean], seed


# ---- substring dedup ----


def brute_dedup(rows, min_words=substring_dedup.MIN_WORDS):
    """The same definition, in plain Python."""
    split = re.compile(r"(?<=\n)|(?<=[.!?]\s)(?=\S)|(?<=[ \t])(?=[^\W\d_])")

    def units(text):
        cuts = [m.start() for m in split.finditer(text) if m.start() and (text[m.start() - 1] == "\n" or (m.start() > 1 and text[m.start() - 2] in ".!?" and text[m.start() - 1].isspace() and m.start() < len(text) and not text[m.start()].isspace()) or (m.start() < len(text) and text[m.start()].isupper()))]
        edges = [0, *cuts, len(text)]
        return [(a, b) for a, b in zip(edges, edges[1:]) if text[a:b].strip()]

    normal = lambda s: re.sub(r"\s+", " ", s.lower()).strip(" ")
    first, out = {}, {}
    for i, t in sorted(rows):
        for n, (a, b) in enumerate(units(t)):
            first.setdefault(normal(t[a:b]), (i, n))
    for i, t in rows:
        spans, run, u = [], [], units(t)
        for n, (a, b) in enumerate([*u, (None, None)]):
            if a is not None and first[normal(t[a:b])] != (i, n):
                run.append((a, b))
            else:
                if sum(len(normal(t[a2:b2]).split(" ")) for a2, b2 in run) >= min_words:
                    spans.append((run[0][0], run[-1][1]))
                run = []
        out[i] = spans
    return out


def test_substring_dedup_equals_brute_force(table):
    r = random.Random(3)
    sentence = lambda s: prose(s, r.randint(3, 14)).replace(".", ",").capitalize() + "."
    passage = " ".join(sentence(900 + i) for i in range(9))
    rows = []
    for i in range(60):
        parts = [sentence(i * 50 + j) if r.random() > 0.2 else "The end." for j in range(r.randint(1, 12))]
        if i % 6 == 0:
            parts.insert(r.randrange(len(parts) + 1), "midway through " + passage + " then more")
        if i % 10 == 3:
            parts = parts + ["\n", "Ünder the Äpfel river stone amber quiet lantern gather morning.", "\n\n"]
        rows.append((i, " ".join(parts)))
    rows += [(70, rows[0][1]), (71, ""), (72, prose(5, 3000))]
    df = table(rows)
    got = {x.doc_id: x for x in substring_dedup.remove(df, spans_col="gone").collect()}
    want = brute_dedup(rows)
    for i, t in rows:
        spans = [(s.start, s.end) for s in got[i].gone]
        assert spans == want[i], i
        text, at = "", 0
        for a, b in spans:
            text, at = text + t[at:a], b
        assert got[i].text == text + t[at:]
    assert any(want[i] for i in range(6, 60, 6)) and got[0].text == rows[0][1] and got[70].text == ""
    assert set(got[0].asDict()) == {*df.columns, "gone"}


def test_substring_dedup_of_odd_rows(table, odd_rows):
    got = substring_dedup.remove(table(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[1] == [None] and by[2] == [""] and len(by[6]) == 2 and by[6][0] == by[6][1] == "" and by[5] == [prose(5, 40)]
    assert substring_dedup.remove(table(odd_rows).where("false")).count() == 0


def test_short_lines_and_lines_without_spaces_go(table):
    menu, chinese, inline = "Home | About us\n", "这是一个没有空格的重复段落\n", "河边的石头安静地等待着早晨的银色光芒和远方的铜铃"
    own = lambda i: f"quite own words number{i} here\n"
    rows = [(i, own(i) + menu + own(100 + i) + chinese + own(200 + i) + f"start{i} here. " + "The end. " + f"Last{i} {i}.\n" + f"x{i}y Ab. " + f"A {inline} {i}z.") for i in range(4)]
    got = {r.doc_id: r for r in substring_dedup.remove(table(rows), spans_col="gone", whole_lines=True).collect()}
    assert got[0].text == rows[0][1]
    for i, t in rows[1:]:
        assert got[i].text == t.replace(menu, "").replace(chinese, ""), i
        assert [t[s.start : s.end] for s in got[i].gone] == [menu, chinese]
    rows = [(i, f"x{i}y words. A. {inline}\nq{i}") for i in range(3)] + [(i, f"x{i}y words. A. {inline}. B{i}\nq{i}") for i in range(3, 6)]
    got = {r.doc_id: r.text for r in substring_dedup.remove(table(rows), whole_lines=True).collect()}
    assert [inline in got[i] for i in range(6)] == [True, False, False, True, False, False]


# ---- syncmers ----


def word_list(text):
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]


def test_edited_texts_and_likeness(table, odd_rows):
    rows = [(i, t) for i, t in odd_rows if i is not None and i != 6] + [(6, prose(5, 40)), (20, prose(20, 300)), (21, prose(20, 300)), (22, prose(22, 500))]
    got = {r.doc_id: r for r in syncmers.compare_edited(table(rows)).collect()}
    ids = sorted(got)
    texts = {i: t or "" for i, t in rows}
    for n, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(n + 1) % len(ids)]]
        half = len(t) // 2
        assert (got[i].n_chars, got[i].edited) == (len(t), t[: len(t) - half] + nxt[:half])
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[20].near_next == 1.0 and got[20].sketch == got[21].sketch and got[5].near_next == 1.0
    assert 0.15 < got[21].near_edited < 0.6 and got[1].near_edited == 1.0
    assert syncmers.compare_edited(table(rows).where("false")).count() == 0
    assert syncmers.compare_edited(table(odd_rows)).count() == len(odd_rows)


def test_anchors_are_closed_syncmers_and_context_free(spark):
    a, b = prose(1, 80), prose(2, 60)
    df = spark.createDataFrame([(1, a), (2, b + " " + a), (3, "two words"), (4, ""), (5, "a b c d")], "doc_id long, text string")
    got = {r.doc_id: [(x.at, x.hash) for x in r.anchors] for r in syncmers.anchors(df).collect()}
    assert [(at + 60, h) for at, h in got[1]] == [(at, h) for at, h in got[2] if at >= 60]
    assert 0.3 < len(got[1]) / 76 < 0.7 and len(got[3]) == 1 and got[4] == [] and len(got[5]) == 1
    words = word_list(a)
    pairs = [r.h for r in spark.createDataFrame([(i, words[i], words[i + 1]) for i in range(len(words) - 1)], "i int, a string, b string").orderBy("i").select(F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h")).collect()]
    assert [at for at, _ in got[1]] == [i for i in range(len(words) - 4) if min(pairs[i : i + 4]) in (pairs[i], pairs[i + 3])]


def test_short_texts_have_an_anchor(spark):
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(5 + i % 3)) for i in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [[(x.at, x.hash) for x in row.anchors] for row in syncmers.anchors(df).collect()]
    assert all(a and all(0 <= at <= 2 for at, _ in a) for a in got) and len({tuple(a) for a in got}) == 90
    assert all(row.near_next == 0.0 for row in syncmers.compare_edited(df).collect())


def test_fingerprints_hold_all_anchors(spark):
    words = [f"w{random.Random(4).randrange(10**6) + i}" for i in range(4000)]
    other = words[:2000] + [f"z{i}" for i in range(50)] + words[2050:]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    a, b = ({x.hash for x in r.anchors} for r in syncmers.anchors(df).orderBy("doc_id").collect())
    got = {r.doc_id: r for r in syncmers.compare_edited(df).collect()}
    assert [x >> 32 for x in got[1].sketch] == sorted(a) and [x >> 32 for x in got[2].sketch] == sorted(b) and len(a) > 1500
    assert got[1].near_next == got[2].near_next == pytest.approx(len(a & b) / len(a | b)) and got[1].near_next < 1


def positional(a, b):
    """Likeness of two lists of (place, hash), in plain Python."""
    first = []
    for x in (a, b):
        f = {}
        for at, h in x:
            f.setdefault(h, at)
        first.append(f)
    a, b = first
    diagonals = Counter(b[h] - a[h] for h in a.keys() & b.keys())
    n = sum(1 for h in a.keys() & b.keys() if diagonals[b[h] - a[h]] > 1 or min(len(a), len(b)) <= 1)
    return 1.0 if not a and not b else n / max(len(a) + len(b) - n, 1)


def test_likeness_counts_positions_as_brute_force_does(spark):
    r = random.Random(12)
    texts = []
    for i in range(60):
        words = prose(r.randrange(8), r.choice([0, 3, 6, 40, 300])).split()
        if words and r.random() < 0.5:
            at = r.randrange(len(words))
            words[at:at] = prose(77, r.randrange(1, 60)).split()
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {x.doc_id: [(y.at, y.hash) for y in x.anchors] for x in syncmers.anchors(df).collect()}
    edited = {}
    got = {x.doc_id: x for x in syncmers.compare_edited(df).collect()}
    for x in syncmers.anchors(spark.createDataFrame([(i, x.edited) for i, x in got.items()], "doc_id long, text string")).collect():
        edited[x.doc_id] = [(y.at, y.hash) for y in x.anchors]
    for i in range(60):
        assert got[i].near_next == pytest.approx(positional(found[i], found[(i + 1) % 60])), i
        assert got[i].near_edited == pytest.approx(positional(found[i], edited[i])), i


def test_passages_by_position(spark):
    passage = prose(55, 70)
    a, b = f"{prose(1, 40)} {passage} {prose(2, 30)}", f"{prose(3, 90)} {passage}"
    r = syncmers.matches(spark.createDataFrame([(1, a, b), (2, a, ""), (3, None, b)], "id int, a string, b string")).orderBy("id").collect()
    longest = max(r[0].passages, key=lambda x: x.words)
    assert longest.words >= 60 and 40 <= longest.a <= 46 and longest.b - longest.a == 50
    assert r[1].passages == [] and not r[2].passages


def test_next_rows_of_many_ranges(spark, monkeypatch):
    """Ids of another type, null and repeated ids, copies, more ranges than rows."""
    rows = [(f"k{i % 50:03}", f"text {i // 50} of {i % 50} " + prose(i, 12)) for i in range(120)] + [(None, "no id")] * 3 + [("k001", "same")] * 4
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    order = sorted({(i or "", t, i is None) for i, t in rows}, key=lambda x: x[0])
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t, _ in order], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order.sort(key=lambda x: (not x[2], x[0], hashes[x[1]]))
    expected = Counter()
    for n, (i, t, null) in enumerate(order):
        nxt, half = order[(n + 1) % len(order)][1], len(t) // 2
        key = None if null else i
        expected[key, t[: len(t) - half] + nxt[:half]] += rows.count((key, t))
    assert Counter((r.doc_id, r.edited) for r in syncmers.compare_edited(df).collect()) == expected


# ---- language model ----


def small_chunks(monkeypatch):
    for name, value in {"CHUNK_DOCS": 7, "CHUNK_WORDS": 900, "BUCKET_KEYS": 200, "CLUSTERED": 20, "HOT": 6}.items():
        monkeypatch.setattr(lm_scoring, name, value)


@pytest.mark.parametrize("hot", [1, 6])
def test_scores_equal_brute_force(table, odd_rows, monkeypatch, hot):
    small_chunks(monkeypatch)
    monkeypatch.setattr(lm_scoring, "HOT", hot)
    rows = odd_rows + [(100 + i, prose(i % 15, 60)) for i in range(20)] + [(200 + i, f"rare{i} word{i % 3} river") for i in range(5)]
    trained = lm_scoring.train(table(rows), size=30, classes=10)
    model, vocab = trained.model, trained.model.vocab
    texts = [words_of((t or "").encode()) for _, t in rows]
    counts = Counter(w for t in texts for w in t)
    number = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w))[:30])}
    assert vocab.words == list(number) and vocab.n_words == sum(counts.values())
    table3 = np.exp(model.table.reshape(100, 10).astype(float))
    assert np.allclose(table3.sum(axis=1), 1, atol=1e-5)
    full, pair = Counter(), Counter()
    windows = lambda t: [(t[i - 1] if i else None, w, t[i + 1] if i + 1 < len(t) else None) for i, w in enumerate(t)]
    for t in texts:
        full.update(windows(t))
        pair.update((a, c) for a, _, c in windows(t))
    rare = sum(n for w, n in counts.items() if w not in number)
    class_of = lambda w: 0 if w is None else int(vocab.class_of[number.get(w, 30)])
    share = lambda w: math.exp(vocab.log_share[number[w]]) if w in number else counts[w] / rare
    assert sum(share(w) for w in number if class_of(w) == class_of(b"river")) == pytest.approx(1)
    want = {}
    for (i, _), t in zip(rows, texts):
        network = [table3[class_of(a) * 10 + class_of(c), class_of(w)] * share(w) for a, w, c in windows(t)]
        both = [(full[x] - 1 + lm_scoring.PRIOR * p) / (pair[x[0], x[2]] - 1 + lm_scoring.PRIOR) for x, p in zip(windows(t), network)]
        want.setdefault(i, []).append((len(t), sum(map(math.log, both)), sum(map(math.log, network))))
    got = {}
    for r in lm_scoring.score(trained).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.log_likelihood, r.network))
        assert (r["mean"] is None) == (r.n_words == 0)
    assert got.keys() == want.keys()
    for i in want:
        assert np.allclose(sorted(got[i]), sorted(want[i]), rtol=1e-4, atol=1e-3), i


def test_an_empty_table_has_no_scores(table, odd_rows):
    assert lm_scoring.score(lm_scoring.train(table(odd_rows).where("false"))).count() == 0


def test_the_network_and_the_windows_predict_better_than_frequencies(table, monkeypatch):
    small_chunks(monkeypatch)
    groups = [f"{a}{i}" for a in ("noun", "verb", "name") for i in range(12)]
    r = random.Random(2)
    line = lambda: " ".join(groups[12 * (j % 3) + r.randrange(12)] for j in range(60))
    rows = [(i, line()) for i in range(80)]
    shuffled = rows[0][1].split()
    random.Random(1).shuffle(shuffled)
    rows += [(500, " ".join(shuffled)), (501, rows[5][1])]
    got = {x.doc_id: x for x in lm_scoring.score(lm_scoring.train(table(rows), size=50, classes=12)).collect()}
    # The learned classes see that the three kinds of words take turns: a third of the choices are left.
    assert got[1].network / 60 > -math.log(12) - 0.4 and -math.log(36) < got[1]["mean"]
    assert got[500].network < got[0].network - 30
    # What stands twice in the corpus is predicted by its other copy.
    assert got[5]["mean"] > got[6]["mean"] + 1 and got[5].log_likelihood == pytest.approx(got[501].log_likelihood)


# ---- search ----


def brute_bm25(rows, asked, k):
    tf = {i: Counter(words_of((t or "").encode())) for i, t in rows}
    n, length = len(tf), {i: sum(c.values()) for i, c in tf.items()}
    avg, df = sum(length.values()) / n, Counter(w for c in tf.values() for w in c)
    out = {}
    for q in asked:
        s = [(round(sum(m * math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * length[i] / avg)) for w, m in tf[q].items() if w in c), 9), i) for i, c in tf.items()]
        out[q] = sorted(((-x, i) for x, i in s if x > 0))[:k]
    return out


@pytest.mark.parametrize("block", [700, 10**6])
def test_search_equals_brute_force(table, monkeypatch, block):
    monkeypatch.setattr(topk_search, "SHARD", 40)
    monkeypatch.setattr(topk_search, "BLOCK", 8)
    monkeypatch.setattr(topk_search, "PRIME", 6)
    rare = [f"word{j}" for j in range(300)]
    rows = [(i, prose(i % 130, 10 + i % 50) + " " + " ".join(random.Random(i).sample(rare, 4))) for i in range(240)] + [(1000 + j, rows_text) for j, rows_text in enumerate(["river " * 300, "", None, "unique"])] + [(2000 + j, prose(3, 40)) for j in range(15)]
    df = table(rows)
    got = {}
    for r in topk_search.search(df, df.where("doc_id % 10 = 0"), 5, block_size=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.doc_id))
    want = brute_bm25(rows, [i for i, _ in rows if i % 10 == 0], 5)
    for q, expected in want.items():
        assert [i for _, i in got.get(q, [])] == [i for _, i in expected], q
        assert np.allclose([s for s, _ in got.get(q, [])], [s for s, _ in expected], atol=1e-6)


def test_search_by_any_kind_of_id(spark):
    rows = [(f"d{i:02}", prose(i % 7, 12)) for i in range(40)] + [(None, "river")]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = topk_search.search(df, df.where("doc_id in ('d03', 'd20')"), 6).orderBy("query_id", "rank").collect()
    assert [r.doc_id for r in got if r.query_id == "d03"] == ["d03", "d10", "d17", "d24", "d31", "d38"] and len(got) == 12


def test_blocks_are_passed_over(monkeypatch):
    """Two languages in one shard: a query reads the blocks of its own."""
    words = [[f"{c}{i}" for i in range(200)] for c in "ab"]
    docs = []
    for i in range(1024):
        r = random.Random(i)
        terms, n = topk_search.terms_of(" ".join(["the", "der"][i % 2] if r.random() < 0.3 else r.choice(words[i % 2]) for _ in range(60)).encode())
        docs.append((i, terms, n))
    placed = topk_search._ordered(docs)
    s = topk_search.Shard([d[0] for d in placed], {k: v.tobytes() for k, v in topk_search._packed(placed).items()}, 60.0)
    q = topk_search.Queries(np.array([0, len(docs[4][1])]), *topk_search.Queries.numbered(docs[4][1]), np.ones(len(docs[4][1])), np.zeros(1))
    best = [([], np.empty(0))]
    place = np.searchsorted(s.types, q.types)
    s.search(q, 0, 1, place, 10, best)
    assert best[0][0][0] == 4 and all(i % 2 == 0 for i in best[0][0]) and s.blocks_read <= s.blocks_seen // 2


def test_each_round_of_a_search_knows_all_earlier_ones(spark):
    """A few shards are read without knowledge, however they are dealt; scores of all rounds so far make the next one's threshold."""
    for parts in (1, 16, 128):
        sizes = topk_search.in_rounds(spark.range(0, 128, 1, parts)).groupBy("round").count().orderBy("round").collect()
        assert [r.round for r in sizes] == [0, 1, 2, 3] and sum(r["count"] for r in sizes) == 128 and sizes[0]["count"] <= 4
    hits = [spark.createDataFrame(x, "query_no int, doc_id long, score double") for x in ([(0, 1, 5.0), (0, 2, 3.0), (1, 1, 2.0)], [(0, 7, 4.0), (1, 8, 9.0)])]
    assert topk_search.reached([], 3, 2).tolist() == [0, 0, 0]
    assert topk_search.reached(hits[:1], 3, 2).tolist() == [3, 0, 0]
    assert topk_search.reached(hits, 3, 2).tolist() == [4, 2, 0]


def test_search_of_odd_and_empty_tables(table, odd_rows):
    df = table(odd_rows)
    assert topk_search.search(df, df.where("doc_id = 4")).first().doc_id == 4
    assert topk_search.search(df.where("false"), df.where("false")).count() == 0


# ---- queries and pipeline ----


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query_gives_its_whole_table(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    if name == "packing_conversations":
        turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn")
        assert got.select("conv_id", "turn").distinct().count() == turns.distinct().count()
    elif name.startswith("op8"):
        assert got.select("query_id").distinct().count() == len(range(0, n, 50))
    else:
        assert got.select("doc_id").distinct().count() == n


def test_pipeline_stages(spark, table, tmp_path):
    rows, labels = labelled(240)
    shared_passage = " ".join(prose(7000 + i, 12).replace(".", "").capitalize() + "." for i in range(6))
    # 501 and 502 share a passage of 72 words, not enough to be near copies; 506 is one of 501.
    own = [prose(8000 + i, 40).replace(".", ",") + ". " for i in range(2)]
    rows = [(i, t) for i, t in rows] + [(500, rows[1][1]), (501, own[0] + shared_passage), (502, own[1] + shared_passage), (506, own[0] + "And " + shared_passage), (503, "mail me at someone@example.com please"), (504, ""), (505, None)]
    folder = str(tmp_path / "sf")
    docs = table(rows).select(*corpus_pipeline.COLUMNS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert tuple(kept.columns) == corpus_pipeline.COLUMNS
        kept.write.parquet(f"{folder}/{name}")
        kept = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r.doc_id: r.text for r in kept.collect()}
    clean = {i for i, _ in rows if i >= 500 or i % 4}
    assert len(seen["toxicity"].keys() & clean) >= 0.97 * len(clean) and sum(i not in seen["toxicity"] for i in range(0, 240, 4)) >= 55
    assert 500 not in seen["near_dedup"] and 1 in seen["near_dedup"] and 502 in seen["near_dedup"] and 506 not in seen["near_dedup"]
    assert shared_passage in seen["substring_dedup"][501] and seen["substring_dedup"][502] == own[1]
    assert seen["pii"][503] == "mail me at [EMAIL] please" and seen["pii"].keys() == seen["near_dedup"].keys()
    whole = {(r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == {(r.doc_id, r.start, r.length) for r in corpus_pipeline.STAGES[-1][1](spark, kept, folder).collect()}
    assert {i for i, _, _ in whole} == seen["pii"].keys()


def test_pipeline_of_odd_and_empty_tables(spark, table, odd_rows, tmp_path):
    rows = odd_rows + [(None, None), (20, "Long. " + prose(11, 40_000)), (21, "Short line.\n" * 3)]
    for name, docs in (("odd", table(rows)), ("empty", table(rows).where("false"))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")  # with extra columns, some of them named as operators' own
        spark.createDataFrame([(1, 1, None), (77, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        kept = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            kept = f(spark, kept, folder)
            assert tuple(kept.columns) == corpus_pipeline.COLUMNS
            kept.write.parquet(f"{folder}/{stage}")
            kept = spark.read.parquet(f"{folder}/{stage}")
        packed = corpus_pipeline.run(spark, folder).collect()
        if name == "empty":
            assert kept.count() == 0 and packed == []
            continue
        by = {}
        for r in kept.collect():
            by.setdefault(r.doc_id, []).append(r.text)
        assert len(by[None]) == 2 and by.keys() == {None, 1, 4, 5, 7, 8, 9, 10, 11, 20, 21}  # 2 and 3 are empty like 1; 6 is a copy of 5
        assert len(by[20][0]) > 100_000 and by[21] == ["Short line.\n"]
        assert sum(r.length for r in packed if r.doc_id == 20) > 20_000


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    df = queries.QUERIES[name](spark, sf)
    got = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str) == sorted((tuple(map(plain, r)) for r in got.fetchall()), key=str)
