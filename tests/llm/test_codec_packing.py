from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seekframe.llm import common, packing, piece_codec
from seekframe.llm.queries import PIECE_MODEL, WORD_TOKENIZER

MODEL, WORDS = public_tokenizers.path(PIECE_MODEL), public_tokenizers.path(WORD_TOKENIZER)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ENCODER = piece_codec.PieceEncoder(MODEL, cache_limit=40)
TOKENIZER = Tokenizer.from_file(WORDS)
TOKENS = packing.WordTokens(WORDS)

ANY = st.text(st.one_of(st.sampled_from(" \n\t.,'s▁aeiouÉßЖ中\U0001f600́İΣσς ​1234"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(ANY)
def test_pieces_equal_the_library(text):
    assert ENCODER.encode(text) == LIBRARY.encode(text)


def test_long_chunks_use_the_heap_with_equal_results():
    text = "internationalization" * 40 + " " + "ab" * 300
    assert ENCODER.encode(text) == LIBRARY.encode(text)
    chunk = "▁understanding"
    assert ENCODER._merged_short(chunk) == [x for x in ENCODER._merged_long(chunk) if x]


def test_a_difference_from_the_library_raises():
    for chunk in ("▁hello", "hello", ",", "▁", "\n"):
        e = piece_codec.PieceEncoder(MODEL)
        e.encode("hello\nhello, \n a  b ▁ ")
        e.check()
        e.fresh[chunk] = (1, 2, 3)
        with pytest.raises(ValueError):
            e.check()


def test_digests(table, odd_rows):
    got = piece_codec.digests(table(odd_rows), MODEL).collect()
    assert len(got) == len(odd_rows)
    texts = dict(odd_rows)
    for r in got:
        ids = LIBRARY.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest())
    r = piece_codec.encode(table([(1, "two  words\n")]), MODEL).first()
    assert list(r.ids) == LIBRARY.encode("two  words\n") and r.decoded == "two  words\n"
    assert piece_codec.digests(table(odd_rows).where("false"), MODEL).count() == 0


@settings(max_examples=300, deadline=None)
@given(ANY)
def test_word_ids_equal_the_tokenizer(text):
    assert TOKENS.encode(text) == np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_word_ids_of_hostile_texts():
    """Special strings in any case, letters of several lower-case characters, combining marks, every sign, long runs without spaces."""
    r = random.Random(8)
    parts = ["<|ENDOFTEXT|>", "<|endoftext|>", "<|StartOfText|>", "<|startoftext|>", "<|", "|>", "İ", "ı", "Σ", "ς", "ß", "ẞ", "ǅ", "\u0307", "\u0301", "\u0345", "é", "e\u0301", "Å", "Ω", "ﬁ", "中", "ไทย", "\u200d", "\u00a0", "\u3000", "\t", "\r\n", "\n", " ", " ", " ", "a", "Bc", "don't", "we'LL", "9", "٣", "_", "-", "²", *".,;:!?)]}([{\"'/\\+*&%$#@~`^=<>|"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 12))) for _ in range(100_000)]
    expected = TOKENIZER.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, e in zip(texts, expected) if TOKENS.encode(t) != np.array(e.ids, dtype="<u4").tobytes()]
    assert not wrong, wrong[:5]


def test_word_ids_with_special_strings_and_a_full_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_LIMIT", 5)
    t = packing.WordTokens(WORDS)
    for text in ("<|startoftext|> a <|endoftext|>.", "x<|startoftext|>y plain words, more. words, " * 3, "w" * 300 + ". a"):
        assert t.encode(text) == np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def check_pieces(rows, texts, max_tokens):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, pieces in by_doc.items():
        ids = np.array(TOKENIZER.encode(texts[i] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        copies = sum(p.start == 0 for p in pieces)
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids)
        assert sum(p.length for p in pieces) == copies * len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= max_tokens
    return by_seq


def test_words_of_letters_go_to_the_tokenizer_with_spaces(monkeypatch):
    """No special token stands between them, which the tokenizer would cut at one by one; every letter of this path, in every place of a word."""
    t, given = packing.WordTokens(WORDS), []
    ids = t._ids
    monkeypatch.setattr(t, "_ids", lambda text: given.append(text) or ids(text))
    letters = [c for c in map(chr, range(0x250)) if c.isalpha()]
    words = [w for c in letters for w in (c, c + "ab", "a" + c + "b", "ab" + c, c + c, c + "'s", c + "1")] + ["river" * 20, "river" * 20 + ",", "stone"]
    for text in (" ".join(words), " ".join(reversed(words)), "<|x " + " ".join(words).upper()):
        assert np.frombuffer(t.encode(text), dtype="<u4").tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids
    assert not any(t.between in x and "stone" in x for x in given) and any("stone" in x for x in given)
    assert not [w for w in t.known if len(w) > packing.LONGEST]


def test_packing_documents(table, odd_rows, spark, sf):
    rows = packing.pack_documents(table(odd_rows), WORDS, max_tokens=512).collect()
    texts = {i: t for i, t in odd_rows}
    check_pieces(rows, texts, 512)
    assert packing.pack_documents(table(odd_rows).where("false"), WORDS).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seqs = check_pieces(packing.pack_documents(docs, WORDS).collect(), {r.doc_id: r.text for r in docs.collect()}, 2048)
    used = sum(p.length for s in seqs.values() for p in s)
    assert used / (2048 * len(seqs)) > 0.97


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(0, 50)).map(lambda x: (x[0], min(x))), max_size=80))
def test_all_three_limits_hold(sizes):
    t, w = np.array([s[0] for s in sizes], dtype=np.int64), np.array([s[1] for s in sizes], dtype=np.int64)
    seq, off = packing.pack_sizes(t, w, (50, 4, 50))
    for s in set(seq.tolist()):
        mine = np.flatnonzero(seq == s)
        assert t[mine].sum() <= 50 and len(mine) <= 4 and w[mine].sum() <= 50
        order = mine[np.argsort(off[mine])]
        assert (off[order] == np.concatenate(([0], np.cumsum(t[order])[:-1]))).all()
    assert len(set(seq.tolist())) <= max(len(sizes), 1)


def test_null_and_repeated_ids_spread_over_buckets(table, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 50)
    rows = [(None, "same words here")] * 300 + [(7, f"text number {i}") for i in range(300)]
    got = packing.pack_documents(table(rows), WORDS, max_tokens=64).collect()
    assert len(got) == 600
    for keys in ([r for r in got if r.doc_id is None], [r for r in got if r.doc_id == 7]):
        buckets = [r.sequence_id >> 36 for r in keys]
        assert max(map(buckets.count, set(buckets))) < 100


def test_a_piece_that_cannot_fit_raises():
    with pytest.raises(ValueError):
        packing.pack_sizes(np.array([60]), np.array([1]), (50, 4, 50))


def test_conversations_keep_the_loss_limit(spark, sf):
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = packing.pack_conversations(conv, WORDS, 1024, 16, 512).collect()
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for s in seqs.values():
        assert sum(r.length for r in s) <= 1024 and sum(r.loss for r in s) <= 512 and len(s) <= 16
    assert len({(r.doc_id, r.start) for r in rows}) == len(rows)


def test_workers_let_go_of_packings_words():
    """A worker that goes on to another operator frees the words that packing keeps, but keeps them from one packing task to the next."""
    packing.word_tokens(WORDS).encode("river stone")
    common.let_go("packing")
    assert packing.word_tokens.cache_info().currsize == 1 and len(packing.word_tokens(WORDS).known) == 3
    common.let_go("toxicity")
    assert packing.word_tokens.cache_info().currsize == 0
