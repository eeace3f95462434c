"""Vector bin packing of examples into training sequences.

Every piece has three sizes: tokens, 1 (a segment), and loss-bearing tokens; every
sequence has a limit on each. Sequences are filled one after the other: of the pieces
that fit in all three dimensions, the one whose size has the largest dot product with
what is left of the sequence (each over the limit) goes in next.

Texts longer than a sequence are cut; whole sequences of one text need no search. The
rest of each text is one piece of a bucket of about `BUCKET` texts, dealt by a hash of the id
and of the piece. A bucket is packed on its own, so memory and time of a task don't grow
with the input, and no bucket depends on how Spark has split the rows. Only sizes and
checksums are shuffled, never ids.

Cases. Null text counts as empty: its only token is the end token. Rows that repeat an
id each give pieces of their own, and other texts under one id go to other buckets. Rows
with a null id are dealt by their place in the input, however many they are. An empty
table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeps, let_go, narrow

END_ID = 1
BUCKET = 16_384
#: Words kept by a worker, and the longest that is kept.
CACHE_LIMIT, LONGEST = 1_400_000, 64
_SIGNS = frozenset(".,;:!?)]}")
#: Letters whose lower case may depend on more than themselves or be more than one character, or that normalisation may change.
_BEYOND = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: Ends the last token of a run of letters in the vocabulary.
_END_OF_WORD = "</w>"
#: Every special token begins so. Its string counts only as it is written: in capitals it is ordinary text.
_SPECIAL = "<|"


class _Known(dict):
    """Ids by word; a word that isn't known yet gives None and is noted."""

    missed: list[str]

    def __missing__(self, word: str) -> None:
        self.missed.append(word)
        return None


class WordTokens:
    """Ids as little-endian 32-bit bytes, word by word: this tokenizer never joins across a space or line end, and drops case."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.between = "<|startoftext|>"
        self.between_id = self.tokenizer.token_to_id(self.between)
        vocabulary = self.tokenizer.get_vocab()
        #: Whether a run of letters ends with this id.
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(_END_OF_WORD)]] = True
        self.known = _Known({"": b""})

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, new: set[str]) -> None:
        known = self.known
        # A letter and the last sign after it are never in one token, so most words with a sign need no search.
        signed = [w for w in new if w[-1] in _SIGNS and w[-2:-1].isalpha() and not _BEYOND.match(w[-2])]
        if signed:
            new.difference_update(signed)
            new.update([w[:-1] for w in signed])
            new.update([w[-1] for w in signed])
            new.difference_update([w for w in new if w in known])
        # Of letters alone each word is one run, whose last token tells where it ends, so spaces keep them apart.
        rest, letters = new, [w for w in new if w.isalpha()]
        if _BEYOND.search("".join(letters)):
            letters = [w for w in letters if not _BEYOND.search(w)]
        if letters:
            ids = self._ids(" ".join(letters))
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(letters):
                rest = new.difference(letters)
                raw, at = ids.tobytes(), 0
                for w, e in zip(letters, (4 * ends).tolist()):
                    known[w] = raw[at:e]
                    at = e
        plain = [w for w in rest if self.between not in w]
        for w in rest.difference(plain):
            known[w] = self._ids(w).tobytes()
        if plain:
            # The other new words go to the tokenizer in one text, kept apart by a token that none of them has.
            ids = self._ids(self.between.join(plain))
            raw, at = ids.tobytes(), 0
            for w, e in zip(plain, [*np.flatnonzero(ids == self.between_id).tolist(), len(ids)], strict=True):
                known[w] = raw[4 * at : 4 * e]
                at = e + 1
        for w in signed:
            known[w] = known[w[:-1]] + known[w[-1]]

    def encode(self, text: str) -> bytes:
        if _SPECIAL not in text and (text.isascii() or not _BEYOND.search(text)):
            text = text.lower()  # as the tokenizer does; fewer distinct words to keep
        known = self.known
        if len(known) > CACHE_LIMIT:
            known = self.known = _Known({"": b""})
        known.missed = []
        words = text.replace("\n", " ").split(" ")
        parts = [known[w] for w in words]
        if known.missed:
            new = set(known.missed)
            self._learn(new)
            parts = [known[w] if p is None else p for p, w in zip(parts, words)]
            for w in [w for w in (*new, *known.missed) if len(w) > LONGEST]:
                known.pop(w, None)
        return b"".join(parts)


@lru_cache(maxsize=2)
def word_tokens(tokenizer_file: str) -> WordTokens:
    return WordTokens(tokenizer_file)


keeps("packing", word_tokens.cache_clear)


def cut_pieces(df: DataFrame, tokenizer_file: str, max_tokens: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the pieces of every text, at most max_tokens long."""
    end, width = np.array([END_ID], dtype="<u4").tobytes(), 4 * max_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("packing")
        tokens = word_tokens(tokenizer_file)
        for b in batches:
            rows, cols = [], ([], [], [], [])
            for row, t in enumerate(b.column(1)):
                ids = tokens.encode(t.as_py()) + end
                for at in range(0, len(ids), width):
                    part = ids[at : at + width]
                    rows.append(row)
                    for c, v in zip(cols, (at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = narrow(df, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def pack_sizes(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, in the given order; equal sizes are taken in that order.

    A piece that exceeds a limit on its own raises.
    """
    if len(tokens) and (tokens.max() > limits[0] or loss.max() > limits[2] or limits[1] < 1):
        raise ValueError("a piece is larger than a sequence")
    sequence, offset = np.empty(len(tokens), np.int64), np.empty(len(tokens), np.int64)
    # Whole sequences first; the search is for the others.
    whole = np.flatnonzero(tokens == limits[0])
    sequence[whole], offset[whole] = np.arange(len(whole)), 0
    rest = np.flatnonzero(tokens < limits[0])
    kinds, kind_of = np.unique(np.stack([tokens[rest], loss[rest]], axis=1), axis=0, return_inverse=True)
    order = rest[np.argsort(kind_of.ravel(), kind="stable")]
    count = np.bincount(kind_of.ravel(), minlength=len(kinds))
    at = np.concatenate(([0], np.cumsum(count)[:-1]))
    t, w = kinds[:, 0].copy(), kinds[:, 1].copy()
    share_t, share_w = t / limits[0], w / limits[2]
    left, bin_no = len(rest), len(whole)
    while left:
        free_t, free_s, free_w, used = limits[0], limits[1], limits[2], 0
        while left and free_s:
            fits = (t <= free_t) & (w <= free_w) & (count > 0)
            dot = np.where(fits, share_t * (free_t / limits[0]) + share_w * (free_w / limits[2]), -1.0)
            best = int(dot.argmax())
            if dot[best] < 0:
                break
            piece = order[at[best]]
            sequence[piece], offset[piece] = bin_no, used
            at[best] += 1
            count[best] -= 1
            left -= 1
            used += int(t[best])
            free_t, free_s, free_w = free_t - int(t[best]), free_s - 1, free_w - int(w[best])
        bin_no += 1
        if bin_no % 64 == 0:
            keep = count > 0
            t, w, share_t, share_w, count, at = (x[keep] for x in (t, w, share_t, share_w, count, at))
    return sequence, offset


def pack(pieces: DataFrame, n_rows: int, max_tokens: int = 2048, max_segments: int = 256, max_loss: int | None = None, loss_col: str | None = None, key_col: str = "doc_id") -> DataFrame:
    """pieces with sequence_id and offset. n_rows: about how many pieces need the search; sets the number of buckets.

    loss_col: loss-bearing tokens of a piece (default: all its tokens).
    """
    limits = (max_tokens, max_segments, max_tokens if max_loss is None else max_loss)
    names = pieces.columns
    buckets = max(1, -(-n_rows // BUCKET))
    key = F.col(f"`{key_col}`")
    by_id = F.xxhash64(key, *(F.col(c) for c in ("start", "ids_crc32") if c in names))
    keyed = pieces.withColumn("bucket", F.pmod(F.when(key.isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(by_id), F.lit(buckets)))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c in (key_col, "start", "ids_crc32") if c in pdf], kind="stable", ignore_index=True)
        tokens = pdf["length"].to_numpy()
        loss = pdf[loss_col].to_numpy() if loss_col else tokens
        s, o = pack_sizes(tokens, loss, limits)
        return pdf[names].assign(sequence_id=(int(key[0]) << 36) + s, offset=o)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return keyed.groupBy("bucket").applyInPandas(one, f"{fields}, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer_file: str, max_tokens: int = 2048, max_segments: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut and pack whole texts: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    return pack(cut_pieces(df, tokenizer_file, max_tokens, id_col, text_col), df.count(), max_tokens, max_segments)


def pack_conversations(df: DataFrame, tokenizer_file: str, max_tokens: int = 2048, max_segments: int = 64, max_loss: int = 1536) -> DataFrame:
    """Instruction data: each turn of (conv_id, turn, role, text) is a piece; only the assistant's tokens bear loss, at most max_loss in a sequence.

    A turn longer than a sequence, or with more loss than it may hold, is cut.
    """
    width = min(max_tokens, max_loss)
    turns = df.select(F.struct("conv_id", "turn").alias("doc_id"), "text", "role")
    cut = cut_pieces(turns.select(F.to_json("doc_id").alias("doc_id"), "text"), tokenizer_file, width)
    roles = turns.select(F.to_json("doc_id").alias("doc_id"), "role").groupBy("doc_id").agg(F.max("role").alias("role"))
    sized = cut.join(roles, "doc_id").withColumn("loss", F.when(F.col("role") == "assistant", F.col("length")).otherwise(F.lit(0)).cast("long"))
    return pack(sized, df.count(), max_tokens, max_segments, max_loss, "loss")
