"""Encoding and decoding with merge-type piece vocabularies (sentencepiece BPE).

Encoding runs the merge itself: all adjacent symbol pairs that form a piece stand in an
agenda ordered by piece score, then by position; the best pair is merged, its
neighbours' new pairs join the agenda, and entries whose symbols have changed meanwhile
are passed over. What isn't a piece in the end falls back to its bytes.

No piece has a word mark after another character, so no merge crosses the start of a
marked word: a text is cut there (and at line ends, which are in no longer piece) into
independent chunks, and a bounded cache keeps each chunk's ids. Whether a vocabulary
allows these cuts is found from its pieces, not assumed.

Each Arrow batch checks every chunk new to the cache against the sentencepiece library;
a difference raises. Decoding is the library's decode over all ids of the text.

Cases. Null text counts as empty: no ids, and the empty text decoded. Ids, rows and
their order aren't changed; repeated rows each give a row. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import keeps, narrow

MARK = "▁"
#: Chunks kept by a worker, and the longest that is kept.
CACHE_LIMIT, LONGEST = 800_000, 64
SHORT, _NEVER = 32, float("inf")


class PieceEncoder:
    """One vocabulary; encode() gives the ids of a text."""

    def __init__(self, model_file: str, cache_limit: int = CACHE_LIMIT):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(sp.get_piece_size())
        self.bytes_of = [sp.piece_to_id(f"<0x{i:02X}>") for i in range(256)]
        self.id_of = {sp.id_to_piece(i): i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        #: The lower, the earlier a piece is merged.
        self.cost_of = {p: -sp.get_score(i) for p, i in self.id_of.items()}
        joined = [p for p in self.id_of if len(p) > 1]
        marked = any(MARK in p.lstrip(MARK) for p in joined)
        self.ends = not any("\n" in p for p in joined)
        line = "\n" if self.ends else ""
        self.cut = None if marked else re.compile(f"{MARK}*[^{MARK}{line}]+|{MARK}+" + ("|\n" if self.ends else ""))
        self.known: dict[str, tuple[int, ...]] = {}
        self.cache_limit = cache_limit
        self.fresh: dict[str, tuple[int, ...]] = {}
        #: Neighbouring characters of any piece: between others no merge is possible.
        self.joined = {p[i : i + 2] for p in joined for i in range(len(p) - 1)}

    def _merged_short(self, chunk: str) -> list[str]:
        """The agenda as a list by position: for few symbols, finding its best entry is faster than keeping it in order."""
        symbols, cost = list(chunk), self.cost_of.get
        agenda = [cost(chunk[i : i + 2], _NEVER) for i in range(len(chunk) - 1)]
        while agenda:
            best = min(agenda)
            if best == _NEVER:
                break
            i = agenda.index(best)
            symbols[i] += symbols[i + 1]
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = cost(symbols[i] + symbols[i + 1], _NEVER)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + symbols[i], _NEVER)
        return symbols

    def _merged_long(self, chunk: str) -> list[str]:
        """The agenda as a heap."""
        symbols = list(chunk)
        n = len(symbols)
        cost = self.cost_of
        agenda = []
        for i in range(n - 1):
            c = cost.get(p := symbols[i] + symbols[i + 1])
            if c is not None:
                agenda.append((c, i, i + 1, p))
        heapq.heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            _, i, j, p = heapq.heappop(agenda)
            if not symbols[i] or after[i] != j or not symbols[j] or len(symbols[i]) + len(symbols[j]) != len(p):
                continue
            symbols[i], symbols[j] = p, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                c = cost.get(q := p + symbols[k])
                if c is not None:
                    heapq.heappush(agenda, (c, i, k, q))
            h = before[i]
            if h >= 0:
                c = cost.get(q := symbols[h] + p)
                if c is not None:
                    heapq.heappush(agenda, (c, h, i, q))
        return symbols

    def merge(self, chunk: str) -> list[int]:
        """The ids of a chunk by the agenda of adjacent pairs."""
        symbols = self._merged_short(chunk) if len(chunk) <= SHORT else self._merged_long(chunk)
        out: list[int] = []
        for x in symbols:
            if x:
                i = self.id_of.get(x)
                if i is None:
                    out.extend(self.bytes_of[b] for b in x.encode())
                else:
                    out.append(i)
        return out

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        line = MARK + text.replace(" ", MARK)
        return self.cut.findall(line) if self.cut else [line]

    def _ids_of_chunk(self, chunk: str) -> tuple[int, ...]:
        ids = self.known.get(chunk)
        if ids is None:
            if len(chunk) > 2 and chunk[-2:] not in self.joined:
                # A last sign that joins with nothing before it: both parts are encoded, and kept, on their own.
                ids = self._ids_of_chunk(chunk[:-1]) + self._ids_of_chunk(chunk[-1])
            else:
                ids = tuple(self.merge(chunk))
            if len(chunk) <= LONGEST:
                self.known[chunk] = ids
            self.fresh[chunk] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if len(self.fresh) >= 20_000:
            self.check()
        if len(self.known) > self.cache_limit:
            self.known.clear()
        chunks = self.chunks(text)
        parts = [self.known.get(c) for c in chunks]
        if None in parts:
            parts = [self._ids_of_chunk(c) if p is None else p for p, c in zip(parts, chunks)]
        return list(chain.from_iterable(parts))

    def check(self) -> None:
        """Holds all chunks encoded since the last call against the library.

        It marks a text's start itself; a chunk without a mark stands behind a line end, which
        is in no longer piece, and what the line end gives alone is taken off.
        """
        marked = [c for c in self.fresh if c[0] == MARK and len(c) > 1]
        self._compare(marked, [c[1:] for c in marked], 0)
        if self.ends:
            bare = [c for c in self.fresh if c[0] != MARK or len(c) == 1]
            self._compare(bare, ["\n" + c for c in bare], len(self.library.encode("\n")))
        self.fresh = {}

    def _compare(self, chunks: list[str], texts: list[str], skip: int) -> None:
        for c, ids in zip(chunks, self.library.encode([t.replace(MARK, " ") for t in texts], num_threads=1), strict=True):
            if tuple(ids[skip:]) != self.fresh[c]:
                raise ValueError(f"the library has {ids[skip:]} for {c!r}, not {self.fresh[c]}")


@lru_cache(maxsize=4)
def encoder(model_file: str) -> PieceEncoder:
    """One for each Python worker, so the cache lasts over batches and tasks."""
    return PieceEncoder(model_file)


keeps("piece_codec", encoder.cache_clear)


def digests(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        text_of = [str(i) for i in range(enc.library.get_piece_size())]
        for b in batches:
            n, a, d = [], [], []
            for t in b.column(1):
                ids = enc.encode(t.as_py())
                n.append(len(ids))
                a.append(hashlib.sha256(",".join([text_of[i] for i in ids]).encode()).hexdigest())
                d.append(hashlib.sha256(enc.library.decode(ids).encode()).hexdigest())
            enc.check()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = narrow(df, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded): the ids themselves and the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        for b in batches:
            ids = [enc.encode(t.as_py()) for t in b.column(1)]
            enc.check()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.library.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    rows = narrow(df, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")
