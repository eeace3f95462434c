"""Search on compressed vectors: scalar (a byte a value), binary (a bit a value), product codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import bit_words, sq8_decoded, sq8_encoded
from .dense import HITS, QUERY_BLOCK, Best, by_blocks, flat_knn, matrix, ranked, with_vectors
from .workload import hashed_sample

TRAIN_SAMPLE = 100_000


def sq8(corpus: DataFrame) -> DataFrame:
    """(doc_id, code<codes, low, span>)."""
    return corpus.select("doc_id", sq8_encoded(F.col("vector")).alias("code"))


def sq8_knn(codes: DataFrame, queries: DataFrame, k: int = 10, metric: str = "ip") -> DataFrame:
    return flat_knn(codes.select("doc_id", sq8_decoded(F.col("code")).alias("vector")), queries, k, metric)


def binary(corpus: DataFrame) -> DataFrame:
    """(doc_id, words)."""
    return corpus.select("doc_id", bit_words(F.col("vector")).alias("words"))


def _near_bits(ids: np.ndarray, words: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(ids, k)
        step = max(1, best.step // (2 * words.shape[1]))
        for b in batches:
            docs, own = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1).view(np.uint64)
            for at in range(0, len(docs), step):
                differ = np.bitwise_count(words[:, None, :] ^ own[None, at : at + step, :]).sum(axis=2, dtype=np.int64)
                best.add(-differ.astype(np.float64), docs[at : at + step])
        yield from best.hits()

    return run


def hamming_knn(codes: DataFrame, queries: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest of codes (doc_id, words) by differing bits; the score is minus their number."""
    asked = queries.where("vector is not null").select("qid", bit_words(F.col("vector")).cast("array<bigint>").alias("words"))

    def search(table: pa.Table) -> DataFrame:
        words = table.column("words").combine_chunks()
        return codes.select("doc_id", "words").mapInArrow(_near_bits(table.column("qid").to_numpy().astype(np.int64), words.flatten().to_numpy().reshape(len(words), -1).view(np.uint64), k), HITS)

    return ranked(by_blocks(asked, search, block), k).withColumn("source", F.lit("dense"))


class ProductCodes:
    """A codebook for each of m equal parts of a vector; trained on a bounded sample of the corpus."""

    def __init__(self, books: np.ndarray):
        self.books = books  # (m, codes, dim / m)

    @classmethod
    def train(cls, corpus: DataFrame, m: int = 8, bits: int = 8, rounds: int = 15, sample: int = TRAIN_SAMPLE, seed: int = 42) -> "ProductCodes":
        """Lloyd's k-means for each part, on about `sample` vectors at most, those with the smallest hashes of their ids."""
        rows = hashed_sample(corpus.where("vector is not null").select("doc_id", "vector"), sample, seed=seed).orderBy("doc_id").select("vector").toArrow()
        x = matrix(rows.column("vector").combine_chunks())
        if not len(x) or x.shape[1] % m:
            raise ValueError(f"the vectors' length must be a multiple of {m}")
        rng, books = np.random.default_rng(seed), []
        for part in np.split(x, m, axis=1):
            book = part[rng.choice(len(part), min(2**bits, len(part)), replace=False)].copy()
            for _ in range(rounds):
                own = _nearest_code(part, book)
                n = np.bincount(own, minlength=len(book))
                total = np.stack([np.bincount(own, weights=part[:, j], minlength=len(book)) for j in range(part.shape[1])], axis=1)
                book[n > 0] = total[n > 0] / n[n > 0, None]
            books.append(book)
        return cls(np.stack(books))

    def encode(self, corpus: DataFrame) -> DataFrame:
        """(doc_id, code array<int>)."""
        books = self.books

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    codes = np.stack([_nearest_code(part, book) for part, book in zip(np.split(matrix(b.column(1)), len(books), axis=1), books)], axis=1)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32()))], names=["doc_id", "code"])

        return corpus.where("vector is not null").select("doc_id", "vector").mapInArrow(run, "doc_id long, code array<int>")

    def knn(self, codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
        """Hits by inner product with the decoded vectors, from one table of part products for each query."""
        books = self.books

        def search(table: pa.Table) -> DataFrame:
            ids, vectors = with_vectors(table)
            tables = np.stack([part @ book.T for part, book in zip(np.split(vectors, len(books), axis=1), books)], axis=1)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                best = Best(ids, k)
                for b in batches:
                    docs, own = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                    for at in range(0, len(docs), best.step):
                        part = own[at : at + best.step]
                        best.add(sum(tables[:, j, part[:, j]] for j in range(part.shape[1])), docs[at : at + best.step])
                yield from best.hits()

            return codes.mapInArrow(run, HITS)

        asked = queries.where("vector is not null").select("qid", "vector")
        return ranked(by_blocks(asked, search, 512), k).withColumn("source", F.lit("dense"))


def _nearest_code(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(axis=1) - 2 * (part @ book.T)).argmin(axis=1)
