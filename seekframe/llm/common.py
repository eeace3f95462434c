"""What the corpus operators share: reading, text access, cutting lineage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared, shared_folder, stored

__all__ = ["documents", "is_empty", "keeps", "let_go", "narrow", "running_starts", "shared", "shared_folder", "stored", "text_or_empty", "words_of"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    """A null text counts as the empty text everywhere in this package."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def narrow(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) under these fixed names, so other columns of the input can't clash with an operator's own."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


_kept: dict[str, Callable[[], None]] = {}


def keeps(owner: str, drop: Callable[[], None]) -> None:
    """drop frees what `owner` keeps in a Python worker from one task to the next."""
    _kept[owner] = drop


def let_go(owner: str = "") -> None:
    """Python workers outlive a stage: frees what other operators keep in this one, and gives free memory back to the system."""
    for other, drop in _kept.items():
        if other != owner:
            drop()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def running_starts(lengths: Column, block: int = 256) -> Column:
    """For an array of lengths, where each part starts: array<bigint>.

    Sums go block by block, so the arrays that grow while they are built stay short.
    """
    longs = "array<bigint>"

    def starts(part: Column, base: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(base.cast("long").alias("at"), F.array().cast(longs).alias("out")),
            lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
            lambda a: a["out"],
        )

    n_blocks = F.greatest(F.ceil(F.size(lengths) / block), F.lit(1)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(lengths, b * block + 1, F.lit(block)).cast(longs))
    bases = starts(F.transform(blocks, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))
    return F.flatten(F.zip_with(blocks, bases, starts))


#: Every ASCII byte that isn't a digit or a-z, as a space.
_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Maximal runs of digits, of a-z after lower-casing A-Z, and of anything that isn't ASCII, in a UTF-8 text."""
    return text.lower().translate(_WORDS).split()
