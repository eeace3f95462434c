"""Vector expressions over ARRAY columns: products, distances, codes.

They are interpreted element by element; for scoring whole tables use operators.dense,
which multiplies matrices in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8


def _double(x: Column) -> Column:
    return x.cast("double")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: _double(x) * _double(y)))


def negative_l2(a: Column, b: Column) -> Column:
    """Minus the squared distance: larger is nearer, as with dot."""
    return -_sum(F.zip_with(a, b, lambda x, y: (_double(x) - _double(y)) * (_double(x) - _double(y))))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    n = norm(v) + TINY
    return F.transform(v, lambda x: _double(x) / n)


def sq8_codes(v: Column) -> Column:
    """One byte a value, scaled between the row's least and greatest; halves round to even. A constant row is all 0."""
    low = _double(F.array_min(v))
    span = F.greatest(_double(F.array_max(v)) - low, F.lit(TINY))
    return F.transform(v, lambda x: F.rint((_double(x) - low) / span * 255).cast("int"))


def sq8_encoded(v: Column) -> Column:
    """(codes, low, span): what sq8_decoded needs."""
    low = _double(F.array_min(v))
    return F.struct(sq8_codes(v).alias("codes"), low.alias("low"), F.greatest(_double(F.array_max(v)) - low, F.lit(TINY)).alias("span"))


def sq8_decoded(encoded: Column) -> Column:
    return F.transform(encoded["codes"], lambda c: c / F.lit(255.0) * encoded["span"] + encoded["low"])


def bit_words(v: Column) -> Column:
    """A bit for each value that is 0 or more, first value in the highest bit of the first 64-bit word; padded with 0."""
    words = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / 64), F.lit(1)).cast("int") - 1)
    bits = F.transform(v, lambda x, i: F.when(_double(x) >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), 63 - i % 64)).otherwise(F.lit(0).cast("long")))
    return F.transform(words, lambda w: F.aggregate(F.slice(bits, w * 64 + 1, F.lit(64)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def partition_bytes(rows: Column, dim: Column) -> Column:
    """Estimated size of an index partition: 32-bit values and half as much again for its graph, plus 1 MiB."""
    return F.floor(rows * F.greatest(dim, F.lit(1)) * 4 * 1.5).cast("long") + 1048576
