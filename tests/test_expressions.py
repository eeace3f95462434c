from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekframe.functions import text as T
from seekframe.functions import vectors as V


def one(spark, schema, row, *cols):
    return spark.createDataFrame([row], schema).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def test_tokens_split_at_anything_but_ascii(spark):
    r = one(spark, "t string", ("Über-Straße 42, CAFÉ x_y",), T.tokens(F.col("t")), T.tokens(F.lit(None).cast("string")))
    assert r.c0 == ["ber", "stra", "e", "42", "caf", "x", "y"] and r.c1 == []


def test_query_key_ignores_case_and_spaces(spark):
    assert one(spark, "t string", ("  A  b\tC\n",), T.query_key(F.col("t"))).c0 == "a b c"


def test_passages(spark):
    r = one(spark, "t string, x string", (None, " body "), T.passage(F.col("t"), F.col("x")), T.passage_to_embed(F.col("t"), F.col("x")), T.cut_for_rerank(F.col("x"), 1))
    assert (r.c0, r.c1, r.c2) == ("body", " body ", " bod")


def test_vector_expressions(spark):
    a, b = [0.5, -1.0, 2.0], [1.0, 3.0, -0.25]
    r = one(spark, "a array<float>, b array<float>", (a, b), V.dot(F.col("a"), F.col("b")), V.negative_l2(F.col("a"), F.col("b")), V.norm(F.col("a")))
    assert r.c0 == pytest.approx(np.dot(a, b)) and r.c1 == pytest.approx(-np.sum((np.array(a) - b) ** 2)) and r.c2 == pytest.approx(np.linalg.norm(a))


def test_sq8_round_trip_and_constant_row(spark):
    v = [float(x) for x in np.random.default_rng(1).normal(size=20)]
    e = V.sq8_encoded(F.col("v"))
    back = one(spark, "v array<double>", (v,), V.sq8_decoded(e)).c0
    assert np.abs(np.array(back) - v).max() <= (max(v) - min(v)) / 255 / 2 + 1e-9
    assert one(spark, "v array<double>", ([0.3, 0.3],), V.sq8_codes(F.col("v"))).c0 == [0, 0]


def test_bits_are_padded_and_hamming_counts(spark):
    v, w = [1.0] + [-1.0] * 69, [1.0] * 70
    r = one(spark, "v array<double>, w array<double>", (v, w), V.bit_words(F.col("v")), V.hamming(V.bit_words(F.col("v")), V.bit_words(F.col("w"))))
    assert r.c0 == [-(2**63), 0] and r.c1 == 69


def test_partition_bytes(spark):
    assert one(spark, "n long, d int", (10, 0), V.partition_bytes(F.col("n"), F.col("d"))).c0 == int(10 * 1 * 4 * 1.5) + (1 << 20)
