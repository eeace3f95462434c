"""Text expressions: tokens, query keys, passages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9; any other character, accented letters too, ends a token."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def query_key(text: Column) -> Column:
    """What makes two query texts equal: lower case, single spaces, no spaces at the ends; any Unicode white space counts."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def passage(title: Column, text: Column) -> Column:
    """Title and text as one passage for lexical search and reranking, stripped."""
    return F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))


def passage_to_embed(title: Column, text: Column) -> Column:
    """As passage(), but without a title the text stays as it is, spaces at its ends too."""
    return F.when(F.coalesce(title, F.lit("")) != "", passage(title, text)).otherwise(F.coalesce(text, F.lit("")))


def cut_for_rerank(text: Column, max_length: int = 256) -> Column:
    """At most four characters for each token that a scorer reads."""
    return F.substring(text, 1, 4 * max_length)
