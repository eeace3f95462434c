"""Removal of repeated passages by hashing normalised units.

A text's units are its lines, cut further behind a full stop, question or exclamation
mark and before any capital that follows a space, so a passage pasted into the middle of a
sentence still consists of whole units. (In scripts that write every noun with a capital
units are short; what they are joined to again is decided by the runs below.) A unit is
normalised (lower case, single spaces) and hashed to 96 bits. Over all documents the earliest occurrence of each digest stays, ranked by
doc_id, then by a hash of the text, then by position; all others are repeats. With
`whole_lines`, repeated lines go whatever their length. Of repeated sentences within lines
a document loses runs that have at least `min_words` words together; shorter runs are
chance repeats of short sentences and stay. Removed spans keep their offsets in the
original text, in code points.

Scale. Units are found and hashed in Arrow batches, a text at a time. Digests are counted
with map-side combining, so a line in a third of all documents is one row from each task;
only digests that occur twice are joined back, and Spark may split the large side of that
join, a skewed key included. The list of a document's repeated units is no longer than the
document.

Cases. Null text counts as empty. Rows that repeat an id and a text have the same rank:
they are treated alike, and don't count as each other's repeats. Null ids rank first.
Blank lines belong to no unit and don't end a run. Other columns, whatever their names,
come through unchanged. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let_go, shared, text_or_empty

MIN_WORDS = 8
#: A unit counts as a word for each so many characters at least.
WORD_CHARS = 10
#: Letters of scripts without spaces: two of them count as a word.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
FLUSH = 200_000


@lru_cache(maxsize=1)
def _cuts() -> re.Pattern:
    """What stands before the start of a unit within a line."""
    capitals = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c)) == "Lu":
            if capitals and capitals[-1][1] == c - 1:
                capitals[-1][1] = c
            else:
                capitals.append([c, c])
    return re.compile(r"[.!?]\s(?=\S)|[ \t](?=[%s])" % "".join(f"{chr(a)}-{chr(b)}" for a, b in capitals))


def _words(unit: str, spaced: bool) -> int:
    n = max(unit.count(" ") + 1, len(unit) // WORD_CHARS)
    return n if spaced else max(n, len(UNSPACED.findall(unit)) // 2)


def units_of(text: str) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(unit, at, words, upto, start, end) of the units that aren't blank, counted by `at`; and of lines of several units, with 0 words.

    `upto` is the last unit of what is a whole line, else -1; start and end are code points.
    """
    cuts, spaced = _cuts().finditer, UNSPACED.search(text) is None
    at = begin = 0
    while begin < len(text):
        stop = text.find("\n", begin) + 1 or len(text)
        own, first = [], at
        low = begin
        for end in [*(m.end() for m in cuts(text, begin, stop)), stop]:
            unit = " ".join(text[low:end].lower().split())
            if unit:
                own.append((unit, at, _words(unit, spaced), -1, low, end))
                at += 1
            low = end
        if len(own) == 1:
            yield (*own[0][:3], first, *own[0][4:])
        elif own:
            yield " ".join([u[0] for u in own]), first, 0, at - 1, own[0][4], own[-1][5]
            yield from own
        begin = stop


def units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rh, h1, h2, at, words, more, start, length): the units of each text, as in units_of, by their digests; rh is a hash of the text.

    `more` is how many units follow in what is a whole line, else -1. All are small numbers, which shuffles compress.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        let_go("substring_dedup")
        for b in batches:
            rows, hashes, numbers = [], [], []

            def out(b=b) -> pa.RecordBatch:
                place = pa.array(rows, pa.int64())
                h = np.frombuffer(b"".join(hashes), dtype=np.int32).reshape(-1, 4)
                at, words, upto, start, end = np.array(numbers, dtype=np.int32).reshape(-1, 5).T
                columns = (h[:, :2].copy().view(np.int64).ravel(), h[:, 2], at, words, np.where(upto >= 0, upto - at, -1), start, end - start)
                return pa.RecordBatch.from_arrays([b.column(0).take(place), b.column(1).take(place), *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=["doc_id", "rh", "h1", "h2", "at", "words", "more", "start", "length"])

            for row, t in enumerate(b.column(2)):
                for unit, *place in units_of(t.as_py()):
                    rows.append(row)
                    hashes.append(digest(unit.encode()))
                    numbers.append(place)
                if len(rows) > FLUSH:
                    yield out()
                    rows, hashes, numbers = [], [], []
            if rows:
                yield out()

    text = text_or_empty(text_col)
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("rh"), text.alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, rh long, h1 long, h2 int, at int, words int, more int, start int, length int")


_RUN = "array<struct<first:int,last:int,start:int,end:int>>"


def _run(x: Column) -> Column:
    return F.struct(*(x[n].alias(n) for n in ("first", "last", "start", "end")))


def _runs(listed: Column, min_words: int) -> Column:
    """Of the sorted (at, words, more, start, end) of a document: the runs of consecutive units with enough words."""
    state = lambda runs, first, last, words, start, end: F.struct(runs.alias("runs"), first.alias("first"), last.alias("last"), words.alias("words"), start.alias("start"), end.alias("end"))
    flush = lambda a: F.when(a["words"] >= min_words, F.concat(a["runs"], F.array(_run(a)))).otherwise(a["runs"])
    none = F.lit(-2)
    return F.aggregate(
        listed,
        state(F.array().cast(_RUN), none, none, F.lit(0), none, none),
        lambda a, x: F.when(x["at"] == a["last"] + 1, state(a["runs"], a["first"], x["at"], a["words"] + x["words"], a["start"], x["end"])).otherwise(state(flush(a), x["at"], x["at"], x["words"], x["start"], x["end"])),
        flush,
    )


def _merged(runs: Column) -> Column:
    """Runs of units, sorted, those that overlap or touch as one."""
    state = lambda out, first, last, start, end: F.struct(out.alias("out"), first.alias("first"), last.alias("last"), start.alias("start"), end.alias("end"))
    flush = lambda a: F.when(a["first"] >= 0, F.concat(a["out"], F.array(_run(a)))).otherwise(a["out"])
    none = F.lit(-2)
    return F.aggregate(
        F.sort_array(runs),
        state(F.array().cast(_RUN), none, none, none, none),
        lambda a, x: F.when(x["first"] <= a["last"] + 1, state(a["out"], a["first"], F.greatest(a["last"], x["last"]), a["start"], F.greatest(a["end"], x["end"]))).otherwise(state(flush(a), x["first"], x["last"], x["start"], x["end"])),
        flush,
    )


def repeats(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", whole_lines: bool = False) -> DataFrame:
    """(doc_id, rh, runs): of each distinct document the runs of units that go, if any, with their places (start, end) in the text."""
    all_units = units(df, id_col, text_col)
    if not whole_lines:
        all_units = all_units.where("words > 0").withColumn("more", F.lit(-1))
    place = F.struct("doc_id", "rh", "at")
    # Written out, so that the join below shuffles two sides of its own and Spark can split a hot digest's partition.
    first = all_units.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.min(F.when(F.col("more") >= 0, place)).alias("first_line"))
    first = shared(first.where("n > 1").select("h1", "h2", "first", "first_line"))
    later = all_units.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    # What was only a part of lines so far isn't a repeated line.
    later = later.withColumn("more", F.when(place.eqNullSafe(F.col("first_line")), -1).otherwise(F.col("more"))).where("words > 0 or more >= 0")
    later = later.groupBy("doc_id", "rh").agg(F.sort_array(F.collect_set(F.struct("at", "words", "more", "start", "length"))).alias("listed"))
    listed = F.transform("listed", lambda x: F.struct(x["at"].alias("at"), x["words"].alias("words"), x["more"].alias("more"), x["start"].alias("start"), (x["start"] + x["length"]).alias("end")))
    later = later.withColumn("listed", listed)
    lines = F.transform(F.filter("listed", lambda x: x["more"] >= 0), lambda x: F.struct(x["at"].alias("first"), (x["at"] + x["more"]).alias("last"), x["start"].alias("start"), x["end"].alias("end")))
    runs = _runs(F.filter("listed", lambda x: x["words"] > 0), min_words)
    return later.select("doc_id", "rh", _merged(F.concat(runs, lines)).alias("runs")).where(F.size("runs") > 0)


def remove(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = "removed", whole_lines: bool = False) -> DataFrame:
    """df with its repeated passages gone from text_col, and their original (start, end) in spans_col (None: not kept)."""
    found = repeats(df, min_words, id_col, text_col, whole_lines)
    # The whole row goes in one column, so no name of df can meet one of these, and its text is shuffled once.
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_or_empty(text_col)).alias("h"))
    rows = rows.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("rh")), "left")
    text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    spans = F.transform("runs", lambda r: F.struct(r["start"].cast("long").alias("start"), r["end"].cast("long").alias("end")))
    rows = rows.withColumn("spans", F.coalesce(spans, F.array().cast("array<struct<start:bigint,end:bigint>>")))
    cuts = F.arrays_zip(F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"])).alias("a"), F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.char_length(text).cast("long"))).alias("b"))
    kept = F.array_join(F.transform(cuts, lambda c: F.substring(text, (c["a"] + 1).cast("int"), (c["b"] - c["a"]).cast("int"))), "")
    new = F.when(F.size("spans") > 0, kept).otherwise(F.col("row").getField(text_col))
    extra = [F.col("spans").alias(spans_col)] if spans_col else []
    return rows.select(*((new if c == text_col else F.col("row").getField(c)).alias(c) for c in df.columns), *extra)
