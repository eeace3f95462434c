"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text's words are hashed; k = 5 consecutive words are a k-mer, 2 consecutive words an
inner substring. A k-mer is a closed syncmer, an anchor, if the smallest hash among its
four inner substrings is that of the first or the last. That depends on the k-mer alone,
not on its surroundings: the same passage has the same anchors in any document, whatever
stands around it, and of the k-mers of running text about every second is one.

A fingerprint holds all distinct anchors of a text with their places: sorted numbers of 64
bits, 31 for the hash and 32 for the first word's number at the hash's first occurrence.
Two texts are compared by position: an anchor that both have lies on a diagonal, the
difference of its places. It counts if another one lies on the same diagonal (or if a text
has one anchor only), so hashes that agree by chance don't count. Likeness is what counts
over all distinct anchors of both. `matches` gives the passages themselves.

Scale. Everything is an array expression within the row. Texts are shuffled once, into
ranges of ids; the next document of each is the next row of its range, and the first row of
a range goes to the end of the range before it too. The bounds of the ranges are found from
ids and lengths; their number grows with the text, one for `RANGE_CHARS` characters.

Cases. Null text counts as empty. A text of fewer than five words has one anchor, all
its words; a longer one without a syncmer has its k-mer of the smallest hash; one without
words has none, and two such fingerprints have likeness 1. Rows
that repeat an id are ordered by a hash of their text; rows that repeat both count as one
in the order and each give a row. Null ids come first. A table of one text has itself as
the next. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared, text_or_empty

K, INNER = 5, 2
RANGE_CHARS = 16_000_000
_LOW = (1 << 32) - 1


def _pairs(a: Column, shift: int, f) -> Column:
    """f(a[i], a[i + shift]) for all i that have both."""
    n = F.greatest(F.size(a) - shift, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + shift), n), f)


def _smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _shift(x: Column, n: int) -> Column:
    return F.call_function("shiftleft", x, F.lit(n))


def _high(x: Column) -> Column:
    return F.shiftright(x, 32)


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW))


def _packed(hash_: Column, at: Column) -> Column:
    return _shift(hash_.bitwiseAND(F.lit(0x7FFFFFFF)).cast("long"), 32).bitwiseOR(at.cast("long"))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with array<bigint>: the anchors of column `text` in text order, hash and place (the k-mer's first word) in one number."""
    w, s, m, e, h, c = (f"__{out}_{x}" for x in ("words", "inner", "least", "ends", "kmers", "chosen"))
    rows = df.withColumn(w, F.transform(F.filter(F.split(F.lower(F.col(text)), r"\s+", -1), lambda x: x != ""), lambda x: F.xxhash64(x)))
    long_enough = F.size(w) >= K
    word = F.col(w)
    rows = rows.withColumn(s, F.when(long_enough, _pairs(word, INNER - 1, lambda a, b: F.xxhash64(a, b))))
    inner = F.col(s)
    rows = rows.withColumn(m, _pairs(_pairs(inner, 1, _smaller), 2, _smaller))
    rows = rows.withColumn(e, _pairs(inner, K - INNER, _smaller))
    rows = rows.withColumn(h, F.zip_with(_pairs(inner, 2, lambda a, b: F.xxhash64(a, b)), F.slice(word, F.lit(K), F.size(word) - (K - 1)), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.hash(a, b))))
    ends = F.zip_with(F.zip_with(F.col(m), F.col(e), lambda a, b: a == b), F.col(h), lambda a, b: F.when(a, b))
    rows = rows.withColumn(c, F.filter(F.transform(ends, _packed), lambda x: x.isNotNull()))
    whole = F.array(_packed(F.hash(F.array_join(F.transform(word, lambda x: x.cast("string")), " ")), F.lit(0)))
    # Few k-mers may have no syncmer among them: the one with the smallest hash stands for them.
    least = F.array(F.array_min(F.transform(F.filter(F.col(h), lambda x: x.isNotNull()), _packed)))
    rows = rows.withColumn(out, F.when(long_enough & (F.size(c) > 0), F.col(c)).when(long_enough, least).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>")))
    return rows.drop(w, s, m, e, h, c)


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the fingerprint of column `text`: its anchors sorted, each hash once with its first place."""
    every = f"__{out}_anchors"
    rows = with_anchors(df, text, every).withColumn(every, F.sort_array(every))
    new = _pairs(F.col(every), 1, lambda a, b: F.when(_high(a) != _high(b), b))
    return rows.withColumn(out, F.concat(F.slice(every, F.lit(1), F.lit(1)), F.filter(new, lambda x: x.isNotNull()))).drop(every)


def _common(a: Column, b: Column) -> Column:
    """The anchors that two fingerprints share, sorted: diagonal (place in b less place in a) and place in a, in one number."""
    tagged = lambda x, tag: F.transform(x, lambda v: _shift(_high(v), 33).bitwiseOR(F.lit(tag << 32)).bitwiseOR(_low(v)))
    both = F.sort_array(F.concat(tagged(a, 0), tagged(b, 1)))
    met = _pairs(both, 1, lambda x, y: F.when(F.shiftright(x, 33) == F.shiftright(y, 33), _shift(_low(y) - _low(x), 32).bitwiseOR(_low(x))))
    return F.sort_array(F.filter(met, lambda x: x.isNotNull()))


def with_common(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with the shared anchors of two fingerprints that aren't alone on their diagonal, as _common gives them."""
    every, same = f"__{out}_common", f"__{out}_same"
    rows = df.withColumn(every, _common(F.col(a), F.col(b)))
    rows = rows.withColumn(same, _pairs(F.col(every), 1, lambda x, y: _high(x) == _high(y)))
    no = F.array(F.lit(False))
    beside = F.zip_with(F.concat(no, F.col(same)), F.concat(F.col(same), no), lambda x, y: x | y)
    few = F.least(F.size(a), F.size(b)) <= 1
    held = F.filter(F.zip_with(F.col(every), beside, lambda x, ok: F.when(ok | few, x)), lambda x: x.isNotNull())
    return rows.withColumn(out, F.when(F.size(every) > 0, held).otherwise(F.col(every))).drop(every, same)


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with the likeness of two fingerprints, 0 to 1; 1 for two empty ones."""
    shared_ = f"__{out}_shared"
    rows = with_common(df, a, b, shared_)
    n = F.size(shared_)
    alike = F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(n / F.greatest(F.size(a) + F.size(b) - n, F.lit(1)))
    return rows.withColumn(out, alike).drop(shared_)


def as_text(sketch: Column) -> Column:
    """Eight hex digits of hash and eight of place for each anchor."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def anchors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, anchors array<struct<at, hash>>): all anchors in text order."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    each = F.transform("anchors", lambda x: F.struct(_low(x).cast("int").alias("at"), _high(x).cast("int").alias("hash")))
    return with_anchors(rows, "text", "anchors").select("doc_id", each.alias("anchors"))


def matches(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with column passages, array<struct<a, b, words>>: what the texts of columns a and b share, by the first words' places and the length in words."""
    rows = with_common(with_sketch(with_sketch(pairs, a, "__a"), b, "__b"), "__a", "__b", "__met")
    kind = "array<struct<a:int,b:int,words:int>>"
    # Anchors on one diagonal whose k-mers overlap or touch are one passage.
    state = lambda done, diagonal, start, end: F.struct(done.alias("done"), diagonal.alias("diagonal"), start.alias("start"), end.alias("end"))
    flush = lambda s: F.when(s["end"] > 0, F.concat(s["done"], F.array(F.struct(s["start"].cast("int").alias("a"), (s["start"] + s["diagonal"]).cast("int").alias("b"), (s["end"] - s["start"]).cast("int").alias("words"))))).otherwise(s["done"])
    zero = F.lit(0).cast("long")
    found = F.aggregate(
        "__met",
        state(F.array().cast(kind), zero, zero, zero),
        lambda s, x: F.when((s["end"] > 0) & (_high(x) == s["diagonal"]) & (_low(x) <= s["end"]), state(s["done"], s["diagonal"], s["start"], _low(x) + K)).otherwise(state(flush(s), _high(x), _low(x), _low(x) + K)),
        flush,
    )
    return rows.withColumn("passages", found).drop("__a", "__b", "__met")


def _in_ranges(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, rh, text) with copies, part and ghost: ranges of (doc_id, rh), each followed by a ghost of the row that comes next. Rows that repeat both stand once."""
    spark = rows.sparkSession
    keys = shared(rows.select("doc_id", "rh", F.char_length("text").alias("n")).groupBy("doc_id", "rh").agg(F.max("n").alias("n"), F.count("*").alias("copies")))
    total = keys.agg(F.sum("n").alias("chars"), F.max("copies").alias("copies")).first()
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total.chars or 0) // RANGE_CHARS))
    me = F.struct("doc_id", "rh")
    # Several ranges for each task, so that they fill tasks evenly. One row for each range comes to the driver.
    cut = keys.select("doc_id", "rh").repartitionByRange(4 * n_tasks, "doc_id", "rh")
    bounds = cut.groupBy(F.spark_partition_id().alias("p")).agg(F.min(me).alias("low")).agg(F.array_sort(F.collect_list("low")).alias("lows"))
    bounds = spark.createDataFrame(bounds.collect(), bounds.schema)
    step = F.ceil(F.sqrt(F.size("lows"))).cast("int")
    bounds = bounds.select("lows", F.size("lows").alias("m"), step.alias("step"))
    bounds = bounds.select("*", F.filter("lows", lambda x, i: i % F.col("step") == 0).alias("coarse"))
    if total.copies and total.copies > 1:
        rows = rows.groupBy("doc_id", "rh").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    rows = rows.crossJoin(F.broadcast(bounds))
    reached = lambda lows: F.size(F.filter(lows, lambda x: x <= me))
    rows = rows.withColumn("c", (reached(F.col("coarse")) - 1) * F.col("step"))
    rows = rows.withColumn("part", F.col("c") + reached(F.slice("lows", F.col("c") + 1, F.col("step"))) - 1)
    place = lambda part, ghost: F.struct(part.cast("int").alias("part"), F.lit(ghost).alias("ghost"))
    own, before = place(F.col("part"), False), place((F.col("part") + F.col("m") - 1) % F.col("m"), True)
    rows = rows.withColumn("x", F.explode(F.when(F.get("lows", F.col("part")).eqNullSafe(me), F.array(own, before)).otherwise(F.array(own))))
    return rows.select("doc_id", "rh", "text", "copies", "x.part", "x.ghost").repartition(n_tasks, "part")


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, sketch, edited_sketch, near_edited, near_next) of each row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("rh", F.xxhash64("text"))
    rows = with_sketch(_in_ranges(rows), "text", "sketch")
    w = Window.partitionBy("part").orderBy("ghost", "doc_id", "rh")
    rows = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_sketch", F.lead("sketch").over(w)).where(~F.col("ghost"))
    rows = rows.withColumn("n_chars", F.char_length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = with_sketch(rows, "edited", "edited_sketch")
    rows = with_likeness(with_likeness(rows, "sketch", "edited_sketch", "near_edited"), "sketch", "next_sketch", "near_next")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited", "sketch", "edited_sketch", "near_edited", "near_next")
