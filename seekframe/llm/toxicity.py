"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (hashed to `BUCKETS`) and of
itself, so a misspelling not seen in training shares most of its vector with the word it
comes from. The words of a window of `WINDOW` words, wherever it starts, are averaged, and a linear softmax
over (clean, toxic) reads the average. A text's logit is that of its most toxic window:
one sentence counts as much in a long text as in a short one. Vectors and softmax are
trained jointly in numpy: first all windows carry their text's label, then only the
window that decides. Both classes weigh the same.

The softmax is linear in the average, so once trained each n-gram needs one number, each
word the mean of its n-grams' numbers (kept in a bounded cache), and each window a mean.

Training uses at most `train_docs` labelled rows of each class: those with the smallest
hash of their id, a sample that doesn't depend on order or partitions, and of these the
first whose texts have `TRAIN_CHARS` characters together. Only their texts come to the
driver. Scoring reads whole texts, whatever their length.

Cases. Null text counts as empty; an empty text scores by the bias alone, like a text of
words without any known n-gram. Rows that repeat each give a row; if texts share a labelled
id, the smallest text is trained on. An id with two labels counts as toxic. Labels of ids
without a document, null labels, and a table without labels of both classes are borne: then
every score is 0. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let_go, narrow, shared

BUCKETS, DIM, WINDOW = 1 << 16, 8, 4
NGRAMS = (3, 4, 5)
TRAIN_DOCS, TRAIN_CHARS = 1500, 60_000_000
#: Windows of a text that a run of REFRESH steps looks at.
ACTIVE, REFRESH = 4, 12
#: Lengths of steps, each tried if the one before gives scores that are further than FITTED from the labels.
SHORTER, FITTED = (1.0, 0.3, 0.1), 0.1
CACHE_LIMIT = 300_000
#: Runs of more characters than STRETCH (words glued together, scripts without spaces) score as their most toxic stretch.
STRETCH = 64
ROWS = 500
_WORD = re.compile(r"\w+")


def ngram_ids(word: str) -> list[int]:
    w = f"<{word}>".encode()
    grams = {w[i : i + n] for n in NGRAMS for i in range(len(w) - n + 1)}
    grams.add(w)
    return sorted({zlib.crc32(g) & (BUCKETS - 1) for g in grams})


@dataclass
class Model:
    """One number for each n-gram bucket (its vector along the softmax), and the bias."""

    weight: np.ndarray
    bias: float

    def word_scores(self) -> "WordScores":
        return WordScores(self)


class WordScores(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.weight = model.weight

    def __missing__(self, word: str) -> float:
        if len(word) > STRETCH:
            # Not kept. Stretches overlap by half.
            return max(float(self.weight[ngram_ids(word[i : i + STRETCH])].mean()) for i in range(0, len(word) - STRETCH // 2, STRETCH // 2))
        if len(self) > CACHE_LIMIT:
            self.clear()
        ids = ngram_ids(word)
        self[word] = v = float(self.weight[ids].mean())
        return v


def window_sums(values: np.ndarray) -> np.ndarray:
    """Sums over all runs of WINDOW values; over all of them if there are fewer."""
    if len(values) <= WINDOW:
        return values.sum(keepdims=True)
    until = np.concatenate(([0.0], np.cumsum(values)))
    return until[WINDOW:] - until[:-WINDOW]


def score_text(text: str, bias: float, words: WordScores) -> float:
    found = _WORD.findall(text.lower())
    if not found:
        z = bias
    else:
        values = np.fromiter(map(words.__getitem__, found), dtype=np.float64, count=len(found))
        # Fewer words than a window are averaged over half a window at least, so one or two don't decide alone.
        z = bias + float(window_sums(values).max()) / max(min(WINDOW, len(found)), WINDOW // 2)
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def fit(texts: list[str], labels: list[int], rounds: int = 240, rate: float = 1.0, decay: float = 0.0003, seed: int = 7) -> Model:
    """Joint training of n-gram vectors and softmax; full batches, fixed seed.

    With few texts, steps may be so long that training never settles and rounding decides its end. A model that misses its
    own texts by more than FITTED is trained anew with shorter steps; of all the one that misses them least is returned.
    """
    best = None
    for share in SHORTER:
        model, missed = _fit(texts, labels, rounds, rate * share, decay, seed)
        if best is None or missed < best[1]:
            best = model, missed
        if missed <= FITTED:
            break
    return best[0]


def _fit(texts: list[str], labels: list[int], rounds: int, rate: float, decay: float, seed: int) -> tuple[Model, float]:
    """The model of one training, and how far its scores of the texts are from the labels, on average with both classes weighing the same."""
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), -math.inf), 0.0
    vocabulary: dict[str, int] = {}
    tokens, starts, window_doc = array("i"), array("i"), array("i")
    for d, t in enumerate(texts):
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in _WORD.findall(t.lower())]
        if ids:
            n = max(len(ids) - WINDOW + 1, 1)
            starts.extend(range(len(tokens), len(tokens) + n))
            window_doc.extend([d] * n)
            tokens.extend(ids)
            # Texts of fewer words than a window are filled up with a word that is none.
            tokens.extend([-1] * (WINDOW - len(ids)))
    if not tokens:
        return Model(np.zeros(BUCKETS), -math.inf), 0.0
    flat, counts = array("i"), array("i")
    for w in vocabulary:
        g = ngram_ids(w)
        flat.extend(g)
        counts.append(len(g))
    tokens_, starts_, doc_of = (np.frombuffer(x, dtype=np.int32) for x in (tokens, starts, window_doc))
    within = tokens_[starts_[:, None] + np.arange(WINDOW, dtype=np.int32)]
    sizes = np.maximum((within >= 0).sum(axis=1), WINDOW // 2).astype(np.float64)
    gram, n_grams_int = np.frombuffer(flat, dtype=np.int32), np.frombuffer(counts, dtype=np.int32)
    n_grams = n_grams_int.astype(np.float64)
    gram_starts = np.concatenate(([0], np.cumsum(n_grams_int)[:-1]))
    class_weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())

    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM))
    softmax = rng.normal(0, 0.1, (2, DIM))
    bias = np.zeros(2)
    seen = [0.0, 0.0, 0.0]
    per_doc_windows = np.bincount(doc_of, minlength=len(y))
    # doc_of ascends: where each text's windows start.
    doc_starts = np.unique(doc_of, return_index=True)[1]
    n_words = len(vocabulary)

    def forward(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
        word = np.add.reduceat((vectors @ (softmax[1] - softmax[0]))[gram], gram_starts) / n_grams
        word = np.append(word, 0.0)  # the word that is none
        z = word[rows[:, 0]].copy()
        for i in range(1, WINDOW):
            z += word[rows[:, i]]
        return bias[1] - bias[0] + z / size

    def step(delta: np.ndarray, rows: np.ndarray, size: np.ndarray, rate: float) -> None:
        share = delta / size
        by_word = sum(np.bincount(np.where(rows[:, i] < 0, n_words, rows[:, i]), weights=share, minlength=n_words + 1) for i in range(WINDOW))[:n_words] / n_grams
        by_gram = np.bincount(gram, weights=np.repeat(by_word, n_grams_int), minlength=BUCKETS)
        grad_s = by_gram @ vectors
        grads = (by_gram[:, None] * (softmax[1] - softmax[0]), np.stack([-grad_s, grad_s]), np.array([-delta.sum(), delta.sum()]))
        # A step is as long as `rate` for the largest entry of each parameter; frequent n-grams move further than rare ones.
        for i, (value, grad) in enumerate(zip((vectors, softmax, bias), grads)):
            seen[i] = max(0.9 * seen[i], float(np.abs(grad).max()), 1e-12)
            value *= 1 - decay
            value -= rate * grad / seen[i]

    def error(z: np.ndarray, docs: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[docs]) * class_weight[docs]

    def first_best(z: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Of each text's windows (begin: where they start) the first with the highest z; none if all are out."""
        most = np.maximum.reduceat(z, begin)
        of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(z))))
        at = np.flatnonzero((z == most[of]) & (z > -np.inf))
        return at[np.unique(of[at], return_index=True)[1]]

    # Few texts need more of these steps to tell which windows decide.
    for _ in range(min(max(30_000 // len(texts), 15), 150)):
        z = forward(within, sizes)
        step(error(z, doc_of) / per_doc_windows[doc_of], within, sizes, rate)
    for left in range(rounds, 0, -REFRESH):
        # Of each text, windows that may decide in the next steps and don't overlap; found anew from all its windows.
        z = forward(within, sizes)
        active = []
        for _ in range(ACTIVE):
            active.append(first_best(z, doc_starts))
            near = (active[-1][:, None] + np.arange(1 - WINDOW, WINDOW)).clip(0, len(z) - 1)
            z[near[doc_of[near] == doc_of[active[-1]][:, None]]] = -np.inf
        at = np.sort(np.concatenate(active))
        rows, docs, size = within[at], doc_of[at], sizes[at]
        begin = np.unique(docs, return_index=True)[1]
        for _ in range(min(left, REFRESH)):
            z = forward(rows, size)
            top = first_best(z, begin)
            delta = np.zeros(len(z))
            delta[top] = error(z[top], docs[top])
            step(delta, rows, size, rate * left / rounds)
    z = forward(within, sizes)
    top = first_best(z, doc_starts)
    missed = float(np.abs(error(z[top], doc_of[top])).sum())
    weight = vectors @ (softmax[1] - softmax[0])
    weight[np.setdiff1d(np.arange(BUCKETS), gram)] = 0.0
    return Model(weight, float(bias[1] - bias[0])), missed


def held_out(id_col: Column) -> Column:
    """True for the third of ids that training never sees."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(df: DataFrame, labels: DataFrame, label_col: str = "toxic", train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of at most train_docs labelled documents of each class, none of them held out."""
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    picked = [r for c in (0, 1) for r in known.where(F.col("y") == c).orderBy("h", "doc_id").limit(train_docs).collect()]
    if not picked:
        return fit([], [])
    spark = df.sparkSession
    small = F.broadcast(spark.createDataFrame([(r.doc_id, r.y) for r in picked], f"doc_id {known.schema['doc_id'].dataType.simpleString()}, y int"))
    rows = shared(narrow(df, id_col, text_col).join(small, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")))
    # Classes alternate, so both keep their share if long texts use the characters up.
    order = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chars = 0
    wanted = []
    for r in sorted(rows.select("doc_id", "y", F.char_length("text").alias("n"), order.alias("place")).collect(), key=lambda r: (r.place, r.y)):
        if wanted and chars + r.n > TRAIN_CHARS:
            continue
        chars += r.n
        wanted.append(r.doc_id)
    texts = sorted(rows.where(F.col("doc_id").isin(wanted)).collect(), key=lambda r: r.doc_id)
    return fit([r.text for r in texts], [r.y for r in texts])


def score(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """df with the probability that its text is toxic."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go("toxicity")
        words = model.word_scores()
        for texts in batches:
            # Some texts at a time stand beside the batch.
            parts = (texts.slice(at, ROWS).to_pylist() for at in range(0, len(texts), ROWS))
            yield pa.array([score_text(t or "", model.bias, words) for part in parts for t in part], pa.float64())

    return df.withColumn(out, run(F.col(f"`{text_col}`").cast("string")))
