"""Masked pseudo-likelihood of documents by a bidirectional window network and the corpus' own windows.

Every word is predicted from its two neighbours. The network: the vectors of the left and of
the right neighbour's class are added, go through tanh, and a softmax gives the class of the
hidden word, times the word's share of its class. The corpus: of all windows with these two
neighbours, how many have this word between them, the predicted occurrence itself left out.
Both make one probability, with the network as the prior of the windows' shares:

    P(word | left, right) = (n(left, word, right) - 1 + PRIOR * P_network) / (n(left, right) - 1 + PRIOR)

The sum of its logarithms over all words of a text is the text's score. A text that stands
twice in the corpus is predicted by its other copy.

Training sees all windows of all documents. Words are counted over the corpus; the
`VOCABULARY` most frequent have classes. Those of the first `CLUSTERED` are learned, by
k-means over how often the most frequent words stand left and right of them; the others'
are bands of frequency. All other words are one class, in which each has the share that its
count over the corpus gives it. As the network sees classes of neighbours, the counts of
(left, right, middle) classes over the whole corpus are all it needs: at most CLASSES**3
numbers, on which it is trained in numpy on the driver, full batches with a fixed seed.

Scale. Texts are split twice, once to count words and once into chunks of word numbers,
which are written to the shared folder; all further passes read chunks. Each chunk sends
every distinct window (and rarer word) once, with its count, as sorted numbers (whose bits grow with the corpus) in about
as many buckets as hold `BUCKET_KEYS`; a bucket adds up and sends the sums back to the
chunk. So a window that stands in a third of all documents is one number from each chunk.
Two neighbours that are both among the `HOT` most frequent words have many different words
between them: their windows are spread over all buckets, and their own count comes from a
small table. The windows' and the words' counts grow with the corpus; what reaches the
driver (vocabulary, class counts) and what is sent to the executors has a fixed bound.

Cases. Null text counts as empty: no words, sum 0, mean and perplexity null. Rows that
repeat each count and each give a row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, shared, stored, words_of

VOCABULARY, CLASSES, BANDS, HIDDEN = 32_768, 96, 24, 48
CLUSTERED, HOT = 8192, 64
CHUNK_DOCS, CHUNK_WORDS, BUCKET_KEYS = 4096, 1_000_000, 2_000_000
#: How many windows the network's opinion is worth.
PRIOR = 2.0
FLUSH = 200_000
#: Numbers of classes. As a word's number, RARE_WORD stands for all words without one.
EDGE, RARE = 0, 1
RARE_WORD = 65_535
#: Of a window's key the bits for the word; the bits for its neighbours beyond those that count the corpus' words (one pair in 2**SPARE_BITS meets another), and how many these are at least.
WORD_BITS, SPARE_BITS, LEAST_BITS, RARE_BITS = 20, 10, 36, 48


def word_counts(rows: DataFrame) -> DataFrame:
    """(word binary, n): how often each word occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.binary()), pa.array(count.values(), pa.int64())], names=["word", "n"])

        count: Counter = Counter()
        for b in batches:
            for t in b.column(1).cast(pa.binary()):
                count.update(words_of(t.as_py()))
                if len(count) > FLUSH:
                    yield out()
                    count.clear()
        yield out()

    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent words, numbered by frequency; classes are set by learn_classes."""

    words: list[bytes]
    counts: np.ndarray
    n_words: int  # of the whole corpus
    class_of: np.ndarray  # by number; one more for all other words
    log_share: np.ndarray  # log of the share of its class; 0 for other words, whose share comes from the corpus

    @property
    def n_rare(self) -> int:
        return self.n_words - int(self.counts.sum())

    def with_classes(self, class_of: np.ndarray) -> "Vocabulary":
        total = np.bincount(class_of, weights=self.counts, minlength=1)
        share = np.log(self.counts / total[class_of]) if len(class_of) else np.empty(0)
        return Vocabulary(self.words, self.counts, self.n_words, np.append(class_of, RARE), np.append(share, 0.0))


def vocabulary(counts: DataFrame, size: int = VOCABULARY) -> Vocabulary:
    """The most frequent words. Which words can be among them is found from a histogram of counts first, so no task sends more than those."""
    if size >= RARE_WORD:
        raise ValueError(f"at most {RARE_WORD - 1} words have numbers")
    level = F.floor(F.log2("n") * 8).cast("int")
    seen, least, n_words = 0, None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("types"), F.sum("n").alias("n")).collect(), key=lambda r: -r.level):
        n_words += r.n
        if seen < size:
            least = r.level
        seen += r.types
    top = counts.where(level >= F.lit(least if least is not None else 0)).orderBy(F.desc("n"), "word").limit(size).collect()
    return Vocabulary([bytes(r.word) for r in top], np.array([r.n for r in top], dtype=np.float64), n_words, np.empty(0, np.int64), np.empty(0))


# ---- chunks ----


def _planes(numbers: np.ndarray) -> bytes:
    """Compressed, byte by byte of equal weight: high bytes are mostly 0."""
    return pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def _numbers(planes: bytes, kind: type, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, dtype=kind)
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(planes, decompressed_size=n * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()


def chunks(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """One row for each run of documents: chunk, ids, ptr (where each text starts), words (n numbers), rare (hashes of the n_rare words without one)."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    words = vocab.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w: i for i, w in enumerate(words)}.get
        digest = xxhash.xxh64_intdigest
        ids, sizes, parts, rare = [], [], [], []

        def out(id_type: pa.DataType) -> pa.RecordBatch:
            ptr = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
            numbers = np.concatenate(parts)
            row = [pa.array([ids], pa.list_(id_type)), *(pa.array([x], pa.binary()) for x in (ptr.tobytes(), _planes(numbers), _planes(np.array(rare, dtype=np.uint64)))), pa.array([len(numbers)]), pa.array([len(rare)])]
            return pa.RecordBatch.from_arrays(row, names=["ids", "ptr", "words", "rare", "n", "n_rare"])

        held = 0
        for b in batches:
            for i, t in zip(b.column(0), b.column(1).cast(pa.binary())):
                text = words_of(t.as_py())
                numbers = np.fromiter((index(w, RARE_WORD) for w in text), dtype=np.uint16, count=len(text))
                rare.extend([digest(text[j]) >> (64 - RARE_BITS) for j in np.flatnonzero(numbers == RARE_WORD).tolist()])
                ids.append(i.as_py())
                sizes.append(len(text))
                parts.append(numbers)
                held += len(text)
                if len(ids) >= CHUNK_DOCS or held >= CHUNK_WORDS:
                    yield out(b.column(0).type)
                    ids, sizes, parts, rare, held = [], [], [], [], 0
        if ids:
            yield out(b.column(0).type)

    made = rows.mapInArrow(run, f"ids array<{kind}>, ptr binary, words binary, rare binary, n long, n_rare long")
    return shared(made.withColumn("chunk", F.monotonically_increasing_id()))


class Chunk:
    """A chunk opened: numbers of words, and of their left and right neighbours (EDGE_WORD at the ends of texts)."""

    EDGE_WORD = RARE_WORD - 1

    def __init__(self, ptr: bytes, words: bytes, rare: bytes, n: int, n_rare: int):
        self.ptr, self.rare = np.frombuffer(ptr, dtype=np.int64), _numbers(rare, np.uint64, n_rare)
        self.words = _numbers(words, np.uint16, n).astype(np.int64)
        self.left, self.right = self.beside(self.words, self.EDGE_WORD)

    def beside(self, of: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(of)
        left, right = np.empty_like(of), np.empty_like(of)
        left[1:], right[:-1] = of[:-1], of[1:]
        starts = self.ptr[self.ptr < n]
        left[starts] = edge
        right[starts - 1] = edge  # the first start is 0, whose -1 is the end of all
        return left, right


_COLUMNS = ("ptr", "words", "rare", "n", "n_rare")


def _sums(parts: DataFrame, size: int, count) -> np.ndarray:
    """The sum over all chunks of count(chunk), which gives cells under `size`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for row in range(b.num_rows):
                total += np.bincount(count(Chunk(*(b.column(c)[row].as_py() for c in range(len(_COLUMNS))))), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    found = parts.select(*_COLUMNS).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


# ---- classes and network ----


def _hot(numbers: np.ndarray, hot: int) -> np.ndarray:
    """0 for a text's end, 1 to hot - 1 for the most frequent words, else -1."""
    return np.where(numbers == Chunk.EDGE_WORD, 0, np.where(numbers < hot - 1, numbers + 1, -1))


def learn_classes(parts: DataFrame, vocab: Vocabulary, classes: int = CLASSES, rounds: int = 15, seed: int = 5) -> Vocabulary:
    """Classes of the CLUSTERED most frequent words by their neighbours; of the others by frequency."""
    n, near = min(len(vocab.words), CLUSTERED), HOT

    def count(c: Chunk) -> np.ndarray:
        own = np.flatnonzero(c.words < n)
        sides = [_hot(x[own], near) for x in (c.left, c.right)]
        return np.concatenate([((c.words[own] * 2 + side) * near + h)[h >= 0] for side, h in enumerate(sides)])

    bands = min(BANDS, max(classes // 4, 1)) if len(vocab.words) > n else 0
    k = max(classes - 2 - bands, 1)
    if not n:
        return vocab.with_classes(np.empty(0, np.int64))
    seen = _sums(parts, n * 2 * near, count).reshape(n, 2 * near)
    # Square roots of shares; what stands beside other words counts as one more place.
    other = np.maximum(vocab.counts[:n, None] - np.stack([seen[:, :near].sum(axis=1), seen[:, near:].sum(axis=1)], axis=1), 0)
    x = np.sqrt(np.concatenate([seen, other], axis=1) / vocab.counts[:n, None])
    weight = np.sqrt(vocab.counts[:n])
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(n, min(k, n), replace=False, p=weight / weight.sum())] if k < n else x
    for _ in range(rounds if k < n else 0):
        own = ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)
        size = np.bincount(own, weights=weight, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x * weight[:, None])
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1e-12)[:, None], centres)
    own = ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)
    rest = np.sqrt(vocab.counts[n:])
    start = np.concatenate(([0.0], np.cumsum(rest)[:-1])) / max(rest.sum(), 1e-9)
    return vocab.with_classes(np.concatenate((2 + own, 2 + k + np.minimum((start * bands).astype(np.int64), bands - 1))) if bands else 2 + own)


def _cells(c: Chunk, class_of: np.ndarray, classes: int) -> np.ndarray:
    """(left, right, middle) of each word's window as one number."""
    own = class_of[np.minimum(c.words, len(class_of) - 1)]
    left, right = c.beside(own, EDGE)
    return (left * classes + right) * classes + own


def fit(counts: np.ndarray, classes: int = CLASSES, hidden: int = HIDDEN, rounds: int = 150, rate: float = 0.02, seed: int = 5) -> np.ndarray:
    """log P(middle | left, right) as [left * classes + right, middle], by the trained network."""
    rng = np.random.default_rng(seed)
    left, right = np.divmod(np.arange(classes * classes), classes)
    p = {
        "left": rng.normal(0, 0.3, (classes, hidden)), "right": rng.normal(0, 0.3, (classes, hidden)), "bias": np.zeros(hidden),
        "out": rng.normal(0, 0.1, (hidden, classes)), "base": np.log((counts.sum(axis=0) + 1) / (counts.sum() + classes)),
    }
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    target = counts / max(counts.sum(), 1.0)
    weight = target.sum(axis=1, keepdims=True)
    for step in range(1, rounds + 1 if counts.any() else 1):
        h = np.tanh(p["left"][left] + p["right"][right] + p["bias"])
        z = h @ p["out"] + p["base"]
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        d = e / e.sum(axis=1, keepdims=True) * weight - target
        back = (d @ p["out"].T) * (1 - h * h)
        by_pair = back.reshape(classes, classes, hidden)
        g = {"out": h.T @ d, "base": d.sum(axis=0), "bias": back.sum(axis=0), "left": by_pair.sum(axis=1), "right": by_pair.sum(axis=0)}
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
            p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
    z = np.tanh(p["left"][left] + p["right"][right] + p["bias"]) @ p["out"] + p["base"]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


@dataclass
class Model:
    """The network's part: what the driver holds and the executors get."""

    vocab: Vocabulary
    table: np.ndarray  # log-probabilities, flat, by window number
    classes: int
    hot: int
    hot_pairs: np.ndarray  # [left * hot + right]: windows between two of the most frequent words

    def network(self, c: Chunk, rare_share: np.ndarray) -> np.ndarray:
        """log P_network of each word of a chunk; rare_share: the share that each word without a number has of all such words."""
        out = self.table[_cells(c, self.vocab.class_of, self.classes)] + self.vocab.log_share[np.minimum(c.words, len(self.vocab.words))]
        out[c.words == RARE_WORD] += np.log(rare_share)
        return out


# ---- windows of words ----


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _keys(c: Chunk, hashes: np.ndarray, hot_words: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(key of each word's window, place in hot_pairs or -1). Keys of windows with the same neighbours share their first bits, but for hot pairs.

    hashes: by number, of the words of the vocabulary, then of a text's end. bits: of a key.
    """
    h = hashes[np.minimum(c.words, len(hashes) - 1)]
    h[c.words == RARE_WORD] = c.rare
    left, right = c.beside(h, 0)
    left[c.left == c.EDGE_WORD] = right[c.right == c.EDGE_WORD] = hashes[-1]
    pair = _mixed(left * np.uint64(0x9E3779B97F4A7C15) + _mixed(right))
    a, b = _hot(c.left, hot_words), _hot(c.right, hot_words)
    hot = np.where((a >= 0) & (b >= 0), a * hot_words + b, -1)
    word = _mixed(pair ^ h)
    pair = np.where(hot >= 0, _mixed(pair + word), pair)
    return (pair >> np.uint64(64 - bits + WORD_BITS) << np.uint64(WORD_BITS)) | (word >> np.uint64(64 - WORD_BITS)), hot


def _own_keys(c: Chunk, hashes: np.ndarray, hot_words: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys of windows and rare words, their counts, the place of each word's window and then of each rare word in them, hot pairs)."""
    windows, hot = _keys(c, hashes, hot_words, bits)
    rare = _mixed(c.rare ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - bits)
    keys, place, n = np.unique(np.concatenate((windows, rare)), return_inverse=True, return_counts=True)
    return keys, n, place, hot


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([*(xxhash.xxh64_intdigest(w) for w in words), xxhash.xxh64_intdigest(b" ")], dtype=np.uint64)


def _bucket_bits(n_words: int) -> int:
    return max(n_words // BUCKET_KEYS, 1).bit_length()


def _key_bits(n_words: int) -> int:
    return min(max(n_words.bit_length() + SPARE_BITS, LEAST_BITS) + WORD_BITS, 64)


def window_sums(parts: DataFrame, model: Model) -> DataFrame:
    """(chunk, sums array<struct<bucket, n, same, pair>>): for each chunk's keys in order, how often they and all keys of their pair occur in the corpus."""
    bits = _key_bits(model.vocab.n_words)
    shift = np.uint64(bits - _bucket_bits(model.vocab.n_words))
    words, hot_words = model.vocab.words, model.hot

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _word_hashes(words)
        for b in batches:
            for row in range(b.num_rows):
                keys, n, _, _ = _own_keys(Chunk(*(b.column(c + 1)[row].as_py() for c in range(len(_COLUMNS)))), hashes, hot_words, bits)
                buckets, starts = np.unique(keys >> shift, return_index=True)
                ends = [*starts[1:].tolist(), len(keys)]
                cut = [(keys[s:e], n[s:e]) for s, e in zip(starts.tolist(), ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets.astype(np.int64)), pa.array(np.full(len(buckets), b.column(0)[row].as_py())), pa.array([len(k) for k, _ in cut], pa.int32()), pa.array([_planes(np.diff(k, prepend=np.uint64(0))) for k, _ in cut], pa.binary()), pa.array([_planes(x.astype(np.uint32)) for _, x in cut], pa.binary())],
                    names=["bucket", "chunk", "n", "keys", "counts"],
                )

    def add(t: pa.Table) -> pa.Table:
        sizes = t.column("n").to_numpy()
        keys = np.concatenate([np.cumsum(_numbers(k.as_py(), np.uint64, n), dtype=np.uint64) for k, n in zip(t.column("keys"), sizes)])
        counts = np.concatenate([_numbers(x.as_py(), np.uint32, n) for x, n in zip(t.column("counts"), sizes)])
        distinct, place = np.unique(keys, return_inverse=True)
        same = np.bincount(place, weights=counts).astype(np.uint64)
        pairs = distinct >> np.uint64(WORD_BITS)
        starts = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        pair = np.repeat(np.add.reduceat(same, starts), np.diff(np.append(starts, len(pairs))))
        ends = np.cumsum(sizes)
        cut = [place[e - n : e] for e, n in zip(ends, sizes)]
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "n": t.column("n"), "same": pa.array([_planes(same[p]) for p in cut], pa.binary()), "pair": pa.array([_planes(pair[p]) for p in cut], pa.binary())})

    sent = parts.select("chunk", *_COLUMNS).mapInArrow(send, "bucket long, chunk long, n int, keys binary, counts binary")
    added = sent.groupBy("bucket").applyInArrow(add, "chunk long, bucket long, n int, same binary, pair binary")
    return added.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "same", "pair"))).alias("sums"))


@dataclass
class Trained:
    model: Model
    parts: DataFrame  # the corpus as chunks


def train(df: DataFrame, size: int = VOCABULARY, classes: int = CLASSES, id_col: str = "doc_id", text_col: str = "text") -> Trained:
    rows = narrow(df, id_col, text_col)
    vocab = vocabulary(stored(word_counts(rows)), size)
    parts = chunks(rows, vocab)
    vocab = learn_classes(parts, vocab, classes)
    class_of = vocab.class_of
    cells, hot = classes**3, HOT

    # One pass: windows of classes, then pairs of the most frequent words around a word.
    def count(c: Chunk) -> np.ndarray:
        a, b = _hot(c.left, hot), _hot(c.right, hot)
        return np.concatenate((_cells(c, class_of, classes), cells + (a * hot + b)[(a >= 0) & (b >= 0)]))

    found = _sums(parts, cells + hot * hot, count)
    table = fit(found[:cells].reshape(classes * classes, classes), classes).ravel().astype(np.float32)
    return Trained(Model(vocab, table, classes, hot, found[cells:]), parts)


def score(trained: Trained) -> DataFrame:
    """(doc_id, n_words, log_likelihood, network, mean, perplexity) of each document of the corpus; network is the sum by the network alone."""
    model, parts = trained.model, trained.parts
    bits = _key_bits(model.vocab.n_words)
    kind = parts.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _word_hashes(model.vocab.words)
        for b in batches:
            for row in range(b.num_rows):
                c = Chunk(*(b.column(i + 1)[row].as_py() for i in range(len(_COLUMNS))))
                size = np.diff(c.ptr)
                of = np.repeat(np.arange(len(size)), size)
                _, _, place, hot = _own_keys(c, hashes, model.hot, bits)
                sums = b.column(len(_COLUMNS) + 1)[row].as_py() or []
                same, pair = (np.concatenate([_numbers(s[name], np.uint64, s["n"]) for s in sums] or [np.empty(0, np.uint64)]).astype(np.float64)[place] for name in ("same", "pair"))
                n = len(c.words)
                network = model.network(c, same[n:] / max(model.vocab.n_rare, 1))
                between = np.where(hot >= 0, model.hot_pairs[hot], pair[:n])
                log = np.log(same[:n] - 1 + PRIOR * np.exp(network)) - np.log(between - 1 + PRIOR)
                total, prior = (np.bincount(of, weights=x, minlength=len(size)) for x in (log, network))
                yield pa.RecordBatch.from_arrays([b.column(0)[row].values, pa.array(size), pa.array(total), pa.array(prior)], names=["doc_id", "n_words", "log_likelihood", "network"])

    rows = parts.join(window_sums(parts, model), "chunk", "left").select("ids", *_COLUMNS, "sums")
    done = rows.mapInArrow(run, f"doc_id {kind}, n_words long, log_likelihood double, network double")
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return done.select("doc_id", "n_words", "log_likelihood", "network", mean.alias("mean"), F.exp(-mean).alias("perplexity"))
