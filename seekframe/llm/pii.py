"""Personal data: candidate spans, boosted trees, calibrated thresholds; DataFrame functions only.

Base spans are matches of four fixed patterns that pass their check; they always stay.
High-recall generators propose further, overlapping candidates: values after words such
as password or token, long opaque strings, groups of digits, spelled-out mail addresses.
Each candidate gets format features (length, character classes, changes between letters
and digits, distinct characters) and context features (words in the `CONTEXT` characters
before it); gradient-boosted trees score it, and a candidate is selected if its score
reaches its generator's threshold.

The trees are trained at first use, on made-up sentences whose candidates and features
come from the very expressions that run on documents; half of the sentences calibrate the
thresholds: the lowest score with a precision of `PRECISION` or more on that half, where a
harmless sentence weighs `PRIOR` times as much, as harmless candidates are that much more
frequent in documents than in the sentences. The training rows are a fixed number that
doesn't depend on the input. The trees then become plain CASE expressions in the plan.

Scale. Everything is an expression within the row: no shuffle, no join. Patterns use
possessive runs and look-behinds, so no text makes them quadratic.

Cases. Null text counts as empty: no spans. Rows that repeat each give a row. An empty
table gives an empty result. Positions are code points, ends exclusive. If selected
spans overlap, redaction replaces their union once, by the first one's kind.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running_starts, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("secret", "id", "contact")
CONTEXT = 24
PRECISION, PRIOR = 0.97, 20.0

# The patterns of the contract, written so that a failing run is tried once.
BASE_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for the pattern to match at all; spares most texts the search.
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
# (generator, kind, needs, pattern, value): value is the pattern of the wanted end of a match, or None for all of it.
GENERATORS = (
    ("named", "secret", r"(?i)(?:token|passw|pwd|secret|key|auth)", r"""(?i)(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key|auth)["']?\s{0,3}[=:]\s{0,3}["']?[^\s"',;]{4,}+""", r"""(?<![^\s"',;=:])[^\s"',;=:]++$"""),
    ("opaque", "secret", r"[A-Za-z0-9_+/=-]{16}", r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+", None),
    ("digits", "id", r"[0-9][ ./-][0-9]", r"(?<![0-9A-Za-z.+/-])(?:\([0-9]{2,4}\) ?)?[0-9]{2,4}(?:[ ./-][0-9]{2,6}){1,5}(?![0-9A-Za-z])", None),
    ("spelled", "contact", r"(?i)[\[(]\s?at\s?[\])]", r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,64}+\s?[\[(]\s?at\s?[\])]\s?[a-z0-9.-]{2,64}+(?:\s?[\[(]\s?dot\s?[\])]\s?[a-z]{2,10})?", None),
)
KIND_OF = {g[0]: g[1] for g in GENERATORS}
_SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string,before:string,after:string>>"

# Words before a candidate that speak for and against it.
CONTEXT_WORDS = {
    "near_secret": r"(?i)(?:token|passw|pwd|secret|api.?key|access|auth|credential|bearer)",
    "near_person": r"(?i)(?:ssn|social|passport|phone|call|tel|mobile|fax|account|iban|born|birth|dob|licen[cs]e no|contact|mail|reach)",
    "near_other": r"(?i)(?:order|invoice|version|isbn|sku|page|ref|date|build|since|figure|table|part|model|serial|on the|ratio|score)",
}
FEATURES = ("length", "digits", "upper", "lower", "signs", "distinct", "changes", "digit_share", "groups", *CONTEXT_WORDS, "glued")


def _matches(text: Column, needs: str, pattern: str) -> tuple[Column, Column]:
    """(gaps, matches) of a pattern: gaps stand around the matches; null where it can't match."""
    some = text.rlike(needs)
    return F.when(some, F.split(text, pattern, -1)), F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _located(df: DataFrame, text: str, kind: str, needs: str, pattern: str, out: str) -> DataFrame:
    """df with array<struct> of the matches of one pattern, with their places and the text around them."""
    gaps, found, spots = f"__{out}_gaps", f"__{out}_found", f"__{out}_spots"
    g, m = _matches(F.col(text), needs, pattern)
    rows = df.withColumn(gaps, g).withColumn(found, m)
    both = F.zip_with(F.slice(F.col(gaps), F.lit(1), F.size(found)), F.col(found), lambda a, b: (F.char_length(a) + F.char_length(b)).cast("long"))
    rows = rows.withColumn(spots, F.when(F.size(found) > 0, running_starts(both)))
    parts = F.arrays_zip(F.col(spots).alias("at"), F.slice(F.col(gaps), F.lit(1), F.size(found)).alias("gap"), F.col(found).alias("value"), F.slice(F.col(gaps), F.lit(2), F.size(found)).alias("next"))
    spans = F.transform(
        parts,
        lambda x: F.struct(
            F.lit(kind).alias("kind"), (x["at"] + F.char_length(x["gap"])).alias("start"), (x["at"] + F.char_length(x["gap"]) + F.char_length(x["value"])).alias("end"),
            x["value"].alias("value"), F.right(x["gap"], F.lit(CONTEXT)).alias("before"), F.left(x["next"], F.lit(1)).alias("after"),
        ),
    )
    return rows.withColumn(out, F.when(F.size(found) > 0, spans).otherwise(F.array().cast(_SPANS))).drop(gaps, found, spots)


def _only(value: Column, kept: str) -> Column:
    return F.regexp_replace(value, f"[^{kept}]", "")


def _small_number(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.ascii(F.substring(digits, -i, F.lit(1))) - 48)
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.transform(each, lambda d, i: F.when(i % 2 == 1, twice(d)).otherwise(d)), F.lit(0), lambda a, d: a + d)
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _small_number)
    n = F.length(_only(value, "0-9"))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_only(value, "0-9"))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda x: _valid(kind, x["value"])


def with_base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df with column base: array of the valid spans, by kind as listed, then by start."""
    rows = df
    for k in BASE_KINDS:
        rows = _located(rows, text, k, NEEDS[k], BASE_PATTERNS[k], f"__{k}")
        if k != "email":
            rows = rows.withColumn(f"__{k}", F.filter(f"__{k}", _check(k)))
    return rows.withColumn("base", F.concat(*(F.col(f"__{k}") for k in BASE_KINDS))).drop(*(f"__{k}" for k in BASE_KINDS))


def _features(x: Column) -> Column:
    v = x["value"]
    digits = F.length(_only(v, "0-9"))
    changes = F.length(F.regexp_replace(F.regexp_replace(v, r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", "\u0001"), "[^\u0001]", ""))
    number = {
        "length": F.length(v), "digits": digits, "upper": F.length(_only(v, "A-Z")), "lower": F.length(_only(v, "a-z")), "signs": F.length(F.regexp_replace(v, "[A-Za-z0-9]", "")),
        "distinct": F.size(F.array_distinct(F.split(v, ""))), "changes": changes, "digit_share": digits / F.greatest(F.length(v), F.lit(1)), "groups": F.size(F.split(v, r"[ ./()-]+")),
        **{n: x["before"].rlike(p).cast("int") for n, p in CONTEXT_WORDS.items()}, "glued": x["after"].rlike("[A-Za-z0-9]").cast("int"),
    }
    return F.struct(*(number[n].cast("double").alias(n) for n in FEATURES))


def _described(gen: str):
    return lambda x: F.struct(F.lit(gen).alias("gen"), x.alias("x"), _features(x).alias("f"))


def _cut_to(value: str):
    """Leaves of a match only its end that matches `value`; what stood before joins the context."""

    def cut(x: Column) -> Column:
        tail = F.regexp_extract(x["value"], value, 0)
        n = F.char_length(tail)
        head = F.substring(x["value"], F.lit(1), F.char_length(x["value"]) - n)
        return F.struct(x["kind"].alias("kind"), (x["end"] - n).alias("start"), x["end"].alias("end"), tail.alias("value"), F.concat(x["before"], head).alias("before"), x["after"].alias("after"))

    return cut


def with_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """df with column candidates: array<struct<gen, x (span), f (features)>> of all generators."""
    rows, made = df, []
    for gen, kind, needs, pattern, value in GENERATORS:
        c = f"__{gen}"
        rows = _located(rows, text, kind, needs, pattern, c)
        if value:
            rows = rows.withColumn(c, F.transform(c, _cut_to(value)))
            rows = rows.withColumn(c, F.filter(c, lambda x: x["value"] != ""))
        rows = rows.withColumn(c, F.transform(c, _described(gen)))
        made.append(c)
    return rows.withColumn("candidates", F.concat(*(F.col(c) for c in made))).drop(*made)


@dataclass
class Trees:
    """Regression trees over FEATURES and the generator; `thresholds` by generator."""

    start: float
    trees: list
    thresholds: dict[str, float]

    def score(self, c: Column) -> Column:
        total = F.lit(self.start)
        for node in self.trees:
            total = total + _case(node, c)
        return total

    def selected(self, c: Column) -> Column:
        limit = F.lit(float("inf"))
        for g, t in self.thresholds.items():
            limit = F.when(c["gen"] == g, F.lit(float(t))).otherwise(limit)
        return self.score(c) >= limit


def _case(node, c: Column) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    name, limit, low, high = node
    test = c["gen"] == name[4:] if name.startswith("gen:") else c["f"][name] > limit
    return F.when(test, _case(high, c)).otherwise(_case(low, c))


COLUMNS = (*FEATURES, *(f"gen:{g[0]}" for g in GENERATORS))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3) -> tuple[float, list]:
    """Gradient boosting of logistic loss: Newton steps, exact splits at midpoints of up to 32 quantiles."""
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    f = np.full(len(y), start)
    cuts = []
    for k in range(x.shape[1]):
        v = np.unique(x[:, k])
        mid = (v[1:] + v[:-1]) / 2
        cuts.append(mid if len(mid) <= 32 else np.unique(np.quantile(mid, np.linspace(0, 1, 32))))

    def grow(rows: np.ndarray, left: int, g: np.ndarray, h: np.ndarray):
        G, H = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if left:
            for k in range(x.shape[1]):
                for c in cuts[k]:
                    up = x[rows, k] > c
                    a, b = g[rows][up].sum(), h[rows][up].sum()
                    if min(up.sum(), (~up).sum()) < 5:
                        continue
                    gain = a * a / (b + 1) + (G - a) ** 2 / (H - b + 1) - G * G / (H + 1)
                    if gain > best[0]:
                        best = (gain, (k, float(c)))
        if best[1] is None:
            v = float(rate * G / (H + 1))
            f[rows] += v
            return v
        k, c = best[1]
        up = x[rows, k] > c
        return (COLUMNS[k], c, grow(rows[~up], left - 1, g, h), grow(rows[up], left - 1, g, h))

    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        trees.append(grow(np.arange(len(y)), depth, y - p, np.maximum(p * (1 - p), 1e-6)))
    return start, trees


def _apply(node, x: np.ndarray) -> np.ndarray:
    if isinstance(node, float):
        return np.full(len(x), node)
    name, limit, low, high = node
    return np.where(x[:, COLUMNS.index(name)] > limit, _apply(high, x), _apply(low, x))


def sentences(n: int = 1500, seed: int = 11) -> list[tuple[str, bool]]:
    """Made-up sentences with one candidate each, and whether it is personal or secret."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["the", "on", "er", "in", "sch", "ung", "que", "ment", "re", "an", "ly", "tion"]) for _ in range(r.randint(1, 4)))
    of = lambda chars, a, b=None: "".join(r.choice(chars) for _ in range(r.randint(a, b or a)))
    hexa, alnum, upper, digit = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789"
    yes = [
        lambda: f'token = "{of(hexa, 32, 48)}"', lambda: f"password={of(hexa, 12, 24)}", lambda: f"password: {of(alnum, 8, 16)}", lambda: f"api_key={of(alnum, 20, 40)}", lambda: f"secret: {of(alnum, 16, 32)}",
        lambda: f"AKIA{of(upper, 16)}", lambda: f"{of(alnum, 32, 48)}7a", lambda: f"{of(hexa, 32, 64)}4", lambda: f"ghp_{of(alnum, 36)}", lambda: f"auth: {of(alnum, 12, 30)}",
        lambda: f"ssn {of(digit, 3)}-{of(digit, 2)}-{of(digit, 4)}", lambda: f"social security {of(digit, 3)}-{of(digit, 2)}-{of(digit, 4)}", lambda: f"call ({of(digit, 3)}) {of(digit, 3)}-{of(digit, 4)}", lambda: f"phone {of(digit, 3)}-{of(digit, 3)}-{of(digit, 4)}",
        lambda: f"({of(digit, 3)}) {of(digit, 3)}-{of(digit, 4)}", lambda: f"born {of(digit, 2)}.{of(digit, 2)}.19{of(digit, 2)}", lambda: f"passport {of(digit, 3)} {of(digit, 3)} {of(digit, 3)}",
        lambda: f"{word()}.{word()} [at] {word()} [dot] com", lambda: f"{word()}{of(digit, 2)} (at) {word()}.org", lambda: f"mail {word()} [at] {word()} (dot) net",
    ]
    no = [
        lambda: f"{word()}-{word()}-{word()}-{word()}", lambda: "".join(word() for _ in range(6)), lambda: "".join(word() for _ in range(7)).capitalize(), lambda: f"{''.join(word() for _ in range(5)).capitalize()}-{''.join(word() for _ in range(3))}", lambda: of(digit, 16, 20), lambda: f"{word()}_{word()}_{word()}_{word()}", lambda: f"order {of(digit, 4)}-{of(digit, 4)}", lambda: f"version {of(digit, 2)}.{of(digit, 2)}.{of(digit, 2)}",
        lambda: f"on 20{of(digit, 2)}-{of(digit, 2)}-{of(digit, 2)}", lambda: f"{of(digit, 2)}.{of(digit, 2)}", lambda: f"{of(digit, 3)} {of(digit, 3)}", lambda: f"isbn {of(digit, 3)}-{of(digit, 2)}-{of(digit, 5)}", lambda: f"figure {of(digit, 2)}.{of(digit, 2)}",
        lambda: f"ratio {of(digit, 2)}/{of(digit, 2)}", lambda: "=" * r.randint(16, 60), lambda: "-" * r.randint(16, 60), lambda: "_" * r.randint(16, 40), lambda: f"the token: {word()}", lambda: f"key: {word()}", lambda: f"auth: {word()}", lambda: f"{word()}/{word()}/{word()}/{word()}",
        lambda: f"invoice {of(digit, 4)} {of(digit, 4)}", lambda: f"page {of(digit, 2)}-{of(digit, 3)}", lambda: f"{word()} (at) {word()}", lambda: f"the {word()} [at] the {word()}", lambda: "ab" * r.randint(8, 30), lambda: f"{of(digit, 4)}-{of(digit, 2)}-{of(digit, 2)}",
    ]
    out = []
    for i in range(n):
        good = i % 2 == 0
        made = r.choice(yes if good else no)()
        out.append((f"{word()} {word()} {made} {word()}{r.choice(['.', ',', ''])} {word()}", good))
    return out


_trained: Trees | None = None


def trained(spark: SparkSession) -> Trees:
    """The trees and thresholds; trained once for each driver process, on made-up sentences only."""
    global _trained
    if _trained is None:
        made = sentences()
        rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "i int, text string").coalesce(1)
        rows = with_candidates(rows).select("i", F.explode("candidates").alias("c")).select("i", "c.gen", "c.f.*").collect()
        x = np.array([[r[n] or 0.0 for n in FEATURES] + [float(r["gen"] == g[0]) for g in GENERATORS] for r in rows])
        y = np.array([float(made[r["i"]][1]) for r in rows])
        fit_half = np.array([r["i"] // 2 % 2 == 0 for r in rows])
        start, trees = boost(x[fit_half], y[fit_half])
        z = start + sum(_apply(t, x) for t in trees)
        thresholds = {}
        for k, g in enumerate(GENERATORS):
            mine = ~fit_half & (x[:, len(FEATURES) + k] == 1)
            order = np.argsort(-z[mine], kind="stable")
            zs, personal = z[mine][order], y[mine][order]
            hit = np.cumsum(personal) / np.cumsum(np.where(personal == 1, 1.0, PRIOR))
            ends = np.concatenate((zs[1:] < zs[:-1], [True]))
            good = np.flatnonzero((hit >= PRECISION) & ends)
            # Midway to the next lower score, as sentences not seen lie on either side.
            thresholds[g[0]] = float((zs[good[-1]] + zs[min(good[-1] + 1, len(zs) - 1)]) / 2) if len(good) else float("inf")
        _trained = Trees(start, trees, thresholds)
    return _trained


def _of_kind(spans: Column, kind: str) -> Column:
    """The distinct places of one kind, in order."""
    places = F.array_sort(F.array_distinct(F.transform(F.filter(spans, lambda x: x["kind"] == kind), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))))
    return F.transform(places, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def with_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df with columns base and spans (base and selected candidates), each array<struct<kind, start, end, ...>> by kind as listed, then start."""
    model = trained(df.sparkSession)
    rows = with_candidates(with_base_spans(df, text), text)
    rows = rows.withColumn("__more", F.transform(F.filter("candidates", model.selected), lambda c: c["x"]))
    slim = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    more = [_of_kind(F.col("__more"), k) for k in EXTRA_KINDS]
    return rows.withColumn("base", slim).withColumn("spans", F.concat(F.col("base"), *more)).drop("candidates", "__more")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) of each row."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return with_spans(rows).select("doc_id", "base", "spans")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with every span of text_col replaced by its kind in brackets, such as [EMAIL]."""
    rows = with_spans(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), text_or_empty(text_col).alias("text")))
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("until"), s["end"].alias("end"), s["kind"].alias("kind"))))
    part = "array<struct<start:bigint,end:bigint,kind:string>>"
    state = lambda done, start, end, kind: F.struct(done.alias("done"), start.alias("start"), end.alias("end"), kind.alias("kind"))
    flush = lambda a: F.when(a["start"] >= 0, F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"), a["kind"].alias("kind"))))).otherwise(a["done"])
    merged = F.aggregate(
        order,
        state(F.array().cast(part), F.lit(-1).cast("long"), F.lit(-1).cast("long"), F.lit("")),
        lambda a, s: F.when((a["start"] >= 0) & (s["start"] < a["end"]), state(a["done"], a["start"], F.greatest(a["end"], s["end"]), a["kind"])).otherwise(state(flush(a), s["start"], s["end"], s["kind"])),
        flush,
    )
    rows = rows.withColumn("__cut", merged)
    pieces = F.arrays_zip(F.concat(F.array(F.lit(0).cast("long")), F.col("__cut")["end"]).alias("a"), F.concat(F.col("__cut")["start"], F.array(F.char_length("text").cast("long"))).alias("b"), F.concat(F.transform("__cut", lambda c: F.concat(F.lit("["), F.upper(c["kind"]), F.lit("]"))), F.array(F.lit(""))).alias("mark"))
    clean = F.array_join(F.transform(pieces, lambda p: F.concat(F.substring(F.col("text"), (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")), p["mark"])), "")
    new = F.when(F.size("__cut") > 0, clean).otherwise(F.col("__row")[text_col])
    return rows.select(*[(new if c == text_col else F.col("__row")[c]).alias(c) for c in df.columns])
