"""The registered queries of this subpackage: each applies one operator to its whole table and gives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_scan, lm_scoring, packing, pii, piece_codec, simhash, substring_dedup, syncmers, topk_search, toxicity
from .common import documents

WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer(WORD_TOKENIZER))


def packing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packing where all three limits count: turns of conversations, of which only the assistant's tokens bear loss."""
    done = packing.pack_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"), tokenizer(WORD_TOKENIZER))
    turn = F.from_json("doc_id", "conv_id long, turn long")
    return done.select(turn["conv_id"].alias("conv_id"), turn["turn"].alias("turn"), "start", "length", "loss", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, pii.BASE_KINDS), F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(lm_scoring.train(documents(spark, sf_dir)))


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(documents(spark, sf_dir), tokenizer(PIECE_MODEL))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated passages gone, and what was removed: start:end in code points, comma-joined."""
    done = substring_dedup.remove(documents(spark, sf_dir).select("doc_id", "text"), whole_lines=True)
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return done.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.size("removed").cast("long").alias("n_removed"), chars.alias("removed_chars"), spans.alias("spans"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).drop("spans")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 50, as a whole, against all documents: its ten best."""
    docs = documents(spark, sf_dir)
    return topk_search.search(docs, docs.where("doc_id % 50 = 0")).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(documents(spark, sf_dir))
    return found.select("doc_id", simhash.fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = syncmers.compare_edited(documents(spark, sf_dir))
    return done.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), syncmers.as_text(F.col("sketch")).alias("fingerprint"), syncmers.as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op3_pii what the fixed patterns alone decide, which SQL can express."""
    return op3_pii(spark, sf_dir).drop("spans")


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op7_license_scan what the phrases alone decide, which SQL can express."""
    return op7_license_scan(spark, sf_dir).drop("labels", "score")


FUNCTIONS = (op1_toxicity, op2_packing, op3_pii, op4_lm_scoring, op5_piece_codec, op6_substring_dedup, op7_license_scan, op8_topk_search, op9_simhash, op10_syncmers, packing_conversations, pii_base_spans, license_phrases)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in FUNCTIONS}

# ---- SQL ----

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}')"

_PHRASE = "list_transform(list_filter(range(1, n + 1), lambda i: {}), lambda i: {{'at': i - 1, 'label': '{}'}})"
_PHRASES = " || ".join(_PHRASE.format(" AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(p.split())), label) for p, label in license_scan.PHRASES.items())
_LICENSES = f"""WITH d AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_WORDS} AS w FROM documents)), p AS (SELECT doc_id, n, {_PHRASES} AS found FROM d)
SELECT doc_id, n AS n_words, len(found) AS n_base, list_min(list_transform(found, lambda x: x.at)) AS first_word, list_max(list_transform(found, lambda x: x.at)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(found, lambda x: x.label))), ',') AS base_labels FROM p"""

# The patterns of the base kinds.
_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr({_DIGITS}, -i, 1)::INT WHEN substr({_DIGITS}, -i, 1)::INT > 4 THEN substr({_DIGITS}, -i, 1)::INT * 2 - 9 ELSE substr({_DIGITS}, -i, 1)::INT * 2 END)) % 10 = 0"
_FINE = {
    "email": "true", "ip": "list_bool_and(list_transform(string_split(v, '.'), lambda x: len(ltrim(x, '0')) < 4 AND coalesce(try_cast(nullif(ltrim(x, '0'), '') AS INT), 0) <= 255))",
    "card": f"len({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}", "phone": f"len({_DIGITS}) BETWEEN 9 AND 15",
}


def _found_sql(no: int, kind: str) -> str:
    """Matches of a kind with their places: what stands between the matches, and the matches, have lengths."""
    pattern = _BASE[kind]
    each = f"SELECT doc_id, generate_subscripts(m, 1) AS i, unnest(m) AS v, g FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM docs)"
    place = "SELECT doc_id, v, i, sum(len(g[i])) OVER w + coalesce(sum(len(v)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM (" + each + ") WINDOW w AS (PARTITION BY doc_id ORDER BY i)"
    return f"SELECT doc_id, {no} AS place, '{kind}' AS kind, pos, pos + len(v) AS upto FROM ({place}) WHERE {_FINE[kind]}"


_PII = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(_found_sql(no, k) for no, k in enumerate(pii.BASE_KINDS))})
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE_KINDS)}, sha256(coalesce(string_agg(kind || ':' || pos::BIGINT || ':' || upto::BIGINT, ',' ORDER BY place, pos), '')) AS base_sha256
FROM docs LEFT JOIN s USING (doc_id) GROUP BY doc_id"""

_SEARCH = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY 1, 2, 3),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS average FROM d), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT q.doc_id AS query_id, p.doc_id, sum(q.tf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * p.tf * 2.5::DOUBLE / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / average))) AS score FROM p q JOIN p USING (term) JOIN f USING (term), st WHERE q.doc_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""

#: Trained models, tokenizers, seeded hashes and link components aren't expressible in SQL; those operators are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op8_topk_search": _SEARCH, "pii_base_spans": _PII, "license_phrases": _LICENSES}
