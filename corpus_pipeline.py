"""A corpus clean-up of five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept:
toxicity rejects documents; of near-duplicates one stays; repeated passages are cut
out; personal data is replaced by its kind; the rest is packed into training sequences.
All stages but the last return the columns of documents, with n_chars following the text.
A document that has lost all its text stays as an empty one: only the first two stages
drop documents.

Cases, stage by stage.

* Null text counts as empty. toxicity scores it by the model's bias alone; near_dedup holds
  all texts without words for copies of each other, so one stays; the others leave it as it
  is (packing: one piece of the end token).
* Null ids: toxicity and packing treat them like any other; near_dedup keeps all such rows, as
  they can't be ranked; for substring_dedup they rank first.
* Rows that repeat an id: near_dedup keeps one; rows that repeat a text have no tie: the
  smallest id stays. Labels that nobody is left for are passed over.
* Very long texts are read to their end by every stage.
* An empty table gives an empty one at each stage. Without labels of both classes
  toxicity rejects nothing.
* Columns beside those of documents fall away in the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.llm import near_copies, packing, pii, substring_dedup, toxicity
from seekframe.llm.common import shared_folder
from seekframe.llm.queries import WORD_TOKENIZER, tokenizer
from seekframe.session import shipped

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC_FROM = 0.7


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, out="__score").where(F.col("__score") < TOXIC_FROM).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(substring_dedup.remove(docs, spans_col=None, whole_lines=True))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(pii.redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer(WORD_TOKENIZER))


STAGES = [("toxicity", shipped(toxicity_stage)), ("near_dedup", shipped(near_dedup_stage)), ("substring_dedup", shipped(substring_stage)), ("pii", shipped(pii_stage)), ("packing", shipped(packing_stage))]

#: Trained models, tokenizers and components aren't expressible in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
