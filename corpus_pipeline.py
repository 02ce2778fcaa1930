"""Corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the
last return the columns of ``documents``. A stage's result is written as
Parquet to the shared folder and read again as the next one's documents.

Nulls may stand in any column, ids may repeat, texts may be empty or very long,
and ``docs`` may have more columns, whatever their names: they are left out. An
empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import jaccard, langid, packing, quality, secrets
from barloom.llm.common import stored
from barloom.llm.tokens import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts fail the base rule, rows of a repeated id are judged one by one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.apply_rules(docs, labels).where("kept").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; ``lang`` is the predicted one. Texts without letters go; without labelled documents there is no model and all go."""
    found = langid.identify(docs, langid.train(docs))
    return found.where("not rejected").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word n-grams, similarity 0.8 or more): the one of the smallest id.

    Documents without words are near to none and stay; the rows of a repeated id stay or go together.
    """
    return jaccard.keep_one(docs, words=5, percent=80).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced; ``n_chars`` follows the text. A null text stays null."""
    found = secrets.scan_secrets(docs).withColumn("text", secrets.redact(F.col("text"), F.col("secret_spans")))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1,024 tokens; a null or empty text is its end id alone."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", dedup_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL has no way to express the language models, the encoder or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
