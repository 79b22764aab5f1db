"""A corpus from documents: quality rules, quality classifier, near-duplicates, packing.

Every stage takes the documents that its predecessor kept, written and reread as Parquet, and all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentloom.llm import jaccard, packing, quality, rules
from momentloom.operators.stored import settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of policy v1 rejects."""
    return rules.keep(_documents(docs), "v1")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of one half or more, by a model fitted to the labelled ones among them.

    Rows whose crc32 of the id modulo 3 is 1 stay out of the fit, as in the operator's query. The rules before took
    most bad documents away, so the few that are left weigh as much as they are frequent.
    """
    rows = _documents(docs)
    model = quality.fit(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", by=3, rest=1)
    return quality.scored(rows, model, "_score").where(F.col("_score") >= 0.5).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard similarity 0.8 or more) the document with the smallest id."""
    return jaccard.one_of_each(_documents(docs), words=5, least=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), "word", end_id=1, capacity=2048)


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates), ("packing", packed)]

#: A fitted classifier and a tokenizer have no SQL form; tests/llm holds every stage against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
