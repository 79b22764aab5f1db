"""Queries of the two classifiers."""

from pyspark.sql import functions as F

from momentloom.llm import labelled, quality, toxicity
from momentloom.llm.registry import query, table


@query()
def op2_quality(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, d, "labels"), "quality", by=3, rest=1)
    return quality.scored(docs, model).select(
        "doc_id", labelled.held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op10_toxicity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, d, "labels"), "toxic", by=4, rest=2)
    return toxicity.scored(docs, model).select(
        "doc_id", labelled.held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
