"""Query of the near-duplicates."""

from pyspark.sql import functions as F

from momentloom.llm import simhash
from momentloom.llm.registry import query, table


@query()
def op4_simhash(spark, d):
    found = simhash.near_duplicates(table(spark, d, "documents"), words=4, seed=42, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
