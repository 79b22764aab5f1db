"""Query of the sharding."""

from pyspark.sql import functions as F

from momentloom.llm import sharding
from momentloom.llm.registry import query, table


@query()
def op7_sharding(spark, d):
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, d, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_hash"))
    out = sharding.shard(rows, ["doc_id", "_hash"], 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
