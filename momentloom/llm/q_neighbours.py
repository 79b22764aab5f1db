"""Query of the nearest neighbours."""

from pyspark.sql import functions as F

from momentloom.llm import neighbours
from momentloom.llm.registry import query, table


@query()
def op3_neighbours(spark, d):
    return neighbours.nearest(table(spark, d, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0, k=20)
