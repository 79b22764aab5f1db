"""Query of the spelling variants."""

from momentloom.llm import spelling
from momentloom.llm.registry import query, table


@query()
def op13_spelling(spark, d):
    return spelling.variants(table(spark, d, "documents"), slip=199, letters=6, least=5, times=5)
