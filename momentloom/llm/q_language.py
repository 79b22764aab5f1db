"""Query of the language of documents."""

from momentloom.llm import labelled, language
from momentloom.llm.registry import query, table


@query()
def op11_language(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    found = language.identified(docs.select("doc_id", "text"), language.fit(docs, by=4, rest=2))
    return found.select("doc_id", labelled.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
