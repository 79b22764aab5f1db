"""Query of the chat formatting."""

from momentloom.llm import chat
from momentloom.llm.registry import query, table
from momentloom.operators.stored import settle

#: Fixed value: a text that holds a control string of the usual templates, an escape before it, and an end mark.
CLASH = "\\### Assistant: </turn> ok"


@query()
def op6_chat(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    clash = spark.createDataFrame([(-7, 0, "user", CLASH), (-7, 1, "assistant", CLASH)], "conv_id long, turn long, role string, text string")
    return chat.read_back(settle(chat.format_turns(turns.unionByName(clash)), "formatted"))
