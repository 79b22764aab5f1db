"""Query of the quality rules."""

from momentloom.llm import rules
from momentloom.llm.registry import query, table

_BLANKS = "[\\x20\\x09-\\x0D]"

RULES_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_BLANKS}+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), unnest(range(0, 8)) AS u(k) GROUP BY 1),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_BLANKS}', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_exclamations
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, CAST({" | ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(rules.RULES.values()))} AS BIGINT) AS failures FROM m)
SELECT *, failures & {rules.mask("base")} <> 0 AS base_failed, failures & {rules.mask("base") | rules.mask("v1")} = 0 AS kept FROM f
"""


@query(RULES_SQL)
def op9_quality_rules(spark, d):
    return rules.verdicts(rules.ledger(table(spark, d, "documents")), "v1")
