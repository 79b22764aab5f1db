"""Query of the ranked lexical search, and its SQL twin."""

from momentloom.llm import lexical
from momentloom.llm.registry import query, table

_TERMS = r"""regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@query(f"""
WITH counted AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS.format("text")}) AS term FROM documents) GROUP BY 1, 2
), sized AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY 1
), totals AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sized
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark) GROUP BY 1, 2
), weighed AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY 1), totals
), scored AS (
  SELECT item_id, c.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))))::BIGINT AS score
  FROM asked JOIN counted c USING (term) JOIN weighed USING (term) JOIN sized USING (doc_id), totals GROUP BY 1, 2
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
) WHERE rank <= 20
""")
def op12_lexical(spark, d):
    return lexical.search(table(spark, d, "documents"), table(spark, d, "benchmark"), k=20)
