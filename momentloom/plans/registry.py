"""Registration of queries with their SQL twins, and the shared SQL definitions of derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Derived tables in dependency order; ``with_`` puts the named ones and what they need in front of a query.
CTES: dict[str, str] = {
    "words": """
        SELECT CAST(conv_id AS VARCHAR) AS video_id, turn, w AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS pos,
               (row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1) * 0.5::DOUBLE + turn * 2.0::DOUBLE AS t0,
               (row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1) * 0.5::DOUBLE + turn * 2.0::DOUBLE + 0.375::DOUBLE AS t1
        FROM (SELECT conv_id, turn,
                     unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w,
                     generate_subscripts(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), 1) AS k
              FROM conversations)""",
    "speech": "SELECT video_id, turn, min(t0) AS t0, max(t1) AS t1 FROM words GROUP BY 1, 2",
    "silence": """
        SELECT video_id, t1 AS t0, nxt AS t1 FROM (
            SELECT video_id, t1, lead(t0) OVER (PARTITION BY video_id ORDER BY t0) AS nxt FROM speech) WHERE nxt > t1""",
    "media": "SELECT video_id, max(t1) + 1 AS duration_s FROM words GROUP BY 1",
    "fillers": """
        SELECT video_id, pos, t0, t1 FROM (
            SELECT video_id, pos, t0, CASE WHEN regexp_matches(text, '(?i)^(de|that|en)[,.]?$') THEN t1
                                           WHEN regexp_matches(text, '(?i)^la$') AND regexp_matches(nxt, '(?i)^[a-z]+[,.]$')
                                                AND NOT regexp_matches(nxt, '(?i)^(de|that|en|la)[,.]?$') THEN nt1 END AS t1
            FROM (SELECT *, lead(text) OVER w AS nxt, lead(t1) OVER w AS nt1 FROM words WINDOW w AS (PARTITION BY video_id ORDER BY pos)))
        WHERE t1 IS NOT NULL""",
    "cuts": """
        SELECT video_id, 'c' || CAST(turn AS VARCHAR) AS cand_id, turn, t0 + 0.125 * (turn % 4) AS t0,
               least(t0 + 0.125 * (turn % 4) + 30 + turn * 5, t1 + 45.25) AS t1
        FROM speech""",
    "ticks": """
        SELECT CAST(user_id AS VARCHAR) AS video_id, event_id, event_type, value,
               CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 60000000 AS DOUBLE) AS t
        FROM events""",
    "media_t": "SELECT video_id, (floor(max(t) / 3600) + 1) * 3600.0::DOUBLE AS duration_s FROM ticks GROUP BY 1",
    "peaks": "SELECT video_id, event_id AS pos, t, value / 50 AS sigma FROM ticks WHERE event_type IN ('error', 'purchase')",
    "sevents": """
        SELECT video_id, event_id AS pos, CASE event_type WHEN 'click' THEN 'laughter' ELSE 'applause' END AS label,
               t AS t0, t + 30 AS t1, value / 400 AS conf FROM ticks WHERE event_type IN ('click', 'view')""",
    "surges": "SELECT video_id, event_id AS pos, t AS t0, t + 60 AS t1 FROM ticks WHERE event_type = 'signup'",
    "talk": "SELECT video_id, event_id AS pos, t AS t0, t + 3600 AS t1 FROM ticks WHERE event_type = 'signup'",
    "quiet": """
        SELECT video_id, t0, t1, row_number() OVER (PARTITION BY video_id ORDER BY t0) - 1 AS pos FROM (
            SELECT video_id, greatest(coalesce(max(t1) OVER (PARTITION BY video_id ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS t0, t0 AS t1
            FROM (SELECT video_id, t0, max(t1) AS t1 FROM talk GROUP BY 1, 2)
            UNION ALL
            SELECT m.video_id, coalesce(greatest(max(k.t1), 0), 0), any_value(m.duration_s)
            FROM media_t m LEFT JOIN talk k ON k.video_id = m.video_id GROUP BY m.video_id)
        WHERE t0 < t1""",
    "scenes": """
        SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t) - 1 AS pos, t AS t0,
               lead(t) OVER (PARTITION BY video_id ORDER BY t) AS t1
        FROM (SELECT DISTINCT video_id, t FROM ticks WHERE event_type = 'error' AND t > 0
              UNION ALL SELECT video_id, 0.0 FROM media_t UNION ALL SELECT video_id, duration_s FROM media_t)
        QUALIFY lead(t) OVER (PARTITION BY video_id ORDER BY t) IS NOT NULL""",
    "pitch": """
        SELECT m.video_id, g.i, g.i * 3600.0 AS t, coalesce(CASE WHEN p.n >= 2 THEN p.v ELSE 0 END, 0) AS v
        FROM media_t m, LATERAL (SELECT unnest(range(0, CAST(m.duration_s / 3600 AS BIGINT))) AS i) g
        LEFT JOIN (SELECT video_id, CAST(floor(t / 3600) AS BIGINT) AS i, var_pop(value) AS v, count(*) AS n FROM ticks GROUP BY 1, 2) p
          ON p.video_id = m.video_id AND p.i = g.i""",
}
NEEDS = {
    "speech": ["words"], "silence": ["speech"], "media": ["words"], "fillers": ["words"], "cuts": ["speech"],
    "media_t": ["ticks"], "peaks": ["ticks", "media_t"], "sevents": ["ticks", "media_t"], "surges": ["ticks", "media_t"], "talk": ["ticks"],
    "quiet": ["talk", "media_t"], "scenes": ["ticks", "media_t"], "pitch": ["ticks", "media_t"],
}


# Lines of orders, numbered from 1 within each order; the given numbers repeat.
LINES = """(SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_quantity, l_returnflag) AS INT) AS l_linenumber,
                 l_extendedprice, l_quantity, l_returnflag FROM lineitem)"""


def with_(*names: str, **more: str) -> str:
    """``WITH`` clause of the named derived tables and their needs, then extra ones in the order given."""
    wanted: set[str] = set()

    def need(n):
        if n not in wanted:
            wanted.add(n)
            for m in NEEDS.get(n, []):
                need(m)

    for n in names:
        need(n)
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in wanted] + [f"{n} AS ({q})" for n, q in more.items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def query(sql: str | None = None, name: str | None = None):
    """Register a query function under its own name, with its SQL twin if there is one."""

    def put(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return put
