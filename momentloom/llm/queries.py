"""All queries of this subpackage."""

from momentloom.llm import (  # noqa: F401
    q_chat,
    q_classifiers,
    q_language,
    q_lexical,
    q_neighbours,
    q_rules,
    q_sharding,
    q_simhash,
    q_spelling,
    q_tokens,
)
from momentloom.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
