"""All registered queries."""

from momentloom.plans import q_candidates, q_cuts, q_evidence, q_product, q_series, q_sources, q_stream, q_temporal, q_text  # noqa: F401
from momentloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
