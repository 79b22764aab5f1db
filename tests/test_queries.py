"""Every query is registered properly; a spread of them is compared with SQL at the smallest scale."""

import pytest
from oracle import compare

from momentloom.plans.catalog import ORACLE, QUERIES

D = "/root/testdata/sf0.001"
SAMPLE = ["energy_rate_windows", "validate_claims", "refine", "overview", "apply_ledger", "caption_lines", "publish_metadata", "stream_ledger", "clip_rows"]


def test_registry():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) > 120


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    msg, _, ok = compare(spark, D, name, QUERIES[name], ORACLE[name])
    assert ok, msg
