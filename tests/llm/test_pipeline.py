"""The pipeline, stage by stage on what the stage before kept; queries with SQL twins."""

import corpus_pipeline
import pytest
from llm.test_jaccard import survivors
from llm.test_rules import plain as measure
from momentloom.llm import rules
from momentloom.llm.queries import ORACLE, QUERIES
from momentloom.operators.stored import settle
from oracle import compare

D = "/root/testdata/sf0.001"


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "packing"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    msg, _, ok = compare(spark, D, name, QUERIES[name], ORACLE[name])
    assert ok, msg


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, D), name)
        held[name] = docs.collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    first = {r.doc_id for r in held["quality_rules"]}
    assert first == {i for i, t in texts.items() if not measure(t)[1] & (rules.mask("v1") | rules.mask("base"))}
    second = {r.doc_id for r in held["quality_classifier"]}
    clean = {i for i in first if labels.get(i) == 1}
    assert second <= first and len(clean & second) >= 0.97 * len(clean)
    third = {r.doc_id for r in held["near_duplicates"]}
    assert sorted(third) == survivors([(i, texts[i]) for i in second])
    assert {r.doc_id for r in held["packing"]} == third
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, D))
    assert docs.count() == 0
