"""Queries that encode whole texts."""

import public_tokenizers

from momentloom.llm import bpe, packing, token_files
from momentloom.llm.registry import query, table
from momentloom.operators.stored import scratch


@query()
def op1_token_files(spark, d):
    folder = scratch(spark, "tokens")
    token_files.write_tokens(table(spark, d, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), "byte", end_id=2, n_ids=50257)
    return token_files.read_tokens(spark, folder)


@query()
def op5_packing(spark, d):
    return packing.pack(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"), "word", end_id=1, capacity=2048, with_ids=False)


@query()
def op8_byte_bpe(spark, d):
    return bpe.round_trip(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
