"""Token files, packing and byte-level BPE against the tokenizer libraries on whole texts."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from momentloom.llm import bpe, packing, token_files
from momentloom.llm.memo import BYTE_PATTERN, PLAIN_BELOW, Kept, library_memo, plain_words
from momentloom.operators.stored import scratch
from tokenizers import Tokenizer

from llm.conftest import EDGES

FILES = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}


@cache
def library(kind):
    return Tokenizer.from_file(P.path(FILES[kind]))


def whole(kind, text):
    return library(kind).encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_memo_equals_whole_encoding(kind):
    memo = library_memo(P.path(FILES[kind]), kind)
    r = random.Random(5)
    odd = ["".join(r.choice(" \n\tab.,'é́ß1日 !\x1c") for _ in range(r.randint(0, 40))) for _ in range(300)]
    for text in [t or "" for _, t in EDGES] + odd:
        assert np.frombuffer(memo.ids(text), "<u4").tolist() == whole(kind, text), text[:60]


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_control_strings_are_one_id(kind):
    memo = library_memo(P.path(FILES[kind]), kind)
    texts = ["end <|endoftext|> of", "<|endoftext|>", "a<|startoftext|><|endoftext|>b c", "<|EndOfText|> <|endoftext|", "x  <|endoftext|>\n\n<|endoftext|> ", "plain"]
    assert [np.frombuffer(x, "<u4").tolist() for x in memo.encode(texts)] == [whole(kind, t) for t in texts]


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_memo_forgets(kind, monkeypatch):
    memo = library_memo(P.path(FILES[kind]), kind)
    monkeypatch.setattr(memo, "kept", Kept(12000))
    r = random.Random(4)
    for _ in range(60):
        text = " ".join(f"w{min(r.randrange(99), r.randrange(99))}, it's" for _ in range(30))
        assert np.frombuffer(memo.ids(text), "<u4").tolist() == whole(kind, text)
        assert memo.kept.held <= 6000 + 91 * 300
    assert memo.kept.older  # generations turned


def test_bpe_merges_each_word_once_while_remembered(monkeypatch):
    c = bpe.coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    monkeypatch.setattr(c.memo, "kept", Kept(1 << 20))
    met = []
    learn = c.memo.learn
    monkeypatch.setattr(c.memo, "learn", lambda words: met.append(list(words)) or learn(words))
    texts = [f"alpha{i % 50} beta, gamma{i}." for i in range(400)]
    for _ in range(3):
        c.encode(texts)
    flat = [w for ws in met for w in ws]
    assert len(flat) == len(set(flat)) and [len(ws) > 1 for ws in met if ws] == [True]


def test_common_letters_are_those_of_the_patterns():
    import unicodedata

    import regex

    letters = regex.compile(r"\p{L}")
    for c in map(chr, range(ord(PLAIN_BELOW))):
        assert c.isalpha() == bool(letters.match(c)) and unicodedata.is_normalized("NFC", c)
    for p in ("word", " word", " Élan,", "été.", "it's", " a1", "", " ", ",", "日本", "word\u0301"):
        own = plain_words(p)
        assert own is None or own == regex.findall(BYTE_PATTERN, p)


def test_token_files(spark, edges):
    folder = scratch(spark, "test")
    token_files.write_tokens(edges, folder, P.path(FILES["byte"]), "byte", end_id=2, n_ids=50257)
    rows = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    want = sorted(((i is not None, i or 0, t or "") for i, t in EDGES))
    at = 0
    for r, (has, i, t) in zip(rows, want, strict=True):
        ids = whole("byte", t) + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i if has else None, at, len(ids), crc(ids))
        at += len(ids)


def test_wide_token_files(spark, edges):
    folder = scratch(spark, "test")
    token_files.write_tokens(edges.where("doc_id = 6"), folder, P.path(FILES["byte"]), "byte", n_ids=70_000)
    (row,) = token_files.read_tokens(spark, folder).collect()
    assert row.ids_crc32 == crc(whole("byte", dict(EDGES)[6]))


def test_no_token_files(spark, no_docs):
    folder = scratch(spark, "test")
    token_files.write_tokens(no_docs, folder, P.path(FILES["byte"]), "byte", end_id=2)
    assert token_files.read_tokens(spark, folder).collect() == []


def test_packing(edges, no_docs):
    rows = packing.pack(edges, P.path(FILES["word"]), "word", end_id=1).collect()
    assert packing.pack(no_docs, P.path(FILES["word"]), "word").collect() == []
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None and r.doc_id != 7:
            docs[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    for i, t in EDGES:
        if i not in (None, 7):
            ids = whole("word", t or "") + [1]
            assert b"".join(x for _, x, _ in sorted(docs[i])) == np.array(ids, "<u4").tobytes()
            assert {n for *_, n in docs[i]} == {len(ids)}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_differencing_is_near_equal_and_rises():
    r = random.Random(2)
    sizes = [r.randint(1, 256) for _ in range(3000)]
    dealt = packing.windows(sizes, 2048)
    assert sorted(i for w in dealt for i in w) == list(range(3000))
    sums = [sum(sizes[i] for i in w) for w in dealt]
    assert max(sums) <= 2048 and len(sums) <= -(-sum(sizes) // 2048) + 2
    assert max(sums) - min(sums) < 40
    assert len(packing.windows([1500, 1500, 1000], 2048)) == 3  # two windows would do for the sum, not for the items


def test_bpe(edges, no_docs):
    path = P.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = sorted((i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
                  for i, t in EDGES for ids in [own.encode_ordinary(t or "")])
    assert sorted((r.doc_id or 0, *r[1:]) for r in bpe.round_trip(edges, path, P.PATTERN).collect()) == want
    back = bpe.decode(bpe.encode(edges, path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.bytes)) for r in back) == sorted((i or 0, (t or "").encode()) for i, t in EDGES)
    assert bpe.round_trip(no_docs, path, P.PATTERN).collect() == []


def test_both_trees_merge_alike():
    c = bpe.coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=c.ranks.of, special_tokens={})
    r = random.Random(3)
    words = ["".join(r.choice("abcdeé ") for _ in range(r.randint(1, 200))).encode() for _ in range(300)] + [b"a" * 999]
    for w in words:
        want = own.encode_ordinary(w.decode())
        assert bpe.merge_long(w, c.ranks) == want
        assert bpe.merge_rows([w], c.ranks, max(2, 1 << (len(w) - 1).bit_length())) == [want]


@pytest.mark.parametrize("tokens", [1, 5])
def test_groups_of_tiny_texts_are_bounded(tokens):
    ids, n = np.ones(tokens, "<u4"), 300_000
    found = list(packing.groups(((i, ids) for i in range(n)), 2048, 256, 1 << 20))
    assert [i for g in found for i, _ in g] == list(range(n))
    # Differencing holds this many pairs of 64-bit numbers: one group had 300,000 x 147 or more of them.
    assert all(len(g) * (len(g) * tokens // 2048 + 1) <= 1.05 * packing.MOST_CELLS for g in found)
    assert sum(len(g) for g in found[:-1]) >= len(found[:-1]) * 30_000


def test_groups_of_usual_texts_close_by_tokens():
    found = list(packing.groups(((i, np.ones(600, "<u4")) for i in range(4000)), 2048, 256, 1 << 20))
    assert [len(g) for g in found] == [1748, 1748, 504]
