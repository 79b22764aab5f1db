"""Quality ledger against plain Python."""

import re
from collections import Counter

from llm.conftest import EDGES
from momentloom.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    m = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
         "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside), "n_lines": len(lines), "n_exclamations": text.count("!")}
    return m, sum(1 << i for i, rule in enumerate(rules.RULES.values()) if eval(rule, {}, m))  # noqa: S307


def key(r):
    return repr(r)


def test_ledger(edges, no_docs):
    got = rules.verdicts(rules.ledger(edges), "v1").collect()
    want = []
    for i, t in EDGES:
        m, bits = plain(t)
        base = bool(bits & rules.mask("base"))
        want.append((i, *(m[k] for k in rules.MEASURES), bits, base, not base and not bits & rules.mask("v1")))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert rules.ledger(no_docs).collect() == []


def test_keep_returns_whole_rows(edges):
    want = sorted((i or 0) for i, t in EDGES if not plain(t)[1] & (rules.mask("v1") | rules.mask("base")))
    kept = rules.keep(edges, "v1")
    assert kept.columns == edges.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == want


def test_ablations(edges):
    bits = [plain(t)[1] for _, t in EDGES]
    names = list(rules.RULES)
    for r in rules.ablations(rules.ledger(edges), ("base", "v2")).collect():
        m, b = rules.mask(r.policy), 1 << names.index(r.rule)
        assert r.failed == sum(bool(x & b) for x in bits)
        assert r.failed_alone == sum(x & m == b for x in bits)
        assert r.rejected == sum(bool(x & m) for x in bits)
