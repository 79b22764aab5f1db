import random

import pytest

WORDS = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice(["", "", "", ".", ",", "\n" + r.choice(WORDS)])) for _ in range(n))


#: Null and empty texts, odd white space, ties, repeated rows, a very long text, null ids.
EDGES = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "a  b\n\n c\t d "), (6, prose(1, 60)), (7, prose(1, 60)), (7, prose(1, 60)),
    (8, prose(2, 30_000)), (9, "Éá ΣΑΣ İ 日本語 \U0001f600 \x1c x y 　z <|endoftext|> it's"), (10, "aaaa " * 400), (11, prose(3, 400) + " ### % $ | & !!!"),
    (12, "\n".join([prose(4, 12)] * 5)), (None, "no id here"), (None, None), (-5, prose(5, 200)), (13, prose(6, 25) + "\0 nul \\ back"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Edge documents with extra columns whose names operators use themselves."""
    rows = [(i, t, "x", 1.0, 7, "s") for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, score double, fp int, _m string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
