"""Toxicity by class-conditional Kneser-Ney models of the characters of words.

One model is fitted to toxic and one to ordinary documents. Both discount their own counts of a character after
its context (up to four characters, from the start of the word) and give the rest to the same backoff: continuation
counts over all documents, labelled or not. So an expression that neither class has seen says nothing, and a rare one
little, while inflected forms share the evidence of their stem. A word's value is the log-likelihood of the toxic
model less that of the ordinary one.
"""

from __future__ import annotations

import math
import sys
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentloom.llm import labelled
from momentloom.llm.memo import slices
from momentloom.operators.stored import settle

ORDER, DISCOUNT = 5, 0.75

#: Words whose values a worker remembers at most; then it starts anew.
MOST_WORDS = 250_000
_EDGES = ".,;:!?\"'()[]*#$%&|"


def grams(word: str) -> list[str]:
    """Every character of a word, and its end, after its context."""
    s = "\x02" + word.strip(_EDGES) + "\x03"
    return [s[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(s))]


def continuations(grams: Iterable[str]) -> dict[str, int]:
    """Of how many longer grams a shorter one is the end."""
    shared: dict[str, int] = {}
    by_length = defaultdict(set)
    for g in grams:
        by_length[len(g)].add(g)
    level = by_length[ORDER]
    for k in range(ORDER - 1, 0, -1):
        below = Counter(g[1:] for g in level)
        shared |= below
        level = set(below) | by_length[k]
    return shared


def continued(seen: DataFrame) -> DataFrame:
    """``gram`` and ``n`` as ``continuations`` has them, from a table of distinct grams in ``gram``."""
    level, out = seen.where(F.length("gram") == ORDER).select("gram"), None
    for k in range(ORDER - 1, 0, -1):
        below = settle(level.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")), "continued")
        out = below if out is None else out.union(below)
        level = below.select("gram").union(seen.where(F.length("gram") == k).select("gram")).distinct()
    return out


@dataclass
class Shared:
    """Continuation counts: of grams, and summed and counted over what follows each context; ``singles`` counts the grams of one character."""

    n: dict[str, int]
    total: dict[str, int]
    kinds: dict[str, int]
    singles: int

    @classmethod
    def of(cls, n: dict[str, int]) -> Shared:
        total, kinds = Counter(), Counter()
        for g, k in n.items():
            total[g[:-1]] += k
            kinds[g[:-1]] += 1
        return cls(n, total, kinds, sum(len(g) == 1 for g in n))

    @classmethod
    def needed(cls, ends: DataFrame, told: DataFrame) -> Shared:
        """What ``log_ratios`` asks of ``ends`` (``gram``, ``n``) for the grams of ``told``: their ends, and what follows the contexts of these.

        So what is collected is bounded by the grams of labelled rows, however many others the documents hold.
        """
        suffixes = told.where(F.length("gram") > 1).select(F.explode(F.expr("transform(sequence(2, length(gram)), i -> substring(gram, i))")).alias("gram")).distinct()
        context = F.expr("substring(gram, 1, length(gram) - 1)").alias("context")
        sums = ends.groupBy(context).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
        n = ends.join(suffixes, "gram", "left_semi").toPandas()
        sums = sums.join(suffixes.select(context).distinct(), "context", "left_semi").toPandas()
        return cls(dict(zip(n["gram"], n["n"].tolist(), strict=True)), dict(zip(sums["context"], sums["n"].tolist(), strict=True)),
                   dict(zip(sums["context"], sums["kinds"].tolist(), strict=True)), ends.where(F.length("gram") == 1).count())


class KneserNey:
    """Chance of a character after its context in both classes, by their own counts and the shared backoff.

    ``counts``: gram to its count in ordinary and in toxic documents.
    """

    def __init__(self, counts: dict[str, tuple[int, int]], shared: Shared):
        self.counts, self.shared = counts, shared
        self.kept: dict[str, float] = {"": 1 / (1 + shared.singles)}
        #: Of each context: its count in both classes, and the number of different characters after it.
        self.seen: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for g, (a, b) in counts.items():
            s = self.seen[g[:-1]]
            s[0], s[1], s[2], s[3] = s[0] + a, s[1] + b, s[2] + (a > 0), s[3] + (b > 0)

    def backoff(self, g: str) -> float:
        out = self.kept.get(g)
        if out is None:
            h, shared = g[:-1], self.shared
            n, out = shared.total.get(h, 0), self.backoff(g[1:])
            if n:
                out = (max(shared.n.get(g, 0) - DISCOUNT, 0) + DISCOUNT * shared.kinds[h] * out) / n
            self.kept[g] = out
        return out

    def left(self, h: str, y: int) -> float:
        """The share of chance that a class leaves to the backoff after a context."""
        s = self.seen.get(h)
        return DISCOUNT * s[2 + y] / s[y] if s and s[y] else 1.0

    def chance(self, g: str, y: int) -> float:
        h = g[:-1]
        s = self.seen.get(h)
        own = max(self.counts.get(g, (0, 0))[y] - DISCOUNT, 0) / s[y] if s and s[y] else 0.0
        return own + self.left(h, y) * self.backoff(g[1:])


def log_ratios(counts: dict[str, tuple[int, int]], shared: Shared | None = None) -> tuple[dict[str, float], dict[str, float]]:
    """Log ratio of toxic to ordinary probability of each gram, and of each context for grams never seen after it.

    ``shared``: continuation counts, those of ``counts`` by default.
    """
    model = KneserNey(counts, shared or Shared.of(continuations(counts)))
    contexts = {h: math.log(model.left(h, 1) / model.left(h, 0)) for h in model.seen}
    return {g: math.log(model.chance(g, 1) / model.chance(g, 0)) for g in counts}, contexts


@dataclass
class Model:
    """Log ratios, and the logistic weights that turn a document's comparison into a chance."""

    ratios: dict[str, float] = field(default_factory=dict)
    contexts: dict[str, float] = field(default_factory=dict)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(5))
    scale: np.ndarray = field(default_factory=lambda: np.ones(5))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(6))
    known: dict[str, tuple[float, int]] = field(default_factory=dict)

    def word(self, word: str) -> tuple[float, int]:
        """Log ratio and length of a lower-case word."""
        found = grams(word)
        ratios, contexts = self.ratios, self.contexts
        out = 0.0
        for g in found:
            r = ratios.get(g)
            out += contexts.get(g[:-1], 0.0) if r is None else r
        return out, len(found)

    def compare(self, text: str) -> tuple[float, ...]:
        """Length-normalised log ratio of the text; its two highest words; the log ratio if one word in twenty were toxic; its length."""
        words = text.lower().split()
        if not words:
            return (0.0,) * 5
        known = self.known
        if len(known) > MOST_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.word(w)
        v = np.array([known[w] for w in words])
        ratio = v[:, 0]
        top = np.sort(ratio[np.argpartition(ratio, -2)[-2:]]) if len(ratio) > 1 else np.array([0.0, ratio[0]])
        mixed = np.log1p(0.05 * np.expm1(np.minimum(ratio, 30))).sum()
        return ratio.sum() / v[:, 1].sum(), min(top[1], 10), min(top[0], 10), math.copysign(math.log1p(abs(mixed)), mixed), math.log1p(len(words))

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -4, 4), np.ones(len(x))])

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-self.design(np.array([self.compare(t) for t in texts])) @ self.weights))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str, by: int, rest: int, most: int = labelled.MOST_ROWS) -> Model:
    """Fit on all documents: a fifth of the labelled ones, of at most about ``most``, sets the logistic weights; all others are counted.

    Each task counts grams of its documents and Spark adds them up: counts by class over the labelled rows,
    continuation counts over all documents. Texts meet their labels by a merge join at every size (rows without an
    id are counted where they are); of the continuation counts only those that labelled grams ask for are collected.
    The model grows with the distinct grams of labelled rows; the driver and every worker hold it. Without labelled
    rows every score is one half.
    """
    told = settle(labelled.sample(labels, label, by, rest, sys.maxsize), "labelled")
    setting = labelled.sample(labels, label, by, rest, most).where("fold = 0")
    counting = told.join(F.broadcast(setting.select("doc_id")), "doc_id", "left_anti").select("doc_id", "y")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def count(batches):
        words = (Counter(), Counter(), Counter())  # the last: without a class

        def out():
            n: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
            for y in (0, 1, 2):
                for w, c in words[y].items():
                    for g in grams(w):
                        n[g][y] += c
                words[y].clear()
            yield pa.RecordBatch.from_pydict({"gram": pa.array(list(n), pa.string()), "n0": pa.array([v[0] for v in n.values()], pa.int64()), "n1": pa.array([v[1] for v in n.values()], pa.int64())})

        for batch in batches:
            y, at = batch.column("y").to_pylist(), 0
            for part in slices(batch.column("text")):
                for t in part:
                    words[2 if y[at] is None else y[at]].update(t.lower().split())
                    at += 1
                if sum(map(len, words)) > 500_000:
                    yield from out()
        if any(words):
            yield from out()

    named = own.where(F.col("doc_id").isNotNull()).join(counting.hint("merge"), "doc_id", "left").select("text", "y")
    unnamed = own.where(F.col("doc_id").isNull()).select("text", F.lit(None).cast("int").alias("y"))
    found = named.union(unnamed).mapInArrow(count, "gram string, n0 long, n1 long")
    counted = settle(found.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "grams")
    told_grams = counted.where("n0 + n1 > 0")
    kept = told_grams.toPandas()
    model = Model()
    if not len(kept):
        return model
    backoff = Shared.needed(settle(continued(counted.select("gram")), "ends"), told_grams)
    model.ratios, model.contexts = log_ratios(dict(zip(kept["gram"], zip(kept["n0"].tolist(), kept["n1"].tolist(), strict=True), strict=True)), backoff)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compare(batches):
        for batch in batches:
            x = np.array([shared.value.compare(t) for part in slices(batch.column("text")) for t in part]).reshape(-1, 5)
            yield pa.RecordBatch.from_pydict({"y": batch.column("y")} | {f"x{i}": x[:, i] for i in range(5)})

    told = labelled.texts(docs, setting).mapInArrow(compare, "y int, " + ", ".join(f"x{i} double" for i in range(5))).toPandas()
    if len(told):
        x, y = told[[f"x{i}" for i in range(5)]].to_numpy(), told["y"].to_numpy()
        model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        model.weights = logistic(model.design(x), y)
    return model


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the score of its whole ``text`` under ``column``; null counts as empty. A column of that name is replaced. No row moves; only texts go to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score([t or "" for t in texts.tolist()]), dtype="float64")

    return docs.withColumn(column, score(F.col("text").cast("string")))
