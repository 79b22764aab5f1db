"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentloom.llm import labelled
from momentloom.llm.memo import slices
from momentloom.operators.stored import settle

STATISTICS = (
    "words", "word_length", "distinct", "stutter", "commonest", "symbols", "bars", "exclamations", "digits", "capitals", "stops",
    "commas", "lines", "distinct_lines", "line_words", "bytes_per_char",
)
_DIGITS, _CAPITALS, _SYMBOLS = b"0123456789", bytes(range(65, 91)), b"#*$%&<>@^~_={}[]"


def statistics(text: str) -> tuple[float, ...]:
    """Scale-free measurements of a whole text, in the order of ``STATISTICS``; an empty text has all 0."""
    words = text.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    raw, n = text.encode(), len(words)
    chars = sum(map(len, words))
    share = lambda found: (len(raw) - len(raw.translate(None, found))) / chars
    counted = Counter(words)
    stutter = sum(map(eq, words, words[1:])) / n
    commonest = max(counted.values()) / n
    lines = [x for x in text.split("\n") if x]
    return (
        math.log1p(n), chars / n, len(counted) / n**0.85, math.sqrt(stutter), commonest, math.sqrt(share(_SYMBOLS)), math.sqrt(share(b"|")), math.sqrt(share(b"!")),
        math.sqrt(share(_DIGITS)), math.sqrt(share(_CAPITALS)), math.sqrt(share(b".?")), math.sqrt(share(b",;:")), math.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))), len(raw) / len(text),
    )


@dataclass
class Model:
    """Everything that scoring needs; a few hundred KB at most, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of the Gaussian kernel over standardised statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        f = np.cos(z @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))
        return np.concatenate([f, np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, texts: list[str]) -> np.ndarray:
        """Calibrated chance of label 1; the ridge value itself breaks ties inside a level."""
        if not texts:
            return np.zeros(0)
        raw = self.raw(np.array([statistics(t) for t in texts]))
        return 0.998 * np.interp(raw, self.knots, self.levels) + 0.002 * np.clip(raw, 0, 1)


def isotonic(values: np.ndarray, hits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in ascending order: the mean value and the level of each block."""
    blocks: list[list[float]] = []
    for v, h, c in zip(values.tolist(), hits.tolist(), counts.tolist(), strict=True):
        blocks.append([v * c, h, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(docs: DataFrame, labels: DataFrame, label: str, by: int, rest: int, features: int = 256, ridge: float = 1e-3, seed: int = 7,
        most: int = labelled.MOST_ROWS) -> Model:
    """Fit on a sample of at most about ``most`` labelled rows (``labelled.sample``).

    Four folds give the normal equations: each partition sums its outer products, the sums are added row by row,
    and the driver solves one system of ``features`` + 1 unknowns. The fifth fold calibrates. Without labelled
    rows every score is one half.
    """
    width = len(STATISTICS)
    rng = np.random.default_rng(seed)
    model = Model(np.zeros(width), np.ones(width), rng.normal(size=(width, features)) / math.sqrt(width), rng.uniform(0, 2 * math.pi, features),
                  np.r_[np.zeros(features), 0.5], np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def measure(batches):
        for batch in batches:
            x = np.array([statistics(t) for part in slices(batch.column("text")) for t in part]).reshape(-1, width)
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "fold": batch.column("fold")} | {f"s{i}": x[:, i] for i in range(width)})

    rows = labelled.texts(docs, labelled.sample(labels, label, by, rest, most))
    rows = settle(rows.mapInArrow(measure, "y int, fold int, " + ", ".join(f"s{i} double" for i in range(width))), "statistics")
    told = rows.where("fold > 0").agg(F.count("*"), F.avg("y"), *[f(f"s{i}") for i in range(width) for f in (F.avg, F.stddev_pop)]).first()
    if not told[0]:
        return model
    model.mean, model.scale = np.array(told[2::2], float), np.maximum(np.array(told[3::2], float), 1e-6)

    def matrix(batch):
        return np.column_stack([batch.column(f"s{i}").to_numpy() for i in range(width)])

    def outer(batches):
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            f = model.features(matrix(batch))
            total += f.T @ np.column_stack([f, batch.column("y").to_numpy()])
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(features + 1), pa.int32()), "v": pa.array(list(total), pa.list_(pa.float64()))})

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column("i").to_pylist(), batch.column("v"), strict=True):
                held[i] = held.get(i, 0) + v.values.to_numpy()
        if held:
            yield pa.RecordBatch.from_pydict({"i": pa.array(list(held), pa.int32()), "v": pa.array(list(held.values()), pa.list_(pa.float64()))})

    sums = rows.where("fold > 0").mapInArrow(outer, "i int, v array<double>").repartition("i").mapInArrow(add, "i int, v array<double>").collect()
    total = np.array([r["v"] for r in sorted(sums, key=lambda r: r["i"])])
    a, b = total[:, :-1], total[:, -1]
    penalty = np.full(features + 1, ridge * told[0])
    penalty[-1] = 0
    centre = told[1]
    model.weights = np.linalg.solve(a + np.diag(penalty + 1e-9), b - centre * a[:, -1])
    model.weights[-1] += centre

    def place(batches):
        for batch in batches:
            v = np.round(np.clip(model.raw(matrix(batch)), -0.5, 1.5) * 2000) / 2000
            yield pa.RecordBatch.from_pydict({"v": v, "y": batch.column("y")})

    bins = rows.where("fold = 0").mapInArrow(place, "v double, y int").groupBy("v").agg(F.sum("y").alias("h"), F.count("*").alias("n")).orderBy("v").collect()
    if bins:  # at most 4,001 of them
        model.knots, model.levels = isotonic(*(np.array([r[k] for r in bins], float) for k in ("v", "h", "n")))
        if len(model.knots) == 1:
            model.knots, model.levels = np.array([0.0, 1.0]), np.clip(np.array([-0.25, 0.25]) + model.levels[0], 0, 1)
    return model


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the score of its ``text`` under ``column``; null counts as empty. A column of that name is replaced. No row moves; only texts go to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score([t or "" for t in texts.tolist()]), dtype="float64")

    return docs.withColumn(column, score(F.col("text").cast("string")))
