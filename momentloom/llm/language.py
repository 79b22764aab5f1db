"""Language of texts by a convolutional network over bytes.

A text is cut into windows of a fixed number of bytes. Every byte has a small vector; filters of several widths slide
over a window, each gives its greatest response, and a softmax over these tells the languages apart. The network is
trained in numpy on windows of labelled documents; a text's language is that with the greatest mean chance over all its windows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentloom.llm import labelled
from momentloom.llm.memo import slices

#: Labelled documents that the network is trained on at most, shared evenly by the languages, and windows of each of them.
MOST_DOCS, WINDOWS_OF_DOC = 6000, 3

#: Bytes of a window; numbers a byte becomes; widths of filters and filters of each width.
WINDOW, DEPTH, WIDTHS, FILTERS = 96, 6, (2, 3, 4), 12

#: The answer for texts without a letter, and for all where no document is labelled.
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_PAD = 256
_BATCH = 2048


def windows(text: str, size: int = WINDOW) -> np.ndarray:
    """All bytes of a text in rows of ``size``, in lower case as far as A to Z goes; the last row is filled up with padding."""
    found = np.frombuffer(text.encode().lower(), np.uint8)
    rows = -(-len(found) // size)
    out = np.full(rows * size, _PAD, np.int16)
    out[: len(found)] = found
    return out.reshape(rows, size)


def _unrolled(shapes: list[np.ndarray]) -> np.ndarray:
    """All filters as one matrix over the widest, shorter ones with zeros behind."""
    wide = max(w.shape[0] for w in shapes)
    return np.concatenate([np.concatenate([w, np.zeros((wide - len(w), *w.shape[1:]), w.dtype)]) for w in shapes], axis=2).reshape(-1, sum(w.shape[2] for w in shapes))


@dataclass
class Network:
    """``embed``: bytes and padding by depth; ``filters``: per width an array (width, depth, filters); ``bias`` of filters; ``top``: responses and 1 by languages."""

    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    top: np.ndarray

    @classmethod
    def new(cls, languages: list[str], seed: int = 3) -> Network:
        r = np.random.default_rng(seed)
        normal = lambda scale, *shape: r.normal(0, scale, shape).astype(np.float32)
        embed = normal(1, _PAD + 1, DEPTH)
        embed[_PAD] = 0
        n = FILTERS * len(WIDTHS)
        return cls(languages, embed, [normal((w * DEPTH) ** -0.5, w, DEPTH, FILTERS) for w in WIDTHS], np.zeros(n, np.float32), normal(n**-0.5, n + 1, len(languages)))

    def spread(self, rows: np.ndarray) -> np.ndarray:
        """The vectors of each byte and of those after it, as far as the widest filter reaches; beyond a window is padding."""
        wide = max(map(len, self.filters))
        held = np.full((len(rows), rows.shape[1] + wide - 1), _PAD, rows.dtype)
        held[:, : rows.shape[1]] = rows
        x = self.embed[held]
        shape = (len(rows), rows.shape[1], wide * x.shape[2])
        return np.lib.stride_tricks.as_strided(x, shape, (x.strides[0], x.strides[1], x.strides[2]))

    def responses(self, x: np.ndarray) -> np.ndarray:
        """Each filter at each byte of each window."""
        return (x.reshape(-1, x.shape[2]) @ _unrolled(self.filters)).reshape(len(x), x.shape[1], -1)

    def chances(self, rows: np.ndarray) -> np.ndarray:
        """Chances of the languages, one row per window."""
        out = np.empty((len(rows), len(self.languages)), np.float32)
        for i in range(0, len(rows), _BATCH):
            part = rows[i : i + _BATCH]
            top = np.maximum(self.responses(self.spread(part)).max(1) + self.bias, 0)
            z = top @ self.top[:-1] + self.top[-1]
            z = np.exp(z - z.max(1, keepdims=True))
            out[i : i + _BATCH] = z / z.sum(1, keepdims=True)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its mean chance of each whole text; ties go to the language first in order."""
        found = [t if t and _LETTER.search(t) else "" for t in texts]
        out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return out, score
        held, owner, n = [], [], 0

        def settle() -> None:
            rows, at = np.concatenate(held), np.concatenate(owner)
            first = np.flatnonzero(np.diff(at, prepend=-1))
            total = np.add.reduceat(self.chances(rows).astype(np.float64), first, axis=0)
            mean = total / np.diff(np.append(first, len(at)))[:, None]
            for i, best, s in zip(at[first].tolist(), mean.argmax(1).tolist(), mean.max(1).tolist(), strict=True):
                out[i], score[i] = self.languages[best], min(s, 1.0)

        for i, t in enumerate(found):
            if t:
                rows = windows(t)
                held.append(rows)
                owner.append(np.full(len(rows), i))
                n += len(rows)
            if n >= 4 * _BATCH:
                settle()
                held, owner, n = [], [], 0
        if held:
            settle()
        return out, score


def gradients(net: Network, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Weighted mean cross-entropy, and its slope in every parameter."""
    x = net.spread(rows)
    raw = net.responses(x)
    where = raw.argmax(1)
    top = np.take_along_axis(raw, where[:, None], 1)[:, 0] + net.bias
    live = top > 0
    top = top * live
    z = top @ net.top[:-1] + net.top[-1]
    z = np.exp(z - z.max(1, keepdims=True))
    p = z / z.sum(1, keepdims=True)
    at = np.arange(len(y))
    loss = float(-(weight * np.log(p[at, y] + 1e-12)).sum() / weight.sum())
    d = p.copy()
    d[at, y] -= 1
    d *= (weight / weight.sum())[:, None]
    d_top = np.concatenate([top.T @ d, d.sum(0, keepdims=True)])
    d_pool = (d @ net.top[:-1].T) * live
    # Only the place of the greatest response of a filter has a slope.
    seen = x[at[:, None], where]  # windows, filters, what each filter saw
    d_all = np.einsum("nf,nfk->kf", d_pool, seen)
    wide, depth = max(map(len, net.filters)), net.embed.shape[1]
    d_filters, f = [], 0
    for w in net.filters:
        d_filters.append(d_all[:, f : f + w.shape[2]].reshape(wide, depth, -1)[: len(w)])
        f += w.shape[2]
    back = d_pool[:, :, None] * _unrolled(net.filters).T[None]
    held = np.full((len(rows), rows.shape[1] + wide - 1), _PAD, np.int64)
    held[:, : rows.shape[1]] = rows
    which = held[at[:, None, None], where[:, :, None] + np.arange(wide)]
    d_embed = np.zeros_like(net.embed)
    np.add.at(d_embed, which.reshape(-1), back.reshape(-1, depth))
    d_embed[_PAD] = 0
    return loss, {"embed": d_embed, "filters": d_filters, "bias": d_pool.sum(0), "top": d_top}


def train(net: Network, rows: np.ndarray, y: np.ndarray, rounds: int = 8, batch: int = 256, rate: float = 0.01, seed: int = 5) -> Network:
    """Adam over shuffled batches; every language weighs as much as any other."""
    r = np.random.default_rng(seed)
    share = np.bincount(y, minlength=len(net.languages))
    weight = (1 / np.maximum(share, 1))[y].astype(np.float32)
    params = [net.embed, *net.filters, net.bias, net.top]
    mean, square = ([np.zeros_like(p) for p in params] for _ in range(2))
    step, steps = 0, rounds * -(-len(rows) // batch)
    for _ in range(rounds):
        order = r.permutation(len(rows))
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            _, g = gradients(net, rows[at], y[at], weight[at])
            step += 1
            now = rate * (1 - step / (steps + 1)) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for p, d, m, v in zip(params, [g["embed"], *g["filters"], g["bias"], g["top"]], mean, square, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= (now * m / (np.sqrt(v) + 1e-8)).astype(p.dtype)
    return net


def fit(docs: DataFrame, by: int, rest: int, most: int = MOST_DOCS) -> Network:
    """A network for the languages that documents name in ``lang``, but for those whose crc32 of the id modulo ``by`` is ``rest``.

    It is trained on at most about ``most`` documents, as many of each language where there are so many, taken by a
    hash of their text and id, and on up to ``WINDOWS_OF_DOC`` windows spread over each; it knows at most the
    ``most`` / 20 most frequent languages. Rows with a null language, or
    a text without a letter, teach nothing; rows with a null id count as not held out. Without any row left, there are no languages.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~labelled.held_out("doc_id", by, rest))
    share = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max(1, most // 20)).collect()}
    if not share:
        return Network.new([])
    each = most // len(share)
    place = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    taken = F.lit(False)
    for lang, n in share.items():
        taken = taken | ((F.col("lang") == lang) & (place < F.lit(each / n)))

    def cut(batches):
        for batch in batches:
            langs, at = batch.column("lang").to_pylist(), 0
            for texts in slices(batch.column("text")):
                out: dict = {"lang": [], "bytes": []}
                for t in texts:
                    if _LETTER.search(t):
                        w = windows(t)
                        full = w[: max(1, len(w) - 1)]
                        for k in np.unique(np.linspace(0, len(full) - 1, WINDOWS_OF_DOC).astype(int)):
                            out["lang"].append(langs[at])
                            out["bytes"].append(full[k].tobytes())
                    at += 1
                yield pa.RecordBatch.from_pydict({"lang": pa.array(out["lang"], pa.string()), "bytes": pa.array(out["bytes"], pa.binary())})

    told = rows.where(taken).select("text", "lang").mapInArrow(cut, "lang string, bytes binary").toPandas().sort_values(["lang", "bytes"])
    languages = sorted(set(told["lang"]))
    if not languages:
        return Network.new([])
    x = np.frombuffer(b"".join(told["bytes"]), np.int16).reshape(-1, WINDOW)
    return train(Network.new(languages), x, np.searchsorted(languages, told["lang"].to_numpy(str)))


def identified(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) of its whole ``text``; columns of these names are replaced.

    Null texts and texts without a letter are ``UNKNOWN`` with score 0, and so is every text if the network knows no
    language. No row moves; only texts go to Python.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("lang_pred string, score double")
    def tell(texts: pd.Series) -> pd.DataFrame:
        out, score = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": pd.Series(out, dtype=object), "score": score.astype("float64")})

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    told = docs.select(*[F.col(f"`{c}`") for c in kept], tell(F.col("text").cast("string")).alias("_told"))
    return told.select(*[F.col(f"`{c}`") for c in kept], "_told.lang_pred", "_told.score")
