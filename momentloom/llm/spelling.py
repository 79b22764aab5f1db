"""Spelling variants: the words of a corpus, those at one edit from each other, and the form that each one varies.

Two words at one edit agree on the first or on the second half of the shorter one. So a word is filed under both
halves of either length that it can be the longer word of; what shares a half comes into one block, whose
``BiIndex`` is searched for every word filed in it. A half that very many words share is cut into several blocks and
its words are looked up in each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentloom.llm.fm_index import BiIndex
from momentloom.llm.memo import slices
from momentloom.operators.stored import settle

_RUN = re.compile("[A-Za-zÀ-ÿ]+")

#: Distinct words that a task counts before it hands them on.
MOST_COUNTED = 300_000

#: Filings that a block holds about, and the words of one half that go into one block at most.
BLOCK, MOST_OF_HALF = 20_000, 20_000


def runs(text: str) -> list[str]:
    """Runs of letters, in lower case as far as A to Z goes."""
    return _RUN.findall(text.encode().lower().decode())


def word_counts(docs: DataFrame, slip: int = 199) -> DataFrame:
    """``word`` and ``n`` of all runs of letters of whole texts.

    Where ``slip`` divides the crc32 of ``<doc_id>:<run>``, the run has lost a character, at the place that the crc32 names.
    Null texts have no runs; a null id is the empty string there; repeated rows count again; other columns are ignored.
    """

    def run(batches):
        counts: Counter = Counter()

        def out():
            rows = pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return rows

        for batch in batches:
            ids, at = batch.column("doc_id").to_pylist(), 0
            for texts in slices(batch.column("text")):
                for t in texts:
                    start = zlib.crc32(b":" if ids[at] is None else b"%d:" % ids[at])
                    for w, n in Counter(runs(t)).items():
                        h = zlib.crc32(w.encode(), start)
                        if h % slip == 0:
                            k = h % len(w)
                            w = w[:k] + w[k + 1 :]
                        counts[w] += n
                    at += 1
                if len(counts) > MOST_COUNTED:
                    yield out()
        if counts:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _filed(vocabulary: DataFrame) -> DataFrame:
    """``word``, ``n``, ``cut`` and ``first`` (the half that is shared ends, or starts, at ``cut``) and ``key``, the half with its side and length class."""
    size = F.length("word")
    sides = []
    for shorter in (size, size - 1):  # the length of the shorter word of a pair
        half = F.floor(shorter / 2).cast("int")
        for first in (True, False):
            part = F.expr("substring(word, 1, half)") if first else F.expr("substring(word, length(word) - half + 1)")
            sides.append((shorter, half, first, part))
    out = None
    for shorter, half, first, part in sides:
        rows = vocabulary.withColumn("half", half).where(F.col("half") > 0).select(
            "word", "n", (F.col("half") if first else size - F.col("half")).cast("int").alias("cut"), F.lit(first).alias("first"),
            F.concat_ws(":", shorter.cast("string"), F.lit("<" if first else ">"), part).alias("key"))
        out = rows if out is None else out.union(rows)
    return out


def near_words(vocabulary: DataFrame, block: int = BLOCK, most: int = MOST_OF_HALF) -> DataFrame:
    """``word``, ``near`` and ``near_n`` of all pairs of words of ``vocabulary`` (distinct ``word``, ``n``) at exactly one edit, in both directions.

    Words are of characters up to U+00FF but the first three, and of two characters at least.
    """
    filed = settle(_filed(vocabulary), "filed")
    shared = filed.groupBy("key").agg(F.count("*").alias("words")).where("words > 1").select("key", F.ceil(F.col("words") / most).cast("int").alias("parts"))
    rows = filed.join(shared, "key")
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    rows = rows.withColumn("own", own).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = settle(rows.select("key", "part", "word", "n", "cut", "first", (F.col("own") == F.col("part")).alias("held")), "halves")
    blocks = max(1, -(-rows.count() // block))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key", "part"), F.lit(blocks)))

    def search(table: pa.Table) -> pa.Table:
        held = table.filter(table["held"]).select(["word", "n"]).group_by("word").aggregate([("n", "max")]).to_pydict()
        words, n = held["word"], np.array(held["n_max"], np.int64)
        if not words:
            return pa.table({"word": pa.array([], pa.string()), "near": pa.array([], pa.string()), "near_n": pa.array([], pa.int64())})
        asked = table.select(["word", "cut", "first"]).to_pydict()
        pattern, found = BiIndex(words).near(asked["word"], np.array(asked["cut"]), np.array(asked["first"], bool))
        return pa.table({
            "word": pa.array([asked["word"][i] for i in pattern.tolist()], pa.string()), "near": pa.array([words[i] for i in found.tolist()], pa.string()),
            "near_n": pa.array(n[found], pa.int64())})

    return rows.groupBy("block").applyInArrow(search, "word string, near string, near_n long").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` from ``word`` and ``form``: forms are followed to the last, twice as far in every round."""
    at = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        at = settle(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, slip: int = 199, letters: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of the words of ``docs`` with ``letters`` characters and ``least`` occurrences.

    A word's form is the most frequent word at one edit (ties: the smallest by code points), if it is ``times`` as
    frequent at least. Forms grow in frequency, so following them ends. An empty table gives no rows.
    """
    words = settle(word_counts(docs, slip).where((F.length("word") >= letters) & (F.col("n") >= least)), "words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    told = words.join(near, "word", "left").withColumn("form_n", -F.col("best.n"))
    formed = F.col("form_n") >= F.col("n") * times
    told = settle(told.select("word", F.when(formed, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("form_n")).alias("form_n")), "told")
    roots = _roots(told.where("form is not null"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
