"""Token ids as flat binary files.

A folder holds, per part, ``part-N.bin`` (ids as little-endian unsigned integers of 16 bits where the vocabulary
allows, else 32), ``part-N.off`` (64-bit offsets of its documents, one more than documents) and ``part-N.doc``
(64-bit document ids; the smallest integer stands for null), and ``parts``, a table of the parts. Parts are in
ascending document order; a part's base is the prefix sum of the tokens before it, so any document's global
position is base + offset without touching another file. Files are memory-mapped where the folder is mounted.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentloom.llm.memo import library_memo, slices

PARTS = "part int, name string, width int, docs long, tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
NULL_ID = -(2**63)


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, kind: str = "byte", end_id: int | None = None, n_ids: int = 65536) -> DataFrame:
    """Encode ``text`` of every row of ``docs`` and write the folder; returns the table of parts.

    ``folder`` must be one that all executors reach. One shuffle brings the texts into document order; each task
    streams its range into its own files under temporary names and renames them when whole, so a repeated task
    only replaces equal files. Null text counts as empty; rows without ``doc_id`` come first; equal ids are
    ordered by text; other columns are ignored. An empty table gives an empty table of parts.
    """
    width = 2 if n_ids <= 65536 else 4
    end = b"" if end_id is None else np.uint32(end_id).tobytes()

    def put(batches):
        place, root = _open(folder)
        part, memo, key = TaskContext.get().partitionId(), library_memo(vocabulary, kind), uuid.uuid4().hex
        names = {x: f"{root}/part-{part:06d}.{x}" for x in ("bin", "off", "doc")}
        streams, n, docs_n = {}, 0, 0
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy()
            at = 0
            for texts in slices(batch.column("text"), 512):
                if not streams:
                    place.create_dir(root)
                    streams = {x: place.open_output_stream(f"{p}.{key}") for x, p in names.items()}
                    streams["off"].write(np.int64(0).tobytes())
                rows = [np.frombuffer(x + end, "<u4") for x in memo.encode(texts)]
                ends = n + np.cumsum([len(r) for r in rows])
                streams["bin"].write(np.concatenate(rows).astype(f"<u{width}").tobytes())
                streams["off"].write(ends.astype("<i8").tobytes())
                streams["doc"].write(ids[at : at + len(texts)].astype("<i8").tobytes())
                n, at, docs_n = int(ends[-1]), at + len(texts), docs_n + len(texts)
        if streams:
            for x, s in streams.items():
                s.close()
                place.move(f"{names[x]}.{key}", names[x])
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "name": [f"part-{part:06d}"], "width": pa.array([width], pa.int32()), "docs": [docs_n], "tokens": [n]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(put, PARTS).write.parquet(f"{folder}/parts")
    return docs.sparkSession.read.schema(PARTS).parquet(f"{folder}/parts")


def _view(place, path: str, kind: str) -> np.ndarray:
    """A file as an array: mapped where it is mounted, else read."""
    if place.type_name == "local":
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
    with place.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_tokens(spark: SparkSession, folder: str, step: int = 2048) -> DataFrame:
    """Every document of the folder, from its files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    The checksum is over the ids as little-endian unsigned 32-bit integers. One task per part and ``step``
    documents at a time; the bases are a running sum over the table of parts, which has one row per written file.
    """
    parts = spark.read.schema(PARTS).parquet(f"{folder}/parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = parts.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def get(batches):
        place, root = _open(folder)
        for batch in batches:
            for p in batch.to_pylist():
                ids = _view(place, f"{root}/{p['name']}.bin", f"<u{p['width']}")
                off = _view(place, f"{root}/{p['name']}.off", "<i8")
                doc = _view(place, f"{root}/{p['name']}.doc", "<i8")
                for i in range(0, len(doc), step):
                    o = np.array(off[i : i + step + 1])
                    block = np.array(ids[o[0] : o[-1]]).astype("<u4")
                    crc = [zlib.crc32(block[a:b].data) if b > a else 0 for a, b in zip(o[:-1] - o[0], o[1:] - o[0], strict=True)]
                    d = np.array(doc[i : i + step])
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(d, mask=d == NULL_ID), "start": o[:-1] + p["base"], "n_tokens": np.diff(o), "ids_crc32": pa.array(crc, pa.int64())})

    return based.repartition(max(1, parts.count())).mapInArrow(get, READ)
