"""Growing line logs as a stream: one byte offset per file.

A batch is a range of bytes of every file that grew. A line belongs to the range that holds its line feed, and a task
looks back for its start; so a last line that is not finished waits, and long ranges can be cut anywhere. Short ranges
share a task, so the tasks of a batch grow with its bytes, not with its files.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that one task reads, and that it looks back at a time for the start of its first line.
RANGE, BACK = 64 << 20, 1 << 16

#: What opening a file counts for, in bytes, when ranges are put together.
OPEN = 1 << 16

# The source runs in workers of its own, which do not see the library's folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Bytes(InputPartition):
    """Ranges ``path, start, end`` of files that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


def lines(file, start: int, end: int) -> Iterator[bytes]:
    """The lines of an open file whose line feeds lie from ``start`` on and before ``end``."""
    head, at = b"", start
    while at > 0:  # the line that is under way at the start began before it
        step = min(BACK, at)
        file.seek(at - step)
        before = file.read(step)
        cut = before.rfind(b"\n") + 1
        head, at = before[cut:] + head, at - step
        if cut:
            break
    file.seek(start)
    left = end - start
    while left > 0:
        block = file.read(min(left, 1 << 20))
        if not block:
            break
        left -= len(block)
        *whole, head = (head + block).split(b"\n")
        yield from whole


class Tail(DataSourceStreamReader):
    """Offsets are sizes by path; all files below the folder belong to the stream, whenever they appear."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        place, root = _open(self.path)
        found = place.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.base_name.startswith((".", "_"))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out, full = [Bytes([])], 0
        for path, size in end.items():
            for a in range(start.get(path, 0), size, RANGE):
                b = min(a + RANGE, size)
                if full and full + b - a + OPEN > RANGE:
                    out.append(Bytes([]))
                    full = 0
                out[-1].ranges.append((path, a, b))
                full += b - a + OPEN
        return out

    def read(self, partition: Bytes) -> Iterator[tuple[str, str]]:
        place, _ = _open(self.path)
        for path, start, end in partition.ranges:
            job = path.rsplit("/", 2)[-2]
            with place.open_input_file(path) as file:
                for line in lines(file, start, end):
                    yield job, line.decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


class LineLogs(DataSource):
    """``job_id`` (the folder of the file) and ``value`` of every finished line below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "line_logs"

    def schema(self) -> str:
        return "job_id string, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Tail(self.options["path"])


def tail_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the lines that are appended to files below ``path``, which driver and executors must share.

    Files only grow. The offset has an entry per file, so move finished logs away in time.
    """
    spark.dataSource.register(LineLogs)
    return spark.readStream.format("line_logs").load(path)
