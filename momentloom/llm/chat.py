"""Chat formatting with a grammar that gives the turns back.

A turn is written as ``### role: text</turn>`` and a line feed. In role and text, a backslash before a backslash or
a control string takes it literally. Text goes out as it is where the parser reads it back unchanged; else control
strings are escaped, and if that is not enough, every backslash too. Each turn is formatted by itself, so a
conversation's text is its turns' texts one after the other, however many there are.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, CLOSE, COLON, LEARNT = "### ", "</turn>", ": ", "assistant"

SEGMENTS = "conv_id long, turn long, segment string, loss_from int, loss_to int"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_IN_ROLE = re.compile(r"\\(\\|### |</turn>|: )|### |</turn>|: ")
_IN_TEXT = re.compile(r"\\(\\|### |</turn>)|### |</turn>")
_CONTROL = {COLON: re.compile(r"### |</turn>|: "), CLOSE: re.compile(r"### |</turn>")}
_CONTROL_OR_SLASH = {COLON: re.compile(r"\\|### |</turn>|: "), CLOSE: re.compile(r"\\|### |</turn>")}


class GrammarError(ValueError):
    """Text that is not a sequence of turns."""


def read_until(text: str, at: int, end: str) -> tuple[str, int]:
    """The unescaped content from ``at`` up to the control string ``end``, and the place after that string."""
    out = []
    for m in (_IN_ROLE if end == COLON else _IN_TEXT).finditer(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        if m[1] is not None:
            out.append(m[1])
        elif m[0] == end:
            return "".join(out), at
        else:
            raise GrammarError(f"{m[0]!r} inside a turn at {m.start()}")
    raise GrammarError(f"no {end!r}")


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted text: role, text, and where the escaped text starts and ends."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise GrammarError(f"no turn at {at}")
        role, start = read_until(text, at + len(OPEN), COLON)
        said, after = read_until(text, start, CLOSE)
        if not text.startswith("\n", after):
            raise GrammarError(f"no line end at {after}")
        turns.append((role, said, start, after - len(CLOSE)))
        at = after + 1
    return turns


def escaped(text: str, end: str, level: int) -> str:
    """0: as it is; 1: control strings escaped; 2: backslashes too."""
    if level == 0:
        return text
    return (_CONTROL if level == 1 else _CONTROL_OR_SLASH)[end].sub(lambda m: "\\" + m[0], text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where its text starts and ends, escaped as little as the round trip allows."""
    for level in (0, 1, 2):
        out = f"{OPEN}{escaped(role, COLON, level)}{COLON}{escaped(text, CLOSE, level)}{CLOSE}\n"
        try:
            turns = parse(out)
        except GrammarError:
            continue
        if len(turns) == 1 and turns[0][:2] == (role, text):
            return out, turns[0][2], turns[0][3]
    raise GrammarError("a fully escaped turn did not come back")


def format_turns(turns: DataFrame) -> DataFrame:
    """One ``segment`` per turn; ``loss_from`` and ``loss_to`` bound its text (code points) where an assistant speaks, else both are 0.

    Null role or text counts as empty; null ``conv_id`` is a conversation of its own; null turns come first. Rows are
    independent, so nothing is shuffled; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            segments, a, b = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                out, start, end = write_turn(role or "", text or "")
                segments.append(out)
                a.append(start if role == LEARNT else 0)
                b.append(end if role == LEARNT else 0)
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id"), "turn": batch.column("turn"), "segment": pa.array(segments, pa.string()),
                                              "loss_from": pa.array(a, pa.int32()), "loss_to": pa.array(b, pa.int32())})

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SEGMENTS)


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of every conversation from its formatted segments: turns as parsed, and the text under the loss mask, unescaped.

    A digest over a conversation needs its turns in order, so they are brought together sorted by turn (ties: by
    segment) and streamed: a task holds one batch and two hash states, however long a conversation is.
    """

    def run(batches):
        held, rows = None, []

        def close():
            key, n, turns, chars, loss, total = held
            rows.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def batch_of():
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)],
                                              names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for key, segment, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_from", "loss_to")), strict=True):
                if held is None or held[0] != key:
                    if held is not None:
                        close()
                    held = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(segment):
                    held[1] += 1
                    held[2].update(f"{role}\n{text}\n".encode())
                if b > a or a:
                    said, _ = read_until(segment[a:b] + CLOSE, 0, CLOSE)
                    held[3] += len(said)
                    held[4].update(said.encode())
                held[5] += len(segment)
            if len(rows) >= 5000:
                yield batch_of()
                rows = []
        if held is not None:
            close()
        if rows:
            yield batch_of()

    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment").mapInArrow(run, DIGESTS)
