"""Chat formatting by columnar byte assembly.

A turn becomes ``### <role>: <text></turn>`` and a line end. Backslash, ``#`` and ``<`` of a text are written as a backslash and a
letter (``:`` of a role too), so no control string can stand inside a text, and reading back is exact.

For a batch of turns numpy computes the lengths of all segments, their cumulative offsets, and for every byte its place in the output; one
preallocated buffer receives headers and contents and becomes an Arrow column without a copy per row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacansift.llm.arrow_text import pieces, strings, utf8

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"
_LETTERS = {"\\": "\\", "#": "h", "<": "l", ":": "c"}
_BACK = {letter: sign for sign, letter in _LETTERS.items()}
_ESCAPED = re.compile(r"\\(.)", re.S)

SEGMENTS = "conv_id long, turn long, formatted string, loss_start long, loss_end long"


def _escape_table(signs: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for sign in signs:
        table[ord(sign)] = ord(_LETTERS[sign])
    return table


_TEXT_TABLE, _ROLE_TABLE = _escape_table("\\#<"), _escape_table("\\#<:")


def _escaped(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    letters = table[data]
    special = letters > 0
    before = np.concatenate([[0], np.cumsum(special)])
    out = np.empty(len(data) + before[-1], np.uint8)
    place = np.arange(len(data)) + before[1:]
    out[place] = np.where(special, letters, data)
    out[place[special] - 1] = ord("\\")
    return out, offsets + before[offsets]


def assembled(parts: list[bytes | tuple[np.ndarray, np.ndarray]], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows joined from parts: the same bytes in every row, or a column of bytes with offsets."""
    lengths = [np.full(rows, len(p)) if isinstance(p, bytes) else np.diff(p[1]) for p in parts]
    offsets = np.concatenate([[0], np.cumsum(np.sum(lengths, axis=0, dtype=np.int64))]).astype(np.int64)
    out = np.empty(offsets[-1], np.uint8)
    start = offsets[:-1].copy()
    for part, length in zip(parts, lengths, strict=True):
        if isinstance(part, bytes):
            out[start[:, None] + np.arange(len(part))] = np.frombuffer(part, np.uint8)
        else:
            data, own = part
            out[np.repeat(start - own[:-1], length) + np.arange(len(data))] = data
        start = start + length
    return out, offsets


def _chars(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each row."""
    counts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.diff(counts[offsets])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole):
            role = _escaped(*utf8(batch.column("role")), _ROLE_TABLE)
            text = _escaped(*utf8(batch.column("text")), _TEXT_TABLE)
            formatted = assembled([OPEN.encode(), role, MIDDLE.encode(), text, CLOSE.encode()], batch.num_rows)
            start = len(OPEN) + _chars(*role) + len(MIDDLE)
            other = np.array([r != LOSS_ROLE for r in batch.column("role").to_pylist()], bool)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    batch.column("turn"),
                    strings(*formatted),
                    pa.array(start, pa.int64(), mask=other),
                    pa.array(start + _chars(*text), pa.int64(), mask=other),
                ],
                names=["conv_id", "turn", "formatted", "loss_start", "loss_end"],
            )


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, formatted, loss_start, loss_end; rows of a conversation stand together, in order.

    The formatted conversation is its rows' ``formatted``, joined. The loss mask covers code points loss_start to loss_end (exclusive)
    of assistant rows and is null elsewhere. Texts and roles that are null count as empty. Turns with equal numbers follow role, then
    text; null turns come first, and rows with a null conversation make up one conversation. Other columns are ignored; an empty table gives no rows.

    A conversation is never held as a whole: its turns pass as a sorted stream, so even a very long one needs only one batch of memory.
    """
    return (
        turns.select(
            F.col("conv_id").cast("long"),
            F.col("turn").cast("long"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(_format, SEGMENTS)
    )


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


def parsed(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, _, rest = segment.removeprefix(OPEN).partition(MIDDLE)
    return unescaped(role), unescaped(rest.removesuffix(CLOSE))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)))
    nothing = object()
    current, n, chars, loss_chars = nothing, 0, 0, 0
    turns, loss = hashlib.sha256(), hashlib.sha256()
    for batch in batches:
        done = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")]
        for conv, segment, start, end in zip(*columns, strict=True):
            if conv != current:
                if current is not nothing:
                    done.append((current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                current, n, chars, loss_chars = conv, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            role, text = parsed(segment)
            turns.update(f"{role}\n{text}\n".encode())
            n += 1
            chars += len(segment)
            if start is not None:
                masked = unescaped(segment[start:end])
                loss.update(masked.encode())
                loss_chars += len(masked)
        yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in done], schema)
    if current is not nothing:
        last = (current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)
        yield pa.RecordBatch.from_pylist([dict(zip(names, last, strict=True))], schema)


def digests(segments: DataFrame) -> DataFrame:
    """Digests of conversations, read back from the rows of :func:`format_turns` in the tasks that made them."""
    return segments.mapInArrow(
        _digest,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
