"""Several values packed in one text field.

The field is scanned as an Arrow string buffer: one pass of NumPy masks over
the bytes gives quote parity, thousands marks and delimiters; child offsets
follow from the piece boundaries, build a list array, and the list is flattened
with the ordinals of its parents. No Python code runs per row or per piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the notation: marks of a range, and what is only around a number.
RANGE_MARKS = r"->|=>|\.\.+|[\x{2026}\x{2010}-\x{2015}\x{2212}\x{2192}~\x{301C}\x{FF5E}]"
FRAME_BEFORE = r"(?i)\b(?:frames?|f)[ .#]*([0-9])"
FRAME_AFTER = r"(?i)([0-9]) *(?:frames?|f)\b"
JOINING_WORDS = r"(?i)\b(?:and|plus|then|also)\b"
DROPPED = b"\"'`()[]{}<>"
DELIMITERS = b";,|/&:+*=\\!%$@^_ \t\n\r\x0b\x0c"

INT_MAX = 2**31 - 1


def _normalise(texts: pa.Array) -> pa.Array:
    """Every notation of a mark as one ASCII byte, so that the byte scan can be simple."""
    s = pc.fill_null(texts.cast(pa.large_string()), "")
    for pattern, to in (
        ("[\\x{201C}\\x{201D}\\x{201E}\\x{FF02}]", '"'),
        ("[\\x{2018}\\x{2019}]", "'"),
        ("[\\p{Z}\\x{0085}]", " "),
        ("[\\x{3001}\\x{FF0C}\\x{FF1B}]", ";"),
        (RANGE_MARKS, "-"),
        (FRAME_BEFORE, r"\1"),
        (FRAME_AFTER, r"\1"),
        # a word between two numbers that is a range mark
        (r"(?i)([0-9][\])'\"]*) *\b(?:to|until|through)\b *", r"\1-"),
        # blanks around a range mark that follows a number
        (r"([0-9][\])'\"]*) +-", r"\1-"),
        (r"([0-9][\])'\"]*-) +", r"\1"),
        (JOINING_WORDS, ";"),
    ):
        p = pattern
        s = pc.replace_substring_regex(s, p, to)
    return s


def _table(members: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(members)] = True
    return mask


_DROPPED, _DELIMITER = _table(DROPPED), _table(DELIMITERS)


def scan_pieces(texts: pa.Array) -> pa.LargeListArray:
    """The non-empty pieces of each text, without quotes and brackets, in order.

    Nulls, empty and blank texts give empty lists.
    """
    s = _normalise(texts)
    if isinstance(s, pa.ChunkedArray):
        s = s.combine_chunks()
    n = len(s)
    offsets = np.frombuffer(s.buffers()[1], np.int64, n + 1, s.offset * 8)
    data = s.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    size = len(raw)
    row = np.repeat(np.arange(n), np.diff(offsets))

    # quote parity, counted from the start of each row
    quotes = np.concatenate([[0], np.cumsum(raw == 0x22)])
    inside = (quotes[:-1] - quotes[offsets[row]]) & 1 == 1

    digit = (raw >= 0x30) & (raw <= 0x39)
    same = lambda k: np.concatenate([row[k:], np.full(min(k, size), -1)])[:size] == row
    ahead = lambda k: np.concatenate([digit[k:], np.zeros(min(k, size), bool)])[:size] & same(k)
    before = np.concatenate([[False], digit[:-1]])[:size]
    thousands = (raw == 0x2C) & inside & before & ahead(1) & ahead(2) & ahead(3) & ~ahead(4)

    kept = ~(_DROPPED[raw] | thousands)
    raw, row, inner = raw[kept], row[kept], ~_DELIMITER[raw[kept]]
    first = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
    start = inner & (first | ~np.concatenate([[False], inner[:-1]])[: len(row)])

    body = raw[inner]
    where = np.concatenate([np.flatnonzero(start[inner]), [len(body)]]).astype(np.int64)
    pieces = pa.LargeStringArray.from_buffers(len(where) - 1, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(body)))
    counts = np.bincount(row[start], minlength=n) if n else np.zeros(0, np.int64)
    lists = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return pa.LargeListArray.from_arrays(pa.array(lists), pieces)


def _values(pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last number of each piece, and whether the piece is a value at all."""
    got = pc.extract_regex(pieces, r"^(?P<a>[0-9]+)(?:-(?P<b>[0-9]+))?$")
    a = got.field("a")
    b = got.field("b")
    a = pc.if_else(pc.is_valid(got), a, pa.scalar(None, a.type))
    b = pc.if_else(pc.equal(pc.fill_null(b, ""), ""), a, b)
    out = []
    for x in (a, b):
        x = pc.utf8_ltrim(x, "0")
        x = pc.if_else(pc.equal(x, ""), "0", x)
        x = pc.if_else(pc.less_equal(pc.utf8_length(x), 10), x, pa.scalar(None, x.type))
        out.append(pc.fill_null(pc.cast(x, pa.int64()), -1).to_numpy(zero_copy_only=False))
    ok = (out[0] >= 0) & (out[1] >= 0) & (out[0] <= INT_MAX) & (out[1] <= INT_MAX)
    return out[0], out[1], ok


def _explode_batch(batch: pa.RecordBatch, column: str, keep: list[str]) -> pa.RecordBatch:
    lists = scan_pieces(batch.column(batch.schema.names.index(column)))
    pieces, counts = lists.values, np.diff(lists.offsets.to_numpy())
    parent = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(len(parent)) - lists.offsets.to_numpy()[parent] + 1
    a, b, ok = _values(pieces)
    # a field that is only 0 says that there is nothing
    ok &= ~((counts[parent] == 1) & (a == 0) & (b == 0) & ~pc.match_substring(pieces, "-").to_numpy(zero_copy_only=False))
    at = np.flatnonzero(ok)
    columns = [batch.column(batch.schema.names.index(k)).take(pa.array(parent[at])) for k in keep]
    columns += [pa.array(x[at], pa.int32()) for x in (pos, a, b)]
    return pa.RecordBatch.from_arrays(columns, names=[*(f"k{i}" for i in range(len(keep))), "pos", "start_frame", "end_frame"])


def unpack_ranges(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """One row per readable value of ``column``: ``keep``, ``pos``, ``start_frame``, ``end_frame``.

    A value is two whole numbers joined by a range mark, as written even if
    reversed, or one number ``n``, read as ``n`` to ``n``. Unreadable pieces take
    a position but give no row, as do numbers beyond a 32-bit integer. Null, empty
    and blank fields and a field that is only 0 give none; a repeated value is
    listed once for each position. ``keep`` may hold a column named like an output
    column: its values then go first, under the same name.
    """
    slim = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)], F.col(f"`{column}`").cast("string").alias("text"))
    schema = ", ".join([f"k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keep)] + ["pos int", "start_frame int", "end_frame int"])
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _explode_batch(b, "text", names)

    return slim.mapInArrow(run, schema).toDF(*keep, "pos", "start_frame", "end_frame")


def packed_sources(annotations: DataFrame, gt: DataFrame) -> list[tuple[str, DataFrame, str]]:
    """The two annotation tables with the name and the packed column of each."""
    return [("test_annotations", annotations, "anomaly_frames"), ("test_gt", gt, "anomaly_ranges")]
