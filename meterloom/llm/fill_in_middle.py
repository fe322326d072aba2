"""Texts cut into prefix, middle and suffix, and put in another order, by a numpy kernel over whole batches.

The kernel reads the UTF-8 buffer that Arrow holds a batch of texts in. A table gives each byte its class,
a second one tells of two neighbouring bytes' classes whether a unit ends between them, and a text's last
byte ends one always. Running sums of the ends, less what they were where a text begins, number the units
of all texts at once, and one search finds the cuts of all rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of text that the kernel takes at once; a longer text is taken alone.
BATCH_BYTES = 4 << 20
FORMS = ("plain", "psm", "spm")
_SCHEMA = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


@dataclass(frozen=True)
class Units:
    """classes: of each byte value; ends[a, b]: a unit ends between a byte of class a and one of class b."""

    classes: np.ndarray
    ends: np.ndarray


def _units(groups: dict[int, bytes], ends: list[tuple[int, int]], size: int) -> Units:
    classes, table = np.zeros(256, np.uint8), np.zeros((size, size), bool)
    for number, members in groups.items():
        classes[np.frombuffer(members, np.uint8)] = number
    for pair in ends:
        table[pair] = True
    return Units(classes, table)


_BLANKS, _CONTINUED = b" \t\n\v\f\r", bytes(range(0x80, 0xC0))
#: Lines with their \n; words with the white space behind them; code points.
UNITS = {
    "line": _units({1: b"\n"}, [(1, 0), (1, 1)], 2),
    "word": _units({1: _BLANKS}, [(1, 0)], 2),
    "char": _units({1: _CONTINUED}, [(0, 0), (1, 0)], 2),
}


def _holds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, mark: bytes) -> np.ndarray:
    """For each text whether it holds the mark."""
    last = len(data) - len(mark) + 1
    if last <= 0:
        return np.zeros(len(starts), bool)
    met = data[:last] == mark[0]
    for i, byte in enumerate(mark[1:], 1):
        met &= data[i : last + i] == byte
    at = np.flatnonzero(met)
    # The first place at or after a text's beginning decides: it has to end within the text.
    first = np.append(at, len(data))[np.searchsorted(at, starts)]
    return first + len(mark) <= ends


def cuts(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, units: Units) -> tuple[np.ndarray, ...]:
    """Of the texts data[offsets[i] : offsets[i + 1]]: their units, the bytes at which prefix and middle end,
    and the code points of both. A text of n units is cut after first % (n + 1) and second % (n + 1) of
    them, the smaller first."""
    starts, stops = offsets[:-1], offsets[1:]
    classes = units.classes[data]
    ends = np.zeros(len(data), bool)
    if len(data):
        ends[:-1] = units.ends[classes[:-1], classes[1:]]
        ends[stops[stops > starts] - 1] = True
    wide = np.int32 if len(data) < 2**31 else np.int64
    counted = np.zeros(len(data) + 1, wide)
    np.cumsum(ends, out=counted[1:])
    base = counted[starts]
    n = (counted[stops] - base).astype(np.int64)
    a, b = first % (n + 1), second % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    # counted[k] is the number of units that end before byte k: the first k that has enough is the cut.
    one, two = (np.searchsorted(counted, (base + k).astype(wide)) for k in (low, high))
    points = np.zeros(len(data) + 1, wide)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    return n, one, two, (points[one] - points[starts]).astype(np.int64), (points[two] - points[one]).astype(np.int64)


def _transformed(texts: pa.Array, draws: np.ndarray, units: Units, rate: int, spm_rate: int, marks: tuple[bytes, ...]) -> list[pa.Array]:
    texts = texts.fill_null("") if texts.null_count else texts
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, where, held = texts.buffers()
    offsets = np.frombuffer(where, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = memoryview(held or b"")[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = np.frombuffer(whole, np.uint8)
    n, one, two, prefix, middle = cuts(data, offsets, draws[0], draws[1], units)
    plain = (n == 0) | (draws[2] % 100 >= rate)
    for mark in marks:
        plain |= _holds(data, offsets[:-1], offsets[1:], mark)
    form = np.where(plain, 0, np.where(draws[3] % 100 < spm_rate, 2, 1))
    p, s, m = marks
    parts: list = []
    for kind, start, x, y, stop in zip(form.tolist(), offsets[:-1].tolist(), one.tolist(), two.tolist(), offsets[1:].tolist()):
        if kind == 0:
            parts.append(whole[start:stop])
        elif kind == 1:
            parts += (p, whole[start:x], s, whole[y:stop], m, whole[x:y])
        else:
            parts += (s, whole[y:stop], p, whole[start:x], m, whole[x:y])
    grown = np.diff(offsets) + np.where(plain, 0, sum(map(len, marks)))
    places = np.concatenate([[0], np.cumsum(grown)]).astype(np.int32)
    output = pa.StringArray.from_buffers(len(texts), pa.py_buffer(places), pa.py_buffer(b"".join(parts)))
    return [
        pa.array(n),
        pa.array(FORMS).take(pa.array(form)),
        pa.array(prefix, mask=plain),
        pa.array(middle, mask=plain),
        output,
    ]


def _slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows of about `size` bytes, or of one row."""
    groups = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) // size
    start = 0
    for stop in [*(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(texts)]:
        if stop > start:
            yield start, stop
        start = stop


def fill_in_middle(df: DataFrame, *, seed: int = 7, rate: int = 100, spm_rate: int = 50, unit: str = "line", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """df's doc_id, beside n (units of the text), form, prefix_chars, middle_chars (code points) and output
    for each row of df (doc_id, text).

    Prefix and middle end after whole units (`line`, `word` or `char`), drawn by the sha256 of `seed:doc_id`:
    its first four groups of 8 hexadecimal digits are h1 to h4. The prefix ends after the smaller of
    h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. Of 100 texts `rate` are put in
    another order (h3), of those `spm_rate` begin with the suffix (h4); marks stand before prefix,
    suffix and middle. An empty or null text, one that holds a mark and one that h3 leaves out are
    `plain`: output is the text, and both counts of code points are null. A null doc_id draws as an empty
    one, so rows with the same doc_id are cut alike. An empty table gives an empty table."""
    hashed, own = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), StructType.fromDDL(_SCHEMA)
    draws = [F.conv(F.substring(hashed, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    docs, raw, units = df.select("doc_id", "text", *draws), tuple(mark.encode() for mark in marks), UNITS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _slices(batch.column(1), BATCH_BYTES):
                part = batch.slice(start, stop - start)
                drawn = np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)])
                yield pa.RecordBatch.from_arrays([part.column(0), *_transformed(part.column(1), drawn, units, rate, spm_rate, raw)], names=["doc_id", *own.names])

    return docs.mapInArrow(run, StructType([docs.schema["doc_id"], *own.fields]))


def restored(output: str | Column = "output", form: str | Column = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of fill_in_middle() was made from, by its form."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = marks
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)

    def between(first: str, second: str) -> tuple[Column, Column]:
        inside = F.substring(head, len(first) + 1, F.length(head))
        return F.substring_index(inside, second, 1), F.substring_index(inside, second, -1)

    prefix, suffix = between(p, s)
    behind, before = between(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(before, middle, behind)).otherwise(output)
