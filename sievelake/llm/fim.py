"""Fill-in-the-middle by a numpy kernel over the UTF-8 buffers of a whole Arrow batch.

Byte classes mark line ends and first bytes of characters; a mask over neighbouring bytes marks where a unit (line) begins; sums that are reset at each
document number units and characters; one searchsorted finds the cuts of all rows; one gather writes all outputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sievelake.llm._session import fresh, python_stage
from sievelake.llm._text import chunks, flat

_LINE_END, _CHARACTER = 1, 2
_CLASS = np.full(256, _CHARACTER, dtype=np.uint8)
_CLASS[0x80:0xC0] = 0
_CLASS[0x0A] |= _LINE_END
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ["plain", "psm", "spm"]


@dataclass(frozen=True)
class Layout:
    """Strings before prefix, suffix and middle, and the shares in hundredths of cut texts, and of suffix first among them. No proper beginning of a string may be its end."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    cut_percent: int = 100
    spm_percent: int = 50

    @property
    def marks(self) -> list[bytes]:
        return [x.encode() for x in (self.prefix, self.suffix, self.middle)]


def occurrences(data: np.ndarray, offsets: np.ndarray, mark: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(row, first byte) of all places of ``mark`` that lie in one text."""
    at = np.flatnonzero(data[: max(0, len(data) - len(mark) + 1)] == mark[0])
    for k, b in enumerate(mark[1:], 1):
        at = at[data[at + k] == b]
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + len(mark) <= offsets[row + 1]
    return row[inside], at[inside]


def line_cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines of each text, first byte of its middle, first byte of its suffix)."""
    begins = np.zeros(len(data), dtype=bool)
    begins[1:] = (_CLASS[data[:-1]] & _LINE_END) > 0
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    upto = np.concatenate([[0], np.cumsum(begins)])
    n = np.diff(upto[offsets])
    one, two = h1 % (n + 1), h2 % (n + 1)
    # a number of lines of a text, counted from the first line of all texts; past its last line is the end of the text
    place = lambda k: np.where(k == n, offsets[1:], np.searchsorted(upto[1:], upto[offsets[:-1]] + k + 1))
    return n, place(np.minimum(one, two)), place(np.maximum(one, two))


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of rows that are the ranges in their rows of ``start`` and ``size`` one after the other."""
    flat_size = size.ravel()
    ends = np.cumsum(flat_size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start.ravel() - (ends - flat_size), flat_size)
    return data[at], np.concatenate([[0], np.cumsum(size.sum(axis=1))])


def cut_texts(data: np.ndarray, offsets: np.ndarray, hashes: list[np.ndarray], layout: Layout) -> tuple[np.ndarray, ...]:
    """(lines, form, characters of prefix, of middle, output bytes, output offsets) of all texts of a batch."""
    h1, h2, h3, h4 = hashes
    n, one, two = line_cuts(data, offsets, h1, h2)
    form = np.where(h4 % 100 < layout.spm_percent, SPM, PSM)
    form[(np.diff(offsets) == 0) | (h3 % 100 >= layout.cut_percent)] = PLAIN
    for mark in layout.marks:
        form[occurrences(data, offsets, mark)[0]] = PLAIN
    upto = np.concatenate([[0], np.cumsum((_CLASS[data] & _CHARACTER) > 0)])
    begin, end = offsets[:-1], offsets[1:]
    marks, every = layout.marks, np.concatenate([data, np.frombuffer(b"".join(layout.marks), dtype=np.uint8)])
    size_of = np.array([len(x) for x in marks])
    mark_at = len(data) + np.cumsum(size_of) - size_of
    # each row: mark, part, mark, part, mark, part; a plain text is one part
    parts = {"prefix": (begin, one - begin), "suffix": (two, end - two), "middle": (one, two - one)}
    start, size = np.zeros((len(n), 6), dtype=np.int64), np.zeros((len(n), 6), dtype=np.int64)
    for kind, order in ((PSM, ("prefix", "suffix", "middle")), (SPM, ("suffix", "prefix", "middle"))):
        own = form == kind
        for k, name in enumerate(order):
            which = ("prefix", "suffix", "middle").index(name)
            start[own, 2 * k], size[own, 2 * k] = mark_at[which], size_of[which]
            start[own, 2 * k + 1], size[own, 2 * k + 1] = parts[name][0][own], parts[name][1][own]
    plain = form == PLAIN
    start[plain, 0], size[plain, 0] = begin[plain], (end - begin)[plain]
    return n, form, upto[one] - upto[begin], upto[two] - upto[one], *gathered(every, start, size)


def rebuilt_texts(data: np.ndarray, offsets: np.ndarray, form: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts that outputs of these forms were made from."""
    marks = layout.marks
    at = np.zeros((3, len(form)), dtype=np.int64)
    for k, mark in enumerate(marks):
        row, place = occurrences(data, offsets, mark)
        first = np.unique(row, return_index=True)
        at[k, first[0]] = place[first[1]]
    p, s, m = at
    size_of = [len(x) for x in marks]
    end = offsets[1:]
    prefix, suffix, middle = p + size_of[0], s + size_of[1], m + size_of[2]
    prefix_end, suffix_end = np.where(form == PSM, s, m), np.where(form == PSM, m, p)
    start = np.stack([prefix, middle, suffix], axis=1)
    size = np.stack([prefix_end - prefix, end - middle, suffix_end - suffix], axis=1)
    plain = form == PLAIN
    start[plain], size[plain] = 0, 0
    start[plain, 0], size[plain, 0] = offsets[:-1][plain], np.diff(offsets)[plain]
    return gathered(data, start, size)


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())


def fill_in_middle(docs: DataFrame, salt: str = "7:", layout: Layout | None = None) -> DataFrame:
    """Every row of ``docs``: doc_id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output.

    Two cuts between lines are drawn by the sha256 of ``salt`` and the decimal doc_id (a null id: ``salt`` alone). A null text is empty, an empty text and one that
    holds a mark of ``layout`` stay plain. Equal ids draw equal hashes; repeated rows come out alike. A text of any length is cut whole; an empty table gives
    no rows; other columns, whatever their names, are not carried.
    """
    layout = layout or Layout()
    python_stage(docs.sparkSession)
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(key, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            drawn = [batch.column(f"h{k}").to_numpy() for k in range(1, 5)]
            for lo, hi in chunks(offsets):
                a, own = offsets[lo], offsets[lo : hi + 1] - offsets[lo]
                n, form, prefix, middle, out, ends = cut_texts(data[a : offsets[hi]], own, [h[lo:hi] for h in drawn], layout)
                plain = form == PLAIN
                columns = [pa.array(n, pa.int64()), pa.array(np.array(FORMS)[form], pa.string()), *[pa.array(x, pa.int64(), mask=plain) for x in (prefix, middle)], _strings(out, ends)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *hashes).mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(cut: DataFrame, layout: Layout | None = None) -> DataFrame:
    """``cut`` (all columns, among them output and form) with ``restored``: the text that the output was made from."""
    layout = layout or Layout()
    python_stage(cut.sparkSession)
    name = fresh("restored", cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("output"))
            form = np.select([batch.column("form").to_numpy(zero_copy_only=False) == x for x in FORMS], range(len(FORMS)), PLAIN)
            for lo, hi in chunks(offsets):
                a, own = offsets[lo], offsets[lo : hi + 1] - offsets[lo]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, _strings(*rebuilt_texts(data[a : offsets[hi]], own, form[lo:hi], layout))], [*part.schema.names, name])

    return cut.mapInArrow(run, StructType([*cut.schema.fields, StructField(name, StringType())]))
