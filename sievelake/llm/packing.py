"""Best-fit packing of texts into sequences of several permitted lengths.

Pieces come longest first. A piece goes into the open bin that it fills best; if none takes it, a bin is opened in the
size with the least cost for each packed token, judged by filling each size with the pieces still to come.
At the end each bin shrinks to the least permitted size that holds its contents. Rows are dealt by global row number into
groups of equal size, which are packed apart.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm._rows import with_row_number
from sievelake.llm._session import python_stage

SIZES = (2048, 4096, 8192, 16384)
#: Rows packed together; a group leaves at most a few bins part empty.
GROUP_ROWS = 8_192


def pack(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = lambda c: c + 64.0) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each piece, size of each bin). Pieces must be 1 .. the largest size long; ``cost`` is that of one bin."""
    sizes = tuple(sorted(sizes))
    order = np.argsort(-lengths, kind="stable").tolist()
    left = np.bincount(lengths, minlength=sizes[-1] + 1).tolist()
    waiting = 0  # bit n: a piece of n tokens is still to come
    for n in np.unique(lengths).tolist():
        waiting |= 1 << n
    at = np.empty(len(lengths), dtype=np.int64)
    used: list[int] = []
    capacity: list[int] = []
    open_bins: dict[int, list[int]] = {}  # by free tokens
    free = 0  # bit r: an open bin has r tokens free

    def filled(room: int) -> int:
        """Tokens of waiting pieces that go into ``room``, longest first."""
        total, most = 0, room
        while fits := waiting & ((1 << (min(room, most) + 1)) - 1):
            n = fits.bit_length() - 1
            take = min(left[n], room // n)
            total, room, most = total + take * n, room - take * n, n - 1
        return total

    for i in order:
        n = int(lengths[i])
        left[n] -= 1
        if not left[n]:
            waiting &= ~(1 << n)
        fits = free >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                free &= ~(1 << room)
        else:
            size = min((c for c in sizes if c >= n), key=lambda c: (cost(c) / (n + filled(c - n)), c))
            b, room = len(used), size
            used.append(0)
            capacity.append(size)
        at[i] = b
        used[b] += n
        room -= n
        if room:
            open_bins.setdefault(room, []).append(b)
            free |= 1 << room
    final = np.array([next(c for c in sizes if c >= u) for u in used], dtype=np.int64)
    return at, final


def byte_tokens(text: Column) -> Column:
    """Tokens of a byte-level vocabulary, and one that ends the text."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def packed(docs: DataFrame, tokens: Column | None = None, sizes: tuple[int, ...] = SIZES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row for each bin: bin_id, size, used, doc_ids, pieces array<struct<doc_id, offset, length>> in the order of the bin.

    ``tokens`` gives a row's length (default ``byte_tokens``). A text longer than the largest size is cut into pieces of
    that size and a rest; every token is in one piece. Null and empty texts are a piece of one token. Ids are carried as they are, nulls
    too. Repeated rows are packed each for itself; of equal pieces the one first by id comes first; other columns are not carried; an empty table has no bins.
    """
    python_stage(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    length = byte_tokens(F.col("text")) if tokens is None else tokens
    numbered, _ = with_row_number(docs.select("doc_id", length.alias("length")), ["doc_id", "length"])
    grouped = numbered.withColumn("group", F.floor(F.col("row_number") / group_rows).cast("long"))
    most = max(sizes)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("row_number")
        n = group.column("length").to_numpy()
        parts = -(-n // most)
        row = np.repeat(np.arange(len(n)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(most, n[row] - part * most)
        at, bins = pack(size, tuple(sizes))
        by = np.argsort(at, kind="stable")
        ids = pc.take(group.column("doc_id"), pa.array(row[by])).combine_chunks()
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(bins)))]).astype(np.int32))
        pieces = pa.StructArray.from_arrays([ids, pa.array(part[by] * most), pa.array(size[by])], ["doc_id", "offset", "length"])
        first = int(group.column("group")[0].as_py()) << 32
        return pa.table(
            {
                "bin_id": first + np.arange(len(bins)),
                "size": bins,
                "used": np.bincount(at, size, len(bins)).astype(np.int64),
                "doc_ids": pa.ListArray.from_arrays(ends, ids),
                "pieces": pa.ListArray.from_arrays(ends, pieces),
            }
        )

    schema = f"bin_id long, size long, used long, doc_ids array<{kind}>, pieces array<struct<doc_id:{kind},offset:long,length:long>>"
    return grouped.groupBy("group").applyInArrow(run, schema)
