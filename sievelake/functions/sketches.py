"""Bottom-k sketches of texts by an Arrow kernel: FNV-1a over the bytes of overlapping word sequences, all sequences of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.functions.text import words

_START, _PRIME = np.uint32(2166136261), np.uint32(16777619)
#: Bytes of text worked on at once (one longer text is still taken whole).
_CHUNK = 1 << 20


def fnv1a_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """FNV-1a, 32 bits, of byte ranges: one byte of each range at a time, longest ranges first."""
    order = np.argsort(starts - ends, kind="stable")
    at, size = starts[order], (ends - starts)[order]
    h = np.full(len(order), _START, dtype=np.uint32)
    for j in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -j, side="left"))
        h[:live] = (h[:live] ^ data[at[:live] + j]) * _PRIME
    out = np.empty_like(h)
    out[order] = h
    return out


def text_sketches(texts: list[str], k: int, n: int) -> list[np.ndarray]:
    """For texts of words with single blanks, the ``k`` least distinct hashes of their ``n``-word sequences; of fewer words, of all of them."""
    data = np.frombuffer(" ".join(texts).encode("ascii") + b" ", dtype=np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = np.array([t.count(" ") + 1 if t else 0 for t in texts])
    first = np.cumsum(np.concatenate([[0], np.maximum(count, 1)]))  # an empty text takes one empty place
    out = []
    shingles = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    row = np.repeat(np.arange(len(texts)), shingles)
    step = np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    a = first[row] + step
    hashes = fnv1a_ranges(data, starts[a], ends[np.minimum(a + n, first[row] + count[row]) - 1])
    for own in np.split(hashes, np.cumsum(shingles)[:-1]) if len(texts) else []:
        out.append(np.unique(own)[:k])
    return out


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 512, n: int = 5) -> DataFrame:
    """(id, sketch array<long>) of every row: the ``k`` least distinct hashes in order; empty for a null text or one without words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, lo, size = batch.column("w").to_pylist(), [], 0, 0
            for k_, t in enumerate(texts, start=1):
                size += len(t)
                if size >= _CHUNK or k_ == len(texts):
                    found += text_sketches(texts[lo:k_], k, n)
                    lo, size = k_, 0
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.astype(np.int64) for s in found], pa.list_(pa.int64()))], [id_col, "sketch"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.array_join(words(F.col(text_col)), " "), F.lit("")).alias("w"))
    return rows.mapInArrow(run, f"{id_col} {kind}, sketch array<bigint>")
