"""Numpy kernels over the texts of one Arrow batch: words, word hashes and shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once (one longer text is still taken whole).
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_P1, _P2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes each output bit about half the time."""
    x = (x ^ (x >> _S33)) * _P1
    x = (x ^ (x >> _S33)) * _P2
    return x ^ (x >> _S33)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None and len(o) else np.zeros(0, dtype=np.uint8)
    return d, o - o[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts: byte ranges, the text of each word, hashes on demand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.data = _LOWER[data] if lower else data
        self.offsets, self.n_texts = offsets, len(offsets) - 1
        inside = ~_SPACE[data]
        before, after = np.empty_like(inside), np.empty_like(inside)
        if len(data):
            before[1:], after[:-1] = inside[:-1], inside[1:]
            bounds = offsets[:-1][offsets[:-1] < offsets[1:]]  # starts of texts that aren't empty
            before[bounds], after[bounds - 1] = False, False
            before[0] = after[-1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: First word of each text, and one more entry for the end.
        self.first = np.searchsorted(self.starts, offsets)
        self.text = np.repeat(np.arange(self.n_texts), np.diff(self.first))
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = word_hashes(self.data, self.starts, self.ends)
        return self._hashes

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, first shingle of each text): ``k`` words each; a text of fewer words has one of all of them."""
        h, n = self.hashes, np.diff(self.first)
        count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
        first = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(first[-1]) - np.repeat(first[:-1] - self.first[:-1], count)
        left = np.repeat(np.minimum(n, k), count)
        acc = mix(left.astype(np.uint64) * _GOLD)
        for j in range(k):
            has = left > j
            if has.all():
                acc = mix(acc * _P1 + h[at + j])
            else:
                acc[has] = mix(acc[has] * _P1 + h[at[has] + j])
        return acc, first


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes at a time for all ranges together."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    lanes = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    length = ends - starts
    h = mix((length.astype(np.uint64) + np.uint64(1)) * _GOLD)
    live, at, left = slice(None), starts, length
    while len(at):
        h[live] = mix(h[live] * _P2 + (lanes[at] & _MASK[np.minimum(left, 8)]))
        more = left > 8
        if not more.any():
            break
        live = np.flatnonzero(more) if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def bit_sums(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text, how many of its hashes have bit 0, 1, ... 63 set (texts x 64)."""
    out = np.zeros((len(first) - 1, 64), dtype=np.int32)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        bits = np.unpackbits(np.ascontiguousarray(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[full] = np.add.reduceat(bits, first[:-1][full], axis=0, dtype=np.int32)
    return out


def majority(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit values with a bit set where it is set in over half of the n hashes."""
    return np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
