"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over fingerprint blocks, exact verification.

A window that shares no shingle with any item has similarity 0 to all, so only windows around a shared shingle
are fingerprinted. Of two fingerprints within the radius, one of eight byte-wide blocks differs in at most an eighth of
it: the items that are so near in one of the eight hold every item in the radius. Candidates are then verified by their shingles,
weighted by how often they occur. Items too short for a shingle are looked for as whole sequences of words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm._session import python_stage
from sievelake.llm._text import Words, chunks, flat, majority, mix

#: Items matched in one pass, and bytes of their texts; more items are matched in several passes. An index takes about 40 bytes for each word.
ITEMS_PER_PASS = 32_768
BYTES_PER_PASS = 16 << 20
#: Shingles of a text fingerprinted at once.
_REGION = 1 << 14
_BLOCKS = 8
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32
_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


def words_of(texts: pa.Array) -> Words:
    """Lower-cased words of letters and digits; all else separates."""
    data, offsets = flat(pc.utf8_lower(texts))
    return Words(_PLAIN[data], offsets, lower=False)


def _bits(shingles: np.ndarray) -> np.ndarray:
    """Running sums of the 64 fingerprint bits (one row more than shingles)."""
    bits = np.unpackbits(np.ascontiguousarray(mix(shingles), dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.concatenate([np.zeros((1, 64), dtype=np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


@dataclass
class Index:
    """Items of one pass, first those of ``k`` words or more. The shingles of item i are ``own[first[i]:first[i + 1]]``, sorted; the items with
    ``shingles[j]`` are ``owners[begin[j]:begin[j + 1]]``. ``short``: the others, by their number of words and the hash of them all."""

    k: int
    radius: int
    ids: list
    sizes: np.ndarray
    prints: np.ndarray
    own: np.ndarray
    first: np.ndarray
    shingles: np.ndarray
    owners: np.ndarray
    begin: np.ndarray
    gate: np.ndarray
    short: dict[int, dict[int, list[int]]]

    @staticmethod
    def of(ids: list, texts: list[str], k: int, radius: int) -> Index:
        words = words_of(pa.array(texts, pa.string()))
        every, at = words.shingles(k)
        n = np.diff(words.first)
        kept, rest = np.flatnonzero(n >= k), np.flatnonzero((n > 0) & (n < k))
        sets = [np.sort(every[at[i] : at[i + 1]]) for i in kept]
        own = np.concatenate([np.zeros(0, dtype=np.uint64), *sets])
        first = np.cumsum([0, *map(len, sets)])
        prints = np.array([majority(_bits(s)[-1:], np.array([len(s)]))[0] for s in sets], dtype=np.uint64)
        item = np.repeat(np.arange(len(kept)), np.diff(first))
        order = np.lexsort((item, own))
        new = np.ones(len(own), dtype=bool)
        new[1:] = (own[order][1:] != own[order][:-1]) | (item[order][1:] != item[order][:-1])
        owners = item[order][new]
        shingles, begin = np.unique(own[order][new], return_index=True)
        gate = np.zeros(1 << 20, dtype=bool)
        gate[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        short: dict[int, dict[int, list[int]]] = {}
        for place, i in enumerate(rest.tolist(), start=len(kept)):
            short.setdefault(int(n[i]), {}).setdefault(int(every[at[i]]), []).append(place)
        return Index(k, radius, [ids[i] for i in (*kept, *rest)], n[kept], prints, own, first, shingles, owners, np.append(begin, len(owners)), gate, short)

    def weights(self, item: int) -> Counter:
        return Counter(self.own[self.first[item] : self.first[item + 1]].tolist())

    def sharing(self, shingles: np.ndarray) -> np.ndarray:
        """Items that have one of some shingles, all of which must be known."""
        j = np.searchsorted(self.shingles, np.unique(shingles))
        size = self.begin[j + 1] - self.begin[j]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.begin[j], size)
        return np.unique(self.owners[at])

    def match(self, shingles: np.ndarray, n_words: int, hits: np.ndarray, least: float) -> Iterator[tuple[int, float, int, int, int]]:
        """(item, similarity, first word, words, differing bits) of a text: the best window for each item, the first of equals."""
        found: dict[int, tuple[float, int, int, int]] = {}
        # hits further apart than the longest item share no window
        longest = int(self.sizes.max())
        for part in np.split(hits, np.flatnonzero(np.diff(hits) > longest) + 1):
            for lo in range(0, len(part), _REGION):
                self._region(shingles, n_words, part[lo : lo + _REGION], least, found)
        for item in sorted(found):
            yield item, *found[item]

    def _region(self, shingles, n_words, hits, least, found) -> None:
        items = self.sharing(shingles[hits])
        weights = {int(i): self.weights(i) for i in items}
        sizes = self.sizes[items]
        base = max(0, int(hits[0]) - int(sizes.max()))
        sums = _bits(shingles[base : min(len(shingles), int(hits[-1]) + int(sizes.max()))])
        for size in np.unique(sizes):
            own = items[sizes == size]
            width = max(1, min(int(size), n_words) - self.k + 1)  # a shorter text is one window
            starts = np.unique((hits[:, None] - np.arange(width)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts + width <= len(shingles))]
            if not len(starts):
                continue
            prints = majority(sums[starts - base + width] - sums[starts - base], np.full(len(starts), width))
            blocks = prints.astype("<u8").view(np.uint8).reshape(-1, _BLOCKS)
            near = np.zeros((len(starts), len(own)), dtype=bool)
            theirs = self.prints[own].astype("<u8").view(np.uint8).reshape(-1, _BLOCKS)
            for b in range(_BLOCKS):
                near |= _NEAR[blocks[:, b][:, None], theirs[:, b][None, :]] <= self.radius // _BLOCKS
            at, which = np.nonzero(near)
            bits = np.bitwise_count(prints[at] ^ self.prints[own[which]])
            for a, item, d in zip(at[bits <= self.radius], own[which[bits <= self.radius]], bits[bits <= self.radius], strict=True):
                s = int(starts[a])
                shared = sum((Counter(shingles[s : s + width].tolist()) & weights[int(item)]).values()) / weights[int(item)].total()
                if shared >= least and (item not in found or (shared, -s) > (found[item][0], -found[item][1])):
                    found[int(item)] = (shared, s, int(min(size, n_words)), int(d))


def _passes(items: DataFrame, k: int, radius: int) -> Iterator[Index]:
    """Indexes over all items, each bounded in items and bytes; items come to the driver one pass at a time."""
    pass_ids, pass_texts, size = [], [], 0
    for row in items.where(F.col("text").isNotNull()).select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if pass_ids and (len(pass_ids) >= ITEMS_PER_PASS or size + len(row["text"]) > BYTES_PER_PASS):
            yield Index.of(pass_ids, pass_texts, k, radius)
            pass_ids, pass_texts, size = [], [], 0
        pass_ids.append(row["item_id"])
        pass_texts.append(row["text"])
        size += len(row["text"])
    yield Index.of(pass_ids, pass_texts, k, radius)


def _hits(batch_texts: pa.Array, index: Index, least: float) -> Iterator[tuple[int, tuple]]:
    """(row, match) for the texts of a batch."""
    if not len(index.ids):
        return
    offsets = flat(batch_texts)[1]
    for lo, hi in chunks(offsets):
        words = words_of(batch_texts.slice(lo, hi - lo))
        shingles, first = words.shingles(index.k)
        some = np.flatnonzero(index.gate[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)])
        some = some[np.isin(shingles[some], index.shingles)]
        rows = np.searchsorted(first, some, side="right") - 1
        for row in np.unique(rows):
            own = some[rows == row] - first[row]
            n_words = int(words.first[row + 1] - words.first[row])
            if n_words >= index.k:
                for match in index.match(shingles[first[row] : first[row + 1]], n_words, own, least):
                    yield lo + int(row), match
        for n, known in index.short.items():
            whole, first = words.shingles(n)
            at = np.flatnonzero(np.isin(whole, np.array(list(known), dtype=np.uint64)))
            rows = np.searchsorted(first, at, side="right") - 1
            seen: set[tuple[int, int]] = set()
            for row, start, x in zip(rows.tolist(), (at - first[rows]).tolist(), whole[at].tolist(), strict=True):
                for item in known[x]:
                    if (row, item) not in seen:  # the first place of each
                        seen.add((row, item))
                        yield lo + row, (item, 1.0, start, n, 0)


def contaminated(docs: DataFrame, items: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 24) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words, bits): for each row of ``docs`` and item, the best window whose
    weighted ``k``-word shingles hold ``similarity`` of the item's.

    An item of fewer than ``k`` words matches where all its words stand in a row. Null and wordless texts and items match nothing; texts of any
    length are read whole; of equal windows the first counts; repeated rows each get their own rows, and so does each of several items with
    one id. Extra columns are not carried; empty tables give no rows.
    """
    python_stage(docs.sparkSession)
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, similarity double, start_word long, n_words long, bits int"
    out = None
    for index in _passes(items, k, radius):
        where = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], where=where) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = list(_hits(batch.column("text"), where.value, similarity))
                if got:
                    columns = list(zip(*[m for _, m in got], strict=True))
                    ids = pa.array([where.value.ids[i] for i in columns[0]])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array([r for r, _ in got])), ids, pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int32())],
                        ["doc_id", "item_id", "similarity", "start_word", "n_words", "bits"],
                    )

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, items: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 24) -> DataFrame:
    """The rows of ``docs``, all columns, whatever their names, that match no item (see ``contaminated``). No row leaves its partition."""
    python_stage(docs.sparkSession)
    for index in _passes(items, k, radius):
        where = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], where=where) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[r for r, _ in _hits(batch.column("text"), where.value, similarity)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
