"""Alignment of two tokenizers by a dictionary of groups.

Byte offsets where tokens of both end cut a text into groups (ids of A, ids of B). Few groups differ, so each is interned: the texts of an Arrow
batch become numbers in the batch's dictionary, and one row holds both. Then

1. pairs of ids that overlap are counted by documents: each batch counts its own, from the links of its groups, and the counts are added;
2. the distinct groups of all batches are expanded into links once, joined with the counts of their pairs, and summed up to a few figures a group;
3. these figures are joined back by group to the dictionaries of the batches, and each document adds them up by the frequencies of its groups.

So what is shuffled is dictionaries, pairs and documents as numbers, never texts or the tokens of a document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm._session import checkpoint, python_stage, scratch_table
from sievelake.llm._text import flat
from sievelake.llm._tokens import Memory, Source, pieces, tiles

#: Between the ids of A and those of B in a group's key.
_BAR = -1
_ID = np.dtype("<i4")


def _joined(values: list[list[int]]) -> np.ndarray:
    return np.fromiter((y for x in values for y in x), dtype=np.int64, count=sum(map(len, values)))


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of some ranges, one range after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def piece_groups(found: list[bytes], own: list[tuple[list[int], list[int]]], size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys' bytes as an array of ids, bounds of the keys, bounds of the groups of each piece) for pieces with their tokens by A and B.

    All pieces are laid end to end; a group ends where a token of A and one of B do.
    """
    a, b = _joined([x for x, _ in own]), _joined([y for _, y in own])
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    n_a = np.diff(np.searchsorted(end_a, cuts, side="right"), prepend=0)
    n_b = np.diff(np.searchsorted(end_b, cuts, side="right"), prepend=0)
    size = n_a + n_b + 1
    bounds = np.concatenate([[0], np.cumsum(size)])
    keys = np.full(bounds[-1], _BAR, dtype=_ID)
    keys[_ranges(bounds[:-1], n_a)] = a
    keys[_ranges(bounds[:-1] + n_a + 1, n_b)] = b
    piece_ends = np.cumsum([len(x) for x in found])
    return keys, bounds, np.searchsorted(cuts, np.concatenate([[0], piece_ends]), side="right")


def expand(keys: list[bytes], size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, A id, B id) of all links of some groups: token pairs whose byte ranges overlap."""
    flat_keys = np.frombuffer(b"".join(keys), dtype=_ID).astype(np.int64)
    size = np.array([len(k) // _ID.itemsize for k in keys], dtype=np.int64)
    group = np.repeat(np.arange(len(keys)), size)
    bar = np.flatnonzero(flat_keys == _BAR)
    is_a = np.arange(len(flat_keys)) < bar[group] if len(keys) else np.zeros(0, dtype=bool)
    is_b = np.arange(len(flat_keys)) > bar[group] if len(keys) else np.zeros(0, dtype=bool)
    a, b = flat_keys[is_a], flat_keys[is_b]
    # both sides of a group cover the same bytes, so all groups can be laid end to end
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    first = np.searchsorted(end_b, end_a - size_a[a], side="right")
    last = np.searchsorted(end_b, end_a, side="left")
    n = last - first + 1
    return np.repeat(group[is_a], n), np.repeat(a, n), b[_ranges(first, n)]


def _written(key: bytes) -> str:
    ids = np.frombuffer(key, dtype=_ID).tolist()
    bar = ids.index(_BAR)
    return ",".join(map(str, ids[:bar])) + "|" + ",".join(map(str, ids[bar + 1 :]))


class Aligner:
    """Turns batches of texts into documents of group numbers; lives as long as a task."""

    def __init__(self, first: Source, second: Source):
        self.a, self.b = first.load(), second.load()
        if not getattr(self.b, "tiled", False):
            raise ValueError("the second tokenizer must be a model whose pieces don't cross words")
        self.size_a, self.size_b = (np.array([len(x) for x in m.bytes], dtype=np.int64) for m in (self.a, self.b))
        self.memory = Memory(self._tokens)

    def _tokens(self, found: list[bytes]) -> list[tuple[list[int], list[int]] | None]:
        """Tokens of pieces; None where the bytes of either side aren't those of the piece."""
        of_a, of_b, own_a, own_b = self.a.of_pieces(found), self.b.of_pieces(found), self.a.bytes, self.b.bytes
        same = lambda x, p, q: b"".join([own_a[i] for i in p]) == x and b"".join([own_b[i] for i in q]) == x
        return [(p, q) if same(x, p, q) else None for x, p, q in zip(found, of_a, of_b, strict=True)]

    def batch(self, texts: pa.Array) -> dict:
        """Of texts with a space in front (empty ones stay empty)."""
        data, offsets = flat(texts)
        starts = tiles(data, offsets)
        name, found = pieces(data, starts)
        tokens = self.memory(found)
        whole = np.array([x is not None for x in tokens], dtype=bool)
        row_of = np.searchsorted(offsets, starts, side="right") - 1
        broken = np.zeros(len(texts), dtype=bool)
        broken[row_of[~whole[name]]] = True
        keep = ~broken[row_of]
        name, row_of = name[keep], row_of[keep]
        # the groups of the pieces that stand in texts with tokens
        used = np.unique(name)
        renamed = np.zeros(len(found), dtype=np.int64)
        renamed[used] = np.arange(len(used))
        name, found, tokens = renamed[name], [found[k] for k in used], [tokens[k] for k in used]
        ids, bounds, groups_of = piece_groups(found, tokens, self.size_a, self.size_b)
        coded = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds * _ID.itemsize), pa.py_buffer(ids)]).dictionary_encode()
        number, keys = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        written = np.array([_written(k) for k in keys], dtype=object)
        by_piece = [";".join(written[number[i:j]]) for i, j in zip(groups_of[:-1].tolist(), groups_of[1:].tolist(), strict=True)]
        piece_bounds = np.searchsorted(row_of, np.arange(len(texts) + 1))
        order = name.tolist()
        digests = [
            hashlib.sha256(";".join([by_piece[k] for k in order[i:j]]).encode()).hexdigest() if j > i else ""
            for i, j in zip(piece_bounds[:-1].tolist(), piece_bounds[1:].tolist(), strict=True)
        ]
        n_groups_of = np.diff(groups_of)
        add = lambda per_piece: np.diff(np.concatenate([[0], np.cumsum(per_piece[name])])[piece_bounds])
        # (document, group) with frequencies
        row = np.repeat(row_of, n_groups_of[name])
        group = number[_ranges(groups_of[:-1][name], n_groups_of[name])]
        both, times = np.unique(row * max(1, len(keys)) + group, return_counts=True)
        row, group = both // max(1, len(keys)), both % max(1, len(keys))
        link_group, link_a, link_b = expand(keys, self.size_a, self.size_b)
        first_link = np.searchsorted(link_group, np.arange(len(keys) + 1))
        n_links_of = np.diff(first_link)
        # documents of each pair: distinct (document, pair), whatever groups hold it
        pair, pair_of = np.unique(link_a << 32 | link_b, return_inverse=True)
        held = np.repeat(row, n_links_of[group]) * max(1, len(pair)) + pair_of[_ranges(first_link[:-1][group], n_links_of[group])]
        pair_docs = np.bincount(np.unique(held) % max(1, len(pair)), minlength=len(pair)) if len(pair) else np.zeros(0, dtype=np.int64)
        ends = np.searchsorted(row, np.arange(len(texts) + 1))
        own = [packed(group[i:j], times[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        counted = np.concatenate([[0], np.cumsum(times * n_links_of[group])])
        return {
            "n_a": add(np.array([len(x) for x, _ in tokens], dtype=np.int64)),
            "n_b": add(np.array([len(y) for _, y in tokens], dtype=np.int64)),
            "n_groups": add(n_groups_of),
            "n_links": np.diff(counted[ends]),
            "groups_sha256": digests,
            "own": own,
            "keys": keys,
            "pairs": (pair >> 32, pair & 0xFFFFFFFF, pair_docs),
        }


def packed(group: np.ndarray, times: np.ndarray) -> bytes:
    """A document's group numbers, ascending, and their frequencies."""
    return zlib.compress(np.concatenate([np.diff(group, prepend=0), times]).astype("<u4").tobytes(), 1)


def unpacked(own: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(own), dtype="<u4").astype(np.int64).reshape(2, -1)
    return np.cumsum(both[0]), both[1]


def _aligned(docs: DataFrame, first: Source, second: Source) -> DataFrame:
    """A row for each Arrow batch: its documents, the keys of its groups, its pairs with the number of documents that hold them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    content = F.coalesce(F.col("text"), F.lit(""))
    spaced = F.when(content == "", "").otherwise(F.concat(F.lit(" "), content))
    fields = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner(first, second), TaskContext.get().partitionId() << 32
        for batch in batches:
            if not len(batch):
                continue
            got = aligner.batch(batch.column("spaced"))
            ids = batch.column("doc_id")
            documents = pa.StructArray.from_arrays([ids, *[pa.array(got[c], pa.int64()) for c in fields[:4]], pa.array(got["groups_sha256"], pa.string()), pa.array(got["own"], pa.binary())], ["doc_id", *fields])
            pairs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in got["pairs"]], ["a", "b", "n"])
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays([pa.array([number]), one(documents), one(pa.array(got["keys"], pa.binary())), one(pairs)], ["batch", "documents", "keys", "pairs"])
            number += 1

    return docs.select("doc_id", spaced.alias("spaced")).mapInArrow(
        run,
        f"batch long, documents array<struct<doc_id:{kind},n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string,own:binary>>, keys array<binary>, pairs array<struct<a:long,b:long,n:long>>",
    )


def links_of(keys: DataFrame, first: Source, second: Source) -> DataFrame:
    """(key, a, b, times) of the links of distinct groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_a, size_b = (np.array([len(x) for x in s.load().bytes], dtype=np.int64) for s in (first, second))
        for batch in batches:
            group, a, b = expand(batch.column("key").to_pylist(), size_a, size_b)
            order = np.lexsort((b, a, group))
            group, a, b = group[order], a[order], b[order]
            new = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(group)])
            times = np.diff(np.append(new, len(group)))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(group[new])), pa.array(a[new]), pa.array(b[new]), pa.array(times, pa.int64())], ["key", "a", "b", "times"])

    return keys.mapInArrow(run, "key binary, a long, b long, times long")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): in how many documents a pair of ids is linked, and whether no other B id is linked with A's in more."""
    counted = aligned.select(F.explode("pairs").alias("p")).select("p.*").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # no more rows than pairs of ids that share bytes; an A id has as many as B has ids at most
    counted = checkpoint(counted)
    highest = checkpoint(counted.groupBy("a").agg(F.max("n").alias("most")))
    return counted.join(highest, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, first: Source, second: Source) -> DataFrame:
    """Every row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``first`` (A, byte-level) reads a space and the text, ``second`` (B) adds the space itself. Texts that are null, empty or whose tokens do not spell them
    (B reads U+2581 as a space) have no tokens: zeros and an empty digest. A row is a document, repeated rows too; texts of any length are taken whole; other
    columns, whatever their names, are not carried; an empty table gives no rows. ``n_best`` counts the links whose pair is in as many documents as any of its A id,
    ``count_sum`` adds up the documents of the pairs of all links.
    """
    python_stage(docs.sparkSession)
    with scratch_table(_aligned(docs, first, second)) as aligned:
        counts = pair_counts(aligned)
        keys = aligned.select(F.explode("keys").alias("key")).distinct()
        # written down before the joins: straight on an aggregate, a join can't split its larger keys
        links = checkpoint(links_of(keys, first, second)).join(checkpoint(counts), ["a", "b"])
        figures = checkpoint(links.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")))
        places = aligned.select("batch", F.posexplode("keys").alias("at", "key")).join(figures, "key")
        # a batch's dictionary is bounded by its text
        back = places.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("at", "n_best", "count_sum"))).alias("figures"))
        met = aligned.select("batch", "documents").join(back, "batch", "left")

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(len(batch)):
                    documents, figures = batch.column("documents")[k].values, batch.column("figures")[k].values
                    # the figures of every group of the batch, in the order of its dictionary
                    best, total = ((figures.field(c).to_numpy() if figures is not None else np.zeros(0, dtype=np.int64)) for c in ("n_best", "count_sum"))
                    own = [unpacked(x) for x in documents.field("own").to_pylist()]
                    sums = [pa.array([int((times * of[group]).sum()) for group, times in own], pa.int64()) for of in (best, total)]
                    yield pa.RecordBatch.from_arrays(
                        [*[documents.field(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], *sums, documents.field("groups_sha256")],
                        ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                    )

        kind = docs.schema["doc_id"].dataType.simpleString()
        return checkpoint(met.mapInArrow(add, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"))
