"""Repeated byte strings of a corpus: which bytes does a string of L bytes cover that starts anywhere else too?

1. Each window of L bytes is assigned to an anchor: the window's least hash of 64 (for short L 32 or fewer) bytes, leftmost if tied. Equal
   windows have equal anchors at equal distances, wherever they stand, so only windows of one anchor can be
   equal. Neighbouring windows with one anchor are a run; an anchor seen once rules out its whole run.
2. Runs of equal bytes are repeated as a whole; they are counted, never paired.
3. Of the other runs, one for each text of a run, those with a repeated anchor meet in tasks dealt by anchor. There
   blocks of eight bytes, counted from the anchor, are the symbols of a string whose suffix array gives the
   Burrows-Wheeler transform; interval expansion on it, up to the number of blocks that every window holds,
   leaves the classes of equal block sequences, and the up to eight bytes around them decide each window exactly.
4. An anchor with more runs than a task takes is dealt over several; these exchange sets of window hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm._bwt import prefixes_of, suffix_array
from sievelake.llm._session import checkpoint, fresh, python_stage, release, scratch_table
from sievelake.llm._text import Words, chunks, flat, mix

#: Bytes of window starts worked on at once; positions take 20 bits.
_SEGMENT = 1 << 19
#: Bytes of runs that one task compares, and runs of one anchor beyond which it is dealt over several tasks.
TASK_BYTES = 3 << 20
ANCHOR_RUNS = 4096
_BLOCK = 8
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64))
_STEPS = [np.uint64(pow(0x2545F4914F6CDD1D, 1 << k, 1 << 64)) for k in range(6)]
_POSITION = np.uint64((1 << 20) - 1)


def _gram(length: int) -> int:
    """Bytes of an anchor: a power of two, a third of the window at most, so long that few repeat by chance."""
    return 1 << min(len(_STEPS), (length // 3).bit_length() - 1)


def _segments(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first byte, end byte, bounds of texts): texts together, or a part of a long one with length - 1 bytes of overlap."""
    for lo, hi in chunks(offsets, _SEGMENT):
        a, b = offsets[lo], offsets[hi]
        if b - a <= _SEGMENT:
            yield a, b, offsets[lo : hi + 1]
            continue
        for s in range(a, b, _SEGMENT):
            e = min(b, s + _SEGMENT + length - 1)
            if e - s >= length:
                yield s, e, np.array([s, e])


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(first window, windows, anchor position, anchor hash) of all runs, in bytes of ``data``."""
    gram = _gram(length)
    wide = length - gram + 1
    for a, b, bounds in _segments(offsets, length):
        n = b - a
        if n < length:
            continue
        h = _LETTERS[data[a:b]]
        for k, power in enumerate(_STEPS[: gram.bit_length() - 1]):
            h = h[: -(1 << k)] * power + h[1 << k :]
        h = mix(h)
        least, reach = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * reach <= wide:
            least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
        if reach < wide:
            least = np.minimum(least[: len(least) - (wide - reach)], least[wide - reach :])
        at = (least & _POSITION).astype(np.int64)
        # windows within one text
        ends = np.repeat(bounds[1:], np.diff(bounds)) - a
        starts = np.flatnonzero(np.arange(len(at)) + length <= ends[: len(at)])
        if not len(starts):
            continue
        anchor = at[starts]
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(starts) > 1)]))
        size = np.diff(np.append(new, len(starts)))
        yield starts[new] + a, size, anchor[new] + a, h[anchor[new]]


def repeated_windows(texts: list[bytes], windows: np.ndarray, anchors: np.ndarray, length: int) -> list[np.ndarray]:
    """For runs (bytes; number of windows; anchor's place), a flag for each window: it is equal to another one.

    ``length`` must be a multiple of eight. All runs together form one string of eight-byte blocks, aligned at their anchors.
    """
    blocks_each = length // _BLOCK - 1  # every window holds so many whole blocks, with eight bytes around them
    phase = anchors % _BLOCK
    padded, at, starts, total = [], 0, [], 0
    for text, p in zip(texts, phase, strict=True):
        # a run's blocks start at its phase; eight spare bytes on both sides
        pad = _BLOCK - int(p)
        tail = -(len(text) + pad) % _BLOCK + _BLOCK
        padded.append(b"\0" * pad + text + b"\0" * tail)
        starts.append(at + pad)
        at += len(padded[-1])
    data = np.frombuffer(b"".join(padded) + b"\0" * 16, dtype=np.uint8)
    words = data[: len(data) - len(data) % 8].view("<u8")
    sizes = np.array([len(x) for x in padded]) // _BLOCK
    first = np.cumsum(sizes) - sizes
    symbols = np.unique(words, return_inverse=True)[1].astype(np.int64) + 2
    symbols = symbols[: sizes.sum()]
    symbols[first] = symbols[first + sizes - 1] = 1  # the padded blocks separate runs
    symbols = np.append(symbols, 0)
    order = suffix_array(symbols, blocks_each + 1)
    shared = prefixes_of(symbols, order, blocks_each)
    class_of = np.empty(len(order), dtype=np.int64)
    class_of[order] = np.cumsum(shared < blocks_each)
    counts = np.bincount(class_of)
    starts = np.array(starts)
    flags = np.zeros(int(windows.sum()), dtype=bool)
    before = np.cumsum(windows) - windows
    run = np.repeat(np.arange(len(texts)), windows)
    byte = starts[run] + np.arange(len(run)) - before[run]  # first byte of each window
    block = -(-byte // _BLOCK)
    left = block * _BLOCK - byte
    name = class_of[block]
    some = np.flatnonzero(counts[name] > 1)
    lanes = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    keep = (np.uint64(1) << (np.uint64(8) * (_BLOCK - left[some]).astype(np.uint64)) % np.uint64(64)) - np.uint64(1)
    keep[left[some] == 0] = ~np.uint64(0)
    outer = np.where(left[some] > 0, lanes[block[some] * _BLOCK - _BLOCK], np.uint64(0))
    around = (outer & ~keep) | (lanes[(block[some] + blocks_each) * _BLOCK] & keep)
    by = np.lexsort((around, left[some], name[some]))
    c, t, k = name[some][by], left[some][by], around[by]
    equal = (c[1:] == c[:-1]) & (t[1:] == t[:-1]) & (k[1:] == k[:-1])
    twice = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
    flags[some[by[twice[: len(by)]]]] = True
    return np.split(flags, before[1:])


def _spans(starts: np.ndarray, flags: list[np.ndarray], length: int) -> list[list[tuple[int, int]]]:
    """Flagged windows of each run as byte ranges of its text."""
    out = []
    for s, f in zip(starts, flags, strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], f.astype(np.int8), [0]])))
        out.append([(int(s + a), int(s + b - 1 + length)) for a, b in zip(edge[::2], edge[1::2], strict=True)])
    return out


def _frame(pdf: pd.DataFrame, spans: list[list[tuple[int, int]]]) -> pd.DataFrame:
    at = np.repeat(np.arange(len(pdf)), [len(x) for x in spans])
    flat_spans = np.array([y for x in spans for y in x], dtype=np.int64).reshape(-1, 2)
    out = pdf[["doc_id", "text_hash"]].iloc[at].reset_index(drop=True)
    return out.assign(a=flat_spans[:, 0], b=flat_spans[:, 1])


def repeated_spans(docs: DataFrame, length: int = 400, anchor_runs: int = ANCHOR_RUNS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(doc_id, text_hash, spans array<struct<a, b>>) of texts with repeated bytes; spans may overlap.

    A text is named by doc_id and xxhash64 of the text; rows equal in both have equal spans and count as copies.
    """
    if length % _BLOCK or length < 4 * _BLOCK:
        raise ValueError("length must be a multiple of 8, 32 at least")
    spark = docs.sparkSession
    python_stage(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            view = memoryview(data)
            for start, size, anchor, name in runs(data, offsets, length):
                doc = np.searchsorted(offsets, start, side="right") - 1
                away = anchor - start
                same = [digest(view[s : s + m - 1 + length], d) for s, m, d in zip(start.tolist(), size.tolist(), away.tolist(), strict=True)]
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(rows),
                        batch.column("text_hash").take(rows),
                        pa.array(name.view(np.int64)),
                        pa.array(np.array(same, dtype=np.uint64).view(np.int64)),
                        pa.array((start - offsets[doc]).astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                        pa.array(away.astype(np.int32)),
                    ],
                    ["doc_id", "text_hash", "anchor", "run", "start", "windows", "away"],
                )

    schema = f"doc_id {kind}, text_hash long, anchor long, run long, start int, windows int, away int"
    with ExitStack() as tables:
        # most anchors are unique: their runs go before anything else is counted
        with scratch_table(named.where(F.octet_length("text") >= length).mapInArrow(anchored, schema)) as every_run:
            found = tables.enter_context(scratch_table(_of_shared_anchors(every_run)))
        one = ["doc_id", "text_hash", "start", "windows", "away"]
        texts = tables.enter_context(scratch_table(found.groupBy("anchor", "run").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in one])))
        whole = found.join(texts.where("n > 1").select("anchor", "run"), ["anchor", "run"], "left_semi")
        end = (F.col("start") + F.col("windows") - 1 + length).cast("long")
        spans = [checkpoint(whole.select("doc_id", "text_hash", F.struct(F.col("start").cast("long").alias("a"), end.alias("b")).alias("s")).distinct())]
        # checkpointed for the same reason as in ``_of_shared_anchors``
        shared = checkpoint(texts.groupBy("anchor").agg(F.count("*").alias("rivals")).where("rivals > 1"))
        partial = checkpoint(texts.join(shared, "anchor").select("anchor", "run", "rivals", *one))
    release(spark)
    with _cut_out(named, partial, length, kind) as cut:
        total = partial.agg(F.sum(F.col("windows") + length)).first()[0] or 0
        tasks = max(1, int(total // task_bytes) + 1)
        parts = F.ceil(F.col("rivals") / anchor_runs)
        part = F.pmod(F.xxhash64("run"), parts)
        dealt = cut.withColumn("part", part).withColumn("task", F.when(parts == 1, F.pmod(F.xxhash64("anchor"), F.lit(tasks))).otherwise(F.xxhash64("anchor", "part")))

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            flags = repeated_windows(pdf["raw"].tolist(), pdf["windows"].to_numpy(), pdf["away"].to_numpy(), length)
            return _frame(pdf, _spans(pdf["start"].to_numpy(), flags, length))

        span_schema = f"doc_id {kind}, text_hash long, a long, b long"
        within = dealt.groupBy("task").applyInPandas(compare, span_schema)
        spans.append(within.select("doc_id", "text_hash", F.struct("a", "b").alias("s")))
        if not partial.where(F.col("rivals") > anchor_runs).isEmpty():
            over = _dealt(dealt.where(F.col("rivals") > anchor_runs), length, anchor_runs, span_schema)
            spans.append(over.select("doc_id", "text_hash", F.struct("a", "b").alias("s")))
        return checkpoint(reduce(DataFrame.union, spans).groupBy("doc_id", "text_hash").agg(F.collect_set("s").alias("spans")))


def _of_shared_anchors(every_run: DataFrame) -> DataFrame:
    """The runs whose anchor another run has too (checkpointed: a join straight on the aggregate could not split those of a hot anchor)."""
    return every_run.join(checkpoint(every_run.groupBy("anchor").count().where("count > 1").select("anchor")), "anchor", "left_semi")


@contextmanager
def _cut_out(named: DataFrame, partial: DataFrame, length: int, kind: str) -> Iterator[DataFrame]:
    """The rows of ``partial`` with the bytes of their runs, ``raw``, as a table."""
    fields = ["anchor", "run", "rivals", "start", "windows", "away"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            lists = batch.column("runs")
            inner, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            doc = np.repeat(np.arange(len(lists)), np.diff(bounds))
            start, windows = (inner.field(c).to_numpy(zero_copy_only=False) for c in ("start", "windows"))
            a = offsets[doc] + start
            for lo in range(0, len(doc), 4096):
                hi = min(len(doc), lo + 4096)
                raw = [data[s : s + m - 1 + length].tobytes() for s, m in zip(a[lo:hi].tolist(), windows[lo:hi].tolist(), strict=True)]
                rows = pa.array(doc[lo:hi])
                part = inner.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), *[part.field(c) for c in fields], pa.array(raw, pa.binary())],
                    ["doc_id", "text_hash", *fields, "raw"],
                )

    places = partial.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(*fields)).alias("runs"))
    once = _once(named.where(F.octet_length("text") >= length))
    same_text = once["doc_id"].eqNullSafe(places["doc_id"]) & (once["text_hash"] == places["text_hash"])
    met = once.join(places, same_text).select(once["doc_id"], once["text_hash"], "text", "runs")
    del places, once, same_text
    table = met.mapInArrow(cut, f"doc_id {kind}, text_hash long, anchor long, run long, rivals long, start int, windows int, away int, raw binary")
    del met
    with scratch_table(table) as written:
        del table
        yield written


def _once(named: DataFrame) -> DataFrame:
    """Of rows equal in doc_id and text one each."""
    key = ["doc_id", "text_hash"]
    again = checkpoint(named.groupBy(*key).count().where("count > 1").select(*key))
    if again.isEmpty():
        return named
    same = named["doc_id"].eqNullSafe(again["doc_id"]) & (named["text_hash"] == again["text_hash"])
    return named.join(again, same, "left_anti").union(named.join(again, same, "left_semi").dropDuplicates(key))


def _dealt(cut: DataFrame, length: int, anchor_runs: int, span_schema: str) -> DataFrame:
    """The windows of anchors dealt over several tasks that are equal to one in another task: each task sends its distinct
    window hashes, as one array for each range of hashes, and gets back those that another task has too."""
    digest = xxhash.xxh3_64_intdigest

    def hashes(row) -> list[int]:
        view = memoryview(row.raw)
        return [digest(view[k : k + length], (row.away - k) & 0xFFFFFFFF) for k in range(row.windows)]

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.unique(np.array([h for row in pdf.itertuples() for h in hashes(row)], dtype=np.uint64))
        to = own % np.uint64(max(1, -(-int(pdf["rivals"].iloc[0]) // anchor_runs)))
        return pd.DataFrame([{"anchor": pdf["anchor"].iloc[0], "part": pdf["part"].iloc[0], "range": int(r), "own": own[to == r].tobytes()} for r in np.unique(to)])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in pdf["own"]]
        value, n = np.unique(np.concatenate(sets), return_counts=True)
        return pdf[["anchor", "part"]].assign(own=[np.intersect1d(s, value[n > 1], assume_unique=True).tobytes() for s in sets])

    def mark(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _frame(left, [[] for _ in range(len(left))])
        known = np.unique(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in right["own"]]))
        flags = [np.isin(np.array(hashes(row), dtype=np.uint64), known) for row in left.itertuples()]
        return _frame(left, _spans(left["start"].to_numpy(), flags, length))

    sent = cut.groupBy("anchor", "part").applyInPandas(send, "anchor long, part long, range long, own binary")
    common = sent.groupBy("anchor", "range").applyInPandas(meet, "anchor long, part long, own binary")
    return cut.groupBy("anchor", "part").cogroup(common.groupBy("anchor", "part")).applyInPandas(mark, span_schema)


def _joined(lists: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, a, b) of spans of windows of ``length`` bytes (a list of them for each row), as runs of windows that start byte after byte; with a length
    of one, the maximal ranges that the spans cover."""
    size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    row, inner = np.repeat(np.arange(len(size)), size), lists.flatten()
    a, b = (inner.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b"))
    order = np.lexsort((b, a, row))
    row, a, b = row[order], a[order], b[order]
    if not len(row):
        return row, a, b
    reach = np.maximum.accumulate(b + (row << 40)) - (row << 40)  # rows follow each other, so each begins anew
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (a[1:] > reach[:-1] - length + 1)])
    first = np.flatnonzero(new)
    return row[first], a[first], reach[np.append(first[1:], len(row)) - 1]


def _long_runs(lists: pa.Array, data: np.ndarray, offsets: np.ndarray, length: int, least_bytes: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, a, b) of the runs of windows that start byte after byte, if they have so many bytes or whole words of their texts."""
    row, a, b = _joined(lists, length)
    keep = b - a >= least_bytes
    for lo, hi in chunks(offsets):
        some = np.flatnonzero((row >= lo) & (row < hi) & ~keep)
        if len(some):
            words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=False)
            at = offsets[row[some]] - offsets[lo]
            # whole words: those that end in the run but for those that start before it
            keep[some] = np.searchsorted(words.ends, at + b[some], side="right") - np.searchsorted(words.starts, at + a[some]) >= least_words
    return row[keep], a[keep], b[keep]


def _kept(view: memoryview, offsets: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[bytes]:
    """Each text without its ranges, which must be in order and apart."""
    first = np.searchsorted(row, np.arange(len(offsets)))
    for k, (lo, hi) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
        i, j = first[k], first[k + 1]
        yield b"".join(view[lo + x : lo + y] for x, y in zip([0, *b[i:j].tolist()], [*a[i:j].tolist(), hi - lo], strict=True)) if j > i else bytes(view[lo:hi])


def _with_spans(docs: DataFrame, found: DataFrame, *names: str) -> DataFrame:
    """``docs`` with the columns of ``found`` (doc_id, text_hash, then as many as ``names``), renamed."""
    key, text_hash = fresh("_doc", docs), fresh("_hash", docs)
    found = found.toDF(key, text_hash, *names)
    return docs.join(found, docs["doc_id"].eqNullSafe(found[key]) & (F.xxhash64(docs["text"]) == found[text_hash]), "left").drop(key, text_hash)


def _within(docs: DataFrame, near: DataFrame, short: int, length: int, options: dict) -> DataFrame:
    """``repeated_spans`` for ``length``, from those for a ``short``-er length: equal long strings lie in unbroken runs of equal short ones, so only
    runs of ``length`` bytes are searched, each different one once; a run that occurs twice is repeated as a whole."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", "text").where(F.octet_length("text") >= length)
    runs_column = fresh("_runs", named)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            view = memoryview(data)
            row, start, end = _joined(batch.column(runs_column), short)
            far = end - start >= length
            row, start, end = row[far], start[far], end[far]
            raw = [bytes(view[x:y]) for x, y in zip((offsets[row] + start).tolist(), (offsets[row] + end).tolist(), strict=True)]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(start), pa.array(raw, pa.binary())], ["doc_id", "text_hash", "start", "raw"])

    cut = _with_spans(named, near, runs_column).withColumn("text_hash", F.xxhash64("text")).mapInArrow(pieces, f"doc_id {kind}, text_hash long, start long, raw binary")
    with scratch_table(cut) as every, ExitStack() as tables:
        by_content = [F.xxhash64("raw", F.lit(1)).alias("doc_id"), F.xxhash64("raw").alias("text_hash")]
        places = tables.enter_context(scratch_table(every.select(F.col("doc_id").alias("doc"), F.col("text_hash").alias("of"), "start", F.octet_length("raw").cast("long").alias("n"), *by_content).distinct()))
        known = checkpoint(places.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies")))
        once = tables.enter_context(scratch_table(every.select(*by_content, F.col("raw").alias("text")).groupBy("doc_id", "text_hash").agg(F.first("text").alias("text")).select("doc_id", "text")))
        inner = repeated_spans(once, length, **options)
        met = places.join(known, ["doc_id", "text_hash"]).join(inner, ["doc_id", "text_hash"], "left")
        whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
        spans = F.when(F.col("copies") > 1, whole).otherwise(F.col("spans"))
        moved = F.transform(spans, lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b")))
        rows = met.where(spans.isNotNull()).groupBy(F.col("doc").alias("doc_id"), F.col("of").alias("text_hash"))
        return checkpoint(rows.agg(F.flatten(F.collect_list(moved)).alias("spans")))


def remove_repeated(docs: DataFrame, length: int = 400, passage_bytes: int | None = None, passage_words: int = 50, **options) -> DataFrame:
    """Every row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, text.

    Removes each byte that a string of ``length`` bytes covers which also starts anywhere else in the corpus, the same text
    included; strings are judged on the input. The first five columns after doc_id are about this alone.

    ``text`` is what is left. With ``passage_bytes``, a length that any ``passage_words`` words reach, it lacks the repeated passages of that many
    whole words too, of which not all have ``length`` bytes; and the rest of a character that a removal has cut goes.

    A null text is empty, and null in ``text``. Repeated rows are copies of each other; shorter texts stay as they are; texts of any length are
    read whole. Other columns, whatever their names, are not carried; an empty table gives no rows.
    """
    python_stage(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    if passage_bytes is None:
        near, found = None, repeated_spans(docs, length, **options).withColumn("near", F.lit(None).cast("array<struct<a:long,b:long>>"))
    else:
        near = repeated_spans(docs, passage_bytes, **options)
        far = _within(docs, near, passage_bytes, length, options).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("spans").alias("far"))
        same = near["doc_id"].eqNullSafe(far["_d"]) & (near["text_hash"] == far["_h"])
        found = near.join(far, same, "left").select("doc_id", "text_hash", "far", F.col("spans").alias("near"))
    release(docs.sparkSession)
    met = _with_spans(docs, found, "_far", "_near")
    span = pa.struct([("a", pa.int64()), ("b", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            view, n = memoryview(data), np.diff(offsets)
            row, a, b = _joined(batch.column("_far"), 1)
            removed = np.bincount(row, b - a, len(n)).astype(np.int64)
            count = np.bincount(row, minlength=len(n)).astype(np.int64)
            digests, rest = [], []
            for kept in _kept(view, offsets, row, a, b):
                digests.append(hashlib.sha256(kept).hexdigest())
                rest.append(kept)
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], fields=list(span)))
            if passage_bytes is not None:
                near = _long_runs(batch.column("_near"), data, offsets, passage_bytes, 1 << 62, passage_words)
                both = [np.concatenate(x) for x in zip((row, a, b), near, strict=True)]
                ends = np.concatenate([[0], np.cumsum(np.bincount(both[0], minlength=len(n)))]).astype(np.int32)
                order = np.argsort(both[0], kind="stable")
                every = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(both[1][order]), pa.array(both[2][order])], fields=list(span)))
                rest = list(_kept(view, offsets, *_joined(every, 1)))
            text = pa.array([x.decode("utf-8", "ignore") if v else None for x, v in zip(rest, batch.column("text").is_valid().to_pylist(), strict=True)], pa.string())
            columns = [pa.array(n), pa.array(removed), pa.array(count), pa.array(digests, pa.string()), spans, text]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return met.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>, text string")


def without_repeated(docs: DataFrame, length: int = 400, least_bytes: int = 0, least_words: int = 0, **options) -> DataFrame:
    """Every row of ``docs``, all columns, its text without the bytes that ``remove_repeated`` removes, nor the rest of a
    character that a removal has cut.

    Of the runs of repeated strings, those that start byte after byte, only the ones of ``least_bytes`` bytes or
    ``least_words`` whole words go. A null text stays null; a text that is all repeated becomes empty; a text of any length is read whole; repeated
    rows are copies of each other; other columns may have any names; an empty table gives no rows."""
    python_stage(docs.sparkSession)
    at, names, column = docs.columns.index("text"), docs.columns, fresh("_spans", docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            row, a, b = _long_runs(batch.column(column), data, offsets, length, least_bytes, least_words)
            left = _kept(memoryview(data), offsets, row, a, b)
            kept = [x.decode("utf-8", "ignore") if v else None for x, v in zip(left, batch.column("text").is_valid().to_pylist(), strict=True)]
            columns = [batch.column(c) for c in names]
            columns[at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return _with_spans(docs, repeated_spans(docs, length, **options), column).mapInArrow(cut, docs.schema)
