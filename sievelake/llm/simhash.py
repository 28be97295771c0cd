"""Near-duplicates by SimHash: fingerprints are linked by a self-join of a binary trie.

Join: two nodes of the trie are traversed together; the bits in which their paths differ are added up, and a
pair of nodes is dropped once the sum exceeds the error budget. A sorted array of fingerprints is the
trie: a node is a range of it. To spread the trie over tasks, the bits are cut into budget + 1 blocks: two fingerprints
within the budget agree in one block at least, so one trie is built for each block, rotated to the front,
and the traversal starts below that block with no error. A node with too many fingerprints for a task is
itself expanded into pairs of deeper nodes, with the same pruning, before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm._session import checkpoint, python_stage, release
from sievelake.llm._text import Words, bit_sums, chunks, flat, majority, mix
from sievelake.llm.components import components

#: Fingerprints that one task joins at most; larger nodes are split first.
NODE_ROWS = 200_000
#: Levels of the trie by which a node that is too large is expanded at once, at most.
STEP = 6
#: Pairs of leaves that are compared outright instead of being expanded further.
_LEAF = 1024
#: Edges that a task holds before it keeps their spanning forest only.
_EDGES = 1 << 20
#: Bytes of text whose shingles one task counts on average.
COUNTED_BYTES = 24 << 20
#: Rows of prefix shingles that a task looks through on average, and rows of shingles that different components share that one compares.
PREFIX_ROWS, MIXED_ROWS = 200_000, 400_000
#: Pairs between two components that are verified first; eight times as many in each further round.
PAIRS_AT_ONCE = 8
#: Bits of the parity map of a shingle set.
_PARITY = 1024
#: Bits of the bitmap that tells which texts a verification needs (4 MB), and bytes of one of Spark's bitmap buckets.
_WANTED_BITS, _BUCKET_BYTES = 1 << 25, 4096


def word_shingle_hashes(text: str | None, k: int) -> list[int]:
    """XXH64 (seed 42) of the k-word shingles of a text, A-Z lower-cased, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [h(b" ".join(words), 42)] if words else []
    joined, starts, ends, at = b" ".join(words), [], [], 0
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    return [h(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :], strict=False)]


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp long): the SimHash of the whole text over ``k``-word shingles; 0 for a null text or one without words."""
    python_stage(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column("text"), []
            for lo, hi in chunks(flat(texts)[1]):
                hashes = [word_shingle_hashes(t, k) for t in texts[lo:hi].to_pylist()]
                n = np.array([len(x) for x in hashes])
                every = np.array([y for x in hashes for y in x], dtype=np.uint64)
                out.append(majority(bit_sums(every, np.concatenate([[0], np.cumsum(n)])), n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out).view(np.int64) if out else [], pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text, and where each text's begin."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[new], np.searchsorted(text[new], np.arange(len(first)))


def two_fingerprints(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, text_hash long, fp long, s0 .. s3 long) for each text.

    ``fp``: SimHash of the distinct words, stable under small edits, for the search. ``s0 .. s3``: 256 bits of SimHash over the
    distinct ``k``-word shingles, which the decision is about. All are 0 for a text without words.
    """
    python_stage(docs.sparkSession)
    salts = mix(np.arange(1, 5, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            parts = []
            for lo, hi in chunks(offsets):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                own = words.hashes ^ mix(words.text.astype(np.uint64) + np.uint64(1))
                at = np.sort(np.unique(own, return_index=True)[1])
                first = np.searchsorted(words.text[at], np.arange(hi - lo + 1))
                columns = [majority(bit_sums(mix(words.hashes[at]), first), np.diff(first))]
                shingles, first = distinct(*words.shingles(k))
                columns += [majority(bit_sums(mix(shingles ^ s), first), np.diff(first)) for s in salts]
                parts.append(np.stack(columns))
            got = np.concatenate(parts, axis=1).view(np.int64) if parts else np.zeros((5, 0), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *map(pa.array, got)], ["doc_id", "text_hash", "fp", "s0", "s1", "s2", "s3"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return narrow.mapInArrow(run, f"doc_id {kind}, text_hash long, fp long, s0 long, s1 long, s2 long, s3 long")


def _enumerate(la, na, lb, nb) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of some pairs of ranges."""
    total = na * nb
    which = np.repeat(np.arange(len(total)), total)
    at = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    return la[which] + at // nb[which], lb[which] + at % nb[which]


def trie_pairs(values: np.ndarray, la, ha, lb, hb, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``budget`` bits, from pairs of nodes (ranges of the sorted ``values``) at ``depth``.

    A node paired with itself gives each pair once.
    """
    diff = np.bitwise_count((values[la] ^ values[lb]) >> np.uint64(64 - depth)) if depth else np.zeros(len(la), dtype=np.uint8)
    stack = [(depth, *map(np.asarray, (la, ha, lb, hb)), diff.astype(np.int64))]
    while stack:
        depth, la, ha, lb, hb, diff = stack.pop()
        same = la == lb
        live = (diff <= budget) & (ha > la) & (hb > lb) & ~(same & (ha - la < 2))
        size = (ha - la) * (hb - lb)
        leaf = live & ((size <= _LEAF) | (depth == 64))
        if leaf.any():
            rows = np.flatnonzero(leaf)
            for part in np.split(rows, np.flatnonzero(np.diff(np.cumsum(size[rows]) >> 21)) + 1):
                i, j = _enumerate(la[part], (ha - la)[part], lb[part], (hb - lb)[part])
                near = (i < j) | ~np.repeat(same[part], size[part])
                near &= np.bitwise_count(values[i] ^ values[j]) <= budget
                if near.any():
                    yield i[near], j[near]
        rows = np.flatnonzero(live & ~leaf)
        if not len(rows):
            continue
        if len(rows) > 1 << 17:
            half = len(rows) // 2
            stack += [(depth, la[r], ha[r], lb[r], hb[r], diff[r]) for r in (rows[:half], rows[half:])]
            continue
        la, ha, lb, hb, diff, same = la[rows], ha[rows], lb[rows], hb[rows], diff[rows], same[rows]
        bit, keep = np.uint64(1 << (63 - depth)), np.uint64(((1 << depth) - 1) << (64 - depth))
        ma = np.clip(np.searchsorted(values, (values[la] & keep) | bit), la, ha)
        mb = np.clip(np.searchsorted(values, (values[lb] & keep) | bit), lb, hb)
        o = ~same
        stack.append(
            (
                depth + 1,
                np.concatenate([la, ma, la, ma[o]]),
                np.concatenate([ma, ha, ma, ha[o]]),
                np.concatenate([lb, mb, mb, lb[o]]),
                np.concatenate([mb, hb, hb, mb[o]]),
                np.concatenate([diff, diff, diff + 1, diff[o] + 1]),
            )
        )


def _merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j; ``parent`` points at the least member of each set afterwards."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (up := parent[parent] != parent).any():
            parent[up] = parent[parent[up]]


def _forest(n: int, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Indices of the edges of a minimum spanning forest, nearest first."""
    parent, chosen = np.arange(n), []
    for d in np.unique(far):
        level = np.flatnonzero(far == d)
        for e in level[parent[i[level]] != parent[j[level]]].tolist():
            a, b = i[e], j[e]
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
                chosen.append(e)
        while (up := parent[parent] != parent).any():
            parent[up] = parent[parent[up]]
    return np.array(chosen, dtype=np.int64)


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(start, width) of budget + 1 blocks of 64 bits."""
    cuts = [64 * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def trie_links(nodes: DataFrame, budget: int, max_bits: int | None = None, node_rows: int = NODE_ROWS) -> DataFrame:
    """Edges (u, v) that connect all ``nodes`` (id, fp; each id once) whose fingerprints differ in ``budget`` bits at most.

    They are spanning stars of what each task found, so they number at most budget + 1 for each node, however many
    pairs are near. With ``max_bits`` a pair must also differ in at most so many of the 256 bits ``s0 .. s3``, and the
    edges are those of a spanning forest with the least such differences: pairs that can be verified.
    """
    python_stage(nodes.sparkSession)
    checked = ["s0", "s1", "s2", "s3"] if max_bits is not None else []
    blocks = _blocks(budget)
    rotated = F.array(
        *[F.struct(F.lit(w).alias("depth"), (F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", 64 - s)) if s else F.col("fp")).alias("value"), F.lit(k).alias("block")) for k, (s, w) in enumerate(blocks)]
    )
    rows = nodes.select("id", *checked, F.explode(rotated).alias("r")).select("id", *checked, "r.*")
    rows = rows.withColumn("a", F.expr("shiftleft(shiftrightunsigned(value, 64 - depth), 64 - depth)")).withColumn("b", F.col("a"))
    n = nodes.count()
    key = ["block", "depth", "a", "b"]
    done: list[DataFrame] = []
    while True:
        # no more levels than halve a node often enough: each level doubles its rows
        levels = F.least(F.lit(STEP), F.ceil(F.log2(F.col("count") * 2 / node_rows))).cast("int")
        large = checkpoint(rows.groupBy(*key).count().where(F.col("count") > node_rows).where("depth < 64").select(*key, levels.alias("levels")))
        if large.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(large, key, "left_anti"))
        deep = rows.join(large, key).withColumn("deeper", F.least(F.col("depth") + F.col("levels"), F.lit(64)))
        cut = "shiftleft(shiftrightunsigned({0}, 64 - {1}), 64 - {1})"
        deep = deep.withColumn("own", F.expr(cut.format("value", "deeper")))
        deep = deep.withColumn("other", F.when(F.expr(cut.format("value", "depth")) == F.col("a"), F.col("b")).otherwise(F.col("a")))
        deep = deep.withColumn("x", F.explode(F.expr("sequence(0L, shiftleft(1L, deeper - depth) - 1L)")))
        deep = deep.withColumn("other", F.col("other").bitwiseOR(F.expr("shiftleft(x, 64 - deeper)")))
        deep = deep.where(F.bit_count(F.col("own").bitwiseXOR(F.col("other"))) <= budget)
        rows = checkpoint(deep.select("id", *checked, F.col("deeper").alias("depth"), "value", "block", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    groups = max(1, -(-n * len(blocks) // node_rows) * 4)
    every = every.withColumn("task", F.pmod(F.xxhash64(*key), F.lit(groups)))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(value=pdf["value"].to_numpy().view(np.uint64), a=pdf["a"].to_numpy().view(np.uint64), b=pdf["b"].to_numpy().view(np.uint64))
        pdf = pdf.sort_values(["block", "depth", "a", "b", "value"], kind="stable")
        ids, index = np.unique(pdf["id"].to_numpy(), return_inverse=True)
        parent = np.arange(len(ids))
        sigs = [pdf[c].to_numpy().view(np.uint64) for c in checked]

        kept = [np.zeros(0, dtype=np.int64)] * 3

        def compact() -> None:
            own = _forest(len(ids), *kept)
            kept[:] = [x[own] for x in kept]

        def add(i: np.ndarray, j: np.ndarray) -> None:
            if not checked:
                _merge(parent, index[i], index[j])
                return
            far = sum(np.bitwise_count(s[i] ^ s[j]).astype(np.int64) for s in sigs)
            near = (far <= max_bits) & (index[i] != index[j])
            kept[:] = [np.concatenate([x, y[near]]) for x, y in zip(kept, (index[i], index[j], far), strict=True)]
            if len(kept[0]) > _EDGES:
                compact()

        value, at = pdf["value"].to_numpy(), np.arange(len(pdf))
        cols = [pdf[c].to_numpy() for c in ("block", "depth")]
        self_pair = (pdf["a"] == pdf["b"]).to_numpy()
        a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
        change = np.flatnonzero(np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]))
        for lo, hi in zip(change, [*change[1:], len(pdf)], strict=True):
            depth = int(cols[1][lo])
            plain = at[lo:hi][self_pair[lo:hi]]
            # nodes paired with themselves are disjoint ranges in one sorted order
            if len(plain):
                v, base = value[plain], plain
                starts = np.flatnonzero(np.concatenate([[True], a[plain][1:] != a[plain][:-1]]))
                ends = np.concatenate([starts[1:], [len(v)]])
                for i, j in trie_pairs(v, starts, ends, starts, ends, depth, budget):
                    add(base[i], base[j])
            crossed = at[lo:hi][~self_pair[lo:hi]]
            if len(crossed):
                new = np.flatnonzero(np.concatenate([[True], (a[crossed][1:] != a[crossed][:-1]) | (b[crossed][1:] != b[crossed][:-1])]))
                for s, e in zip(new, [*new[1:], len(crossed)], strict=True):
                    own = crossed[s:e]
                    order = np.argsort(value[own], kind="stable")
                    own, v = own[order], value[own][order]
                    mask = np.uint64(((1 << depth) - 1) << (64 - depth))
                    one, two = ((v & mask) == x for x in (a[own[0]], b[own[0]]))
                    if one.any() and two.any():
                        r = [np.array([f(np.flatnonzero(x))]) for x in (one, two) for f in (lambda y: y[0], lambda y: y[-1] + 1)]
                        for i, j in trie_pairs(v, *r, depth, budget):
                            add(own[i], own[j])
        if checked:
            compact()
            return pd.DataFrame({"u": ids[kept[0]], "v": ids[kept[1]]})
        moved = np.flatnonzero(parent != np.arange(len(ids)))
        return pd.DataFrame({"u": ids[moved], "v": ids[parent[moved]]})

    return every.select("task", "id", *checked, *key, "value").groupBy("task").applyInPandas(join, "u long, v long")


def link(docs: DataFrame, k: int = 3, budget: int = 2, node_rows: int = NODE_ROWS) -> DataFrame:
    """Every row of ``docs``: doc_id, fp, fingerprint (16 hex digits), component_id.

    Fingerprints are linked at ``budget`` differing bits or fewer; component_id is the least doc_id that links reach,
    the row's own included. Copies share a fingerprint and are never paired: the join runs over distinct
    fingerprints. Null and wordless texts have fingerprint zero and are linked like any others; a null doc_id is never a
    component_id unless all of its component are null. Extra columns are not carried; an empty table gives no rows.
    """
    own = checkpoint(fingerprints(docs, k))
    nodes = checkpoint(own.groupBy(F.col("fp").alias("id")).agg(F.min("doc_id").alias("least")))
    linked = components(trie_links(nodes.select("id", F.col("id").alias("fp")), budget, node_rows=node_rows))
    known = checkpoint(nodes.join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    # checkpointed: a join straight on the aggregate could not split the rows of a large component
    least = checkpoint(known.groupBy("root").agg(F.min("least").alias("component_id")))
    named = known.join(least, "root").select(F.col("id").alias("fp"), "component_id")
    return own.join(named, "fp", "left").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _bits_of(hashes: DataFrame) -> np.ndarray:
    """A bitmap of ``_WANTED_BITS`` bits, packed: of each ``text_hash`` one is set. Its size is fixed, whatever the number of hashes."""
    place = F.pmod("text_hash", F.lit(_WANTED_BITS)) + 1  # buckets of the built-in bitmaps are counted from 1
    parts = hashes.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(_WANTED_BITS // 8, dtype=np.uint8)
    for bucket, bits in parts.toArrow().to_pandas().itertuples(index=False):
        own = np.frombuffer(bits, dtype=np.uint8)
        out[(bucket - 1) * _BUCKET_BYTES : (bucket - 1) * _BUCKET_BYTES + len(own)] = own
    return out


def shingle_sets(docs: DataFrame, k: int, wanted: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, shingles binary): the distinct hashes of a text's ``k``-word shingles, 48 bits each, for the texts whose bit is set in ``wanted``.

    Texts are read where they lie and only sets leave the scan; a few more texts than were asked for pass the bitmap, all of them if these are very many."""
    python_stage(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = (batch.column("text_hash").to_numpy().astype(np.int64)) % _WANTED_BITS
            batch = batch.filter(pa.array((wanted[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))
            data, offsets = flat(batch.column("text"))
            sets = []
            for lo, hi in chunks(offsets):
                own, first = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]).shingles(k)
                own = own >> np.uint64(16)
                sets += [np.unique(own[a:b]).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for a, b in zip(first, first[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sets, pa.binary())], ["doc_id", "text_hash", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, shingles binary")


def _read_set(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def _verified(edges: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """The edges whose texts have a Jaccard similarity of ``similarity`` at least. Edges are named by their texts, so sets are dealt once, by text; no text is."""
    of = lambda end: nodes.select(F.col("id").alias(end), F.col("least.doc_id").alias(f"d_{end}"), F.col("least.text_hash").alias(f"h_{end}"))
    named = checkpoint(edges.select("u", "v").join(of("u"), "u").join(of("v"), "v"))
    wanted = _bits_of(named.select(F.explode(F.array("h_u", "h_v")).alias("text_hash")))
    # repeated rows of one text give its set more than once
    sets = shingle_sets(docs, k, wanted).groupBy("doc_id", "text_hash").agg(F.first("shingles").alias("shingles"))

    def with_set(rows: DataFrame, end: str) -> DataFrame:
        own = sets.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("shingles").alias(f"s_{end}"))
        return rows.join(own, rows[f"d_{end}"].eqNullSafe(own["_d"]) & (rows[f"h_{end}"] == own["_h"])).drop("_d", "_h", f"d_{end}", f"h_{end}")

    pairs = with_set(with_set(named, "u"), "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("s_u").to_pylist(), batch.column("s_v").to_pylist(), strict=True):
                x, y = _read_set(a), _read_set(b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(compare, "u long, v long")


def shared_shingles(docs: DataFrame, k: int, similarity: float, counted_bytes: int = COUNTED_BYTES) -> DataFrame:
    """(text_hash, n int, at int, key long): of each text's prefix the ``k``-word shingles that stand in other texts too; n is its number of distinct ones.

    Two sets of that similarity must share one of their first n - ceil(similarity x n) + 1 shingles, in any one order for all texts. Here the
    rarest come first, by counts over all of ``docs``: a shingle that stands in one text only is at the front and never shared, so a text
    most of whose shingles are its own has no row. Each task counts a part of the hashes, sent as 4 bytes beside the text's number in its batch; two
    shingles that agree in the part and these bytes count as one, which can only add rows.
    """
    python_stage(docs.sparkSession)
    parts = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // counted_bytes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = 0
        for whole in batches:
            for start in range(0, len(whole), 1 << 16):
                batch = whole.slice(start, 1 << 16)
                data, offsets = flat(batch.column("text"))
                values, sizes = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
                for lo, hi in chunks(offsets):
                    own, first = distinct(*Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]).shingles(k))
                    values.append(own)
                    sizes.append(np.diff(first))
                own, n = np.concatenate(values), np.concatenate(sizes)
                part = ((own >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                low, text = own.astype(np.uint32)[order], np.repeat(np.arange(len(n), dtype=np.uint16), n)[order]
                bounds = np.searchsorted(part[order], np.arange(parts + 1))
                sent = np.flatnonzero(np.diff(bounds))
                # the texts' sizes and hashes go with one of the rows
                heads = [n.astype(np.int32).tobytes()] + [b""] * (len(sent) - 1), [batch.column("text_hash").to_numpy().tobytes()] + [b""] * (len(sent) - 1)
                if len(sent):
                    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(bounds[sent], bounds[sent + 1], strict=True)], pa.binary())  # noqa: E731, B023
                    ids = [pa.array(np.full(len(sent), x, dtype=np.int64)) for x in ((context.partitionId() << 32) + number, len(sent))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sent.astype(np.int32)), *ids, cut(low), cut(text), *(pa.array(x, pa.binary()) for x in heads)], ["part", "batch", "rows", "low", "text", "sizes", "hashes"]
                    )
                number += 1

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        low = np.frombuffer(b"".join(pdf["low"]), dtype=np.uint32)
        values = np.sort(low)
        often = np.unique(values[1:][values[1:] == values[:-1]])
        times = (np.searchsorted(values, often, side="right") - np.searchsorted(values, often)).astype(np.int64)
        columns: dict[str, list] = {"low": [], "text": [], "times": []}
        for own, text in zip(pdf["low"], pdf["text"], strict=True):
            own, text = np.frombuffer(own, dtype=np.uint32), np.frombuffer(text, dtype=np.uint16)
            at = np.minimum(np.searchsorted(often, own), max(len(often) - 1, 0))
            shared = often[at] == own if len(often) else np.zeros(len(own), dtype=bool)
            for name, x in (("low", own), ("text", text), ("times", times[at] if len(often) else own)):
                columns[name].append(x[shared].tobytes())
        return pdf[["part", "batch", "rows", "sizes", "hashes"]].assign(**columns)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf["sizes"].str.len() > 0
        if len(pdf) != pdf["rows"].iloc[0] or head.sum() != 1:
            raise RuntimeError("rows of a batch are missing: the scan gave other batches when it was repeated")
        n, hashes = (np.frombuffer(pdf[c][head].iloc[0], dtype=kind) for c, kind in (("sizes", np.int32), ("hashes", np.int64)))
        low, text, times = (np.frombuffer(b"".join(pdf[c]), dtype=kind) for c, kind in (("low", np.uint32), ("text", np.uint16), ("times", np.int64)))
        part = np.repeat(pdf["part"].to_numpy(), pdf["low"].str.len() // 4)
        key, text = (part.astype(np.int64) << 32) | low.astype(np.int64), text.astype(np.int64)
        order = np.lexsort((key, times, text))
        key, text = key[order], text[order]
        first = np.searchsorted(text, np.arange(len(n) + 1))
        at = n[text] - np.diff(first)[text] + np.arange(len(text)) - first[text]
        keep = at < n[text] - np.ceil(similarity * n[text] - 1e-9).astype(np.int64) + 1
        text = text[keep]
        return pd.DataFrame({"text_hash": hashes[text], "n": n[text], "at": at[keep].astype(np.int32), "key": key[keep]})

    dealt = docs.select(F.xxhash64("text").alias("text_hash"), "text").mapInArrow(deal, "part int, batch long, rows long, low binary, text binary, sizes binary, hashes binary")
    counted = dealt.groupBy("part").applyInPandas(count, "part int, batch long, rows long, sizes binary, hashes binary, low binary, text binary, times binary")
    return counted.groupBy("batch").applyInPandas(choose, "text_hash long, n int, at int, key long")


def parity_maps(docs: DataFrame, k: int, wanted: np.ndarray) -> DataFrame:
    """(text_hash, parity binary) for the texts whose bit is set in ``wanted``: ``_PARITY`` bits, each of which is flipped by the ``k``-word shingles that fall on it."""
    python_stage(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = (batch.column("text_hash").to_numpy().astype(np.int64)) % _WANTED_BITS
            batch = batch.filter(pa.array((wanted[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))
            data, offsets = flat(batch.column("text"))
            parity = []
            for lo, hi in chunks(offsets):
                own, first = distinct(*Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]).shingles(k))
                text = np.repeat(np.arange(hi - lo), np.diff(first))
                flips = np.bincount(text * _PARITY + (mix(own) % np.uint64(_PARITY)).astype(np.int64), minlength=(hi - lo) * _PARITY).reshape(-1, _PARITY)
                parity += [x.tobytes() for x in np.packbits((flips & 1).astype(np.uint8), axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column("text_hash"), pa.array(parity, pa.binary())], ["text_hash", "parity"])

    return docs.select(F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "text_hash long, parity binary")


def prefix_pairs(key, node, root, n, at, own_map, parity, similarity: float) -> np.ndarray:
    """(2 x pairs) nodes with different roots that share a key, whose sizes and places of the key allow the similarity, and whose parity maps (``own_map``-th rows of ``parity``) do.

    A shingle in one of two sets flips one bit, so they differ in as many shingles as their maps do in bits, or in more. Pairs are looked at here and only those that pass leave.
    """
    order = np.lexsort((n, key))
    key, node, root, n, at, own_map = (x[order] for x in (key, node, root, n, at, own_map))
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([start, [len(key)]]))
    mixed = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
    rows = np.flatnonzero(np.repeat(mixed, size))
    left = np.repeat(start + size, size)[rows] - rows - 1
    found = np.zeros((2, 0), dtype=np.int64)
    for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(np.cumsum(left) >> 19)) + 1):
        i = np.repeat(rows[part], left[part])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(left[part]) - left[part], left[part])
        most = 1 + np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j]) - 1
        near = (root[i] != root[j]) & (n[i] >= similarity * n[j] - 1e-9) & (most * (1 + similarity) >= similarity * (n[i] + n[j]) - 1e-9)
        i, j = i[near], j[near]
        apart = np.bitwise_count(parity[own_map[i]] ^ parity[own_map[j]]).sum(axis=1, dtype=np.int64)
        near = apart * (1 + similarity) <= (n[i] + n[j]) * (1 - similarity) + 1e-9
        i, j = node[i[near]], node[j[near]]
        found = np.unique(np.concatenate([found, [np.minimum(i, j), np.maximum(i, j)]], axis=1), axis=1)
    return found


def _shared_prefixes(docs: DataFrame, nodes: DataFrame, k: int, similarity: float) -> DataFrame:
    """Pairs (u, v) of ``nodes`` (id, root, least) with different roots, among them all whose shingle sets are so similar.

    Only keys that texts of different roots share go further, and only to their rows parity maps are joined, so that pairs that can't be similar are never written.
    """
    wanted = nodes.select("id", "root", F.col("least.text_hash").alias("text_hash"))
    # copies of a text give its rows more than once
    keys = shared_shingles(docs, k, similarity).groupBy("text_hash", "key").agg(F.min("n").alias("n"), F.min("at").alias("at"))
    rows = checkpoint(keys.join(wanted, "text_hash").select("id", "root", "n", "at", "key"))
    release(docs.sparkSession)
    task = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-rows.count() // PREFIX_ROWS)))).cast("int")

    def of_mixed_keys(pdf: pd.DataFrame) -> pd.DataFrame:
        key, root = pdf["key"].to_numpy(), pdf["root"].to_numpy()
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        several = np.minimum.reduceat(root[order], start) != np.maximum.reduceat(root[order], start)
        return pdf.iloc[order[np.repeat(several, np.diff(np.append(start, len(key))))]]

    rows = rows.withColumn("task", task).groupBy("task").applyInPandas(of_mixed_keys, "id long, root long, n int, at int, key long, task int")
    rows = checkpoint(rows)
    release(docs.sparkSession)
    tasks = max(1, -(-rows.count() // MIXED_ROWS))
    rows = rows.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks)).cast("int"))
    # a text's map goes once to each task that has rows of it; copies of one text give its map more than once
    needed = checkpoint(wanted.join(rows.select("id").distinct(), "id", "left_semi").select("id", "text_hash"))
    maps = parity_maps(docs, k, _bits_of(needed)).join(needed, "text_hash").groupBy("id").agg(F.first("parity").alias("parity"))
    sent = rows.select(F.col("task").alias("to"), F.col("id").alias("node")).distinct().join(maps.withColumnRenamed("id", "node"), "node")

    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("node")
        parity = np.frombuffer(b"".join(right["parity"]), dtype=np.uint64).reshape(-1, _PARITY // 64)
        own_map = np.searchsorted(right["node"].to_numpy(), left["id"].to_numpy())
        u, v = prefix_pairs(*(left[c].to_numpy() for c in ("key", "id", "root", "n", "at")), own_map, parity, similarity)
        return pd.DataFrame({"u": u, "v": v})

    return rows.groupBy("task").cogroup(sent.groupBy("to")).applyInPandas(join, "u long, v long").distinct()


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(u, v, rank): the pairs between nodes of different roots, numbered within each pair of roots."""
    of = lambda end: known.select(F.col("id").alias(end), F.col("root").alias(f"r_{end}"))
    met = pairs.select("u", "v").join(of("u"), "u").join(of("v"), "v").where("r_u <> r_v")
    one = Window.partitionBy(F.least("r_u", "r_v"), F.greatest("r_u", "r_v")).orderBy(F.xxhash64("u", "v"), "u", "v")
    return checkpoint(met.select("u", "v", F.row_number().over(one).alias("rank")))


def near_duplicates(docs: DataFrame, budget: int = 7, max_bits: int = 54, k: int = 5, similarity: float = 0.8, node_rows: int = NODE_ROWS) -> DataFrame:
    """Every row of ``docs``: doc_id, text_hash, component (long), representative (boolean), copies.

    First search: trie self-join of the SimHash of distinct words within ``budget`` bits. It finds most links cheaply; none depends on it alone. Pairs that differ in over ``max_bits`` of 256 bits of
    SimHash over distinct ``k``-word shingles go (the expected share is acos(2s / (1 + s)) / pi for a Jaccard similarity of s: 39 bits at
    0.8, with a deviation of 6). Of the rest each task keeps a spanning forest, nearest pairs first. Second search, exact, for what the bits
    miss and for forest edges that fail: between the components so far, all pairs that share a shingle of their prefixes, in rounds until
    no pair is left whose ends are apart. Edges of both are verified: the Jaccard
    similarity of whole ``k``-word shingle sets must be ``similarity`` at least. Words: A-Z lower-cased. Texts without words
    are copies of each other. The row with the least doc_id of a component represents it (nulls last; equal ids: the least
    text hash); ``copies`` counts the rows that equal a row in id and text.
    """
    own = checkpoint(two_fingerprints(docs, k))
    signature = ["fp", "s0", "s1", "s2", "s3"]
    own = own.withColumn("id", F.xxhash64(*signature))
    first = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    nodes = checkpoint(own.groupBy("id", *signature).agg(F.min(first).alias("least")))
    edges = checkpoint(trie_links(nodes.select("id", *signature), budget, max_bits, node_rows).distinct())
    rooted = lambda linked: checkpoint(nodes.select("id", "least").join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    release(docs.sparkSession)
    linked = components(_verified(edges, nodes, docs, k, similarity))
    known = rooted(linked)
    release(docs.sparkSession)
    pairs, most = checkpoint(_shared_prefixes(docs, known, k, similarity)), PAIRS_AT_ONCE
    release(docs.sparkSession)
    while not (apart := _apart(pairs, known)).isEmpty():
        release(docs.sparkSession)
        linked = linked.select(F.col("node").alias("u"), F.col("root").alias("v"))
        linked = components(linked.union(_verified(apart.where(F.col("rank") <= most), nodes, docs, k, similarity)))
        known, pairs, most = rooted(linked), apart.where(F.col("rank") > most), 8 * most
    # checkpointed: a join straight on the aggregate could not split the rows of a large component
    least = checkpoint(known.groupBy("root").agg(F.min("least").alias("head")))
    named = known.select("id", "root").join(least, "root")
    rows = own.groupBy("doc_id", "text_hash", "id").agg(F.count("*").alias("copies"))
    rows = rows.join(named, "id")
    is_head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    return rows.select("doc_id", "text_hash", F.col("root").alias("component"), is_head.alias("representative"), "copies")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One row of each component of ``near_duplicates``, with all columns; of repeated rows one stays."""
    heads = checkpoint(near_duplicates(docs, **options).where("representative").select(F.col("doc_id").alias("_head"), F.col("text_hash").alias("_hash"), "copies"))
    own = lambda few: docs.join(few, docs["doc_id"].eqNullSafe(few["_head"]) & (F.xxhash64(docs["text"]) == few["_hash"]), "left_semi")
    if heads.where("copies > 1").isEmpty():
        return own(heads)
    return own(heads.where("copies = 1")).unionByName(own(heads.where("copies > 1")).dropDuplicates(["doc_id", "text"]))
