"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

Viterbi decoding gives the best labels of a text's lines; the share of its words in content lines decides
whether the text is kept. Base rules (too few words, too many repeated ones) come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm._session import python_stage
from sievelake.llm._text import Words, chunks, flat, mix, word_hashes

FEATURES = ("bias", "blank", "under 4 words", "10 words or more", "ends a sentence", "a symbol each 10 characters", "a digit each 5 characters",
            "mostly capitals", "a bar", "equal to another line", "mean word over 12 characters", "ends with !!")
#: Used where there is nothing to learn from: weights for content, and the gain of keeping the label of the line before.
_PRIOR = np.array([1.5, -1.0, -0.5, 0.5, 0.5, -3.0, -1.0, -2.0, -1.0, -2.0, -1.0, -2.0])


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int32)
    out[list(chars)] = 1
    return out


_SYMBOL = _lut(b"#*$%&|<>")
_UPPER, _DIGIT, _BAR = _lut(bytes(range(65, 91))), _lut(bytes(range(48, 58))), _lut(b"|")
_LETTER = _lut(bytes(range(65, 91)) + bytes(range(97, 123)))
_CHAR = (np.arange(256) & 0xC0 != 0x80).astype(np.int32)
_STOP = _lut(b".!?") > 0


#: Lines that training works on at once (one longer text is still taken whole).
BATCH_LINES = 200_000


@dataclass
class Crf:
    """State 1 is content. ``weights``: features, for content against boilerplate; ``stay``: gain for two equal labels in a row."""

    weights: np.ndarray = field(default_factory=lambda: _PRIOR.copy())
    stay: float = 0.5

    def viterbi(self, lines: np.ndarray, first: np.ndarray) -> np.ndarray:
        """1 for content lines, over all texts at once (``first``: first line of each text); content wins ties."""
        gain, n = lines @ self.weights, np.diff(first)
        out = np.zeros(len(lines), dtype=np.int8)
        if not len(lines):
            return out
        by = np.argsort(-n, kind="stable")
        begin, n = first[:-1][by], n[by]
        back = np.zeros((len(lines), 2), dtype=np.int8)
        best = np.zeros((len(by), 2))
        for t in range(int(n[0])):
            k = int(np.searchsorted(-n, -t, side="left"))  # texts with more than t lines
            at = begin[:k] + t
            if t:
                stay, switch = best[:k] + self.stay, best[:k, ::-1]
                back[at] = np.where(switch > stay, [[1, 0]], [[0, 1]])
                best[:k] = np.maximum(stay, switch)
            best[:k, 1] += gain[at]
        state = (best[:, 1] >= best[:, 0]).astype(np.int8)
        for t in range(int(n[0]) - 1, -1, -1):
            k = int(np.searchsorted(-n, -t, side="left"))
            at = begin[:k] + t
            out[at] = state[:k]
            state[:k] = back[at, state[:k]]
        return out


@dataclass
class Page:
    """Counts and line features of some texts."""

    base: dict[str, np.ndarray]
    lines: np.ndarray
    line_words: np.ndarray
    first_line: np.ndarray


def describe(data: np.ndarray, offsets: np.ndarray) -> Page:
    n_texts = len(offsets) - 1
    words = Words(data, offsets, lower=False)
    n_words = np.diff(words.first)
    summed = lambda lut: np.concatenate([[0], np.cumsum(lut[data], dtype=np.int64)])
    chars, symbols = summed(_CHAR), summed(_SYMBOL)
    in_words = np.concatenate([[0], np.cumsum(chars[words.ends] - chars[words.starts])])

    # words in 5-word windows that a text has more than once
    own, first = words.shingles(5)
    count = np.diff(first)
    text = np.repeat(np.arange(n_texts), count)
    _, inverse, times = np.unique(own ^ mix(text.astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[inverse] > 1)
    at = words.first[text[twice]] + twice - first[text[twice]]
    cover = np.zeros(len(words.starts) + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, np.minimum(at + 5, len(words.starts)), -1)
    repeated = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])

    # lines: one more than line feeds in each text
    feeds = np.flatnonzero(data == 10)
    text_of = np.searchsorted(offsets, feeds, side="right") - 1
    n_lines = np.bincount(text_of, minlength=n_texts) + 1
    first_line = np.concatenate([[0], np.cumsum(n_lines)])
    order = np.lexsort((np.concatenate([offsets[:-1], feeds + 1]), np.concatenate([np.arange(n_texts), text_of])))
    starts = np.concatenate([offsets[:-1], feeds + 1])[order]
    ends = np.concatenate([starts[1:] - 1, [0]])
    ends[first_line[1:] - 1] = offsets[1:]
    line_text = np.repeat(np.arange(n_texts), n_lines)
    line_words = np.searchsorted(words.starts, ends) - np.searchsorted(words.starts, starts)
    line_hash = word_hashes(data, starts, ends) ^ mix(line_text.astype(np.uint64) + np.uint64(1))
    _, seen_first, inverse, times = np.unique(line_hash, return_index=True, return_inverse=True, return_counts=True)
    with_word = line_words > 0
    again = with_word & (seen_first[inverse] != np.arange(len(starts)))
    lengths = np.maximum(1, chars[ends] - chars[starts])
    of = lambda sums: sums[ends] - sums[starts]
    last = np.where(line_words > 0, words.ends[np.maximum(0, np.searchsorted(words.starts, ends) - 1)] - 1, 0) if len(words.ends) else np.zeros(len(starts), dtype=int)
    last_byte = data[last] if len(data) else np.zeros(len(starts), dtype=np.uint8)
    before_last = data[np.maximum(0, last - 1)] if len(data) else last_byte
    letters = of(summed(_LETTER))
    lines = np.stack(
        [
            np.ones(len(starts)),
            ~with_word,
            with_word & (line_words < 4),
            line_words >= 10,
            with_word & _STOP[last_byte],
            10 * of(symbols) >= lengths,
            5 * of(summed(_DIGIT)) >= lengths,
            (2 * of(summed(_UPPER)) > letters) & (letters > 3),
            of(summed(_BAR)) > 0,
            with_word & (times[inverse] > 1),
            lengths > 13 * np.maximum(1, line_words),
            with_word & (last_byte == 33) & (before_last == 33),
        ],
        axis=1,
    ).astype(float)
    lines[~with_word, 5:] = 0
    base = {
        "n_words": n_words,
        "word_chars": np.diff(in_words[words.first]),
        "n_symbols": np.diff(symbols[offsets]),
        "n_dup_lines": np.bincount(line_text, again, n_texts).astype(np.int64),
        "n_repeat_words": np.diff(repeated[words.first]),
    }
    return Page(base, lines, line_words, first_line)


def fit(docs: DataFrame, labels: DataFrame, examples: int = 1_500, longest: int = 20_000, rounds: int = 120) -> Crf:
    """Maximum likelihood on labelled texts: all lines of a text of quality 1 count as content, of quality 0 as boilerplate.

    Bounds: ``examples`` labelled texts in expectation (rows whose hash falls under that share) of ``longest`` bytes at most.
    Rows with a null id, label or text are left out; an id that is labelled twice has its lower label; repeated rows count each. Other columns may
    have any names. Without a text of each kind, as in empty tables, the prior weights stay.
    """
    labels = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    n = labels.count()
    draw = F.xxhash64(F.lit("quality"), F.col("doc_id")).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    # the sample is bounded by a parameter, so its ids may be broadcast
    chosen = F.broadcast(labels.where(draw < min(1.0, examples / max(1, n))))
    python_stage(docs.sparkSession)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            page = describe(data, offsets)
            bits = (page.lines @ (1 << np.arange(len(FEATURES)))).astype(np.int32)
            own = np.split(bits, page.first_line[1:-1])
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(own, pa.list_(pa.int32()))], ["quality", "lines"])

    rows = docs.where(F.octet_length("text") <= longest).select("doc_id", "text").join(chosen, "doc_id").select("quality", "text")
    got = sorted((r["quality"] > 0, r["lines"]) for r in rows.mapInArrow(described, "quality int, lines array<int>").collect())
    crf = Crf()
    if not got or got[0][0] == got[-1][0]:
        return crf
    got.sort(key=lambda r: (len(r[1]), r))
    n = np.array([len(r[1]) for r in got])
    y = np.array([r[0] for r in got], dtype=float)
    # each text weighs the same, and so does each label
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) / n
    # texts of similar length are worked on together, so many that their lines, the spare ones included, stay under BATCH_LINES
    batches, lo = [], 0
    while lo < len(got):
        hi = lo + 1
        while hi < len(got) and (hi + 1 - lo) * n[hi] <= BATCH_LINES:
            hi += 1
        batches.append((lo, hi))
        lo = hi
    w, stay, moment = crf.weights.copy(), crf.stay, np.zeros(len(FEATURES) + 1)
    for _ in range(rounds):
        slope = np.append(-1e-4 * w, -1e-4 * stay)
        for lo, hi in batches:
            slope += _slope([r[1] for r in got[lo:hi]], y[lo:hi], weight[lo:hi], w, stay)
        moment += slope**2
        move = 0.2 * slope / np.sqrt(moment + 1e-12)
        w, stay = w + move[:-1], stay + move[-1]
    return Crf(w, float(stay))


def _slope(lines: list[list[int]], y: np.ndarray, weight: np.ndarray, w: np.ndarray, stay: float) -> np.ndarray:
    """Slope of the log likelihood of some texts (features of their lines as bits) by ``w`` and ``stay``: forward-backward over all texts at once."""
    n = np.array([len(own) for own in lines])
    most = int(n.max())
    bits = np.zeros((len(lines), most), dtype=np.int64)
    for k, own in enumerate(lines):
        bits[k, : len(own)] = own
    live = np.arange(most) < n[:, None]
    x = ((bits[:, :, None] >> np.arange(len(FEATURES))) & 1).astype(float) * live[:, :, None]
    gain = np.stack([np.zeros((len(lines), most)), x @ w], axis=2)
    step = np.array([[stay, 0.0], [0.0, stay]])
    ahead = np.zeros((len(lines), most, 2))
    behind = np.zeros((len(lines), most, 2))
    ahead[:, 0] = gain[:, 0]
    for t in range(1, most):
        m = ahead[:, t - 1, :, None] + step
        ahead[:, t] = np.where(live[:, t, None], np.logaddexp(m[:, 0], m[:, 1]) + gain[:, t], ahead[:, t - 1])
    for t in range(most - 2, -1, -1):
        m = step + (gain[:, t + 1] + behind[:, t + 1])[:, None, :]
        behind[:, t] = np.where(live[:, t + 1, None], np.logaddexp(m[:, :, 0], m[:, :, 1]), 0)
    z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    p = np.exp(ahead[:, :, 1] + behind[:, :, 1] - z[:, None]) * live
    pair = ahead[:, :-1, :, None] + step + (gain[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None]
    equal = (np.exp(pair[..., 0, 0]) + np.exp(pair[..., 1, 1])) * live[:, 1:]
    by_weight = (((y[:, None] * live - p) * weight[:, None])[:, :, None] * x).sum((0, 1))
    return np.append(by_weight, ((live[:, 1:] - equal) * weight[:, None]).sum())


def judge(docs: DataFrame, crf: Crf, min_content: float = 0.5) -> DataFrame:
    """Every row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    content_share, n_content_lines.

    kept: not base_failed, and ``min_content`` of the words at least stand in content lines. A null text is empty; a text
    without words fails the base rules and has content share 0. Texts of any length are read whole; content wins ties; repeated rows stay; other
    columns are not carried; an empty table gives no rows.
    """
    python_stage(docs.sparkSession)
    where = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for lo, hi in chunks(offsets):
                page = describe(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                content = where.value.viterbi(page.lines, page.first_line)
                total = lambda v: np.add.reduceat(v, page.first_line[:-1])
                n = page.base["n_words"]
                share = total(page.line_words * content) / np.maximum(1, n)
                failed = (n < 10) | (100 * page.base["n_repeat_words"] > 20 * n)
                columns = [pa.array(v.astype(np.int64)) for v in page.base.values()]
                columns += [pa.array(failed), pa.array(~failed & (share >= min_content)), pa.array(share), pa.array(total(content.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *columns], names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "n_content_lines"]
    kinds = ["long"] * 5 + ["boolean", "boolean", "double", "long"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{a} {b}" for a, b in zip(names[1:], kinds, strict=True))
    return docs.select("doc_id", "text").mapInArrow(run, schema)
