"""Toxicity of texts whose words are disguised: noisy-channel restoration, then a word model.

A suspicious span (digits or symbols among letters, repeated letters, spaced-out letters, pieces that together spell a marked word) is a
lattice: each position offers the readings it may stand for, at the channel's cost. Viterbi decoding runs through the lattice with
two automata: a character trigram model of the whole corpus, and a trie of the words that the labels mark, each of which has a
probability as a whole. The best path is the restored span. A span with one reading is its own best path, so plain words are taken
as they are. The score is a noisy-or over the words of the restored text: each word alone, by itself or by its beginning, may make it toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm._session import python_stage, scratch_table
from sievelake.llm._text import Words, chunks, flat, mix
from sievelake.llm.langid import _CODES, BASE

#: What a symbol may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
_VOWELS = "aeiou"
#: Costs of the channel, as natural logarithms: a symbol for a letter, no symbol, a digit that is one, a repeated letter, a masked vowel, a gap that
#: ends a word among spaced-out letters, each character by which a gap is wider than the narrowest, a gap inside a word of plain text.
MAPPED, DROPPED, KEPT, REPEATED, MASKED, SPLIT, WIDER, JOINED = -1.0, -4.0, -4.0, -0.7, -3.0, -1.0, -2.0, -3.0
#: log P of a word that the labels mark, as a whole; other words are spelled out by the trigram model.
KNOWN = -10.0
_PUNCTUATION = ".,;:?\"'`´()[]{}<>«»“”‘’„…¿¡–—-_~^/\\=%&#*§°"
_DOUBLE = re.compile(r"(.)\1")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+])(?:[ .\-_*]{1,3}(?:[^\W_]|[@$!|+])){2,}(?!\S)")
_RUN = re.compile(r"(.)\1*", re.S)
_GAP_OR_RUN = re.compile(r"([ .\-_*])[ .\-_*]*|([^ .\-_*])\2*", re.S)
_LETTERS = re.compile(r"[^\W\d_]+")
_PREFIXES = (4, 5, 6)
_CACHE = 200_000
#: The plainest reading of a symbol, by which pieces are looked up before they are decoded.
_PLAINEST = str.maketrans({c: x[0] for c, x in LEET.items()})


@dataclass
class Language:
    """log P(c | a, b) over the alphabet of ``BASE`` symbols; 0 is a boundary."""

    table: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Language:
        """From trigram counts (flat, BASE cubed), each order smoothed by the one below."""
        three = counts.reshape(BASE, BASE, BASE).astype(np.float64)
        one = (three.sum((0, 1)) + 0.1) / (three.sum() + 0.1 * BASE)
        two = three.sum(0)
        two = (two + 5 * one) / (two.sum(1, keepdims=True) + 5)
        return Language(np.log((three + 5 * two) / (three.sum(2, keepdims=True) + 5)).astype(np.float32))


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < len(_CODES), _CODES[np.minimum(points, len(_CODES) - 1)], 0)


def _symbol(c: str, n: int) -> list[tuple[str, float]]:
    """Readings of ``n`` equal characters that are no letters."""
    offered = [(x, MAPPED) for x in LEET.get(c, "")]
    offered += [(x + x, MAPPED) for x in LEET.get(c, "") if n > 1]
    if c.isdigit():
        return [*offered, (c * n, KEPT)]
    # one symbol of those that look like letters is seldom there for itself, three are
    offered += [("", DROPPED if c in LEET and n < 3 else 0.0), (" ", DROPPED if c in LEET and n < 3 else SPLIT)]
    return [*offered, *((v, MASKED) for v in _VOWELS)] if c == "*" and n == 1 else offered


def _letter(c: str, n: int) -> list[tuple[str, float]]:
    return [(c, 0.0)] if n == 1 else [(c, REPEATED), (c + c, 0.0 if n == 2 else REPEATED)]


def readings(span: str, joined: bool = False) -> list[list[tuple[str, float]]]:
    """The lattice of a lower-cased span: for each run of one character, its readings and their costs.

    Among spaced-out letters a gap is one position, which the wider ends a word the likelier. ``joined``: the gaps of plain text may be
    gaps inside a word.
    """
    if not joined and _SPACED.fullmatch(span):
        runs = [(m[1] is not None, m[0]) for m in _GAP_OR_RUN.finditer(span)]
        narrow = min((len(x) for gap, x in runs if gap), default=1)
        lattice = []
        for gap, x in runs:
            more = len(x) - narrow
            lattice.append([("", WIDER * more), (" ", SPLIT if not more else 0.0)] if gap else _letter(x[0], len(x)) if x[0].isalpha() else _symbol(x[0], len(x)))
        return lattice
    lattice = []
    for run in _RUN.finditer(span):
        c, n = run[1], len(run[0])
        if c.isspace():
            lattice.append([("", JOINED), (" ", 0.0)] if joined else [(" ", 0.0)])
        else:
            lattice.append(_letter(c, n) if c.isalpha() else _symbol(c, n))
    return lattice


def _squeezed(word: str) -> str:
    return _DOUBLE_RUN.sub(r"\1", word)


_DOUBLE_RUN = re.compile(r"(.)\1+")


@dataclass
class Lexicon:
    """A trie of marked words, spelled without repeated letters. ``next``: (node, letter) to node; ``whole``: the word that ends at a node;
    ``begin``: the beginning of words that ends there, after which any letters may follow; ``heads``: what pieces of a word may start with."""

    next: dict[tuple[int, str], int] = field(default_factory=dict)
    last: list[str] = field(default_factory=lambda: [""])
    whole: dict[int, str] = field(default_factory=dict)
    begin: dict[int, str] = field(default_factory=dict)
    heads: set[str] = field(default_factory=set)
    spelled: set[str] = field(default_factory=set)

    @staticmethod
    def of(features: list[str]) -> Lexicon:
        """From words and ^beginnings; of words with equal spelling the last stays."""
        out = Lexicon()
        for f in features:
            word = f.lstrip("^")
            node, short = 0, _squeezed(word)
            for c in short:
                if (node, c) not in out.next:
                    out.next[node, c] = len(out.last)
                    out.last.append(c)
                node = out.next[node, c]
            if f[0] == "^":
                out.begin[node] = word
            else:
                out.whole[node] = word
                out.spelled.add(short)
                out.heads.update(x[:k] for x in (word, short) for k in range(1, len(x)))
        return out


def decode(span: str, language: Language, lexicon: Lexicon | None = None, joined: bool = False) -> tuple[str, float]:
    """The best path through the lattice and its log probability; of equal paths the first in the order of ``readings``.

    A state is the last two symbols of the trigram model and the node of the trie (0: none). At the start of a word a path may enter the trie at
    the cost of ``KNOWN``; there letters are free, repeated ones stay at their node, and it is left where a word or a beginning ends. One state holds
    one path, so the work grows with the span's length alone.
    """
    table, none = language.table, Lexicon()
    lexicon = lexicon or none
    step, last, whole, begin = lexicon.next, lexicon.last, lexicon.whole, lexicon.begin
    # a path is a linked list of its texts, so that paths share what they have in common
    states: dict[tuple[int, int, int], tuple[float, tuple | None]] = {(0, 0, 0): (0.0, None)}
    for offered in [*readings(span, joined), [(" ", 0.0)]]:
        new: dict[tuple[int, int, int], tuple[float, tuple | None]] = {}
        for text, cost in offered:
            for state, (score, path) in states.items():
                reached = [(state, score + cost, path)]
                for c in text:
                    after = []
                    code = int(codes(c)[0]) if c not in _KNOWN_CODES else _KNOWN_CODES[c]
                    for (a, b, node), s, p in reached:
                        if not node:
                            after.append(((b, code, 0), s + float(table[a, b, code]), (p, c)))
                            if not b and (0, c) in step:
                                after.append(((b, code, step[0, c]), s + KNOWN, p))
                            continue
                        if last[node] == c:
                            after.append(((b, code, node), s, p))
                        elif (node, c) in step:
                            after.append(((b, code, step[node, c]), s, p))
                        if not c.isalpha():
                            if node in whole or node in begin:
                                after.append(((b, code, 0), s, ((p, whole.get(node) or begin[node]), c)))
                        elif node in begin:
                            after.append(((b, code, 0), s + float(table[a, b, code]), ((p, begin[node]), c)))
                    reached = after
                for to, s, p in reached:
                    if to not in new or new[to][0] < s:
                        new[to] = (s, p)
        states = new
    score, path = max((v for k, v in states.items() if not k[2]), key=lambda x: x[0])
    parts = []
    while path is not None:
        path, x = path
        parts.append(x)
    return "".join(reversed(parts)).strip(), score


_KNOWN_CODES = {c: int(codes(c)[0]) for c in "abcdefghijklmnopqrstuvwxyzáéíóúüñäößàâçèêëîïôùû 0123456789"}


@dataclass
class Model:
    """``weights``: the chance that a feature (a word, or ^ and a beginning) alone makes a text toxic; ``prior``: that of a text without any."""

    language: Language
    weights: dict[str, float] = field(default_factory=dict)
    prior: float = 0.02
    lexicon: Lexicon = field(default_factory=Lexicon)
    cache: dict[tuple[bool, str], frozenset[str]] = field(default_factory=dict)

    def learn(self, weights: dict[str, float], prior: float) -> None:
        """Marked words and beginnings become known to the decoder; of those with one spelling the heaviest."""
        self.weights, self.prior, self.cache = weights, prior, {}
        self.lexicon = Lexicon.of([w for w in sorted(weights, key=lambda w: (weights[w], w)) if len(w) > 2])

    def restored(self, span: str, joined: bool = False) -> frozenset[str]:
        """The words on the best path of a span."""
        got = self.cache.get((joined, span))
        if got is None:
            if len(self.cache) >= _CACHE:
                self.cache.clear()
            got = self.cache[joined, span] = frozenset(_LETTERS.findall(decode(span, self.language, self.lexicon, joined)[0]))
        return got

    def pieces(self, tokens: list[str]) -> Iterator[str]:
        """Neighbouring tokens that together spell a marked word, in their plainest reading: no other lattice over a gap has a marked word in it."""
        heads, spelled = self.lexicon.heads, self.lexicon.spelled
        first = {t for t in set(tokens) if t in heads or (not t.isalpha() and t.translate(_PLAINEST) in heads)}
        for i in [i for i, t in enumerate(tokens) if t in first]:
            joined = tokens[i].translate(_PLAINEST)
            for j in range(i + 1, len(tokens)):
                joined += tokens[j].rstrip(_PUNCTUATION).translate(_PLAINEST)
                if _squeezed(joined) in spelled:
                    yield " ".join([*tokens[i:j], tokens[j].rstrip(_PUNCTUATION)])
                if joined not in heads:
                    break

    def words(self, text: str | None) -> set[str]:
        """Distinct words of the restored text: plain words as they are, suspicious spans restored."""
        text = (text or "").lower()
        tokens = text.split()
        distinct = set(tokens)
        found = {t for t in distinct if t.isalpha()}
        for token in distinct - found:
            core = token.strip(_PUNCTUATION).rstrip("!")
            if core.isalpha():
                found.add(core)
            elif any(map(str.isalpha, core)):
                found.update(self.restored(core))
        if _TRIPLE.search(text):
            found.update(*[self.restored(t) for t in found if _TRIPLE.search(t)])
        if self.weights:
            # a letter may be doubled or not; only where one reading is marked does it matter which
            spelled = self.lexicon.spelled
            found.update(*[self.restored(w) for w in found if w not in self.weights and (w in spelled or (_DOUBLE.search(w) and _squeezed(w) in spelled))])
            found.update(*[self.restored(x, True) for x in self.pieces(tokens)])
        found.update(*[self.restored(m[0]) for m in _SPACED.finditer(text)])
        return found

    def score(self, text: str | None) -> float:
        known, clean = self.weights, 1 - self.prior
        for word in self.words(text):
            chance = max([known.get(word, 0.0), *[known.get("^" + word[:n], 0.0) for n in _PREFIXES if len(word) > n]])
            clean *= 1 - chance
        return 1 - clean


def _beginnings(words: set[str]) -> set[str]:
    return {"^" + w[:n] for n in _PREFIXES for w in words if len(w) > n}


def language_model(docs: DataFrame) -> Language:
    """Trigram counts of all texts, added up on the executors: at most BASE cubed rows reach the driver."""
    python_stage(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BASE**3, dtype=np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo in range(0, len(texts), 64):
                c = codes("\n\n" + "\n\n".join(t for t in texts[lo : lo + 64] if t) + "\n\n").astype(np.int64)
                total += np.bincount(c[:-2] * BASE**2 + c[1:-1] * BASE + c[2:], minlength=BASE**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["gram", "n"])

    rows = docs.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BASE**3, dtype=np.int64)
    counts[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return Language.of(counts)


def _g2(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Likelihood ratio of a word's presence against the label; 0 where it does not speak for label 1."""
    table = np.stack([pos, neg, n_pos - pos, n_neg - neg]).astype(float)
    rows, cols = np.stack([pos + neg, n_pos + n_neg - pos - neg]).astype(float), np.array([n_pos, n_neg], dtype=float)
    expected = np.stack([rows[i] * cols[j] for i in (0, 1) for j in (0, 1)]) / (n_pos + n_neg)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(table > 0, table * np.log(table / expected), 0)
    return np.where(pos * n_neg > neg * n_pos, 2 * parts.sum(0), 0)


def _apart(sample: DataFrame) -> DataFrame:
    """(text_hash) of the texts of a sample that count as evidence: of near copies with one label one. Texts that share the least hash of their
    five-word shingles under one of four orders, as two texts of similarity s do with probability 1 - (1 - s)^4, count once."""
    salts = mix(np.arange(1, 5, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            least = np.zeros((len(salts), batch.num_rows), dtype=np.uint64)
            for lo, hi in chunks(offsets):
                own, first = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]).shingles(5)
                some = np.flatnonzero(np.diff(first))
                if len(some):
                    least[:, lo + some] = [np.minimum.reduceat(mix(own ^ s), first[some]) for s in salts]
            yield pa.RecordBatch.from_arrays([batch.column("text_hash"), batch.column("toxic"), *[pa.array(m.view(np.int64)) for m in least]], ["text_hash", "toxic", "m0", "m1", "m2", "m3"])

    left = sample.mapInArrow(run, "text_hash long, toxic int, m0 long, m1 long, m2 long, m3 long")
    for m in ("m0", "m1", "m2", "m3"):
        left = left.groupBy((F.col("toxic") > 0).alias("label"), F.col(m).alias("key")).agg(F.min_by(F.struct("text_hash", "toxic", "m0", "m1", "m2", "m3"), "text_hash").alias("one")).select("one.*")
    return left.select("text_hash")


def _marked(sample: DataFrame, features: Callable[[str], set[str]], n_pos: int, n_neg: int, vocabulary: int, false_share: float, errors: float, least_chance: float) -> dict[str, float]:
    """The features of ``sample`` (toxic, text) that speak for label 1, each with the chance of label 1 in texts that have it (see ``fit``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen[toxic > 0].update(features(text))
            every = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *[pa.array([s[f] for f in every], pa.int64()) for s in seen]], ["feature", "neg", "pos"])

    with scratch_table(sample.mapInArrow(count, "feature string, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))) as counted:
        tested = counted.count()
        # only features that lean to label 1; the rest would get no weight
        leaning = counted.where((F.col("pos") >= 3) & (F.col("pos") * n_neg > F.col("neg") * n_pos))
        lean = (F.col("pos") / n_pos - F.col("neg") / n_neg) / F.sqrt((F.col("pos") + F.col("neg")) / (n_pos + n_neg))
        rows = leaning.orderBy(F.desc(lean), "feature").limit(vocabulary).toArrow()
    pos, neg = rows["pos"].to_numpy(), rows["neg"].to_numpy()
    n, share = pos + neg, pos / np.maximum(1, pos + neg)
    # the lower bound of Wilson's interval for that chance
    least = (share + errors**2 / (2 * n) - errors * np.sqrt(share * (1 - share) / n + errors**2 / (4 * n**2))) / (1 + errors**2 / n)
    by_chance = np.array([math.erfc(math.sqrt(g / 2)) / 2 for g in _g2(pos, neg, n_pos, n_neg)])
    names, strong = np.array(rows["feature"].to_pylist(), dtype=object), _discovered(by_chance, tested, false_share) & (least >= least_chance)
    return dict(zip(names[strong].tolist(), least[strong].tolist(), strict=True))


def fit(docs: DataFrame, labels: DataFrame, examples: int = 20_000, vocabulary: int = 4_000, false_share: float = 0.01, errors: float = 3.0, least_chance: float = 0.25) -> Model:
    """Learns from ``labels`` (doc_id, toxic), which must hold training rows only, and the texts of ``docs``.

    The language model counts all of ``docs``. The word model is fitted on ``examples`` labelled rows at most, in expectation
    (rows whose hash falls under that share; near copies count once). Its features are words, then beginnings of words that are no features;
    ``vocabulary`` of each at most: those that speak for label 1, by the likelihood ratio of their presence, so strongly that ``false_share`` of them at
    most are expected to do so by chance (Benjamini and Hochberg, over all of the sample). Each has the least chance of label 1 in texts that have it
    that is within ``errors`` standard errors of what the sample shows, so that a rare feature marks a text only together with others; under ``least_chance`` it
    is none, however sure it is that it says a little (a large sample is sure of that for many). Rows with a null id, label or text are left
    out; an id that is labelled twice has its higher label. Other columns may
    have any names. Without a label of each kind, as in empty tables, all texts get the prior score.
    """
    model = Model(language_model(docs))
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = labels.count()
    draw = F.xxhash64(F.lit("toxic"), F.col("doc_id")).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    chosen = labels.where(draw < min(1.0, examples / max(1, n)))
    where = docs.sparkSession.sparkContext.broadcast(model)
    # the sample is bounded by a parameter, so its ids may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())
    equal = texts.groupBy(F.xxhash64("text").alias("text_hash")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    with scratch_table(equal) as drawn, scratch_table(drawn.join(F.broadcast(_apart(drawn)), "text_hash", "left_semi")) as sample:

        sizes = {bool(r["t"]): r["n"] for r in sample.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
        n_pos, n_neg = sizes.get(True, 0), sizes.get(False, 0)
        if not n_pos or not n_neg:
            return model
        weights = _marked(sample, lambda t: where.value.words(t), n_pos, n_neg, vocabulary, false_share, errors, least_chance)
        # a beginning speaks for the words that are not marked by themselves
        weights |= _marked(sample, lambda t: _beginnings(where.value.words(t) - weights.keys()), n_pos, n_neg, vocabulary, false_share, errors, least_chance)

        def unmarked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                none = [not (w := where.value.words(t)) & weights.keys() and not _beginnings(w) & weights.keys() for t in batch.column("text").to_pylist()]
                yield batch.select(["toxic"]).filter(pa.array(none, pa.bool_()))

        rest = {r["t"]: r["count"] for r in sample.mapInArrow(unmarked, "toxic int").groupBy((F.col("toxic") > 0).alias("t")).count().collect()}
    model.learn(weights, min(0.4, (rest.get(True, 0) + 0.5) / (sum(rest.values()) + 1)))
    return model


def _discovered(p: np.ndarray, tested: int, false_share: float) -> np.ndarray:
    """Which of the least p-values of ``tested`` hypotheses to believe, so that ``false_share`` of them at most are expected to be false."""
    order = np.argsort(p, kind="stable")
    passed = np.flatnonzero(p[order] <= false_share * np.arange(1, len(p) + 1) / max(1, tested))
    out = np.zeros(len(p), dtype=bool)
    if len(passed):
        out[order[: passed[-1] + 1]] = True
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs``: doc_id, text_hash, score (0 to 1), predicted (1 from 0.5). A null or empty text gets the prior score; texts of any length
    are read whole; repeated rows stay, with equal scores; other columns are not carried; an empty table gives no rows."""
    python_stage(docs.sparkSession)
    where = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([where.value.score(t) for t in batch.column("text").to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], ["doc_id", "text_hash", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whatever their names, whose score (see ``score``) is under 0.5. No row leaves its partition."""
    python_stage(docs.sparkSession)
    where = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([where.value.score(t) < 0.5 for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
