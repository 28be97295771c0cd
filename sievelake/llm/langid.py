"""Language identification by string kernels.

Kernel: blended spectrum of 1- to 3-character grams, by presence: the number of grams two texts share,
over the root of the product of their gram counts. Nystrom: a text is described by its kernel values with
a set of landmark texts. Classifier: one-versus-rest kernel ridge regression in that space. Scoring is a
product of two matrices per batch: presence x landmarks, then similarities x weights.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm._session import python_stage

#: Symbols of the gram alphabet: 0 for anything that is no letter, 1-26 for a-z, the rest hashed.
BASE = 64
GRAMS = BASE + BASE**2 + BASE**3
_BLOCK = 256
#: Landmark texts in expectation, those of all languages together.
MOST_LANDMARKS = 1536


def _alphabet() -> np.ndarray:
    codes = np.zeros(0x3000, dtype=np.int32)
    for point in range(len(codes)):
        if chr(point).isalpha():
            codes[point] = point - 96 if 97 <= point <= 122 else 27 + point % (BASE - 27)
    return codes


_CODES = _alphabet()


def grams(text: str) -> np.ndarray:
    """The distinct blended grams (orders 1 to 3) of a whole lower-cased text, as numbers below ``GRAMS``."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where(points < len(_CODES), _CODES[np.minimum(points, len(_CODES) - 1)], 27 + (points % (BASE - 27)).astype(np.int32))
    two = c[:-1] * BASE + c[1:]
    three = two[:-1] * BASE + c[2:]
    found = np.concatenate([c, two + BASE, three + (BASE + BASE**2)])
    return distinct(found, GRAMS)


_stamp = np.zeros(0, dtype=np.int64)


def distinct(found: np.ndarray, size: int) -> np.ndarray:
    """The distinct values below ``size``, without a sort: the last row to stamp a value stands for it."""
    global _stamp
    if len(_stamp) < size:
        _stamp = np.zeros(size, dtype=np.int64)
    rows = np.arange(len(found))
    _stamp[found] = rows
    return found[_stamp[found] == rows]


def has_letter(text: Column) -> Column:
    """Of any script; digits, numerals such as \u00bd, \u00b2 or \u2460, and marks are no letters. False for a null text."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


@dataclass
class Model:
    """``column`` maps a gram to its landmark column (-1: in no landmark); ``landmarks`` is 0/1, columns x landmarks."""

    langs: list[str]
    column: np.ndarray
    landmarks: np.ndarray
    norms: np.ndarray
    weights: np.ndarray | None = None

    @staticmethod
    def of(langs: list[str], sets: list[np.ndarray]) -> Model:
        """``sets``: the grams of each landmark."""
        known = np.unique(np.concatenate(sets)) if sets else np.zeros(0, dtype=np.int64)
        column = np.full(GRAMS, -1, dtype=np.int32)
        column[known] = np.arange(len(known))
        landmarks = np.zeros((len(known), len(sets)), dtype=np.float32)
        for k, s in enumerate(sets):
            landmarks[column[s], k] = 1
        return Model(langs, column, landmarks, np.sqrt([max(1, len(s)) for s in sets]))

    def similarities(self, texts: list[str]) -> np.ndarray:
        """Kernel values, texts x landmarks, by one matrix product for each block of texts."""
        out = np.zeros((len(texts), self.landmarks.shape[1]))
        for lo in range(0, len(texts), _BLOCK):
            part = texts[lo : lo + _BLOCK]
            present = np.zeros((len(part), len(self.landmarks)), dtype=np.float32)
            norms = np.ones(len(part))
            for k, text in enumerate(part):
                own = grams(text)
                norms[k] = np.sqrt(max(1, len(own)))
                columns = self.column[own]
                present[k, columns[columns >= 0]] = 1
            out[lo : lo + _BLOCK] = (present @ self.landmarks) / norms[:, None] / self.norms
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, softmax share) of each text; ties go to the language first in order."""
        if not texts or not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        scores = 4 * (self.similarities(texts) @ self.weights)
        shares = np.exp(scores - scores.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        best = shares.argmax(axis=1)
        return [self.langs[k] for k in best], shares[np.arange(len(texts)), best]


def _sample(rows: DataFrame, quotas: dict[str, float], part: str) -> DataFrame:
    """Rows whose hash falls under the share of their language (an expected bound, the same on each run)."""
    share = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    draw = (F.xxhash64(F.lit(part), F.col("doc_id"), F.col("text")).bitwiseAND(F.lit((1 << 52) - 1))) / float(1 << 52)
    return rows.where(draw < F.element_at(share, F.col("lang")))


def _gram_sets(rows: DataFrame) -> list[np.ndarray]:
    """The grams of each text, in an order of their own; texts don't leave the executors."""
    python_stage(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.sort(grams(t)) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))], ["grams"])

    return [np.array(g, dtype=np.int64) for g in sorted(r["grams"] for r in rows.select("text").mapInArrow(run, "grams array<long>").collect())]


def fit(rows: DataFrame, landmarks: int = 24, examples: int = 800, ridge: float = 1e-3) -> Model:
    """Fits on ``rows`` (doc_id, text, lang), which must hold training rows only.

    Bounds, in expectation: ``landmarks`` landmark texts and ``examples`` training texts for each language, drawn by hash, whole texts of any length;
    beyond ``MOST_LANDMARKS`` / ``landmarks`` languages each has fewer landmarks. A language of which none is drawn has the text with
    the least hash. Languages weigh the same, however many rows they have. Rows without a language or a letter are left out; repeated rows count each.
    Without a usable row the model knows no language and predicts ``und``.
    """
    rows = rows.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    total = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(total)
    if not langs:
        return Model.of([], [])
    each = min(landmarks, max(1, MOST_LANDMARKS // len(langs)))
    chosen = _sample(rows, {k: min(1.0, each / n) for k, n in total.items()}, "landmark")
    rare = set(langs) - {r["lang"] for r in chosen.select("lang").distinct().collect()}
    chosen = chosen.select("text")
    if rare:
        least = rows.where(F.col("lang").isin(*rare)).groupBy("lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        chosen = chosen.union(least.select("text"))
    model = Model.of(langs, _gram_sets(chosen))
    drawn = _sample(rows, {k: min(1.0, examples / n) for k, n in total.items()}, "example")
    where = rows.sparkSession.sparkContext.broadcast(model)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = where.value.similarities(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(list(values), pa.list_(pa.float64()))], ["lang", "k"])

    got = sorted((r["lang"], r["k"]) for r in drawn.select("lang", "text").mapInArrow(described, "lang string, k array<double>").collect())
    k_nm = np.array([k for _, k in got]) if got else np.zeros((0, len(model.norms)))
    target = np.array([[1.0 if lang == x else -1.0 for x in langs] for lang, _ in got]).reshape(-1, len(langs))
    drawn_of = Counter(lang for lang, _ in got)
    weight = np.array([1 / drawn_of[lang] for lang, _ in got]).reshape(-1, 1)
    k_mm = (model.landmarks.T @ model.landmarks) / model.norms[:, None] / model.norms
    left = k_nm.T @ (weight * k_nm) + ridge * k_mm + 1e-8 * np.eye(len(model.norms))
    model.weights = np.linalg.lstsq(left, k_nm.T @ (weight * target), rcond=None)[0]
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs``: doc_id, lang_pred, score. Null and empty texts and those without a letter are ``und`` with score 0; texts of any length are
    read whole. Ties go to the language first in order; repeated rows stay; other columns are not carried; an empty table gives no rows."""
    python_stage(docs.sparkSession)
    where = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            usable = np.flatnonzero(batch.column("usable").to_numpy(zero_copy_only=False)).tolist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            names, shares = where.value.predict([texts[k] for k in usable])
            for k, name in zip(usable, names, strict=True):
                lang[k] = name
            score[usable] = shares
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", has_letter(F.col("text")).alias("usable")).mapInArrow(scored, f"doc_id {kind}, lang_pred string, score double")
