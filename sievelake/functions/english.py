"""Does a posting ask for English, and how much? Words are labelled (language, level, demand), and a level goes to the language nearest to it in words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.functions.text import job_language
from sievelake.session import ship

LEVELS = ("basico", "intermedio", "avanzado", "fluido")
# fixed values: words and pairs of words for each level, folded
LEVEL_WORDS = {
    "basico": ("a1", "a2", "basico", "basic", "elementary"),
    "intermedio": ("b1", "intermedio", "intermediate", "conversacional", "conversational"),
    "avanzado": ("b2", "c1", "avanzado", "advanced", "upper intermediate", "professional", "business level", "working proficiency"),
    "fluido": ("c2", "fluido", "fluent", "fluency", "nativo", "native", "bilingue", "bilingual", "full professional"),
}
# fixed values: names of English and of other languages, and small words between names in a list
ENGLISH = ("english", "ingles")
OTHERS = ("spanish", "espanol", "german", "aleman", "french", "frances", "portuguese", "portugues", "italian", "italiano", "chinese", "chino", "japanese", "japones", "korean", "coreano", "dutch")
LISTING = ("language", "in", "of", "both", "and", "or", "y", "e", "o", "de", "en", "ambos")
# fixed values: phrases in which English asks for nothing; a hyphen counts where it is written
NO_DEMAND = (
    "english version", "english below", "english translation", "english site", "english only", "english classes", "english lessons", "plain english", "version ingles", "version de ingles", "version en ingles",
    "traduccion ingles", "traduccion de ingles", "traduccion en ingles", "sitio ingles", "sitio de ingles", "sitio en ingles", "clases ingles", "clases de ingles", "clases en ingles", "en ingles abajo",
    "english-language", "spanish-speaking", "cv in english", "cv en english", "cv in ingles", "cv en ingles", "resume in english", "resume en english", "resume in ingles", "resume en ingles",
)
# fixed values: words that make a mention a demand, and beginnings of such words
DEMAND = (
    "level", "skill", "skills", "communication", "written", "spoken", "verbal", "required", "must", "strong", "excellent", "good", "manejo", "dominio", "nivel", "conocimiento", "conocimientos", "excluyente", "indispensable",
    "deseable", "requerido", "oral", "escrito", "hablar", "comunicacion", "idioma", "language", "lees", "leer", "tecnico",
)
DEMAND_BEGINNINGS = ("proficien", "requirement", "speak")
#: Words around a mention within which a phrase silences it.
NEAR = 4

_LEVEL_OF = {tuple(w.split()): k for k, name in enumerate(LEVELS) for w in LEVEL_WORDS[name]}
_SILENT = [tuple(re.findall("[a-z]+|-", p)) for p in NO_DEMAND]
_LANGUAGES, _IN_LISTS = {*ENGLISH, *OTHERS}, {*ENGLISH, *OTHERS, *LISTING}
_WORD = re.compile(r"[a-z0-9]+|[\n.;•-]")


def _fragments(folded: str) -> Iterator[list[tuple[str, bool]]]:
    """Sentences and items of lists, as words, each with whether a hyphen ties it to the next one. A dash between blanks parts fragments like a full stop."""
    words: list[tuple[str, bool]] = []
    for m in _WORD.finditer(folded):
        token = m[0]
        if token[0].isalnum():
            words.append((token, False))
            continue
        around = folded[max(0, m.start() - 1) : m.start()], folded[m.end() : m.end() + 1]
        if token == "-" and not (around[0].isspace() and around[1].isspace()):
            if words and around[0].isalnum():
                words[-1] = (words[-1][0], True)
            continue
        if words:
            yield words
        words = []
    if words:
        yield words


def _is_silent(words: list[tuple[str, bool]], at: int) -> bool:
    """A phrase that asks for nothing stands within a few words of a mention."""
    lo, hi = max(0, at - NEAR), min(len(words), at + NEAR + 1)
    line: list[str] = []
    for w, tied in words[lo:hi]:
        line += [w, "-"] if tied else [w]
    bare = [w for w in line if w != "-"]
    inside = lambda phrase, own: any(tuple(own[k : k + len(phrase)]) == phrase for k in range(len(own) - len(phrase) + 1))
    return any(inside(p, line if "-" in p else bare) for p in _SILENT)


def _for_english(words: list[str], english: set[int], others: list[int], first: int, last: int) -> bool:
    """Whether the level in words ``first`` to ``last`` is one of English: it leads into a list of languages with English in it, or no other language is nearer."""
    k = last + 1
    while k < len(words) and words[k] in _IN_LISTS:
        if k in english:
            return True
        k += 1
    away = lambda places: min(first - p if p < first else p - last for p in places)
    return not others or away(english) <= away(others)


def asked_english(text: str | None) -> tuple[bool, str | None]:
    """(asks, level) of one text, read whole."""
    folded = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    asks, best = False, -1
    if not any(name in folded for name in ENGLISH):
        return asks, None
    for tied in _fragments(folded):
        words = [w for w, _ in tied]
        english = {k for k, w in enumerate(words) if w in ENGLISH and not _is_silent(tied, k)}
        if not english:
            continue
        others, level, k = [k for k, w in enumerate(words) if w in OTHERS], -1, 0
        while k < len(words):
            size = 2 if tuple(words[k : k + 2]) in _LEVEL_OF else 1
            found = _LEVEL_OF.get(tuple(words[k : k + size]))
            if found is not None and _for_english(words, english, others, k, k + size - 1):
                level = max(level, found)
            k += size if found is not None else 1
        if level >= 0 or any(w in DEMAND or w.startswith(DEMAND_BEGINNINGS) for w in words):
            asks, best = True, max(best, level)
    return asks, LEVELS[best] if best >= 0 else None


def language_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang") -> DataFrame:
    """(id, language, asks_english, english_level). Distances between words have no built-in form, so texts that name English pass an Arrow stage; the rest,
    and the language, stay in the JVM. Rows keep their partitions; null and empty texts ask for nothing."""
    kind = docs.schema[id_col].dataType.simpleString()
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [asked_english(t) if named else (False, None) for t, named in zip(batch.column("text").to_pylist(), batch.column("named").to_pylist(), strict=True)]
            asks, level = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("language"), pa.array(asks, pa.bool_()), pa.array(level, pa.string())], [id_col, "language", "asks_english", "english_level"])

    named = F.coalesce(F.col(text_col).rlike(r"(?iu)english|ingl[eé]|ingle[̀-ͯ]"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), job_language(F.col(text_col), F.col(declared_col)).alias("language"), named.alias("named"), F.when(named, F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, f"{id_col} {kind}, language string, asks_english boolean, english_level string")
