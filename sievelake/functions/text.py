"""Text normalisation as Spark expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: accented Latin letters and their base letters
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"
# fixed values: legal forms that end a company's name
LEGAL_SUFFIXES = ("inc", "llc", "ltd", "limited", "srl", "sa", "sas", "sl", "sac", "sapi", "cv", "corp", "corporation", "co", "gmbh", "ag", "plc", "bv", "pty")
# fixed values: words of a title that name a level
SENIORITY = ("junior", "jr", "semi", "semisenior", "semisr", "ssr", "senior", "sr", "mid", "middle", "intermediate", "trainee", "entry", "i", "ii", "iii", "iv")
# fixed values: words of a title that don't tell titles apart
TITLE_STOPWORDS = (
    "de", "del", "la", "el", "los", "las", "y", "e", "o", "u", "con", "para", "por", "en", "a", "un", "una", "and", "or", "of", "the", "for", "with", "in", "at", "to", "on",
    "remote", "remoto", "remota", "hybrid", "hibrido", "hibrida", "onsite", "presencial", "latam", "latinoamerica", "argentina",
)
# fixed values: spellings of one technology
CANONICAL = (
    (r"\bfull[\s-]?stack\b", "fullstack"),
    (r"\bfront[\s-]?end\b", "frontend"),
    (r"\bback[\s-]?end\b", "backend"),
    (r"(?:^|[\s(/|,])\.net\b", " dotnet"),
    (r"\bc#", "csharp"),
    (r"\bc\+\+", "cpp"),
    (r"\bnode\.js\b", "nodejs"),
    (r"\bnext\.js\b", "nextjs"),
    (r"\bvue\.js\b", "vuejs"),
    (r"\breact\.js\b", "reactjs"),
)
# fixed values: frequent words that tell languages apart
LANGUAGE_WORDS = {
    "en": ("the", "and", "you", "with", "will", "our", "for", "are", "your", "to", "of", "we", "this", "have", "is"),
    "es": ("el", "la", "los", "las", "del", "y", "con", "en", "es", "un", "una", "tu", "nuestro", "nuestra", "somos", "buscamos", "trabajo", "equipo"),
    "pt": ("nao", "voce", "voces", "vaga", "uma", "um", "com", "em", "os", "das", "ou", "seu", "sua", "nosso", "nossa", "trabalho", "equipe", "sao", "mais", "ao", "pelo", "pela", "tambem"),
}


def fold(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.lower(F.translate(text, ACCENTED, PLAIN))


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_brackets(text: Column) -> Column:
    """Without (...) and [...], however deep they are nested: pairs without a bracket inside go until none is left. There are no more rounds than opening brackets; texts without any have none."""
    opening = F.regexp_count(text, F.lit(r"[(\[]"))
    inner = lambda t: F.regexp_replace(t, r"\([^()]*\)|\[[^\[\]]*\]", " ")
    return F.when(opening > 0, F.aggregate(F.sequence(F.lit(1), opening), text, lambda t, _: inner(t))).otherwise(text)


def fold_whole(text: Column) -> Column:
    """As ``fold``, but by compatibility forms (NFKD) for all of Unicode: ligatures, full-width forms and marks on any letter. Only texts with characters that ``fold`` leaves as they are
    go through Python; all others stay in the JVM."""

    @F.pandas_udf("string")
    def nfkd(texts: pd.Series) -> pd.Series:
        plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
        return texts.map(plain, na_action="ignore")

    rest = F.translate(text, ACCENTED, PLAIN)
    return F.coalesce(nfkd(F.when(rest.rlike(r"[^\x00-\x7F]"), text)), F.lower(rest))


def words(text: Column) -> Column:
    """Folded runs of ASCII letters and digits."""
    return F.filter(F.split(F.regexp_replace(fold(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def company_name(raw: Column) -> Column:
    """Normalised company: last part after an arrow, folded, without "via ...", legal forms dropped but never to nothing."""
    parts = F.filter(F.split(raw, r"\s*(?:→|->|=>|»)\s*"), lambda p: F.trim(p) != "")
    base = F.coalesce(F.try_element_at(parts, F.lit(-1)), raw)
    text = F.regexp_replace(fold(strip_brackets(base)), r"\s+(?:via|a traves de|through)\s+.*$", " ")
    text = F.array_join(words(text), " ")
    # s a, s r l, s a p i: letters of a dotted legal form belong together
    dotted = "|".join(" ".join(s) for s in LEGAL_SUFFIXES if 2 <= len(s) <= 4)
    text = F.regexp_replace(F.regexp_replace(text, rf"(?:^|(?<=\S ))({dotted})$", "$1#"), r"(?<=\b\w) (?=(?:\w )*\w#$)", "")
    text = F.regexp_replace(text, "#", "")
    return F.regexp_replace(text, rf"(?<=\S)(?: (?:{'|'.join(LEGAL_SUFFIXES)}))+$", "")


def title_tokens(raw: Column) -> Column:
    """Distinct words of a title in order: one spelling for each technology, no levels, stop words or numbers."""
    text = fold(strip_brackets(raw))
    for pattern, name in CANONICAL:
        text = F.regexp_replace(text, pattern, name)
    drop = F.array(*[F.lit(w) for w in (*SENIORITY, *TITLE_STOPWORDS)])
    kept = F.filter(words(text), lambda w: ~F.array_contains(drop, w) & ~w.rlike(r"^(?:id\d+|\d+)$"))
    return F.array_distinct(kept)


def job_language(text: Column, declared: Column, longest: int | None = None) -> Column:
    """es, en or pt: as declared, else by frequent words (8 at least, twice the second at least), else null. Whole texts count unless ``longest`` cuts them."""
    part = text if longest is None else F.substring(text, 1, longest)
    hits = lambda w, known: F.size(F.filter(w, lambda x: x.isin(*known)))
    count = lambda w: F.struct(*[hits(w, v).alias(k) for k, v in LANGUAGE_WORDS.items()])
    # bound as a lambda's variable, the words are found once for all languages
    every = F.element_at(F.transform(F.array(F.regexp_extract_all(fold(part), F.lit("([a-z]+)"), 1)), count), 1)
    n = {k: every[k] for k in LANGUAGE_WORDS}
    code = F.substring(F.lower(F.trim(declared)), 1, 2)
    by_words = F.lit(None).cast("string")
    for k in reversed(list(n)):
        others = F.greatest(*[v for j, v in n.items() if j != k])
        by_words = F.when((n[k] >= 8) & (n[k] >= 2 * others), k).otherwise(by_words)
    return F.when(code.isin(*n), code).when(text.isNotNull(), by_words)


def content_hash(text: Column) -> Column:
    return F.sha2(F.lower(squash(text)), 256)


def html_to_text(html: Column) -> Column:
    """Scripts, styles and comments go; block ends become line feeds, other tags spaces; common entities are read."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])\s*>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def mask_emails(text: Column, marker: str = "[email]") -> Column:
    # the pattern begins anew at every word: texts without an at need not be searched
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", marker)).otherwise(text)


def mask_phones(text: Column, marker: str = "[phone]") -> Column:
    """Runs of eight digits or more with usual separators, unless they are dates, ranges of years or addresses of hosts."""
    no = r"(?!\d{4}-\d{2}-\d{2}\b)(?!(?:19|20)\d{2}\s*[-–/]\s*(?:19|20)\d{2}\b)(?!\d{1,3}(?:\.\d{1,3}){3}\b)"
    return F.regexp_replace(text, rf"(?<![\w.+]){no}\+?\(?\d(?:[\s().-]{{0,2}}\d){{7,14}}(?![\w])", marker)


def seniority_bucket(level: Column, title: Column) -> Column:
    """junior, semi, senior, lead or unknown: the level column first, else the title; the lowest that is named."""
    text = fold(F.coalesce(F.when(F.trim(level) != "", level), title, F.lit("")))
    semi = text.rlike(r"\b(semi[\s-]?senior|semi[\s-]?sr|ssr|mid|middle|intermediate)\b")
    rest = F.regexp_replace(text, r"\bsemi[\s-]?(senior|sr)\b", " ")
    return (
        F.when(rest.rlike(r"\b(junior|jr|trainee|entry|intern)\b"), "junior")
        .when(semi, "semi")
        .when(rest.rlike(r"\b(senior|sr)\b"), "senior")
        .when(rest.rlike(r"\b(lead|staff|principal|head|manager)\b"), "lead")
        .otherwise("unknown")
    )


def mask_shape(text: Column) -> Column:
    """Letters and digits replaced by X, x and 9: the shape of a text without its content."""
    return F.mask(text, F.lit("X"), F.lit("x"), F.lit("9"))


def monthly_usd(amount: Column, period: Column) -> Column:
    """Amount a month by period (mensual, anual, hora at 160 hours); halves round up; null for other periods."""
    up = lambda x: F.floor(x + 0.5).cast("long")
    return F.when(period == "mensual", up(amount)).when(period == "anual", up(amount / 12)).when(period == "hora", up(amount * 160))
