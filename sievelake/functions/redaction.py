"""Personal data in texts: finders that start from a sign (an at, a label, digits) and read on by tokens; what they find is marked, counted, and looked for again.

A finder is a small function from a text to ranges. The text is searched for the sign by a substring or word search; only around it are tokens read and shapes checked.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sievelake.session import ship

Span = tuple[int, int]
# fixed values: kinds in the order in which they are marked, and their markers
MARKERS = {
    "email": "[email]", "url": "[link]", "national_id": "[documento]", "passport": "[documento]", "address": "[dirección]", "birth_date": "[fecha de nacimiento]", "age": "[edad]", "marital_status": "[estado civil]", "phone": "[teléfono]",
    "display_name": "[nombre]",
}
KINDS = tuple(MARKERS)
# fixed values: ends of domains that make a link with a path, and sites that are links without one
LINK_DOMAINS = ("com", "net", "org", "io", "dev", "app", "ar", "co", "me", "ai", "info", "edu", "gov", "br", "cl", "uy", "mx", "es", "us", "uk", "tech", "xyz")
LINK_SITES = ("linkedin", "github", "gitlab", "behance", "twitter", "instagram", "facebook")
# fixed values: labels before a value, folded, as words
ID_LABELS = ("dni", "d n i", "documento", "documento de identidad", "documento nacional")
TAX_LABELS = ("cuil", "cuit")
PASSPORT_LABELS = ("pasaporte", "passport")
ADDRESS_LABELS = ("domicilio", "direccion", "address")
STREETS = ("av", "avda", "avenida", "calle", "pasaje", "pje", "bv", "boulevard", "bulevar", "diagonal", "camino", "street")
BIRTH_LABELS = ("fecha de nacimiento", "f de nac", "f de nacimiento", "nacido el", "nacida el", "naci el", "date of birth", "born", "born on", "dob", "d o b")
AGE_LABELS = ("edad", "age")
NUMBER_WORDS = ("n", "no", "number", "num")
MARITAL_STEMS = ("solter", "casad", "divorciad", "viud")

#: Characters after a label that are read for its value, and tokens after it.
AHEAD, TOKENS = 120, 16
_LOCAL, _HOST = frozenset("abcdefghijklmnopqrstuvwxyz0123456789._%+-"), frozenset("abcdefghijklmnopqrstuvwxyz0123456789-.")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_RUN = re.compile(r"\d+")


class _Plain(dict):
    """Each character without its accents and in lower case, as one character."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        self[code] = unicodedata.normalize("NFD", char)[0].lower()[:1] or char
        return self[code]


_PLAIN = _Plain()


def _folded(text: str) -> str:
    """Without accents and in lower case, character by character, so that places stay."""
    return text.lower() if text.isascii() else text.translate(_PLAIN)


def _tokens(text: str, start: int) -> list[tuple[int, int, str]]:
    out = []
    for m in _TOKEN.finditer(text, start, min(len(text), start + AHEAD)):
        out.append((m.start(), m.end(), m[0]))
        if len(out) == TOKENS:
            break
    return out


def _words_at(low: str, words: tuple[str, ...]) -> Iterator[Span]:
    """Places of whole words."""
    for word in words:
        at = low.find(word)
        while at >= 0:
            end = at + len(word)
            if not (at and (low[at - 1].isalnum() or low[at - 1] == "_")) and not (end < len(low) and (low[end].isalnum() or low[end] == "_")):
                yield at, end
            at = low.find(word, at + 1)


def _labels(low: str, labels: tuple[str, ...]) -> Iterator[Span]:
    """Places of labels: their words one after the other, with blanks or full stops between; a longer label that goes on where a shorter one ends comes first."""
    ordered = sorted(labels, key=lambda x: -len(x))
    for first in sorted({x.split()[0] for x in labels}):
        for start, _ in _words_at(low, (first,)):
            tokens = _tokens(low, start)
            for label in ordered:
                end, k = start, 0
                for word in label.split():
                    while k < len(tokens) and tokens[k][2] == "." and end > start:
                        k += 1
                    if k == len(tokens) or tokens[k][2] != word:
                        break
                    end, k = tokens[k][1], k + 1
                else:
                    yield start, end
                    break


def _after(tokens: list[tuple[int, int, str]], skip: str, words: tuple[str, ...] = ()) -> int:
    """The first token after a label's full stop, a word such as "number" with its sign, and one of ``skip``."""
    k = 0
    while k < len(tokens) and tokens[k][2] == ".":
        k += 1
    if k < len(tokens) and tokens[k][2].lower() in words:
        k += 1
        while k < len(tokens) and tokens[k][2] in "°º.":
            k += 1
    if k < len(tokens) and tokens[k][2] in skip:
        k += 1
    return k


def _digits(text: str, start: int) -> Iterator[tuple[list[Span], list[str]]]:
    """Runs of digits, tied by one to three separators, from ``start`` on: (places, what stands between)."""
    places: list[Span] = []
    between: list[str] = []
    for m in _RUN.finditer(text, start):
        gap = text[places[-1][1] : m.start()] if places else ""
        if places and (len(gap) > 3 or gap.strip(" \t\n\r.()-\xa0")):
            yield places, between
            places, between = [], []
        elif places:
            between.append(gap)
        places.append(m.span())
    if places:
        yield places, between


def _free(text: str, start: int, end: int) -> bool:
    """No letter, digit or underscore on either side."""
    return not (start and (text[start - 1].isalnum() or text[start - 1] == "_")) and not (end < len(text) and (text[end].isalnum() or text[end] == "_"))


def _one(gap: str, allowed: str) -> bool:
    return len(gap) == 1 and gap in allowed


def _spelled_host(low: str, start: int) -> tuple[int, int]:
    """(end, labels) of a host from ``start``: labels parted by a full stop, "(dot)", "[dot]" or "punto", with blanks around."""
    end, parts = start, 0
    while True:
        stop = end
        while stop < len(low) and (low[stop] in _HOST and low[stop] != "."):
            stop += 1
        if stop == end:
            break
        end, parts, last = stop, parts + 1, stop
        while end < len(low) and low[end].isspace() and end - last < 3:
            end += 1
        sign = next((x for x in (".", "(dot)", "[dot]", "punto") if low.startswith(x, end) and (x != "punto" or end > last)), None)
        if sign is None:
            return last, parts
        end += len(sign)
        begun = end
        while end < len(low) and low[end].isspace() and end - begun < 3:
            end += 1
        if end == len(low) or low[end] not in _HOST or low[end] == "." or sign == "." and end > begun:
            return last, parts
    return end, parts


def mails(text: str, low: str) -> Iterator[Span]:
    at = low.find("@")
    while at >= 0:
        start = at
        while start and low[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        while end < len(low) and low[end] in _HOST:
            end += 1
        # the domain ends with the last of its labels that is letters, after a full stop
        labels, place, best = low[at + 1 : end].split("."), at + 1, 0
        for k, label in enumerate(labels):
            letters = len(label) - len(label.lstrip("abcdefghijklmnopqrstuvwxyz"))
            if k and not label or not k and not label:
                break
            if k and letters >= 2:
                best = place + letters
            place += len(label) + 1
        if start < at and best:
            yield start, best
        at = low.find("@", at + 1)
    # spelled out: name (at) host (dot) com, nombre arroba host punto com
    for sign in ("(at)", "[at]", "arroba"):
        at = low.find(sign)
        while at >= 0:
            left, right = at, at + len(sign)
            blanks = lambda k, step: next((n for n in range(4) if not (0 <= (p := k + step * n) < len(low) and low[p].isspace())), 4)
            before, after = blanks(left - 1, -1), blanks(right, 1)
            fits = before and after if sign == "arroba" else True
            start = left - before
            while start and low[start - 1] in _LOCAL:
                start -= 1
            end, parts = _spelled_host(low, right + after) if after < 4 else (right, 0)
            if fits and start < left - before and parts > 1:
                yield start, end
            at = low.find(sign, at + 1)


def links(text: str, low: str) -> Iterator[Span]:
    """Addresses with a scheme or www, domains with a path, and some sites by name; up to a blank, comma, semicolon or closing bracket, without the punctuation at the end."""
    if "." not in low and "://" not in low:
        return
    for m in re.finditer(r"[^\s,;)\]]+", low):
        chunk, found = m[0], []
        if "." not in chunk and "://" not in chunk:
            continue
        for sign in ("http://", "https://", "www."):
            if (k := chunk.find(sign)) >= 0 and not (k and (chunk[k - 1].isalnum() or chunk[k - 1] == "_")):
                found.append((k, k + len(sign)))
        for host in re.finditer(r"[a-z0-9-]+(?:\.[a-z0-9-]+)+", chunk):
            labels = host[0].split(".")
            path = chunk[host.end() : host.end() + 1] == "/"
            # a host whose beginning is no letter or digit begins after it
            start = host.start() + len(host[0]) - len(host[0].lstrip("-"))
            if start and (chunk[start - 1].isalnum() or chunk[start - 1] == "_"):
                continue
            if path and labels[-1] in LINK_DOMAINS:
                found.append((start, host.end() + 1))
            for k, label in enumerate(labels[:-1]):
                if label in LINK_SITES and labels[k + 1] == "com":
                    found.append((host.start() + len(".".join(labels[:k])) + bool(k), host.start() + len(".".join(labels[: k + 2]))))
        if found:
            start, least = min(found)
            yield m.start() + start, m.start() + max(least, len(chunk.rstrip(".:!?")))


def national_ids(text: str, low: str) -> Iterator[Span]:
    """Numbers behind a label: seven or eight digits as 1.234.567; tax numbers of 2, 7 or 8, and 1 digits, which need no label if they are written with hyphens; and two numbers with full stops and a check digit."""
    for start, end in _labels(low, ID_LABELS):
        tokens = _tokens(text, end)
        k = _after(tokens, ":#-", NUMBER_WORDS)
        if k < len(tokens) and tokens[k][2].isdigit():
            places, between = next(_digits(text, tokens[k][0]))
            sizes = [b - a for a, b in places]
            if sizes[0] in (7, 8):
                stop = places[0][1]
            elif sizes[:3] in ([1, 3, 3], [2, 3, 3]) and all(_one(g, ". ") for g in between[:2]):
                stop = places[2][1]
            elif (sizes[:2] in ([1, 6], [2, 6], [4, 3], [5, 3])) and _one(between[0], ". "):
                stop = places[1][1]
            else:
                continue
            if stop == len(text) or not (text[stop].isalnum() or text[stop] == "_"):
                yield start, stop
    for start, end in _labels(low, TAX_LABELS):
        tokens = _tokens(text, end)
        k = _after(tokens, ":#-/")
        while k < len(tokens) and (tokens[k][2].lower() in TAX_LABELS or tokens[k][2] in ":#-"):
            k += 1
        if k < len(tokens) and tokens[k][2].isdigit():
            places, between = next(_digits(text, tokens[k][0]))
            sizes = [b - a for a, b in places]
            for n, shapes in ((3, ([2, 7, 1], [2, 8, 1])), (2, ([2, 8], [2, 9], [9, 1], [10, 1])), (1, ([10], [11]))):
                if sizes[:n] in shapes and all(_one(g, "- ") for g in between[: n - 1]) and _free(text, places[0][0], places[n - 1][1]):
                    yield start, places[n - 1][1]
                    break
    for places, between in _digits(text, 0):
        sizes = [b - a for a, b in places]
        for k in range(len(places)):
            rest, gaps = sizes[k:], between[k:]
            if rest[:3] in ([2, 7, 1], [2, 8, 1]) and gaps[:2] == ["-", "-"]:
                n = 3
            elif rest[:4] == [3, 3, 3, 2] and gaps[:3] == [".", ".", "-"]:
                n = 4
            elif rest[:3] in ([1, 3, 3], [2, 3, 3]) and gaps[:2] == [".", "."]:
                end = places[k + 2][1]
                check = low[end + 1 : end + 2]
                if low[end : end + 1] == "-" and (check.isdigit() or check == "k") and _free(text, places[k][0], end + 2):
                    yield places[k][0], end + 2
                continue
            else:
                continue
            if _free(text, places[k][0], places[k + n - 1][1]):
                yield places[k][0], places[k + n - 1][1]


def passports(text: str, low: str) -> Iterator[Span]:
    for start, end in _labels(low, PASSPORT_LABELS):
        tokens = _tokens(text, end)
        k = _after(tokens, ":#-", NUMBER_WORDS)
        if k < len(tokens):
            stop = tokens[k][0]
            while stop < len(text) and low[stop].isascii() and low[stop].isalnum():
                stop += 1
            value = low[tokens[k][0] : stop]
            if 6 <= len(value) <= 10 and any(c.isdigit() for c in value) and (stop == len(text) or not (text[stop].isalnum() or text[stop] == "_")):
                yield start, stop


def addresses(text: str, low: str) -> Iterator[Span]:
    """The rest of a line behind a label and a colon; a street's kind, its name and the number of a house."""
    for start, end in _labels(low, ADDRESS_LABELS):
        colon = next((t for t in _tokens(text, end)[:1] if t[2] == ":"), None)
        line_end = text.find("\n", end)
        line_end = len(text) if line_end < 0 else line_end
        if colon and colon[1] <= line_end and text[colon[1] : line_end].strip():
            yield start, line_end
    for start, end in _words_at(low, STREETS):
        name = end + (text[end : end + 1] == ".")
        for n, (a, b, token) in enumerate(_tokens(text, name)):
            if a - name > 44 or not (token.isalnum() or token in ".'-°º"):
                break
            number = token.isdigit() and b - a <= 5 and n and text[a - 1] in " \t\n°ºno." and not (b < len(text) and (text[b].isalnum() or text[b] == "_"))
            if number and a - name >= 4:
                yield start, b
                break


def _date_end(tokens: list[tuple[int, int, str]]) -> int | None:
    """The end of a date that the tokens begin with."""
    kinds = [("n", len(t)) if t.isdigit() else ("w", 0) if t.isalpha() else (t, 0) for _, _, t in tokens]
    number = lambda k, *sizes: k < len(kinds) and kinds[k][0] == "n" and kinds[k][1] in sizes
    sign = lambda k, allowed: k < len(kinds) and kinds[k][0] in allowed
    if number(0, 4) and sign(1, "-") and number(2, 2) and sign(3, "-") and number(4, 2):
        return tokens[4][1]
    if number(0, 1, 2) and sign(1, "/.-") and number(2, 1, 2) and sign(3, "/.-") and number(4, 2, 3, 4):
        return tokens[4][1]
    words = [k for k in range(len(tokens)) if not (kinds[k][0] == "w" and tokens[k][2].lower() == "de")]
    plain = [tokens[k] for k in words]
    size = lambda k, *sizes: k < len(plain) and plain[k][2].isdigit() and len(plain[k][2]) in sizes
    if size(0, 1, 2) and len(plain) > 1 and plain[1][2].isalpha() and size(2, 4):
        return plain[2][1]
    if plain and plain[0][2].isalpha() and size(1, 1, 2):
        k = 2 + (len(plain) > 2 and plain[2][2] == ",")
        if size(k, 4):
            return plain[k][1]
    if number(0, 4) and tokens[0][2][:2] in ("19", "20"):
        return tokens[0][1]
    return None


def birth_dates(text: str, low: str) -> Iterator[Span]:
    for start, end in _labels(low, BIRTH_LABELS):
        tokens = _tokens(text, end)
        stop = _date_end(tokens[_after(tokens, ":-") :])
        if stop:
            yield start, stop


def ages(text: str, low: str) -> Iterator[Span]:
    years = ("anos", "años")
    for start, end in _labels(low, AGE_LABELS):
        tokens = _tokens(low, end)
        k = _after(tokens, ":-")
        if k < len(tokens) and tokens[k][2].isdigit() and len(tokens[k][2]) <= 2 and _free(low, tokens[k][0], tokens[k][1]):
            yield start, tokens[k + 1][1] if k + 1 < len(tokens) and tokens[k + 1][2] in years else tokens[k][1]
    for word, tail in (("anos", ["de", "edad"]), ("years", ["old"]), ("year", ["old"])):
        for at, end in _words_at(low, (word,)):
            after = [t for t in _tokens(low, end)[: len(tail)]]
            head = low[max(0, at - 6) : at].rstrip()
            digits = len(head) - len(head.rstrip("0123456789"))
            first = max(0, at - 6) + len(head) - digits
            if [t[2] for t in after] == tail and 1 <= digits <= 2 and not (first and (low[first - 1].isalnum() or low[first - 1] == "_")):
                yield first, after[-1][1]


def _gender_end(low: str, end: int) -> int:
    """Behind "/a" or "(a)", if it stands there."""
    return end + next((len(x) for x in ("/a", "(a)") if low.startswith(x, end)), 0)


def marital_states(text: str, low: str) -> Iterator[Span]:
    for start, end in _labels(low, ("estado civil",)):
        tokens = _tokens(text, end)
        k = _after(tokens, ":-")
        if k < len(tokens) and tokens[k][2].isalpha():
            yield start, _gender_end(low, tokens[k][1])
    for start, end in _words_at(low, tuple(stem + g for stem in MARITAL_STEMS for g in "oa")):
        yield start, _gender_end(low, end)


def _years(text: str, places: list[Span]) -> bool:
    return all(b - a == 4 and text[a : a + 2] in ("19", "20") for a, b in places)


def _phone_runs(text: str, places: list[Span], between: list[str], k: int) -> int:
    """How many runs from the ``k``-th on are a local phone number: eleven or ten digits in one, 4-4, area and 3-4 or 4-4 digits, or a long-distance 0 and mobile 15. 0: none."""
    sizes, gaps = [b - a for a, b in places[k:]], between[k:]
    tied = lambda n: len(sizes) >= n and all(len(g.replace("(", "").replace(")", "")) <= 1 and (len(g) == 1 or "(" in g or ")" in g) for g in gaps[: n - 1])
    zero = text[places[k][0]] == "0"
    if zero and 3 <= sizes[0] <= 5:
        if tied(4) and text[places[k + 1][0] : places[k + 1][1]] == "15" and sizes[2] in (3, 4) and sizes[3] in (3, 4):
            return 4
        if tied(3) and sizes[1] in (3, 4, 5, 6) and sizes[2] in (3, 4):
            return 3
        if tied(2) and sizes[1] in (6, 7, 8):
            return 2
    if tied(3) and 2 <= sizes[0] <= 5 and sizes[1] in (3, 4) and sizes[2] == 4:
        return 3
    if tied(2) and sizes[0] == 4 and sizes[1] == 4:
        return 2
    return int(sizes[0] in (10, 11) or zero and 9 <= sizes[0] <= 13)


def phones(text: str, low: str) -> Iterator[Span]:
    for places, between in _digits(text, 0):
        k = 0
        while k < len(places):
            start = places[k][0]
            plus = start and text[start - 1] == "+" and not (start > 1 and text[start - 2].isalnum())
            digits = lambda n: sum(b - a for a, b in places[k : k + n])  # noqa: B023, E731
            if plus or text.startswith("549", start) and not (start and (text[start - 1].isalnum() or text[start - 1] == "_")):
                n = len(places) - k
                while n > 1 and (digits(n) > 16 or places[k + n - 1][1] - start > 21):
                    n -= 1
                if digits(n) >= (9 if plus else 11) and (plus or places[k + n - 1][1] - start <= 18):
                    yield start - bool(plus), places[k + n - 1][1]
                    k += n
                    continue
            n = _phone_runs(text, places, between, k)
            end = places[k + n - 1][1] if n else start
            before = text[start - 1] if start else " "
            if n and not _years(text, places[k : k + n]) and digits(n) >= 8 and not (before.isalnum() or before in "_.") and not (end < len(text) and (text[end].isalnum() or text[end] == "_")):
                opened = before == "(" and ")" in text[start:end]
                yield start - opened, end
                k += n
            else:
                # of a row of years none begins a number
                k += 1
                while k < len(places) and _years(text, places[k - 1 : k + 1]):
                    k += 1


def names(name: str | None) -> Callable[[str, str], Iterator[Span]]:
    """A finder of a person's whole name and of its parts of three letters or more, whatever their accents and case."""
    parts = _folded(unicodedata.normalize("NFC", name or "")).split()

    def find(text: str, low: str) -> Iterator[Span]:
        whole = r"\s+".join(map(re.escape, parts)) if len(parts) > 1 else None
        for pattern in [*([whole] if whole else []), *[re.escape(p) for p in parts if len(p) > 2]]:
            for m in re.finditer(rf"(?<![^\W_]){pattern}(?![^\W_])", low):
                yield m.span()

    return find


FINDERS: dict[str, Callable[[str, str], Iterator[Span]]] = {
    "email": mails, "url": links, "national_id": national_ids, "passport": passports, "address": addresses, "birth_date": birth_dates, "age": ages, "marital_status": marital_states, "phone": phones,
}


def _apart(spans: Iterator[Span]) -> list[Span]:
    """In order; of overlapping ones the first, and the longest from one place."""
    out: list[Span] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def redact(text: str, name: str | None = None) -> tuple[str, dict[str, int], list[str]]:
    """(text with markers, how often each kind was found, kinds that are found in the result). Compatibility forms are made plain first."""
    text = text if text.isascii() else unicodedata.normalize("NFKC", text)
    finders = FINDERS | ({"display_name": names(name)} if name and name.strip() else {})
    counts: dict[str, int] = {}
    low = _folded(text)
    for kind, find in finders.items():
        spans = _apart(find(text, low))
        if spans:
            ends = [0, *[b for _, b in spans]]
            text = MARKERS[kind].join(text[a:b] for a, b in zip(ends, [*[a for a, _ in spans], len(text)], strict=True))
            counts[kind], low = len(spans), _folded(text)
    # where nothing was marked, the result is the text that was searched
    return text, counts, [k for k, find in finders.items() if next(iter(find(text, low)), None)] if counts else []


def redacted(text: Column, name: Column | None = None) -> Column:
    """struct<text, counts map, residual array>: a text with any residual must not be used. A null text has nulls; without a name none is looked for.

    An Arrow-batched function: labels before values and shapes of numbers have no built-in form."""
    ship(SparkSession.getActiveSession())

    @F.pandas_udf("text string, counts map<string,int>, residual array<string>")
    def run(texts: pd.Series, of: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if t is None else redact(t, n) for t, n in zip(texts, of, strict=True)]
        return pd.DataFrame(rows, columns=["text", "counts", "residual"])

    return run(text, F.lit(None).cast("string") if name is None else name)


def without_links(text: Column, most: int | None = None) -> Column:
    """Without web and mail addresses, blanks squashed, cut to ``most`` characters: text that goes into a prompt."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def clean(t: str | None) -> str | None:
            for find in (mails, links) if t is not None else ():
                for a, b in reversed(_apart(find(t, _folded(t)))):
                    t = t[:a] + " " + t[b:]
            return t

        return texts.map(clean, na_action="ignore")

    ship(SparkSession.getActiveSession())
    text = F.trim(F.regexp_replace(run(text), r"\s+", " "))
    return text if most is None else F.substring(text, 1, most)


def clipped(column: Column, most: int) -> Column:
    return F.substring(column, 1, most)


def clipped_list(column: Column, items: int, most: int) -> Column:
    """The first ``items`` of an array, each cut to ``most`` characters; a null stays null."""
    return F.transform(F.slice(column, 1, items), lambda x: F.substring(x, 1, most))
