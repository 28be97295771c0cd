"""Texts that address their evaluator: phrases as steps over words, tried only where a letter skeleton of the text holds what they need.

A text is folded, freed of invisible characters and letters that only look Latin, and read in several forms: as it is, with words put together that were spelled letter by letter, and with digits and
symbols read as letters. All forms share one skeleton - letters alone, in order - so one automaton over it tells which phrases can occur in any of them; most texts end there.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sievelake.session import ship

# fixed values: words of the phrases, folded; * stands for any ending
_PAST, _ORDERS = "previous|prior|above|earlier|preceding|former", "instructions|rules|directions|guidelines"
_ALL_THE, _ARTICLES = "all|any|the|your|these|those|my|of", "todas|toda|todos|todo|el|la|las|los|lo|as|os|tu|tus|su|sus|vuestra|vuestras|mis|estas|esas|nuestras"
_GRADE, _RIGHT = "score|puntaje|nota|puntuacion|calificacion|rating|grade", "correct|correcto|correcta|final|right|expected|esperado|esperada"
_MOST = "10|9|diez|nueve|ten|nine|maximo|maxima|maximum|highest|perfect|perfecto|perfecta|alto|alta|high"
_ORDER = "pone|poner|ponele|asigna|asignale|asignar|dale|califica|calificalo|calificar|puntua|otorga|otorgale|give|assign|rate|grade|set"
_THIS, _WHO = "this|that|the|these|este|esta|ese|esa|el|la|al|tu|su|dicho|dicha", "candidate|applicant|candidato|candidata|perfil|postulante|aplicante|aviso|oferta|posting|job|role|persona|cv|resume|curriculum|puesto|vacante|posicion"
_FOREIGN = "ignorez|ignorer|oubliez|negligez|ignoriere*|ignorieren|vergiss|missachte*|desconsider*|desprez*|esquec*"
_FOREIGN_THE = "todas|toda|todos|todo|tous|toutes|alle|alles|as|os|les|des|die|der|den|diese|ihre|deine|vos|vuestra|vuestras|tes|ses|suas|sua|seus|seu|tus|tu|sus|su"
_FOREIGN_ORDERS = "instruction*|instruc*|anweisung*|regle|regles|regel|regeln|regra|regras|consigne|consignes|vorgabe|vorgaben|indicac*"

#: (name, letters one of which the skeleton must hold, phrases). Of a phrase, each step is a word out of some; "?" may be missing, "~n" is up to n words of any kind, "&n" up to n words out of some.
SIGNALS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("ignorar_instrucciones", "ignor", ("ignora|ignore ?todas ?las instrucciones|reglas anteriores|previas|del",)),
    ("ignore_previous", "ignor", (f"ignore &3:{_ALL_THE} {_PAST} {_ORDERS}|prompt|prompts", f"ignore &3:{_ALL_THE} {_ORDERS} above|before|given")),
    ("system_prompt", "systemprompt", ("reveal*|show|print|repeat|output|leak|dump|display|your|new|mostra*|muestra*|revela*|imprim*|repet*|tu|tus ?the|your|el|tu system prompt", "system prompt :|=")),
    ("ignorar_otros_idiomas", "ignor|oubli|neglig|vergiss|missacht|desconsider|desprez|esquec", (f"{_FOREIGN} &3:{_FOREIGN_THE} {_FOREIGN_ORDERS}",)),
    ("valor_accion", "aplicarpersonalizado", ("aplicar_personalizado", "como|as|to|en|a aplicar personalizado", ":|= aplicar personalizado")),
    ("nota_requerida", "score|puntaje|nota|puntuacion|calificacion|rating|grade", tuple(f"the|el|la|este|esta ?{_RIGHT} {_GRADE} ?{_RIGHT} &4:for|para|of|de|this|the|este|esta|{_WHO} {verb} {_MOST}" for verb in ("must|should be", "needs|has to be", "debe|deberia ser", "tiene|tendria que ser"))),
    ("nota_correcta", "score|puntaje|nota|puntuacion|calificacion|rating|grade", (f"the|el|la {_RIGHT} {_GRADE} &4:for|para|of|de|this|the|este|esta|{_WHO} es|is {_MOST}", f"the|el|la {_GRADE} {_RIGHT} &4:for|para|of|de|this|the|este|esta|{_WHO} es|is {_MOST}", f"the|el|la {_GRADE} for|para|of|de {_THIS} {_WHO} es|is {_MOST}")),
    ("you_are_now", "youarenow", ("you are now a|an",)),
    ("act_as_ai", "actas", ("act as a|an ai|assistant", "act as a|an language model")),
    ("disregard_previous", "disregard|forget|override|skip", (f"disregard|forget|override|skip &3:{_ALL_THE} {_PAST} {_ORDERS}|prompt|prompts", f"disregard|forget|override|skip &3:{_ALL_THE} {_ORDERS} above|before|given")),
    ("olvidar_anterior", "olvid", ("olvida|olvide ?todo lo anterior",)),
    ("ignorar_todo_anterior", "ignor", ("ignora|ignore todo lo anterior",)),
    ("nuevas_instrucciones", "nuevasinstrucciones", ("nuevas instrucciones",)),
    ("new_instructions", "newinstructions", ("new instructions",)),
    ("poner_score_alto", "score|puntaje|puntuacion", ("pone|asigna|dale|give|assign|set ?un|a score|puntaje|puntuacion ?de|of 9|10",)),
    ("score_alto", "score", ("score ?: 9|10 / 10",)),
    ("campo_accion_sugerida", "accionsugerida", ("accion_sugerida",)),
    ("campo_bloqueadores_duros", "bloqueadoresduros", ("bloqueadores_duros",)),
    ("campo_match_fuerte", "matchfuerte", ("match_fuerte",)),
    ("veredicto_campo", "veredicto", ("veredicto :",)),
    ("responder_solo_con", "respond", ("respond|responde only|solo|unicamente with|con",)),
    ("do_not_evaluate", "donotevaluate", ("do not evaluate",)),
    ("no_evalues", "noevalue", ("no evalue|evalues",)),
    ("marca_apertura", "aviso", ("< < < ?fin aviso",)),
    ("marca_cierre", "aviso", ("aviso > > >",)),
    ("token_inst", "inst", ("[ inst ]",)),
    ("token_im_start", "imstart", ("< | im_start | >",)),
    ("bloque_json", "json", ("` ` ` json",)),
    ("encabezado_rol", "system|instruction|assistant", ("# # # system|instruction|assistant",)),
    ("ignorar_indicaciones", "ignor|descart|desestim|omit|saltea|desat", (f"ignora|ignore|ignorar|ignorad|ignoren|descarta|descarte|descartar|descartad|desestima|desestime|desestimar|desestimad|omite|omitir|saltea|salteate|desatende|desatender|desatended &2:{_ARTICLES} instruc*|regla|reglas|indicac*|consigna|consignas|pauta|pautas|directiva*|anterior|anteriores|previo|previos|previa|previas",)),
    ("pasar_por_alto", "poralto", ("pasa|pasar por alto ?todo ?lo indicado|anterior|escrito|dicho",)),
    ("mandato_nota", "score|puntaje|nota|puntuacion|calificacion|rating|grade", (f"{_ORDER} ~4 {_GRADE} ?de|of|a|to|as|como {_MOST}",)),
    ("mandato_nota_maxima", "score|puntaje|nota|puntuacion|calificacion|rating|grade", (f"{_ORDER} ~3 maximo|maxima|maximum|highest|top|perfect|perfecto|perfecta|alto|alta|high|diez|ten {_GRADE}",)),
    ("calificar_diez_de_diez", "rate|grade|califica|puntua", ("rate|grade|califica|calificalo|puntua ~6 10|diez|ten /|de 10|diez|ten", "rate|grade|califica|calificalo|puntua ~6 10|diez|ten out of 10|diez|ten")),
    ("candidato_ideal_preaprobado", "idealya", ("candidato|candidata ideal ya ?fue|esta seleccionad*|preseleccionad*|aprobad*|preaprobad*|elegid*",)),
    ("candidato_perfecto", "candidateis|applicantis|candidatoes|postulantees", ("this candidate|applicant is ?a|an|the perfect|ideal|best|top", "este candidato|postulante es ?el|un ideal|perfecto|mejor")),
)
HIDDEN = "texto_oculto"
#: Signals that count only if their sentence speaks of a candidate or a posting, and words on either side that are its sentence.
_TARGETED, AROUND = frozenset(("mandato_nota", "mandato_nota_maxima")), 18
# fixed values: letters of other alphabets that look like Latin ones, and digits and symbols that stand for letters
LOOKALIKES = dict(zip("аеорсхуіјѕкмнтԁһӏԛѡαονιτρεκυχγηβωı", "aeopcxyijskmhtdhlqwaovitpekuxynbwi", strict=True))
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_AS_LATIN = str.maketrans(LOOKALIKES)
_AS_LETTERS = str.maketrans(LEET)
_APART = str.maketrans(dict.fromkeys("-_.*·|/\\", " "))
_TOKEN = re.compile(r"[a-z0-9_]+|[^\sa-z0-9_]")
_TAGS = re.compile("[\U000e0000-\U000e007f]")
_ENDS = frozenset(".!?")


def _is_invisible(char: str) -> bool:
    return unicodedata.category(char) == "Cf" or "︀" <= char <= "️" or "\U000e0100" <= char <= "\U000e01ef"


class _Step:
    """One step of a phrase: words, beginnings of words, how many there may be, and whether of any kind."""

    def __init__(self, raw: str):
        self.least, self.most, self.any = 1, 1, False
        if raw[0] == "~":
            self.least, self.most, self.any, raw = 0, int(raw[1:]), True, ""
        elif raw[0] == "&":
            n, raw = raw[1:].split(":", 1)
            self.least, self.most = 0, int(n)
        elif raw[0] == "?" and len(raw) > 1:
            self.least, raw = 0, raw[1:]
        own = [raw] if raw == "|" else raw.split("|")
        self.words, self.heads = frozenset(x for x in own if not x.endswith("*")), tuple(x[:-1] for x in own if x.endswith("*"))

    def fits(self, token: str) -> bool:
        return self.any and token[0].isalnum() or token in self.words or bool(self.heads) and token.startswith(self.heads)


def _match(tokens: list[str], at: int, steps: tuple[_Step, ...], k: int = 0, used: int = 0) -> int:
    """The end of a phrase's first match from token ``at`` on, or -1. Punctuation between words is passed over, but for the end of a sentence."""
    if k == len(steps):
        return at
    step = steps[k]
    if used >= step.least and (end := _match(tokens, at, steps, k + 1)) >= 0:
        return end
    while at < len(tokens) and not step.fits(tokens[at]) and (k or used) and not tokens[at][0].isalnum() and tokens[at][0] != "_" and tokens[at] not in _ENDS:
        at += 1
    if at < len(tokens) and used < step.most and step.fits(tokens[at]):
        return _match(tokens, at + 1, steps, k + 1 if used + 1 == step.most else k, 0 if used + 1 == step.most else used + 1)
    return -1


class Detector:
    """The phrases, by their first words, and the automaton of what they need."""

    def __init__(self):
        import ahocorasick

        self.order = [name for name, _, _ in SIGNALS]
        self.phrases = {name: [tuple(_Step(x) for x in p.split(" ")) for p in phrases] for name, _, phrases in SIGNALS}
        needs: dict[str, set[str]] = {}
        for name, cores, _ in SIGNALS:
            for core in cores.split("|"):
                needs.setdefault(core, set()).add(name)
        self.automaton = ahocorasick.Automaton()
        for core, names in needs.items():
            self.automaton.add_word(core, frozenset(names))
        self.automaton.make_automaton()
        self.target = [tuple(_Step(x) for x in p.split(" ")) for p in (f"{_THIS} {_WHO}", f"{_THIS} ~1 {_WHO}")]

    def possible(self, folded: str) -> set[str]:
        skeleton = "".join(c for c in folded.translate(_AS_LETTERS) if "a" <= c <= "z")
        return set().union(*(names for _, names in self.automaton.iter(skeleton)))

    def _is_targeted(self, tokens: list[str], start: int, end: int) -> bool:
        lo, hi = max(0, start - AROUND), min(len(tokens), end + AROUND)
        own = tokens[lo:hi]
        return any(_match(own, k, p) >= 0 for k in range(len(own)) for p in self.target if p[0].fits(own[k]))

    def found(self, text: str, names: set[str]) -> set[str]:
        tokens, out = _TOKEN.findall(text), set()
        places: dict[str, list[int]] = {}
        for k, token in enumerate(tokens):
            places.setdefault(token, []).append(k)
        for name in names:
            for steps in self.phrases[name]:
                first = steps[0]
                starts = [w for w in first.words if w in places] + ([w for w in places if w.startswith(first.heads)] if first.heads else [])
                ends = ((k, _match(tokens, k, steps)) for w in starts for k in places[w])
                if name not in out and any(end >= 0 and (name not in _TARGETED or self._is_targeted(tokens, k, end)) for k, end in ends):
                    out.add(name)
        return out

    def signals(self, text: str) -> list[str]:
        """Names in order, of a whole text."""
        plain = text if text.isascii() else "".join(c for c in text if not _is_invisible(c))
        bases = [plain] if len(plain) == len(text) else [plain, "".join(" " if _is_invisible(c) else c for c in text)]
        out: set[str] = set()
        for base in bases:
            folded = _fold(base)
            names = self.possible(folded)
            if names:
                spread = folded.translate(_APART)
                forms = {folded, _put_together(spread, True), _put_together(spread, False)}
                forms |= {_unleet(x) for x in forms}
                for form in forms:
                    out |= self.found(form, names - out)
        return [n for n in self.order if n in out] + ([HIDDEN] if _TAGS.search(text) else [])


def _fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower().translate(_AS_LATIN)


def _put_together(spread: str, wide_gaps_part: bool) -> str:
    """Three or more single letters in a row as one word; two blanks or more part words, or don't."""
    out = []
    for piece in re.split(r"\s{2,}", spread) if wide_gaps_part else [spread]:
        run: list[str] = []
        for word in [*piece.split(), ""]:
            if len(word) == 1 and "a" <= word <= "z":
                run.append(word)
                continue
            out += ["".join(run)] if len(run) >= 3 else run
            run = []
            out += [word] if word else []
    return " ".join(out)


def _unleet(text: str) -> str:
    """Digits and symbols as letters, in words that have letters."""
    return " ".join(w.translate(_AS_LETTERS) if any("a" <= c <= "z" for c in w) else w for w in text.split())


@lru_cache(maxsize=1)
def detector() -> Detector:
    return Detector()


def signals_udf(spark: SparkSession):
    """The signals as an Arrow-batched function: steps over words have no built-in form."""
    ship(spark)

    @F.pandas_udf("array<string>")
    def injection_signals(texts: pd.Series) -> pd.Series:
        own = detector()
        return pd.Series([own.signals(t) if t else [] for t in texts], dtype=object)

    return injection_signals


def injection_signals(text: Column) -> Column:
    """Names of the signals in a whole text, in order, ``texto_oculto`` last; none for null or empty texts."""
    return signals_udf(SparkSession.getActiveSession())(text)
