"""Rules on built rows: each row is made to exercise one rule."""

from pyspark.sql import functions as F

from sievelake.functions import text, urls
from sievelake.operators import decisions, prefilter
from sievelake.operators.dedup import user_duplicates
from sievelake.sources import boards
from sievelake.streaming import jobs

_COMPANIES = [(1, "Globant S.A."), (2, "Foo → Acme Inc"), (3, "Acme, Inc."), (4, "ACME  Corp. vía LinkedIn"), (5, "Inc"), (6, "Pérez & Hijos SRL"), (7, "S.A."), (8, "Bar -> Baz => Qux GmbH"), (9, "Mercado (Argentina) [AR] Ltda"), (10, ""), (11, None), (12, "Peña y Co LLC")]
_COMPANY_NAMES = [(1, "globant"), (2, "acme"), (3, "acme"), (4, "acme"), (5, "inc"), (6, "perez hijos"), (7, "sa"), (8, "qux"), (9, "mercado ltda"), (10, ""), (11, None), (12, "pena y")]


_LINKS = [(1, "https://www.Example.com/a/?utm_source=x&b=2&a=1#f"), (2, "http://linkedin.com/jobs/view/senior-dev-123?trk=z"), (3, "https://ar.indeed.com/viewjob?jk=ab&from=x"), (4, "ftp://x.org/a"), (5, "https://www.linkedin.com/jobs/search?currentJobId=77"), (6, None), (7, "https://x.org"), (8, "https://x.org/?ref=a&gclid=b")]
_CANONICAL = [(1, "https://example.com/a?a=1&b=2"), (2, "https://linkedin.com/jobs/view/123"), (3, "https://ar.indeed.com/viewjob?jk=ab"), (4, None), (5, "https://linkedin.com/jobs/view/77"), (6, None), (7, "https://x.org"), (8, "https://x.org")]


_RULES = prefilter.Rules(
    accepted=("remoto",), languages=("es", "en"), adjacent=("ml engineer", "ai evaluator"), pools=(("base de talentos", r"\b(?:base|banco) de talentos\b"), ("talent pool", r"\btalent pool\b")),
    phrases=(("multinivel", r"\bmultinivel\b", True), ("network marketing", r"\bnetwork marketing\b", True), ("oportunidad de negocio", r"\boportunidad de negocio\b", False), ("ingresos extra", r"\bingresos? extras?\b", False)),
    other_trades=(("vendedor", r"(?<![a-z0-9])vendedor(?:es|as?)?(?![a-z0-9])", ("ventas_b2b",)), ("chofer", r"\bchofer\b", ())), domains=("growth", "seo", "sales"), own_domains={"ventas_b2b": ("sales",)},
    own_phrases={"project_manager": ("project manager",)}, allowlist=("individual contributor",), blocklist=("manager", "director", "vp "), roles=("project_manager",), country="AR", city="Buenos Aires",
    countries={"AR": ["argentina"], "MX": ["mexico"], "BR": ["brasil", "brazil"]}, outside={"ES": ["spain"], "CA": ["canada"]}, license_terms={"US": ("series 7", "bar admission"), "AR": ("matricula nacional",)},
)
_CASES = [  # title, location, modality, badges, candidates, countries, text, language
    ("Backend Engineer", "Remoto, Argentina", "remoto", [], 3, None, "We build.", "en"),
    ("Backend Engineer", "Madrid", "presencial", None, None, None, None, None),
    ("Backend Engineer (Hybrid)", None, "remoto", [], None, None, None, None),
    ("Hybrid Cloud Engineer", None, "remoto", [], None, None, None, None),
    ("Backend Engineer - Presencial o remoto opcional", None, "remoto", [], None, None, None, None),
    ("Backend", "On-site in Lima", "desconocida", [], None, None, None, None),
    ("Desenvolvedor", None, "remoto", [], None, None, None, "pt"),
    ("Senior ML Engineer", None, "remoto", [], None, None, None, "en"),
    ("Banco de Talentos IT", None, "remoto", [], None, None, None, "es"),
    ("Emprendé en MULTINIVEL", None, "remoto", [], None, None, None, None),
    ("Asesor", None, "remoto", [], None, None, "Red de network marketing: ingresos extra desde casa", "es"),
    ("Asesor", None, "remoto", [], None, None, "Oportunidad de negocio con ingresos extras", "es"),
    ("Software Engineer", None, "remoto", [], None, None, "Red de network marketing: ingresos extra desde casa", "es"),
    ("Vendedora de salón", None, "remoto", [], None, None, None, "es"),
    ("Vendedor de software", None, "remoto", [], None, None, None, "es"),
    ("Analyst", None, "remoto", [], None, None, "Series 7 required", "en"),
    ("Analyst", None, "remoto", [], None, None, "Series 7 or Matrícula Nacional", "en"),
    ("Growth Hacker", None, "remoto", [], None, None, None, "en"),
    ("AI Engineer, Growth", None, "remoto", [], None, None, None, "en"),
    ("Backend", None, "remoto", ["x", "1 de 4 aptitudes"], None, None, None, None),
    ("Backend", None, "remoto", ["3 of 4 skills"], 250, None, None, None),
    ("Engineering Manager", None, "remoto", [], 50, None, None, None),
    ("AI Engineering Manager", None, "remoto", [], 5, None, None, None),
    ("Project Manager", None, "remoto", [], None, None, None, None),
    ("Manager (individual contributor)", None, "remoto", [], None, None, None, None),
    ("Backend", "LATAM", "remoto", [], None, None, None, None),
    ("Backend", "US-based", "remoto", [], None, None, None, None),
    ("Backend", "Worldwide", "remoto", [], None, None, None, None),
    ("Backend", None, "remoto", [], None, ["MX", "BR"], None, None),
    ("Backend", None, "remoto", [], None, ["*"], None, None),
    ("Backend", "Spain", "remoto", [], None, None, None, None),
    ("Backend", "Anywhere", "remoto", [], None, None, "You must be based in Canada or Brazil. Thanks", None),
    ("Backend", "Anywhere", "remoto", [], None, None, "You must be based in Argentina or Brazil.", None),
    (None, None, None, None, None, None, None, None),
]
_EXPECTED = [  # reason, detail, cap, flags
    (None, None, None, []), ("modalidad_no_remota", "modalidad presencial", None, []), ("modalidad_no_remota", "título: Backend Engineer (Hybrid)", None, []), (None, None, None, []),
    ("modalidad_no_remota", "título: Backend Engineer - Presencial o remoto opcional", None, []), ("modalidad_no_remota", "ubicación: On-site in Lima", None, []), ("idioma_no_aceptado", "aviso en pt", None, []),
    ("disciplina_distinta", "keyword 'ml engineer'", None, []), ("disciplina_distinta", "base 'base de talentos'", None, []), ("disciplina_distinta", "venta multinivel 'multinivel'", None, []),
    ("disciplina_distinta", "venta multinivel 'network marketing'", None, []), (None, None, None, []), (None, None, None, []), ("disciplina_distinta", "oficio 'vendedor'", None, []), (None, None, None, []),
    ("licencia_profesional", "'series 7'", None, []), (None, None, None, []), ("disciplina_distinta", "keyword 'growth'", None, []), (None, None, None, ["domain_keyword:growth"]), ("badge_aptitudes", "aptitudes 25 %", None, []),
    (None, None, None, ["skills_match_high", "many_candidates"]), ("titulo_blocklist", "'manager'", None, []), (None, None, 6.0, ["title_cap"]), (None, None, None, []), (None, None, None, []), (None, None, None, ["location_risk"]),
    (None, None, None, ["location_risk"]), (None, None, None, []), (None, None, None, ["location_risk"]), (None, None, None, []), (None, None, None, ["location_risk"]), (None, None, None, ["location_risk", "residencia_exigida:BR,CA"]),
    (None, None, None, []), (None, None, None, []),
]
_CASE_SCHEMA = "id long, title string, location string, modality string, badges array<string>, candidates int, countries_allowed array<string>, text string, language string"


_C = decisions.Criteria(disciplines=("ai_engineer", "backend"), accepted=("remoto", "hibrido"), salary_floor=2000, max_hours=44, cloud_penalty=0.5, english_penalty=1.0, years=2, cefr="B1", gap_blocks_from=5)
_BASE = dict(score=9.5, blockers=[], risks=[], years_required=None, years_discipline=None, discipline="backend", modality="remoto", salary_min=None, salary_max=None, local_currency=None, weekly_hours=None, levels=None, english_required="no_menciona", english_moot=None, cloud_must=None, location_ok="ok", title_cap=None, flags=[], only_places=None)
_DECISIONS = [  # changes; score, blockers, risks, location, action
    ({}, (9.5, [], [], "ok", "aplicar_personalizado")),
    ({"score": 7.2}, (7.2, [], [], "ok", "aplicar")),
    ({"score": 5.5}, (5.5, [], [], "ok", "guardar")),
    ({"score": 4.9}, (4.9, [], [], "ok", "descartar")),
    ({"title_cap": 6.0}, (6.0, [], [], "ok", "guardar")),
    ({"years_required": 8}, (9.5, ["años requeridos ≥ 8 (8)"], [], "ok", "descartar")),
    ({"years_required": 5}, (9.0, [], ["pide 5 años, tenés 2"], "ok", "aplicar")),
    ({"years_required": 7}, (9.0, ["gap de años: pide 7 años, tenés 2"], [], "ok", "descartar")),
    ({"years_discipline": "ads"}, (9.5, ["años en otro dominio (ads)"], [], "ok", "descartar")),
    ({"discipline": "sales"}, (3.0, ["disciplina distinta (sales)"], [], "ok", "descartar")),
    ({"blockers": ["Disciplina distinta (lead)"]}, (9.5, [], [], "ok", "aplicar_personalizado")),
    ({"blockers": ["híbrido en oficina"], "modality": "hibrido"}, (9.5, [], ["híbrido en oficina"], "ok", "aplicar")),
    ({"blockers": ["solo presencial"], "modality": "presencial"}, (9.5, ["solo presencial"], [], "ok", "descartar")),
    ({"salary_min": 1000, "salary_max": 1500}, (9.5, ["salario por debajo del piso (USD 1500/mes < 2000)"], [], "ok", "descartar")),
    ({"salary_min": 1000, "salary_max": 2500, "blockers": ["sueldo bajo"]}, (9.5, [], ["el rango salarial empieza abajo de tu piso"], "ok", "aplicar_personalizado")),
    ({"local_currency": True}, (9.5, [], ["salario en USD pagado en moneda local"], "ok", "aplicar_personalizado")),
    ({"weekly_hours": 48}, (9.5, ["jornada de 48 h (máximo 44)"], [], "ok", "descartar")),
    ({"levels": ["Senior"]}, (9.5, [], ["el aviso es senior y tenés ~2 años"], "ok", "aplicar_personalizado")),
    ({"levels": ["Junior"]}, (9.5, [], [], "ok", "aplicar_personalizado")),
    ({"english_required": "avanzado"}, (8.5, [], ["inglés requerido avanzado, el candidato tiene B1"], "ok", "aplicar")),
    ({"english_required": "avanzado", "english_moot": True, "blockers": ["Inglés avanzado"], "risks": ["english a mejorar"]}, (9.5, [], ["el aviso no pide inglés, el modelo sí"], "ok", "aplicar")),
    ({"cloud_must": True}, (9.0, [], [], "ok", "aplicar_personalizado")),
    ({"flags": ["location_risk", "many_candidates"]}, (9.5, [], ["ubicación sin confirmar", "muchos candidatos"], "ok", "aplicar")),
    ({"location_ok": "no"}, (9.5, [], ["location_ok = no"], "no", "guardar")),
    ({"flags": ["residencia_exigida:CA,US"]}, (9.5, ["residencia exigida en CA, US"], [], "no", "descartar")),
    ({"only_places": "CA"}, (9.5, ["remoto solo desde CA"], [], "no", "descartar")),
    ({"risks": ["trae instrucciones al lector"]}, (5.0, [], ["el aviso trae instrucciones al evaluador"], "ok", "guardar")),
    ({"score": 12.0}, (10.0, [], [], "ok", "aplicar_personalizado")),
    ({"score": -1.0}, (0.0, [], [], "ok", "descartar")),
]
_DECISION_SCHEMA = "id long, score double, blockers array<string>, risks array<string>, years_required int, years_discipline string, discipline string, modality string, salary_min int, salary_max int, local_currency boolean, weekly_hours int, levels array<string>, english_required string, english_moot boolean, cloud_must boolean, location_ok string, title_cap double, flags array<string>, only_places string"


_TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
_OLD = [  # id, user, url, external_keys, hash, company, title_tokens, text, seen, modality, location
    (1, "u", "x/1", ["a:1"], "h1", "acme", ["data", "engineer", "python"], _TEXT, 10, "remoto", None), (2, "u", "x/2", ["a:2", "b:9"], "h2", "acme", ["backend", "go"], None, 10, "remoto", "lima"),
    (3, "u", None, [], None, "unknown", ["backend", "go"], None, 12, None, None), (4, "v", "x/1", ["a:1"], "h1", "acme", ["backend"], _TEXT, 10, None, None), (5, "u", None, [], None, "acme", ["backend", "go"], None, 1, None, None),
]
_NEW = [  # id, user, url, external_key, hash, company, title_tokens, text, seen, modality, location
    (11, "u", "x/2", "a:1", None, "z", [], None, 99, None, None), (12, "u", None, "b:9", None, "z", [], None, 99, None, None), (13, "u", None, None, "h2", "z", [], None, 99, None, None),
    (14, "u", None, None, "q", "z", [], _TEXT + " ", 12, None, None), (15, "u", None, None, "q", "z", [], _TEXT, 99, None, None), (16, "u", None, None, None, "acme", ["backend", "go"], None, 12, "remoto", "lima"),
    (17, "u", None, None, None, "acme", ["backend", "go"], None, 12, "presencial", None), (18, "u", None, None, None, "acme", ["backend", "go"], None, 12, "desconocida", "quito"), (19, "u", None, None, None, "unknown", ["backend", "go"], None, 12, None, None),
    (20, "u", None, None, None, "acme", ["data", "engineer"], None, 12, None, None), (21, "w", "x/1", "a:1", "h1", "acme", ["backend"], _TEXT, 10, None, None),
]
_MATCHED = [(11, "merge", 1, "external_id", 1.0, []), (12, "merge", 2, "external_id", 1.0, []), (13, "merge", 2, "jd_hash", 1.0, []), (14, "merge", 1, "jd_text", 1.0, ["volume_recruiting"]), (15, "insert", None, None, None, []), (16, "insert", 2, "company_title", 1.0, []),
            (17, "insert", 5, "company_title", 1.0, []), (18, "insert", 5, "company_title", 1.0, []), (19, "insert", None, None, None, []), (20, "insert", 1, "company_title", 0.6666666666666666, []), (21, "insert", None, None, None, [])]


_LOG = [  # task, at_s, seq, event
    *[(1, s, k, e) for k, (s, e) in enumerate([(0, "enqueue"), (5, "dequeue"), (9, "ack"), (10, "fail")])],
    *[(2, s, k, e) for k, (s, e) in enumerate([(0, "enqueue"), (5, "dequeue"), (9, "fail"), (20, "dequeue"), (70, "dequeue"), (75, "fail"), (196, "dequeue"), (200, "fail"), (900, "dequeue")])],
    *[(3, s, k, e) for k, (s, e) in enumerate([(0, "enqueue"), (5, "dequeue"), (100, "stale"), (1000, "stale"), (1001, "dequeue"), (1005, "release")])],
    *[(4, s, k, e) for k, (s, e) in enumerate([(3, "ack"), (4, "enqueue"), (4, "enqueue")])],
    *[(5, s, k, e) for k, (s, e) in enumerate([(0, "enqueue"), (7, "dequeue")])],
]




def of(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_companies_and_urls(spark):
    assert of(spark.createDataFrame(_COMPANIES, "id long, raw string").select("id", text.company_name(F.col("raw")))) == {k: (v,) for k, v in _COMPANY_NAMES}
    assert of(spark.createDataFrame(_LINKS, "id long, url string").select("id", urls.canonical_url(F.col("url")))) == {k: (v,) for k, v in _CANONICAL}


def test_prefilter(spark):
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(_CASES)], _CASE_SCHEMA)
    assert of(prefilter.prefilter(rows, _RULES).select("id", "reason", "detail", "cap", "flags")) == dict(enumerate(_EXPECTED))


def test_changed_verdicts(spark):
    rows = spark.createDataFrame([(k, *c, _EXPECTED[k][0] if k % 2 == 0 else "titulo_blocklist", _EXPECTED[k][3]) for k, c in enumerate(_CASES)], _CASE_SCHEMA + ", old_reason string, old_flags array<string>")
    changed = {k: e for k, e in enumerate(_EXPECTED) if k % 2 and e[0] != "titulo_blocklist"}
    passes = sorted(k for k, e in changed.items() if e[0] is None)[:4]
    assert of(prefilter.changed_verdicts(rows, _RULES, "id", enqueue=4)) == {k: (e[0], e[3], k in passes) for k, e in changed.items()}


def test_decisions(spark):
    rows = spark.createDataFrame([(k, *(_BASE | change).values()) for k, (change, _) in enumerate(_DECISIONS)], _DECISION_SCHEMA)
    assert of(decisions.decide_posting(rows, _C).select("id", "final_score", "blockers", "risks", "final_location_ok", "action")) == {k: e for k, (_, e) in enumerate(_DECISIONS)}


def test_user_duplicates(spark):
    shape = "id long, user string, url string, {}, hash string, company string, title_tokens array<string>, text string, seen long, modality string, location string"
    got = user_duplicates(spark.createDataFrame(_NEW, shape.format("external_key string")), spark.createDataFrame(_OLD, shape.format("external_keys array<string>")), window=14)
    assert of(got) == {m[0]: tuple(m[1:]) for m in _MATCHED}


def test_queue_states(spark):
    got = of(jobs.queue_states(spark.createDataFrame(_LOG, "task long, at_s long, seq long, event string")))
    assert got == {1: ("done", 1, 0, None), 2: ("failed", 3, 195, None), 3: ("pending", 1, 1005, None), 4: ("pending", 0, 4, None), 5: ("processing", 1, 0, 7)}


def test_due_sources_and_planned_queries(spark):
    rows = [("a", 60, 100, None, 4), ("b", 60, 950, None, 1), ("c", 60, None, None, 3), ("d", 300, 500, "http_429", 1), ("e", 300, 500, "http_500", 2), ("f", 60, 600, None, 9)]
    df = spark.createDataFrame(rows, "source string, minimum long, last_attempt long, last_error string, cost long")
    assert of(boards.due_sources(df, F.lit(1000), 9)) == {"c": (1,), "a": (2,), "e": (3,)}
    words = [("data", 0, 0, "a"), ("data", 0, 1, "b"), ("qa", 1, 0, "k"), ("qa", 1, 1, "l"), ("qa", 1, 2, "x"), ("ux", 2, 0, "u")]
    plan = boards.planned_queries(spark.createDataFrame(words, "role string, role_order long, place long, keyword string"), per_role=2, per_run=3, rotation=2)
    assert of(plan) == {0: ("qa", "k"), 1: ("ux", "u"), 2: ("data", "b")}


def test_badges_without_a_ratio(spark):
    rows = [(1, []), (2, ["x"]), (3, None), (4, ["0 of 0 skills"]), (5, ["x", "1 of 4 skills"])]
    assert of(spark.createDataFrame(rows, "id long, badges array<string>").select("id", prefilter.badge_ratio(F.col("badges")))) == {1: (None,), 2: (None,), 3: (None,), 4: (None,), 5: (0.25,)}


def test_parts_of_titles_that_say_a_place(spark):
    titles = {"engineer (hybrid)": "hybrid", "hybrid cloud engineer": None, "dev, on-site in lima": "onsite in lima", "onsite interviews manager": None, "dev | modalidad hibrida": "modalidad hibrida", "dev - hybrid optional": None, "dev (hybrid, flexible hours)": "hybrid", "dev - en oficina": "en oficina", "dev: hybrid mode 3 dias": "hybrid mode 3 dias", "": None}
    got = spark.createDataFrame([(t,) for t in titles], "t string").select("t", prefilter.non_remote_segment(F.col("t")))
    assert of(got) == {k: (v,) for k, v in titles.items()}
