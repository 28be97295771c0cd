"""Rules without a SQL form: against plain Python on the driver's tables, and on built rows."""

import json
import os

import pytest
import regex
from pyspark.sql import functions as F

from sievelake.functions import english, redaction, text
from sievelake.operators import decisions, matching
from sievelake.sources import boards

DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


MARKED = [  # text, what it becomes
    ("Escribime a persona.ficticia@example.com hoy", "Escribime a [email] hoy"), ("x＠y.com", "[email]"), ("ana (at) mail (dot) com / github.io/x", "[email] / [link]"), ("ana arroba mail punto com hola", "[email] hola"), ("a [at] b.com", "[email]"),
    ("a@b a@b.c @x.com x@y.com.ar. z", "a@b a@b.c @x.com [email]. z"), ("linkedin.com/in/uno y https://example.com/cv, www.example.com/x. github.com, foo.tech/cv!", "[link] y [link], [link]. [link], [link]!"),
    ("Node.js/Express, CI/CD, ASP.NET y React.js", "Node.js/Express, CI/CD, ASP.NET y React.js"),
    *[(f"Tel: {x}. Gracias", "Tel: [teléfono]. Gracias") for x in ("+54 9 351 555-0000", "+54 9 351 5550000", "0299 15 555 0000", "0299 15-555-0000", "11 1234-5678", "(011) 4123-4567", "11-1234-5678", "299 555-0000", "+1 (415) 555-0100", "2995550000", "5491144445555", "549 11 4444-5555", "4555-1234")],
    *[(f"Datos: {x} fin", "Datos: [documento] fin") for x in ("DNI 22.333.444", "D.N.I. 22.333.444", "DNI: 22333444", "DNI N° 22.333.444", "documento 12.345.678", "documento de identidad n° 12345678", "CUIL 27-22333444-1", "CUIT: 27223334441", "27-22333444-1", "123.456.789-09", "22.333.444-5", "12.345.678-K", "Pasaporte: AAB123456", "passport no. X1234567")],
    ("el pasaporte electrónico de la empresa", "el pasaporte electrónico de la empresa"), ("Vivo en Av. Siempre Viva 742, Ciudad", "Vivo en [dirección], Ciudad"), ("Calle Falsa 123", "[dirección]"), ("pje San Juan 123", "[dirección]"), ("Domicilio: algo s/n\nOtra línea", "[dirección]\nOtra línea"),
    *[(f"{x} y sigo", "[fecha de nacimiento] y sigo") for x in ("Fecha de nacimiento: 12/03/1990", "Nacido el 12 de marzo de 1990", "Nacida el 12-03-1990", "Born March 12, 1990", "DOB: 1990-03-12", "D.O.B. 12.03.1990", "f. de nac. 01/02/1990", "nací el 1990")],
    *[(x, "[edad]") for x in ("Edad: 32 años", "Edad: 32", "32 años de edad", "Age: 32", "32 years old")], ("Estado civil: soltera", "[estado civil]"), ("Casado/a, con hijos", "[estado civil], con hijos"), ("Soy divorciado", "Soy [estado civil]"), ("viudas", "viudas"),
    *[(x, x) for x in ("2019 – 2023. 03/2020 - 06/2022. 2018-2021 y 2018 2019-2021. 5 años de experiencia y 10 años", "Atendí a 10.000.000 de usuarios y 1.500 tickets", "15.000 USD, 192.168.10.100, 4111111111111111", "", "a" * 3000 + "@", "@" * 500, "1" * 5000, "( ) - +")],
]


def test_redaction(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(MARKED)] + [(-1, None)], "id long, t string")
    got = {r["id"]: r["r"] for r in rows.select("id", redaction.redacted(F.col("t")).alias("r")).collect()}
    for k, (value, expected) in enumerate(MARKED):
        assert got[k]["text"] == expected, value
        assert sum(got[k]["counts"].values()) == sum(expected.count(m) for m in set(redaction.MARKERS.values())) and not got[k]["residual"]
    assert got[-1]["text"] is None and got[-1]["counts"] is None and got[-1]["residual"] is None
    named = spark.createDataFrame([("Álvaro Núñez-Pérez trabajó con alvaro", "Alvaro Nunez"), ("Nuñez, Álvaro", "Alvaro Nuñez"), ("SOFIA EJEMPLO y sofia  ejemplo", "Sofia Ejemplo"), ("Persona", None), ("Nombre Ficticio", "Nombre Ficticio")], "t string, name string")
    out = [r["r"] for r in named.select(redaction.redacted(F.col("t"), F.col("name")).alias("r")).collect()]
    assert [r["text"] for r in out] == ["[nombre]-Pérez trabajó con [nombre]", "[nombre], [nombre]", "[nombre] y [nombre]", "Persona", "[nombre]"]
    assert [r["residual"] for r in out] == [[], [], [], [], ["display_name"]]  # the marker is a part of the name: fails closed
    links = spark.createDataFrame([("Mirá https://example.com/a, a@b.com y  listo",), (None,)], "t string").select(redaction.without_links(F.col("t")).alias("t"), redaction.without_links(F.col("t"), 6).alias("few")).collect()
    assert [tuple(r) for r in links] == [("Mirá , y listo", "Mirá ,"), (None, None)]


@tables
def test_redaction_and_masks_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = docs.select("text", redaction.redacted(F.col("text")).alias("r"), text.mask_phones(text.mask_emails(F.col("text"))).alias("m")).collect()
    assert all((r["r"]["text"], r["r"]["counts"], r["r"]["residual"]) == redaction.redact(r["text"]) for r in got)
    # mail addresses as one pattern finds them, none of which is left
    mail = regex.compile(r"(?i)[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}")
    assert sum(r["r"]["counts"].get("email", 0) for r in got) == sum(len(mail.findall(r["text"])) for r in got) > 0
    assert not any(mail.search(r["r"]["text"]) or r["r"]["residual"] for r in got)
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    no = r"(?!\d{4}-\d{2}-\d{2}\b)(?!(?:19|20)\d{2}\s*[-–/]\s*(?:19|20)\d{2}\b)(?!\d{1,3}(?:\.\d{1,3}){3}\b)"
    phone = regex.compile(rf"(?<![\w.+]){no}\+?\(?\d(?:[\s().-]{{0,2}}\d){{7,14}}(?![\w])", regex.ASCII)
    assert all(r["m"] == phone.sub("[phone]", regex.sub(email, "[email]", r["text"])) for r in got)


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("Advanced English required", (True, "avanzado")),
        ("Inglés intermedio. Francés avanzado", (True, "intermedio")),
        ("Fluent in Spanish, Italian and English", (True, "fluido")),
        ("Advanced German and some English skills", (True, None)),
        ("English version below", (False, None)),
        ("Nivel B2 de inglés; ingles conversacional", (True, "avanzado")),
        ("Our English office", (False, None)),
        ("You must speak english", (True, None)),
        ("Professional Spanish and basic English", (True, "basico")),
        ("English B2+", (True, "avanzado")), ("Nice to have: conversational English", (True, "intermedio")), ("Languages: Spanish and English (bilingual)", (True, "fluido")), ("Conocimientos de inglés básico", (True, "basico")),
        ("English: upper-intermediate or better", (True, "avanzado")), ("English at full professional proficiency", (True, "fluido")), ("Join our Spanish-speaking team", (False, None)), ("Description in English below.", (False, None)),
        ("Podés ver la versión en inglés de este aviso", (False, None)), ("English-language site", (False, None)), ("Fluency in both English and German", (True, "fluido")), ("Perfil:\n- Fluent English\n- Git", (True, "fluido")), ("• Inglés intermedio", (True, "intermedio")),
        ("Excellent English\n- Advanced Excel", (True, None)), ("English required - fluent German", (True, None)), ("INGLÉS AVANZADO", (True, "avanzado")), ("english " * 5000, (False, None)), ("advanced german english " * 4000, (True, "avanzado")),
        ("", (False, None)),
        (None, (False, None)),
    ],
)
def test_asked_english(value, expected):
    assert english.asked_english(value) == expected


@tables
def test_language_facts_of_a_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("\nAdvanced English required"))).otherwise(F.col("text"))).withColumn("extra", F.lit(1))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = english.language_facts(docs).collect()
    assert len(got) == len(texts) and all((r["asks_english"], r["english_level"]) == english.asked_english(texts[r["doc_id"]]) for r in got)
    assert english.language_facts(docs.limit(0)).count() == 0


def test_company_boards(spark):
    frame = lambda value: spark.createDataFrame([(json.dumps(value),), ("broken",)], "value string")
    lever = [{"id": "1", "text": "Data &amp; AI", "hostedUrl": "https://l.co/1", "createdAt": 0, "workplaceType": "hybrid", "categories": {"location": "Lima", "allLocations": ["Lima", "Quito"], "team": "D"}, "salaryRange": {"min": 10, "max": 20, "currency": "usd", "interval": "per-year-salary"}}, {"id": "2", "text": "x"}]
    r = boards.lever(frame(lever), "acme").collect()
    assert [(x["title"], x["location"], x["modality"], x["salary_min"], x["salary_max"], x["salary_period"], x["tags"]) for x in r] == [("Data & AI", "Lima / Quito", "hibrido", 10, 20, "anual", ["D"])]
    ashby = {"jobs": [{"title": "A", "jobUrl": "https://a.co/x/77?y=1", "isRemote": True, "secondaryLocations": [{"location": "B"}]}, {"id": "z", "title": "B", "jobUrl": "https://a.co/z", "isListed": False}]}
    assert [(x["external_id"], x["modality"], x["location"]) for x in boards.ashby(frame(ashby), "acme").collect()] == [("77", "remoto", "B")]
    workable = {"jobs": [{"shortcode": "S", "title": "W", "shortlink": "https://w.co/S", "telecommuting": False, "city": "Remote", "country": "AR", "locations": []}]}
    assert [(x["external_id"], x["modality"], x["location"]) for x in boards.workable(frame(workable), "acme").collect()] == [("S", "desconocida", "Remote, AR")]
    relief = {"data": [{"id": "9", "fields": {"title": "R", "country": [{"name": "Peru"}], "source": [{"name": "NGO"}], "date": {"created": "2024-01-02T00:00:00Z"}}}, {"id": "8", "fields": {"title": ""}}]}
    assert [(x["company"], x["location"], x["countries"]) for x in boards.reliefweb(frame(relief)).collect()] == [("NGO", "Peru", ["Peru"])]
    team = {"items": [{"url": "https://acme.teamtailor.com/jobs/55-dev", "title": "T", "remote_status": "fully", "locations": [{"city": "Lima", "country": "PE"}]}, {"url": "https://evil.com/jobs/1", "title": "T"}]}
    assert [(x["external_id"], x["modality"], x["location"]) for x in boards.teamtailor(frame(team), "acme").collect()] == [("55", "remoto", "Lima, PE")]
    assert [x["external_id"] for x in boards.jooble(frame({"jobs": [{"id": "3", "title": "J", "link": "https://j.co/3"}, {"id": "4", "title": "K", "link": "javascript:x"}]})).collect()] == ["jooble:3"]


def test_small_source_rules(spark):
    attempts = spark.createDataFrame([("a", 1, None), ("a", 2, "http_404"), ("b", 1, None)], "board string, page int, code string")
    assert {(r["board"], r["status"], r["permanent"], r["pages"]) for r in boards.board_states(attempts).collect()} == {("a", "http_404", True, 2), ("b", "ok", False, 1)}
    html = spark.createDataFrame([("<p>a<meta http-equiv=x>b</p>",), ("<me<meta>ta x>c",), ("<base href=1",)], "h string").select(boards.without_navigation(F.col("h")).alias("h"))
    assert [r["h"] for r in html.collect()] == ["<p>ab</p>", "c", ""]
    paste = spark.createDataFrame([("https://x.co/1\nBackend Dev\nCompany: Acme\nBody one\n\nBody two",), (None,), ("Only a title",)], "t string").select(boards.pasted(F.col("t")).alias("p"))
    assert [tuple(r["p"]) for r in paste.collect()] == [("https://x.co/1", "Backend Dev", "Acme", "Body one\nBody two"), (None, None, None, ""), (None, "Only a title", None, "")]


def test_split_is_balanced_and_reproducible(spark):
    rows = spark.range(101).select("id", (F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("b"))
    parts = {r["id"]: r["part"] for r in decisions.stratified_split(rows, "id", ["a", "b"], 5).collect()}
    assert len(parts) == 101 and abs(list(parts.values()).count("dev") - 50.5) < 1
    assert parts == {r["id"]: r["part"] for r in decisions.stratified_split(rows.repartition(7), "id", ["a", "b"], 5).collect()}


def test_sql_functions(spark):
    from sievelake.functions.sql import register_sql

    names = register_sql(spark, [("go", ["go", "golang"]), ("google", ["google cloud"])])
    assert "skill_mentions" in names
    r = spark.sql("SELECT fold_text('Ñandú') AS a, squash('  x   y ') AS b, monthly_usd(12000D, 'anual') AS c, url_host('https://A.b/x') AS d, jaccard(array('a', 'b'), array('b')) AS e, word_list('Más, de 1') AS f, content_hash(' A  b') = sha2('a b', 256) AS g").first()
    assert tuple(r) == ("nandu", "x y", 1000, "a.b", 0.5, ["mas", "de", "1"], True)
    spark.createDataFrame([(1, "golang is nice to have\ngoogle cloud"), (2, None)], "id long, t string").createOrReplaceTempView("postings")
    got = spark.sql("SELECT id, slug, position, must FROM postings, LATERAL skill_mentions(t)").collect()
    assert {tuple(x) for x in got} == {(1, "go", 0, False), (1, "google", 23, True)}


def test_mentions_equal_masking(spark):
    import random

    r = random.Random(1)
    taxonomy = [("a", ["x y", "x"]), ("b", ["y z", "y"]), ("c", ["z"]), ("d", ["x y z"])]
    texts = [" ".join(r.choices(["x", "y", "z", "xx", "\n", "a plus"], k=12)) for _ in range(60)]

    def plain(t):
        masked, found = t, {}
        for term, slug in matching.compile_terms(taxonomy):
            for m in list(regex.finditer(rf"(?<![\w+#]){regex.escape(term)}(?![\w+#])", masked)):
                line = t[: m.end()].rsplit("\n", 1)[-1] + t[m.end() :].split("\n", 1)[0]
                at, must = found.get(slug, (m.start(), False))
                found[slug] = (min(at, m.start()), must or "a plus" not in line)
                masked = masked[: m.start()] + "\0" * len(m[0]) + masked[m.end() :]
        return found

    got = matching.mentions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), taxonomy).collect()
    assert {(x["doc_id"], x["slug"], x["position"], x["must"]) for x in got} == {(k, s, *v) for k, t in enumerate(texts) for s, v in plain(t).items()}
