"""Rules on whole tables: titles, places, offers and evaluations are made of the tables' own rows, with words picked by key, and DuckDB computes the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions import places, text, titles, urls
from sievelake.operators import decisions, prefilter
from sievelake.operators.dedup import insert_companies, user_duplicates
from sievelake.plans.registry import query


def _quoted(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_quoted, v)) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


#: Words of titles; each part's name stands between one of each, by its key.
_BEFORE = ["Senior", "Sr.", "Semi Senior", "Semi-Senior / Senior", "Junior", "Tech Lead", "Lead Generation", "Staff", "Principal", "Principal,", "Head of", "Group", "Pasante de", "Mid-Market", "VP", "Intern", "Entry Level", "Director de", "ssr", "Lead", "Mid Level", "Vice-President,", "Chief of", ""]
_AFTER = ["Software Engineer", "Data Engineer (Remote)", "Developer", "Backend", "QA", "Designers", "People", "Product Manager", "Account Executive", "Analyst", "Nurse", "React", "Diseñador/a Jr", "Lead", "Architect", "Full Stack Designer", "leads", "Marketing"]
_pick = lambda words, at: F.element_at(F.array(*[F.lit(w) for w in words]), (at % len(words) + 1).cast("int"))
_pick_sql = lambda words, at: f"{_quoted(words)}[{at} % {len(words)} + 1]"
_TITLE_SQL = f"(SELECT p_partkey AS id, CASE WHEN p_partkey % 101 > 0 THEN {_pick_sql(_BEFORE, 'p_partkey')} || ' ' || p_name || ' ' || {_pick_sql(_AFTER, '(p_partkey // 7 + p_size)')} END AS title FROM part)"


def _titled(t) -> DataFrame:
    """Every part as a posting with a title."""
    key = F.col("p_partkey")
    title = F.concat_ws(" ", _pick(_BEFORE, key), "p_name", _pick(_AFTER, F.floor(key / 7) + F.col("p_size")))
    return t.part.select(key.alias("id"), F.when(key % 101 > 0, title).alias("title"))


_PADDED = "' ' || array_to_string(list_filter(string_split_regex(regexp_replace(lower(strip_accents(coalesce(title, ''))), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''), ' ') || ' '"
_HAS = lambda column, terms: f"regexp_matches({column}, ' ({'|'.join(terms)}) ')"
_LEVEL_SQL = f"""WITH p AS (SELECT id, {_PADDED} AS p0 FROM {_TITLE_SQL}),
  a AS (SELECT id, p0, regexp_replace(regexp_replace(regexp_replace(regexp_replace(p0, '( lead generation)+ ', ' ', 'g'), '( lead gen)+ ', ' ', 'g'), '( leads)+ ', ' ', 'g'), '( mid market)+ ', ' ', 'g') AS p FROM p),
  b AS (SELECT id, p0, p, regexp_replace(p, '( semi senior)+ ', ' ', 'g') AS q FROM a),
  l AS (SELECT id, p0, array_to_string(list_filter([CASE WHEN {_HAS('p', titles.LEVELS[0][1])} THEN 'Trainee' END, CASE WHEN {_HAS('p', titles.LEVELS[1][1])} THEN 'Junior' END, CASE WHEN {_HAS('p', titles.LEVELS[2][1])} THEN 'Semi Senior' END,
    CASE WHEN {_HAS('q', titles.LEVELS[3][1])} THEN 'Senior' END, CASE WHEN {_HAS('q', titles.LEVELS[4][1])} OR ({_HAS('p', titles.LEAD_WITH_ROLE)} AND regexp_matches(p, ' (engineer|developer|architect|scientist|designer)s? ')) THEN 'Lead' END], lambda x: x IS NOT NULL), ' / ') AS levels FROM b)"""


@query(f"{_LEVEL_SQL} SELECT id, nullif(levels, '') AS levels FROM l")
def title_levels(t):
    return _titled(t).select("id", titles.title_levels(F.col("title")).alias("levels"))


_YEARS = "CASE WHEN id % 3 = 0 THEN 3 WHEN id % 3 = 1 THEN 8 END"


@query(f"""{_LEVEL_SQL}, k AS (SELECT id, CASE WHEN {_HAS('p0', titles.ABOVE_SENIOR)} OR regexp_matches(p0, ' group ((product|engineering) )?(manager|lead) ') THEN 'staff_plus' WHEN levels IN ('Senior', 'Lead') THEN 'senior' END AS level, {_YEARS} AS years FROM l)
  SELECT id, level, CAST(coalesce(years < 5 AND level = 'senior', false) AS INT) AS senior_penalty, coalesce(years < 5 AND level = 'staff_plus', false) AS too_senior FROM k""")
def title_assessments(t):
    years = F.when(F.col("id") % 3 == 0, 3).when(F.col("id") % 3 == 1, 8)
    return _titled(t).select("id", titles.assess_title(F.col("title"), years).alias("a")).select("id", "a.*")


_NAMED, _VETO, _SPARED = ["data engineer", "backend", "software engineer"], ["designer", "qa", "semi senior"], ["full stack"]


@query(f"""SELECT id, CASE WHEN regexp_matches(p, ' ({'|'.join(_NAMED)})s? ') THEN 2 WHEN {_HAS('p', _VETO)} AND NOT {_HAS('p', _SPARED)} THEN 0 ELSE 1 END AS fit,
  title IS NOT NULL AND regexp_matches(lower(title), '\\b(data[^a-z0-9]+engineer|backend|software[^a-z0-9]+engineer)s?\\b') AS strong FROM (SELECT id, title, {_PADDED} AS p FROM {_TITLE_SQL})""")
def title_fits(t):
    rows = _titled(t)
    strong = F.coalesce(F.lower("title").rlike(titles.strong_pattern(_NAMED)), F.lit(False))
    return rows.select("id", titles.title_fit(F.col("title"), _NAMED, _VETO, _SPARED).alias("fit"), strong.alias("strong"))


_HINTING = ["Backend Engineer", "Marketing Lead", "QA Backend Data Design Marketing", "Office", "Data Designer", "Data Analyst", "Graphic Designer Intern", "QA", "Marketing QA Data"]
_CATEGORIES = ["Programming", "Design", "design ", "Sales"]
_HINT_ROWS_SQL = f"(SELECT p_partkey AS id, CASE WHEN p_partkey % 53 > 0 THEN {_pick_sql(_HINTING, 'p_partkey')} || ' ' || p_name END AS title, CASE WHEN p_size % 7 > 0 THEN {_pick_sql(_CATEGORIES, 'p_size')} END AS category, CASE WHEN p_brand < 'Brand#2' THEN 'a' ELSE 'b' END AS source FROM part)"
_HINT_TERMS = {"backend": ["backend"], "data": ["data"], "design": ["design", "designer"], "marketing": ["marketing"], "qa": ["qa"]}
_HINT_SQL = "list_filter([CASE WHEN p LIKE '% backend %' THEN 'backend' END, CASE WHEN p LIKE '% data %' AND p NOT LIKE '% analyst %' THEN 'data' END, CASE WHEN regexp_matches(p, ' (design|designer) ') THEN 'design' END, CASE WHEN p LIKE '% marketing %' THEN 'marketing' END, CASE WHEN p LIKE '% qa %' THEN 'qa' END], lambda x: x IS NOT NULL)"


@query(f"""WITH n AS (SELECT id, {_HINT_SQL} AS named, CASE WHEN source = 'a' AND lower(trim(category)) = 'programming' THEN ['backend', 'data'] WHEN source = 'a' AND lower(trim(category)) = 'design' THEN list_intersect(['design'], {_HINT_SQL}) ELSE [] END AS cat FROM (SELECT *, {_PADDED} AS p FROM {_HINT_ROWS_SQL})),
  b AS (SELECT id, named, list_sort(list_distinct(list_concat(named, cat))) AS u FROM n) SELECT id, CASE WHEN len(u) <= 4 THEN u WHEN len(named) <= 4 THEN list_sort(named) ELSE [] END AS hints FROM b""")
def role_hints(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = t.part.select(key.alias("id"), F.when(key % 53 > 0, F.concat_ws(" ", _pick(_HINTING, key), "p_name")).alias("title"), F.when(size % 7 > 0, _pick(_CATEGORIES, size)).alias("category"), F.when(F.col("p_brand") < "Brand#2", "a").otherwise("b").alias("source"))
    by_category = {("a", "programming"): (["backend", "data"], False), ("a", "design"): (["design"], True)}
    return rows.select("id", titles.role_hints(F.col("title"), F.col("category"), F.col("source"), by_category, _HINT_TERMS, {"data": ["analyst"]}).alias("hints"))


_SOMEWHERE = ["Remote (LATAM)", "  Buenos Aires, Argentina - Remoto ", "New Mexico, USA", "México o Perú", "remoto", "São Paulo / Brazilian hours", "Córdoba [hybrid (3 days)], ARGENTINA;", "Spain, remote", "Peruanos y argentinos", "Brasil", "Lima, PERU", "Mexico, New Mexico"]
_PLACES_SQL = f"(SELECT c_custkey AS id, CASE WHEN c_custkey % 37 > 0 THEN {_pick_sql(_SOMEWHERE, 'c_custkey')} || CASE WHEN c_nationkey % 3 = 0 THEN ', ' || lower(c_mktsegment) WHEN c_nationkey % 3 = 1 THEN ' | ' || {_pick_sql(_SOMEWHERE, 'c_nationkey')} ELSE '' END END AS place FROM customer)"
_NAMES, _OUT = {"AR": ["argentina"], "BR": ["brazil", "brasil"], "MX": ["mexico"], "PE": ["peru"]}, {"ES": ["spain", "espana"]}
_FOLDED = "lower(strip_accents(coalesce(place, '')))"
_NAMED_SQL = f"list_filter([CASE WHEN regexp_matches(f, '(^|[^a-z0-9])argentina($|[^a-z0-9])') THEN 'AR' END, CASE WHEN regexp_matches(f, '(^|[^a-z0-9])(brazil|brasil)($|[^a-z0-9])') THEN 'BR' END, CASE WHEN regexp_matches(replace(f, 'new mexico', ''), '(^|[^a-z0-9])mexico($|[^a-z0-9])') THEN 'MX' END, CASE WHEN regexp_matches(f, '(^|[^a-z0-9])peru($|[^a-z0-9])') THEN 'PE' END, CASE WHEN regexp_matches(f, '(^|[^a-z0-9])(spain|espana)($|[^a-z0-9])') THEN 'ES' END], lambda x: x IS NOT NULL)"


@query(f"""SELECT id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(place)), '\\([^()\\[\\]]*\\)', ' ', 'g'), '\\[[^\\[\\]]*\\]', ' ', 'g'), '\\b(remoto|remota|remote)\\b', ' ', 'g'), '\\s+', ' ', 'g'), '^[\\s,;/|-]+|[\\s,;/|-]+$', '', 'g')), '') AS normal, {_NAMED_SQL} AS countries, regexp_matches(f, '(^|[^a-z0-9])peru') AS peru FROM (SELECT *, {_FOLDED} AS f FROM {_PLACES_SQL})""")
def location_names(t):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    more = F.when(nation % 3 == 0, F.concat(F.lit(", "), F.lower("c_mktsegment"))).when(nation % 3 == 1, F.concat(F.lit(" | "), _pick(_SOMEWHERE, nation))).otherwise("")
    rows = t.customer.select(key.alias("id"), F.when(key % 37 > 0, F.concat(_pick(_SOMEWHERE, key), more)).alias("place"))
    named = places.countries_mentioned(F.col("place"), _NAMES, _OUT, {"mexico": "(?<!new )"})
    return rows.select("id", places.normal_location(F.col("place")).alias("normal"), named.alias("countries"), places.mentions_country(F.col("place"), F.lit("pe"), _NAMES, whole=False).alias("peru"))


_LEADS, _FORMS = ["", "Foo → ", "Bar -> Baz => ", "Old » "], [" S.A.", " Inc", ", Inc.", " & Hijos SRL", " GmbH", " (Argentina) [AR] Ltda", " Corp. vía LinkedIn", " y Co LLC", "", " S.R.L."]


@query(f"""WITH c AS (SELECT s_suppkey AS id, {_pick_sql(_LEADS, 's_suppkey')} || s_name || {_pick_sql(_FORMS, 's_suppkey // 3')} AS raw FROM supplier),
  f AS (SELECT id, lower(strip_accents(regexp_replace(regexp_extract(raw, '([^→»>]*)$', 1), '\\([^()]*\\)|\\[[^\\[\\]]*\\]', ' ', 'g'))) AS x FROM c),
  w AS (SELECT id, trim(regexp_replace(regexp_replace(x, '\\s+via\\s.*$', ' '), '[^a-z0-9]+', ' ', 'g')) AS x FROM f)
  SELECT id, regexp_replace(regexp_replace(regexp_replace(x, ' s a$', ' sa'), ' s r l$', ' srl'), '( (sa|srl|inc|gmbh|corp|llc|co))+$', '') AS company FROM w""")
def company_cases(t):
    """Every supplier with something before and behind its name."""
    key = F.col("s_suppkey")
    raw = F.concat(_pick(_LEADS, key), F.col("s_name"), _pick(_FORMS, F.floor(key / 3)))
    return t.supplier.select(key.alias("id"), text.company_name(raw).alias("company"))


@query(r"""WITH p AS (SELECT page_id AS id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'HTTPS://WWW.Shop' || page_id || '.com/a//?utm_source=x&b=' || page_id || '&a=1#f' WHEN 2 THEN 'http://linkedin.com/jobs/view/dev-' || page_id || '?trk=z' WHEN 3 THEN 'https://ar.indeed.com/viewjob?jk=k' || page_id || '&from=x' ELSE 'ftp://x.org/' || page_id END AS url FROM pages),
  q AS (SELECT id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND NOT list_contains(['trk', 'ref', 'src', 'source', 'fbclid', 'gclid'], lower(split_part(x, '=', 1)))) AS kept FROM p)
  SELECT id, CASE WHEN id % 5 = 4 THEN NULL WHEN id % 5 = 2 THEN 'https://linkedin.com/jobs/view/' || id WHEN id % 5 = 3 THEN 'https://ar.indeed.com/viewjob?jk=k' || id WHEN url IS NOT NULL AND url LIKE '%://%' THEN lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END END AS canonical FROM q""")
def url_cases(t):
    """Every page's own address, or one of a shop, two job sites or a scheme that is none, with its number in it."""
    n, key = F.col("page_id").cast("string"), F.col("page_id") % 5
    shop = F.concat(F.lit("HTTPS://WWW.Shop"), n, F.lit(".com/a//?utm_source=x&b="), n, F.lit("&a=1#f"))
    raw = F.when(key == 0, F.col("url")).when(key == 1, shop).when(key == 2, F.concat(F.lit("http://linkedin.com/jobs/view/dev-"), n, F.lit("?trk=z"))).when(key == 3, F.concat(F.lit("https://ar.indeed.com/viewjob?jk=k"), n, F.lit("&from=x")))
    return t.pages.select(F.col("page_id").alias("id"), urls.canonical_url(F.coalesce(raw, F.concat(F.lit("ftp://x.org/"), n))).alias("canonical"))


_MODES, _TONGUES, _BADGES = ["remoto", "remoto", "remoto", "desconocida", "hibrido", "presencial", "remoto"], ["es", "en", "en", "es", "pt"], ["1 de 4 aptitudes", "3 of 4 skills", "x", "2 de 4 aptitudes", "0 of 0 skills"]
_OFFERED_SQL = f"""o AS (SELECT p_partkey AS id, title, {_pick_sql(_MODES, 'p_size')} AS modality, CASE WHEN p_size % 9 > 0 THEN {_pick_sql(_TONGUES, 'p_size')} END AS language, CASE WHEN p_size % 4 > 0 THEN {_pick_sql(_BADGES, 'p_partkey')} END AS badge,
    CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 200 END AS candidates, {_pick_sql(_SOMEWHERE, 'p_size')} AS location, CASE WHEN p_partkey % 8 = 0 THEN ['MX', 'BR'] WHEN p_partkey % 8 = 1 THEN ['*'] WHEN p_partkey % 8 = 2 THEN ['AR'] END AS allowed FROM part JOIN {_TITLE_SQL} AS q ON q.id = p_partkey),
  p AS (SELECT *, {_PADDED} AS w, lower(strip_accents(location)) AS f, CASE badge WHEN '1 de 4 aptitudes' THEN 0.25 WHEN '3 of 4 skills' THEN 0.75 WHEN '2 de 4 aptitudes' THEN 0.5 END AS ratio FROM o),
  h AS (SELECT *, CASE WHEN w LIKE '% vp %' THEN 'vp ' WHEN w LIKE '% manager %' THEN 'manager' WHEN w LIKE '% director %' THEN 'director' END AS blocked, CASE WHEN w LIKE '% marketing %' THEN 'marketing' WHEN w LIKE '% people %' THEN 'people' END AS domain FROM p),
  n AS (SELECT *, CASE WHEN modality IN ('presencial', 'hibrido') OR (modality <> 'remoto' AND regexp_matches(f, '\\b(hybrid)\\b')) THEN 'modalidad_no_remota' WHEN language = 'pt' THEN 'idioma_no_aceptado' WHEN w LIKE '% data engineer %' OR w LIKE '% nurse %' OR domain IS NOT NULL THEN 'disciplina_distinta'
    WHEN ratio < 0.4 THEN 'badge_aptitudes' WHEN blocked IS NOT NULL THEN 'titulo_blocklist' END AS reason FROM h),
  v AS (SELECT *, CASE WHEN modality IN ('presencial', 'hibrido') THEN 'modalidad ' || modality WHEN reason = 'modalidad_no_remota' THEN 'ubicación: ' || location WHEN reason = 'idioma_no_aceptado' THEN 'aviso en pt' WHEN w LIKE '% data engineer %' THEN 'keyword ''data engineer''' WHEN w LIKE '% nurse %' THEN 'oficio ''enfermera'''
    WHEN domain IS NOT NULL THEN 'keyword ''' || domain || '''' WHEN reason = 'badge_aptitudes' THEN 'aptitudes 25 %' WHEN reason = 'titulo_blocklist' THEN '''' || blocked || '''' END AS detail,
    CASE WHEN reason IS NOT NULL THEN CAST([] AS VARCHAR[]) ELSE list_filter([CASE WHEN ratio >= 0.75 THEN 'skills_match_high' END, CASE WHEN CASE WHEN allowed IS NOT NULL THEN NOT list_contains(allowed, '*') AND NOT list_contains(allowed, 'AR') ELSE NOT regexp_matches(f, '(^|[^a-z0-9])argentina') AND (regexp_matches(f, '\\b(latam|remote|remoto)\\b')
      OR regexp_matches(f, '\\b(us|usa)([^a-z0-9]|$)') OR len({_NAMED_SQL}) > 0) END THEN 'location_risk' END, CASE WHEN candidates >= 100 THEN 'many_candidates' END], lambda x: x IS NOT NULL) END AS flags FROM n)"""
_OFFER_RULES = prefilter.Rules(languages=("es", "en"), adjacent=("data engineer",), other_trades=(("enfermera", r"\bnurse\b", ()),), domains=("marketing", "people"), blocklist=("vp ", "manager", "director"), country="AR", countries=_NAMES, outside=_OUT)


def _offered(t) -> DataFrame:
    """Every part as an offer, its columns picked by key and size."""
    key, size = F.col("p_partkey"), F.col("p_size")
    allowed = F.when(key % 8 == 0, F.array(F.lit("MX"), F.lit("BR"))).when(key % 8 == 1, F.array(F.lit("*"))).when(key % 8 == 2, F.array(F.lit("AR")))
    rows = t.part.select(
        key.alias("id"), _pick(_SOMEWHERE, size).alias("location"), _pick(_MODES, size).alias("modality"), F.when(size % 4 > 0, F.array(_pick(_BADGES, key))).alias("badges"), F.when(key % 3 > 0, key % 200).cast("int").alias("candidates"),
        allowed.alias("countries_allowed"), F.lit(None).cast("string").alias("text"), F.when(size % 9 > 0, _pick(_TONGUES, size)).alias("language"),
    )
    return rows.join(_titled(t), "id")


@query(f"WITH {_OFFERED_SQL} SELECT id, reason, detail, CAST(NULL AS DOUBLE) AS cap, flags FROM v")
def prefilter_cases(t):
    return prefilter.prefilter(_offered(t), _OFFER_RULES).select("id", "reason", "detail", "cap", "flags")


@query(f"""WITH {_OFFERED_SQL}, r AS (SELECT id, reason, flags, CASE WHEN id % 3 = 0 THEN reason WHEN id % 3 = 1 THEN 'titulo_blocklist' END AS old FROM v), c AS (SELECT id, reason, flags, reason IS NULL AND old IS NOT NULL AS passes FROM r WHERE reason IS DISTINCT FROM old OR (id % 3 > 0 AND len(flags) > 0))
  SELECT id, reason, flags, passes AND row_number() OVER (PARTITION BY passes ORDER BY id) <= 40 AS enqueue FROM c""")
def reprefilter_changes(t):
    """Stored verdicts of two thirds of the offers are outdated; forty that pass now go to the queue."""
    now = prefilter.prefilter(_offered(t), _OFFER_RULES).select("id", "reason", "flags")
    old = F.when(F.col("id") % 3 == 0, F.col("reason")).when(F.col("id") % 3 == 1, "titulo_blocklist")
    stored = now.select("id", old.alias("old_reason"), F.when(F.col("id") % 3 == 0, F.col("flags")).alias("old_flags"))
    return prefilter.changed_verdicts(_offered(t).join(stored, "id"), _OFFER_RULES, "id", enqueue=40)


_C = decisions.Criteria(disciplines=("ai_engineer", "backend"), accepted=("remoto", "hibrido"), salary_floor=2000, max_hours=44, cloud_penalty=0.5, english_penalty=1.0, years=2, cefr="B1", gap_blocks_from=5)


@query("""WITH o AS (SELECT o_orderkey AS id, least(round(o_totalprice / 50000, 1), CASE WHEN o_orderkey % 10 = 0 THEN 6.0 ELSE 99 END) AS score, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 11 END AS y, o_orderkey % 6 = 0 AS other, CASE WHEN o_orderkey % 3 = 0 THEN 1000 + o_orderkey % 40 * 100 END AS pay,
    CASE WHEN o_orderkey % 4 = 0 THEN 40 + o_orderkey % 10 END AS hours, o_orderkey % 5 = 0 AS cloud, o_orderkey % 7 = 0 AS english, o_orderkey % 8 AS f, o_orderkey % 13 = 0 AS away FROM orders),
  s AS (SELECT *, round(greatest(0.0, least(10.0, CASE WHEN other THEN least(score - 0.5 * coalesce(y BETWEEN 5 AND 7, false)::INT, 3.0) ELSE score - 0.5 * coalesce(y BETWEEN 5 AND 7, false)::INT END - 0.5 * cloud::INT - english::INT)), 2) AS final_score,
    list_filter([CASE WHEN y >= 8 THEN 'años requeridos ≥ 8 (' || y || ')' END, CASE WHEN y = 7 THEN 'gap de años: pide 7 años, tenés 2' END, CASE WHEN other THEN 'disciplina distinta (sales)' END, CASE WHEN pay < 2000 THEN 'salario por debajo del piso (USD ' || pay || '/mes < 2000)' END,
      CASE WHEN hours > 44 THEN 'jornada de ' || hours || ' h (máximo 44)' END, CASE WHEN away THEN 'remoto solo desde CA' END], lambda x: x IS NOT NULL) AS blockers,
    list_filter([CASE WHEN y BETWEEN 4 AND 6 THEN 'pide ' || y || ' años, tenés 2' END, CASE WHEN english THEN 'inglés requerido avanzado, el candidato tiene B1' END, CASE WHEN f = 0 THEN 'ubicación sin confirmar' END, CASE WHEN f = 1 THEN 'muchos candidatos' END], lambda x: x IS NOT NULL) AS risks FROM o)
  SELECT id, final_score, blockers, risks, CASE WHEN away THEN 'no' ELSE 'ok' END AS final_location_ok, CASE WHEN len(blockers) > 0 OR final_score < 5 THEN 'descartar' WHEN len(risks) > 0 THEN CASE WHEN final_score >= 7 THEN 'aplicar' ELSE 'guardar' END WHEN final_score >= 9 THEN 'aplicar_personalizado' WHEN final_score >= 7 THEN 'aplicar' ELSE 'guardar' END AS action FROM s""")
def decision_cases(t):
    """Every order as an evaluated posting; which rules hold for it follows from its key and price."""
    key, none = F.col("o_orderkey"), F.lit(None)
    strings = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    rows = t.orders.select(
        key.alias("id"), F.round(F.col("o_totalprice") / 50000, 1).alias("score"), strings().alias("blockers"), strings().alias("risks"), F.when(key % 2 == 0, key % 11).cast("int").alias("years_required"), none.cast("string").alias("years_discipline"), F.when(key % 6 == 0, "sales").otherwise("backend").alias("discipline"),
        F.lit("remoto").alias("modality"), none.cast("int").alias("salary_min"), F.when(key % 3 == 0, 1000 + key % 40 * 100).cast("int").alias("salary_max"), none.cast("boolean").alias("local_currency"), F.when(key % 4 == 0, 40 + key % 10).cast("int").alias("weekly_hours"), none.cast("array<string>").alias("levels"),
        F.when(key % 7 == 0, "avanzado").otherwise("no_menciona").alias("english_required"), none.cast("boolean").alias("english_moot"), (key % 5 == 0).alias("cloud_must"), F.lit("ok").alias("location_ok"), F.when(key % 10 == 0, 6.0).alias("title_cap"),
        F.when(key % 8 == 0, strings("location_risk")).when(key % 8 == 1, strings("many_candidates")).otherwise(strings()).alias("flags"), F.when(key % 13 == 0, "CA").alias("only_places"),
    )
    return decisions.decide_posting(rows, _C).select("id", "final_score", "blockers", "risks", "final_location_ok", "action")


_SENTENCE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
_MINE_SQL = f"""o AS (SELECT o_orderkey AS id, o_custkey AS who, o_orderkey % 2 = 1 AS fresh, CASE WHEN o_orderkey % 5 > 0 THEN 'x/' || (o_orderkey % 400) END AS url, CASE WHEN o_orderkey % 3 > 0 THEN 'k' || (o_orderkey // 2 % 300) END AS ext, CASE WHEN o_orderkey % 7 = 0 THEN 'h' || (o_orderkey % 90) END AS hash,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'acme' WHEN '2-HIGH' THEN 'zeta' WHEN '3-MEDIUM' THEN 'unknown' ELSE 'umbra' END AS company, CASE o_orderstatus WHEN 'F' THEN ['data', 'engineer', 'python'] WHEN 'O' THEN ['data', 'engineer'] ELSE ['backend', 'go'] END AS tokens,
    CASE WHEN o_orderkey % 4 = 0 THEN '{_SENTENCE}' WHEN o_orderkey % 4 = 1 THEN '{_SENTENCE} ' || CASE WHEN o_orderkey % 3 = 0 THEN 'end' ELSE lower(o_orderpriority) || ' ' || o_orderstatus || ' ' || o_orderpriority END END AS text, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS seen,
    CASE o_orderkey % 6 WHEN 0 THEN 'remoto' WHEN 1 THEN 'presencial' WHEN 2 THEN 'desconocida' END AS modality, CASE WHEN o_orderkey % 8 = 0 THEN 'lima' WHEN o_orderkey % 8 = 3 THEN 'quito' END AS place FROM orders),
  w AS (SELECT *, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS l FROM o), s AS MATERIALIZED (SELECT *, CASE WHEN len(l) > 5 THEN list_distinct([array_to_string(l[i:i+4], ' ') FOR i IN range(1, len(l) - 3)]) END AS g FROM w),
  m AS MATERIALIZED (SELECT a.id, b.id AS job, a.url = b.url AS by_url, a.ext = b.ext AS by_ext, a.hash = b.hash AS by_hash, abs(a.seen - b.seen) <= 400 AS near, len(list_intersect(a.g, b.g)) / CAST(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)) AS DOUBLE) AS alike, len(list_intersect(a.tokens, b.tokens)) / CAST(len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens)) AS DOUBLE) AS close,
    a.company = b.company AND a.company <> 'unknown' AND NOT (a.text IS NOT NULL AND b.text IS NOT NULL) AND NOT coalesce(nullif(a.modality, 'desconocida') <> nullif(b.modality, 'desconocida'), false) AND NOT coalesce(a.place <> b.place, false) AS fits
    FROM s a JOIN s b ON a.who = b.who AND a.fresh AND NOT b.fresh),
  k AS (SELECT id, job, CASE WHEN by_url THEN 'url' WHEN by_ext THEN 'external_id' ELSE 'jd_hash' END AS reason FROM m WHERE by_url OR by_ext OR by_hash QUALIFY row_number() OVER (PARTITION BY id ORDER BY job) = 1),
  x AS (SELECT id, job, alike FROM m WHERE near AND alike >= 0.9 QUALIFY row_number() OVER (PARTITION BY id ORDER BY alike DESC, job) = 1), c AS (SELECT id, job, close FROM m WHERE near AND fits AND close > 0.6 QUALIFY row_number() OVER (PARTITION BY id ORDER BY close DESC, job) = 1)"""


def _postings(t) -> DataFrame:
    """Orders as postings of their customers; the odd ones are new."""
    key, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    half = F.floor(key / 2).cast("long")
    tail = F.when(key % 3 == 0, "end").otherwise(F.concat_ws(" ", F.lower(priority), status, priority))
    tokens = F.when(status == "F", F.array(*map(F.lit, ("data", "engineer", "python")))).when(status == "O", F.array(*map(F.lit, ("data", "engineer")))).otherwise(F.array(*map(F.lit, ("backend", "go"))))
    return t.orders.select(
        key.alias("id"), F.col("o_custkey").alias("user"), F.when(key % 5 > 0, F.concat(F.lit("x/"), (key % 400).cast("string"))).alias("url"), F.when(key % 3 > 0, F.concat(F.lit("k"), (half % 300).cast("string"))).alias("external_key"), F.when(key % 7 == 0, F.concat(F.lit("h"), (key % 90).cast("string"))).alias("hash"),
        F.when(priority == "1-URGENT", "acme").when(priority == "2-HIGH", "zeta").when(priority == "3-MEDIUM", "unknown").otherwise("umbra").alias("company"), tokens.alias("title_tokens"), F.when(key % 4 == 0, _SENTENCE).when(key % 4 == 1, F.concat(F.lit(_SENTENCE + " "), tail)).alias("text"),
        F.datediff("o_orderdate", F.lit("1995-01-01")).cast("long").alias("seen"), F.when(key % 6 == 0, "remoto").when(key % 6 == 1, "presencial").when(key % 6 == 2, "desconocida").alias("modality"), F.when(key % 8 == 0, "lima").when(key % 8 == 3, "quito").alias("location"),
    )


@query(f"""WITH {_MINE_SQL} SELECT o.id, CASE WHEN k.id IS NOT NULL OR x.id IS NOT NULL THEN 'merge' ELSE 'insert' END AS kind, coalesce(k.job, x.job, c.job) AS job, CASE WHEN k.id IS NOT NULL THEN k.reason WHEN x.id IS NOT NULL THEN 'jd_text' WHEN c.id IS NOT NULL THEN 'company_title' END AS reason,
  CASE WHEN k.id IS NOT NULL THEN 1.0 ELSE coalesce(x.alike, c.close) END AS similarity, CASE WHEN k.id IS NULL AND x.id IS NOT NULL THEN ['volume_recruiting'] ELSE CAST([] AS VARCHAR[]) END AS flags FROM o LEFT JOIN k USING (id) LEFT JOIN x USING (id) LEFT JOIN c USING (id) WHERE o.fresh""")
def user_dedup_cases(t):
    rows = _postings(t)
    recent = rows.where("id % 2 = 0").withColumn("external_keys", F.array_compact(F.array("external_key"))).drop("external_key")
    return user_duplicates(rows.where("id % 2 = 1"), recent, window=400)


@query("SELECT name_normalized, min(name) AS name FROM (SELECT lower(trim(s_name)) AS name_normalized, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'customer', c_mktsegment FROM customer) GROUP BY 1")
def company_inserts(t):
    known = t.supplier.where("s_suppkey % 4 = 0").select(F.lower(F.trim("s_name")).alias("name_normalized"), F.col("s_name").alias("name"))
    seen = t.supplier.where("s_suppkey % 2 = 0").select(F.lower(F.trim("s_name")).alias("name_normalized"), F.col("s_name").alias("name")).union(t.customer.select(F.lit("customer"), "c_mktsegment"))
    return insert_companies(known, seen)


@query("SELECT event_id, CASE WHEN last IS NULL THEN 'ok' WHEN s - last < 10 THEN 'floor' WHEN event_type = 'click' THEN 'ok' WHEN s - last < 600 THEN 'window' ELSE 'ok' END AS verdict FROM (SELECT event_id, event_type, epoch_us(ts) // 1000000 AS s, lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events)")
def recompute_verdicts(t):
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    last = F.lag(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("event_id", decisions.recompute_allowed(at, last, F.col("event_type") == "click").alias("verdict"))


@query("""SELECT c_mktsegment, CAST(sum(CASE WHEN o_orderstatus IN ('O', 'P') THEN 1 ELSE 0 END) AS BIGINT) AS recommended, CAST(sum(CASE WHEN o_orderstatus IN ('O', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS reviewed FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def review_progress(t):
    action = F.when(F.col("o_orderstatus") == "O", "aplicar").when(F.col("o_orderstatus") == "P", "aplicar_personalizado").otherwise("guardar")
    total, reviewed = decisions.progress(F.col("o_orderpriority"), action, ("1-URGENT", "2-HIGH"))
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(total.alias("recommended"), reviewed.alias("reviewed"))
