"""Text queries: normalisation, languages, hashes, similarity, rules and duplicates on ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.functions import english, redaction, similarity, text, urls
from sievelake.functions.sketches import sketches as text_sketches
from sievelake.operators.core import anti_join_any, first_match
from sievelake.operators.dedup import pool_duplicates
from sievelake.plans.registry import query

_FOLD = "lower(strip_accents({}))"
_WORDS = "list_filter(string_split_regex(regexp_replace(" + _FOLD + ", '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"SELECT doc_id, len({_WORDS.format('text')}) AS n_words, md5(array_to_string({_WORDS.format('text')}, ' ')) AS folded_md5 FROM documents")
def fold_words(t):
    w = text.words(F.col("text"))
    return t.documents.select("doc_id", F.size(w).cast("long").alias("n_words"), F.md5(F.array_join(w, " ")).alias("folded_md5"))


@query(r"SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')))) AS jd_hash FROM documents")
def content_hashes(t):
    return t.documents.select("doc_id", text.content_hash(F.col("text")).alias("jd_hash"))


@query(r"""WITH h AS (SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')))) AS jd_hash FROM documents)
  SELECT jd_hash, min(doc_id) AS root, count(*) AS copies FROM h GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicates(t):
    h = t.documents.select("doc_id", text.content_hash(F.col("text")).alias("jd_hash"))
    return h.groupBy("jd_hash").agg(F.min("doc_id").alias("root"), F.count("*").alias("copies")).where("copies > 1")


_HITS = {k: f"len(list_filter(regexp_extract_all({_FOLD.format('text')}, '[a-z]+'), lambda x: list_contains({_sql_list(v)}, x)))" for k, v in text.LANGUAGE_WORDS.items()}


@query(f"""SELECT doc_id, CASE WHEN left(lower(trim(declared)), 2) IN ('en', 'es', 'pt') THEN left(lower(trim(declared)), 2) WHEN en >= 8 AND en >= 2 * greatest(es, pt) THEN 'en' WHEN es >= 8 AND es >= 2 * greatest(en, pt) THEN 'es' WHEN pt >= 8 AND pt >= 2 * greatest(en, es) THEN 'pt' END AS language
  FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN lang END AS declared, {_HITS['en']} AS en, {_HITS['es']} AS es, {_HITS['pt']} AS pt FROM documents)""")
def language_stopwords(t):
    declared = F.when(F.col("doc_id") % 4 == 0, F.col("lang"))
    return t.documents.select("doc_id", text.job_language(F.col("text"), declared).alias("language"))


@query(r"SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '[email]', 'g') AS masked, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS emails FROM documents")
def mask_emails(t):
    pattern = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    return t.documents.select("doc_id", text.mask_emails(F.col("text")).alias("masked"), F.regexp_count("text", F.lit(pattern)).cast("long").alias("emails"))


@query()
def mask_contacts(t):
    return t.documents.select("doc_id", text.mask_phones(text.mask_emails(F.col("text"))).alias("masked"))


_NAME = "lower(split_part(x, '=', 1))"
_KEPT = f"list_sort(list_filter(string_split(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT list_contains({_sql_list(urls.TRACKING)}, {_NAME}) AND NOT starts_with({_NAME}, 'utm_')))"


@query(f"""SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND host <> '' THEN scheme || '://' || host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM (
  SELECT page_id, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '') AS host,
  regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, {_KEPT} AS kept FROM (SELECT page_id, trim(url) AS u FROM pages))""")
def canonical_urls(t):
    return t.pages.select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query("""WITH h AS (SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host FROM pages), d AS (SELECT array_to_string(string_split(host, '.')[-2:], '.') AS domain, host FROM h)
  SELECT domain, count(*) AS n, count(DISTINCT host) AS hosts FROM d GROUP BY 1""")
def sender_domains(t):
    host = urls.host_of(F.col("url"))
    return t.pages.select(host.alias("host"), urls.base_domain(host).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"))


@query("""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host FROM pages), f AS (SELECT host, min(page_id) AS first_page, count(*) AS n FROM h GROUP BY 1)
  SELECT host, first_page, n FROM f WHERE first_page >= 100""")
def filter_leak_new_domains(t):
    """Hosts first seen after the known period (the first hundred pages)."""
    h = t.pages.select("page_id", urls.host_of(F.col("url")).alias("host"))
    return h.groupBy("host").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")).where("first_page >= 100")


def _sql_html(column: str) -> str:
    x = rf"regexp_replace({column}, '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])\s*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        x = f"replace({x}, '{entity}', {char})"
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, {_sql_html('html')} AS body FROM pages")
def html_bodies(t):
    return t.pages.select("page_id", text.html_to_text(F.col("html")).alias("body"))


@query("""SELECT s_suppkey, array_to_string(list_filter(string_split_regex(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''), ' ') AS company FROM supplier""")
def company_names(t):
    return t.supplier.select("s_suppkey", text.company_name(F.col("s_name")).alias("company"))


_DROP = _sql_list((*text.SENIORITY, *text.TITLE_STOPWORDS))


@query(f"""SELECT p_partkey, list_filter(w, lambda x, i: NOT list_contains({_DROP}, x) AND NOT regexp_matches(x, '^(id[0-9]+|[0-9]+)$') AND list_position(w, x) = i) AS tokens FROM (
  SELECT p_partkey, list_filter(string_split_regex(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM part)""")
def title_tokens(t):
    return t.part.select("p_partkey", text.title_tokens(F.col("p_name")).alias("tokens"))


@query(f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), s AS (SELECT doc_id, CASE WHEN len(w) > 5 THEN list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d)
  SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s""")
def shingle_counts(t):
    return t.documents.select("doc_id", F.size(similarity.shingles(F.col("text"))).cast("long").alias("n_shingles"))


@query(f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), s AS (SELECT doc_id, CASE WHEN len(w) > 5 THEN list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d)
  SELECT doc_id, list_sort(list_distinct([list_reduce(list_prepend(CAST(2166136261 AS BIGINT), [CAST(ascii(c) AS BIGINT) FOR c IN string_split(x, '')]), lambda h, c: (xor(h, c) * 16777619) % 4294967296) FOR x IN sh]))[1:512] AS sketch FROM s""")
def sketches(t):
    return text_sketches(t.documents)


@query("""SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 7 = 0 AND (o.doc_id = d.doc_id OR o.text = d.text OR o.n_chars = d.n_chars))""")
def owned_anti_three_keys(t):
    d = t.documents.select("doc_id", "n_chars", F.xxhash64("text").alias("text_hash"))
    return anti_join_any(d, d.where("doc_id % 7 = 0"), ["doc_id", "text_hash", "n_chars"]).select("doc_id")


@query(r"""SELECT doc_id, CASE WHEN n_chars < 100 THEN 'too_short' WHEN lang NOT IN ('en', 'es') THEN 'language' WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'symbols' WHEN regexp_matches(text, '(?i)\b(password|token)\b') THEN 'secret' WHEN source IN ('src1', 'src2') THEN 'source' END AS reason,
  list_filter([CASE WHEN n_chars > 10000 THEN 'very_long' END, CASE WHEN contains(text, '|') THEN 'table' END], lambda x: x IS NOT NULL) AS flags FROM documents""")
def prefilter_reasons(t):
    """The first rule that holds names the reason; flags gather independently."""
    rules = [
        (F.col("n_chars") < 100, "too_short"),
        (~F.col("lang").isin("en", "es"), "language"),
        (F.col("text").rlike("[#$%&*]{3}"), "symbols"),
        (F.col("text").rlike(r"(?i)\b(password|token)\b"), "secret"),
        (F.col("source").isin("src1", "src2"), "source"),
    ]
    flags = F.array_compact(F.array(F.when(F.col("n_chars") > 10000, "very_long"), F.when(F.contains("text", F.lit("|")), "table")))
    return t.documents.select("doc_id", first_match(rules).alias("reason"), flags.alias("flags"))


@query(r"""WITH f AS (SELECT CASE WHEN n_chars < 100 THEN 'too_short' WHEN lang NOT IN ('en', 'es') THEN 'language' WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'symbols' WHEN regexp_matches(text, '(?i)\b(password|token)\b') THEN 'secret' WHEN source IN ('src1', 'src2') THEN 'source' ELSE 'entered' END AS reason FROM documents)
  SELECT reason, count(*) AS n FROM f GROUP BY 1""")
def explain_stages(t):
    return prefilter_reasons(t).groupBy(F.coalesce("reason", F.lit("entered")).alias("reason")).agg(F.count("*").alias("n"))


@query(r"""WITH h AS (SELECT doc_id, n_chars, source, sha256(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')))) AS hash FROM documents), g AS (SELECT hash, min(doc_id) AS root FROM h GROUP BY 1)
  SELECT root, min(doc_id) AS first_id, max(n_chars) AS n_chars, list_sort(list_distinct(list(source))) AS sources, count(*) AS copies FROM h JOIN g USING (hash) GROUP BY 1""")
def merge_survivors(t):
    """Copies merged into the earliest: longest text, all sources."""
    h = t.documents.select("doc_id", "n_chars", "source", text.content_hash(F.col("text")).alias("hash"))
    g = h.groupBy("hash").agg(F.min("doc_id").alias("root"), F.min("doc_id").alias("first_id"), F.max("n_chars").alias("n_chars"), F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("copies"))
    return g.drop("hash")


_SETS = "CASE WHEN len(w) > 5 THEN list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END"


@query(rf"""WITH RECURSIVE t AS MATERIALIZED (SELECT *, {_WORDS.format('text')} AS w FROM documents), d AS MATERIALIZED (SELECT doc_id AS id, source, CASE WHEN doc_id % 5 = 0 THEN lang || '/' || n_chars END AS url, CASE WHEN trim(text) <> '' THEN sha256(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')))) END AS hash, {_SETS} AS s, n_chars % 997 AS ext FROM t),
  k AS (SELECT *, min(id) OVER (PARTITION BY source, ext) AS first FROM d), f AS (SELECT * FROM k WHERE id = first),
  m AS (SELECT a.id, b.id AS to_id, CASE WHEN a.url = b.url THEN 'url' WHEN a.hash = b.hash THEN 'jd_hash' ELSE 'jd_text' END AS reason, CASE WHEN coalesce(a.url = b.url, false) OR coalesce(a.hash = b.hash, false) THEN 1.0 ELSE len(list_intersect(a.s, b.s)) / CAST(len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)) AS DOUBLE) END AS similarity
    FROM f a JOIN f b ON b.id < a.id AND a.id - b.id <= 300 AND (a.url = b.url OR a.hash = b.hash OR (a.source = b.source AND len(a.s) > 0 AND len(b.s) > 0))),
  o AS (SELECT id, to_id, reason, similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY to_id) AS rn FROM m WHERE similarity >= 0.9) WHERE rn = 1),
  r AS (SELECT id, id AS root FROM f WHERE id NOT IN (SELECT id FROM o) UNION ALL SELECT o.id, r.root FROM o JOIN r ON r.id = o.to_id)
  SELECT k.id, r.root, CASE WHEN k.id <> k.first THEN 'same' ELSE coalesce(o.reason, 'new') END AS reason, CASE WHEN k.id <> k.first THEN 1.0 ELSE o.similarity END AS similarity FROM k JOIN r ON r.id = k.first LEFT JOIN o ON o.id = k.id""")
def pool_dedup_roots(t):
    """Some rows share a url with others of their language and length; rows of a source with one external id are the same."""
    url = F.when(F.col("doc_id") % 5 == 0, F.concat_ws("/", "lang", F.col("n_chars").cast("string")))
    docs = t.documents.select(F.col("doc_id").alias("id"), "source", (F.col("n_chars") % 997).cast("string").alias("external_id"), url.alias("url"), F.col("source").alias("company"), F.col("doc_id").alias("seen"), "text")
    return pool_duplicates(docs, window=300)


@query()
def redactions(t):
    """Every kind of personal data in a text, counted, marked and looked for again."""
    r = t.documents.select("doc_id", redaction.redacted(F.col("text")).alias("r"))
    n = lambda kind: F.coalesce(F.try_element_at("r.counts", F.lit(kind)), F.lit(0)).alias(kind)
    return r.select("doc_id", *[n(k) for k in redaction.FINDERS], F.md5("r.text").alias("redacted_md5"), F.size("r.residual").alias("residual"))


@query()
def english_facts(t):
    return english.language_facts(t.documents)


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b')) AS addresses, len(regexp_extract_all(text, '\b[0-9a-f]{32,64}\b')) AS keys, len(regexp_extract_all(text, '\b[0-9]{16}\b')) AS cards FROM documents""")
def redaction_counts(t):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return t.documents.select("doc_id", n(r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b").alias("addresses"), n(r"\b[0-9a-f]{32,64}\b").alias("keys"), n(r"\b[0-9]{16}\b").alias("cards"))
