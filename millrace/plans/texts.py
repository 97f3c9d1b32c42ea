"""Texts, addresses and duplicates over the documents and pages tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import classifiers, facts, identity, scoring, text, urls
from millrace.functions.requirement_rows import requirement_rows
from millrace.operators import evidence
from millrace.operators.dedup import duplicate_links, keep_first
from millrace.plans.registry import query
from millrace.tables import dealt, kept, table

WORDS_SQL = "trim(regexp_replace(replace(lower(regexp_replace(text, '[̀-ͯ]', '', 'g')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT doc_id, {WORDS_SQL} AS words, CASE WHEN length({WORDS_SQL}) >= 250 THEN sha256({WORDS_SQL}) END AS signature FROM documents")
def word_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal words and a long text's hash, without decomposition (accented letters part words), as SQL can say it."""
    w = text.ascii_words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", w.alias("words"), identity.description_signature(w).alias("signature"))


#: Normal words of a text without markup, accents taken off.
PLAIN_SQL = "trim(regexp_replace(replace(lower(strip_accents(text)), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT doc_id, CAST(length({PLAIN_SQL}) AS BIGINT) AS n, CASE WHEN length({PLAIN_SQL}) >= 250 THEN sha256({PLAIN_SQL}) END AS signature FROM documents")
def description_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As word_signatures, with accents decomposed and markup cleaned."""
    w = text.words(text.clean_html("text"))
    return table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).select("doc_id", F.length("w").cast("long").alias("n"), identity.description_signature(F.col("w")).alias("signature"))


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def exact_copies_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each exact text; only hashes are shuffled, not texts."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("h"))
    return keep_first(rows, F.col("h"), [F.col("doc_id")]).drop("h")


@query("""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, regexp_matches(url, '[?&]utm_source(=|&|$)') AS tracked, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) = 'example.net' OR ends_with(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '.example.net') AS matches FROM pages""")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = urls.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", h.alias("host"), urls.has_parameter(F.col("url"), "utm_source").alias("tracked"), urls.host_matches(h, "example.net").alias("matches"))


@query("SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, count(*) AS n, count(DISTINCT url) AS n_urls FROM pages GROUP BY 1")
def pages_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.count_distinct("url").alias("n_urls"))


@query()
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url", urls.normalize_url("url").alias("canonical"))
    return p.select("page_id", "canonical", F.concat(F.lit("posting:v1:"), F.sha2(F.coalesce(F.concat(F.lit("requisition|"), urls.requisition_key("url")), F.col("canonical")), 256)).alias("identity"), urls.platform(F.col("url"), F.lit("feed"), F.lit(None).cast("string")).alias("platform"))


@query()
def cleaned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of whole pages."""
    return table(spark, sf_dir, "pages").select("page_id", text.clean_html("html").alias("text"))


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, regexp_extract(html, '<html[^>]*lang=\"([a-z]+)\"', 1) AS declared, len(regexp_extract_all(html, '<a ')) AS n_links FROM pages")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract(p, "<title>([^<]*)</title>", 1)).alias("title"), F.regexp_extract(p, '<html[^>]*lang="([a-z]+)"', 1).alias("declared"), F.regexp_count(p, F.lit("<a ")).cast("long").alias("n_links"))


def marker_sql(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '(?i)(https?://|www\\.)[^\\s]+', ' ', 'g')), '\\p{{L}}+') AS tokens FROM documents)
SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, {", ".join(f"CAST(len(list_filter(tokens, lambda x: list_contains({marker_sql(w)}, x))) AS BIGINT) AS hits_{k}, CAST(len(list_distinct(list_filter(tokens, lambda x: list_contains({marker_sql(w)}, x)))) AS BIGINT) AS kinds_{k}" for k, w in [("en", classifiers.ENGLISH), *classifiers.PROFILES.items()])} FROM t""")
def language_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker words of four languages: how many a text has and how many different ones."""
    t = table(spark, sf_dir, "documents").select("doc_id", classifiers.letter_tokens(F.col("text")).alias("tokens"))
    out = [F.size("tokens").cast("long").alias("n_tokens")]
    for k, w in [("en", classifiers.ENGLISH), *classifiers.PROFILES.items()]:
        hits, kinds = classifiers.marker_hits(F.col("tokens"), w)
        out += [hits.cast("long").alias(f"hits_{k}"), kinds.cast("long").alias(f"kinds_{k}")]
    return t.select("doc_id", *out)


FOREIGN_SQL = " OR ".join(f"(hits_{k} >= 5 AND kinds_{k} >= 3 AND hits_{k} >= greatest(hits_en * 1.25, hits_en + 2))" for k in classifiers.PROFILES)


@query(f"""WITH t AS (SELECT doc_id, text, regexp_extract_all(lower(regexp_replace(text, '(?i)(https?://|www\\.)[^\\s]+', ' ', 'g')), '\\p{{L}}+') AS tokens FROM documents),
c AS (SELECT doc_id, len(tokens) AS n, len(regexp_extract_all(text, '\\p{{L}}')) AS letters, len(regexp_extract_all(text, '[\\p{{Cyrillic}}\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Arabic}}\\p{{Hangul}}\\p{{Greek}}\\p{{Hebrew}}]')) AS other,
{", ".join(f"len(list_filter(tokens, lambda x: list_contains({marker_sql(w)}, x))) AS hits_{k}, len(list_distinct(list_filter(tokens, lambda x: list_contains({marker_sql(w)}, x)))) AS kinds_{k}" for k, w in [("en", classifiers.ENGLISH), *classifiers.PROFILES.items()])} FROM t)
SELECT doc_id, (other >= 6 AND (other / greatest(letters, 1) >= 0.65 OR (other / greatest(letters, 1) >= 0.3 AND hits_en < 4))) OR (n >= 8 AND ({FOREIGN_SQL})) AS is_foreign FROM c""")
def foreign_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", classifiers.foreign_language(F.col("text")).alias("is_foreign"))


RULES = [("Thin role rejected", "than|thand", ""), ("Ending role rejected", "ending|inging", "the"), ("Mixed role rejected", "ist|que", "")]
RULES_SQL = "CASE " + " ".join(f"WHEN regexp_matches(t, '(?i)(^|[^A-Za-z0-9_])({w})([^A-Za-z0-9_]|$)')" + (f" AND NOT regexp_matches(t, '(?i)(^|[^A-Za-z0-9_])({u})([^A-Za-z0-9_]|$)')" if u else "") + f" THEN '{r}'" for r, w, u in RULES) + " END"


@query(f"SELECT doc_id, {RULES_SQL} IS NULL AS passes, coalesce({RULES_SQL}, 'Passed regex pre-filter') AS reason FROM (SELECT doc_id, text AS t FROM documents)")
def first_matching_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules over whole texts: the first that holds gives the reason."""
    reason = classifiers.first_rule(F.col("text"), RULES)
    return table(spark, sf_dir, "documents").select("doc_id", reason.isNull().alias("passes"), F.coalesce(reason, F.lit(classifiers.PASSED)).alias("reason"))


#: What is put before and after a text, by doc_id in turn: pages that are gone, closed, shells, sites or requests, what only looks like them, duties, qualifications and cut ends.
WRAPS = [
    ("", ""), ("404 Not Found. ", ""), ("HTTP: 404 ", ""), ("Call 1-888-404-2494 now. ", ""), ("The page you were looking for doesn't exist. ", ""), ("", " This position has been filled."), ("", " Applications are no longer accepted for this posting!"), ("", " If the position is filled, applications may close."), ("", " Until then; the job is closed"),
    ("", " Once the requisition is cancelled"), ("Cookie preferences. Accept all cookies. ", ""), ("Manage cookies. Your requirements: ", ""), ("Join Remote OK. Frontpage. Dark mode. Top jobs. ", ""), ("Join Remote OK. Frontpage. Dark mode. ", ""), ("Returning applicant? Sign in to apply. ", ""), ("Search jobs. Key duties. Diploma. ", ""),
    ("Saved jobs. Responsibilities. ", ""), ("What the job actually is. ", ""), ("This role is broad and involves much. ", ""), ("You maintain some large territories. ", ""), ("You need more. ", ""), ("Key accountabilities. Previous experience. ", ""), ("What we’re looking for. What you’ll work on. ", ""), ("Your impact. ", "..."), ("Who you are. In this role ", "…"), ("2+ years. ", ""),
]
WRAP_SQL = ", ".join("({}, '{}', '{}')".format(i, *[w.replace("'", "''") for w in pair]) for i, pair in enumerate(WRAPS))


def re_sql(value: str, *patterns: str) -> str:
    """SQL for whether one of the patterns is found."""
    return "(" + " OR ".join(f"regexp_matches({value}, '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


BEFORE_SQL = "regexp_extract(s, '(?s)^(.*?)" + classifiers.CLOSED.replace("'", "''") + "', 1)"
SHELL_TEXT = classifiers.PAGE_SHELL


@query(rf"""WITH w AS (SELECT doc_id, source, trim(regexp_replace(concat(head, text, tail), '[\s\x00]+', ' ', 'g')) AS t FROM documents JOIN (VALUES {WRAP_SQL}) v(i, head, tail) ON doc_id % {len(WRAPS)} = v.i),
f AS (SELECT *, length(t) AS n, {re_sql('t', *classifiers.DUTIES)} AS duties, {re_sql('t', *classifiers.QUALIFICATIONS)} AS qualifications, {re_sql('t', classifiers.GONE)} AS gone, {re_sql('t', classifiers.COOKIES)} AND NOT {re_sql('t', classifiers.WORK)} AS cookies, {re_sql('t', classifiers.SHELL)} AS shell,
  {re_sql('t', classifiers.SITE)} AND {' + '.join(f"CAST({re_sql('t', p)} AS INT)" for p in classifiers.NAVIGATION)} >= 3 AS chrome,
  len(list_filter(regexp_split_to_array(t, '[.!?;\n]'), lambda s: {re_sql('s', classifiers.CLOSED)} AND NOT ({re_sql(BEFORE_SQL, classifiers.CONDITION)} AND {re_sql(BEFORE_SQL, classifiers.APPLYING)}))) > 0 AS closed FROM w),
r AS (SELECT doc_id, CASE WHEN t = '' OR gone OR closed OR (cookies AND n < 2000) OR chrome OR (shell AND NOT (duties AND qualifications)) THEN '{SHELL_TEXT}' WHEN n < 650 THEN 'fewer than 650 usable characters' WHEN regexp_matches(t, '(?:\.\.\.|…)$') AND n < 2000 THEN 'visibly truncated description'
  WHEN source = 'src0' OR n >= 1500 THEN NULL WHEN NOT duties THEN 'no usable role duties' WHEN NOT qualifications THEN 'no usable qualifications' END AS reason FROM f) SELECT doc_id, reason IS NULL AS scorable, reason FROM r""")
def scorable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with parts of pages around them: whether they can be scored, else why not."""
    wrap = lambda k: F.element_at(F.array(*[F.lit(w[k]) for w in WRAPS]), (F.col("doc_id") % len(WRAPS) + 1).cast("int"))
    q = classifiers.description_quality(F.concat(wrap(0), F.col("text"), wrap(1)), F.col("source") == "src0")
    return table(spark, sf_dir, "documents").select("doc_id", q.alias("q")).select("doc_id", "q.scorable", "q.reason")


@query("""SELECT doc_id, '$' || format('{:,}', 50000 + doc_id % 40000) || '–$95,000 base' AS pay, 'up to ' || (doc_id % 90 + 10) || '%' AS travel FROM documents""")
def stated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pay and travel of texts to which a statement of them is added."""
    said = F.concat(F.col("text"), F.lit(". Base pay range $"), F.format_number(F.lit(50_000) + F.col("doc_id") % 40_000, 0), F.lit(" - $95,000. Travel up to "), (F.col("doc_id") % 90 + 10).cast("string"), F.lit("% of the time."))
    return table(spark, sf_dir, "documents").select("doc_id", facts.posted_base_pay(said).alias("pay"), facts.posted_travel(said).alias("travel"))


SIGNALS = [("join", r"\band\b", 3, 4), ("the", r"\bthe\b", 1, 10), ("und", r"\bund\b", 2, 5), ("que", r"\bque\b", 2, 5)]


@query("""WITH c AS (SELECT doc_id, len(regexp_extract_all(lower(text), '\\band\\b')) AS a, len(regexp_extract_all(lower(text), '\\bthe\\b')) AS b, len(regexp_extract_all(lower(text), '\\bund\\b')) AS c, len(regexp_extract_all(lower(text), '\\bque\\b')) AS d FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS text FROM documents))
SELECT doc_id, CAST(least(least(a, 4) * 3 + least(b, 10) + least(c, 5) * 2 + least(d, 5) * 2, 24) AS INTEGER) AS points, CAST((a > 0)::INT + (b > 0)::INT + (c > 0)::INT + (d > 0)::INT AS INTEGER) AS kinds, CAST(a + b + c + d AS INTEGER) AS hits, CAST(greatest(0, least(100, 30 + least(least(a, 4) * 3 + least(b, 10) + least(c, 5) * 2 + least(d, 5) * 2, 24))) AS INTEGER) AS score FROM c""")
def signal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted, saturating signals; other than ASCII letters are put aside so that both regex dialects see the same word edges."""
    t = F.lower(F.regexp_replace("text", r"[^\x00-\x7F]", "x"))
    p = table(spark, sf_dir, "documents").select("doc_id", scoring.signal_points(t, SIGNALS, 24).alias("s"))
    return p.select("doc_id", F.col("s.points").cast("int").alias("points"), F.col("s.kinds").cast("int").alias("kinds"), F.col("s.hits").cast("int").alias("hits"), scoring.heuristic_score(30, [F.col("s.points")], []).alias("score"))


@query("SELECT b.item_id, count(*) AS n_docs FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def exact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each benchmark passage is found word for word: one pass over each document for all passages."""
    passages = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    found = evidence.find_all(table(spark, sf_dir, "documents").select("doc_id", "text"), passages, "doc_id", "text", "item_id")
    return found.select("item_id", "doc_id").distinct().groupBy("item_id").agg(F.count("*").alias("n_docs"))


@query("""WITH w AS (SELECT DISTINCT substr(text, 1, 3) AS q FROM benchmark), n AS (SELECT q, row_number() OVER (ORDER BY q) AS quote_id FROM w)
SELECT doc_id, quote_id, i AS start, i + 3 AS "end" FROM (SELECT doc_id, text, unnest(range(length(text) - 2)) AS i FROM documents WHERE length(text) >= 3) d JOIN n ON substr(d.text, CAST(d.i + 1 AS INT), 3) = n.q""")
def located_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of the passages' first three letters in all documents, also within words and over one another."""
    quotes = table(spark, sf_dir, "benchmark").select(F.substring("text", 1, 3).alias("quote")).distinct().withColumn("quote_id", F.row_number().over(Window.orderBy("quote")))
    return evidence.find_all(table(spark, sf_dir, "documents").select("doc_id", "text"), quotes, "doc_id", "text")


#: Parts as descriptions, in SQL that both engines read alike: the lines before each requirement, and the whole.
LINES = {
    "years": "concat(p_name, ' is what we sell.\n\n  Requirements:\n')",
    "licence": "concat('- ', 1 + p_partkey % 9, '+ years of ', p_type, ' sales; valid driver''s license\n')",
    "soft": "concat('- Must know ', p_brand, ', and 3 references preferred\n')",
    "optional": "concat('You can say no, a degree is not required, but must travel.\nNice to have\n\t* Knows ', p_name, ', and 2 others\n')",
    "rest": "concat('Benefits\n😀 You must like ', p_brand, '. Pay is good! At least ', p_partkey % 5, ' days off, minimum.\nCompensation:\nYou must be rich.\n')",
    "items": "concat('Role-defining qualifications\nPreferred verification item: ', p_brand, ' badge\nRequired verification item: seal of ', p_type)",
}
DESCRIPTION = f"concat({', '.join(LINES.values())})"
REQUIREMENT_ID = "'req-' || substr(sha256(classification || chr(0) || lower(regexp_replace(text, '[.;:,]+$', ''))), 1, 24)"


@query(f"""WITH d AS (SELECT *, length({LINES['years']}) AS a, length({LINES['licence']}) AS b, length({LINES['soft']}) AS c, length({LINES['optional']}) AS e, length({LINES['rest']}) AS f FROM part WHERE p_partkey % 3 <> 0),
r AS (SELECT p_partkey, concat(1 + p_partkey % 9, '+ years of ', p_type, ' sales') AS text, 'required' AS classification, 'REQUIRED EXPERIENCE' AS section, 'explicit_section' AS source, a AS start, a + b - 1 AS "end" FROM d
UNION ALL SELECT p_partkey, 'valid driver''s license', 'required', 'REQUIRED EXPERIENCE', 'explicit_section', a, a + b - 1 FROM d
UNION ALL SELECT p_partkey, concat('Knows ', p_name), 'preferred', 'PREFERRED EXPERIENCE', 'explicit_section', a + b + c + length('You can say no, a degree is not required, but must travel.') + length('Nice to have') + 3, a + b + c + e - 1 FROM d
UNION ALL SELECT p_partkey, '2 others', 'preferred', 'PREFERRED EXPERIENCE', 'explicit_section', a + b + c + length('You can say no, a degree is not required, but must travel.') + length('Nice to have') + 3, a + b + c + e - 1 FROM d
UNION ALL SELECT p_partkey, concat('😀 You must like ', p_brand, '.'), 'required', 'OTHER', 'mandatory_language', a + b + c + e + 9, a + b + c + e + 9 + length('😀 You must like ') + length(p_brand) + 1 FROM d
UNION ALL SELECT p_partkey, concat('At least ', p_partkey % 5, ' days off, minimum.'), 'required', 'OTHER', 'mandatory_language', a + b + c + e + 9 + length('😀 You must like ') + length(p_brand) + 1 + length(' Pay is good! '), a + b + c + e + 9 + length('😀 You must like ') + length(p_brand) + 1 + length(' Pay is good! At least 1 days off, minimum.') FROM d
UNION ALL SELECT p_partkey, concat(p_brand, ' badge'), 'preferred', 'ROLE-DEFINING QUALIFICATIONS', 'explicit_section', a + b + c + e + f + 29, a + b + c + e + f + 29 + length('Preferred verification item: ') + length(p_brand) + 6 FROM d
UNION ALL SELECT p_partkey, concat('seal of ', p_type), 'required', 'ROLE-DEFINING QUALIFICATIONS', 'explicit_section', a + b + c + e + f + 29 + length('Preferred verification item: ') + length(p_brand) + 7, a + b + c + e + f + 29 + length('Preferred verification item: ') + length(p_brand) + 7 + length('Required verification item: seal of ') + length(p_type) FROM d
UNION ALL SELECT p_partkey, concat('Primary core function of the ', p_name), 'required', 'OTHER', 'core_function', 0, 0 FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 0
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 <> 0)
SELECT p_partkey, {REQUIREMENT_ID} AS requirement_id, text, classification, section, source, start, "end", CASE WHEN text IS NOT NULL THEN source <> 'core_function' AND classification = 'required' END AS mandatory, CASE WHEN text IS NULL THEN 'too_many' END AS fault FROM r""")
def stated_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as descriptions: the requirements that each states, with their places; some state none and some too many."""
    many = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(33)), lambda i: F.concat(F.lit("Must do "), i)), ". ")
    k = F.col("p_partkey")
    text_ = F.when(k % 3 != 0, F.expr(DESCRIPTION)).when(k % 2 == 0, F.lit("Nothing is asked here")).otherwise(many)
    d = table(spark, sf_dir, "part").select("p_partkey", "p_name", text_.alias("description"))
    made = requirement_rows(d, "description", "p_name", [r"(?i)\bpay transparency\b"])
    return made.select("p_partkey", "requirement_id", "text", "classification", "section", "source", "start", "end", "mandatory", "fault")


#: Documents as vectors, in SQL that both engines read alike: (job_id, pos, evidence_id, quote, source, field, low, high) and (job_id, pos, question, answer, cited).
VECTORS = "SELECT doc_id AS job_id, text, source AS company FROM documents WHERE length(text) >= 60"
EVIDENCE_SQL = """SELECT job_id, 0 AS pos, 'a' AS evidence_id, substr(text, 1, 12) AS quote, 'original_jd' AS source, NULL AS field, 0 AS low, 12 AS high FROM v
UNION ALL SELECT job_id, 1, 'b', substr(text, 31, 6), 'original_jd', NULL, 30, 36 FROM v
UNION ALL SELECT job_id, 2, 'c', 'never said', 'original_jd', NULL, 40, 50 FROM v WHERE job_id % 4 = 0
UNION ALL SELECT job_id, 3, 'b', substr(text, 51, 5), 'original_jd', NULL, 50, 55 FROM v WHERE job_id % 6 = 0
UNION ALL SELECT job_id, 4, 'f', substr(text, 21, 4), 'original_jd', NULL, 20, 24 FROM v WHERE job_id % 9 = 0
UNION ALL SELECT job_id, 5, 'd', 'rit', 'trusted_metadata', 'title', 1, 4 FROM v WHERE job_id % 5 = 0
UNION ALL SELECT job_id, 6, 'e', 'x', 'trusted_metadata', NULL, 0, 1 FROM v WHERE job_id % 7 = 0
UNION ALL SELECT job_id, 7, 'g', repeat('long', 90), 'trusted_metadata', 'title', 0, 360 FROM v WHERE job_id % 15 = 0"""
ANSWERS_SQL = """SELECT job_id, 0 AS pos, 'q1' AS question, 'yes' AS answer, CASE WHEN job_id % 8 = 0 THEN 'a,zz' ELSE 'a,b' END AS cited FROM v
UNION ALL SELECT job_id, CASE WHEN job_id % 10 = 0 THEN 2 ELSE 1 END, 'q2', CASE WHEN job_id % 4 = 0 THEN 'yes' ELSE 'no' END, CASE WHEN job_id % 4 = 0 THEN 'c' ELSE '' END FROM v
UNION ALL SELECT job_id, CASE WHEN job_id % 10 = 0 THEN 1 ELSE 2 END, 'q3', CASE WHEN job_id % 5 = 0 THEN 'yes' ELSE 'no' END, CASE WHEN job_id % 5 = 0 THEN 'd,a' ELSE '' END FROM v WHERE job_id % 11 <> 0
UNION ALL SELECT job_id, 3, 'q9', 'yes', '' FROM v WHERE job_id % 13 = 0"""


@query(f"""WITH v AS ({VECTORS}), e AS ({EVIDENCE_SQL}), n AS ({ANSWERS_SQL}),
c AS (SELECT job_id, question, i, string_split(cited, ',')[i] AS evidence_id FROM n, range(1, 3) r(i) WHERE cited <> '' AND i <= len(string_split(cited, ','))),
t AS (SELECT e.*, v.text FROM e JOIN v USING (job_id) WHERE e.source = 'original_jd'),
s AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY source, CASE WHEN source = 'original_jd' THEN low END, quote, evidence_id, pos) AS due, row_number() OVER (PARTITION BY job_id ORDER BY pos) AS is_at FROM e),
m AS (SELECT c.*, f.source, f.place, f.n FROM c LEFT JOIN (SELECT job_id, evidence_id, arg_min(source, pos) AS source, arg_min(is_at, pos) AS place, arg_min(length(quote), pos) AS n FROM s GROUP BY ALL) f USING (job_id, evidence_id))
SELECT job_id, evidence_id AS subject, 'repeated_id' AS kind FROM e GROUP BY ALL HAVING count(*) > 1
UNION SELECT job_id, evidence_id, 'source' FROM e WHERE source <> 'original_jd' AND field IS NULL
UNION SELECT job_id, evidence_id, 'quote_too_long' FROM e WHERE length(quote) > 320
UNION SELECT job_id, evidence_id, 'not_found' FROM t WHERE instr(text, quote) = 0 UNION SELECT job_id, 'g', 'not_found' FROM e WHERE evidence_id = 'g'
UNION SELECT job_id, evidence_id, 'occurrences' FROM t WHERE instr(text, quote) > 0 AND (instr(text, quote) <> low + 1 OR instr(substr(text, low + 2), quote) > 0)
UNION SELECT job_id, evidence_id, 'catalog_order' FROM s WHERE due <> is_at
UNION SELECT job_id, evidence_id, 'unreferenced' FROM e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.job_id = e.job_id AND c.evidence_id = e.evidence_id)
UNION SELECT job_id, 'q3', 'membership' FROM v WHERE job_id % 11 = 0 UNION SELECT job_id, 'q9', 'membership' FROM v WHERE job_id % 13 = 0
UNION SELECT job_id, q, 'answer_order' FROM v, unnest(['q2', 'q3']) x(q) WHERE job_id % 10 = 0 AND job_id % 11 <> 0
UNION SELECT job_id, question, 'cardinality' FROM n WHERE question = 'q3' AND len(string_split(cited, ',')) > 1
UNION SELECT job_id, question, 'unknown_evidence' FROM m WHERE source IS NULL
UNION SELECT job_id, question, 'unauthorized_source' FROM m WHERE question = 'q3' AND source = 'original_jd'
UNION SELECT job_id, question, 'unauthorized_field' FROM m WHERE question = 'q3' AND source = 'trusted_metadata'
UNION SELECT a.job_id, a.question, 'citation_order' FROM m a JOIN m b ON a.job_id = b.job_id AND a.question = b.question AND b.i = a.i + 1 AND b.place <= a.place
UNION SELECT job_id, question, 'combined_length' FROM m WHERE question = 'q1' GROUP BY ALL HAVING sum(n) > 17""")
def vector_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as texts that answers cite, with faults: what is wrong with each vector."""
    v = table(spark, sf_dir, "documents").where(F.length("text") >= 60).select(F.col("doc_id").alias("job_id"), "text", F.col("source").alias("company"))
    # What is cited stands within the first 60 letters: texts are read for those once, and once to be searched.
    heads = kept(dealt(v.select("job_id", F.substring("text", 1, 60).alias("text"), "company"), "job_id"), "heads")
    made = lambda sql: spark.sql("WITH v AS (SELECT * FROM {v}) " + sql, v=heads)
    spans = F.array(F.struct(F.col("low").cast("int").alias("start"), F.col("high").cast("int").alias("end")))
    found = made(EVIDENCE_SQL).withColumn("occurrences", spans).drop("low", "high")
    answers = made(ANSWERS_SQL).withColumn("evidence", F.when(F.col("cited") == "", F.array().cast("array<string>")).otherwise(F.split("cited", ",")))
    source = lambda name, field, text_: (v if field is None else heads).select("job_id", F.lit(name).alias("source"), F.lit(field).cast("string").alias("field"), text_.alias("text"))
    sources = source("original_jd", None, F.col("text")).unionByName(source("trusted_metadata", "title", F.lit("Writer"))).unionByName(source("trusted_metadata", "company", F.col("company")))
    jd, meta, none = ["original_jd"], ["trusted_metadata"], []
    rules = [("q1", 0, "yes", 1, 2, 17, jd, none), ("q2", 1, "yes", 1, 1, 100, jd, none), ("q2", 1, "no", 0, 0, 0, none, none), ("q3", 2, "yes", 1, 1, 100, meta, ["company"]), ("q3", 2, "no", 0, 0, 0, none, none)]
    return evidence.vector_faults(found, answers, sources, spark.createDataFrame(rules, "question string, pos int, answer string, least int, most int, total int, sources array<string>, fields array<string>"))


@query("""SELECT conv_id, count(*) AS n_turns, sum(CASE WHEN role = 'assistant' THEN 2 WHEN role = 'user' THEN 1 ELSE 0 END) AS units, CAST(floor((20 * sum(CASE WHEN role = 'assistant' THEN 2 WHEN role = 'user' THEN 1 ELSE 0 END) + count(*)) / (2.0 * count(*))) AS INTEGER) AS points, CASE WHEN bool_or(role = 'system') THEN 'Does not meet' ELSE 'Partially qualified' END AS label FROM conversations GROUP BY 1""")
def criteria_from_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as criteria: outcomes by role, gathered by conversation and scored."""
    role = F.col("role")
    outcome = F.when(role == "assistant", "direct").when(role == "user", "partial").otherwise("does_not_meet")
    units = F.when(role == "assistant", 2).when(role == "user", 1).otherwise(0)
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum(units).alias("units"), F.collect_list(F.struct(F.lit("required").alias("classification"), outcome.alias("outcome"), F.lit(False).alias("neutral"))).alias("criteria"), F.collect_list(outcome).alias("outcomes"))
    return rows.select("conv_id", "n_turns", "units", scoring.preferred_points(F.col("outcomes")).alias("points"), scoring.criterion_score(F.col("criteria"))["label"].alias("label"))


@query(f"""WITH w AS (SELECT doc_id, lang, {PLAIN_SQL} AS w FROM documents), f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, w) AS first FROM w WHERE length(w) >= 250)
SELECT doc_id AS id, first AS duplicate_of, 'description' AS why FROM f WHERE first < doc_id""")
def document_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings of a company for each language: which repeat an earlier long text word for word."""
    d = table(spark, sf_dir, "documents")
    postings = d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("arrived"), F.lit("Writer").alias("title"), F.col("lang").alias("company"), F.lit("").alias("location"), F.col("text").alias("description"), F.lit(None).cast("string").alias("url"), F.lit("crawl").alias("source"), F.lit(None).cast("string").alias("source_id"))
    return duplicate_links(postings)
