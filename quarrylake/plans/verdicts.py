"""Queries on answers that aren't pages, failed reads, titles, flags and texts that leave the system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import verdicts as V
from . import sqltext as S
from .inputs import literal, sql_literal, table
from .texts import TITLE

ANSWERS = [
    (-1, "<div class='g-recaptcha'></div> just a moment", 200, ""), (-2, "<script src='/cdn-cgi/challenge-platform/x'>", 403, ""), (-3, "Just a moment... Ray ID: 7a6b5c4d3e", 200, ""), (-4, "Just a moment while the kettle boils", 200, ""), (-5, "Just a moment", 503, ""),
    (-6, "Pardon our interruption", 200, "server DataDome"), (-7, "Please sign in to continue. Login here", 200, ""), (-8, "authentication required", 401, ""), (-9, "authentication required by the treaty", 200, ""), (-10, "Access Denied", 403, ""),
    (-11, "an essay on access denied", 200, ""), (-12, "access denied. Reference #18.abcdef12", 200, ""), (-13, "", 403, ""), (-14, None, 200, None), (-15, "Request blocked", 200, "x-sucuri-id 12"), (-16, "px-captcha", None, None), (-17, "Access denied", None, None),
]
STATUSES = [(1, 301, "origin", "auto", None), (2, 404, "origin", "static", None), (3, 403, "reader", "auto", None), (4, 403, "reader", "browser", None), (5, 401, "origin", "browser", None), (6, 403, "origin", "static", None), (7, 403, "origin", "auto", None), (8, 429, "origin", "auto", 30.0), (9, 429, "reader", "auto", None), (10, 503, "reader", "auto", 5.0), (11, 418, "origin", "auto", None), (12, 200, "reader", "", None)]
FAILURES = [
    (1, "PageUnavailable", "http_403", None, None, None, None), (2, "", "read timed out", None, None, None, None), (3, "pdf_parse_failed", None, None, None, None, None), (4, None, "no readable text", None, None, None, None), (5, None, None, None, True, False, None), (6, "Odd", None, None, None, None, 20),
    (7, None, None, "SILENT_EMPTY", None, None, None), (8, None, None, "ok", False, None, 120), (9, None, None, "ok", True, True, 4000), (10, None, None, None, None, None, None), (11, "AuthError", "deadline", None, None, None, None), (12, None, None, None, True, None, 0),
]
LEAKS = [
    (-1, "see https://me:pw@host.org/a?token=abc&x=1#key=zz"), (-2, "call with api_key=12345, then"), (-3, "user:pass@db.example.org refused"), (-4, "password=hunter2; next"), (-5, "mail me@host.org"), (-6, "https://a.org/?session=1&sig=2"), (-7, None), (-8, ""), (-9, "ftp://anonymous@files.org Token=abc"),
]
_ANSWERS_SQL = f"SELECT id, body, status, headers FROM {sql_literal('id, body, status, headers', ANSWERS)} UNION ALL SELECT page_id, html, CASE WHEN page_id % 7 = 0 THEN 403 ELSE 200 END, '' FROM pages"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select(i.cast("long").alias("id"), F.col("html").alias("body"), F.when(i % 7 == 0, 403).otherwise(200).alias("status"), F.lit("").alias("headers"))
    return literal(spark, "id long, body string, status int, headers string", ANSWERS).unionByName(pages)


def challenges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir)
    return rows.select("id", V.challenge(F.col("body"), F.col("status"), F.col("headers")).alias("v")).select("id", "v.*")


def _first(pairs: list, test: str) -> str:
    return f"list_filter([{', '.join('{' + chr(39) + 'm' + chr(39) + ': ' + S.lit(m) + ', ' + chr(39) + 'p' + chr(39) + ': ' + S.lit(p) + '}' for m, p in pairs)}], lambda x: {test})[1]"


CHALLENGE_SQL = f"""WITH a AS ({_ANSWERS_SQL}), s AS (SELECT id, status, lower(left(coalesce(body, ''), {V.SCANNED})) AS t, lower(coalesce(headers, '')) AS h FROM a),
f AS (SELECT *, {_first(V.CAPTCHAS, 'contains(t, x.m)')} AS w, {_first(V.CHALLENGES, 'contains(t, x.m)')} AS c, coalesce({_first(V.PROVIDERS, "contains(t, x.m) OR contains(h, x.m)")}.p, '') AS prov,
  list_filter([{S.words(V.BOT_PHRASES)}], lambda x: contains(t, x))[1] AS bot, list_filter([{S.words(V.AUTH_PHRASES)}], lambda x: contains(t, x))[1] AS auth, list_filter([{S.words(V.DENIED_PHRASES)}], lambda x: contains(t, x))[1] AS denied, regexp_matches(t, {S.lit(V.REFERENCE_ID)}) AS ref FROM s),
k AS (SELECT *, CASE WHEN trim(t) = '' THEN 'none' WHEN w IS NOT NULL THEN 'captcha' WHEN c IS NOT NULL THEN 'script' WHEN bot IS NOT NULL THEN 'phrase'
  WHEN auth IS NOT NULL AND (coalesce(status, 0) = 401 OR regexp_matches(t, 'login|signin|session')) THEN 'auth_required' WHEN denied IS NOT NULL AND (coalesce(status, 0) IN (401, 403) OR ref OR prov <> '') THEN 'access_denied' ELSE 'none' END AS kind FROM f)
SELECT id, CASE WHEN kind IN ('script', 'phrase') THEN 'bot_challenge' ELSE kind END AS kind, CASE kind WHEN 'captcha' THEN w.p WHEN 'script' THEN c.p WHEN 'phrase' THEN prov WHEN 'access_denied' THEN prov ELSE '' END AS provider,
  CASE kind WHEN 'captcha' THEN w.m WHEN 'script' THEN c.m WHEN 'phrase' THEN bot WHEN 'auth_required' THEN auth WHEN 'access_denied' THEN denied ELSE '' END AS marker, CASE kind WHEN 'none' THEN FALSE WHEN 'phrase' THEN prov <> '' OR ref OR coalesce(status, 0) IN (403, 429, 503) ELSE TRUE END AS confident FROM k"""


def status_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each status with what it means; events with a value between 300 and 599 play further answers."""
    status = F.col("value").cast("int")
    more = table(spark, sf_dir, "events").where("value >= 300 AND value < 600").select((F.col("event_id") + 100).cast("long").alias("id"), status.alias("status"), F.when(F.col("user_id") % 2 == 0, "origin").otherwise("reader").alias("layer"), F.element_at(F.array(*[F.lit(x) for x in ("auto", "static", "browser")]), (F.col("user_id") % 3 + 1).cast("int")).alias("mode"), F.when(F.col("user_id") % 5 == 0, 60.0).alias("retry_after"))
    rows = literal(spark, "id long, status int, layer string, mode string, retry_after double", STATUSES).unionByName(more)
    return rows.select("id", V.status_error(F.col("status"), F.col("layer"), F.col("mode"), F.col("retry_after")).alias("e")).select("id", "e.*")


_H = {k: S.lit(v) for k, v in V.HINTS.items()}
STATUS_SQL = f"""WITH s AS (SELECT id, status, layer, mode, retry_after FROM {sql_literal('id, status, layer, mode, retry_after', STATUSES)} UNION ALL
  SELECT event_id + 100, CAST(floor(value) AS INTEGER), CASE WHEN user_id % 2 = 0 THEN 'origin' ELSE 'reader' END, ['auto', 'static', 'browser'][user_id % 3 + 1], CASE WHEN user_id % 5 = 0 THEN 60.0 END FROM events WHERE value >= 300 AND value < 600)
SELECT CAST(id AS BIGINT) AS id, CASE WHEN status = 429 THEN 'rate_limited' ELSE 'page_unavailable' END AS error, CASE WHEN status IN (301, 302, 303, 307, 308) THEN 'redirect_loop' ELSE 'http_' || status END AS detail,
  CASE WHEN status IN (301, 302, 303, 307, 308) THEN {_H['redirect']} WHEN status = 404 THEN {_H['missing']} WHEN status IN (401, 403) AND layer = 'reader' AND mode = 'browser' THEN {_H['reader_browser']} WHEN status IN (401, 403) AND layer = 'reader' THEN {_H['reader']}
    WHEN status IN (401, 403) AND mode = 'browser' THEN {_H['browser']} WHEN status IN (401, 403) AND mode = 'static' THEN {_H['static']} WHEN status IN (401, 403) THEN {_H['other']} WHEN status = 429 AND retry_after > 0 THEN {_H['cooldown']} WHEN status = 429 THEN {_H['moment']}
    WHEN status BETWEEN 500 AND 599 THEN {_H['server']} ELSE '' END AS hint, CAST(CASE WHEN status = 429 THEN retry_after END AS DOUBLE) AS retry_after FROM s"""


def failure_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed reads; events of kind error play more, with their number of characters."""
    more = table(spark, sf_dir, "events").where("event_type = 'error'").select((F.col("event_id") + 100).cast("long").alias("id"), F.lit(None).cast("string").alias("error"), F.lit("").alias("detail"), F.when(F.col("user_id") % 3 == 0, "silent_empty").alias("status"), (F.col("user_id") % 4 == 0).alias("requires_js"), (F.col("user_id") % 8 == 0).alias("js_ok"), F.col("value").cast("int").alias("chars"))
    rows = literal(spark, "id long, error string, detail string, status string, requires_js boolean, js_ok boolean, chars int", FAILURES).unionByName(more)
    return rows.select("id", V.failure_cause(*[F.col(c) for c in ("error", "detail", "status", "requires_js", "js_ok", "chars")]).alias("f")).select("id", "f.*")


_SAYS = {cause: "(" + " OR ".join(f"contains(message, {S.lit(w)})" for w in words) + ")" for cause, words in V.CAUSES}
CAUSES_SQL = f"""WITH r AS (SELECT * FROM {sql_literal('id, error, detail, status, requires_js, js_ok, chars', FAILURES)} UNION ALL
  SELECT event_id + 100, NULL, '', CASE WHEN user_id % 3 = 0 THEN 'silent_empty' END, user_id % 4 = 0, user_id % 8 = 0, CAST(trunc(value) AS INTEGER) FROM events WHERE event_type = 'error'),
m AS (SELECT *, lower(coalesce(error, '')) || ' ' || lower(coalesce(detail, '')) AS message FROM r),
c AS (SELECT *, CASE WHEN {_SAYS['blocked']} THEN 1 WHEN {_SAYS['too_slow']} THEN 2 WHEN {_SAYS['wrong_format']} THEN 3 WHEN {_SAYS['not_enough_text']} THEN 4 WHEN coalesce(requires_js, FALSE) AND js_ok = FALSE THEN 5 WHEN message <> ' ' THEN 6 WHEN lower(status) = 'silent_empty' THEN 7 WHEN chars >= 0 AND chars < 150 THEN 8 ELSE 9 END AS k FROM m)
SELECT CAST(id AS BIGINT) AS id, ['blocked', 'too_slow', 'wrong_format', 'not_enough_text', 'not_enough_text', 'other', 'not_enough_text', 'not_enough_text', 'other'][k] AS cause,
  CASE k WHEN 1 THEN 'denied/challenge/rate-limit or security policy' WHEN 2 THEN 'timeout/deadline' WHEN 3 THEN 'unreadable/unsupported document format' WHEN 4 THEN 'no readable text or missing OCR/rendered text' WHEN 5 THEN 'client-rendered page was not read by the browser'
    WHEN 6 THEN 'typed failure without enough evidence for a specific cause' WHEN 7 THEN 'empty content' WHEN 8 THEN 'only ' || chars || ' characters returned' ELSE 'insufficient evidence; inspect the site and source record' END AS evidence FROM c"""


def scrubbed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' texts without credentials, and how long each is within its envelope."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text", F.col("source").alias("url"))
    rows = docs.unionByName(literal(spark, "id long, text string", LEAKS).withColumn("url", F.lit(None).cast("string")))
    clean = rows.select("id", "url", V.scrubbed(F.col("text")).alias("clean"))
    return clean.select("id", F.md5("clean").alias("clean_md5"), F.length(V.enveloped(F.col("clean"), F.col("url"))).alias("enveloped"))


def _scrub(x: str) -> str:
    for pattern, to in V.CREDENTIALS:
        flags = "'gi'" if pattern.startswith("(?i)") else "'g'"
        x = f"regexp_replace({x}, {S.lit(pattern.removeprefix('(?i)'))}, {S.lit(to.replace('$', chr(92)))}, {flags})"
    return x


SCRUB_SQL = f"""WITH r AS (SELECT doc_id AS id, text, source AS url FROM documents UNION ALL SELECT id, text, NULL FROM {sql_literal('id, text', LEAKS)}), c AS (SELECT id, url, {_scrub('text')} AS clean FROM r)
SELECT CAST(id AS BIGINT) AS id, md5(clean) AS clean_md5, CAST(length('<internet-content untrusted="true"' || CASE WHEN coalesce(url, '') <> '' THEN ' origin="' || url || '"' ELSE '' END || '>' || chr(10) || clean || chr(10) || '</internet-content>' || chr(10) || {S.lit(V.NOTICE)}) AS INTEGER) AS enveloped FROM c"""


def merged_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each page's title and text with one that some pages have already."""
    html = F.col("html")
    known = F.when(F.col("page_id") % 3 == 0, F.array(F.lit("known:flag"), F.lit("invisible_characters"))).when(F.col("page_id") % 3 == 1, F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "pages").select("page_id", T.html_title(html).alias("title"), F.regexp_replace(html, "<[^>]+>", " ").alias("content"), known.alias("known"))
    return rows.select("page_id", F.array_join(V.flags_merged(F.col("title"), F.col("content"), F.col("known")), ",").alias("flags"))


FLAGS_SQL = f"""WITH p AS (SELECT page_id, coalesce({TITLE}, '') || chr(10) || coalesce(regexp_replace(html, '<[^>]+>', ' ', 'g'), '') AS t FROM pages)
SELECT page_id, array_to_string(list_sort(list_distinct(list_concat({S.flags('t')}, CASE WHEN page_id % 3 = 0 THEN ['known:flag', 'invisible_characters'] ELSE [] END))), ',') AS flags FROM p"""

TITLES = [(-1, "A title", "# H", "u"), (-2, "", "text\n # Heading here \nmore", "u"), (-3, None, "Title: From a line", "u"), (-4, " ", "nothing", "https://a.org/x"), (-5, "word " * 60, None, None), (-6, "x" * 250, "", None), (-7, None, None, None), (-8, "", "#no heading\ntitle:", "u")]


def resolved_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    heading = F.concat(F.lit("text\n# "), F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("id"), F.when(F.col("page_id") % 2 == 0, T.html_title(html)).alias("title"), heading.alias("markdown"), "url")
    rows = pages.unionByName(literal(spark, "id long, title string, markdown string, url string", TITLES))
    return rows.select("id", V.resolved_title(F.col("title"), F.col("markdown"), F.col("url")).alias("t")).select("id", "t.*")


TITLES_SQL = f"""WITH r AS (SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN {TITLE} END AS title, 'text' || chr(10) || '# ' || regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS markdown, url FROM pages UNION ALL SELECT * FROM {sql_literal('id, title, markdown, url', TITLES)}),
l AS (SELECT *, trim(coalesce(title, '')) AS own, list_filter(list_transform(string_split(coalesce(markdown, ''), chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '# ') OR starts_with(lower(x), 'title:'))[1] AS line FROM r),
n AS (SELECT *, trim(CASE WHEN starts_with(line, '# ') THEN substr(line, 3) WHEN line IS NULL THEN '' ELSE regexp_replace(line, '^[^:]*:', '') END) AS named FROM l),
s AS (SELECT id, CASE WHEN own <> '' THEN 'html' WHEN named <> '' THEN 'markdown' ELSE 'url' END AS source, CASE WHEN own <> '' THEN {S.squeeze('own')} WHEN named <> '' THEN {S.squeeze('named')} ELSE coalesce(url, '') END AS t FROM n)
SELECT CAST(id AS BIGINT) AS id, CASE WHEN source = 'url' OR length(t) <= 200 THEN t WHEN length(regexp_extract(left(t, 200), '^(.*) ', 1)) >= 100 THEN rtrim(regexp_extract(left(t, 200), '^(.*) ', 1)) ELSE left(t, 200) END AS title, source, source <> 'url' AND length(t) > 200 AS clipped FROM s"""

PDFS = [(1, "ex-\nample of a ﬁle"), (2, "well-\n  known"), (3, "co­operate a-b"), (4, None), (5, "end-\n"), (6, "x\x00y"), (7, "ＡＢ-\t\nＣ")]
HEADS = [(1, "%PDF-1.7 ..."), (2, "﻿%PDF-1.4"), (3, "<html>%PDF-1.4"), (4, "x" * 1019 + "%PDF-1.4"), (5, "x" * 1020 + "%PDF-1.4"), (6, ""), (7, None)]


def pdf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 100).cast("long").alias("id"), F.regexp_replace("text", "ing ", "-\ning ").alias("t"))
    rows = docs.unionByName(literal(spark, "id long, t string", PDFS))
    heads = literal(spark, "id long, h string", HEADS).select("id", V.looks_like_pdf(F.col("h").cast("binary")).alias("is_pdf"))
    return rows.select("id", V.pdf_text(F.col("t")).alias("t")).join(F.broadcast(heads), "id", "left").select("id", F.length("t").alias("chars"), F.instr("t", "-\n").alias("dash"), "is_pdf")


QUERIES = {"challenges": challenges, "status_errors": status_errors, "failure_causes": failure_causes, "scrubbed_texts": scrubbed_texts, "merged_flags": merged_flags, "resolved_titles": resolved_titles, "pdf_texts": pdf_texts}
SQL = {"challenges": CHALLENGE_SQL, "status_errors": STATUS_SQL, "failure_causes": CAUSES_SQL, "scrubbed_texts": SCRUB_SQL, "merged_flags": FLAGS_SQL, "resolved_titles": TITLES_SQL}
