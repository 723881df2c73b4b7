"""Queries on what questions ask for. Turns of conversations play questions, beside some that have requests in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions import request as Q
from ..functions import text as T
from ..functions import url as U
from . import sqltext as S
from .inputs import literal, micro, sql_literal, sql_micro, table

TODAY = "2026-11-20"
ASKED = [
    (-1, "https://react.dev/learn main article text without navigation"), (-2, "https://a.org/x?y=1, how do I reverse a list"), (-3, "HTTP://b.org/p). compare with https://c.org"), (-4, "see https://a.org"), (-5, "https://a.org/z summary?"),
    (-6, "jet stream wind speed official documentation"), (-7, "quantum tunnelling latest release date primary source"), (-8, "primary school enrolment statistics 2024"), (-9, "rainfall in Assam 2026"), (-10, "ocean currents peer reviewed studies and evidence 2025"),
    (-11, "site:who.int malaria guideline"), (-12, "official dataset download"), (-13, "what is the current price of tea"), (-14, "pdf"), (-15, "python asyncio error troubleshooting guide"), (-16, "open regression issue in github repository of numpy"),
    (-17, "arxiv 2401.12345 preprint"), (-18, "latest news on floods in Kerala"), (-19, "climate policy in 2019"), (-20, "register a company in New Zealand"), (-21, "UK inflation rate statistics"), (-22, "indian tax form"), (-23, ""), (-24, None),
    (-25, "site:github.com issues"), (-26, "solar panel efficiency known limitations 2026"), (-27, "history of tea - official record, 1990"), (-28, "a b c the with report"), (-29, "kidney stones WHO guidance"),
]
PAGES = [
    (1, "https://docs.python.org/3/library/asyncio.html", "asyncio documentation"), (2, "https://www.who.int/news/malaria", "Malaria"), (3, "https://arxiv.org/abs/2401.12345", "A paper"), (4, "https://en.wikipedia.org/wiki/Tea", "Tea - Wikipedia"),
    (5, "https://www.assam.gov.in/forms", "Forms"), (6, "https://stackoverflow.com/questions/1", "Error"), (7, "https://data.gov.uk/dataset/1", "Inflation statistics"), (8, "https://example.com/", "official documentation"), (9, "https://shop.example.com/active/database", "databases"), (10, "https://x.org/releases/9", "What's new in 9"),
]
_A = sql_literal("id, q", ASKED)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, q): all distinct turns of conversations, and the questions above."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("id"), F.col("text").alias("q"))
    return turns.unionByName(literal(spark, "id long, q string", ASKED))


_QS = f"qs AS (SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS id, text AS q FROM conversations UNION ALL SELECT id, q FROM {_A})"
_SQ = f"{S.squeeze(chr(99) + 'oalesce(q, ' + chr(39) * 2 + ')')}"


def read_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("id", Q.read_request(F.col("q")).alias("r")).select("id", "r.*")


READ_SQL = f"""WITH {_QS}, r AS (SELECT id, trim(coalesce(q, '')) AS raw FROM qs), u AS (SELECT id, raw, regexp_extract(raw, {S.lit(Q.LEADING_URL.replace('^(?i)', '(?i)^'))}, 1) AS whole FROM r),
v AS (SELECT *, trim(substr(raw, length(whole) + 1)) AS rest FROM u)
SELECT id, rtrim(whole, '.,;:!?)]}}"''') AS url, CASE WHEN whole <> '' THEN rest ELSE '' END AS request,
  whole <> '' AND NOT regexp_matches(rest, '(?i)https?://') AND NOT ends_with(rest, '?') AND trim(lower(split_part(replace(replace(rest, chr(10), ' '), chr(9), ' '), ' ', 1)), '.,:;!?') NOT IN ({S.words(Q.QUESTION_OPENERS)}) AS asks FROM v"""


def subject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = questions(spark, sf_dir).select("id", Q.split_subject(F.col("q")).alias("s")).select("id", "s.*")
    return rows.withColumn("markers", F.array_join(Q.request_markers(F.col("request")), ","))


_LIST = lambda items: "[" + S.words(items) + "]"
_DATE = f"(regexp_matches({{0}}, '[0-9]') OR {{0}} IN ({S.words(Q.MONTH_WORDS)}))"
_SPLIT = f"""{_QS}, w AS (SELECT id, {_SQ} AS raw, {S.every(_SQ, T.RUN)} AS words FROM qs),
l AS (SELECT *, list_transform(words, lambda x: lower(x)) AS low, len(words) AS n, list_filter(list_transform(words, lambda x: trim(lower(x), '.,;:!?()[]"''')), lambda x: x <> '') AS plain, len({S.scopes('raw')}) AS scopes FROM w),
p AS (SELECT *, list_max(list_transform(list_filter({_LIST(Q.PHRASES)}, lambda f: ends_with(' ' || array_to_string(plain, ' '), ' ' || f) AND len(string_split(f, ' ')) < len(plain)), lambda f: len(string_split(f, ' ')))) AS longest,
  list_max(list_filter(range(0, n), lambda i: low[i + 1] IN ({S.words(Q.MARKERS)}) OR NOT ({_DATE.format('low[i + 1]')} OR low[i + 1] IN ({S.words(Q.CONNECTIVES)})))) AS last,
  CASE WHEN low[1] IN ({S.words(Q.OPENERS)}) THEN low[2] ELSE low[1] END AS opener FROM l),
b AS (SELECT *, coalesce(list_max(list_filter(range(0, n), lambda i: i < last AND NOT (low[i + 1] IN ({S.words(Q.SHAPE_WORDS + Q.MARKERS + Q.CONNECTIVES)}) OR {_DATE.format('low[i + 1]')}))), -1) + 1 AS reach FROM p),
c AS (SELECT *, CASE WHEN scopes > 0 OR n < 2 THEN NULL WHEN longest IS NOT NULL THEN n - longest WHEN opener IN ({S.words(Q.MARKERS)}) THEN NULL
  WHEN low[last + 1] IN ({S.words(Q.MARKERS)}) THEN CASE WHEN last > 0 THEN reach END WHEN regexp_matches(low[n], '^(19|20)[0-9][0-9]$') THEN n - 1 END AS begin FROM b),
h AS (SELECT *, CASE WHEN begin > 0 THEN length(regexp_extract(raw, '^(?:' || {S.lit(Q.NOT_RUN)} || {S.lit(T.RUN)} || '){{' || begin || '}}' || {S.lit(Q.NOT_RUN)})) END AS cut_at FROM c),
s AS (SELECT id, raw, low, rtrim(trim(left(raw, cut_at)), ':;,-— ') AS a, trim(substr(raw, cut_at + 1)) AS z FROM h),
split AS (SELECT id, raw, low, CASE WHEN coalesce(a, '') <> '' AND z <> '' THEN a ELSE raw END AS subject, CASE WHEN coalesce(a, '') <> '' AND z <> '' THEN z ELSE '' END AS request FROM s)"""
SPLIT_SQL = f"WITH {_SPLIT} SELECT id, subject, request, array_to_string({S.ordered(f'list_filter(list_transform({S.every(chr(114) + chr(101) + chr(113) + chr(117) + chr(101) + chr(115) + chr(116), T.RUN)}, lambda x: lower(x)), lambda x: x IN ({S.words(Q.MARKERS)}))')}, ',') AS markers FROM split"


def request_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = questions(spark, sf_dir).select("id", "q", Q.split_subject(F.col("q"))["request"].alias("request"))
    return rows.select("id", F.array_join(Q.request_kinds(F.col("q"), F.col("request")), ",").alias("kinds"))


_KINDS = ", ".join(f"CASE WHEN list_has_any(words, {_LIST(items)}) THEN '{kind}' END" for kind, items in Q.KIND_WORDS.items())
_KIND_ROWS = f"""{_SPLIT}, o AS (SELECT id, request, raw, CASE WHEN low[1] IN ({S.words(Q.OPENERS)}) THEN low[2] ELSE low[1] END AS opener FROM split),
k AS (SELECT id, string_split_regex(lower(replace(replace(CASE WHEN request <> '' THEN request WHEN opener IN ({S.words(Q.MARKERS)}) THEN raw ELSE '' END, ',', ' '), '-', ' ')), '\\s+') AS words FROM o),
kinds AS (SELECT id, list_sort(list_filter([{_KINDS}], lambda x: x IS NOT NULL)) AS kinds FROM k)"""
KINDS_SQL = f"WITH {_KIND_ROWS} SELECT id, array_to_string(kinds, ',') AS kinds FROM kinds"


def kind_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question above with each of the pages above and of the pages' table whose number ends like the question's."""
    asked = literal(spark, "id long, q string", ASKED).select("id", Q.request_kinds(F.col("q"), Q.split_subject(F.col("q"))["request"]).alias("asked"))
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") + 100).alias("page"), "url", F.lit("the reference notes").alias("title")).unionByName(literal(spark, "page long, url string, title string", PAGES))
    kinds = pages.select("page", Q.source_kinds(F.col("url"), F.col("title")).alias("found"))
    met = kinds.join(F.broadcast(asked), (F.col("page") <= 100) | (F.col("page") % 29 == -F.col("id") - 1))
    return met.select("id", "page", F.array_join("found", ",").alias("found"), micro(Q.kind_bonus(F.col("asked"), F.col("found"))).alias("bonus"))


def _has(kind: str) -> str:
    ends, begins, paths, words = Q.SOURCES[kind]
    tests = [f"ends_with(host, {S.lit(x)})" for x in ends] + [f"starts_with(host, {S.lit(x)})" for x in begins]
    tests += [f"list_has_any(segments, {_LIST(paths)})"] if paths else []
    tests += [f"contains(low, {S.lit(w)})" if " " in w else f"regexp_matches(low, {S.lit(chr(92) + 'b' + w + chr(92) + 'b')})" for w in words]
    return " OR ".join(tests)


_SOURCE = ", ".join(f"CASE WHEN {_has(kind)} THEN '{kind}' END" for kind in Q.SOURCES)
BONUS_SQL = f"""WITH {_KIND_ROWS}, pg AS (SELECT page_id + 100 AS page, url, 'the reference notes' AS title FROM pages UNION ALL SELECT page, url, title FROM {sql_literal('page, url, title', PAGES)}),
x AS (SELECT page, lower(title) AS low, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS host, list_filter(string_split(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '/'), lambda s: s <> '') AS segments FROM pg),
f AS (SELECT page, CASE WHEN len(segments) > 0 THEN list_sort(list_filter([{_SOURCE}], lambda k: k IS NOT NULL)) ELSE [] END AS found FROM x)
SELECT id, page, array_to_string(found, ',') AS found, {sql_micro('CASE WHEN list_has_any(kinds, found) THEN 0.2 ELSE 0 END')} AS bonus FROM f JOIN kinds ON id < 0 AND (page <= 100 OR page % 29 = -id - 1)"""


def jurisdictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each question, and what two official hosts gain under it."""
    rows = questions(spark, sf_dir).select("id", I.answer_type(F.col("q")).alias("kind"), Q.jurisdiction(F.col("q")).alias("j"))
    gain = lambda url: micro(Q.intent_multiplier(F.lit(url), F.col("kind"), F.col("j.suffixes"), F.col("j.domains")))
    return rows.select("id", F.col("j.label").alias("label"), gain("https://www.kerala.gov.in/forms").alias("at_state"), gain("https://docs.example.govt.nz/a").alias("at_other"))


_PLACE = "CASE " + " ".join(f"WHEN contains(low, {S.lit(s)}) THEN {S.lit(' '.join(w.capitalize() for w in s.split()))}" for s in Q.STATES) + " " + " ".join(f"WHEN regexp_matches(low, {S.lit(chr(92) + 'b' + n + chr(92) + 'b')}) THEN {S.lit(label)}" for n, label, _ in Q.COUNTRIES) + " ELSE '' END"
_SUFFIXES = "CASE " + " ".join(f"WHEN label = {S.lit(label)} THEN {_LIST(suffixes)}" for _, label, suffixes in Q.COUNTRIES) + " WHEN label = '' THEN CAST([] AS VARCHAR[]) ELSE ['.gov.in', '.nic.in'] END"
_COUNTRY_NAMES = S.words(sorted({label for _, label, _ in Q.COUNTRIES}))


def _gain(host: str) -> str:
    domains = f"CASE WHEN label = '' OR label IN ({_COUNTRY_NAMES}) THEN CAST([] AS VARCHAR[]) ELSE [replace(lower(label), ' ', '') || '.gov.in', 'gov.in'] END"
    placed = f"CASE WHEN len(list_filter({domains}, lambda d: '{host}' = d OR ends_with('{host}', '.' || d))) > 0 THEN 1.3 WHEN len(list_filter({_SUFFIXES}, lambda s: ends_with('{host}', s))) > 0 THEN 1.2 ELSE 1.0 END"
    gov = ".gov" in host
    fit = f"CASE kind WHEN 'procedure' THEN {1.2 if gov or host.endswith('.nic.in') else 1.0} WHEN 'error' THEN {1.2 if host.startswith(('docs.', 'developer.')) else 1.0} WHEN 'statistic' THEN {1.15 if gov or host.startswith('data.') else 1.0} ELSE 1.0 END"
    return sql_micro(f"CAST({placed} AS DOUBLE) * CAST({fit} AS DOUBLE)")


def _answer_type(q: str) -> str:
    t, low = S.squeeze(f"coalesce({q}, '')"), f"lower({S.squeeze(f'coalesce({q}, {chr(39) * 2})')})"
    m = lambda x, p: f"regexp_matches({x}, {S.lit(p)})"
    return f"CASE WHEN {m(t, I.ERROR)} THEN 'error' WHEN {m(low, I.COMPARISON)} THEN 'comparison' WHEN {m(low, I.PROCEDURE)} THEN 'procedure' WHEN {m(low, I.CURRENT)} THEN CASE WHEN {m(low, I.STATISTIC)} THEN 'statistic' ELSE 'current_event' END WHEN {m(low, I.YEAR)} OR {m(low, I.STATISTIC)} THEN 'statistic' WHEN {m(low, I.DEFINITION)} THEN CASE WHEN starts_with({low}, 'how many') THEN 'entity_lookup' ELSE 'definition' END ELSE 'general' END"


PLACES_SQL = f"""WITH {_QS}, a AS (SELECT id, lower({_SQ}) AS low, {_answer_type('q')} AS kind FROM qs), p AS (SELECT id, kind, {_PLACE} AS label FROM a)
SELECT id, label, {_gain('kerala.gov.in')} AS at_state, {_gain('docs.example.govt.nz')} AS at_other FROM p"""


def specialist_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("id", F.array_join(Q.routes(F.col("q"), F.lit(TODAY).cast("date")), ",").alias("routes"))


_WHEN = r"(?:19|20)[0-9][0-9](?:-[0-9][0-9](?:-[0-9][0-9])?)?"
ROUTES_SQL = f"""WITH {_QS}, a AS (SELECT id, {_SQ} AS raw, lower({_SQ}) AS low, {_answer_type('q')} AS kind FROM qs),
y AS (SELECT *, regexp_extract(low, '\\b(?:between|from)\\s+({_WHEN})\\s+(?:and|to|until|through)\\s+({_WHEN})\\b', ['f', 't']) AS span, regexp_extract(low, '\\bsince\\s+({_WHEN})\\b', 1) AS since, regexp_extract(low, '\\bin\\s+((?:19|20)[0-9][0-9])\\b', 1) AS year FROM a),
n AS (SELECT id, low, list_contains(list_transform({S.scopes('raw')}, lambda s: regexp_extract(s, '^[^/]*')), 'github.com') OR (regexp_matches(low, '\\bgithub\\b') AND regexp_matches(low, {S.lit(Q.CODE_HOST)}) AND regexp_matches(low, {S.lit(Q.CODE_THING)})) AS hosted,
  (span.f <> '' AND span.f <= span.t AND left(span.t, 4) < '2026') OR (since <> '' AND left(since, 4) < '2026') OR (year <> '' AND year < '2026') AS archive,
  kind = 'current_event' OR regexp_matches(low, {S.lit(I.NEWS)}) OR regexp_matches(low, {S.lit(I.SPAN)}) OR regexp_matches(low, '\\b(today|tonight|this morning|right now|yesterday)\\b|\\b(this|the past|the last)\\s+(week|month)\\b') AS news FROM y)
SELECT id, CASE WHEN hosted THEN 'github-search' WHEN regexp_matches(low, {S.lit(Q.ACADEMIC)}) THEN 'crossref,arxiv' ELSE
  concat_ws(',', CASE WHEN archive THEN 'sitemaps,publisher-feeds' WHEN news THEN 'bing-news,google-news,publisher-feeds,gdelt' END, CASE WHEN regexp_matches(low, {S.lit(Q.TECHNICAL)}) THEN 'stackexchange' END) END AS routes FROM n"""

QUERIES = {"read_requests": read_requests, "subject_split": subject_split, "request_kinds": request_kinds, "kind_bonus": kind_bonus, "jurisdictions": jurisdictions, "specialist_routes": specialist_routes}
SQL = {"read_requests": READ_SQL, "subject_split": SPLIT_SQL, "request_kinds": KINDS_SQL, "kind_bonus": BONUS_SQL, "jurisdictions": PLACES_SQL, "specialist_routes": ROUTES_SQL}
