"""Queries over questions, dates and failures given as literal tables, and over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import intent as I
from . import sqltext as S
from .inputs import literal, micro, sql_literal, sql_micro, table

TODAY = "2026-11-20"
QUESTIONS = [
    (1, "latest news on the election in Assam over the past 3 days"), (2, "how to register a company in India"), (3, "error E1234 in python asyncio"), (4, "gdp growth 2026"), (5, "what is the capital of France"),
    (6, "how many moons has Saturn"), (7, "rust vs c++ performance"), (8, "climate policy in 2019"), (9, "floods since 2018-03"), (10, "elections between 2015 and 2017-06"), (11, "weather today in London"),
    (12, "ai chip startups within two weeks"), (13, ""), (14, None), (15, "recipes"), (16, "white house policy on war this month"), (17, "reports from 2024-02 to 2024-02"),
]
_Q = f"(SELECT id, q FROM {sql_literal('id, q', QUESTIONS)} UNION ALL SELECT CAST(1000 + conv_id * 100 + turn AS INTEGER), text FROM conversations) AS asked"
RAW_DATES = [
    (1, "Published 2026-02-28 here", "https://a.org/x"), (2, "bad 2026-02-30", "https://a.org/2025/12/31/story"), (3, "on 5 August 2026.", ""), (4, "Aug 5, 2026", ""), (5, "Sept. 7, 2026", None),
    (6, None, "https://a.org/2024-01-02"), (7, "31 February 2026", ""), (8, "nothing", "https://a.org/20/1"), (9, "3 May 2026", ""),
]
STAMPS = [
    (1, "20261019T012345Z"), (2, "2026-10-19T23:30:00-05:00"), (3, "2026-10-19"), (4, "Wed, 28 Oct 2026 18:44:23 GMT"), (5, "2026-02-30"), (6, "soon"), (7, None), (8, "2026-10-19T01:00:00Z"), (9, "2026-10-19T01:00:00+0530"), (10, ""), (11, "2026-10-19T05:06:07"),
]
ANSWERS = [(1, 429, "x"), (2, 404, "page"), (3, 503, "rate limit reached"), (4, 200, "Please solve the CAPTCHA"), (5, 403, "denied"), (6, 302, ""), (7, 418, None)]


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions above and all turns of conversations."""
    turns = table(spark, sf_dir, "conversations").select((F.lit(1000) + F.col("conv_id") * 100 + F.col("turn")).cast("int").alias("id"), F.col("text").alias("q"))
    return literal(spark, "id int, q string", QUESTIONS).unionByName(turns)


def classify_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    return asked(spark, sf_dir).select("id", I.answer_type(q).alias("kind"), I.region(q).alias("region"), F.array_join(I.topics(q), ",").alias("topics"), I.is_news(q).alias("news"), I.news_window_days(q).alias("days"))


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(' ' || low || ' ', {S.lit(f' {w} ')})" for w in words) + ")"


_N = "CASE w " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in I.NUMBERS.items()) + " ELSE TRY_CAST(w AS INTEGER) END"
_M = lambda p, x="low": f"regexp_matches({x}, {S.lit(p)})"
CLASSIFY_SQL = f"""WITH a AS (SELECT id, {S.squeeze("coalesce(q, '')")} AS t, lower({S.squeeze("coalesce(q, '')")}) AS low FROM {_Q}),
b AS (SELECT *, regexp_extract(low, {S.lit(I.SPAN)}, 1) AS w, regexp_extract(low, {S.lit(I.SPAN)}, 2) AS u FROM a), c AS (SELECT *, {_N} AS n FROM b),
d AS (SELECT *, CASE WHEN w <> '' AND n > 0 THEN CASE WHEN regexp_matches(u, '^(hour|hr)') THEN greatest(1, n // 24) WHEN starts_with(u, 'day') THEN n WHEN starts_with(u, 'week') THEN n * 7 WHEN starts_with(u, 'month') THEN n * 30 ELSE n * 365 END
  WHEN {_M(r"\b(today|tonight|this morning|right now|as of today)\b")} THEN 1 WHEN {_M(r"\byesterday\b")} THEN 2 WHEN {_M(r"\b(this|the past|the last)\s+week\b")} THEN 7 WHEN {_M(r"\b(this|the past|the last)\s+month\b")} THEN 30 END AS days FROM c)
SELECT id, CASE WHEN {_M(I.ERROR, "t")} THEN 'error' WHEN {_M(I.COMPARISON)} THEN 'comparison' WHEN {_M(I.PROCEDURE)} THEN 'procedure' WHEN {_M(I.CURRENT)} THEN CASE WHEN {_M(I.STATISTIC)} THEN 'statistic' ELSE 'current_event' END
  WHEN {_M(I.YEAR)} OR {_M(I.STATISTIC)} THEN 'statistic' WHEN {_M(I.DEFINITION)} THEN CASE WHEN starts_with(low, 'how many') THEN 'entity_lookup' ELSE 'definition' END ELSE 'general' END AS kind,
 CASE {" ".join(f"WHEN {_has(w)} THEN '{n}'" for n, w in I.REGIONS)} END AS region,
 array_to_string(list_filter([{", ".join(f"CASE WHEN {_has(w)} THEN '{n}' END" for n, w in I.TOPICS.items())}], lambda x: x IS NOT NULL), ',') AS topics, {_M(I.NEWS)} OR days IS NOT NULL AS news, days FROM d"""


def archive_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = I.archive_bounds(F.col("q"), F.lit(TODAY).cast("date"))
    # Events make questions of each kind with dates of their own.
    e, day = F.col("event_id"), F.col("ts").cast("timestamp")
    early = F.add_months(F.to_date(day), -12 * (F.col("user_id") % 30).cast("int"))
    month, iso = F.date_format(early, "yyyy-MM"), F.date_format(early, "yyyy-MM-dd")
    made = F.when(e % 4 == 0, F.concat(F.lit("policy in "), F.year(early).cast("string"))).when(e % 4 == 1, F.concat(F.lit("floods Since "), month)).when(e % 4 == 2, F.concat(F.lit("votes between  "), F.year(early).cast("string"), F.lit(" and "), iso)).otherwise(F.concat(F.lit("from "), iso, F.lit(" through "), month))
    more = table(spark, sf_dir, "events").select((e + 1_000_000).cast("int").alias("id"), made.alias("q"))
    return literal(spark, "id int, q string", QUESTIONS).unionByName(more).select("id", b["lo"].cast("string").alias("lo"), b["hi"].cast("string").alias("hi")).where("lo IS NOT NULL")


ARCHIVE_SQL = f"""WITH e AS (SELECT event_id, CAST(CAST(ts AS DATE) - to_months(CAST(12 * (user_id % 30) AS INTEGER)) AS DATE) AS d FROM events), m AS (SELECT CAST(event_id + 1000000 AS INTEGER) AS id, CASE event_id % 4 WHEN 0 THEN make_date(year(d), 1, 1) WHEN 1 THEN date_trunc('month', d) WHEN 2 THEN make_date(year(d), 1, 1) ELSE d END AS lo,
  CASE event_id % 4 WHEN 0 THEN make_date(year(d), 12, 31) WHEN 2 THEN d WHEN 3 THEN last_day(d) END AS hi, event_id % 4 AS k FROM e)
SELECT id, CAST(CAST(lo AS DATE) AS VARCHAR) AS lo, CAST(hi AS VARCHAR) AS hi FROM m WHERE CASE WHEN k IN (0, 1) THEN year(lo) < 2026 ELSE hi < DATE '{TODAY}' END
UNION ALL SELECT * FROM (VALUES (8, '2019-01-01', '2019-12-31'), (9, '2018-03-01', NULL), (10, '2015-01-01', '2017-06-30'), (17, '2024-02-01', '2024-02-29')) t(id, lo, hi)"""


def extract_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.extract_date(F.col("raw"), F.col("url"))
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).cast("int").alias("id"), F.col("text").alias("raw"), F.concat(F.lit("https://a.org/"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("doc_id").cast("int") % 2500), "yyyy/MM/dd"), F.lit("/x")).alias("url"))
    return literal(spark, "id int, raw string, url string", RAW_DATES).unionByName(docs).select("id", e["day"].cast("string").alias("day"), e["evidence"].alias("evidence"))


def _sql_date(y: str, m: str, d: str) -> str:
    return f"TRY_CAST({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"


def _g(col: str, pattern: str, k: int) -> str:
    return f"regexp_extract({col}, {S.lit(pattern)}, {k})"


_MON = lambda x: f"CAST(list_position([{S.words(D.MONTHS)}], lower({x}[1:3])) AS VARCHAR)"
DATES_SQL = f"""WITH a AS (SELECT id, coalesce(raw, '') AS t, coalesce(url, '') AS u FROM (SELECT id, raw, url FROM {sql_literal("id, raw, url", RAW_DATES)} UNION ALL SELECT doc_id + 1000, text, 'https://a.org/' || strftime(DATE '2020-01-01' + CAST(doc_id % 2500 AS INTEGER), '%Y/%m/%d') || '/x' FROM documents)),
b AS (SELECT id, {_sql_date(_g("t", D.ISO, 1), _g("t", D.ISO, 2), _g("t", D.ISO, 3))} AS iso, {_sql_date(_g("u", D.IN_PATH, 1), _g("u", D.IN_PATH, 2), _g("u", D.IN_PATH, 3))} AS pth,
 {_sql_date(_g("t", D.WRITTEN, 3), _MON(_g("t", D.WRITTEN, 2)), _g("t", D.WRITTEN, 1))} AS w, {_sql_date(_g("t", D.WRITTEN_US, 3), _MON(_g("t", D.WRITTEN_US, 1)), _g("t", D.WRITTEN_US, 2))} AS us FROM a)
SELECT CAST(id AS INTEGER) AS id, CAST(coalesce(iso, pth, w, us) AS VARCHAR) AS day, CASE WHEN iso IS NOT NULL THEN 'snippet_iso' WHEN pth IS NOT NULL THEN 'url_path' WHEN w IS NOT NULL OR us IS NOT NULL THEN 'snippet_written' ELSE '' END AS evidence FROM b"""


def normalize_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, at = F.col("event_id"), F.col("ts").cast("timestamp")
    forms = [F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")), F.concat(F.lit("Mon, "), F.date_format(at, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")), F.date_format(at, "yyyy-MM-dd"), F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("-0800"))]
    more = table(spark, sf_dir, "events").select((e + 1000).cast("int").alias("id"), F.element_at(F.array(*forms), (e % len(forms) + 1).cast("int")).alias("raw"))
    return literal(spark, "id int, raw string", STAMPS).unionByName(more).select("id", D.normalize_timestamp(F.col("raw")).cast("string").alias("day"))


STAMPS_SQL = """SELECT CAST(event_id + 1000 AS INTEGER) AS id, CAST(CAST(CASE event_id % 6 WHEN 2 THEN ts - INTERVAL 330 MINUTES WHEN 5 THEN ts + INTERVAL 8 HOURS ELSE ts END AS DATE) AS VARCHAR) AS day FROM events UNION ALL SELECT * FROM (VALUES (1, '2026-10-19'), (2, '2026-10-20'), (3, '2026-10-19'), (4, '2026-10-28'), (5, NULL), (6, NULL), (7, NULL), (8, '2026-10-19'), (9, '2026-10-18'), (10, NULL), (11, '2026-10-19')) t(id, day)"""


def http_status_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.status_class(F.col("status"))
    return literal(spark, "id int, status int, body string", ANSWERS).select("id", c["kind"].alias("kind"), c["detail"].alias("detail"), I.block_kind(F.col("body"), F.col("status")).alias("block"))


STATUS_SQL = f"""WITH a AS (SELECT *, CASE WHEN status IN (301, 302, 303, 307, 308) THEN 'redirect_loop' WHEN status = 404 THEN 'not_found' WHEN status IN (401, 403) THEN 'denied' WHEN status = 429 THEN 'rate_limited' WHEN status BETWEEN 500 AND 599 THEN 'server_error' ELSE 'unavailable' END AS kind FROM {sql_literal("id, status, body", ANSWERS)})
SELECT id, kind, CASE WHEN kind = 'redirect_loop' THEN kind ELSE 'http_' || status END AS detail, CASE WHEN status = 429 THEN 'rate_limited' WHEN regexp_matches(lower(coalesce(body, '')), '{"|".join(I.CAPTCHA)}') THEN 'captcha' WHEN regexp_matches(lower(coalesce(body, '')), '{"|".join(I.RATE)}') THEN 'rate_limited' END AS block FROM a"""


def feed_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six publishers most likely to cover each question: region, topics in common, tier."""
    feeds = literal(spark, "place int, name string, domain string, region string, topics string, tier int", [(i, *f) for i, f in enumerate(I.FEEDS)])
    about = asked(spark, sf_dir).select("id", I.region(F.col("q")).alias("wanted"), I.topics(F.col("q")).alias("about"))
    common = F.size(F.array_intersect("about", F.split("topics", ",")))
    by_region = F.when(F.col("region") == F.col("wanted"), 4.0).when(F.col("region").startswith(F.concat("wanted", F.lit("-"))), 2.5).otherwise(0.0)
    score = F.coalesce(by_region, F.lit(0.0)) + 1.5 * common + F.when(F.col("tier") == 1, 0.5).otherwise(0.0) + F.when(F.col("wanted").isNull() & (common == 0), 0.1).otherwise(0.0)
    met = about.join(F.broadcast(feeds), F.lit(True)).withColumn("score", score)
    best = met.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "place"))).where("nth <= 6")
    return best.select("id", "nth", "name", micro(F.col("score")).alias("score"))


FEEDS_SQL = f"""WITH a AS (SELECT id, lower({S.squeeze("coalesce(q, '')")}) AS low FROM {_Q}),
b AS (SELECT id, CASE {" ".join(f"WHEN {_has(w)} THEN '{n}'" for n, w in I.REGIONS)} END AS wanted, list_filter([{", ".join(f"CASE WHEN {_has(w)} THEN '{n}' END" for n, w in I.TOPICS.items())}], lambda x: x IS NOT NULL) AS about FROM a),
f AS (SELECT * FROM {sql_literal("place, name, domain, region, topics, tier", [(i, *f) for i, f in enumerate(I.FEEDS)])}),
s AS (SELECT id, name, place, coalesce(CASE WHEN region = wanted THEN 4.0 WHEN starts_with(region, wanted || '-') THEN 2.5 END, 0.0) + 1.5 * len(list_intersect(about, string_split(topics, ','))) + CASE WHEN tier = 1 THEN 0.5 ELSE 0.0 END + CASE WHEN wanted IS NULL AND len(list_intersect(about, string_split(topics, ','))) = 0 THEN 0.1 ELSE 0.0 END AS score FROM b, f)
SELECT id, nth, name, {sql_micro("score")} AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, place) AS nth FROM s) WHERE nth <= 6"""


def conversation_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of answers that turns of conversations ask for, by role."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role", I.answer_type(F.col("text")).alias("kind")).agg(F.count("*").alias("n"), F.count_if(I.is_news(F.col("text"))).alias("news"))


CONVERSATIONS_SQL = f"""WITH a AS (SELECT role, {S.squeeze("coalesce(text, '')")} AS t, lower({S.squeeze("coalesce(text, '')")}) AS low FROM conversations)
SELECT role, CASE WHEN {_M(I.ERROR, "t")} THEN 'error' WHEN {_M(I.COMPARISON)} THEN 'comparison' WHEN {_M(I.PROCEDURE)} THEN 'procedure' WHEN {_M(I.CURRENT)} THEN CASE WHEN {_M(I.STATISTIC)} THEN 'statistic' ELSE 'current_event' END
  WHEN {_M(I.YEAR)} OR {_M(I.STATISTIC)} THEN 'statistic' WHEN {_M(I.DEFINITION)} THEN CASE WHEN starts_with(low, 'how many') THEN 'entity_lookup' ELSE 'definition' END ELSE 'general' END AS kind, count(*) AS n, count(*) FILTER ({_M(I.NEWS)} OR {_M(I.SPAN)} OR {_M(r"\b(today|tonight|this morning|right now|as of today|yesterday)\b")} OR {_M(r"\b(this|the past|the last)\s+(week|month)\b")}) AS news FROM a GROUP BY 1, 2"""

QUERIES = {
    "classify_questions": classify_questions, "archive_ranges": archive_ranges, "extract_dates": extract_dates, "normalize_stamps": normalize_stamps, "http_status_classes": http_status_classes,
    "feed_selection": feed_selection, "conversation_intents": conversation_intents,
}
SQL = {
    "classify_questions": CLASSIFY_SQL, "archive_ranges": ARCHIVE_SQL, "extract_dates": DATES_SQL, "normalize_stamps": STAMPS_SQL, "http_status_classes": STATUS_SQL,
    "feed_selection": FEEDS_SQL, "conversation_intents": CONVERSATIONS_SQL,
}
