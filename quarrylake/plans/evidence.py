"""Queries on results as evidence: snippets, dates, conflicts, merges, verification, reasons, chains, archive and feed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import score as C
from ..functions import text as T
from ..functions import url as U
from ..operators import evidence as V
from ..operators import ranking as R
from . import ranking as K
from . import sqltext as S
from . import urls
from .inputs import checkpoints, literal, micro, sql_literal, sql_micro, stored, table

_R4 = "floor(({0}) * 10000 + 0.5) / 10000"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' hits with their canonical URLs, and two more for some pages: a terse one, and boilerplate."""
    hits = K.hits(spark, sf_dir).withColumn("canonical", U.canonical(F.col("url")))
    some = hits.where("arrival_seq % 3 = 0")
    price = some.withColumn("snippet", F.concat(F.lit("Price 12 of "), F.substring("snippet", 1, 40))).withColumn("arrival_seq", F.col("arrival_seq") + 100_000)
    plate = some.withColumn("snippet", F.concat(F.lit("Welcome to our site. Learn more about "), F.substring("snippet", 1, 90))).withColumn("arrival_seq", F.col("arrival_seq") + 200_000)
    return hits.unionByName(price).unionByName(plate)


_MORE = f"""{K._HITS}, h3 AS (SELECT question_id, arrival_seq, canonical, url, title, snippet, published_at FROM hits UNION ALL
  SELECT question_id, arrival_seq + 100000, canonical, url, title, 'Price 12 of ' || left(snippet, 40), published_at FROM hits WHERE arrival_seq % 3 = 0 UNION ALL
  SELECT question_id, arrival_seq + 200000, canonical, url, title, 'Welcome to our site. Learn more about ' || left(snippet, 90), published_at FROM hits WHERE arrival_seq % 3 = 0)"""
_QUESTIONS = [*K.QUESTIONS[:3], (3, "price der ung schkeit"), (4, "")]


def best_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.best_snippets(_hits(spark, sf_dir), literal(spark, "question_id long, question string", _QUESTIONS))


SNIPPETS_SQL = f"""WITH {_MORE}, q AS (SELECT question_id, question, list_filter({S.terms('question')}, lambda t: length(t) > 2) AS wanted, regexp_matches(question, {S.lit(V.FACTOID)}) AS factoid FROM {sql_literal('question_id, question', _QUESTIONS)}),
r AS (SELECT h3.*, wanted, factoid, len(list_filter(wanted, lambda t: contains(lower(snippet), t))) AS c FROM h3 JOIN q USING (question_id) WHERE canonical IS NOT NULL AND snippet <> ''),
v AS (SELECT *, CASE WHEN len(wanted) > 0 THEN c + c / greatest(1, len(list_filter(string_split_regex(lower(snippet), '\\s+'), lambda w: w <> ''))) - CASE WHEN regexp_matches(snippet, {S.lit(V.BOILERPLATE)}) THEN 2.0 ELSE 0 END + CASE WHEN factoid AND regexp_matches(snippet, '[0-9]') THEN 0.75 ELSE 0 END ELSE 0 END AS value FROM r),
b AS (SELECT question_id, canonical, arg_max({{'s': snippet, 'c': c}}, (value, -arrival_seq)) AS best, arg_max(snippet, (length(snippet), -arrival_seq)) AS longest FROM v GROUP BY question_id, canonical)
SELECT question_id, canonical, CASE WHEN best.c > 0 THEN best.s ELSE longest END AS snippet FROM b"""

EVIDENCE = ["jsonld:datePublished", "rss:pubDate", "meta:article:published_time", "time:datetime", "snippet_iso", "", "meta:og:article:published_time"]


def date_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = K.hits(spark, sf_dir).withColumn("canonical", U.canonical(F.col("url"))).where("canonical IS NOT NULL")
    told = hits.withColumn("date_evidence", F.element_at(F.array(*[F.lit(e) for e in EVIDENCE]), (F.col("arrival_seq") % len(EVIDENCE) + 1).cast("int")))
    return V.dated_groups(told)


CONFIDENCE_SQL = f"""WITH {K._HITS}, e AS (SELECT question_id, canonical, published_at, [{S.words(EVIDENCE)}][arrival_seq % {len(EVIDENCE)} + 1] AS ev FROM hits WHERE canonical IS NOT NULL)
SELECT question_id, canonical, ['', 'low', 'medium', 'high'][max(CASE WHEN published_at IS NULL THEN 1 WHEN regexp_matches(ev, '^(jsonld:|meta:article|meta:og:article)') THEN 4 WHEN regexp_matches(ev, '^(rss|time):') THEN 3 ELSE 2 END)] AS confidence FROM e GROUP BY question_id, canonical"""

FIGURES = [
    (10, 1, "https://a.org/1", "Growth of 5%", "It was 5.1% last year"), (10, 2, "https://b.org/1", "Growth of 7 percent", "cost $20"), (10, 3, "https://c.org/1", "Up 5.2 percent", "cost $20.5"), (10, 4, "https://a.org/2", "down 0%", "price 30 usd"),
    (11, 1, "https://a.org/1", "3 million", "x"), (11, 2, "https://www.a.org/2", "9 million", "x"), (12, 1, "https://a.org/1", "nothing", None), (12, 2, "https://b.org/1", None, "1,200 items"), (12, 3, "https://c.org/1", "1,500 items", "2,000 more"),
]


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits of pages as ranked results: forty to a question."""
    hits = K.hits(spark, sf_dir).select((F.floor(F.col("arrival_seq") / 40) + 100).cast("long").alias("question_id"), F.col("arrival_seq").alias("place"), "url", "title", F.concat_ws(" ", "snippet", F.concat((F.col("arrival_seq") % 9).cast("string"), F.lit(" percent"))).alias("snippet"), "published_at")
    return hits.unionByName(literal(spark, "question_id long, place long, url string, title string, snippet string", FIGURES), allowMissingColumns=True)


def conflict_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.conflicts(_ranked(spark, sf_dir))
    text = lambda c: F.array_join(F.transform("sides", lambda s: F.coalesce(s[c].cast("string"), F.lit("-"))), "|").alias(f"{c}s")
    return found.select("question_id", "unit", F.array_join(F.transform("values", lambda v: F.floor(v * 1000 + 0.5).cast("long").cast("string")), ",").alias("values"), micro(F.col("spread")).alias("spread"), text("url"), text("domain"), text("published_at"))


_UNIT = "CASE u " + " ".join(f"WHEN {S.lit(k)} THEN {S.lit(v)}" for k, v in T.UNITS.items() if k) + " ELSE 'count' END"
CONFLICTS_SQL = f"""WITH RECURSIVE {K._HITS}, rk AS (SELECT arrival_seq // 40 + 100 AS question_id, arrival_seq AS place, url, title, concat_ws(' ', snippet, (arrival_seq % 9) || ' percent') AS snippet, published_at FROM hits UNION ALL SELECT *, NULL FROM {sql_literal('question_id, place, url, title, snippet', FIGURES)}),
n AS (SELECT question_id, place, url, published_at, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS dom, unnest(list_zip(regexp_extract_all(concat_ws(' ', title, snippet), {S.lit(T.MEASURE)}, 1), regexp_extract_all(concat_ws(' ', title, snippet), {S.lit(T.MEASURE)}, 2))) AS p FROM rk),
u AS (SELECT question_id, place, dom, url, published_at, CAST(replace(p[1], ',', '') AS DOUBLE) AS value, lower(regexp_replace(coalesce(p[2], ''), '\\s+', ' ', 'g')) AS u, row_number() OVER () AS o FROM n),
f AS (SELECT question_id, place, dom, url, published_at, {_UNIT} AS unit, arg_min(value, o) AS value FROM u GROUP BY ALL),
g AS (SELECT question_id, unit, place, value, {{'v': value, 'u': url, 'd': dom, 'p': coalesce(CAST(published_at AS VARCHAR), '-')}} AS side, row_number() OVER (PARTITION BY question_id, unit ORDER BY place, value) AS k FROM f WHERE (question_id, unit) IN (SELECT (question_id, unit) FROM f GROUP BY question_id, unit HAVING count(DISTINCT dom) >= 2)),
w AS (SELECT question_id, unit, k, [value] AS kept, [side] AS sides FROM g WHERE k = 1 UNION ALL
  SELECT g.question_id, g.unit, g.k, CASE WHEN len(list_filter(kept, lambda v: v = g.value OR (least(abs(v), abs(g.value)) <> 0 AND (greatest(abs(v), abs(g.value)) - least(abs(v), abs(g.value))) / least(abs(v), abs(g.value)) <= 0.05))) = 0 THEN list_append(kept, g.value) ELSE kept END,
   CASE WHEN len(list_filter(kept, lambda v: v = g.value OR (least(abs(v), abs(g.value)) <> 0 AND (greatest(abs(v), abs(g.value)) - least(abs(v), abs(g.value))) / least(abs(v), abs(g.value)) <= 0.05))) = 0 THEN list_append(sides, g.side) ELSE sides END FROM w JOIN g ON g.question_id = w.question_id AND g.unit = w.unit AND g.k = w.k + 1),
z AS (SELECT question_id, unit, list_sort(arg_max(kept, k)) AS vals, arg_max(sides, k) AS sides FROM w GROUP BY question_id, unit)
SELECT question_id, unit, array_to_string(list_transform(vals, lambda v: CAST(floor(v * 1000 + 0.5) AS BIGINT)), ',') AS "values", {sql_micro('CASE WHEN vals[1] <> 0 THEN ' + _R4.format('vals[-1] / vals[1]') + ' END')} AS spread,
 array_to_string(list_transform(sides, lambda x: x.u), '|') AS urls, array_to_string(list_transform(sides, lambda x: x.d), '|') AS domains, array_to_string(list_transform(sides, lambda x: x.p), '|') AS published_ats FROM z WHERE len(vals) >= 2"""


def sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = literal(spark, "question_id long, url string, published_at date", [(20, "https://a.org/1", None), (20, "https://b.org/2", None), (21, "https://a.org/1", None), (21, "https://www.a.org/2", None)])
    return V.sufficiency(K.hits(spark, sf_dir).select("question_id", "url", "published_at").unionByName(more))


SUFFICIENCY_SQL = f"""WITH {K._HITS}, r AS (SELECT question_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS dom, published_at FROM hits UNION ALL SELECT question_id, dom, NULL FROM (VALUES (20, 'a.org'), (20, 'b.org'), (21, 'a.org'), (21, 'a.org')) t(question_id, dom)),
s AS (SELECT question_id, count(DISTINCT dom) AS independent_domains, count(*) AS results, count(published_at) AS dated_results FROM r GROUP BY question_id)
SELECT *, CASE WHEN independent_domains < 2 THEN 'insufficient' WHEN dated_results = 0 THEN 'undated' ELSE 'sourced' END AS label FROM s"""


def merge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(checkpoints(spark), sf_dir)
    near = R.near_titles(R.merge_canonical(hits), threshold=0.5)
    return V.merge_log(hits, near).groupBy("question_id", "reason", "kept").agg(F.count("*").alias("merged"), F.min("similarity").alias("least")).withColumn("least", micro(F.col("least")))


WIRE = [
    (30, 1, "https://www.reuters.com/a", "Flood waters rise in the old river town overnight"), (30, 2, "https://small.example.net/b", "Reuters: Flood waters rise in the old river town overnight"), (30, 3, "https://other.example.com/c", "Flood waters rise in the old river town overnight - live"), (30, 4, "https://x.org/d", "Tea prices fall"),
    (31, 1, "https://tiny.example.org/a", "Parliament passes new water law after long debate"), (31, 2, "https://www.bbc.com/b", "Parliament passes new water law after long debate"), (31, 3, "https://tiny.example.org/c", "Parliament passes new water law after long debate"), (32, 1, "https://a.org/1", None), (32, 2, "https://b.org/1", None),
]


def syndicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among all groups of pages, before they are ranked, and among given wire stories; what is kept gets their hits."""
    checkpoints(spark)
    groups = R.merge_canonical(K.hits(spark, sf_dir)).unionByName(R.merge_canonical(literal(spark, "question_id long, arrival_seq long, url string, title string", WIRE).withColumns({"engine": F.lit("e"), "position": F.col("arrival_seq").cast("int"), "snippet": F.lit(""), "published_at": F.lit(None).cast("date")})))
    groups = stored(groups, "groups")
    moved = V.syndicated(groups.withColumnRenamed("arrival_seq", "place"), 0.5)
    merged, log = V.merge_syndicated(groups, moved)
    gained = merged.join(log.select("question_id", F.col("kept").alias("url")).distinct(), ["question_id", "url"], "left_semi").select("question_id", F.lit("kept").alias("what"), "url", F.col("hits").cast("string").alias("told"))
    return gained.unionByName(log.select("question_id", F.lit("merged").alias("what"), F.col("merged").alias("url"), F.col("kept").alias("told")))


def _news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.news_scored(K._scored(spark, sf_dir), K.today())


def news_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = R.top_k(_news(spark, sf_dir), 8)
    return best.select("question_id", "place", "url", *[micro(F.col(c)).alias(c) for c in ("freshness", "source_quality", "score")])


def news_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best news results held against the pages' own text and dates."""
    best = R.top_k(_news(spark, sf_dir), 8)
    html = F.col("html")
    day = F.when(F.col("page_id") % 2 == 0, F.date_add(F.lit("2026-12-01").cast("date"), (F.col("page_id") % 29).cast("int")))
    pages = table(spark, sf_dir, "pages").select("url", F.regexp_replace(html, "<[^>]+>", " ").alias("content"), day.alias("published_at"), "page_id").where("page_id % 3 <> 0")
    once = pages.groupBy("url").agg(F.min_by("content", "page_id").alias("content"), F.min_by("published_at", "page_id").alias("published_at"))
    found = V.verified(best, once, K.questions(spark), K.today())
    return found.withColumn("score", micro(F.col("score"))).withColumn("published_at", F.col("published_at").cast("string"))


OUTCOMES = [
    (1, 1, "a", "results", None), (1, 2, "b", "failed", "captcha"), (2, 1, "a", "empty", None), (2, 2, "b", "empty", None), (3, 1, "a", "failed", "timeout"), (3, 2, "b", "skipped", "circuit_open"), (4, 1, "a", "results", None), (5, 1, "b", "results", None), (5, 2, "a", "results", None),
]
COUNTS = [(1, 5, "good", 0, 0), (4, 0, "unknown", 3, 2), (5, 7, "low", 0, 0)]


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, seq, engine, status, kind): the calls above, and events as calls of engines for the question of each user."""
    status = F.when(F.col("event_type") == "error", F.when(F.col("user_id") % 2 == 0, "failed").otherwise("skipped")).when(F.col("user_id") % 3 == 0, "empty").otherwise("results")
    calls = table(spark, sf_dir, "events").select((F.col("user_id") + 100).cast("long").alias("question_id"), F.col("event_id").cast("long").alias("seq"), F.concat(F.lit("e"), (F.col("event_id") % 4).cast("string")).alias("engine"), status.alias("status"), F.when(F.col("event_type") == "error", F.lit("timeout")).alias("kind"))
    return literal(spark, "question_id long, seq long, engine string, status string, kind string", OUTCOMES).unionByName(calls)


_OUTCOMES = f"o AS (SELECT question_id, seq, engine, status, kind FROM {sql_literal('question_id, seq, engine, status, kind', OUTCOMES)} UNION ALL SELECT user_id + 100, event_id, 'e' || (event_id % 4), CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'failed' ELSE 'skipped' END WHEN user_id % 3 = 0 THEN 'empty' ELSE 'results' END, CASE WHEN event_type = 'error' THEN 'timeout' END FROM events)"


def result_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = _outcomes(spark, sf_dir)
    n = (F.col("question_id") % 4).cast("int")
    more = outcomes.where("question_id >= 100").select("question_id").distinct().select("question_id", n.alias("n"), F.when(n == 2, "low").otherwise("good").alias("coverage"), n.alias("dropped"), F.lit(1).alias("non_public"))
    return V.reasons(outcomes, literal(spark, "question_id long, n int, coverage string, dropped int, non_public int", COUNTS).unionByName(more))


REASONS_SQL = f"""WITH {_OUTCOMES}, c AS (SELECT * FROM {sql_literal('question_id, n, coverage, dropped, non_public', COUNTS)} UNION ALL SELECT DISTINCT question_id, question_id % 4, CASE WHEN question_id % 4 = 2 THEN 'low' ELSE 'good' END, question_id % 4, 1 FROM o WHERE question_id >= 100),
p AS (SELECT question_id, string_agg(DISTINCT engine, ', ' ORDER BY engine) FILTER (status = 'results') AS served, string_agg(DISTINCT engine, ', ' ORDER BY engine) FILTER (status IN ('failed', 'skipped')) AS failed, string_agg(engine || ': ' || kind, ', ' ORDER BY seq) FILTER (status IN ('failed', 'skipped')) AS told FROM o GROUP BY question_id),
r AS (SELECT p.*, coalesce(n, 0) AS n, coalesce(dropped, 0) AS dropped, coalesce(non_public, 0) AS np, CASE WHEN n > 0 AND coverage = 'low' THEN 'low_coverage' WHEN n > 0 THEN 'none' WHEN served IS NOT NULL THEN 'filtered_out' WHEN failed IS NOT NULL THEN 'engines_failed' ELSE 'no_hits' END AS reason FROM p LEFT JOIN c USING (question_id))
SELECT CAST(question_id AS BIGINT) AS question_id, reason, CASE reason WHEN 'none' THEN n || ' results from ' || coalesce(served, 'search engines') || CASE WHEN failed IS NOT NULL THEN '; degraded: ' || failed || ' failed or were skipped' ELSE '' END WHEN 'low_coverage' THEN n || ' results, but they do not address the question; treat them as generic filler, not evidence'
  WHEN 'filtered_out' THEN 'no results left after filtering (' || dropped || ' dropped by filters, ' || np || ' non-public URLs removed)' WHEN 'engines_failed' THEN 'search failed: no engine produced results (' || told || ')' ELSE 'no results: every engine answered with zero hits' END AS summary FROM r"""


def filler_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.filler_risk(_outcomes(spark, sf_dir))


FILLER_SQL = f"WITH {_OUTCOMES} SELECT CAST(question_id AS BIGINT) AS question_id, bool_or(status IN ('failed', 'skipped')) AS degraded, bool_or(status IN ('failed', 'skipped')) AND count(DISTINCT engine) FILTER (status = 'results') BETWEEN 1 AND count(DISTINCT engine) - 1 AS filler_risk FROM o GROUP BY question_id"


def paid_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).select(u.cast("long").alias("question_id"), (u % 2 == 0).alias("configured"), (u % 3 == 0).alias("explicit"), (u % 7 == 0).alias("already"), (u % 5).alias("free_engines"), F.element_at(F.array(F.lit("low"), F.lit("partial"), F.lit("good")), (u % 3 + 1).cast("int")).alias("coverage"), (u % 4 == 0).alias("on_low"))
    return V.paid_fallback(rows)


PAID_SQL = """WITH s AS (SELECT DISTINCT user_id AS q, user_id % 2 = 0 AS cfg, user_id % 3 = 0 AS expl, user_id % 7 = 0 AS done, user_id % 5 < 2 AS short, user_id % 3 = 0 AS low, user_id % 4 = 0 AS allowed FROM events)
SELECT CAST(q AS BIGINT) AS question_id, done OR (cfg AND (short OR (low AND allowed))) AS attempted, CASE WHEN done AND expl THEN 'explicit_engine' WHEN done THEN 'keyless_chain_exhausted' WHEN cfg AND low AND allowed THEN 'low_coverage' WHEN cfg AND short THEN 'keyless_chain_exhausted' WHEN cfg AND low THEN 'low_coverage_not_enabled' WHEN NOT cfg THEN 'not_configured' ELSE 'not_needed' END AS trigger FROM s"""


def query_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of pages as answers to up to eight forms of each question; coverage turns good at a form that depends on the question."""
    hits = K.hits(spark, sf_dir).withColumn("canonical", U.canonical(F.col("url"))).where("canonical IS NOT NULL").withColumn("seq", F.col("arrival_seq") % 8)
    forms = hits.groupBy("question_id", "seq").agg(F.collect_set("canonical").alias("urls")).withColumn("coverage", F.when(F.col("seq") < F.col("question_id") % 4, "partial").otherwise("good"))
    return V.query_prefix(forms, 12)


PREFIX_SQL = f"""WITH {K._HITS}, p AS (SELECT question_id, canonical, min(arrival_seq % 8) AS seq FROM hits WHERE canonical IS NOT NULL GROUP BY question_id, canonical), f AS (SELECT DISTINCT question_id, arrival_seq % 8 AS seq FROM hits WHERE canonical IS NOT NULL),
c AS (SELECT f.question_id, f.seq, (SELECT count(*) FROM p WHERE p.question_id = f.question_id AND p.seq <= f.seq) AS pages FROM f)
SELECT question_id, seq, pages FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.question_id = c.question_id AND d.seq < c.seq AND d.pages >= 12 AND d.seq >= d.question_id % 4)"""

ENGINES = [("duckduckgo", True), ("bing", True), ("mojeek", False), ("wikipedia", True), ("semantic-search", False)]
ALIASES = [("browser-search", 0, "duckduckgo"), ("browser-search", 1, "bing"), ("semantic-search", 0, "semantic-search")]
REQUESTED = [(1, 1, "bing"), (1, 2, "browser-search"), (2, 1, "browser-search"), (2, 2, "wikipedia"), (2, 3, "bing"), (3, 1, "nosuch"), (3, 2, "semantic-search"), (3, 3, "mojeek"), (3, 4, "mojeek")]


def engine_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("bing", "browser-search", "mojeek", "wikipedia", "semantic-search", "nosuch")])
    more = table(spark, sf_dir, "events").select((F.col("user_id") + 100).cast("long").alias("request_id"), F.col("event_id").cast("long").alias("seq"), F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("name"))
    asked = literal(spark, "request_id long, seq long, name string", REQUESTED).unionByName(more)
    return V.chains(asked, literal(spark, "name string, available boolean", ENGINES), literal(spark, "name string, nth int, engine string", ALIASES))


CHAINS_SQL = f"""WITH a AS (SELECT request_id, seq, name FROM {sql_literal('request_id, seq, name', REQUESTED)} UNION ALL SELECT user_id + 100, event_id, ['bing', 'browser-search', 'mojeek', 'wikipedia', 'semantic-search', 'nosuch'][event_id % 6 + 1] FROM events),
x AS (SELECT request_id, seq, coalesce(l.nth, 0) AS sub, coalesce(l.engine, a.name) AS engine FROM a LEFT JOIN {sql_literal('name, nth, engine', ALIASES).replace('AS t(', 'AS l(')} ON l.name = a.name), m AS (SELECT request_id, engine, min((seq, sub)) AS at_ FROM x GROUP BY ALL)
SELECT CAST(request_id AS BIGINT) AS request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY at_) AS INTEGER) AS nth, engine, available FROM m LEFT JOIN {sql_literal('name, available', ENGINES).replace('AS t(', 'AS e(')} ON e.name = m.engine"""

ASKED = [(0, "reading the river page", None, None), (1, "page one two", "2026-03-01", "2026-09-30"), (2, "about docs", None, "2026-06-30"), (3, "", None, None)]


def _asked(spark: SparkSession) -> DataFrame:
    rows = literal(spark, "question_id long, question string, date_from string, date_to string", ASKED)
    return rows.withColumn("date_from", F.col("date_from").cast("date")).withColumn("date_to", F.col("date_to").cast("date"))


def archive_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as rows of sitemaps, for questions with words that their URLs hold."""
    i = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(i.cast("long").alias("seq"), "url", F.when(i % 2 == 0, F.lit("A page to read")).alias("title"), F.when(i % 4 == 0, F.date_add(F.lit("2026-01-01").cast("date"), (i % 365).cast("int"))).alias("publication_date"), F.when(i % 3 == 0, F.date_add(F.lit("2026-02-01").cast("date"), (i % 200).cast("int"))).alias("lastmod"))
    return V.archive_hits(rows, _asked(spark), 20).withColumn("published_at", F.col("published_at").cast("string")).withColumn("modified_at", F.col("modified_at").cast("string")).drop("title")


_ASKED = f"q AS (SELECT question_id, {S.terms('question')} AS wanted, CAST(date_from AS DATE) AS lo, CAST(date_to AS DATE) AS hi FROM {sql_literal('question_id, question, date_from, date_to', ASKED)})"
ARCHIVE_SQL = f"""WITH {_ASKED}, r AS (SELECT page_id AS seq, url, {S.terms("concat_ws(' ', CASE WHEN page_id % 2 = 0 THEN 'A page to read' END, regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '[/_.-]', ' ', 'g'))")} AS words, CASE WHEN page_id % 4 = 0 THEN DATE '2026-01-01' + CAST(page_id % 365 AS INTEGER) END AS p, CASE WHEN page_id % 3 = 0 THEN DATE '2026-02-01' + CAST(page_id % 200 AS INTEGER) END AS m FROM pages WHERE regexp_matches(url, '(?i)^https?://[^/?#]+')),
k AS (SELECT question_id, seq, url, p, m FROM r JOIN q ON list_has_any(words, wanted) WHERE (lo IS NULL OR coalesce(p, m) >= lo) AND (hi IS NULL OR coalesce(p, m) <= hi) QUALIFY row_number() OVER (PARTITION BY question_id, url ORDER BY seq) = 1)
SELECT CAST(question_id AS BIGINT) AS question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY seq) AS INTEGER) AS position, url, CAST(p AS VARCHAR) AS published_at, CAST(m AS VARCHAR) AS modified_at, CASE WHEN p IS NOT NULL THEN 'publication' WHEN m IS NOT NULL THEN 'revision' ELSE '' END AS date_kind, CASE WHEN p IS NOT NULL THEN 'sitemap:news:publication_date' WHEN m IS NOT NULL THEN 'sitemap:lastmod' ELSE '' END AS evidence FROM k QUALIFY position <= 20"""


def feed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' hits as entries of three feeds."""
    entries = K.hits(spark, sf_dir).select(F.col("engine").alias("feed"), F.col("arrival_seq").cast("long").alias("seq"), "url", "title", F.concat_ws(" ", "snippet", F.lit("reading of the river")).alias("snippet"), "published_at")
    return V.feed_hits(entries, _asked(spark), 1, 15).withColumn("published_at", F.col("published_at").cast("string"))


FEEDS_SQL = f"""WITH {K._HITS}, {_ASKED}, e AS (SELECT engine AS feed, arrival_seq AS seq, url, published_at, {S.terms("concat_ws(' ', title, snippet, 'reading of the river')")} AS words FROM hits),
kept AS (SELECT question_id, feed, seq, url, published_at, row_number() OVER (PARTITION BY question_id, feed ORDER BY seq) AS nth FROM e JOIN q ON list_has_any(words, wanted) WHERE published_at IS NULL OR ((lo IS NULL OR published_at >= lo) AND (hi IS NULL OR published_at <= hi)))
SELECT CAST(question_id AS BIGINT) AS question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY published_at DESC NULLS LAST, nth, feed) AS INTEGER) AS position, feed, url, CAST(published_at AS VARCHAR) AS published_at FROM kept QUALIFY position <= 15"""

QUERIES = {
    "best_snippets": best_snippets, "date_confidence": date_confidence, "conflict_report": conflict_report, "sufficiency": sufficiency, "merge_log": merge_log, "syndicated": syndicated, "news_topk": news_topk, "news_verified": news_verified, "result_reasons": result_reasons, "filler_risk": filler_risk,
    "paid_fallback": paid_fallback, "query_prefix": query_prefix, "engine_requests": engine_requests, "archive_hits": archive_hits, "feed_hits": feed_hits,
}
SQL = {
    "best_snippets": SNIPPETS_SQL, "date_confidence": CONFIDENCE_SQL, "conflict_report": CONFLICTS_SQL, "sufficiency": SUFFICIENCY_SQL, "result_reasons": REASONS_SQL, "filler_risk": FILLER_SQL, "paid_fallback": PAID_SQL, "query_prefix": PREFIX_SQL, "engine_requests": CHAINS_SQL, "archive_hits": ARCHIVE_SQL, "feed_hits": FEEDS_SQL,
}
