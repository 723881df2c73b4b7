"""Queries from hits to ranked results, stories and trends. Pages play the hits of five questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import score as C
from ..functions import text as T
from ..functions import url as U
from ..operators import ranking as R
from . import sqltext as S
from . import urls
from .inputs import checkpoints, literal, micro, sql_literal, sql_micro, table
from .texts import TITLE

QUESTIONS = [(0, "the thering and reading of thand"), (1, "des queaux et la tionêau"), (2, '"of the" ndtion thsh in'), (3, "der ung schkeit und die"), (4, "ción de la mente las")]
TODAY = "2027-01-01"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    html, i = F.col("html"), F.col("page_id")
    snippet = T.squeeze(F.regexp_replace(F.regexp_extract(html, r"(?is)<p[^>]*>(.*?)</p>", 1), r"<[^>]+>", " "))
    return table(spark, sf_dir, "pages").select(
        (i % 5).alias("question_id"), i.alias("arrival_seq"), F.concat(F.lit("e"), (i % 3).cast("string")).alias("engine"), (F.floor(i / 15) % 10 + 1).cast("int").alias("position"),
        T.html_title(html).alias("title"), "url", F.substring(snippet, 1, 300).alias("snippet"),
        F.when(i % 4 != 0, F.date_add(F.lit("2026-01-01").cast("date"), (i * 37 % 400).cast("int"))).alias("published_at"),
    )


def questions(spark: SparkSession) -> DataFrame:
    return literal(spark, "question_id long, question string", QUESTIONS)


def today() -> Column:
    return F.lit(TODAY).cast("date")


_SNIPPET = "left(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<p[^>]*>(.*?)</p>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), 300)"
_HITS = f"""{urls._PAGES_CANONICAL},
hits AS (SELECT page_id % 5 AS question_id, page_id AS arrival_seq, 'e' || (page_id % 3) AS engine, CAST(page_id // 15 % 10 + 1 AS INTEGER) AS position, {TITLE} AS title, pages.url, {_SNIPPET} AS snippet,
  CASE WHEN page_id % 4 <> 0 THEN DATE '2026-01-01' + CAST(page_id * 37 % 400 AS INTEGER) END AS published_at, c.canonical, c.dom, c.pth FROM pages JOIN canon c ON c.id = page_id),
groups AS (SELECT question_id, canonical, min(arrival_seq) AS arrival_seq, arg_min(url, arrival_seq) AS url, arg_min(dom, arrival_seq) AS dom, arg_min(pth, arrival_seq) AS pth, arg_min(snippet, arrival_seq) AS snippet,
  arg_max(title, (length(title), -arrival_seq)) AS title, min(published_at) AS published_at, min(position) AS best_rank, count(*) AS hits, count(DISTINCT engine) AS n_engines, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines FROM hits WHERE canonical IS NOT NULL GROUP BY question_id, canonical)"""


def merged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = R.merge_canonical(hits(spark, sf_dir))
    return g.select("question_id", "canonical", "url", "title", F.col("published_at").cast("string").alias("published_at"), "best_rank", "hits", F.array_join(F.map_keys("engine_ranks"), ",").alias("engines"))


MERGED_SQL = f"WITH {_HITS} SELECT question_id, canonical, url, title, CAST(published_at AS VARCHAR) AS published_at, best_rank, hits, engines FROM groups"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.score_groups(R.merge_canonical(hits(spark, sf_dir)), questions(spark), today())


def rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = R.top_k(_scored(spark, sf_dir), 8, capped=U.domain(F.col("url")).endswith("example.org"), cap=2)
    return best.select("question_id", "place", "url", "title", *[micro(F.col(c)).alias(c) for c in ("relevance", "authority", "freshness", "agreement", "score")])


_R4 = "floor(({0}) * 10000 + 0.5) / 10000"
_Q = sql_literal("question_id, question", QUESTIONS)


def _lap(x: str) -> str:
    return f"CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, {S.terms(x)})) / len(qt) ELSE 0 END"


_SCORED = f"""{_HITS},
q AS (SELECT question_id, question, {S.terms("question")} AS qt, {S.quoted("question")} AS ph FROM {_Q}),
eng AS (SELECT question_id, count(DISTINCT engine) AS engines_all FROM hits WHERE canonical IS NOT NULL GROUP BY question_id),
f1 AS (SELECT groups.*, question, qt, ph, engines_all, 1.0 / greatest(best_rank, 1) AS rk, {_lap("title")} AS lt, {_lap("snippet")} AS ls FROM groups JOIN q USING (question_id) JOIN eng USING (question_id)),
f2 AS (SELECT *, CASE WHEN trim(snippet) <> '' THEN 0.4 * lt + 0.6 * ls ELSE lt END AS lap, len(list_filter(ph, lambda p: contains(lower(title || ' ' || snippet), lower(p)))) AS found,
  (CASE WHEN (starts_with(lower(title), 'list of ') OR starts_with(lower(title), 'category:') OR starts_with(lower(title), 'portal:') OR starts_with(lower(title), 'index of ')) AND NOT list_contains(qt, 'list') THEN 0.65 ELSE 1.0 END)
  * (CASE WHEN contains(lower(title), 'disambiguation') OR contains(lower(pth), 'disambiguation') THEN 0.6 ELSE 1.0 END) * (CASE WHEN regexp_matches(pth, '^/*$') AND len(qt) >= 3 THEN 0.8 ELSE 1.0 END) AS mult FROM f1),
f3 AS (SELECT *, CASE WHEN len(ph) > 0 THEN 0.5 * rk + 0.35 * lap + 0.15 * found / len(ph) ELSE 0.5 * rk + 0.5 * lap END AS base FROM f2),
f4 AS (SELECT *, {_R4.format("least(1.0, least(1.0, base) * mult)")} AS relevance, CASE WHEN dom LIKE '%.org' THEN 0.6 WHEN dom LIKE '%.gov' THEN 0.9 WHEN dom LIKE '%.edu' THEN 0.85 ELSE 0.5 END AS authority,
  {_R4.format("n_engines / engines_all")} AS agreement, CASE WHEN published_at IS NULL THEN 0.5 ELSE {_R4.format(f"pow(0.5, greatest(DATE '{TODAY}' - published_at, 0) / 365.0)")} END AS fresh FROM f3),
f5 AS (SELECT *, CASE WHEN relevance >= 0.3 THEN fresh ELSE least(fresh, 0.5) END AS freshness FROM f4),
scored AS (SELECT *, {_R4.format("(0.0 + relevance * 0.4 + authority * 0.2 + freshness * 0.2 + agreement * 0.2) / 1.0")} AS score FROM f5)"""
TOPK_SQL = f"""WITH {_SCORED},
c AS (SELECT *, row_number() OVER (PARTITION BY question_id, ends_with(dom, 'example.org') ORDER BY score DESC, url) AS nth FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, url) AS place FROM c WHERE NOT ends_with(dom, 'example.org') OR nth <= 2)
SELECT question_id, place, url, title, {", ".join(f"{sql_micro(c)} AS {c}" for c in ("relevance", "authority", "freshness", "agreement", "score"))} FROM r WHERE place <= 8"""


def rank_page_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(_scored(spark, sf_dir), 5, offset=5).select("question_id", "place", "url", micro(F.col("score")).alias("score"))


PAGE_TWO_SQL = f"""WITH {_SCORED} SELECT question_id, place - 5 AS place, url, {sql_micro("score")} AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, url) AS place FROM scored) WHERE place > 5 AND place <= 10"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.coverage(R.merge_canonical(hits(spark, sf_dir)), questions(spark))


COVERAGE_SQL = f"""WITH {_HITS},
q AS (SELECT question_id, list_filter({S.terms(S.without_sites("question"))}, lambda t: t NOT IN ({S.words(T.STOPWORDS)})) AS t FROM {_Q}),
q2 AS (SELECT question_id, CASE WHEN len(list_filter(t, lambda x: regexp_matches(x, '[0-9]|[^\\x00-\\x7F]') OR length(x) >= 9)) > 0 THEN list_filter(t, lambda x: regexp_matches(x, '[0-9]|[^\\x00-\\x7F]') OR length(x) >= 9) ELSE t END AS telling FROM q),
m AS (SELECT question_id, max(len(list_intersect(telling, {S.terms("title || ' ' || snippet || ' ' || replace(regexp_extract(url, '://([^/:?#]*)', 1), '.', ' ') || ' ' || regexp_replace(pth, '[/_]', ' ', 'g')")}))) AS matched FROM groups JOIN q2 USING (question_id) GROUP BY question_id)
SELECT question_id, CAST(len(telling) AS INTEGER) AS total, CAST(coalesce(matched, 0) AS INTEGER) AS matched, CASE WHEN len(telling) = 0 THEN 'unknown' WHEN coalesce(matched, 0) / len(telling) >= 0.6 THEN 'good' WHEN coalesce(matched, 0) / len(telling) >= 0.3 THEN 'partial' ELSE 'low' END AS status FROM q2 LEFT JOIN m USING (question_id)"""


def near_title_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.near_titles(R.merge_canonical(hits(checkpoints(spark), sf_dir)))


def story_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = R.top_k(_scored(spark, sf_dir), 50)
    return R.story_facts(best, R.stories(best))


def story_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First report, latest update and numbers of stories of each question."""
    facts = story_clusters(spark, sf_dir)
    return facts.groupBy("question_id").agg(F.min("first_report").alias("first_report"), F.max("latest_update").alias("latest_update"), F.count("*").alias("stories"), F.count("first_report").alias("dated_stories"))


def story_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trends(story_clusters(spark, sf_dir), today(), window_days=30)


def volume_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event type the value of the last two days over the mean daily value before, at least one."""
    e = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    last = e.agg(F.max("day").alias("last"))
    daily = e.groupBy("event_type", "day").agg(F.sum(F.floor(F.col("value") * 100 + 0.5)).alias("cents"))
    daily = daily.join(F.broadcast(last), F.col("day") <= F.col("last"))
    age = F.datediff("last", "day")
    out = daily.groupBy("event_type").agg(F.sum(F.when(age <= 1, F.col("cents")).otherwise(0)).alias("recent"), F.sum(F.when(age > 1, F.col("cents")).otherwise(0)).alias("before"), F.count_if(age > 1).alias("days"))
    base = F.greatest(F.coalesce(F.try_divide(F.col("before"), F.col("days")) / 100, F.lit(0.0)), F.lit(1.0))
    return out.select("event_type", F.col("recent").cast("long").alias("recent"), F.floor(F.col("recent") / 100 / base * 1000 + 0.5).cast("long").alias("ratio_milli"))


VOLUME_SQL = """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS cents FROM events GROUP BY ALL), l AS (SELECT max(CAST(ts AS DATE)) AS last FROM events),
o AS (SELECT event_type, coalesce(sum(cents) FILTER (last - day <= 1), 0) AS recent, coalesce(sum(cents) FILTER (last - day > 1), 0) AS b, count(*) FILTER (last - day > 1) AS n FROM d, l GROUP BY event_type)
SELECT event_type, CAST(recent AS BIGINT) AS recent, CAST(floor(recent / 100 / greatest(CASE WHEN n = 0 THEN 0 ELSE b / n / 100 END, 1.0) * 1000 + 0.5) AS BIGINT) AS ratio_milli FROM o"""

RANGES = [(1, "2024-01-01", "2024-01-03"), (2, None, "2024-01-02"), (3, "2024-01-05", None), (4, "2026-01-01", "2026-02-01")]


def date_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the inclusive date windows of questions: a range join, counted on both sides' keys."""
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    windows = literal(spark, "question int, lo string, hi string", RANGES)
    inside = (F.col("lo").isNull() | (F.col("day") >= F.col("lo").cast("date"))) & (F.col("hi").isNull() | (F.col("day") <= F.col("hi").cast("date")))
    return days.join(F.broadcast(windows), inside).groupBy("question").agg(F.sum("n").alias("events"), F.count("*").alias("days"))


DATE_WINDOWS_SQL = f"""SELECT question, CAST(sum(n) AS BIGINT) AS events, count(*) AS days FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) JOIN {sql_literal("question, lo, hi", RANGES)}
ON (lo IS NULL OR day >= CAST(lo AS DATE)) AND (hi IS NULL OR day <= CAST(hi AS DATE)) GROUP BY question"""

QUERIES = {
    "merged_groups": merged_groups, "rank_topk": rank_topk, "rank_page_two": rank_page_two, "coverage": coverage, "near_title_merge": near_title_merge, "story_clusters": story_clusters,
    "story_timeline": story_timeline, "story_trends": story_trends, "volume_trend": volume_trend, "date_windows": date_windows,
}
SQL = {"merged_groups": MERGED_SQL, "rank_topk": TOPK_SQL, "rank_page_two": PAGE_TWO_SQL, "coverage": COVERAGE_SQL, "volume_trend": VOLUME_SQL, "date_windows": DATE_WINDOWS_SQL}
