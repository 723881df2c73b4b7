"""Queries over captured answers: outcomes of reading, routes, decoded wrappers, posts of listings. Pages are what they read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import reading as R
from ..operators import routing as G
from . import urls as P
from .inputs import literal, micro, stored, table

_KINDS = 9
#: A paragraph that each page's article ends with, so that none is too short to tell from an empty shell.
MORE = "<p>" + "This page has a paragraph of plain prose that anyone can read. " * 6 + "</p>"
CAPTCHA = '<html><body><div class="g-recaptcha" data-sitekey="x"></div>Prove it</body></html>'


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captured answers; what came instead of some of them, their ids decide."""
    k, html = F.col("page_id") % _KINDS, F.replace("html", F.lit("</article>"), F.lit(MORE + "</article>"))
    body = F.when(k == 3, CAPTCHA).when(k == 4, F.concat(F.lit("%PDF-1.7 "), F.col("page_id").cast("string"))).when(k == 5, "<html><body><script>app()</script></body></html>").when(k == 6, "<html><head><title>Page not found</title></head><body><p>Sorry, page not found. It may have been moved to another place on this site.</p></body></html>").when(k == 8, None).otherwise(html)
    status = F.when(k == 1, 404).when(k == 2, 429).otherwise(200)
    return table(spark, sf_dir, "pages").select("page_id", F.when(k == 7, "http://127.0.0.1/admin").otherwise(F.col("url")).alias("url"), status.alias("status"), F.lit("server: x").alias("headers"), F.when(k == 2, 30.0).alias("retry_after"), body.alias("html"))


def bulk_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = R.split(stored(R.read_pages(_answers(spark, sf_dir)), "read"))
    fine = good.select("page_id", F.lit("").alias("error"), F.lit("").alias("detail"), F.lit(None).cast("double").alias("retry_after"), F.lit("").alias("cause"), "title", "truncated")
    return fine.unionByName(bad.select("page_id", "error", "detail", "retry_after", "cause", F.lit("").alias("title"), F.lit(False).alias("truncated")))


def read_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many answers failed, by error and cause."""
    bad = R.split(R.read_pages(_answers(spark, sf_dir)))[1]
    return bad.groupBy("error", "detail", "cause").agg(F.count("*").alias("pages"))


FAILURES_SQL = """SELECT x.e AS error, x.d AS detail, x.c AS cause, count(*) AS pages FROM (SELECT [{'e': '', 'd': '', 'c': ''}, {'e': 'page_unavailable', 'd': 'http_404', 'c': 'other'}, {'e': 'rate_limited', 'd': 'http_429', 'c': 'blocked'}, {'e': 'challenge', 'd': 'captcha: recaptcha', 'c': 'blocked'}, {'e': 'extraction_failed', 'd': 'unsupported_media: pdf', 'c': 'wrong_format'},
 {'e': 'extraction_failed', 'd': 'empty_response', 'c': 'not_enough_text'}, {'e': 'page_unavailable', 'd': 'soft_404', 'c': 'other'}, {'e': 'security_blocked', 'd': 'blocked_by_security_policy', 'c': 'blocked'}, {'e': 'extraction_failed', 'd': 'empty_response', 'c': 'not_enough_text'}][page_id % 9 + 1] AS x FROM pages WHERE page_id % 9 > 0) GROUP BY ALL"""


def _wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's URL as a news wrapper has it: a message with a number, the URL and a text after it, as base64 for URLs."""
    url = F.encode(F.regexp_replace("url", r"[^\x21-\x7e]", "-"), "UTF-8")
    n = F.length(url)
    length = F.when(n < 128, F.unhex(F.lpad(F.hex(n), 2, "0"))).otherwise(F.unhex(F.concat(F.hex(n % 128 + 128), F.lpad(F.hex(F.floor(n / 128)), 2, "0"))))
    message = F.concat(F.unhex(F.lit("081322")), length, url, F.unhex(F.lit("2A0568656C6C6F")))
    coded = F.regexp_replace(F.translate(F.regexp_replace(F.base64(message), r"\s", ""), "+/", "-_"), "=+$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[^\x21-\x7e]", "-").alias("url"), F.concat(F.lit("https://news.google.com/rss/articles/"), coded, F.lit("?oc=5")).alias("wrapped"))


def news_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wrapped(spark, sf_dir).select("page_id", U.coded_news(F.col("wrapped")).alias("target"), (U.coded_news(F.col("url")) == F.col("url")).alias("others_stay"))


TARGETS_SQL = "SELECT page_id, regexp_replace(url, '[^\\x21-\\x7e]', '-', 'g') AS target, TRUE AS others_stay FROM pages"

#: Hosts that pages move to, by id, so that each rule is met: exact, subdomains, likenesses that aren't, and marks of feeds.
HOSTS = ["github.com", "gist.github.com", "notgithub.com", "www.youtube.com", "x.com", "ex.com", "redd.it", "github.com.evil.example", "FACEBOOK.com:443", "site.example/feed/", "xueqiu.com/atom", None]


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = F.element_at(F.array(*[F.lit(h) for h in HOSTS]), (F.col("page_id") % len(HOSTS) + 1).cast("int"))
    rest = F.regexp_replace("url", "^[a-z]+://[^/?#]*", "")
    given = table(spark, sf_dir, "pages")
    return given.select("page_id", F.concat(F.lit("https://"), to, rest).alias("url")).unionByName(given.select((F.col("page_id") + 1_000_000_000).alias("page_id"), "url"))


def routed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.routed(_moved(spark, sf_dir), G.rules(spark)).select("page_id", "source")


_HOSTS = ", ".join("NULL" if h is None else f"'{h}'" for h in HOSTS)
_RULES = " ".join(f"WHEN {' OR '.join(f'''dom = '{h}' OR ends_with(dom, '.{h}')''' for h in hosts)} THEN '{name}'" for name, hosts in G.SOURCES)
ROUTES_SQL = f"""WITH m AS (SELECT page_id, 'https://' || [{_HOSTS}][page_id % {len(HOSTS)} + 1] || regexp_replace(url, '^[a-z]+://[^/?#]*', '') AS url FROM pages UNION ALL SELECT page_id + 1000000000, url FROM pages),
d AS (SELECT page_id, lower(url) AS low, regexp_extract(lower(url), '^[a-z]+://(?:www\\.)?([^/?#:]*)', 1) AS dom FROM m)
SELECT page_id, CASE {_RULES} WHEN {' OR '.join(f"contains(low, '{x}')" for x in G.FEED_MARKS)} THEN 'rss' END AS source FROM d"""


def authority_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The authority of given and all pages' URLs by a join with a table of suffixes."""
    weights = literal(spark, "suffix string, weight double", list(U.AUTHORITY.items()))
    found = G.longest_suffix(P._urls(spark, sf_dir).where("url IS NOT NULL"), weights, U.DEFAULT_AUTHORITY)
    return found.select("id", micro(F.col("authority")).alias("authority"))


_AUTHORITY = P.AUTHORITY_SQL[: P.AUTHORITY_SQL.rindex("SELECT id,")]
JOINED_SQL = _AUTHORITY + "SELECT id, CAST(floor(coalesce((SELECT arg_max(v, length(s)) FROM w WHERE dom = s OR ends_with(dom, '.' || s)), 0.5) * 1000000 + 0.5) AS BIGINT) AS authority FROM split"

CARD = '<div><a class="t" href="https://www.forum.example/post/{i}-{k}?post=a">Post <b>{i}</b> &amp; {k}</a><span>by <a href="/user{k}"><img> who{k}</a></span> {c}</div>'


def _card(i: Column, k: int, counts: str) -> Column:
    return F.replace(F.lit(CARD.replace("{k}", str(k)).replace("{c}", counts)), F.lit("{i}"), i)


def listed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of each page with three cards put into it: with both counts, with one, with none; a link that comes again counts once."""
    i = F.col("page_id").cast("string")
    cards = F.concat(_card(i, 1, "1,234 upvotes <i>5 comments</i>"), F.lit('<p><a href="https://www.forum.example/post/none"><img></a></p>'), _card(i, 2, "<b>7</b> comments"), _card(i, 3, ""), _card(i, 1, "9 upvotes"))
    return R.card_posts(table(spark, sf_dir, "pages").select("page_id", F.concat("html", cards).alias("html")))


POSTS_SQL = """SELECT page_id, k AS place, 'Post ' || page_id || ' & ' || k AS title, 'https://www.forum.example/post/' || page_id || '-' || k AS url, 'who' || k AS author, CASE k WHEN 1 THEN 1234 END AS score, CASE k WHEN 1 THEN 5 WHEN 2 THEN 7 END AS comments FROM pages, (VALUES (1), (2), (3)) t(k)"""

QUERIES = {"bulk_read": bulk_read, "read_failures": read_failures, "news_targets": news_targets, "routed_urls": routed_urls, "authority_joined": authority_joined, "listed_posts": listed_posts}
SQL = {"read_failures": FAILURES_SQL, "news_targets": TARGETS_SQL, "routed_urls": ROUTES_SQL, "authority_joined": JOINED_SQL, "listed_posts": POSTS_SQL}
