"""Queries over result pages, article dates and reformulated questions. The SQL states the rows that the pages hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.forms import reformulate
from ..sources import markup as M
from .inputs import literal, sql_literal, table

CLASSED = '<div class="result"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.org%2Fx&amp;rut=1">A <b>one</b></a><div class="result__snippet">snip &amp; one</div></div><a class="result-link" href="https://b.org/">B</a><a class="result__a" href="/local">L</a>'
LISTED = '<ol><li class="b_algo"><h2><a href="https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9iLmV4YW1wbGUvcA">Bee</a></h2><p>Text b</p></li><li class="b_ad"><h2><a href="https://ad.org">Ad</a></h2></li></ol>'
PLAIN = '<ul class="results"><li><h2><a href="https://m.org/1">M one</a></h2><p class="s">First</p></li><li><h2><a href="https://m.org/2">M two</a></h2><p>Second</p></li></ul>'
HITS = [("classed", 1, "A one", "https://a.org/x", "snip & one"), ("classed", 2, "B", "https://b.org/", ""), ("listed", 1, "Bee", "https://b.example/p", "Text b"), ("plain", 1, "M one", "https://m.org/1", "First"), ("plain", 2, "M two", "https://m.org/2", "Second")]
ARTICLES = [
    (1, '<script type="application/ld+json">{"@graph":[{"@type":"NewsArticle","datePublished":"2026-10-19T23:30:00-05:00","dateModified":"2026-10-22"}]}</script><meta property="article:published_time" content="2025-01-01">'),
    (2, '<meta content="2026-03-04T00:00:00Z" property="article:published_time"><meta name="lastmod" content="2026-03-09">'),
    (3, '<time itemprop="dateModified" datetime="2026-01-01">x</time><time class="published" datetime="2026-02-02">y</time>'),
    (4, '<script type="application/ld+json">{"@type":"Person","datePublished":"2020-01-01"}</script><p>Published 2024-05-05</p>'), (5, '<time datetime="2026-02-30">x</time>'), (6, None), (7, '<meta name="date" content="Wed, 28 Oct 2026 18:44:23 GMT">'),
]
DATES = [(1, "2026-10-20", "2026-10-22", "jsonld:datePublished", "high"), (2, "2026-03-04", "2026-03-09", "meta:article:published_time", "high"), (3, "2026-02-02", None, "time:datetime", "medium"), (4, None, None, "", ""), (5, None, None, "", ""), (6, None, None, "", ""), (7, "2026-10-28", None, "meta:date", "high")]


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, page in (("classed", CLASSED), ("listed", LISTED), ("plain", PLAIN)):
        one = M.result_page(literal(spark, "id int, html string", [(1, page), (2, "<p>nothing</p>"), (3, None)]), name).select(F.lit(name).alias("layout"), "position", "title", "url", "snippet")
        out = one if out is None else out.unionByName(one)
    return out


def article_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Pages, to which a date is given in one of four ways.
    i = F.col("page_id")
    day = F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), (i % 600).cast("int")), "yyyy-MM-dd")
    given = F.when(i % 5 == 0, F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('T10:00:00Z">'))).when(i % 5 == 1, F.concat(F.lit("<time datetime='"), day, F.lit("'>then</time>"))).when(i % 5 == 2, F.concat(F.lit('<script type="application/ld+json">{"@type": "Article", "dateModified": "2026-06-01", "datePublished": "'), day, F.lit('"}</script>'))).when(i % 5 == 3, F.concat(F.lit("<p>Published "), day, F.lit("</p>"))).otherwise("")
    pages = table(spark, sf_dir, "pages").select((i + 100).cast("int").alias("id"), F.concat("html", given).alias("html"))
    d = literal(spark, "id int, html string", ARTICLES).unionByName(pages).select("id", M.article_dates(F.col("html")).alias("d"))
    return d.select("id", F.col("d.published_at").cast("string").alias("published_at"), F.col("d.modified_at").cast("string").alias("modified_at"), "d.evidence", "d.confidence")


def page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages have a date of publication, by confidence."""
    d = table(spark, sf_dir, "pages").select(M.article_dates(F.col("html")).alias("d"))
    return d.groupBy(F.col("d.confidence").alias("confidence")).agg(F.count("*").alias("pages"), F.count("d.published_at").alias("dated"))


REFORMULATED = [
    (1, 1, "buy cheap car insurance in delhi", "original"), (1, 2, "buy cheap car insurance delhi", "keywords"), (1, 3, "purchase cheap car insurance in delhi", "synonym"),
    (2, 1, "solar panel output and wind turbine cost per year", "original"), (2, 2, "solar panel output", "sub_question"), (2, 3, "wind turbine cost per year", "sub_question"), (3, 1, "c++", "original"),
    (6, 1, "exoplanet atmosphere spectroscopy replication failures primary literature", "original"), (6, 2, "exoplanet atmosphere spectroscopy", "focus"),
]


def reformulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = literal(spark, "id int, q string", [(1, "buy cheap  car insurance in delhi"), (2, "solar panel output and wind turbine cost per year"), (3, "c++"), (4, ""), (5, None), (6, "exoplanet atmosphere spectroscopy replication failures primary literature")])
    return asked.select("id", F.posexplode(reformulate(F.col("q"), 3)).alias("at", "r")).select("id", (F.col("at") + 1).alias("place"), "r.text", "r.strategy")


QUERIES = {"result_pages": result_pages, "article_dates": article_dates, "page_dates": page_dates, "reformulated": reformulated}
SQL = {
    "result_pages": "SELECT * FROM " + sql_literal("layout, position, title, url, snippet", HITS),
    "article_dates": "SELECT CAST(page_id + 100 AS INTEGER) AS id, CASE WHEN page_id % 5 < 3 THEN CAST(DATE '2025-01-01' + CAST(page_id % 600 AS INTEGER) AS VARCHAR) END AS published_at, CASE WHEN page_id % 5 = 2 THEN '2026-06-01' END AS modified_at, CASE page_id % 5 WHEN 0 THEN 'meta:article:published_time' WHEN 1 THEN 'time:datetime' WHEN 2 THEN 'jsonld:datePublished' ELSE '' END AS evidence, CASE WHEN page_id % 5 = 1 THEN 'medium' WHEN page_id % 5 IN (0, 2) THEN 'high' ELSE '' END AS confidence FROM pages UNION ALL SELECT * FROM " + sql_literal("id, published_at, modified_at, evidence, confidence", DATES),
    "reformulated": "SELECT * FROM " + sql_literal("id, place, text, strategy", REFORMULATED),
}
