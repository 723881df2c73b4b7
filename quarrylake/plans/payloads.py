"""Queries over captured answers of services. The SQL states the rows that the captured answers hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import payloads as P
from .inputs import literal, sql_literal, table

ENCYCLOPEDIA = '{"query":{"search":[{"title":"Solar  panel","snippet":"A <span>solar</span> &amp; panel","timestamp":"2026-02-03T04:05:06Z"},{"snippet":"no title"},{"title":"C++: history","timestamp":"bad"}]}}'
WORKS = '{"message":{"items":[{"title":["On  panels"],"DOI":"10.1/a b","author":[{"given":"A","family":"B"},{"family":"C"}],"container-title":["J"],"issued":{"date-parts":[[2025,3]]}},{"title":["Whole"],"URL":"https://x.org/w","abstract":"<p>Text here</p>","published-print":{"date-parts":[[2025,3,9]]}},{"title":[],"URL":"https://x.org/none"}]}}'
ANSWERS = '{"items":[{"title":"Q &quot;one&quot;","link":"https://stackoverflow.com/q/1","is_answered":true,"score":5,"tags":["a","b"]},{"title":"Elsewhere","link":"https://other.com/q"},{"title":"Two","link":"https://stackoverflow.com/q/2","body":"<p>Body</p>","is_answered":false}]}'
ARTICLES = '{"articles":[{"title":" A  story","url":"https://n.org/1","seendate":"20260102T030405Z"},{"title":"No host","url":"https:///x"},{"title":"Mail","url":"mailto:a@b.c"}]}'
RESULTS = '{"results":[{"title":"R1","url":"https://r.org/1","content":"c","publishedDate":"2026-01-02T00:00:00"},{"title":"","url":"https://r.org/2"},{"title":"R3","url":"ftp://r.org/3"},{"title":"R4","link":"https://r.org/4","snippet":"s","date":"soon"}]}'
ORGANIC = '{"organic":[{"title":"O1","link":"https://o.org/1","snippet":"s1","date":"2026-05-06"}]}'
REPOSITORIES = '{"items":[{"full_name":"a/b","html_url":"https://github.com/a/b","description":"D  d","license":{"spdx_id":"MIT"},"updated_at":"2026-03-04T00:00:00Z"},{"name":"x","html_url":"https://evil.com/x"}]}'
RELEASES = '[{"tag_name":"v1","html_url":"https://github.com/a/b/releases/v1","body":"notes","published_at":"2026-03-05T00:00:00Z"}]'
POSTS = [(1, '{"title":"T","permalink":"/p","score":"12","num_comments":"x","created_utc":"1700","selftext":"S"}'), (2, '{"name":"N","link":"https://l","username":"u","points":3,"community":"c","comment_count":4,"date":"2026","summary":"Y"}'), (3, "not json"), (4, '{"title":"","url":""}')]
FEED = '<rss><channel><item><title><![CDATA[One & all]]></title><link>https://f.org/1</link><description>&lt;b&gt;x&lt;/b&gt; y</description><pubDate>Wed, 28 Oct 2026 18:44:23 GMT</pubDate></item><item><title>No link</title></item></channel></rss>'
ATOM = '<feed><entry><title>Two</title><link rel="alternate" href="https://f.org/2"/><summary>s</summary><updated>2026-01-02T00:00:00Z</updated></entry></feed>'
SITEMAP = '<urlset><url><loc>https://s.org/a</loc><lastmod>2026-01-02</lastmod><news:news><news:publication_date>2026-01-01</news:publication_date><news:title>A</news:title></news:news></url><sitemap><loc>https://s.org/more.xml</loc></sitemap></urlset>'

HITS = [
    ("answers", 1, 'Q "one"', "https://stackoverflow.com/q/1", "accepted answer · score 5 · a, b", None, None), ("answers", 2, "Two", "https://stackoverflow.com/q/2", "Body", None, None),
    ("articles", 1, "A story", "https://n.org/1", "", None, None),
    ("encyclopedia", 1, "Solar panel", "https://en.wikipedia.org/wiki/Solar_panel", "A solar & panel", None, "2026-02-03"), ("encyclopedia", 2, "C++: history", "https://en.wikipedia.org/wiki/C%2B%2B:_history", "", None, None),
    ("organic", 1, "O1", "https://o.org/1", "s1", "2026-05-06", None), ("results", 1, "R1", "https://r.org/1", "c", "2026-01-02", None), ("results", 2, "R4", "https://r.org/4", "s", None, None),
    ("releases", 1, "v1", "https://github.com/a/b/releases/v1", "notes", "2026-03-05", None), ("repositories", 1, "a/b", "https://github.com/a/b", "D d · License: MIT", None, "2026-03-04"),
    ("works", 1, "On panels", "https://doi.org/10.1/a+b", "A B, C; J; DOI 10.1/a b", None, None), ("works", 2, "Whole", "https://x.org/w", "Text here", "2025-03-09", None),
]


def service_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(body: str) -> DataFrame:
        return literal(spark, "id int, body string", [(1, body), (2, "{"), (3, None), (4, "[]")])

    made = {
        "encyclopedia": P.encyclopedia(of(ENCYCLOPEDIA)), "works": P.works(of(WORKS)), "answers": P.answers(of(ANSWERS)), "articles": P.articles(of(ARTICLES)), "results": P.results(of(RESULTS)),
        "organic": P.results(of(ORGANIC), "organic"), "repositories": P.repositories(of(REPOSITORIES)), "releases": P.repositories(of(RELEASES), "releases"),
    }
    # Each page as the answer of a metasearch with one result, and each as one of an encyclopedia.
    page, day = F.col("page_id"), F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("page_id") % 300).cast("int")), "yyyy-MM-dd")
    text = F.substring(T.squeeze(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "&[a-z#0-9]+;", " ")), 1, 400)
    one = F.struct(F.concat(F.lit("Page "), page.cast("string")).alias("title"), F.col("url"), text.alias("content"), F.concat(day, F.lit("T00:00:00")).alias("publishedDate"))
    found = F.struct(F.struct(F.array(F.struct(F.concat(F.lit("Page "), page.cast("string")).alias("title"), text.alias("snippet"), F.concat(day, F.lit("T00:00:00Z")).alias("timestamp"))).alias("search")).alias("query"))
    pages = table(spark, sf_dir, "pages").select(page.cast("int").alias("id"), F.to_json(F.struct(F.array(one).alias("results"))).alias("results"), F.to_json(found).alias("found"))
    made |= {"pages": P.results(pages.select("id", F.col("results").alias("body"))), "pages_found": P.encyclopedia(pages.select("id", F.col("found").alias("body")))}
    out = None
    for name, hits in made.items():
        one = hits.select(F.lit(name).alias("service"), "position", "title", "url", "snippet", F.col("published_at").cast("string").alias("published_at"), F.col("modified_at").cast("string").alias("modified_at"))
        out = one if out is None else out.unionByName(one)
    return out


def forum_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.posts(literal(spark, "id int, body string", POSTS))


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each page as a feed: one entry in RSS, one in Atom, and one without a link.
    i = F.col("page_id").cast("string")
    made = F.concat(F.lit("<rss><item><title>Page "), i, F.lit("</title><link>https://f.org/"), i, F.lit("</link><description>No. "), i, F.lit("</description><pubDate>Thu, 01 Jan 2026 00:00:00 GMT</pubDate></item><item><title>None</title></item><entry><title>Entry "), i, F.lit('</title><link href="https://g.org/'), i, F.lit('"/><updated>2026-01-02</updated></entry></rss>'))
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") + 10).cast("int").alias("id"), made.alias("body"))
    return P.feed(literal(spark, "id int, body string", [(1, FEED), (2, ATOM), (3, "junk"), (4, None)]).unionByName(pages))


def sitemap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each page as a sitemap of its own.
    i = F.col("page_id")
    entry = F.concat(F.lit("<urlset><url><loc>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>2026-0"), (i % 9 + 1).cast("string"), F.lit("-01</lastmod><news:title>Page &lt;"), i.cast("string"), F.lit("&gt;</news:title></url></urlset>"))
    pages = table(spark, sf_dir, "pages").select((i + 10).cast("int").alias("id"), entry.alias("body"))
    return P.sitemap(literal(spark, "id int, body string", [(1, SITEMAP), (2, ""), (3, None)]).unionByName(pages))


def sitemap_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = literal(spark, "domain string, robots string", [("a.org", "User-agent: *\nSitemap: https://a.org/own.xml\nsitemap: https://a.org/sitemap.xml"), ("b.org", None)])
    return asked.select("domain", F.posexplode(P.sitemap_candidates(F.col("domain"), F.col("robots"))).alias("place", "url"))


#: Entries of each kind of link; the feed names its own site or, for odd ids, doesn't.
LINKED = '<item><title>Whole</title><link>https://w.example/{i}?a=1&amp;b=2</link><pubDate>Thu, 01 Jan 2026 23:00:00 GMT</pubDate></item><item><title>Relative</title><link>posts/{i}</link><dc:creator>Who</dc:creator></item><item><title>Rooted</title><link>/r/../{i}</link></item><item><title>Host</title><link>//h.example/{i}</link></item><item><title>Guid</title><guid>https://g.example/{i}</guid></item><item><title>Lost</title><guid>tag:{i}</guid></item><entry><title>Atom</title><link rel="self" href="https://no.example/"/><link href="?p={i}"/><author><name>A</name></author><updated>2026-02-03T00:30:00+02:00</updated></entry>'


def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    head = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<title>Feed "), i, F.lit("</title><link>https://site.example/sub/index.html</link>"))).otherwise("")
    body = F.concat(F.lit("<rss><channel>"), head, F.when(F.col("page_id") % 5 == 4, "").otherwise(F.replace(F.lit(LINKED), F.lit("{i}"), i)), F.lit("</channel></rss>"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("https://feeds.example/a/feed.xml").alias("url"), body.alias("body"))


def feed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.linked_feed(_feeds(spark, sf_dir)).withColumn("published_at", F.col("published_at").cast("string"))


def feed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.feed_documents(_feeds(spark, sf_dir), limit=6).withColumn("warnings", F.array_join("warnings", "; "))


FEED_LINKS_SQL = """WITH p AS (SELECT page_id AS id, CAST(page_id AS VARCHAR) AS i, page_id % 2 = 0 AS own FROM pages WHERE page_id % 5 <> 4)
SELECT id, 1 AS position, 'Whole' AS title, 'https://w.example/' || i || '?a=1&b=2' AS url, '2026-01-01' AS published_at, '' AS guid, '' AS author, CAST(NULL AS VARCHAR) AS warning FROM p
UNION ALL SELECT id, 2, 'Relative', CASE WHEN own THEN 'https://site.example/sub/posts/' ELSE 'https://feeds.example/a/posts/' END || i, NULL, '', 'Who', NULL FROM p
UNION ALL SELECT id, 3, 'Rooted', CASE WHEN own THEN 'https://site.example/' ELSE 'https://feeds.example/' END || i, NULL, '', '', NULL FROM p
UNION ALL SELECT id, 4, 'Host', 'https://h.example/' || i, NULL, '', '', NULL FROM p
UNION ALL SELECT id, 5, 'Guid', 'https://g.example/' || i, NULL, 'https://g.example/' || i, '', NULL FROM p
UNION ALL SELECT id, 6, 'Lost', '', NULL, 'tag:' || i, '', 'entry has no link and no URL guid; the permalink is unknown' FROM p
UNION ALL SELECT id, 7, 'Atom', CASE WHEN own THEN 'https://site.example/sub/index.html' ELSE 'https://feeds.example/a/feed.xml' END || '?p=' || i, '2026-02-02', '', 'A', NULL FROM p"""
FEED_STATUS_SQL = """SELECT page_id AS id, CASE WHEN page_id % 10 = 9 THEN 'unparsed' ELSE 'ok' END AS status, CASE WHEN page_id % 2 = 0 THEN 'Feed ' || page_id ELSE 'https://feeds.example/a/feed.xml' END AS title,
 CASE WHEN page_id % 2 = 0 THEN 'https://site.example/sub/index.html' ELSE '' END AS link, CASE WHEN page_id % 5 = 4 THEN 0 ELSE 7 END AS entries, CASE WHEN page_id % 5 = 4 THEN 0 ELSE 6 END AS returned,
 CASE WHEN page_id % 5 = 4 THEN '' ELSE 'entry has no link and no URL guid; the permalink is unknown' END AS warnings FROM pages"""

QUERIES = {"service_hits": service_hits, "forum_posts": forum_posts, "feed_entries": feed_entries, "sitemap_rows": sitemap_rows, "sitemap_places": sitemap_places, "feed_links": feed_links, "feed_status": feed_status}
SQL = {
    "feed_links": FEED_LINKS_SQL,
    "feed_status": FEED_STATUS_SQL,
    "service_hits": """WITH p AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&[a-z#0-9]+;', ' ', 'g'), '\\s+', ' ', 'g')) AS t, CAST(DATE '2026-01-01' + CAST(page_id % 300 AS INTEGER) AS VARCHAR) AS day FROM pages)
SELECT 'pages' AS service, 1 AS position, 'Page ' || page_id AS title, url, rtrim(left(t, 400)) AS snippet, day AS published_at, NULL AS modified_at FROM p WHERE regexp_matches(url, '^https?://[^/?#]+') UNION ALL
SELECT 'pages_found', 1, 'Page ' || page_id, 'https://en.wikipedia.org/wiki/Page_' || page_id, rtrim(left(t, 400)), NULL, day FROM p UNION ALL SELECT * FROM """ + sql_literal("service, position, title, url, snippet, published_at, modified_at", HITS),
    "forum_posts": "SELECT * FROM " + sql_literal('id, title, url, author, "group", score, comments, created_at, text', [(1, "T", "/p", "", "", 12, None, "1700", "S"), (2, "N", "https://l", "u", "c", 3, 4, "2026", "Y"), (4, "", "", "", "", None, None, None, "")]),
    "feed_entries": "SELECT CAST(page_id + 10 AS INTEGER) AS id, 1 AS position, 'Page ' || page_id AS title, 'https://f.org/' || page_id AS url, 'No. ' || page_id AS snippet, 'Thu, 01 Jan 2026 00:00:00 GMT' AS published FROM pages UNION ALL SELECT CAST(page_id + 10 AS INTEGER), 2, 'Entry ' || page_id, 'https://g.org/' || page_id, '', '2026-01-02' FROM pages UNION ALL SELECT * FROM " + sql_literal("id, position, title, url, snippet, published", [(1, 1, "One & all", "https://f.org/1", "<b>x</b> y", "Wed, 28 Oct 2026 18:44:23 GMT"), (2, 1, "Two", "https://f.org/2", "s", "2026-01-02T00:00:00Z")]),
    "sitemap_rows": "SELECT CAST(page_id + 10 AS INTEGER) AS id, 'page' AS kind, url, '2026-0' || (page_id % 9 + 1) || '-01' AS lastmod, '' AS published, 'Page <' || page_id || '>' AS title FROM pages UNION ALL SELECT * FROM " + sql_literal("id, kind, url, lastmod, published, title", [(1, "page", "https://s.org/a", "2026-01-02", "2026-01-01", "A"), (1, "index", "https://s.org/more.xml", "", "", "")]),
    "sitemap_places": "SELECT * FROM " + sql_literal("domain, place, url", [("a.org", 0, "https://a.org/own.xml"), ("a.org", 1, "https://a.org/sitemap.xml"), ("a.org", 2, "https://a.org/sitemap_index.xml"), ("a.org", 3, "https://a.org/news-sitemap.xml"), ("a.org", 4, "https://a.org/sitemap-news.xml"), ("b.org", 0, "https://b.org/sitemap.xml"), ("b.org", 1, "https://b.org/sitemap_index.xml"), ("b.org", 2, "https://b.org/news-sitemap.xml"), ("b.org", 3, "https://b.org/sitemap-news.xml")]),
}
