"""Answers of search services as tables of hits: JSON texts in, one row for each hit out.

Each reader takes a table with the columns id and body (a JSON text) and returns
(id, position, title, url, snippet, published_at, modified_at); position counts
from 1 within an answer. A body that isn't the expected JSON gives no rows.
Publication and revision are never taken for each other, and a date that isn't
whole is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions import url as U

_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_ITEM = "STRUCT<title: STRING, url: STRING, link: STRING, html_url: STRING, description: STRING, snippet: STRING, content: STRING, text: STRING, publishedDate: STRING, published: STRING, page_age: STRING, date: STRING, published_date: STRING>"


def _day(text: Column) -> Column:
    cut = F.substring(text, 1, 10)
    return F.when(cut.rlike(_DAY), F.try_to_date(cut, "yyyy-MM-dd"))


def _plain(text: Column, most: int) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.substring(T.squeeze(t), 1, most)


def _first(*columns: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns], F.lit(""))


def _numbered(rows: DataFrame, limit: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("id").orderBy("at"))
    return rows.withColumn("position", place).where(F.col("position") <= limit).select("id", "position", "title", "url", "snippet", "published_at", "modified_at")


def _items(bodies: DataFrame, schema: str, path: str) -> DataFrame:
    parsed = bodies.select("id", F.from_json("body", schema).alias("p"))
    return parsed.select("id", F.posexplode(F.col(f"p.{path}")).alias("at", "x")).where("x IS NOT NULL")


def _none() -> Column:
    return F.lit(None).cast("date")


def encyclopedia(bodies: DataFrame, limit: int = 50, lang: str = "en") -> DataFrame:
    """Pages with the time of their last revision."""
    rows = _items(bodies, "query STRUCT<search: ARRAY<STRUCT<title: STRING, snippet: STRING, timestamp: STRING>>>", "query.search").where(F.col("at") < limit)
    title = T.squeeze(F.coalesce("x.title", F.lit("")))
    url = F.concat(F.lit(f"https://{lang}.wikipedia.org/wiki/"), F.replace(U.encode(F.replace(title, F.lit(" "), F.lit("_"))), F.lit("%3A"), F.lit(":")))
    out = rows.select("id", "at", title.alias("title"), url.alias("url"), _plain(F.col("x.snippet"), 400).alias("snippet"), _none().alias("published_at"), _day(F.col("x.timestamp")).alias("modified_at"))
    return _numbered(out.where("title <> ''"), limit)


def works(bodies: DataFrame, limit: int = 50) -> DataFrame:
    """Scholarly works; a date only if year, month and day are given."""
    parts = "STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>"
    schema = f"message STRUCT<items: ARRAY<STRUCT<title: ARRAY<STRING>, DOI: STRING, URL: STRING, author: ARRAY<STRUCT<given: STRING, family: STRING>>, `container-title`: ARRAY<STRING>, abstract: STRING, `published-print`: {parts}, `published-online`: {parts}, issued: {parts}>>>"
    rows = _items(bodies, schema, "message.items").where(F.col("at") < limit)

    def date(name: str) -> Column:
        p = F.try_element_at(F.col(f"x.`{name}`.`date-parts`"), F.lit(1))
        text = F.concat_ws("-", F.lpad(p[0].cast("string"), 4, "0"), F.lpad(p[1].cast("string"), 2, "0"), F.lpad(p[2].cast("string"), 2, "0"))
        return F.when(F.size(p) >= 3, F.try_to_date(text, "yyyy-MM-dd"))

    published = F.coalesce(date("published-print"), date("published-online"), date("issued"))
    doi = F.trim(F.coalesce("x.DOI", F.lit("")))
    url = _first(F.col("x.URL"), F.when(doi != "", F.concat(F.lit("https://doi.org/"), F.replace(U.encode(doi), F.lit("%2F"), F.lit("/")))))
    names = F.array_join(F.filter(F.transform(F.slice("x.author", 1, 4), lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))), lambda n: n != ""), ", ")
    details = F.array_join(F.filter(F.array(F.coalesce(names, F.lit("")), F.coalesce(F.try_element_at(F.col("x.`container-title`"), F.lit(1)), F.lit("")), F.coalesce(published.cast("string"), F.lit("")), F.when(doi != "", F.concat(F.lit("DOI "), doi)).otherwise("")), lambda d: d != ""), "; ")
    out = rows.select("id", "at", F.substring(T.squeeze(F.coalesce(F.try_element_at(F.col("x.title"), F.lit(1)), F.lit(""))), 1, 200).alias("title"), url.alias("url"), F.substring(_first(_plain(F.col("x.abstract"), 800), details), 1, 400).alias("snippet"), published.alias("published_at"), _none().alias("modified_at"))
    return _numbered(out.where("title <> '' AND url <> ''"), limit)


def answers(bodies: DataFrame, limit: int = 50) -> DataFrame:
    """Questions of a site of answers: the body, else whether answered, score and tags."""
    rows = _items(bodies, "items ARRAY<STRUCT<title: STRING, link: STRING, body: STRING, tags: ARRAY<STRING>, is_answered: BOOLEAN, score: INT>>", "items").where(F.col("at") < limit)
    details = F.array_join(F.array_compact(F.array(F.when(F.col("x.is_answered"), "accepted answer").otherwise("unanswered"), F.concat(F.lit("score "), F.col("x.score").cast("string")), F.when(F.size("x.tags") > 0, F.array_join(F.slice("x.tags", 1, 5), ", ")))), " · ")
    out = rows.select("id", "at", _plain(F.col("x.title"), 200).alias("title"), F.trim("x.link").alias("url"), F.substring(_first(_plain(F.col("x.body"), 800), details), 1, 400).alias("snippet"), _none().alias("published_at"), _none().alias("modified_at"))
    return _numbered(out.where((F.col("title") != "") & F.col("url").startswith("https://stackoverflow.com/")), limit)


def articles(bodies: DataFrame, limit: int = 50) -> DataFrame:
    """Articles of a news index; when the index saw them isn't when they were published."""
    rows = _items(bodies, "articles ARRAY<STRUCT<title: STRING, url: STRING, seendate: STRING>>", "articles")
    url = F.substring(T.squeeze(F.coalesce("x.url", F.lit(""))), 1, 2048)
    out = rows.select("id", "at", F.substring(T.squeeze(F.coalesce("x.title", F.lit(""))), 1, 240).alias("title"), url.alias("url"), F.lit("").alias("snippet"), _none().alias("published_at"), _none().alias("modified_at"))
    return _numbered(out.where((F.col("title") != "") & U.scheme(F.col("url")).isin("http", "https") & (U.host(F.col("url")) != "")), limit)


def results(bodies: DataFrame, path: str = "results", limit: int = 50) -> DataFrame:
    """Hits of services that give results, data, items, hits, organic or web.results, whatever they call the fields."""
    many = f"ARRAY<{_ITEM}>"
    schema = f"results {many}, data {many}, items {many}, hits {many}, organic {many}, web STRUCT<results: {many}>"
    rows = _items(bodies, schema, path)
    published = F.coalesce(*[_day(F.col(f"x.{k}")) for k in ("page_age", "date", "published_date", "publishedDate", "published")])
    out = rows.select("id", "at", F.substring(_first(F.col("x.title")), 1, 200).alias("title"), _first(F.col("x.url"), F.col("x.link")).alias("url"), F.substring(_first(*[F.col(f"x.{k}") for k in ("description", "snippet", "content", "text")]), 1, 400).alias("snippet"), published.alias("published_at"), _none().alias("modified_at"))
    return _numbered(out.where((F.col("title") != "") & F.col("url").rlike("^https?://")), limit)


def repositories(bodies: DataFrame, mode: str = "repositories", limit: int = 50) -> DataFrame:
    """Repositories (revised), issues or releases (published) of a code host."""
    item = "STRUCT<full_name: STRING, name: STRING, tag_name: STRING, title: STRING, html_url: STRING, description: STRING, body: STRING, license: STRUCT<spdx_id: STRING>, updated_at: STRING, published_at: STRING, created_at: STRING>"
    wrapped = bodies.select("id", F.when(F.lit(mode == "releases"), F.concat(F.lit('{"items":'), "body", F.lit("}"))).otherwise(F.col("body")).alias("body"))
    rows = _items(wrapped, f"items ARRAY<{item}>", "items").where(F.col("at") < limit)
    licence = F.when(F.col("x.license.spdx_id") != "", F.concat(F.lit("License: "), F.col("x.license.spdx_id")))
    titles = {"repositories": ("full_name", "name"), "releases": ("name", "tag_name")}.get(mode, ("title",))
    snippet = F.array_join(F.array_compact(F.array(F.when(T.squeeze(F.col("x.description")) != "", T.squeeze(F.col("x.description"))), licence)), " · ") if mode == "repositories" else T.squeeze(F.coalesce("x.body", F.lit("")))
    published = _none() if mode == "repositories" else _day(F.col("x.published_at" if mode == "releases" else "x.created_at"))
    modified = _day(F.col("x.updated_at")) if mode == "repositories" else _none()
    out = rows.select("id", "at", F.substring(_first(*[F.col(f"x.{t}") for t in titles]), 1, 200).alias("title"), F.trim("x.html_url").alias("url"), F.substring(snippet, 1, 400).alias("snippet"), published.alias("published_at"), modified.alias("modified_at"))
    return _numbered(out.where((F.col("title") != "") & F.col("url").startswith("https://github.com/")), limit)


def posts(bodies: DataFrame) -> DataFrame:
    """(id, title, url, author, group, score, comments, created_at, text): posts of forums under any of their fields' names."""
    names = "title name url link permalink author username user subreddit community group channel score points upvotes num_comments comments comment_count created_at created created_utc published published_at date selftext body text content summary".split()
    p = bodies.where(F.col("body").rlike(r"^\s*\{")).select("id", F.from_json(F.col("body"), ", ".join(f"`{n}` STRING" for n in names)).alias("p"))

    def pick(*some: str) -> Column:
        return F.coalesce(*[F.when(F.col(f"p.{n}") != "", F.col(f"p.{n}")) for n in some])

    return p.where(F.col("p").isNotNull()).select(
        "id", F.coalesce(pick("title", "name"), F.lit("")).alias("title"), F.coalesce(pick("url", "link", "permalink"), F.lit("")).alias("url"), F.coalesce(pick("author", "username", "user"), F.lit("")).alias("author"),
        F.coalesce(pick("subreddit", "community", "group", "channel"), F.lit("")).alias("group"), pick("score", "points", "upvotes").try_cast("int").alias("score"), pick("num_comments", "comments", "comment_count").try_cast("int").alias("comments"),
        pick("created_at", "created", "created_utc", "published", "published_at", "date").alias("created_at"), F.coalesce(pick("selftext", "body", "text", "content", "summary"), F.lit("")).alias("text"),
    )


def _tag(xml: Column, name: str) -> Column:
    inner = F.regexp_extract(xml, rf"(?is)<(?:[a-z]+:)?{name}(?:\s[^>]*)?>(.*?)</(?:[a-z]+:)?{name}>", 1)
    return _plain(F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), 2000)


def feed(bodies: DataFrame, limit: int = 50) -> DataFrame:
    """(id, position, title, url, snippet, published): entries of RSS and Atom documents; published is the raw text."""
    entries = F.regexp_extract_all("body", F.lit(r"(?is)<(?:item|entry)(?:\s[^>]*)?>.*?</(?:item|entry)>"), F.lit(0))
    rows = bodies.select("id", F.posexplode(entries).alias("at", "x"))
    link = F.regexp_extract("x", r"(?is)<link[^>]*href=\"([^\"]*)\"", 1)
    out = rows.select("id", "at", _tag(F.col("x"), "title").alias("title"), _first(_tag(F.col("x"), "link"), link, _tag(F.col("x"), "guid")).alias("url"), _first(_tag(F.col("x"), "description"), _tag(F.col("x"), "summary"), _tag(F.col("x"), "content")).alias("snippet"), _first(_tag(F.col("x"), "pubDate"), _tag(F.col("x"), "published"), _tag(F.col("x"), "updated")).alias("published"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("at"))
    return out.where("title <> '' AND url <> ''").withColumn("position", place).where(F.col("position") <= limit).drop("at")


ENTRY = r"(?is)<(?:item|entry)(?:\s[^>]*)?>.*?</(?:item|entry)>"
NO_LINK = "entry has no link and no URL guid; the permalink is unknown"
BAD_LINK = "entry link could not be resolved: "


def _own_link(xml: Column) -> Column:
    """The text of <link>, or the href of the first one that isn't for something else than the thing itself."""
    tags = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:[a-z]+:)?link\s[^>]*>"), F.lit(0))
    own = F.filter(tags, lambda t: ~F.lower(F.regexp_extract(t, r"(?is)\srel\s*=\s*[\"']([^\"']*)", 1)).isin("self", "edit", "replies", "enclosure", "related", "via", "hub", "next", "prev"))
    hrefs = F.transform(own, lambda t: _plain(F.regexp_extract(t, r"(?is)\shref\s*=\s*[\"']([^\"']*)", 1), 2000))
    return _first(_tag(xml, "link"), F.get(F.filter(hrefs, lambda h: h != ""), F.lit(0)))


def linked_feed(documents: DataFrame, limit: int = 20) -> DataFrame:
    """(id, position, title, url, published_at, guid, author, warning): entries of feeds (id, url, body) with absolute links.

    A relative link is resolved against the feed's own link, if that is absolute,
    else against where the feed was read; a guid that is a URL stands in for a
    missing link. An entry whose link is unknown or can't be resolved stays, with
    a warning. published_at is the UTC day, null if it is no whole date.
    """
    rows = documents.select("id", F.trim("url").alias("feed_url"), F.regexp_replace(F.coalesce("body", F.lit("")), "(?is)<(item|entry)[ >].*", "").alias("head"), F.posexplode(F.regexp_extract_all("body", F.lit(ENTRY), F.lit(0))).alias("at", "x")).where(F.col("at") < limit)
    web = lambda c: F.lower(c).rlike("^https?://")
    rows = rows.select("id", "at", "x", "feed_url", _own_link(F.col("head")).alias("feed_link"), _own_link(F.col("x")).alias("link"), _first(_tag(F.col("x"), "guid"), _tag(F.col("x"), "id")).alias("guid"))
    raw = F.when(F.col("link") != "", F.col("link")).when(web(F.col("guid")), F.col("guid")).otherwise("")
    rows = rows.withColumn("raw", raw).withColumn("base", F.when(web(F.col("feed_link")), F.col("feed_link")).otherwise(F.coalesce("feed_url", F.lit(""))))
    whole = F.col("raw").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]")
    url = F.when((F.col("raw") == "") | whole, F.col("raw")).when(F.col("raw").startswith("//"), F.concat(F.lit("https:"), "raw")).otherwise(U.resolve(F.col("base"), F.col("raw")))
    rows = rows.withColumn("resolved", url)
    lost = (F.col("raw") != "") & ~F.col("resolved").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    warning = F.when(F.col("raw") == "", NO_LINK).when(lost, F.concat(F.lit(BAD_LINK), F.substring("raw", 1, 120)))
    when = _first(_tag(F.col("x"), "pubDate"), _tag(F.col("x"), "published"), _tag(F.col("x"), "date"), _tag(F.col("x"), "updated"))
    return rows.select("id", (F.col("at") + 1).alias("position"), _tag(F.col("x"), "title").alias("title"), F.when(lost, F.col("raw")).otherwise(F.col("resolved")).alias("url"), D.normalize_timestamp(when).alias("published_at"), "guid", _first(_tag(F.col("x"), "creator"), _tag(F.regexp_extract("x", r"(?is)<author(?:\s[^>]*)?>.*?</author>", 0), "name"), _tag(F.col("x"), "author")).alias("author"), warning.alias("warning"))


def feed_documents(documents: DataFrame, limit: int = 20) -> DataFrame:
    """(id, status, title, link, entries, returned, warnings): a row for each feed; `unparsed` if it has neither entries nor a title.
    A title that is missing is the feed's URL; warnings are those of the entries returned, in order."""
    head = F.regexp_replace(F.coalesce("body", F.lit("")), "(?is)<(item|entry)[ >].*", "")
    heads = documents.select("id", "url", _tag(head, "title").alias("own"), _own_link(head).alias("link"), F.coalesce(F.regexp_count("body", F.lit(ENTRY)), F.lit(0)).alias("entries"))
    found = linked_feed(documents, limit).groupBy("id").agg(F.count("*").cast("int").alias("returned"), F.transform(F.array_sort(F.collect_list(F.when(F.col("warning").isNotNull(), F.struct("position", "warning")))), lambda w: w["warning"]).alias("warnings"))
    out = heads.join(found, "id", "left")
    status = F.when((F.col("entries") == 0) & (F.col("own") == ""), "unparsed").otherwise("ok")
    return out.select("id", status.alias("status"), F.when(F.col("own") != "", F.col("own")).otherwise(F.col("url")).alias("title"), "link", "entries", F.coalesce("returned", F.lit(0)).alias("returned"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))


def sitemap(bodies: DataFrame) -> DataFrame:
    """(id, kind, url, lastmod, published, title): `index` rows name further sitemaps, `page` rows pages."""
    entries = F.regexp_extract_all("body", F.lit(r"(?is)<(?:url|sitemap)(?:\s[^>]*)?>.*?</(?:url|sitemap)>"), F.lit(0))
    rows = bodies.select("id", F.explode(entries).alias("x"))
    kind = F.when(F.col("x").rlike(r"(?i)^<sitemap[\s>]"), "index").otherwise("page")
    return rows.select("id", kind.alias("kind"), _tag(F.col("x"), "loc").alias("url"), _tag(F.col("x"), "lastmod").alias("lastmod"), _tag(F.col("x"), "publication_date").alias("published"), _tag(F.col("x"), "title").alias("title")).where("url <> ''")


def sitemap_candidates(domain: Column, robots: Column) -> Column:
    """Where a domain's sitemaps may be: those that robots.txt names, then the usual places."""
    named = F.regexp_extract_all(F.coalesce(robots, F.lit("")), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))
    usual = F.array(*[F.concat(F.lit("https://"), domain, F.lit(p)) for p in ("/sitemap.xml", "/sitemap_index.xml", "/news-sitemap.xml", "/sitemap-news.xml")])
    return F.array_distinct(F.concat(named, usual))
