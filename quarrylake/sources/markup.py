"""Result pages and article pages as rows and dates, by Spark's own pattern functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions import url as U
from .payloads import _plain

# Names of meta tags, by priority.
PUBLISHED = "article:published_time og:article:published_time parsely-pub-date dc.date.issued dc.date.created dcterms.created datepublished publish-date publish_date publication_date sailthru.date date originalpublicationdate".split()
MODIFIED = "article:modified_time og:updated_time article:updated_time parsely-pub-date-updated dc.date.modified dcterms.modified datemodified last-modified lastmod updated_time".split()
ARTICLE_TYPES = "newsarticle article reportagenewsarticle blogposting scholarlyarticle webpage report".split()

#: For each kind of result page: a hit's block, its link, its title and its snippet.
LAYOUTS = {
    "classed": (r"(?is)<a[^>]*class=\"[^\"]*result(?:__a|-link)\b[^\"]*\"[^>]*>.*?(?=<a[^>]*class=\"[^\"]*result(?:__a|-link)\b|$)", r"(?is)^<a[^>]*href=\"([^\"]*)\"", r"(?is)^<a[^>]*>(.*?)</a>", r"(?is)class=\"[^\"]*result(?:__|-)snippet[^\"]*\"[^>]*>(.*?)</(?:a|div|td|span)>"),
    "listed": (r"(?is)<li[^>]*class=\"[^\"]*\bb_algo\b[^\"]*\"[^>]*>.*?</li>", r"(?is)<h2[^>]*>.*?<a[^>]*href=\"([^\"]*)\"", r"(?is)<h2[^>]*>(.*?)</h2>", r"(?is)<p[^>]*>(.*?)</p>"),
    "plain": (r"(?is)<h2[^>]*>\s*<a[^>]*>.*?</h2>.*?<p[^>]*>.*?</p>", r"(?is)<a[^>]*href=\"([^\"]*)\"", r"(?is)<a[^>]*>(.*?)</a>", r"(?is)</h2>.*?<p[^>]*>(.*?)</p>"),
}


def result_page(pages: DataFrame, layout: str) -> DataFrame:
    """(id, position, title, url, snippet): hits of result pages (id, html); pages without hits give no rows."""
    block, link, title, snippet = LAYOUTS[layout]
    rows = pages.select("id", F.posexplode(F.regexp_extract_all("html", F.lit(block), F.lit(0))).alias("at", "x"))
    raw = F.replace(F.regexp_extract("x", link, 1), F.lit("&amp;"), F.lit("&"))
    target = {"classed": U.search_redirect, "listed": U.coded_redirect}.get(layout, lambda c: c)(raw)
    out = rows.select("id", "at", _plain(F.regexp_extract("x", title, 1), 2000).alias("title"), target.alias("url"), _plain(F.regexp_extract("x", snippet, 1), 2000).alias("snippet"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("at"))
    return out.where((F.col("title") != "") & F.col("url").rlike("^https?://")).select("id", place.alias("position"), "title", "url", "snippet")


META = r"(?is)<meta\s[^>]*>"


def _metas(html: Column) -> Column:
    """Names of a page's meta tags (name, property or itemprop, in lower case) with the content of the first of each."""
    def attribute(tag: Column, names: str) -> Column:
        return F.regexp_extract(tag, rf"(?is)\s(?:{names})\s*=\s*[\"']([^\"']*)[\"']", 1)

    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(META), F.lit(0))
    pairs = F.transform(tags, lambda t: F.struct(F.lower(attribute(t, "name|property|itemprop")).alias("key"), attribute(t, "content").alias("value")))
    kept = F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))
    first = F.filter(kept, lambda p, i: F.array_position(F.transform(kept, lambda q: q["key"]), p["key"]) == i + 1)
    return F.map_from_entries(first)


def _first_of(found: list[tuple[Column, str]]) -> Column:
    """(day, evidence) of the first day that isn't null."""
    out = F.when(found[0][0].isNotNull(), F.struct(found[0][0].alias("day"), F.lit(found[0][1]).alias("evidence")))
    for day, evidence in found[1:]:
        out = out.when(day.isNotNull(), F.struct(day.alias("day"), F.lit(evidence).alias("evidence")))
    return out


def article_dates(html: Column) -> Column:
    """(published_at, modified_at, evidence, confidence) of an article's page: JSON-LD, then meta tags, then <time>. When it
    was changed is never taken for when it was published; nothing is read from prose."""
    blocks = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    kind = rf"(?is)\"@type\"\s*:\s*(?:\[[^\]]*)?\"(?:{'|'.join(ARTICLE_TYPES)})\""
    articles = F.array_join(F.filter(blocks, lambda b: b.rlike(kind)), "\n")
    ld = lambda *names: F.coalesce(*[D.normalize_timestamp(F.regexp_extract(articles, rf'(?s)"{n}"\s*:\s*"([^"]*)"', 1)) for n in names])
    stamp = r"(?is)<time(?![^>]*(?:itemprop|class)=)[^>]*datetime=[\"']([^\"']*)[\"']"
    hinted = r"(?is)<time(?=[^>]*(?:itemprop|class)=[\"'][^\"']*(?:published|pubdate))[^>]*datetime=[\"']([^\"']*)[\"']"
    t = F.coalesce(D.normalize_timestamp(F.regexp_extract(html, hinted, 1)), D.normalize_timestamp(F.regexp_extract(html, stamp, 1)))

    def of(metas: Column) -> Column:
        """What the tags say, which are read once."""
        named = lambda names: F.filter(F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.struct(D.normalize_timestamp(F.try_element_at(metas, F.lower(n))).alias("day"), F.concat(F.lit("meta:"), n).alias("evidence"))), lambda x: x["day"].isNotNull())
        published = F.coalesce(_first_of([(ld("datePublished", "uploadDate"), "jsonld:datePublished")]), F.get(named(PUBLISHED), F.lit(0)), _first_of([(t, "time:datetime")]))
        modified = F.coalesce(ld("dateModified", "dateUpdated"), F.get(named(MODIFIED), F.lit(0))["day"])
        return T.let(published, lambda p: F.struct(p["day"].alias("published_at"), modified.alias("modified_at"), F.coalesce(p["evidence"], F.lit("")).alias("evidence"), F.when(p["evidence"] == "time:datetime", "medium").when(p["day"].isNotNull(), "high").otherwise("").alias("confidence")))

    return T.let(_metas(html), of)
