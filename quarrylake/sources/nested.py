"""JSON of unknown shape, walked in rounds: article dates in linked data, and lists of results wherever they stand.

A round opens one level of all documents at once, so a walk takes as many jobs
as the deepest document has levels, `depth` at most. What a value is, a VARIANT
says; the order of an object's fields, which a VARIANT doesn't keep, comes from
its text, which is carried beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from .markup import ARTICLE_TYPES, article_dates

# The fields under which a list of results stands, by priority.
RESULT_FIELDS = ["results", "data", "items", "hits"]

#: Levels that a walk opens; below them nothing is looked at.
DEPTH = 32

LINKED = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"


def _opened(nodes: DataFrame) -> DataFrame:
    """(key, path, raw, v) of all values within `nodes`, of objects in the order of their fields."""
    spark = nodes.sparkSession
    fields, entries = F.from_json("raw", "map<string,string>"), F.from_json("raw", "array<string>")
    inside = nodes.withColumn("fields_", fields).withColumn("entries_", entries).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    at = F.when(F.col("key").isNotNull(), F.array_position(F.map_keys("fields_"), F.col("key")).cast("int") - 1).otherwise(F.col("pos"))
    raw = F.when(F.col("key").isNotNull(), F.try_element_at("fields_", F.col("key"))).otherwise(F.get("entries_", F.col("pos")))
    return inside.select("doc", F.concat("path", F.array(at)).alias("path"), raw.alias("raw"), F.col("value").alias("v"))


def walk(documents: DataFrame, taken: Column, below: Column, depth: int = DEPTH, keep: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """All values under the condition `taken` in JSON texts (doc, path, raw, v), as `keep` returns them; those under `below` are
    opened. A value's place is its path: paths in order are a walk that meets what holds a value before the value.

    The driver asks after each round whether anything is left to open.
    """
    frontier, found = documents, None
    for _ in range(depth):
        frontier = frontier.checkpoint()
        here = keep(frontier.where(taken))
        found = here if found is None else found.unionByName(here)
        if frontier.isEmpty():
            break
        frontier = _opened(frontier.where(below)).where(F.substring("raw", 1, 1).isin("{", "["))
    return found


def json_ish(bodies: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """(doc, path, raw, v): texts as JSON; of a text that isn't, what lies from its first bracket to its last. Others give no row,
    nor do objects that name a field twice."""
    whole = F.trim(body)
    cut = F.regexp_extract(whole, r"(?s)[\[{].*[\]}]", 0)
    rows = bodies.select(F.col(key).alias("doc"), F.explode(F.array(F.struct(whole.alias("raw"), F.try_parse_json(whole).alias("v"), F.try_parse_json(cut).alias("w"), cut.alias("cut")))).alias("x"))
    rows = rows.select("doc", F.array().cast("array<int>").alias("path"), F.when(F.col("x.v").isNotNull(), F.col("x.raw")).otherwise(F.col("x.cut")).alias("raw"), F.coalesce("x.v", "x.w").alias("v"))
    return rows.where("v IS NOT NULL")


def _listed(path: str) -> Column:
    return F.try_variant_get("v", path, "array<variant>")


def result_lists(bodies: DataFrame, key: str = "id", body: str = "body", depth: int = DEPTH) -> DataFrame:
    """(doc, items): the first list of results in each answer: a list stands for itself; an object for the first of its fields
    `results`, `data`, `items` and `hits` that is a list; otherwise for what its values hold, in order, the first that isn't empty.
    Only the list's objects are items; an answer without such a list gives no row."""
    named = F.coalesce(*[_listed(f"$.{f}") for f in RESULT_FIELDS])
    found = F.coalesce(_listed("$"), named)

    def kept(nodes: DataFrame) -> DataFrame:
        items = F.filter(found, lambda x: F.try_variant_get(x, "$", "map<string,variant>").isNotNull())
        return nodes.select("doc", "path", items.alias("items")).where(F.size("items") > 0)

    every = walk(json_ish(bodies, key, body), found.isNotNull(), found.isNull(), depth, kept)
    first = every.groupBy("doc").agg(F.min("path").alias("path"))
    return every.join(first, ["doc", "path"]).select("doc", "items")


def found_results(bodies: DataFrame, key: str = "id", body: str = "body", limit: int = 50) -> DataFrame:
    """(doc, position, title, url, snippet, published_at): hits of answers of any shape, of the first `limit` items those that have
    a URL; a position is the item's place in its list. A date is the text's first ten characters."""
    text = lambda *names: F.coalesce(*[F.nullif(F.try_variant_get("x", f"$.{n}", "string"), F.lit("")) for n in names])
    items = result_lists(bodies, key, body).select("doc", F.posexplode("items").alias("at", "x")).where(F.col("at") < limit)
    url = text("url", "link")
    return items.where(url.isNotNull()).select("doc", (F.col("at") + 1).alias("position"), F.coalesce(text("title"), url).alias("title"), url.alias("url"), F.substring(F.coalesce(text("text", "snippet"), F.lit("")), 1, 400).alias("snippet"), F.substring(text("publishedDate", "published_date"), 1, 10).alias("published_at"))


def linked_dates(pages: DataFrame, key: str = "page_id", html: str = "html", depth: int = DEPTH) -> DataFrame:
    """(doc, published, modified): dates of the articles in pages' linked data: of the first article, in the order of the walk, that
    has one. A date counts only where it is the article's own, not that of a value within it. Blocks that aren't JSON are skipped."""
    blocks = pages.select(F.col(key).alias("doc"), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINKED), F.lit(1))).alias("block", "raw"))
    nodes = blocks.select("doc", F.array("block").alias("path"), F.trim("raw").alias("raw"), F.try_parse_json(F.trim("raw")).alias("v")).where("v IS NOT NULL")
    text = lambda *names: F.coalesce(*[F.nullif(F.try_variant_get("v", f"$.{n}", "string"), F.lit("")) for n in names])
    kinds = F.coalesce(F.try_variant_get("v", '$["@type"]', "array<string>"), F.array(F.try_variant_get("v", '$["@type"]', "string")))
    article = F.coalesce(F.exists(kinds, lambda k: F.lower(k).isin(ARTICLE_TYPES)), F.lit(False))

    def kept(found: DataFrame) -> DataFrame:
        return found.select("doc", "path", D.normalize_timestamp(text("datePublished", "uploadDate")).alias("published"), D.normalize_timestamp(text("dateModified", "dateUpdated")).alias("modified"))

    articles = walk(nodes, article, F.lit(True), depth, kept)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("path"))).alias(c)
    return articles.groupBy("doc").agg(first("published"), first("modified"))


def dated(pages: DataFrame, key: str = "page_id", html: str = "html", depth: int = DEPTH) -> DataFrame:
    """(doc, published_at, modified_at, evidence, confidence): a row for each page: the dates of its linked data, else those of its
    meta tags, else of its <time> elements. `key` must name a page."""
    rest = pages.select(F.col(key).alias("doc"), article_dates(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), LINKED, "")).alias("d"))
    both = rest.join(linked_dates(pages, key, html, depth), "doc", "left")
    linked = F.col("published").isNotNull()
    return both.select("doc", F.coalesce("published", "d.published_at").alias("published_at"), F.coalesce("modified", "d.modified_at").alias("modified_at"), F.when(linked, "jsonld:datePublished").otherwise(F.col("d.evidence")).alias("evidence"), F.when(linked, "high").otherwise(F.col("d.confidence")).alias("confidence"))
