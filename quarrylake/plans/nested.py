"""Queries over answers and linked data of any shape. Each page is written as one, in a shape that its id decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import nested as N
from .inputs import checkpoints, table


def _day() -> Column:
    return F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), (F.col("page_id") % 600).cast("int")), "yyyy-MM-dd")


def _json(template: str, **values: Column) -> Column:
    """A text with columns in the place of {name}."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = min((rest.find("{" + n + "}") for n in values if "{" + n + "}" in rest), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        name = rest[at + 1 : rest.index("}", at)]
        parts += [F.lit(rest[:at]), values[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


ITEM = '{"title": "Page {i}", "url": {u}, "text": "No. {i}", "publishedDate": "{d}T10:00:00Z"}'
#: By id: a named list; one of several deep objects, the first empty one passed over; within text; a bare list; an empty named list
#: that stands for its object; a list of texts beside one of objects in a sibling field.
SHAPES = [
    '{"results": [' + ITEM + ', {"title": "none"}, 5, {"link": "https://l.example/{i}"}]}',
    '{"meta": {"n": 1, "data": []}, "payload": {"zz": {"deep": {"hits": [7, ' + ITEM + ']}}, "aa": {"items": [{"url": "https://wrong.example/"}]}}}',
    'log: started\n{"response": {"items": [' + ITEM + ']}}\ndone.',
    '[' + ITEM + ', "x", {"url": ""}]',
    '{"results": [], "other": {"data": [' + ITEM + ']}}',
    '{"names": ["a", "b"], "z": [' + ITEM + '], "a": [{"url": "https://later.example/"}]}',
    "{not json",
]


def found_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"i": F.col("page_id").cast("string"), "u": F.regexp_extract(F.to_json(F.struct("url")), '^.*?:(".*")}$', 1), "d": _day()}
    body = F.lit(None).cast("string")
    for k, shape in enumerate(SHAPES):
        body = F.when(F.col("page_id") % len(SHAPES) == k, _json(shape, **values)).otherwise(body)
    pages = table(checkpoints(spark), sf_dir, "pages").select("page_id", body.alias("body"))
    return N.found_results(pages, "page_id").withColumnRenamed("doc", "page_id")


RESULTS_SQL = """WITH p AS (SELECT page_id, page_id % 7 AS k, url, CAST(DATE '2025-01-01' + CAST(page_id % 600 AS INTEGER) AS VARCHAR) AS day FROM pages)
SELECT page_id, 1 AS position, 'Page ' || page_id AS title, url, 'No. ' || page_id AS snippet, day AS published_at FROM p WHERE k IN (0, 1, 2, 3, 5)
UNION ALL SELECT page_id, 3, 'https://l.example/' || page_id, 'https://l.example/' || page_id, '', NULL FROM p WHERE k = 0"""

#: By id: an article with an author's and an image's own dates; a graph with a page before its article, whose date is no date; two
#: blocks, the first broken; a list of types; an article deep in an object whose field stands before another's; no article; none.
LINKED = [
    '{"@type": "NewsArticle", "author": {"@type": "Person", "datePublished": "1999-01-01"}, "image": {"uploadDate": "1998-01-01"}, "dateModified": "2026-06-01", "datePublished": "{d}T05:00:00Z"}',
    '{"@graph": [{"@type": "WebPage", "datePublished": "soon"}, {"@type": "Person", "dateModified": "2000-01-01"}, {"@type": "article", "uploadDate": "{d}", "dateUpdated": "2026-06-02"}]}',
    '{"@type": "Article", "datePublished": "1997-01-01"</script><script type=\'application/ld+json\' id="x">[{"@type": "BlogPosting", "datePublished": "{d}"}]',
    '{"@type": ["Thing", "Report"], "about": {"@type": "Article", "datePublished": "1996-01-01"}, "datePublished": "{d}"}',
    '{"zzz": {"one": [{"@type": "Article", "datePublished": "{d}"}]}, "aaa": {"@type": "Article", "datePublished": "1995-01-01", "dateModified": "2026-06-03"}}',
    '{"@type": "Person", "datePublished": "1994-01-01"}',
]


def nested_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.lit("<meta name='date' content='2026-12-31'>")
    for k, block in enumerate(LINKED):
        given = F.when(F.col("page_id") % 7 == k, F.concat(F.lit('<script type="application/ld+json">\n'), _json(block, d=_day()), F.lit("\n</script>"))).otherwise(given)
    pages = table(checkpoints(spark), sf_dir, "pages").select("page_id", F.concat("html", given).alias("html"))
    found = N.dated(pages)
    return found.select(F.col("doc").alias("page_id"), F.col("published_at").cast("string").alias("published_at"), F.col("modified_at").cast("string").alias("modified_at"), "evidence", "confidence")


DATES_SQL = """SELECT page_id, CASE WHEN page_id % 7 < 5 THEN CAST(DATE '2025-01-01' + CAST(page_id % 600 AS INTEGER) AS VARCHAR) WHEN page_id % 7 = 6 THEN '2026-12-31' END AS published_at,
 CASE page_id % 7 WHEN 0 THEN '2026-06-01' WHEN 1 THEN '2026-06-02' WHEN 4 THEN '2026-06-03' END AS modified_at,
 CASE WHEN page_id % 7 < 5 THEN 'jsonld:datePublished' WHEN page_id % 7 = 6 THEN 'meta:date' ELSE '' END AS evidence, CASE WHEN page_id % 7 = 5 THEN '' ELSE 'high' END AS confidence FROM pages"""

QUERIES = {"found_results": found_results, "nested_dates": nested_dates}
SQL = {"found_results": RESULTS_SQL, "nested_dates": DATES_SQL}
