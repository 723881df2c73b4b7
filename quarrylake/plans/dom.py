"""Queries over pages as elements: selectors, absolute links, controls and forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import elements as E
from .inputs import stored, table


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(E.parse(table(spark, sf_dir, "pages"), keep=("url",)), "parsed")


#: Fields of a page: a scalar, a scalar by a child step, lists by descendants, by siblings, and one that no page has.
SCHEMA = {"title": "head > title", "heading": "article > h1", "menu": "body > nav li > a[href^='/']", "paragraphs": "article p", "ad_or_foot": "div.ad, footer", "after_heading": "h1 + p", "none": "main #content"}


def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.extract(_parsed(spark, sf_dir), SCHEMA)
    many = lambda n: F.coalesce(F.array_join(F.coalesce(F.col(f"{n}.many"), F.array(F.col(f"{n}.one"))), "|"), F.lit("")).alias(n)
    return found.select(F.col("page").alias("page_id"), F.col("title.one").alias("title"), F.col("heading.one").alias("heading"), many("menu"), many("paragraphs"), many("ad_or_foot"), F.col("after_heading.one").alias("after_heading"), F.col("none.one").alias("none"))


def _unescaped(x: str) -> str:
    for a, b in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&amp(?![a-zA-Z0-9=;])", "&")):
        x = f"replace({x}, '{a}', '{b}')" if "(" not in a else x
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


_TEXT = lambda x: _unescaped(f"regexp_replace({x}, '<[^>]*>', '', 'g')")
# A title may be cut within a reference: `&amp` at its end stands for the sign too.
_TITLE = "regexp_replace(" + _TEXT("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)") + ", '&amp$', '&')"
_NAV = "regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)"
_BODY = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
EXTRACT_SQL = f"""SELECT page_id, {_TITLE} AS title, regexp_replace({_TEXT(f"regexp_extract({_BODY}, '(?s)<h1>(.*?)</h1>', 1)")}, '&amp$', '&') AS heading,
 array_to_string(list_transform(regexp_extract_all({_NAV}, '(?s)<a href="/[^"]*">(.*?)</a>', 1), lambda x: {_TEXT("x")}), '|') AS menu,
 array_to_string(list_transform(string_split({_BODY}, '<p>')[2:], lambda x: {_TEXT("regexp_replace(x, '(?s)</p>.*', '')")}), '|') AS paragraphs,
 array_to_string([{_TEXT("regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)")}, {_TEXT("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)")}], '|') AS ad_or_foot,
 {_TEXT(f"regexp_replace(string_split({_BODY}, '<p>')[2], '(?s)</p>.*', '')")} AS after_heading, CAST(NULL AS VARCHAR) AS none FROM pages"""


def selector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.counts(_parsed(spark, sf_dir), {"anchors": "a[href]", "items": "nav ul > li", "later_items": "li ~ li", "odd_items": "li:nth-child(odd)", "first_or_last": "li:first-child, li:last-child", "breaks": "article b > br", "bold_in_nav": "nav b", "not_ad": "body > div:not(.ad)"})
    return found.withColumnRenamed("page", "page_id")


_N = f"len(regexp_extract_all({_NAV}, '<li>'))"
COUNTS_SQL = f"""SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS anchors, {_N} AS items, greatest({_N} - 1, 0) AS later_items, ({_N} + 1) // 2 AS odd_items, least({_N}, 2) AS first_or_last,
 len(regexp_extract_all({_BODY}, '<br>')) AS breaks, 0 AS bold_in_nav, 0 AS not_ad FROM pages"""


def _varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose menus are written in six ways, by id: references of each kind, and each way of quoting."""
    i, html = F.col("page_id") % 6, F.col("html")
    to = {1: 'href="./$1"', 2: 'href="../$1"', 3: 'href="//other.example/a/../$1"', 4: 'href="?q=$1"', 5: "HREF = 'https://ABC.example/$1#x'"}
    out = html
    for k, x in to.items():
        out = F.when(i == k, F.regexp_replace(html, 'href="/([^"]*)"', x)).otherwise(out)
    return table(spark, sf_dir, "pages").select("page_id", "url", out.alias("html"))


def absolute_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = stored(E.parse(_varied(spark, sf_dir), keep=("url",)), "parsed")
    return E.links(parsed).select(F.col("page").alias("page_id"), "place", "text", "url", "internal")


_REST = "regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)', {})"
LINKS_SQL = f"""WITH p AS (SELECT page_id, {_REST.format(1)} AS s, {_REST.format(2)} AS h, {_REST.format(3)} AS d, {_NAV} AS nav FROM pages),
a AS (SELECT *, regexp_extract_all(nav, '(?s)<a href="/([^"]*)">(.*?)</a>', 1) AS refs, regexp_extract_all(nav, '(?s)<a href="/([^"]*)">(.*?)</a>', 2) AS texts FROM p),
b AS (SELECT page_id, s, h, d, unnest(refs) AS r, unnest(texts) AS t, generate_subscripts(refs, 1) AS place FROM a),
c AS (SELECT *, replace(r, '&amp;', '&') AS u, CASE WHEN d = '' THEN '/' ELSE regexp_extract(d, '^(.*/)', 1) END AS dir FROM b)
SELECT page_id, CAST(place AS INTEGER) AS place, {_TEXT("t")} AS text,
 CASE page_id % 6 WHEN 0 THEN s || '://' || h || '/' || u WHEN 1 THEN s || '://' || h || dir || u WHEN 2 THEN s || '://' || h || CASE WHEN dir = '/' THEN '/' ELSE regexp_extract(dir, '^(.*/)[^/]*/$', 1) END || u
  WHEN 3 THEN s || '://other.example/' || u WHEN 4 THEN s || '://' || h || d || '?q=' || u ELSE 'https://ABC.example/' || u || '#x' END AS url, page_id % 6 NOT IN (3, 5) AS internal FROM c"""


def _with_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages, each with a form after it whose controls are named in all ways, and one control outside."""
    i = F.col("page_id").cast("string")
    form = F.concat(
        F.lit('<form id="f'), i, F.lit('" action="send?x='), i, F.lit('" method=post><label for="q'), i, F.lit('"> Query  '), i, F.lit('</label><input id="q'), i, F.lit('" name=q value="v'), i,
        F.lit('" required><label>Agree <input type=checkbox name=ok></label><select name=s aria-label="Sort"><option value=a>A<option selected>B '), i, F.lit('</select><textarea placeholder="Notes">n'), i,
        F.lit('</textarea><input type=hidden name=token value=t><button>Go '), i, F.lit("</button></form><input type=submit hidden><span role=button onclick=x()>Out "), i, F.lit("</span>"))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.concat("html", form).alias("html"))


def page_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = stored(E.parse(_with_form(spark, sf_dir), keep=("url",)), "parsed")
    found = E.forms(parsed).select("page", "form", "id", "action", "method", F.posexplode("fields").alias("at", "x"))
    return found.select(F.col("page").alias("page_id"), "form", F.col("id").alias("form_id"), "action", "method", "at", "x.tag", "x.type", "x.name", "x.label", "x.value", "x.required")


_ACTION = """CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN regexp_extract(url, '^[^?#]*', 0) || '/' ELSE regexp_extract(url, '^([a-z]+://[^?#]*/)[^/?#]*', 1) END || 'send?x=' || page_id"""
FORMS_SQL = f"""SELECT page_id, 0 AS form, 'f' || page_id AS form_id, {_ACTION} AS action, 'POST' AS method, x.at, x.tag, x.type, x.name, x.label, x.value, x.required FROM (SELECT page_id, url, unnest([
 {{'at': 0, 'tag': 'input', 'type': 'text', 'name': 'q', 'label': 'Query ' || page_id, 'value': 'v' || page_id, 'required': true}}, {{'at': 1, 'tag': 'input', 'type': 'checkbox', 'name': 'ok', 'label': 'Agree', 'value': '', 'required': false}},
 {{'at': 2, 'tag': 'select', 'type': 'text', 'name': 's', 'label': 'Sort', 'value': 'B ' || page_id, 'required': false}}, {{'at': 3, 'tag': 'textarea', 'type': 'text', 'name': '', 'label': 'Notes', 'value': 'n' || page_id, 'required': false}},
 {{'at': 4, 'tag': 'input', 'type': 'hidden', 'name': 'token', 'label': 'token', 'value': 't', 'required': false}}, {{'at': 5, 'tag': 'button', 'type': 'text', 'name': '', 'label': 'Go ' || page_id, 'value': '', 'required': false}}]) AS x FROM pages)"""


def interactive_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = stored(E.parse(_with_form(spark, sf_dir), keep=("url",)), "parsed")
    return E.interactive(parsed).withColumnRenamed("page", "page_id")


INTERACTIVE_SQL = f"""WITH p AS (SELECT page_id, {_REST.format(1)} || '://' || {_REST.format(2)} || '/' AS root, {_NAV} AS nav FROM pages),
a AS (SELECT page_id, root, regexp_extract_all(nav, '(?s)<a href="/([^"]*)">(.*?)</a>', 1) AS refs, regexp_extract_all(nav, '(?s)<a href="/([^"]*)">(.*?)</a>', 2) AS texts FROM p),
b AS (SELECT page_id, root, unnest(refs) AS r, unnest(texts) AS t, generate_subscripts(refs, 1) AS ref FROM a)
SELECT page_id, CAST(ref AS INTEGER) AS ref, 'a' AS tag, 'link' AS role, {_TEXT("t")} AS name, CAST(NULL AS VARCHAR) AS type, root || replace(r, '&amp;', '&') AS href, CAST(NULL AS VARCHAR) AS value, 'a' AS selector FROM b
UNION ALL SELECT page_id, CAST(n + x.ref AS INTEGER) AS ref, x.tag, x.role, x.name, x.type, CAST(NULL AS VARCHAR) AS href, x.value, x.selector FROM (SELECT page_id, len(refs) AS n, unnest([
 {{'ref': 1, 'tag': 'input', 'role': 'textbox', 'name': 'Query ' || page_id, 'type': NULL, 'value': 'v' || page_id, 'selector': '#q' || page_id}}, {{'ref': 2, 'tag': 'input', 'role': 'checkbox', 'name': 'Agree', 'type': 'checkbox', 'value': '', 'selector': 'input'}},
 {{'ref': 3, 'tag': 'select', 'role': 'combobox', 'name': 'Sort', 'type': NULL, 'value': 'B ' || page_id, 'selector': 'select'}}, {{'ref': 4, 'tag': 'textarea', 'role': 'textbox', 'name': 'Notes', 'type': NULL, 'value': 'n' || page_id, 'selector': 'textarea'}},
 {{'ref': 5, 'tag': 'input', 'role': 'input', 'name': 'token', 'type': 'hidden', 'value': 't', 'selector': 'input'}}, {{'ref': 6, 'tag': 'button', 'role': 'button', 'name': 'Go ' || page_id, 'type': NULL, 'value': '', 'selector': 'button'}},
 {{'ref': 7, 'tag': 'span', 'role': 'button', 'name': 'Out ' || page_id, 'type': NULL, 'value': NULL, 'selector': 'span'}}]) AS x FROM a)"""

QUERIES = {"page_extract": page_extract, "selector_counts": selector_counts, "absolute_links": absolute_links, "page_forms": page_forms, "interactive_elements": interactive_elements}
SQL = {"page_extract": EXTRACT_SQL, "selector_counts": COUNTS_SQL, "absolute_links": LINKS_SQL, "page_forms": FORMS_SQL, "interactive_elements": INTERACTIVE_SQL}
