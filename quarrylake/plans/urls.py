"""Queries over URLs: features, keys, filters by domain, redirects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import url as U
from .inputs import literal, micro, sql_literal, sql_micro, table

EDGES = [
    (1, "HTTP://WWW.Example.com:80/a/b/?utm_source=x&b=2&a=1#frag"),
    (2, "https://example.com"),
    (3, "https://example.com/a//?flag&z=a+b%20c"),
    (4, "ftp://example.com/x"),
    (5, "https://host_name.example.com:8443/v1.2/Docs/index.html?a=1&a-b=2&a=0"),
    (6, "https://translate.google.com/translate?sl=en&u=https%3A%2F%2Fwww.site.org%2Fp%3Fid%3D1"),
    (7, "https://r.jina.ai/https://deep.site.org/x"),
    (8, "http://localhost/x"),
    (9, "http://192.168.1.10/x"),
    (10, "http://8.8.8.8/dns"),
    (11, "https://user:pw@example.com/"),
    (12, "https://staging.example.co.uk/3.10/whats-new_page.php"),
    (13, ""),
    (14, None),
    (15, "not a url"),
    (16, "https://www.nasa.gov/news?ref=home"),
    (17, "https://edition.cnn.com/2026/01/02/story-slug/"),
    (18, "https://sub.dept.ac.in/a"),
    (19, "https://archive.org/v2/x/2_1/"),
    (20, "https://printer.local/a"),
    (21, "example.com/without/scheme"),
    (22, "https://metadata.google.internal/x"),
    (23, "https://example.com/a b"),
    (24, "https://ex.europa.eu/eli?x=%E2%82%AC&y=~*"),
]


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    return pages.unionByName(literal(spark, "id long, url string", [(-i, u) for i, u in EDGES]))


_URLS = "(SELECT page_id AS id, url FROM pages UNION ALL SELECT * FROM " + sql_literal("id, url", [(-i, u) for i, u in EDGES]) + ")"
_R = U.SPLIT.replace("\\s", "[ \\t\\n\\r\\f\\v]")
_TRACK = ", ".join(f"'{x}'" for x in U.TRACKING_PARAMS)

#: CTEs that split the URLs of `src(id, url)` into parts, as DuckDB macros over text.
MACROS = f"""
part AS (SELECT id, url, lower(regexp_extract(url, '{_R}', 1)) AS sch, regexp_extract(url, '{_R}', 2) AS auth, regexp_extract(url, '{_R}', 3) AS pth, regexp_extract(url, '{_R}', 4) AS q FROM src),
parts AS (SELECT *, lower(regexp_extract(regexp_replace(auth, '^.*@', ''), '^(\\[[^\\]]*\\]|[^:]*)', 1)) AS host, regexp_extract(auth, ':([0-9]+)$', 1) AS port FROM part),
split AS (SELECT *, regexp_replace(host, '^www\\.', '') AS dom FROM parts)"""

_UNWRAP = f"""
raw AS (SELECT * FROM {_URLS}),
pre AS (SELECT id, url AS orig, lower(regexp_extract(regexp_replace(regexp_extract(url, '{_R}', 2), '^.*@', ''), '^(\\[[^\\]]*\\]|[^:]*)', 1)) AS h, regexp_extract(url, '{_R}', 4) AS qq FROM raw),
src AS (SELECT id, orig, trim(CASE
  WHEN h LIKE '%translate.google.com' OR h = 'translate.google.co.in' THEN coalesce(
    CASE WHEN regexp_matches(url_decode(regexp_extract(qq, '(?:^|&)u=([^&]*)', 1)), '^https?://') THEN url_decode(regexp_extract(qq, '(?:^|&)u=([^&]*)', 1)) END,
    CASE WHEN regexp_matches(url_decode(regexp_extract(qq, '(?:^|&)url=([^&]*)', 1)), '^https?://') THEN url_decode(regexp_extract(qq, '(?:^|&)url=([^&]*)', 1)) END, orig)
  WHEN h = 'r.jina.ai' AND regexp_extract(orig, '^\\s*[A-Za-z]+://r\\.jina\\.ai/+(https?://.*)$', 1) <> '' THEN regexp_extract(orig, '^\\s*[A-Za-z]+://r\\.jina\\.ai/+(https?://.*)$', 1)
  ELSE orig END) AS url FROM pre),"""


def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("id", U.canonical(F.col("url")).alias("canonical"), U.unwrap(F.col("url")).alias("unwrapped"))


_ENC = "replace(url_encode({0}), '%20', '+')"
CANONICAL_SELECT = f"""CASE WHEN sch IN ('http', 'https') AND host <> '' THEN concat('https://', CASE WHEN port IN ('', '80', '443') THEN dom ELSE concat(dom, ':', port) END,
  CASE WHEN pth = '' OR pth = '/' THEN '/' ELSE regexp_replace(pth, '/+$', '') END,
  CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(list_transform(list_sort(kept), lambda p: {_ENC.format("p.k")} || '=' || {_ENC.format("p.v")}), '&') END) END"""
KEPT = f"""list_filter(list_transform(list_filter(string_split(q, '&'), lambda p: p <> ''),
  lambda p: {{'k': url_decode(replace(regexp_extract(p, '^([^=]*)', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(p, '^[^=]*=?(.*)$', 1), '+', ' '))}}),
  lambda p: NOT (starts_with(lower(p.k), 'utm_') OR lower(p.k) IN ({_TRACK}))) AS kept"""
CANONICAL_SQL = f"""WITH {_UNWRAP} {MACROS.replace("SELECT id, url, lower", "SELECT id, orig, url, lower")},
k AS (SELECT *, {KEPT} FROM split)
SELECT id, {CANONICAL_SELECT} AS canonical, (SELECT s.url FROM src s WHERE s.id = k.id AND s.orig IS NOT NULL) AS unwrapped FROM k"""


def url_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return _urls(spark, sf_dir).where(u.isNotNull()).select(
        "id", U.domain(u).alias("domain"), U.registrable(u).alias("registrable"), U.is_test_host(u).alias("test_host"),
        F.array_join(U.version_segments(u), "|").alias("versions"), U.slug_words(u).alias("words"), U.slug_title(u).alias("title"),
        U.source_id(u).alias("source_id"), U.normalize_domain(u).alias("normalized"), U.scope_matches(u, "example.com/en").alias("in_scope"),
        U.domain_matches(U.domain(u), "example.org").alias("in_domain"),
    )


_VERSION = U.VERSION_SEGMENT
_IPV4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
URL_FEATURES_SQL = f"""WITH src AS (SELECT * FROM {_URLS} WHERE url IS NOT NULL), {MACROS},
s2 AS (SELECT *, list_filter(string_split(pth, '/'), lambda s: s <> '') AS segs, CASE WHEN pth = '' THEN '/' ELSE lower(pth) END AS lp FROM split),
s3 AS (SELECT *, trim(regexp_replace(regexp_replace(segs[-1], '(?i)\\.(html?|php|aspx?)$', ''), '[-_]+', ' ', 'g'))[1:240] AS slug FROM s2)
SELECT id, dom AS domain, regexp_extract(dom, '([^.]*\\.)?[^.]*$', 0) AS registrable,
  host = 'localhost' OR ends_with(host, '.local') OR regexp_extract(host, '^[^.]*', 0) IN ({", ".join(f"'{x}'" for x in U.TEST_LABELS)}) OR regexp_matches(host, '{_IPV4}') AS test_host,
  array_to_string(list_transform(list_filter(segs, lambda s: regexp_matches(s, '{_VERSION}')), lambda s: lower(s)), '|') AS versions,
  lower(regexp_replace(regexp_replace(pth, '(?i)\\.(html?|php|aspx?|cms)$', ' '), '[/\\-_.]+', ' ', 'g')) AS words,
  CASE WHEN slug <> '' THEN slug ELSE url END AS title,
  concat('s', sha256(url)[1:10]) AS source_id,
  regexp_replace(regexp_extract(regexp_replace(lower(trim(url)), '^[a-z]+://', ''), '^[^/?#]*', 0), '^www\\.', '') AS normalized,
  dom <> '' AND (dom = 'example.com' OR ends_with(dom, '.example.com')) AND (lp = '/en' OR starts_with(lp, '/en/')) AS in_scope,
  dom = 'example.org' OR ends_with(dom, '.example.org') AS in_domain
FROM s3"""


def public_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public URLs kept, others counted."""
    return _urls(spark, sf_dir).agg(F.count_if(U.is_public(F.col("url"))).alias("kept"), F.count_if(~U.is_public(F.col("url"))).alias("rejected"), F.sum(F.when(U.is_public(F.col("url")), F.col("id"))).alias("kept_ids"))


def _ranges(number: str) -> str:
    return " OR ".join(f"{number} BETWEEN {a} AND {b}" for a, b in map(U.network_range, U.NOT_PUBLIC))


_NUMBER = "CASE WHEN regexp_matches({0}, '" + _IPV4 + "') THEN list_reduce(list_transform(string_split({0}, '.'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 256 + b) END"
PUBLIC_SQL = f"""WITH raw AS (SELECT * FROM {_URLS}),
src AS (SELECT id, CASE WHEN contains(trim(url), '://') THEN trim(url) ELSE 'https://' || trim(url) END AS url, trim(url) AS t FROM raw),
{MACROS.replace("SELECT id, url, lower", "SELECT id, t, url, lower")},
ok AS (SELECT id, coalesce(t <> '' AND NOT regexp_matches(t, '[\\s\\x00-\\x1f\\x7f\\\\]') AND sch IN ('http', 'https') AND h <> '' AND NOT contains(auth, '@') AND NOT contains(h, '%')
  AND NOT (h IN ({", ".join(f"'{x}'" for x in U.PRIVATE_HOSTS)}) OR NOT (contains(h, '.') OR starts_with(h, '[')) OR starts_with(h, '[')
    OR {" OR ".join(f"ends_with(h, '{x}')" for x in U.PRIVATE_SUFFIXES)} OR coalesce({_ranges("num")}, FALSE)), FALSE) AS good
  FROM (SELECT *, {_NUMBER.replace("{0}", "h")} AS num FROM (SELECT *, regexp_replace(host, '\\.+$', '') AS h FROM split)))
SELECT count(*) FILTER (good) AS kept, count(*) FILTER (NOT good) AS rejected, CAST(sum(id) FILTER (good) AS BIGINT) AS kept_ids FROM ok"""


def authority_longest_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return _urls(spark, sf_dir).where(u.isNotNull()).select("id", micro(U.authority(u)).alias("authority"), micro(U.source_quality(u)).alias("quality"))


AUTHORITY_SQL = f"""WITH src AS (SELECT * FROM {_URLS} WHERE url IS NOT NULL), {MACROS},
w AS (SELECT ltrim(s, '.') AS s, v FROM {sql_literal("s, v", [(s, v) for s, v in U.AUTHORITY.items()])}),
e AS (SELECT unnest([{", ".join(f"'{x}'" for x in U.ESTABLISHED)}]) AS d),
p AS (SELECT unnest([{", ".join(f"'{x}'" for x in U.PRIMARY_DOMAINS)}]) AS d), ps AS (SELECT unnest([{", ".join(f"'{x.lstrip('.')}'" for x in U.PRIMARY_SUFFIXES)}]) AS d)
SELECT id, {sql_micro("coalesce((SELECT arg_max(v, length(s)) FROM w WHERE dom = s OR ends_with(dom, '.' || s)), 0.5)")} AS authority,
 {sql_micro("CASE WHEN dom = '' THEN 0.5 WHEN EXISTS (SELECT 1 FROM p WHERE dom = p.d) OR EXISTS (SELECT 1 FROM ps WHERE dom = ps.d OR ends_with(dom, '.' || ps.d)) THEN 0.95 WHEN EXISTS (SELECT 1 FROM e WHERE dom = e.d OR ends_with(dom, '.' || e.d)) THEN 0.85 ELSE 0.5 END")} AS quality FROM split"""

FILTERS = [
    (0, ["example.com"], [], None, None),
    (1, [], ["example.net", "ththnd.example.org"], None, None),
    (2, ["example.org", "example.com"], ["m.example.org"], "html", None),
    (3, [], [], "html", "example.com/en"),
]


def domain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of four questions after include and exclude domains, file type and site scope: semi and anti joins on domain tails."""
    u = F.col("url")
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 4).alias("question"), "page_id", "url")
    labels = F.split(U.domain(u), r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rules = literal(spark, "question long, include array<string>, exclude array<string>, file_type string, scope string", FILTERS)
    kept = pages.join(F.broadcast(rules), "question").where(
        ((F.size("include") == 0) | F.arrays_overlap(tails, F.col("include")))
        & ~F.arrays_overlap(tails, F.col("exclude"))
        & (F.col("file_type").isNull() | F.regexp_extract(F.lower(u), r"^[^?]*", 0).endswith(F.concat(F.lit("."), F.col("file_type"))))
        & (F.col("scope").isNull() | U.scope_matches(u, F.col("scope")))
    )
    return kept.select("question", "page_id")


DOMAIN_FILTER_SQL = f"""WITH src AS (SELECT page_id AS id, url FROM pages), {MACROS},
r AS (SELECT * FROM {sql_literal("question, inc, exc, ft, scope", FILTERS)})
SELECT r.question, id AS page_id FROM split JOIN r ON id % 4 = r.question
WHERE (len(inc) = 0 OR len(list_filter(inc, lambda d: dom = d OR ends_with(dom, '.' || d))) > 0)
 AND len(list_filter(exc, lambda d: dom = d OR ends_with(dom, '.' || d))) = 0
 AND (ft IS NULL OR ends_with(string_split(lower(url), '?')[1], '.' || ft))
 AND (scope IS NULL OR ((dom = 'example.com' OR ends_with(dom, '.example.com')) AND (lower(pth) = '/en' OR starts_with(lower(pth), '/en/'))))"""


def sweep_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each canonical page the first of several queries that found it; later finds are dropped."""
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 3).alias("query_seq"), "page_id", U.canonical(F.col("url")).alias("canonical"))
    first = pages.groupBy("canonical").agg(F.min(F.struct("query_seq", "page_id")).alias("f"), F.count("*").alias("found"))
    return first.select("canonical", "f.query_seq", "f.page_id", "found")


_PAGES_CANONICAL = f"""src AS (SELECT page_id AS id, url FROM pages), {MACROS}, k AS (SELECT *, {KEPT} FROM split), canon AS (SELECT id, url, dom, pth, {CANONICAL_SELECT} AS canonical FROM k)"""
SWEEP_SQL = f"""WITH {_PAGES_CANONICAL}
SELECT canonical, arg_min(id % 3, (id % 3, id)) AS query_seq, arg_min(id, (id % 3, id)) AS page_id, count(*) AS found FROM canon GROUP BY canonical"""

LINKS = [
    (1, "//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2Fx%3Fy%3D1&rut=z"),
    (2, "https://plain.example/x"),
    (3, "https://www.bing.com/ck/a?!&&p=1&u=a1aHR0cHM6Ly9iLmV4YW1wbGUvcA&ntb=1"),
    (4, "https://www.bing.com/news/apiclick.aspx?ref=FexRss&url=https%3a%2f%2fc.example%2fn&c=1"),
    (5, "https://www.bing.com/ck/a?u=a1%%%"),
    (6, "https://other.example/ck/a?u=a1aHR0cHM6Ly9iLmV4YW1wbGUvcA"),
]


def redirect_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("href")
    return literal(spark, "id int, href string", LINKS).select("id", U.search_redirect(h).alias("search"), U.coded_redirect(h).alias("coded"), U.click_redirect(h).alias("click"))


REDIRECT_SQL = f"""WITH l AS (SELECT *, CASE WHEN starts_with(href, '//') THEN 'https:' || href ELSE href END AS full_href FROM {sql_literal("id, href", LINKS)}),
m AS (SELECT *, url_decode(regexp_extract(full_href, '[?&]uddg=([^&#]*)', 1)) AS ud, regexp_extract(href, '[?&]u=a1([^&#]*)', 1) AS tok, url_decode(regexp_extract(href, '[?&]url=([^&#]*)', 1)) AS cu FROM l)
SELECT id, CASE WHEN ud <> '' THEN ud ELSE full_href END AS search,
 CASE WHEN contains(href, 'bing.com/ck/') AND regexp_matches(tok, '^[A-Za-z0-9_-]+$') THEN CAST(decode(from_base64(rpad(translate(tok, '-_', '+/'), CAST(length(tok) + (4 - length(tok) % 4) % 4 AS INTEGER), '='))) AS VARCHAR) ELSE href END AS coded,
 CASE WHEN contains(href, 'bing.com') AND starts_with(cu, 'http') THEN cu ELSE href END AS click FROM m"""

COOKIES = [(1, "example.com", False, "/", False, 1), (2, "a.example.com", True, "/docs", False, 2), (3, "example.com", False, "/docs/api", True, 3), (4, "other.org", False, "/", False, 4), (5, "example.com", True, "/", False, 5)]
REQUESTS = [(1, "http", "a.example.com", "/docs/api/x"), (2, "https", "example.com", "/docs"), (3, "https", "a.example.com", "/docsy")]


def cookie_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cookies of each request: domain, path and secure rules as a theta join; longer paths first, then older cookies."""
    cookies = literal(spark, "cookie int, domain string, host_only boolean, path string, secure boolean, created int", COOKIES)
    asked = literal(spark, "request int, scheme string, host string, target string", REQUESTS)
    hit = U.cookie_domain_matches(F.col("host"), F.col("domain"), F.col("host_only")) & U.cookie_path_matches(F.col("target"), F.col("path")) & (~F.col("secure") | (F.col("scheme") == "https"))
    place = F.row_number().over(Window.partitionBy("request").orderBy(F.length("path").desc(), "created"))
    return asked.join(F.broadcast(cookies), hit).select("request", "cookie", place.alias("place"))


COOKIE_SQL = f"""SELECT request, cookie, row_number() OVER (PARTITION BY request ORDER BY length(path) DESC, created) AS place
FROM (SELECT * FROM {sql_literal("request, scheme, host, target", REQUESTS)}) r JOIN (SELECT * FROM {sql_literal("cookie, domain, host_only, path, secure, created", COOKIES)}) c
ON (host = domain OR (NOT host_only AND ends_with(host, '.' || domain))) AND (target = path OR (starts_with(target, path) AND (ends_with(path, '/') OR substr(target, length(path) + 1, 1) = '/'))) AND (NOT secure OR scheme = 'https')"""

ADDRESSES = [(1, "127.0.0.1"), (2, "10.1.2.3"), (3, "172.32.0.1"), (4, "172.16.9.9"), (5, "169.254.169.254"), (6, "1.1.1.1"), (7, "100.64.1.1"), (8, "224.0.0.5"), (9, "255.255.255.255"), (10, "example.com"), (11, "198.19.0.1"), (12, "192.0.0.8")]


def blocked_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal(spark, "id int, host string", ADDRESSES).select("id", U.is_blocked_ipv4(F.col("host")).alias("blocked"))


BLOCKED_SQL = f"""SELECT id, coalesce({_ranges("num")}, FALSE) AS blocked FROM (SELECT id, {_NUMBER.replace("{0}", "host")} AS num FROM {sql_literal("id, host", ADDRESSES)})"""

QUERIES = {
    "canonical_urls": canonical_urls,
    "url_features": url_features,
    "public_url_filter": public_url_filter,
    "authority_longest_suffix": authority_longest_suffix,
    "domain_filter": domain_filter,
    "sweep_first_seen": sweep_first_seen,
    "redirect_targets": redirect_targets,
    "cookie_matches": cookie_matches,
    "blocked_addresses": blocked_addresses,
}
SQL = {
    "canonical_urls": CANONICAL_SQL,
    "url_features": URL_FEATURES_SQL,
    "public_url_filter": PUBLIC_SQL,
    "authority_longest_suffix": AUTHORITY_SQL,
    "domain_filter": DOMAIN_FILTER_SQL,
    "sweep_first_seen": SWEEP_SQL,
    "redirect_targets": REDIRECT_SQL,
    "cookie_matches": COOKIE_SQL,
    "blocked_addresses": BLOCKED_SQL,
}
