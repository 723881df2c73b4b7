"""Queries on research reports, circuits that last, rotation, addresses, and places of phrases in pages."""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import intent as I
from ..functions import text as T
from ..functions import url as U
from ..operators import research as R
from ..operators import state as A
from . import ranking as K
from . import requests as Q
from . import sqltext as S
from . import state as L
from .inputs import literal, micro, sql_literal, sql_micro, table

_KIND = "CASE user_id % 11 WHEN 0 THEN 'captcha' WHEN 1 THEN 'rate_limited' WHEN 2 THEN NULL ELSE 'timeout' END"


def persistent_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = L.log(spark, sf_dir).withColumn("kind", F.expr(_KIND))
    found = A.persistent_breaker(log, threshold=2)
    last = log.groupBy("key").agg(F.max("at").alias("end"))
    return found.join(last, "key").select("key", "failures", "kind", micro((F.col("open_until") - F.col("end")) / 1000).alias("open_ks"))


BREAKER_SQL = f"""WITH RECURSIVE {L._LOG}, e AS (SELECT *, {_KIND} AS kind, row_number() OVER (PARTITION BY key ORDER BY at_s, seq) AS n FROM log),
w AS (SELECT key, n, at_s, CAST(CASE WHEN ok THEN 0 ELSE 1 END AS BIGINT) AS streak, kind, NOT ok AND kind IN ('captcha', 'rate_limited') AS opened, ok FROM e WHERE n = 1 UNION ALL
  SELECT e.key, e.n, e.at_s, CASE WHEN e.ok THEN 0 ELSE streak + 1 END, e.kind, NOT e.ok AND (coalesce(opened, FALSE) OR coalesce(e.kind IN ('captcha', 'rate_limited'), FALSE) OR streak + 1 >= 2), e.ok FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1),
l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1)
SELECT key, CAST(streak AS INTEGER) AS failures, CASE WHEN NOT ok THEN coalesce(kind, 'unavailable') END AS kind,
  {sql_micro("CASE WHEN opened THEN least(21600.0, CASE WHEN coalesce(kind IN ('captcha', 'rate_limited'), FALSE) THEN 900.0 * pow(2, least(streak - 1, 10)) ELSE 300.0 * pow(2, least(greatest(streak - 2, 0), 10)) END) / 1000 END")} AS open_ks FROM l"""

INSTANCES = [(0, "a.example"), (1, "b.example"), (2, "c.example"), (3, "d.example"), (4, "e.example")]
COOLING = [("b.example", 1e18), ("d.example", 0.0)]


def rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests in their order; one of five instances cools all the time."""
    asked = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("request"), F.lit(5.0).alias("at"))
    return A.rotated(asked, literal(spark, "place int, instance string", INSTANCES), literal(spark, "instance string, until double", COOLING))


ROTATED_SQL = f"""WITH i AS (SELECT place, instance FROM {sql_literal('place, instance', INSTANCES)} WHERE instance <> 'b.example')
SELECT event_id AS request, CAST(row_number() OVER (PARTITION BY event_id ORDER BY (place - event_id % 5 + 5) % 5) AS INTEGER) AS nth, instance FROM events, i"""

HOSTS = ["::1", "[::1]", "fe80::1%eth0", "2001:4860:4860::8888", "::ffff:10.0.0.1", "fd12:3456::1", "2001:db8::5", "64:ff9b::1.2.3.4", "ff02::1", "1:2:3:4:5:6:7:8", "1:2:3", "::", "example.org", "2606:4700::1111", "1::2::3", "12345::", "2001:0:1::", "2002:c000:204::1", "100::7", "fec0::1", None]


def blocked_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given addresses, and one for each document that its id makes."""
    made = table(spark, sf_dir, "documents").select((F.col("doc_id") + 100).cast("long").alias("id"), F.concat_ws(":", F.lower(F.hex(F.col("doc_id") * 7919 % 65536)), F.lit("db8"), F.lit("0"), F.lit(""), F.lower(F.hex(F.col("doc_id")))).alias("h"))
    given = literal(spark, "id long, h string", [(i, h) for i, h in enumerate(HOSTS)])
    return given.unionByName(made).select("id", U.ipv6_hex(F.col("h")).alias("digits"), U.is_blocked_ipv6(F.col("h")).alias("blocked"))


def _v6(h: str | None) -> tuple[str | None, bool]:
    """The same by the standard library, for the addresses given above."""
    try:
        a = ipaddress.IPv6Address((h or "").strip("[]").split("%")[0])
    except ValueError:
        return None, False
    return a.packed.hex(), any(a in ipaddress.IPv6Network(n) for n in U.NOT_PUBLIC_V6)


V6_SQL = f"""WITH m AS (SELECT doc_id + 100 AS id, lpad(format('{{:x}}', doc_id * 7919 % 65536), 4, '0') || '0db80000' || repeat('0', 16) || lpad(format('{{:x}}', doc_id), 4, '0') AS digits FROM documents)
SELECT CAST(id AS BIGINT) AS id, digits, blocked FROM {sql_literal('id, digits, blocked', [(i, *_v6(h)) for i, h in enumerate(HOSTS)])}
UNION ALL SELECT CAST(id AS BIGINT), digits, starts_with(digits, '20010db8') OR starts_with(digits, '2002') OR regexp_matches(digits, '^(f[cd]|fe[89abcdef]|ff)') OR regexp_matches(digits, '^200100|^200101') OR starts_with(digits, '0100000000000000') OR starts_with(digits, '0064ff9b00000000') OR starts_with(digits, '0064ff9b0001') FROM m"""


def found_in_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of two phrases in every page and document: how many of the first fifty, and what stands around them."""
    texts = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("id"), F.col("html").alias("t")).unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id") + 1_000_000).cast("long").alias("id"), F.col("text").alias("t")))
    rows = texts.select("id", "t", F.explode(F.array(F.lit("The"), F.lit("a."))).alias("phrase"))
    found = rows.select("id", "phrase", T.found_in_page(F.coalesce("t", F.lit("")), F.col("phrase")).alias("found")).where(F.size("found") > 0)
    return found.select("id", "phrase", F.size("found").alias("n"), F.array_join(F.transform("found.at", lambda x: x.cast("string")), ",").alias("places"), F.md5(F.array_join("found.context", "|")).alias("contexts"))


FOUND_SQL = """WITH t AS (SELECT page_id AS id, coalesce(html, '') AS t FROM pages UNION ALL SELECT doc_id + 1000000, coalesce(text, '') FROM documents), p AS (SELECT id, t, phrase, string_split(lower(t), lower(phrase)) AS parts FROM t, (VALUES ('The'), ('a.')) v(phrase)),
l AS (SELECT id, t, phrase, list_transform(range(1, least(50, len(parts) - 1) + 1), lambda i: CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(phrase) + 1 AS BIGINT)) AS ats FROM p WHERE len(parts) > 1)
SELECT CAST(id AS BIGINT) AS id, phrase, CAST(len(ats) AS INTEGER) AS n, array_to_string(ats, ',') AS places, md5(array_to_string(list_transform(ats, lambda a: substr(t, greatest(1, a - 100), length(phrase) + 100 + least(100, a - 1))), '|')) AS contexts FROM l"""

EPOCHS = [(1, 0.0), (2, -1.0), (3, 1792372800.5), (4, 1e15), (5, -1e15), (6, None), (7, 86399.999)]


def epoch_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("double")
    rows = literal(spark, "id long, s double", EPOCHS).unionByName(table(spark, sf_dir, "events").select((F.col("event_id") + 100).cast("long").alias("id"), at.alias("s")))
    return rows.select("id", D.epoch_date(F.col("s")).cast("string").alias("day"))


EPOCH_SQL = f"SELECT CAST(id AS BIGINT) AS id, CASE WHEN abs(s) < 1e12 THEN CAST(DATE '1970-01-01' + CAST(floor(s / 86400) AS INTEGER) AS VARCHAR) END AS day FROM (SELECT id, CAST(s AS DOUBLE) AS s FROM {sql_literal('id, s', EPOCHS)} UNION ALL SELECT event_id + 100, epoch_us(ts) / 1000000.0 FROM events)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of pages as results of three rounds of search for five questions."""
    seq = F.col("arrival_seq")
    hits = K.hits(spark, sf_dir).withColumn("canonical", U.canonical(F.col("url"))).where("canonical IS NOT NULL")
    return hits.select(
        "question_id", seq.alias("seq"), F.substring(F.sha1("canonical"), 1, 12).alias("source_id"), "canonical", "url", "title", "snippet", (seq % 3 + 1).cast("int").alias("round"), F.concat(F.lit("q"), (seq % 7).cast("string")).alias("query"),
        F.array("engine").alias("engines"), F.when(seq % 5 == 0, F.array(F.lit("flag"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        F.when(seq % 4 == 0, "snippet_only").when(seq % 4 == 1, "read_failed").otherwise("read").alias("read_status"), (seq * 7919 % 1000 / 1000).alias("score"), F.when(seq % 6 == 0, 0.0).otherwise(0.5).alias("relevance"), U.domain(F.col("url")).alias("domain"),
    )


_RESULTS = f"""{K._HITS}, rs AS (SELECT question_id, arrival_seq AS seq, substr(sha1(canonical), 1, 12) AS source_id, url, title, snippet, arrival_seq % 3 + 1 AS round, 'q' || (arrival_seq % 7) AS query, engine, arrival_seq % 5 = 0 AS flagged,
  CASE arrival_seq % 4 WHEN 0 THEN 'snippet_only' WHEN 1 THEN 'read_failed' ELSE 'read' END AS read_status, arrival_seq * 7919 % 1000 / 1000 AS score, CASE WHEN arrival_seq % 6 = 0 THEN 0.0 ELSE 0.5 END AS relevance, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS domain FROM hits WHERE canonical IS NOT NULL)"""


def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = R.merge_sources(_results(spark, sf_dir))
    return merged.select("question_id", "source_id", "url", "title", F.array_join("engines", ",").alias("engines"), F.array_join("flags", ",").alias("flags"), F.array_join(F.transform("rounds", lambda r: r.cast("string")), ",").alias("rounds"), F.array_join("queries", ",").alias("queries"), "snippet")


MERGED_SQL = f"""WITH {_RESULTS} SELECT question_id, source_id, arg_min(url, seq) AS url, arg_min(title, seq) AS title, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines, CASE WHEN bool_or(flagged) THEN 'flag' ELSE '' END AS flags,
  string_agg(DISTINCT CAST(round AS VARCHAR), ',' ORDER BY CAST(round AS VARCHAR)) AS rounds, string_agg(DISTINCT query, ',' ORDER BY query) AS queries, arg_max(snippet, (length(snippet), -seq)) AS snippet FROM rs GROUP BY question_id, source_id"""


def next_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.next_reads(_results(spark, sf_dir), 4).select("question_id", "place", "url", micro(F.col("score")).alias("score"))


READS_SQL = f"WITH {_RESULTS} SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, url) AS INTEGER) AS place, url, {sql_micro('score')} AS score FROM rs WHERE read_status = 'snippet_only' QUALIFY place <= 4"


def research_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = literal(spark, "question_id long, question string", [*K.QUESTIONS, (9, "nobody asked")])
    return R.research_coverage(_results(spark, sf_dir), asked, 40).withColumn("coverage", micro(F.col("coverage")))


COVERAGE_SQL = f"""WITH {_RESULTS}, q AS (SELECT question_id, list_filter({S.terms(S.without_sites('question'))}, lambda t: t NOT IN ({S.words(T.STOPWORDS)})) AS terms FROM {sql_literal('question_id, question', [*K.QUESTIONS, (9, "nobody asked")])}),
d AS (SELECT q.question_id, count(DISTINCT domain) AS every, count(DISTINCT CASE WHEN len(list_filter(terms, lambda t: contains(lower(concat_ws(' ', title, snippet)), t))) > 0 THEN domain END) AS naming FROM q LEFT JOIN rs ON rs.question_id = q.question_id AND relevance > 0 GROUP BY q.question_id)
SELECT CAST(question_id AS BIGINT) AS question_id, {sql_micro('least(1.0, CASE WHEN naming > 0 THEN naming ELSE every END / 40)')} AS coverage FROM d"""


def limitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir)
    calls = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("question_id"), F.when(F.col("event_type") == "error", "failed").otherwise("results").alias("status"))
    return R.limitations(calls, rows, rows.where("question_id = 2").select("question_id"))


LIMITS_SQL = f"""WITH {_RESULTS}, c AS (SELECT user_id % 7 AS question_id, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1), s AS (SELECT question_id, count(*) AS n, count(*) FILTER (read_status = 'snippet_only') AS so, count(*) FILTER (read_status = 'read_failed') AS un FROM rs GROUP BY 1)
SELECT question_id, coalesce(failed, 0) AS failed, coalesce(so, 0) AS snippet_only, coalesce(un, 0) AS unread, coalesce(question_id = 2 AND n > 0, FALSE) AS contested, n IS NULL AS no_sources FROM c FULL JOIN s USING (question_id)"""


def provenance_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of one report on all results: pages as sources, conversations' turns as claims of them."""
    rows = _results(spark, sf_dir)
    queries = rows.select(F.substring("query", 2, 9).alias("query_no")).distinct()
    returned = rows.select(F.substring("query", 2, 9).alias("query_no"), (F.col("seq") % 50).alias("source_id"))
    claims = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id"), (F.col("conv_id") % 60).alias("source_id"))
    statements = claims.groupBy((F.col("claim_id") % 40).alias("statement_id")).agg(F.collect_set("claim_id").alias("claim_ids"))
    conflicts = statements.where("statement_id % 9 = 0").select(F.col("statement_id").alias("conflict_id"), "claim_ids")
    nodes, edges = R.provenance_graph(queries, returned, claims, statements, conflicts)
    return edges.unionByName(nodes.select(F.col("node").alias("src"), F.lit("").alias("dst"), F.concat(F.lit("is:"), F.col("kind")).alias("relation")))


GRAPH_SQL = f"""WITH {_RESULTS}, r AS (SELECT substr(query, 2) AS qn, seq % 50 AS sid FROM rs), c AS (SELECT conv_id * 1000 + turn AS cid, conv_id % 60 AS sid FROM conversations),
e AS (SELECT 'question' AS src, 'q:' || qn AS dst, 'issued' AS relation FROM r UNION SELECT 'q:' || qn, 'src:' || sid, 'returned' FROM r WHERE sid IN (SELECT sid FROM c) UNION SELECT 'src:' || sid, 'claim:' || cid, 'states' FROM c
  UNION SELECT 'claim:' || cid, 'stmt:' || (cid % 40), 'supports' FROM c UNION SELECT 'claim:' || cid, 'x:' || (cid % 40), 'conflicts_with' FROM c WHERE cid % 40 % 9 = 0),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT src, dst, relation FROM e UNION ALL SELECT node, '', 'is:' || CASE split_part(node, ':', 1) WHEN 'q' THEN 'query' WHEN 'src' THEN 'source' WHEN 'stmt' THEN 'statement' WHEN 'x' THEN 'contradiction' ELSE split_part(node, ':', 1) END FROM n"""


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as recorded calls by their text; other turns ask again, some with what was never recorded."""
    turns = table(spark, sf_dir, "conversations").select(F.md5("text").alias("key"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    recorded = turns.where("seq % 3 <> 0").select("key", "seq", F.concat(F.lit("answer "), F.col("seq").cast("string")).alias("answer"))
    return R.replayed(turns.where("seq % 2 = 0").select("key", F.col("seq").alias("asked")), recorded, "key")


REPLAY_SQL = """WITH t AS (SELECT md5(text) AS key, conv_id * 1000 + turn AS seq FROM conversations), r AS (SELECT key, 'answer ' || min(seq) AS answer FROM t WHERE seq % 3 <> 0 GROUP BY key)
SELECT t.key, seq AS asked, answer, answer IS NOT NULL AS recorded FROM t LEFT JOIN r ON r.key IS NOT DISTINCT FROM t.key AND t.key IS NOT NULL WHERE seq % 2 = 0"""


def valid_syntheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as reports, their turns as statements that cite turns; some cite what isn't there, some are empty."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when((F.col("conv_id") % 11 == 0) & (F.col("turn") == 1), " ").otherwise(F.col("text")).alias("text"))
    cited = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0), F.array(F.col("turn"), F.lit(9999))).otherwise(F.array("turn"))
    statements = turns.select(F.col("conv_id").alias("report"), F.col("turn").alias("statement_id"), "text", cited.alias("claim_ids"))
    found = R.valid_syntheses(statements, turns.select(F.col("conv_id").alias("report"), F.col("turn").alias("claim_id")))
    return found.select("report", "statement_id", F.size("claim_ids").alias("cited"))


SYNTHESES_SQL = """WITH bad AS (SELECT conv_id FROM conversations WHERE (conv_id % 5 = 0 AND turn = 0) OR (conv_id % 11 = 0 AND turn = 1) OR coalesce(trim(text), '') = '')
SELECT conv_id AS report, turn AS statement_id, 1 AS cited FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM bad)"""

SCOPES = [(0, "example.org"), (1, "example.net/en"), (1, "blog.example.com"), (3, "www.example.com")]


def scope_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scope_misses(_results(spark, sf_dir).select("question_id", "seq", "url"), literal(spark, "question_id long, scope string", SCOPES))


MISSES_SQL = f"""WITH {_RESULTS}, x AS (SELECT question_id, seq, url, domain, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) AS pth FROM rs), s AS (SELECT question_id, regexp_replace(scope, '^www\\.', '') AS scope FROM {sql_literal('question_id, scope', SCOPES)}),
p AS (SELECT question_id, regexp_extract(scope, '^[^/]*') AS h, regexp_extract(scope, '^[^/]*/(.*)$', 1) AS q FROM s)
SELECT question_id, seq, url FROM x WHERE question_id IN (SELECT question_id FROM p) AND NOT EXISTS (SELECT 1 FROM p WHERE p.question_id = x.question_id AND (x.domain = h OR ends_with(x.domain, '.' || h)) AND (q = '' OR pth = '/' || q OR starts_with(pth, '/' || q || '/')))"""

EXPECTED = [(0, ["example.org"], [], 300), (1, ["nowhere.test"], ["zzz"], None), (2, [], ["der"], 30), (3, ["example.net"], [], None), (4, ["a.org"], [], 5)]


def scored_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 25 pages as the results of one query, in their order; what is expected of it, its number decides. One query has no results."""
    results = K.hits(spark, sf_dir).select(F.floor(F.col("arrival_seq") / 25).alias("question_id"), (F.col("arrival_seq") % 25 + 1).alias("place"), "url", "title", "snippet", "published_at")
    kinds = literal(spark, "kind long, domains array<string>, phrases array<string>, recency_days int", EXPECTED)
    asked = results.select("question_id").unionByName(literal(spark, "question_id long", [(-1,)])).distinct().withColumn("kind", F.pmod("question_id", F.lit(5)))
    return R.scored_queries(results, asked.join(F.broadcast(kinds), "kind").drop("kind"), K.today())


_EXPECTED = ", ".join(f"({i}, CAST([{S.words(d)}] AS VARCHAR[]), CAST([{S.words(p)}] AS VARCHAR[]), {r if r else 'NULL'})" for i, d, p, r in EXPECTED)
SCORED_SQL = f"""WITH {K._HITS}, wanted AS (SELECT * FROM (VALUES {_EXPECTED}) t(kind, domains, phrases, recency)), e AS (SELECT question_id, wanted.* FROM (SELECT DISTINCT arrival_seq // 25 AS question_id FROM hits UNION SELECT -1) q JOIN wanted ON (question_id % 5 + 5) % 5 = kind),
r AS (SELECT arrival_seq // 25 AS question_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS dom, lower(concat_ws(' ', title, snippet)) AS hay, published_at FROM hits WHERE arrival_seq % 25 < 5)
SELECT CAST(e.question_id AS BIGINT) AS question_id, count(dom) > 0 AS available, coalesce(bool_or(len(list_filter(domains, lambda d: dom = d OR ends_with(dom, '.' || d))) > 0 OR len(list_filter(phrases, lambda p: contains(hay, p))) > 0), FALSE) AS quality_hit,
  CASE WHEN any_value(recency) IS NOT NULL THEN coalesce(bool_or(DATE '{K.TODAY}' - published_at <= recency), FALSE) END AS fresh FROM e LEFT JOIN r ON r.question_id = e.question_id GROUP BY e.question_id"""


def repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import request

    asked = Q.questions(spark, sf_dir).unionByName(literal(spark, "id long, q string", [(-100 - i, f"{w} official documentation") for i, w in enumerate(("tea", "rice", "salt"))]))
    return R.repeated_phrases(asked.select(request.split_subject(F.col("q"))["request"].alias("request")))


_PHRASES = Q._SPLIT.replace(Q._QS, f"qs AS (SELECT * FROM ({Q._QS[7:-1]}) UNION ALL SELECT * FROM (VALUES (-100, 'tea official documentation'), (-101, 'rice official documentation'), (-102, 'salt official documentation')) t(id, q))")
PHRASES_SQL = f"WITH {_PHRASES}, pp AS (SELECT array_to_string(list_transform({S.every('request', T.RUN)}, lambda x: lower(x)), ' ') AS phrase FROM split) SELECT phrase, count(*) AS n FROM pp WHERE phrase <> '' GROUP BY phrase HAVING count(*) >= 2"


def archive_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each region the first three tier-one publishers, by their place in the list; all regions' where a region has none."""
    feeds = literal(spark, "seq int, domain string, region string, tier int", [(i, d, r, t) for i, (_, d, r, _, t) in enumerate(I.FEEDS)]).where("tier = 1")
    regions = literal(spark, "asked string", [("IN",), ("GB",), ("US",), ("QA",), ("ZZ",), ("",)])
    return R.archive_domains(feeds, regions, 3)


_FEEDS = sql_literal("seq, domain, region, tier", [(i, d, r, t) for i, (_, d, r, _, t) in enumerate(I.FEEDS)])
DOMAINS_SQL = f"""WITH f AS (SELECT * FROM {_FEEDS} WHERE tier = 1), a AS (SELECT * FROM (VALUES ('IN'), ('GB'), ('US'), ('QA'), ('ZZ'), ('')) t(asked)),
m AS (SELECT asked, domain, min(seq) AS seq FROM a JOIN f ON asked = '' OR region = asked OR starts_with(region, asked || '-') OR NOT EXISTS (SELECT 1 FROM f g WHERE g.region = asked OR starts_with(g.region, asked || '-')) GROUP BY ALL)
SELECT asked, CAST(row_number() OVER (PARTITION BY asked ORDER BY seq) AS INTEGER) AS place, domain FROM m QUALIFY place <= 3"""

QUERIES = {
    "persistent_breaker": persistent_breaker, "rotated": rotated, "blocked_v6": blocked_v6, "page_phrases": found_in_page, "epoch_dates": epoch_dates, "merged_sources": merged_sources, "next_reads": next_reads, "research_coverage": research_coverage, "limitations": limitations,
    "provenance_graph": provenance_graph, "replayed": replayed, "valid_syntheses": valid_syntheses, "scope_misses": scope_misses, "scored_queries": scored_queries, "repeated_phrases": repeated_phrases, "archive_domains": archive_domains,
}
SQL = {
    "persistent_breaker": BREAKER_SQL, "rotated": ROTATED_SQL, "blocked_v6": V6_SQL, "page_phrases": FOUND_SQL, "epoch_dates": EPOCH_SQL, "merged_sources": MERGED_SQL, "next_reads": READS_SQL, "research_coverage": COVERAGE_SQL, "limitations": LIMITS_SQL,
    "provenance_graph": GRAPH_SQL, "replayed": REPLAY_SQL, "valid_syntheses": SYNTHESES_SQL, "scope_misses": MISSES_SQL, "scored_queries": SCORED_SQL, "repeated_phrases": PHRASES_SQL, "archive_domains": DOMAINS_SQL,
}
