"""Queries over evidence: claims of documents, contradictions, statements, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import score as C
from ..functions import text as T
from ..functions import url as U
from ..operators import research as R
from . import sqltext as S
from .inputs import checkpoints, literal, micro, sql_literal, sql_micro, stored, table

QUESTION = "ndtion thering shtion thandst erreation intheat 45 eautre schung"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.col("text").alias("content"), F.col("source").alias("domain"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.claims(_sources(spark, sf_dir), F.lit(QUESTION)).withColumn("claim_id", F.col("source_id") * 100 + F.col("place"))
    return found.join(_sources(spark, sf_dir).select("source_id", "domain"), "source_id")


_CLAIMS = f"""q AS (SELECT {S.content_terms(f"'{QUESTION}'")} AS qt),
s AS (SELECT doc_id AS source_id, source AS domain, {S.sentences("text")} AS ss FROM documents),
e AS (SELECT source_id, domain, unnest(ss) AS text, generate_subscripts(ss, 1) AS pos FROM s),
f AS (SELECT *, {S.content_list("text")} AS cl FROM e),
g AS (SELECT source_id, domain, text, list_filter(cl, lambda x, i: list_position(cl, x) = i) AS terms, row_number() OVER (PARTITION BY source_id ORDER BY pos) AS place FROM f, q WHERE list_has_any(cl, qt)),
claims AS (SELECT source_id, domain, place, source_id * 100 + place AS claim_id, text, terms[1:8] AS terms, {S.measurements("text")} AS numbers, {S.negated("text")} AS negated FROM g WHERE place <= 10)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).select("source_id", "place", F.md5(F.col("text").cast("binary")).alias("text"), F.array_join("subject_terms", "|").alias("terms"), F.array_join("numbers", "|").alias("numbers"), "negated")


CLAIMS_SQL = f"WITH {_CLAIMS} SELECT source_id, place, md5(text) AS text, array_to_string(terms, '|') AS terms, array_to_string(numbers, '|') AS numbers, negated FROM claims"

#: Claims that contradict, agree, or only look alike: id, source, domain, terms, numbers, negated, score, text.
CLAIMS = [
    (1, 1, "a.org", ["solar", "panel", "output"], ["22"], False, 0.8, "Solar panel output is 22."),
    (2, 2, "b.org", ["solar", "panel", "output"], ["18"], False, 0.6, "Output of a solar panel: 18."),
    (3, 3, "b.org", ["solar", "panel", "output", "falls"], ["22", "18"], True, 0.4, "Solar panel output never falls."),
    (4, 4, "c.org", ["cooking", "rice"], [], False, 0.5, "Cooking rice is simple."),
    (5, 5, "d.org", ["cooking", "rice"], [], True, 0.7, "Cooking rice is not simple."),
    (6, 6, "d.org", ["tidal", "energy", "coast"], ["5%"], False, 0.9, "Tidal energy covers 5% of the coast."),
    (7, 7, "e.org", [], ["7"], False, 0.2, "7"),
    (8, 8, "a.org", ["solar", "panel", "output"], [], False, 0.3, "Solar panel output."),
]
_TABLE = sql_literal("claim_id, source_id, domain, terms, numbers, negated, score, text", CLAIMS)


def _literal(spark: SparkSession) -> DataFrame:
    return literal(spark, "claim_id long, source_id long, domain string, subject_terms array<string>, numbers array<string>, negated boolean, source_score double, text string", CLAIMS)


def _jaccard(a: str, b: str) -> str:
    return S.jaccard(a, b)


_KIND = "CASE WHEN len(a.numbers) > 0 AND len(b.numbers) > 0 AND NOT list_has_any(a.numbers, b.numbers) THEN 'numeric_mismatch' WHEN a.negated <> b.negated THEN 'negation_mismatch' END"


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _literal(spark).select(F.lit("given").alias("of"), "claim_id", "source_id", "domain", "subject_terms", "numbers", "negated")
    # Claims cost all the text work; the search for pairs reads them six times.
    found = stored(_claims(spark, sf_dir), "claims")
    real = found.select(F.lit("documents").alias("of"), (F.col("claim_id") + 1000).alias("claim_id"), "source_id", "domain", "subject_terms", "numbers", "negated")
    return R.contradictions(made.drop("of")).unionByName(R.contradictions(real.drop("of")))


CONTRADICTIONS_SQL = f"""WITH {_CLAIMS}, given AS (SELECT * FROM {_TABLE})
SELECT a.claim_id AS a, b.claim_id AS b, {_KIND} AS kind FROM given a JOIN given b ON a.claim_id < b.claim_id AND a.source_id <> b.source_id AND a.domain <> b.domain AND {_jaccard("a.terms", "b.terms")} >= 0.6 WHERE {_KIND} IS NOT NULL
UNION ALL
SELECT a.claim_id + 1000 AS a, b.claim_id + 1000 AS b, {_KIND} AS kind FROM claims a JOIN claims b ON list_has_any(a.terms, b.terms) AND a.claim_id < b.claim_id AND a.source_id <> b.source_id AND a.domain <> b.domain AND {_jaccard("a.terms", "b.terms")} >= 0.6 WHERE {_KIND} IS NOT NULL"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of the claims above, a report of their own (1), and of the claims of all documents (2)."""
    checkpoints(spark)
    real = _claims(spark, sf_dir).select((F.col("claim_id") + 1000).alias("claim_id"), "source_id", "domain", "subject_terms", "numbers", "negated", ((F.col("source_id") % 10) / 10).alias("source_score"), "text", F.lit(2).alias("report"))
    found = stored(_literal(spark).withColumn("report", F.lit(1)).unionByName(real), "claims")
    pairs = R.contradictions(found.where("report = 1")).unionByName(R.contradictions(found.where("report = 2")))
    contested = pairs.select(F.explode(F.array("a", "b")).alias("claim_id"))
    out = R.statements(found, R.cluster_claims(found, "report"), contested, "report")
    return out.select("report", "place", "leader", "status", micro(F.col("confidence")).alias("confidence"), F.md5("text").alias("text"), "domains", "sources", "claims")


STATEMENTS_SQL = f"""WITH RECURSIVE {_CLAIMS}, both_ AS (SELECT 1 AS report, claim_id, source_id, domain, CAST(terms AS VARCHAR[]) AS terms, CAST(numbers AS VARCHAR[]) AS numbers, negated, CAST(score AS DOUBLE) AS score, text FROM {_TABLE} UNION ALL SELECT 2, claim_id + 1000, source_id, domain, terms, numbers, negated, source_id % 10 / 10, text FROM claims),
c AS (SELECT *, row_number() OVER (ORDER BY claim_id) AS r FROM both_),
walk(r, leaders, claim_id, leader) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(rep INTEGER, id BIGINT, t VARCHAR[])[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT c.r, CASE WHEN len(m) > 0 THEN leaders ELSE list_append(leaders, {{'rep': CAST(c.report AS INTEGER), 'id': CAST(c.claim_id AS BIGINT), 't': c.terms}}) END, CAST(c.claim_id AS BIGINT), CASE WHEN len(m) > 0 THEN m[1].id ELSE CAST(c.claim_id AS BIGINT) END
  FROM (SELECT w.r AS wr, w.leaders, c.*, list_filter(w.leaders, lambda l: l.rep = c.report AND CASE WHEN len(l.t) > 0 AND len(c.terms) > 0 THEN len(list_intersect(l.t, c.terms)) / len(list_distinct(list_concat(l.t, c.terms))) ELSE 0 END >= 0.5) AS m FROM walk w JOIN c ON c.r = w.r + 1) c),
x AS (SELECT a.claim_id AS a, b.claim_id AS b FROM c a JOIN c b ON a.report = b.report AND a.claim_id < b.claim_id AND a.source_id <> b.source_id AND a.domain <> b.domain AND {_jaccard("a.terms", "b.terms")} >= 0.6 WHERE {_KIND} IS NOT NULL),
bad AS (SELECT a AS claim_id FROM x UNION SELECT b FROM x),
j AS (SELECT w.leader, c.*, c.claim_id IN (SELECT claim_id FROM bad) AS hit FROM walk w JOIN c ON c.claim_id = w.claim_id),
sg AS (SELECT report, leader, count(DISTINCT domain) AS domains, count(*) AS sources, avg(score) AS quality FROM (SELECT report, leader, source_id, any_value(domain) AS domain, any_value(score) AS score FROM j GROUP BY report, leader, source_id) GROUP BY report, leader),
cg AS (SELECT report, leader, count(*) AS claims, bool_or(hit) AS contested, arg_min(text, (-score, length(text), claim_id)) AS text FROM j GROUP BY report, leader),
o AS (SELECT *, floor(greatest(0.0, least(1.0, (0.3 + 0.2 * (domains - 1)) * quality - CASE WHEN contested THEN 0.3 ELSE 0.0 END)) * 1000 + 0.5) / 1000 AS conf FROM sg JOIN cg USING (report, leader))
SELECT report, row_number() OVER (PARTITION BY report ORDER BY conf DESC, text) AS place, leader, CASE WHEN contested THEN 'contested' WHEN domains >= 2 THEN 'corroborated' ELSE 'single_source' END AS status, {sql_micro("conf")} AS confidence, md5(text) AS text, domains, sources, CAST(claims AS BIGINT) AS claims FROM o"""


#: Ends of the hosts that documents are taken to be from, and their title.
SUFFIXES = ["gov", "edu", "org", "com"]
TITLE = "On the question"


def evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance, quality, recency and score of each document as a source on a host of its own; of the content its first 4000
    characters count, beside title and snippet."""
    url = F.concat(F.lit("https://docs.example."), F.element_at(F.array(*[F.lit(x) for x in SUFFIXES]), (F.col("doc_id") % len(SUFFIXES) + 1).cast("int")), F.lit("/"), F.col("doc_id").cast("string"))
    d = table(spark, sf_dir, "documents").withColumn("url", url)
    rel = C.round4(T.evidence_relevance(F.lit(QUESTION), F.concat_ws(" ", F.lit(TITLE), F.substring("text", 1, 4000))))
    fresh = C.freshness(F.when(F.col("doc_id") % 3 != 0, F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 300).cast("int"))), F.lit("2027-01-01").cast("date"))
    flagged = F.exists(T.flags(F.col("text")), lambda f: f.startswith("prompt_injection"))
    return d.select("doc_id", micro(rel).alias("relevance"), micro(U.authority(F.col("url"))).alias("quality"), micro(fresh).alias("recency"), micro(C.evidence_score(rel, U.authority(F.col("url")), fresh, flagged)).alias("score"))


_R4 = "floor(({0}) * 10000 + 0.5) / 10000"
EVIDENCE_SQL = f"""WITH a AS (SELECT doc_id, {_R4.format(f"len(list_intersect({S.content_terms(f'{chr(39)}{QUESTION}{chr(39)}')}, {S.content_terms(f"'{TITLE} ' || substr(coalesce(text, ''), 1, 4000)")})) / len({S.content_terms(f'{chr(39)}{QUESTION}{chr(39)}')})")} AS rel,
 CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE {_R4.format("pow(0.5, greatest(DATE '2027-01-01' - (DATE '2026-01-01' + CAST(doc_id % 300 AS INTEGER)), 0) / 365.0)")} END AS fresh, len(list_filter({S.flags("text")}, lambda f: starts_with(f, 'prompt_injection'))) > 0 AS bad, CASE doc_id % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.85 WHEN 2 THEN 0.6 ELSE 0.5 END AS quality FROM documents)
SELECT doc_id, {sql_micro("rel")} AS relevance, {sql_micro("quality")} AS quality, {sql_micro("fresh")} AS recency, {sql_micro(_R4.format("greatest(0.0, least(1.0, (rel * 0.5 + quality * 0.3 + fresh * 0.2) / 1.0 - CASE WHEN bad THEN 0.2 ELSE 0.0 END))"))} AS score FROM a"""

EDGES = [("q1", "s1"), ("q1", "s2"), ("s1", "c1"), ("s2", "c2"), ("c1", "st1"), ("c2", "st1"), ("c2", "x1"), ("x1", "c1"), ("q2", "s3"), ("s3", "c9"), ("q1", "s1")]


def provenance_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question led to, and what each statement came from, with the least number of steps."""
    checkpoints(spark)
    edges = literal(spark, "src string, dst string", EDGES)
    down = R.reach(spark, edges, literal(spark, "start string", [("q1",), ("q2",)]))
    up = R.reach(spark, edges, literal(spark, "start string", [("st1",), ("c9",)]), forward=False)
    return down.withColumn("way", F.lit("down")).unionByName(up.withColumn("way", F.lit("up")))


REACH_SQL = f"""WITH RECURSIVE e AS (SELECT DISTINCT * FROM {sql_literal("src, dst", EDGES)}),
w AS (SELECT x AS start, x AS node, 0 AS steps, d AS way FROM (VALUES ('q1', 'down'), ('q2', 'down'), ('st1', 'up'), ('c9', 'up')) t(x, d)
 UNION SELECT start, CASE WHEN way = 'down' THEN dst ELSE src END, steps + 1, way FROM w JOIN e ON (CASE WHEN way = 'down' THEN src ELSE dst END) = node WHERE steps < 12)
SELECT start, node, min(steps) AS steps, way FROM w GROUP BY ALL HAVING min(steps) > 0"""

QUERIES = {"claims": claims, "contradictions": contradictions, "statements": statements, "evidence_scores": evidence_scores, "provenance_reach": provenance_reach}
SQL = {"claims": CLAIMS_SQL, "contradictions": CONTRADICTIONS_SQL, "statements": STATEMENTS_SQL, "evidence_scores": EVIDENCE_SQL, "provenance_reach": REACH_SQL}
