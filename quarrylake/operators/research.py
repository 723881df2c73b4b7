"""Evidence: claims of sources, contradictions, statements, and the graph of what came from what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import score as C
from ..functions import text as T
from ..functions import url as U
from . import greedy

# Fixed values.
CLAIMS_PER_SOURCE, SUBJECT_TERMS = 10, 8
CONTRADICTION, CLUSTER = 0.6, 0.5
CONFIDENCE_BASE, CONFIDENCE_PER_DOMAIN, CONTESTED_PENALTY = 0.3, 0.2, 0.3


def claims(sources: DataFrame, question: Column, limit: int = CLAIMS_PER_SOURCE) -> DataFrame:
    """The first sentences of each source that share a term with the question: (source_id, place, text, subject_terms,
    numbers, negated). `sources` has source_id and content; place counts from 1."""
    s = sources.select("source_id", F.posexplode(T.sentences(F.col("content"))).alias("at", "text"), question.alias("question"))
    s = s.withColumn("terms", T.content_terms(F.col("text"))).where(F.arrays_overlap("terms", T.content_terms(F.col("question"))))
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("at"))
    s = s.withColumn("place", place).where(F.col("place") <= limit)
    return s.select("source_id", "place", "text", F.slice("terms", 1, SUBJECT_TERMS).alias("subject_terms"), T.measurements(F.col("text")).alias("numbers"), T.negated(F.col("text")).alias("negated"))


def contradictions(found: DataFrame, threshold: float = CONTRADICTION) -> DataFrame:
    """Pairs of claims of different sources and domains about one subject whose numbers are disjoint, or of which one is
    negated: (a, b, kind). `found` has claim_id, source_id, domain, subject_terms, numbers, negated.

    Prefix filter: claims are brought together only by the rarest of their terms,
    so many that two sets as alike as `threshold` must share one of them. Claims
    with equal terms are compared as classes first.
    """
    terms = found.select("subject_terms").distinct().withColumn("class", F.xxhash64("subject_terms"))
    each = terms.select("class", F.explode("subject_terms").alias("t"))
    often = each.groupBy("t").agg(F.count("*").alias("n"))
    ranked = each.join(often, "t").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("by"))
    size = F.size("by")
    prefix = F.slice("by", F.lit(1), size - F.ceil(size * threshold).cast("int") + 1)
    keys = ranked.select("class", F.explode(prefix).alias("k")).select("class", F.col("k.t").alias("t"))
    pairs = keys.alias("x").join(keys.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.class") <= F.col("y.class"))).select(F.col("x.class").alias("p"), F.col("y.class").alias("q")).distinct()
    one, two = terms.select(F.col("class").alias("p"), F.col("subject_terms").alias("tp")), terms.select(F.col("class").alias("q"), F.col("subject_terms").alias("tq"))
    alike = pairs.join(one, "p").join(two, "q").where(T.jaccard(F.col("tp"), F.col("tq")) >= threshold).select("p", "q")
    both = alike.unionByName(alike.where("p <> q").select(F.col("q").alias("p"), F.col("p").alias("q")))
    member = found.withColumn("class", F.xxhash64("subject_terms"))
    a = member.select(F.col("class").alias("p"), F.col("claim_id").alias("a"), F.col("source_id").alias("sa"), F.col("domain").alias("da"), F.col("numbers").alias("na"), F.col("negated").alias("ga"))
    b = member.select(F.col("class").alias("q"), F.col("claim_id").alias("b"), F.col("source_id").alias("sb"), F.col("domain").alias("db"), F.col("numbers").alias("nb"), F.col("negated").alias("gb"))
    met = a.join(both, "p").join(b, "q").where((F.col("a") < F.col("b")) & (F.col("sa") != F.col("sb")) & (F.col("da") != F.col("db")))
    numeric = (F.size("na") > 0) & (F.size("nb") > 0) & ~F.arrays_overlap("na", "nb")
    kind = F.when(numeric, "numeric_mismatch").when(F.col("ga") != F.col("gb"), "negation_mismatch")
    return met.select("a", "b", kind.alias("kind")).where("kind IS NOT NULL")


def cluster_claims(found: DataFrame, key: str, threshold: float = CLUSTER) -> DataFrame:
    """Claims of each `key` grouped in order of claim_id: a claim joins the first group whose first claim is alike enough.
    Returns (key, claim_id, leader). Claims meet by their rarest terms; a report may have any number of them."""
    rows = found.select(key, "claim_id", F.coalesce("subject_terms", F.array().cast("array<string>")).alias("subject_terms"))
    return greedy.grouped(rows, [key], "claim_id", "claim_id", F.col("subject_terms"), threshold).select(key, "claim_id", "leader")


def statements(found: DataFrame, grouped: DataFrame, contested: DataFrame, key: str) -> DataFrame:
    """One statement for each group of claims: status, confidence, text, numbers of domains and sources; best first.

    `found` has claim_id, source_id, domain, source_score and text; `contested`
    has the column claim_id. The text is that of the best source's shortest claim.
    """
    rows = grouped.join(found.drop(key), "claim_id").join(contested.select("claim_id").distinct().withColumn("hit", F.lit(True)), "claim_id", "left")
    by_source = rows.groupBy(key, "leader", "source_id").agg(F.first("domain").alias("domain"), F.first("source_score").alias("score"), F.max(F.coalesce("hit", F.lit(False))).alias("hit"), F.count("*").alias("claims"), F.min(F.struct(F.length("text").alias("n"), "claim_id", "text")).alias("best"))
    g = by_source.groupBy(key, "leader").agg(
        F.countDistinct("domain").alias("domains"), F.count("*").alias("sources"), F.sum("claims").alias("claims"), F.max("hit").alias("contested"), F.avg("score").alias("quality"),
        F.min(F.struct((-F.col("score")).alias("s"), "best.n", "best.claim_id", "best.text")).alias("best"))
    raw = (CONFIDENCE_BASE + CONFIDENCE_PER_DOMAIN * (F.col("domains") - 1)) * F.col("quality") - F.when(F.col("contested"), CONTESTED_PENALTY).otherwise(0.0)
    confidence = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) * 1000 + 0.5) / 1000
    status = F.when(F.col("contested"), "contested").when(F.col("domains") >= 2, "corroborated").otherwise("single_source")
    out = g.select(key, "leader", status.alias("status"), confidence.alias("confidence"), F.col("best.text").alias("text"), "domains", "sources", "claims")
    return out.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col("confidence").desc(), "text")))


def reach(spark: SparkSession, edges: DataFrame, start: DataFrame, forward: bool = True, depth: int = 100) -> DataFrame:
    """(start, node, steps): all nodes reachable from each start and the least number of edges to them. Edges have src and dst.

    A frontier is joined with the edges until it is empty: as many joins as the longest shortest path, `depth` at most.
    """
    a, b = ("src", "dst") if forward else ("dst", "src")
    arcs = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    seen = start.select("start", F.col("start").alias("node"), F.lit(0).alias("steps"))
    frontier = seen
    for k in range(1, depth + 1):
        step = frontier.join(arcs, "node").select("start", F.col("next").alias("node")).distinct()
        frontier = step.join(seen, ["start", "node"], "left_anti").withColumn("steps", F.lit(k)).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("steps > 0")


def merge_sources(results: DataFrame) -> DataFrame:
    """A row for each question and source of all rounds: its first hit's url and title, the union of engines, flags, rounds and
    queries, and the longest snippet (of these the first)."""
    first = F.min(F.struct("seq", "url", "title")).alias("first")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    longest = F.max(F.struct(F.length("snippet").alias("n"), (-F.col("seq")).alias("s"), "snippet")).alias("longest")
    out = results.groupBy("question_id", "source_id").agg(first, union("engines"), union("flags"), F.array_sort(F.collect_set("round")).alias("rounds"), F.array_sort(F.collect_set("query")).alias("queries"), longest)
    return out.select("question_id", "source_id", "first.url", "first.title", "engines", "flags", "rounds", "queries", F.col("longest.snippet").alias("snippet"))


def next_reads(sources: DataFrame, n: int) -> DataFrame:
    """The n best sources of each question that are known by their snippets only, by falling score, then URL."""
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "url")
    return sources.where("read_status = 'snippet_only'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def research_coverage(sources: DataFrame, questions: DataFrame, min_sources: int) -> DataFrame:
    """(question_id, coverage): distinct relevant domains against `min_sources`, 1 at most; where some of them name a term of
    the question in title or snippet, only those count. Questions without relevant sources have 0."""
    terms = F.filter(T.terms(T.without_sites(F.col("question"))), lambda t: ~t.isin(T.STOPWORDS))
    asked = questions.select("question_id", terms.alias("terms"))
    rows = sources.where("relevance > 0").join(asked, "question_id")
    hay = F.lower(F.concat_ws(" ", "title", "snippet"))
    names = F.exists("terms", lambda t: F.contains(hay, t))
    per = rows.groupBy("question_id").agg(F.countDistinct("domain").alias("every"), F.countDistinct(F.when(names, F.col("domain"))).alias("naming"))
    n = F.when(F.col("naming") > 0, F.col("naming")).otherwise(F.col("every"))
    found = per.select("question_id", F.least(F.lit(1.0), n / max(1, min_sources)).alias("coverage"))
    return asked.select("question_id").join(found, "question_id", "left").fillna(0.0, ["coverage"])


def limitations(calls: DataFrame, sources: DataFrame, contradictions: DataFrame) -> DataFrame:
    """(question_id, failed, snippet_only, unread, contested, no_sources): what a report must own to. Tables have question_id;
    `calls` status, `sources` read_status."""
    failed = calls.groupBy("question_id").agg(F.count_if(F.col("status").isin("failed", "skipped")).alias("failed"))
    read = sources.groupBy("question_id").agg(F.count("*").alias("sources"), F.count_if(F.col("read_status") == "snippet_only").alias("snippet_only"), F.count_if(F.col("read_status") == "read_failed").alias("unread"))
    contested = contradictions.groupBy("question_id").agg(F.count("*").alias("pairs"))
    rows = failed.join(read, "question_id", "full_outer").join(contested, "question_id", "full_outer").fillna(0)
    return rows.select("question_id", "failed", "snippet_only", "unread", (F.col("pairs") > 0).alias("contested"), (F.col("sources") == 0).alias("no_sources"))


def provenance_graph(queries: DataFrame, returned: DataFrame, claims: DataFrame, statements: DataFrame, conflicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a report, each once: (node, kind) of the question, queries, sources, claims, statements and
    contradictions; (src, dst, relation) issued, returned, states, supports, conflicts_with.

    `queries` has query_no, `returned` query_no and source_id, `claims` claim_id
    and source_id, `statements` statement_id and claim_ids, `conflicts` conflict_id and claim_ids.
    """
    name = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    link = lambda df, a, b, relation: df.select(a.alias("src"), b.alias("dst"), F.lit(relation).alias("relation"))
    told, fought = statements.select("statement_id", F.explode("claim_ids").alias("claim_id")), conflicts.select("conflict_id", F.explode("claim_ids").alias("claim_id"))
    known = returned.join(claims.select("source_id").distinct(), "source_id", "left_semi")
    edges = link(queries, F.lit("question"), name("q", "query_no"), "issued")
    for more in (link(known, name("q", "query_no"), name("src", "source_id"), "returned"), link(claims, name("src", "source_id"), name("claim", "claim_id"), "states"), link(told, name("claim", "claim_id"), name("stmt", "statement_id"), "supports"), link(fought, name("claim", "claim_id"), name("x", "conflict_id"), "conflicts_with")):
        edges = edges.unionByName(more)
    edges = edges.distinct()
    kinds = {"question": "question", "q": "query", "src": "source", "claim": "claim", "stmt": "statement", "x": "contradiction"}
    kind = F.element_at(F.create_map(*[F.lit(v) for pair in kinds.items() for v in pair]), F.regexp_extract("node", "^[a-z]+", 0))
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return nodes.withColumn("kind", kind), edges


def replayed(asked: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """Each asked key with its first recorded answer: (key, seq, answer, recorded); `recorded` has key, seq, answer."""
    first = recorded.groupBy(key).agg(F.min_by("answer", "seq").alias("answer"))
    out = asked.join(first.withColumn("recorded", F.lit(True)), key, "left")
    return out.withColumn("recorded", F.coalesce("recorded", F.lit(False)))


def valid_syntheses(statements: DataFrame, claims: DataFrame) -> DataFrame:
    """Statements of the reports all of whose statements stand: text that isn't empty, claims cited, no claim invented.

    `statements` has report, statement_id, text, claim_ids; `claims` report and
    claim_id. One bad statement rejects its whole report.
    """
    cited = statements.select("report", F.explode("claim_ids").alias("claim_id"))
    invented = cited.join(claims.select("report", "claim_id"), ["report", "claim_id"], "left_anti").select("report")
    hollow = statements.where((F.coalesce(F.trim("text"), F.lit("")) == "") | (F.coalesce(F.size("claim_ids"), F.lit(0)) <= 0)).select("report")
    return statements.join(invented.unionByName(hollow).distinct(), "report", "left_anti")


def scope_misses(results: DataFrame, scopes: DataFrame) -> DataFrame:
    """Results on hosts outside all scopes of their question; questions without scopes miss nothing. `scopes`: question_id, scope."""
    scoped = results.join(scopes.select("question_id").distinct(), "question_id", "left_semi")
    inside = scopes.withColumnRenamed("question_id", "of")
    return scoped.join(inside, (F.col("question_id") == F.col("of")) & U.scope_matches(F.col("url"), F.col("scope")), "left_anti")


def scored_queries(results: DataFrame, expected: DataFrame, today: Column, top: int = 5) -> DataFrame:
    """(question_id, available, quality_hit, fresh): whether one of a question's first results is on an acceptable domain or has
    an expected phrase, and whether one is as recent as asked (null where no recency is asked).

    `expected` has question_id, domains, phrases, recency_days.
    """
    rows = expected.join(results.where(F.col("place") <= top), "question_id", "left")
    host, hay = U.domain(F.col("url")), F.lower(F.concat_ws(" ", "title", "snippet"))
    hit = F.exists("domains", lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d))) | F.exists("phrases", lambda p: F.contains(hay, F.lower(p)))
    young = F.coalesce(F.datediff(today, F.col("published_at")) <= F.col("recency_days"), F.lit(False))
    out = rows.groupBy("question_id").agg(F.max(F.col("url").isNotNull()).alias("available"), F.coalesce(F.max(hit), F.lit(False)).alias("quality_hit"), F.max(young).alias("young"), F.first("recency_days").alias("asked"))
    return out.select("question_id", "available", "quality_hit", F.when(F.col("asked").isNotNull(), F.col("young")).alias("fresh"))


def repeated_phrases(requests: DataFrame, least: int = 2) -> DataFrame:
    """(phrase, n): requests as lower-case words that occur `least` times or more. `requests` has request."""
    words = F.array_join(F.transform(T._all(F.col("request"), T.RUN), F.lower), " ")
    return requests.select(words.alias("phrase")).where("phrase <> ''").groupBy("phrase").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def archive_domains(feeds: DataFrame, regions: DataFrame, n: int) -> DataFrame:
    """(asked, place, domain): the first n publishers of each region asked for, each once, by their place in the list; a region
    (or its parts) without any, and an empty one, takes all. `feeds` has seq, domain, region; `regions` asked. Both are small."""
    of = (F.col("region") == F.col("asked")) | F.col("region").startswith(F.concat(F.col("asked"), F.lit("-")))
    met = regions.join(F.broadcast(feeds), of, "left")
    own = met.where("domain IS NOT NULL")
    rest = met.where("domain IS NULL").select("asked").join(F.broadcast(feeds), F.lit(True))
    once = own.unionByName(rest).groupBy("asked", "domain").agg(F.min("seq").alias("seq"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy("seq"))).where(F.col("place") <= n).select("asked", "place", "domain")
