"""From hits to ranked results: merging, facts of groups, scores, caps, top k, coverage, stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import score as C
from ..functions import text as T
from ..functions import url as U
from . import greedy


def merge_canonical(hits: DataFrame) -> DataFrame:
    """A row for each question and canonical page, with the facts of its hits.

    `hits` has question_id, arrival_seq, engine, position, title, url, snippet,
    published_at. The page keeps its first hit's URL, its longest title (ties: the
    first), its earliest date, and each engine's best position. Hits without a
    canonical URL go. One shuffle, on question and page.
    """
    keyed = hits.withColumn("canonical", U.canonical(F.col("url"))).where("canonical IS NOT NULL")
    by_engine = keyed.groupBy("question_id", "canonical", "engine").agg(
        F.min("position").alias("rank"), F.count("*").alias("hits"), F.min("published_at").alias("published_at"),
        F.min(F.struct("arrival_seq", "url", "snippet")).alias("first"), F.max(F.struct(F.length("title").alias("n"), (-F.col("arrival_seq")).alias("s"), "title")).alias("longest"),
    )
    return by_engine.groupBy("question_id", "canonical").agg(
        F.min("first").alias("first"), F.max("longest").alias("longest"), F.min("published_at").alias("published_at"), F.min("rank").alias("best_rank"),
        F.sum("hits").alias("hits"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("engine", "rank")))).alias("engine_ranks"),
    ).select("question_id", "canonical", F.col("first.arrival_seq").alias("arrival_seq"), F.col("first.url").alias("url"), F.col("first.snippet").alias("snippet"), F.col("longest.title").alias("title"), "published_at", "best_rank", "hits", "engine_ranks")


def score_groups(groups: DataFrame, questions: DataFrame, today: Column) -> DataFrame:
    """Adds the factors and the score of each group. `questions` has question_id and question; it is small next to groups."""
    engines = groups.select("question_id", F.explode(F.map_keys("engine_ranks")).alias("e")).groupBy("question_id").agg(F.countDistinct("e").alias("engines"))
    asked = questions.select("question_id", "question", T.terms(F.col("question")).alias("q_terms"), T.quoted(F.col("question")).alias("phrases"))
    g = groups.join(asked, "question_id").join(engines, "question_id")
    g = g.withColumn("relevance", C.relevance(F.col("best_rank"), F.col("title"), F.col("snippet"), F.col("question"), F.col("q_terms"), F.col("phrases"), F.col("url")))
    flagged = F.exists(T.flags(F.concat_ws(" ", "title", "snippet")), lambda f: f.startswith("prompt_injection:"))
    g = g.withColumn("relevance", F.when(flagged, C.round4(F.col("relevance") * C.FLAGGED_FACTOR)).otherwise(F.col("relevance")))
    g = g.withColumn("relevance", F.when(U.is_test_host(F.col("url")), C.round4(F.col("relevance") * C.FLAGGED_FACTOR)).otherwise(F.col("relevance")))
    g = g.withColumn("authority", U.authority(F.col("url"))).withColumn("agreement", C.round4(F.size("engine_ranks") / F.col("engines")))
    g = g.withColumn("freshness", C.gated_freshness(F.col("relevance"), C.freshness(F.col("published_at"), today)))
    return g.withColumn("score", C.combine({k: F.col(k) for k in C.WEIGHTS})).drop("q_terms", "phrases")


def top_k(scored: DataFrame, k: int, capped: Column | None = None, cap: int | Column = 2, offset: int = 0) -> DataFrame:
    """The k best rows of each question by falling score, then URL, after `offset`; of the rows that `capped` marks at
    most `cap`, without others in their place beyond k."""
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "url")
    if capped is not None:
        marked = Window.partitionBy("question_id", "capped").orderBy(F.col("score").desc(), "url")
        scored = scored.withColumn("capped", capped).withColumn("nth", F.row_number().over(marked)).where(~F.col("capped") | (F.col("nth") <= cap)).drop("capped", "nth")
    return scored.withColumn("place", F.row_number().over(order)).where((F.col("place") > offset) & (F.col("place") <= offset + k)).withColumn("place", F.col("place") - offset)


def coverage(results: DataFrame, questions: DataFrame) -> DataFrame:
    """How many of each question's telling terms its best result has: good from 0.6, partial from 0.3, else low; unknown
    for a question without terms."""
    terms = F.filter(T.terms(T.without_sites(F.col("question"))), lambda t: ~t.isin(T.STOPWORDS))
    telling = F.filter(terms, lambda t: t.rlike(r"[0-9]|[^\x00-\x7F]") | (F.length(t) >= 9))
    q = questions.select("question_id", F.when(F.size(telling) > 0, telling).otherwise(terms).alias("telling"))
    words = F.concat_ws(" ", F.col("title"), F.col("snippet"), F.replace(U.host(F.col("url")), F.lit("."), F.lit(" ")), F.regexp_replace(U.path(F.col("url")), "[/_]", " "))
    found = results.join(q, "question_id").groupBy("question_id").agg(F.max(F.size(F.array_intersect("telling", T.terms(words)))).alias("matched"))
    out = q.join(found, "question_id", "left").select("question_id", F.size("telling").alias("total"), F.coalesce("matched", F.lit(0)).alias("matched"))
    ratio = F.col("matched") / F.col("total")
    return out.withColumn("status", F.when(F.col("total") == 0, "unknown").when(ratio >= 0.6, "good").when(ratio >= 0.3, "partial").otherwise("low"))


def near_titles(groups: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Greedy merging of groups with alike titles on one host, in order of arrival: (question_id, canonical, kept).

    A group joins the first kept group of its question, registrable host and
    version segments whose title is alike enough. Titles meet by their rarest
    words, and the order is settled by joins in rounds: a host may have any number of pages.
    """
    keyed = groups.select("question_id", "arrival_seq", "canonical", "title", U.registrable(F.col("url")).alias("host"), F.array_join(U.version_segments(F.col("url")), "/").alias("versions"))
    found = greedy.grouped(keyed, ["question_id", "host", "versions"], "arrival_seq", "canonical", T.title_words(F.coalesce("title", F.lit(""))), threshold)
    return found.select("question_id", "canonical", F.col("leader").alias("kept"))


def stories(results: DataFrame, threshold: float = 0.62, gap_days: int = 10, compared: int = 3) -> DataFrame:
    """Results of a question grouped to stories: (question_id, url, story), story counting from 0 in order of score.

    A result joins the first story one of whose first `compared` members has an
    equal canonical URL, a syndicated title, or alike story words within
    `gap_days`. Each question's results, its top k, are folded in order.
    """
    rows = results.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("score")).alias("s"), "url", "canonical", "published_at", T.story_words(F.col("title")).alias("words"), T.syndication_terms(F.col("title")).alias("wire"))), True).alias("rows"))
    kind = "STRUCT<url: STRING, canonical: STRING, published_at: DATE, words: ARRAY<STRING>, wire: ARRAY<STRING>>"
    zero = F.expr(f"CAST(array() AS ARRAY<ARRAY<{kind}>>)")

    def same(a: Column, b: Column) -> Column:
        alike = (T.jaccard(a["words"], b["words"]) >= threshold) | (T.containment(a["words"], b["words"]) >= 0.85)
        near = a["published_at"].isNull() | b["published_at"].isNull() | (F.abs(F.datediff(a["published_at"], b["published_at"])) <= gap_days)
        return F.coalesce(a["canonical"] == b["canonical"], F.lit(False)) | (T.jaccard(a["wire"], b["wire"]) >= max(0.8, threshold)) | (alike & near)

    def step(acc: Column, row: Column) -> Column:
        one = F.struct(*[row[k].alias(k) for k in ("url", "canonical", "published_at", "words", "wire")])
        hits = F.transform(acc, lambda g: F.exists(F.slice(g, 1, compared), lambda m: same(row, m)))
        at = F.array_position(hits, F.lit(True))
        return F.when(at > 0, F.transform(acc, lambda g, i: F.when(i + 1 == at, F.concat(g, F.array(one))).otherwise(g))).otherwise(F.concat(acc, F.array(F.array(one))))

    folded = rows.select("question_id", F.posexplode(F.aggregate("rows", zero, step)).alias("story", "members"))
    return folded.select("question_id", "story", F.explode("members").alias("m")).select("question_id", "m.url", "story")


def story_facts(results: DataFrame, grouped: DataFrame) -> DataFrame:
    """First report, latest update, domains, size, dated members, primary copy and score of each story."""
    r = results.join(grouped, ["question_id", "url"])
    facts = r.groupBy("question_id", "story").agg(
        F.min("published_at").alias("first_report"), F.max("published_at").alias("latest_update"), F.count("*").alias("story_count"), F.count("published_at").alias("dated_count"),
        F.countDistinct(U.domain(F.col("url"))).alias("source_count"), F.max("score").alias("best"), F.max(F.struct(U.source_quality(F.col("url")).alias("q"), "score", "url")).alias("primary"))
    return facts.select("question_id", "story", "first_report", "latest_update", "story_count", "dated_count", "source_count", F.col("primary.url").alias("primary_url"), F.substring(F.sha1("primary.url"), 1, 12).alias("id"), C.round4(F.col("best") + F.least("source_count", F.lit(5)) * 0.05).alias("score"))


def trends(facts: DataFrame, today: Column, window_days: int = 2, k: int = 8) -> DataFrame:
    """The stories that spread: publishers, recency and size; those updated in the window, or all where none was."""
    age = F.datediff(today, F.col("latest_update"))
    recent = F.coalesce(age.between(0, window_days), F.lit(False))
    any_recent = F.max(recent).over(Window.partitionBy("question_id"))
    basis = facts.withColumn("recent", recent).withColumn("any", any_recent).where("recent OR NOT any")
    recency = F.coalesce(F.greatest(F.lit(0.0), 1 - age / max(1, window_days)), F.lit(0.0))
    signal = C.round4(F.col("source_count") * 0.6 + recency * 0.4 + F.least("story_count", F.lit(10)) * 0.05)
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("signal").desc(), "id"))
    return basis.withColumn("signal", signal).withColumn("place", place).where(F.col("place") <= k).select("question_id", "id", "signal", "place")
