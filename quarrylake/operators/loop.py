"""Research on many questions at once: rounds of searching, reading and weighing, until each question has a reason to stop.

What is known so far lies in stored tables to which each round adds; the driver
asks only how many questions go on. A round costs the same jobs for one question
as for a million, and a question that has stopped isn't worked on again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import score as C
from ..functions import text as T
from ..functions import url as U
from ..functions.forms import reformulate
from . import research as R

# Forms of a question in the first round, coverage that is enough, characters of a page that are kept, contested
# subjects that are asked about, and words of each; the reasons to stop.
FORMS, ENOUGH, PAGE_CHARS, CONTESTED, CONTESTED_TERMS = 3, 0.7, 4000, 3, 4
COVERED, BUDGET, NO_NEW, FAILED, ROUNDS = "coverage_reached", "budget_exhausted", "no_new_sources", "search_failed", "max_rounds"

ASKED = "question_id, question, max_rounds, max_queries, min_sources, read_top_n"

Search = Callable[[DataFrame], DataFrame]
Expand = Callable[[DataFrame, int, DataFrame], DataFrame]


@dataclass
class Report:
    """What a run leaves: `questions` (question_id, stop_reason, rounds, coverage, queries), `steps` (question_id, round, ask_no, query,
    strategy, error), `sources` (question_id, source_id, url, title, domain, snippet, published_at, engines, flags, rounds, queries,
    score, relevance, read_status), `claims`, `contradictions` (question_id, a, b, kind, subject_terms) and `candidates` (all forms
    that were proposed, whether asked or not, from which a run can be replayed)."""

    questions: DataFrame
    steps: DataFrame
    sources: DataFrame
    claims: DataFrame
    contradictions: DataFrame
    candidates: DataFrame


def expand(active: DataFrame, round_no: int, contested: DataFrame) -> DataFrame:
    """(question_id, nth, text, strategy): the question's forms in the first round; later what is contested, by its subject's first
    words, and twice as many forms. `contested` has question_id, nth and subject_terms."""
    forms = active.select("question_id", F.posexplode(reformulate(F.col("question"), FORMS if round_no == 1 else 2 * FORMS)).alias("nth", "f"))
    out = forms.select("question_id", (F.col("nth") + CONTESTED).alias("nth"), "f.text", "f.strategy")
    if round_no > 1:
        words = F.concat(F.array_join(F.slice("subject_terms", 1, CONTESTED_TERMS), " "), F.lit(" evidence"))
        some = contested.where((F.col("nth") < CONTESTED) & (F.size("subject_terms") > 0)).select("question_id", "nth", words.alias("text"), F.lit("contested").alias("strategy"))
        out = some.join(active.select("question_id"), "question_id").select(*out.columns).unionByName(out)
    return out


def to_ask(candidates: DataFrame, active: DataFrame, used: DataFrame) -> DataFrame:
    """Candidates in order with `ask_no` from the number already asked, each text once whatever its case and what was asked before not
    again; `over` marks those beyond the question's budget."""
    rows = candidates.withColumn("text", F.trim("text")).where("text <> ''").withColumn("low", F.lower("text"))
    once = rows.groupBy("question_id", "low").agg(F.min(F.struct("nth", "text", "strategy")).alias("c")).join(used.select("question_id", F.lower("query").alias("low")).distinct(), ["question_id", "low"], "left_anti")
    spent = used.groupBy("question_id").agg(F.count("*").alias("spent"))
    rows = once.select("question_id", "c.*").join(active.select("question_id", "max_queries"), "question_id").join(spent, "question_id", "left")
    ask_no = F.row_number().over(Window.partitionBy("question_id").orderBy("nth")) + F.coalesce("spent", F.lit(0))
    return rows.withColumn("ask_no", ask_no.cast("int")).withColumn("over", F.col("ask_no") > F.col("max_queries")).select("question_id", "ask_no", F.col("text").alias("query"), "strategy", "over")


def weighed(results: DataFrame, reads: DataFrame, questions: DataFrame, today: Column) -> DataFrame:
    """Sources of all rounds' results (merged), with what was read of them, score and relevance."""
    sources = R.merge_sources(results)
    dates = results.groupBy("question_id", "source_id").agg(F.min_by("published_at", "seq").alias("published_at"))
    rows = sources.join(dates, ["question_id", "source_id"]).join(reads, ["question_id", "source_id"], "left").join(questions.select("question_id", "question"), "question_id")
    rows = rows.withColumn("read_status", F.coalesce("read_status", F.lit("snippet_only"))).withColumn("domain", U.domain(F.col("url")))
    text = F.concat_ws(" ", "title", "snippet", F.substring(F.coalesce("content", F.lit("")), 1, PAGE_CHARS))
    rows = rows.withColumn("relevance", C.round4(T.evidence_relevance(F.col("question"), text)))
    flagged = F.exists("flags", lambda f: f.startswith("prompt_injection"))
    return rows.withColumn("score", C.evidence_score(F.col("relevance"), U.authority(F.col("url")), C.freshness(F.col("published_at"), today), flagged))


def argued(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, contradictions) of each question's sources, from what was read of them or else their snippets. Claims are numbered
    by source in the order it was found, then by place; contradictions from 0 in the order of their claims."""
    key = F.concat_ws(":", F.col("question_id").cast("string"), "source_id")
    rows = sources.select(key.alias("source_id"), "question_id", "domain", "question", "first_seq", F.when(F.coalesce("content", F.lit("")) != "", F.col("content")).otherwise(F.col("snippet")).alias("content"))
    found = R.claims(rows, F.col("question")).join(rows.select("source_id", "question_id", "domain", "first_seq"), "source_id")
    order = F.row_number().over(Window.partitionBy("question_id").orderBy("first_seq", "source_id", "place"))
    found = found.withColumn("number", order).withColumn("claim_id", F.struct("question_id", "number"))
    # Terms carry their question, so that claims of different questions never meet.
    apart = found.withColumn("subject_terms", F.transform("subject_terms", lambda t: F.concat_ws("\x1f", F.col("question_id").cast("string"), t)))
    pairs = R.contradictions(apart.select("claim_id", "source_id", "domain", "subject_terms", "numbers", "negated"))
    terms = found.select("claim_id", "subject_terms")
    both = pairs.join(terms.withColumnsRenamed({"claim_id": "a", "subject_terms": "ta"}), "a").join(terms.withColumnsRenamed({"claim_id": "b", "subject_terms": "tb"}), "b")
    both = both.select(F.col("a.question_id").alias("question_id"), F.col("a.number").alias("a"), F.col("b.number").alias("b"), "kind", F.array_sort(F.array_intersect("ta", "tb")).alias("subject_terms"))
    nth = F.row_number().over(Window.partitionBy("question_id").orderBy("a", "b")) - 1
    claims = found.select("question_id", "number", F.regexp_replace("source_id", "^.*:", "").alias("source_id"), "domain", "text", "subject_terms", "numbers", "negated")
    return claims, both.withColumn("nth", nth)


def _covered(sources: DataFrame, active: DataFrame) -> DataFrame:
    """(question_id, coverage) against each question's own min_sources."""
    counted = R.research_coverage(sources, active, 1_000_000).select("question_id", F.round(F.col("coverage") * 1_000_000).alias("domains"))
    return counted.join(active.select("question_id", "min_sources"), "question_id").select("question_id", F.least(F.lit(1.0), F.col("domains") / F.greatest("min_sources", F.lit(1))).alias("coverage"))


def research(questions: DataFrame, search: Search, read: Callable[[DataFrame], DataFrame] | None, today: Column, store: Callable[[DataFrame, str], DataFrame], expander: Expand = expand, enough: float = ENOUGH) -> Report:
    """Runs all questions (question_id, question, max_rounds, max_queries, min_sources, read_top_n) to their ends.

    `search` takes (question_id, ask_no, query) and returns (question_id, ask_no,
    place, url, title, snippet, published_at, engines, flags, error): a row for
    each hit, or one with an error and no url for a query that failed. `read`
    takes distinct urls and returns (url, content); a page that isn't among them,
    or is blank, couldn't be read. `store` writes a table and reads it back.

    In each round the expander's candidates that weren't asked before are asked
    in order, while the question's budget lasts; the best sources known only by
    their snippet are read; then a question stops that is covered, whose budget
    was too small for its candidates, or whose round brought no source that is
    new (search_failed if searches failed and nothing was ever found), in this
    order; the rest at their last round. Empty questions are left out. Ids must not
    repeat.
    """
    spark = questions.sparkSession
    asked = store(questions.selectExpr(*ASKED.split(", ")).withColumn("question", T.squeeze(F.col("question"))).where("question <> ''"), "questions")
    most = asked.agg(F.max("max_rounds")).first()[0] or 0
    empty = lambda schema: spark.createDataFrame([], schema)
    qid = asked.schema["question_id"].dataType.simpleString()
    kinds = f"question_id {qid}, "
    steps = empty(kinds + "round int, ask_no int, query string, strategy string, error string")
    results = empty(kinds + "seq long, source_id string, canonical string, url string, title string, snippet string, published_at date, round int, query string, engines array<string>, flags array<string>")
    reads = empty(kinds + "source_id string, content string, read_status string")
    proposed = empty(kinds + "round int, nth int, text string, strategy string")
    done = empty(kinds + "stop_reason string, rounds int, coverage double")
    contested = empty(kinds + "nth int, subject_terms array<string>")
    active = asked
    for round_no in range(1, most + 1):
        candidates = store(expander(active, round_no, contested).select("question_id", F.lit(round_no).alias("round"), F.col("nth").cast("int").alias("nth"), "text", "strategy"), "candidates")
        proposed = proposed.unionByName(candidates)
        ask = store(to_ask(candidates, active, steps), "ask")
        now = ask.where("NOT over")
        hits = store(search(now.select("question_id", "ask_no", "query")), "hits")
        failed = hits.where("error IS NOT NULL").groupBy("question_id", "ask_no").agg(F.min("error").alias("error"))
        steps = store(steps.unionByName(now.join(failed, ["question_id", "ask_no"], "left").select("question_id", F.lit(round_no).alias("round"), "ask_no", "query", "strategy", "error")), "steps")
        found = hits.where("error IS NULL AND url IS NOT NULL").withColumn("canonical", U.canonical(F.col("url"))).where("canonical IS NOT NULL").join(now.select("question_id", "ask_no", "query"), ["question_id", "ask_no"])
        found = found.select("question_id", (F.col("ask_no") * F.lit(1 << 20).cast("long") + F.col("place")).alias("seq"), U.source_id(F.col("canonical")).alias("source_id"), "canonical", "url", "title", "snippet", "published_at", F.lit(round_no).alias("round"), "query", "engines", "flags")
        new = found.select("question_id", "source_id").distinct().join(results.select("question_id", "source_id").distinct(), ["question_id", "source_id"], "left_anti").groupBy("question_id").agg(F.count("*").alias("new"))
        results = store(results.unionByName(found), "results")
        mine = results.join(active.select("question_id"), "question_id", "left_semi")
        if read is not None:
            known = weighed(mine, reads, active, today)
            wanted = known.where("read_status = 'snippet_only'").withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("score").desc(), "url"))).join(active.select("question_id", "read_top_n"), "question_id").where("place <= read_top_n")
            wanted = store(wanted.select("question_id", "source_id", "url"), "wanted")
            content = F.substring("content", 1, PAGE_CHARS)
            whole = F.coalesce(F.trim("content") != "", F.lit(False))
            got = wanted.join(read(wanted.select("url").distinct()), "url", "left").select("question_id", "source_id", F.when(whole, content).alias("content"), F.when(whole, "read").otherwise("read_failed").alias("read_status"))
            reads = store(reads.unionByName(got), "reads")
        first = mine.groupBy("question_id", "source_id").agg(F.min("seq").alias("first_seq"))
        sources = store(weighed(mine, reads, active, today).join(first, ["question_id", "source_id"]), "sources")
        if round_no < most:
            contested = store(argued(sources)[1].select("question_id", "nth", "subject_terms"), "contested")
        flags = active.join(_covered(sources, active), "question_id", "left").join(new, "question_id", "left").join(ask.groupBy("question_id").agg(F.max("over").alias("over")), "question_id", "left")
        flags = flags.join(failed.groupBy("question_id").agg(F.count("*").alias("failures")), "question_id", "left").join(sources.groupBy("question_id").agg(F.count("*").alias("held")), "question_id", "left").fillna(0, ["new", "failures", "held"]).fillna(0.0, ["coverage"])
        reason = (
            F.when(F.col("coverage") >= enough, COVERED).when(F.coalesce("over", F.lit(False)), BUDGET)
            .when(F.col("new") == 0, F.when((F.col("failures") > 0) & (F.col("held") == 0), FAILED).otherwise(NO_NEW)).when(F.col("max_rounds") <= round_no, ROUNDS)
        )
        flags = store(flags.withColumn("reason", reason), "flags")
        done = done.unionByName(flags.where("reason IS NOT NULL").select("question_id", F.col("reason").alias("stop_reason"), F.lit(round_no).alias("rounds"), "coverage"))
        active = flags.where("reason IS NULL").select(*asked.columns)
        if active.isEmpty():
            break
    first = results.groupBy("question_id", "source_id").agg(F.min("seq").alias("first_seq"))
    sources = store(weighed(results, reads, asked, today).join(first, ["question_id", "source_id"]), "sources")
    claims, pairs = argued(sources)
    spent = steps.groupBy("question_id").agg(F.count("*").cast("int").alias("queries"))
    ended = done.join(spent, "question_id", "left").fillna(0, ["queries"]).withColumn("coverage", C.round4(F.col("coverage")))
    return Report(ended, steps, sources, claims, pairs, proposed)


def recorded(report: Report) -> Expand:
    """An expander that proposes what a run's expander proposed, so that the run can be done again from its record."""
    def again(active: DataFrame, round_no: int, contested: DataFrame) -> DataFrame:
        rows = report.candidates.where(F.col("round") == round_no).select("question_id", "nth", "text", "strategy")
        return rows.join(active.select("question_id"), "question_id", "left_semi")

    return again
