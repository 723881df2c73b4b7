"""The search in one piece, for all questions at once: hits are admitted, merged, scored under each question's profile and ranked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import intent as I
from ..functions import request as Q
from ..functions import score as C
from ..functions import text as T
from ..functions import url as U
from . import evidence as E
from . import ranking as R

#: What a question may bring besides its text, null or missing where it brings nothing.
OPTIONS = {
    "include_domains": "array<string>", "exclude_domains": "array<string>", "file_type": "string", "date_from": "date", "date_to": "date",
    "exclude_unknown_dates": "boolean", "exclude_urls": "array<string>",
}
#: What a hit may bring besides the columns that ranking.merge_canonical() names.
HIT_OPTIONS = {"date_evidence": "string", "date_kind": "string", "modified_at": "date"}
#: Lengths of titles and snippets, and how many pages of an encyclopaedia a kind of answer stands.
TITLE_CHARS, SNIPPET_CHARS = 200, 400
CAP_PARTICULAR, CAP_OTHERS = 1, 2


@dataclass
class Found:
    """results: a row for each ranked page. log: what went into what, as evidence.merge_log, without similarity. report: a row
    for each question with its numbers, coverage, reason and shortfall."""

    results: DataFrame
    log: DataFrame
    report: DataFrame


def _with(rows: DataFrame, options: dict[str, str]) -> DataFrame:
    return rows.withColumns({name: F.lit(None).cast(kind) for name, kind in options.items() if name not in rows.columns})


def asked(questions: DataFrame, today: Column, k: int) -> DataFrame:
    """What each question asks for, worked out once: filters (those that it names in its text where it brings none), kind of
    answer, profile, terms, wanted kinds of sources, place. `questions` has question_id and question, and may have OPTIONS."""
    rows = _with(questions, OPTIONS).withColumn("question", F.coalesce("question", F.lit(""))).select(
        "question_id", "question", *OPTIONS, T.site_scopes(F.col("question")).alias("scopes"), T.without_sites(F.col("question")).alias("bare"),
        I.is_news(F.col("question")).alias("recent"), I.news_window_days(F.col("question")).alias("days"), I.archive_bounds(F.col("question"), today).alias("archive"),
        Q.split_subject(F.col("question"))["request"].alias("request"))
    rows = rows.withColumns({"kind": I.answer_type(F.col("bare")), "news": F.col("recent") | F.col("archive").isNotNull()})
    hosts = F.transform("scopes", lambda s: F.regexp_extract(s, "^[^/]*", 0))
    domains = F.when(F.size("include_domains") > 0, F.col("include_domains")).otherwise(hosts)
    # A window that the question names counts where it brings no dates of its own.
    undated = F.col("news") & F.col("date_from").isNull() & F.col("date_to").isNull()
    older = F.col("archive").isNotNull()
    lo = F.when(older, F.col("archive.lo")).when(F.col("days").isNotNull(), F.date_sub(today, F.greatest(F.col("days") - 1, F.lit(0))))
    hi = F.when(older, F.col("archive.hi")).when(F.col("days").isNotNull(), today)
    cap = F.when(F.col("kind").isin(*C.PARTICULAR), CAP_PARTICULAR).when(F.col("kind").isin(*C.DEFINING), k).otherwise(CAP_OTHERS)
    return rows.select(
        "question_id", "question", "kind", "news", older.alias("old"), "scopes", "file_type", "exclude_urls", cap.alias("cap"),
        F.transform(domains, lambda d: F.regexp_replace(F.lower(d), r"^www\.", "")).alias("include_domains"), F.transform("exclude_domains", lambda d: F.regexp_replace(F.lower(d), r"^www\.", "")).alias("exclude_domains"),
        F.when(undated, lo).otherwise(F.col("date_from")).alias("date_from"), F.when(undated, hi).otherwise(F.col("date_to")).alias("date_to"), F.coalesce("exclude_unknown_dates", F.lit(False)).alias("exclude_unknown_dates"),
        T.terms(F.col("question")).alias("q_terms"), T.quoted(F.col("question")).alias("phrases"), Q.request_kinds(F.col("question"), F.col("request")).alias("wants"), Q.jurisdiction(F.col("bare")).alias("place_of"),
    )


def judged(hits: DataFrame, about: DataFrame) -> DataFrame:
    """Hits with `refused`: null, or the first reason against a hit: non_public, include_domains, site_operator,
    exclude_domains, file_type, unknown_date, date, exclude_urls; and canonical, flags, and a date from snippet or URL where
    the hit had none. Hits of no question go. `about` is what asked() gives."""
    filters = about.select("question_id", "scopes", "include_domains", "exclude_domains", "file_type", "date_from", "date_to", "exclude_unknown_dates", "exclude_urls")
    inner = F.trim(U.unwrap(F.col("url")))
    rows = _with(hits, HIT_OPTIONS).select("question_id", "arrival_seq", "engine", "position", "title", "snippet", "published_at", *HIT_OPTIONS, F.when(inner.contains("://"), inner).otherwise(F.concat(F.lit("https://"), inner)).alias("url"))
    rows = rows.withColumns({"canonical": U.canonical(F.col("url")), "host": U.domain(F.col("url")), "public": U.is_public(F.col("url"))})
    # URLs seen before are few a question; their canonical forms are worked out once each.
    seen = about.select("question_id", F.explode("exclude_urls").alias("u")).groupBy("question_id").agg(F.collect_set(F.coalesce(U.canonical(F.col("u")), F.col("u"))).alias("seen"))
    rows = rows.join(filters.join(seen, "question_id", "left"), "question_id")
    on = lambda domains: F.exists(domains, lambda d: U.domain_matches(F.col("host"), d))
    day, lo, hi = F.col("published_at"), F.col("date_from"), F.col("date_to")
    windowed = lo.isNotNull() | hi.isNotNull()
    ending = F.regexp_extract(F.lower("url"), r"^[^?]*", 0)
    refused = (
        F.when(~F.col("public") | F.col("canonical").isNull(), "non_public")
        .when((F.size("include_domains") > 0) & ~on("include_domains"), "include_domains")
        .when((F.size("scopes") > 0) & ~F.exists("scopes", lambda s: U.scope_matches(F.col("url"), s)), "site_operator")
        .when(on("exclude_domains"), "exclude_domains")
        .when((F.coalesce("file_type", F.lit("")) != "") & ~ending.endswith(F.concat(F.lit("."), "file_type")), "file_type")
        .when(windowed & day.isNull() & F.col("exclude_unknown_dates"), "unknown_date")
        .when((day < lo) | (day > hi), "date")
        .when(F.array_contains("seen", F.col("canonical")) | F.array_contains("exclude_urls", F.col("url")), "exclude_urls")
    )
    text = F.concat_ws(" ", "title", "snippet")
    flags = F.array_sort(F.concat(T.flags(text), F.when(U.is_test_host(F.col("url")), F.array(F.lit("test_host"))).otherwise(F.array().cast("array<string>"))))
    found = D.extract_date(F.coalesce("snippet", F.lit("")), F.col("url"))
    rows = rows.withColumns({"refused": refused, "unknown_kept": windowed & day.isNull(), "flags": flags, "found": found, "undated": day.isNull()})
    return rows.select(
        "question_id", "arrival_seq", "engine", "position", "url", "canonical", "refused", "unknown_kept", "flags", "modified_at",
        T.sanitize(F.coalesce("title", F.lit("")), TITLE_CHARS).alias("title"), T.sanitize(F.coalesce("snippet", F.lit("")), SNIPPET_CHARS).alias("snippet"), F.coalesce("published_at", "found.day").alias("published_at"),
        F.when(F.col("undated") & F.col("found.day").isNotNull(), F.col("found.evidence")).otherwise(F.coalesce("date_evidence", F.lit(""))).alias("date_evidence"),
        F.when(F.col("undated") & F.col("found.day").isNotNull(), "publication").otherwise(F.coalesce("date_kind", F.lit(""))).alias("date_kind"),
    )


def gathered(kept: DataFrame, about: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with `page`, log): the canonical URL of the page that each hit counts for. Pages with alike titles on one host
    join the first; for questions about news, copies of wire stories then join the most credible one."""
    pages = kept.groupBy("question_id", "canonical").agg(F.min(F.struct("arrival_seq", "url", "title")).alias("first")).select("question_id", "canonical", "first.*").checkpoint()
    near = R.near_titles(pages).checkpoint()
    leads = near.where("canonical = kept").select("question_id", "canonical").join(pages, ["question_id", "canonical"])
    wire = leads.join(about.where("news").select("question_id"), "question_id", "left_semi").select("question_id", F.col("arrival_seq").alias("place"), "url", "title")
    moved = E.syndicated(wire).checkpoint()
    by_url = lambda name, as_: pages.select("question_id", F.col("url").alias(name), F.col("canonical").alias(as_))
    final = E.last_kept(moved).join(by_url("url", "kept_first"), ["question_id", "url"]).join(by_url("kept", "final"), ["question_id", "kept"]).select("question_id", F.col("kept_first").alias("kept"), "final")
    home = near.join(final, ["question_id", "kept"], "left").select("question_id", "canonical", F.coalesce("final", "kept").alias("page"))
    log = E.merge_log(kept, near).select("question_id", "reason", "kept", "merged")
    log = log.unionByName(moved.select("question_id", F.lit("syndication").alias("reason"), "kept", F.col("url").alias("merged")))
    return kept.join(home, ["question_id", "canonical"]), log


def page_facts(hits: DataFrame) -> DataFrame:
    """A row for each question and page: URL of its own first hit, longest title (ties: own hits first, then arrival), first
    date, best position of each engine, flags, and what its dates are. Two aggregations on one key: hits of an engine come
    together first, so that a page of many hits is a few rows."""
    own = F.col("canonical") == F.col("page")
    order = F.struct((~own).alias("other"), "arrival_seq")
    level = F.when(F.col("published_at").isNotNull(), E.date_confidence(F.col("date_evidence"))).otherwise(0)
    title = F.struct(F.length("title").alias("n"), own.alias("own"), (-F.col("arrival_seq")).alias("s"), "title")
    by_engine = hits.groupBy("question_id", "page", "engine").agg(
        F.min("position").alias("rank"), F.count("*").alias("n"), F.min("published_at").alias("day"), F.min(F.struct(order.alias("o"), "url")).alias("first"), F.max(title).alias("longest"),
        F.max(level).alias("level"), F.collect_set(F.when(F.size("flags") > 0, F.col("flags"))).alias("flagged"), F.min(F.when(F.col("modified_at").isNotNull(), F.struct(order.alias("o"), "modified_at"))).alias("changed"),
        F.min(F.when(F.col("date_kind") != "", F.struct((F.col("date_kind") != "publication").alias("later"), order.alias("o"), "date_kind"))).alias("dated_as"),
        F.min(F.when(F.col("date_evidence") != "", F.struct(order.alias("o"), "date_evidence"))).alias("shown"),
    )
    return by_engine.groupBy("question_id", "page").agg(
        F.min("first").alias("first"), F.max("longest").alias("longest"), F.min("day").alias("published_at"), F.min("rank").alias("best_rank"), F.sum("n").alias("hits"), F.max("level").alias("level"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("engine", "rank")))).alias("engine_ranks"), F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_list("flagged"))))).alias("flags"),
        F.min("changed").alias("changed"), F.min("dated_as").alias("dated_as"), F.min("shown").alias("shown"),
    ).select(
        "question_id", F.col("page").alias("canonical"), F.col("first.url").alias("url"), F.col("longest.title").alias("title"), "published_at", "best_rank", "hits", "engine_ranks", "flags", "level",
        F.col("changed.modified_at").alias("modified_at"), F.coalesce("dated_as.date_kind", F.lit("")).alias("date_kind"), F.coalesce("shown.date_evidence", F.lit("")).alias("date_evidence"),
    )


def scored(groups: DataFrame, about: DataFrame, today: Column) -> DataFrame:
    """Pages with factors and score: relevance with what the question's kind, wanted sources and place give or take; the
    profile for news where it asks for news, with neutral freshness where that is old. `groups` has page_facts() and snippet."""
    engines = groups.select("question_id", F.explode(F.map_keys("engine_ranks")).alias("e")).groupBy("question_id").agg(F.countDistinct("e").alias("engines"))
    g = groups.join(about.select("question_id", "question", "kind", "news", "old", "cap", "q_terms", "phrases", "wants", "place_of"), "question_id").join(engines, "question_id")
    url = F.col("url")
    bonus = Q.kind_bonus(F.col("wants"), Q.source_kinds(url, F.col("title")))
    g = g.withColumn("relevance", C.relevance(F.col("best_rank"), F.col("title"), F.col("snippet"), F.col("question"), F.col("q_terms"), F.col("phrases"), url, F.col("kind"), bonus))
    g = g.withColumn("relevance", C.round4(F.least(F.lit(1.0), F.col("relevance") * Q.intent_multiplier(url, F.col("kind"), F.col("place_of.suffixes"), F.col("place_of.domains")))))
    for sign in (F.exists("flags", lambda f: f.startswith("prompt_injection:")), F.array_contains("flags", "test_host")):
        g = g.withColumn("relevance", F.when(sign, C.round4(F.col("relevance") * C.FLAGGED_FACTOR)).otherwise(F.col("relevance")))
    day = F.col("published_at")
    fresh = F.when(F.col("old"), C.NEUTRAL).when(F.col("news"), C.freshness(day, today, C.NEWS_HALF_LIFE_DAYS)).otherwise(C.freshness(day, today))
    g = g.withColumns({"authority": U.authority(url), "agreement": C.round4(F.size("engine_ranks") / F.col("engines")), "source_quality": C.round4(U.source_quality(url)), "freshness": C.gated_freshness(F.col("relevance"), fresh)})
    by = lambda weights: C.combine({name: F.col(name) for name in weights}, weights)
    g = g.withColumn("score", F.when(F.col("news"), by(C.NEWS_WEIGHTS)).otherwise(by(C.WEIGHTS)))
    confidence = F.element_at(F.array(F.lit(""), F.lit("low"), F.lit("medium"), F.lit("high")), F.col("level") + 1)
    return g.withColumn("date_confidence", F.when(F.col("news"), confidence).otherwise("")).drop("level", "q_terms", "phrases", "wants", "place_of", "engines", "old", "question")


def search(hits: DataFrame, questions: DataFrame, today: Column, k: int = 8, pages: DataFrame | None = None, outcomes: DataFrame | None = None) -> Found:
    """Ranked results of all questions from what engines found for them.

    `hits` has question_id, arrival_seq (unique in a question), engine, position,
    title, url, snippet, published_at and may have HIT_OPTIONS. `pages` (url,
    content, published_at), where given, are read for the first results on news.
    `outcomes` (question_id, status) tells engines that failed from those that
    found nothing. A question without hits has a row in the report. Needs a
    folder for checkpoints; hits, groups and what was merged are cut there.
    """
    about = asked(questions, today, k).checkpoint()
    questions = about.select("question_id", "question")
    all_hits = judged(hits, about).checkpoint()
    kept, log = gathered(all_hits.where("refused IS NULL"), about)
    log = log.checkpoint()
    snippets = E.best_snippets(kept.drop("canonical").withColumnRenamed("page", "canonical"), questions)
    groups = page_facts(kept).join(snippets, ["question_id", "canonical"], "left").withColumn("snippet", F.coalesce("snippet", F.lit(""))).checkpoint()
    encyclopaedic = U.domain(F.col("url")).endswith(C.ENCYCLOPEDIA)
    best = R.top_k(scored(groups, about, today), k, capped=encyclopaedic, cap=F.col("cap"))
    if pages is not None:
        best = _read(best.checkpoint(), pages, questions, today)
    best = best.checkpoint()
    return Found(best.drop("cap"), log, _report(all_hits, groups, best, log, about, questions, k, outcomes, encyclopaedic))


def _read(best: DataFrame, pages: DataFrame, questions: DataFrame, today: Column) -> DataFrame:
    """Results of news questions held against their pages, the others as they are."""
    news = best.where("news")
    told = E.verified(news, pages, questions, today).withColumnsRenamed({"confidence": "sure"})
    own = news.drop("published_at", "score", "place").join(told, ["question_id", "url"]).withColumn("date_confidence", F.when(F.col("sure") != "", F.col("sure")).otherwise(F.col("date_confidence"))).drop("sure")
    return own.unionByName(best.where("NOT news"), allowMissingColumns=True)


def _report(all_hits: DataFrame, groups: DataFrame, best: DataFrame, log: DataFrame, about: DataFrame, questions: DataFrame, k: int, outcomes: DataFrame | None, encyclopaedic: Column) -> DataFrame:
    refused = F.col("refused")
    per_hit = all_hits.groupBy("question_id").agg(
        F.count("*").alias("hits"), F.count_if(refused == "non_public").alias("non_public"), F.count_if(refused.isNotNull() & ~refused.isin("non_public", "exclude_urls")).alias("dropped"),
        F.count_if(refused == "exclude_urls").alias("excluded_seen"), F.count_if(F.col("unknown_kept") & F.coalesce(~refused.isin("non_public", "include_domains", "site_operator", "exclude_domains", "file_type", "unknown_date"), F.lit(True))).alias("date_unknown_kept"))
    merges = log.where("reason <> 'canonical_url'").groupBy("question_id").agg(F.count("*").alias("page_merges"))
    same = log.where("reason = 'canonical_url'").groupBy("question_id").agg(F.count("*").alias("hit_merges"))
    hubs = groups.groupBy("question_id").agg(F.count("*").alias("groups"), F.count_if(encyclopaedic).alias("hubs"))
    ranked = best.groupBy("question_id").agg(F.count("*").alias("results"), F.count("published_at").alias("dated"))
    covered = R.coverage(best, questions).select("question_id", F.col("status").alias("coverage"))
    rows = about.select("question_id", "kind", "news")
    for more in (per_hit, merges, same, hubs, ranked, covered):
        rows = rows.join(more, "question_id", "left")
    if outcomes is not None:
        ended = outcomes.groupBy("question_id").agg(F.max(F.col("status").isin("results", "empty")).alias("answered"), F.max(F.col("status").isin("failed", "skipped")).alias("failed"))
        rows = rows.join(ended, "question_id", "left")
    else:
        rows = rows.withColumns({"answered": F.lit(True), "failed": F.lit(False)})
    rows = rows.fillna(0).fillna(False, ["answered", "failed"]).fillna("unknown", ["coverage"])
    n = F.col("results")
    reason = (
        F.when((n > 0) & (F.col("coverage") == "low"), "low_coverage").when(n > 0, "none")
        .when(~F.col("answered") & F.col("failed"), "engines_failed").when(F.col("hits") > 0, "filtered_out").otherwise("no_results")
    )
    merged = F.col("page_merges") + F.col("hit_merges")
    shortfall = (
        F.when((n == 0) | (n >= k), "").when(F.col("kind").isin(*C.PARTICULAR) & (F.col("hubs") > 1), "capped")
        .when((merged > 0) & (merged >= k - n), "deduped").when(F.col("dropped") > 0, "filtered").otherwise("exhausted")
    )
    return rows.withColumns({"reason": reason, "shortfall": shortfall}).drop("answered", "failed")
