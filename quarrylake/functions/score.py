"""Scores of ranking and evidence, as expressions. Sums and weights are those of fixed profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from . import url as U

# Fixed values.
WEIGHTS = {"relevance": 0.4, "authority": 0.2, "freshness": 0.2, "agreement": 0.2}
NEWS_WEIGHTS = {"relevance": 0.40, "freshness": 0.35, "authority": 0.08, "agreement": 0.07, "source_quality": 0.10}
HALF_LIFE_DAYS, NEWS_HALF_LIFE_DAYS, NEUTRAL = 365.0, 7.0, 0.5
GATE_FLOOR, FLAGGED_FACTOR = 0.30, 0.5
EVIDENCE = {"relevance": 0.5, "quality": 0.3, "recency": 0.2}
INJECTION_PENALTY = 0.2
HUB_TITLES = ["list of ", "category:", "portal:", "index of "]
DICTIONARIES = ["merriam-webster.com", "dictionary.cambridge.org", "dictionary.com", "thefreedictionary.com", "lexico.com"]
ENCYCLOPEDIA = "wikipedia.org"
#: Kinds of answers that an encyclopaedia gives, and kinds that it doesn't.
DEFINING = ("definition", "entity_lookup")
PARTICULAR = ("procedure", "statistic", "current_event", "comparison", "error")


def round4(x: Column) -> Column:
    """Half up at the fourth place, by the same arithmetic on all engines."""
    return F.floor(x * 10000 + 0.5) / 10000


def specificity(url: Column, title: Column, question: Column, terms: Column, kind: Column | None = None) -> Column:
    """Below one for hubs, disambiguations, bare home pages and dictionaries; with the kind of answer that is asked for
    (intent.answer_type) also for encyclopaedia pages where it is none of theirs."""
    low, path = F.lower(F.trim(title)), U.path(url)
    hub = low.startswith(HUB_TITLES[0])
    for p in HUB_TITLES[1:]:
        hub = hub | low.startswith(p)
    definition = F.lower(F.trim(question)).rlike("^(what does|meaning of|define |definition of)")
    out = F.when(hub & ~F.array_contains(terms, "list"), 0.65).otherwise(1.0)
    out = out * F.when(low.contains("disambiguation") | F.lower(path).contains("disambiguation"), 0.6).otherwise(1.0)
    out = out * F.when(path.rlike("^/*$") & (F.size(terms) >= 3), 0.8).otherwise(1.0)
    dictionary = U.domain(url).isin(DICTIONARIES)
    if kind is not None:
        definition = definition | kind.isin(*DEFINING)
        dictionary = dictionary | U.domain(url).endswith(".dictionary.cambridge.org")
        out = out * F.when(U.domain(url).endswith(ENCYCLOPEDIA) & kind.isin(*PARTICULAR), 0.65).otherwise(1.0)
    return out * F.when(dictionary & ~definition, 0.5).otherwise(1.0)


def overlap(question_terms: Column, text: Column) -> Column:
    return F.when(F.size(question_terms) > 0, F.size(F.array_intersect(question_terms, T.terms(text))) / F.size(question_terms)).otherwise(F.lit(0.0))


def relevance(best_rank: Column, title: Column, snippet: Column, question: Column, q: Column, phrases: Column, url: Column, kind: Column | None = None, bonus: Column | None = None) -> Column:
    """Half the reciprocal rank and half the overlap of terms (with quoted phrases less, for the phrases found), times specificity.

    q and phrases are the question's terms and quoted phrases, which are worked out once for each question;
    kind is the answer's, bonus what a page gains for being of a kind that the question asks for.
    """
    in_title, in_snippet = overlap(q, title), overlap(q, snippet)
    lap = F.when(F.trim(snippet) != "", 0.4 * in_title + 0.6 * in_snippet).otherwise(in_title)
    hay = F.lower(F.concat(title, F.lit(" "), snippet))
    found = F.size(F.filter(phrases, lambda p: F.contains(hay, F.lower(p))))
    rank = 1.0 / F.greatest(best_rank, F.lit(1))
    base = F.when(F.size(phrases) > 0, 0.5 * rank + 0.35 * lap + 0.15 * found / F.greatest(F.size(phrases), F.lit(1))).otherwise(0.5 * rank + 0.5 * lap)
    if bonus is not None:
        base = F.least(F.lit(1.0), base) + bonus
    return round4(F.least(F.lit(1.0), F.least(F.lit(1.0), base) * specificity(url, title, question, q, kind)))


def freshness(published: Column, today: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    age = F.greatest(F.datediff(today, published), F.lit(0))
    return F.when(published.isNull(), NEUTRAL).otherwise(round4(F.pow(F.lit(0.5), age / half_life)))


def gated_freshness(rel: Column, fresh: Column) -> Column:
    """Freshness can't lift what isn't relevant."""
    return F.when(rel >= GATE_FLOOR, fresh).otherwise(F.least(fresh, F.lit(NEUTRAL)))


def combine(factors: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    total = sum(weights.values())
    return round4(sum((c * weights.get(k, 0.0) for k, c in factors.items()), F.lit(0.0)) / total)


def evidence_score(rel: Column, quality: Column, recency: Column, flagged: Column) -> Column:
    raw = (rel * EVIDENCE["relevance"] + quality * EVIDENCE["quality"] + recency * EVIDENCE["recency"]) / sum(EVIDENCE.values())
    return round4(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw - F.when(flagged, INJECTION_PENALTY).otherwise(0.0))))
