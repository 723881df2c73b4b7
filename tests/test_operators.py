"""Operators that SQL can't say, against plain Python on small tables; nulls, empty tables and clashing names."""

import datetime
import random
import re

from pyspark.sql import functions as F

from quarrylake.functions import html, text, url
from quarrylake.operators import ranking, research, state

HITS = "question_id long, arrival_seq long, engine string, position int, title string, url string, snippet string, published_at date"


def _words(t):
    return set(re.findall(r"\w+", t.lower()))


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_near_titles_against_a_loop(spark):
    rnd = random.Random(2)
    words = "solar panel output falls rises today again and once more".split()
    rows = [(i % 3, i, "e", 1, " ".join(rnd.sample(words, 8)), f"https://{"ab"[i % 2]}.org/p{i}x", "", None) for i in range(60)]
    groups = ranking.merge_canonical(spark.createDataFrame(rows, HITS))
    found = {(r.question_id, r.canonical): r.kept for r in ranking.near_titles(groups, 0.7).collect()}
    wanted, kept = {}, {}
    for q, i, _, _, title, link, _, _ in rows:
        for other, words_of in kept.setdefault((q, link[8]), []):
            if _jaccard(words_of, _words(title)) >= 0.7:
                wanted[q, link] = other
                break
        else:
            kept[q, link[8]].append((link, _words(title)))
            wanted[q, link] = link
    assert found == wanted


def test_stories_compare_the_first_three_members(spark):
    day = datetime.date(2026, 1, 1)
    titles = ["Floods displace thousands in delta region", "Thousands displaced as flood hits delta region", "Bank raises key rate by half", "Flood displaces thousands in delta region now"]
    rows = [(1, f"https://x{i}.org/", f"https://x{i}.org/", t, 0.9 - i / 10, day if i != 3 else datetime.date(2026, 3, 1)) for i, t in enumerate(titles)]
    results = spark.createDataFrame(rows, "question_id long, url string, canonical string, title string, score double, published_at date")
    grouped = {r.url: r.story for r in ranking.stories(results).collect()}
    assert grouped["https://x0.org/"] == grouped["https://x1.org/"] != grouped["https://x2.org/"]
    assert grouped["https://x3.org/"] not in (grouped["https://x0.org/"], grouped["https://x2.org/"])
    facts = ranking.story_facts(results, ranking.stories(results)).collect()
    assert max(r.story_count for r in facts) == 2


def test_confidence_of_known_cases(spark):
    rows = [(1, 1, "a.org", ["solar", "panel"], ["22"], False, 0.8, "a"), (2, 2, "b.org", ["solar", "panel"], ["22"], False, 0.6, "b")]
    found = spark.createDataFrame(rows, "claim_id long, source_id long, domain string, subject_terms array<string>, numbers array<string>, negated boolean, source_score double, text string").withColumn("report", F.lit(1))
    none = research.contradictions(found)
    assert none.count() == 0
    one = research.statements(found, research.cluster_claims(found, "report"), none.select(F.col("a").alias("claim_id")), "report").first()
    assert (one.status, one.confidence, one.domains) == ("corroborated", 0.35, 2)


def test_contradictions_against_all_pairs(spark):
    rnd = random.Random(4)
    terms = [f"t{i}" for i in range(9)]
    rows = [(i, rnd.randrange(20), rnd.choice("abc"), sorted(rnd.sample(terms, rnd.randint(0, 5))), [rnd.choice("123")] if rnd.random() < 0.6 else [], rnd.random() < 0.3) for i in range(120)]
    found = spark.createDataFrame(rows, "claim_id long, source_id long, domain string, subject_terms array<string>, numbers array<string>, negated boolean")
    got = {(r.a, r.b): r.kind for r in research.contradictions(found).collect()}
    wanted = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] != b[1] and a[2] != b[2] and _jaccard(set(a[3]), set(b[3])) >= 0.6:
                kind = "numeric_mismatch" if a[4] and b[4] and not set(a[4]) & set(b[4]) else "negation_mismatch" if a[5] != b[5] else None
                if kind:
                    wanted[a[0], b[0]] = kind
    assert got == wanted


def test_empty_tables(spark):
    hits = spark.createDataFrame([], HITS)
    groups = ranking.merge_canonical(hits)
    questions = spark.createDataFrame([(1, "q")], "question_id long, question string")
    scored = ranking.score_groups(groups, questions, F.lit("2026-01-01").cast("date"))
    assert ranking.top_k(scored, 5).count() == ranking.near_titles(groups).count() == ranking.stories(scored).count() == 0
    assert ranking.coverage(groups, questions).first().matched == 0
    log = spark.createDataFrame([], "key long, at double, seq long, ok boolean, value double")
    for out in (state.breaker(log), state.smoothed_latency(log), state.pacing(log, 1.0, "key"), state.cache_hits(log, 1.0), state.failure_runs(log)):
        assert out.count() == 0


def test_null_texts(spark):
    one = spark.createDataFrame([(None,), ("",)], "x string")
    x = F.col("x")
    for made in (text.tokens(x), text.sentences(x), text.content_terms(x), text.sanitize(x), url.canonical(x), url.is_public(x), text.longest_link_run(x), html.to_markdown(x)):
        assert one.select(made.alias("y")).count() == 2
    assert [r.y for r in one.select(url.canonical(x).alias("y")).collect()] == [None, None]


def test_smoothing_is_the_recurrence(spark):
    rnd = random.Random(1)
    values = [0.0, 0.0] + [rnd.choice([0.0, rnd.random() * 10]) for _ in range(200)]
    log = spark.createDataFrame([(1, float(i), i, v) for i, v in enumerate(values)], "key long, at double, seq long, value double")
    wanted = 0.0
    for v in values:
        wanted = wanted if v == 0 else v if wanted == 0 else 0.25 * v + 0.75 * wanted
    assert abs(state.smoothed_latency(log).first().ewma - wanted) < 1e-9


def test_main_content():
    page = "<html><head><title>T</title></head><body><nav><a href='/x'>Menu</a></nav><main><h1>Head</h1><p>" + "A sentence of some words that reads as prose does. " * 8 + "<a href='/y'>link</a></p></main><footer>foot</footer></body></html>"
    made = html.markdown(page)
    assert made.startswith("# Head") and "Menu" not in made and "foot" not in made and "[link](/y)" in made
    assert html.markdown("<p>a<b>c") == "a**c" and html.markdown(None) == "" and html.markdown("<<>>") is not None
