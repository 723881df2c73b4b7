"""Evidence operators that SQL can't say, against plain Python on small tables; markdown of whole pages."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from quarrylake.functions import html, request, text, verdicts
from quarrylake.operators import evidence, greedy, ranking
from quarrylake.plans.inputs import checkpoints

RESULTS = "question_id long, place long, url string, title string"


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


QUALITY = {"nasa.gov": 0.95, "reuters.com": 0.85, "one.example": 0.5, "two.example": 0.5, "six.test": 0.5}


def _syndicated(rows, threshold):
    """Pairs one by one, the first in order, until none is left."""
    wanted, host = {}, lambda r: r[2].split("/")[2]
    terms = lambda r: {w for w in r[3].split() if len(w) > 2}
    for q in {r[0] for r in rows}:
        left = [r for r in rows if r[0] == q]
        while True:
            pair = next(((a, b) for i, a in enumerate(left) for b in left[i + 1 :] if host(a) != host(b) and _jaccard(terms(a), terms(b)) >= threshold), None)
            if pair is None:
                break
            keep, drop = pair if QUALITY[host(pair[0])] >= QUALITY[host(pair[1])] else pair[::-1]
            left.remove(drop)
            wanted[q, drop[2]] = keep[2]
    return wanted


@pytest.mark.parametrize("threshold,count", [(0.8, 9), (0.5, 7)])
def test_syndication_is_a_fixed_point(spark, threshold, count):
    rnd = random.Random(3)
    words = "flood water rise old river town night bank rate cut".split()
    rows = [(q, p, f"https://{rnd.choice(list(QUALITY))}/{q}-{p}", " ".join(rnd.sample(words, count))) for q in range(5) for p in range(14)]
    wanted = _syndicated(rows, threshold)
    checkpoints(spark)
    table = spark.createDataFrame(rows, RESULTS)
    moved = evidence.syndicated(table, threshold)
    assert {(r.question_id, r.url): r.kept for r in moved.collect()} == wanted and len(wanted) > 10
    assert evidence.syndicated(table.where("false")).count() == 0
    groups = table.selectExpr("question_id", "url AS canonical", "place AS arrival_seq", "url", "'' AS snippet", "title", "IF(place % 2 = 0, NULL, date_add(DATE '2026-01-01', CAST(place AS INT))) AS published_at", "CAST(place AS INT) AS best_rank", "1L AS hits", "map(concat('e', place % 3), CAST(place AS INT)) AS engine_ranks")
    merged, log = evidence.merge_syndicated(groups, moved)

    def end(q, url):
        while (q, url) in wanted:
            url = wanted[q, url]
        return url

    hits = {}
    for q, p, url, _ in rows:
        hits.setdefault((q, end(q, url)), []).append((p, url))
    for r in merged.collect():
        mine = hits.pop((r.question_id, r.url))
        ranks = {f"e{k}": min(p for p, _ in mine if p % 3 == k) for k in {p % 3 for p, _ in mine}}
        own = next(p for p, u in mine if u == r.url)
        dated = [own] if own % 2 else [p for p, _ in mine if p % 2]
        day = datetime.date(2026, 1, 1) + datetime.timedelta(min(dated)) if dated else None
        assert (r.hits, r.best_rank, r.engine_ranks, r.published_at) == (len(mine), min(p for p, _ in mine), ranks, day)
    assert not hits and log.count() == len(wanted)


@pytest.mark.parametrize("threshold", [0.5, 0.85])
def test_leaders_against_a_loop(spark, threshold):
    rnd = random.Random(7)
    rows = [(i % 2, i, f"r{i}", rnd.sample("abcdefgh", rnd.randrange(0, 6))) for i in range(120)]
    table = spark.createDataFrame(rows, "b int, o long, id string, w array<string>")
    found = {r.id: r.leader for r in greedy.grouped(table, ["b"], "o", "id", F.col("w"), threshold).collect()}
    wanted, leaders = {}, []
    for b, _, name, words in rows:
        hit = next((x for c, x, ws in leaders if c == b and _jaccard(ws, set(words)) >= threshold), None)
        wanted[name] = hit or name
        if hit is None:
            leaders.append((b, name, set(words)))
    assert found == wanted


def test_merges_are_told(spark):
    rows = [(1, 1, "https://a.org/x?utm_source=1", "One two three four"), (1, 2, "https://a.org/x", "One two three four"), (1, 3, "https://a.org/y", "One two three four five"), (1, 4, "https://b.org/y", "One two three four"), (1, 5, None, "none")]
    hits = spark.createDataFrame(rows, "question_id long, arrival_seq long, url string, title string").withColumn("canonical", F.regexp_replace("url", r"\?.*", "")).withColumns({"engine": F.lit("e"), "position": F.lit(1), "snippet": F.lit(""), "published_at": F.lit(None).cast("date")})
    near = spark.createDataFrame([(1, "https://a.org/x", "https://a.org/x"), (1, "https://a.org/y", "https://a.org/x")], "question_id long, canonical string, kept string")
    found = sorted((r.reason, r.kept, r.merged, r.similarity) for r in evidence.merge_log(hits, near).collect())
    assert found == [("canonical_url", rows[0][2], "https://a.org/x", None), ("near_duplicate", rows[0][2], "https://a.org/y", 0.8)]


def test_pages_correct_the_dates_of_news(spark):
    day = datetime.date
    factors = "relevance double, authority double, agreement double, source_quality double, freshness double, score double"
    results = spark.createDataFrame([(1, 1, "u1", day(2026, 1, 1), 0.9, 0.5, 1.0, 0.5, 0.1, 0.6), (1, 2, "u2", day(2026, 1, 2), 0.5, 0.5, 1.0, 0.5, 0.1, 0.5), (1, 3, "u3", None, 0.5, 0.5, 1.0, 0.5, 0.5, 0.4), (1, 4, "u4", None, 0.5, 0.5, 1.0, 0.5, 0.5, 0.3)], f"question_id long, place int, url string, published_at date, {factors}")
    pages = spark.createDataFrame([("u1", "river flood town", day(2026, 1, 1)), ("u2", "nothing of it", day(2026, 6, 1)), ("u4", "river flood", day(2026, 6, 1))], "url string, content string, published_at date")
    asked = spark.createDataFrame([(1, "river flood")], "question_id long, question string")
    found = {r.url: r for r in evidence.verified(results, pages, asked, F.lit("2026-06-01").cast("date")).collect()}
    assert (found["u1"].read, found["u1"].topic_match, found["u1"].corroborated, found["u1"].confidence) == (True, True, True, "high")
    assert (found["u2"].read, found["u2"].topic_match, found["u2"].published_at) == (True, False, day(2026, 6, 1))
    assert found["u2"].score == pytest.approx(0.40 * 0.5 + 0.35 * 1.0 + 0.08 * 0.5 + 0.07 * 1.0 + 0.10 * 0.5) and found["u2"].place == 1
    assert (found["u3"].read, found["u4"].read, found["u4"].score) == (False, False, 0.3)


def test_news_profile(spark):
    scored = spark.createDataFrame([(1, "https://a.org/", 0.2, 0.5, 1.0, datetime.date(2026, 6, 1)), (1, "https://b.org/", 0.8, 0.5, 1.0, datetime.date(2026, 5, 25))], "question_id long, url string, relevance double, authority double, agreement double, published_at date").withColumn("score", F.lit(0.0))
    found = {r.url: r for r in evidence.news_scored(scored, F.lit("2026-06-01").cast("date")).collect()}
    assert found["https://a.org/"].freshness == 0.5 and found["https://b.org/"].freshness == 0.5
    q = found["https://b.org/"].source_quality
    assert found["https://b.org/"].score == pytest.approx(0.40 * 0.8 + 0.35 * 0.5 + 0.08 * 0.5 + 0.07 + 0.10 * q, abs=1e-4)


def test_markdown_of_a_page():
    page = """<html><head><title>T</title><style>x</style></head><body><nav><a href="/">Home</a></nav><div id="content"><h1>Head</h1><p>A <b>bold</b> <a href="/x">link</a> and <code>f(x)</code>.</p>
<ol><li>one</li><li>two<ul><li>inner</li></ul></li></ol><pre>a
  b</pre><img src="p.png" alt="A  picture"><table><tr><th>k</th><th>v|w</th></tr><tr><td>1</td><td>2</td></tr></table><p>""" + "Some prose that goes on for long enough to be the main content of this page. " * 6 + """</p></div><footer>Foot</footer></body></html>"""
    lines = html.markdown(page).split("\n\n")
    assert lines[:2] == ["# Head", "A **bold** [link](/x) and `f(x)`."]
    assert lines[2:5] == ["1. one", "2. two", "- inner"]
    assert lines[5] == "```\na\n  b\n```" and lines[6] == "![A picture](p.png)"
    assert lines[7] == "| k | v\\|w |\n| --- | --- |" and lines[8] == "| 1 | 2 |"
    assert not any("Home" in x or "Foot" in x for x in lines)
    assert html.markdown(None) == "" == html.markdown("<p>") and html.markdown("<table><td>x") == "x"


def test_pdf_texts_join_words(spark):
    rows = spark.createDataFrame([(1, "ex-\nample"), (2, "a­b ﬁt"), (3, None), (4, "end-\n")], "id int, t string")
    assert {r.id: r.t for r in rows.select("id", verdicts.pdf_text(F.col("t")).alias("t")).collect()} == {1: "example", 2: "ab fit", 3: "", 4: "end-"}


def _place(phrase, t):
    return [m.start() + 1 for m in re.finditer(re.escape(phrase.lower()), t.lower())][:50]


def test_phrases_in_pages(spark):
    rows = [(1, "The end of the lathe", "the"), (2, "x" * 300 + "a.b" + "y" * 300 + "A.B", "a.b"), (3, "", "q"), (4, "aaaa" * 40, "aa"), (5, r"a \E b \e", r"\E")]
    table = spark.createDataFrame(rows, "id int, t string, p string")
    found = {r.id: [(x.at, x.context) for x in r.f] for r in table.select("id", text.found_in_page(F.col("t"), F.col("p")).alias("f")).collect()}
    for i, t, p in rows:
        assert found[i] == [(at, t[max(0, at - 101) : at - 1 + len(p) + 100]) for at in _place(p, t)]


def test_requests_of_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "   "), (4, "tea"), (5, "official documentation")], "id int, q string")
    found = {r.id: tuple(r.s) for r in rows.select("id", request.split_subject(F.col("q")).alias("s")).collect()}
    assert found == {1: ("", ""), 2: ("", ""), 3: ("", ""), 4: ("tea", ""), 5: ("official documentation", "")}


def test_snippets_speak_to_the_question(spark):
    rows = [(1, 1, "p", "Find Stripe fees and pricing information"), (1, 2, "p", "Stripe fees: 2.9% + 30c"), (1, 3, "q", "nothing here"), (1, 4, "q", "nothing at all here"), (2, 5, "p", "long words only"), (1, 6, None, "x")]
    hits = spark.createDataFrame(rows, "question_id long, arrival_seq long, canonical string, snippet string")
    asked = spark.createDataFrame([(1, "stripe fees pricing"), (2, "a b")], "question_id long, question string")
    found = {(r.question_id, r.canonical): r.snippet for r in evidence.best_snippets(hits, asked).collect()}
    assert found == {(1, "p"): "Stripe fees: 2.9% + 30c", (1, "q"): "nothing at all here", (2, "p"): "long words only"}
    assert ranking.near_titles(ranking.merge_canonical(spark.createDataFrame([], "question_id long, arrival_seq long, engine string, position int, title string, url string, snippet string, published_at date"))).count() == 0


def test_copies_of_a_story_are_no_pairs(spark):
    """Titles that come again and again, also with a word repeated, on hosts of several qualities, interleaved with alike ones."""
    rnd = random.Random(5)
    titles = ["flood water rise old river", "flood water rise old town", "bank rate cut", "bank bank bank bank bank rate", "rate"]
    rows = [(q, p, f"https://{rnd.choice(list(QUALITY))}/{q}-{p}", rnd.choice(titles)) for q in range(4) for p in range(45)]
    checkpoints(spark)
    moved = evidence.syndicated(spark.createDataFrame(rows, RESULTS), 0.5)
    assert {(r.question_id, r.url): r.kept for r in moved.collect()} == _syndicated(rows, 0.5)
    seen, alike_pairs = [], greedy.alike_pairs
    greedy.alike_pairs = lambda nodes, threshold: seen.append(nodes.count()) or alike_pairs(nodes, threshold)
    try:
        evidence.syndicated(spark.createDataFrame([(1, p, f"https://{'one' if p % 3 else 'two'}.example/{p}", titles[p % 2]) for p in range(400)], RESULTS), 0.5)
    finally:
        greedy.alike_pairs = alike_pairs
    assert seen == [2]


def test_alike_pairs_are_all_found_and_few_meet(spark):
    """All pairs of sets by brute force, repeated words too; and, of a small vocabulary, few sets meet that aren't alike."""
    rnd = random.Random(8)
    rows = [(b, p, [rnd.choice("abcdefg") for _ in range(rnd.randrange(0, 7))]) for b in range(3) for p in range(40)] + [(0, 100, ["a"] * 9 + ["z"]), (0, 101, ["z"]), (0, 102, ["z", "z", "y"])]
    table = spark.createDataFrame(rows, "block long, p long, words array<string>").select("block", F.struct("block", "p").alias("node"), "words")
    for threshold in (0.3, 0.5, 0.85, 1.0):
        wanted = {(b, p, q) for b, p, x in rows for c, q, y in rows if b == c and p < q and _jaccard(set(x), set(y)) >= threshold}
        found = greedy.alike_pairs(table, threshold).collect()
        assert {(r.a.block, r.a.p, r.b.p) for r in found} == wanted and len(found) == len(wanted)
    words = [f"w{k}" for k in range(300)]
    many = spark.createDataFrame([(0, p, rnd.sample(words, 8)) for p in range(3000)], "block long, node long, words array<string>")
    assert greedy.meeting(many, 0.5).count() < 60_000
