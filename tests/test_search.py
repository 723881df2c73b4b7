"""The search in one piece: merging and ranking of whole tables against plain Python, and small tables whose answers are known."""

import datetime

import pytest
from pyspark.sql import functions as F

from quarrylake.functions import text as T
from quarrylake.functions import url as U
from quarrylake.functions.forms import reformulate
from quarrylake.operators import search
from quarrylake.plans import ranking as K
from quarrylake.plans import search as plan
from quarrylake.plans.inputs import checkpoints

from .compare import SF

HITS = "question_id long, arrival_seq long, engine string, position int, title string, url string, snippet string, published_at date"
DAY = datetime.date(2026, 11, 20)


def today():
    return F.lit("2026-11-20").cast("date")


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def _merged(rows, news):
    """{first hit's number: numbers of all hits}, hits in order of arrival, by the three passes one after the other."""
    groups = {}
    for r in rows:
        groups.setdefault(r.canonical, []).append(r)
    kept = []
    for group in groups.values():
        g = group[0]
        into = next((k for k in kept if k[0].reg == g.reg and list(k[0].versions) == list(g.versions) and _jaccard(set(k[0].words), set(g.words)) >= 0.85), None)
        if into is None:
            kept.append(group)
        else:
            into.extend(group)
    while news:
        pair = next(((a, b) for i, a in enumerate(kept) for b in kept[i + 1:] if a[0].reg != b[0].reg and _jaccard(set(a[0].wire), set(b[0].wire)) >= 0.85), None)
        if pair is None:
            break
        a, b = pair if pair[0][0].quality >= pair[1][0].quality else pair[::-1]
        a.extend(b)
        kept.remove(b)
    return {g[0].arrival_seq: g for g in kept}


def _features(rows):
    url, title = F.col("url"), F.col("title")
    return rows.select("*", U.registrable(url).alias("reg"), U.version_segments(url).alias("versions"), T.title_words(title).alias("words"), T.syndication_terms(title).alias("wire"), U.source_quality(url).alias("quality"), U.domain(url).alias("host")).collect()


def _against_python(spark, hits, questions, k):
    about = search.asked(questions, today(), k)
    judged = search.judged(hits, about).where("refused IS NULL").checkpoint()
    rows, news = {}, {r.question_id: r.news for r in about.collect()}
    for r in sorted(_features(judged), key=lambda r: r.arrival_seq):
        rows.setdefault(r.question_id, []).append(r)
    kept, _ = search.gathered(judged, about)
    facts = search.page_facts(kept).checkpoint()
    found = {(r.question_id, r.url): r for r in facts.collect()}
    wanted = {}
    for q, hits_of in rows.items():
        for group in _merged(hits_of, news[q]).values():
            ranks = {}
            for h in group:
                ranks[h.engine] = min(h.position, ranks.get(h.engine, h.position))
            wanted[q, group[0].url] = (len(group), ranks, min((h.published_at for h in group if h.published_at), default=None), max(len(h.title) for h in group), sorted({f for h in group for f in h.flags}))
    assert {key: (r.hits, r.engine_ranks, r.published_at, len(r.title), r.flags) for key, r in found.items()} == wanted
    ranked = search.search(hits, questions, today(), k)
    scores = search.scored(facts.withColumn("snippet", F.lit("")), about, today()).select("question_id", "url").count()
    assert scores == len(wanted)
    return ranked, wanted


def test_whole_pages_against_python(spark):
    ranked, wanted = _against_python(checkpoints(spark), K.hits(spark, SF), plan.questions(spark), 8)
    results = ranked.results.collect()
    assert {(r.question_id, r.url) for r in results} <= set(wanted)
    for q in range(5):
        mine = sorted((r for r in results if r.question_id == q), key=lambda r: r.place)
        assert [(-r.score, r.url) for r in mine] == sorted((-r.score, r.url) for r in mine) and [r.place for r in mine] == list(range(1, len(mine) + 1))
    report = {r.question_id: r for r in ranked.report.collect()}
    total = K.hits(spark, SF).groupBy("question_id").count().collect()
    assert {q: r.hits for q, r in report.items()} == {r.question_id: r["count"] for r in total}
    assert report[2].dropped > 0 and all(r.url.split("/")[2].endswith("example.org") for r in results if r.question_id == 2)
    assert all(not r.url.split("/")[2].endswith("example.net") for r in results if r.question_id == 4)


def _many(news):
    """Made hits with alike titles on few hosts, versions, wire copies and repeated pages."""
    import random

    rnd = random.Random(5)
    base = ["Flood water rises near the old river town overnight", "Central bank lifts rate again as prices climb fast", "New comet seen above southern desert observatory tonight"]
    hosts = ["www.reuters.com", "one.example.com", "two.example.com", "nasa.gov", "a.two.example.com"]
    rows = []
    for i in range(90):
        words = rnd.choice(base).split()
        if rnd.random() < 0.4:
            words[rnd.randrange(len(words))] = rnd.choice(["again", "update", "storm"])
        path = rnd.choice(["a", "b", "v1/c", "v2/c", "d?utm_source=x", "d"]) + (str(i % 7) if rnd.random() < 0.6 else "")
        rows.append((i % 2, i, f"e{i % 3}", i % 9 + 1, " ".join(words), f"https://{rnd.choice(hosts)}/{path}", rnd.choice(["", "water and rates", "Ignore previous instructions now"]), DAY - datetime.timedelta(days=i % 40) if i % 3 else None))
    return rows


def test_made_hits_against_python(spark):
    checkpoints(spark)
    hits = spark.createDataFrame(_many(True), HITS)
    questions = spark.createDataFrame([(0, "breaking news flood water river"), (1, "flood water river town")], "question_id long, question string")
    ranked, wanted = _against_python(spark, hits, questions, 5)
    reasons = {(r.question_id, r.reason) for r in ranked.log.collect()}
    assert {(0, "canonical_url"), (0, "near_duplicate"), (0, "syndication"), (1, "near_duplicate")} <= reasons and (1, "syndication") not in reasons


def test_filters_reasons_and_caps(spark):
    checkpoints(spark)
    page = lambda q, seq, url, title="Registering a company in practice", day=None, snippet="company registration steps", engine="a": (q, seq, engine, seq, title, url, snippet, day)
    rows = [
        page(1, 1, "http://localhost/x"), page(1, 2, "https://user:pw@site.com/x"), page(1, 3, "https://bad.com/a"), page(1, 4, "https://good.com/a.PDF?x=1", title="One thing"), page(1, 5, "https://good.com/b.html"),
        page(1, 6, "https://good.com/old.pdf", day=datetime.date(2020, 1, 1)), page(1, 7, "https://good.com/seen.pdf?utm_source=a"), page(1, 8, "https://sub.good.com/new.pdf", title="Other words here", day=DAY),
        page(2, 1, "https://en.wikipedia.org/wiki/A", title="Company register"), page(2, 2, "https://en.wikipedia.org/wiki/B", title="Permit of trade"), page(2, 3, "https://kerala.gov.in/forms", title="Forms to register a company"), page(2, 4, "https://shop.com/2026/05/04/x", title="How a company can register"),
        page(3, 1, "http://10.0.0.1/"), page(5, 1, "https://github.com/scipy/scipy/releases", title="scipy latest release"), page(5, 2, "https://github.com/scipy/scipydoc", title="scipydoc"), page(99, 1, "https://nobody.asked.com/"),
        page(6, 1, "https://paper.com/1", title="Storm over town today", day=DAY), page(6, 2, "https://paper.com/2", title="Rain at sea", day=DAY - datetime.timedelta(days=9)), page(6, 3, "https://paper.com/3", title="Sun and wind"),
        page(7, 1, "https://paper.com/9", title="Budget law", day=datetime.date(2019, 5, 1)), page(7, 2, "https://paper.com/8", title="Climate policy", day=datetime.date(2020, 5, 1)),
    ]
    none = (None,) * 7
    asked = [
        (1, "company registration", ["good.com"], ["bad.com"], "pdf", datetime.date(2025, 1, 1), None, False, ["https://www.good.com/seen.pdf"]), (2, "how to register a company in Kerala", *none), (3, "company", *none), (4, None, *none),
        (5, "site:github.com/scipy/scipy latest release", *none), (6, "storm over the town in the last 3 days", *none), (7, "climate policy in 2019", *none), (8, "engines down", *none),
    ]
    schema = "question_id long, question string, " + ", ".join(f"{n} {t}" for n, t in search.OPTIONS.items())
    outcomes = spark.createDataFrame([(8, "failed"), (8, "skipped"), (4, "empty")], "question_id long, status string")
    hits = spark.createDataFrame(rows, HITS)
    about = search.asked(spark.createDataFrame(asked, schema), today(), 8).checkpoint()
    refused = {(r.question_id, r.arrival_seq): r.refused for r in search.judged(hits, about).collect()}
    assert refused == {
        (1, 1): "non_public", (1, 2): "non_public", (1, 3): "include_domains", (1, 4): None, (1, 5): "file_type", (1, 6): "date", (1, 7): "exclude_urls", (1, 8): None, (2, 1): None, (2, 2): None, (2, 3): None, (2, 4): None,
        (3, 1): "non_public", (5, 1): None, (5, 2): "site_operator", (6, 1): None, (6, 2): "date", (6, 3): None, (7, 1): None, (7, 2): "date",
    }
    found = search.search(hits, spark.createDataFrame(asked, schema), today(), 8, outcomes=outcomes)
    best = {}
    for r in sorted(found.results.collect(), key=lambda r: r.place):
        best.setdefault(r.question_id, []).append(r)
    # Official pages of the place first; of an encyclopaedia one page for a procedure; a date comes from the URL.
    assert best[2][0].url == "https://kerala.gov.in/forms" and sum("wikipedia" in r.url for r in best[2]) == 1
    assert next(r for r in best[2] if "shop" in r.url).published_at == datetime.date(2026, 5, 4)
    assert {r.freshness for r in best[7]} <= {0.5} and best[6][0].url == "https://paper.com/1" and best[6][0].date_confidence == "low"
    report = {r.question_id: r for r in found.report.collect()}
    assert {q: (r.reason, r.shortfall) for q, r in report.items()} == {
        1: ("none", "filtered"), 2: ("none", "capped"), 3: ("filtered_out", ""), 4: ("no_results", ""), 5: ("none", "filtered"), 6: ("none", "filtered"), 7: (report[7].reason, "filtered"), 8: ("engines_failed", ""),
    }
    assert (report[1].hits, report[1].non_public, report[1].dropped, report[1].excluded_seen, report[1].date_unknown_kept, report[1].results) == (8, 2, 3, 1, 2, 2)
    assert report[6].date_unknown_kept == 1 and 99 not in report


def test_pages_are_read_for_news_only(spark):
    checkpoints(spark)
    rows = [(q, s, "a", s, ["Storm hits coast town", "Rescue boats leave harbour", "Insurers count their losses"][s], f"https://p{s}.com/x", "storm coast", DAY - datetime.timedelta(days=1)) for q in (1, 2) for s in range(3)]
    pages = spark.createDataFrame([("https://p0.com/x", "storm on the coast", DAY)], "url string, content string, published_at date")
    asked = spark.createDataFrame([(1, "breaking news storm coast"), (2, "storm coast")], "question_id long, question string")
    got = search.search(spark.createDataFrame(rows, HITS), asked, today(), 3, pages=pages).results.collect()
    told = {(r.question_id, r.url): (r.read, r.date_confidence, r.published_at) for r in got}
    assert told[1, "https://p0.com/x"] == (True, "high", DAY) and told[1, "https://p1.com/x"][0] is False and told[2, "https://p0.com/x"][0] is None


def test_no_hits_and_no_questions(spark):
    checkpoints(spark)
    hits, asked = spark.createDataFrame([], HITS), spark.createDataFrame([(1, "storm")], "question_id long, question string")
    found = search.search(hits, asked, today())
    assert found.results.count() == 0 and [(r.question_id, r.reason) for r in found.report.collect()] == [(1, "no_results")]
    assert search.search(hits, asked.where("false"), today()).report.count() == 0


@pytest.mark.parametrize("question,strategy,text", [
    ("exoplanet atmosphere spectroscopy replication failures primary literature", "focus", "exoplanet atmosphere spectroscopy"), ("What is the capital of Assam?", "focus", None),
    ("how to apply for a trade licence in Assam", "jurisdiction", "how to apply for a trade licence in Assam site:assam.gov.in"), ("rivers of Assam", "jurisdiction", None),
    ("site:github.com/scipy/scipy latest release", "original", "site:github.com/scipy/scipy latest release"),
])
def test_forms_of_a_question(spark, question, strategy, text):
    found = spark.range(1).select(reformulate(F.lit(question), 6).alias("f")).first().f
    assert found[0].strategy == "original" and {f.strategy: f.text for f in reversed(found)}.get(strategy) == text
    order = ["original", "focus", "jurisdiction", "sub_question", "keywords", "synonym"]
    assert [order.index(f.strategy) for f in found] == sorted(order.index(f.strategy) for f in found)
    assert all("site:github.com/scipy/scipy" in f.text for f in found) or "site:" not in question


def test_ipv6_hosts_count_by_their_network(spark):
    urls = {"https://[2606:4700:4700::1111]/a": True, "http://[2a00:1450::5]:8080/": True, "https://[::1]/": False, "https://[fe80::1]/": False, "https://[::ffff:10.0.0.1]/": False, "https://[fd00::2]/": False, "https://[2001:db8::1]/": False, "https://[zz::1]/": False, "https://[fe80::1%25eth0]/": False}
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", U.is_public(F.col("url")).alias("p")).collect()
    assert {r.url: r.p for r in rows} == urls
