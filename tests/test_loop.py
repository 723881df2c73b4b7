"""The research loop against a plain loop for one question at a time."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quarrylake.operators import loop as L
from quarrylake.plans.inputs import checkpoints, stored

HITS = "text string, place int, url string, title string, snippet string, published_at date, engines array<string>, flags array<string>, error string"
TODAY = datetime.date(2026, 1, 1)


def _run(spark, questions, script, table, pages, record=None):
    """`script` is {question_id: [[texts of a round], ...]}, `table` {text: hits or an error}, `pages` {url: content}."""
    checkpoints(spark)
    asked = spark.createDataFrame(questions, "question_id int, question string, max_rounds int, max_queries int, min_sources int, read_top_n int")
    proposals = spark.createDataFrame([(q, r + 1, n, t, "x") for q, rounds in script.items() for r, texts in enumerate(rounds) for n, t in enumerate(texts)], "question_id int, round int, nth int, text string, strategy string")
    rows = []
    for text, found in table.items():
        if isinstance(found, str):
            rows.append((text, None, None, None, None, None, None, None, found))
        else:
            rows += [(text, i + 1, url, title, snippet, None, ["e1"], [], None) for i, (url, title, snippet) in enumerate(found)]
    known = spark.createDataFrame(rows, HITS)
    content = spark.createDataFrame(list(pages.items()), "url string, content string")
    search = lambda ask: ask.join(known, ask["query"] == known["text"]).drop("query", "text")
    expander = L.recorded(record) if record else (lambda active, n, contested: proposals.where(F.col("round") == n).join(active.select("question_id"), "question_id", "left_semi"))
    return L.research(asked, search, lambda urls: urls.join(content, "url"), F.lit(TODAY), stored, expander)


def _plain(question, rounds, table, pages, max_rounds, max_queries, min_sources, read_top_n):
    used, sources, reads, stop = [], {}, {}, "max_rounds"
    word = question.split()[0]
    for number in range(1, max_rounds + 1):
        new = failures = 0
        over = False
        for text in rounds[number - 1] if number <= len(rounds) else []:
            text = text.strip()
            if not text or text.lower() in [u.lower() for u in used]:
                continue
            if len(used) >= max_queries:
                over = True
                break
            used.append(text)
            found = table.get(text, [])
            if isinstance(found, str):
                failures += 1
                continue
            for url, title, snippet in found:
                if url not in sources:
                    sources[url] = [title, snippet]
                    new += 1
                elif len(snippet) > len(sources[url][1]):
                    sources[url][1] = snippet
        told = lambda u: word in f"{sources[u][0]} {sources[u][1]} {reads.get(u) or ''}".split()
        for url in sorted((u for u in sources if u not in reads), key=lambda u: (not told(u), u))[:read_top_n]:
            reads[url] = pages.get(url, "").strip() and pages[url]
        domains = {u.split("/")[2] for u in sources if told(u)}
        naming = {u.split("/")[2] for u in sources if told(u) and word in f"{sources[u][0]} {sources[u][1]}"}
        coverage = min(1.0, len(naming or domains) / min_sources)
        if coverage >= 0.7:
            stop = "coverage_reached"
            break
        if over:
            stop = "budget_exhausted"
            break
        if not new:
            stop = "search_failed" if failures and not sources else "no_new_sources"
            break
    return stop, number, round(coverage, 4), len(used), sorted(sources), sorted(u for u in reads if reads[u])


def test_against_a_plain_loop(spark):
    rnd = random.Random(5)
    questions, script, table, pages = [], {}, {}, {}
    for q in range(24):
        word = f"subject{q}"
        texts = [f"q{q} t{i}" for i in range(7)]
        for t in texts:
            if rnd.random() < 0.25 or q % 8 == 7:
                table[t] = "engine down"
                continue
            urls = [f"https://d{rnd.randrange(9)}.example/{q}/{rnd.randrange(3)}" for _ in range(rnd.randrange(0, 4))]
            table[t] = [(u, "page", rnd.choice([f"{word} here", "nothing", f"nothing but {word} in words"])) for u in dict.fromkeys(urls)]
            pages |= {u: rnd.choice([f"long text about {word}", "of other things", " "]) for u in urls if rnd.random() < 0.7}
        pick = lambda: [rnd.choice([t, t.upper() if rnd.random() < 0.1 else t, "", f" {t} "]) for t in rnd.choices(texts, k=rnd.randrange(1, 4))]  # noqa: E731,B023
        script[q] = [pick() for _ in range(rnd.randrange(2, 5))]
        questions.append((q, f"{word} ?", rnd.randrange(1, 5), rnd.randrange(1, 7), rnd.randrange(1, 6), rnd.randrange(0, 3)))
    report = _run(spark, [*questions, (99, "  ", 3, 3, 3, 3)], script, table, pages)
    ended = {r["question_id"]: r for r in report.questions.collect()}
    urls, read = {}, {}
    for r in report.sources.collect():
        urls.setdefault(r["question_id"], []).append(r["url"])
        if r["read_status"] == "read":
            read.setdefault(r["question_id"], []).append(r["url"])
    wanted = {}
    for q, question, *options in questions:
        wanted[q] = _plain(question, script[q], table, pages, *options)
        got = ended[q]
        assert (got["stop_reason"], got["rounds"], got["coverage"], got["queries"], sorted(urls.get(q, [])), sorted(read.get(q, []))) == wanted[q], q
    assert set(ended) == set(wanted) and {w[0] for w in wanted.values()} == {"coverage_reached", "budget_exhausted", "max_rounds", "no_new_sources", "search_failed"}
    errors = {(r["question_id"], r["query"]) for r in report.steps.where("error IS NOT NULL").collect()}
    assert errors == {(q, t) for q, t in {(r["question_id"], r["query"]) for r in report.steps.collect()} if isinstance(table.get(t), str)} and errors
    again = _run(spark, questions, script, table, pages, record=report)
    assert sorted(map(str, again.questions.collect())) == sorted(map(str, report.questions.collect()))


def test_contested_subjects_are_asked_about(spark):
    said = "Solar panel efficiency reached {} percent in tests of the year."
    table = {"q1": [("https://a.gov/x", "Solar panel efficiency", said.format(22)), ("https://b.edu/y", "Solar panel efficiency", said.format(18))], "other": [("https://c.org/z", "Solar panel efficiency", said.format(18))]}
    report = _run(spark, [(1, "solar panel efficiency", 1, 5, 5, 0), (2, "solar panel efficiency", 1, 5, 5, 0)], {1: [["q1"]], 2: [["other"]]}, table, {})
    pairs = report.contradictions.collect()
    assert [(r["question_id"], r["kind"]) for r in pairs] == [(1, "numeric_mismatch")]  # a claim of another question contradicts nothing
    active = spark.createDataFrame([(1, "solar panel efficiency of cells")], "question_id int, question string")
    asked = L.expand(active, 2, report.contradictions).orderBy("nth").collect()
    assert asked[0]["strategy"] == "contested" and asked[0]["text"] == " ".join(pairs[0]["subject_terms"][:4]) + " evidence" and asked[1]["strategy"] == "original"
    assert {r["strategy"] for r in L.expand(active, 1, report.contradictions).collect()} & {"contested"} == set()


@pytest.mark.parametrize("most", [0, 2])
def test_nothing_to_ask(spark, most):
    report = _run(spark, [(1, "", most, 1, 1, 1)], {1: [["q"]]}, {"q": "down"}, {"u": "x"})
    assert report.questions.count() == report.sources.count() == report.claims.count() == 0
