"""Wire format, routes, outcomes of reading and posts of listings against plain Python."""

import base64
import random

from pyspark.sql import functions as F

from quarrylake.functions import url as U
from quarrylake.operators import reading as R
from quarrylake.operators import routing as G


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n % 128 + 128]), n // 128
    return out + bytes([n])


def test_wire_fields(spark):
    rnd = random.Random(2)
    messages = [b"", b"\x08", b"\xff" * 20, b"\x0a\x05ab", b"\x0b\x01", b"\x00\x01"]
    wanted = [[], [], [], [], [], []]
    for _ in range(60):
        message, fields = b"", []
        for _ in range(rnd.randrange(1, 6)):
            number, kind = rnd.randrange(1, 3000), rnd.choice([0, 1, 2, 5])
            text = bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 3, 130, 300])))
            body = {0: _varint(rnd.randrange(2**50)), 1: b"12345678", 2: _varint(len(text)) + text, 5: b"1234"}[kind]
            message, fields = message + _varint(number * 8 + kind) + body, [*fields, (number, kind, text if kind == 2 else None)]
        messages.append(message)
        wanted.append(fields)
    found = spark.createDataFrame(list(enumerate(map(bytearray, messages))), "i int, m binary").select("i", U.wire_fields(F.col("m")).alias("f")).orderBy("i").collect()
    assert [[(x["number"], x["kind"], None if x["bytes"] is None else bytes(x["bytes"])) for x in r["f"]] for r in found] == wanted


def test_news_wrappers(spark):
    inside = b"https://pub.example/a~b?c=d"
    coded = lambda m: base64.urlsafe_b64encode(m).decode().rstrip("=")
    at = "https://news.google.com/rss/articles/"
    cases = {
        at + coded(b"\x08\x13\x22" + _varint(len(inside)) + inside + b"ztail"): inside.decode(),  # what follows is no part of it
        at + coded(b"\xff\xff" + inside + b"\x00rest"): inside.decode(),
        at + coded(b"\x08\x13\x22\x03abc"): None, at + "!!!": None, at: None, "https://other.example/" + coded(b"\x22" + _varint(len(inside)) + inside): None,
    }
    found = spark.createDataFrame([(c,) for c in cases], "u string").select("u", U.coded_news(F.col("u")).alias("t")).collect()
    assert {r["u"]: r["t"] for r in found} == {u: t or u for u, t in cases.items()}


def test_routes(spark):
    rnd = random.Random(4)
    labels = ["a", "b", "com", "x"]
    made = [(i, ".".join(rnd.choices(labels, k=rnd.randrange(1, 4)))) for i in range(30)]
    rules = [(p, f"s{p}", "host", h) for p, h in made] + [(7, "t7", "text", "/FEED"), (40, "t40", "text", "z")]
    urls = [f"https://{'.'.join(rnd.choices(labels, k=rnd.randrange(1, 5)))}/{rnd.choice(['', 'feed', 'z', 'q'])}" for _ in range(80)] + [None, "", "not a url", "mailto:a@b.com"]
    found = G.routed(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(rules, "priority int, source string, kind string, pattern string")).collect()

    def plain(url):
        host = (url or "").split("/")[2] if (url or "").startswith("https://") else ""
        host = host.removeprefix("www.")
        hits = [(p, s) for p, s, kind, x in rules if url and (kind == "host" and host and (host == x or host.endswith("." + x)) or kind == "text" and x.lower() in url.lower())]
        return min(hits)[1] if hits else None

    assert sorted(map(str, [(r["url"], r["source"]) for r in found])) == sorted(map(str, [(u, plain(u)) for u in urls]))
    weighted = G.longest_suffix(spark.createDataFrame([("https://a.b.com/",), ("https://b.com",), ("https://xb.com",), (None,)], "url string"), spark.createDataFrame([(".com", 0.1), ("b.com", 0.2), (".a.b.com", 0.3)], "suffix string, weight double"), 0.5)
    assert {r["url"]: r["authority"] for r in weighted.collect()} == {"https://a.b.com/": 0.3, "https://b.com": 0.2, "https://xb.com": 0.1, None: 0.5}


def test_each_page_has_its_own_outcome(spark):
    text = "<html><head><title>T</title></head><body><article><p>" + "A sentence of some ten words that says a thing or two. " * 20 + "</p></article></body></html>"
    pages = [
        (1, "https://a.org/", 200, None, None, text), (2, None, 200, None, None, text), (3, "http://10.0.0.1/", 200, None, None, text), (4, "https://a.org/", 503, None, None, text), (5, "https://a.org/", 429, None, 7.0, None),
        (6, "https://a.org/", None, None, None, text), (7, "https://a.org/", 200, None, None, None), (8, "https://a.org/", 200, None, None, "<<<>&#x110000;<p"), (9, "https://a.org/", 200, None, None, "%PDF-1.4"), (None, "https://a.org/", 200, None, None, text),
    ]
    read = R.read_pages(spark.createDataFrame(pages, "page_id int, url string, status int, headers string, retry_after double, html string"), most=200)
    good, bad = R.split(read)
    assert {r["page_id"]: (r["title"], len(r["content"]) <= 200, r["truncated"]) for r in good.collect()} == dict.fromkeys((1, 6, None), ("T", True, True))
    errors = {r["page_id"]: (r["error"], r["cause"], r["retry_after"]) for r in bad.collect()}
    assert errors[2] == errors[3] == ("security_blocked", "blocked", None) and errors[5] == ("rate_limited", "blocked", 7.0) and errors[4][0] == "page_unavailable"
    assert errors[7] == ("extraction_failed", "not_enough_text", None) and errors[9] == ("extraction_failed", "wrong_format", None) and set(errors) == {2, 3, 4, 5, 7, 8, 9}


def test_pages_that_look_like_shells_keep_their_text(spark):
    """A word said over and over has no sentences and a menu only links, but both are texts; a page without any fails, as does one with hardly any."""
    body = lambda x: f"<html><head><title>T</title></head><body><article>{x}</article></body></html>"
    junk = "<p>" + "oner " * 900 + "</p>" + "<p>This page has a paragraph of plain prose that anyone can read.</p>" * 5
    pages = [(1, body(junk)), (2, body("<ul>" + "".join(f"<li><a href='/{k}'>A menu's item number {k}</a></li>" for k in range(40)) + "</ul>")), (3, body("<p>Short.</p>")), (4, body("<p>" + "A sentence of some ten words that says a thing or two. " * 20 + "</p>")), (5, body("<script>app()</script>"))]
    rows = spark.createDataFrame([(k, "https://a.org/", 200, None, None, h) for k, h in pages], "page_id int, url string, status int, headers string, retry_after double, html string")
    found = {r["page_id"]: r for r in R.read_pages(rows).collect()}
    assert {k: (r["shell"], r["failed"] and r["failed"]["detail"]) for k, r in found.items()} == {1: (True, None), 2: (True, None), 3: (None, "js_shell"), 4: (False, None), 5: (None, "empty_response")}
    assert found[1]["content"].startswith("oner oner") and "number 39" in found[2]["content"]


def test_cards(spark):
    link = '<a class=x href="https://f.example/post/{}">{}</a>'
    page = link.format("one", "One") + "<p>12 comments" + link.format("two", "<i></i>") + "3 upvotes" + link.format("three", "Th&amp;ree") + "x" * 1300 + "9 upvotes" + link.format("one", "Again") + "5 upvotes" + link.format("two", "Two") + "1.5 upvotes, 1,000 upvotes 2 COMMENT <a href='/me'>me.x</a>"
    found = R.card_posts(spark.createDataFrame([(1, page), (2, None), (3, "no posts")], "page_id int, html string")).orderBy("place").collect()
    assert [tuple(r) for r in found] == [(1, 1, "One", "https://f.example/post/one", "", None, 12), (1, 2, "Th&ree", "https://f.example/post/three", "", None, None), (1, 3, "Two", "https://f.example/post/two", "me.x", None, 2)]
