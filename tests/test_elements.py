"""Element tables against trees walked in plain Python, and references against the standard library."""

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from quarrylake.functions import url as U
from quarrylake.operators import elements as E
from quarrylake.plans import dom

from .compare import SF

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><base href="/base/"></head><body class="x main">
<ul><li>one<li class="a b">two <b>bold<li>three</ul><p>first<p id=second>second<div><p>in div</div></p>
<table><tr><td>1<td>2<tr><td>3</table><br/><img src=i.png alt=" pic "><script>var a = "<p>";</script>
<a href=" rel/x ">  A
 link </a><a href="JavaScript:x()">no</a><a href="">no</a><a>none</a><a href='//h.example/y'>B</a><form id=f><form id=inner><input name=n></form>
<label>L <input id=l></label><div><span></span></p></html>"""


def _pages(spark, *html):
    return spark.createDataFrame([(i, "https://site.example/dir/page?q=1", h) for i, h in enumerate(html)], "page_id long, url string, html string")


def _texts(spark, html, selector):
    return [r["text"] for r in E.rows(E.parse(_pages(spark, html)), selector).orderBy("place").collect()]


def test_tree(spark):
    assert _texts(spark, PAGE, "li") == ["one", "two bold", "three"]
    assert _texts(spark, PAGE, "body > p") == ["first", "second"]
    assert _texts(spark, PAGE, "td") == ["1", "2", "3"] and _texts(spark, PAGE, "tr:nth-child(2) > td") == ["3"]
    assert _texts(spark, PAGE, "li.a.b b, #second, title") == ["T & t", "bold", "second"]
    assert _texts(spark, PAGE, "script") == ['var a = "<p>";']
    parsed = E.parse(_pages(spark, PAGE, "", None))
    got = {r["page"]: r for r in E.counts(parsed, {"forms": "form", "all": "*", "held": "form input"}).collect()}
    assert (got[0]["forms"], got[0]["held"], got[1]["all"], got[2]["all"]) == (1, 1, 0, 0)
    html = E.read(parsed, E.select(E.elements(parsed), "ul > li"), "outerHTML").orderBy("node").collect()
    assert [r["value"] for r in html] == ["<li>one", '<li class="a b">two <b>bold', "<li>three"]
    assert [r["value"] for r in E.read(parsed, E.select(E.elements(parsed), "img"), "ALT").collect()] == [" pic "]
    one = E.extract(parsed, {"t": "title", "li": "li", "no": "nav"}).orderBy("page").collect()
    assert one[0]["t"]["one"] == "T & t" and one[0]["li"]["many"] == ["one", "two bold", "three"] and one[0]["no"] == one[1]["t"] == (None, None) and len(one) == 3


def test_links(spark):
    found = E.links(E.parse(_pages(spark, PAGE, None), keep=("url",))).orderBy("place").collect()
    assert [(r["text"], r["url"], r["internal"]) for r in found] == [("A link", "https://site.example/base/rel/x", True), ("B", "https://h.example/y", False)]
    assert E.links(E.parse(_pages(spark, PAGE), keep=("url",)), internal_only=True, limit=5).count() == 1


def _random_page(rnd):
    def one(depth):
        tag = rnd.choice(["div", "span", "ul", "em"])
        attrs = "".join([rnd.choice(["", ' class="a"', ' class="b a"', " class=c"]), rnd.choice(["", ' id="k"', " data-x='v w'", ' lang="en-GB"'])])
        inner = "".join(one(depth + 1) for _ in range(rnd.randrange(0, 4))) if depth < 5 else "t"
        return f"<{tag}{attrs}>{inner}</{tag}>"

    return "<div>" + "".join(one(0) for _ in range(4)) + "</div>"


class _Node:
    def __init__(self, row, nodes):
        self.tag, self.attrs, self.parent, self.node = row["tag"], row["attrs"], nodes.get(row["parent"]), row["node"]
        self.children = []
        if self.parent:
            self.parent.children.append(self)


CLASS = lambda n: (n.attrs.get("class") or "").split()
#: Selectors and what they mean, said by walking up and aside.
CASES = {
    "div.a span": lambda n: n.tag == "span" and any(p.tag == "div" and "a" in CLASS(p) for p in _up(n)),
    "div > .b": lambda n: "b" in CLASS(n) and n.parent and n.parent.tag == "div",
    "em + em": lambda n: n.tag == "em" and _before(n)[-1:] and _before(n)[-1].tag == "em",
    "ul ~ div > em": lambda n: n.tag == "em" and n.parent and n.parent.tag == "div" and any(s.tag == "ul" for s in _before(n.parent)),
    "[data-x~=v] > *:not(.a)": lambda n: "a" not in CLASS(n) and n.parent and "v" in n.parent.attrs.get("data-x", "").split(),
    "[lang|=en], #k:first-child": lambda n: n.attrs.get("lang", "").startswith("en-") or n.attrs.get("id") == "k" and not _before(n),
    "div div:nth-child(2n+1) ul": lambda n: n.tag == "ul" and any(p.tag == "div" and len(_before(p)) % 2 == 0 and any(g.tag == "div" for g in _up(p)) for p in _up(n)),
    "span:last-child:not(:only-child)": lambda n: n.tag == "span" and n.parent and n.parent.children[-1] is n and len(n.parent.children) > 1,
}


def _up(n):
    while n.parent:
        n = n.parent
        yield n


def _before(n):
    return n.parent.children[: n.parent.children.index(n)] if n.parent else []


def test_selectors_against_walks(spark):
    rnd = random.Random(3)
    parsed = E.parse(_pages(spark, *[_random_page(rnd) for _ in range(12)]))
    flagged = E.matches(E.elements(parsed), {f"s{i}": s for i, s in enumerate(CASES)}).collect()
    trees = {}
    for r in sorted(flagged, key=lambda r: (r["page"], r["node"])):
        nodes = trees.setdefault(r["page"], {})
        nodes[r["node"]] = _Node(r, nodes)
    for i, (selector, holds) in enumerate(CASES.items()):
        wanted = {(p, n.node) for p, nodes in trees.items() for n in nodes.values() if holds(n)}
        assert {(r["page"], r["node"]) for r in flagged if r[f"s{i}"]} == wanted and wanted, selector


@pytest.mark.parametrize("selector", ["", "div >", "> a", "a:hover", "a[", "p::before", "a,,b", "div:not(a b)"])
def test_unknown_selectors(selector):
    with pytest.raises(ValueError):
        E.compiled(selector)


def test_names_of_controls(spark):
    page = """<span id=a> One </span><span id=b>Two</span><button aria-labelledby="a b missing a">x</button><input aria-label=" Own " id=i><label for=j> For
    j </label><label for=j>late</label><input id=j title=t><label>Outer <label>in <textarea>z</textarea></label></label><select><option value=1>x<option>y</select><select></select><input type=submit><input type=reset value=R><input><input hidden>
    <a href=x style="display : none">h</a><a href="../up" role=button><img alt=no>Up</a><div onclick=f()>D</div><summary>s</summary><input type=checkbox name=c aria-hidden=TRUE>"""
    found = E.interactive(E.parse(_pages(spark, page), keep=("url",))).orderBy("ref").collect()
    assert [(r["tag"], r["role"], r["name"], r["value"], r["selector"]) for r in found] == [
        ("button", "button", "One Two One", "", "button"), ("input", "textbox", "Own", "", "#i"), ("input", "textbox", "For j", "", "#j"), ("textarea", "textbox", "Outer in z", "z", "textarea"),
        ("select", "combobox", "", "1", "select"), ("select", "combobox", "", "", "select"), ("input", "button", "submit", "", "input"), ("input", "button", "R", "R", "input"), ("input", "textbox", "", "", "input"),
        ("a", "button", "Up", None, "a"), ("div", "div", "D", None, "div"),
    ]
    assert found[-2]["href"] == "https://site.example/up"


def test_whole_pages_are_listed(spark):
    """The given pages' own links stand before the controls added to them; nothing of a page is left out."""
    found = dom.interactive_elements(spark, SF).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    refs = {p: [r["tag"] for r in sorted(found, key=lambda r: r["ref"]) if r["page_id"] == p] for p in pages}
    assert all(tags == ["a"] * pages[p].count("<a href=") + ["input", "input", "select", "textarea", "input", "button", "span"] for p, tags in refs.items())
    assert sum(x.count("<a href=") for x in pages.values())


BASES = ["http://a/b/c/d;p?q", "http://a", "https://h.example:8080/x/y/?k=v#f", "http://a/b/"]
#: The normal and abnormal examples of RFC 3986, 5.4, and others.
REFERENCES = ["g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "g?y/./x", "g?y/../x", "g#s/./x", "g#s/../x", "//h2/a/../b", "mailto:x@y.z", "é/ü?ß"]


#: Where the library isn't strict: it keeps dot segments after another host, and the base's fragment for an empty reference.
OTHERWISE = {(b, "//h2/a/../b"): f"{b.split(':')[0]}://h2/b" for b in BASES} | {(b, ""): b.split("#")[0] for b in BASES}


def test_references(spark):
    pairs = [(b, r) for b in BASES for r in REFERENCES]
    found = spark.createDataFrame(pairs, "b string, r string").select("b", "r", U.resolve(F.col("b"), F.col("r")).alias("u")).collect()
    for x in found:
        assert x["u"] == OTHERWISE.get((x["b"], x["r"]), urljoin(x["b"], x["r"])), x
    nulls = spark.range(1).select(U.resolve(F.lit(None).cast("string"), F.lit("x")).alias("a"), U.resolve(F.lit("http://a/"), F.lit(None).cast("string")).alias("b")).first()
    assert nulls["a"] is None and nulls["b"] is None


def test_results_leave_python_in_pieces(spark):
    """However many rows and characters a batch has, few results are held at a time; order, nulls and values stay."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from quarrylake.functions import html as H

    held, texts = [], [None if k % 7 == 0 else f"<p>{k}" for k in range(5000)] + ["x" * 400_000] * 7
    def make(x):
        held[-1] += 1
        return x + "!"

    found = []
    batches = (pa.array(x, pa.string()) for x in (texts, [], [None]))
    held.append(0)
    for piece in H.in_pieces(batches, make, pa.string()):
        assert held[-1] <= len(piece) <= H.PIECE_TEXTS and len(piece) * 400_000 <= 2 * H.PIECE_CHARS or len(piece[0].as_py() or "") < 100
        found += piece.to_pylist()
        held.append(0)
    assert found == [None if x is None else x + "!" for x in [*texts, None]] and max(held) <= H.PIECE_TEXTS
    rows = spark.createDataFrame([(k, None if k % 5 == 0 else f"<p>page {k}</p>" + "<br>" * (k % 3)) for k in range(3000)], "page_id int, html string").coalesce(1)
    sizes = rows.select(H.parse_elements(F.col("html")).alias("p"), "page_id", H.to_markdown(F.col("html")).alias("md"), H.normal_form(F.col("html"), "NFKC").alias("n"), "html").collect()
    assert all((r["p"] is None and r["md"] is None and r["n"] is None) if r["page_id"] % 5 == 0 else (len(r["p"]["elements"]) == 1 + r["page_id"] % 3 and r["md"] == f"page {r['page_id']}" and r["n"] == r["html"]) for r in sizes)
    moved = H.with_markdown(rows, "html", "md").collect()
    assert len(moved) == 3000 and all(r["md"] == (None if r["page_id"] % 5 == 0 else f"page {r['page_id']}") for r in moved)
