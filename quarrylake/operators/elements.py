"""Pages as tables of elements, and selectors over them as windows and joins on the elements' intervals.

An element is numbered by its start tag; its descendants are those numbered up
to `last`. Text and source aren't repeated for each element that holds them: an
element has the places where its own begin and end in the page's.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import url as U

#: One condition on an element: .class, #id, [attribute op value], :pseudo or :pseudo(...).
_CONDITION = re.compile(r"""\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<d>[^"]*)"|'(?P<s>[^']*)'|(?P<w>[^\]\s]+))\s*)?\]|:(?P<pseudo>[\w-]+)(?:\((?P<arg>[^()]*(?:\([^()]*\)[^()]*)*)\))?""")
_TAG = re.compile(r"\*|[A-Za-z][\w-]*")
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")


def parse(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, html, text, elements, and the columns `keep`): each page parsed once. Store it if several results are drawn from it.
    `key` must name a page: rows that share one would be taken for one page. A null page has no elements."""
    parsed = pages.select(key, html, *keep, H.parse_elements(F.col(html)).alias("p"))
    return parsed.select(F.col(key).alias("page"), F.col(html).alias("html"), *keep, F.col("p.text").alias("text"), F.col("p.elements").alias("elements"))


def elements(parsed: DataFrame) -> DataFrame:
    """(page, node, parent, last, depth, nth, siblings, tag, attrs and places): a row for each element."""
    return parsed.select("page", F.explode("elements").alias("e")).select("page", "e.*")


def _attribute(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def _nth(arg: str) -> Column:
    """:nth-child(an+b)."""
    arg = {"odd": "2n+1", "even": "2n"}.get(arg.strip().lower(), re.sub(r"\s", "", arg.lower()))
    found = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", arg)
    if not arg or not found:
        raise ValueError(f"not a position: {arg!r}")
    a = {None: 0, "": 1, "+": 1, "-": -1}.get(found[1]) if found[1] in (None, "", "+", "-") else int(found[1])
    b = int(found[2] or 0)
    if a == 0:
        return F.col("nth") == b
    return (F.pmod(F.col("nth") - b, F.lit(abs(a))) == 0) & ((F.col("nth") - b) * (1 if a > 0 else -1) >= 0)


def _compound(text: str) -> tuple[Column, int]:
    """The condition of one compound selector at the text's beginning, and how many characters it takes."""
    at, out = 0, F.lit(True)
    if tag := _TAG.match(text):
        at = tag.end()
        out = out if tag[0] == "*" else F.col("tag") == tag[0].lower()
    begin = at
    while m := _CONDITION.match(text, at):
        at = m.end()
        if m["cls"]:
            one = F.array_contains(F.split(F.coalesce(_attribute("class"), F.lit("")), r"\s+"), m["cls"])
        elif m["id"]:
            one = F.coalesce(_attribute("id") == m["id"], F.lit(False))
        elif m["attr"]:
            value, wanted = _attribute(m["attr"].lower()), next((m[k] for k in "dsw" if m[k] is not None), "")
            one = {
                None: value.isNotNull(), "=": value == wanted, "^=": value.startswith(wanted) & F.lit(wanted != ""), "$=": value.endswith(wanted) & F.lit(wanted != ""), "*=": value.contains(wanted) & F.lit(wanted != ""),
                "~=": F.array_contains(F.split(value, r"\s+"), wanted) & F.lit(wanted != "" and not re.search(r"\s", wanted)), "|=": (value == wanted) | value.startswith(wanted + "-"),
            }[m["op"]]
            one = F.coalesce(one, F.lit(False))
        elif m["pseudo"] == "not":
            inner, used = _compound((m["arg"] or "").strip())
            if used != len((m["arg"] or "").strip()):
                raise ValueError(f"not a compound selector: {m['arg']!r}")
            one = ~inner
        elif m["pseudo"] == "nth-child":
            one = _nth(m["arg"] or "")
        else:
            known = {"first-child": F.col("nth") == 1, "last-child": F.col("nth") == F.col("siblings"), "only-child": F.col("siblings") == 1, "root": F.col("parent").isNull() & (F.col("tag") == "html")}
            if m["pseudo"] not in known:
                raise ValueError(f"unknown :{m['pseudo']}")
            one = known[m["pseudo"]]
        out = out & one
    if not at or at == begin and not tag:
        raise ValueError(f"not a selector: {text!r}")
    return out, at


def compiled(selector: str) -> list[list[tuple[str, Column]]]:
    """The alternatives of a selector, each as steps (combinator to the step before, condition). The first combinator is ''."""
    out: list[list[tuple[str, Column]]] = []
    text = selector.strip()
    while True:
        steps, how = [], ""
        while True:
            condition, used = _compound(text)
            steps.append((how, condition))
            text = text[used:]
            m = _COMBINATOR.match(text)
            if not text.strip() or text.lstrip().startswith(","):
                break
            if not m:
                raise ValueError(f"not a selector: {selector!r}")
            how, text = m[1] or " ", text[m.end() :]
        out.append(steps)
        text = text.lstrip()
        if not text:
            return out
        text = text[1:].lstrip()


def within(marked: Column) -> Column:
    """Whether an element lies within a marked one: of those that begin before it, one reaches as far. Intervals nest, so the
    furthest end met so far tells, and one pass in the order of the page does what a join on intervals would."""
    before = Window.partitionBy("page").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(marked, F.col("last"))).over(before) >= F.col("node"), F.lit(False))


def matches(found: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """`found` (elements) with a boolean column for each selector: tag, *, .class, #id, [attribute] with = ~= |= ^= $= *=,
    :first-child :last-child :only-child :nth-child() :root :not(compound); descendants, children (>), next (+) and later (~)
    siblings; alternatives by commas. Anything else is a ValueError. Nothing is matched across pages."""
    family = Window.partitionBy("page", "parent").orderBy("node")
    out, names = found, list(found.columns)
    for name, selector in selectors.items():
        hits = []
        for k, steps in enumerate(compiled(selector)):
            flag = f"{name}_{k}_"
            for j, (how, condition) in enumerate(steps):
                last, flag = flag, f"{name}_{k}_{j}_"
                if how == "":
                    out = out.withColumn(flag, condition)
                elif how == " ":
                    out = out.withColumn(flag, condition & within(F.col(last)))
                elif how == ">":
                    parents = out.where(F.col(last)).select("page", F.col("node").alias("parent"), F.lit(True).alias("held_"))
                    out = out.join(parents, ["page", "parent"], "left").withColumn(flag, condition & F.col("held_").isNotNull()).drop("held_")
                elif how == "+":
                    out = out.withColumn(flag, condition & F.coalesce(F.lag(last).over(family), F.lit(False)))
                else:
                    out = out.withColumn(flag, condition & F.coalesce(F.max(last).over(family.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
            hits.append(F.col(flag))
        both = hits[0]
        for h in hits[1:]:
            both = both | h
        out = out.withColumn(name, both)
    return out.select(*names, *selectors)


def select(found: DataFrame, selector: str) -> DataFrame:
    """The elements that a selector matches."""
    return matches(found, {"matched_": selector}).where("matched_").drop("matched_")


def _cut(text: str, begin: str, end: str) -> Column:
    return F.substr(F.col(text), F.col(begin) + 1, F.col(end) - F.col(begin))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeezed(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"(?U)\s+", " "))


def read(parsed: DataFrame, chosen: DataFrame, attribute: str = "text") -> DataFrame:
    """`chosen` elements with `value`: their `text` (trimmed), `html` (inside), `outerHTML`, or an attribute, null if they lack it."""
    if attribute in ("text", "textContent"):
        value = trimmed(_cut("text_", "text_from", "text_to"))
    elif attribute in ("html", "innerHTML"):
        value = _cut("html_", "inner_from", "inner_to")
    elif attribute == "outerHTML":
        value = _cut("html_", "html_from", "html_to")
    else:
        return chosen.withColumn("value", _attribute(attribute.lower()))
    pages = parsed.select("page", F.col("text").alias("text_"), F.col("html").alias("html_"))
    return chosen.join(pages, "page").withColumn("value", value).drop("text_", "html_")


def rows(parsed: DataFrame, selector: str) -> DataFrame:
    """(page, place, text, html, href): a row for each match in the order of the page, from 1."""
    chosen = select(elements(parsed), selector)
    pages = parsed.select("page", F.col("text").alias("text_"), F.col("html").alias("html_"))
    place = F.row_number().over(Window.partitionBy("page").orderBy("node"))
    return chosen.join(pages, "page").select("page", place.alias("place"), trimmed(_cut("text_", "text_from", "text_to")).alias("text"), _cut("html_", "inner_from", "inner_to").alias("html"), _attribute("href").alias("href"))


def counts(parsed: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """(page, and the number of matches of each selector): a row for each page, those without elements too."""
    flagged = matches(elements(parsed), selectors)
    found = flagged.groupBy("page").agg(*[F.count_if(name).alias(name) for name in selectors])
    return parsed.select("page").join(found, "page", "left").fillna(0, list(selectors))


def extract(parsed: DataFrame, schema: dict[str, str]) -> DataFrame:
    """(page, and for each field a struct of `one` and `many`): the text of a field's only match is `one`; of several the texts
    are `many`, in order; without a match both are null. A row for each page."""
    flagged = matches(elements(parsed), schema)
    hit = F.array(*[F.when(F.col(name), F.lit(name)) for name in schema])
    each = flagged.select("page", "node", "text_from", "text_to", F.explode(F.array_compact(hit)).alias("field"))
    spans = each.groupBy("page", "field").agg(F.array_sort(F.collect_list(F.struct("node", "text_from", "text_to"))).alias("spans"))
    fields = spans.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("field", "spans"))).alias("fields"))
    # A page's fields meet its text once; texts aren't shuffled once for each match.
    pages = parsed.select("page", "text").join(fields, "page", "left")
    texts = pages.select("page", F.transform_values("fields", lambda _, s: F.transform(s, lambda x: trimmed(F.substr(F.col("text"), x["text_from"] + 1, x["text_to"] - x["text_from"])))).alias("fields"))
    value = lambda name: F.try_element_at("fields", F.lit(name))
    return texts.select("page", *[F.struct(F.when(F.size(value(n)) == 1, F.get(value(n), F.lit(0))).alias("one"), F.when(F.size(value(n)) > 1, value(n)).alias("many")).alias(n) for n in schema])


def base_url(parsed: DataFrame, url: str = "url") -> DataFrame:
    """(page, base): the URL that a page's references are resolved against: that of its first <base href>, itself resolved."""
    given = parsed.select("page", url, F.get(F.filter("elements", lambda e: (e["tag"] == "base") & e["attrs"]["href"].isNotNull()), F.lit(0)).alias("b"))
    return given.select("page", F.coalesce(U.resolve(F.col(url), F.col("b")["attrs"]["href"]), F.col(url)).alias("base"))


def links(parsed: DataFrame, url: str = "url", internal_only: bool = False, limit: int | None = None) -> DataFrame:
    """(page, place, text, href, url, internal): anchors with a reference, from 1, as absolute URLs; `internal` if the host is
    the page's own. References that are empty or run a script are left out. `parsed` has kept the column `url`."""
    href = trimmed(_attribute("href"))
    anchors = elements(parsed).where((F.col("tag") == "a") & (href != "") & ~F.lower(href).startswith("javascript:"))
    pages = parsed.select("page", F.col("text").alias("text_"), F.col(url).alias("page_url_")).join(base_url(parsed, url), "page")
    out = anchors.join(pages, "page").select("page", "node", squeezed(_cut("text_", "text_from", "text_to")).alias("text"), _attribute("href").alias("href"), U.resolve(F.col("base"), href).alias("url"), "page_url_")
    out = out.withColumn("internal", F.coalesce((U.host(F.col("url")) == U.host(F.col("page_url_"))) & (U.host(F.col("url")) != ""), F.lit(False)))
    out = out.where("internal") if internal_only else out
    out = out.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("node")))
    out = out.where(F.col("place") <= limit) if limit is not None else out
    return out.select("page", "place", "text", "href", "url", "internal")


# Elements that are never shown, and the roles that tags and kinds of input have.
HIDDEN_TAGS = ["script", "style", "head", "meta", "link", "noscript", "template"]
ROLES = {
    "button": "button", "summary": "button", "textarea": "textbox", "select": "combobox", "option": "option", "img": "image", "nav": "navigation", "main": "main", "header": "banner", "footer": "contentinfo", "aside": "complementary", "form": "form",
    "ul": "list", "ol": "list", "li": "listitem", "table": "table", "tr": "row", "td": "cell", "th": "cell", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
}
INPUT_ROLES = {"hidden": "", "submit": "button", "button": "button", "reset": "button", "image": "button", "checkbox": "checkbox", "radio": "radio", "search": "searchbox"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def role() -> Column:
    """An element's role: the one it names, or that of its tag; '' if neither."""
    kind = F.lower(F.coalesce(_attribute("type"), F.lit("text")))
    given = F.lower(trimmed(F.coalesce(_attribute("role"), F.lit(""))))
    own = F.when(F.col("tag") == "input", F.coalesce(_lookup(INPUT_ROLES, kind), F.lit("textbox"))).when(F.col("tag") == "a", F.when(_attribute("href").isNotNull(), "link").otherwise("")).otherwise(F.coalesce(_lookup(ROLES, F.col("tag")), F.lit("")))
    return F.when(given != "", given).otherwise(own)


def hidden() -> Column:
    """Whether an element itself is marked as not shown; what holds it isn't asked."""
    style = F.lower(F.coalesce(_attribute("style"), F.lit("")))
    return F.col("tag").isin(HIDDEN_TAGS) | _attribute("hidden").isNotNull() | F.coalesce(F.lower(_attribute("aria-hidden")) == "true", F.lit(False)) | style.rlike(r"display\s*:\s*none|visibility\s*:\s*hidden")


def holder(found: DataFrame, tag: str, name: str) -> DataFrame:
    """`found` with `name`: the node of the element `tag` that holds each element, null if none does; of such elements within one
    another the outermost. Those don't overlap, so it is the last one that began before, if it reaches as far."""
    outer = found.withColumn("outer_", (F.col("tag") == tag) & ~within(F.col("tag") == tag))
    before = Window.partitionBy("page").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("outer_"), F.struct("node", "last")), ignorenulls=True).over(before)
    out = outer.withColumn("last_", last)
    return out.withColumn(name, F.when(F.col("last_.last") >= F.col("node"), F.col("last_.node"))).drop("outer_", "last_")


def _named(parsed: DataFrame, controls: DataFrame, found: DataFrame) -> DataFrame:
    """`controls` (with `label_node`) and `name`, the accessible name: aria-label, what aria-labelledby names, the label for it or
    around it, placeholder, title, name, then its text."""
    pages = parsed.select("page", F.col("text").alias("text_"))
    texts = lambda some: some.join(pages, "page").withColumn("said_", _cut("text_", "text_from", "text_to")).drop("text_")
    given = lambda a: F.nullif(trimmed(_attribute(a)), F.lit(""))
    first = Window.partitionBy("page", "id_").orderBy("node")
    with_id = found.where(F.coalesce(_attribute("id") != "", F.lit(False))).withColumn("id_", _attribute("id")).withColumn("k_", F.row_number().over(first)).where("k_ = 1")
    asked = controls.where(_attribute("aria-labelledby").isNotNull()).select("page", F.col("node").alias("of_"), F.posexplode(F.split(trimmed(_attribute("aria-labelledby")), r"(?U)\s+")).alias("at_", "id_"))
    by_id = texts(with_id.join(asked.select("page", "id_").distinct(), ["page", "id_"], "left_semi")).select("page", "id_", trimmed(F.col("said_")).alias("said_")).where("said_ <> ''")
    by_id = asked.join(by_id, ["page", "id_"]).groupBy("page", F.col("of_").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at_", "said_"))), lambda x: x["said_"]), " ").alias("by_id_"))
    labels = texts(found.where("tag = 'label'")).select("page", "node", squeezed(F.col("said_")).alias("said_"), _attribute("for").alias("id_")).where("said_ <> ''")
    named_for = labels.where("id_ <> ''").groupBy("page", "id_").agg(F.min_by("said_", "node").alias("for_"))
    around = labels.select("page", F.col("node").alias("label_node"), F.col("said_").alias("around_"))
    own_id = F.coalesce(_attribute("id"), F.lit(""))
    out = texts(controls).withColumn("id_", own_id).join(by_id, ["page", "node"], "left").join(named_for, ["page", "id_"], "left").join(around, ["page", "label_node"], "left")
    kind = F.lower(F.coalesce(_attribute("type"), F.lit("text")))
    pressed = F.when((F.col("tag") == "input") & kind.isin("submit", "button", "reset"), trimmed(F.coalesce(F.nullif(_attribute("value"), F.lit("")), kind)))
    field = F.coalesce("for_", "around_", given("placeholder"), given("title"), given("name"), pressed, F.lit(""))
    image = F.coalesce(F.nullif(_attribute("alt"), F.lit("")), _attribute("title"), F.lit(""))
    own = F.when(F.col("tag").isin("input", "textarea", "select"), field).when(F.col("tag") == "img", trimmed(image)).otherwise(squeezed(F.col("said_")))
    return out.withColumn("name", F.coalesce(given("aria-label"), F.nullif("by_id_", F.lit("")), own)).drop("id_", "by_id_", "for_", "around_")


def _controls(parsed: DataFrame, chosen: Column) -> DataFrame:
    """Elements under a condition, with name, form_node and value: an input's or button's attribute, a text area's text, a
    select's chosen option or else its first; null for other elements."""
    found = holder(holder(holder(elements(parsed), "label", "label_node"), "form", "form_node"), "select", "select_node")
    pages = parsed.select("page", F.col("text").alias("text_"))
    options = found.where("tag = 'option' AND select_node IS NOT NULL").join(pages, "page")
    said = F.coalesce(_attribute("value"), squeezed(_cut("text_", "text_from", "text_to")))
    options = options.groupBy("page", F.col("select_node").alias("node")).agg(F.min_by(said, F.struct(_attribute("selected").isNull(), "node")).alias("option_value_"))
    out = _named(parsed, found.where(chosen), found).join(options, ["page", "node"], "left")
    value = F.when(F.col("tag") == "select", F.coalesce("option_value_", F.lit(""))).when(F.col("tag") == "textarea", F.col("said_")).when(F.col("tag").isin("input", "button"), F.coalesce(_attribute("value"), F.lit("")))
    return out.withColumn("value", value).drop("option_value_", "said_")


def interactive(parsed: DataFrame, url: str = "url") -> DataFrame:
    """(page, ref, tag, role, name, type, href, value, selector): what a reader can act on, numbered from 1 in the order of the
    page: links, buttons, fields, and elements with such a role or an onclick; not those marked as hidden. `parsed` has kept `url`."""
    acts = F.col("tag").isin("button", "input", "select", "textarea") | (F.col("tag") == "a") & _attribute("href").isNotNull() | F.coalesce(_attribute("role").isin("button", "link"), F.lit(False)) | _attribute("onclick").isNotNull()
    out = _controls(parsed, acts & ~hidden()).join(base_url(parsed, url), "page")
    ref = F.row_number().over(Window.partitionBy("page").orderBy("node"))
    own_id = F.coalesce(_attribute("id"), F.lit(""))
    return out.select(
        "page", ref.alias("ref"), "tag", F.coalesce(F.nullif(role(), F.lit("")), "tag").alias("role"), "name", F.nullif(_attribute("type"), F.lit("")).alias("type"),
        F.when(F.col("tag") == "a", U.resolve(F.col("base"), F.coalesce(_attribute("href"), F.lit("")))).alias("href"), "value", F.when(own_id != "", F.concat(F.lit("#"), own_id)).otherwise(F.col("tag")).alias("selector"),
    )


def forms(parsed: DataFrame, url: str = "url") -> DataFrame:
    """(page, form, id, action, method, fields): each form of a page, from 0, with its controls in order (tag, type, name, id, label,
    value, required). The action is absolute, the page's URL if there is none. `parsed` has kept `url`."""
    controls = _controls(parsed, F.col("tag").isin("input", "textarea", "select", "button")).where("form_node IS NOT NULL")
    text = lambda a, other="": F.coalesce(F.nullif(_attribute(a), F.lit("")), F.lit(other))
    field = F.struct("node", "tag", text("type", "text").alias("type"), text("name").alias("name"), text("id").alias("id"), F.col("name").alias("label"), F.coalesce("value", F.lit("")).alias("value"), _attribute("required").isNotNull().alias("required"))
    fields = controls.groupBy("page", F.col("form_node").alias("node")).agg(F.array_sort(F.collect_list(field)).alias("fields"))
    found = elements(parsed).where("tag = 'form'").join(base_url(parsed, url), "page").join(parsed.select("page", F.col(url).alias("page_url_")), "page").join(fields, ["page", "node"], "left")
    place = F.row_number().over(Window.partitionBy("page").orderBy("node")) - 1
    action = F.when(text("action") == "", F.col("page_url_")).otherwise(U.resolve(F.col("base"), text("action")))
    listed = F.transform(F.coalesce("fields", F.array()), lambda x: F.struct(*[x[c].alias(c) for c in ("tag", "type", "name", "id", "label", "value", "required")]))
    return found.select("page", place.alias("form"), text("id").alias("id"), action.alias("action"), F.upper(text("method", "GET")).alias("method"), listed.alias("fields"))
