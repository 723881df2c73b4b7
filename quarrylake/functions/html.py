"""Pages as markdown and plain text. HTML needs a parser, so these are Arrow functions: batches go to Python, results leave it in
small pieces."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# What main content has at least, and where it may be.
LEAST_CHARS, LEAST_SHARE = 200, 0.5
CONTAINERS = {"main", "article"}
MAIN_NAMES = {"main", "content", "main-content", "article", "post", "entry-content", "post-content", "article-body", "page-content"}
SKIPPED = {"script", "style", "noscript", "template", "svg", "head", "nav", "footer", "aside", "form"}
BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "pre", "header", "figure", "figcaption", "td", "th", "dl", "dt", "dd"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Markdown(HTMLParser):
    """One pass from tags to lines of markdown, and where each container's lines begin and end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.now: list[str] = []
        self.skip: list[str] = []
        self.links: list[tuple[str, int]] = []
        self.open: list[tuple[str, int]] = []
        self.found: list[tuple[int, int]] = []
        self.depth: list[tuple[str, bool]] = []
        self.lists: list[int | None] = []
        self.cells: list[str] | None = None
        self.rows = 0
        self.pre = 0
        self.prefix = ""

    def flush(self) -> None:
        if self.cells is not None:
            return
        raw = "".join(self.now)
        text = raw.strip("\n") if self.pre else re.sub(r"\s+", " ", raw).strip()
        if text.strip():
            self.lines.append("```\n" + text + "\n```" if self.pre else self.prefix + text)
        self.now, self.prefix = [], ""
        self.links = [(href, 0) for href, _ in self.links]

    def cell(self) -> None:
        """Ends a table's cell, if one is open."""
        if self.cells is not None:
            self.cells.append(re.sub(r"\s+", " ", "".join(self.now)).strip().replace("|", "\\|"))
            self.now = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip or tag in SKIPPED:
            if tag in SKIPPED:
                self.skip.append(tag)
            return
        has = dict(attrs)
        if tag not in VOID:
            names = {*(has.get("class") or "").lower().split(), (has.get("id") or "").lower(), "main" if has.get("role") == "main" else ""}
            contains = tag in CONTAINERS or tag in ("div", "section") and bool(names & MAIN_NAMES)
            self.depth.append((tag, contains))
        else:
            contains = False
        if tag in BLOCKS or tag == "li" or re.fullmatch("h[1-6]", tag):
            self.flush()
        if contains:
            self.open.append((tag, len(self.lines)))
        if tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
        elif tag == "li":
            self.prefix = "- "
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
                self.prefix = f"{self.lists[-1]}. "
        elif tag == "pre":
            self.pre += 1
        elif tag == "code" and not self.pre:
            self.now.append("`")
        elif tag == "table":
            self.rows = 0
        elif tag == "tr":
            self.cells, self.now = [], []
        elif tag in ("td", "th"):
            self.now = []
        elif re.fullmatch("h[1-6]", tag):
            self.prefix = "#" * int(tag[1]) + " "
        elif tag == "br":
            self.now.append("\n" if self.pre else " ")
        elif tag == "img" and has.get("src"):
            self.now.append(f"![{re.sub(r'\s+', ' ', has.get('alt') or '').strip()}]({has['src']})")
        elif tag in ("b", "strong"):
            self.now.append("**")
        elif tag == "a":
            self.links.append((has.get("href") or "", len(self.now)))

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag in SKIPPED:
                while self.skip and self.skip.pop() != tag:
                    pass
            return
        contained = False
        for k in range(len(self.depth) - 1, -1, -1):
            if self.depth[k][0] == tag:
                contained = self.depth[k][1]
                del self.depth[k:]
                break
        if tag in ("b", "strong"):
            self.now.append("**")
        elif tag == "code" and not self.pre:
            self.now.append("`")
        elif tag == "a" and self.links:
            href, at = self.links.pop()
            label = re.sub(r"\s+", " ", "".join(self.now[at:])).strip()
            if label and href:
                self.now[at:] = [f"[{label}]({href})"]
        elif tag in ("td", "th"):
            self.cell()
        elif tag == "tr" and self.cells is not None:
            cells, self.cells = self.cells, None
            if any(cells):
                self.lines.append("| " + " | ".join(cells) + " |" + ("\n|" + " --- |" * len(cells) if not self.rows else ""))
                self.rows += 1
            self.now = []
        elif tag in BLOCKS or tag == "li" or re.fullmatch("h[1-6]", tag):
            self.flush()
            if tag == "pre":
                self.pre = max(0, self.pre - 1)
            elif tag in ("ul", "ol") and self.lists:
                self.lists.pop()
        if contained:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    self.found.append((self.open[k][1], len(self.lines)))
                    del self.open[k:]
                    break

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.now.append(data)


def _prose(lines: list[str]) -> int:
    """Characters in lines that read as prose: ten words or more, or five that end a sentence."""
    total = 0
    for x in lines:
        n = len(x.split())
        if n >= 10 or n >= 5 and re.search(r"[.!?][\"')]?\s*$", x):
            total += len(x)
    return total


def markdown(html: str | None, main: bool = True) -> str:
    """A page's text as markdown: of its tightest container that has half of the prose and 200 characters, else all of it."""
    if not html:
        return ""
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.lines
    if main and parser.found:
        whole = _prose(lines)
        fits = [(sum(map(len, lines[begin:end])), begin, end) for begin, end in parser.found if _prose(lines[begin:end]) >= max(LEAST_CHARS, LEAST_SHARE * whole)]
        if fits:
            _, begin, end = min(fits)
            lines = lines[begin:end]
    return "\n\n".join(lines)


# Texts, and their characters, whose results leave Python together.
PIECE_TEXTS, PIECE_CHARS = 256, 1_000_000


def in_pieces(batches: Iterable[pa.Array], make: Callable[[str], object], kind: pa.DataType) -> Iterator[pa.Array]:
    """`make` of each text in order, null of null, in arrays of few texts: a task holds one text of a batch as a Python object at a
    time, and the results of one piece, however many and long a batch's texts are."""
    for batch in batches:
        made, chars = [], 0
        for x in batch:
            text = x.as_py()
            made.append(None if text is None else make(text))
            chars += len(text or "")
            if len(made) == PIECE_TEXTS or chars >= PIECE_CHARS:
                yield pa.array(made, kind)
                made, chars = [], 0
        if made:
            yield pa.array(made, kind)


def to_markdown(html: Column, main: bool = True) -> Column:
    @F.arrow_udf("string")
    def convert(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return in_pieces(pages, lambda x: markdown(x, main), pa.string())

    return convert(html)


def with_markdown(rows: DataFrame, html: str, name: str, main: bool = True) -> DataFrame:
    """`rows` with the column `html` replaced by its markdown `name`, as a step of its own that Spark moves nothing through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, at = [c for c in batch.schema.names if c != html], 0
            for made in in_pieces([batch.column(html)], lambda x: markdown(x, main), pa.string()):
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, len(made)) for c in kept], made], names=[*kept, name])
                at += len(made)

    kept = StructType([f for f in rows.schema.fields if f.name != html])
    return rows.mapInArrow(run, kept.add(name, StringType()))


def to_text(html: Column) -> Column:
    """Markdown without the targets of links."""
    return F.regexp_replace(F.regexp_replace(to_markdown(html), r"\[([^\]]*)\]\([^)]*\)", "$1"), r"\*\*", "")


def normal_form(text: Column, form: str = "NFC") -> Column:
    """A Unicode normal form, which Spark has no function for. ASCII, which is in every form, doesn't leave the JVM."""
    @F.arrow_udf("string")
    def convert(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import unicodedata

        return in_pieces(texts, lambda x: unicodedata.normalize(form, x), pa.string())

    return convert(text)


# Which open elements a start tag ends, and within what: paragraphs end at a block, items at the next item of their list.
_PARAGRAPH_ENDS = BLOCKS - {"tr", "td", "th", "figcaption", "dt", "dd"} | {"h1", "h2", "h3", "h4", "h5", "h6", "address", "aside", "details", "fieldset", "footer", "form", "hr", "nav"}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
_WITHIN = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}} | dict.fromkeys(("tr", "td", "th", "tbody", "tfoot"), {"table"})
_HEAD = {"meta", "title", "link", "base", "style", "script", "noscript", "template", "head"}

ELEMENTS = "struct<text: string, elements: array<struct<node: int, parent: int, last: int, depth: int, nth: int, siblings: int, tag: string, attrs: map<string, string>, text_from: int, text_to: int, html_from: int, html_to: int, inner_from: int, inner_to: int>>>"


class _Tree(HTMLParser):
    """Elements in the order of their start tags: each with its last descendant, and where its text and its source lie."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.html, self.rows, self.open, self.text, self.chars = html, [], [], [], 0
        self.lines = [0, *[m.end() for m in re.finditer("\n", html)]]
        self.feed(html)
        self.close()
        self.drop(0, len(html))

    def at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def drop(self, keep: int, at: int, end: int | None = None) -> None:
        """Ends the innermost elements but the first `keep`; the outermost of them at the end tag from `at` to `end`, if any."""
        for k in range(len(self.open) - 1, keep - 1, -1):
            row = self.rows[self.open[k]]
            row |= {"last": len(self.rows) - 1, "text_to": self.chars, "inner_to": at, "html_to": end if end is not None and k == keep else at}
        del self.open[keep:]

    def implied(self, tag: str, at: int) -> None:
        for ends, within in ((_ENDS.get(tag, set()), _WITHIN.get(tag, set())), ({"p"} if tag in _PARAGRAPH_ENDS else set(), {"table", "button", "td", "th", "object"}), ({"head"} if tag not in _HEAD else set(), set())):
            found = None
            for k in range(len(self.open) - 1, -1, -1):
                name = self.rows[self.open[k]]["tag"]
                if name in within:
                    break
                if name in ends:
                    found = k
                elif name in ("div", "section", "article", "body"):
                    break
            if found is not None:
                self.drop(found, at)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = self.at()
        self.implied(tag, at)
        if tag == "form" and any(self.rows[k]["tag"] == "form" for k in self.open):
            return
        parent = self.open[-1] if self.open else None
        node, inner = len(self.rows), at + len(self.get_starttag_text() or "")
        has: dict[str, str] = {}
        for name, value in attrs:
            has.setdefault(name, value or "")
        row = {"node": node, "parent": parent, "last": node, "depth": len(self.open), "nth": 1, "siblings": 1, "tag": tag, "attrs": has, "text_from": self.chars, "text_to": self.chars, "html_from": at, "html_to": inner, "inner_from": inner, "inner_to": inner}
        self.rows.append(row)
        if tag not in VOID:
            self.open.append(node)

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag: str) -> None:
        at = self.at()
        for k in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[k]]["tag"] == tag:
                end = self.html.find(">", at)
                self.drop(k, at, len(self.html) if end < 0 else end + 1)
                return

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        self.chars += len(data)

    def numbered(self) -> list[dict]:
        family: dict[int | None, list[dict]] = {}
        for row in self.rows:
            family.setdefault(row["parent"], []).append(row)
        for rows in family.values():
            for k, row in enumerate(rows):
                row["nth"], row["siblings"] = k + 1, len(rows)
        return self.rows


def parse_elements(html: Column) -> Column:
    """A page's text and its elements (ELEMENTS). End tags that HTML lets be left out are implied; an end tag without a start
    is skipped, as is a form within a form; what an end tag finds open inside its element ends with it. Null gives null."""
    def one(page: str) -> dict:
        tree = _Tree(page)
        return {"text": "".join(tree.text), "elements": [r | {"attrs": list(r["attrs"].items())} for r in tree.numbered()]}

    @F.arrow_udf(ELEMENTS)
    def parse(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return in_pieces(pages, one, _ELEMENT_TYPE)

    return parse(html)


_INTS = ("node", "parent", "last", "depth", "nth", "siblings")
_PLACES = ("text_from", "text_to", "html_from", "html_to", "inner_from", "inner_to")
_ELEMENT_TYPE = pa.struct([("text", pa.string()), ("elements", pa.list_(pa.struct([*[(n, pa.int32()) for n in _INTS], ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), *[(n, pa.int32()) for n in _PLACES]])))])
