"""Reading many pages, each with its own outcome: a row that fails a step keeps its error and is skipped by the steps after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import url as U
from ..functions import verdicts as V

# How much of a page's text is kept.
MAX_CHARS = 20_000

ERROR = "struct<error: string, detail: string, hint: string, retry_after: double>"


def error(kind: Column | str, detail: Column | str = "", hint: str = "", retry_after: Column | None = None) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    wait = F.lit(None).cast("double") if retry_after is None else retry_after.cast("double")
    return F.struct(text(kind).alias("error"), text(detail).alias("detail"), F.lit(hint).alias("hint"), wait.alias("retry_after"))


def failing(rows: DataFrame, what: Column) -> DataFrame:
    """`rows` (with `failed`, null so far or an error) in which those for which `what` isn't null fail with it, if they haven't
    before. `failed` stands once in it, so that a filter on it doesn't grow with each step that it is pushed through."""
    return rows.withColumn("failed", F.coalesce("failed", what))


def sound(value: Column) -> Column:
    """A value of rows that haven't failed, null for others: what is made from it isn't worked out for them."""
    return F.when(F.col("failed").isNull(), value)


def read_pages(pages: DataFrame, key: str = "page_id", mode: str = "auto", most: int = MAX_CHARS) -> DataFrame:
    """(key, url, failed, cause, title, content, truncated, flags, shell): a row for each captured answer, in whatever order.

    `pages` has the key, url, status, headers, retry_after and html. `failed` is null
    for a page that could be read, or its first error: an URL that isn't public, a
    refusing status, a document that isn't HTML, a challenge in place of the page,
    no text, a page that says it isn't there, a shell that a script would fill.
    A page of some length that only has a shell's shape (few sentences, mostly
    links) is read: nothing here renders it, so it keeps its text, as `shell` says.
    `cause` is the bucket that an error belongs to. One page's failure changes
    no other's row, and nulls fail as what they lack. The content is markdown,
    cut at `most` characters with a note.
    """
    rows = pages.select(F.col(key), "url", "status", "headers", "retry_after", "html", F.lit(None).cast(ERROR).alias("failed"))
    rows = failing(rows, F.when(~F.coalesce(U.is_public(F.col("url")), F.lit(False)), error("security_blocked", "blocked_by_security_policy")))
    refused = V.status_error(F.col("status"), F.lit("origin"), F.lit(mode), F.col("retry_after"))
    rows = failing(rows, F.when(F.col("status") >= 300, F.struct(refused["error"].alias("error"), refused["detail"].alias("detail"), refused["hint"].alias("hint"), refused["retry_after"].cast("double").alias("retry_after"))))
    rows = failing(rows, F.when(V.looks_like_pdf(F.encode(F.substring("html", 1, 1024), "UTF-8")), error("extraction_failed", "unsupported_media: pdf")))
    seen = lambda c: F.when((c["kind"] != "none") & c["confident"], error("challenge", F.concat(c["kind"], F.when(c["provider"] != "", F.concat(F.lit(": "), c["provider"])).otherwise(""))))
    rows = failing(rows, T.let(V.challenge(F.col("html"), F.col("status"), F.col("headers")), seen))
    # Rows that failed reach the parser as nulls.
    rows = rows.select(key, "url", "failed", T.html_title(F.col("html")).alias("title_"), sound(F.coalesce("html", F.lit(""))).alias("html"))
    rows = H.with_markdown(rows, "html", "markdown_")
    rows = failing(rows, F.when(F.trim("markdown_") == "", error("extraction_failed", "empty_response")))
    rows = failing(rows, F.when(T.is_soft_404(F.col("markdown_")), error("page_unavailable", "soft_404")))
    rows = failing(rows, F.when(T.is_empty_shell(F.col("markdown_")), error("extraction_failed", "js_shell")))
    title = V.resolved_title(F.col("title_"), F.col("markdown_"), F.col("url"))
    content = T.truncate(F.col("markdown_"), most)
    cause = V.failure_cause(F.col("failed.error"), F.col("failed.detail"), F.lit("failed"), F.lit(False), F.lit(True), F.lit(-1))["cause"]
    return rows.select(
        key, "url", "failed", F.when(F.col("failed").isNotNull(), cause).alias("cause"), sound(title["title"]).alias("title"), sound(content).alias("content"), sound(F.length("markdown_") > most).alias("truncated"),
        sound(V.flags_merged(title["title"], F.col("markdown_"), F.lit(None).cast("array<string>"))).alias("flags"),
        sound(T.is_script_shell(F.col("markdown_"))).alias("shell"),
    )


def split(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages that were read, failures with error, detail, hint, retry_after and cause). Store the table before: both read it."""
    good = read.where("failed IS NULL").drop("failed", "cause")
    return good, read.where("failed IS NOT NULL").select(read.columns[0], "url", "failed.*", "cause")


POST = r"(?is)<a\s[^>]*href\s*=\s*[\"'](https?://[^\"'#?]*/post/[^\"'#?]+)[^\"']*[\"'][^>]*>(.*?)</a>"
#: Characters after a post's link in which its author and counts stand.
NEAR = 1200


def card_posts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, place, title, url, author, score, comments): posts that a listing links to, each once per page (its first link with a
    text), with the author and counts that stand nearest after the link.

    An author or count belongs to the last post's link before it, if it is no
    further than 1,200 characters, and the first of its kind counts. So the next
    card's counts are never taken for a card without any. Without one, author is
    empty and a count null.
    """
    text = F.coalesce(F.col(html), F.lit(""))
    # A page is cut before each link to a post: a cut holds one card, and what follows the last card up to the page's end.
    cards = pages.select(key, F.posexplode(F.split(text, r"(?i)(?=<a\s[^>]{0,500}href\s*=\s*[\"']https?://[^\"'#?]{0,300}/post/)")).alias("at", "card"))
    link = F.regexp_extract("card", r"(?is)^" + POST[5:], 0)
    cards = cards.withColumn("link_", link).where("link_ <> ''")
    plain = lambda c: T.squeeze(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), "&quot;", '"'), "&#39;|&#x27;", "'"), "&amp;", "&"))
    near = F.substr(F.col("card"), F.length("link_") + 1, F.lit(NEAR))
    cards = cards.select(key, "at", F.regexp_extract("link_", POST, 1).alias("url"), plain(F.regexp_extract("link_", POST, 2)).alias("title"), near.alias("near_"))
    cards = cards.where("title <> ''").withColumn("nth_", F.row_number().over(Window.partitionBy(key, "url").orderBy("at"))).where("nth_ = 1")
    said = F.regexp_replace("near_", "<[^>]*>", " ")
    number = lambda word: F.regexp_replace(F.regexp_extract(said, rf"(?i)([0-9][0-9,.]*)\s*{word}", 1), ",", "").try_cast("int")
    author = F.regexp_extract("near_", r"(?is)href\s*=\s*[\"'](?:https?://[^/\"']+)?/([A-Za-z0-9_.-]+)[\"'][^>]*>\s*(?:<[^>]+>\s*)*([A-Za-z0-9_.-]{2,40})", 2)
    place = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    return cards.select(key, place.alias("place"), "title", "url", author.alias("author"), number("upvotes?").alias("score"), number("comments?").alias("comments"))
