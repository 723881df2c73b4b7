"""The research loop over pages: what each question comes to. A loop has no SQL; tests hold it against a plain one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import loop as L
from . import ranking as K
from .inputs import checkpoints, literal, stored, table

#: Questions with their bounds: rounds, queries, domains that are enough, pages read in a round. The last two find nothing and fail.
RUNS = [
    (0, K.QUESTIONS[0][1], 3, 12, 3, 3), (1, K.QUESTIONS[1][1], 3, 12, 40, 3), (2, K.QUESTIONS[2][1], 2, 1, 500, 2), (3, K.QUESTIONS[3][1] + " und schung; der keit und die ung", 1, 12, 900, 3), (4, K.QUESTIONS[4][1], 3, 12, 700, 0),
    (5, "zzyzx qwrtp vvkkx", 3, 12, 3, 3), (6, "unreachable engine zzyzx", 2, 2, 3, 3),
]


def page_search(pages: DataFrame, k: int = 8, down: str = "unreachable") -> L.Search:
    """A search of pages by the words of titles and snippets: the k pages with most of a query's terms, then by URL. A query with
    the word `down` fails. `pages` is stored and has url, title, snippet, published_at and terms; its postings are what is joined."""
    postings = stored(pages.select("url", F.explode("terms").alias("t")), "postings")

    def search(asked: DataFrame) -> DataFrame:
        broken = F.lower("query").contains(down)
        words = asked.where(~broken).select("question_id", "ask_no", F.explode(F.array_distinct(T.terms(F.col("query")))).alias("t"))
        met = words.join(postings, "t").groupBy("question_id", "ask_no", "url").agg(F.count("*").alias("n"))
        place = F.row_number().over(Window.partitionBy("question_id", "ask_no").orderBy(F.col("n").desc(), "url"))
        best = met.withColumn("place", place).where(F.col("place") <= k).join(pages.drop("terms"), "url")
        hits = best.select("question_id", "ask_no", "place", "url", "title", "snippet", "published_at", F.array(F.lit("pages")).alias("engines"), T.flags(F.concat_ws(" ", "title", "snippet")).alias("flags"), F.lit(None).cast("string").alias("error"))
        return hits.unionByName(asked.where(broken).select("question_id", "ask_no", F.lit("engine is down").alias("error")), allowMissingColumns=True)

    return search


def research_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop reasons, rounds, coverage and what was found for seven questions asked of all pages; one page of seven can't be read."""
    checkpoints(spark)
    hits = K.hits(spark, sf_dir).dropDuplicates(["url"])
    pages = stored(hits.select("url", "title", "snippet", "published_at", T.terms(F.concat_ws(" ", "title", "snippet")).alias("terms")), "pages")
    body = T.squeeze(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>|<head>.*?</head>", " "), "<[^>]+>", " "))
    texts = table(spark, sf_dir, "pages").dropDuplicates(["url"]).select("url", F.when(F.col("page_id") % 7 != 0, body).alias("content"))
    asked = literal(spark, "question_id long, question string, max_rounds int, max_queries int, min_sources int, read_top_n int", RUNS)
    report = L.research(asked, page_search(pages), lambda urls: urls.join(texts, "url"), K.today(), stored)
    sources = report.sources.groupBy("question_id").agg(F.count("*").alias("sources"), F.count_if(F.col("read_status") == "read").alias("read"), F.count_if(F.col("read_status") == "read_failed").alias("unread"))
    claims = report.claims.groupBy("question_id").agg(F.count("*").alias("claims"))
    pairs = report.contradictions.groupBy("question_id").agg(F.count("*").alias("contradictions"))
    failed = report.steps.groupBy("question_id").agg(F.count("error").alias("failed"))
    out = report.questions
    for more in (sources, claims, pairs, failed):
        out = out.join(more, "question_id", "left")
    return out.fillna(0)


QUERIES = {"research_runs": research_runs}
SQL: dict[str, str] = {}
