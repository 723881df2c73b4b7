"""The search in one piece over pages that play the hits of five questions. Merging in order has no SQL; tests hold it against
plain Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as S
from . import ranking as K
from .inputs import checkpoints, literal, micro

#: One on news, one on an older year, one in a scope, one that asks how to do something, one with filters of its own.
ASKED = [
    (0, "latest news the thering and reading of thand", None, None, None), (1, "des queaux et la tionêau in 2026", None, None, None), (2, '"of the" ndtion thsh in site:example.org', None, None, None),
    (3, "how to register der ung schkeit und die", None, None, None), (4, "ción de la mente las", ["example.net"], "2026-03-01", ["http://therwh.example.org/es/12"]),
]
FACTORS = ("relevance", "authority", "freshness", "agreement", "source_quality", "score")


def questions(spark: SparkSession) -> DataFrame:
    rows = literal(spark, "question_id long, question string, exclude_domains array<string>, date_from string, exclude_urls array<string>", ASKED)
    return rows.withColumn("date_from", F.col("date_from").cast("date"))


def found(spark: SparkSession, sf_dir: str) -> S.Found:
    return S.search(K.hits(checkpoints(spark), sf_dir), questions(spark), K.today(), 8)


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = found(spark, sf_dir).results
    return best.select("question_id", "place", "url", "canonical", "title", "snippet", F.col("published_at").cast("string").alias("published_at"), "date_kind", "date_confidence", "hits",
                       F.array_join(F.map_keys("engine_ranks"), ",").alias("engines"), F.array_join("flags", ",").alias("flags"), *[micro(F.col(c)).alias(c) for c in FACTORS])


def search_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).report


QUERIES = {"search_results": search_results, "search_reports": search_reports}
SQL: dict[str, str] = {}
