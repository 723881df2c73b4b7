"""All queries outside the training-data subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dom, evidence, loop, markup, nested, pages, payloads, questions, ranking, reading, reports, requests, research, search, state, texts, urls, verdicts

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (urls, texts, ranking, research, state, questions, requests, verdicts, evidence, reports, payloads, pages, markup, dom, nested, loop, reading, search)


def queries() -> dict[str, Query]:
    return {name: q for module in MODULES for name, q in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
