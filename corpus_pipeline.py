"""A corpus for training: toxic and undetermined documents go, one of each group of copies stays, the rest is packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.llm import exact, langid, packing, simhash, toxicity
from quarrylake.llm.common import documents, fold, stored
from quarrylake.llm.tokens import word_bpe_path

#: A language is rejected as undetermined below this mean probability.
LEAST_LANGUAGE_SCORE = 0.3


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and all columns as one, so that no column's name can clash with an operator's."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text is predicted to be toxic go; null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, fold("doc_id", 5) != 0)
    return toxicity.score(_rows(docs), model, keep=("row",)).where("predicted = 0").select("row.*")


def language_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or whose most probable language hardly stands out, go."""
    net = langid.fit(docs, fold("doc_id", 4) != 2)
    found = langid.predict(_rows(docs), net, keep=("row",))
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def _one_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id (null as simhash.NO_ID) and text hash are in `chosen` (row_id, text_hash): of repeated
    rows, one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = _rows(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(simhash.NO_ID)).alias("row_id"), F.xxhash64(text).alias("text_hash"), "row")
    return rows.join(chosen, ["row_id", "text_hash"], "left_semi").dropDuplicates(["row_id", "text_hash"]).select("row.*")


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z against a-z the one with the largest doc_id stays; of rows that share it, one."""
    found = exact.exact_duplicates(docs.select("doc_id", "text"))
    kept = found.where("kept").groupBy("id", "sha256").agg(F.min("text_hash").alias("text_hash"))
    return _one_each(docs, kept.select(F.coalesce("id", F.lit(simhash.NO_ID)).alias("row_id"), "text_hash"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked the one with the smallest doc_id stays; linked are those whose sets of five-word shingles
    have a similarity of 0.8 or more and whose SimHash fingerprints differ in at most 14 bits.

    All texts without words are one group. Of rows with the same doc_id and text
    one stays; of a group's rows that share the smallest doc_id, one text's; a
    null doc_id stays only if no row of its group has one.
    """
    found = simhash.verified_duplicates(docs.select("doc_id", "text"))
    leaders = found.where("row_id = leader_id AND text_hash = leader_hash").select("row_id", "text_hash")
    return _one_each(docs, leaders)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens, with lexical neighbours together.

    A null or empty text is its end id alone; rows with a null or a repeated doc_id are documents of their own.
    """
    return packing.pieces(docs, word_bpe_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("language", language_out),
    ("exact_dedup", copies_out),
    ("near_dedup", near_copies_out),
    ("packing", packed),
]

#: No stage but exact dedup can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written to the shared folder before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
