"""Fill-in-the-middle arrangements of texts, in Spark SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: What marks the prefix, the suffix and the middle in an arranged text.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are arranged, and of 100 arranged ones so many with the suffix first.
ARRANGED, SUFFIX_FIRST = 90, 20

_MINE = {"id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"}


def _number(digest: Column, group: int) -> Column:
    """The group-th (from 0) eight hexadecimal digits as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def _joined(units: Column, begin: Column, end: Column) -> Column:
    return F.array_join(F.slice(units, begin + 1, end - begin), "")


def arrange(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), arranged: int = ARRANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): one row for each row of `docs`, with the columns `keep` as they are
    (`_kept` is added to a name that clashes).

    A text is an array of its n code points, cut in two places that the sha256 of
    the id decides: prefix, middle, suffix. `psm` puts `<P>` prefix `<S>` suffix
    `<M>` middle, `spm` `<S>` suffix `<P>` prefix `<M>` middle; `plain` is the
    text itself: texts that are empty or null, that contain one of the three
    marks, or that the hash leaves alone. A cut may leave any of the three
    empty. The hash takes a null id as no digits; rows with the same id are cut
    by the same numbers, each in its own text. An empty table gives an empty
    table; other columns aren't read. No row moves: a text's array lives in its
    task alone, and takes about 60 bytes a code point there.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole_id = F.col(id_col)
    rows = docs.select(whole_id.alias("id"), text.alias("text_"), F.sha2(F.concat(F.lit("1:"), F.coalesce(whole_id.cast("string"), F.lit(""))).cast("binary"), 256).alias("digest_"), *[F.col(c).alias(f"{c}_kept" if c in _MINE else c) for c in keep])
    rows = rows.withColumn("units_", F.regexp_extract_all("text_", F.lit("(?s)."), F.lit(0)))
    rows = rows.withColumn("n", F.size("units_").cast("long"))
    first, second = (F.pmod(_number(F.col("digest_"), k), F.col("n") + 1) for k in (0, 1))
    marked = F.col("text_").contains(PREFIX) | F.col("text_").contains(SUFFIX) | F.col("text_").contains(MIDDLE)
    form = F.when((F.col("n") == 0) | marked | (_number(F.col("digest_"), 2) % 100 >= arranged), "plain").when(_number(F.col("digest_"), 3) % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumns({"low_": F.least(first, second).cast("int"), "high_": F.greatest(first, second).cast("int"), "form": form})
    units, n, low, high = F.col("units_"), F.col("n").cast("int"), F.col("low_"), F.col("high_")
    prefix, middle, suffix = _joined(units, F.lit(0), low), _joined(units, low, high), _joined(units, high, n)
    output = F.when(F.col("form") == "plain", F.col("text_")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    moved = F.col("form") != "plain"
    kept = [f"{c}_kept" if c in _MINE else c for c in keep]
    return rows.select("id", "n", "form", F.when(moved, low.cast("long")).alias("prefix_chars"), F.when(moved, (high - low).cast("long")).alias("middle_chars"), output.alias("output"), *kept)


def restored(arranged: DataFrame) -> DataFrame:
    """`arranged` with a column `restored`: the text rebuilt from `output` and `form` alone. An arranged output has each mark
    once, for texts with a mark stay plain and none can arise where a piece meets a mark. Null output or form gives null."""
    parts = F.split("output", f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    with_parts = arranged.withColumn("parts_", F.when(F.col("form") != "plain", parts))
    piece = lambda k: F.get("parts_", F.lit(k))
    text = F.when(F.col("form") == "plain", F.col("output")).when(F.col("form") == "psm", F.concat(piece(1), piece(3), piece(2))).when(F.col("form") == "spm", F.concat(piece(2), piece(3), piece(1)))
    return with_parts.withColumn("restored", text).drop("parts_")


def _sha256(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = restored(arrange(documents(spark, sf_dir).select("doc_id", "text")))
    return found.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", _sha256("output").alias("output_sha256"), _sha256("restored").alias("restored_sha256"))


OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
