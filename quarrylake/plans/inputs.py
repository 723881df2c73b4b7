"""Inputs that queries share: tables by name, and small literal tables for Spark and SQL alike."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors reach. Where it is unset, a temporary one if Spark runs in one
    process; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
        found = "file://" + tempfile.mkdtemp(prefix="quarrylake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def checkpoints(spark: SparkSession) -> SparkSession:
    """The session, with a folder for checkpoints set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: for what several later steps use."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_literal(names: str, rows: list[tuple]) -> str:
    """The same rows as a DuckDB subquery: (VALUES ...) t(names)."""

    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, (int, float)):
            return repr(x)
        if isinstance(x, list):
            return "[" + ", ".join(map(one, x)) + "]"
        quoted = str(x).replace("'", "''")
        if any(ord(c) < 32 for c in quoted):
            return "concat(" + ", ".join(f"chr({ord(c)})" if ord(c) < 32 else f"'{c if c != chr(39) else chr(39) * 2}'" for c in str(x)) + ")"
        return f"'{quoted}'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({names})"


def micro(x: Column) -> Column:
    """A number in whole millionths, the same on all engines."""
    return F.floor(x * 1_000_000 + 0.5).cast("long")


def sql_micro(x: str) -> str:
    return f"CAST(floor(({x}) * 1000000 + 0.5) AS BIGINT)"
