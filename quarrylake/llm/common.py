"""Helpers that several operators share: scratch tables, folds, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where that is unset, a temporary one if Spark runs in one process;
    on a cluster, where executors would each write to a disk of their own, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
        found = "file://" + tempfile.mkdtemp(prefix="quarrylake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Bytes of a batch that goes to a Python worker. Spark's own limit lets a task hold several times 64 MB beside its heap.
BATCH_BYTES = 16_000_000


def small_batches(spark: SparkSession) -> None:
    """Keeps batches with texts of any length small; a lower limit that is already set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back, in a folder for each value of `by` if given.

    Later steps then depend on files that every executor can read, so a lost
    executor costs no recomputation of what came before.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of keys that may be sent to every executor.
FEW_KEYS = 500_000


#: Parts in which a key's rows are shuffled.
SPREAD = 32


def narrowed(rows: DataFrame, keys: DataFrame, by: list[str], few: int = FEW_KEYS, spread: str | None = None) -> DataFrame:
    """`rows` joined with `keys` (small columns, stored) by `by`: while there are few keys the rows don't move; beyond, both
    sides are shuffled, the rows of each key in SPREAD parts by a hash of the column `spread` if that is given."""
    if keys.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(keys), by)
    if spread:
        rows = rows.withColumn("part_", F.pmod(F.xxhash64(spread), F.lit(SPREAD)).cast("int"))
        keys = keys.withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        return rows.join(keys.hint("shuffle_merge"), [*by, "part_"]).drop("part_")
    return rows.join(keys.hint("shuffle_merge"), by)


def forget(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list of longs.

    Returns (node, component): one row per node that has an edge to another
    node; component is the smallest node of its component. Self-loops, repeated
    edges and nulls are ignored; no edges give an empty table.

    Alternates large-star and small-star steps; each step is two aggregations
    and joins on node ids, and every round is written to the shared folder, so
    neither the plan nor any task grows with a component.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    edges = stored(edges.select(hi.alias("v"), lo.alias("m")).where("v <> m").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("r")).withColumn("r", F.least("r", "v"))
        large = both.join(least, "v").where("m > v").select(F.col("m").alias("v"), F.col("r").alias("m"))
        large = large.where("v <> m").distinct()
        first = large.groupBy("v").agg(F.min("m").alias("r"))
        small = large.join(first, "v").select(F.explode(F.array(F.struct("v", "r"), F.struct(F.col("m").alias("v"), "r"))).alias("x"))
        edges = stored(small.select(F.col("x.v").alias("v"), F.col("x.r").alias("m")).where("v <> m").distinct(), "edges")
        inner = edges.select(F.col("v").alias("m"))
        if edges.join(inner, "m", "left_semi").isEmpty():
            # Stars only, but a node may still hang on two centres.
            twice = edges.groupBy("v").agg(F.count("*").alias("n")).where("n > 1")
            if twice.isEmpty():
                return edges.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(
                    edges.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
                )
