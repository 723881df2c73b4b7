"""Exact duplicates by composable polynomial fingerprints, verified text by text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, narrowed, small_batches, stored

#: Primes below 2**31 and a base for each: together a fingerprint of 124 bits.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1048583, 99990001, 1500450271, 715827883)
#: Bytes per chunk. 255 * 2**31 * 4096 is below 2**53, so float64 sums are exact.
CHUNK = 4096
#: Texts of more characters are cut and their chunks hashed by several tasks.
HUGE = 4_000_000
#: Members of a group that one task compares with the first of them.
PER_TASK = 2000


def _powers() -> np.ndarray:
    out = np.empty((CHUNK, len(PRIMES)))
    for k, (p, base) in enumerate(zip(PRIMES, BASES)):
        x = 1
        for i in range(CHUNK - 1, -1, -1):
            out[i, k] = x
            x = x * base % p
    return out


_POWERS = _powers()
_SHIFT = [pow(base, CHUNK, p) for p, base in zip(PRIMES, BASES)]


def combine(left: tuple[int, ...], right: tuple[int, ...], right_length: int) -> tuple[int, ...]:
    """The hash of two joined byte strings from their hashes and the second one's length."""
    return tuple((x * pow(base, right_length, p) + y) % p for x, y, p, base in zip(left, right, PRIMES, BASES))


def polynomial(data: bytes) -> tuple[int, ...]:
    """Polynomial hashes of `data`: chunk hashes by one matrix product, joined by length-shifted arithmetic."""
    if not data:
        return (0,) * len(PRIMES)
    head = -len(data) % CHUNK  # leading zeros don't change the value
    block = np.zeros(len(data) + head, np.uint8)
    block[head:] = np.frombuffer(data, np.uint8)
    sums = (block.reshape(-1, CHUNK).astype(np.float64) @ _POWERS).astype(np.int64)
    out = []
    for k, p in enumerate(PRIMES):
        x = 0
        for y in sums[:, k].tolist():
            x = (x * _SHIFT[k] + y) % p
        out.append(x)
    return tuple(out)


def _name(value: tuple[int, ...], length: int) -> str:
    return "".join(f"{x:08x}" for x in value) + f"{length:x}"


def _normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False, huge: int = HUGE) -> DataFrame:
    """(id, fp, sha256, text_hash[, text], ...) for each row, with the columns named in `keep`: the polynomial fingerprint with
    the length, and SHA-256, of the text in UTF-8 after A-Z became a-z; XXH64 of the text as it is. A null text counts as empty.

    A text of more than `huge` characters is cut in Spark; its chunks are hashed
    wherever Spark puts them and their shifted hashes are summed.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), *keep)
    names = ["id", "fp", "sha256", "text_hash"] + ["text"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, sha = [], []
            for x in batch.column(1):
                data = _normal(x.as_py())
                fp.append(_name(polynomial(data), len(data)))
                sha.append(hashlib.sha256(data).hexdigest())
            columns = [batch.column(0), pa.array(fp, pa.string()), pa.array(sha, pa.string()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(1)] * with_text + batch.columns[3:], names=names + list(keep))

    schema = "id long, fp string, sha256 string, text_hash long" + ", text string" * with_text + "".join(f", `{c}` {t}" for c, t in rows.dtypes[3:])
    usual = rows.where(F.length("text") <= huge).mapInArrow(run, schema)
    long = rows.where(F.length("text") > huge).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    parts = _huge(long.select("key", "text"), huge)
    out = long.join(parts, "key").select(*names, *keep)
    return usual.unionByName(out)


def _huge(long: DataFrame, huge: int) -> DataFrame:
    """(key, fp, sha256) of long texts: each cut of `huge` characters is hashed apart, then moved to its place and summed."""
    step = huge
    cuts = long.dropDuplicates(["key"]).select("key", F.posexplode(F.transform(F.sequence(F.lit(0), ((F.length("text") - 1) / step).cast("int")), lambda i: F.substring("text", i * step + 1, F.lit(step)))).alias("part", "cut"), F.octet_length("text").alias("n"))
    cuts = cuts.withColumn("bytes", F.octet_length("cut").cast("long")).repartition("key", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [polynomial(_normal(x.as_py())) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(hashes, pa.list_(pa.int64()))], names=["key", "part", "bytes", "h"])

    hashed = cuts.select("key", "part", "cut", "bytes").mapInArrow(run, "key string, part int, bytes long, h array<long>")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = []
            for parts in batch.column(1).to_pylist():
                value, n = (0,) * len(PRIMES), 0
                for x in parts:
                    value, n = combine(value, tuple(x["h"]), x["bytes"]), n + x["bytes"]
                fp.append(_name(value, n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.string())], names=["key", "fp"])

    parts = hashed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "bytes", "h"))).alias("parts"))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sha = long.select("key", F.sha2(lower.cast("binary"), 256).alias("sha256")).dropDuplicates(["key"])
    return parts.mapInArrow(join, "key string, fp string").join(sha, "key")


def _same(x: str, y: str, step: int = 1 << 20) -> bool:
    """Chunk by chunk, whether two texts are equal but for A-Z against a-z."""
    return len(x) == len(y) and all(_normal(x[i : i + step]) == _normal(y[i : i + step]) for i in range(0, len(x), step))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_task: int = PER_TASK, huge: int = HUGE) -> DataFrame:
    """(id, keep_id, group_size, kept, sha256, text_hash): one row for each row of `docs`.

    Texts are equal when identical after lower-casing A-Z only; of equal texts
    the row with the largest id stays. Null counts as empty. Rows with a null id
    count in group_size and are kept only if no row of their group has an id;
    of rows that repeat the largest id all are marked kept. text_hash is XXH64
    of the text as it is. An empty table gives an empty table. Other columns of
    `docs` are not read.

    Fingerprints, which are small, say what occurs once. Only texts whose
    fingerprints occur again are moved: they are dealt by fingerprint and a salt,
    and each task streams them past the first text of its salt, holding two texts
    at a time; then the first texts of a group's salts are streamed past one another.
    Texts that share a fingerprint and differ have other SHA-256 and are other
    groups; two texts that share both and differ would end the job.
    """
    plain = stored(fingerprints(docs, id_col, text_col, huge=huge), "fingerprints")
    groups = stored(plain.groupBy("fp", "sha256").agg(F.count("*").alias("group_size"), F.max("id").alias("keep_id"), F.min("text_hash").alias("text_hash")), "groups")
    alone = groups.where("group_size = 1").select(F.col("keep_id").alias("id"), "keep_id", "group_size", F.lit(True).alias("kept"), "sha256", "text_hash")

    repeated = groups.where("group_size > 1").withColumn("salts", F.ceil(F.col("group_size") / per_task).cast("int")).drop("text_hash")
    forms = stored(plain.select("text_hash", "fp", "sha256").distinct().join(repeated, ["fp", "sha256"]).withColumnsRenamed({"fp": "group_fp", "sha256": "group_sha256"}), "forms")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    again = narrowed(rows.withColumn("text_hash", F.xxhash64("text")), forms, ["text_hash"], spread="id")
    facts = ("group_fp", "group_sha256", "keep_id", "group_size", "salts")
    texts = fingerprints(again, "id", "text", keep=facts, with_text=True, huge=huge).where("fp = group_fp AND sha256 = group_sha256").drop("group_fp", "group_sha256")
    dealt = texts.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    names = ["id", "keep_id", "group_size", "sha256", "text_hash", "fp", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, text = None, ""
        for batch in batches:
            out: dict[str, list] = {name: [] for name in names}
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                new = (row["fp"], row["sha256"], row["salt"]) != key
                if new:
                    key, text = (row["fp"], row["sha256"], row["salt"]), row["text"]
                elif not _same(row["text"], text):
                    raise RuntimeError("two texts share a fingerprint and a SHA-256")
                for name in names[:-1]:
                    out[name].append(row[name])
                out["first"].append(text if new and row["salts"] > 1 else None)
            yield pa.RecordBatch.from_pydict(out, schema=_COMPARED)

    by_salt = dealt.repartition("fp", "sha256", "salt").sortWithinPartitions("fp", "sha256", "salt")
    compared = stored(by_salt.mapInArrow(run, "id long, keep_id long, group_size long, sha256 string, text_hash long, fp string, first string"), "compared")

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, text = None, ""
        for batch in batches:
            for i in range(batch.num_rows):
                name, first = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), batch.column(2)[i].as_py()
                if name != key:
                    key, text = name, first
                elif not _same(first, text):
                    raise RuntimeError("two texts share a fingerprint and a SHA-256")
            yield batch.slice(0, 0).select(["sha256"])

    several = compared.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha256", "text_hash")
    leading = compared.where("first IS NOT NULL").select("fp", "sha256", "first").repartition("fp", "sha256").sortWithinPartitions("fp", "sha256")
    # No rows, but it is read with the others: it fails if a group's salts differ.
    proof = leading.mapInArrow(firsts, "sha256 string").select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(False).alias("kept"), "sha256", F.lit(0).cast("long").alias("text_hash"))
    return alone.unionByName(several).unionByName(proof)


_COMPARED = pa.schema([("id", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("sha256", pa.string()), ("text_hash", pa.int64()), ("fp", pa.string()), ("first", pa.string())])


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


#: DuckDB has no lower-casing of A-Z only; translate() does it.
OP6_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
