"""A table of each key's last row, kept in Parquet files: batches are appended, and a small manifest says which files count.

A writer adds its files first and then the next manifest; readers only see what
a manifest names, so a writer that is lost leaves nothing but unread files. The
next manifest is made by a rename that fails if another writer was faster; then
the change is made again on top of that one's.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import IntegerType, LongType, StructType

#: Segments after which a write also merges them; manifests that are kept.
MOST_SEGMENTS, KEPT_MANIFESTS = 32, 8
TRIES = 20


class KeyedTable:
    """Rows of any schema in `folder`, in `buckets` folders by the hash of the columns `key`; of a key's rows the one that is last by
    `order` (then by the segment it came with) counts. Null keys are keys. The schema is that of the first write."""

    def __init__(self, spark: SparkSession, folder: str, key: tuple[str, ...] = ("key",), order: tuple[str, ...] = ("at", "seq"), buckets: int = 16) -> None:
        self.spark, self.folder, self.key, self.order, self.buckets = spark, folder.rstrip("/"), key, order, buckets
        jvm = spark.sparkContext._jvm
        self._path, self._conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        self._text, kind = jvm.org.apache.commons.io.IOUtils, getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        self._plain = spark.sparkContext._gateway.new_array(kind, 1)
        self._plain[0] = kind.NONE

    # Manifests.
    def manifest(self) -> dict[str, Any]:
        """What the newest manifest says; of a folder without one, an empty table."""
        place = self._path(f"{self.folder}/manifests")
        names = [x.getPath().getName() for x in (self._fs.listStatus(place) if self._fs.exists(place) else [])]
        name = max((x for x in names if x.endswith(".json")), default=None)
        if name is None:
            return {"version": 0, "segments": [], "cuts": [], "batches": {}, "schema": None}
        with_file = self._fs.open(self._path(f"{self.folder}/manifests/{name}"))
        try:
            return json.loads(self._text.toString(with_file, "UTF-8"))
        finally:
            with_file.close()

    def _commit(self, change: Callable[[dict[str, Any]], dict[str, Any] | None]) -> bool:
        """Makes the next manifest from what `change` makes of the newest; False if it makes nothing of it."""
        for _ in range(TRIES):
            now = self.manifest()
            new = change(now)
            if new is None:
                return False
            new["version"] = now["version"] + 1
            made = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}")
            out = self._fs.create(made, False)
            out.write(bytearray(json.dumps(new).encode()))
            out.close()
            try:
                self._context.rename(made, self._path(f"{self.folder}/manifests/{new['version']:012d}.json"), self._plain)
            except Py4JJavaError as failed:
                self._fs.delete(made, False)
                if "FileAlreadyExists" not in failed.java_exception.getClass().getName():
                    raise
                continue
            for v in range(max(1, new["version"] - 2 * KEPT_MANIFESTS), new["version"] - KEPT_MANIFESTS):
                self._fs.delete(self._path(f"{self.folder}/manifests/{v:012d}.json"), False)
            return True
        raise RuntimeError(f"{TRIES} writers were faster: {self.folder}")

    # Rows.
    def _segment(self, rows: DataFrame) -> str:
        path = f"{self.folder}/segments/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        rows.withColumn("bucket_", bucket).repartition(self.buckets, "bucket_").write.partitionBy("bucket_").parquet(path)
        return path

    def _last(self, rows: DataFrame) -> DataFrame:
        names = [c for c in rows.columns if c not in self.key]
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*names), F.struct(*self.order, "segment_")).alias("last_"))
        return last.select(*self.key, "last_.*")

    def put(self, rows: DataFrame, source: str | None = None, batch: int = 0) -> bool:
        """Adds rows. A batch of a `source` that is numbered no higher than one already in is left out: False."""
        if source is not None and self.manifest()["batches"].get(source, -1) >= batch:
            return False
        base = self.manifest()["version"] + 1
        # Of one write's rows only the last of each key can count.
        path = self._segment(self._last(rows.withColumn("segment_", F.lit(base).cast("long"))).select(*rows.columns, "segment_"))
        schema = rows.schema.jsonValue()

        def add(now: dict[str, Any]) -> dict[str, Any] | None:
            if source is not None and now["batches"].get(source, -1) >= batch:
                return None
            batches = now["batches"] | ({source: batch} if source is not None else {})
            return now | {"segments": [*now["segments"], path], "batches": batches, "schema": now["schema"] or schema}

        done = self._commit(add)
        if len(self.manifest()["segments"]) > MOST_SEGMENTS:
            self.compact()
        return done

    def _rows(self, now: dict[str, Any], paths: list[str]) -> DataFrame:
        schema = StructType.fromJson(now["schema"]).add("segment_", LongType()).add("bucket_", IntegerType())
        empty = self.spark.createDataFrame([], schema)
        # Buckets are folders under each segment; a file that can't be read holds no rows.
        parts = [self.spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("basePath", p).parquet(p) for p in paths]
        out = empty
        for p in parts:
            out = out.unionByName(p)
        for cut in now["cuts"]:
            hit = F.col("segment_") < cut["before"]
            for column, value in cut["equals"].items():
                hit = hit & F.col(column).eqNullSafe(F.lit(value))
            out = out.where(~hit)
        return out

    def latest(self, among: DataFrame | None = None) -> DataFrame:
        """Each key's last row; with `among` (the key columns) only rows in the buckets of those keys are read."""
        now = self.manifest()
        if now["schema"] is None:
            raise ValueError(f"nothing was ever put in {self.folder}")
        rows = self._rows(now, now["segments"])
        if among is not None:
            asked = among.select(F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()
            rows = rows.where(F.col("bucket_").isin([r["b"] for r in asked]))
        return self._last(rows.drop("bucket_")).drop("segment_").select(*[f["name"] for f in now["schema"]["fields"]])

    def remove(self, **equals: Any) -> None:
        """Rows put so far that have these values go (all rows without any). Their files go when they are merged."""
        def cut(now: dict[str, Any]) -> dict[str, Any]:
            if not equals:
                return now | {"segments": [], "cuts": []}
            return now | {"cuts": [*now["cuts"], {"equals": equals, "before": now["version"] + 1}]}

        self._commit(cut)

    def compact(self, keep: Column | None = None) -> bool:
        """Merges all segments into one of last rows, of which those under `keep` stay; segments added meanwhile stay beside it.
        False if another merge was faster. Old files stay until `vacuum`, for readers that still hold them."""
        now = self.manifest()
        if now["schema"] is None:
            return False
        rows = self._last(self._rows(now, now["segments"]).drop("bucket_"))
        path = self._segment(rows.where(keep) if keep is not None else rows)

        def swap(found: dict[str, Any]) -> dict[str, Any] | None:
            if not set(now["segments"]) <= set(found["segments"]):
                return None
            return found | {"segments": [path, *[s for s in found["segments"] if s not in now["segments"]]], "cuts": [c for c in found["cuts"] if c not in now["cuts"]]}

        return self._commit(swap)

    def vacuum(self) -> int:
        """Deletes segments that the newest manifest doesn't name; only when no reader or writer is at work. Returns how many."""
        place = self._path(f"{self.folder}/segments")
        live = {s.rsplit("/", 1)[1] for s in self.manifest()["segments"]}
        old = [x.getPath() for x in (self._fs.listStatus(place) if self._fs.exists(place) else []) if x.getPath().getName() not in live]
        for p in old:
            self._fs.delete(p, True)
        return len(old)

    def sink(self, updates: DataFrame, source: str) -> DataStreamWriter:
        """A writer that puts a stream's batches; one that is run again after a failure is left out."""
        return updates.writeStream.foreachBatch(lambda batch, n: self.put(batch, source, n) and None).outputMode("append")


def request_key(namespace: Column, payload: Column) -> Column:
    """The hash of a namespace and a request (a JSON text), whatever the order of its fields; a text that isn't JSON is itself."""
    same = F.coalesce(F.to_json(F.try_parse_json(payload)), payload, F.lit("null"))
    return F.sha2(F.concat(F.coalesce(F.to_json(F.array(namespace)), F.lit("")), same).cast("binary"), 256)


class ResponseCache:
    """Answers to requests with a time to live. Tables of puts have namespace, payload, value (JSON texts), at (seconds) and cacheable,
    tables of gets namespace, payload and now. A cache that isn't enabled takes and gives nothing."""

    def __init__(self, spark: SparkSession, folder: str, enabled: bool = True, buckets: int = 16) -> None:
        self.table, self.enabled = KeyedTable(spark, folder, ("key",), ("at",), buckets), enabled

    def put(self, answers: DataFrame, source: str | None = None, batch: int = 0) -> bool:
        """Stores the answers that may be; those that are tied to a session or a person (cacheable is false or null) are refused."""
        if not self.enabled:
            return False
        may = answers.where("cacheable").select(request_key(F.col("namespace"), F.col("payload")).alias("key"), "namespace", F.col("at").cast("double").alias("at"), "value")
        return self.table.put(may, source, batch)

    def get(self, asked: DataFrame, ttl: float) -> DataFrame:
        """`asked` with value and age in seconds: null where nothing was stored, where it is older than `ttl` or from later than
        `now`, and where the value isn't JSON. A `ttl` of 0 or less gives nothing."""
        none = asked.withColumn("value", F.lit(None).cast("string")).withColumn("age", F.lit(None).cast("double"))
        if not self.enabled or ttl <= 0 or self.table.manifest()["schema"] is None:
            return none
        keyed = asked.withColumn("key", request_key(F.col("namespace"), F.col("payload")))
        stored = self.table.latest(keyed.select("key")).select("key", F.col("value").alias("value_"), "at")
        age = F.col("now").cast("double") - F.col("at")
        fresh = age.between(0.0, float(ttl)) & F.try_parse_json("value_").isNotNull()
        return keyed.join(stored, "key", "left").select(*asked.columns, F.when(fresh, F.col("value_")).alias("value"), F.when(fresh, age).alias("age"))

    def invalidate(self, namespace: str | None = None) -> int:
        """Drops all answers, or one namespace's; returns how many there were."""
        if self.table.manifest()["schema"] is None:
            return 0
        held = self.table.latest()
        n = held.where(F.col("namespace") == namespace).count() if namespace is not None else held.count()
        self.table.remove(**({"namespace": namespace} if namespace is not None else {}))
        return n

    def evict(self, now: float, ttl: float) -> bool:
        """Merges the files and leaves out what has expired."""
        return self.table.compact(F.lit(now) - F.col("at") <= ttl)
