"""Queries over pages as texts, streams of events read in batches of files, and the captured data source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..operators import state as A
from ..sources import service as V
from ..sources.keyed import KeyedTable, ResponseCache
from ..streaming import state as W
from . import state as L
from .inputs import literal, shared_folder, sql_literal, table


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main content of each page as markdown: its length, first line and whether it looks like a shell."""
    p = table(spark, sf_dir, "pages").select("page_id", H.to_markdown(F.col("html")).alias("md"))
    return p.select("page_id", F.length("md").alias("chars"), F.regexp_extract("md", "^[^\n]*", 0).alias("first"), T.is_script_shell(F.col("md")).alias("shell"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", H.to_text(F.col("html")).alias("text"))
    return p.select("page_id", F.length("text").alias("chars"), F.size(T.sentences(F.col("text"))).alias("sentences"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _run(spark: SparkSession, out: DataFrame, name: str, mode: str) -> DataFrame:
    """The result of a stream that ends when its input does, written to the shared folder."""
    folder = _folder(spark)
    if mode == "append":
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    else:
        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")

        query = out.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    at = F.col("ts").cast("timestamp")
    # A stream reads a folder: the table's own one, or the folder of its file with that file alone.
    lone = spark.read.parquet(source).inputFiles()
    path, only = (source, "*.parquet") if any("/events.parquet/" in x for x in lone) else (sf_dir, "events.parquet")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", only).parquet(path)
    return stream.select((F.col("user_id") % 50).alias("key"), at.alias("ts"), (F.unix_micros(at) / 1_000_000).alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), "value", "event_type")


def breaker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The circuits of the log as a stream leaves them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", W.ROCKSDB)
    out = _run(spark, W.breaker_stream(_events(spark, sf_dir), 2), "breaker", "update")
    return out.groupBy("key").agg(F.max_by(F.struct("failures", "trips"), "batch").alias("s")).select("key", "s.failures", "s.trips")


BREAKER_SQL = """WITH log AS (SELECT user_id % 50 AS key, ts, event_id AS seq, event_type <> 'error' AS ok FROM events), isl AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, seq) AS island FROM log),
runs AS (SELECT key, island, count(*) AS failures FROM isl WHERE NOT ok GROUP BY key, island), l AS (SELECT key, arg_max(ok, (ts, seq)) AS ok FROM log GROUP BY key), o AS (SELECT key, count(*) FILTER (failures >= 2) AS trips, arg_max(failures, island) AS failures FROM runs GROUP BY key)
SELECT l.key, CAST(CASE WHEN ok THEN 0 ELSE failures END AS INTEGER) AS failures, CAST(coalesce(trips, 0) AS INTEGER) AS trips FROM l LEFT JOIN o ON l.key = o.key"""


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type, from a stream; windows that the watermark closed."""
    out = _run(spark, W.windows(_events(spark, sf_dir), "1 hour", late="0 seconds"), "windows", "complete")
    return out.groupBy("begin", "event_type").agg(F.max_by("events", "batch").alias("events")).select(F.unix_timestamp("begin").alias("begin"), "event_type", "events")


WINDOWS_SQL = "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS begin, event_type, count(*) AS events FROM events GROUP BY 1, 2"


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users' events with gaps below six hours."""
    at = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("key"), at.alias("ts"))
    found = W.sessions(rows, gap="6 hours")
    return found.select("key", F.unix_micros("begin").alias("begin"), F.unix_micros("end").alias("end"), "events")


SESSIONS_SQL = """WITH e AS (SELECT user_id % 50 AS key, epoch_us(ts) AS t FROM events), g AS (SELECT key, t, CASE WHEN t - lag(t) OVER (PARTITION BY key ORDER BY t) < 21600000000 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT key, t, sum(new) OVER (PARTITION BY key ORDER BY t RANGE UNBOUNDED PRECEDING) AS n FROM g) SELECT key, min(t) AS begin, max(t) + 21600000000 AS "end", count(*) AS events FROM s GROUP BY key, n"""


def first_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the log that a stream of first requests lets through; all of the log is one batch."""
    out = _run(spark, W.first_requests(_events(spark, sf_dir), "3650 days").select("key", "ts"), "first", "append")
    return out.groupBy("key").agg(F.count("*").alias("asked"))


def session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's last event, as a stream that merges into a table leaves it."""
    folder = _folder(spark)
    rows = _events(spark, sf_dir).select("key", "at", "seq", "ok", "event_type")
    table = KeyedTable(spark, f"{folder}/table")
    W.keep_latest(rows, table).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table.latest().select("key", "seq", "ok", "event_type")


def response_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as answers and questions of a cache: what three of four requests answer is stored in two batches, errors are refused,
    one namespace is dropped and one is expired; then each user's request is asked for in each namespace."""
    e = table(spark, sf_dir, "events")
    payload = F.concat(F.lit('{"user": '), (F.col("user_id") % 50).cast("string"), F.lit(', "k": 1}'))
    made = e.where("event_id % 4 <> 0").select("event_id", F.col("event_type").alias("namespace"), payload.alias("payload"), F.concat(F.lit('{"n": '), F.col("event_id").cast("string"), F.lit("}")).alias("value"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"), (F.col("event_type") != "error").alias("cacheable"))
    cache = ResponseCache(spark, f"{_folder(spark)}/cache")
    cache.put(made.where("event_id % 2 = 0").drop("event_id"), "log", 0)
    cache.put(made.where("event_id % 2 = 1").drop("event_id"), "log", 1)
    cache.put(made.drop("event_id"), "log", 1)  # the same batch again
    cache.invalidate("signup")
    cache.table.compact()
    now = e.agg(F.unix_micros(F.max("ts").cast("timestamp")).cast("double").alias("now"))
    asked = e.select(F.col("event_type").alias("namespace"), F.concat(F.lit('{"k":1,"user":'), (F.col("user_id") % 50).cast("string"), F.lit("}")).alias("payload")).distinct().crossJoin(F.broadcast(now))
    found = cache.get(asked, CACHE_TTL)
    return found.select("namespace", "payload", "value", F.col("age").cast("long").alias("age"))


#: A week, in microseconds, as the log's times are.
CACHE_TTL = 7 * 24 * 3600 * 1e6

CACHE_SQL = f"""WITH e AS (SELECT event_id, event_type, user_id % 50 AS u, epoch_us(ts) AS t FROM events), last AS (SELECT event_type, u, max(t) AS t, arg_max(event_id, t) AS n FROM e WHERE event_id % 4 <> 0 AND event_type NOT IN ('error', 'signup') GROUP BY 1, 2),
asked AS (SELECT DISTINCT event_type, u FROM e), now AS (SELECT max(t) AS now FROM e)
SELECT a.event_type AS namespace, '{{"k":1,"user":' || a.u || '}}' AS payload, CASE WHEN now - l.t <= {int(CACHE_TTL)} THEN '{{"n": ' || l.n || '}}' END AS value, CASE WHEN now - l.t <= {int(CACHE_TTL)} THEN CAST(now - l.t AS BIGINT) END AS age FROM asked a CROSS JOIN now LEFT JOIN last l ON l.event_type = a.event_type AND l.u = a.u"""


def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each run of failures of the log would wait in all, if each failure were tried again."""
    runs = A.failure_runs(L.log(spark, sf_dir)).select("key", "island", F.explode(F.sequence(F.lit(1), F.col("failures").cast("int"))).alias("attempt"))
    return runs.groupBy("key").agg(F.sum(A.retry_delay(F.col("attempt"))).cast("long").alias("waited"))


DELAYS_SQL = f"WITH {L._RUNS} SELECT key, CAST(sum(list_sum(list_transform(range(1, failures + 1), lambda i: least(8, pow(2, i - 1))))) AS BIGINT) AS waited FROM runs GROUP BY key"


def captured_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as answers that three services gave, captured in files; one service's first places are asked for."""
    i = F.col("page_id")
    hits = table(spark, sf_dir, "pages").select(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (i % 3 + 1).cast("int")).alias("engine"), F.concat(F.lit("q"), (i % 5).cast("string")).alias("query"), (F.floor(i / 15) + 1).cast("int").alias("position"), F.concat(F.lit("Page "), i.cast("string")).alias("title"), "url")
    folder = f"{shared_folder(spark).rstrip('/')}/captured-{uuid.uuid4().hex}"
    hits.write.partitionBy("engine").json(folder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(V.CapturedHits)
    return spark.read.format("captured_hits").option("path", folder).load().where("engine = 'a' AND position <= 10")


def filter_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.filter_modes(spark, literal(spark, "question_id int, active array<string>", [(1, ["include_domains", "date"]), (2, ["file_type"]), (3, [])]))


QUERIES = {"page_markdown": page_markdown, "page_text": page_text, "breaker_stream": breaker_stream, "event_windows": event_windows, "user_sessions": user_sessions, "first_requests": first_requests, "session_table": session_table, "response_cache": response_cache, "retry_delays": retry_delays, "captured_hits": captured_hits, "filter_modes": filter_modes}
SQL = {
    "breaker_stream": BREAKER_SQL,
    "event_windows": WINDOWS_SQL,
    "user_sessions": SESSIONS_SQL,
    "first_requests": "SELECT user_id % 50 AS key, 1 AS asked FROM events GROUP BY 1",
    "session_table": "SELECT user_id % 50 AS key, arg_max(event_id, (ts, event_id)) AS seq, arg_max(event_type <> 'error', (ts, event_id)) AS ok, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1",
    "response_cache": CACHE_SQL,
    "retry_delays": DELAYS_SQL,
    "captured_hits": "SELECT 'a' AS engine, 'q' || (page_id % 5) AS query, CAST(page_id // 15 + 1 AS INTEGER) AS position, 'Page ' || page_id AS title, url FROM pages WHERE page_id % 3 = 0 AND page_id // 15 + 1 <= 10",
    "filter_modes": "SELECT * FROM " + sql_literal("question_id, engine, filter, mode", [(1, "a", "include_domains", "native"), (1, "a", "date", "post_filtered"), (1, "b", "include_domains", "emulated"), (1, "b", "date", "unsupported"), (1, "c", "include_domains", "unsupported"), (1, "c", "date", "unsupported"), (2, "a", "file_type", "unsupported"), (2, "b", "file_type", "emulated"), (2, "c", "file_type", "unsupported")]),
}
