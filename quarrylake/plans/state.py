"""Queries over the log of events: circuits, caches, latency, pacing, retention, metrics. Users play engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import state as A
from .inputs import literal, micro, sql_literal, sql_micro, table


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, at (seconds), seq, ok, value."""
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("double")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("key"), at.alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), "value", "event_type", "user_id")


_LOG = "log AS (SELECT user_id % 50 AS key, epoch_us(ts) / 1000000.0 AS at_s, event_id AS seq, event_type <> 'error' AS ok, value, event_type, user_id FROM events)"
_RUNS = f"""{_LOG}, isl AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY at_s, seq) AS island FROM log),
runs AS (SELECT key, island, count(*) AS failures, min(at_s) AS first_at, max(at_s) AS last_at FROM isl WHERE NOT ok GROUP BY key, island)"""


def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.failure_runs(log(spark, sf_dir)).select("key", "island", "failures", micro(F.col("last_at") - F.col("first_at")).alias("lasted"))


RUNS_SQL = f"WITH {_RUNS} SELECT key, CAST(island AS BIGINT) AS island, failures, {sql_micro('last_at - first_at')} AS lasted FROM runs"


def breaker_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    now = rows.agg(F.max("at").alias("now"))
    found = A.breaker(rows, threshold=2).join(F.broadcast(now), F.lit(True))
    return A.breaker_state(found, F.col("now")).select("key", "failures", "trips", "state")


BREAKER_SQL = f"""WITH {_RUNS}, l AS (SELECT key, arg_max(ok, (at_s, seq)) AS ok FROM log GROUP BY key), n AS (SELECT max(at_s) AS now FROM log),
o AS (SELECT key, count(*) FILTER (failures >= 2) AS trips, arg_max(failures, island) AS failures, max(last_at) AS lf FROM runs GROUP BY key)
SELECT l.key, CAST(CASE WHEN ok THEN 0 ELSE failures END AS INTEGER) AS failures, CAST(coalesce(trips, 0) AS INTEGER) AS trips, CASE WHEN ok OR failures < 2 THEN 'closed' WHEN now - lf >= 300 THEN 'half_open' ELSE 'open' END AS state
FROM l LEFT JOIN o ON l.key = o.key, n"""


def dead_transports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    now = rows.agg(F.max("at").alias("now"))
    tagged = rows.join(F.broadcast(now), F.lit(True))
    found = A.dead_transports(tagged.drop("now"), F.lit(0.0), ttl=1e18)
    return found.select("key", "fails", "dead")


DEAD_SQL = f"""WITH {_LOG}, lo AS (SELECT key, max((at_s, seq)) AS m FROM log WHERE ok GROUP BY key)
SELECT log.key, count(*) AS fails, count(*) >= 2 AS dead FROM log LEFT JOIN lo ON log.key = lo.key WHERE m IS NULL OR (at_s, seq) > m GROUP BY log.key"""


def ewma_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.smoothed_latency(log(spark, sf_dir)).select("key", micro(F.col("ewma") / 1000).alias("ewma_k"))


EWMA_SQL = f"""WITH RECURSIVE {_LOG}, s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_s, seq) AS n FROM log WHERE value > 0),
w AS (SELECT key, n, value AS e FROM s WHERE n = 1 UNION ALL SELECT s.key, s.n, 0.25 * s.value + 0.75 * w.e FROM w JOIN s ON s.key = w.key AND s.n = w.n + 1)
SELECT key, {sql_micro("arg_max(e, n) / 1000")} AS ewma_k FROM w GROUP BY key"""


def request_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    paced = A.pacing(log(spark, sf_dir), 600.0, key="key")
    return paced.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("delay") > 0).alias("delayed"), micro(F.max("delay") / 1000).alias("longest_k"))


PACING_SQL = f"""WITH {_LOG}, a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_s, seq) * 600.0 AS n FROM log),
b AS (SELECT *, max(at_s - n) OVER (PARTITION BY key ORDER BY at_s, seq ROWS UNBOUNDED PRECEDING) + n - at_s AS delay FROM a)
SELECT key, count(*) AS n, count(*) FILTER (delay > 0) AS delayed, {sql_micro("max(delay) / 1000")} AS longest_k FROM b GROUP BY key"""


def cache_ttl_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of one user and type are equal; answers live for six hours."""
    rows = log(spark, sf_dir).withColumn("key", F.sha2(F.to_json(F.struct("user_id", "event_type")), 256))
    return A.cache_hits(rows, 21600.0).groupBy("key").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


CACHE_SQL = f"""WITH RECURSIVE {_LOG}, s AS (SELECT *, sha256('{{"user_id":' || user_id || ',"event_type":"' || event_type || '"}}') AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY at_s, seq) AS n FROM log),
w AS (SELECT k, n, at_s AS stored, FALSE AS hit FROM s WHERE n = 1
 UNION ALL SELECT s.k, s.n, CASE WHEN s.at_s - w.stored <= 21600 THEN w.stored ELSE s.at_s END, s.at_s - w.stored <= 21600 FROM w JOIN s ON s.k = w.k AND s.n = w.n + 1)
SELECT k AS key, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM w GROUP BY k"""


def engine_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engines called for each user's day until two have answered, and the outcome of the chain."""
    rows = log(spark, sf_dir).withColumn("question_id", F.concat_ws(":", "user_id", F.floor(F.col("at") / 86400).cast("long")))
    called = A.run_chain(rows, 2)
    return called.groupBy("question_id").agg(F.count("*").alias("called"), F.count_if("ok").alias("answered"), F.array_join(F.sort_array(F.collect_set(F.when(~F.col("ok"), F.col("key").cast("string")))), ",").alias("failed"))


CHAIN_SQL = f"""WITH {_LOG}, q AS (SELECT *, user_id || ':' || CAST(floor(at_s / 86400) AS BIGINT) AS question_id FROM log),
p AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM q)
SELECT question_id, count(*) AS called, count(*) FILTER (ok) AS answered, coalesce(string_agg(DISTINCT CAST(key AS VARCHAR), ',' ORDER BY CAST(key AS VARCHAR)) FILTER (NOT ok), '') AS failed FROM p WHERE b < 2 GROUP BY question_id"""


def degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engines by outcome for each hour of the day."""
    rows = log(spark, sf_dir).withColumn("hour", F.floor(F.col("at") / 3600).cast("long") % 24)
    out = rows.groupBy("hour").agg(F.countDistinct(F.when(F.col("ok"), F.col("key"))).alias("served"), F.countDistinct(F.when(~F.col("ok"), F.col("key"))).alias("impaired"), F.countDistinct("key").alias("engines"))
    return out.withColumn("degraded", F.col("impaired") > 0)


DEGRADATION_SQL = f"""WITH {_LOG} SELECT CAST(floor(at_s / 3600) AS BIGINT) % 24 AS hour, count(DISTINCT key) FILTER (ok) AS served, count(DISTINCT key) FILTER (NOT ok) AS impaired, count(DISTINCT key) AS engines, count(DISTINCT key) FILTER (NOT ok) > 0 AS degraded FROM log GROUP BY 1"""

BUCKETS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


def metrics_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative histogram of values: how many are at most each bound, by event type."""
    e = table(spark, sf_dir, "events")
    wide = e.groupBy("event_type").agg(F.count("value").alias("n"), *[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(BUCKETS)])
    return wide.select("event_type", "n", F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("c")) for i, b in enumerate(BUCKETS)])).alias("x")).select("event_type", "n", micro(F.col("x.le")).alias("le"), F.col("x.c").alias("at_most"))


HISTOGRAM_SQL = f"SELECT event_type, n, {sql_micro('le')} AS le, at_most FROM (SELECT event_type, count(value) AS n FROM events GROUP BY 1) JOIN (SELECT event_type AS t, le, count(*) FILTER (value <= le) AS at_most FROM events, (SELECT unnest({BUCKETS}) AS le) GROUP BY 1, 2) ON t = event_type"


def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.nearest_rank(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice", [0.5, 0.95, 0.99])
    return found.select("l_returnflag", micro(F.col("fraction")).alias("fraction"), micro(F.col("l_extendedprice")).alias("value"))


RANK_SQL = f"""WITH v AS (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem), f AS (SELECT unnest([0.5, 0.95, 0.99]) AS f)
SELECT l_returnflag, {sql_micro("f")} AS fraction, {sql_micro("l_extendedprice")} AS value FROM v, f WHERE r = greatest(1, least(n, CAST(round_even(f * n + 0.5, 0) AS BIGINT)))"""


def rates_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and failures by event type and engine group, with subtotals."""
    rows = log(spark, sf_dir).withColumn("split", (F.col("key") % 3).cast("int"))
    return rows.rollup("split", "event_type").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failed"), F.grouping_id().cast("int").alias("level"))


ROLLUP_SQL = f"WITH {_LOG} SELECT CAST(key % 3 AS INTEGER) AS split, event_type, count(*) AS n, count(*) FILTER (NOT ok) AS failed, CAST(grouping(key % 3, event_type) AS INTEGER) AS level FROM log GROUP BY ROLLUP (key % 3, event_type)"


def family_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each cause occurs in each family: event types by hour of the day, pivoted."""
    types = ["click", "error", "purchase", "signup", "view"]
    rows = table(spark, sf_dir, "events").select((F.hour("ts") % 6).alias("family"), "event_type")
    return rows.groupBy("family").agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in types], F.count_if(~F.col("event_type").isin(types)).alias("other"))


CAUSES_SQL = "SELECT CAST(hour(ts) % 6 AS INTEGER) AS family, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + ", count(*) FILTER (event_type NOT IN ('click', 'error', 'purchase', 'signup', 'view')) AS other FROM events GROUP BY 1"


def mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank and nDCG at 5 of each source's labelled documents, ranked by length."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")))
    ideal = F.row_number().over(Window.partitionBy("source").orderBy(F.col("quality").desc(), "doc_id"))
    gain = lambda place: F.when((F.col("quality") == 1) & (F.col(place) <= 5), 1 / F.log2(F.col(place) + 1)).otherwise(0.0)
    out = rows.withColumn("ideal", ideal).groupBy("source").agg(F.min(F.when(F.col("quality") == 1, F.col("place"))).alias("first"), F.sum(gain("place")).alias("dcg"), F.sum(gain("ideal")).alias("best"))
    return out.select("source", micro(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), micro(F.floor(F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(1.0) * 10000 + 0.5) / 10000).alias("ndcg"))


NDCG_SQL = f"""WITH r AS (SELECT source, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place, row_number() OVER (PARTITION BY source ORDER BY quality DESC, doc_id) AS ideal FROM labels JOIN documents USING (doc_id)),
g AS (SELECT source, min(place) FILTER (quality = 1) AS first, sum(CASE WHEN quality = 1 AND place <= 5 THEN 1 / log2(place + 1) ELSE 0 END) AS dcg, sum(CASE WHEN quality = 1 AND ideal <= 5 THEN 1 / log2(ideal + 1) ELSE 0 END) AS best FROM r GROUP BY source)
SELECT source, {sql_micro("coalesce(1 / first, 0.0)")} AS mrr, {sql_micro("floor((CASE WHEN best > 0 THEN dcg / best ELSE 1.0 END) * 10000 + 0.5) / 10000")} AS ndcg FROM g"""


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 100 documents balanced over languages, by SHA-256 of the id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    sizes = d.groupBy("lang").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    quota = sizes.join(F.broadcast(total), F.lit(True)).select("lang", F.greatest(F.lit(1), F.bround(100 * F.col("n") / F.col("total")).cast("int")).alias("quota"))
    placed = d.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    return placed.where("place <= 100").join(F.broadcast(quota), "lang").where("place <= quota").select("doc_id", "lang", "place")


SAMPLE_SQL = """WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS place, count(*) OVER (PARTITION BY lang) AS n, count(*) OVER () AS total FROM documents)
SELECT doc_id, lang, place FROM d WHERE place <= greatest(1, CAST(round_even(100 * n / total, 0) AS INTEGER))"""


def session_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five turns of each conversation."""
    c = table(spark, sf_dir, "conversations")
    return A.retain(c.select("conv_id", "turn", "role"), 5, "conv_id", "turn", "turn")


RETENTION_SQL = "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5"


def discoveries_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of discoveries united by URL: the first title that isn't empty, the latest time."""
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[^?#]*", 0).alias("url"), F.when(F.col("page_id") % 3 != 0, T.html_title(F.col("html"))).alias("title"), F.col("page_id").alias("at"))
    both = p.where("at % 2 = 0").withColumn("list", F.lit(0)).unionByName(p.withColumn("list", F.lit(1)))
    return both.groupBy("url").agg(F.min(F.when(F.col("title") != "", F.struct("list", "at", "title"))).alias("t"), F.max("at").alias("at")).select("url", "t.title", "at")


MERGED_SQL = """WITH p AS (SELECT regexp_extract(url, '^[^?#]*') AS url, CASE WHEN page_id % 3 <> 0 THEN trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) END AS title, page_id AS at_id FROM pages),
b AS (SELECT *, 0 AS l FROM p WHERE at_id % 2 = 0 UNION ALL SELECT *, 1 FROM p)
SELECT url, arg_min(title, (l, at_id)) FILTER (title <> '') AS title, max(at_id) AS "at" FROM b GROUP BY url"""


def lexicon_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that label 0 texts have and label 1 texts hardly: counts of texts by word and quality."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    words = rows.select("quality", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("word"))
    counts = words.groupBy("word").agg(F.count_if(F.col("quality") == 0).alias("shape"), F.count_if(F.col("quality") == 1).alias("topic"))
    return counts.where("shape >= 2 AND (topic = 0 OR shape >= 3 * topic)")


LEXICON_SQL = """WITH w AS (SELECT quality, unnest(list_distinct(regexp_extract_all(lower(text), '\\p{L}+'))) AS word FROM labels JOIN documents USING (doc_id))
SELECT word, count(*) FILTER (quality = 0) AS shape, count(*) FILTER (quality = 1) AS topic FROM w GROUP BY word HAVING count(*) FILTER (quality = 0) >= 2 AND (count(*) FILTER (quality = 1) = 0 OR count(*) FILTER (quality = 0) >= 3 * count(*) FILTER (quality = 1))"""

QUERIES = {
    "failure_runs": failure_runs, "breaker_state": breaker_state, "dead_transports": dead_transports, "ewma_latency": ewma_latency, "request_pacing": request_pacing, "cache_ttl_hits": cache_ttl_hits,
    "engine_chain": engine_chain, "degradation": degradation, "metrics_histogram": metrics_histogram, "nearest_rank_percentile": nearest_rank, "rates_rollup": rates_rollup, "family_causes": family_causes,
    "mrr_ndcg": mrr_ndcg, "hash_sample": hash_sample, "session_retention": session_retention, "discoveries_merged": discoveries_merged, "lexicon_mining": lexicon_mining,
}
SQL = {
    "failure_runs": RUNS_SQL, "breaker_state": BREAKER_SQL, "dead_transports": DEAD_SQL, "ewma_latency": EWMA_SQL, "request_pacing": PACING_SQL, "cache_ttl_hits": CACHE_SQL,
    "engine_chain": CHAIN_SQL, "degradation": DEGRADATION_SQL, "metrics_histogram": HISTOGRAM_SQL, "nearest_rank_percentile": RANK_SQL, "rates_rollup": ROLLUP_SQL, "family_causes": CAUSES_SQL,
    "mrr_ndcg": NDCG_SQL, "hash_sample": SAMPLE_SQL, "session_retention": RETENTION_SQL, "discoveries_merged": MERGED_SQL, "lexicon_mining": LEXICON_SQL,
}
