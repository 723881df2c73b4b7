"""Which source reads a URL, and what else a table of host suffixes says of it: rules are a table that hosts are joined with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url as U

# Sources in their order with the hosts that they read (subdomains too), and what a feed's URL contains.
SOURCES = [
    ("github", ["github.com"]), ("youtube", ["youtube.com", "youtu.be"]), ("twitter", ["x.com", "twitter.com"]), ("reddit", ["reddit.com", "redd.it"]), ("indiehackers", ["indiehackers.com"]),
    ("bilibili", ["bilibili.com", "b23.tv"]), ("xiaohongshu", ["xiaohongshu.com", "xhslink.com"]), ("v2ex", ["v2ex.com"]), ("xueqiu", ["xueqiu.com"]), ("boss", ["zhipin.com"]), ("linkedin", ["linkedin.com"]),
    ("facebook", ["facebook.com", "fb.com", "fb.watch"]), ("instagram", ["instagram.com"]), ("transcribe", ["xiaoyuzhoufm.com"]),
]
FEED_SOURCE, FEED_MARKS = "rss", ["/feed", "/rss", ".xml", "atom", "rss."]

#: Rules on a URL's text are tried one by one, so there may be this many.
MOST_TEXT_RULES = 500


def rules(spark: SparkSession) -> DataFrame:
    """(priority, source, kind, pattern): the sources above; kind is `host` or `text`."""
    rows = [(n, name, "host", h) for n, (name, hosts) in enumerate(SOURCES) for h in hosts] + [(len(SOURCES), FEED_SOURCE, "text", m) for m in FEED_MARKS]
    return spark.createDataFrame(rows, "priority int, source string, kind string, pattern string")


def suffixes(host: Column) -> Column:
    """A host and all that is left of it without its first labels, the longest first."""
    labels = F.split(host, r"\.")
    return F.when(host != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))


def by_host(urls: DataFrame, table: DataFrame, best: Column, name: str, url: str = "url") -> DataFrame:
    """`urls` with `name`: an aggregate of the rows of `table` (suffix, ...) whose suffix is the URL's host or ends it at a dot; null
    without any. Each host is looked up once, and meets the table by equal texts, however large that is."""
    rows = urls.withColumn("host_", U.domain(F.col(url)))
    hosts = rows.select("host_").where("host_ <> ''").distinct()
    met = hosts.select("host_", F.explode(suffixes(F.col("host_"))).alias("suffix")).join(table, "suffix")
    found = met.groupBy("host_").agg(best.alias(name))
    return rows.join(found, "host_", "left").drop("host_")


def routed(urls: DataFrame, by: DataFrame, url: str = "url") -> DataFrame:
    """`urls` with `source`: that of the first rule, by priority, that a URL meets; null for those that only a general reader can
    read. Rules (priority, source, kind, pattern) of kind `host` hold for a host and its subdomains, those of kind `text` where the
    URL contains the pattern, whatever its case. A null URL has no source."""
    texts = by.where("kind = 'text'").select("priority", "source", F.lower("pattern").alias("pattern")).limit(MOST_TEXT_RULES + 1).collect()
    if len(texts) > MOST_TEXT_RULES:
        raise ValueError(f"more than {MOST_TEXT_RULES} rules on texts")
    hosts = by.where("kind = 'host'").select(F.lower("pattern").alias("suffix"), F.struct("priority", "source").alias("rule"))
    low = F.lower(F.col(url))
    said = F.lit(None).cast("struct<priority: int, source: string>")
    for r in sorted(texts, key=lambda r: -r["priority"]):
        said = F.when(low.contains(r["pattern"]), F.struct(F.lit(r["priority"]).alias("priority"), F.lit(r["source"]).alias("source"))).otherwise(said)
    found = by_host(urls, hosts, F.min("rule"), "host_rule_", url).withColumn("text_rule_", said)
    first = F.when(F.col("text_rule_").isNull() | (F.col("host_rule_") <= F.col("text_rule_")), F.col("host_rule_")).otherwise(F.col("text_rule_"))
    return found.withColumn("source", first["source"]).drop("host_rule_", "text_rule_")


def longest_suffix(urls: DataFrame, weights: DataFrame, default: float, name: str = "authority", url: str = "url") -> DataFrame:
    """`urls` with the weight of the longest suffix (suffix, weight) of each host, `default` without one."""
    table = weights.select(F.lower(F.regexp_replace("suffix", r"^\.", "")).alias("suffix"), "weight")
    return by_host(urls, table, F.max_by("weight", F.length("suffix")), name, url).fillna(default, [name])
