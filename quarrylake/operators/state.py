"""State of engines, hosts and caches from logs of what happened: runs, circuits, pacing, smoothing, retention.

What order decides is said by windows: runs of failures, ranks, running maxima.
Only cache entries, whose age depends on which requests were answered from the
cache, fold each key's requests. `streaming/state.py` has such states for streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
THRESHOLD, COOLDOWN, BLOCKED_COOLDOWN, MAX_COOLDOWN = 3, 300.0, 900.0, 21600.0
SMOOTH = 0.25
#: 0.75 to this power is zero in double precision.
TELLING = 2700
TRANSPORT_FAILURES, TRANSPORT_TTL = 2, 900.0
RETRY_BASE, RETRY_MOST = 1.0, 8.0
SEARCH_TTL, PAGE_TTL = 300, 3600


def breaker(log: DataFrame, key: str = "key", at: str = "at", ok: str = "ok", seq: str = "seq", threshold: int = THRESHOLD) -> DataFrame:
    """(key, failures, opened_at, trips): each key's circuit after its events in order: consecutive failures, when it last
    opened (null: closed), and how often it opened. A failure while open opens it anew; a success closes it.

    So a circuit is what its runs of failures are: a run of `threshold` opens it, and its last failure is when.
    """
    runs = failure_runs(log, key, at, ok, seq)
    last = log.groupBy(key).agg(F.max(F.struct(F.col(at).alias("at"), F.col(seq).alias("seq"), F.col(ok).alias("ok"))).alias("last"))
    of = runs.groupBy(key).agg(F.count_if(F.col("failures") >= threshold).cast("int").alias("trips"), F.max_by("failures", "island").alias("failures"), F.max("last_at").alias("last_fail"))
    down = ~F.col("last.ok")
    failures = F.when(down, F.col("failures")).otherwise(0).cast("int")
    return last.join(of, key, "left").select(key, failures.alias("failures"), F.when(down & (F.col("failures") >= threshold), F.col("last_fail")).alias("opened_at"), F.coalesce("trips", F.lit(0)).alias("trips"))


def persistent_breaker(log: DataFrame, key: str = "key", at: str = "at", ok: str = "ok", seq: str = "seq", kind: str = "kind", threshold: int = THRESHOLD) -> DataFrame:
    """(key, failures, kind, open_until): circuits that survive restarts, after each key's events in order.

    A captcha or a rate limit opens at once, other failures from `threshold` in a
    row; a failure while open opens anew. The wait doubles with the run: from
    the first blocked failure, or from the threshold, up to six hours. open_until
    is null for a closed circuit; failures and kind are of the run at the end.
    """
    order = Window.partitionBy(key, "island").orderBy(at, seq)
    blocked = F.coalesce(F.col(kind).isin("captcha", "rate_limited"), F.lit(False))
    before = F.sum(F.col(ok).cast("int")).over(Window.partitionBy(key).orderBy(at, seq).rowsBetween(Window.unboundedPreceding, 0))
    fails = log.withColumn("island", before).where(~F.col(ok)).withColumn("blocked", blocked).withColumn("streak", F.row_number().over(order))
    opens = F.col("blocked") | (F.col("streak") >= threshold)
    fails = fails.withColumn("opened", F.max(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last_ok = log.groupBy(key).agg(F.max(F.struct(F.col(at).alias("at"), F.col(seq).alias("seq"), F.col(ok).alias("ok"))).alias("last"))
    end = fails.groupBy(key).agg(F.max(F.struct(F.col(at).alias("at"), F.col(seq).alias("seq"), "streak", "blocked", "opened", F.col(kind).alias("kind"))).alias("f"))
    rows = last_ok.join(end, key, "left")
    steps = F.least(F.lit(10), F.when(F.col("f.blocked"), F.col("f.streak") - 1).otherwise(F.greatest(F.lit(0), F.col("f.streak") - threshold)))
    wait = F.least(F.lit(MAX_COOLDOWN), F.when(F.col("f.blocked"), BLOCKED_COOLDOWN).otherwise(COOLDOWN) * F.pow(F.lit(2.0), steps))
    down = ~F.col("last.ok")
    return rows.select(key, F.when(down, F.col("f.streak")).otherwise(0).cast("int").alias("failures"), F.when(down, F.coalesce("f.kind", F.lit("unavailable"))).alias("kind"), F.when(down & F.col("f.opened"), F.col("f.at") + wait).alias("open_until"))


def rotated(requests: DataFrame, instances: DataFrame, cooling: DataFrame) -> DataFrame:
    """(request, nth, instance): the order in which each request tries instances: round robin, without those that cool.

    `requests` has request (0, 1, ...) and at; `instances` place (0, 1, ...) and
    instance; `cooling` instance and until. Instances are a small table.
    """
    n = instances.count()
    tried = requests.join(F.broadcast(instances), F.lit(True))
    up = tried.join(F.broadcast(cooling), (tried["instance"] == cooling["instance"]) & (cooling["until"] > tried["at"]), "left_anti")
    order = Window.partitionBy("request").orderBy(F.pmod(F.col("place") - F.col("request"), F.lit(max(n, 1))))
    return up.withColumn("nth", F.row_number().over(order)).select("request", "nth", "instance")


def breaker_state(found: DataFrame, now: Column, cooldown: float = COOLDOWN) -> DataFrame:
    """Adds closed, open or half_open at `now`."""
    return found.withColumn("state", F.when(F.col("opened_at").isNull(), "closed").when(now - F.col("opened_at") >= cooldown, "half_open").otherwise("open"))


def failure_runs(log: DataFrame, key: str = "key", at: str = "at", ok: str = "ok", seq: str = "seq") -> DataFrame:
    """(key, failures, first_at, last_at): each run of consecutive failures of a key, by the number of successes before it."""
    before = F.sum(F.col(ok).cast("int")).over(Window.partitionBy(key).orderBy(at, seq).rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumn("island", before).where(~F.col(ok)).groupBy(key, "island").agg(F.count("*").alias("failures"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def dead_transports(log: DataFrame, now: Column, key: str = "key", at: str = "at", ok: str = "ok", seq: str = "seq", failures: int = TRANSPORT_FAILURES, ttl: float = TRANSPORT_TTL) -> DataFrame:
    """Keys whose last events are at least `failures` failures, the last of them no more than `ttl` ago: (key, fails, last_fail, dead)."""
    last_ok = log.where(ok).groupBy(key).agg(F.max(F.struct(at, seq)).alias("last_ok"))
    tail = log.join(last_ok, key, "left").where(F.col("last_ok").isNull() | (F.struct(at, seq) > F.col("last_ok")))
    out = tail.groupBy(key).agg(F.count("*").alias("fails"), F.max(at).alias("last_fail"))
    return out.withColumn("dead", (F.col("fails") >= failures) & (now - F.col("last_fail") <= ttl))


def smoothed_latency(log: DataFrame, key: str = "key", at: str = "at", value: str = "value", seq: str = "seq", weight: float = SMOOTH) -> DataFrame:
    """(key, ewma): exponentially smoothed latency; the first one that isn't zero starts it and zeros change nothing.

    The smoothing is a sum of values weighted by how many came after. A value
    that thousands came after weighs less than a double can tell: each key's last
    ones suffice, and Spark keeps no more of a key than those.
    """
    some = log.where(F.col(value) > 0)
    first = some.groupBy(key).agg(F.min(F.struct(at, seq)).alias("first"))
    after = F.row_number().over(Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(seq).desc()))
    last = some.withColumn("after", after).where(F.col("after") <= TELLING).join(first, key)
    share = F.when(F.struct(at, seq) == F.col("first"), 1.0).otherwise(weight) * F.pow(F.lit(1 - weight), F.col("after") - 1)
    return last.groupBy(key).agg(F.sum(share * F.col(value)).alias("ewma"))


def pacing(log: DataFrame, gap: float, key: str = "host", at: str = "at", seq: str = "seq") -> DataFrame:
    """(host, at, seq, starts, delay): when each request may start if those of a host keep `gap` between them.

    The n-th request starts at the latest of its own time and the starts that
    earlier ones force: a running maximum of at - n * gap, plus n * gap.
    """
    order = Window.partitionBy(key).orderBy(at, seq)
    n = F.row_number().over(order) * gap
    starts = F.max(F.col("slack")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("n")
    out = log.withColumn("n", n).withColumn("slack", F.col(at) - F.col("n")).withColumn("starts", starts)
    return out.select(key, at, seq, "starts", (F.col("starts") - F.col(at)).alias("delay"))


def cache_hits(log: DataFrame, ttl: float, key: str = "key", at: str = "at", seq: str = "seq") -> DataFrame:
    """Adds `hit`: whether an equal request was stored at most `ttl` before. Every miss stores its answer, so an entry's age
    counts from the last miss.

    A request later than `ttl` after the one before it is a miss whatever came
    earlier: a key's log falls into stretches there. Only the times of one stretch
    are folded at once, to its misses.
    """
    order = Window.partitionBy(key).orderBy(at, seq)
    begins = F.coalesce(F.col(at) - F.lag(at).over(order) > ttl, F.lit(True))
    rows = log.select(key, at, seq, begins.cast("int").alias("begins")).withColumn("stretch", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("begins")
    times = rows.groupBy(key, "stretch").agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.col(seq).alias("seq")))).alias("times"))
    zero = F.expr("CAST(array() AS ARRAY<STRUCT<at: DOUBLE, seq: BIGINT>>)")
    # The list grows at misses only, each of which is later than the last by more than the time to live.
    stored = F.aggregate("times", zero, lambda s, e: F.when((F.size(s) > 0) & (e["at"] - F.element_at(s, -1)["at"] <= ttl), s).otherwise(F.concat(s, F.array(F.struct(e["at"].cast("double").alias("at"), e["seq"].cast("long").alias("seq"))))))
    misses = times.select(key, F.explode(stored).alias("m")).select(key, F.col("m.at").alias(at), F.col("m.seq").alias(seq), F.lit(True).alias("missed"))
    return rows.drop("stretch").join(misses, [key, at, seq], "left").select(key, at, seq, F.col("missed").isNull().alias("hit"))


def retry_delay(attempt: Column, base: float = RETRY_BASE, most: float = RETRY_MOST) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt - 1))


def run_chain(outcomes: DataFrame, least: int, question: str = "question_id", seq: str = "seq", ok: str = "ok") -> DataFrame:
    """The prefix of each question's engines that a chain calls: it stops once `least` of them have succeeded."""
    before = F.coalesce(F.sum(F.col(ok).cast("int")).over(Window.partitionBy(question).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return outcomes.withColumn("before", before).where(F.col("before") < least).drop("before")


def retain(log: DataFrame, n: int, key: str, at: str, seq: str) -> DataFrame:
    """The last n rows of each key."""
    order = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(seq).desc())
    return log.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")


def nearest_rank(values: DataFrame, key: str, value: str, fractions: list[float]) -> DataFrame:
    """Nearest-rank percentiles: the value at place round(f * n + 0.5) - 1, rounding half to even, within the values.

    Equal values are counted first; a window runs over distinct values only.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    wanted = placed.select("*", F.explode(F.array(*[F.lit(f) for f in fractions])).alias("fraction"))
    rank = F.greatest(F.lit(1), F.least(F.col("n"), F.bround(F.col("fraction") * F.col("n") + 0.5).cast("long")))
    return wanted.where((F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank)).select(key, "fraction", value)
