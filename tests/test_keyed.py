"""The keyed table and the response cache on it."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from quarrylake.sources import keyed as K


def _rows(spark, rows):
    return spark.createDataFrame(rows, "key string, at long, seq long, what string")


def _held(table):
    return sorted(map(str, table.latest().collect()))


def test_last_row_of_each_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "MOST_SEGMENTS", 4)
    table, rnd, last = K.KeyedTable(spark, f"file://{tmp_path}/t", buckets=3), random.Random(1), {}
    with pytest.raises(ValueError):
        table.latest()
    for batch in range(7):
        rows = [(rnd.choice(["a", "b", "c", None, ""]), rnd.randrange(5), rnd.randrange(3), f"{batch}-{i}") for i in range(8)]
        rows = list({r[:3]: r for r in rows}.values())
        table.put(_rows(spark, rows))
        for r in rows:
            if r[0] not in last or r[1:3] >= last[r[0]][1:3]:
                last[r[0]] = r
        assert _held(table) == sorted(map(str, _rows(spark, list(last.values())).collect()))
    assert len(table.manifest()["segments"]) <= 4
    assert table.compact() and len(table.manifest()["segments"]) == 1 and table.vacuum() > 0
    assert _held(table) == sorted(map(str, _rows(spark, list(last.values())).collect()))
    some = table.latest(spark.createDataFrame([("a",)], "key string"))
    assert [r["what"] for r in some.where("key = 'a'").collect()] == [last["a"][3]]


def test_writers_at_the_same_time(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    one, two = K.KeyedTable(spark, folder, buckets=2), K.KeyedTable(spark, folder, buckets=2)
    one.put(_rows(spark, [("a", 1, 1, "x"), ("b", 1, 1, "x")]))
    seen = one.manifest()
    # Another writer commits between reading the manifest and making the next: nothing is lost.
    manifest, calls = one.manifest, []

    def late():
        calls.append(1)
        if len(calls) == 3:
            two.put(_rows(spark, [("b", 2, 1, "two")]))
            return seen
        return manifest()

    one.manifest = late
    one.put(_rows(spark, [("a", 2, 1, "one")]))
    one.manifest = manifest
    assert [r["what"] for r in one.latest().orderBy("key").collect()] == ["one", "two"] and len(one.manifest()["segments"]) == 3
    # A merge that another was faster than does nothing.
    stale = one.manifest()
    two.compact()
    one.manifest = lambda: stale if not calls.clear() and not calls.append(1) and one.__dict__.pop("manifest") else None
    assert not one.compact() and [r["what"] for r in two.latest().orderBy("key").collect()] == ["one", "two"]


def test_removed_rows_and_lost_writers(spark, tmp_path):
    table = K.KeyedTable(spark, f"file://{tmp_path}/t", buckets=2)
    table.put(_rows(spark, [("a", 9, 1, "x"), ("b", 1, 1, "y")]))
    table.remove(what="x")
    assert [r["key"] for r in table.latest().collect()] == ["b"]
    table.put(_rows(spark, [("a", 1, 1, "x")]))  # put after the removal: it counts
    assert [(r["key"], r["at"]) for r in table.latest().orderBy("key").collect()] == [("a", 1), ("b", 1)]
    table.compact()
    assert table.manifest()["cuts"] == [] and table.latest().count() == 2
    table._segment(_rows(spark, [("z", 1, 1, "lost")]).withColumn("segment_", F.lit(9)))  # its writer never came to the manifest
    assert table.latest().count() == 2
    table.remove()
    assert table.latest().count() == 0


def test_streams_put_once(spark, tmp_path):
    source, folder = str(tmp_path / "in"), f"file://{tmp_path}"
    table = K.KeyedTable(spark, f"{folder}/t", buckets=2)
    for n in range(2):
        _rows(spark, [("a", n, 1, f"{n}"), (f"k{n}", n, 1, f"{n}")]).write.mode("append").json(source)
        stream = spark.readStream.schema("key string, at long, seq long, what string").json(source)
        table.sink(stream, "s").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    assert [(r["key"], r["what"]) for r in table.latest().orderBy("key").collect()] == [("a", "1"), ("k0", "0"), ("k1", "1")]
    assert table.manifest()["batches"] == {"s": 1} and len(table.manifest()["segments"]) == 2
    assert not table.put(_rows(spark, [("a", 99, 1, "again")]), "s", 1)
    assert [r["what"] for r in table.latest().where("key = 'a'").collect()] == ["1"]


def _asked(spark, now, *pairs):
    return spark.createDataFrame([(n, p, float(now)) for n, p in pairs], "namespace string, payload string, now double")


def _put(cache, spark, at, *rows):
    return cache.put(spark.createDataFrame([(n, p, v, float(at), c) for n, p, v, c in rows], "namespace string, payload string, value string, at double, cacheable boolean"))


def test_cache(spark, tmp_path):
    cache = K.ResponseCache(spark, f"file://{tmp_path}/c", buckets=2)
    a, b = ("search", '{"q": "a", "n": 1}'), ("search", '{"q": "b"}')
    value = lambda now, ttl, *x: [(r["value"], r["age"]) for r in cache.get(_asked(spark, now, *x), ttl).collect()]
    assert value(1, 60, a) == [(None, None)] and cache.invalidate() == 0
    assert _put(cache, spark, 100, (*a, '{"x": "h\\u00e9llo"}', True), (*b, "1", False), ("page", a[1], "3", True), ("search", "not json", "4", None), ("search", '"bad"', "{not json", True))
    assert value(130, 60, a) == [('{"x": "h\\u00e9llo"}', 30.0)]
    assert value(130, 60, ("search", '{"n":1,"q":"a"}')) == [('{"x": "h\\u00e9llo"}', 30.0)]  # order of fields doesn't matter
    assert value(130, 60, b) == value(130, 60, ("search", "not json")) == [(None, None)]  # refused
    assert value(130, 60, ("page", a[1])) == [("3", 30.0)] and value(130, 60, ("other", a[1])) == [(None, None)]
    assert value(161, 60, a) == value(99, 60, a) == value(130, 0, a) == [(None, None)] and value(160, 60, a)[0][1] == 60.0
    assert value(130, 60, ("search", '"bad"')) == [(None, None)]
    assert not K.ResponseCache(spark, f"file://{tmp_path}/c", enabled=False).put(_asked(spark, 1, a))
    assert cache.invalidate("search") == 2 and value(130, 60, a, ("page", a[1])) == [(None, None), ("3", 30.0)]
    _put(cache, spark, 140, (*b, "5", True))
    assert cache.evict(170, 60) and [r["value"] for r in cache.table.latest().collect()] == ["5"] and cache.invalidate() == 1


def test_damaged_files_are_misses(spark, tmp_path):
    cache = K.ResponseCache(spark, f"file://{tmp_path}/c", buckets=1)
    _put(cache, spark, 100, ("s", "1", "1", True))
    _put(cache, spark, 100, ("s", "2", "2", True))
    bad = glob.glob(f"{cache.table.manifest()['segments'][0].removeprefix('file://')}/bucket_=*/*.parquet")[0]
    with open(bad, "wb") as f:
        f.write(b"junk")
    os.remove(os.path.join(os.path.dirname(bad), "." + os.path.basename(bad) + ".crc"))
    assert [r["value"] for r in cache.get(_asked(spark, 101, ("s", "1"), ("s", "2")), 60).orderBy("payload").collect()] == [None, "2"]
