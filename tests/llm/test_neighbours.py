"""Nearest neighbours against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylake.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>, score double, query_id string"


def _table(spark, vectors, parts=5):
    return spark.createDataFrame([(i, v, 0.5, "x") for i, v in vectors], SCHEMA).repartition(parts)


def _usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v)


def _wanted(vectors, every, k=10):
    """(query id, rank, id, score) by all pairs; of rows that repeat an id each answers."""
    rows = [(i, np.array(v, float)) for i, v in vectors if _usable(v)]
    out = []
    for q, (i, x) in enumerate(rows):
        if i is None or i % every:
            continue
        far = sorted((float(((x - y) ** 2).sum()), j is None, j or 0) for r, (j, y) in enumerate(rows) if r != q and len(y) == len(x))
        out += [(i, n + 1, None if none else j, math.sqrt(d)) for n, (d, none, j) in enumerate(far[:k])]
    return sorted(out, key=str)


def _found(table, every, **more):
    found = neighbours.nearest(table, F.col("vec_id") % every == 0, **more).collect()
    return sorted(((r["query_id"], r["rank"], r["id"], r["score"]) for r in found), key=str)


def _same(found, wanted):
    assert [x[:3] for x in found] == [x[:3] for x in wanted]
    assert [x[3] for x in found] == pytest.approx([x[3] for x in wanted])


def _recall(found, wanted):
    limit = {}
    for q, rank, _, score in wanted:
        limit[q] = max(limit.get(q, 0), score)
    return sum(score <= limit[q] for q, _, _, score in found) / len(wanted)


@pytest.mark.parametrize("kind", ["sphere", "clusters"])
def test_recall(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 24))
    if kind == "clusters":
        x = x[rng.integers(0, 40, 3000)] + 0.1 * rng.standard_normal((3000, 24))
    vectors = list(enumerate(x.tolist()))
    found, wanted = _found(_table(spark, vectors), 50, place_bytes=40_000), _wanted(vectors, 50)
    assert len(found) == len(wanted) == 600
    assert _recall(found, wanted) >= 0.9
    exact = {(q, j): s for q, _, j, s in _wanted(vectors, 50, 3000)}
    assert all(exact[q, j] == pytest.approx(s, rel=1e-14) for q, _, j, s in found)


def test_most_probes_then_everything(spark):
    """Queries that would need more buckets than allowed meet every row: the result is exact."""
    vectors = list(enumerate(np.random.default_rng(5).standard_normal((400, 16)).tolist()))
    _same(_found(_table(spark, vectors), 20, most=2, place_bytes=5000), _wanted(vectors, 20))


def test_copies_and_ties(spark):
    rng = np.random.default_rng(6)
    hot = rng.standard_normal(8).tolist()
    vectors = [(i, hot) for i in range(0, 900, 2)] + [(i, rng.standard_normal(8).tolist()) for i in range(1, 300, 2)]
    vectors += [(3000 + i, [float(i % 3), 1.0, *[0.0] * 6]) for i in range(60)]
    found, wanted = _found(_table(spark, vectors), 30, place_bytes=1000, success=0.999), _wanted(vectors, 30)
    assert len(found) == len(wanted)
    same = [x for x in zip(found, wanted) if x[0][:3] == x[1][:3]]
    assert len(same) >= 0.98 * len(wanted)
    for q in (0, 30, 870, 3000, 3030):  # a copy's nearest are the copies with the smallest ids, without itself
        assert [x[:3] for x in found if x[0] == q] == [x[:3] for x in wanted if x[0] == q]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, 2.0]), (1, None), (100, None), (2, []), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.0, 0.0]), (6, [None, 1.0]), (None, [1.0, 2.0]), (None, [9.0, 2.0]), (200, [1.0, -0.0]), (7, [1.0, 0.0]), (300, [1.0, 1.0, 1.0]), (400, [5.0]), (8, [6.0]), (500, [1e300, -1e300]), (-100, [1.0, 2.5])]
    _same(_found(_table(spark, vectors), 100), _wanted(vectors, 100))
    assert _found(_table(spark, vectors).limit(0), 100) == []
    _same(_found(_table(spark, vectors), 1000), _wanted(vectors, 1000))


def test_probes_come_by_chance():
    """The kept buckets are the likeliest of all combinations, in order, and stand for the chance of a normal step."""
    rng = np.random.default_rng(7)
    at, reach = rng.uniform(-3, 3, (6, 4)), rng.uniform(0.2, 1.0, 6)
    bins, counts, reached = neighbours.probes(at, reach, 1.0, 0.8, most=200)
    for q in range(6):
        steps = reach[q] * rng.standard_normal((40_000, 4))
        seen = {tuple(b) for b in bins[q, : counts[q]].tolist()}
        share = np.mean([tuple(b) in seen for b in np.floor(at[q] + steps).astype(int).tolist()])
        assert not reached[q] or share == pytest.approx(0.8, abs=0.06) or counts[q] < 8 and share >= 0.8 - 0.02
