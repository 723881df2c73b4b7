"""Whitening against a full eigendecomposition."""

import math
from collections import defaultdict

import numpy as np
import pytest

from quarrylake.llm import whiten


def _fitted(vectors):
    """id, component -> figures, by numpy over the distinct scaled vectors of each length."""
    rows = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    by = defaultdict(list)
    for i, x in rows:
        by[len(x)].append((i, x))
    out = []
    for size, some in by.items():
        distinct = sorted({x for _, x in some})
        n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
        centred = np.array([[float((n * c - s) / n) for c, s in zip(x, sums)] for x in distinct])
        cov = centred.T @ centred / n
        e, axes = np.linalg.eigh(cov)
        e, axes = e[::-1], axes[:, ::-1]
        k = min(16, size, int((e > size * 2.3e-16 * max(e[0], 0)).sum())) if e[0] > 0 else 0
        for i, x in some:
            d = np.array([(n * c - s) / n for c, s in zip(x, sums)])
            for c in range(k):
                out.append((i, size, c + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), d @ axes[:, c] / math.sqrt(e[c]), e[c] / np.trace(cov)))
    return out


def _table(spark, vectors):
    return spark.createDataFrame([(i, v, 0.5, "x") for i, v in vectors], "vec_id long, embedding array<double>, whitened double, id string").repartition(5)


def _compare(found, wanted, sizes):
    mine = sorted((r["id"] if r["id"] is not None else -1, sizes[r["id"]], r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"]) for r in found)
    theirs = sorted((x[0] if x[0] is not None else -1, *x[1:]) for x in wanted)
    assert [x[:5] for x in mine] == [x[:5] for x in theirs]
    signs = {}
    for a, b in zip(mine, theirs):
        sign = signs.setdefault((a[1], a[2]), math.copysign(1, a[5] * b[5]) if abs(b[5]) > 1e-6 else None) or 1
        if signs[a[1], a[2]] is None:
            del signs[a[1], a[2]]
            sign = math.copysign(1, a[5] * b[5]) if a[5] * b[5] else 1
        assert a[5] * sign == pytest.approx(b[5], abs=1e-8, rel=1e-8)
        assert a[6] == pytest.approx(b[6], rel=1e-9)
    assert all(r["identity_error"] <= 1e-6 for r in found)


def _random(seed, n, d, decay):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, d)) @ np.linalg.qr(rng.standard_normal((d, d)))[0] * 3 * decay ** np.arange(d)


@pytest.mark.parametrize("d,decay", [(64, 1.0), (64, 0.6), (40, 0.97), (7, 0.8), (1, 1.0)])
def test_components(spark, d, decay):
    x = _random(d, 400, d, decay)
    vectors = [(i, v) for i, v in enumerate(x.tolist())]
    vectors += [(1000 + i, vectors[3][1]) for i in range(90)]
    _compare(whiten.whitened(_table(spark, vectors)).collect(), _fitted(vectors), {i: len(v) for i, v in vectors})


def test_range_finder_decides(spark):
    """Falling eigenvalues are met without all dimensions; equal ones need them."""
    for decay, whole in ((0.5, False), (1.0, True)):
        x = np.round(_random(3, 500, 60, decay) * 1e6).astype(np.int64) if not whole else np.round(_random(3, 500, 60, decay) * 64).astype(np.int64)
        fit = spark.createDataFrame([(60, r) for r in x.tolist()], "size int, u array<long>")
        model = whiten.fit_components(fit, 8, 12, 3)[60]
        assert model.whole == whole
        c = x - x.mean(0)
        values, axes = np.linalg.eigh(c.T @ c / len(c))
        assert np.abs(np.abs((axes[:, ::-1][:, :8] * model.axes).sum(0)) - 1).max() < 1e-12
        assert model.values == pytest.approx(values[::-1][:8], rel=1e-12)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [2.0, -3.0]), (8, [0.0, 0.0]), (None, [4.0, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [1.0, 2.0, 3.0]), (11, [5.0]), (12, [7.5]), (13, [1e300])]
    found = whiten.whitened(_table(spark, vectors)).collect()
    usable = [x for x in vectors if x[0] not in (13,)]
    _compare(found, _fitted(usable), {i: len(v or ()) for i, v in vectors})
    assert {r["id"] for r in found} == {6, 7, 8, None, 11, 12}
    assert whiten.whitened(_table(spark, vectors).limit(0)).count() == 0


def test_deviation_beyond_64_bits(spark):
    vectors = [(1, [1e12, 1.0]), (2, [-1e12, 0.25]), (3, [0.0, 9.0])]
    found = whiten.whitened(_table(spark, vectors)).collect()
    wanted = {x[0]: x[4] for x in _fitted(vectors)}
    assert {r["id"]: int(r["deviation"]) for r in found} == wanted and max(wanted.values()) > 2**64
