"""Exact and near duplicates against plain Python."""

import functools
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from quarrylake.llm import embed, exact, simhash
from quarrylake.llm.common import components


def _lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("per_task,huge,few", [(2000, 4_000_000, 500_000), (1, 50, 500_000), (1, 4_000_000, 0)])
def test_exact(spark, docs, rows, nothing, per_task, huge, few, monkeypatch):
    monkeypatch.setattr(exact, "narrowed", functools.partial(exact.narrowed, few=few))
    found = exact.exact_duplicates(docs, per_task=per_task, huge=huge).drop("text_hash").collect()
    by = defaultdict(list)
    for r in rows:
        by[_lower(r[1])].append(r[0])
    wanted = []
    for text, ids in by.items():
        top = max((i for i in ids if i is not None), default=None)
        wanted += [(i, top, len(ids), i == top, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)
    assert exact.exact_duplicates(nothing).count() == 0


def test_fingerprints_compose():
    rnd = random.Random(1)
    data = bytes(rnd.randrange(256) for _ in range(20_000))
    for cut in (0, 1, 4095, 4096, 9999, 20_000):
        assert exact.combine(exact.polynomial(data[:cut]), exact.polynomial(data[cut:]), len(data) - cut) == exact.polynomial(data)


def _fingerprint(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", _lower(text))]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    if not shingles:
        return 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark, docs, rows, nothing):
    found = {(r.id, r.fp & (2**64 - 1)): r.component for r in simhash.near_duplicates(docs).collect()}
    prints = {(r[0], _fingerprint(r[1])) for r in rows}
    assert set(found) == prints
    with_id = sorted(x for x in prints if x[0] is not None)
    pairs = [(a[0], b[0]) for a in with_id for b in with_id if a < b and (a[1] ^ b[1]).bit_count() <= 4]
    groups = _groups(pairs, [x[0] for x in with_id])
    assert all(found[x] == groups[x[0]] for x in with_id)
    assert simhash.near_duplicates(nothing).count() == 0


def _signed(v):
    return v - 2**64 if v >= 2**63 else v


@pytest.mark.parametrize("distance,segments,split", [(4, None, None), (4, [(0, 22, 1), (22, 21, 1), (43, 21, 0)], 5), (4, [(0, 32, 2), (32, 32, 1)], 4), (14, None, 2), (14, [(0, 16, 3), (16, 16, 3), (32, 16, 3), (48, 16, 2)], 3), (0, None, 0)])
def test_multi_index_loses_no_link(spark, distance, segments, split):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(40)]
    values = set(base)
    for x in base:
        for n in range(distance + 3):
            y = x
            for b in rnd.sample(range(64), n):
                y ^= 1 << b
            values.add(y)
    signed = sorted(map(_signed, values))
    nodes = spark.createDataFrame([(v, v, None) for v in signed], "key long, fp long, sketch binary")
    got = [(r.a, r.b) for r in simhash.links(nodes, distance, segments=segments, split=split).collect()]
    differ = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(differ(a, b) <= distance for a, b in got)
    assert _groups(got, signed) == _groups([(a, b) for a in signed for b in signed if a < b and differ(a, b) <= distance], signed)


def test_alike_rows_give_few_links(spark):
    # 3000 fingerprints within 4 bits of one: some 4.5 million pairs, but about one link for each and each shard that holds it.
    rnd = random.Random(1)
    values = {_signed(sum(1 << b for b in rnd.sample(range(64), 2))) for _ in range(3000)}
    nodes = spark.createDataFrame([(v, v, None) for v in values], "key long, fp long, sketch binary")
    assert simhash.links(nodes, 4).count() < 40 * len(values)


@pytest.mark.parametrize("n", [10, 10**5, 10**7, 10**10])
@pytest.mark.parametrize("distance", [0, 4, 14])
def test_segments_cover_all_bits(n, distance):
    segments = simhash.segments_for(n, distance)
    assert [first for first, _, _ in segments] == np.cumsum([0, *[w for _, w, _ in segments[:-1]]]).tolist() and sum(w for _, w, _ in segments) == 64
    assert sum(r + 1 for _, _, r in segments) >= distance + 1


def _set(text, k=5):
    words = _lower(text).split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


@pytest.mark.parametrize("block", [256, 3])
def test_verified(spark, docs, rows, nothing, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    rnd = random.Random(8)
    texts = [(r[0], r[1]) for r in rows]
    for k in range(25):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(30, 300))]
        for j in range(6):
            changed = [w if rnd.random() > 0.004 * j else f"x{rnd.randrange(3000)}" for w in words]
            texts.append((1000 * (k + 1) + j, " ".join(changed)))
    texts += [(5000, "a few words"), (5001, "A few words"), (1000, texts[len(rows)][1])]
    rnd.shuffle(texts)
    table = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, key int")
    found = simhash.verified_duplicates(table).collect()
    nodes = sorted({(i is None, i if i is not None else simhash.NO_ID, t or "") for i, t in texts})
    place = {n: k for k, n in enumerate(nodes)}
    assert len(found) == len(nodes)
    alike = lambda a, b: a == b or (a | b) and len(a & b) >= 0.8 * len(a | b)
    sets = [_set(t) for *_, t in nodes]
    prints = [simhash.fingerprint(t, 5) for *_, t in nodes]
    pairs = [(a, b) for a in range(len(nodes)) for b in range(a) if alike(sets[a], sets[b])]
    near = [(a, b) for a, b in pairs if sets[a] == sets[b] or (prints[a] ^ prints[b]).bit_count() <= 14]
    assert len(near) >= 0.95 * len(pairs) > 150
    groups = _groups(near, range(len(nodes)))
    kept = sorted(r.row_id for r in found if (r.row_id, r.text_hash) == (r.leader_id, r.leader_hash))
    assert kept == sorted(nodes[k][1] for k in set(groups.values()))
    by_row = defaultdict(set)
    for n, k in place.items():
        by_row[n[1]].add(nodes[groups[k]][1])
    assert all(r.leader_id in by_row[r.row_id] for r in found)
    assert simhash.verified_duplicates(nothing).count() == 0


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5, 5), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    assert found == _groups(real, {x for p in real for x in p})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [2000, 20])
def test_vectors(spark, block):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 64))
    vectors, labels = [], []
    for x in base:
        for k in range(6):
            y = x / np.linalg.norm(x) + rng.normal(size=64) * 0.02 * k
            vectors.append((y * rng.uniform(0.1, 10)).astype(np.float32).tolist())
            labels.append(int(rng.integers(0, 2)))
    vectors += [vectors[0]] * 40 + [None, [], [0.0] * 64, [float("nan")] * 64, [None] * 64, vectors[1], [1.0, 0.0, 0.0]]
    labels += [labels[0]] * 40 + [0, 0, 0, 0, 0, None, 0]
    rows = [(i, v, lab, i * 2.0) for i, (v, lab) in enumerate(zip(vectors, labels))]
    found = embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node double"), block=block)
    got = {r.id: (r.n_links, r.component, r.kept) for r in found.collect()}
    good = {i: np.array(v, np.float64) for i, v, lab, _ in rows if lab is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    pairs = [(a, b) for a in good for b in good if a < b and labels[a] == labels[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.93]
    linked = defaultdict(int)
    for a, b in pairs:
        linked[a] += 1
        linked[b] += 1
    groups = _groups(pairs, range(len(rows)))
    wanted = {i: (linked[i], groups[i], groups[i] == i) for i in range(len(rows))}
    assert sum(got[i] == wanted[i] for i in wanted) >= 0.99 * len(wanted)
    assert all(got[i] == (0, i, True) for i in set(range(len(rows))) - set(good))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embed.near_duplicates(empty).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = embed.hadamard(x)
    assert np.allclose((x**2).sum(1), (y**2).sum(1)) and np.allclose(embed.hadamard(y), x)
