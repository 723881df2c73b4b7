"""Language, toxicity, Katz scores, licences and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylake.llm import katz, langid, license, toxicity, wordtable

WORDS = {"en": "the of and to in is that it was for on are with they be at this have from or".split(), "de": "der die und das nicht ein eine ist mit sich auf für den von zu dem".split(), "fr": "le la les des est une dans que pour qui sur pas avec plus par".split()}


def _made(n, seed=1):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(WORDS[lang]) for _ in range(40)), lang) for i in range(n) for lang in [list(WORDS)[i % 3]]]


def test_language(spark, docs, rows, nothing):
    made = spark.createDataFrame(_made(150), "doc_id long, text string, lang string")
    net = langid.fit(made, F.col("doc_id") % 4 != 2)
    found = {r.id: (r.lang_pred, r.score) for r in langid.predict(made, net).collect()}
    held = [(i, lang) for i, _, lang in _made(150) if i % 4 == 2]
    assert sum(found[i][0] == lang for i, lang in held) >= 0.95 * len(held)
    edge = langid.predict(docs, net, keep=("score", "lang"))
    assert edge.columns == ["id", "lang_pred", "score", "score_kept", "lang"]
    got = [(r.id, r.lang_pred, r.score) for r in edge.collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, _, s in got)
    assert {i for i, lang, _ in got if lang == "und"} == {4, 5, 6, 7}
    assert langid.fit(nothing, F.lit(True)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(nothing, net).count() == 0


def test_what_has_no_letter_is_undetermined(spark):
    net = langid.ByteGRU(["a", "b"])
    texts = ["\u00b2", "\u00bd \u2167", "\u2460", "12", "", None, "x", "\u65e5", "\u00aa"]
    found = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net)
    assert [r.lang_pred == "und" for r in sorted(found.collect())] == [True] * 6 + [False] * 3


def _labelled(net, word):
    """The sum over a word's bytes of the label probabilities, one byte and one state at a time."""
    p, h = {k: v.astype(np.float64) for k, v in net.p.items()}, langid.HIDDEN
    s = lambda x: 1 / (1 + np.exp(-x))

    def states(d, data):
        state, out = np.zeros(h), []
        for b in data:
            a = p["E"][b] @ p[f"W{d}"] + p[f"c{d}"]
            z, r = s(a[:h] + state @ p[f"U{d}"][:, :h]), s(a[h : 2 * h] + state @ p[f"U{d}"][:, h : 2 * h])
            c = np.tanh(a[2 * h :] + (r * state) @ p[f"U{d}"][:, 2 * h :])
            state = z * state + (1 - z) * c
            out.append(state)
        return out

    total = np.zeros(len(net.languages))
    for f, b in zip(states("f", word), reversed(states("b", word[::-1]))):
        e = np.exp(np.concatenate([f, b]) @ p["V"] + p["v"])
        total += e / e.sum()
    return total


def test_labels_against_a_plain_loop(spark):
    net = langid.ByteGRU(["a", "b", "c"], seed=5)
    texts = ["some words of\u00e4 length", "x" * 1000 + " y", "\u65e5\u672c" * 300]
    found = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net)
    for r in found.collect():
        pieces = [w[i : i + langid.PIECE] for w in texts[r.id].encode().split() for i in range(0, len(w), langid.PIECE)]
        mean = sum(_labelled(net, w) for w in pieces) / sum(map(len, pieces))
        assert net.languages[int(mean.argmax())] == r.lang_pred and abs(mean.max() - r.score) < 1e-4


def test_training_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "DOCS_PER_LANGUAGE", 20)
    made = spark.createDataFrame([(i, f"word{i} and more", "en" if i % 10 else "de") for i in range(1000)] + [(2000, None, "fr"), (2001, "x", None)], "doc_id long, text string, lang string")
    sizes = Counter(r.label for r in langid.training_words(made, F.lit(True), "doc_id", "text", "lang").collect())
    assert sizes == {"en": 20, "de": 20}


def test_gradients():
    net = langid.ByteGRU(["a", "b"], seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = langid.padded([b"abc", b"hello", b"z"])
    label = np.array([0, 1, 0])
    _, g = net.gradients(x, mask, label)
    rng = np.random.default_rng(0)
    for name in ("Uf", "Wb", "V", "cf"):
        spot = tuple(rng.integers(0, s) for s in net.p[name].shape)
        old, sides = net.p[name][spot], []
        for step in (1e-3, -1e-3):
            net.p[name][spot] = old + step
            sides.append(net.gradients(x, mask, label)[0])
        net.p[name][spot] = old
        assert abs((sides[0] - sides[1]) / 2e-3 - g[name][spot]) < 1e-3


@pytest.fixture(scope="module")
def insults():
    rnd = random.Random(2)
    clean = [w for ws in WORDS.values() for w in ws] + [f"{a}{b}en" for a in "klmnprst" for b in "aeiou"]
    rows = []
    for i in range(600):
        words = [rnd.choice(clean) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            words[rnd.randrange(30)] = rnd.choice(["idiot", "moron", "loser"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_words_are_restored_once(monkeypatch):
    """A word with signs at its edges is the word without them, texts without hidden signs aren't translated, and a model's
    restorer stays with it."""
    counts, letter = np.zeros(toxicity.CELLS + 1, np.int64), toxicity._letters()
    toxicity._count("letter idiot moron \u00fcber", letter, counts)
    model = toxicity.ToxicityModel(counts[: toxicity.CELLS], int(counts[toxicity.CELLS]), {}, 0.0)
    calls, real = [], toxicity.restore
    monkeypatch.setattr(toxicity, "restore", lambda token, *a, **b: calls.append(token) or real(token, *a, **b))
    found = [model.restorer().words(t) for t in ("letter", "letter.", '"letter"', "letter,")]
    assert calls == ["letter"] and found == [found[0]] * 4

    class Untranslated(str):
        def lower(self):
            return Untranslated(str.lower(self))

        def translate(self, table):
            raise AssertionError("translated")

    assert toxicity.words_of(Untranslated("\u00dcber ALLES")) == ["\u00fcber", "alles"]
    for c in map(chr, toxicity.HIDDEN):
        assert toxicity.words_of(f"\u00dcb{c}er i{c}d{c}iot") == ["\u00fcber", "idiot"]


def test_toxicity(spark, docs, rows, nothing, insults):
    texts = spark.createDataFrame([(i, t, "x") for i, t, _ in insults], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, x) for i, _, x in insults] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(texts, labels, F.col("doc_id") % 5 != 1)
    found = {r.id: r.predicted for r in toxicity.score(texts, model).collect()}
    assert sum(found[i] == x for i, _, x in insults) >= 0.98 * len(insults)
    hidden = ["you are an 1d10t", "what a m0r0n", "such a l.o.s.e.r here", "idiooooot", "i d i o t you are", "мoron"]
    hidden = [t.replace("м", "m") for t in hidden]
    obscure = spark.createDataFrame(list(enumerate([*hidden, "the of and 1234 to in"])), "doc_id long, text string")
    got = [r.predicted for r in sorted(toxicity.score(obscure, model).collect(), key=lambda r: r.id)]
    assert got == [1] * len(hidden) + [0]
    broken = ["what an iddiot", "a mo ron here", "you i. d. i. o. t.", "such an id io t", "l oser"]
    got = [r.predicted for r in sorted(toxicity.score(spark.createDataFrame(list(enumerate(broken)), "doc_id long, text string"), model).collect())]
    assert got == [1] * len(broken)
    edge = toxicity.score(docs, model, keep=("score",)).collect()
    assert len(edge) == len(rows) and all(0 <= r.score <= 1 for r in edge)
    assert toxicity.score(nothing, model).count() == 0
    none = toxicity.fit(nothing, labels.limit(0), F.lit(True))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}


@pytest.mark.parametrize("breaks", [False, True])
def test_viterbi_is_the_best_path(breaks, monkeypatch):
    counts, letter = np.zeros(toxicity.CELLS + 1, np.int64), toxicity._letters()
    toxicity._count(" ".join(w for ws in WORDS.values() for w in ws) + " idiot moron loser" * 3, letter, counts)
    model = toxicity.CharacterModel(counts[: toxicity.CELLS], int(counts[toxicity.CELLS]))
    rnd = random.Random(4)

    def cost(words):
        total = 0.0
        for w in words:
            before = toxicity.EDGE
            for c in w + toxicity.EDGE:
                total -= model.log(before[1 - toxicity.ORDER :], c)
                before += c
        return total

    def best(token):
        paths = [(0.0, "")]
        for c, n in [(m.group()[0], len(m.group())) for m in __import__("re").finditer(r"(.)\1*", token)]:
            more = [(x + a, text + (" " if y == toxicity.EDGE else y)) for x, text in paths for a, y in toxicity._choices(c, n)]
            if breaks:
                more += [(x + a + 0.5, text + " " + y) for x, text in paths for a, y in toxicity._choices(c, n) if y not in ("", toxicity.EDGE) and text and text[-1] != " "]
            paths = more
        return min(x + cost(text.split()) for x, text in paths)

    for _ in range(60):
        token = "".join(rnd.choice("idotmrns10*@.o") for _ in range(rnd.randrange(1, 7)))
        found = toxicity._paths(token, model, breaks, [])
        least = min(x - model.log(last[1 - toxicity.ORDER :], toxicity.EDGE) if last != toxicity.EDGE else x for last, (x, _) in found.items())
        assert abs(least - best(token)) < 1e-9
    assert toxicity.restore("m0r0n" * 40, model)
    # Where the shared beginning is written down changes nothing, and a long token is restored as a whole.
    long = ["".join(rnd.choice("idotmrns10*@.o") for _ in range(rnd.randrange(60, 400))) for _ in range(6)] + ["a-" * 31 + "1d10t", "x" * 5000 + "m0r0n"]
    once = []
    for piece in (10_000, 64, 3):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        once.append([toxicity.restore(t, model, breaks) for t in long])
    assert once[0] == once[1] == once[2]


def _katz(rows, modulus=7, held=2):
    """Base scores by the formula; the model's probabilities after each word must sum to one."""
    def split(t):
        return [*(t or "").encode().lower().split(), b""]

    out_of = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % modulus == held
    count = Counter(w for i, t in rows if not out_of(i) for w in split(t))
    n, v = sum(count.values()), len(count)
    return [(i, out_of(i), len(split(t)), sum(count[w] > 0 for w in split(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in split(t))) for i, t in rows]


def test_katz(spark, docs, rows, nothing):
    made = [(i, t) for i, t, _ in _made(120)] + [(r[0], r[1]) for r in rows]
    table = spark.createDataFrame([(i, t, 1.0) for i, t in made], "doc_id long, text string, score double")
    scores, bigrams = katz.scored(table, shards=3)
    got = sorted(((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scores.collect()), key=str)
    assert got == sorted(((*x[:5], round(x[5], 6)) for x in _katz(made)), key=str)
    seen = Counter((a, b) for i, t in made if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2 for w in [["", *(t or "").lower().split(), ""]] for a, b in zip(w, w[1:]))
    assert sum(sum(r.n) for r in bigrams.collect()) == sum(seen.values())
    assert sum(len(r.n) for r in bigrams.collect()) == len(seen)
    assert all(r.score <= 0 for r in scores.collect())
    assert katz.scored(nothing)[0].count() == 0


def _katz_scores(rows, modulus=7, held=2, k=katz.K):
    """log10 of each text's probability by dictionaries: what follows each word, discounted, the rest from the words alone."""
    def split(t):
        return ["", *(t or "").lower().split(), ""]

    def factors(counts):
        n = Counter(counts)
        cut = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
        d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if cut < 1 and n[r] and n[r + 1] else 1.0 for r in range(1, k + 1)}
        return lambda r: d[r] if r <= k and 0 < d[r] < 1 else 1.0

    learn = [split(t) for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % modulus != held]
    one, two = Counter(w for t in learn for w in t[1:]), Counter(p for t in learn for p in zip(t, t[1:]))
    d1, d2, n = factors(one.values()), factors(two.values()), sum(one.values())
    kept = sum(d1(c) * c for c in one.values())
    total = n if n - kept > 1e-9 * max(n, 1) else n + 1
    word = lambda w: d1(one[w]) * one[w] / total if one[w] else ((total - kept) / total if total else 1.0)
    after = {}
    for (a, b), c in two.items():
        after.setdefault(a, {})[b] = c

    def p(a, b):
        if a not in after:
            return word(b)
        follows = after[a]
        n, kept = sum(follows.values()), sum(d2(c) * c for c in follows.values())
        n += n - kept <= 1e-9
        if b in follows:
            return d2(follows[b]) * follows[b] / n
        return (n - kept) / n / max(1 - sum(map(word, follows)), 1e-12) * word(b)

    return [(i, sum(math.log10(p(a, b)) for a, b in zip(split(t), split(t)[1:]))) for i, t in rows]


def test_katz_scores_against_dictionaries(spark):
    rnd = random.Random(6)
    words = [f"w{int(rnd.paretovariate(0.9))}" for _ in range(6000)]
    made = [(i, " ".join(words[rnd.randrange(5900) :][: rnd.randrange(0, 60)])) for i in range(150)] + [(None, "never seen before"), (7, None), (7, "w1 w1 w2")]
    scores, _ = katz.scored(spark.createDataFrame(made, "doc_id long, text string"), shards=4)
    got, wanted = sorted(((r.id, r.score) for r in scores.collect()), key=lambda x: (str(x[0]), x[1])), sorted(_katz_scores(made), key=lambda x: (str(x[0]), x[1]))
    assert [x[0] for x in got] == [x[0] for x in wanted]
    assert all(abs(a - b) < 1e-6 * max(1, abs(b)) for (_, a), (_, b) in zip(got, wanted))


def test_katz_frequent_words_are_dealt_however_many_shards(spark):
    # The most frequent word is the first of shard 1090 of 1100; half of its occurrences are held out.
    asks = [(7, wordtable.pack((b"b\nrare\nthe", np.array([3 << 32, 1, 5000 + (5000 << 32)]))))]
    told = [x for batch in katz._number_words(1090, asks, 1100) for x in batch.to_pylist()]
    often = np.array([x["c"] for x in told if x["block"] == -2 and x["tokens"] > katz.HOT_SHARE * 1_000_000 / 1100])
    assert often.tolist() == [1090]
    assert sum(x["tokens"] for x in told if x["block"] == -1) == 10_004
    a, b = np.full(5000, 1090), np.arange(5000)
    assert np.bincount(katz._pair_shard(a, b, katz._is_hot(a, often), 1100)).max() < 50
    # And in a table: one word makes up half of it, its pairs don't meet in one shard, and shards don't change results.
    rows = [(i, " ".join(f"the w{i * 50 + j}" for j in range(50))) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    scores, bigrams = katz.scored(table, shards=24)
    sizes = Counter()
    for r in bigrams.collect():
        sizes[r.shard] += len(r.n)
    assert max(sizes.values()) < 0.15 * sum(sizes.values())
    few = {r.id: r.score for r in katz.scored(table, shards=2)[0].collect()}
    assert all(abs(r.score - few[r.id]) < 1e-9 * abs(r.score) for r in scores.collect()) and len(few) == 40


def test_katz_sums_to_one():
    one = katz.Unigrams(100, 10, {1: 4, 2: 3, 90: 1})
    two = katz.discounts({1: 50, 2: 20, 3: 10, 4: 6, 5: 4, 6: 3})
    counts = np.array([1, 1, 1, 1, 2, 2, 2, 90])  # of all known words; one further class is unknown
    assert abs(one.p(counts).sum() + one.unknown - 1) < 1e-9
    follows = np.array([3, 1, 0, 0, 2, 0, 0, 7])
    sums = np.zeros((1, katz.K + 2))
    for n, c in zip(follows, counts):
        if n:
            sums[0, min(n, katz.K + 1) - 1] += n
            sums[0, katz.K + 1] += one.p(np.array([c]))[0]
    logs = katz.log_probabilities(np.append(follows, 0), np.append(counts, 0), np.repeat(sums, 9, axis=0), one, two)
    assert abs((10**logs).sum() - 1) < 1e-9


def _nearest(text, whole):
    """The licence of a text, term by term, in plain Python; and the score."""
    import re

    counts = [Counter(re.findall(license.TERM, t.lower())) for _, t in license.TEMPLATES]
    df = Counter(t for c in counts for t in c)
    weigh = lambda c: {t: (1 + math.log(n)) * (math.log((1 + len(counts)) / (1 + df[t])) + 1) for t, n in c.items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    bare = re.sub(license.MARKS, "", text or "")
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", bare)]
    passages = paragraphs + [" ".join(p.split()) for p in bare.split("\n")] + re.sub(r"([.!?:])\s+([A-Z(])", r"\1\n\2", "\n".join(paragraphs)).split("\n") + [" ".join(bare.split())] * whole
    found = []
    for p in set(passages):
        if re.search(license.CUE, p) and len(p.split(" ")) <= license.most_words(license.TEMPLATES):
            v = weigh(Counter(re.findall(license.TERM, p.lower())))
            for (name, _), c in zip(license.TEMPLATES, counts):
                w = weigh(c)
                score = round(sum(x * w.get(t, 0) for t, x in v.items()) / (length(v) * length(w)), 6)
                if score >= license.LEAST_COSINE:
                    found.append((name == license.WEAK, -score, name))
    return (min(found)[2], -min(found)[1]) if found else (None, None)


GPL3 = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * All rights reserved.
 */
int main;
"""


@pytest.mark.parametrize("few", [500_000, 0])
def test_licences(spark, monkeypatch, few):
    monkeypatch.setattr(license, "FEW_KEYS", few)
    monkeypatch.setattr(license, "narrowed", __import__("functools").partial(license.narrowed, few=few))
    mit = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + license.TEXTS[1][1].replace("including without", "including\nwithout") + "\n\nTHE SOFTWARE IS PROVIDED AS IS."
    rows = [
        ("repo/LICENSE", mit, 1), ("repo/src/a.py", "x = 1", 1), ("repo/src/deep/b.py", "# Licensed under the Apache License, Version 2.0.\ny = 2", 1), ("repo/vendor/COPYING.txt", "This program is free software\n\nAll rights reserved.", 1),
        ("repo/vendor/lib/c.c", None, 1), ("other/d.txt", "", 1), (None, "Released under the MIT License.", 1), ("repo/src/a.py", "x = 1", 2), ("e.txt", "Nothing about terms.", 1), ("f.txt", "the license of " * 5000, 1),
        ("g/h.c", GPL3, 1), ("g/i.py", "# SPDX-License-Identifier: MIT", 1), ("g/LICENSE-2.md", "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\nEveryone is permitted", None), ("g/x/j", "Mozilla Public License Version 2.0\n======\n1. Definitions", 1),
    ]
    files = spark.createDataFrame(rows, "path string, text string, license int")
    result = license.scan(files)
    found = sorted(((r.path, r.license, r.kind, r.from_path) for r in result.collect()), key=str)
    wanted = [
        ("repo/LICENSE", "MIT", "file", None), ("repo/src/a.py", "MIT", "inherited", "repo/LICENSE"), ("repo/src/a.py", "MIT", "inherited", "repo/LICENSE"), ("repo/src/deep/b.py", "Apache-2.0", "header", None),
        ("repo/vendor/COPYING.txt", "Proprietary", "file", None), ("repo/vendor/lib/c.c", "Proprietary", "inherited", "repo/vendor/COPYING.txt"), ("other/d.txt", None, None, None), (None, "MIT", "header", None), ("e.txt", None, None, None), ("f.txt", None, None, None),
        ("g/h.c", "GPL-3.0", "header", None), ("g/i.py", "MIT", "header", None), ("g/LICENSE-2.md", "GPL-3.0", "file", None), ("g/x/j", "MPL-2.0", "header", None),
    ]
    assert found == sorted(wanted, key=str)
    own = {(r.path, r.license, r.score) for r in result.collect() if r.kind != "inherited"}
    assert own == {(p, *_nearest(t, bool(p) and "LICENSE" in p or p == "repo/vendor/COPYING.txt")) for p, t, _ in rows if (p, None) not in {(x[0], x[3]) for x in wanted if x[2] == "inherited"} and p not in {x[0] for x in wanted if x[2] == "inherited"}}
    again = license.scan(spark.createDataFrame([(None, None, "en"), (None, "Licensed under CC BY 4.0.", "en")], "path string, text string, doc_id string"), keep=("doc_id",))
    assert sorted((r.license or "", r.doc_id) for r in again.collect()) == [("", "en"), ("CC-BY-4.0", "en")]
    assert license.scan(files.limit(0)).count() == 0


def test_templates_hold_a_cue():
    import re

    assert all(re.search(license.CUE, text) for _, text in license.TEMPLATES)


def test_pipeline(spark, docs, insults, tmp_path):
    import corpus_pipeline

    extra = [(100 + i, t, "en", "s", None, None) for i, t, _ in insults[:100]]
    table = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    table.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + i, x, 1) for i, _, x in insults[:100]], "doc_id long, toxic int, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, f"file://{tmp_path}")
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        after.write.parquet(f"file://{tmp_path}/{name}")
        now = spark.read.parquet(f"file://{tmp_path}/{name}")
    left = {r.doc_id for r in now.collect()}
    assert 1 not in left and 2 in left and 3 in left and 8 in left and not left & {4, 5, 6, 7}
    assert now.where("doc_id = 9").count() == 1
    packed = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, now, f"file://{tmp_path}").collect()}
    assert packed == left
