"""Encoding, token files and packing against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrylake.llm import bpe, katz, mixcoder, packing, tokenfile, tokens, wordtable
from quarrylake.llm.tokens import WordEncoder, word_bpe_path

SIGNS = "abcXYZéßÖñÉĀžŽ.,!?%&*$#@;:|-+()<>^_~`0129  \n\t'İıſKÅ日本語ªǅ’²½́­​×÷\x0b\x1c\x00"


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(word_bpe_path())
    made.no_truncation()
    made.no_padding()
    return made


def _ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_is_the_library(library):
    rnd = random.Random(3)
    texts = [None, "", " ", "'", "<|endoftext|> A", "A<|ENDOFTEXT|>", "x" * 50 + "É"] + ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    for text, ids in zip(texts, WordEncoder(word_bpe_path()).encode(texts)):
        assert ids.tolist() == _ids(library, text)


def test_encode_and_decode(spark, docs, rows, nothing, library):
    found = bpe.decode(bpe.encode(docs, word_bpe_path()), word_bpe_path()).collect()
    got = sorted((str(r.id), list(r.ids), r.text) for r in found)
    wanted = sorted((str(r[0]), _ids(library, r[1]), library.decode(_ids(library, r[1]), skip_special_tokens=False)) for r in rows)
    assert got == wanted
    assert bpe.decode(bpe.encode(nothing, word_bpe_path()), word_bpe_path()).count() == 0


def test_rows_behind_a_shuffle(spark, docs, library):
    mixed = docs.repartition(5, F.rand())
    for steady in (False, True):
        table = mixed if not steady else docs
        found = bpe.encode(table, word_bpe_path(), steady=steady).collect()
        assert sorted((str(r.id), list(r.ids)) for r in found) == sorted((str(r.doc_id), _ids(library, r.text)) for r in docs.collect())


def _apart(spark, rows, partitions):
    """Each partition holds all of `rows`."""
    return spark.sparkContext.parallelize(range(partitions), partitions).flatMap(lambda _: rows).toDF("doc_id long, text string")


def test_same_rows_in_several_partitions(spark, library):
    rows = [(1, "one row, again"), (None, "and one without an id"), (2, None)]
    found = bpe.decode(bpe.encode(_apart(spark, rows, 3), word_bpe_path()), word_bpe_path()).collect()
    assert sorted((str(r.id), list(r.ids)) for r in found) == sorted((str(i), _ids(library, t)) for i, t in rows * 3)
    scores, bigrams = katz.scored(_apart(spark, rows, 3), shards=3)
    again, same = katz.scored(_apart(spark, rows * 3, 1), shards=3)
    assert sorted(scores.collect(), key=str) == sorted(again.collect(), key=str) and scores.count() == 9
    table, wanted = (sorted(x for r in t.collect() for x in zip(r.first, r.second, r.n)) for t in (bigrams, same))
    assert table == wanted


def test_blocks_with_other_rows_have_other_names():
    def name(rows):
        return wordtable._named([pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["id", "text"])])[0]

    assert name([(1, "a2 b")]) != name([(1, "a"), (2, "b")])
    assert name([(1, "a")]) == name([(1, "a")])


@pytest.mark.parametrize("n", [0, 1, 2, 257, 5000, 70_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), np.zeros(n, np.int64), np.minimum(rng.zipf(1.3, n), 49407)):
        lanes, steps, payload = mixcoder.encode(ids, 49408)
        assert (mixcoder.decode(n, lanes, steps, payload, 49408) == ids).all()
    text = np.tile(rng.integers(0, 49408, 50), n // 50 + 1)[:n]
    assert n < 5000 or len(mixcoder.encode(text, 49408)[2]) < n * 2


def test_coder_learns_what_follows():
    """Ids that depend on the one or two before take far fewer bits than their own frequencies would give."""
    rng = np.random.default_rng(7)
    n = 400_000
    one = rng.integers(0, 2000, (2000, 4))
    ids, now = np.zeros(n, np.int64), 5
    for i, (k, fresh, other) in enumerate(zip(rng.integers(0, 4, n).tolist(), (rng.random(n) < 0.1).tolist(), rng.integers(0, 2000, n).tolist())):
        ids[i] = now = other if fresh else int(one[now, k])
    counts = np.bincount(ids)
    counts = counts[counts > 0]
    zero = -(counts / n * np.log2(counts / n)).sum()
    lanes, steps, payload = mixcoder.encode(ids, 49408)
    assert len(payload) * 8 / n < 0.6 * zero
    assert (mixcoder.decode(n, lanes, steps, payload, 49408) == ids).all()


def test_rows_leave_each_branch_its_part():
    """Whatever a row has learned, each branch keeps a part of the range and is found in it, in integers alone."""
    rng = np.random.default_rng(3)
    tree = mixcoder.Tree(mixcoder.depths(np.arange(1, 400)))
    model, n = mixcoder.Model(tree, 50), 400
    for step in range(n):
        model.begin()
        model.look(None, None, 0)
        parts = [model.part(np.full(50, b)) for b in range(mixcoder.WAYS)]
        begins, widths = (np.array([p[k] for p in parts]).astype(np.int64) for k in range(2))
        assert (widths > 0).all() and (begins[0] == 0).all() and (begins + widths == np.append(begins[1:], np.full((1, 50), 1 << mixcoder.FREQUENCY_BITS), axis=0)).all()
        branch = rng.integers(0, mixcoder.WAYS, 50) if step % 3 else np.full(50, step // 60)
        begin, width = model.part(branch)
        assert (model.find(begin) == branch).all() and (model.find(begin + width - np.uint64(1)) == branch).all()
        model.learn(branch)
        model.end(np.full(50, step % 7, np.int64))


def test_seen_pieces_are_not_sorted_again(library, monkeypatch):
    """A piece that lies in its slot is found there; pieces that share slots are still found right."""
    texts = [f"word{i} some other pieces {i * i}, ünd" for i in range(300)] * 2
    coder = tokens.WordEncoder(word_bpe_path())
    first = [x.tolist() for x in coder.encode(texts)]
    assert first == [_ids(library, t) for t in texts]
    with monkeypatch.context() as patch:
        patch.setattr(tokens._Pieces, "_sorted", None)
        assert [x.tolist() for x in coder.encode(texts[:100])] == first[:100]
    monkeypatch.setattr(tokens, "SLOT_BITS", 2)
    crowded = tokens.WordEncoder(word_bpe_path())
    assert [[x.tolist() for x in crowded.encode(texts)] for _ in range(2)] == [first] * 2


@pytest.mark.parametrize("key", [None, lambda low, high: low * 0, lambda low, high: low % np.uint64(5) << np.uint64(62)])
def test_pieces_whose_hashes_are_equal(library, monkeypatch, key):
    """Words that were given one hash, and any words under a hash that tells few apart, have the ids of the library."""
    if key:
        monkeypatch.setattr(tokens._Pieces, "_key", staticmethod(key), raising=False)
    texts = ["theingbmtionrerk one word", "its equal: theingbttionrere", "theingbmtionrerk theingbttionrere theingbmtionrerk", "again; theingrationretw, theingrotionretk"]
    coder = WordEncoder(word_bpe_path())
    for some in (texts[:1], texts[1:], texts, [f"{t} {i} w{'o' * i}rd" for i, t in enumerate(texts * 5)]):
        assert [x.tolist() for x in coder.encode(some)] == [_ids(library, t) for t in some]


@pytest.mark.parametrize("counts", [[0, 5], [1] * 16, [1] * 17, [2**k for k in range(40)], list(range(1, 3000))])
def test_tree_has_a_path_for_each_id(counts):
    tree = mixcoder.Tree(mixcoder.depths(np.array(counts)))
    for i, c in enumerate(counts):
        node, found = 0, None
        for d in range(tree.levels):
            place = int(tree.path[d, i])
            if place < 0:
                break
            assert place >> 4 == node
            node = found = int(tree.child[place])
        assert (found == -1 - i) if c else (found is None)


def test_damaged_depths_are_refused():
    with pytest.raises(ValueError):
        mixcoder.Tree(np.ones(17, np.uint8))


def test_ranges_that_are_powers_of_two():
    """A lane cut to a range of 1 passes through 2**16, 2**32 and 2**48, and stays there."""
    writer = mixcoder._Writer(3, 10)
    writer.low[:] = [(1 << 48) - 1, (5 << 48) - (1 << 16), 0]
    writer.range[:] = [1 << 20, 1 << 30, (1 << 64) - 1]
    writer.settle()
    assert writer.range.tolist() == [1 << 48, 1 << 48, (1 << 64) - 1] and writer.n.tolist() == [3, 2, 0]


def test_damage_is_noticed():
    block = tokenfile.pack_block([1, None], [3, 2], np.array([5, 6, 7, 8, 9]), 49408)
    whole = tokenfile.head(49408) + block
    names, lengths, tokens = next(tokenfile.unpack_file(whole))
    assert (names, lengths.tolist(), tokens.tolist()) == ([1, None], [3, 2], [5, 6, 7, 8, 9])
    for at in range(len(whole)):
        with pytest.raises(tokenfile.DamagedFile):
            list(tokenfile.unpack_file(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :]))
    with pytest.raises(tokenfile.DamagedFile):
        list(tokenfile.unpack_file(whole[:-1]))


def test_files(spark, docs, rows, nothing, library, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    tokenfile.write(docs, folder, word_bpe_path(), file_text=40_000, block_tokens=1000)
    found = sorted(tokenfile.read(spark, folder).collect(), key=lambda r: r.start)
    assert sorted(str(r[0]) for r in rows) == sorted(str(r.id) for r in found)
    ids = [-1 if r.id is None else r.id for r in found]
    assert ids == sorted(ids)
    at = 0
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(np.array([*_ids(library, r[1]), 1], "<u4").tobytes())
    for r in found:
        assert r.start == at and r.n == len(r.ids) // 4 and bytes(r.ids) in by[r.id]
        at += r.n
    gone = next(p for p in (tmp_path / "tokens").iterdir() if p.name == "part-000001.tok" or p.suffix == ".tok")
    gone.rename(f"{gone}.away")
    with pytest.raises(Exception, match="is missing"):
        tokenfile.read(spark, folder).collect()
    tokenfile.write(nothing, f"file://{tmp_path}/none", word_bpe_path())
    assert tokenfile.read(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("window,shard", [(4096, 1_500_000), (64, 2000)])
def test_packing(spark, docs, rows, nothing, library, window, shard):
    found = packing.packed(docs, word_bpe_path(), window=window, shard_tokens=shard).collect()
    wanted = sorted((str(r[0]), np.array([*_ids(library, r[1]), 2], "<u4").tobytes()) for r in rows)
    whole, sequences = defaultdict(list), defaultdict(list)
    for p in found:
        whole[p.id].append((p.start, bytes(p.ids), p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, len(p.ids) // 4))
    # Ids that are repeated give pieces of several documents; all their tokens are there.
    assert sum(len(p.ids) for p in found) == sum(len(x) for _, x in wanted)
    for name, pieces in whole.items():
        texts = [x for n, x in wanted if n == str(name)]
        if len(texts) == 1:
            assert b"".join(x for _, x, _ in sorted(pieces)) == texts[0]
            assert all(n * 4 == len(texts[0]) for _, _, n in pieces)
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == window or at & (at - 1) == 0
    assert packing.packed(nothing, word_bpe_path()).count() == 0


def test_neighbours_share_windows():
    rng = np.random.default_rng(0)
    topics = [rng.integers(1000 * k, 1000 * k + 40, (20, 50)) for k in range(4)]
    texts = [topics[i % 4][i // 4] for i in range(80)]
    idf = np.ones(5000, np.float32)
    pure = 0
    for pieces in packing.Shard(texts, idf, 50.0).windows(500):
        pure += len({doc % 4 for doc, _, _ in pieces}) <= 2
    assert pure >= 7
    assert zlib.crc32(b"") == 0


def test_topics_share_windows_over_many_shards(spark):
    rnd = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rnd.choice(letters) for _ in range(7))
    common = [word() for _ in range(300)]
    base = [[rnd.choice(common) if rnd.random() < 0.5 else word() for _ in range(60)] for _ in range(60)]
    rows = [(k * 8 + j, " ".join(w if rnd.random() < 0.95 else rnd.choice(common) for w in base[k])) for k in range(60) for j in range(8)]
    rnd.shuffle(rows)
    table = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "doc_id long, text string")
    topic = [i // 8 for i, _ in rows]
    found = packing.packed(table, word_bpe_path(), window=512, shard_tokens=4000).collect()
    assert len({r.sequence_id >> 32 for r in found}) >= 10
    windows = defaultdict(set)
    for r in found:
        windows[r.sequence_id].add(r.id)
    together = sum(topic[a] == topic[b] for x in windows.values() for a in x for b in x if a < b)
    assert together >= 480, together


def test_routes_split_hot_signatures():
    routes = packing.Routes([(1, 10), (2, 20), (3, 1000), (4, 5)], [(3, 7, 400), (2, 1, 20)], 50)
    assert routes.shard(1, 5, 9) == routes.shard(2, 1, 3)
    hot = {routes.shard(3, 7, k) for k in range(1000)}
    rest = {routes.shard(3, b, 0) for b in range(1000) if b != 7}
    assert len(hot) == 8 and len(rest) == 12 and not hot & rest
    assert max(hot | rest | {routes.shard(4, 0, 0)}) < routes.shards
