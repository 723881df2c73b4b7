"""Katz backoff bigram model of whole documents, with Good-Turing discounts."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, forget, stored
from .wordtable import NAMES, SCHEMA, met, row, shards_for, split_blocks, unpack

#: Counts above this are not discounted.
K = 5
#: Words that are more than this share of a shard's mean number of tokens are hot: their bigrams are dealt over all shards.
HOT_SHARE = 0.25


def discounts(n: dict[int, int]) -> np.ndarray:
    """Katz's factors d[r] for counts r = 0 to K and, last, for all above, from the numbers n[r] of types seen r times.

    A factor that the counts don't support (outside 0 to 1, or from an empty
    class) is one: such a count is not discounted.
    """
    d = np.ones(K + 2)
    n1 = n.get(1, 0)
    cut = (K + 1) * n.get(K + 1, 0) / n1 if n1 else 1.0
    if cut < 1:
        for r in range(1, K + 1):
            if n.get(r) and n.get(r + 1):
                x = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut)
                d[r] = x if 0 < x < 1 else 1.0
    return d


class Unigrams:
    """Discounted word probabilities; one further class holds all words that training lacks."""

    def __init__(self, n: int, types: int, counts: dict[int, int]):
        self.n, self.types = n, types
        self.d = discounts(counts)
        kept = sum(r * c * self.d[min(r, K + 1)] for r, c in counts.items() if r <= K) + n - sum(r * c for r, c in counts.items() if r <= K)
        # If nothing was discounted, the unknown class counts as one more token.
        self.total = n if n - kept > 1e-9 * max(n, 1) else n + 1
        self.unknown = (self.total - kept) / self.total if self.total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        seen = self.d[np.minimum(c, K + 1)] * c / max(self.total, 1)
        return np.where(c > 0, seen, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 1) / (self.n + self.types + 1)


def _words(text: str | None) -> list[bytes]:
    """Lower-cased words, then the empty word, which stands for the end."""
    return [*(text or "").encode("utf-8").lower().split(), b""]


def _count(texts: list[list[bytes]], held: list[bool]) -> dict[bytes, int]:
    """Each word's training count, plus 2**32 for each time it is held out; a block has fewer words than that."""
    train: Counter[bytes] = Counter()
    other: Counter[bytes] = Counter()
    for words, out_of in zip(texts, held):
        (other if out_of else train).update(words)
    for w, c in other.items():
        train[w] += c << 32
    return train


def _is_held(i: int | None, modulus: int, held: int) -> bool:
    return zlib.crc32(b"" if i is None else b"%d" % i) % modulus == held


def _is_hot(numbers: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which of the numbers are in the sorted `hot`."""
    at = np.searchsorted(hot, numbers)
    return hot[np.minimum(at, len(hot) - 1)] == numbers if len(hot) else np.zeros(len(numbers), bool)


def _pair_shard(first: np.ndarray, second: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """A pair's shard: that of its first word, but for hot first words, whose pairs are dealt by both."""
    return np.where(hot, (first * 31 + second * 2654435761) % shards, first % shards).astype(np.int64)


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, bigrams).

    scores: (id, held_out, n_tokens, n_known, train_tokens, base_score, score),
    one row for each row of `docs`. The model learns from rows whose
    crc32(id as text) mod `modulus` is not `held` (a null id counts as the text
    ''). Tokens are words and one end; a null or empty text is its end alone.
    Repeated ids are scored and counted as often as they occur. Without training
    rows every token is in the unknown class, which has all probability.

    bigrams: the model's table, partitioned by shard, as arrays (shard, first,
    second, n): numbers of words and counts. A bigram that training lacks backs
    off to its second word, with the weight that makes the probabilities after
    each first word sum to one; words that training lacks share one class.

    Blocks of documents ask once for each of their distinct words and bigrams;
    the shards that own these sum counts over all blocks and answer.
    """
    shards = shards or shards_for(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def weigh(ids: list, texts: list[list[bytes]]) -> dict[bytes, int]:
        return _count(texts, [_is_held(i, modulus, held) for i in ids])

    questions, places = split_blocks(rows, _words, shards, "words", weigh)
    known = stored(_numbered(questions, shards), "numbers")
    classes = known.where("block = -1").select("c", "types").groupBy("c").agg(F.sum("types").alias("types"))
    few = {c: n for c, n in classes.where(f"c <= {K + 1}").collect()}
    n, types = classes.agg(F.coalesce(F.sum(F.col("c") * F.col("types")), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    one = Unigrams(n, types, few)
    # All tokens are shared among words, so fewer than shards / HOT_SHARE words have more than HOT_SHARE / shards of them.
    every = known.where("block = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    often = known.where("block = -2 AND tokens > %r" % (HOT_SHARE * every / shards)).select("c").toArrow()
    hot_words = np.sort(often.column("c").to_numpy())

    sequences = stored(met(known.where("block >= 0").select(*NAMES), places, shards, _sequences, SCHEMA), "sequences")
    forget(questions, places, known)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                yield from _ask_pairs(x["block"], unpack(x["payload"]), hot_words, shards, modulus, held)

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for batch in batches:
            for x in batch.to_pylist():
                by.setdefault(x["shard"], []).append((x["block"], x["payload"]))
        for k, asks in by.items():
            yield from _answer_pairs(k, asks, one, hot_words)

    asks = sequences.mapInArrow(ask, SCHEMA).repartition(shards, "shard")
    answers = stored(asks.mapInArrow(reply, SCHEMA + ", r int, types long, hot array<long>, hot_sums array<double>, first array<int>, second array<int>, n array<int>"), "pairs")
    pair_classes = {r: t for r, t in answers.where("block = -1").groupBy("r").agg(F.sum("types")).collect()}
    two = discounts(pair_classes)
    # Sums of the hot first words: fewer than shards / HOT_SHARE * (K + 2) numbers.
    sums = answers.where("block = -2").select(F.explode(F.arrays_zip("hot", "hot_sums")).alias("x")).groupBy("x.hot").agg(F.sum("x.hot_sums").alias("s")).collect()
    hot = np.zeros(len(hot_words) * (K + 2))
    for key, value in sums:
        hot[key] = value
    hot = hot.reshape(-1, K + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kept = None, {}
        for batch in batches:
            for x in batch.to_pylist():
                if x["block"] != block:
                    block, kept = x["block"], {}
                if x["shard"] >= 0:
                    kept[x["shard"]] = unpack(x["payload"])
                else:
                    yield _score(*unpack(x["payload"]), kept, one, two, hot_words, hot, shards, modulus, held)

    both = answers.where("block >= 0").select(*NAMES).unionByName(sequences).repartition(shards, "block").sortWithinPartitions("block", F.desc("shard"))
    scores = both.mapInArrow(run, "id long, n_tokens long, n_known long, base_score double, score double")
    scores = scores.select("id", (fold("id", modulus) == held).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
    return scores, answers.where("block = -3").select("shard", "first", "second", "n")


def _ask_pairs(block: int, sequences: tuple, hot: np.ndarray, shards: int, modulus: int, held: int) -> Iterator[pa.RecordBatch]:
    """A block's distinct pairs, by shard: the pairs as differences, their training counts here and their second words' counts."""
    ids, lengths, at, numbers, counts = sequences
    first, second, train = _pairs(ids, lengths, at, modulus, held)
    ranks, n, _ = _distinct(first, second, train)
    # Numbers rise with ranks: pairs of numbers come in the order of pairs of ranks.
    b_rank = ranks & 0xFFFFFFFF
    a, b = numbers[ranks >> 32], numbers[b_rank]
    pairs = (a << 32) | b
    shard = _pair_shard(a, b, _is_hot(numbers, hot)[ranks >> 32], shards)
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1)).tolist()
    for k in range(shards):
        some = order[bounds[k] : bounds[k + 1]]
        if len(some):
            yield row(block, k, (np.diff(pairs[some], prepend=0), n[some].astype(np.int32), counts[b_rank[some]].astype(np.int32)))


def _numbered(questions: DataFrame, shards: int) -> DataFrame:
    """Answers to questions: each word's number and training count. Rows of block -1 tell how many words have each count,
    and how many tokens they are with those held out; rows of block -2 the words that may be hot, with their tokens.

    Numbers are unique and small for frequent words: a shard numbers its words
    by falling count. That needs all questions of the shard, which are the
    distinct words of its blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for batch in batches:
            for x in batch.to_pylist():
                by.setdefault(x["shard"], []).append((x["block"], x["payload"]))
        for shard, asks in by.items():
            yield from _number_words(shard, asks, shards)

    return questions.repartition(shards, "shard").mapInArrow(run, SCHEMA + ", c long, types long, tokens long")


def _number_words(shard: int, asks: list, shards: int) -> Iterator[pa.RecordBatch]:
    names = [*NAMES, "c", "types", "tokens"]
    total: dict[bytes, int] = {}
    held_out: Counter[bytes] = Counter()
    for _, payload in asks:
        joined, weights = unpack(payload)
        words = joined.split(b"\n")
        for w, c in zip(words, (weights & 0xFFFFFFFF).tolist()):
            total[w] = total.get(w, 0) + c
        for i in np.flatnonzero(weights >> 32).tolist():
            held_out[words[i]] += int(weights[i]) >> 32
    ordered = sorted(total, key=lambda w: (-total[w], w))
    number = {w: i * shards + shard for i, w in enumerate(ordered)}
    for block, payload in asks:
        words = unpack(payload)[0].split(b"\n")
        answer = row(block, shard, (np.array([number[w] for w in words], np.int64), np.array([total[w] for w in words], np.int64)))
        yield pa.RecordBatch.from_arrays([*answer.columns, *[pa.nulls(1, pa.int64())] * 3], names=names)

    def told(block: int, c: np.ndarray, types: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
        m = len(c)
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.array(np.full(m, shard, np.int32)), pa.nulls(m, pa.binary()), pa.array(c), pa.array(types), pa.array(tokens)], names=names)

    counts = np.fromiter(total.values(), np.int64, len(total))
    tokens = counts + np.fromiter(map(held_out.__getitem__, total), np.int64, len(total))
    c, types = np.unique(counts, return_counts=True)
    # The class of count 0 isn't one of the model's, but its tokens are of the corpus.
    yield told(-1, c, np.where(c > 0, types, 0), np.bincount(np.searchsorted(c, counts), tokens).astype(np.int64))
    # The corpus has at least this shard's tokens: no hot word is missed.
    may = tokens > HOT_SHARE * tokens.sum() / shards
    numbers = np.fromiter(map(number.__getitem__, total), np.int64, len(total))
    yield told(-2, numbers[may], np.zeros(may.sum(), np.int64), tokens[may])


def _sequences(block: int, held: dict[int, object], places: tuple) -> Iterator[pa.RecordBatch]:
    """A block's documents as positions in its list of words, with the words' numbers and training counts."""
    ids, lengths, at, listed = places
    numbers = np.concatenate([held[k][0] for k in sorted(held)])[listed]
    counts = np.concatenate([held[k][1] for k in sorted(held)])[listed]
    # Frequent words get small positions: the same sequences, fewer bytes.
    order = np.argsort(numbers, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    yield row(block, -1, (ids, lengths, rank[at], numbers[order], counts[order]))


def _pairs(ids: list, lengths: np.ndarray, at: np.ndarray, modulus: int, held: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token its predecessor (for the first the end, which every document has), itself, and whether it is for training."""
    ends = np.cumsum(lengths)
    first = np.empty_like(at)
    first[1:] = at[:-1]
    first[ends - lengths] = at[ends - 1]
    train = np.repeat(np.array([not _is_held(i, modulus, held) for i in ids], bool), lengths)
    return first, at, train


def _distinct(a: np.ndarray, b: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs, how often each occurs in training, and the place of each given pair among them."""
    pair = (a.astype(np.int64) << 32) | b
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    new = np.diff(pair, prepend=-1) != 0
    place = np.empty(len(pair), np.int64)
    place[order] = np.cumsum(new) - 1
    return pair[new], np.bincount(place, train, minlength=int(new.sum())).astype(np.int64), place


def _answer_pairs(shard: int, asks: list, one: Unigrams, hot_words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """To each block, for its pairs of this shard in their order: the training count of each pair and, by first word,
    how many tokens follow it in pairs of each count up to K, and above, and the sum of the followers' word probabilities."""
    names = [*NAMES, "r", "types", "hot", "hot_sums", "first", "second", "n"]

    def out(block: int, payload: object, **more: pa.Array) -> pa.RecordBatch:
        blank = {"r": pa.nulls(1, pa.int32()), "types": pa.nulls(1, pa.int64()), "hot": pa.nulls(1, pa.list_(pa.int64())), "hot_sums": pa.nulls(1, pa.list_(pa.float64())), **{k: pa.nulls(1, pa.list_(pa.int32())) for k in ("first", "second", "n")}} | more
        return pa.RecordBatch.from_arrays([*row(block, shard, payload).columns, *blank.values()], names=names)

    keys = [np.cumsum(unpack(p)[0]) for _, p in asks]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    new = np.diff(every[order], prepend=-1) != 0
    inverse = np.empty(len(every), np.int64)
    inverse[order] = np.cumsum(new) - 1
    pair = every[order][new]
    n = np.bincount(inverse, np.concatenate([unpack(p)[1] for _, p in asks]), minlength=len(pair)).astype(np.int64)
    second_count = np.zeros(len(pair), np.int64)
    second_count[inverse] = np.concatenate([unpack(p)[2] for _, p in asks])
    a = pair >> 32
    first_at = np.flatnonzero(np.diff(a, prepend=-1))
    capped = np.minimum(n, K + 1)
    sums = np.stack([np.add.reduceat(np.where(capped == r, n, 0), first_at) for r in range(1, K + 2)] + [np.add.reduceat(np.where(n > 0, one.p(second_count), 0.0), first_at)], axis=1)
    firsts = a[first_at]
    for (block, _), key in zip(asks, keys):
        at = np.searchsorted(pair, key)
        mine = np.unique(key >> 32)
        yield out(block, (n[at].astype(np.int32), sums[np.searchsorted(firsts, mine)]))
    hot = np.flatnonzero(_is_hot(firsts, hot_words))
    if len(hot):
        cells = (np.searchsorted(hot_words, firsts[hot])[:, None] * (K + 2) + np.arange(K + 2)).ravel()
        yield out(-2, None, hot=pa.array([cells.tolist()], pa.list_(pa.int64())), hot_sums=pa.array([sums[hot].ravel().tolist()], pa.list_(pa.float64())))
    for r in range(1, K + 2):
        yield out(-1, None, r=pa.array([r], pa.int32()), types=pa.array([int((n == r).sum())], pa.int64()))
    seen = n > 0
    for i in range(0, int(seen.sum()), 200_000):
        part = np.flatnonzero(seen)[i : i + 200_000]
        lists = {k: pa.array([v[part].astype(np.int32)], pa.list_(pa.int32())) for k, v in (("first", a), ("second", pair & 0xFFFFFFFF), ("n", n))}
        yield out(-3, None, **lists)


def log_probabilities(n: np.ndarray, second_count: np.ndarray, sums: np.ndarray, one: Unigrams, two: np.ndarray) -> np.ndarray:
    """log10 p(second | first) of pairs, given their counts, their second words' counts and the sums of their first words."""
    tokens = sums[:, : K + 1]
    total = tokens.sum(1)
    kept = tokens @ two[1:]
    # A first word none of whose followers is discounted counts one token more, so that unseen ones have some mass.
    total = np.where(total - kept > 1e-9, total, total + 1)
    lower = one.p(second_count)
    rest = np.maximum(1 - sums[:, K + 1], 1e-12)
    seen = two[np.minimum(n, K + 1)] * n / total
    return np.log10(np.where(n > 0, seen, np.where(tokens.sum(1) > 0, (total - kept) / total / rest * lower, lower)))


def _score(ids: list, lengths: np.ndarray, at: np.ndarray, numbers: np.ndarray, counts: np.ndarray, answers: dict[int, object], one: Unigrams, two: np.ndarray, hot_words: np.ndarray, hot: np.ndarray, shards: int, modulus: int, held: int) -> pa.RecordBatch:
    first, second, train = _pairs(ids, lengths, at, modulus, held)
    ranks, _, place = _distinct(first, second, train)
    b_rank = ranks & 0xFFFFFFFF
    a, b = numbers[ranks >> 32], numbers[b_rank]
    is_hot = _is_hot(numbers, hot_words)[ranks >> 32]
    shard = _pair_shard(a, b, is_hot, shards)
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1)).tolist()
    n, sums = np.zeros(len(ranks), np.int64), np.zeros((len(ranks), K + 2))
    for k, (got, by_first) in answers.items():
        some = order[bounds[k] : bounds[k + 1]]
        n[some] = got
        sums[some] = by_first[np.cumsum(np.diff(a[some], prepend=a[some[0]]) != 0)]
    sums[is_hot] = hot[np.searchsorted(hot_words, a[is_hot])]
    logs = log_probabilities(n, counts[b_rank], sums, one, two)
    token = logs[place]
    starts = np.cumsum(lengths) - lengths
    c = counts[second]
    columns = [np.add.reduceat(x, starts) for x in ((c > 0).astype(np.int64), np.log10(one.base(c)), token)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths.astype(np.int64)), *map(pa.array, columns)], names=["id", "n_tokens", "n_known", "base_score", "score"])


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = scored(documents(spark, sf_dir))
    return scores.withColumnRenamed("id", "doc_id")
