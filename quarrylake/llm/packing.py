"""Packing of documents into windows with their lexical neighbours, by a sharded BM25 index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored
from .tokens import encoded, load, word_bpe_path

K1, B = 1.2, 0.75
#: Tokens that one shard of the index holds on average.
SHARD_TOKENS = 1_500_000


def term_statistics(tokens: DataFrame, vocabulary: int) -> tuple[np.ndarray, int, float]:
    """Document frequencies of all ids, number of documents, mean length: over all rows of `tokens`.

    The tasks that encoded have counted their documents; the driver gets one number per id of the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for x in batch.column(0):
                pairs = np.frombuffer(x.as_buffer(), "<i8").reshape(-1, 2)
                df[pairs[:, 0]] += pairs[:, 1]
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen])], names=["term", "df"])

    df = np.zeros(vocabulary, np.int64)
    counts = tokens.where("df IS NOT NULL").select("df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df[counts.column("term").to_numpy()] = counts.column("df").to_numpy()
    n, total = tokens.where("n IS NOT NULL").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return df, n, total / max(n, 1)


def signatures(idf: np.ndarray, df: np.ndarray) -> list[np.ndarray]:
    """Two tables of ranks of all ids. A document's signature is its least rank in each: a weighted minhash, equal in two
    documents with a chance of about their overlap weighted by idf squared. Ids of a single document come last."""
    rnd = np.random.default_rng(42)
    weight = np.where(df > 1, idf.astype(np.float64) ** 2, 0)
    out = []
    for _ in range(2):
        value = np.full(len(idf), np.inf)
        np.divide(rnd.exponential(size=len(idf)), weight, out=value, where=weight > 0)
        rank = np.empty(len(idf), np.int64)
        rank[np.argsort(value, kind="stable")] = np.arange(len(idf))
        out.append(rank)
    return out


class Routes:
    """Shards of about `shard_tokens` ids for documents by their signatures, so that those of a signature share one.

    first: (rank, ids) of all first ranks; both: (rank, rank, ids) of pairs with
    more than a quarter of a shard. Small first ranks fill shards together; one
    that is larger than a shard has shards of its own, dealt by the second rank,
    and large pairs of it shards of their own, dealt by the document.
    """

    def __init__(self, first: list[tuple[int, int]], both: list[tuple[int, int, int]], shard_tokens: int):
        large = {a for a, n in first if n > shard_tokens}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.firsts: dict[int, tuple[int, int]] = {}
        self.shards, taken = 0, dict.fromkeys(large, 0)
        for a, b, n in sorted(both):
            if a in large:
                self.pairs[a, b] = self._new(n, shard_tokens)
                taken[a] += n
        room = 0
        for a, n in sorted(first):
            if a in large:
                self.firsts[a] = self._new(n - taken[a], shard_tokens)
                continue
            if n > room:
                last, room = self._new(n, shard_tokens), shard_tokens
            self.firsts[a] = last
            room -= n

    def _new(self, n: int, shard_tokens: int) -> tuple[int, int]:
        begin, count = self.shards, max(1, -(-n // shard_tokens))
        self.shards += count
        return begin, count

    def shard(self, a: int, b: int, key: int) -> int:
        begin, count = self.pairs.get((a, b)) or self.firsts[a]
        return begin + (key if (a, b) in self.pairs else b * 2654435761 >> 8) % count


class Shard:
    """A BM25 inverted index over the documents of one shard."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.texts = texts
        self.size = np.array([len(x) for x in texts], np.int64)
        terms, docs, counts = [], [], []
        for i, x in enumerate(texts):
            t, c = np.unique(x, return_counts=True)
            terms.append(t), counts.append(c), docs.append(np.full(len(t), i, np.int32))
        self.terms = terms
        term, doc = np.concatenate(terms).astype(np.int64), np.concatenate(docs)
        tf = np.concatenate(counts).astype(np.float32)
        norm = (K1 * (1 - B + B * self.size / mean_length)).astype(np.float32)
        order = np.argsort(term, kind="stable")
        self.doc = doc[order]
        self.weight = (idf[term] * tf * (K1 + 1) / (tf + norm[doc]))[order].astype(np.float32)
        self.first = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document that the index still has for the seed's terms."""
        begin, end = self.first[self.terms[seed]], self.first[self.terms[seed] + 1]
        n = end - begin
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.doc[at], self.weight[at], minlength=len(self.texts))

    def keep(self, unused: np.ndarray) -> None:
        """Drops the postings of used documents."""
        kept = unused[self.doc]
        before = np.concatenate([[0], np.cumsum(kept)])
        self.first = before[self.first]
        self.doc, self.weight = self.doc[kept], self.weight[kept]

    def windows(self, window: int) -> Iterator[list[tuple[int, int, int]]]:
        """Windows as lists of (document, start, length); all but the last are full.

        The seed is what the window before cut off, else the first unused
        document; unused documents follow by falling score (ties: by their
        order), the last one cut where the window ends.
        """
        unused = np.ones(len(self.texts), bool)
        after: tuple[int, int] | None = None
        first, indexed = 0, len(unused)
        while True:
            left = int(unused.sum())
            if left * 2 < indexed:
                self.keep(unused)
                indexed = left
            if after is None:
                while first < len(unused) and not unused[first]:
                    first += 1
                if first == len(unused):
                    return
                after = (first, 0)
                unused[first] = False
            seed, start = after
            length = min(window, int(self.size[seed]) - start)
            pieces, room, after = [(seed, start, length)], window - length, None
            if start + length < self.size[seed]:
                after = (seed, start + length)
            elif room:
                rest = np.flatnonzero(unused)
                for i in rest[np.argsort(-self.scores(seed)[rest], kind="stable")].tolist():
                    unused[i] = False
                    length = min(room, int(self.size[i]))
                    pieces.append((i, 0, length))
                    room -= length
                    if length < self.size[i]:
                        after = (i, length)
                    if not room:
                        break
            yield pieces


def powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces of a window that isn't full, cut into sequences whose lengths are powers of two, longest first."""
    total = sum(x[2] for x in pieces)
    for bit in reversed(range(total.bit_length())):
        room = total & 1 << bit
        out = []
        while room:
            doc, start, length = pieces[0]
            part = min(room, length)
            out.append((doc, start, part))
            pieces = [(doc, start + part, length - part), *pieces[1:]] if part < length else pieces[1:]
            room -= part
        if out:
            yield out


def packed(docs: DataFrame, path: str, window: int = 4096, end: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(id, start, ids, doc_tokens, sequence_id, offset): one row for each piece of a document.

    Each document's ids, with `end` after them, are cut into pieces; each id
    lies in one piece. Sequences have `window` ids, but for the last of each
    shard, whose ids go into sequences that are powers of two long: nothing is
    padded. A null or empty text is its end id alone. Rows with a null id are
    packed like others; repeated ids are documents of their own. An empty table
    gives an empty table. Other columns of `docs` are not read.

    Documents whose rare ids overlap share a shard of about `shard_tokens` ids
    with a chance that grows with the overlap (see Routes). Each shard has its
    inverted index over token ids; document frequencies and the mean length are
    those of the whole table. A task holds one shard at a time.
    """
    spark = docs.sparkSession
    tokens = stored(encoded(docs, path, end, id_col, text_col), "tokens")
    vocabulary = load(path).get_vocab_size()
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    df, n, mean_length = term_statistics(tokens, vocabulary)
    total = int(round(n * mean_length))
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    shared = spark.sparkContext.broadcast((idf, signatures(idf, df)))  # three numbers per id of the vocabulary
    alone = total <= shard_tokens

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value[1]
        for batch in batches:
            texts = [np.frombuffer(x.as_buffer(), width) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([int(t[x].min()) for x in texts], pa.int64()) for t in (one, two)] + [pa.array(map(len, texts), pa.int64())], names=["a", "b", "n"])

    documents_of = tokens.where("n IS NOT NULL")
    if alone:
        routes = None
    else:
        signs = stored(documents_of.select("ids").mapInArrow(signed, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "signatures")
        # At most one row per id of the vocabulary, and four for each shard.
        first = [tuple(x) for x in signs.groupBy("a").agg(F.sum("n")).collect()]
        both = [tuple(x) for x in signs.where(f"n * 4 > {shard_tokens}").collect()]
        routes = spark.sparkContext.broadcast(Routes(first, both, shard_tokens))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value[1]
        for batch in batches:
            texts = [np.frombuffer(x.as_buffer(), width) for x in batch.column(1)]
            shard = [routes.value.shard(int(one[x].min()), int(two[x].min()), key) for x, key in zip(texts, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shard, pa.int32())], names=["id", "ids", "shard"])

    def pack(shard: int, ids: list, texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        index = Shard(texts, shared.value[0], mean_length)
        sequence, rows = shard << 32, []
        for pieces in index.windows(window):
            for one in [pieces] if sum(x[2] for x in pieces) == window else powers(pieces):
                offset = 0
                for doc, start, length in one:
                    rows.append((ids[doc], start, texts[doc][start : start + length].astype("<u4").tobytes(), len(texts[doc]), sequence, offset))
                    offset += length
                sequence += 1
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], names=_NAMES)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, texts = 0, [], []
        for batch in batches:
            for i, x, shard in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if shard != now:
                    if texts:
                        yield from pack(now, ids, texts)
                    now, ids, texts = shard, [], []
                ids.append(i)
                texts.append(np.frombuffer(x.as_buffer(), width).copy())
        if texts:
            yield from pack(now, ids, texts)

    if alone:
        dealt = documents_of.select("id", "ids", F.lit(0).alias("shard")).repartition(1)
    else:
        # The ids of a text join its key so that rows with a null id spread too.
        dealt = documents_of.select("id", "ids", F.xxhash64("id", "ids").alias("key")).mapInArrow(routed, "id long, ids binary, shard int")
        dealt = dealt.repartition(routes.value.shards, "shard")
    return dealt.sortWithinPartitions("shard", "id", "ids").mapInArrow(run, "id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")


_NAMES = ["id", "start", "ids", "doc_tokens", "sequence_id", "offset"]
_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """packed() with a checksum of each piece's ids in the place of the ids."""
    length = (F.octet_length("ids") / 4).cast("long")
    return packed(docs, path).select(F.col("id").alias("doc_id"), "start", length.alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(documents(spark, sf_dir), word_bpe_path())
