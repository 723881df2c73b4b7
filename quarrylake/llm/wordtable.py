"""Distinct words of blocks of documents: what travels is each block's words, never one row per position.

Documents are read in blocks. `split_blocks` gives, for each block and
shard, the block's distinct words of that shard, and for each block its documents
as positions in the block's list of distinct words. The shard's task answers each
question with what it knows of those words, in their order; answers and places
meet by block. Every word of the corpus is handled by one shard, so whatever is
worked out per word is worked out once.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored
from .tokens import slices

#: Bytes of text in a block, and for each shard.
BLOCK, PER_SHARD = 8_000_000, 16_000_000
SCHEMA = "block long, shard int, payload binary"
NAMES = ["block", "shard", "payload"]


def pack(value: object) -> bytes:
    return zstandard.compress(pickle.dumps(value, protocol=5), 3)


def unpack(data: bytes) -> object:
    """What pack() made in another task of the same job."""
    return pickle.loads(zstandard.decompress(data))


def row(block: int, shard: int, payload: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([shard], pa.int32()), pa.array([pack(payload)], pa.binary())], names=NAMES)


def by_count(counts: np.ndarray) -> np.ndarray:
    """The places of a list of words by falling count."""
    return np.argsort(-counts, kind="stable")


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32 as all their lowest bytes, then all second bytes and so on: like bytes together take less."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def shards_for(docs: DataFrame, text_col: str = "text", per_shard: int = PER_SHARD) -> int:
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    return max(12, -(-size // per_shard))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block, rows): the partition's rows (id, text) in blocks of about BLOCK bytes of text, named by a hash of their content."""
    held, size = [], 0
    for batch in slices(batches, 1, 2_000_000):
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= BLOCK:
            yield _named(held)
            held, size = [], 0
    if held:
        yield _named(held)


def _named(held: list[pa.RecordBatch]) -> tuple[int, pa.RecordBatch]:
    rows = _joined(held)
    name = xxhash.xxh64()
    for i, x in zip(rows.column(0).to_pylist(), rows.column(1)):
        text = x.as_buffer() if x.is_valid else b""
        # With the text's length before it no other rows make the same bytes.
        name.update(b"%d %d " % (i, len(text)) if i is not None else b"- %d " % len(text))
        name.update(text)
    return name.intdigest() >> 1, rows


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def by_shard(distinct: set[bytes], shards: int) -> list[list[bytes]]:
    """The words of each shard, sorted."""
    out: list[list[bytes]] = [[] for _ in range(shards)]
    crc = zlib.crc32
    for w in distinct:
        out[crc(w) % shards].append(w)
    for words in out:
        words.sort()
    return out


def split_blocks(rows: DataFrame, split: Callable[[str | None], list[bytes]], shards: int, name: str | None = None, weigh: Callable[[list, list[list[bytes]]], dict[bytes, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(questions, places) of the blocks of `rows` (id, text).

    questions: for each block and shard the words joined by line ends, and what
    `weigh` makes of them (a number for each word). places: for each block the
    ids, lengths and positions of their words in the block's list of words, and
    how often each word of the list occurs. The list goes by shard and word;
    positions are in the list as by_count orders it: frequent words have small
    ones, which take few bytes.

    With a name both are written to the shared folder in one pass. Without one
    each is worked out by a pass of its own, which spares disk; blocks are named
    by their content, so a second pass that saw other blocks is noticed.
    """
    small_batches(rows.sparkSession)

    def made(asked: bool, placed: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, batch in blocks(batches):
                texts = [split(x) for x in batch.column(1).to_pylist()]
                ids = batch.column(0).to_pylist()
                del batch
                weights = weigh(ids, texts) if weigh and asked else None
                place: dict[bytes, int] = {}
                for shard, words in enumerate(by_shard(set().union(*texts), shards)):
                    if words and placed:
                        place.update(zip(words, range(len(place), len(place) + len(words))))
                    if words and asked:
                        yield row(block, shard, (b"\n".join(words), np.array([weights.get(w, 0) for w in words], np.int64) if weigh else None))
                if placed:
                    get = place.__getitem__
                    lengths = np.array([len(words) for words in texts])
                    at = np.fromiter((get(w) for words in texts for w in words), np.int64, int(lengths.sum()))
                    del texts
                    counts = np.bincount(at, minlength=len(place))
                    rank = np.empty(len(place), np.int64)
                    rank[by_count(counts)] = np.arange(len(place))
                    yield row(block, -1, (ids, lengths, _planes(rank[at]), counts.astype(np.int32)))

        return rows.mapInArrow(run, SCHEMA)

    if name is None:
        return made(True, False), made(False, True)
    both = stored(made(True, True).withColumn("places", F.col("shard") < 0), name, by="places")
    return both.where("NOT places").select(*NAMES), both.where("places").select(*NAMES)


def answered(questions: DataFrame, shards: int, make: Callable[[], Callable[[list[bytes], np.ndarray | None], object]]) -> DataFrame:
    """An answer to each question; `make()` gives a function that a task calls with each row's words and weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reply = make()
        for batch in batches:
            for x in batch.to_pylist():
                joined, weights = unpack(x["payload"])
                yield row(x["block"], x["shard"], reply(joined.split(b"\n"), weights))

    return questions.repartition(shards, "shard").mapInArrow(run, SCHEMA)


def met(answers: DataFrame, places: DataFrame, partitions: int, use: Callable[[int, dict[int, object], tuple], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `use(block, answers by shard, places)` yields for each block; places are ids, lengths, positions, and the
    order of the block's list that positions are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1).to_pylist()[0]
                if x["block"] != block:
                    block, held = x["block"], {}
                payload = unpack(x["payload"])
                if x["shard"] >= 0:
                    held[x["shard"]] = payload
                else:
                    ids, lengths, at, counts = payload
                    # Blocks with the same rows share a name, and the answers: these stay until the name changes.
                    yield from use(block, held, (ids, lengths, _unplaned(at), by_count(counts)))

    both = answers.unionByName(places).repartition(partitions, "block").sortWithinPartitions("block", F.desc("shard"))
    return both.mapInArrow(run, schema)
