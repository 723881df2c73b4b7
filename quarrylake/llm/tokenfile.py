"""Token ids in binary files of independently reset, checksummed blocks.

A file is a header and blocks. A block holds whole documents: their ids, the
lengths of their token sequences, and the tokens as mixcoder codes them, with a
model of the block's own. Files are named by their place in the order of
documents, so that file after file gives ascending ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, shared_dir, small_batches
from .mixcoder import decode, encode
from .tokens import encoder, load, slices, word_bpe_path

MAGIC = b"QLTOKEN3"
#: mark, size of the vocabulary, CRC-32 of both.
HEAD = "<8sII"
#: documents, tokens, lanes, steps, bytes of the table of documents, bytes of the payload, CRC-32 of the tokens, and of all else.
BLOCK = "<4sIQIIIQII"
#: Tokens after which a block ends with the document it is in.
BLOCK_TOKENS = 2_000_000
#: Bytes of text for a file.
FILE_TEXT = 24_000_000


class DamagedFile(ValueError):
    """A block whose checksum doesn't hold, or a file that is cut short."""


def head(vocabulary: int) -> bytes:
    """What a file begins with."""
    return struct.pack(HEAD, MAGIC, vocabulary, zlib.crc32(struct.pack("<8sI", MAGIC, vocabulary)))


def pack_block(names: list[int | None], lengths: list[int], tokens: np.ndarray, vocabulary: int) -> bytes:
    """A block of documents: their ids (None is kept), lengths and joined tokens."""
    known = np.array([x is not None for x in names], np.uint8)
    ids = np.array([x or 0 for x in names], "<i8")
    table = zlib.compress(known.tobytes() + ids.tobytes() + np.array(lengths, "<u8").tobytes(), 1)
    lanes, steps, payload = encode(tokens, vocabulary)
    rest = zlib.crc32(payload, zlib.crc32(table, zlib.crc32(struct.pack("<IQII", len(names), len(tokens), lanes, steps))))
    return struct.pack(BLOCK, b"BLK1", len(names), len(tokens), lanes, steps, len(table), len(payload), zlib.crc32(tokens.astype("<u4").tobytes()), rest) + table + payload


def unpack_file(content: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, lengths, tokens) of each block; raises DamagedFile rather than return what wasn't written."""
    if len(content) < struct.calcsize(HEAD) or content[:8] != MAGIC:
        raise DamagedFile("not a token file")
    _, vocabulary, crc = struct.unpack_from(HEAD, content)
    if crc != zlib.crc32(content[:12]):
        raise DamagedFile("the head's checksum doesn't hold")
    at = struct.calcsize(HEAD)
    while at < len(content):
        if at + struct.calcsize(BLOCK) > len(content):
            raise DamagedFile("cut short")
        mark, docs, n, lanes, steps, table_size, payload_size, crc, rest = struct.unpack_from(BLOCK, content, at)
        at += struct.calcsize(BLOCK)
        table, payload = content[at : at + table_size], content[at + table_size : at + table_size + payload_size]
        at += table_size + payload_size
        if mark != b"BLK1" or at > len(content) or rest != zlib.crc32(payload, zlib.crc32(table, zlib.crc32(struct.pack("<IQII", docs, n, lanes, steps)))):
            raise DamagedFile("a block's checksum doesn't hold")
        plain = zlib.decompress(table)
        known, ids, lengths = np.frombuffer(plain, np.uint8, docs), np.frombuffer(plain, "<i8", docs, docs), np.frombuffer(plain, "<u8", docs, 9 * docs).astype(np.int64)
        tokens = decode(n, lanes, steps, payload, vocabulary)
        if crc != zlib.crc32(tokens.astype("<u4").tobytes()) or lengths.sum() != n:
            raise DamagedFile("a block's tokens differ from what was written")
        yield [x if k else None for x, k in zip(ids.tolist(), known.tolist())], lengths, tokens


def write(docs: DataFrame, folder: str, path: str, end: int | None = 1, id_col: str = "doc_id", text_col: str = "text", file_text: int = FILE_TEXT, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes the tokens of all texts, each followed by `end`, to `folder` in ascending order of ids.

    Rows with a null id come first; rows that share an id come in the order of
    their texts' hashes. A null text counts as empty. An empty table gives a
    folder without token files. `folder` is a URI that all executors reach. A
    file is written under a hidden name and then moved, so that a task that is
    run again, or twice at once, leaves one whole file. Other columns of `docs`
    are not read.

    Documents are dealt by ranges of ids, and of hashes within an id; each task
    writes one file and holds one block of it.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    files = max(6, -(-size // file_text))
    vocabulary = load(path).get_vocab_size()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        system, place = pafs.FileSystem.from_uri(folder)
        system.create_dir(place)
        hidden, name = f"{place}/.part-{part:06d}-{attempt}", f"{place}/part-{part:06d}.tok"
        coder, last = encoder(path), np.array([] if end is None else [end], np.int64)
        docs_in, tokens_in = 0, 0
        with system.open_output_stream(hidden) as out:
            out.write(head(vocabulary))
            names: list = []
            held: list[np.ndarray] = []
            n = 0

            def flush() -> None:
                out.write(pack_block(names, [len(x) for x in held], np.concatenate(held), vocabulary))

            for batch in slices(_chain(first, batches), 1):
                for name_of, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist())):
                    names.append(name_of)
                    held.append(np.concatenate([ids, last]).astype(np.int32))
                    n += len(held[-1])
                    if n >= block_tokens:
                        flush()
                        docs_in, tokens_in = docs_in + len(names), tokens_in + n
                        names, held, n = [], [], 0
            if names:
                flush()
                docs_in, tokens_in = docs_in + len(names), tokens_in + n
        system.move(hidden, name)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([docs_in], pa.int64()), pa.array([tokens_in], pa.int64())], names=["part", "docs", "tokens"])

    ordered = rows.repartitionByRange(files, "id", "h").sortWithinPartitions("id", "h").select("id", "text")
    written = ordered.mapInArrow(run, "part int, docs long, tokens long")
    written.write.mode("overwrite").parquet(f"{folder}/_manifest")


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _starts(manifest: DataFrame) -> DataFrame:
    """(part, expected, base): tokens of each file and of all files before it, summed by thousands of files first."""
    rows = manifest.select("part", F.col("tokens").alias("expected"), F.floor(F.col("part") / 1000).alias("group"))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy("group").agg(F.sum("expected").alias("of_group")).select("group", F.coalesce(F.sum("of_group").over(before), F.lit(0)).alias("of_groups"))
    inside = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(groups, "group").select("part", "expected", (F.col("of_groups") + F.coalesce(F.sum("expected").over(inside), F.lit(0))).alias("base"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n, ids): one row for each document in the files of `folder`; start counts the tokens of all documents
    before it; ids are little-endian unsigned integers of 32 bits. Fails on a damaged or a missing file.

    A row for each file goes to the tasks, which open the files themselves: no file's content is shuffled.
    """
    manifest = spark.read.schema("part int, docs long, tokens long").parquet(f"{folder}/_manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for part, expected, at in zip(*(batch.column(k).to_pylist() for k in range(3))):
                try:
                    with system.open_input_file(f"{place}/part-{part:06d}.tok") as file:
                        content = file.read()
                except FileNotFoundError as gone:
                    raise DamagedFile(f"part {part} is missing") from gone
                for names, lengths, tokens in unpack_file(content):
                    ends = np.cumsum(lengths)
                    for i in range(0, len(names), 2000):
                        some, end = lengths[i : i + 2000], ends[i : i + 2000]
                        data = tokens[end[0] - some[0] : end[-1]].astype("<u4")
                        offsets = np.concatenate([[0], 4 * np.cumsum(some)])
                        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 2000], pa.int64()), pa.array(at + end - some), pa.array(some), ids], names=["id", "start", "n", "ids"])
                    at, expected = at + len(tokens), expected - len(tokens)
                if expected:
                    raise DamagedFile(f"part {part} is cut short")

    files = max(1, manifest.count())
    dealt = _starts(manifest).repartition(files, "part").select("part", "expected", "base")
    return dealt.mapInArrow(run, "id long, start long, n long, ids binary")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), folder, word_bpe_path())
    found = read(spark, folder)
    return found.select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
