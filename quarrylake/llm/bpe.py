"""BPE encoding through a table of distinct words, and decoding through the table of pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .tokens import encoder, load, word_bpe_path
from .wordtable import answered, met, shards_for, split_blocks


#: Shards of the table of words at most: a shard's words grow with the vocabulary only, which is shared by all texts.
MOST_SHARDS = 2048


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, steady: bool = False) -> DataFrame:
    """(id, ids): one row for each row of `docs`; ids is the array of a text's ids under the tokenizer at `path`.

    For tokenizers that never join what ASCII white space parts. A null text
    counts as empty; an empty text has no ids. Rows with null or repeated ids
    are encoded like others; an empty table gives an empty table. Other columns
    of `docs` are not read.

    Texts are split in Spark; each distinct word goes to its shard, which
    encodes it once, and the ids come back to the blocks of documents that hold
    the word, where they are set at the word's positions. `steady` says that the
    rows come in the same order whenever they are read, as from files: they are
    then read twice, else once, with the words kept in the shared folder meanwhile.
    """
    shards = shards or min(MOST_SHARDS, shards_for(docs, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def make() -> Callable:
        coder, known = encoder(path), {}

        def reply(words: list[bytes], _: None) -> object:
            missing = [w for w in words if w not in known]
            known.update(zip(missing, coder.words(missing)))
            ids = [known[w] for w in words]
            return np.array([len(x) for x in ids], np.int32), b"".join(ids)

        return reply

    def use(block: int, held: dict[int, object], places: tuple) -> Iterator[pa.RecordBatch]:
        dtype = encoder(path).dtype
        table: list[bytes] = []
        for shard in sorted(held):
            sizes, ids = held[shard]
            ends = np.cumsum(sizes)
            table += [ids[i:j] for i, j in zip((ends - sizes).tolist(), ends.tolist())]
        names, lengths, at, order = places
        if len(table) != len(order):
            raise RuntimeError("the input changed between two reads")
        table = [table[i] for i in order.tolist()]
        get, begin, out = table.__getitem__, 0, []
        for n in lengths.tolist():
            out.append(np.frombuffer(b"".join(map(get, at[begin : begin + n].tolist())), dtype))
            begin += n
        for i in range(0, len(out), 512):
            part = out[i : i + 512]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(part).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 512], pa.int64()), ids], names=["id", "ids"])

    def split(text: str | None) -> list[bytes]:
        return encoder(path).split(text)

    questions, places = split_blocks(rows, split, shards, None if steady else "words")
    return met(answered(questions, shards, make), places, shards, use, "id long, ids array<int>")


def pieces(path: str) -> list[str]:
    """The piece of each id: as many as the vocabulary has, whatever the corpus."""
    tokenizer = load(path)
    return [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]


def _joined(ids: np.ndarray, sizes: np.ndarray, begins: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the pieces of ids, one after another, and where each ends. Each piece has a space after it."""
    n = sizes[ids]
    ends = np.cumsum(n)
    at = np.repeat(begins[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
    return letters[at], ends


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text): the text of each array of ids, as the tokenizer's decode(ids, skip_special_tokens=False).

    For tokenizer files without a decoder, whose pieces are joined by spaces.
    The id-to-piece table has the vocabulary's size, so every task holds it and
    joins by looking each id up. A null array counts as empty.
    """
    if load(path).decoder is not None:
        raise ValueError("only tokenizers whose pieces are joined by spaces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [p.encode("utf-8") + b" " for p in pieces(path)]
        sizes = np.array([len(p) for p in table])
        begins, letters = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(table), np.uint8)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lists = part.column(1)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                n = np.array([len(x) if x.is_valid else 0 for x in lists])
                text, ends = _joined(ids, sizes, begins, letters)
                ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
                # The space after a text's last piece goes.
                keep = np.ones(len(text), bool)
                keep[ends[1:][n > 0] - 1] = False
                offsets = ends - np.concatenate([[0], np.cumsum(n > 0)])
                texts = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text[keep]))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, texts.cast(pa.string())], names=["id", "ids", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "id long, ids array<int>, text string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = word_bpe_path()
    found = decode(encode(documents(spark, sf_dir), path, steady=True), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
