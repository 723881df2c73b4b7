"""Encoding with the tokenizers library, word by word with a bounded memory of words."""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Words that a Python worker remembers (see WordEncoder).
KEEP = 250_000
#: Words that are encoded as one string.
TOGETHER = 64
#: Bytes of text that are split at a time.
GROUP = 2_000_000


def word_bpe_path() -> str:
    """Where the public word-level BPE file lies; the default of the queries' tokenizer parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: Signs that end words; none of them is a letter, a digit or an apostrophe.
TAILS = b".,!?%&*$#@;:|-+()=\"/\\[]{}<>^_~`"
#: Letters below this take the short way; which signs are letters was settled long ago there.
SETTLED = "\u0530"


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _LetterModel:
    """The file's own BPE model on words of letters alone, without the regular expressions that would find them.

    Only for files whose rules make such a word one piece of text: lower case,
    byte-level letters, a mark at each word's end.
    """

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer, pre_tokenizers

        rules = json.loads(tokenizer.to_str())
        steps = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
        cuts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        pattern = cuts[0].get("pattern", {}).get("Regex", "") if cuts else ""
        model = rules["model"]
        self.fits = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.fits = self.fits and not cuts[1]["add_prefix_space"] and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["continuing_subword_prefix"]
        if self.fits:
            self.tokenizer = Tokenizer(tokenizer.model)
            self.tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocabulary = tokenizer.get_vocab()
            self.ends = np.zeros(tokenizer.get_vocab_size(), bool)
            self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
            self.letters = {b: c for b, c in _byte_letters().items() if b != 32}

    def encode(self, words: list[bytes], dtype: np.dtype) -> list[bytes]:
        """The ids of words of lower-case letters."""
        runs = [b" ".join(words[i : i + 1000]).decode("latin-1").translate(self.letters) for i in range(0, len(words), 1000)]
        out: list[bytes] = []
        for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False):
            ids = np.array(e.ids, dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            data, size = ids.tobytes(), ids.itemsize
            begin = 0
            for end in (cuts * size).tolist():
                out.append(data[begin:end])
                begin = end
        assert len(out) == len(words)
        return out


#: What each byte is: 0 white space, 1 letter (of a-z, A-Z and U+00C0 to U+017F), 2 digit, 3 sign, 9 anything else.
_CLASS = np.full(256, 9, np.uint8)
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), 0xC3, 0xC4, 0xC5, *range(0x80, 0xC0)]] = 1
_CLASS[48:58] = 2
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = 3
#: What looks like a letter above but isn't one, or changes its length in lower case.
_ODD = [b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0", b"\xc5\x89"]
_FINE = np.flatnonzero(_CLASS != 9).astype(np.uint8).tobytes()
#: The first k bytes of a number of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bits of the number of slots in which pieces are looked up first.
SLOT_BITS = 20


class _Pieces:
    """Ids of texts of ASCII and Latin letters, piece by piece: runs of letters, digits, runs of signs.

    Pieces of at most 16 bytes are found by their bytes, all of a group of texts
    at once: in the slot of their hash, or, if another one lies there, in a sorted
    table of hashes; longer ones, and those whose hash another one has, in a dict.
    At most `keep` pieces are remembered.
    """

    def __init__(self, letters: _LetterModel, through: Callable[[list[bytes]], list[bytes]], dtype: np.dtype, keep: int = 1_500_000):
        self.letters, self.through, self.dtype, self.keep = letters, through, dtype, keep
        self.forget()

    def forget(self) -> None:
        self.key, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        # Entry 0 is no piece's: none has a byte zero.
        self.low, self.high = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
        self.place, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.slot = np.zeros(1 << SLOT_BITS, np.int64)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.ids, self.filled = np.zeros(1 << 16, self.dtype), 0

    @staticmethod
    def fits(data: bytes) -> bool:
        return not data.translate(None, _FINE) and b"<|" not in data and (data.isascii() or not any(x in data for x in _ODD))

    def _add(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Place and size of the ids of new pieces."""
        words = [i for i, p in enumerate(pieces) if p[0] > 57 and _CLASS[p[0]] == 1]
        others = sorted(set(range(len(pieces))) - set(words))
        lower = [p if p.isascii() else p.decode("utf-8").lower().encode("utf-8") for p in (pieces[i] for i in words)]
        found: list[bytes] = [b""] * len(pieces)
        for some, ids in ((words, self.letters.encode(lower, self.dtype)), (others, self.through([pieces[i] for i in others]))):
            for i, x in zip(some, ids):
                found[i] = x
        new = np.frombuffer(b"".join(found), self.dtype)
        size = np.array([len(x) for x in found], np.int64) // self.dtype.itemsize
        place = self.filled + np.cumsum(size) - size
        if self.filled + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.filled], np.zeros(self.filled + 2 * len(new), self.dtype)])
        self.ids[self.filled : self.filled + len(new)] = new
        self.filled += len(new)
        return place, size

    @staticmethod
    def _key(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A hash of each piece's bytes; without the shift between, words that are alike in both halves often share one."""
        key = low * np.uint64(0x9E3779B97F4A7C15)
        key = ((key ^ key >> np.uint64(32)) + high) * np.uint64(0xC2B2AE3D27D4EB4F)
        return key ^ key >> np.uint64(29)

    def _sorted(self, key: np.ndarray, low: np.ndarray, high: np.ndarray, pieces: Callable[[np.ndarray], list[bytes]]) -> np.ndarray:
        """The entries of pieces that didn't lie in their slots, and from now on do; new ones are added, and 0 stands for
        those whose hash another piece has."""
        unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        where = np.searchsorted(self.key, unique)
        hit = np.zeros(len(unique), bool)
        inside = where < len(self.key)
        hit[inside] = self.key[where[inside]] == unique[inside]
        entry = np.zeros(len(unique), np.int64)
        entry[hit] = self.entry[where[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            spots = first[new]
            place, size = self._add(pieces(spots))
            entry[new] = np.arange(len(self.place), len(self.place) + len(new))
            self.key, self.entry = np.insert(self.key, where[new], unique[new]), np.insert(self.entry, where[new], entry[new])
            self.low, self.high = np.concatenate([self.low, low[spots]]), np.concatenate([self.high, high[spots]])
            self.place, self.size = np.concatenate([self.place, place]), np.concatenate([self.size, size])
        self.slot[(unique >> np.uint64(64 - SLOT_BITS)).view(np.int64)] = entry
        entry = entry[inverse]
        return np.where((self.low.take(entry) == low) & (self.high.take(entry) == high), entry, 0)

    def encode(self, group: list[bytes]) -> list[np.ndarray]:
        if len(self.key) + len(self.long) > self.keep:
            self.forget()
        text = b"\n".join(group) + b"\n"
        c = np.frombuffer(text.translate(_CLASS.tobytes()), np.uint8)
        # The text begins and ends a line: no piece crosses its borders.
        change = np.concatenate([[True], (c[1:] != c[:-1]) | (c[1:] == 2)])
        begin = np.flatnonzero(change & (c != 0))
        end = np.flatnonzero(np.concatenate([change[1:], [True]]) & (c != 0)) + 1
        length = end - begin
        place, size = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        short = np.flatnonzero(length <= 16)
        at, n = begin[short], length[short]
        eight = np.ndarray(len(text) + 8, "<u8", text + bytes(16), strides=(1,))  # the eight bytes from each on
        low, high = eight[at] & _FIRST.take(np.minimum(n, 8)), eight[at + 8] & _FIRST.take(np.maximum(n, 8) - 8)
        key = self._key(low, high)
        entry = self.slot.take((key >> np.uint64(64 - SLOT_BITS)).view(np.int64))
        other = np.flatnonzero((self.low.take(entry) != low) | (self.high.take(entry) != high))
        if len(other):
            spots = short[other]
            entry[other] = self._sorted(key[other], low[other], high[other], lambda some: [text[i:j] for i, j in zip(begin[spots[some]].tolist(), end[spots[some]].tolist())])
        place[short], size[short] = self.place.take(entry), self.size.take(entry)
        rest = np.concatenate([np.flatnonzero(length > 16), short[entry == 0]])
        if len(rest):
            pieces = [text[i:j] for i, j in zip(begin[rest].tolist(), end[rest].tolist())]
            missing = list({p for p in pieces if p not in self.long})
            self.long.update(zip(missing, zip(*(x.tolist() for x in self._add(missing)))))
            found = np.array([self.long[p] for p in pieces], np.int64)
            place[rest], size[rest] = found[:, 0], found[:, 1]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(place - total[:-1], size) + np.arange(total[-1])]
        starts = np.cumsum([0] + [len(x) + 1 for x in group])
        bounds = total[np.searchsorted(begin, starts)].tolist()
        return [ids[i:j] for i, j in zip(bounds[:-1], bounds[1:])]


class WordEncoder:
    """Ids of texts under a tokenizer that never joins what ASCII white space parts.

    That holds for tokenizers that split at white space and drop it. Each word
    (what lies between ASCII white space) is then encoded once while it is
    remembered. Words that are letters and perhaps signs after them are put
    together from the ids of both; all others go through the library as they are.
    Of the parts of letters two generations of at most `keep` are remembered:
    when the younger is full it replaces the older, and a part found there moves
    up. Whole words are forgotten when there are `keep`.
    """

    def __init__(self, path: str, keep: int = KEEP):
        self.tokenizer = load(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.keep = keep
        self.known: dict[bytes, bytes] = {}
        self.letters = _LetterModel(self.tokenizer)
        self.pieces = _Pieces(self.letters, self._through, self.dtype)
        self.cores: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {b"": b""}

    def _alone(self, word: str) -> bool:
        """Whether offsets could mislead: such words are encoded by themselves."""
        return not word.isascii() and (not unicodedata.is_normalized("NFC", word) or len(word.lower()) != len(word) or any(map(str.isspace, word)))

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes."""
        if not self.letters.fits:
            return self._through(words)
        if len(self.cores) > self.keep:
            self.cores, self.old = {}, self.cores
        cores, old, tails = self.cores, self.old, self.tails
        out: list[bytes | None] = list(map(cores.get, words))
        parts: list[tuple[int, bytes, bytes]] = []
        others: list[int] = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            w = words[i]
            core = w.rstrip(TAILS)
            tail = w[len(core) :]
            if core.isalpha():  # of bytes: ASCII letters only
                core = core.lower()
            elif core.isascii():
                if core:
                    others.append(i)
                    continue
            else:
                text = core.decode("utf-8")
                low = text.lower()
                if not text.isalpha() or not low.isalpha() or max(text) >= SETTLED or max(low) >= SETTLED or not unicodedata.is_normalized("NFC", text) or not unicodedata.is_normalized("NFC", low):
                    others.append(i)
                    continue
                core = low.encode("utf-8")
            if tail not in tails:
                if len(tail) > 8 or b"<|" in tail:
                    others.append(i)
                    continue
                tails[tail] = self._through([tail])[0]
            parts.append((i, core, tail))
        missing = {core for _, core, _ in parts if core not in cores}
        missing.discard(b"")
        found = missing & old.keys()
        cores.update((core, old[core]) for core in found)
        new = list(missing - found)
        cores.update(zip(new, self.letters.encode(new, self.dtype)))
        for i, core, tail in parts:
            out[i] = cores[core] + tails[tail] if core else tails[tail]
        for i, ids in zip(others, self._through([words[i] for i in others])):
            out[i] = ids
        return out

    def _through(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word by the library's encoding of texts."""
        out: list[bytes] = [b""] * len(words)
        texts = [w.decode("utf-8") for w in words]
        order, alone = [], []
        for i, w in enumerate(texts):
            (alone if "<|" in w or self._alone(w) else order).append(i)
        for i, e in zip(alone, self.tokenizer.encode_batch([texts[i] for i in alone], add_special_tokens=False)):
            out[i] = np.array(e.ids, self.dtype).tobytes()
        runs = [order[i : i + TOGETHER] for i in range(0, len(order), TOGETHER)]
        for run, e in zip(runs, self.tokenizer.encode_batch([" ".join([texts[i] for i in run]) for run in runs], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            at = np.array([x[0] for x in e.offsets], np.int64)
            begins = np.cumsum([len(texts[i]) + 1 for i in run])[:-1]
            cuts = np.searchsorted(at, begins).tolist()
            for i, a, b in zip(run, [0, *cuts], [*cuts, len(ids)]):
                out[i] = ids[a:b].tobytes()
        return out

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; None counts as empty."""
        group, size = [], 0
        for text in texts:
            group.append((text or "").encode("utf-8"))
            size += len(group[-1])
            if size >= GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[bytes]) -> list[np.ndarray]:
        plain = [self.letters.fits and self.pieces.fits(data) for data in group]
        fast = iter(self.pieces.encode([data.lower() for data, ok in zip(group, plain) if ok])) if any(plain) else iter(())
        slow = iter(self._by_words([self._split(data) for data, ok in zip(group, plain) if not ok]))
        return [next(fast) if ok else next(slow) for ok in plain]

    def split(self, text: str | None) -> list[bytes]:
        """The words of a text; where letters' case doesn't matter, A-Z as a-z, for there are fewer words then."""
        return self._split((text or "").encode("utf-8"))

    def _split(self, data: bytes) -> list[bytes]:
        return (data.lower() if self.letters.fits and b"<|" not in data else data).split()

    def _by_words(self, group: list[list[bytes]]) -> Iterator[np.ndarray]:
        if len(self.known) > self.keep:
            self.known = {}
        known = self.known
        found = [list(map(known.get, words)) for words in group]
        gaps = [[i for i, ids in enumerate(parts) if ids is None] if None in parts else [] for parts in found]
        new = list({words[i] for words, places in zip(group, gaps) for i in places})
        known.update(zip(new, self.words(new)))
        for words, parts, places in zip(group, found, gaps):
            for i in places:
                parts[i] = known[words[i]]
            yield np.frombuffer(b"".join(parts), self.dtype)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder; Spark reuses workers, so words learnt in one task serve the next."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose given string column has about `limit` bytes at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([len(x) if x is not None else 0 for x in (v.as_buffer() if v.is_valid else None for v in batch.column(column))])
        begin, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        yield batch.slice(begin)


def encoded(docs: DataFrame, path: str, end: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, ids, df): the ids of each text, then `end` if given, as little-endian unsigned integers, of 16 bits if the
    vocabulary allows, else of 32.

    One row for each row of `docs`, with df null; a null text counts as empty.
    Each task adds a row without n and ids whose df has, as pairs of 64-bit
    integers, the ids that its texts have and how many of its texts have each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        last = np.array([] if end is None else [end], coder.dtype)
        df = np.zeros(coder.tokenizer.get_vocab_size(), np.int64)
        seen = np.zeros(len(df), bool)
        for batch in slices(batches, 1):
            ids = [np.concatenate([x, last]) for x in coder.encode(batch.column(1).to_pylist())]
            for x in ids:
                seen[x] = True
                some = np.flatnonzero(seen) if len(x) > 5000 else np.unique(x)
                df[some] += 1
                seen[x] = False
            n = len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.nulls(n, pa.binary())], names=["id", "n", "ids", "df"])
        some = np.flatnonzero(df)
        pairs = np.stack([some, df[some]], axis=1).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([pairs], pa.binary())], names=["id", "n", "ids", "df"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n long, ids binary, df binary")
