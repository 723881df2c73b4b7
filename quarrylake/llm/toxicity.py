"""Toxicity by noisy-channel deobfuscation: texts are restored by Viterbi decoding, then scored."""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, small_batches, stored
from .tokens import slices

#: Cells of the table of n-gram counts, whatever the corpus.
CELLS = 1 << 19
ORDER = 4
#: Bound of the labelled sample that the classifier is fitted on: documents of each label, by hash.
TOXIC_DOCS, CLEAN_DOCS = 3000, 6000
#: Features of a support that chance is expected to give at most, by their number among clean texts.
CHANCE = 0.5
#: Tokens that a Python worker remembers.
KEEP = 400_000
PREFIXES = range(3, 9)

#: What a sign may stand for, and at what cost (natural logarithms).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou"}
#: Cyrillic and Greek letters that look like Latin ones.
ALIKE = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
COST_LEET, COST_MASK, COST_DROP, COST_BREAK, COST_ALIKE = 1.0, 2.5, 0.7, 2.0, 0.5
COST_ONE_OF_MANY, COST_TWO_OF_MANY, COST_ONE_OF_TWO = 0.3, 0.6, 2.5
EDGES = ".,;:!?\"'()[]{}<>/\\~^=_-%&*#`«»“”‘’…¿¡"
_TWICE = re.compile(r"(.)\1")
#: After so many characters of a token what all paths share is written down.
PIECE = 64
#: Words of one or two letters that make up a smaller share of all letters may be pieces of a broken word.
RARE = 1e-5
HIDDEN = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))
_HIDDEN = tuple(map(chr, HIDDEN))


#: Multiplier of the hash of n-grams; all of it is arithmetic on 64 bits.
_STEP = 0x9E3779B1
#: Stands for a word's beginning and its end.
EDGE = "\0"


def _cell(gram: str) -> int:
    h = 0
    for c in gram:
        h = (h * _STEP + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return (h ^ h >> 29) % CELLS


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _count(text: str, letter: np.ndarray, counts: np.ndarray) -> None:
    """Adds the n-grams of a text's runs of letters to the counts; the last count is that of all letters and edges."""
    codes = np.frombuffer(("\0" + text + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letter[codes], codes, 0)
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])].astype(np.uint64)
    counts[CELLS] += len(codes)
    h = np.zeros(len(codes), np.uint64)
    for k in range(ORDER):
        n = len(codes) - k
        if n <= 0:
            return
        h = h[:n] * np.uint64(_STEP) + codes[k:] + np.uint64(1)
        cells = ((h ^ (h >> np.uint64(29))) & np.uint64(CELLS - 1)).astype(np.int64)
        for j in range(1, k):  # an edge may only be the first or the last
            cells[codes[j : n + j] == 0] = -1
        cells = cells[cells >= 0]
        counts[:CELLS] += np.bincount(cells, minlength=CELLS)


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    # Each sign is looked for by itself: few texts have any, and translating goes letter by letter.
    return (text.translate(HIDDEN) if not text.isascii() and any(c in text for c in _HIDDEN) else text).split()


def _plain(token: str) -> bool:
    """Whether a token without edges is letters of one script, none of them twice in a row."""
    if not token.isalpha() or not token.isascii() and any(c in ALIKE for c in token) and any("a" <= c <= "z" for c in token):
        return False
    return not _TWICE.search(token)


class CharacterModel:
    """Interpolated character n-grams of words, from a table of hashed counts."""

    def __init__(self, counts: np.ndarray, letters: int):
        self.counts, self.total = counts, max(letters, 1)
        self.known: dict[tuple[str, str], float] = {}

    def log(self, before: str, c: str) -> float:
        found = self.known.get((before, c))
        if found is None:
            if len(self.known) > 500_000:
                self.known = {}
            found = self.known[before, c] = math.log(self._p(before, c))
        return found

    def _p(self, before: str, c: str) -> float:
        if not before:
            return (int(self.counts[_cell(c)]) + 0.5) / (self.total + 500.0)
        context = int(self.counts[_cell(before)])
        return (int(self.counts[_cell(before + c)]) + 5.0 * self._p(before[1:], c)) / (max(context, int(self.counts[_cell(before + c)])) + 5.0)


def character_counts(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Counts of all n-grams up to ORDER of all words of all rows, in CELLS cells, and the number of letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, letter = np.zeros(CELLS + 1, np.int64), _letters()
        for batch in slices(batches, 0, 2_000_000):
            _count("\0".join(x or "" for x in batch.column(0).to_pylist()).lower(), letter, counts)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["cell", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS + 1, np.int64)
    counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return counts[:CELLS], int(counts[CELLS])


def restore(token: str, model: CharacterModel, breaks: bool = False) -> list[str]:
    """The words that most likely lie behind a token: the best path of a lattice of what its signs may stand for.

    A run of one letter may be one or two of it; a sign may be a letter, nothing,
    or a break between words; with `breaks` a word may also end anywhere, as in
    letters set apart. All paths are followed: of those that end in the same
    ORDER - 1 characters, on which alone what follows depends, the best is kept.
    A token may be of any length, as its whole lattice decides: what all kept
    paths have in common is written down as it grows, so time is in proportion.
    """
    sure: list[str] = []
    best = min((cost - model.log(last[1 - ORDER :], EDGE) if last != EDGE else cost, text) for last, (cost, text) in _paths(token, model, breaks, sure).items())
    return ("".join(sure) + best[1]).split()


def _choices(c: str, n: int) -> list[tuple[float, str]]:
    """(cost, letters): what a run of n characters c may stand for; EDGE is a break between words."""
    options: list[tuple[float, str]] = []
    if c.isalpha():
        options += [(0.0, c * n)] if n <= 2 else [(COST_ONE_OF_MANY, c), (COST_TWO_OF_MANY, c * 2)]
        if n == 2:
            options.append((COST_ONE_OF_TWO, c))
        if c in ALIKE:
            options.append((COST_ALIKE, ALIKE[c] * min(n, 2)))
        return options
    for letter in LEET.get(c, ""):
        cost = COST_MASK if c == "*" else COST_LEET
        options.append((cost, letter))
        if n >= 2:
            options.append((cost + 0.5, letter * 2))
    return [*options, (COST_DROP, ""), (COST_BREAK, EDGE)]


def _paths(token: str, model: CharacterModel, breaks: bool, sure: list[str]) -> dict[str, tuple[float, str]]:
    """By last characters, the cost and text of the best path through the token's lattice, without the beginning that all paths
    share: it goes to `sure` after every PIECE characters."""
    beam: dict[str, tuple[float, str]] = {EDGE: (0.0, "")}  # last characters -> (cost, text so far)
    i, told = 0, 0
    while i < len(token):
        if i - told >= PIECE:
            told, shared = i, os.path.commonprefix([text for _, text in beam.values()])
            sure.append(shared)
            beam = {last: (cost, text[len(shared) :]) for last, (cost, text) in beam.items()}
        c, n = token[i], 1
        while i + n < len(token) and token[i + n] == c:
            n += 1
        i += n
        new: dict[str, tuple[float, str]] = {}
        if n == 1 and not breaks and c.isalpha() and c not in ALIKE:
            # A letter that stands for itself only.
            for last, (cost, text) in beam.items():
                p = model.known.get((last, c))
                one = (cost - (model.log(last, c) if p is None else p), text + c)
                last = (last + c)[1 - ORDER :]
                if last not in new or one < new[last]:
                    new[last] = one
            beam = new
            continue
        options = _choices(c, n)
        for last, (cost, text) in beam.items():
            for more, letters in options:
                _extend(new, model, last, cost + more, text, letters)
                if breaks and letters and letters != EDGE and last != EDGE:
                    ended = cost + 0.5 - model.log(last[1 - ORDER :], EDGE)
                    _extend(new, model, EDGE, ended + more, text + " ", letters)
        beam = new
    return beam


def _extend(new: dict, model: CharacterModel, last: str, cost: float, text: str, letters: str) -> None:
    if letters == EDGE:
        if last != EDGE:
            cost -= model.log(last[1 - ORDER :], EDGE)
            last, text = EDGE, text + " "
    else:
        for c in letters:
            cost -= model.log(last[1 - ORDER :], c)
            last, text = (last + c)[1 - ORDER :], text + c
    if last not in new or (cost, text) < new[last]:
        new[last] = (cost, text)


def features(words: Iterable[str]) -> set[str]:
    """Prefixes of each word, and each word as a whole (with a mark after it)."""
    out = set()
    for w in words:
        out.add(w + "$")
        out.update(w[:k] for k in PREFIXES if k <= len(w))
    return out


class Restorer:
    """The words behind tokens; hidden ones are remembered."""

    def __init__(self, model: CharacterModel):
        self.model, self.known, self.pieces = model, {}, {}

    def words(self, token: str) -> list[str]:
        bare = token.strip(EDGES)
        if _plain(bare):
            return [bare]
        if not any(c.isalpha() for c in token):
            return []
        found = self.known.get(bare)
        if found is None:
            if len(self.known) > KEEP:
                self.known = {}
            found = self.known[bare] = restore(bare, self.model)
        return found

    def piece(self, token: str) -> str:
        """The token without edges if it may be a piece of a broken word: one character, or two that are rarely a word; else ''."""
        found = self.pieces.get(token)
        if found is None:
            if len(self.pieces) > KEEP:
                self.pieces = {}
            bare = token.strip(EDGES) if len(token) > 1 else token
            may = len(bare) == 1 or len(bare) == 2 and bare.isalpha() and self._rare(bare)
            found = self.pieces[token] = bare if may else ""
        return found

    def _rare(self, word: str) -> bool:
        return int(self.model.counts[_cell(EDGE + word + EDGE)]) < RARE * self.model.total

    def spaced(self, tokens: list[str]) -> list[list[str]]:
        """The words behind each run of pieces: of three or more, not all alike, with the short tokens beside them; of fewer, if
        one is rarely a word by itself, with the tokens beside them."""
        piece = self.piece
        short = {t for t in set(tokens) if len(t) < 6 and piece(t)}
        if not short:
            return []
        at = [i for i, t in enumerate(tokens) if t in short]
        runs, k = [], 0
        while k < len(at):
            begin = at[k]
            while k + 1 < len(at) and at[k + 1] == at[k] + 1:
                k += 1
            end = at[k] + 1
            k += 1
            run = [piece(t) for t in tokens[begin:end]]
            many = len(run) >= 3
            if len(set(run)) < 2 if many else not any(p.isalpha() and self._rare(p) for p in run):
                continue
            longest = 3 if many else 24
            sides = [t.strip(EDGES) for t in (tokens[begin - 1] if begin else "", tokens[end] if end < len(tokens) else "")]
            before, after = (t if len(t) <= longest and t.isalpha() else "" for t in sides)
            if many or before or after or len(run) > 1:
                runs.append(before + "".join(run) + after)
        return [restore(r, self.model, breaks=True) for r in runs]

    def text(self, text: str | None) -> str:
        """The restored text: words in their order, spaced runs after them."""
        tokens = words_of(text)
        words = [w for t in tokens for w in self.words(t)]
        return " ".join(words + [w for r in self.spaced(tokens) for w in r])


class ToxicityModel:
    """Features that mark toxic documents, with the probability that each gives; noisy-or over those that a text has."""

    def __init__(self, counts: np.ndarray, letters: int, weights: dict[str, float], leak: float):
        self.counts, self.letters, self.weights, self.leak = counts, letters, weights, leak
        self.known: Restorer | None = None

    def restorer(self) -> Restorer:
        """This worker's restorer; Spark reuses workers, so words restored in one task serve the next."""
        if self.known is None:
            self.known = Restorer(CharacterModel(self.counts, self.letters))
        return self.known


def feature_counts(docs: DataFrame, counts: np.ndarray, letters: int) -> DataFrame:
    """(f, toxic, clean): how many texts of either label, of rows (text, toxic), have each feature in their restored words."""
    table = docs.sparkSession.sparkContext.broadcast(counts)  # CELLS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(CharacterModel(table.value, letters))
        seen = (Counter(), Counter())
        for batch in slices(batches, 0, 1_000_000):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = words_of(text)
                words = {w for t in set(tokens) for w in restorer.words(t)} | {w for r in restorer.spaced(tokens) for w in r}
                seen[toxic].update(features(words))
        names = sorted(seen[0].keys() | seen[1].keys())
        for i in range(0, len(names), 100_000):
            some = names[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([seen[1][f] for f in some], pa.int64()), pa.array([seen[0][f] for f in some], pa.int64())], names=["f", "toxic", "clean"])

    each = docs.select("text", "toxic").mapInArrow(run, "f string, toxic long, clean long")
    return each.groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """The model: character counts of all rows that `learn` admits, and features chosen on a bounded sample of their labels.

    Of the labelled texts, those whose least and greatest word hashes agree (copies
    and most near copies do) count once; of these the TOXIC_DOCS and CLEAN_DOCS first
    by hash are taken. A group with any label 1 counts as toxic. A feature is
    taken if chance would hardly give any feature so many toxic texts and so few
    clean ones, and if no better one begins with it or begins it. Null texts and
    labels are left out.
    """
    rows = docs.where(learn & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counts, letters = character_counts(rows)
    marks = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)")
    words = F.split(F.lower("text"), r"\s+")
    one, two = F.transform(words, lambda w: F.xxhash64(w)), F.transform(words, lambda w: F.hash(w))
    alike = rows.select("id", F.xxhash64(F.array_min(one), F.array_max(one), F.array_min(two), F.array_max(two)).alias("h"))
    known = stored(marks.join(alike, "id").groupBy("h").agg(F.max("toxic").alias("toxic"), F.max_by("id", F.struct("toxic", "id")).alias("id")), "labelled")
    number = {t: n for t, n in known.groupBy("toxic").agg(F.count("*")).collect()}
    toxic_n, clean_n = number.get(1, 0), number.get(0, 0)
    if not toxic_n:
        return ToxicityModel(counts, letters, {}, 0.0)
    sample = known.where("toxic = 1").orderBy("h").limit(TOXIC_DOCS).unionByName(known.where("toxic = 0").orderBy("h").limit(CLEAN_DOCS))
    sample = F.broadcast(sample.select("id", "toxic"))  # TOXIC_DOCS + CLEAN_DOCS rows at most
    texts = stored(rows.join(sample, "id").dropDuplicates(["id"]), "sample")
    table = stored(feature_counts(texts, counts, letters).where("toxic > 0 OR clean > 1"), "features")
    # How many features so many clean texts have: at most CLEAN_DOCS rows.
    usual = dict(table.where("clean > 0").groupBy("clean").agg(F.count("*")).collect())
    toxic_s, clean_s = min(toxic_n, TOXIC_DOCS), min(clean_n, CLEAN_DOCS)
    odds = toxic_s / max(clean_s, 1)
    larger, above = {}, 0
    for n in range(max(usual, default=0), 0, -1):
        above = max(above, usual.get(n, 0))
        larger[n] = above
    enough = next((n for n in range(2, toxic_s + 1) if larger.get(n, 1) * odds**n < CHANCE), toxic_s + 1) if odds < 1 else 20
    scale = (clean_n / max(clean_s, 1)) / (toxic_n / toxic_s)
    good = table.where((F.col("toxic") >= enough) & (F.col("clean") * 10 * scale <= F.col("toxic"))).toArrow().to_pylist()
    good.sort(key=lambda x: (3 * x["clean"] - x["toxic"], x["f"].endswith("$"), -len(x["f"]), x["f"]))
    weights: dict[str, float] = {}
    for x in good:
        if not any(x["f"].startswith(f) or f.startswith(x["f"].rstrip("$")) for f in weights):
            weights[x["f"]] = (x["toxic"] + 0.5) / (x["toxic"] + x["clean"] * scale + 1)
    model = ToxicityModel(counts, letters, weights, 0.0)
    left = score(texts.where("toxic = 1"), model, "id", "text").where("score = 0").count()
    model.leak = min(0.4, (left * toxic_n / toxic_s + 0.5) / (clean_n + 1))
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, predicted, ...): one row for each row of `docs`, with the columns named in `keep` (those that are named like
    a result with `_kept` after the name).

    The score is the probability that the text is toxic: noisy-or of the marks
    that its restored words have, over what texts without marks have. A null or
    empty text has no marks. predicted is 1 at a score of 0.5 or more. Null and
    repeated ids are rows like others; equal texts get equal scores. An empty
    table gives an empty table.
    """
    names = ["id", "score", "predicted", *(f"{c}_kept" if c in ("id", "score", "predicted") else c for c in keep)]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS numbers and a few features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        restorer = known.restorer()
        seen: set[str] = set()
        marked: dict[str, set[str]] = {}
        begins = tuple(sorted({f.rstrip("$")[:3] for f in known.weights}))
        for batch in slices(batches, 1, 2_000_000):
            scores = []
            for text in batch.column(1).to_pylist():
                tokens = words_of(text)
                distinct = set(tokens)
                for t in distinct - seen:
                    words = [w for w in restorer.words(t) if w.startswith(begins)]
                    hits = words and features(words) & known.weights.keys()
                    if hits:
                        marked[t] = hits
                seen |= distinct
                hits = set().union(*(marked[t] for t in distinct & marked.keys()))
                for words in restorer.spaced(tokens):
                    hits |= features(words) & known.weights.keys()
                clean = 1.0 - known.leak
                for f in sorted(hits):
                    clean *= 1.0 - known.weights[f]
                scores.append(1.0 - clean)
                if len(seen) > KEEP:
                    seen, marked = set(), {}
            values = np.array(scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64()), pa.array((values >= 0.5).astype(np.int32)), *batch.columns[2:]], names=names)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *keep)
    schema = "id long, score double, predicted int" + "".join(f", `{c}` {t}" for c, (_, t) in zip(names[3:], rows.dtypes[2:]))
    return rows.mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score(docs, fit(docs, labels, fold("doc_id", 5) != 0))
    return found.select(F.col("id").alias("doc_id"), (fold("id", 5) == 0).alias("held_out"), "score", "predicted")
