"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, fold, small_batches
from .tokens import slices

#: Bound of the sample that the network is fitted on: labelled documents per language, words of each.
DOCS_PER_LANGUAGE, WORDS_PER_DOC = 600, 120
#: Bytes of a word in training: longer ones give a stretch from a random place.
TRAIN_BYTES = 24
#: Bytes after which the states start anew within a word. Longer words (texts without white space) are labelled whole, in
#: pieces, so that memory doesn't grow with a word.
PIECE = 192
#: Labels whose number of rows is over this share of the sample's bound are thinned by hash before they are ranked.
SLACK = 2
HIDDEN, EMBED = 24, 12
UNDETERMINED = "und"
#: Words that a Python worker remembers.
KEEP = 400_000
LETTER = r"\p{L}"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGRU:
    """A bidirectional GRU that labels every byte of a word; its states start anew at each word, and within a word after PIECE
    bytes.

    A word's labels so depend on the word alone, however often it occurs.
    """

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        n, h = len(languages), HIDDEN
        self.languages = languages
        self.p = {"E": rng.normal(0, 0.3, (257, EMBED))}
        for d in "fb":
            self.p |= {f"W{d}": rng.normal(0, EMBED**-0.5, (EMBED, 3 * h)), f"U{d}": rng.normal(0, h**-0.5, (h, 3 * h)), f"c{d}": np.zeros(3 * h)}
        self.p |= {"V": rng.normal(0, (2 * h) ** -0.5, (2 * h, n)), "v": np.zeros(n)}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of one direction, (time, words, hidden); x: byte numbers, (time, words). Masked steps keep the state."""
        h, (u, into) = HIDDEN, (self.p[f"U{d}"], (self.p["E"] @ self.p[f"W{d}"] + self.p[f"c{d}"]))
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((*x.shape, h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = into[x[t]]
            zr = _sigmoid(a[:, : 2 * h] + state @ u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(a[:, 2 * h :] + (r * state) @ u[:, 2 * h :])
            m = mask[t][:, None]
            new = state + m * (1 - z) * (c - state)
            if keep is not None:
                keep.append((t, state, z, r, c))
            state = out[t] = new
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run("f", x, mask), self._run("b", x, mask)], axis=2)
        logits = both @ self.p["V"] + self.p["v"]
        e = np.exp(logits - logits.max(2, keepdims=True))
        return e / e.sum(2, keepdims=True)

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions and its gradients, by backpropagation through time."""
        h = HIDDEN
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(d, x, mask, kept[d]) for d in "fb"], axis=2)
        logits = both @ self.p["V"] + self.p["v"]
        e = np.exp(logits - logits.max(2, keepdims=True))
        p = e / e.sum(2, keepdims=True)
        words, total = np.arange(x.shape[1]), mask.sum()
        loss = float(-(np.log(p[:, words, label] + 1e-9) * mask).sum() / total)
        p[:, words, label] -= 1
        p *= (mask / total)[:, :, None]
        g["V"] = np.einsum("twh,twn->hn", both, p, optimize=True)
        g["v"] = p.sum((0, 1))
        back = p @ self.p["V"].T
        for d, part in (("f", back[:, :, :h]), ("b", back[:, :, h:])):
            w, u = self.p[f"W{d}"], self.p[f"U{d}"]
            ds = np.zeros((x.shape[1], h), np.float32)
            for t, state, z, r, c in reversed(kept[d]):
                ds = ds + part[t]
                m = mask[t][:, None]
                dc = ds * m * (1 - z) * (1 - c * c)
                dz = ds * m * (state - c) * z * (1 - z)
                drs = dc @ u[:, 2 * h :].T
                dr = drs * state * r * (1 - r)
                da = np.concatenate([dz, dr, dc], axis=1)
                g[f"U{d}"][:, : 2 * h] += state.T @ da[:, : 2 * h]
                g[f"U{d}"][:, 2 * h :] += (r * state).T @ dc
                g[f"c{d}"] += da.sum(0)
                ex = self.p["E"][x[t]]
                g[f"W{d}"] += ex.T @ da
                np.add.at(g["E"], x[t], da @ w.T)
                ds = ds * (1 - m * (1 - z)) + drs * r + da[:, : 2 * h] @ u[:, : 2 * h].T
        return loss, g

    def fit(self, words: list[bytes], label: np.ndarray, rounds: int = 2, size: int = 256, rate: float = 0.01, seed: int = 11) -> ByteGRU:
        """Adam over the words in shuffled batches of similar length."""
        rng = np.random.default_rng(seed)
        one = {k: np.zeros_like(v) for k, v in self.p.items()}
        two = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        steps = max(1, rounds * -(-len(words) // size))
        lengths = np.array([min(len(w), TRAIN_BYTES) for w in words])
        for _ in range(rounds):
            order = rng.permutation(len(words))
            order = order[np.argsort(lengths[order] + rng.random(len(order)), kind="stable")]
            cuts = [order[i : i + size] for i in range(0, len(order), size)]
            for k in rng.permutation(len(cuts)):
                x, mask = padded([words[i][:TRAIN_BYTES] for i in cuts[k]])
                _, g = self.gradients(x, mask, label[cuts[k]])
                step += 1
                now = rate * (1 - step / (steps + 1)) + 1e-4
                norm = sum(float((v * v).sum()) for v in g.values()) ** 0.5
                for key, v in g.items():
                    v = v / max(1.0, norm)
                    one[key] = 0.9 * one[key] + 0.1 * v
                    two[key] = 0.999 * two[key] + 0.001 * v * v
                    self.p[key] -= (now * (one[key] / (1 - 0.9**step)) / (np.sqrt(two[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def word_sums(self, words: list[bytes], size: int = 1024) -> np.ndarray:
        """For each word the sums of the probabilities over its positions and, last, the number of positions."""
        out = np.zeros((len(words), len(self.languages) + 1), np.float32)
        order = np.argsort([len(w) for w in words], kind="stable").tolist()
        begin = 0
        while begin < len(order):
            longest = len(words[order[min(begin + size, len(order)) - 1]])
            end = min(len(order), begin + max(1, min(size, 40_000 // max(longest, 1))))
            some = order[begin:end]
            x, mask = padded([words[i] for i in some])
            out[some, :-1] = np.einsum("twn,tw->wn", self.probabilities(x, mask), mask)
            out[some, -1] = mask.sum(0)
            begin = end
        return out


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(time, words) byte numbers with 256 after each end, and the mask of bytes."""
    lengths = np.array([len(w) for w in words])
    longest = max(1, int(lengths.max(initial=1)))
    mask = np.arange(longest)[:, None] < lengths
    x = np.full((longest, len(words)), 256, np.int64)
    x.T[mask.T] = np.frombuffer(b"".join(words), np.uint8)
    return x, mask.astype(np.float32)


def split(text: str) -> list[bytes]:
    """The lower-cased words of a text in UTF-8, those longer than PIECE bytes in pieces."""
    words = text.lower().encode("utf-8").split()
    if all(len(w) <= PIECE for w in words):
        return words
    return [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]


def training_words(docs: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(label, words): at most DOCS_PER_LANGUAGE documents of each label, at most WORDS_PER_DOC words of each, both by hash.

    A label's rows are counted first; of many rows only the share that holds
    about SLACK times the bound, by hash, is ranked.
    """
    rows = docs.where(learn & F.col(label_col).isNotNull())
    rows = rows.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    counts = rows.groupBy("label").agg(F.count("*").alias("of_label"))
    share = F.least(F.lit(1.0), F.lit(float(SLACK * DOCS_PER_LANGUAGE)) / F.col("of_label"))
    # A row for each label; a label is a column's distinct value, not text.
    thin = rows.join(F.broadcast(counts), "label").withColumn("h", F.xxhash64("id", "text")).where(F.pmod("h", F.lit(1 << 40)) < share * (1 << 40))
    thin = thin.where(F.col("text").rlike(LETTER)).select("label", "text", "h")
    first = thin.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("k") <= DOCS_PER_LANGUAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, words = [], []
            for label, text, h in zip(*(batch.column(i).to_pylist() for i in range(3))):
                some = text.lower().encode("utf-8").split()
                rng = np.random.default_rng(h & 0xFFFFFFFF)
                take = rng.choice(len(some), min(len(some), WORDS_PER_DOC), replace=False)
                begins = [int(rng.integers(0, max(1, len(some[i]) - TRAIN_BYTES + 1))) for i in take.tolist()]
                labels.append(label)
                words.append([some[i][k : k + TRAIN_BYTES] for i, k in zip(take.tolist(), begins)])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(words, pa.list_(pa.binary()))], names=["label", "words"])

    return first.select("label", "text", "h").mapInArrow(run, "label string, words array<binary>")


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> ByteGRU | None:
    """The network, fitted on a bounded sample of the labelled rows that `learn` admits; None if there are none."""
    sample = training_words(docs, learn, id_col, text_col, label_col).toArrow().to_pylist()
    languages = sorted({x["label"] for x in sample})
    if not languages:
        return None
    number = {x: i for i, x in enumerate(languages)}
    sample.sort(key=lambda x: (x["label"], x["words"]))
    words = [w for x in sample for w in x["words"]]
    label = np.array([number[x["label"]] for x in sample for _ in x["words"]])
    return ByteGRU(languages).fit(words, label)


class WordMemory:
    """What the network says of words, remembered for at most KEEP words."""

    def __init__(self, net: ByteGRU):
        self.net, self.place = net, {}
        self.sums = np.zeros((0, len(net.languages) + 1), np.float32)
        self.filled = 0

    def pooled(self, texts: list[list[bytes]]) -> np.ndarray:
        """For each text the sums over all positions of all words, and the number of positions."""
        distinct = set().union(*texts)
        if len(self.place) > KEEP:
            self.place, self.filled = {}, 0
        missing = sorted(w for w in distinct if w not in self.place)
        need = self.filled + len(missing)
        if need > len(self.sums):
            grown = np.zeros((max(need, 2 * len(self.sums)), self.sums.shape[1]), np.float32)
            grown[: self.filled] = self.sums[: self.filled]
            self.sums = grown
        self.sums[self.filled : need] = self.net.word_sums(missing)
        self.place.update(zip(missing, range(self.filled, need)))
        self.filled = need
        get, out = self.place.__getitem__, np.zeros((len(texts), self.sums.shape[1]))
        for i, words in enumerate(texts):
            out[i] = self.sums[np.fromiter(map(get, words), np.int64, len(words))].sum(0, dtype=np.float64)
        return out


def predict(docs: DataFrame, net: ByteGRU | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score, ...): one row for each row of `docs`, with the columns named in `keep` (those that are named like
    a result with `_kept` after the name).

    Every byte of the lower-cased words of the whole text is labelled; the
    document's probabilities are the means over all positions; the prediction is
    the most probable language (ties: the first by name) and its mean the score.
    A text that is null, or has no letter (Unicode class L), or a missing network:
    `und`, score 0. Null and repeated ids are rows like others; equal texts get
    equal results. An empty table gives an empty table.
    """
    names = ["id", "lang_pred", "score", *(f"{c}_kept" if c in ("id", "lang_pred", "score") else c for c in keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = None if net is None else WordMemory(net)
        for batch in slices(batches, 1, 2_000_000):
            texts = batch.column(1).to_pylist()
            language, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            at = np.flatnonzero(np.array(batch.column(2).to_pylist(), bool))
            if memory is not None and len(at):
                sums = memory.pooled([split(texts[i]) for i in at])
                means = sums[:, :-1] / sums[:, -1:]
                for i, k, m in zip(at.tolist(), means.argmax(1).tolist(), means):
                    language[i], score[i] = net.languages[k], min(1.0, float(m[k]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(language, pa.string()), pa.array(score), *batch.columns[3:]], names=names)

    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(text.rlike(LETTER), F.lit(False)).alias("has"), *keep)
    schema = "id long, lang_pred string, score double" + "".join(f", `{c}` {t}" for c, (_, t) in zip(names[3:], rows.dtypes[3:]))
    return rows.mapInArrow(run, schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predict(docs, fit(docs, fold("doc_id", 4) != 2))
    return found.select(F.col("id").alias("doc_id"), (fold("id", 4) == 2).alias("held_out"), "lang_pred", "score")
