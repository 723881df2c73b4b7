"""SimHash near-duplicate groups by multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, documents, narrowed, small_batches, stored

#: Bits of a fingerprint, and bins of a sketch (a byte each).
BITS, BINS = 64, 32
#: Rows of a shard's table. Smaller tables still have 2**LEAST_SPLIT shards a segment.
SHARD_ROWS, LEAST_SPLIT = 500_000, 2
#: Look-ups and matches that a task works on at once.
AT_ONCE = 1 << 20
#: Sketches whose estimate is lower are not looked at again: five standard deviations below a similarity of 0.8.
LEAST_SKETCH = 0.45
#: Members, and bytes of their shingles, that one block of a cell holds.
BLOCK_ROWS, BLOCK_BYTES = 256, 32_000_000


def shingles(text: str | None, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles of a text in their order, repeats included.

    Words are what lies between ASCII white space after A-Z became a-z. Fewer
    words than a shingle: the whole sequence is the only one. No word: none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size + 1) - size - 1
    width = min(shingle, len(words))
    begins, ends = begin[: len(words) - width + 1].tolist(), (begin + size)[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[i:j], seed) for i, j in zip(begins, ends)), np.uint64, len(begins))


def simhash(h: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is 1 if over half of them have it."""
    columns = h.view(np.uint8).reshape(-1, 8)  # little-endian bytes: column k holds bits 8k to 8k+7
    ones = np.zeros(BITS, np.int64)
    for k in range(8):
        ones[8 * k : 8 * k + 8] = np.bincount(columns[:, k], minlength=256) @ _BITS
    return int(((ones * 2 > len(h)).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text; zero without a word."""
    return simhash(shingles(text, shingle, seed))


_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - (BINS - 1).bit_length())


def sketch(distinct: np.ndarray) -> bytes:
    """A byte for each bin of the sorted distinct hashes: zero if it is empty, else taken from its least hash."""
    at = np.append(np.searchsorted(distinct, _EDGES), len(distinct))
    filled = at[1:] > at[:-1]
    out = np.zeros(BINS, np.uint8)
    out[filled] = 1 + distinct[at[:-1][filled]] % np.uint64(255)
    return out.tobytes()


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The share of bins, of those that either sketch has, in which both agree; rows are sketches."""
    return ((x == y) & (x > 0)).sum(1) / np.maximum(((x | y) > 0).sum(1), 1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp, ...): one row for each row of `docs`, with the columns named in `keep`; fp is the fingerprint as a signed
    long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], names=["id", "fp", *keep])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *keep)
    return rows.mapInArrow(run, "id long, fp long" + "".join(f", `{c}` {t}" for c, t in rows.dtypes[2:]))


def probe_radii(segments: int, distance: int) -> list[int]:
    """How far each segment is probed so that no pair within `distance` is missed.

    If every segment differed by more than its radius, the total would be at
    least sum(radius + 1); radii that sum to distance - segments + 1 suffice.
    """
    spare = distance - segments + 1
    return [spare // segments + (k < spare % segments) for k in range(segments)]


def ball(width: int, radius: int) -> np.ndarray:
    """All masks of `width` bits with at most `radius` of them set, nearest first."""
    masks = last = np.zeros(1, np.uint64)
    for _ in range(min(radius, width)):
        last = np.unique(last[:, None] | (np.uint64(1) << np.arange(width, dtype=np.uint64)))
        last = np.setdiff1d(last, masks)
        masks = np.concatenate([masks, last])
    return masks


def segments_for(n: int, distance: int) -> list[tuple[int, int, int]]:
    """(first bit, width, radius) of the segments that cost least for a table of n fingerprints.

    Few segments are wide: a look-up meets few rows, but the balls are large.
    The cost is that of all look-ups, and of the rows that they meet if
    fingerprints are spread evenly. Any choice finds all pairs.
    """
    best: tuple[float, list] = (math.inf, [])
    for m in range(2, min(8, distance + 1) + 1):
        widths = [BITS // m + (k < BITS % m) for k in range(m)]
        radii = probe_radii(m, distance)
        cost = sum(sum(math.comb(w, i) for i in range(r + 1)) * (1 + n / 2**w) for w, r in zip(widths, radii))
        # A segment's table of places has a number for each of its values.
        if cost < best[0] and max(widths) <= 32:
            firsts = np.cumsum([0, *widths]).tolist()
            best = (cost, list(zip(firsts, widths, radii)))
    return best[1] or [(0, 32, distance // 2), (32, 32, (distance - 1) // 2)]


class _Table:
    """Fingerprints of one shard of one segment, found by the segment's value; links are told by a forest over them."""

    def __init__(self, keys: np.ndarray, fps: np.ndarray, sketches: np.ndarray, segment: tuple[int, int, int], split: int, distance: int, least: float):
        self.segment, self.split, self.distance, self.least = segment, split, distance, least
        self.low = segment[1] - split
        values = self.low_bits(fps)
        order = np.argsort(values, kind="stable")
        self.keys, self.fps, self.sketches = keys[order], fps[order], sketches[order]
        self.values = values[order]
        self.dense = self.low <= 22
        if self.dense:
            self.first = np.searchsorted(self.values, np.arange((1 << self.low) + 1, dtype=np.uint64))
        self.root = np.arange(len(keys))
        masks = ball(segment[1], segment[2])
        tops = masks >> np.uint64(self.low)
        self.masks = {int(t): masks[tops == t] & np.uint64((1 << self.low) - 1) for t in np.unique(tops)}

    def low_bits(self, fps: np.ndarray) -> np.ndarray:
        return fps >> np.uint64(self.segment[0]) & np.uint64((1 << self.low) - 1)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = int(self.root[i])
        return i

    def probe(self, keys: np.ndarray, fps: np.ndarray, sketches: np.ndarray, top: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, keys) of links of the given fingerprints with the table's, as many as it takes to connect what is linked.

        `top` is how their segment's upper bits differ from the shard's; `own`: they are the table, in its order.
        """
        masks = self.masks.get(top, np.zeros(0, np.uint64))
        low = self.low_bits(fps)
        # The row of the table that each given row was linked with first.
        self.joined = np.full(len(fps), -1, np.int64)
        matches = 1 + len(self.keys) / (1 << self.low)
        step = 1 if own else 64
        begin = 0
        while begin < len(fps) and len(masks):
            # Small steps first: one row of a dense group joins all of it, and later rows then give one link each.
            end = min(len(fps), begin + step)
            per = max(1, int(AT_ONCE / matches / (end - begin)))
            for m in range(0, len(masks), per):
                at = low[begin:end, None] ^ masks[m : m + per]
                start, stop = (self.first[at], self.first[at + np.uint64(1)]) if self.dense else (np.searchsorted(self.values, at), np.searchsorted(self.values, at, side="right"))
                row = np.broadcast_to(np.arange(begin, end)[:, None], at.shape)
                hit = stop > start
                yield from self._meet(keys, fps, sketches, row[hit], start[hit], stop[hit], own)
            begin = end
            step = min(2 * step, 4096)

    def _meet(self, keys: np.ndarray, fps: np.ndarray, sketches: np.ndarray, row: np.ndarray, start: np.ndarray, stop: np.ndarray, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        total = np.cumsum(stop - start)
        begin = 0
        while begin < len(row):
            # At most AT_ONCE matches, or those of one look-up.
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + AT_ONCE, side="right")))
            n = stop[begin:end] - start[begin:end]
            i = np.repeat(row[begin:end], n)
            j = np.repeat(start[begin:end] - np.cumsum(n) + n, n) + np.arange(n.sum())
            begin = end
            near = np.bitwise_count(fps[i] ^ self.fps[j]) <= self.distance
            if own:
                near &= i < j
            i, j = i[near], j[near]
            if self.least and len(i):
                alike = estimate(sketches[i], self.sketches[j]) >= self.least
                i, j = i[alike], j[alike]
            if len(i):
                found = self._join(i, j, own)
                yield keys[found[0]], self.keys[found[1]]

    def _join(self, i: np.ndarray, j: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of links of rows i with rows j of the table, those that connect what wasn't connected; the forest learns them."""
        while not np.array_equal(self.root, up := self.root[self.root]):
            self.root = up
        tree = self.root[j]
        if own:
            new = self.root[i] != tree
            i, j, tree = i[new], j[new], tree[new]
        _, first = np.unique(i * len(self.keys) + tree, return_index=True)
        i, j = i[first], j[first]
        kept = np.zeros(len(i), bool)
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
            if not own and self.joined[a] < 0:
                self.joined[a], kept[k] = b, True
                continue
            at, other = self.find(a if own else int(self.joined[a])), self.find(b)
            if at != other:
                self.root[max(at, other)], kept[k] = min(at, other), True
        return i[kept], j[kept]


def links(nodes: DataFrame, distance: int = 4, least: float = 0.0, segments: list[tuple[int, int, int]] | None = None, split: int | None = None) -> DataFrame:
    """(a, b): pairs of keys of `nodes` (key, fp, sketch) that are linked, as many as it takes to connect all that are.

    Two nodes are linked if their fingerprints differ in at most `distance` bits
    and, with `least`, their sketches agree in that share of bins. Keys are
    unique longs. Sketches may be null without `least`.

    Multi-index hashing: fingerprints are cut into segments; each fingerprint
    looks up a Hamming ball around each of its segments in a table of them, and
    what it meets is compared whole. A segment's table is sharded by the
    segment's upper `split` bits; a fingerprint goes to the shards that its ball
    meets, upwards only, for the lower one of a pair finds the other. No link is
    lost, but a shard gives one for each node and group that it has connected
    already: n nodes that are all alike give about n pairs.
    """
    if segments is None or split is None:
        n = nodes.count()
        segments = segments or segments_for(n, distance)
        split = max(LEAST_SPLIT, math.ceil(math.log2(max(n, 1) / SHARD_ROWS))) if split is None else split
    parts = [ball(min(split, width), radius) for _, width, radius in segments]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array(batch.column(1)).view(np.uint64)
            for k, ((first, width, _), masks) in enumerate(zip(segments, parts)):
                own = (fps >> np.uint64(first) & np.uint64((1 << width) - 1)) >> np.uint64(width - split)
                for mask in masks:
                    some = np.flatnonzero((own ^ mask) >= own)
                    shard = ((own[some] ^ mask) + np.uint64(k << split)).astype(np.int64)
                    taken = batch.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.full(len(some), int(mask), np.int64)), *taken.columns], names=["shard", "top", "key", "fp", "sketch"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, table, held = -1, None, []

        def made() -> _Table:
            keys, fps, sketches = (np.concatenate(x) for x in zip(*held))
            return _Table(keys, fps, sketches, segments[shard >> split], split, distance, least)

        def pairs(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for a, b in found:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal table
            if held:
                table = made()
                held.clear()
                yield from pairs(table.probe(table.keys, table.fps, table.sketches, 0, True))

        for batch in batches:
            shards, tops = np.array(batch.column(0)), np.array(batch.column(1))
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(tops) != 0)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if begin == end:
                    continue
                if shards[begin] != shard:
                    yield from closed()
                    shard, table = int(shards[begin]), None
                part = batch.slice(begin, end - begin)
                rows = (np.array(part.column(2)), np.array(part.column(3)).view(np.uint64), _sketches(part.column(4)))
                if tops[begin] == 0:
                    held.append(rows)
                else:
                    yield from closed()
                    if table is not None:
                        yield from pairs(table.probe(*rows, int(tops[begin]), False))
        yield from closed()

    shards = len(segments) << split
    dealt = nodes.select("key", "fp", "sketch").mapInArrow(route, "shard long, top long, key long, fp long, sketch binary")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "top")
    return dealt.mapInArrow(search, "a long, b long")


def _sketches(column: pa.Array) -> np.ndarray:
    if column.null_count == len(column):
        return np.zeros((len(column), 0), np.uint8)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """(id, fp, component): one row for each row of `docs`.

    Rows whose fingerprints differ in at most `distance` bits are linked;
    component is the smallest id reachable. Null and word-free texts have the
    fingerprint zero and are linked like any other. Rows with a null id keep
    their fingerprint and link others, but never name a component, unless no
    row of it has an id (then it is null). Repeated ids give a row each. An
    empty table gives an empty table. Other columns of `docs` are not read.

    Pairs are sought between distinct fingerprints only, so copies, however
    many, cost one aggregation.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("id").alias("node")), "nodes")
    pairs = links(nodes.select(F.col("fp").alias("key"), "fp", F.lit(None).cast("binary").alias("sketch")), distance)
    reach = components(pairs)
    named = nodes.join(reach.withColumnRenamed("node", "fp"), "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    least = named.groupBy("c").agg(F.min("node").alias("least"))
    by_fp = named.join(least, "c").select("fp", F.col("least").alias("component"))
    return fps.join(by_fp, "fp").select("id", "fp", "component")


#: Stands for a null id where rows are told apart; as an id of its own it only costs work.
NO_ID = -(1 << 63)


def _keyed(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, text_hash, text, ...): what tells rows apart without Python."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("row_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"), *keep)


def verified_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 14, similarity: float = 0.8) -> DataFrame:
    """(row_id, text_hash, leader_id, leader_hash): one row for each distinct pair of an id and a text of `docs`.

    Texts are linked if their sets of word shingles have a Jaccard similarity of
    at least `similarity` and their fingerprints differ in at most `distance`
    bits; equal sets are one class (those of all word-free and null texts too).
    text_hash is XXH64 of the text (Spark's xxhash64; null counts as empty), the
    leader the row of the component with the smallest id (null ids last, written
    as -2**63; ties by text_hash). Repeated rows are one. An empty table gives
    an empty table. Other columns of `docs` are not read.

    With shingles of five words 14 bits hold some 95 % of pairs with a
    similarity of 0.8 to 0.85 and nearly all above. Candidates come from
    links(), with sketches, as groups; within these, blocks of members meet
    blocks, and each pair that isn't connected yet is compared by its shingles.
    """

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(2):
                h = shingles(x.as_py(), shingle)
                u = np.unique(h)
                rows.append((xxhash.xxh64_intdigest(u.tobytes()), simhash(h), sketch(u), len(u)))
            key, fp, sk, n = zip(*rows) if rows else ((), (), (), ())
            columns = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (key, fp)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(sk, pa.binary()), pa.array(n, pa.int64())], names=["row_id", "text_hash", "key", "fp", "sketch", "n"])

    small_batches(docs.sparkSession)
    rows = stored(_keyed(docs, id_col, text_col).mapInArrow(profile, "row_id long, text_hash long, key long, fp long, sketch binary, n long"), "profiles")
    first = F.min(F.struct((F.col("row_id") == NO_ID).alias("last"), "row_id", "text_hash")).alias("first")
    # Of equal sets with other repeats one fingerprint stands for all.
    nodes = stored(rows.groupBy("key").agg(first, F.min(F.struct("fp", "sketch", "n")).alias("x")).select("key", "first", "x.*"), "nodes")
    groups = stored(components(links(nodes, distance, LEAST_SKETCH)), "groups")
    checked = _verified(docs, nodes, groups, id_col, text_col, shingle, distance, similarity)
    reach = components(checked).withColumnRenamed("node", "key")
    named = nodes.select("key", "first").join(reach, "key", "left").withColumn("c", F.coalesce("component", "key"))
    leaders = named.groupBy("c").agg(F.min("first").alias("leader"))
    by_key = named.join(leaders, "c").select("key", F.col("leader.row_id").alias("leader_id"), F.col("leader.text_hash").alias("leader_hash"))
    return rows.select("row_id", "text_hash", "key").distinct().join(by_key, "key").select("row_id", "text_hash", "leader_id", "leader_hash")


def _verified(docs: DataFrame, nodes: DataFrame, groups: DataFrame, id_col: str, text_col: str, shingle: int, distance: int, similarity: float) -> DataFrame:
    """(a, b): links that connect, within each group of candidates, all that are linked by their shingles."""
    members = nodes.join(groups.withColumnRenamed("node", "key"), "key").select("key", "component", "n", "first.row_id", "first.text_hash")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    members = stored(members.join(members.groupBy("component").agg(blocks.alias("blocks")), "component"), "members")
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, mine).alias("i"), F.greatest(j, mine).alias("j")))
    # One row of each class brings its text; the rest of the table stays where it is while there are few classes.
    chosen = narrowed(_keyed(docs, id_col, text_col), members.select("key", "component", "blocks", "row_id", "text_hash"), ["row_id", "text_hash"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column(3):
                h = shingles(x.as_py(), shingle)
                found.append(np.array([simhash(h)], np.uint64).tobytes() + np.unique(h).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], names=["key", "component", "blocks", "data"])

    whole = chosen.select("key", "component", "blocks", "text").mapInArrow(sets, "key long, component long, blocks int, data binary")
    whole = whole.groupBy("key", "component", "blocks").agg(F.first("data").alias("data"))
    dealt = whole.select("key", "component", "data", mine.alias("mine"), F.explode(cells).alias("cell")).select("component", "cell.i", "cell.j", "key", "mine", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for *cell, key, mine_, data in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if cell != now:
                    yield from _compared(now, held, distance, similarity)
                    now, held = cell, []
                held.append((key, mine_, data))
        yield from _compared(now, held, distance, similarity)

    small_batches(docs.sparkSession)
    return dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "key").mapInArrow(run, "a long, b long")


def _compared(cell: list | None, held: list[tuple[int, int, bytes]], distance: int, similarity: float) -> Iterator[pa.RecordBatch]:
    if len(held) < 2:
        return
    _, first, second = cell
    keys = [x[0] for x in held]
    fps = np.array([np.frombuffer(x[2], np.uint64, 1)[0] for x in held])
    sets = [np.frombuffer(x[2], np.uint64, offset=8) for x in held]
    sketches = np.stack([np.frombuffer(sketch(u), np.uint8) for u in sets])
    mine = np.array([x[1] for x in held])
    left, right = np.flatnonzero(mine == first), np.flatnonzero(mine == second)
    root = list(range(len(held)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out: list[tuple[int, int]] = []
    for i in left.tolist():
        others = right[(right > i) | (first != second)]
        others = others[np.bitwise_count(fps[others] ^ fps[i]) <= distance]
        others = others[estimate(np.broadcast_to(sketches[i], (len(others), BINS)), sketches[others]) >= LEAST_SKETCH]
        for j in others.tolist():
            a, b = find(i), find(j)
            if a == b:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                root[a] = b
                out.append((keys[i], keys[j]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
