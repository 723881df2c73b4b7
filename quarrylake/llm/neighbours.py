"""Nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FEW_KEYS, stored

#: Hash tables, and the estimated chance with which a neighbour is in a bucket that its query visits in one of them.
TABLES, SUCCESS = 4, 0.97
#: A bin is so many times as wide as the typical distance to a k-th neighbour.
WIDTH = 2.0
#: Functions in a key: this many for each doubling of the rows, within bounds.
KEYS_PER_DOUBLING, FEWEST_KEYS, MOST_KEYS = 0.62, 4, 16
#: Buckets that a query may visit in a table. One that needs more to reach SUCCESS is compared with all rows instead.
PROBES = 2048
#: Rows of the sample in which a query's k-th nearest distance is an upper bound of its own.
SAMPLE = 4096
#: Bytes of vectors, as doubles, that one place of a table is meant to hold.
PLACE_BYTES = 2_000_000
#: Queries whose visits one task works out.
QUERIES_PER_TASK = 200
#: The key of the pseudo-table in which queries meet all rows.
EVERYTHING = -1


@dataclass
class Index:
    """One length's hash functions: directions and shifts for each table, the bin's width, places a table has, and the sample."""

    rows: int
    directions: np.ndarray
    shifts: np.ndarray
    width: float
    places: int
    sample: np.ndarray

    def bins(self, x: np.ndarray, table: int) -> np.ndarray:
        """Where each row falls along each function of the table, in bins; the bin's number is the whole part."""
        return (x @ self.directions[table] + self.shifts[table]) / self.width

    def place(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) >> np.uint64(20)) % np.uint64(self.places)).astype(np.int32)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, each by its own differences, so that a pair's doesn't depend on what stands beside it."""
    d = x - y
    return (d * d).sum(axis=1)


def _mixed(bins: np.ndarray) -> np.ndarray:
    """A 64-bit code of the last axis. Codes that clash would only make a bucket larger."""
    out = np.full(bins.shape[:-1], 1469598103934665603, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(bins.shape[-1]):
            out = (out ^ bins[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


_ERF = np.vectorize(math.erf, otypes=[float])


def _below(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _ERF(z / math.sqrt(2)))


def probes(at: np.ndarray, reach: np.ndarray, width: float, chance: float, most: int = PROBES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, counts, reached) for queries at `at` (queries, functions), in bins of `width`: the buckets to visit, the likeliest
    to hold a neighbour at the distance `reach` first, how many of them bring the chance to `chance`, and whether `most` did.

    A function's difference between the two is normal with that distance as its
    deviation, which gives the chance of each bin beside the query's own; a
    bucket's is their product. The likeliest buckets of some functions begin
    only with the likeliest of one function fewer, so each step keeps the best.
    """
    n, m = at.shape
    offsets = np.arange(-2, 3)
    inside = at - np.floor(at)
    edges = np.arange(-2, 4)[None, None, :] - inside[:, :, None]
    below = _below(edges * (width / np.maximum(reach, 1e-300))[:, None, None])
    logs = np.log(np.maximum(np.diff(below, axis=2), 1e-300))
    best, path = np.zeros((n, 1)), np.zeros((n, 1, 0), np.int8)
    for j in range(m):
        total = (best[:, :, None] + logs[:, j][:, None, :]).reshape(n, -1)
        if total.shape[1] > most:
            pick = np.argpartition(-total, most - 1, axis=1)[:, :most]
        else:
            pick = np.broadcast_to(np.arange(total.shape[1]), total.shape)
        best = np.take_along_axis(total, pick, 1)
        before = np.take_along_axis(path, (pick // len(offsets))[:, :, None], 1)
        path = np.concatenate([before, offsets[pick % len(offsets)][:, :, None].astype(np.int8)], axis=2)
    order = np.argsort(-best, axis=1, kind="stable")
    so_far = np.exp(np.take_along_axis(best, order, 1)).cumsum(axis=1)
    counts = np.minimum((so_far < chance).sum(axis=1) + 1, so_far.shape[1])
    bins = np.floor(at).astype(np.int64)[:, None, :] + np.take_along_axis(path, order[:, :, None], 1)
    return bins, counts, so_far[:, -1] >= chance


def _visits(node: int, size: int, table: int, places: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each place that a query visits in a table, with the codes of the buckets there."""
    order = np.argsort(places, kind="stable")
    met, begin = np.unique(places[order], return_index=True)
    lists = pa.ListArray.from_arrays(pa.array([*begin.tolist(), len(codes)], pa.int32()), pa.array(codes[order]))
    n = len(met)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, node)), pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, table, np.int32)), pa.array(met.astype(np.int32)), lists], names=["node", "size", "table", "place", "codes"])


def _usable(vector: Column) -> Column:
    limit = F.lit(float(np.finfo(np.float64).max))
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) <= limit)) & F.exists(vector, lambda c: c != 0), F.lit(False))


def _looked_up(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """`rows` with the columns of `keys` where there is one. While there are few keys the rows don't move; beyond, the join is
    one that adaptive execution splits where a key has many rows."""
    few = keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    return rows.join(F.broadcast(keys) if few else keys.hint("shuffle_merge"), by, "left")


def _indexes(classes: DataFrame, k: int, tables: int, place_bytes: int, seed: int) -> dict[int, Index]:
    """For each length its hash functions, fitted on at most SAMPLE rows of it (those whose hashes are smallest)."""
    out = {}
    for r in classes.groupBy("size").agg(F.count("*").alias("n")).collect():
        size, n = r["size"], r["n"]
        near = classes.where(F.col("size") == size).orderBy(F.xxhash64("vector"), "node").limit(SAMPLE)
        sample = np.array([x["vector"] for x in near.select("vector").collect()], np.float64)
        some = sample[:: max(1, len(sample) // 256)]
        reach = [np.sort(_exact(x, sample))[min(k, len(sample) - 1)] for x in some]
        width = WIDTH * math.sqrt(float(np.median(reach)))
        m = min(MOST_KEYS, max(FEWEST_KEYS, math.ceil(KEYS_PER_DOUBLING * math.log2(max(n, 2)))))
        rng = np.random.default_rng([seed, size])
        width = width if 0 < width < math.inf else 1.0
        places = max(1, math.ceil(n / max(64, place_bytes // (8 * size))))
        out[size] = Index(n, rng.standard_normal((tables, size, m)), rng.uniform(0, width, (tables, 1, m)), width, places, sample)
    return out


def nearest(
    vectors: DataFrame,
    queries: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    tables: int = TABLES,
    success: float = SUCCESS,
    most: int = PROBES,
    place_bytes: int = PLACE_BYTES,
    seed: int = 11,
) -> DataFrame:
    """(query_id, rank, id, score): for each row of `vectors` where `queries` holds its k nearest other rows found, by Euclidean
    distance in double precision; fewer if there are fewer. `queries` is a condition on the columns of `vectors`.

    All usable rows are indexed and all are candidates: rows whose vectors are
    null, empty, zero or hold null or non-finite components take no part, and
    only vectors of one length are compared. Ties go to the smaller id, a null
    id last; a row with a null id isn't a query. Rows with the same id are rows
    of their own: each is a query, and a candidate of the others. Copies of a
    vector are one class, which is hashed and compared once. An empty table gives
    an empty table; other columns are read only if `queries` does.

    Each table's key joins several p-stable functions. A query visits buckets in
    the order of their estimated chance to hold a neighbour at its k-th nearest
    distance in a sample (an upper bound of its own), until the tables together
    reach `success`; one that would need more than `most` buckets in a table, or
    that finds fewer than k rows, meets every row instead. Buckets are dealt to
    places; one with over twice the rows that it is meant to hold is cut into
    parts, all of which its queries meet.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    if vectors.schema[vector_col].dataType.simpleString() not in ("array<float>", "array<double>"):
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    kind = rows.schema["vector"].dataType.simpleString()
    rows = rows.where(_usable(F.col("vector")))
    # -0.0 + 0.0 is 0.0, so vectors are equal if and only if their texts are.
    print_of = F.unhex(F.sha2(F.transform("vector", lambda c: c + F.lit(0.0).cast(kind[6:-1])).cast("string").cast("binary"), 256))
    base = stored(rows.select(F.monotonically_increasing_id().alias("row"), "id", "asks", F.size("vector").alias("size"), "vector", print_of.alias("print")), "vectors")
    copied = stored(base.groupBy("print").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("print", "first"), "copied")
    named = _looked_up(base, copied, ["print"]).withColumn("node", F.coalesce("first", "row"))
    classes = named.where("node = row").select("node", "size", "vector")
    asking = named.where("asks AND id IS NOT NULL").select("id", "node", "size", "vector")
    asked = stored(asking.dropDuplicates(["node"]).select("node", "size", "vector"), "asked")
    # Of a class only the k + 1 smallest ids can be among the k nearest.
    order = Window.partitionBy("node").orderBy(F.col("id").asc_nulls_last(), "row")
    members = stored(named.select("node", "id", "row").withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k + 1).select("node", "id", "pos"), "members")
    indexes = _indexes(classes, k, tables, place_bytes, seed)
    chance = 1 - (1 - success) ** (1 / tables)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                some, index = batch.take(pa.array(np.flatnonzero(sizes == size))), indexes[size]
                x = _matrix(some.column("vector"))
                for t in range(tables):
                    code = _mixed(np.floor(index.bins(x, t)))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(len(x), t, np.int32)), pa.array(index.place(code)), pa.array(code)], names=[*some.schema.names, "table", "place", "code"])

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                every, index = batch.take(pa.array(np.flatnonzero(sizes == size))), indexes[size]
                for i in range(0, every.num_rows, 32):
                    some = every.slice(i, 32)
                    x = _matrix(some.column("vector"))
                    bound = np.array([np.sort(_exact(q, index.sample))[k] if len(index.sample) > k else np.inf for q in x])
                    found = [probes(index.bins(x, t), np.sqrt(bound), index.width, chance, most) for t in range(tables)] if np.isfinite(bound).any() else []
                    whole = ~np.isfinite(bound)
                    for _, _, reached in found:
                        whole |= ~reached
                    for q, node in enumerate(some.column("node").to_pylist()):
                        if whole[q]:
                            yield from _visits(node, size, EVERYTHING, np.arange(index.places), np.zeros(index.places, np.int64))
                            continue
                        for t, (bins, counts, _) in enumerate(found):
                            codes = np.unique(_mixed(bins[q, : counts[q]]))
                            yield from _visits(node, size, t, index.place(codes), codes)

    crowd = stored(classes.mapInArrow(hashed, f"node long, size int, vector {kind}, table int, place int, code long").groupBy("size", "table", "place").agg(F.count("*").alias("n")), "crowd")
    n = asked.count()
    visits = stored(asked.repartition(max(1, math.ceil(n / QUERIES_PER_TASK)), "node").mapInArrow(visited, "node long, size int, table int, place int, codes array<long>"), "visits")

    def searched(visits: DataFrame) -> DataFrame:
        """(node, other, far): the nearest k + 1 classes of each visiting node in each place that it visits."""
        cell = ["size", "table", "place"]
        keyed = classes.mapInArrow(hashed, f"node long, size int, vector {kind}, table int, place int, code long")
        full = crowd.select(*cell, F.ceil(F.col("n") * F.col("size") * 8 / (2 * place_bytes)).cast("int").alias("parts"))
        if not visits.where(F.col("table") == EVERYTHING).isEmpty():
            spread = F.create_map(*[F.lit(x) for s, i in indexes.items() for x in (s, i.places)])
            keyed = keyed.unionByName(classes.select("node", "size", "vector", F.lit(EVERYTHING).alias("table"), F.pmod(F.xxhash64("node"), spread[F.col("size")]).cast("int").alias("place"), F.lit(0).cast("long").alias("code")))
        own = _looked_up(keyed, full.where("parts > 1"), cell).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.coalesce("parts", F.lit(1))).cast("int"))
        asks = _looked_up(visits, full.where("parts > 1"), cell).withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).join(asked.select("node", "vector"), "node")
        both = own.select(*cell, "part", F.lit(0).alias("kind"), "node", F.array("code").alias("codes"), "vector").unionByName(asks.select(*cell, "part", F.lit(1).alias("kind"), "node", "codes", "vector"))
        met = both.repartition(*cell, "part").sortWithinPartitions(*cell, "part", "kind")
        return met.mapInArrow(lambda batches: _answers(batches, k + 1), "node long, other long, far double")

    # A class has k + 1 members here at the most; of classes as far as each other all that can matter stay.
    def best(found: DataFrame) -> DataFrame:
        """(node, near): the k + 1 nearest rows in order, a query's own among them."""
        rows = found.distinct().join(members.withColumnRenamed("node", "other"), "other")
        order = Window.partitionBy("node").orderBy("far", F.col("id").asc_nulls_last(), "other", "pos")
        top = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
        return top.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("at", "id", "far"))).alias("near"))

    near = stored(best(searched(visits)), "near")
    # Fewer than k + 1 rows (with its own): the tables didn't show enough, so these meet every row.
    few = visits.where(F.col("table") == EVERYTHING).select("node").distinct()
    short = near.where(F.size("near") <= k).join(few, "node", "left_anti").select("node")
    lost = asked.select("node").join(near.select("node"), "node", "left_anti")
    again = short.unionByName(lost).join(asked.select("node", "size"), "node")
    if not again.isEmpty():
        spread = F.create_map(*[F.lit(x) for s, i in indexes.items() for x in (s, i.places)])
        again = stored(again.select("node", "size", F.lit(EVERYTHING).alias("table"), F.explode(F.sequence(F.lit(0), spread[F.col("size")] - 1)).alias("place"), F.array(F.lit(0).cast("long")).alias("codes")), "again")
        more = best(searched(again))
        near = near.join(again.select("node").distinct(), "node", "left_anti").unionByName(more)
    own = F.array_position(F.transform("near", lambda x: x["id"]), F.col("query_id"))
    listed = asking.select(F.col("id").alias("query_id"), "node").join(near, "node").withColumn("own", own)
    others = F.slice(F.filter("near", lambda x, i: (i != F.col("own") - 1) | (F.col("own") == 0)), 1, k)
    return listed.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.sqrt("x.far").alias("score"))


def _answers(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest rows of a part of a place, and those as far as the last, for each query that visits it. Rows come before queries."""
    here, rows, held = None, [], None
    for batch in batches:
        names = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "table", "place", "part", "kind")], axis=1)
        cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)]):
            if a == b:
                continue
            part, place, kind = batch.slice(a, b - a), tuple(names[a, :4].tolist()), names[a, 4]
            if place != here:
                here, rows, held = place, [], None
            if kind == 0:
                rows.append(part)
                continue
            if held is None and rows:
                held, rows = _Place(rows), []
            for i in range(0, part.num_rows if held else 0, 64):
                yield from held.answers(part.slice(i, 64), k)


class _Place:
    """Rows of one place, sorted by the code of their bucket."""

    def __init__(self, rows: list[pa.RecordBatch]) -> None:
        code = np.concatenate([r.column("codes").flatten().to_numpy(zero_copy_only=False) for r in rows])
        order = np.argsort(code, kind="stable")
        self.code = code[order]
        self.node = np.concatenate([r.column("node").to_numpy(zero_copy_only=False) for r in rows])[order]
        self.vector = np.concatenate([_matrix(r.column("vector")) for r in rows])[order]
        self.square = (self.vector * self.vector).sum(axis=1)

    def answers(self, asks: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
        x = _matrix(asks.column("vector"))
        square = (x * x).sum(axis=1)
        rough = square[:, None] + self.square - 2 * (x @ self.vector.T)
        out_node, out_other, out_far = [], [], []
        for q, (node, codes) in enumerate(zip(asks.column("node").to_pylist(), asks.column("codes"))):
            codes = np.unique(codes.values.to_numpy(zero_copy_only=False))
            at = np.flatnonzero(codes[np.minimum(np.searchsorted(codes, self.code), len(codes) - 1)] == self.code)
            if len(at) > k:
                near = rough[q, at]
                # Rounding of the rough distances is far below this; where they aren't finite all rows stay.
                slack = 1e-9 * (square[q] + self.square[at].max())
                limit = np.partition(near, k - 1)[k - 1] + slack
                at = at[near <= limit] if np.isfinite(limit) else at
            far = _exact(x[q], self.vector[at])
            if len(far) > k:
                keep = far <= np.partition(far, k - 1)[k - 1]
                at, far = at[keep], far[keep]
            out_node.append(np.full(len(at), node))
            out_other.append(self.node[at])
            out_far.append(far)
        if out_node:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_node, out_other, out_far)], names=["node", "other", "far"])


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
