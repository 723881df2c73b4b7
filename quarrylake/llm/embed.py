"""Near-duplicate vectors by cross-polytope hashing with multiprobe buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, stored

#: Tables, rotations joined in a key, buckets that a vector probes in each table (its own included).
TABLES, ROTATIONS, PROBES = 10, 3, 4
#: Vertices of each rotation among which probes are chosen.
VERTICES = 4
#: Rows of a bucket that one block of a cell holds.
BLOCK = 2000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; rows have a power of two as length."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def codes(x: np.ndarray, tables: int = TABLES, rotations: int = ROTATIONS, probes: int = PROBES, seed: int = 5) -> np.ndarray:
    """(rows, tables, probes): the codes of the buckets each vector probes; the first of each table is its own.

    Each rotation is three rounds of random signs and a Hadamard transform; a
    vector's vertex is the axis, with its sign, to which the rotated vector is
    nearest. Further probes change some vertices to the next nearest axes, in the
    order of what that costs.
    """
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    rng = np.random.default_rng(seed)
    m = min(VERTICES, width)
    combos = np.stack(np.meshgrid(*[np.arange(m)] * rotations, indexing="ij"), -1).reshape(-1, rotations)
    out = np.zeros((len(x), tables, min(probes, len(combos))), np.int64)
    for t in range(tables):
        cost, vertices = np.zeros((len(x), len(combos))), []
        for r in range(rotations):
            y = x
            for sign in rng.choice([-1.0, 1.0], size=(3, width)):
                y = hadamard(y * sign)
            near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :m]
            height = np.take_along_axis(y, near, 1)
            vertices.append(2 * near + (height < 0))
            cost += ((np.abs(height[:, :1]) - np.abs(height)) ** 2)[:, combos[:, r]]
        best = np.argsort(cost, axis=1, kind="stable")[:, : out.shape[2]]
        for r in range(rotations):
            out[:, t] = out[:, t] * (2 * width) + np.take_along_axis(vertices[r], combos[best, r], 1)
    return out


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _buckets(classes: DataFrame, tables: int, rotations: int, probes: int) -> DataFrame:
    """(node, key, code, home, own): a row for each bucket that a class probes; `own` has its own codes in all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(batch.column("size"))
            for size in np.unique(sizes).tolist():
                some = batch.take(pa.array(np.flatnonzero(sizes == size)))
                for i in range(0, some.num_rows, 1000):
                    part = some.slice(i, 1000)
                    found = codes(_unit(_matrix(part, "vector")), tables, rotations, probes)
                    n, _, width = found.shape
                    node = np.repeat(np.array(part.column("node")), tables * width)
                    table = np.tile(np.repeat(np.arange(tables, dtype=np.int32), width), n)
                    home = np.tile(np.arange(width) == 0, n * tables)
                    own = pa.FixedSizeListArray.from_arrays(pa.array(np.repeat(found[:, :, 0], tables * width, axis=0).ravel()), tables).cast(pa.list_(pa.int64()))
                    label = part.column("label").take(pa.array(np.repeat(np.arange(n), tables * width)))
                    size_of = pa.array(np.full(len(node), size, np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(node), label, size_of, pa.array(table), pa.array(found.ravel()), pa.array(home), own], names=["node", "label", "size", "table", "code", "home", "own"])

    return classes.mapInArrow(run, "node long, label string, size int, table int, code long, home boolean, own array<long>")


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaling by the largest component first keeps squares of huge and tiny numbers finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


_KEY = ["label", "size", "table", "code"]


def links(classes: DataFrame, cosine: float = 0.93, tables: int = TABLES, rotations: int = ROTATIONS, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """(a, b): distinct pairs a < b of nodes with equal labels and a cosine of at least `cosine`, as far as the tables meet.

    `classes` has node, label, size and vector. A bucket with more than `block`
    rows is cut into blocks, and pairs of blocks go to different tasks; no bucket
    is capped. A pair that has the same own bucket in an earlier table is left to
    that table.
    """
    keys = stored(_buckets(classes, tables, rotations, probes), "buckets")
    sizes = keys.groupBy(*_KEY).agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where("n > 1 AND any_home")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n", "any_home")
    met = keys.join(sizes, _KEY)
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, mine).alias("i"), F.greatest(j, mine).alias("j")))
    met = met.select("node", *_KEY, "home", "own", mine.alias("mine"), F.explode(cells).alias("cell"))
    met = met.join(classes.select("node", "vector"), "node").select("node", *_KEY, "home", "own", "mine", "cell.i", "cell.j", "vector")
    cell = [*_KEY, "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in cell)))
            begin = 0
            for at in range(1, len(names) + 1):
                if at < len(names) and names[at] == names[begin]:
                    continue
                if held and last != names[begin]:
                    yield from _compare(held, cosine)
                    held = []
                held.append(batch.slice(begin, at - begin))
                last, begin = names[begin], at
        if held:
            yield from _compare(held, cosine)

    dealt = met.repartition(*cell).sortWithinPartitions(*cell)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _compare(held: list[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    if rows.num_rows < 2:
        return
    i, j, table = (rows.column(c)[0].as_py() for c in ("i", "j", "table"))
    node, home, mine = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("node", "home", "mine"))
    vector, own = _unit(_matrix(rows, "vector")), _matrix(rows, "own")
    left = np.flatnonzero(mine == i)
    right = np.flatnonzero(mine == j)
    for k in range(0, len(left), 256):
        part = left[k : k + 256]
        x, y = np.nonzero((vector[part] @ vector[right].T >= cosine - 1e-9) & (home[part][:, None] | home[right][None, :]))
        x, y = part[x], right[y]
        ordered = node[x] < node[y]
        if i != j:
            x, y = np.where(ordered, x, y), np.where(ordered, y, x)
            x, y = x[node[x] < node[y]], y[node[x] < node[y]]
        else:
            x, y = x[ordered], y[ordered]
        # Verified pair by pair, so that a pair's cosine doesn't depend on what else is in the bucket.
        sure = np.zeros(len(x), bool)
        for s in range(0, len(x), 20_000):
            sure[s : s + 20_000] = (vector[x[s : s + 20_000]] * vector[y[s : s + 20_000]]).sum(axis=1) >= cosine
        x, y = x[sure], y[sure]
        new = (own[x, :table] != own[y, :table]).all(axis=1) if table else np.ones(len(x), bool)
        if new.any():
            yield pa.RecordBatch.from_arrays([pa.array(node[x[new]]), pa.array(node[y[new]])], names=["a", "b"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, tables: int = TABLES, rotations: int = ROTATIONS, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component, kept): one row for each row of `vectors`.

    Rows are compared when their labels are equal and not null and their vectors
    have the same length; they are linked at a cosine of at least `cosine`, in
    double precision. A vector that is null, empty, zero or holds null or
    non-finite components links with nothing. n_links counts the other rows
    linked directly; component is the smallest id reachable; kept marks the rows
    that have it. Rows with a null id count as links but name no component
    unless no row of it has an id. Repeated ids are rows of their own. An empty
    table gives an empty table. Other columns of `vectors` are not read.

    Equal vectors of a label form one class; only classes are hashed and
    compared, so copies, however many, cost one aggregation.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    limit = F.lit(float(np.finfo(np.float64).max))
    usable = F.col("label").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) <= limit)) & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    good = rows.where("usable")
    grouped = good.groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()).withColumn("size", F.size("vector")), "classes")
    pairs = stored(links(classes.select("node", "label", "size", "vector"), cosine, tables, rotations, probes, block), "links")
    size_of = classes.select("node", "n")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(size_of.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    named = classes.join(linked, "node", "left").join(components(pairs), "node", "left").withColumn("c", F.coalesce("component", "node"))
    least = named.groupBy("c").agg(F.min("least").alias("top"))
    facts = named.join(least, "c").select("label", "vector", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("top").alias("component"))
    found = good.join(facts, ["label", "vector"]).select("id", "n_links", "component")
    alone = rows.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return found.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


#: All pairs of a label: the brute force that the hashed search is held against.
OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
    AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), l AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.label = q.label AND p.r <> q.r AND len(p.x) = len(q.x)
  WHERE list_dot_product(p.x, q.x) / (sqrt(list_dot_product(p.x, p.x)) * sqrt(list_dot_product(q.x, q.x))) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
