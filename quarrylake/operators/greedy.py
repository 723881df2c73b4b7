"""Greedy groups in order: each row joins the first leader that it is alike to, else it leads. By joins, in rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def meeting(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): nodes of one block whose sets of words may have a Jaccard similarity of `threshold`, a before b; none that has is lost.

    Two sets as alike as that share at least as many words as the threshold asks of
    the larger. Where that is two, they share two of those that are left when all
    that it asks of a set, less two, are cut off its most frequent words. Sets meet
    by such pairs of words, which stay rare where a vocabulary doesn't grow with
    the rows; those that may share one word only meet by words, too.
    """
    each = sets.select("block", "node", F.explode("words").alias("t"))
    often = each.groupBy("block", "t").agg(F.count("*").alias("n"))
    ranked = each.join(often, ["block", "t"]).groupBy("block", "node").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("by"))
    size = F.size("by")
    shared = F.ceil(size * threshold - 1e-9).cast("int")
    head = ranked.select("block", "node", size.alias("n"), shared.alias("shared"), F.transform(F.slice("by", F.lit(1), F.least(size, size - shared + 2)), lambda k: k["t"]).alias("head"))
    pairs = F.flatten(F.transform("head", lambda t, i: F.transform(F.slice("head", i + 2, F.size("head")), lambda u: F.struct(t.alias("t"), u.alias("u")))))
    single = F.when(F.col("shared") <= 1, F.transform("head", lambda t: F.struct(t.alias("t"), F.lit("").alias("u")))).otherwise(F.array())
    keys = head.select("block", "node", "n", F.explode(F.concat(pairs, single)).alias("k")).select("block", "k.t", "k.u", "node", "n")
    x, y = keys.withColumnsRenamed({"node": "a", "n": "na"}), keys.withColumnsRenamed({"node": "b", "n": "nb"})
    fits = (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9) & ((F.col("u") != "") | (F.col("na") + F.col("nb") - 1 <= 1 / threshold + 1e-9))
    return x.join(y, ["block", "t", "u"]).where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()


def alike_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): nodes of one block whose word sets have a Jaccard similarity of at least `threshold`, a before b.

    `nodes` has block, node (unique; its order is theirs) and words, of which repeats count once.
    """
    sets = nodes.select("block", "node", F.array_distinct("words").alias("words"))
    one, two = sets.select(F.col("node").alias("a"), F.col("words").alias("wa")), sets.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    return meeting(sets, threshold).join(one, "a").join(two, "b").where(T.jaccard(F.col("wa"), F.col("wb")) >= threshold).select("a", "b")


def leaders(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, leader): the first leader each node is alike to, in the order of nodes; leaders lead themselves.

    A node leads once no earlier alike node is open or leads; it is settled once
    an alike leader is earlier than all its open ones. Each round settles the first
    open node of every chain, and is one join on the pairs, which are cut from
    their lineage. Nodes without words are alike to none.
    """
    pairs = alike_pairs(nodes, threshold).checkpoint()
    state = nodes.select("node", F.when(F.lit(True), F.lit("open")).alias("is")).checkpoint()
    while True:
        before = pairs.join(state.select(F.col("node").alias("a"), "is"), "a").groupBy(F.col("b").alias("node")).agg(F.min(F.when(F.col("is") == "leads", F.col("a"))).alias("lead"), F.min(F.when(F.col("is") == "open", F.col("a"))).alias("wait"))
        told = state.join(before, "node", "left")
        settled = F.when(F.col("lead").isNotNull(), "follows").when(F.col("wait").isNull(), "leads").otherwise("open")
        state = told.select("node", F.when(F.col("is") == "open", settled).otherwise(F.col("is")).alias("is")).checkpoint()
        if state.where("is = 'open'").isEmpty():
            break
    first = pairs.join(state.where("is = 'leads'").select(F.col("node").alias("a")), "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("lead"))
    return state.join(first, "node", "left").select("node", F.when(F.col("is") == "leads", F.col("node")).otherwise(F.col("lead")).alias("leader"))


def grouped(rows: DataFrame, block: list[str], order: str, id_col: str, words: Column, threshold: float) -> DataFrame:
    """Rows with a column `leader`: the id of the row that leads each row's group, among rows that agree in `block`, in the
    order of the column `order` (a long that is unique within a block).

    Rows with equal words are one node: they join the same leader as the first of them.
    """
    keyed = rows.withColumn("words_", F.array_sort(F.array_distinct(words)))
    empty = keyed.where(F.size("words_") == 0).withColumn("leader", F.col(id_col)).drop("words_")
    keyed = keyed.where(F.size("words_") > 0)
    nodes = keyed.groupBy(*block, "words_").agg(F.min(F.struct(F.col(order).alias("o"), F.col(id_col).alias("i"))).alias("first"))
    within = F.struct(*block)
    placed = nodes.select(*block, "words_", F.col("first.i").alias("leader_id"), F.struct(within.alias("block"), F.col("first.o").alias("o")).alias("node"))
    found = leaders(placed.select(F.col("node.block").alias("block"), "node", F.col("words_").alias("words")), threshold)
    named = placed.drop("leader_id").join(found, "node").drop("node")
    by = named.join(placed.select(F.col("node").alias("leader"), "leader_id"), "leader").select(*block, "words_", "leader_id")
    joined = keyed.join(by, [*block, "words_"]).withColumnRenamed("leader_id", "leader").drop("words_")
    return joined.unionByName(empty)
