"""Merkle manifest of a table: a root over all rows, a proof for each, and the check of rows that may have changed.

Rows are leaves. Per group (source) they stand in order, and every FANOUT consecutive nodes become their parent,
level by level, until one node, the subroot, remains; the subroots in order of their groups likewise become the
root. H is SHA-256 of digests written as lower-case hexadecimal text.

Each level is a DataFrame: nodes have an index in their group, the index divided by the fanout names the run, and a
run's children, collected and sorted (FANOUT of them at most), are hashed into a node of the next level, which
has a fanout-th of the rows. Then levels are joined from the root down: a run's path, the digests left and right
of each node on the way up, is joined to its children once and is theirs but for the last step. A leaf's proof
and its recomputed root are worked out from that path in the task that holds its run.

Indices come from two sums, so that no group passes through one task, however large: rows are dealt by ranges of (group,
order) and written, numbered within (group, range), and each range begins where the ranges before it end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import saved, sent

FANOUT = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(*columns: Column) -> Column:
    """SHA-256 of the columns, each `-` if null, else its length in UTF-8 bytes, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def indexed(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with `idx`, the place in their group from 0 (nulls first), and the groups with `n`, their sizes."""
    dealt = saved(rows.repartitionByRange(*group, *order).withColumn("range", F.spark_partition_id()), "dealt")
    sizes = saved(dealt.groupBy(*group, "range").count(), "ranges")
    # A row for each range and group at most: groups that fill many ranges have as many rows as there are ranges.
    earlier = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("count").over(earlier), F.lit(0))).where("base > 0")
    within = dealt.withColumn("place", F.row_number().over(Window.partitionBy(*group, "range").orderBy(*order)))
    bases = bases.select(F.col("range").alias("r"), *(F.col(g).alias(f"g_{g}") for g in group), "base")
    match = F.col("range") == F.col("r")
    for g in group:
        match &= F.col(g).eqNullSafe(F.col(f"g_{g}"))
    placed = within.join(sent(bases), match, "left").withColumn("idx", F.col("place") - 1 + F.coalesce("base", F.lit(0)))
    return placed.select(*rows.columns, "idx"), sizes.groupBy(*group).agg(F.sum("count").alias("n"))


def _run() -> Column:
    return F.floor(F.col("idx") / FANOUT).cast("long")


def _steps(path: Column) -> Column:
    """From a run's sorted `nodes` and the path of the node that they make: each node with its own path."""
    digests = F.col("nodes.hash")

    def step(node: Column, i: Column) -> Column:
        side = F.struct(F.concat_ws("", F.slice(digests, F.lit(1), i)).alias("left"), F.concat_ws("", F.slice(digests, i + 2, F.lit(FANOUT))).alias("right"))
        return F.struct(node.alias("node"), F.concat(F.array(side), path).alias("path"))

    return F.transform("nodes", step)


def _grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """From (tree, n, idx, hash), n the number of the tree's nodes: the runs of each level (tree, run, nodes), lowest
    first, until each tree has one node; and these (tree, hash). A tree of one node has no runs."""
    levels, tops = [], nodes.where("n = 1").select("tree", "hash")
    while True:
        runs = nodes.where("n > 1").groupBy("tree", "n", _run().alias("run")).agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("nodes"))
        runs = saved(runs, "runs")
        if runs.isEmpty():
            return levels, tops
        levels.append(runs.select("tree", "run", "nodes"))
        nodes = runs.select("tree", F.ceil(F.col("n") / FANOUT).cast("long").alias("n"), F.col("run").alias("idx"), F.sha2(F.concat_ws("", "nodes.hash"), 256).alias("hash"))
        tops = tops.unionByName(nodes.where("n = 1").select("tree", "hash"))


def _descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, idx, path) of the lowest nodes, from the path of each tree's last node (tree, path)."""
    over = tops.select("tree", F.lit(0).cast("long").alias("idx"), "path")
    for runs in reversed(levels):
        # Trees that do not reach so high wait; others begin here, with the run that makes their last node.
        waiting = over.join(runs.select("tree").distinct(), "tree", "left_anti")
        steps = runs.select("tree", F.col("run").alias("idx"), "nodes").join(over, ["tree", "idx"]).select("tree", F.explode(_steps(F.col("path"))).alias("s"))
        over = saved(steps.select("tree", F.col("s.node.idx").alias("idx"), F.col("s.path").alias("path")).unionByName(waiting), "paths")
    return over


def manifest(docs: DataFrame, columns: list[str], group: str, order: str, changed: Column | None = None, text: str = "text") -> DataFrame:
    """Return the order and group columns, leaf, subroot, root, proof_sha256 (H of all siblings on the way to the root,
    left to right, level by level), folded_root and verified, a row for each row of `docs`.

    Leaves are leaf_hash(columns). Where `changed` holds, folded_root is made from the leaf of the row with A-Z of
    `text` lower-cased, against the siblings of the unchanged table; elsewhere from the row's own leaf. verified
    tells whether it equals root.

    Groups stand by their bytes, null first; rows by `order`, nulls first, ties by their leaf, so repeated rows are
    leaves side by side. Nulls, empty and very long texts are leaves as above. A group of one row has its leaf
    as subroot, a table of one group its subroot as root. An empty table gives no rows. Other columns are not read.
    """
    leaf = leaf_hash(*(F.col(c) for c in columns))
    lowered = leaf_hash(*(F.translate(F.col(c), UPPER, LOWER) if c == text else F.col(c) for c in columns))
    other = F.when(changed if changed is not None else F.lit(False), lowered)
    rows = docs.select(F.col(order).alias("at"), F.col(group).alias("name"), leaf.alias("hash"), other.alias("other"))
    placed, sizes = indexed(rows, ["name"], ["at", "hash"])

    # Trees are numbered in their order, so that null is one like any other; their numbers also place the subroots.
    trees = saved(indexed(sizes, [], ["name"])[0].withColumnRenamed("idx", "tree"), "trees")
    named = sent(trees.withColumnRenamed("name", "tree_name"))
    leaves = placed.join(named, F.col("name").eqNullSafe(F.col("tree_name")))
    runs = leaves.groupBy("tree", "n", _run().alias("run")).agg(F.sort_array(F.collect_list(F.struct("idx", "hash", "at", "other"))).alias("nodes"))
    runs = saved(runs, "leaves")

    # A tree of one leaf has its leaf as last node, without a step between.
    alone = F.col("n") == 1
    above = runs.select("tree", F.ceil(F.col("n") / FANOUT).cast("long").alias("n"), F.col("run").alias("idx"), F.when(alone, F.col("nodes")[0]["hash"]).otherwise(F.sha2(F.concat_ws("", "nodes.hash"), 256)).alias("hash"))
    levels, subroots = _grow(above)
    subroots = saved(subroots, "subroots")
    tops, last = _grow(subroots.select(F.lit(0).alias("tree"), F.lit(subroots.count()).cast("long").alias("n"), F.col("tree").alias("idx"), "hash"))
    root = last.first()  # one digest
    at_root = docs.sparkSession.createDataFrame([(0, [])] if root else [], "tree int, path array<struct<left:string,right:string>>")
    paths = saved(_descend(tops, at_root).select(F.col("idx").alias("tree"), "path"), "paths")

    over = _descend(levels, paths).select("tree", F.col("idx").alias("run"), F.col("path").alias("above"))
    facts = saved(trees.select("tree", "name").join(subroots.withColumnRenamed("hash", "subroot"), "tree"), "facts")
    own = F.when(alone, F.transform("nodes", lambda node: F.struct(node.alias("node"), F.col("above").alias("path")))).otherwise(_steps(F.col("above")))
    each = runs.join(over, ["tree", "run"]).join(sent(facts), "tree").select("name", "subroot", F.explode(own).alias("s"))
    path, node = F.col("s.path"), F.col("s.node")
    folded = F.aggregate(path, F.coalesce(node["other"], node["hash"]), lambda held, step: F.sha2(F.concat(step["left"], held, step["right"]), 256))
    proof = F.sha2(F.concat_ws("", F.transform(path, lambda step: F.concat(step["left"], step["right"]))), 256)
    out = each.select(node["at"].alias(order), F.col("name").alias(group), node["hash"].alias("leaf"), "subroot", F.lit(root["hash"] if root else None).cast("string").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
