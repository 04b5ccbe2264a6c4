"""Merkle manifest of a dataset: a leaf for each row, a tree for each source, a tree over the sources, and a proof for each row.

The leaves of a source stand in order of their id; runs of ``ARITY`` consecutive nodes are hashed to their parent, level by level, until one
node is left. The trees' tops, in order of the source, are the leaves of one more tree, built alike. Every level is one exchange of digests by
(tree, run), and a run is all that meets in a group, so a source with a third of all rows is no special case.

Proofs come from pointer jumping: a node holds the segment of siblings between itself and an ancestor, at first its parent. Self-joins of the
nodes double the distance and concatenate the segments, and a tree's top already holds the segments from there to the root. After k joins only
nodes whose level is a multiple of 2^k can still be asked for, so the joined side shrinks to n / 3^(2^k). The rows themselves join the tables
of distance 1, 2, 4 … one after the other, keyed by (tree, place), a key that is unique on the joined side.

Defined cases: null values count as ``-``; rows with a null source form a tree of their own, the first; null ids come first in
their source; rows with one id stand in the order of their leaves, and equal rows one after another, each with a proof of its own; an empty
table gives no rows; a lone row's proof is empty, and it is itself subroot and root; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripchain.llm.common import Scratch
from tripchain.llm.sharding import in_order

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = "struct<left:binary,right:binary>"


def _nothing() -> Column:
    return F.expr(f"cast(array() AS array<{_STEP}>)")


def digest(data: Column) -> Column:
    """SHA-256 of text, as bytes."""
    return F.unhex(F.sha2(data, 256))


def hex_text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf_of(*values: Column) -> Column:
    """The leaf of a row: each value with its length in bytes before it, so that no two rows give the same text."""
    text = [value.cast("string") for value in values]
    return digest(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give, as bytes."""
    return F.aggregate(proof, leaf, lambda node, step: digest(hex_text(F.concat(step["left"], node, step["right"]))))


def siblings(proof: Column) -> Column:
    """All digests of a proof in its order, as bytes."""
    return F.aggregate(proof, F.unhex(F.lit("")), lambda seen, step: F.concat(seen, step["left"], step["right"]))


def _places(ordered: DataFrame) -> DataFrame:
    """``pos``, gapless from 0 within each tree, and ``size``, the tree's rows, for rows that ``in_order`` sorted by tree first.

    What meets in one task for a tree is a count for each part of the sort, not rows.
    """
    parts = ordered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = parts.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size"))
    return ordered.join(shift, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _runs(nodes: DataFrame, carried: Sequence[str]) -> DataFrame:
    """(tree, pos, size, node) of the parents, and ``below``, their children with what stands left and right of each."""
    own = F.struct("pos", "node", *carried)
    runs = nodes.where("size > 1").groupBy("tree", F.expr(f"pos div {ARITY}").alias("run")).agg(
        F.array_sort(F.collect_list(own)).alias("below"), F.ceil(F.first("size") / ARITY).alias("up"))
    joined = lambda part: F.aggregate(part, F.unhex(F.lit("")), lambda seen, one: F.concat(seen, one["node"]))
    beside = F.transform("below", lambda one, i: F.struct(
        one["pos"].alias("pos"), one["node"].alias("node"), *[one[c].alias(c) for c in carried],
        joined(F.slice("below", 1, i)).alias("left"), joined(F.slice("below", i + 2, ARITY)).alias("right")))
    return runs.select("tree", F.col("run").alias("pos"), F.col("up").alias("size"),
                       digest(hex_text(joined(F.col("below")))).alias("node"), beside.alias("below"))


def _children(runs: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """(tree, pos, node, path): the nodes of a level, each with its segment to the parent."""
    step = F.array(F.struct(F.col("one.left").alias("left"), F.col("one.right").alias("right"))).alias("path")
    return runs.select("tree", F.explode("below").alias("one")).select("tree", "one.pos", "one.node", *[f"one.{c}" for c in carried], step)


class _Forest:
    """All levels of the trees over ``leaves`` (tree, pos, size, node, carried …)."""

    def __init__(self, leaves: DataFrame, scratch: Scratch, carried: Sequence[str] = ()):
        self.leaves, self.scratch, self.carried, self.levels = leaves, scratch, carried, []
        most, nodes = leaves.agg(F.max("size")).first()[0] or 0, leaves
        while most > 1:
            self.levels.append(scratch.keep(_runs(nodes, carried if not self.levels else ()), "merkle-level"))
            nodes, most = self.levels[-1].drop("below"), -(-most // ARITY)

    def tops(self) -> DataFrame:
        """(tree, level, node): the last node of each tree."""
        found = self.leaves.where("size = 1").select("tree", F.lit(0).alias("level"), "node")
        for level, runs in enumerate(self.levels, 1):
            found = found.unionByName(runs.where("size = 1").select("tree", F.lit(level).alias("level"), "node"))
        return found

    def paths(self, onward: DataFrame) -> DataFrame:
        """(tree, pos, node, carried …, path, outer, top): a leaf's segment up to its tree's top, and what ``onward``
        (tree, level, outer, top) says of the top."""
        no_top = [F.lit(None).cast(f"array<{_STEP}>").alias("outer"), F.lit(None).cast("binary").alias("top")]
        onward = onward.withColumn("level", F.col("level").cast("int"))
        above = onward.where("level > 0").select("tree", "level", F.lit(0).cast("long").alias("pos"), _nothing().alias("path"), "outer", "top")
        for level, runs in enumerate(self.levels[1:], 1):
            above = above.unionByName(_children(runs).select("tree", F.lit(level).alias("level"), "pos", "path", *no_top))
        above = self.scratch.keep(above, "merkle-jump")
        rows = self.leaves.where("size = 1").select("tree", "pos", "node", *self.carried, _nothing().alias("path")).join(
            onward.where("level = 0").select("tree", "outer", "top"), "tree")
        if self.levels:
            rows = rows.unionByName(_children(self.levels[0], self.carried).select("*", *no_top))
        rows = rows.withColumn("level", F.lit(0))
        step = 1
        while step <= len(self.levels):
            rows = self._jump(rows, above.where(F.col("level") == step), step)
            above = above.where(F.col("level") > 0)
            if 2 * step <= len(self.levels):
                here, there = (above.where(F.col("level") % (2 * step) == rest) for rest in (0, step))
                above = self.scratch.keep(self._jump(here, there, step), "merkle-jump")
            step *= 2
        return rows.drop("level")

    @staticmethod
    def _jump(nodes: DataFrame, ancestors: DataFrame, step: int) -> DataFrame:
        """Segments of ``nodes`` with those of their ancestors ``step`` levels up behind them, where there is one."""
        further = ancestors.select(
            F.col("tree").alias("_tree"), F.col("level").alias("_level"), F.col("pos").alias("_pos"),
            F.col("path").alias("_path"), F.col("outer").alias("_outer"), F.col("top").alias("_top"))
        at = (F.col("tree") == F.col("_tree")) & (F.col("level") + step == F.col("_level")) & (F.expr(f"pos div {ARITY**step}L") == F.col("_pos"))
        found = nodes.join(further, at, "left")
        return found.withColumns({
            "path": F.concat("path", F.coalesce("_path", _nothing())), "outer": F.coalesce("outer", "_outer"), "top": F.coalesce("top", "_top"),
        }).drop("_tree", "_level", "_pos", "_path", "_outer", "_top")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id", source: str = "source",
             carried: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, carried …), digests as bytes; ``proof`` holds for each level up to the root what stands left and
    right of the node. ``carried`` names further columns to take along, computed on the rows of ``docs``."""
    spark, carried = docs.sparkSession, carried or {}
    scratch, kept = Scratch(spark), Scratch(spark)
    # A tree is known by sixteen bytes of its source, however long that is; no bytes stand for null.
    rows = scratch.keep(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.unhex(F.md5(F.col(source).cast("string").cast("binary"))), F.unhex(F.lit(""))).alias("tree"),
        leaf_of(*[F.col(c) for c in fields]).alias("node"), F.struct(*[value.alias(name) for name, value in carried.items()] or [F.lit(0).alias("none")]).alias("own")), "merkle-rows")
    order = F.col("source").asc_nulls_first()
    leaves = _places(in_order(rows, scratch, "merkle-leaves", order, F.col("doc_id").asc_nulls_first(), F.col("node")))
    forest = _Forest(scratch.keep(leaves.select("tree", "pos", "size", "node", "doc_id", "own"), "merkle-places"), scratch, ("doc_id", "own"))
    tops = forest.tops().join(rows.groupBy("tree").agg(F.first("source").alias("source")), "tree")
    ranked = in_order(tops.select(F.col("tree").alias("below"), "source", F.col("level").alias("height"), "node"), scratch, "merkle-tops", order)
    upper = _Forest(scratch.keep(_places(ranked.withColumn("tree", F.lit(0))).select("tree", "pos", "size", "node", "below", "height"), "merkle-sources"),
                    scratch, ("below", "height"))
    last = upper.tops()
    whole = last.select("node").first()
    root = F.lit(bytes(whole["node"]) if whole else None).cast("binary")
    ends = upper.paths(last.select("tree", "level", _nothing().alias("outer"), F.col("node").alias("top")))
    onward = ends.select(F.col("below").alias("tree"), F.col("height").alias("level"), F.col("path").alias("outer"), F.col("node").alias("top"))
    proven = forest.paths(scratch.keep(onward, "merkle-onward"))
    result = kept.keep(proven.select(
        "doc_id", F.col("node").alias("leaf"), F.col("top").alias("subroot"), root.alias("root"), F.concat("path", "outer").alias("proof"),
        *[F.col(f"own.{name}").alias(name) for name in carried]), "merkle-manifest")
    scratch.drop()
    return result


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), digests as hex text; texts of rows whose id's CRC is even lose
    their line ends before they are verified."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    received = leaf_of(*[tampered if c == "text" else F.col(c) for c in FIELDS])
    found = manifest(docs, carried={"received": received}).withColumn("folded", folded(F.col("received"), F.col("proof")))
    return found.select(
        "doc_id", *[hex_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(hex_text(siblings(F.col("proof"))), 256).alias("proof_sha256"), hex_text(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"))
