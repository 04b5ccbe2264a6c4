"""Sharding by best-fit-decreasing bin packing; the law is ``bytes`` (sizes near equal).

Equal texts form a group that stays whole. Groups go by falling size into the bin whose remaining capacity is the smallest that
still holds them; the bins stand in a balanced tree by remaining capacity. The packing works on runs of groups of one size, which
is exact, since equal groups are interchangeable: the tightest bin stays the tightest while it takes more of them. Runs are all that
reaches the driver: k distinct sizes need at least k(k+1)/2 bytes, so n bytes of text have fewer than sqrt(2n) runs, and n/(2k)
bytes a run. The groups themselves are ranked by a range-partitioned sort and find their shard by size and rank.

``pack`` packs into bins of a given capacity; ``equal_bins`` seeks the least capacity at which a given number of bins is enough.
A group above an equal share of what is left gets a bin to itself.

Defined cases: a null text has no bytes and the size 1, in one group with the empty text; repeated rows are packed each;
an empty table gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripchain.llm.common import Scratch, text_key


class Bins:
    """Bins in a treap by (remaining, bin); priorities are hashes of the bin, so the tree is balanced and always the same."""

    def __init__(self) -> None:
        self.root = None

    def add(self, remaining: int, number: int) -> None:
        low, high = self._split(self.root, (remaining, number))
        leaf = [(remaining, number), hash((number, 0x9E3779B9)), None, None]
        self.root = self._join(self._join(low, leaf), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin of least remaining capacity that holds ``size``."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        first, rest = self._split(high, (node[0][0], node[0][1] + 1))
        self.root = self._join(low, rest)
        return node[0]

    def _split(self, node, key):
        """Nodes below ``key`` and the others, along one path."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _join(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high


def pack(runs: Iterable[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Runs (size, groups) by falling size into bins: (size, first rank, last rank + 1, bin), ranks counted within the size.

    Opens bins as needed; with ``bins`` given, none when that many are not enough.
    """
    tree, opened, placed = Bins(), 0, []
    for size, groups in runs:
        rank = 0
        while rank < groups:
            found = tree.take_tightest(size)
            if found is None:
                if bins is not None and opened == bins:
                    return None
                found, opened = (max(capacity, size), opened), opened + 1
            n = min(groups - rank, found[0] // size)
            placed.append((size, rank, rank + n, found[1]))
            tree.add(found[0] - n * size, found[1])
            rank += n
    return placed


def equal_bins(runs: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """The packing into ``bins`` bins at the least capacity found by halving."""
    alone, rest = [], [list(run) for run in sorted(runs, reverse=True)]
    left, first = sum(size * groups for size, groups in rest), {size: 0 for size, _ in runs}
    while rest and len(alone) < bins - 1 and rest[0][0] * (bins - len(alone)) > left:
        size = rest[0][0]
        alone.append((size, first[size], first[size] + 1, len(alone)))
        first[size] += 1
        left -= size
        rest[0][1] -= 1
        if not rest[0][1]:
            rest.pop(0)
    if not rest:
        return alone
    free = bins - len(alone)
    low = max(-(-left // free), rest[0][0])
    high, best = low, pack(rest, low, free)
    while best is None:
        high += max(rest[0][0], high // 64)
        best = pack(rest, high, free)
    while high - low > max(1, low // 100_000):
        middle = (low + high) // 2
        tried = pack(rest, middle, free)
        low, high, best = (low, middle, tried) if tried is not None else (middle, high, best)
    shift = len(alone)
    return alone + [(size, a + first[size], b + first[size], shift + number) for size, a, b, number in best]


def in_order(df: DataFrame, scratch: Scratch, name: str, *keys: Column) -> DataFrame:
    """Rows in the order of the keys, written as a table, with ``part`` and ``at``, the place in the part."""
    return scratch.keep(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), name)


def numbered(ordered: DataFrame, within: str) -> DataFrame:
    """``number``: gapless from 0 within each value of a column by which ``in_order`` sorted first.

    What meets in one task per value is a count for each part of the sort, not rows.
    """
    parts = ordered.groupBy(within, "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy(within).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = parts.select(within, "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return ordered.join(shift, [within, "part"]).withColumn("number", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def shard_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot); slots run from 0 in each shard, and copies of a text stand together."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.keep(docs.select(
        F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), text_key(F.col(text)).alias("key")), "shard-rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("total"))
    ranked = in_order(groups, scratch, "shard-groups", F.col("total").desc(), F.col("key"))
    runs = [(r["total"], r["n"]) for r in ranked.groupBy("total").agg(F.count(F.lit(1)).alias("n")).collect()]
    placed = spark.createDataFrame(equal_bins(runs, shards), "total long, low long, high long, shard int")
    number = numbered(ranked, "total")
    # A size has at most as many pieces as there are shards, so the join makes at most that many rows a group before the test.
    chosen = number.join(placed, "total").where((F.col("number") >= F.col("low")) & (F.col("number") < F.col("high"))).select("key", "shard")
    sharded = in_order(rows.join(chosen, "key"), scratch, "shard-slots", F.col("shard"), F.col("key"), F.col("doc_id"))
    result = Scratch(spark).keep(
        numbered(sharded, "shard").select("doc_id", "size", "text_crc32", "shard", F.col("number").alias("slot")), "shards")
    scratch.drop()
    return result
