"""Per-card work that survives cards with any number of rows.

Almost all cards have a handful of taps a day, and a window per card in one task is the
cheapest plan there is. A placeholder card can hold a third of the table, and then the same
window is one endless task. So cards above ``Config.hot_rows`` are split off, and every
operator takes ``spread``: False means plain windows, True means the same result from
aggregates that combine map-side, joins back (left to AQE to broadcast or to split) and
ranks by blocks of bounded size. No row is dropped on either path.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripchain.config import Config
from tripchain.session import settle

# Ids are unique integers, so one block of ids holds at most this many rows.
BLOCK_BITS = 20


@dataclass(frozen=True)
class Cards:
    """Rows of ordinary cards, and rows of hot cards where there are any."""

    cold: DataFrame
    hot: DataFrame | None = None
    #: Partitions for the rows of ordinary cards, by their counted number.
    parts: int = 1

    def apply(self, step: Callable[..., DataFrame], *args, cut: bool = False, **kwargs) -> "Cards":
        """Run a step on both parts; ``cut`` ends the hot part's lineage after it."""
        cold = step(self.cold, *args, spread=False, **kwargs)
        if self.hot is None:
            return replace(self, cold=cold)
        hot = step(self.hot, *args, spread=True, **kwargs)
        return replace(self, cold=cold, hot=settle(hot, "hot") if cut else hot)

    def map(self, step: Callable[..., DataFrame], *args, **kwargs) -> "Cards":
        """Run a row-wise step, the same on both parts."""
        return replace(self, cold=step(self.cold, *args, **kwargs),
                       hot=None if self.hot is None else step(self.hot, *args, **kwargs))

    def gather(self, card: Sequence[str]) -> "Cards":
        """The one exchange by card. A task sorts its rows for many windows, all in memory at once, so their number has a bound
        that neither the size of the input nor a coalescing of partitions by their compressed bytes moves."""
        return replace(self, cold=self.cold.repartition(self.parts, *card))

    def union(self) -> DataFrame:
        return self.cold if self.hot is None else self.cold.unionByName(self.hot)


def split_hot(df: DataFrame, config: Config = Config()) -> Cards:
    """Split off the cards with more than ``hot_rows`` rows.

    Keeps a count per card, which combines map-side. The list of hot cards has at
    most rows / hot_rows entries. Its real size decides whether it is broadcast.
    """
    card = list(config.card_keys)
    counts = settle(df.groupBy(*card).agg(F.count("*").alias("_n")), "card-counts")
    is_hot = F.col("_n") > config.hot_rows
    found, rows = counts.agg(F.count_if(is_hot), F.sum(F.when(~is_hot, F.col("_n")))).first()
    parts = parts_for(df, rows or 0, config.task_rows)
    if found == 0:
        return Cards(df, parts=parts)
    hot_cards = counts.where(is_hot).select(*card)
    if found <= config.hot_broadcast:
        hot_cards = F.broadcast(hot_cards)
    return Cards(df.join(hot_cards, card, "left_anti"),
                 settle(df.join(hot_cards, card, "left_semi"), "hot"), parts)


def parts_for(df: DataFrame, rows: int, task_rows: int) -> int:
    """Partitions of at most about ``task_rows`` rows; a small table still uses all cores."""
    spark = df.sparkSession
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(1, least, -(-rows // task_rows))


def join_back(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a table with one row per key to the rows; null keys match each other."""
    renamed = table.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    match = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        match = same if match is None else match & same
    return df.join(renamed, match, how).drop(*[f"_k_{k}" for k in keys])


def group_stats(df: DataFrame, keys: Sequence[str], stats: dict[str, Column],
                spread: bool = False) -> DataFrame:
    """Add aggregates over the rows with the same keys (nulls are one group)."""
    if not spread:
        window = W.partitionBy(*keys)
        return df.withColumns({name: value.over(window) for name, value in stats.items()})
    table = df.groupBy(*keys).agg(*[value.alias(name) for name, value in stats.items()])
    return join_back(df, table, keys)


def rank_rows(df: DataFrame, keys: Sequence[str], order: dict[str, Column], out: str,
              id_col: str = "id", coarse: dict[str, Column] | None = None,
              spread: bool = False) -> DataFrame:
    """Add the 1-based position of each row among those with the same keys.

    ``order`` maps columns to their sort expressions; ``id_col`` comes last and makes it total.
    The spread form counts rows per (keys, order values, block of ids) and adds the counts before
    to the position inside the block. ``coarse`` names leading order columns with
    few values, whose counts are summed up first so that no window sees every block of a card.
    """
    coarse = coarse or {}
    if not spread:
        # Coarse columns come from order columns, which sort the same way without them.
        window = W.partitionBy(*keys).orderBy(*order.values(), F.col(id_col).asc())
        return df.withColumn(out, F.row_number().over(window).cast("long"))

    blocked = df.withColumn("_block", F.shiftright(F.col(id_col), BLOCK_BITS))
    parts = list(dict.fromkeys([*keys, *coarse, *order, "_block"]))
    before = lambda w: F.coalesce(
        F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = blocked.groupBy(*parts).agg(F.count("*").alias("_n"))
    fine = W.partitionBy(*keys, *coarse).orderBy(*order.values(), F.col("_block").asc())
    offsets = counts.withColumn("_before", before(fine)).drop("_n")
    if coarse:
        leading = W.partitionBy(*keys).orderBy(*coarse.values())
        leading_counts = (
            counts.groupBy(*keys, *coarse).agg(F.sum("_n").alias("_n"))
            .withColumn("_lead_before", before(leading)).drop("_n")
        )
        offsets = join_back(offsets, leading_counts, [*keys, *coarse]).withColumn(
            "_before", F.col("_before") + F.col("_lead_before")).drop("_lead_before")
    inside = W.partitionBy(*parts).orderBy(F.col(id_col).asc())
    return (
        join_back(blocked, offsets, parts)
        .withColumn(out, F.col("_before") + F.row_number().over(inside))
        .drop("_before", "_block")
    )


def neighbour(table: DataFrame, keys: Sequence[str], value: str, carry: Sequence[str],
              out: str, forward: bool) -> DataFrame:
    """Add the struct (value, *carry) of the next or previous ``value`` under the same keys.

    ``table`` has one row per (keys, value) with an integer, non-null value. Works block by block:
    inside a block by a window, across blocks by the first or last entry of each.
    """
    entry = F.struct(value, *carry)
    sort = F.col(value).asc() if forward else F.col(value).desc()
    edge_sort = F.col("_block").asc() if forward else F.col("_block").desc()
    edge = F.min(entry) if forward else F.max(entry)
    blocked = table.withColumn("_block", F.shiftright(F.col(value), BLOCK_BITS))
    edges = (
        blocked.groupBy(*keys, "_block").agg(edge.alias("_edge"))
        .withColumn("_over", F.lead("_edge").over(W.partitionBy(*keys).orderBy(edge_sort)))
        .drop("_edge")
    )
    inside = F.lead(entry).over(W.partitionBy(*keys, "_block").orderBy(sort))
    return (
        join_back(blocked.withColumn("_inside", inside), edges, [*keys, "_block"])
        .withColumn(out, F.coalesce("_inside", "_over"))
        .drop("_inside", "_over", "_block")
    )
