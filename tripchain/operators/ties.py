"""Order for taps that share a stage id because nothing in the data orders them.

Three passes, each on the result of the last: by distance to the next stage, by distance from
the previous one, and by id where a card has neither. Passes only ever count a stage id down,
into the gap that the peers of the running count have left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripchain.config import Config
from tripchain.functions.hexgrid import distance
from tripchain.operators.chain import CARD, is_boarding
from tripchain.operators.nearest_cells import nearest_cells
from tripchain.operators.skew import group_stats, join_back, neighbour, rank_rows

STAGE = "id_etapa"


def _tied_count(config: Config) -> Column:
    return F.count_if(F.col("modo").isin(*config.tied_modes))


def _is_tied() -> Column:
    return F.col(STAGE).isNotNull() & (F.col("_tied") > 1)


def tied_groups(df: DataFrame, config: Config = Config(), card: Sequence[str] = CARD) -> DataFrame:
    """Stages that more than one tap of a tied mode shares, with the number of those taps."""
    return (
        df.where(F.col("modo").isin(*config.tied_modes) & F.col(STAGE).isNotNull())
        .groupBy(*card, STAGE).agg(F.count("*").alias("taps")).where("taps > 1")
    )


def _count_down(df: DataFrame, moves: Column, card: Sequence[str], order: dict[str, Column],
                spread: bool) -> DataFrame:
    """Stage id minus (rank - 1) for the rows where ``moves`` holds. The rows of a stage where it
    does not hold must come last in the order."""
    flagged = df.withColumn("_moves", F.coalesce(moves, F.lit(False)))
    keys = [*card, STAGE]
    step = F.col(STAGE) - F.col("_rank") + 1
    if not spread:
        return (
            rank_rows(flagged, keys, order, "_rank")
            .withColumn(STAGE, F.when(F.col("_moves"), step).otherwise(F.col(STAGE)))
            .drop("_moves", "_rank")
        )
    # Counts per distance are summed up first: no window sees all id blocks of a stage.
    moved = rank_rows(flagged.where("_moves"), keys, order, "_rank", coarse=order, spread=True)
    return (
        moved.withColumn(STAGE, step).drop("_moves", "_rank")
        .unionByName(flagged.where("not _moves").drop("_moves"))
    )


def order_by_next(df: DataFrame, config: Config = Config(), card: Sequence[str] = CARD,
                  spread: bool = False) -> DataFrame:
    """Boardings of a tied stage: the nearer to a boarding of the next stage, the later."""
    added = ["_tied", "_dist"]
    ranked = _with_next_distance_spread(df, config, card) if spread else _with_next_distance(df, config, card)
    moves = _is_tied() & F.col("_dist").isNotNull()
    return _count_down(ranked, moves, card, {"_dist": F.col("_dist").asc_nulls_last()}, spread).drop(*added)


def _with_next_distance(df: DataFrame, config: Config, card: Sequence[str]) -> DataFrame:
    here = F.collect_set(F.when(is_boarding(), F.struct("cell_q", "cell_r")))
    stats = group_stats(df, [*card, STAGE], {"_tied": _tied_count(config), "_here": here})
    # From the highest stage down, the last row of the growing frame belongs to the next stage.
    later = (
        W.partitionBy(*card).orderBy(F.col(STAGE).desc_nulls_last())
        .rangeBetween(W.unboundedPreceding, -1)
    )
    steps = distance("cell_q", "cell_r", "c.cell_q", "c.cell_r")
    best = F.expr(f"array_min(transform(_next, c -> {steps}))")
    return (
        stats.withColumn("_next", F.last("_here").over(later))
        .withColumn("_dist", F.when(_is_tied() & is_boarding(), best))
        .drop("_here", "_next")
    )


def _with_next_distance_spread(df: DataFrame, config: Config, card: Sequence[str]) -> DataFrame:
    stages = df.where(F.col(STAGE).isNotNull()).groupBy(*card, STAGE).agg(_tied_count(config).alias("_tied"))
    paired = (
        neighbour(stages, card, STAGE, [], "_next", forward=True)
        .where(_is_tied() & F.col("_next").isNotNull())
        .select(*card, STAGE, F.col(f"_next.{STAGE}").alias("_next_stage"))
    )
    cells = df.where(is_boarding()).groupBy(*card, STAGE, "cell_q", "cell_r").agg(F.count("*").alias("_n"))
    keys = [*card, STAGE]
    members = join_back(cells, paired, keys, "inner").select(*keys, "cell_q", "cell_r")
    targets = join_back(
        cells.drop("_n").withColumnRenamed(STAGE, "_next_stage"), paired,
        [*card, "_next_stage"], "inner").select(*keys, "cell_q", "cell_r")
    found = nearest_cells(members, targets, keys)
    with_tied = join_back(df, stages, keys)
    return join_back(with_tied, found, [*keys, "cell_q", "cell_r"]).withColumn(
        "_dist", F.when(is_boarding(), F.col("_dist")))


def order_by_previous(df: DataFrame, config: Config = Config(), card: Sequence[str] = CARD,
                      spread: bool = False) -> DataFrame:
    """Taps of a tied stage: the farther from the tap before, the later the stage stays.

    The tap that stands for the previous stage is the first by kind descending (unknown kind
    first) and id.
    """
    stats = {
        "_tied": _tied_count(config),
        "_seat": F.max(F.struct(
            F.col("tipo_trx_tren").isNull().alias("unknown"),
            F.col("tipo_trx_tren").alias("kind"),
            (-F.col("id")).alias("neg_id"),
            "cell_q", "cell_r")),
    }
    if spread:
        stages = df.where(F.col(STAGE).isNotNull()).groupBy(*card, STAGE).agg(
            *[value.alias(name) for name, value in stats.items()])
        previous = neighbour(
            stages.withColumns({"cell_q": F.col("_seat.cell_q"), "cell_r": F.col("_seat.cell_r")}),
            card, STAGE, ["cell_q", "cell_r"], "_previous", forward=False)
        linked = join_back(
            df, previous.select(*card, STAGE, "_tied", "_previous"), [*card, STAGE])
    else:
        # Same sort as the window per stage; a seat without a stage is no previous stage.
        earlier = (
            W.partitionBy(*card).orderBy(F.col(STAGE).asc_nulls_first())
            .rangeBetween(W.unboundedPreceding, -1)
        )
        linked = (
            group_stats(df, [*card, STAGE], stats)
            .withColumn("_previous", F.last(F.when(F.col(STAGE).isNotNull(), F.col("_seat"))).over(earlier)).drop("_seat")
        )
    moves = _is_tied() & F.col("_previous").isNotNull()
    to_previous = distance("cell_q", "cell_r", "_previous.cell_q", "_previous.cell_r")
    measured = linked.withColumn("_dist", F.when(moves, F.expr(to_previous))).drop("_previous")
    return _count_down(measured, F.col("_dist").isNotNull(), card,
                       {"_dist": F.col("_dist").desc()}, spread).drop("_tied", "_dist")


def order_by_id(df: DataFrame, config: Config = Config(), card: Sequence[str] = CARD,
                spread: bool = False) -> DataFrame:
    """Taps that are still tied: the lowest id keeps the stage."""
    keys = [*card, STAGE]
    if not spread:
        # The rank's sort serves the count too.
        ranked = rank_rows(df, keys, {}, "_rank")
        counted = group_stats(ranked, keys, {"_tied": _tied_count(config)})
        step = F.when(_is_tied(), F.col(STAGE) - F.col("_rank") + 1).otherwise(F.col(STAGE))
        return counted.withColumn(STAGE, step).drop("_rank", "_tied")
    counted = group_stats(df, keys, {"_tied": _tied_count(config)}, spread=True)
    return _count_down(counted, _is_tied(), card, {}, spread=True).drop("_tied")
