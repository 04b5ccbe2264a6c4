"""Destination stops from the card's next tap, round the day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripchain.config import Config
from tripchain.operators.chain import CARD, is_boarding
from tripchain.operators.nearest import attach
from tripchain.operators.skew import BLOCK_BITS, group_stats, join_back, rank_rows
from tripchain.session import settle

DAY_ORDER = ("id_viaje", "id_etapa", "tipo_trx_tren")


def next_trx(df: DataFrame, card: Sequence[str] = CARD, spread: bool = False) -> DataFrame:
    """Add ``fila`` (position in the card's day) and ``next`` (id, lon, lat of the next tap).
    The next of the last is the first of the day. Check-outs count as taps."""
    order = {c: F.col(c).asc_nulls_last() for c in DAY_ORDER}
    tap = F.struct("id", "lon", "lat")
    if not spread:
        window = W.partitionBy(*card).orderBy(*order.values(), F.col("id").asc())
        following = F.coalesce(F.lead(tap).over(window), F.first(tap).over(window))
        return df.withColumns({"fila": F.row_number().over(window).cast("long"), "next": following})
    placed = settle(rank_rows(
        df.withColumn("_stages", F.shiftright("id_etapa", BLOCK_BITS)), card, order, "fila",
        coarse={"id_viaje": order["id_viaje"], "_stages": F.col("_stages").asc_nulls_last()},
        spread=True).drop("_stages"), "placed")
    last = placed.groupBy(*card).agg(F.max("fila").alias("_last"))
    # A tap's place in the day is unique, so this join has no hot key.
    follower = join_back(placed.select(*card, "fila", tap.alias("next")), last, card).select(
        *card, F.when(F.col("fila") == 1, F.col("_last")).otherwise(F.col("fila") - 1).alias("fila"), "next")
    return placed.join(follower, [*card, "fila"])


def asked_pairs(linked: DataFrame) -> DataFrame:
    """(line, lon, lat): boardings' lines at the places of their next taps, each pair once."""
    return linked.where(is_boarding()).select(
        F.col("id_linea").alias("line"), F.col("next.lon").alias("lon"), F.col("next.lat").alias("lat")).distinct()


def impute_destination(df: DataFrame, lookup: DataFrame, config: Config = Config(),
                       card: Sequence[str] = CARD, spread: bool = False) -> DataFrame:
    """Add parada_id_d to rows that have ``next``: the stop of the row's line nearest to the next tap.

    One row per stage gets a destination, chosen by kind, distance and id among the boardings that
    have a candidate; the cut by distance comes after that choice.
    """
    key = {"_line": F.col("id_linea"), "_lon": F.col("next.lon"), "_lat": F.col("next.lat")}
    stop = lookup.select(
        F.col("line").alias("_line"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), "stop", "stop_dist")
    candidates = attach(df.withColumns(key), stop, list(key), config.broadcast_lookup).drop(*key)
    entry = F.struct(
        F.col("tipo_trx_tren").isNull().alias("unknown"),
        F.col("tipo_trx_tren").alias("kind"),
        F.col("stop_dist"), F.col("id"))
    choice = F.min(F.when(is_boarding() & F.col("stop").isNotNull(), entry))
    chosen = (F.col("_choice.id") == F.col("id")) & (F.col("stop_dist") <= config.destination_cells)
    return (
        group_stats(candidates, [*card, "id_viaje", "id_etapa"], {"_choice": choice}, spread)
        .withColumn("parada_id_d", F.when(chosen, F.col("stop")))
        .drop("_choice", "stop", "stop_dist")
    )


def drop_checkouts(df: DataFrame) -> DataFrame:
    """Check-outs are ends of stages, not stages."""
    return df.where(is_boarding())


def coverage(stages: DataFrame) -> DataFrame:
    """How many stages have a destination."""
    return stages.agg(
        F.count("*").alias("etapas"), F.count("parada_id_d").alias("etapas_con_destino"))
