"""Stage and trip ids from taps that carry an hour but no minute."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripchain.config import CHECK_IN, CHECK_OUT, CHECK_OUT_ALONE
from tripchain.operators.skew import join_back

CARD = ("id_tarjeta",)
# Nulls come last in ascending order throughout.
TAP_ORDER = ("hora", "etapa_red_sube", "tipo_trx_tren")


def is_boarding(kind: str = "tipo_trx_tren") -> Column:
    return ~F.col(kind).eqNullSafe(F.lit(CHECK_OUT))


def base_stages(trx: DataFrame, card: Sequence[str] = CARD) -> DataFrame:
    """Taps with a card, without check-outs that lack their check-in."""
    keep = ~F.col("tipo_trx_tren").eqNullSafe(F.lit(CHECK_OUT_ALONE))
    for key in card:
        keep = keep & F.col(key).isNotNull()
    return trx.where(keep)


def _weight(df: DataFrame) -> Column:
    return F.col("_weight") if "_weight" in df.columns else F.lit(1)


def stage_ids(df: DataFrame, card: Sequence[str] = CARD, order: Sequence[str] = TAP_ORDER) -> DataFrame:
    """id_etapa: boardings of the card so far. Taps that the order cannot tell apart are
    peers and all get the count at the end of the peers (a RANGE frame)."""
    window = W.partitionBy(*card).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    boardings = F.when(is_boarding(), _weight(df)).otherwise(0)
    return df.withColumn("id_etapa", F.sum(boardings).over(window).cast("long"))


def trip_temp_id(df: DataFrame) -> DataFrame:
    """The stage id minus the position in the integrated fare is constant within a trip."""
    return df.withColumn("id_viaje_temp", (F.col("id_etapa") - F.col("etapa_red_sube")).cast("long"))


def checkout_only(df: DataFrame, card: Sequence[str] = CARD) -> DataFrame:
    """Flag the rows of trips that hold nothing but check-outs."""
    weight = _weight(df)
    window = W.partitionBy(*card, "id_viaje_temp")
    boardings = F.sum(F.when(is_boarding(), weight).otherwise(0)).over(window)
    return df.withColumn("solo_checkout", boardings == 0)


def checkout_targets(df: DataFrame, card: Sequence[str] = CARD) -> DataFrame:
    """viaje_target and etapa_target: the previous trip of the card, and the latest check-in
    stage of any trip before. A RANGE frame over strictly smaller trips in place of a self-join."""
    # Same sort as the windows per trip. It puts unknown trips into every frame, where they must not
    # count.
    earlier = (
        W.partitionBy(*card).orderBy(F.col("id_viaje_temp").asc_nulls_first())
        .rangeBetween(W.unboundedPreceding, -1)
    )
    known = F.col("id_viaje_temp").isNotNull()
    check_in = F.when(known & (F.col("tipo_trx_tren") == CHECK_IN), F.col("id_etapa"))
    return df.withColumns({
        "viaje_target": F.when(known, F.max("id_viaje_temp").over(earlier)),
        "etapa_target": F.when(known, F.max(check_in).over(earlier)),
    })


def repair_checkouts(df: DataFrame, card: Sequence[str] = CARD) -> DataFrame:
    """Move check-outs that ended up in a trip of their own back to the trip before.

    One pass on one snapshot: a target that moves itself is not followed, and a trip with
    nothing before it loses its ids.
    """
    moved = F.col("solo_checkout") & F.col("id_viaje_temp").isNotNull()
    return (
        checkout_targets(checkout_only(df, card), card)
        .withColumns({
            "id_etapa": F.when(moved, F.col("etapa_target")).otherwise(F.col("id_etapa")),
            "id_viaje_temp": F.when(moved, F.col("viaje_target")).otherwise(F.col("id_viaje_temp")),
        })
        .drop("solo_checkout", "viaje_target", "etapa_target")
    )


def trip_ids(df: DataFrame, card: Sequence[str] = CARD) -> DataFrame:
    """id_viaje: 1, 2, … over the trips of a card, null where the trip is unknown."""
    window = W.partitionBy(*card).orderBy(F.col("id_viaje_temp").asc_nulls_last())
    return df.withColumn(
        "id_viaje",
        F.when(F.col("id_viaje_temp").isNotNull(), F.dense_rank().over(window).cast("long")),
    )


def on_values(df: DataFrame, step: Callable[[DataFrame, Sequence[str]], DataFrame], card: Sequence[str] = CARD) -> DataFrame:
    """Run a step once per distinct value of the order columns, with the number of taps as weight, and give its columns to the taps.

    A card has a few hundred such values at most, however many taps it has.
    """
    keys = [*card, *TAP_ORDER]
    groups = df.groupBy(*keys).agg(F.count("*").alias("_weight"))
    return join_back(df, step(groups, card).drop("_weight"), keys)


def chain(df: DataFrame, card: Sequence[str] = CARD, spread: bool = False) -> DataFrame:
    """Stage ids, check-out repair and trip ids in one go.

    All of them depend on a tap only through its order columns, so the spread form computes
    them once per distinct value of those.
    """
    if spread:
        return on_values(df, chain, card)
    return df.transform(stage_ids, card).transform(trip_temp_id) \
        .transform(repair_checkouts, card).transform(trip_ids, card).drop("id_viaje_temp")
