"""Trips and cards from finished stages. Plain aggregates: they combine map-side, so one card
or trip with many stages is no special case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripchain.config import BUS, METRO, TRAIN
from tripchain.operators.chain import CARD


def _stage_order() -> Column:
    """(id_etapa, hora, id) packed into one number, unknown values last: sixteen, two and twenty digits.

    Numbers up to 38 digits have a fixed width, so aggregates that order by one stay in the hash aggregate. Holds for stages below
    10^16 and hours from 0 to 98.
    """
    return F.expr(
        "cast(coalesce(cast(id_etapa AS decimal(16,0)), 9999999999999999BD) * 100 + coalesce(cast(hora AS decimal(2,0)), 99BD) AS decimal(18,0))"
        " * 100000000000000000000BD + (9223372036854775808BD + id)")


def _sex_code(sex: str = "sexo") -> Column:
    """A known sex as a number of fixed width; ``sex_names`` has the texts."""
    return F.when(F.col(sex) != "", F.xxhash64(sex))


def sex_names(stages: DataFrame) -> DataFrame:
    """(code, sexo): the few texts that occur."""
    return stages.where(F.col("sexo") != "").select(_sex_code().alias("_code"), "sexo").distinct()


def trips_with_sex(stages: DataFrame, card: Sequence[str] = CARD) -> DataFrame:
    """The trips table plus the lowest and highest code of the sexes recorded on the trip's stages."""
    order = _stage_order()
    of_mode = lambda mode: F.count_if(F.col("modo") == mode)
    sex = _sex_code()
    return stages.groupBy(*card, "id_viaje").agg(
        F.count_distinct("id_etapa").alias("cantidad_etapas"),
        of_mode(METRO).alias("etapas_subte"),
        of_mode(TRAIN).alias("etapas_tren"),
        of_mode(BUS).alias("etapas_colectivo"),
        F.min_by("parada_id_o", order).alias("parada_id_o"),
        # The last stage counts, with a destination or without.
        F.max_by("parada_id_d", order).alias("parada_id_d"),
        F.min_by("hora", order).alias("hora"),
        # A trip without an id is never marked.
        (F.col("id_viaje").isNotNull() & F.bool_or(F.col("parada_id_d").isNull())).alias("etapas_incompletas"),
        F.min(sex).alias("_sexo_min"),
        F.max(sex).alias("_sexo_max"),
    )


def build_trips(stages: DataFrame, card: Sequence[str] = CARD) -> DataFrame:
    return trips_with_sex(stages, card).drop("_sexo_min", "_sexo_max")


def card_sex(stages: DataFrame, card: Sequence[str] = CARD) -> DataFrame:
    """The sex of the cards that have exactly one on record."""
    code = _sex_code()
    found = (
        stages.where(F.col("sexo") != "").groupBy(*card).agg(F.min(code).alias("_code"), F.max(code).alias("_other"))
        .where(F.col("_code") == F.col("_other")).drop("_other")
    )
    return found.join(sex_names(stages), "_code").drop("_code").select(*card, "sexo")


def cards_from_trips(trips: DataFrame, names: DataFrame, card: Sequence[str] = CARD) -> DataFrame:
    """Cards from ``trips_with_sex`` and ``sex_names``: home is the origin of the first trip, one without an id coming last."""
    low, high = F.min("_sexo_min"), F.max("_sexo_max")
    return trips.groupBy(*card).agg(
        F.min_by("parada_id_o", F.coalesce("id_viaje", F.lit(2**63 - 1))).alias("parada_hogar"),
        F.when(low == high, low).alias("_code"),
        F.bool_or("etapas_incompletas").alias("viajes_con_etapas_incompletas"),
    ).join(names, "_code", "left").select(*card, "parada_hogar", "sexo", "viajes_con_etapas_incompletas")


def build_cards(stages: DataFrame, card: Sequence[str] = CARD) -> DataFrame:
    return cards_from_trips(trips_with_sex(stages, card), sex_names(stages), card)
