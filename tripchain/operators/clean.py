"""Row cleaning: service area, cards with one tap, canonical lines, double taps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripchain.config import BUS, METRO, TRAIN, Config
from tripchain.functions.geo import in_box
from tripchain.functions.hexgrid import with_cell
from tripchain.operators.chain import CARD
from tripchain.operators.skew import group_stats


def in_service_area(df: DataFrame, config: Config = Config()) -> DataFrame:
    return df.where(in_box(F.col("lon"), F.col("lat"), config))


def geo_clean(df: DataFrame, config: Config = Config()) -> DataFrame:
    """Keep taps inside the service area and add their cell."""
    return with_cell(in_service_area(df, config), config)


def drop_singles(df: DataFrame, card: Sequence[str] = CARD, spread: bool = False) -> DataFrame:
    """Drop the cards that have one row."""
    return group_stats(df, card, {"_rows": F.count("*")}, spread).where("_rows > 1").drop("_rows")


def normalize_line(df: DataFrame, lines: DataFrame) -> DataFrame:
    """Take the line from the branch table; taps of an unknown branch keep theirs."""
    canonical = (
        lines.where(F.col("id_ramal").isNotNull())
        .groupBy(F.col("id_ramal").alias("_ramal")).agg(
            F.min("id_linea").alias("_linea"), F.lit(True).alias("_known"))
    )
    return (
        df.join(canonical, F.col("id_ramal") == F.col("_ramal"), "left")
        .withColumn("id_linea", F.when(F.col("_known"), F.col("_linea")).otherwise(F.col("id_linea")))
        .drop("_ramal", "_linea", "_known")
    )


# Per mode: the columns whose repetition marks a double tap, and those by which rows are then
# deleted. The metro deletes by fewer than it detects.
DOUBLE_TAPS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    BUS: (("id_linea", "interno_bus", "hora", "etapa_red_sube"),) * 2,
    METRO: (("id_ramal", "hora", "etapa_red_sube", "lat", "lon"),
            ("id_ramal", "hora", "etapa_red_sube")),
    TRAIN: (("id_linea", "hora", "etapa_red_sube", "lat", "lon", "tipo_trx_tren"),) * 2,
}


def double_tap_groups(df: DataFrame, mode: str, card: Sequence[str] = CARD) -> DataFrame:
    """Values of the detection columns that more than one tap of the mode has, with the count."""
    return (
        df.where(F.col("modo") == mode).groupBy(*card, *DOUBLE_TAPS[mode][0])
        .agg(F.count("*").alias("taps")).where("taps > 1")
    )


def _all_known(keys: Sequence[str]) -> Column:
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return known


def double_tap_limits(df: DataFrame, mode: str, card: Sequence[str] = CARD,
                      spread: bool = False) -> DataFrame:
    """Add ``_last``: the id below which rows with the same deletion columns go, null where nothing
    goes. Unknown values never equal anything, so rows that have them neither delete nor go."""
    detect, delete = ([*card, *keys] for keys in DOUBLE_TAPS[mode])
    counts = {"_repeated": F.count_if(F.col("modo") == mode), "_top": F.max("id")}
    doubled = F.when((F.col("_repeated") > 1) & _all_known(detect), F.col("_top"))
    found = group_stats(df, detect, counts, spread).withColumn("_last", doubled).drop(*counts)
    if detect == delete:
        return found
    return group_stats(found.withColumnRenamed("_last", "_found"), delete,
                       {"_last": F.max("_found")}, spread).drop("_found")


def drop_double_taps(df: DataFrame, mode: str, card: Sequence[str] = CARD,
                     spread: bool = False) -> DataFrame:
    """Of taps of one card at the same place and hour keep the one with the highest id."""
    stays = F.col("_last").isNull() | (F.col("id") >= F.col("_last"))
    return double_tap_limits(df, mode, card, spread).where(stays).drop("_last")
