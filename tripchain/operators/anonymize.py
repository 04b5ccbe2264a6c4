"""Masking of raw taps as the data owner does it before publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truncate(coordinate: Column, decimals: int = 3) -> Column:
    """Cut, not round, a decimal coordinate; towards zero."""
    scale = 10 ** decimals
    cut = F.when(coordinate < 0, F.ceil(coordinate * scale)).otherwise(F.floor(coordinate * scale))
    return (cut / F.lit(scale)).cast(f"decimal(9,{decimals})")


def mask(value: Column, salt: str) -> Column:
    """Salted digest; null stays null."""
    return F.sha2(F.concat(F.lit(salt), value.cast("string")), 256)


def anonymize(raw: DataFrame, salt: str, decimals: int = 3, time: str = "ts") -> DataFrame:
    """Mask card and vehicle, truncate coordinates, keep only the hour of the time."""
    return raw.withColumns({
        "id_tarjeta": mask(F.col("id_tarjeta"), salt),
        "interno_bus": mask(F.col("interno_bus"), salt),
        "lat": truncate(F.col("lat"), decimals),
        "lon": truncate(F.col("lon"), decimals),
        "hora": F.hour(time),
    }).drop(time)
