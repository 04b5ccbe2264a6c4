"""Point predicates and binning in degrees."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points this close to the border of a buffer (in degrees) count as on it, and so as inside.
BORDER = 1e-9


def in_box(lon: Column, lat: Column, config) -> Column:
    """Inside the service area, bounds included; null where a coordinate is.

    Decimal bounds compare without a cast of the column, so a scan can push them down.
    """
    south, north, west, east = (
        F.lit(Decimal(str(b))) for b in (config.lat_min, config.lat_max, config.lon_min, config.lon_max))
    return lat.between(south, north) & lon.between(west, east)


def point_in_buffer(lon: str, lat: str, center_lon: str, center_lat: str,
                    radius: float = 0.03, quad_segs: int = 8) -> Column:
    """Inside the regular polygon of ``4 * quad_segs`` corners that stands for a round
    buffer, one corner due east. Takes SQL expressions. Only points between the inner and the
    outer circle of the polygon need the trigonometry.
    """
    dx, dy = f"(double({lon}) - double({center_lon}))", f"(double({lat}) - double({center_lat}))"
    squared = f"({dx} * {dx} + {dy} * {dy})"
    wedge = math.pi / (2 * quad_segs)
    inner = radius * math.cos(wedge / 2)
    # Distance along the normal of the polygon side that faces the point.
    along = f"sqrt({squared}) * cos(pmod(atan2({dy}, {dx}), {wedge}D) - {wedge / 2}D)"
    return F.expr(
        f"CASE WHEN {squared} > {(radius + 2 * BORDER) ** 2}D THEN false "
        f"WHEN {squared} < {inner ** 2}D THEN true "
        f"ELSE {along} <= {inner + BORDER}D END")


def _bin(column: str, width: float) -> str:
    """Bins are a hundredth wider than the reach, so that rounding cannot put two points exactly that far apart two bins apart."""
    return f"floor(cast({column} AS double) / {width * 1.01}D)"


def with_bin(df: DataFrame, lon: str, lat: str, width: float) -> DataFrame:
    """Square bin of a point."""
    return df.selectExpr("*", f"{_bin(lon, width)} AS bin_x", f"{_bin(lat, width)} AS bin_y")


def with_near_bins(df: DataFrame, lon: str, lat: str, width: float) -> DataFrame:
    """One row per bin that can hold something within ``width`` of the point."""
    return (
        df.selectExpr("*", "explode(sequence(-1L, 1L)) AS _dx")
        .selectExpr("*", "explode(sequence(-1L, 1L)) AS _dy")
        .selectExpr("*", f"{_bin(lon, width)} + _dx AS bin_x", f"{_bin(lat, width)} + _dy AS bin_y")
        .drop("_dx", "_dy")
    )
