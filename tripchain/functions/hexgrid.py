"""Hexagonal grid cells as two axial columns (q, r), and the distance between cells.

The planar grid is plain column arithmetic. Its cells differ from H3 cells at the borders.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripchain.config import Config

# Local equirectangular plane, metres per degree at the origin.
LON0, LAT0 = -58.5, -34.6
M_PER_LON, M_PER_LAT = 91637.0, 111195.0


def _with_planar_cell(df: DataFrame, lon: str, lat: str, q: str, r: str, side: float) -> DataFrame:
    """Axial coordinates of the hexagon that holds a point; null for a null point.

    Rounds the three cube coordinates half up and corrects the one that moved the most.
    """
    x = f"(cast({lon} AS double) - ({LON0}D)) * {M_PER_LON}D"
    y = f"(cast({lat} AS double) - ({LAT0}D)) * {M_PER_LAT}D"
    return (
        df.selectExpr("*", f"({x} / sqrt(3.0D) - {y} / 3.0D) / {float(side)}D AS _q",
                      f"({y} * 2.0D / 3.0D) / {float(side)}D AS _r")
        .selectExpr("*", "floor(_q + 0.5D) AS _rq", "floor(_r + 0.5D) AS _rr", "floor(-_q - _r + 0.5D) AS _rs")
        .selectExpr("*", "abs(_rq - _q) AS _dq", "abs(_rr - _r) AS _dr", "abs(_rs + _q + _r) AS _ds")
        .selectExpr("*", f"CASE WHEN _dq > _dr AND _dq > _ds THEN -_rr - _rs ELSE _rq END AS {q}",
                    "CASE WHEN (_dq > _dr AND _dq > _ds) OR _dr <= _ds THEN _rr "
                    f"ELSE -_rq - _rs END AS {r}")
        .drop("_q", "_r", "_rq", "_rr", "_rs", "_dq", "_dr", "_ds")
    )


def with_cell(df: DataFrame, config: Config = Config(), lon: str = "lon", lat: str = "lat",
              q: str = "cell_q", r: str = "cell_r") -> DataFrame:
    """Add the cell of a point as the columns ``q`` and ``r``."""
    return _with_planar_cell(df, lon, lat, q, r, config.hex_side_m)


def distance(q1: str, r1: str, q2: str, r2: str) -> str:
    """Steps between two cells through adjacent cells, as a SQL expression."""
    dq, dr = f"({q1} - {q2})", f"({r1} - {r2})"
    return f"greatest(abs({dq}), abs({dr}), abs({dq} + {dr}))"
