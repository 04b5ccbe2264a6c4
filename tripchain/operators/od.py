"""Geography of stages and trips, and origin-destination counts."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GEOGRAPHY = ("h3", "radio_2010", "depto_2010", "departamento", "provincia")


def stop_geography(stops: DataFrame, cells: DataFrame) -> DataFrame:
    """Each stop with its cell and the census geography of the cell, where known."""
    return stops.select("id", "h3").join(cells.select(*GEOGRAPHY), "h3", "left")


def georeference(od: DataFrame, stops: DataFrame, cells: DataFrame) -> DataFrame:
    """Add the geography of the origin stop (suffix _o) and of the destination stop (_d)."""
    places = stop_geography(stops, cells)
    for end in ("o", "d"):
        named = places.withColumnsRenamed({c: f"{c}_{end}" for c in ("id", *GEOGRAPHY)})
        od = od.join(named, F.col(f"parada_id_{end}") == F.col(f"id_{end}"), "left").drop(f"id_{end}")
    return od


def od_matrix(od: DataFrame, level: str = "departamento", by: Sequence[str] = ()) -> DataFrame:
    """Rows per origin and destination at a level of ``GEOGRAPHY``, or per stop with
    ``level="parada_id"``. Rows without a destination count under null."""
    return od.groupBy(f"{level}_o", f"{level}_d", *by).agg(F.count("*").alias("cantidad"))


def od_rollup(od: DataFrame, levels: Sequence[str] = ("departamento", "provincia"), by: Sequence[str] = (),
              crossed: bool = False) -> DataFrame:
    """Rows per origin and destination at several levels at once, from the first level, the finest, to all places together.

    Both ends are taken at one level, or with ``crossed`` each at every level of its own. ``nivel_o`` and ``nivel_d`` name the level
    ("todo" for all), so that an unknown name is not taken for a sum over names; a name of a finer level counts under the coarser
    names it comes with. One Expand and one aggregate, which combines map-side, whatever the number of levels.
    """
    depths = range(len(levels) + 1)
    ends = {end: [f"{level}_{end}" for level in levels] for end in ("o", "d")}
    sets = [[*ends["o"][i:], *ends["d"][j:], *by] for i, j in (product(depths, depths) if crossed else zip(depths, depths))]
    names = F.array(*[F.lit(level) for level in (*levels, "todo")])
    summed = {end: reduce(lambda a, b: a + b, [F.grouping(c).cast("int") for c in columns]) for end, columns in ends.items()}
    counted = od.groupingSets(sets, *ends["o"], *ends["d"], *by).agg(
        F.count("*").alias("cantidad"), *[total.alias(f"_{end}") for end, total in summed.items()])
    return counted.withColumns({f"nivel_{end}": names[F.col(f"_{end}")] for end in ends}).drop("_o", "_d")
