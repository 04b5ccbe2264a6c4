"""Distance from each cell of one set to the nearest cell of another, within groups.

Used for the stages of hot cards only. Both sides are distinct cells, cut into bands of grid rows; a task holds one band of members and one band of
targets, which the width of the service area bounds, and no pair of cells is ever emitted. A member is compared with the bands round its own. What
lies beyond is at least as far as the rows between, so most members are settled at once, and only the others look at bands further out, twice as far
each time.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripchain.operators.skew import join_back
from tripchain.session import settle

# Send the search to the workers with the query: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BAND_ROWS = 64
_ROW_STRIDE = np.int64(1) << 32


def hex_distance_to_set(q: np.ndarray, r: np.ndarray, set_q: np.ndarray, set_r: np.ndarray) -> np.ndarray:
    """Smallest hex distance from each (q, r) to the set.

    Walks grid rows outwards. In the row at offset d, cells of a whole interval of q are |d| steps
    away and each step outside it costs one more, so one binary search per row is enough.
    A point is done once the row offset reaches its best distance.
    """
    keys = np.sort(set_r * _ROW_STRIDE + set_q)
    dq, dr = q - set_q[0], r - set_r[0]
    best = np.maximum(np.maximum(np.abs(dq), np.abs(dr)), np.abs(dq + dr))
    offset = 0
    while True:
        open_points = np.flatnonzero(best > offset)
        if open_points.size == 0:
            return best
        for d in {offset, -offset}:
            low = q[open_points] - max(d, 0)
            high = q[open_points] + max(-d, 0)
            base = (r[open_points] + d) * _ROW_STRIDE
            at = np.searchsorted(keys, base + low)
            right = keys[np.minimum(at, keys.size - 1)] - base
            left = keys[np.maximum(at - 1, 0)] - base
            # A key of another row is at least half a stride away, and so never the minimum.
            cost = np.minimum(
                np.where(right >= low, np.maximum(right - high, 0), _ROW_STRIDE),
                np.where(left < low, low - left, _ROW_STRIDE))
            best[open_points] = np.minimum(best[open_points], cost + abs(d))
        offset += 1


def _compared(asked: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, cell_q, cell_r, _dist): per member and band that it asks (``_other``) the distance to the nearest target of the band."""
    pairs = asked.select(*keys, "_band", "_other").distinct()
    copies = join_back(targets.withColumnRenamed("_band", "_other"), pairs, [*keys, "_other"], "inner")
    # Both sides may come from one table; fresh names tell their columns apart.
    copies = copies.select(*[F.col(c).alias(c) for c in copies.columns])
    names = [*keys, "cell_q", "cell_r", "_dist"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame(columns=names)
        found = hex_distance_to_set(*(
            side[c].to_numpy(np.int64) for side in (left, right) for c in ("cell_q", "cell_r")))
        return left[[*keys, "cell_q", "cell_r"]].assign(_dist=found)

    schema = asked.select(*keys, "cell_q", "cell_r", F.lit(0).cast("long").alias("_dist")).schema
    on = [*keys, "_band", "_other"]
    return asked.groupBy(*on).cogroup(copies.groupBy(*on)).applyInPandas(search, schema)


def nearest_cells(members: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, cell_q, cell_r, _dist) for each member whose group has a target."""
    cell = [*keys, "cell_q", "cell_r"]
    banded = lambda df: df.select(*cell, F.floor(F.col("cell_r") / BAND_ROWS).alias("_band"))
    targets = settle(banded(targets), "targets")
    spans = targets.groupBy(*keys).agg(F.min("_band").alias("_low"), F.max("_band").alias("_high"))
    waiting = settle(join_back(banded(members), spans, keys, "inner").withColumn("_dist", F.lit(None).cast("long")), "members")
    settled, first, last = [], 0, 1
    while True:
        rings = [d for d in range(-last, last + 1) if abs(d) >= first]
        asked = waiting.withColumn("_other", F.explode(F.array(*[F.col("_band") + d for d in rings]))).where("_other BETWEEN _low AND _high")
        found = _compared(asked, targets, keys)
        state = ["_band", "_low", "_high"]
        known = waiting.select(*cell, *state, "_dist").unionByName(
            found.select(*cell, *[F.lit(None).cast("long").alias(c) for c in state], "_dist"))
        best = settle(known.groupBy(*cell).agg(*[F.min(c).alias(c) for c in (*state, "_dist")]), "members")
        # Targets in bands that were not asked are more than ``last * BAND_ROWS`` rows away.
        done = f"_dist <= {last * BAND_ROWS} OR (_band - {last} <= _low AND _band + {last} >= _high)"
        settled.append(best.where(done).select(*cell, "_dist"))
        waiting = best.where(f"NOT coalesce({done}, false)")
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        first, last = last + 1, 2 * last + 1
