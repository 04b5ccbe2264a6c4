"""Nearest stop of a line or branch, once per distinct cell or place.

A tap's origin depends on its route and its cell only, so origins are looked up per (route, cell): a table that the service area
bounds, whatever the precision of coordinates. A destination also depends on whether the place lies in a stop's buffer, so
it is looked up per (line, place), for the pairs that boardings ask for. Taps look their stop up afterwards, which keeps a station with a third
of all taps from meaning a third of the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripchain.config import Config
from tripchain.functions.geo import point_in_buffer, with_bin, with_near_bins
from tripchain.functions.hexgrid import distance, with_cell
from tripchain.operators.skew import parts_for
from tripchain.session import settle

LINE, BRANCH = "linea", "ramal"
ORIGIN_KEY = ("route_kind", "route", "cell_q", "cell_r")
# Parts of a bin in the join with more stops than can be broadcast.
SALTS = 16


def with_route(df: DataFrame, config: Config = Config()) -> DataFrame:
    """Add the route on which a tap's origin stop is searched: line or branch, by mode.
    Taps of other modes get none."""
    by_line = F.col("modo").isin(*config.line_modes)
    by_branch = F.col("modo").isin(*config.branch_modes)
    return df.withColumns({
        "route_kind": F.when(by_line, LINE).when(by_branch, BRANCH),
        "route": F.when(by_line, F.col("id_linea")).when(by_branch, F.col("id_ramal")),
    })


def stops_by_route(stops: DataFrame, config: Config = Config(), kinds: Sequence[str] = (LINE, BRANCH)) -> DataFrame:
    """Stops once per line and once per branch; of several at one spot the lowest id counts."""
    column = {LINE: "id_linea", BRANCH: "id_ramal"}
    listed = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(column[kind]).alias("route")) for kind in kinds]))
    spots = (
        stops.withColumn("_as", listed)
        .select(F.col("_as.kind").alias("route_kind"), F.col("_as.route").alias("route"),
                F.col("longitud").alias("stop_lon"), F.col("latitud").alias("stop_lat"), "id")
        .where(F.col("route").isNotNull() & F.col("stop_lon").isNotNull() & F.col("stop_lat").isNotNull())
        .groupBy("route_kind", "route", "stop_lon", "stop_lat").agg(F.min("id").alias("stop"))
    )
    return settle(with_cell(spots, config, "stop_lon", "stop_lat", "stop_q", "stop_r"), "spots")


def _as_double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({f"{c}_deg": F.col(c).cast("double") for c in columns})


def _dealt(asked: DataFrame, by: Sequence[str], config: Config) -> DataFrame:
    """Places or cells in parts of about ``task_places``. Each meets many stops and is kept at every distance to them until the
    nearest is known, so a part coalesced by its few bytes would be too much for one task."""
    kept = settle(asked, "asked")
    return kept.repartition(parts_for(kept, kept.count(), config.task_places), *by)


def _met(near: DataFrame, keyed: DataFrame, on: Sequence[str], by: Sequence[str], broadcast_spots: int) -> DataFrame:
    """Rows of ``near`` with the stops of their bins. Stops are broadcast only up to a counted number; beyond that, a bin in
    the centre may have a large share of the rows, and each bin is cut into salts by the columns ``by``."""
    on = [*on, "bin_x", "bin_y"]
    if keyed.count() <= broadcast_spots:
        return near.join(F.broadcast(keyed), on)
    salted = near.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    copies = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"])


def _nearest(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """The stop at the smallest cell distance (lowest id on a draw) per ``by``."""
    # In two steps both aggregates have fixed-width buffers and stay in the hash aggregate.
    return (
        pairs.groupBy(*by, "_dist").agg(F.min("stop").alias("_stop"))
        .groupBy(*by).agg(F.min_by("_stop", "_dist").alias("stop"), F.min("_dist").alias("stop_dist"))
    )


CELL_DISTANCE = distance("cell_q", "cell_r", "stop_q", "stop_r")


def places_of(taps: DataFrame, config: Config = Config()) -> DataFrame:
    """Distinct (route, place) of taps inside the service area."""
    return (
        with_route(taps, config).where(F.col("route").isNotNull())
        .select("route_kind", "route", "lon", "lat").distinct()
    )


def cells_of(taps: DataFrame, config: Config = Config()) -> DataFrame:
    """Distinct (route, cell) of taps inside the service area."""
    return (
        with_cell(with_route(taps, config).where(F.col("route").isNotNull()), config)
        .select(*ORIGIN_KEY).distinct()
    )


def _cell_bin(column: str, width: int) -> Column:
    return F.floor(F.col(column) / width)


def origin_lookup(cells: DataFrame, stops: DataFrame, config: Config = Config()) -> DataFrame:
    """(route, cell) → origin stop at most ``origin_cells`` away.

    The buffer is wider than the cut, so it needs no test here. Bins are squares of cells as wide as the cut, so the nine round a cell
    hold all that is in reach.
    """
    width = max(1, config.origin_cells)
    spots = (
        stops_by_route(stops, config).groupBy("route_kind", "route", "stop_q", "stop_r").agg(F.min("stop").alias("stop"))
        .withColumns({"bin_x": _cell_bin("stop_q", width), "bin_y": _cell_bin("stop_r", width)})
    )
    step = F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long")))
    near = (
        _dealt(cells.select(*ORIGIN_KEY), ["cell_q", "cell_r"], config).withColumn("_dx", step).withColumn("_dy", step)
        .withColumns({"bin_x": _cell_bin("cell_q", width) + F.col("_dx"), "bin_y": _cell_bin("cell_r", width) + F.col("_dy")})
    )
    pairs = _met(near, spots, ["route_kind", "route"], ORIGIN_KEY, config.broadcast_spots).withColumn("_dist", F.expr(CELL_DISTANCE))
    return _nearest(pairs.where(F.col("_dist") <= config.origin_cells), ORIGIN_KEY)


def destination_lookup(asked: DataFrame, stops: DataFrame, config: Config = Config()) -> DataFrame:
    """(line, place) → nearest stop of the line whose buffer holds the place, for the pairs of ``asked`` (line, lon, lat).

    The distance cut comes after the choice of one candidate per stage, so it is not applied here.
    """
    by = ["line", "lon", "lat"]
    spots = stops_by_route(stops, config, (LINE,)).drop("route_kind").withColumnRenamed("route", "line")
    pairs = _held(with_cell(asked.select(*by).distinct(), config), spots, config)
    return _nearest(pairs.withColumn("_dist", F.expr(CELL_DISTANCE)), by)


def _held(places: DataFrame, spots: DataFrame, config: Config) -> DataFrame:
    """Places (line, lon, lat) with each of the line's stops whose buffer holds them."""
    # Only the nine bins round a place can hold a stop within a bin's width of it.
    near = with_near_bins(_as_double(_dealt(places, ["lon", "lat"], config), "lon", "lat"), "lon_deg", "lat_deg", config.buffer_deg)
    keyed = with_bin(_as_double(spots, "stop_lon", "stop_lat"), "stop_lon_deg", "stop_lat_deg", config.buffer_deg)
    inside = point_in_buffer("lon_deg", "lat_deg", "stop_lon_deg", "stop_lat_deg", config.buffer_deg, config.buffer_quad_segs)
    return _met(near, keyed, ["line"], ["lon", "lat"], config.broadcast_spots).where(inside)


def holding_stops(places: DataFrame, stops: DataFrame, config: Config = Config()) -> DataFrame:
    """(line, lon, lat, stops): how many stops of the line have the place in their buffer, for places with any."""
    spots = settle(
        stops.where("id_linea IS NOT NULL AND longitud IS NOT NULL AND latitud IS NOT NULL")
        .groupBy(F.col("id_linea").alias("line"), F.col("longitud").alias("stop_lon"), F.col("latitud").alias("stop_lat"))
        .agg(F.count("*").alias("_stops")), "spots")
    return _held(places.select("line", "lon", "lat").distinct(), spots, config).groupBy("line", "lon", "lat").agg(
        F.sum("_stops").alias("stops"))


def attach(df: DataFrame, lookup: DataFrame, on: Sequence[str], broadcast_rows: int = Config.broadcast_lookup) -> DataFrame:
    """Rows with what a table has for their key, null where it has nothing. The table, settled before, has one row per key.

    A table of up to ``broadcast_rows`` rows (counted) goes to the taps, so that they need no exchange, whatever the planner's threshold. Beyond
    that both are exchanged by the key, and the rows of one key are cut into salts by their id.
    """
    if lookup.count() <= broadcast_rows:
        return df.join(F.broadcast(lookup), list(on), "left")
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        .join(copies, [*on, "_salt"], "left").drop("_salt")
    )


def attach_origin(df: DataFrame, lookup: DataFrame, config: Config = Config()) -> DataFrame:
    """Add parada_id_o, null where no stop is in reach. Lines are canonical already."""
    stop = lookup.select(*ORIGIN_KEY, F.col("stop").alias("parada_id_o"))
    return attach(with_cell(with_route(df, config), config), stop, ORIGIN_KEY, config.broadcast_lookup).drop(*ORIGIN_KEY)


def origins_of(places: DataFrame, lookup: DataFrame, config: Config = Config()) -> DataFrame:
    """(route, place) → origin stop, for places that have one."""
    found = with_cell(places, config).join(lookup, list(ORIGIN_KEY))
    return found.drop("cell_q", "cell_r")


def drop_unlocated(df: DataFrame) -> DataFrame:
    """Taps without a stop in reach go."""
    return df.where(F.col("parada_id_o").isNotNull())
