"""Named queries over the test tables: each runs the chain up to one operator and returns
what that operator adds, with integers as bigint and coordinates in thousandths of a degree."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripchain.config import BUS, METRO, TRAIN, Config
from tripchain.functions.hexgrid import distance
from tripchain.operators import anonymize as masking
from tripchain.operators import chain, clean, destinations, nearest, od, ties, trips
from tripchain.operators.skew import group_stats
from tripchain.plans import day
from tripchain.session import scratch_path, settle
from tripchain.sources import csv, driver_tables

CONFIG = Config()
SALT = "tripchain"


def _milli(column: str) -> Column:
    return F.round(F.col(column) * 1000).cast("long")


def _show(df: DataFrame, *columns: str) -> DataFrame:
    """Select columns; ``x_milli`` stands for coordinate x in thousandths."""
    picked = df.select(*[
        _milli(c.removesuffix("_milli")).alias(c) if c.endswith("_milli") else F.col(c) for c in columns])
    return picked.select(*[
        F.col(f.name).cast("long") if isinstance(f.dataType, T.IntegerType) else F.col(f.name)
        for f in picked.schema.fields])


class _Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.trx = driver_tables.trx(spark, sf_dir)
        self.stops = driver_tables.stops(spark, sf_dir)
        self.lines = driver_tables.lines(spark, sf_dir)
        self.cells = driver_tables.cells(spark, sf_dir)
        self.fares = driver_tables.fares(spark, sf_dir)

    def origins(self) -> DataFrame:
        return day.origin_table(self.trx, self.stops, self.lines, CONFIG)

    def stages(self) -> DataFrame:
        return day.finished_stages(self.trx, self.stops, self.lines, CONFIG)


def base_stages(t: _Inputs) -> DataFrame:
    return _show(chain.base_stages(t.trx), "id", "id_tarjeta", "modo", "lat_milli", "lon_milli", "sexo", "interno_bus",
                 "tipo_trx_tren", "etapa_red_sube", "id_linea", "id_ramal", "id_tarifa", "hora")


def _chained(t: _Inputs, step: Callable[[DataFrame, Sequence[str]], DataFrame]) -> DataFrame:
    """A step of the chain: windows for ordinary cards, distinct order values for hot ones."""
    def run(df: DataFrame, card: Sequence[str], spread: bool = False) -> DataFrame:
        return chain.on_values(df, step, card) if spread else step(df, card)
    return day.started(t.trx, CONFIG).apply(run, CONFIG.card_keys).union()


def _temp_ids(df: DataFrame, card: Sequence[str]) -> DataFrame:
    return chain.trip_temp_id(chain.stage_ids(df, card))


def stage_ids(t: _Inputs) -> DataFrame:
    return _show(_chained(t, chain.stage_ids), "id", "id_tarjeta", "id_etapa")


def trip_temp_id(t: _Inputs) -> DataFrame:
    return _show(_chained(t, _temp_ids), "id", "id_tarjeta", "id_etapa", "id_viaje_temp")


def checkout_only_trips(t: _Inputs) -> DataFrame:
    flagged = _chained(t, lambda df, card: chain.checkout_only(_temp_ids(df, card), card))
    return flagged.where("solo_checkout").groupBy("id_tarjeta", "id_viaje_temp").agg(F.count("*").alias("checkouts"))


def checkout_fix(t: _Inputs) -> DataFrame:
    repaired = _chained(t, lambda df, card: chain.repair_checkouts(_temp_ids(df, card), card))
    return _show(repaired, "id", "id_tarjeta", "id_etapa", "id_viaje_temp")


def trip_ids(t: _Inputs) -> DataFrame:
    return _show(day.chained(t.trx, CONFIG).union(), "id", "id_tarjeta", "id_etapa", "id_viaje")


def hex_cell(t: _Inputs) -> DataFrame:
    return _show(clean.geo_clean(t.trx, CONFIG), "id", "lat_milli", "lon_milli", "cell_q", "cell_r")


def hex_distance(t: _Inputs) -> DataFrame:
    """Cells between each tap and the first tap of its card."""
    located = clean.geo_clean(chain.base_stages(t.trx), CONFIG)
    first = group_stats(located, chain.CARD, {"first": F.min(F.struct("id", "cell_q", "cell_r"))}, spread=True)
    return first.select("id", F.col("first.id").alias("first_id"), F.expr(
        distance("cell_q", "cell_r", "first.cell_q", "first.cell_r")).alias("distancia"))


def geo_clean(t: _Inputs) -> DataFrame:
    return _show(day.chained(t.trx, CONFIG).map(clean.geo_clean, CONFIG).union(),
                 "id", "id_tarjeta", "id_etapa", "id_viaje", "cell_q", "cell_r")


def drop_singles(t: _Inputs) -> DataFrame:
    return _show(day.placed(t.trx, CONFIG).union(), "id", "id_tarjeta", "id_etapa")


def normalize_line(t: _Inputs) -> DataFrame:
    return _show(day.on_lines(t.trx, t.lines, CONFIG).union(), "id", "id_ramal", "id_linea")


def dup_groups(t: _Inputs) -> DataFrame:
    taps = settle(day.on_lines(t.trx, t.lines, CONFIG).union(), "taps")
    shown = None
    for mode in (BUS, METRO, TRAIN):
        groups = clean.double_tap_groups(taps, mode)
        for column in ("id_linea", "id_ramal", "interno_bus", "lat", "lon", "tipo_trx_tren"):
            if column not in groups.columns:
                groups = groups.withColumn(column, F.lit(None).cast(taps.schema[column].dataType))
        part = _show(groups.withColumn("modo", F.lit(mode)), "modo", "id_tarjeta", "hora", "etapa_red_sube", "id_linea",
                     "id_ramal", "interno_bus", "lat_milli", "lon_milli", "tipo_trx_tren", "taps")
        shown = part if shown is None else shown.unionByName(part)
    return shown


def _dedup(*modes: str) -> Callable[[_Inputs], DataFrame]:
    return lambda t: _show(day.deduplicated(t.trx, t.lines, CONFIG, modes).union(),
                           "id", "id_tarjeta", "modo", "id_etapa")


def tied_groups(t: _Inputs) -> DataFrame:
    return ties.tied_groups(day.cleaned(t.trx, t.lines, CONFIG).union(), CONFIG)


def _tie(passes: int) -> Callable[[_Inputs], DataFrame]:
    return lambda t: _show(day.ordered(t.trx, t.lines, CONFIG, passes).union(),
                           "id", "id_tarjeta", "id_etapa", "id_viaje")


def _line_taps(t: _Inputs) -> DataFrame:
    return clean.normalize_line(clean.geo_clean(t.trx, CONFIG), t.lines)


def point_in_buffer_query(t: _Inputs) -> DataFrame:
    """In how many buffers of its line's stops each tap lies."""
    taps = _line_taps(t).withColumn("line", F.col("id_linea"))
    held = settle(nearest.holding_stops(taps, t.stops, CONFIG), "held")
    return nearest.attach(taps, held, ["line", "lon", "lat"], CONFIG.broadcast_lookup).select(
        "id", "id_linea", F.coalesce("stops", F.lit(0)).cast("long").alias("paradas"))


def buffer_join(t: _Inputs) -> DataFrame:
    """Per line and place of a tap: the nearest of the line's stops whose buffer holds the place, and its distance."""
    taps = clean.normalize_line(clean.in_service_area(chain.base_stages(t.trx, CONFIG.card_keys), CONFIG), t.lines)
    own = nearest.with_route(taps, CONFIG).where("route IS NOT NULL").select(F.col("id_linea").alias("line"), "lon", "lat")
    return _show(nearest.destination_lookup(own, t.stops, CONFIG), "line", "lon_milli", "lat_milli", "stop", "stop_dist")


def origin_union(t: _Inputs) -> DataFrame:
    """Origin stops of bus, train and metro places in one pass."""
    places = day.tap_places(t.trx, t.lines, CONFIG)
    return _show(nearest.origins_of(places, t.origins(), CONFIG),
                 "route_kind", "route", "lon_milli", "lat_milli", "stop", "stop_dist")


def origin_stop(t: _Inputs) -> DataFrame:
    return _show(day.with_origins(t.trx, t.lines, t.origins(), CONFIG).union(),
                 "id", "id_tarjeta", "id_etapa", "parada_id_o")


def next_trx(t: _Inputs) -> DataFrame:
    linked = day.with_next(t.trx, t.lines, t.origins(), CONFIG).union()
    return linked.select("id", "id_tarjeta", "fila", F.col("next.id").alias("id_lead"))


def dest_stop(t: _Inputs) -> DataFrame:
    return _show(day.with_destinations(t.trx, t.stops, t.lines, t.origins(), CONFIG).union(),
                 "id", "id_tarjeta", "id_viaje", "id_etapa", "parada_id_d")


def drop_checkouts(t: _Inputs) -> DataFrame:
    return _show(t.stages(), "id", "id_tarjeta", "modo", "lat_milli", "lon_milli", "sexo", "interno_bus", "tipo_trx_tren",
                 "etapa_red_sube", "id_linea", "id_ramal", "id_tarifa", "hora", "id_etapa", "id_viaje", "cell_q",
                 "cell_r", "parada_id_o", "parada_id_d")


def coverage(t: _Inputs) -> DataFrame:
    return destinations.coverage(t.stages())


def trip_table(t: _Inputs) -> DataFrame:
    built = trips.build_trips(t.stages())
    return _show(built, *built.columns)


def card_sex(t: _Inputs) -> DataFrame:
    return trips.card_sex(t.stages())


def card_table(t: _Inputs) -> DataFrame:
    return trips.build_cards(t.stages())


def od_georef(t: _Inputs) -> DataFrame:
    stages = t.stages().select("id", "id_tarjeta", "parada_id_o", "parada_id_d")
    return od.georeference(stages, t.stops, t.cells)


def od_matrix(t: _Inputs) -> DataFrame:
    """Stages between departments by hour."""
    stages = t.stages().select("hora", "parada_id_o", "parada_id_d")
    counted = od.od_matrix(od.georeference(stages, t.stops, t.cells), "departamento", ["hora"])
    return _show(counted, *counted.columns)


def od_rollup(t: _Inputs) -> DataFrame:
    """Stages by hour between departments, between provinces and in all."""
    stages = t.stages().select("hora", "parada_id_o", "parada_id_d")
    counted = od.od_rollup(od.georeference(stages, t.stops, t.cells), by=["hora"])
    return _show(counted, *counted.columns)


def od_cube(t: _Inputs) -> DataFrame:
    """Trips between places at every pair of levels."""
    ends = trips.build_trips(t.stages()).select("parada_id_o", "parada_id_d")
    return od.od_rollup(od.georeference(ends, t.stops, t.cells), crossed=True)


def od_trips(t: _Inputs) -> DataFrame:
    """Trips with the geography of both ends."""
    built = trips.build_trips(t.stages()).select(
        "id_tarjeta", "id_viaje", "cantidad_etapas", "hora", "etapas_incompletas", "parada_id_o", "parada_id_d")
    found = od.georeference(built, t.stops, t.cells)
    return _show(found, *found.columns)


def _written_csv(df: DataFrame, name: str) -> str:
    """The table as CSV with a header, nulls unquoted and empty strings quoted."""
    path = scratch_path(df.sparkSession, name)
    df.write.csv(path, header=True, nullValue=None, emptyValue='""')
    return path


def _as_numeric(df: DataFrame, *columns: str) -> DataFrame:
    """Integers as a column of arbitrary precision may be printed."""
    return df.withColumns({c: F.concat(F.col(c).cast("string"), F.lit(".0")) for c in columns})


def load_trx(t: _Inputs) -> DataFrame:
    printed = _as_numeric(t.trx, "interno_bus", "etapa_red_sube", "id_linea", "id_ramal", "id_tarifa", "hora")
    loaded = csv.load_trx(t.trx.sparkSession, _written_csv(printed, "trx-csv"))
    return _show(loaded, "id", "id_tarjeta", "modo", "lat_milli", "lon_milli", "sexo", "interno_bus", "tipo_trx_tren",
                 "etapa_red_sube", "id_linea", "id_ramal", "id_tarifa", "hora")


def load_stops(t: _Inputs) -> DataFrame:
    # The stops file has the name before the coordinates.
    printed = _as_numeric(t.stops, "id_linea", "id_ramal")
    loaded = csv.load_stops(t.stops.sparkSession, _written_csv(printed, "stops-csv"))
    return _show(loaded, "id", "id_linea", "id_ramal", "nombre_estacion", "longitud_milli", "latitud_milli", "h3")


def load_fares(t: _Inputs) -> DataFrame:
    loaded = csv.load_fares(t.fares.sparkSession, _written_csv(t.fares, "fares-csv"))
    return loaded.select(F.col("id_tarifa").cast("long").alias("id_tarifa"), "descripcion",
                         F.round(F.col("valor") * 100).cast("long").alias("centavos"))


def load_lines(t: _Inputs) -> DataFrame:
    return csv.load_lines(t.lines.sparkSession, _written_csv(t.lines, "lines-csv"))


def load_cells(t: _Inputs) -> DataFrame:
    return csv.load_cells(t.cells.sparkSession, _written_csv(t.cells, "cells-csv"))


def sink_roundtrip(t: _Inputs) -> DataFrame:
    """The cards table as read back from the three written result tables."""
    written = day.write_results(t.trx, t.stops, t.lines, scratch_path(t.trx.sparkSession, "results"), CONFIG)
    return _show(written.trips, "id_tarjeta", "id_viaje", "cantidad_etapas", "parada_id_o", "parada_id_d").join(
        written.cards, "id_tarjeta")


def anonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taps with coordinates and a full time of their own, masked."""
    raw = driver_tables.raw_trx(spark, sf_dir)
    return _show(masking.anonymize(raw, SALT), "id", "id_tarjeta", "interno_bus", "lat_milli", "lon_milli", "hora")


STEPS: dict[str, Callable[[_Inputs], DataFrame]] = {
    "base_stages": base_stages,
    "stage_ids": stage_ids,
    "trip_temp_id": trip_temp_id,
    "checkout_only_trips": checkout_only_trips,
    "checkout_fix": checkout_fix,
    "trip_ids": trip_ids,
    "hex_cell": hex_cell,
    "hex_distance": hex_distance,
    "geo_clean": geo_clean,
    "drop_singles": drop_singles,
    "normalize_line": normalize_line,
    "dup_groups": dup_groups,
    "dedup_bus": _dedup(BUS),
    "dedup_metro": _dedup(BUS, METRO),
    "dedup_train": _dedup(BUS, METRO, TRAIN),
    "tied_groups": tied_groups,
    "tie_next": _tie(1),
    "tie_prev": _tie(2),
    "tie_id": _tie(3),
    "point_in_buffer": point_in_buffer_query,
    "buffer_join": buffer_join,
    "origin_stop": origin_stop,
    "origin_union": origin_union,
    "next_trx": next_trx,
    "dest_stop": dest_stop,
    "drop_checkouts": drop_checkouts,
    "coverage": coverage,
    "trips": trip_table,
    "card_sex": card_sex,
    "cards": card_table,
    "od_georef": od_georef,
    "od_matrix": od_matrix,
    "od_rollup": od_rollup,
    "od_cube": od_cube,
    "od_trips": od_trips,
    "load_trx": load_trx,
    "load_stops": load_stops,
    "load_lines": load_lines,
    "load_cells": load_cells,
    "load_fares": load_fares,
    "sink_roundtrip": sink_roundtrip,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    bound = {
        name: (lambda spark, sf_dir, step=step: step(_Inputs(spark, sf_dir)))
        for name, step in STEPS.items()
    }
    return {**bound, "anonymize": anonymize}
