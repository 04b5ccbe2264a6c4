"""The whole chain: taps, stops and lines in; stages, trips and cards out.

Ordinary cards need one exchange by card, for everything up to the next tap; destinations, trips and cards go on from a table
in buckets of the card. Origin and destination tables beyond ``Config.broadcast_lookup`` rows cost one more exchange of the taps for
origins, before the one by card, and two for destinations.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from tripchain.config import BUS, METRO, TRAIN, Config
from tripchain.operators import chain, clean, destinations, nearest, ties, trips
from tripchain.operators.skew import Cards, split_hot
from tripchain.session import settle, settle_by
from tripchain.sources.csv import save_table


@dataclass(frozen=True)
class Result:
    stages: DataFrame
    trips: DataFrame
    cards: DataFrame


def started(trx: DataFrame, config: Config = Config(), lines: DataFrame | None = None, origins: DataFrame | None = None) -> Cards:
    """Taps with a card, gathered by it; with ``origins`` also on canonical lines and with their origin stop, null where there is none.

    An origin depends on the tap alone, so it is attached to rows as they come, before any exchange by card.
    """
    cards = split_hot(chain.base_stages(trx, config.card_keys), config)
    if origins is not None:
        cards = cards.map(clean.normalize_line, lines).map(nearest.attach_origin, origins, config)
    return cards.gather(config.card_keys)


def chained(trx: DataFrame, config: Config = Config(), lines: DataFrame | None = None, origins: DataFrame | None = None) -> Cards:
    """Taps with stage and trip ids."""
    return started(trx, config, lines, origins).apply(chain.chain, config.card_keys, cut=True)


def placed(trx: DataFrame, config: Config = Config(), lines: DataFrame | None = None, origins: DataFrame | None = None) -> Cards:
    """… inside the service area, without cards that have one tap."""
    return chained(trx, config, lines, origins).map(clean.geo_clean, config).apply(
        clean.drop_singles, config.card_keys)


def on_lines(trx: DataFrame, lines: DataFrame, config: Config = Config(), origins: DataFrame | None = None) -> Cards:
    """… on canonical lines."""
    cards = placed(trx, config, lines, origins)
    return cards.map(clean.normalize_line, lines) if origins is None else cards


def deduplicated(trx: DataFrame, lines: DataFrame, config: Config = Config(),
                 modes: tuple[str, ...] = (BUS, METRO, TRAIN), origins: DataFrame | None = None) -> Cards:
    """… without double taps."""
    cards = on_lines(trx, lines, config, origins)
    for mode in modes:
        cards = cards.apply(clean.drop_double_taps, mode, config.card_keys, cut=True)
    return cards


def cleaned(trx: DataFrame, lines: DataFrame, config: Config = Config(), origins: DataFrame | None = None) -> Cards:
    return deduplicated(trx, lines, config, origins=origins).apply(clean.drop_singles, config.card_keys, cut=True)


PASSES = (ties.order_by_next, ties.order_by_previous, ties.order_by_id)


def ordered(trx: DataFrame, lines: DataFrame, config: Config = Config(), passes: int = 3,
            origins: DataFrame | None = None) -> Cards:
    """… with simultaneous taps put in order."""
    cards = cleaned(trx, lines, config, origins)
    for step in PASSES[:passes]:
        cards = cards.apply(step, config, config.card_keys, cut=True)
    return cards


def _tap_rows(trx: DataFrame, lines: DataFrame, config: Config) -> DataFrame:
    """All taps that can become stages. Row-wise steps, so they do not wait for the chain."""
    return clean.normalize_line(
        clean.in_service_area(chain.base_stages(trx, config.card_keys), config), lines)


def tap_places(trx: DataFrame, lines: DataFrame, config: Config = Config()) -> DataFrame:
    """Their distinct (route, place)."""
    return nearest.places_of(_tap_rows(trx, lines, config), config)


def tap_cells(trx: DataFrame, lines: DataFrame, config: Config = Config()) -> DataFrame:
    """Their distinct (route, cell)."""
    return nearest.cells_of(_tap_rows(trx, lines, config), config)


def origin_table(trx: DataFrame, stops: DataFrame, lines: DataFrame, config: Config = Config()) -> DataFrame:
    """(route, cell) → origin stop, computed once and kept as a table in the shared folder.

    It grows with the area, neither with the taps nor with the precision of their coordinates. As a table its rows are counted
    at no cost, which decides how it is joined.
    """
    return settle(nearest.origin_lookup(tap_cells(trx, lines, config), stops, config), "origin")


def with_origins(trx: DataFrame, lines: DataFrame, origins: DataFrame, config: Config = Config()) -> Cards:
    """… with an origin stop, again without cards that have one tap."""
    return ordered(trx, lines, config, origins=origins).map(nearest.drop_unlocated).apply(
        clean.drop_singles, config.card_keys, cut=True)


def with_next(trx: DataFrame, lines: DataFrame, origins: DataFrame, config: Config = Config()) -> Cards:
    """… with the next tap."""
    return with_origins(trx, lines, origins, config).apply(destinations.next_trx, config.card_keys, cut=True)


def with_destinations(trx: DataFrame, stops: DataFrame, lines: DataFrame, origins: DataFrame,
                      config: Config = Config()) -> Cards:
    """… with a destination stop.

    Only now is it known which places are asked for on which lines. So ordinary cards are settled
    here, in buckets of the card, and read for these pairs and then for all that follows, without another exchange.
    """
    linked = with_next(trx, lines, origins, config)
    linked = replace(linked, cold=settle_by(linked.cold, "linked", config.card_keys, linked.parts))
    lookup = settle(nearest.destination_lookup(destinations.asked_pairs(linked.union()), stops, config), "destination")
    return linked.apply(destinations.impute_destination, lookup, config, config.card_keys, cut=True)


def finished_stages(trx: DataFrame, stops: DataFrame, lines: DataFrame, config: Config = Config()) -> DataFrame:
    origins = origin_table(trx, stops, lines, config)
    done = with_destinations(trx, stops, lines, origins, config).map(destinations.drop_checkouts)
    return done.union().drop("next", "fila")


def run(trx: DataFrame, stops: DataFrame, lines: DataFrame, config: Config = Config()) -> Result:
    """Result tables. The chain up to the next tap and the stop lookups run at once, the tables when they are
    used. Each is a full plan of its own; to get all three, ``write_results`` computes the stages once."""
    stages = finished_stages(trx, stops, lines, config)
    return Result(stages, trips.build_trips(stages, config.card_keys),
                  trips.build_cards(stages, config.card_keys))


def write_results(trx: DataFrame, stops: DataFrame, lines: DataFrame, path: str,
                  config: Config = Config(), partition_by: tuple[str, ...] = ()) -> Result:
    """Write stages, trips and cards as Parquet under ``path``; each is built from the last."""
    stages = save_table(finished_stages(trx, stops, lines, config), os.path.join(path, "etapas"), partition_by)
    summary = settle(trips.trips_with_sex(stages, config.card_keys), "trips")
    trip_table = save_table(summary.drop("_sexo_min", "_sexo_max"), os.path.join(path, "viajes"), partition_by)
    cards = save_table(trips.cards_from_trips(summary, trips.sex_names(stages), config.card_keys), os.path.join(path, "tarjetas"), partition_by)
    return Result(stages, trip_table, cards)
