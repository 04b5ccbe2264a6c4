"""Parameters of the chain, with the published method's values as defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the input format.
CHECK_IN = "CHECK IN"
CHECK_OUT = "CHECK OUT"
CHECK_OUT_ALONE = "CHECK OUT SIN CHECKIN"
BUS, METRO, TRAIN = "COL", "SUB", "TRE"


@dataclass(frozen=True)
class Config:
    # One chain is built per distinct value of these columns. Put a service date
    # in front of the card to process many days in one run.
    card_keys: tuple[str, ...] = ("id_tarjeta",)

    # Service area in degrees, bounds included.
    lat_min: float = -36.0
    lat_max: float = -33.0
    lon_min: float = -61.0
    lon_max: float = -57.0

    # Planar hexagon grid with the side of an H3 resolution-10 cell.
    hex_side_m: float = 66.0

    # A stop is a stage's origin up to this many cells away, its destination up to
    # that many, and a destination candidate only inside the buffer round the stop.
    origin_cells: int = 6
    destination_cells: int = 17
    buffer_deg: float = 0.03
    buffer_quad_segs: int = 8

    # Modes whose simultaneous taps are put in order by distance.
    tied_modes: tuple[str, ...] = (METRO, BUS)
    # Origin stops are searched on the line or on the branch, by mode.
    line_modes: tuple[str, ...] = (BUS,)
    branch_modes: tuple[str, ...] = (TRAIN, METRO)

    # Cards with more taps than this leave the one-task-per-card path.
    hot_rows: int = 2_000
    # Largest list of such cards that is still broadcast.
    hot_broadcast: int = 1_000_000
    # Rows of ordinary cards that one task arranges, about: their number is counted and divided by this.
    task_rows: int = 100_000
    # Places or cells for which one task searches stops, about.
    task_places: int = 2_000
    # Most stops (counted per line and branch) that are broadcast to the places.
    broadcast_spots: int = 1_000_000
    # Most rows (counted) of a table of origins or destinations that are broadcast to the taps.
    broadcast_lookup: int = 1_000_000
