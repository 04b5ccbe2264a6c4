"""Stop lookups and the split of hot cards, on both sides of their size checks."""

import random

import pytest
from pyspark.sql import functions as F

from tripchain.config import Config
from tripchain.functions.geo import point_in_buffer, with_bin, with_near_bins
from tripchain.functions.hexgrid import distance, with_cell
from tripchain.operators import nearest
from tripchain.operators.skew import split_hot
from tripchain.plans import day
from tripchain.session import settle


@pytest.fixture(scope="module")
def scattered():
    r = random.Random(11)
    spot = lambda: (round(-58.5 + r.random() * 0.12, 3), round(-34.6 + r.random() * 0.1, 3))
    stops = [(i, r.choice([1, 2]), r.choice([10, 20]), *spot()) for i in range(60)]
    taps = []
    for i in range(150):
        lon, lat = spot()
        taps.append(dict(id=i, modo=r.choice(["COL", "SUB", "TRE", "LAN"]), lon=lon, lat=lat,
                         id_linea=r.choice([1, 2]), id_ramal=r.choice([10, 20])))
    return stops, taps


@pytest.mark.parametrize("broadcast_spots", [1_000, 0])
def test_lookups_equal_all_pairs(taps, stop_table, scattered, broadcast_spots):
    config = Config(broadcast_spots=broadcast_spots)
    stops, rows = stop_table(scattered[0]), taps(scattered[1])
    spots = settle(with_cell(nearest.stops_by_route(stops, config).select(
        "route_kind", "route", "stop_lon", "stop_lat", "stop"), config, "stop_lon", "stop_lat", "stop_q", "stop_r"), "all")
    places = settle(nearest.places_of(rows, config), "places")
    pairs = with_cell(places, config).crossJoin(spots.withColumnsRenamed({"route_kind": "kind", "route": "own"})).withColumns({
        "d": F.expr(distance("cell_q", "cell_r", "stop_q", "stop_r")),
        "held": point_in_buffer("lon", "lat", "stop_lon", "stop_lat")}).toPandas()

    def best(group):
        row = group.sort_values(["d", "stop"]).iloc[0]
        return int(row["stop"]), int(row["d"])

    own = pairs[(pairs.kind == pairs.route_kind) & (pairs.own == pairs.route) & pairs.held]
    expected = {k: best(g) for k, g in own.groupby(["route_kind", "route", "lon", "lat"]) if best(g)[1] <= config.origin_cells}
    found = nearest.origins_of(places, nearest.origin_lookup(nearest.cells_of(rows, config), stops, config), config).collect()
    assert expected and {(r.route_kind, r.route, r.lon, r.lat): (r.stop, r.stop_dist) for r in found} == expected

    lines = pairs[(pairs.kind == nearest.LINE) & pairs.held]
    # Pairs are asked for on one line each, so that some places are never asked for on the other.
    asked = settle(places.selectExpr("CASE WHEN lon * 1000 % 2 = 0 THEN 1L ELSE 2L END AS line", "lon", "lat"), "asked")
    wanted = {tuple(r) for r in asked.collect()}
    expected = {k: best(g) for k, g in lines.groupby(["own", "lon", "lat"]) if k in wanted}
    found = nearest.destination_lookup(asked, stops, config).collect()
    assert expected and len(found) <= len(wanted) and {(r.line, r.lon, r.lat): (r.stop, r.stop_dist) for r in found} == expected


@pytest.mark.parametrize("broadcast_lookup", [1_000, 0])
def test_origins_are_attached_to_all_rows(taps, stop_table, scattered, broadcast_lookup):
    config = Config(broadcast_lookup=broadcast_lookup)
    stops, rows = stop_table(scattered[0]), taps([*scattered[1], dict(id=1000, lon=None, lat=None), dict(id=1001, id_linea=None)])
    lookup = settle(nearest.origin_lookup(nearest.cells_of(rows, config), stops, config), "origin")
    found = nearest.attach_origin(rows, lookup, config)
    assert sorted(found.columns) == sorted([*rows.columns, "parada_id_o"]) and found.count() == rows.count()
    placed = nearest.origins_of(nearest.places_of(rows, config), lookup, config).collect()
    expected = {(r.route_kind, r.route, r.lon, r.lat): r.stop for r in placed}
    for r in found.collect():
        kind, route = (nearest.LINE, r.id_linea) if r.modo == "COL" else (nearest.BRANCH, r.id_ramal)
        assert r.parada_id_o == (None if r.modo == "LAN" else expected.get((kind, route, r.lon, r.lat)))
    assert 0 < nearest.drop_unlocated(found).count() < rows.count()


def test_origin_table_does_not_grow_with_the_digits_of_coordinates(taps, stop_table):
    r = random.Random(2)
    rows = taps([dict(id=i, lon=round(-58.5 + r.random() * 0.002, 12), lat=round(-34.6 + r.random() * 0.002, 12)) for i in range(600)])
    stops = stop_table([(1, 1, 10, -58.499, -34.599), (2, 1, 10, -58.4985, -34.599)])
    assert nearest.places_of(rows).count() == 600
    lookup = settle(nearest.origin_lookup(nearest.cells_of(rows), stops), "origin")
    assert 2 < lookup.count() < 20
    steps = with_cell(nearest.attach_origin(rows, lookup)).crossJoin(
        with_cell(stops.select(F.col("id").alias("stop"), "longitud", "latitud"), Config(), "longitud", "latitud", "stop_q", "stop_r")).withColumn(
        "d", F.expr(distance("cell_q", "cell_r", "stop_q", "stop_r"))).toPandas().sort_values(["id", "d", "stop"]).groupby("id").first()
    assert (steps["parada_id_o"] == steps["stop"]).all() and steps["stop"].nunique() == 2


def test_holding_stops_are_counted(taps, stop_table, scattered):
    stops, rows = stop_table([*scattered[0], (900, 1, 10, scattered[0][0][3], scattered[0][0][4])]), taps(scattered[1])
    places = settle(rows.select(F.col("id_linea").alias("line"), "lon", "lat").distinct(), "places")
    held = places.crossJoin(stops.select("id_linea", "longitud", "latitud")).where("line = id_linea").where(
        point_in_buffer("lon", "lat", "longitud", "latitud")).groupBy("line", "lon", "lat").count()
    for config in (Config(), Config(broadcast_spots=0)):
        found = nearest.holding_stops(places, stops, config)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, held.collect()))


@pytest.mark.parametrize("hot_broadcast", [1_000, 0])
def test_hot_cards_are_split_off_whole(taps, hot_broadcast):
    df = taps([dict(id=i, id_tarjeta=1 if i % 3 else i) for i in range(60)])
    parts = split_hot(df, Config(hot_rows=10, hot_broadcast=hot_broadcast))
    assert (parts.hot.count(), parts.cold.count()) == (40, 20)
    assert parts.union().select("id").distinct().count() == 60
    assert split_hot(df, Config(hot_rows=40)).hot is None


@pytest.mark.parametrize("dx, dy", [(0.03, 0), (-0.03, 0), (0, 0.03), (0, -0.03)])
def test_bins_hold_stops_exactly_at_the_buffer(spark, dx, dy):
    """Over the whole service area, on its grid of thousandths."""
    places = spark.range(4001).selectExpr("id", "-61 + id / 1000D AS lon", "-36 + (id % 3001) / 1000D AS lat")
    stops = places.selectExpr("id", f"round(lon + {dx}D, 3) AS lon", f"round(lat + {dy}D, 3) AS lat")
    met = with_near_bins(places, "lon", "lat", 0.03).join(with_bin(stops, "lon", "lat", 0.03).select("id", "bin_x", "bin_y"), ["id", "bin_x", "bin_y"])
    assert met.count() == 4001


def test_a_task_arranges_a_bounded_number_of_rows(taps, stop_table, line_table):
    """Tasks grow in number with the rows, not in size, whatever the session's shuffle partitions and coalescing."""
    df = taps([dict(id=i, id_tarjeta=i % 120, hora=i % 24, interno_bus=i, lon=round(-58.5 + i % 7 / 100, 2)) for i in range(2400)])
    stops, lines = stop_table([(i, 1, 10, round(-58.5 + i / 100, 2), -34.6) for i in range(7)]), line_table([(10, 1)])
    config = Config(task_rows=200)
    for copies in (1, 3):
        more = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumns({
            "id": F.col("id") + 10_000 * F.col("copy"), "id_tarjeta": F.col("id_tarjeta") + 1000 * F.col("copy")}).drop("copy")
        cold = day.chained(more, config).cold
        sizes = [r["count"] for r in cold.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 2400 * copies and len(sizes) > 9 * copies and max(sizes) <= 3 * config.task_rows
        few, many = (sorted(map(repr, day.finished_stages(more, stops, lines, c).collect())) for c in (Config(), config))
        assert few == many and few


def test_a_task_searches_stops_for_a_bounded_number_of_places(spark, stop_table):
    """Lookups have tasks by the counted places and cells, whatever the bytes that these take."""
    places = settle(spark.range(2400).selectExpr(
        "1 AS line", "cast(-58.5 + id % 60 / 1000D AS decimal(20, 12)) AS lon", "cast(-34.6 + floor(id / 60) / 1000D AS decimal(20, 12)) AS lat"), "places")
    stops = stop_table([(i, 1, 10, round(-58.5 + i / 100, 2), round(-34.6 + i % 3 / 100, 2)) for i in range(6)])
    taps = places.selectExpr("'COL' AS modo", "line AS id_linea", "10 AS id_ramal", "lon", "lat")
    for config in (Config(task_places=200), Config(task_places=400)):
        cells = nearest.cells_of(taps, config)
        for lookup, asked, wide in (
                (nearest.destination_lookup(places, stops, config), 2400, nearest.destination_lookup(places, stops, Config())),
                (nearest.origin_lookup(cells, stops, config), cells.count(), nearest.origin_lookup(cells, stops, Config()))):
            found = settle(lookup.withColumn("part", F.spark_partition_id()), "found")
            sizes = [r["count"] for r in found.groupBy("part").count().collect()]
            assert len(sizes) > asked / config.task_places / 2 and max(sizes) <= 2 * config.task_places
            assert sorted(map(repr, found.drop("part").collect())) == sorted(map(repr, wide.collect()))
