"""Hand-worked cases, one per trap, on the plain and on the spread path."""

import pytest
from conftest import by_id
from pyspark.sql import functions as F

from tripchain.config import BUS, METRO, Config
from tripchain.functions.hexgrid import with_cell
from tripchain.operators import chain, clean, destinations, ties, trips
from tripchain.plans import day
from tripchain.session import settle

IN, OUT = "CHECK IN", "CHECK OUT"
both_paths = pytest.mark.parametrize("spread", [False, True])


def tap(id, modo, hora, red, tipo=None, **more):
    return dict(id=id, modo=modo, hora=hora, etapa_red_sube=red, tipo_trx_tren=tipo, **more)


@both_paths
@pytest.mark.parametrize("rows, stages, trips_", [
    pytest.param([tap(1, "COL", 8, 0), tap(2, "SUB", 8, 1), tap(3, "COL", 18, 0)], [1, 2, 3], [1, 1, 2], id="chaining"),
    pytest.param([tap(1, "TRE", 7, 0, IN), tap(2, "TRE", 7, 0, OUT), tap(3, "COL", 8, 1), tap(4, "TRE", 17, 0, IN),
                  tap(5, "TRE", 18, 0, OUT)], [1, 1, 2, 3, 3], [1, 1, 1, 2, 2], id="check-out shares the stage"),
    pytest.param([tap(1, "COL", 15, 0), tap(2, "TRE", 16, 1, IN), tap(3, "COL", 17, 0), tap(4, "TRE", 17, 1, OUT)],
                 [1, 2, 3, 2], [1, 1, 2, 1], id="lone check-out goes back"),
    pytest.param([tap(1, "TRE", 6, 0, OUT), tap(2, "COL", 8, 0), tap(3, "COL", 18, 0)], [None, 1, 2], [None, 1, 2],
                 id="check-out with nothing before"),
    pytest.param([tap(1, "TRE", 9, 0), tap(2, "TRE", 9, 0, OUT), tap(3, "TRE", 9, 0, IN)], [2, 1, 1], [2, 1, 1],
                 id="kind order, unknown last"),
    pytest.param([tap(1, "COL", 9, None), tap(2, "COL", 8, 0)], [2, 1], [None, 1], id="unknown position"),
])
def test_chain(taps, spread, rows, stages, trips_):
    got = by_id(chain.chain(taps(rows), spread=spread), "id_etapa", "id_viaje")
    assert got == {row["id"]: (s, t) for row, s, t in zip(rows, stages, trips_)}


@both_paths
def test_repair_does_not_follow_moved_targets(taps, spread):
    # Running stages 1, 1, 2, 2; temporary trips 1, 0, 2, 1: trip 0 is a lone check-out with nothing
    # before it. Trip 1 has a boarding, so nothing else moves.
    rows = [tap(1, "TRE", 6, 0, IN), tap(2, "TRE", 7, 1, OUT), tap(3, "TRE", 8, 0, IN), tap(4, "TRE", 9, 1, OUT)]
    got = by_id(chain.chain(taps(rows), spread=spread), "id_etapa", "id_viaje")
    assert got == {1: (1, 1), 2: (None, None), 3: (2, 2), 4: (2, 1)}


@both_paths
def test_peers_share_the_last_id_and_the_next_stage_orders_them(taps, spread):
    rows = [tap(1, "SUB", 9, 0, lon=-58.49), tap(2, "SUB", 9, 0, lon=-58.48), tap(3, "SUB", 9, 0, lon=-58.47),
            tap(4, "COL", 18, 0, lon=-58.5)]
    df = settle(chain.chain(with_cell(taps(rows)), spread=spread), "chained")
    assert by_id(df, "id_etapa") == {1: 3, 2: 3, 3: 3, 4: 4}
    done = settle(ties.order_by_next(df, spread=spread), "done")
    assert by_id(done, "id_etapa") == {1: 3, 2: 2, 3: 1, 4: 4}
    assert by_id(done, "id_viaje") == {1: 1, 2: 1, 3: 1, 4: 2}


@both_paths
def test_the_previous_stage_orders_what_has_no_next(taps, spread):
    rows = [tap(1, "COL", 8, 0, lon=-58.5), tap(2, "SUB", 18, 0, lon=-58.49), tap(3, "SUB", 18, 0, lon=-58.47)]
    df = settle(chain.chain(with_cell(taps(rows)), spread=spread), "chained")
    after = settle(ties.order_by_next(df, spread=spread), "after")
    assert by_id(after, "id_etapa") == {1: 1, 2: 3, 3: 3}
    assert by_id(ties.order_by_previous(after, spread=spread), "id_etapa") == {1: 1, 2: 2, 3: 3}


@both_paths
def test_ids_order_what_has_neither(taps, spread):
    rows = [tap(1, "SUB", 9, 0, lon=-58.49), tap(2, "SUB", 9, 0, lon=-58.48)]
    df = settle(chain.chain(with_cell(taps(rows)), spread=spread), "chained")
    for step in day.PASSES:
        df = settle(step(df, spread=spread), "ordered")
    assert by_id(df, "id_etapa") == {1: 2, 2: 1}


@both_paths
def test_next_stage_of_check_outs_only_does_not_order(taps, spread):
    # The stage after the tie holds only a check-out, so the first pass leaves the tie alone.
    df = with_cell(taps([tap(1, "SUB", 9, 0), tap(2, "SUB", 9, 0), tap(3, "TRE", 10, 0, OUT)]))
    df = df.withColumn("id_etapa", F.when(F.col("id") < 3, 2).otherwise(3).cast("long"))
    assert by_id(ties.order_by_next(df, spread=spread), "id_etapa") == {1: 2, 2: 2, 3: 3}


@both_paths
def test_unknown_kind_stands_for_the_previous_stage_before_a_check_out(taps, spread):
    rows = [tap(1, "TRE", 7, 0, OUT, lon=-58.5), tap(2, "COL", 7, 0, lon=-58.4), tap(3, "SUB", 9, 0, lon=-58.49),
            tap(4, "SUB", 9, 0, lon=-58.41)]
    df = with_cell(taps(rows)).withColumn("id_etapa", F.when(F.col("id") < 3, 1).otherwise(3).cast("long"))
    # Measured from tap 2, tap 3 is the farther one and keeps the stage.
    assert by_id(ties.order_by_previous(df, spread=spread), "id_etapa") == {1: 1, 2: 1, 3: 3, 4: 2}


@both_paths
def test_metro_deletes_by_fewer_columns_than_it_detects(taps, spread):
    metro = dict(modo="SUB", hora=9, etapa_red_sube=0, id_ramal=1010)
    rows = [dict(metro, id=1, lon=-58.49), dict(metro, id=2, lon=-58.45), dict(metro, id=3, lon=-58.45),
            dict(metro, id=4, hora=10)]
    assert set(by_id(clean.drop_double_taps(taps(rows), METRO, spread=spread), "id")) == {3, 4}


@both_paths
def test_unknown_vehicles_are_never_double_taps(taps, spread):
    rows = [dict(id=1, interno_bus=7), dict(id=2, interno_bus=7), dict(id=3), dict(id=4)]
    assert set(by_id(clean.drop_double_taps(taps(rows), BUS, spread=spread), "id")) == {2, 3, 4}


@both_paths
def test_double_taps_of_one_mode_also_remove_equal_rows_of_others(taps, spread):
    rows = [dict(id=1, interno_bus=7, modo="TRE"), dict(id=2, interno_bus=7), dict(id=3, interno_bus=7)]
    assert set(by_id(clean.drop_double_taps(taps(rows), BUS, spread=spread), "id")) == {3}


def test_box_bounds_are_inside(taps):
    rows = [dict(id=1, lat=-36, lon=-61), dict(id=2, lat=-33, lon=-57), dict(id=3, lat=-36.000001, lon=-60),
            dict(id=4, lat=-34, lon=-56.999999), dict(id=5, lat=None), dict(id=6, lon=None)]
    assert set(by_id(clean.geo_clean(taps(rows)), "id")) == {1, 2}


def test_unknown_branches_keep_their_line(taps, line_table):
    rows = [dict(id=1, id_ramal=10, id_linea=5), dict(id=2, id_ramal=11, id_linea=5), dict(id=3, id_ramal=None, id_linea=5)]
    assert by_id(clean.normalize_line(taps(rows), line_table([(10, 3), (10, 2), (None, 9)])), "id_linea") == {1: 2, 2: 5, 3: 5}


def run(taps_, stops, lines, hot_rows):
    config = Config(hot_rows=hot_rows)
    stages = settle(day.finished_stages(taps_, stops, lines, config), "stages")
    return stages.collect(), trips.build_trips(stages).collect(), trips.build_cards(stages).collect()


@pytest.mark.parametrize("hot_rows", [1_000, 1])
def test_destinations_close_the_day_on_the_own_line(taps, stop_table, line_table, hot_rows):
    # Line 1 at A, line 2 at B; each line has a stop at both ends, one cell or two off.
    a, b = (-58.5, -34.6), (-58.45, -34.6)
    stops = stop_table([(1, 1, 10, *a), (2, 1, 10, -58.451, -34.6), (3, 2, 20, *b), (4, 2, 20, -58.499, -34.6)])
    rows = [tap(1, "COL", 8, 0, lon=a[0], id_linea=1, id_ramal=10), tap(2, "COL", 18, 0, lon=b[0], id_linea=2, id_ramal=20)]
    stages, trip_rows, cards = run(taps(rows), stops, line_table([(10, 1), (20, 2)]), hot_rows)
    assert {r.id: (r.parada_id_o, r.parada_id_d) for r in stages} == {1: (1, 2), 2: (3, 4)}
    assert {r.id_viaje: (r.cantidad_etapas, r.parada_id_o, r.parada_id_d, r.hora, r.etapas_incompletas) for r in trip_rows} \
        == {1: (1, 1, 2, 8, False), 2: (1, 3, 4, 18, False)}
    assert [(r.parada_hogar, r.sexo, r.viajes_con_etapas_incompletas) for r in cards] == [(1, "M", False)]


@both_paths
def test_next_tap_wraps_round_before_check_outs_go(taps, spread):
    rows = [tap(1, "TRE", 6, 0, OUT), tap(2, "COL", 8, 0), tap(3, "COL", 18, 0)]
    df = destinations.next_trx(settle(chain.chain(taps(rows), spread=spread), "chained"), spread=spread)
    assert {r.id: (r.fila, r.next.id) for r in df.collect()} == {2: (1, 3), 3: (2, 1), 1: (3, 2)}


def cells_east(n):
    """Longitude of the centre of the cell n steps east of the origin."""
    return round(-58.5 + n * 66 * 3 ** 0.5 / 91637, 6)


def test_cuts(taps, stop_table, line_table, hot_rows=1_000):
    # Card 1 boards 6 cells from its stop, card 2 once 7 cells off; both have their next stop at 17
    # and at 18 cells.
    far, far2 = cells_east(100), cells_east(300)
    stops = stop_table([(1, 1, 10, cells_east(6), -34.6), (2, 2, 20, far, -34.6), (3, 1, 10, far + 17 * 0.001247436, -34.6),
                        (4, 2, 20, cells_east(-18), -34.6), (5, 3, 30, far2, -34.6)])
    first = dict(modo="COL", lon=-58.5, id_linea=1, id_ramal=10)
    second = dict(modo="COL", lon=far, id_linea=2, id_ramal=20)
    rows = [dict(first, id=1, hora=8), dict(second, id=2, hora=9),
            dict(first, id=3, id_tarjeta=2, hora=8), dict(second, id=4, id_tarjeta=2, hora=9),
            dict(id=5, id_tarjeta=2, hora=10, id_linea=3, id_ramal=30, lon=cells_east(293))]
    stages, trip_rows, cards = run(taps(rows), stops, line_table([(10, 1), (20, 2), (30, 3)]), hot_rows)
    got = {r.id: (r.parada_id_o, r.parada_id_d) for r in stages}
    assert got == {1: (1, 3), 2: (2, None), 3: (1, 3), 4: (2, None)}
    assert {(r.id_tarjeta, r.id_viaje): r.etapas_incompletas for r in trip_rows} == \
        {(1, 1): False, (1, 2): True, (2, 1): False, (2, 2): True}
    assert all(r.viajes_con_etapas_incompletas for r in cards)


def finished(taps, rows, **more):
    df = taps(rows).withColumns({"id_viaje": F.lit(1).cast("long"), "id_etapa": F.col("id"), "parada_id_o": F.col("id"),
                                 "parada_id_d": F.col("id")})
    return df.withColumns({k: v for k, v in more.items()})


def test_sex_needs_exactly_one_record(taps):
    rows = [dict(id=1, id_tarjeta=1, sexo="M"), dict(id=2, id_tarjeta=1, sexo=""), dict(id=3, id_tarjeta=2, sexo="M"),
            dict(id=4, id_tarjeta=2, sexo="F"), dict(id=5, id_tarjeta=3, sexo=""), dict(id=6, id_tarjeta=3, sexo=None)]
    stages = finished(taps, rows)
    assert {r.id_tarjeta: r.sexo for r in trips.build_cards(stages).collect()} == {1: "M", 2: None, 3: None}
    assert [tuple(r) for r in trips.card_sex(stages).collect()] == [(1, "M")]


def test_the_last_stage_decides_the_destination(taps):
    stages = finished(taps, [dict(id=1), dict(id=2, modo="SUB")], parada_id_d=F.expr("if(id = 1, 9, null)"))
    row = trips.build_trips(stages).collect()[0]
    assert (row.cantidad_etapas, row.etapas_colectivo, row.etapas_subte, row.parada_id_o, row.parada_id_d) == (2, 1, 1, 1, None)
    assert row.etapas_incompletas is True


def test_trips_without_id_are_never_incomplete(taps):
    stages = finished(taps, [dict(id=1)], id_viaje=F.lit(None).cast("long"), parada_id_d=F.lit(None).cast("long"))
    assert trips.build_trips(stages).collect()[0].etapas_incompletas is False


def test_one_destination_per_stage_and_the_cut_comes_after_the_choice(spark, taps):
    # Two trains share a stage. The one with a known kind is chosen although its candidate is too far,
    # so the other one gets no destination.
    df = taps([tap(1, "TRE", 8, 0, IN), tap(2, "TRE", 8, 0)]).withColumns({
        "id_viaje": F.lit(1), "id_etapa": F.lit(1),
        "next": F.struct(F.lit(9).alias("id"), F.when(F.col("id") == 1, F.lit(-58)).otherwise(-59).cast("decimal(9,6)").alias("lon"),
                         F.lit(-34).cast("decimal(9,6)").alias("lat"))})
    lookup = spark.createDataFrame([(1, -58, -34, 5, 20), (1, -59, -34, 6, 3)], "line long, lon int, lat int, stop long, stop_dist long") \
        .withColumns({"lon": F.col("lon").cast("decimal(9,6)"), "lat": F.col("lat").cast("decimal(9,6)")})
    for spread in (False, True):
        assert by_id(destinations.impute_destination(df, lookup, spread=spread), "parada_id_d") == {1: None, 2: None}
    near = lookup.withColumn("stop_dist", F.lit(17).cast("long"))
    assert by_id(destinations.impute_destination(df, near), "parada_id_d") == {1: 5, 2: None}
