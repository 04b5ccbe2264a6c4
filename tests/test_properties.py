"""Operators against direct definitions on dense random tables."""

import math
import random

import numpy as np
import pytest
from conftest import by_id
from pyspark.sql import functions as F

from tripchain.config import BUS, METRO, TRAIN, Config
from tripchain.functions.geo import point_in_buffer
from tripchain.functions.hexgrid import M_PER_LAT, M_PER_LON, distance, with_cell
from tripchain.operators import chain, clean, destinations, ties
from tripchain.operators.nearest_cells import hex_distance_to_set, nearest_cells
from tripchain.operators.skew import neighbour, rank_rows
from tripchain.session import settle


def random_taps(seed, rows=400, cards=12, spots=40):
    r = random.Random(seed)
    return [dict(
        id=i, id_tarjeta=r.randrange(cards), modo=r.choice(["COL", "SUB", "TRE"]), hora=r.choice([7, 8, 9, 10, None]),
        etapa_red_sube=r.choice([0, 0, 1, None]), tipo_trx_tren=r.choice([None, None, "CHECK IN", "CHECK OUT"]),
        id_linea=r.choice([1, 2, None]), id_ramal=r.choice([10, 20, None]), interno_bus=r.choice([1, 2, None]),
        lat=-34.6 + r.randrange(3) / 100, lon=-58.5 + r.randrange(spots) / 1000) for i in range(rows)]


@pytest.mark.parametrize("mode", [BUS, METRO, TRAIN])
def test_double_taps_equal_the_pairwise_definition(taps, mode):
    rows = random_taps(len(clean.DOUBLE_TAPS[mode][0]), rows=600, cards=3, spots=2)
    df = taps(rows)
    detect, delete = clean.DOUBLE_TAPS[mode]
    key = lambda row, cols: tuple(round(row[c], 6) if isinstance(row[c], float) else row[c] for c in ("id_tarjeta", *cols))
    counts = {}
    for row in rows:
        if row["modo"] == mode:
            counts[key(row, detect)] = counts.get(key(row, detect), 0) + 1
    doubled = [row for row in rows if None not in key(row, detect) and counts.get(key(row, detect), 0) > 1]
    kept = {row["id"] for row in rows if not any(
        row["id"] < d["id"] and key(row, delete) == key(d, delete) for d in doubled)}
    assert 0 < len(kept) < len(rows)
    for spread in (False, True):
        assert set(by_id(clean.drop_double_taps(df, mode, spread=spread), "id")) == kept


def test_spread_steps_equal_plain_ones(taps):
    """The whole sequence, step by step on the same input, with tied and unknown values."""
    df = settle(with_cell(taps(random_taps(5))), "input")
    steps = [chain.chain, clean.drop_singles, ties.order_by_next, ties.order_by_previous, ties.order_by_id, destinations.next_trx]
    for step in steps:
        plain, spread = settle(step(df, spread=False), "plain"), settle(step(df, spread=True), "spread")
        columns = sorted(plain.columns)
        assert sorted(spread.columns) == columns, step.__name__
        assert sorted(map(repr, plain.select(columns).collect())) == sorted(map(repr, spread.select(columns).collect())), step.__name__
        df = plain


def test_results_do_not_depend_on_row_order_or_partitions(taps):
    df = with_cell(taps(random_taps(7)))
    shuffled = df.orderBy(F.rand(3)).repartition(5)
    run = lambda d: by_id(ties.order_by_id(ties.order_by_previous(ties.order_by_next(chain.chain(d)))),
                          "id_etapa", "id_viaje")
    assert run(df) == run(shuffled)


def test_ranks_and_neighbours_cross_blocks(spark):
    # Ids and stages far apart lie in different blocks.
    rows = [(1, (i * 7919) % 5, i * 300_000) for i in range(60)]
    df = spark.createDataFrame(rows, "card int, v int, id long")
    order = {"v": F.col("v").desc()}
    for coarse in (None, {"v": F.col("v").desc()}):
        ranked = rank_rows(df, ["card"], order, "place", coarse=coarse, spread=True)
        expected = sorted(rows, key=lambda r: (-r[1], r[2]))
        assert by_id(ranked, "place") == {r[2]: n + 1 for n, r in enumerate(expected)}
    ids = sorted(r[2] for r in rows)
    for forward in (True, False):
        found = neighbour(df.select("card", "id", "v"), ["card"], "id", ["v"], "other", forward).collect()
        step = 1 if forward else -1
        expected = {i: ids[n + step] if 0 <= n + step < len(ids) else None for n, i in enumerate(ids)}
        assert {r.id: r.other and r.other.id for r in found} == expected


def hex_steps(q, r, sq, sr):
    dq, dr = q[:, None] - sq[None, :], r[:, None] - sr[None, :]
    return np.maximum(np.maximum(abs(dq), abs(dr)), abs(dq + dr)).min(axis=1)


@pytest.mark.parametrize("spread, size", [(10, 30), (200, 40), (5000, 7), (3000, 1)])
def test_hex_search_equals_all_pairs(spread, size):
    rng = np.random.default_rng(size)
    q, r, sq, sr = (rng.integers(-spread, spread, n) for n in (200, 200, size, size))
    assert (hex_distance_to_set(q, r, sq, sr) == hex_steps(q, r, sq, sr)).all()


def test_sliced_search_equals_all_pairs(spark, monkeypatch):
    from tripchain.operators import nearest_cells as module
    monkeypatch.setattr(module, "BAND_ROWS", 3)
    rng = np.random.default_rng(2)
    make = lambda n: spark.createDataFrame(
        list({(int(g), int(q), int(r)) for g, q, r in zip(rng.integers(0, 3, n), rng.integers(-50, 50, n), rng.integers(-50, 50, n))}),
        "g long, cell_q long, cell_r long")
    members, targets = make(120), make(40)
    found = nearest_cells(members, targets, ["g"]).toPandas()
    m, t = members.toPandas(), targets.toPandas()
    assert len(found) == len(m)
    for g, part in found.groupby("g"):
        own = t[t.g == g]
        expected = hex_steps(part.cell_q.to_numpy(), part.cell_r.to_numpy(), own.cell_q.to_numpy(), own.cell_r.to_numpy())
        assert (part["_dist"].to_numpy() == expected).all()


def test_cells_hold_their_points_and_distances_bound_metres(spark):
    rng = random.Random(4)
    rows = [(i, rng.uniform(-61, -57), rng.uniform(-36, -33), rng.uniform(-0.025, 0.025), rng.uniform(-0.025, 0.025)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, lon double, lat double, dx double, dy double").withColumns(
        {"lon2": F.col("lon") + F.col("dx"), "lat2": F.col("lat") + F.col("dy")})
    cells = with_cell(with_cell(df), lon="lon2", lat="lat2", q="q2", r="r2").withColumn(
        "steps", F.expr(distance("cell_q", "cell_r", "q2", "r2")))
    pdf = cells.withColumn("inside", point_in_buffer("lon", "lat", "lon2", "lat2")).toPandas()
    side = 66.0
    x, y = side * math.sqrt(3) * (pdf.cell_q + pdf.cell_r / 2), side * 1.5 * pdf.cell_r
    off = np.hypot((pdf.lon + 58.5) * M_PER_LON - x, (pdf.lat + 34.6) * M_PER_LAT - y)
    assert off.max() <= side + 1e-6
    # Pairs within the cuts are inside the buffer.
    assert (pdf.steps <= Config().origin_cells).sum() > 500 and pdf.inside[pdf.steps <= Config().destination_cells].all()


def test_buffer_is_the_polygon(spark):
    rng = random.Random(9)
    points = [(i, *(0.03 * rng.uniform(0.98, 1.01) * f(a) for f in (math.cos, math.sin)))
              for i, a in enumerate(rng.uniform(0, 2 * math.pi) for _ in range(5_000))]
    points += [(-1, 0.03, 0.0), (-2, 0.0, -0.03), (-3, 0.031, 0.0)]
    df = spark.createDataFrame(points, "id long, x double, y double").withColumn(
        "inside", point_in_buffer("x", "y", "0.0", "0.0"))
    corners = [(0.03 * math.cos(k * math.pi / 16), 0.03 * math.sin(k * math.pi / 16)) for k in range(33)]

    def left_of_all(x, y):
        return all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-11
                   for (ax, ay), (bx, by) in zip(corners, corners[1:]))

    got = {r.id: r.inside for r in df.collect()}
    assert got == {i: left_of_all(x, y) for i, x, y in points}
    assert got[-1] and got[-2] and not got[-3]
