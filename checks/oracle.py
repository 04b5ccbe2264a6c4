"""DuckDB SQL for every named query, written on its own terms: set-based joins, counts of
smaller rows and semi joins where the Spark side uses windows and aggregates.

Short column names inside: card, la/lo (thousandths of a degree), bus, kind, red, cq/cr (cell).
"""

from __future__ import annotations

import math

# Stand-ins that sort unknown values last.
_LAST_TEXT = "'~'"
_LAST_INT = "9000000000000000000"
_DAY = (f"(coalesce({{0}}.trip, {_LAST_INT}), coalesce({{0}}.stage, {_LAST_INT}), "
        f"coalesce({{0}}.kind, {_LAST_TEXT}), {{0}}.id)")
_TAP = f"(coalesce({{0}}.hour, {_LAST_INT}), coalesce({{0}}.red, {_LAST_INT}), coalesce({{0}}.kind, {_LAST_TEXT}))"


def _cell(source: str, key: str) -> str:
    """Rows of ``source`` with cq, cr: cube rounding of the planar hexagon grid."""
    x, y = "((lo / 1000.0::DOUBLE) + 58.5::DOUBLE) * 91637.0::DOUBLE", "((la / 1000.0::DOUBLE) + 34.6::DOUBLE) * 111195.0::DOUBLE"
    return f"""
      SELECT * EXCLUDE (fq, fr, nq, nr, ns, eq, er, es),
             CASE WHEN eq > er AND eq > es THEN -nr - ns ELSE nq END AS cq,
             CASE WHEN eq > er AND eq > es THEN nr WHEN er > es THEN -nq - ns ELSE nr END AS cr
      FROM (SELECT *, abs(nq - fq) AS eq, abs(nr - fr) AS er, abs(ns + fq + fr) AS es
            FROM (SELECT *, floor(fq + 0.5)::BIGINT AS nq, floor(fr + 0.5)::BIGINT AS nr, floor(-fq - fr + 0.5)::BIGINT AS ns
                  FROM (SELECT {key}, ({x} / sqrt(3.0::DOUBLE) - {y} / 3.0::DOUBLE) / 66.0::DOUBLE AS fq,
                               ({y} * 2.0::DOUBLE / 3.0::DOUBLE) / 66.0::DOUBLE AS fr
                        FROM {source})))"""


def _steps(a: str, b: str) -> str:
    return (f"greatest(abs({a}.cq - {b}.cq), abs({a}.cr - {b}.cr), "
            f"abs({a}.cq - {b}.cq + {a}.cr - {b}.cr))")


def _inside(p: str, s: str) -> str:
    """Point p in the 32-sided polygon round s: behind all 32 sides."""
    dx, dy = f"(({p}.lo - {s}.lo) / 1000.0::DOUBLE)", f"(({p}.la - {s}.la) / 1000.0::DOUBLE)"
    sides = ", ".join(
        f"{dx} * {math.cos(a)!r}::DOUBLE + {dy} * {math.sin(a)!r}::DOUBLE"
        for a in ((k + 0.5) * math.pi / 16 for k in range(32)))
    near = f"abs({p}.lo - {s}.lo) <= 30 AND abs({p}.la - {s}.la) <= 30"
    return f"({near} AND greatest({sides}) <= {0.03 * math.cos(math.pi / 32)!r}::DOUBLE + 1e-9::DOUBLE)"


def _several(source: str) -> str:
    """Rows of the cards that have at least two."""
    return f"SELECT * FROM {source} WHERE card IN (SELECT card FROM {source} GROUP BY card HAVING count(*) >= 2)"


def _without_doubles(source: str, mode: str, seen: list[str], gone: list[str]) -> str:
    """Rows for which no repeated tap with a higher id has the same ``gone`` columns."""
    seen_cols, same = ", ".join(["card", *seen]), " AND ".join(f"e.{c} = d.{c}" for c in ["card", *gone])
    return f"""
      SELECT e.* FROM {source} e ANTI JOIN
        (SELECT t.* FROM {source} t SEMI JOIN
          (SELECT {seen_cols} FROM {source} WHERE modo = '{mode}' GROUP BY ALL HAVING count(*) >= 2)
          USING ({seen_cols})) d
      ON {same} AND e.id < d.id"""


_BUS_KEYS = ["linea", "bus", "hour", "red"]
_METRO_SEEN, _METRO_GONE = ["ramal", "la", "lo", "hour", "red"], ["ramal", "hour", "red"]
_TRAIN_KEYS = ["linea", "la", "lo", "kind", "hour", "red"]


def _renumbered(source: str, moves: str) -> str:
    """Stage minus the number of rows of the same stage that come first in ``moves`` (id, place)."""
    return f"""
      SELECT t.* REPLACE (t.stage - coalesce(m.ahead, 0) AS stage) FROM {source} t LEFT JOIN
        (SELECT a.id, count(b.id) AS ahead FROM {moves} a LEFT JOIN {moves} b
         ON a.card = b.card AND a.stage = b.stage AND (b.d, b.id) < (a.d, a.id) GROUP BY a.id) m
      ON t.id = m.id"""


def _tied(source: str) -> str:
    return f"""
      SELECT card, stage, count(*) AS n FROM {source}
      WHERE modo IN ('SUB', 'COL') AND stage IS NOT NULL GROUP BY ALL HAVING count(*) > 1"""


def _nearest_row(kind: str, column: str, modes: str) -> str:
    """Origin stop of the places of some modes: nearest in the buffer, then the cut."""
    return f"""
      SELECT '{kind}' AS route_kind, route, lo, la, best.p AS stop, best.d AS stop_dist FROM (
        SELECT p.{column} AS route, p.lo, p.la, min({{'d': {_steps('p', 's')}, 'p': s.id}}) AS best
        FROM (SELECT DISTINCT {column}, lo, la, cq, cr FROM linetaps WHERE card IS NOT NULL AND modo IN ({modes})) p
        JOIN st s ON s.{column} = p.{column} AND {_inside('p', 's')}
        GROUP BY ALL)
      WHERE best.d <= 6"""


CTES: dict[str, str] = {
    # Derived inputs.
    "ev": """
      SELECT event_id AS e, user_id AS u, day(ts) AS dd, hour(ts)::BIGINT AS hour, (props->>'k')::BIGINT AS k,
             CASE event_type WHEN 'error' THEN 'SUB' WHEN 'signup' THEN 'TRE' ELSE 'COL' END AS modo
      FROM events""",
    "trx": """
      SELECT e * 2 + c AS id, CASE WHEN e % 97 <> 0 THEN u * 100 + dd // 3 END AS card, modo,
             CASE WHEN e % 89 = 0 THEN NULL WHEN e % 83 = 0 THEN 0
                  ELSE -34600 + CASE modo WHEN 'COL' THEN (e * 53) % 47 ELSE (k % 7) * 6 END END::BIGINT AS la,
             CASE WHEN e % 89 = 0 THEN NULL WHEN e % 83 = 0 THEN 0
                  ELSE -58500 + CASE modo WHEN 'COL' THEN (e * 37) % 61 ELSE (k % 7) * 9 END END::BIGINT AS lo,
             CASE WHEN e % 11 = 0 THEN '' WHEN u % 7 = 0 THEN NULL
                  WHEN (u + (e % 211 = 0)::INT) % 2 = 0 THEN 'M' ELSE 'F' END AS sexo,
             CASE WHEN modo = 'COL' THEN e % 2 END AS bus,
             CASE WHEN modo <> 'TRE' THEN NULL WHEN k % 5 < 2 THEN 'CHECK IN' WHEN k % 5 < 4 THEN 'CHECK OUT'
                  ELSE 'CHECK OUT SIN CHECKIN' END AS kind,
             CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END::BIGINT AS red,
             CASE modo WHEN 'SUB' THEN 100 WHEN 'TRE' THEN 200 ELSE 1 + k % 5 END::BIGINT AS linea,
             CASE modo WHEN 'SUB' THEN (101 + k % 2) * 10 WHEN 'TRE' THEN (201 + k % 3) * 10 + e % 2
                  ELSE (1 + k % 5) * 10 + e % 2 END::BIGINT AS ramal,
             k % 8 AS tarifa, hour
      FROM ev, (VALUES (0), (1)) v(c) WHERE c = 0 OR e % 23 = 0""",
    "st0": """
      SELECT p_partkey AS id, p_name AS nombre, linea, linea * 10 + CASE WHEN linea IN (101, 102) THEN 0 ELSE (p_partkey // 10) % 2 END AS ramal,
             -58500 + (p_partkey * 29) % 61 AS lo, -34600 + (p_partkey * 41) % 47 AS la
      FROM (SELECT *, CASE WHEN p_partkey % 10 < 5 THEN 1 + p_partkey % 10 WHEN p_partkey % 10 < 7 THEN 96 + p_partkey % 10
                           ELSE 194 + p_partkey % 10 END AS linea FROM part)""",
    "st": _cell("st0", "*"),
    "ln": "SELECT DISTINCT ramal, linea FROM st WHERE ramal <> 51",
    "cl": """
      SELECT DISTINCT cq || '_' || cr AS h3, lpad(n_nationkey::VARCHAR, 9, '0') AS radio, lpad(n_nationkey::VARCHAR, 5, '0') AS depto,
             n_name AS departamento, r_name AS provincia
      FROM st JOIN nation ON n_nationkey = ((cq + cr) % 25 + 25) % 25 JOIN region ON r_regionkey = n_regionkey""",
    # Ids.
    "base": "SELECT * FROM trx WHERE card IS NOT NULL AND coalesce(kind, '') <> 'CHECK OUT SIN CHECKIN'",
    "e1": f"""
      SELECT a.*, b.stage FROM base a JOIN (
        SELECT x.id, count(y.id) AS stage FROM base x LEFT JOIN base y
        ON y.card = x.card AND coalesce(y.kind, '') <> 'CHECK OUT' AND {_TAP.format('y')} <= {_TAP.format('x')}
        GROUP BY x.id) b ON a.id = b.id""",
    "e2": "SELECT *, stage - red AS tmp FROM e1",
    "lone": """
      SELECT card, tmp, count(*) AS n FROM e2 GROUP BY ALL HAVING bool_and(coalesce(kind, '') = 'CHECK OUT')""",
    "aims": """
      SELECT l.card, l.tmp, max(p.tmp) AS trip_aim, max(p.stage) FILTER (p.kind = 'CHECK IN') AS stage_aim
      FROM lone l LEFT JOIN e2 p ON p.card = l.card AND p.tmp < l.tmp WHERE l.tmp IS NOT NULL GROUP BY ALL""",
    "e3": """
      SELECT e.* REPLACE (CASE WHEN a.card IS NULL THEN e.stage ELSE a.stage_aim END AS stage,
                          CASE WHEN a.card IS NULL THEN e.tmp ELSE a.trip_aim END AS tmp)
      FROM e2 e LEFT JOIN aims a ON a.card = e.card AND a.tmp = e.tmp""",
    "e4": """
      SELECT e.*, v.trip FROM e3 e LEFT JOIN (
        SELECT x.card, x.tmp, count(DISTINCT y.tmp) AS trip FROM (SELECT DISTINCT card, tmp FROM e3) x
        JOIN e3 y ON y.card = x.card AND y.tmp <= x.tmp GROUP BY ALL) v ON v.card = e.card AND v.tmp = e.tmp""",
    # Cleaning.
    "inbox": _cell("(SELECT * FROM trx WHERE la BETWEEN -36000 AND -33000 AND lo BETWEEN -61000 AND -57000)", "*"),
    "geo": "SELECT e.*, i.cq, i.cr FROM e4 e JOIN inbox i ON i.id = e.id",
    "c1": _several("geo"),
    "c2": "SELECT c.* REPLACE (coalesce(l.linea, c.linea) AS linea) FROM c1 c LEFT JOIN ln l ON l.ramal = c.ramal",
    "linetaps": """
      SELECT i.* REPLACE (coalesce(l.linea, i.linea) AS linea) FROM inbox i LEFT JOIN ln l ON l.ramal = i.ramal
      WHERE coalesce(i.kind, '') <> 'CHECK OUT SIN CHECKIN'""",
    "d1": _without_doubles("c2", "COL", _BUS_KEYS, _BUS_KEYS),
    "d2": _without_doubles("d1", "SUB", _METRO_SEEN, _METRO_GONE),
    "d3": _without_doubles("d2", "TRE", _TRAIN_KEYS, _TRAIN_KEYS),
    "c3": _several("d3"),
    # Ties: to the next stage, from the previous one, by id.
    "tieda": _tied("c3"),
    "aftera": "SELECT t.card, t.stage, min(z.stage) AS nxt FROM tieda t JOIN c3 z ON z.card = t.card AND z.stage > t.stage GROUP BY ALL",
    "movea": f"""
      SELECT a.id, a.card, a.stage, min({_steps('a', 'b')}) AS d FROM aftera t
      JOIN c3 a ON a.card = t.card AND a.stage = t.stage AND coalesce(a.kind, '') <> 'CHECK OUT'
      JOIN c3 b ON b.card = t.card AND b.stage = t.nxt AND coalesce(b.kind, '') <> 'CHECK OUT' GROUP BY ALL""",
    "t1": _renumbered("c3", "movea"),
    "tiedb": _tied("t1"),
    "beforeb": "SELECT t.card, t.stage, max(z.stage) AS prv FROM tiedb t JOIN t1 z ON z.card = t.card AND z.stage < t.stage GROUP BY ALL",
    "seatb": f"""
      SELECT t.card, t.stage, arg_max({{'cq': z.cq, 'cr': z.cr}}, {{'k': coalesce(z.kind, {_LAST_TEXT}), 'i': -z.id}}) AS seat
      FROM beforeb t JOIN t1 z ON z.card = t.card AND z.stage = t.prv GROUP BY ALL""",
    "moveb": """
      SELECT a.id, a.card, a.stage, -greatest(abs(a.cq - seat.cq), abs(a.cr - seat.cr), abs(a.cq + a.cr - seat.cq - seat.cr)) AS d
      FROM seatb t JOIN t1 a ON a.card = t.card AND a.stage = t.stage""",
    "t2": _renumbered("t1", "moveb"),
    "tiedc": _tied("t2"),
    "movec": "SELECT a.id, a.card, a.stage, 0 AS d FROM t2 a SEMI JOIN tiedc t ON t.card = a.card AND t.stage = a.stage",
    "t3": _renumbered("t2", "movec"),
    # Origins.
    "origins": " UNION ALL ".join([_nearest_row("linea", "linea", "'COL'"), _nearest_row("ramal", "ramal", "'SUB', 'TRE'")]),
    "o1": """
      SELECT t.*, o.stop AS po FROM t3 t JOIN origins o ON o.lo = t.lo AND o.la = t.la
      AND ((t.modo = 'COL' AND o.route_kind = 'linea' AND o.route = t.linea)
        OR (t.modo <> 'COL' AND o.route_kind = 'ramal' AND o.route = t.ramal))""",
    "o2": _several("o1"),
    # Next tap: by the number of taps before it.
    "place": f"""
      SELECT a.*, 1 + b.n AS fila FROM o2 a JOIN (
        SELECT x.id, count(y.id) AS n FROM o2 x LEFT JOIN o2 y ON y.card = x.card AND {_DAY.format('y')} < {_DAY.format('x')}
        GROUP BY x.id) b ON a.id = b.id""",
    "nx": """
      SELECT a.*, coalesce(n.id, f.id) AS nid, coalesce(n.lo, f.lo) AS nlo, coalesce(n.la, f.la) AS nla,
             coalesce(n.cq, f.cq) AS ncq, coalesce(n.cr, f.cr) AS ncr
      FROM place a LEFT JOIN place n ON n.card = a.card AND n.fila = a.fila + 1 JOIN place f ON f.card = a.card AND f.fila = 1""",
    # Destinations: one per card, trip and stage, then the cut.
    "goals": f"""
      SELECT g.linea, g.lo, g.la, min({{'d': {_steps('g', 's')}, 'p': s.id}}) AS best
      FROM (SELECT DISTINCT linea, nlo AS lo, nla AS la, ncq AS cq, ncr AS cr FROM nx WHERE coalesce(kind, '') <> 'CHECK OUT') g
      JOIN st s ON s.linea = g.linea AND {_inside('g', 's')} GROUP BY g.linea, g.lo, g.la""",
    "picks": f"""
      SELECT n.card, n.trip, n.stage, min({{'k': coalesce(n.kind, {_LAST_TEXT}), 'd': g.best.d, 'i': n.id, 'p': g.best.p}}) AS b
      FROM nx n JOIN goals g ON g.linea = n.linea AND g.lo = n.nlo AND g.la = n.nla
      WHERE coalesce(n.kind, '') <> 'CHECK OUT' GROUP BY ALL""",
    "dst": """
      SELECT n.*, p.b.p AS pd FROM nx n LEFT JOIN (SELECT * FROM picks WHERE b.d <= 17) p ON p.b.i = n.id""",
    "stages": "SELECT * FROM dst WHERE coalesce(kind, '') <> 'CHECK OUT'",
    # Trips and cards.
    "spots": f"""
      SELECT card, trip, min({{'a': coalesce(stage, {_LAST_INT}), 'b': coalesce(hour, {_LAST_INT}), 'i': id}}).i AS first_id,
             max({{'a': coalesce(stage, {_LAST_INT}), 'b': coalesce(hour, {_LAST_INT}), 'i': id}}).i AS last_id
      FROM stages GROUP BY ALL""",
    "trips": """
      SELECT s.card, s.trip, count(DISTINCT x.stage) AS n, count(*) FILTER (x.modo = 'SUB') AS sub,
             count(*) FILTER (x.modo = 'TRE') AS tre, count(*) FILTER (x.modo = 'COL') AS col,
             any_value(f.po) AS po, min(l.pd) AS pd, any_value(f.hour) AS hour,
             s.trip IS NOT NULL AND count(*) > count(x.pd) AS open
      FROM spots s JOIN stages x ON x.card = s.card AND x.trip IS NOT DISTINCT FROM s.trip
      JOIN stages f ON f.id = s.first_id JOIN stages l ON l.id = s.last_id GROUP BY s.card, s.trip""",
    "sexes": "SELECT card, any_value(sexo) AS sexo FROM stages WHERE sexo <> '' GROUP BY card HAVING count(DISTINCT sexo) = 1",
    "cards": f"""
      SELECT t.card, any_value(h.po) AS home, any_value(x.sexo) AS sexo, bool_or(t.open) AS open FROM trips t
      JOIN (SELECT a.card, a.po FROM trips a WHERE NOT EXISTS (SELECT 1 FROM trips b WHERE b.card = a.card
            AND coalesce(b.trip, {_LAST_INT}) < coalesce(a.trip, {_LAST_INT}))) h ON h.card = t.card
      LEFT JOIN sexes x ON x.card = t.card GROUP BY t.card""",
    "geography": """
      SELECT st.id, st.cq || '_' || st.cr AS h3, cl.radio, cl.depto, cl.departamento, cl.provincia
      FROM st LEFT JOIN cl ON cl.h3 = st.cq || '_' || st.cr""",
    "od": """
      SELECT s.*, o.h3 AS h3o, o.radio AS ro, o.depto AS eo, o.departamento AS deo, o.provincia AS pro,
             d.h3 AS h3d, d.radio AS rd, d.depto AS ed, d.departamento AS ded, d.provincia AS prd
      FROM stages s LEFT JOIN geography o ON o.id = s.po LEFT JOIN geography d ON d.id = s.pd""",
    "odt": """
      SELECT s.*, o.h3 AS h3o, o.radio AS ro, o.depto AS eo, o.departamento AS deo, o.provincia AS pro,
             d.h3 AS h3d, d.radio AS rd, d.depto AS ed, d.departamento AS ded, d.provincia AS prd
      FROM trips s LEFT JOIN geography o ON o.id = s.po LEFT JOIN geography d ON d.id = s.pd""",
}

_TRX_COLUMNS = """id, card AS id_tarjeta, modo, la AS lat_milli, lo AS lon_milli, sexo, bus AS interno_bus, kind AS tipo_trx_tren,
  red AS etapa_red_sube, linea AS id_linea, ramal AS id_ramal, tarifa AS id_tarifa, hour AS hora"""
_TIES = "SELECT id, card AS id_tarjeta, stage AS id_etapa, trip AS id_viaje FROM {}"
_DEDUP = "SELECT id, card AS id_tarjeta, modo, stage AS id_etapa FROM {}"


def _repeated(mode: str, columns: list[str]) -> str:
    every = ["linea", "ramal", "bus", "la", "lo", "kind"]
    shown = ", ".join(c if c in columns else f"NULL AS {c}" for c in every)
    grouped = ", ".join(["card", *columns])
    return f"SELECT '{mode}' AS modo, card, hour, red, {shown}, count(*) AS n FROM c2 WHERE modo = '{mode}' GROUP BY {grouped} HAVING count(*) > 1"


def _levels(source: str, wanted, *by: str) -> str:
    """Counts at pairs of levels, a statement for each pair."""
    names = ["departamento", "provincia", "todo"]
    kept = lambda end, column, shown: f"{column} AS {end}" if shown else f"NULL AS {end}"
    return " UNION ALL ".join(
        f"""SELECT {kept('departamento_o', 'deo', o < 1)}, {kept('provincia_o', 'pro', o < 2)}, {kept('departamento_d', 'ded', d < 1)},
      {kept('provincia_d', 'prd', d < 2)}, {''.join(b + ', ' for b in by)}count(*) AS cantidad, '{names[o]}' AS nivel_o, '{names[d]}' AS nivel_d
      FROM {source} GROUP BY ALL HAVING count(*) > 0""" for o in range(3) for d in range(3) if wanted(o, d))


RESULTS: dict[str, str] = {
    "base_stages": f"SELECT {_TRX_COLUMNS} FROM base",
    "stage_ids": "SELECT id, card AS id_tarjeta, stage AS id_etapa FROM e1",
    "trip_temp_id": "SELECT id, card AS id_tarjeta, stage AS id_etapa, tmp AS id_viaje_temp FROM e2",
    "checkout_only_trips": "SELECT card AS id_tarjeta, tmp AS id_viaje_temp, n AS checkouts FROM lone",
    "checkout_fix": "SELECT id, card AS id_tarjeta, stage AS id_etapa, tmp AS id_viaje_temp FROM e3",
    "trip_ids": "SELECT id, card AS id_tarjeta, stage AS id_etapa, trip AS id_viaje FROM e4",
    "hex_cell": "SELECT id, la AS lat_milli, lo AS lon_milli, cq AS cell_q, cr AS cell_r FROM inbox",
    "hex_distance": f"""SELECT b.id, f.id AS first_id, {_steps('b', 'f')} AS distancia
      FROM inbox b SEMI JOIN base ON base.id = b.id
      JOIN (SELECT card, min(id) AS m FROM inbox i SEMI JOIN base ON base.id = i.id GROUP BY card) g ON g.card = b.card
      JOIN inbox f ON f.id = g.m""",
    "geo_clean": "SELECT id, card AS id_tarjeta, stage AS id_etapa, trip AS id_viaje, cq AS cell_q, cr AS cell_r FROM geo",
    "drop_singles": "SELECT id, card AS id_tarjeta, stage AS id_etapa FROM c1",
    "normalize_line": "SELECT id, ramal AS id_ramal, linea AS id_linea FROM c2",
    "dup_groups": "SELECT modo, card AS id_tarjeta, hour AS hora, red AS etapa_red_sube, linea AS id_linea, ramal AS id_ramal, "
                  "bus AS interno_bus, la AS lat_milli, lo AS lon_milli, kind AS tipo_trx_tren, n AS taps FROM ("
                  + " UNION ALL ".join([_repeated("COL", _BUS_KEYS), _repeated("SUB", _METRO_SEEN), _repeated("TRE", _TRAIN_KEYS)]) + ")",
    "dedup_bus": _DEDUP.format("d1"),
    "dedup_metro": _DEDUP.format("d2"),
    "dedup_train": _DEDUP.format("d3"),
    "tied_groups": "SELECT card AS id_tarjeta, stage AS id_etapa, n AS taps FROM tieda",
    "tie_next": _TIES.format("t1"),
    "tie_prev": _TIES.format("t2"),
    "tie_id": _TIES.format("t3"),
    "point_in_buffer": f"""SELECT t.id, t.linea AS id_linea, count(s.id) AS paradas
      FROM (SELECT i.* REPLACE (coalesce(l.linea, i.linea) AS linea) FROM inbox i LEFT JOIN ln l ON l.ramal = i.ramal) t
      LEFT JOIN st s ON s.linea = t.linea AND {_inside('t', 's')} GROUP BY ALL""",
    "buffer_join": f"""SELECT linea AS line, lo AS lon_milli, la AS lat_milli, best.p AS stop, best.d AS stop_dist FROM (
      SELECT s.linea, g.lo, g.la, min({{'d': {_steps('g', 's')}, 'p': s.id}}) AS best
      FROM (SELECT DISTINCT linea, lo, la, cq, cr FROM linetaps WHERE card IS NOT NULL AND modo IN ('COL', 'SUB', 'TRE')) g
      JOIN st s ON s.linea = g.linea AND {_inside('g', 's')} GROUP BY s.linea, g.lo, g.la)""",
    "origin_union": "SELECT route_kind, route, lo AS lon_milli, la AS lat_milli, stop, stop_dist FROM origins",
    "origin_stop": "SELECT id, card AS id_tarjeta, stage AS id_etapa, po AS parada_id_o FROM o2",
    "next_trx": "SELECT id, card AS id_tarjeta, fila, nid AS id_lead FROM nx",
    "dest_stop": "SELECT id, card AS id_tarjeta, trip AS id_viaje, stage AS id_etapa, pd AS parada_id_d FROM dst",
    "drop_checkouts": f"""SELECT {_TRX_COLUMNS}, stage AS id_etapa, trip AS id_viaje, cq AS cell_q, cr AS cell_r,
      po AS parada_id_o, pd AS parada_id_d FROM stages""",
    "coverage": "SELECT count(*) AS etapas, count(pd) AS etapas_con_destino FROM stages",
    "trips": """SELECT card AS id_tarjeta, trip AS id_viaje, n AS cantidad_etapas, sub AS etapas_subte, tre AS etapas_tren,
      col AS etapas_colectivo, po AS parada_id_o, pd AS parada_id_d, hour AS hora, open AS etapas_incompletas FROM trips""",
    "card_sex": "SELECT card AS id_tarjeta, sexo FROM sexes",
    "cards": "SELECT card AS id_tarjeta, home AS parada_hogar, sexo, open AS viajes_con_etapas_incompletas FROM cards",
    "od_georef": """SELECT id, card AS id_tarjeta, po AS parada_id_o, pd AS parada_id_d, h3o AS h3_o, ro AS radio_2010_o,
      eo AS depto_2010_o, deo AS departamento_o, pro AS provincia_o, h3d AS h3_d, rd AS radio_2010_d, ed AS depto_2010_d,
      ded AS departamento_d, prd AS provincia_d FROM od""",
    "od_matrix": "SELECT deo AS departamento_o, ded AS departamento_d, hour AS hora, count(*) AS cantidad FROM od GROUP BY ALL",
    "od_rollup": _levels("od", lambda o, d: o == d, "hour AS hora"),
    "od_cube": _levels("odt", lambda o, d: True),
    "od_trips": """SELECT card AS id_tarjeta, trip AS id_viaje, n AS cantidad_etapas, hour AS hora, open AS etapas_incompletas,
      po AS parada_id_o, pd AS parada_id_d, h3o AS h3_o, ro AS radio_2010_o, eo AS depto_2010_o, deo AS departamento_o,
      pro AS provincia_o, h3d AS h3_d, rd AS radio_2010_d, ed AS depto_2010_d, ded AS departamento_d, prd AS provincia_d FROM odt""",
    "load_trx": f"SELECT {_TRX_COLUMNS} FROM trx",
    "load_stops": """SELECT id, linea AS id_linea, ramal AS id_ramal, nombre AS nombre_estacion, lo AS longitud_milli, la AS latitud_milli,
      cq || '_' || cr AS h3 FROM st""",
    "load_lines": """SELECT linea AS id_linea, 'L' || linea AS linea, CASE WHEN linea > 200 THEN 'TRE' WHEN linea > 100 THEN 'SUB' ELSE 'COL' END AS modo,
      ramal AS id_ramal, 'R' || ramal AS ramal_corto, 'Ramal ' || ramal AS ramal, NULL::VARCHAR AS provincia, NULL::VARCHAR AS municipio FROM ln""",
    "load_fares": """SELECT k % 8 AS id_tarifa, 'Tarifa ' || (k % 8) AS descripcion, 1800 + 25 * (k % 8) + count(*) % 25 AS centavos
      FROM ev GROUP BY k % 8""",
    "load_cells": "SELECT h3, radio AS radio_2010, depto AS depto_2010, departamento, provincia FROM cl",
    "sink_roundtrip": """SELECT t.card AS id_tarjeta, t.trip AS id_viaje, t.n AS cantidad_etapas, t.po AS parada_id_o, t.pd AS parada_id_d,
      c.home AS parada_hogar, c.sexo, c.open AS viajes_con_etapas_incompletas FROM trips t JOIN cards c ON c.card = t.card""",
    "anonymize": """SELECT event_id AS id, sha256('tripchain' || user_id) AS id_tarjeta,
      CASE WHEN event_id % 3 <> 0 THEN sha256('tripchain' || (event_id % 1000)) END AS interno_bus,
      -((34600000 - (event_id * 53) % 100000) // 1000) AS lat_milli, -((58500000 - (event_id * 37) % 100000) // 1000) AS lon_milli,
      hour(ts)::BIGINT AS hora FROM events""",
}


def _used(sql: str) -> list[str]:
    """The CTEs a statement needs, in order of definition."""
    import re

    words = lambda text: set(re.findall(r"\w+", text))
    needed, wanted = set(), words(sql)
    for name in reversed(CTES):
        if name in wanted:
            needed.add(name)
            wanted |= words(CTES[name])
    return [name for name in CTES if name in needed]


def oracle_sql() -> dict[str, str]:
    statements = {}
    for name, sql in RESULTS.items():
        ctes = ",\n".join(f"{cte} AS MATERIALIZED ({CTES[cte]})" for cte in _used(sql))
        statements[name] = f"WITH {ctes}\n{sql}" if ctes else sql
    return statements
