import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tripchain import schemas  # noqa: E402
from tripchain.session import local_session, settle  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=2)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def taps(spark):
    """Taps from dicts; every column has a harmless default."""
    default = dict(id_tarjeta=1, modo="COL", lat=-34.6, lon=-58.5, sexo="M", interno_bus=None, tipo_trx_tren=None,
                   etapa_red_sube=0, id_linea=1, id_ramal=10, id_tarifa=0, hora=8)

    def build(rows):
        filled = [{**default, **row} for row in rows]
        for row in filled:
            for c in ("lat", "lon"):
                row[c] = None if row[c] is None else Decimal(str(row[c]))
        names = schemas.TRX.fieldNames()
        return settle(spark.createDataFrame([tuple(r[n] for n in names) for r in filled], schemas.TRX).coalesce(1), "taps")

    return build


@pytest.fixture
def stop_table(spark):
    def build(rows):
        """(id, line, branch, lon, lat) each."""
        return settle(spark.createDataFrame(
            [(i, line, branch, f"P{i}", Decimal(str(lon)), Decimal(str(lat)), f"c{i}") for i, line, branch, lon, lat in rows],
            schemas.STOPS).coalesce(1), "stops")
    return build


@pytest.fixture
def line_table(spark):
    def build(rows):
        """(branch, line) each."""
        return spark.createDataFrame(
            [(line, None, None, branch, None, None, None, None) for branch, line in rows], schemas.LINES)
    return build


def by_id(df, *columns):
    return {row["id"]: tuple(row[c] for c in columns) if len(columns) > 1 else row[columns[0]]
            for row in df.select("id", *columns).collect()}
