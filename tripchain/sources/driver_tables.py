"""Taps, stops, lines and cells derived from the star-schema test tables.

``events`` become taps, ``part`` becomes stops, ``nation`` and ``region`` name the census
geography. Integer arithmetic only, so that any SQL engine gets the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripchain import schemas
from tripchain.config import BUS, CHECK_IN, CHECK_OUT, CHECK_OUT_ALONE, METRO, TRAIN, Config
from tripchain.functions.hexgrid import with_cell

UNLISTED_BRANCH = 51


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _degrees(milli: Column) -> Column:
    return (milli.cast("decimal(9,0)") / F.lit(1000)).cast(schemas.COORD)


def _shape(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def trx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tap per event, and a second one right behind it for every 23rd (a double tap)."""
    event, user = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("long")
    mode = F.when(F.col("event_type") == "error", METRO).when(F.col("event_type") == "signup", TRAIN).otherwise(BUS)
    is_bus, is_metro, is_train = (F.col("modo") == m for m in (BUS, METRO, TRAIN))
    line = F.when(is_metro, 101 + F.col("k") % 2).when(is_train, 201 + F.col("k") % 3).otherwise(1 + F.col("k") % 5)
    place = lambda on_bus, other, base: (
        F.when(event % 89 == 0, None).when(event % 83 == 0, 0)
        .otherwise(base + F.when(is_bus, on_bus).otherwise(other)))
    kind = F.col("k") % 5
    taps = (
        _table(spark, sf_dir, "events")
        .withColumns({"k": k, "modo": mode})
        .withColumn("lin", line)
        .withColumn("copy", F.explode(F.when(event % 23 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .withColumns({
            "id": event * 2 + F.col("copy"),
            "id_tarjeta": F.when(event % 97 != 0, user * 100 + F.floor(F.dayofmonth("ts") / 3)),
            "lat": _degrees(place((event * 53) % 47, (F.col("k") % 7) * 6, F.lit(-34600))),
            "lon": _degrees(place((event * 37) % 61, (F.col("k") % 7) * 9, F.lit(-58500))),
            "sexo": F.when(event % 11 == 0, "").when(user % 7 == 0, None).otherwise(
                F.when((user + (event % 211 == 0).cast("int")) % 2 == 0, "M").otherwise("F")),
            "interno_bus": F.when(is_bus, event % 2),
            "tipo_trx_tren": F.when(is_train, F.when(kind < 2, CHECK_IN).when(kind < 4, CHECK_OUT).otherwise(CHECK_OUT_ALONE)),
            "etapa_red_sube": F.when(F.col("k") % 4 == 3, 1).otherwise(0),
            "id_linea": F.when(is_metro, 100).when(is_train, 200).otherwise(F.col("lin")),
            "id_ramal": F.col("lin") * 10 + F.when(is_metro, 0).otherwise(event % 2),
            "id_tarifa": F.col("k") % 8,
            "hora": F.hour("ts"),
        })
    )
    return _shape(taps, schemas.TRX)


def raw_trx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taps as before masking: vehicle and card numbers, six-decimal coordinates, a full time."""
    event = F.col("event_id")
    offset = lambda factor: (event * factor) % 100_000
    micro = lambda value: (value.cast("decimal(12,0)") / F.lit(1_000_000)).cast(schemas.COORD)
    return _table(spark, sf_dir, "events").select(
        event.alias("id"), F.col("user_id").alias("id_tarjeta"),
        F.when(event % 3 != 0, event % 1000).alias("interno_bus"),
        micro(-34_600_000 + offset(53)).alias("lat"), micro(-58_500_000 + offset(37)).alias("lon"), "ts")


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    digit = key % 10
    line = F.when(digit < 5, 1 + digit).when(digit < 7, 96 + digit).otherwise(194 + digit)
    spots = (
        _table(spark, sf_dir, "part")
        .withColumns({"id": key, "nombre_estacion": F.col("p_name"), "id_linea": line})
        .withColumns({
            "id_ramal": F.col("id_linea") * 10 + F.when(F.col("id_linea").between(101, 102), 0).otherwise(F.floor(key / 10) % 2),
            "longitud": _degrees(-58500 + (key * 29) % 61),
            "latitud": _degrees(-34600 + (key * 41) % 47),
        })
    )
    cell = with_cell(spots, Config(), "longitud", "latitud")
    return _shape(cell.withColumn("h3", F.concat_ws("_", "cell_q", "cell_r")), schemas.STOPS)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches of the stops but one, so that taps of an unlisted branch occur."""
    listed = (
        stops(spark, sf_dir).select("id_ramal", "id_linea").distinct()
        .where(F.col("id_ramal") != UNLISTED_BRANCH)
        .withColumns({
            "modo": F.when(F.col("id_linea") > 200, TRAIN).when(F.col("id_linea") > 100, METRO).otherwise(BUS),
            "linea": F.concat(F.lit("L"), F.col("id_linea")),
            "ramal_corto": F.concat(F.lit("R"), F.col("id_ramal")),
            "ramal": F.concat(F.lit("Ramal "), F.col("id_ramal")),
            "provincia": F.lit(None), "municipio": F.lit(None),
        })
    )
    return _shape(listed, schemas.LINES)


def fares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per fare code that occurs, with a name and a price."""
    code = F.get_json_object("props", "$.k").cast("long") % 8
    return _table(spark, sf_dir, "events").groupBy(code.alias("id_tarifa")).agg(F.count("*").alias("n")).select(
        "id_tarifa", F.concat(F.lit("Tarifa "), F.col("id_tarifa")).alias("descripcion"),
        ((1800 + F.col("id_tarifa") * 25 + F.col("n") % 25).cast("decimal(9,0)") / F.lit(100)).cast("decimal(9,2)").alias("valor"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cell that has a stop; nations are its departments, regions its provinces."""
    used = (
        with_cell(stops(spark, sf_dir), Config(), "longitud", "latitud")
        .select("h3", F.pmod(F.col("cell_q") + F.col("cell_r"), F.lit(25)).alias("nation")).distinct()
    )
    named = (
        used.join(_table(spark, sf_dir, "nation"), F.col("nation") == F.col("n_nationkey"))
        .join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumns({
            "radio_2010": F.lpad(F.col("nation").cast("string"), 9, "0"),
            "depto_2010": F.lpad(F.col("nation").cast("string"), 5, "0"),
            "departamento": F.col("n_name"), "provincia": F.col("r_name"),
        })
    )
    return _shape(named, schemas.CELLS)
