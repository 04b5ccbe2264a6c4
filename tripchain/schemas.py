"""Schemas of the input tables, in the column order of their CSV files."""

from pyspark.sql import types as T

# Six digits before the point and twelve behind it: as fast as a long, and no published coordinate has more.
COORD = T.DecimalType(18, 12)

TRX = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("id_tarjeta", T.LongType()),
    T.StructField("modo", T.StringType()),
    T.StructField("lat", COORD),
    T.StructField("lon", COORD),
    T.StructField("sexo", T.StringType()),
    T.StructField("interno_bus", T.LongType()),
    T.StructField("tipo_trx_tren", T.StringType()),
    T.StructField("etapa_red_sube", T.IntegerType()),
    T.StructField("id_linea", T.LongType()),
    T.StructField("id_ramal", T.LongType()),
    T.StructField("id_tarifa", T.LongType()),
    T.StructField("hora", T.IntegerType()),
])

STOPS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("id_linea", T.LongType()),
    T.StructField("id_ramal", T.LongType()),
    T.StructField("nombre_estacion", T.StringType()),
    T.StructField("longitud", COORD),
    T.StructField("latitud", COORD),
    T.StructField("h3", T.StringType()),
])

LINES = T.StructType([
    T.StructField("id_linea", T.LongType()),
    T.StructField("linea", T.StringType()),
    T.StructField("modo", T.StringType()),
    T.StructField("id_ramal", T.LongType()),
    T.StructField("ramal_corto", T.StringType()),
    T.StructField("ramal", T.StringType()),
    T.StructField("provincia", T.StringType()),
    T.StructField("municipio", T.StringType()),
])

# Census codes keep their leading zeros, so they stay strings.
CELLS = T.StructType([
    T.StructField("h3", T.StringType()),
    T.StructField("radio_2010", T.StringType()),
    T.StructField("depto_2010", T.StringType()),
    T.StructField("departamento", T.StringType()),
    T.StructField("provincia", T.StringType()),
])
