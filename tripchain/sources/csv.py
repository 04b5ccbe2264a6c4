"""CSV readers with the input schemas, and the Parquet sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripchain import schemas


def _number(field: T.StructField) -> Column:
    """A field's text as a number of its type. The files come from columns of arbitrary precision, so ``57.0`` is the integer 57;
    a text that is no number, and digits that the type would lose, stop the load."""
    text = F.col(field.name)
    wide = T.DecimalType(38, 19 if isinstance(field.dataType, T.IntegralType) else 32)
    exact = text.try_cast(wide).try_cast(field.dataType)
    same = exact.try_cast(wide).eqNullSafe(text.try_cast(wide)) & exact.isNotNull()
    refused = F.raise_error(F.concat(F.lit("malformed or too long a number in "), F.lit(field.name), F.lit(": "), text)).cast(field.dataType)
    return F.when(text.isNull(), None).when(same, exact).otherwise(refused).alias(field.name)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    # An empty field is NULL and a quoted empty one is the empty string: the null
    # marker must be something else than "" for Spark to keep the two apart.
    # A line with too few or too many fields stops the load.
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    rows = spark.read.schema(as_text).csv(path, header=True, enforceSchema=True, nullValue="\\N", mode="FAILFAST")
    return rows.select(*[
        F.col(f.name) if isinstance(f.dataType, T.StringType) else _number(f) for f in schema.fields])


def load_trx(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.TRX)


def load_stops(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.STOPS)


def load_lines(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.LINES)


def load_cells(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.CELLS)


def load_fares(spark: SparkSession, path: str) -> DataFrame:
    """The fare table has no published schema: it is 463 bytes, so inference is cheap."""
    return spark.read.csv(path, header=True, inferSchema=True, nullValue="\\N")


def save_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a result table and return it as read back."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    # With the written schema: else a partition column's type is guessed from its folders' names.
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)
