"""Named queries against their SQL on the smallest data, plan shape, and sources."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.compare import difference, oracle_connection
from tripchain.config import Config
from tripchain.operators import trips
from tripchain.operators.anonymize import anonymize
from tripchain.plans import catalog, day
from tripchain.session import settle
from tripchain.sources import csv, driver_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


def test_every_query_has_sql():
    assert set(catalog.queries()) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert difference(got, con.execute(entry.oracle_sql()[name]).fetch_df()) is None


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_exchange_of_taps_up_to_cards(spark):
    """Both halves of the chain, with tables of origins and destinations above the planner's threshold."""
    trx, stops, lines = (settle(make(spark, SF), "plan") for make in (driver_tables.trx, driver_tables.stops, driver_tables.lines))
    origins = day.origin_table(trx, stops, lines, Config())
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    listed = size(lines.groupBy("id_ramal").agg(F.min("id_linea"), F.lit(True)))
    assert listed < size(origins)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", listed)
    try:
        first = executed(day.with_next(trx, lines, origins, Config()).union())
        assert first.count("Exchange hashpartitioning(id_tarjeta") == 1 and "Exchange hashpartitioning(route" not in first, first
        stages = day.finished_stages(trx, stops, lines, Config())
        second = executed(trips.build_trips(stages))
        assert "Exchange hashpartitioning" not in second and "SortAggregate" not in second, second
        last = executed(trips.build_cards(stages))
        assert "Exchange hashpartitioning(id_tarjeta" not in last and "SortAggregate" not in last, last
        # Beyond the counted limit, taps are exchanged by route and cell first.
        far = executed(day.with_next(trx, lines, origins, Config(broadcast_lookup=0)).union())
        assert far.count("Exchange hashpartitioning(id_tarjeta") == 1 and "_salt" in far
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The bounds of the service area and the card filter reach the scan.
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    cells = executed(day.tap_cells(trx, lines, Config()))
    assert "GreaterThanOrEqual(lat,-36.000000000000)" in cells, cells
    assert "IsNotNull(id_tarjeta)" in cells
    assert "sexo" not in cells and "hora" not in cells
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_large_lookups_give_the_same_stages(spark):
    trx, stops, lines = (settle(make(spark, SF), "large") for make in (driver_tables.trx, driver_tables.stops, driver_tables.lines))
    few, many = (sorted(map(repr, day.finished_stages(trx, stops, lines, Config(broadcast_lookup=n)).collect())) for n in (1_000_000, 0))
    assert few == many and few


@pytest.mark.parametrize("name", ["stage_ids", "trip_temp_id", "checkout_only_trips", "checkout_fix"])
def test_steps_of_ordinary_cards_need_one_exchange(spark, name):
    assert executed(catalog.queries()[name](spark, SF)).count("Exchange hashpartitioning") == 1


def test_levels_are_one_aggregate(spark):
    plan = executed(catalog.queries()["od_rollup"](spark, SF))
    assert plan.count("Expand") == 1 and plan.count("Exchange hashpartitioning(departamento_o") == 1


def test_results_are_read_back_from_folders_of_a_column(spark, tmp_path):
    trx, stops, lines = (settle(make(spark, SF), "parts") for make in (driver_tables.trx, driver_tables.stops, driver_tables.lines))
    dated = trx.withColumn("fecha", F.concat(F.lit("0"), F.col("hora") % 2))
    config = Config(card_keys=("fecha", "id_tarjeta"))
    result = day.write_results(dated, stops, lines, str(tmp_path / "out"), config, partition_by=("fecha",))
    assert sorted(p.name for p in (tmp_path / "out" / "viajes").glob("fecha=*")) == ["fecha=00", "fecha=01"]
    assert result.cards.schema["fecha"].dataType.simpleString() == "string"
    assert {r["fecha"] for r in result.cards.collect()} == {"00", "01"}
    assert sorted(map(repr, result.trips.collect())) == sorted(map(repr, trips.build_trips(result.stages, config.card_keys).select(result.trips.columns).collect()))


def test_empty_fields_are_null_and_quoted_ones_are_not(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,card,mode,lat,lon,sex,v,k,e,l,r,f,h\n1,2,COL,-34.6,-58.5,"",,,0,1,10,3,8\n2,,SUB,,,,7,"CHECK IN",1,1,10,3,9\n')
    first, second = csv.load_trx(spark, str(tmp_path / "t.csv")).orderBy("id").collect()
    assert (first.sexo, first.interno_bus, first.tipo_trx_tren, float(first.lat)) == ("", None, None, -34.6)
    assert (second.id_tarjeta, second.lat, second.sexo, second.tipo_trx_tren, second.hora) == (None, None, None, "CHECK IN", 9)


def test_a_field_of_the_wrong_type_stops_the_load(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,l,r,n,lon,lat,h\n1,x,10,A,-58.5,-34.6,c\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        csv.load_stops(spark, str(tmp_path / "s.csv")).collect()


def test_numbers_are_read_as_they_are_or_not_at_all(spark, tmp_path):
    head = "id,card,mode,lat,lon,sex,v,k,e,l,r,f,h\n"
    (tmp_path / "t.csv").write_text(head + "1,9223372036854775807,COL,-34.123456789012,-58.5e0,M,57.0,,0.00,10,3.0,8,5\n")
    row = csv.load_trx(spark, str(tmp_path / "t.csv")).collect()[0]
    assert (row.id_tarjeta, str(row.lat), float(row.lon), row.interno_bus, row.etapa_red_sube, row.id_ramal) == (
        9223372036854775807, "-34.123456789012", -58.5, 57, 0, 3)
    for bad in ("1,2,COL,-34.1234567890123,-58.5,M,57,,0,10,3,8,5", "1,2,COL,-34.1,-58.5,M,57.5,,0,10,3,8,5", "1,2,COL,-34.1,-58.5,M,5,,3000000000,10,3,8,5",
                "1,9223372036854775808,COL,-34.1,-58.5,M,5,,0,10,3,8,5", "1,2,COL,x,-58.5,M,5,,0,10,3,8,5"):
        (tmp_path / "b.csv").write_text(head + bad + "\n")
        with pytest.raises(Exception, match="malformed"):
            csv.load_trx(spark, str(tmp_path / "b.csv")).collect()


def test_fares_are_read_as_they_are(spark, tmp_path):
    (tmp_path / "f.csv").write_text("id_tarifa,valor\n1,18.5\n")
    assert [tuple(r) for r in csv.load_fares(spark, str(tmp_path / "f.csv")).collect()] == [(1, 18.5)]


def test_masking(spark):
    raw = spark.sql("SELECT 5L AS id_tarjeta, CAST(NULL AS BIGINT) AS interno_bus, CAST(-34.600999 AS DECIMAL(9,6)) AS lat, "
                    "CAST(-58.4 AS DECIMAL(9,6)) AS lon, timestamp_ntz'2019-11-13 17:59:59' AS ts")
    row = anonymize(raw, "s").collect()[0]
    assert (str(row.lat), str(row.lon), row.hora, row.interno_bus) == ("-34.600", "-58.400", 17, None)
    assert row.id_tarjeta == spark.range(1).select(F.sha2(F.lit("s5"), 256)).collect()[0][0] and "ts" not in row.asDict()


def test_days_are_chains_of_their_own(spark):
    """With a date in front of the card, each day gives what it gives alone."""
    trx, stops, lines = (settle(make(spark, SF), "day") for make in (driver_tables.trx, driver_tables.stops, driver_tables.lines))
    two = trx.withColumn("fecha", F.lit(1)).unionByName(
        trx.withColumns({"fecha": F.lit(2), "id": F.col("id") + 1_000_000}))
    alone = day.finished_stages(trx, stops, lines, Config()).select("id", "id_etapa", "id_viaje", "parada_id_o", "parada_id_d")
    both = day.finished_stages(two, stops, lines, Config(card_keys=("fecha", "id_tarjeta")))
    got = both.select((F.col("id") % 1_000_000).alias("id"), *alone.columns[1:]).collect()
    expected = [tuple(r) for r in alone.collect()]
    key = lambda r: (r[0], repr(r))
    assert sorted(map(tuple, got), key=key) == sorted(expected * 2, key=key)
