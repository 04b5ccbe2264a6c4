"""Time the chain at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Inputs are written as tables first (``load``), as the chain starts from loaded tables. ``chain``, ``clean`` and
``order`` each run from the taps up to that step; ``stages`` is the whole chain including the stop lookups; ``trips``,
``cards`` and ``od_matrix`` start from the written stages. ``chain``, ``clean`` and ``order`` are parts of ``stages``
and do not count in the total. $BENCH_COPIES repeats the taps under other card numbers.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tripchain import Config  # noqa: E402
from tripchain.operators import od, trips  # noqa: E402
from tripchain.plans import day  # noqa: E402
from tripchain.session import local_session, settle  # noqa: E402
from tripchain.sources import driver_tables  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
COPIES = int(os.environ.get("BENCH_COPIES", "1"))


def repeated(trx: DataFrame, copies: int) -> DataFrame:
    if copies == 1:
        return trx
    return (
        trx.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
        .withColumns({"id": F.col("id") + F.col("_copy") * F.lit(10**8),
                      "id_tarjeta": F.col("id_tarjeta") + F.col("_copy") * F.lit(10**9)})
        .drop("_copy")
    )


def main() -> None:
    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    config, seconds = Config(), {}

    def timed(name, action):
        start = time.time()
        result = action()
        seconds[name] = round(time.time() - start, 3)
        return result

    def consumed(df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()

    def load():
        trx = repeated(driver_tables.trx(spark, SF_DIR), COPIES).repartition(int(CPUS) * 4 if COPIES > 1 else int(CPUS))
        return [settle(df, "bench") for df in (
            trx, *(make(spark, SF_DIR) for make in (driver_tables.stops, driver_tables.lines, driver_tables.cells)))]

    trx, stops, lines, cells = timed("load", load)
    timed("chain", lambda: consumed(day.chained(trx, config).union()))
    timed("clean", lambda: consumed(day.cleaned(trx, lines, config).union()))
    timed("order", lambda: consumed(day.ordered(trx, lines, config).union()))
    stages = timed("stages", lambda: settle(day.finished_stages(trx, stops, lines, config), "bench"))
    timed("trips", lambda: consumed(trips.build_trips(stages)))
    timed("cards", lambda: consumed(trips.build_cards(stages)))
    timed("od_matrix", lambda: consumed(od.od_matrix(
        od.georeference(stages.select("hora", "parada_id_o", "parada_id_d"), stops, cells), "departamento", ["hora"])))
    print(json.dumps({
        "metric": "total wall-clock of the trip chain", "value": round(sum(seconds[k] for k in ("load", "stages", "trips", "cards", "od_matrix")), 3), "unit": "sec",
        "queries": seconds, "sf": Path(SF_DIR).name.removeprefix("sf"), "taps": trx.count(), "copies": COPIES}))


if __name__ == "__main__":
    main()
