"""Trips with timers: state goes when a trip is idle, and totals are those of the batch answer."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from tarn.operators import online
from tarn.streaming import trips


def test_idle_trips_end(spark, tmp_path):
    day = datetime(2024, 5, 1, 8)

    def fix(trip, minute, event, lng):
        return (trip, day + timedelta(minutes=minute), minute, event, lng, 47.0, 5.0)

    batches = [
        [fix(1, 0, "start", 11.0), fix(1, 1, "fix", 11.0), fix(1, 2, "fix", 11.01), fix(2, 0, "start", 11.0), fix(2, 3, "fix", 11.1)],
        [fix(2, 60, "fix", 11.2), fix(2, 400, "fix", 11.3)],
        [fix(2, 410, "fix", 11.4)],
        [fix(2, 420, "pause", 11.4), fix(1, 430, "start", 12.0), fix(1, 431, "fix", 12.0), fix(1, 432, "fix", 12.02), fix(1, 2, "fix", 50.0)],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, trips.FIXES).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stream = spark.readStream.schema(trips.FIXES).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    told = []
    try:
        query = trips.timed_trip_updates(stream, idle="2 hours", late="1 minute").writeStream.outputMode("update").foreachBatch(lambda df, n: told.extend((n, *r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        kept = query.lastProgress.stateOperators[0].numRowsTotal
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    ended = [t for t in told if t[5]]
    first = [t for t in told if t[1] == 1 and not t[5]]
    # Trip 1 is told, ends while only trip 2 goes on, and starts anew; what came late for it is dropped.
    assert [(t[1], t[2], t[4]) for t in ended if t[1] == 1] == [(1, 1, 2)]
    assert [(t[2], t[4]) for t in first] == [(1, 2), (1, 2)] and first[0][0] < ended[0][0] <= first[1][0]
    batch = {(r.trip_id, r.segment): r.metres for r in online.trip_distance(spark.createDataFrame([r for b in batches for r in b if r[4] != 50.0], trips.FIXES)).collect()}
    assert first[0][3] == pytest.approx(batch[1, 1]) and first[1][3] == pytest.approx(batch[1, 2])
    assert kept >= 1
