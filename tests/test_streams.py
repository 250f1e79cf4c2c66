"""Nearest slices of a stream: out-of-order rows wait for each other, rows later than allowed are counted and left out."""

import datetime

from tidewright.streaming import nearest


def test_sightings_wait_for_slices(spark, tmp_path):
    at = lambda h, m, s=0: datetime.datetime(2024, 5, 1, h, m, s)
    files = [
        [(1, at(10, 0), False), (None, at(9, 50), True), (3, at(10, 20), False), (5, at(12, 0), False)],
        [(None, at(10, 10), True), (2, at(14, 59), False)],  # after the sightings that take it
        [(None, at(15, 10), True), (None, at(14, 48), True), (4, at(15, 20, 1), False)],
        [(None, at(10, 1), True), (6, at(10, 0), False)],  # the watermark is at 14:20: too late
        [(None, datetime.datetime(2200, 1, 1), True)],
    ]
    for rows in files:
        spark.createDataFrame(rows, "id long, at timestamp, is_slice boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, at timestamp, is_slice boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, nearest.PROVIDER)
    try:
        settled = nearest.nearest_time_stream(stream.where("id IS NOT NULL"), stream.where("is_slice"), 1800, "1 hour", key="at", time="at")
        q = settled.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    got = {r.id: (r.key, r.time) for r in spark.read.schema(settled.schema).parquet(str(tmp_path / "out")).collect()}
    assert got == {
        1: (at(10, 0), at(10, 10)),  # the later of two equally near
        2: (at(14, 59), at(15, 10)), 3: (at(10, 20), at(10, 10)), 4: (at(15, 20, 1), at(15, 10)), 5: (at(12, 0), None)
    }
    assert nearest.late_rows(q) == 4  # a slice in three buckets, and a sighting
