import datetime as dt

from glyphlake.streaming.arrivals import first_deliveries, orphan_alerts, stream_table


def run(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)


def test_repeats_are_dropped(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d)
    schema = "item_id long, loaded_at timestamp, v string"
    spark.createDataFrame([(1, day(1), "a"), (2, day(1), "b"), (1, day(3), "a")], schema).write.parquet(str(tmp_path / "in"))
    run(first_deliveries(stream_table(spark, str(tmp_path / "in"), schema), "item_id", "loaded_at"), "firsts", "append")
    assert sorted(r["item_id"] for r in spark.table("firsts").collect()) == [1, 2]


def test_alerts(spark, tmp_path):
    items = spark.createDataFrame([("p", "1A", None, dt.datetime(2024, 1, 1), None)], "path string, handle string, cad_handles array<string>, loaded_at timestamp, erased_at timestamp")
    schema = "path string, id string, sent_at timestamp"
    spark.createDataFrame([("p", "@_1a_&f0;@_2b_&f0", dt.datetime(2024, 1, 2)), ("q", "1A", dt.datetime(2024, 1, 2))], schema).write.parquet(str(tmp_path / "in"))
    run(orphan_alerts(stream_table(spark, str(tmp_path / "in"), schema), items), "alerts", "complete")
    assert [r["missing"] for r in spark.table("alerts").collect()] == [2]
