from elevata.streaming import ingest as I


def test_reports_of_batches(spark, tmp_path):
    schema = "facade_id long, kind string, w_cm long, h_cm long"
    elements = spark.createDataFrame([(1, "window", 100, 100), (1, "door", 100, 200), (2, "window", 50, 50)], schema)
    elements.write.parquet(str(tmp_path / "in"))
    facades = spark.createDataFrame([(7, 1, 100000, 300), (7, 2, 1000, 300), (7, 3, 5, 300)], "image_id long, facade_id long, total_cm2 long, h long")
    seen = []
    query = I.reports_by_batch(I.arriving_elements(spark, str(tmp_path / "in"), elements.schema), facades, lambda rows, n: seen.extend((n, r["facade_id"], r["net"]) for r in rows.collect()), str(tmp_path / "check"))
    query.awaitTermination(60)
    assert sorted(seen) == [(0, 1, 70000), (0, 2, 0)]


def test_running_totals(spark, tmp_path):
    schema = "facade_id long, kind string, w_cm long, h_cm long"
    spark.createDataFrame([(1, "window", 10, 10), (1, "door", 10, 20)], schema).write.parquet(str(tmp_path / "in"))
    rows = I.running_totals(I.arriving_elements(spark, str(tmp_path / "in"), schema))
    query = rows.writeStream.outputMode("complete").format("memory").queryName("totals").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("totals").collect()] == [(1, 300, 2)]


def test_windows_of_events(spark):
    rows = I.counted_events(spark.readStream.format("rate").load().selectExpr("timestamp AS ts", "'a' AS event_type", "CAST(value AS double) AS value"))
    assert rows.isStreaming and rows.columns == ["window", "event_type", "n", "total"]
