from datetime import datetime, timedelta

from lagwise.streaming.incremental import running_events, windowed_field


def test_windows_and_sessions(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(hours=h), "a", float(h)) for h in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, k string, v double")
    df.write.parquet(str(tmp_path / "in"))

    def run(make, name):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name).collect()

    days = run(lambda s: windowed_field(s, "ts", ["k"], "v"), "days")
    assert {(r.start.day, r.n) for r in days} == {(1, 24), (2, 24)}
    runs = run(lambda s: running_events(s, "ts", ["k"], "v < 10 or v between 20 and 25"), "runs")
    assert [r.n for r in runs] == [10]  # the later run is still open: no row lies beyond its gap and the watermark
