"""Files and streams."""

from stratagraph.sources import files
from stratagraph.streaming.rollup import windowed_counts


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Dataset,Order,Family,Species_Scientific,Species_Chinese,Protection_CN,IUCN,CITES,Elevation_m,Habitats,Source\nS1,A,B,C d,某鸟,,LC,II,2100-4300,forest-meadow,x\nS1,A,B,C e,某,,,,3200,,x\n", encoding="utf-8")
    a, b = files.read_raptors(spark, str(tmp_path / "r.csv")).collect()
    assert (a.elevation_lo, a.elevation_hi, a.habitats, a.Protection_CN) == (2100, 4300, ["forest", "meadow"], None)
    assert (b.elevation_lo, b.elevation_hi, b.habitats) == (3200, 3200, None)
    df = spark.createDataFrame([("黑颈鹤", 1.5)], "name string, v double")
    files.write_json(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().name == "黑颈鹤"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", "ab"[i % 2], float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("to_timestamp(ts) AS ts", "event_type", "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, late="3 days").writeStream.outputMode("complete").format("memory").queryName("rollup_test").start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.table("rollup_test")) == key(windowed_counts(df))
