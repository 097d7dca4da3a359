from datetime import datetime

from stridefold.streaming.bars import daily_bars

ROWS = [("X", datetime(2020, 1, 1, 9), 10.0, 1.0), ("X", datetime(2020, 1, 1, 16), 12.0, 2.0), ("X", datetime(2020, 1, 1, 12), 9.0, 1.0), ("Y", datetime(2020, 1, 2, 9), 5.0, 1.0), ("X", datetime(2020, 1, 9, 9), 11.0, 1.0)]
SCHEMA = "symbol string, at timestamp, price double, size double"


def test_stream_equals_table(spark, tmp_path):
    table = spark.createDataFrame(ROWS, SCHEMA)
    table.write.parquet(str(tmp_path / "in"))
    stream = daily_bars(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).format("memory").queryName("bars").start()
    q.processAllAvailable()
    q.stop()
    expected = {tuple(r) for r in daily_bars(table).collect()}
    final = {tuple(r) for r in spark.table("bars").collect()}
    assert ("X", datetime(2020, 1, 1), 12.0, 12.0, 9.0, 4.0) in final
    assert final == {r for r in expected if r[1] < datetime(2020, 1, 8)}
