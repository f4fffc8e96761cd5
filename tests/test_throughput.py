import duckdb

from lorekeep.queries import streams


def test_all_windows(spark, tmp_path):
    """Windows that a watermark leaves open at the stream's end are counted, and events without a time."""
    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "b"), ("2024-01-01 01:05:00", "a"), ("2024-01-01 01:06:00", "a"), (None, "b"), ("2024-01-01 00:11:00", "a")]
    events = spark.createDataFrame(rows, "t string, event_type string").selectExpr("cast(t as timestamp_ntz) as ts", "event_type")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in streams.stream_throughput(spark, str(tmp_path)).collect()]
    want = [("2024-01-01 00:00", "a", 2), ("2024-01-01 00:00", "b", 1), ("2024-01-01 01:00", "a", 2), (None, "b", 1)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(db.sql(streams.SQL["stream_throughput"]).fetchall(), key=repr) == sorted(want, key=repr)
