from strataprobe.streaming import profile


def test_running_profiles(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (None, "2024-02-01 10:00:00"), (3, None)], "x long, t string").selectExpr("x", "cast(t as timestamp) as t")
    path = str(tmp_path / "in")
    df.repartition(3).write.parquet(path)
    read = lambda: profile.read_growing(spark, path, df.schema, 1)
    for name, frame, mode in (("nulls", profile.running_missing_values(read()), "complete"), ("months", profile.running_records_by(read(), "t", "month"), "complete"), ("days", profile.windowed_counts(read(), "t"), "complete")):
        profile.start(frame, name, str(tmp_path / name), mode).awaitTermination()
    assert spark.table("nulls").first().asDict() == {"row_count": 3, "x_nulls": 1, "t_nulls": 1}
    assert sorted((r.month, r.n) for r in spark.table("months").collect()) == [(1, 1), (2, 1)]
    assert spark.table("days").agg({"n": "sum"}).first()[0] == 2
