from haargrid.streaming.ingest import append_new


def test_appends_each_key_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda a, b: spark.createDataFrame([(i, 1, float(i)) for i in range(a, b)], "thingi_id long, level int, value double")
    rows(0, 5).write.parquet(src)
    schema = rows(0, 1).schema
    append_new(spark, src, schema, out, str(tmp_path / "c1"), ["thingi_id", "level"]).awaitTermination()
    assert spark.read.parquet(out).count() == 5
    rows(3, 9).write.mode("append").parquet(src)
    append_new(spark, src, schema, out, str(tmp_path / "c1"), ["thingi_id", "level"]).awaitTermination()
    append_new(spark, src, schema, out, str(tmp_path / "c2"), ["thingi_id", "level"]).awaitTermination()
    assert sorted(r.thingi_id for r in spark.read.parquet(out).collect()) == list(range(9))
