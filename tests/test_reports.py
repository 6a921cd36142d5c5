from engram.sources.tables import read_reports, write_reports


def test_missing_and_malformed_reports(spark, tmp_path):
    schema = "topic string, n int, boundary string"
    path = f"{tmp_path}/reports"
    assert read_reports(spark, path, schema).collect() == []
    write_reports(spark.createDataFrame([("a", 1, "en"), ("b", 2, "de")], schema), path)
    (tmp_path / "reports" / "boundary=de" / "broken.json").write_text('{"topic": "c", "n"')
    assert sorted(tuple(r) for r in read_reports(spark, path, schema).select("topic", "n", "boundary").collect()) == [("a", 1, "en"), ("b", 2, "de")]
