from tessera.sources import io


def test_one_large_file_is_read_in_several_tasks(spark, tmp_path):
    plain, over = tmp_path / "plain", tmp_path / "over"
    for folder in (plain, over):
        folder.mkdir()
    (plain / "a.csv").write_text("id,name,note\n" + "".join(f'{i},"n ""{i}""",x{i % 7}\n' for i in range(60_000)))
    (over / "a.csv").write_text("id,note\n" + "".join(f'{i},"two\nlines"\n' for i in range(100)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        df = io.read_csv(spark, str(plain))
        assert df.rdd.getNumPartitions() > 3
        assert df.count() == 60_000 and df.where("name = 'n \"59999\"'").count() == 1 and dict(df.dtypes)["id"] == "bigint"
        many = io.read_csv(spark, str(over))
        assert many.count() == 100 and {r["note"] for r in many.collect()} == {"two\nlines"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
