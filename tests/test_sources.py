from datetime import date

from sequela.sources import registers, stages

D = date


def test_rows_without_an_id_are_dropped_and_columns_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("select * from values (1, 'a', 9), (null, 'b', 9) t(id, v, w)").write.parquet(path)
    df = registers.load_register(spark, path, {"person_id": "id", "v": "upper(v)"}, "person_id")
    assert [tuple(r) for r in df.collect()] == [(1, "A")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:int,v:string>" in plan and "IsNotNull(id)" in plan


def test_positive_tests(spark, collect):
    tests = spark.createDataFrame(
        [(1, D(2020, 2, 29), "POSITIVE"), (1, D(2020, 3, 1), "POSITIVE"),
         (1, D(2020, 3, 1), "POSITIVE"), (2, D(2020, 3, 2), "NEGATIVE")],
        "person_id long, specimen_date date, result string",
    )
    assert registers.positive_tests(tests, D(2020, 3, 1)).count() == 2
    assert collect(registers.positive_test_days(tests)) == [(1, D(2020, 2, 29)), (1, D(2020, 3, 1))]


def test_reading_one_endpoint_prunes_the_stage(spark, collect, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "endpoint string, x int")
    path = registers.write_stage(df, str(tmp_path / "s"))
    assert collect(registers.read_stage(spark, path, df.schema)) == sorted([("a", 1), ("b", 2)])
    one = registers.read_stage(spark, path, df.schema, "a")
    assert collect(one, "x") == [(1,)]
    assert "PartitionFilters: [isnotnull(endpoint" in one._jdf.queryExecution().executedPlan().toString()
    empty = stages.stage(df.filter("x > 5"))
    assert empty.count() == 0 and set(empty.columns) == {"endpoint", "x"}


def files_of(path):
    """Data files of a stage by endpoint folder."""
    found = {}
    for f in path.rglob("part-*.parquet"):
        found.setdefault(f.parent.name, []).append(f)
    return found


def test_files_of_a_stage_do_not_follow_the_tasks(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 40).selectExpr("concat('e', least(id % 12, 3)) endpoint", "id person_id")
    path = registers.write_stage(rows, str(tmp_path / "s"))
    assert {name: len(files) for name, files in files_of(tmp_path / "s").items()} == {f"endpoint=e{k}": 1 for k in range(4)}
    back = registers.read_stage(spark, path, rows.schema)
    assert back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
    registers.write_stage(rows, str(tmp_path / "few"), rows_per_file=500)
    # e3 has three quarters of the rows
    assert {name: len(files) for name, files in files_of(tmp_path / "few").items()} == {
        "endpoint=e0": 1, "endpoint=e1": 1, "endpoint=e2": 1, "endpoint=e3": 6,
    }


def test_an_endpoint_larger_than_a_partition_is_split(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    rows = spark.range(0, 200_000, 1, 8).selectExpr(
        "if(id % 10 < 9, 'hot', 'cold') endpoint", "id person_id", "xxhash64(id) filler"
    )
    try:
        spark.conf.set(size, "256KB")
        registers.write_stage(rows, str(tmp_path / "s"))
    finally:
        spark.conf.set(size, before)
    found = files_of(tmp_path / "s")
    assert 2 <= len(found["endpoint=hot"]) <= 20 and len(found["endpoint=cold"]) <= 4
    assert spark.read.parquet(str(tmp_path / "s")).count() == 200_000


def test_result_tables_stack(spark, collect, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "endpoint string, v double")
    paths = [registers.write_results(df.filter(f"endpoint = '{e}'"), str(tmp_path / e)) for e in "ab"]
    got = {r.endpoint: r.v for r in registers.stack_results(spark, paths, df.schema).collect()}
    assert got == {"a": 1.5, "b": None}
