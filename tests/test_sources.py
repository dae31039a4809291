import pytest

from tessera.sources import formats, series
from tessera.sources.scratch import Scratch, shared_dir


@pytest.mark.parametrize("kind", ["csv", "json", "orc", "parquet"])
def test_nulls_and_line_breaks_come_back(spark, kind, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted",\nline'), (2, None), (3, ""), (None, "é")], "id int, s string")
    formats.write(df, kind, f"file://{tmp_path}/t")
    assert sorted(map(repr, formats.read(spark, kind, f"file://{tmp_path}/t", df.schema).collect())) == sorted(map(repr, df.collect()))


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="avro"):
        formats.read(spark, "avro", "x", "a int")


def test_series(spark):
    spark.dataSource.register(series.Series)
    df = spark.read.format("series").options(start=3, end=20, step=4, partitions=3).load()
    assert sorted(tuple(r) for r in df.collect()) == [(3, 9), (7, 49), (11, 121), (15, 225), (19, 361)]
    assert spark.read.format("series").options(end=0).load().count() == 0


def test_scratch_tables_are_freed(spark):
    import os

    scratch = Scratch(spark, "test")
    df = scratch.cut(spark.range(10).toDF("n"), "numbers")
    (path,) = [p for _, p in scratch.paths.values()]
    assert df.count() == 10 and path.startswith(shared_dir(spark))
    scratch.free(df)
    assert not os.path.exists(path.removeprefix("file://")) and not scratch.paths


def test_jdbc_round_trip(spark):
    """Against the database that comes with Spark, in memory."""
    options = {"url": "jdbc:derby:memory:tessera;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df = spark.createDataFrame([(k, f"n{k}" if k % 3 else None, k / 4) for k in range(100)], "id long, name string, amount double")
    formats.write_jdbc(df, name="sums", partitions=2, **options)
    back = formats.read_jdbc(spark, options["url"], "sums", "id", 0, 100, 4, driver=options["driver"])
    assert back.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    assert "PushedFilters: [*IsNotNull(id), *GreaterThan(id,90)]" in back.where("id > 90")._jdf.queryExecution().executedPlan().toString()
