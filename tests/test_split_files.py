"""Wide tables are filtered and written split by split without a sort, in methods that the JVM compiles."""

from pyspark.sql import functions as F

from tidegrid.operators.quality import drop_infinite
from tidegrid.session import settings
from tidegrid.sinks import tables

LIMIT, WRITERS = "spark.sql.codegen.hugeMethodLimit", "spark.sql.maxConcurrentOutputFileWriters"


def test_a_computed_column_is_tested_once(spark):
    df = spark.range(10).select(F.sin(F.col("id") / 3).alias("a"), "id")
    plan = drop_infinite(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SIN(") == 2  # once for the test, once for the row


def test_only_complete_finite_rows_stay(spark):
    inf, nan = float("inf"), float("nan")
    values = [(1, 1.5, 2.5), (2, inf, 0.0), (3, -inf, 0.0), (4, nan, 0.0), (5, None, 0.0), (6, -0.0, -inf), (None, 1.0, 1.0), (8, -1e308, 1e38)]
    df = spark.createDataFrame(values, "k int, d double, f float")
    assert sorted(r.k for r in drop_infinite(df).collect()) == [1, 8]


def test_settings_end_with_their_actions(spark):
    spark.conf.set(WRITERS, "3")
    spark.conf.unset(LIMIT)
    usual = spark.conf.get(LIMIT)
    try:
        with settings(spark, {LIMIT: "8000", WRITERS: "8"}):
            assert (spark.conf.get(LIMIT), spark.conf.get(WRITERS)) == ("8000", "8")
            raise KeyError
    except KeyError:
        pass
    assert (spark.conf.get(LIMIT), spark.conf.get(WRITERS)) == (usual, "3")
    spark.conf.unset(WRITERS)


def test_rows_are_not_sorted_by_split(spark, tmp_path):
    # a task that does not sort leaves each split's rows in their order, without one file per run of a split
    df = spark.range(0, 3000, numPartitions=2).select("id", F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"))
    seen = []
    seen_settings = tables.settings

    def noted(session, values):
        seen.append(values)
        return seen_settings(session, values)

    tables.settings = noted
    try:
        path = tables.write_split_parquet(df, str(tmp_path / "parquet"))
        train, test = tables.write_split_csv(df, str(tmp_path / "csv"))
    finally:
        tables.settings = seen_settings
    assert all(v[WRITERS] == "8" and v[LIMIT] == "8000" for v in seen) and len(seen) == 2
    assert len(list((tmp_path / "parquet" / "split=train").glob("*.parquet"))) == 2
    rows = df.where("split = 'train'").exceptAll(spark.read.parquet(path).where("split = 'train'").select("id", "split"))
    assert rows.count() == 0 and spark.read.parquet(path).count() == 3000
    assert spark.read.csv(train, header=True).count() == 2000 and spark.read.csv(test, header=True).count() == 1000


def test_split_csv_files_are_compressed(spark, tmp_path):
    df = spark.range(0, 2000, numPartitions=2).selectExpr("id", "id % 3 / 7.0D AS x", "1 AS Season_Spring", "IF(id % 4 = 0, 'test', 'train') AS split")
    train, test = tables.write_split_csv(df, str(tmp_path / "csv"))
    files = [f for f in (tmp_path / "csv").rglob("part-*") if not f.name.startswith(".")]
    assert len(files) == 4 and all(f.name.endswith(".csv.gz") and f.read_bytes()[:2] == b"\x1f\x8b" for f in files)
    read = [spark.read.options(header=True).schema("id long, x double, Season_Spring boolean").csv(p) for p in (train, test)]
    want = df.selectExpr("id", "x", "true AS Season_Spring", "split")
    got = read[0].selectExpr("*", "'train' AS split").unionByName(read[1].selectExpr("*", "'test' AS split"))
    assert got.count() == 2000 and want.exceptAll(got).isEmpty()
