import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import encode
from tidegrid.operators import correlation, quality, quantiles, scaling, selecting, splitting
from tidegrid.timeline import Timeline

INF = float("inf")
DAYS = Timeline("series", "ts", 86400)


@pytest.mark.parametrize("n, spread", [(1, 5), (2, 5), (3, 5), (10, 1000), (997, 4), (30000, 10**9)])
def test_quantiles_equal_numpy(spark, n, spread):
    values = np.random.default_rng(n).integers(0, spread, n).astype(float)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.probability: r.value for r in quantiles.quantiles(df, "v", probabilities).collect()}
    for p in probabilities:
        assert got[p] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_describe_per_group_with_nulls(spark):
    random = np.random.default_rng(1)
    rows = [("a", float(x)) for x in random.normal(0, 1, 400)] + [(None, 1.0), (None, 2.0), ("b", None), ("b", 7.0)]
    rows += [("a", float("nan"))]
    got = {r.g: r for r in quantiles.describe(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    want = pd.Series([v for g, v in rows if g == "a" and v == v]).describe()
    for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"),
                         ("q50", "50%"), ("q75", "75%"), ("max", "max")):
        assert got["a"][ours] == pytest.approx(want[theirs])
    assert got[None].q50 == 1.5 and got["b"]["count"] == 1 and got["b"].std is None and got["b"].q25 == 7.0


def test_describe_of_an_empty_table(spark):
    got = quantiles.describe(spark.createDataFrame([], "v double"), "v").collect()
    assert len(got) == 1 and got[0]["count"] == 0 and got[0].q50 is None


def test_missing_infinite_and_complete_rows(spark):
    df = spark.createDataFrame(
        [(1.0, 1, "x"), (None, 2, "x"), (float("nan"), 3, None), (INF, 4, "x"), (-INF, None, "x")],
        "a double, b int, c string")
    assert {r.column_name: (r.missing, r.percent) for r in quality.missing_counts(df).collect()} == {
        "a": (2, 40.0), "b": (1, 20.0), "c": (1, 20.0)}
    assert [(r.column_name, r.infinite) for r in quality.infinity_counts(df).collect()] == [("a", 2)]
    assert quality.drop_incomplete(df).count() == 2 and quality.drop_infinite(df).count() == 1
    assert quality.incomplete_rows(df).collect()[0].dropped_rows == 3
    assert quality.infinite_to_null(df).where("a IS NULL").count() == 3
    totals = quality.split_totals(df.withColumn("split", F.lit("train"))).collect()[0]
    assert (totals.missing, totals.infinite) == (4, 2)
    assert selecting.complete_cases(df, ["b"]).count() == 4


def test_split_consistency_shows_one_sided_columns(spark):
    train = spark.createDataFrame([(1, None)], "a int, b int")
    test = spark.createDataFrame([(1, 2)], "a int, c int")
    got = {r.column_name: tuple(r)[1:] for r in quality.split_consistency(train, test).collect()}
    assert got == {"a": (1, 1, 1, 1), "b": (1, 0, 0, 0), "c": (0, 1, 0, 1)}


def test_leaks_by_name_and_by_value(spark):
    df = spark.createDataFrame([(1, 1.0, 5), (2, 2.0, 5), (None, None, 5)], "target int, copy double, other int")
    df = df.withColumn("TARGET_", F.lit(0)).withColumn("Demand", F.lit(1))
    got = {r.feature: r.leaked for r in quality.leaks(df, ["copy", "other", "Demand"]).collect()}
    assert got == {"copy": 1, "other": 0, "Demand": 1}
    with pytest.raises(ValueError, match="copy"):
        quality.leaks(df, ["copy"], raise_on_leak=True)


@pytest.mark.parametrize("method", ["expressions", "gram"])
def test_correlations_equal_pandas(spark, method):
    random = np.random.default_rng(2)
    data = pd.DataFrame(random.normal(1e6, 1, (200, 4)), columns=list("abcd"))
    data["b"] = data["a"] * 2 + random.normal(0, 0.1, 200)
    data.loc[3:20, "c"] = np.nan
    data["d"] = 0.1
    rows = [tuple(None if np.isnan(x) else float(x) for x in r) for r in data.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    got = {(r.left, r.right): r.correlation for r in correlation.correlation_pairs(df, method=method).collect()}
    assert len(got) == 6
    want = data.corr().abs()
    for (a, b), r in got.items():
        if "d" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-6)
    kept, dropped = correlation.drop_correlated(df, threshold=0.9, drop_first=["b", "c"])
    assert dropped == ["b"] and kept.columns == ["a", "c", "d"]
    assert correlation.drop_correlated(df, threshold=0.9)[1] == []


@pytest.mark.parametrize("method", ["expressions", "gram"])
def test_nan_and_infinity_are_left_out_of_correlations(spark, method):
    random = np.random.default_rng(5)
    data = pd.DataFrame(random.normal(0, 1, (300, 3)), columns=list("xyz"))
    data.loc[7, "x"], data.loc[9, "y"] = np.nan, np.inf
    df = spark.createDataFrame([tuple(map(float, r)) for r in data.itertuples(index=False)], "x double, y double, z double")
    want = data.replace([np.inf], np.nan).corr().abs()
    for r in correlation.correlation_pairs(df, method=method).collect():
        assert r.correlation == pytest.approx(want.loc[r.left, r.right], abs=1e-9)
    assert correlation.drop_correlated(df, threshold=0.9, drop_first=["y"])[1] == []


def test_scaler_uses_population_deviation_and_one_for_constants(spark):
    train = spark.createDataFrame([("s", 1.0, 7), ("s", 3.0, 7), ("t", 10.0, 7)], "g string, x double, k int")
    stats = {r.feature: (r.mean, r.scale) for r in scaling.fit_scaler(train.where("g = 's'"), ["x", "k"]).collect()}
    assert stats == {"x": (2.0, 1.0), "k": (7.0, 1.0)}
    fitted = scaling.fit_scaler(train.where("g = 's'"), ["x", "k"])
    scaled = scaling.transform(train, fitted, ["x", "k"])
    assert sorted(r.x for r in scaled.collect()) == [-1.0, 1.0, 8.0]
    back = scaling.inverse(scaled, fitted, {"x": "x"})
    assert sorted(r.x for r in back.collect()) == [1.0, 3.0, 10.0]
    grouped = scaling.transform(train, scaling.fit_scaler(train, ["x"], ["g"]), ["x"], ["g"])
    assert sorted(r.x for r in grouped.collect()) == [-1.0, 0.0, 1.0]


def daily(spark, n, series="a", start="2024-01-31"):
    return spark.range(n).selectExpr(
        f"'{series}' AS series", f"CAST(date_add(DATE'{start}', CAST(id AS INT)) AS TIMESTAMP_NTZ) AS ts",
        f"date_add(DATE'{start}', CAST(id AS INT)) AS date", "id AS y")


def test_chronological_splits(spark):
    df = daily(spark, 400)
    at = splitting.split_at_date(df, "date", "2024-02-10").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in at} == {"train": 10, "test": 390}
    months = splitting.split_after_months(df, "date", 1).where("split = 'train'").agg(F.max("date")).collect()[0][0]
    assert str(months) == "2024-02-28"


@pytest.mark.parametrize("n, fraction, held", [(10, 0.2, 2), (4, 0.2, 0), (1, 0.9, 0), (7, 0.15, 1)])
def test_tail_validation(spark, n, fraction, held):
    df = daily(spark, n).unionByName(daily(spark, 20, "b"))
    got = splitting.split_tail(df, DAYS.at(block=3), fraction).where("series = 'a'").orderBy("ts").collect()
    assert [r.role for r in got] == ["train"] * (n - held) + ["validation"] * held


def test_stratified_split_draws_exact_counts_per_bin(spark):
    random = np.random.default_rng(5)
    values = np.round(random.exponential(10, 3000), 1)
    values[:1200] = 0.0
    rows = [(i, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, y double")
    got = splitting.split_stratified(df, "y", ["id"]).toPandas()
    breaks = sorted(set(np.quantile(values, [0, 0.25, 0.5, 0.75, 1])))
    bins = np.searchsorted(breaks[1:-1], got["y"], side="left")
    for b in np.unique(bins):
        part = got[bins == b]
        assert (part["split"] == "train").sum() == math.ceil(0.75 * len(part))
    again = splitting.split_stratified(df.repartition(9, "y"), "y", ["id"]).toPandas()
    assert got.sort_values("id")["split"].tolist() == again.sort_values("id")["split"].tolist()


def test_stratified_split_of_a_constant_and_of_nulls(spark):
    df = spark.range(10).withColumn("y", F.when(F.col("id") < 8, F.lit(3.0)))
    got = splitting.split_stratified(df, "y", ["id"]).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 6, "test": 2, None: 2}


def test_encodings(spark):
    df = spark.createDataFrame([("b", "Yes"), (None, None), ("c", "No"), ("a", "Yes")], "s string, f string")
    assert encode.levels_of(df, "s") == ["a", "b", "c"]
    coded = encode.factor_codes(df, ["s", "missing"])
    assert [r.s for r in coded.collect()] == [1, 3, 2, 0]
    assert encode.factor_codes(df, ["s"], {"s": ["a", "b"]}).collect()[2].s == 2
    dummies = df.withColumn("s_a", F.lit(1))
    assert encode.factor_codes(dummies, ["s"]).collect()[0].s == "b"
    hot = df.withColumns(encode.one_hot("s", ["c", "a", "b"], "S")).collect()
    assert [(r.S_b, r.S_c) for r in hot] == [(1, 0), (0, 0), (0, 1), (0, 0)]
    flags = df.withColumns(encode.binary_encodes("s", "f")).collect()
    assert [r.is_functioning for r in flags] == [1, 0, 0, 1]
    with pytest.raises(ValueError):
        encode.levels_of(df, "s", max_levels=2)


def test_codes_of_many_levels(spark):
    """100,000 levels, with NULL, ties in the lead, short and non-ASCII levels; a third of the rows have one level."""
    text = F.when(F.col("id") % 3 == 0, "v7").when(F.col("id") == 1, None).otherwise(F.concat(F.lit("v"), F.col("id").cast("string")))
    df = spark.range(160_000).select("id", text.alias("s"), F.lit(None).cast("string").alias("none"))
    df = df.union(spark.createDataFrame([(-1, "", None), (-2, "é", None), (-3, "v", None), (-4, "𝒳", None), (-5, "\uffff", None)], df.schema))
    rows = df.collect()
    levels = {v: k for k, v in enumerate(sorted({r.s for r in rows if r.s is not None}))}
    assert len(levels) > 100_000
    coded = {r.id: r for r in encode.factor_codes(df, ["s", "none"]).collect()}
    assert len(coded) == len(rows)
    assert all(coded[r.id].s == levels.get(r.s, len(levels)) and coded[r.id].none == 0 for r in rows)


def test_projection_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "demand int, hour_sin int, temperature int, target int")
    assert selecting.feature_set(df, 17).columns == ["temperature", "hour_sin"]
    assert selecting.complement(df).columns == ["hour_sin", "temperature", "target"]
    assert selecting.drop_originals(df).columns == df.columns
    assert selecting.target_of(df.drop("target")) == "demand"
