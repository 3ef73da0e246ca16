import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegrid.operators import lookback, rolling
from tidegrid.operators.numbering import number_by_hash, number_in_series
from tidegrid.operators.grid import fill_grid
from tidegrid.functions.hashing import key_hash
from tidegrid.timeline import Timeline, over_past, slot_of, slot_time

HOURS = Timeline("series", "ts", 3600)


def frame(spark, lengths=(300, 1, 40), start="2024-02-28", seed=0):
    """Series of given lengths, with a NULL here and there."""
    random = np.random.default_rng(seed)
    parts = []
    for series, n in enumerate(lengths):
        parts.append(pd.DataFrame({
            "series": series, "ts": pd.date_range(start, periods=n, freq="h"),
            "demand": random.integers(0, 9, n), "temperature": random.normal(10, 5, n),
            "humidity": random.uniform(0, 100, n), "wind_speed": random.uniform(0, 5, n),
        }))
    data = pd.concat(parts, ignore_index=True)
    data.loc[data.index % 37 == 5, "temperature"] = np.nan
    rows = [
        (int(r.series), r.ts.to_pydatetime(), int(r.demand), None if np.isnan(r.temperature) else float(r.temperature),
         float(r.humidity), float(r.wind_speed)) for r in data.itertuples()
    ]
    schema = "series long, ts timestamp_ntz, demand long, temperature double, humidity double, wind_speed double"
    return data, spark.createDataFrame(rows, schema)


def pandas_features(data):
    out = data.copy()
    by = out.groupby("series")
    for k in rolling.DEMAND_LAGS:
        out[f"demand_lag_{k}h"] = by["demand"].shift(k)
    for name, short in (("temperature", "temp"), ("humidity", "humidity"), ("wind_speed", "wind_speed")):
        out[f"{short}_lag_1h"] = by[name].shift(1)
        out[f"{short}_change_1h"] = out[name] - out[f"{short}_lag_1h"]

    def past(column, n, what):
        return by[column].transform(lambda s: getattr(s.shift(1).rolling(n, min_periods=1), what)())

    for n in rolling.DEMAND_MEANS:
        out[f"demand_rolling_{n}h_mean"] = past("demand", n, "mean")
    for what in ("std", "min", "max"):
        out[f"demand_rolling_24h_{what}"] = past("demand", 24, what)
    out["temp_rolling_3h_mean"] = past("temperature", 3, "mean")
    out["temp_rolling_3h_std"] = past("temperature", 3, "std")
    out["temp_rolling_24h_mean"] = past("temperature", 24, "mean")
    return out


def collected(df, names):
    got = df.select("series", "ts", *[F.col(n).cast("double").alias(n) for n in names]).toPandas()
    return got.sort_values(["series", "ts"]).reset_index(drop=True)


@pytest.mark.parametrize("block", [7, 50, 168, 4096])
def test_window_features_equal_pandas_whatever_the_block(spark, block):
    data, df = frame(spark)
    want = pandas_features(data).sort_values(["series", "ts"]).reset_index(drop=True)
    built = rolling.add_window_features(df, HOURS.at(block=block))
    names = [c for c in built.columns if c not in data.columns]
    got = collected(built, names)
    assert len(got) == len(data) and len(names) == 21
    for n in names:
        np.testing.assert_allclose(got[n], want[n].astype(float), atol=1e-9, err_msg=n)


def test_rows_before_1970_fall_into_the_right_block(spark):
    data, df = frame(spark, (60,), start="1969-12-31 00:00:00")
    built = over_past(df, HOURS.at(block=5), 3, lambda w: {"x": F.lag("demand", 3).over(w)})
    np.testing.assert_allclose(collected(built, ["x"])["x"], data["demand"].shift(3))


def test_later_rows_never_change_earlier_features(spark):
    _, df = frame(spark, (200,))
    short = rolling.add_window_features(df.where("ts < '2024-03-05'"), HOURS.at(block=32))
    full = rolling.add_window_features(df, HOURS.at(block=32)).where("ts < '2024-03-05'")
    assert short.exceptAll(full).isEmpty() and full.exceptAll(short).isEmpty()


def test_partitioning_and_company_do_not_change_results(spark):
    _, df = frame(spark)
    whole = rolling.add_window_features(df, HOURS.at(block=64))
    shuffled = rolling.add_window_features(df.repartition(7, "demand"), HOURS.at(block=64))
    alone = rolling.add_window_features(df.where("series = 2"), HOURS.at(block=64))
    assert whole.exceptAll(shuffled).isEmpty()
    assert whole.where("series = 2").exceptAll(alone).isEmpty()


def test_gaps_count_rows_when_numbered(spark):
    data, df = frame(spark, (120, 30))
    keep = (data.index % 3 != 1)
    gappy = df.withColumn("h", F.hour("ts")).join(
        spark.createDataFrame([(int(r.series), r.ts.to_pydatetime()) for r in data[keep].itertuples()],
                              "series long, ts timestamp_ntz"), ["series", "ts"])
    timeline = HOURS.at(block=16)
    numbered = number_in_series(gappy, timeline, total="n")
    built = over_past(numbered, timeline.at(position="position"), 24, rolling.demand_means)
    want = pandas_features(data[keep].reset_index(drop=True)).sort_values(["series", "ts"]).reset_index(drop=True)
    got = collected(built, ["position", "n", "demand_rolling_24h_mean"])
    np.testing.assert_allclose(got["demand_rolling_24h_mean"], want["demand_rolling_24h_mean"])
    assert got.groupby("series")["position"].apply(list).tolist() == [
        list(range(1, n + 1)) for n in got.groupby("series").size()]
    assert (got.groupby("series")["n"].max() == got.groupby("series").size()).all()


def test_numbering_keeps_null_keys_and_covers_each_number_once(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    got = number_by_hash(df, ["g"], key_hash(["id"], 1), 64, ["id"]).toPandas()
    assert len(got) == 1000
    for _, part in got.groupby("g", dropna=False):
        assert sorted(part["position"]) == list(range(1, len(part) + 1))


def test_slots_and_times_are_inverse(spark):
    times = ["1969-12-31 23:00:00", "1970-01-01 00:00:00", "2024-03-31 02:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").selectExpr("t", "CAST(t AS TIMESTAMP_NTZ) AS ts")
    back = df.selectExpr("t", f"CAST({slot_time(slot_of('ts', 3600), 3600)} AS STRING) AS back")
    assert all(r.t == r.back for r in back.collect())


def test_grid_fills_gaps_with_defaults(spark):
    events = spark.createDataFrame(
        [("a", "2024-01-01 00:10:00", 1), ("a", "2024-01-01 00:50:00", 2), ("a", "2024-01-01 03:00:00", 4),
         ("b", "2024-01-01 05:00:00", 8)], "series string, t string, v int"
    ).selectExpr("series", "CAST(t AS TIMESTAMP_NTZ) AS ts", "v")
    measures = {"n": "count(v)", "total": "coalesce(sum(v), 0)"}
    full = {(r.series, r.ts.hour): (r.n, r.total) for r in fill_grid(events, HOURS.at(block=2), measures).collect()}
    assert len(full) == 12
    assert full["a", 0] == (2, 3) and full["a", 1] == (0, 0) and full["b", 5] == (1, 8)
    own = fill_grid(events, HOURS, measures, bounds="series").collect()
    assert sorted((r.series, r.ts.hour) for r in own) == [("a", h) for h in range(4)] + [("b", 5)]
    part = fill_grid(events, HOURS, measures, since="2024-01-01 02:00:00", until="2024-01-01 05:00:00").collect()
    assert {(r.series, r.ts.hour): (r.n, r.total) for r in part} == {
        k: v for k, v in full.items() if 2 <= k[1] < 5}
    with pytest.raises(ValueError):
        fill_grid(events, HOURS, measures, since="2024-01-01 02:30:00")


def test_lookback_equals_brute_force_and_keeps_nulls(spark):
    data, df = frame(spark, (60, 5), seed=3)
    df = df.withColumn("split", F.when(F.col("ts") < "2024-02-29", "train").otherwise("test"))
    length = 8
    got = lookback.lookback(df, HOURS.at(block=6), ["temperature", "demand"], length).collect()
    points = lookback.point_features(df, HOURS.at(block=6), ["temperature", "demand"], length).collect()
    data = data.assign(split=np.where(data["ts"] < "2024-02-29", "train", "test"))
    want = {}
    for (series, split), part in data.groupby(["series", "split"]):
        part = part.sort_values("ts").reset_index(drop=True)
        for i in range(length, len(part)):
            rows = part.iloc[i - length:i]
            want[series, part["ts"][i]] = [
                [None if np.isnan(t) else t, float(d)] for t, d in zip(rows["temperature"], rows["demand"])]
    assert len(got) == len(want) == len(points)
    for r in got:
        assert [list(x) for x in r.sequence] == want[r.series, r.ts]
    for r in points:
        assert [r.point["temperature"], float(r.point["demand"])] == want[r.series, r.ts][-1]


def test_filters_are_causal_sums(spark):
    data, df = frame(spark, (50,))
    bank = lookback.filter_bank(df, HOURS.at(block=9), "demand", {3: (1.0, 2.0, 4.0)}, dilation=2)
    x = data["demand"].astype(float)
    want = 4 * x + 2 * x.shift(2).fillna(0) + x.shift(4).fillna(0)
    np.testing.assert_allclose(collected(bank, ["scale_3"])["scale_3"], want)
    with pytest.raises(ValueError):
        lookback.filter_bank(df, HOURS, "demand", {3: (1.0, 2.0)})
    share = lookback.scale_share(bank, [3]).collect()[0]
    assert share.share == 1.0 and abs(share.mean_abs - want.abs().mean()) < 1e-9
    assert lookback.receptive_field(3, 4) == 31 and lookback.receptive_field(3, 4, per_level=2) == 61


def test_softmax_per_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1000.0), ("b", 5.0)], "g string, s double")
    got = {(r.g, r.s): r.weight for r in lookback.softmax_weights(df, "s", ["g"]).collect()}
    assert got["a", 1000.0] == 1.0 and got["a", 1.0] == 0.0 and got["b", 5.0] == 1.0


def test_blocks_agree_with_a_plain_window(spark, folder):
    from tidegrid.sources.adapters import HOURLY, hourly_events

    raw = hourly_events(spark, folder, "event_type")
    plain = Window.partitionBy("series").orderBy("ts")
    want = raw.select("series", "ts", F.lag("demand", 168).over(plain).alias("x"))
    got = over_past(raw, HOURLY.at(block=50), 168, lambda w: {"x": F.lag("demand", 168).over(w)}).select("series", "ts", "x")
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_blocks_never_change_results_of_series_with_gaps(spark):
    data, df = frame(spark, (100, 30))
    gone = "series = 0 AND hour(ts) < 20 AND day(ts) = 29"
    df = df.where(f"NOT ({gone})").withColumn("split", F.when(F.col("demand") > 4, "train").otherwise("test"))
    plain = Window.partitionBy("series").orderBy("ts")
    want = df.select("series", "ts", F.lag("demand", 24).over(plain).alias("x"))
    split = Window.partitionBy("series", "split").orderBy("ts")
    windows = df.withColumn("n", F.row_number().over(split)).where("n > 12").select("series", "ts")
    for block in (4096, 24, 10):
        hours = HOURS.at(block=block)
        got = over_past(df, hours, 24, lambda w: {"x": F.lag("demand", 24).over(w)})
        assert got.columns == [*df.columns, "x"]
        assert want.exceptAll(got.select("series", "ts", "x")).isEmpty() and got.count() == df.count()
        for timeline in (hours, hours.at(complete=True)):
            for found in (lookback.lookback(df, timeline, ["demand"], 12), lookback.point_features(df, timeline, ["demand"], 12)):
                assert windows.exceptAll(found.select("series", "ts")).isEmpty() and found.count() == windows.count()


def test_rows_without_a_time_come_last(spark):
    """They keep their place in the table and see the rows before them, as a sort with missing times last would do."""
    rows = [("s", None if k % 10 == 7 else k, float(k)) for k in range(100)]
    table = spark.createDataFrame(rows, "series string, k int, x double").repartition(4)
    table = table.selectExpr("series", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, k) AS ts", "x")
    timed = [x for _, k, x in rows if k is not None]
    for block in (8, 4096):
        got = over_past(table, HOURS.at(block=block), 5, lambda w: {"before": F.lag("x", 5).over(w), "n": F.count("x").over(w.rowsBetween(-5, -1))}).collect()
        assert len(got) == 100
        want = {x: (timed[i - 5] if i >= 5 else None) for i, x in enumerate(timed)}
        assert {r.x: r.before for r in got if r.ts is not None} == want
        assert all(r.n == 5 for r in got if r.ts is None)
        numbered = number_in_series(table, HOURS.at(block=block), name="p", total="n").collect()
        assert sorted(r.p for r in numbered) == list(range(1, 101))
        assert {r.p for r in numbered if r.ts is None} == set(range(91, 101))


@pytest.mark.parametrize("rows, message", [([*range(5), *range(10, 60)], "gap"), ([*range(30), 29], "gap"), ([*range(9), None], "time")])
@pytest.mark.parametrize("block", [10, 4096])
def test_a_false_promise_of_a_complete_series_raises(spark, rows, message, block):
    table = spark.createDataFrame([("s", k) for k in rows], "series string, k int")
    table = table.selectExpr("series", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, k) AS ts", "k")
    with pytest.raises(Exception, match=message):
        over_past(table, HOURS.at(complete=True, block=block), 24, lambda w: {"lag": F.lag("k", 24).over(w)}).collect()
    assert over_past(table, HOURS.at(block=block), 24, lambda w: {"lag": F.lag("k", 24).over(w)}).count() == len(rows)


def test_empty_cells_are_made_after_the_last_shuffle(spark):
    """Neither one task nor a shuffle holds the empty cells; borders, rows without a time or a series stay right."""
    rows = [(1, 0, 2), (1, 1, 3), (1, 5, 1), (1, 5, 4), (2, 11, 7), (None, 3, 8), (None, None, 9), (3, None, 5)]
    events = spark.createDataFrame(rows, "series bigint, h int, v int").selectExpr(
        "series", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, h) AS ts", "v", "1 AS seen")
    measures = {"n": "count(seen)", "total": "coalesce(sum(v), -1)", "top": "max(v)"}
    for block in (1, 2, 3, 4096):
        filled = fill_grid(events, HOURS.at(block=block), measures)
        plan = filled._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Generate") < plan.index("HashAggregate(keys=[series")
        got = sorted([(r.series or 0, -1 if r.ts is None else r.ts.hour, r.n, r.total, r.top) for r in filled.collect()], key=str)
        want = []
        for series in {r[0] for r in rows}:
            for hour in [*range(12), None]:
                values = [v for s, h, v in rows if (s, h) == (series, hour)]
                if values or hour is not None:
                    want.append((series or 0, -1 if hour is None else hour, len(values), sum(values) if values else -1, max(values, default=None)))
        assert got == sorted(want, key=str), block


def test_numbers_need_no_join_and_keep_null_keys_and_duplicates(spark):
    rows = [(k, h) for k in ("a", None) for h in (5, 5, 70000, 1 << 40, (1 << 40) + 1)] + [("b", None)]
    df = spark.createDataFrame(rows, "k string, h bigint")
    numbered = number_by_hash(df, ["k"], F.col("h"), 41, ["h"], "n", "of")
    assert "Join" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert sorted(((r.k or "", r.n, r.of, r.h) for r in numbered.collect())) == sorted(
        (k or "", i + 1, 5, h) for k in ("a", None) for i, h in enumerate(sorted(x for y, x in rows if y == k)))
