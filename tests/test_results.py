import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.hashing import arithmetic_hash, gaussian, key_hash
from tidegrid.models import combine, trees, tuning
from tidegrid.operators import augment, history, lookback, metrics, residuals
from tidegrid.plans.features import model_table
from tidegrid.sinks import reports, tables
from tidegrid.sources import csv, results
from tidegrid.timeline import Timeline

HOURS = Timeline("series", "ts", 3600)


def scored(spark, pairs, model="m", split="test"):
    rows = [(model, split, None if y is None else float(y), None if p is None else float(p)) for y, p in pairs]
    return spark.createDataFrame(rows, "model string, split string, actual double, predicted double")


def test_metrics_equal_numpy(spark):
    random = np.random.default_rng(0)
    y = random.integers(0, 50, 500).astype(float)
    p = y + random.normal(0, 3, 500)
    df = scored(spark, [*zip(y, p), (None, 1), (1, None)])
    got = metrics.evaluate(df, by=["model"]).collect()[0]
    assert got.R2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got.RMSE == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert got.MAE == pytest.approx(np.abs(y - p).mean())
    assert got.CV == pytest.approx(100 * got.RMSE / y.mean())
    assert got.MAPE == pytest.approx(100 * np.abs((y - p) / np.where(y == 0, np.nan, y))[y != 0].mean())
    readings = df.groupBy().agg(*[
        metrics.mape("actual", "predicted", mode).alias(mode) for mode in ("floor", "epsilon", "raw")]).collect()[0]
    assert readings.floor == pytest.approx(100 * np.abs((y - p) / np.where(y == 0, 1, y))[y > 10].mean())
    assert readings.epsilon == pytest.approx(100 * np.abs((y - p) / (y + 1e-8)).mean())
    assert readings.raw is None


def test_metrics_of_zero_and_constant_actuals(spark):
    zero = metrics.evaluate(scored(spark, [(0, 1), (0, 2)]), by=["model"]).collect()[0]
    assert zero.R2 is None and zero.CV is None and zero.MAPE is None and zero.MAE == 1.5
    raw = scored(spark, [(2, 1), (4, 4)]).groupBy().agg(metrics.mape("actual", "predicted", "raw").alias("m"))
    assert raw.collect()[0].m == 25.0


def test_gaps_verdicts_ranks_and_comparisons(spark):
    table = spark.createDataFrame(
        [("a", "train", 0.95), ("a", "test", 0.89), ("b", "train", 0.9), ("b", "test", 0.7), ("c", "train", 0.5)],
        "model string, split string, R2 double")
    gaps = metrics.split_gap(table).withColumns({
        "four": metrics.gap_verdict(F.col("gap")), "three": metrics.gap_verdict(F.col("gap"), "three")})
    got = {r.model: (r.four, r.three) for r in gaps.collect()}
    assert got == {"a": ("good", "good"), "b": ("needs regularization", "significant overfitting"), "c": (None, None)}
    assert {r.model: r["rank"] for r in metrics.rank_models(gaps).collect()} == {"a": 1, "b": 2, "c": 3}
    better = metrics.improvement(gaps, "test_r2", F.lit(metrics.BASELINE_R2)).where("model = 'a'").collect()[0]
    assert better.points == pytest.approx(34.29) and better.target_reached == 1 and better.target_gap == 0
    errors = spark.createDataFrame([("a", 90.0), ("b", 130.0)], "model string, RMSE double")
    lower = metrics.improvement(errors, "RMSE", F.lit(120.0), target=100.0, lower_is_better=True).orderBy("model").collect()
    assert [(r.relative_percent, r.target_reached, r.target_gap > 0) for r in lower] == [
        (pytest.approx(25.0), 1, False), (pytest.approx(-25 / 3), 0, True)]
    both = metrics.compare_with(spark.createDataFrame([("a", 0.9, 150.0)], "model string, R2 double, RMSE double"),
                                {"R2": 0.95, "RMSE": 139.64}).collect()
    assert {r.metric: round(r.difference, 6) for r in both} == {"R2": -0.05, "RMSE": 10.36}


@pytest.mark.parametrize("values", [[0.0, 1.0, 2.0, 10.0, 10.0], [3.0, 3.0], list(np.random.default_rng(3).normal(0, 1, 300))])
def test_histogram_equals_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "e double")
    got = {r.bin: r.frequency for r in residuals.residual_histogram(df, "e", 50).collect()}
    counts, _ = np.histogram(values, 50)
    assert got == {i + 1: c for i, c in enumerate(counts) if c}


def stop_by_loop(losses, patience):
    best, best_epoch, waited = None, None, 0
    for epoch, loss in enumerate(losses, 1):
        if best is None or loss < best:
            best, best_epoch, waited = loss, epoch, 0
        else:
            waited += 1
            if waited >= patience:
                return epoch, best_epoch, best, 1
    return len(losses), best_epoch, best, 0


def test_early_stop_equals_the_loop(spark):
    random = np.random.default_rng(4)
    runs = {f"m{i}": [float(x) for x in np.round(random.uniform(0, 1, 3 + i), 1)] for i in range(25)}
    rows = [(m, e, x) for m, losses in runs.items() for e, x in enumerate(losses, 1)]
    df = spark.createDataFrame(rows, "model string, epoch int, val_loss double")
    got = {r.model: tuple(r)[1:] for r in history.early_stop(df, patience=4).collect()}
    assert got == {m: stop_by_loop(losses, 4) for m, losses in runs.items()}
    best = {r.model: r.best_epoch for r in history.best_epoch(df).collect()}
    assert best == {m: int(np.argmin(losses)) + 1 for m, losses in runs.items()}
    assert [trees.rounds_to_keep(losses, 4) for losses in runs.values()] == [
        stop_by_loop(losses, 4)[1] for losses in runs.values()]


def test_hashed_noise_is_normal_and_repeatable(spark):
    df = spark.range(20000).withColumn("x", F.lit(0.0))
    noisy = augment.add_noise(df, ["x"], ["id"], sigma=0.5)
    values = np.array([r.x for r in noisy.orderBy("id").collect()])
    assert abs(values.mean()) < 0.02 and abs(values.std() - 0.5) < 0.02
    again = augment.add_noise(df.repartition(13), ["x"], ["id"], sigma=0.5)
    assert noisy.exceptAll(again).isEmpty()
    other = df.select(F.corr(gaussian(["id"], 1), gaussian(["id"], 2))).collect()[0][0]
    assert abs(other) < 0.05


@pytest.mark.parametrize("alpha", [0.1, 0.2, 2.0])
def test_beta_draws_have_the_right_moments(spark, alpha):
    df = spark.range(20000).select(augment.beta_draw(key_hash(["id"], 7), alpha).alias("b"))
    b = np.array([r.b for r in df.collect()])
    assert ((b >= 0) & (b <= 1)).all()
    assert abs(b.mean() - 0.5) < 0.02 and abs(b.var() - 1 / (4 * (2 * alpha + 1))) < 0.01


def test_mixup_pairs_keep_all_rows_and_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumns({"x": F.col("id") * 1.0, "y": F.col("id") * 10.0})
    mixed = augment.mixup_pairs(df, ["x"], "y", ["id"])
    rows = mixed.collect()
    assert len(rows) == 500 and 180 < sum(r.mixed for r in rows) < 320
    assert all(abs(r.y - 10 * r.x) < 1e-6 for r in rows)
    assert all(r.x == r.id for r in rows if not r.mixed)
    assert mixed.exceptAll(augment.mixup_pairs(df.repartition(11), ["x"], "y", ["id"])).isEmpty()


def test_mixup_batches_drop_the_short_batch_and_permute(spark):
    df = spark.range(70).withColumns({"x": F.col("id") * 1.0, "y": F.col("id") * 1.0})
    mixed = augment.mixup_batches(df, ["x"], "y", ["id"], 16, weight=F.lit(0.0), order=arithmetic_hash(F.col("id"), 3), bits=31)
    rows = mixed.collect()
    assert len(rows) == 64 and {r.batch for r in rows} == {0, 1, 2, 3}
    for batch in range(4):
        assert {float(r.id) for r in rows if r.batch == batch} == {r.x for r in rows if r.batch == batch}


def test_raw_csv_in_latin1_and_utf8(spark, tmp_path):
    header = "Date,Rented Bike Count,Hour,Temperature(°C),Seasons,Functioning Day\n"
    for encoding in ("utf-8", "latin-1"):
        path = tmp_path / encoding
        path.mkdir()
        (path / "a.csv").write_bytes((header + "01/12/2017,254,0,-5.2,Winter,Yes\n31/12/2017,,23,x,,No\n").encode(encoding))
        df = csv.read_raw_csv(spark, str(path))
        assert df.columns == ["date", "demand", "hour", "temperature", "season", "functioning"]
        first, second = df.orderBy("date").collect()
        assert (str(first.date), first.demand, first.hour, first.temperature) == ("2017-12-01", 254, 0, -5.2)
        assert second.demand is None and second.temperature is None and second.season is None


def test_latin1_in_the_body_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Date,Hour,place\n01/12/2017,1,plain\n02/12/2017,2,Zoë\n".encode("latin-1"))
    assert [r.place for r in csv.read_raw_csv(spark, str(tmp_path)).orderBy("date").collect()] == ["plain", "Zoë"]


def test_files_of_one_folder_have_encodings_of_their_own(spark, tmp_path, monkeypatch):
    head = "Date,Hour,Temperature(°C),place\n"
    (tmp_path / "a.csv").write_bytes((head + "01/12/2017,1,-5.2,Zoë\n").encode())
    (tmp_path / "b.csv").write_bytes(("\ufeff" + head + "02/12/2017,2,1.5,\"a, né\"\n\n").encode())
    (tmp_path / "c.csv").write_bytes((head + "03/12/2017,3,0,Zoë\r\n04/12/2017,4,7,Bär\r\n").encode("latin-1"))
    expected = [(1, -5.2, "Zoë"), (2, 1.5, "a, né"), (3, 0.0, "Zoë"), (4, 7.0, "Bär")]
    for named in (1_000, 0):
        monkeypatch.setattr(csv, "NAMED_FILES", named)
        rows = csv.read_raw_csv(spark, str(tmp_path)).orderBy("date").collect()
        assert [(r.hour, r.temperature, r.place) for r in rows] == expected
        assert [r.date.day for r in rows] == [1, 2, 3, 4]


def test_values_that_do_not_parse(spark, tmp_path):
    lines = ["01/12/2017,1,2.5,a", "99/99/2017,2,3.5,b", "02/12/2017,x,4.5,c", "03/12/2017,,y,d", "04/12/2017,4"]
    (tmp_path / "a.csv").write_text("Date,Hour,Temperature(°C),place\n" + "\n".join(lines) + "\n")
    rows = csv.read_raw_csv(spark, str(tmp_path), unparsed="line").collect()
    assert [r.line for r in rows] == [None, lines[1], lines[2], lines[3], None]
    assert rows[1].date is None and (rows[1].hour, rows[1].temperature, rows[1].place) == (2, 3.5, "b")
    assert rows[2].hour is None and rows[2].temperature == 4.5
    assert (rows[3].hour, rows[3].temperature, rows[4].hour, rows[4].place) == (None, None, 4, None)


def test_hourly_csv_goes_to_the_model_table(spark, tmp_path):
    header = "Date,Rented Bike Count,Hour,Temperature(°C),Humidity(%),Wind speed (m/s),Visibility (10m)," \
        "Dew point temperature(°C),Solar Radiation (MJ/m2),Rainfall(mm),Snowfall (cm),Seasons,Holiday,Functioning Day,station\n"
    lines = [f"{d:02d}/12/2017,{d * h + 1},{h},{h - 5.0},40,1.5,2000,-17.6,0,0,0,Winter,No Holiday,Yes,s\n" for d in range(1, 15) for h in range(24)]
    (tmp_path / "a.csv").write_bytes((header + "".join(lines)).encode("latin-1"))
    raw = csv.read_hourly_csv(spark, str(tmp_path))
    assert str(raw.agg(F.max("ts").alias("m")).collect()[0].m) == "2017-12-14 23:00:00"
    rows = model_table(raw, Timeline("station"), "2017-12-12")
    assert {r.split: r.n for r in rows.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 4 * 24, "test": 3 * 24}


def test_split_csv_writes_booleans_and_original_headers(spark, tmp_path):
    df = spark.createDataFrame([("train", 1.5, 1), ("test", 2.5, 0)], "split string, temperature double, Season_Spring int")
    train, test = tables.write_split_csv(df, str(tmp_path / "out"))
    lines = {r.value for r in spark.read.text(train).collect()}
    assert lines == {"Temperature(°C),Season_Spring", "1.5,True"}
    a, b = csv.read_feature_pair(spark, train, test, "temperature double, Season_Spring boolean")
    assert a.collect()[0] == (1.5, 1) and b.collect()[0] == (2.5, 0)


def test_leaderboard_takes_any_parameter_type(spark, tmp_path):
    scores = {"R2": 0.9, "RMSE": 1.0, "MAE": 0.5}
    for i, parameters in enumerate((17, "222,272+XGB", None)):
        (tmp_path / f"{i}.json").write_text(json.dumps({
            "model_name": f"m{i}", "rank": i + 1, "parameters": parameters, "train_metrics": scores,
            "test_metrics": scores}, indent=2))
    board = results.read_leaderboard(spark, str(tmp_path)).orderBy("rank").collect()
    assert [r.parameters for r in board] == ["17", "222,272+XGB", None] and board[0].test_metrics.R2 == 0.9


def test_wide_predictions_pad_the_shorter_side(spark):
    df = spark.sql("""SELECT 'a' AS series, TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT), 0, 0) AS ts,
        IF(id < 5, 'train', 'test') AS split, id AS y, id + 1 AS p FROM range(7)""")
    wide = tables.wide_predictions(df, HOURS.at(block=2), "y", "p").orderBy("row_number").collect()
    assert [(r.actual_train, r.actual_test) for r in wide] == [(0, 5), (1, 6), (2, None), (3, None), (4, None)]
    assert wide[0].residuals_test == -1


def test_metrics_summary_and_parameters(spark):
    table = spark.createDataFrame([("m", "train", 1.0, 2.0, 3.0, 4.0, None)],
                                  "model string, split string, R2 double, RMSE double, MAE double, CV double, MAPE double")
    assert reports.metrics_summary(table).columns == ["model", "Set", "R2", "RMSE", "MAE", "CV", "MAPE"]
    assert reports.metrics_summary(table, split_method="x").collect()[0].Split_Method == "x"
    assert reports.best_parameters(spark, {"b": 1, "a": 2}).collect() == [("a", "2"), ("b", "1")]
    assert reports.training_history(spark, [1.0], [2.0], [0.1]).columns == ["epoch", "train_loss", "val_loss", "lr"]


@pytest.fixture(scope="module")
def learning_rows(spark):
    df = spark.sql("""SELECT 's' AS series, TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT), 0, 0) AS ts,
        CAST(id % 24 AS DOUBLE) AS a, CAST(id % 7 AS DOUBLE) AS b, IF(id < 300, 'train', 'test') AS split FROM range(400)""")
    return df.withColumn("target", F.col("a") * 2 + F.col("b")).cache()


TINY = trees.TreeSettings(depth=3, rounds=5, rate=0.5, patience=2, row_share=1.0, feature_share="all")


def test_trees_learn_save_and_reload(spark, learning_rows, tmp_path):
    rows = trees.assemble(learning_rows, ["a", "b"])
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    model, train_losses, losses = trees.fit_with_patience(train, test, "target", TINY)
    assert train_losses[-1] < train_losses[0] and len(losses) == 5
    result = metrics.evaluate(trees.score(model, test).withColumnRenamed("target", "actual"), by=["split"]).collect()[0]
    assert result.R2 > 0.8
    loaded = results.load_trees(tables.save_model(model, str(tmp_path / "model")))
    assert trees.score(loaded, test).select("predicted").exceptAll(trees.score(model, test).select("predicted")).isEmpty()
    ranked = trees.importances(model, ["a", "b"], spark).orderBy(F.desc("importance")).collect()
    assert ranked[0].feature == "a" and abs(sum(r.importance for r in ranked) - 1) < 1e-9


def test_boosting_stops_with_patience_and_equals_a_whole_fit(spark, learning_rows):
    noisy = learning_rows.withColumn("target", F.col("target") + F.randn(3) * 4)
    rows = trees.assemble(noisy.drop("features"), ["a", "b"]).cache()
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    long = trees.TreeSettings(**{**TINY.__dict__, "rounds": 40})
    model, train_losses, losses = trees.fit_with_patience(train, test, "target", long, segment=3)
    kept = trees.rounds_to_keep(losses, long.patience)
    assert model.getNumTrees == kept and len(losses) == min(kept + long.patience, 40) < 40
    assert all(b <= a for a, b in zip(train_losses, train_losses[1:]))
    whole = trees.fit_trees(train, "target", trees.TreeSettings(**{**TINY.__dict__, "rounds": kept}))
    assert trees.round_losses(whole, test, "target") == pytest.approx(losses[:kept])
    mine, its = (trees.score(m, test).orderBy("ts").select("predicted").collect() for m in (model, whole))
    assert [r.predicted for r in mine] == pytest.approx([r.predicted for r in its])


def test_grid_search_prefers_the_better_setting(spark, learning_rows):
    rows = trees.assemble(learning_rows, ["a", "b"]).where("split = 'train'")
    found = tuning.grid_search(rows, "target", ["ts"], rounds=(1, 6), depths=(3,), folds=2, repeats=2, settings=TINY)
    assert found.best == {"maxIter": 6, "maxDepth": 3} and len(found.scores) == 2


def test_ensemble_is_the_row_mean_and_noise_free_copies_change_nothing(spark, learning_rows):
    rows = trees.assemble(learning_rows, ["a", "b"])
    models = combine.fit_ensemble(rows.where("split = 'train'"), "target", TINY, (1, 2))
    single = [trees.score(m, rows, f"p{i}").select("ts", f"p{i}") for i, m in enumerate(models)]
    want = {r.ts: (r.p0 + r.p1) / 2 for r in single[0].join(single[1], "ts").collect()}
    for copies in (0, 2):
        got = combine.score_ensemble(models, rows, ["a", "b"], ["ts"], copies=copies, sigma=0.0).collect()
        assert len(got) == 400 and all(r.predicted == pytest.approx(want[r.ts]) for r in got)


def test_stack_takes_windows_and_points(spark, learning_rows):
    windows = lookback.lookback(learning_rows, HOURS, ["a", "b"], 6)
    points = lookback.point_features(learning_rows, HOURS, ["a", "b"], 6).select("series", "ts", "point")
    both = windows.join(points, ["series", "ts"])
    embedding = combine.fit_window_embedding(both.where("split = 'train'"), size=3)
    stacked = combine.stack_features(embedding, both)
    assert stacked.first()["features"].size == 5
    model = trees.fit_trees(stacked.where("split = 'train'"), "target", TINY)
    assert trees.score(model, stacked).count() == 400 - 2 * 6


def test_choice_takes_the_lowest_score(spark):
    df = spark.createDataFrame([("s", "b", 1.0), ("s", "a", 1.0), ("s", "c", 2.0)], "series string, model string, RMSE double")
    assert combine.choose(df, ["series"]).collect()[0].model == "a"


def test_shapes_count_the_parts_of_a_stage_in_its_own_pass(spark):
    from tidegrid.operators import quality

    raw = spark.range(10).withColumn("half", F.when(F.col("id") < 3, "a").when(F.col("id") < 8, "b"))
    kept = raw.where("id > 0").withColumn("more", F.lit(1))
    halves = {h: ("kept", f"half = '{h}'") for h in "ab"}
    shapes = quality.shapes({"raw": raw, "kept": kept}, "raw", halves)
    text = shapes._jdf.queryExecution().executedPlan().toString()
    assert text.count("Range (0, 10") == 2
    assert {tuple(r) for r in shapes.collect()} == {
        ("raw", 10, 2, 100.0), ("kept", 9, 3, 90.0), ("a", 2, 3, 20.0), ("b", 5, 3, 50.0)}
    empty = quality.shapes({"raw": raw.where("id < 0")}, "raw").first()
    assert (empty.row_count, empty.retained_percent) == (0, None)


def test_fits_deal_out_partitions_of_too_many_rows(spark, monkeypatch):
    from tidegrid.models import trees

    rows = spark.range(0, 100, 1, 2)
    assert trees.dealt(rows) is rows
    monkeypatch.setattr(trees, "FIT_ROWS", 10)
    assert trees.dealt(rows).rdd.getNumPartitions() == 10 and trees.dealt(rows).count() == 100
