"""The learning queries do their whole work, and their shared steps only once."""

import datetime
import inspect

import pytest
from pyspark.sql import functions as F

from tidegrid.models import combine, trees, tuning
from tidegrid.queries import QUERIES as learning_queries
from tidegrid.queries import learning
from tidegrid.session import FILE_BY_FILE, settings, write_and_read

SMALL = trees.TreeSettings(depth=2, rounds=3, patience=3, min_rows=1)
AE = "spark.sql.adaptive.enabled"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Four users over the whole month, so that there are rows on both sides of the split date."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(u, start + datetime.timedelta(hours=h), float((h * 7 + u) % 23), '{"k": %d}' % (h % 100)) for u in range(4) for h in range(u, 719 + u % 2, 5 + u)]
    folder = tmp_path_factory.mktemp("events")
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def rows(spark):
    numbers = spark.range(0, 400, numPartitions=3)
    table = numbers.selectExpr("id", "id % 7 * 1.0 AS a", "id % 11 * 1.0 AS b", "id % 7 * 3.0 + id % 11 AS target", "IF(id % 5 = 0, 'test', 'train') AS split")
    return trees.assemble(write_and_read(table, "learning"), ["a", "b"])


def test_windows_of_the_rows_are_made_once(spark, events, monkeypatch):
    plans = []

    def noted(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString(), spark.conf.get("spark.sql.codegen.hugeMethodLimit")))
        return write_and_read(df, label)

    monkeypatch.setattr(learning, "write_and_read", noted)
    got = learning._rows(spark, events)
    ((label, plan, limit),) = plans
    # windows stand only below what is held, which the statistics take, too
    lines = plan.splitlines()
    held = [k for k, line in enumerate(lines) if "InMemoryRelation" in line]
    windows = [k for k, line in enumerate(lines) if " Window " in line]
    assert (label, limit) == ("rows", "8000") and held and windows and min(windows) > min(held)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == 0
    # the statistics are those of the training rows
    train = got.where("split = 'train'").agg(F.avg("demand_lag_24h").alias("m"), F.stddev_pop("demand_lag_24h").alias("s")).first()
    assert train.m == pytest.approx(0, abs=1e-9) and train.s == pytest.approx(1)
    assert got.where("split = 'test'").count() > 0


def test_a_table_read_file_by_file_keeps_its_partitions(spark):
    first = write_and_read(spark.range(0, 900, numPartitions=9).selectExpr("id", "id % 10 AS x"), "first")
    with settings(spark, FILE_BY_FILE):
        assert first.rdd.getNumPartitions() == 9
        again = write_and_read(first.selectExpr("id", "x * 2.0 AS x"), "again")
        parts = [sorted(r.id for r in p) for p in again.rdd.glom().collect()]
    assert sorted(parts) == [list(range(a, a + 100)) for a in range(0, 900, 100)]


def test_boosting_deals_rows_out_once(rows, spark, monkeypatch):
    monkeypatch.setattr(trees, "FIT_ROWS", 60)
    calls, dealt = [], trees.dealt

    def noted(train):
        calls.append(train)
        return dealt(train)

    monkeypatch.setattr(trees, "dealt", noted)
    model, train_losses, losses = trees.fit_with_patience(rows.where("split = 'train'"), rows.where("split = 'test'"), "target", SMALL, segment=2)
    assert len(calls) == 1 and model.getNumTrees == 3
    assert all(b < a for a, b in zip(train_losses, train_losses[1:])) and len(losses) == 3
    assert spark.conf.get(FILE := "spark.sql.files.openCostInBytes") != FILE_BY_FILE[FILE]


def test_a_fit_gets_its_partitions_without_adaptive_execution(rows, spark, monkeypatch):
    monkeypatch.setattr(trees, "FIT_ROWS", 60)
    before = spark.conf.get(AE)
    with trees.dealing(rows.where("split = 'train'"), ["target", trees.VECTOR]) as part:
        assert part.columns == ["target", trees.VECTOR] and spark.conf.get(AE) == "false"
        assert part.rdd.getNumPartitions() == -(-320 // 60) and part.count() == 320
    assert spark.conf.get(AE) == before
    few = rows.limit(50)
    with trees.dealing(few, ["target"]) as part:
        assert part is few and spark.conf.get(AE) == before


def whole(function, *args, **named):
    """The settings of a call, by name, with the defaults of the operator."""
    call = inspect.signature(function).bind(*args, **named)
    call.apply_defaults()
    return call.arguments


@pytest.mark.parametrize("name", ["i03_grid_search", "b09_best_parameters"])
def test_a_search_runs_the_whole_grid(spark, events, monkeypatch, name):
    calls, search = [], tuning.grid_search

    def noted(*args, **named):
        calls.append(whole(search, *args, **named))
        return tuning.SearchResult(None, {"maxIter": 1, "maxDepth": 2}, [(1, 2, 3.0)])

    monkeypatch.setattr(tuning, "grid_search", noted)
    assert learning_queries[name](spark, events).count() > 0
    (call,) = calls
    assert (len(call["rounds"]) * len(call["depths"]), call["folds"], call["repeats"]) == (24, 10, 3)
    assert max(call["rounds"]) == 300 and call["settings"] == trees.TreeSettings()
    assert call["train"].where("split != 'train'").isEmpty()


@pytest.mark.parametrize("name", ["i04_importance", "i02_stack"])
def test_a_fit_has_all_rounds(spark, events, monkeypatch, name):
    calls, fit = [], trees.fit_trees

    def noted(*args, **named):
        calls.append(whole(fit, *args, **named)["settings"])
        return fit(*args, **{**named, "settings": SMALL})

    monkeypatch.setattr(trees, "fit_trees", noted)
    assert learning_queries[name](spark, events).count() in (2, 10)
    assert calls == [trees.TreeSettings()] and (calls[0].depth, calls[0].rounds) == (6, 500)


def test_noise_is_written_in_compiled_methods(spark, events, monkeypatch):
    limits = []

    def noted(df, label):
        limits.append((label, spark.conf.get("spark.sql.codegen.hugeMethodLimit")))
        return write_and_read(df, label)

    monkeypatch.setattr(learning, "write_and_read", noted)
    got = learning_queries["i06_noisy_copies"](spark, events)
    assert limits[-1] == ("noisy", "8000") and got.count() == learning._rows(spark, events).count()
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") != "8000"


def test_an_ensemble_deals_rows_out_once(rows, spark, monkeypatch):
    monkeypatch.setattr(trees, "FIT_ROWS", 60)
    calls, dealt = [], trees.dealt

    def noted(train):
        calls.append(train)
        return dealt(train)

    for module in (trees, combine):
        monkeypatch.setattr(module, "dealt", noted, raising=False)
    models = combine.fit_ensemble(rows.where("split = 'train'"), "target", SMALL, (1, 2))
    assert len(models) == 2 and len(calls) == 1
    assert [m.getOrDefault("seed") for m in models] == [1, 2]
