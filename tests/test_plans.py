import re
from importlib.util import find_spec

import __spark_entry__ as contract
from tidegrid.columns import CALENDAR, CHANGES, ENCODINGS, FEATURES, INTERACTIONS, LAGS, ROLLING, WEATHER
from tidegrid.plans.features import feature_table, features_for_range, model_table, padded_start
from tidegrid.session import scratch_path, shared_folder
from tidegrid.sources.adapters import HOURLY, hourly_events

SPLIT = "2024-01-25"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_table_has_the_documented_columns(spark, folder):
    assert [len(x) for x in (WEATHER, CALENDAR, LAGS, ROLLING, INTERACTIONS, CHANGES, ENCODINGS)] == [8, 19, 8, 10, 11, 3, 5]
    table = model_table(hourly_events(spark, folder), HOURLY, SPLIT)
    features = [c for c in table.columns if c not in ("series", "ts", "split", "demand", "target")]
    assert sorted(features) == sorted(FEATURES) and len(features) == 64


def test_row_counts_and_dropped_rows(spark, folder):
    raw = hourly_events(spark, folder, "event_type")
    table = model_table(raw, HOURLY, SPLIT)
    assert raw.count() == 3600 and table.count() == 3600 - 5 * 168
    assert {r.split: r["count"] for r in table.groupBy("split").count().collect()} == {
        "train": 5 * (24 * 24 - 168), "test": 5 * 6 * 24}


def test_all_window_features_share_one_exchange_and_one_window(spark, folder):
    raw = spark.read.parquet(f"{folder}/events.parquet").selectExpr(
        "user_id AS series", "ts", "CAST(ts AS DATE) AS date", "hour(ts) AS hour", "event_id AS demand",
        *[f"value AS {c}" for c in WEATHER], "event_type AS season", "event_type AS holiday", "event_type AS functioning")
    text = plan(feature_table(raw, HOURLY))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert len(re.findall(r"\bWindow \[", text)) == 1 and len(re.findall(r"\bSort \[", text)) == 1
    assert "SinglePartition" not in text and "Python" not in text


def test_series_filter_and_pruning_reach_the_scan(spark, folder):
    table = feature_table(hourly_events(spark, folder), HOURLY)
    text = plan(table.where("series = 7").select("ts", "demand_lag_168h"))
    assert "EqualTo(user_id,7)" in text
    assert not re.search(r"\b(props|value)#", text)


def test_range_filter_reaches_the_scan_and_changes_nothing(spark, folder):
    start, end = "2024-01-20 00:00:00", "2024-01-21 00:00:00"
    raw = hourly_events(spark, folder, since=padded_start(start, HOURLY), until=end)
    ranged = features_for_range(raw, HOURLY, start, end)
    assert "GreaterThanOrEqual(ts,2024-01-13T00:00)" in plan(ranged)
    whole = feature_table(hourly_events(spark, folder), HOURLY).where(f"ts >= '{start}' AND ts < '{end}'")
    names = [c for c in whole.columns if not c.endswith(("std", "mean"))]
    assert whole.select(names).exceptAll(ranged.select(names)).isEmpty() and ranged.count() == whole.count()


def test_model_table_can_be_joined_without_a_slow_plan(spark, folder):
    table = model_table(hourly_events(spark, folder), HOURLY, SPLIT)
    joined = table.join(spark.range(3).withColumnRenamed("id", "series"), "series")
    assert "SortMergeJoin" in plan(joined) or "BroadcastHashJoin" in plan(joined)


def test_no_query_uses_a_cross_join(spark, folder):
    for name in ("feature_table", "g13_scale_and_back", "c08_months_split", "c09_stratified_split", "i08_mixup_pairs",
                 "h11_improvement", "g17_residual_histogram", "b08_predictions_wide"):
        text = plan(contract.queries()[name](spark, folder))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_mixup_never_broadcasts_a_side_as_long_as_the_table(spark, folder):
    """File sizes say nothing of the cells a grid makes, so the planner took these joins for small."""
    for name in ("i08_mixup_pairs", "i08_mixup_beta", "i09_mixup_batches"):
        assert "Broadcast" not in plan(contract.queries()[name](spark, folder)), name


def test_scratch_folder_is_the_one_the_session_names(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    assert folder is None or shared_folder(spark) == folder.rstrip("/")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    rows = contract.entry(spark).collect()
    assert {r.split for r in rows} == {"train", "test"}
    there = find_spec("tidegrid.llm") is not None and find_spec("corpus_pipeline") is not None
    assert any("pipeline" in n or re.match(r"op\d", n) for n in contract.queries()) == there


def test_every_surveyed_operator_has_a_query():
    wanted = (
        [f"a{i:02d}" for i in range(1, 6)] + [f"b{i:02d}" for i in range(1, 12)]
        + [f"c{i:02d}" for i in (1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13)] + [f"d{i:02d}" for i in range(1, 9)]
        + [f"e{i:02d}" for i in range(1, 11)] + [f"f{i:02d}" for i in range(1, 11)]
        + [f"g{i:02d}" for i in (*range(1, 14), 15, 16, 17, 18, 20)] + [f"h{i:02d}" for i in range(1, 14)]
        + [f"i{i:02d}" for i in range(1, 12)] + ["j01", "k02"]
    )
    names = contract.queries()
    assert [w for w in wanted if not any(n.startswith(w) for n in names)] == []


def test_sql_twins_agree_on_the_small_tables(spark, folder):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name in ("f03_rolling_mean", "g12_scaler_fit", "c10_tail_validation", "h05_mape_floor", "b08_predictions_wide"):
        got = contract.queries()[name](spark, folder)
        got = got.select(*sorted(got.columns)).collect()
        cursor = con.execute(contract.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        want = [tuple(r[i] for i in order) for r in cursor.fetchall()]
        assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want)), name


def test_window_tasks_are_not_put_together_by_compressed_size(spark, folder, capsys):
    contract.queries()["f06_temperature_rolling"](spark, folder).explain()
    plan = capsys.readouterr().out
    assert plan.count("REPARTITION_BY_NUM") == 1 and "_block" in next(x for x in plan.splitlines() if "REPARTITION_BY_NUM" in x)
    # the window takes that exchange as its own
    above = plan[: plan.index("REPARTITION_BY_NUM")]
    assert above.count("Exchange") == 1 and "Window" in above
