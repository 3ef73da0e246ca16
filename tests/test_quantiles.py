"""Radix selection against numpy: order of keys, hard numbers, many values in a narrow range."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.ordering import ordered_key
from tidegrid.operators.quantiles import _value_of, describe, quantiles

HARD = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.7976931348623157e308, -1.7976931348623157e308,
        float("inf"), float("-inf"), 0.1, 1 / 3, 2.0**52 + 1, np.nextafter(1, 0), np.nextafter(2, 0), np.nextafter(4, 8), 1e-310]


def numbers():
    bits = np.random.default_rng(3).integers(0, 1 << 63, 4_000, dtype=np.uint64)
    values = np.concatenate([bits.view(np.float64), -bits.view(np.float64), HARD, 2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1000, 1000), 0)])
    return values[~np.isnan(values)]


def test_keys_are_the_bits_in_order(spark):
    values = numbers()
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = rows.select("v", ordered_key(F.col("v")).alias("k")).withColumn("back", _value_of(F.col("k"))).collect()
    for r in got:
        bits = int(np.float64(abs(r.v)).view(np.int64))
        assert r.k == (-bits if r.v < 0 else bits), r.v
        assert r.back == r.v
    assert spark.sql("SELECT CAST('NaN' AS DOUBLE) v UNION ALL SELECT NULL").where(ordered_key(F.col("v")).isNotNull()).count() == 0


def expected(values, p):
    return float(np.quantile(np.array(values, float), p))


@pytest.mark.parametrize("probs", [[0, 0.25, 0.5, 0.75, 1], [0.1, 0.1, 0.999]])
def test_groups_nulls_and_ties(spark, probs):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g in ("a", None, "b") for v in rng.integers(-50, 50, 333) / 7]
    rows += [("a", None), ("nothing", None), ("nan", float("nan")), ("one", 4.5), (None, float("nan"))]
    got = quantiles(spark.createDataFrame(rows, "g string, v double"), "v", probs, ["g"]).collect()
    groups = {g: [v for h, v in rows if h == g and v is not None and v == v] for g, _ in rows}
    want = {(g, p): expected(v, p) for g, v in groups.items() if v for p in probs}
    assert len(got) == len(want)
    for r in got:
        assert r.value == pytest.approx(want[r.g, r.probability], rel=1e-14)


def test_infinite_and_tiny_values(spark):
    values = [float(v) for v in HARD if np.isfinite(v)]
    got = {r.probability: r.value for r in quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [0, 0.5, 1]).collect()}
    assert got == {0.0: min(values), 0.5: sorted(values)[len(values) // 2] if len(values) % 2 else got[0.5], 1.0: max(values)}
    both = spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),)], "v double")
    assert [r.value for r in quantiles(both, "v", [0, 0.5, 1]).orderBy("probability").collect()] == [float("-inf"), 1.0, float("inf")]


def test_a_million_values_between_two_neighbours(spark):
    """All inside a range that a sketch could not tell apart, and beside far ones."""
    n = 1_000_000
    rows = spark.range(n).select((F.lit(1.0) + F.col("id") * 2.0**-40).alias("v"))
    rows = rows.union(spark.range(10).select((F.col("id") * 1e300).alias("v")))
    values = np.concatenate([1 + np.arange(n) * 2.0**-40, np.arange(10) * 1e300])
    probs = [0.0, 0.01, 0.25, 0.5, 0.5000001, 0.9999, 1.0]
    got = {r.probability: r.value for r in quantiles(rows, "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(expected(values, p), rel=1e-15)


def test_rounds_order_counts_only(spark, monkeypatch):
    """No window runs over rows: only over counts of digits, of which there are 65,536 at most."""
    from tidegrid.operators import quantiles as module

    written = {}

    def keep(df, label, write=module.write_and_read):
        written[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(module, "write_and_read", keep)
    quantiles(spark.range(1_000).select(F.rand(5).alias("v"), (F.col("id") % 3).alias("g")), "v", [0.5], ["g"])
    assert list(written) == ["keys", "digits", *(f"ranks-{k}" for k in range(4))]
    assert "Window" not in written["keys"] + written["digits"]
    for step in range(4):
        plan = written[f"ranks-{step}"]
        # below the window there is an aggregate by digit, not rows
        assert plan.count("Window ") == 1 and (not step or "HashAggregate" in plan[plan.index("Window ") :])
    assert "Range (" in written["keys"] and not any("Range (" in p for label, p in written.items() if label != "keys")


def test_describe_of_nothing(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert quantiles(none, "v", [0.5], ["g"]).count() == 0 and describe(none, "v", ["g"]).count() == 0
    row = describe(none, "v").first()
    assert row["count"] == 0 and row["q50"] is None
