"""Models, tuning, ensembles and augmentation.

Fits cannot be written in SQL, so most queries here have no SQL twin; the pairing
rules of the augmentations have one. The search, the stack and the importances have
the operators' whole settings, the other fits few rounds (README); no rows are cut.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from tidegrid.functions.hashing import arithmetic_hash
from tidegrid.models import combine, trees, tuning, windows
from tidegrid.operators import augment, metrics, scaling
from tidegrid.operators.selecting import top
from tidegrid.operators.splitting import split_at_date, split_tail
from tidegrid.plans.features import model_table
from tidegrid.queries.base import (
    HOURLY, SPLIT_DATE, hourly_events, hourly_sql, query, r6, s6,
)
from tidegrid.session import COMPILED, scratch_path, settings, write_and_read
from tidegrid.sinks import reports, tables
from tidegrid.sources import results

KEYS = ["series", "ts"]
INPUTS = [
    "demand_lag_1h", "demand_lag_24h", "demand_lag_168h", "demand_rolling_24h_mean", "demand_rolling_24h_std",
    "temp_lag_1h", "hour_sin", "hour_cos", "is_rush_hour", "is_weekend",
]
SMALL = trees.TreeSettings(depth=3, rounds=4, patience=2)


def _rows(spark, folder):
    """Model rows, scaled on the training part, written once: a fit reads them many times.

    Windows are made once, in compiled methods, and held on disk for the statistics and the scaled rows: by partition
    as they are made, so that sums, files and the rows that a fit draws are those of windows made twice.
    """
    table = model_table(hourly_events(spark, folder), HOURLY, SPLIT_DATE)
    plain = table.select(*KEYS, "split", F.col("target").cast("double").alias("target"), *INPUTS).persist(StorageLevel.DISK_ONLY)
    try:
        with settings(spark, COMPILED):
            stats = scaling.fit_scaler(plain.where("split = 'train'"), INPUTS)
            return write_and_read(scaling.transform(plain, stats, INPUTS), "rows")
    finally:
        plain.unpersist()


def _vectors(spark, folder):
    return trees.assemble(_rows(spark, folder), INPUTS)


def _parts(rows):
    """Fit and validation rows: the last fifth of each training series validates."""
    roles = split_tail(rows.where("split = 'train'"), HOURLY, 0.2)
    return roles.where("role = 'train'"), roles.where("role = 'validation'")


def _scored(model, rows):
    return trees.score(model, rows).select(*KEYS, "split", F.col("target").alias("actual"), "predicted")


@query("i01_boosted_trees")
def i01(spark, folder):
    rows = _vectors(spark, folder)
    fit, validation = _parts(rows)
    model, _, _ = trees.fit_with_patience(fit, validation, "target", SMALL)
    return metrics.evaluate(_scored(model, rows), by=["split"])


@query("i02_stack")
def i02(spark, folder):
    rows = _rows(spark, folder)
    embedding = windows.fit_window_components(rows.where("split = 'train'"), HOURLY, INPUTS, 24)
    # packs of rows are written, a sixth of the size of their windows' vectors; each pass makes the vectors anew
    packs = write_and_read(windows.window_packs(rows, HOURLY, INPUTS, embedding.length, [*KEYS, "split", "target"]), "packs")
    packs = windows.dealt_packs(packs, trees.FIT_ROWS)
    train = windows.packed_scores(packs.where("_carry[0].split = 'train'"), embedding)
    model = trees.fit_trees(train, "target", deal=False)
    return metrics.evaluate(_scored(model, windows.packed_scores(packs, embedding)), by=["split"])


def _search(spark, folder):
    rows = _vectors(spark, folder)
    train = rows.where("split = 'train'")
    return rows, tuning.grid_search(train, "target", KEYS)


@query("i03_grid_search")
def i03(spark, folder):
    _, found = _search(spark, folder)
    return spark.createDataFrame(found.scores, "rounds int, depth int, rmse double")


@query("b09_best_parameters")
def b09(spark, folder):
    _, found = _search(spark, folder)
    return reports.best_parameters(spark, found.best)


@query("i04_importance")
def i04(spark, folder):
    rows = _vectors(spark, folder)
    model = trees.fit_trees(rows.where("split = 'train'"), "target")
    return top(trees.importances(model, INPUTS, spark), "importance", 15, ["feature"])


@query("b06_training_history")
def b06(spark, folder):
    fit, validation = _parts(_vectors(spark, folder))
    _, train_losses, losses = trees.fit_with_patience(fit, validation, "target", SMALL)
    return reports.training_history(spark, train_losses, losses, [SMALL.rate] * len(losses))


@query("i05_ensemble_trees")
def i05(spark, folder):
    rows = _vectors(spark, folder)
    models = combine.fit_ensemble(rows.where("split = 'train'"), "target", SMALL, combine.ENSEMBLE_SEEDS[:2])
    scored = combine.score_ensemble(models, rows, INPUTS, KEYS)
    return scored.select(*KEYS, "split", F.col("target").alias("actual"), r6("predicted"))


@query("i06_noisy_copies")
def i06(spark, folder):
    rows = _vectors(spark, folder)
    model = trees.fit_trees(rows.where("split = 'train'"), "target", SMALL)
    scored = combine.score_ensemble([model], rows, INPUTS, KEYS, copies=combine.NOISY_COPIES)
    found = scored.select(*KEYS, "split", F.col("target").alias("actual"), r6("predicted"))
    # the noise of all copies makes a method that is too large to be compiled
    with settings(spark, COMPILED):
        return write_and_read(found, "noisy")


@query("i07_noise")
def i07(spark, folder):
    train = split_at_date(hourly_events(spark, folder), "date", SPLIT_DATE).where("split = 'train'")
    noisy = augment.add_noise(train, ["temperature", "humidity"], KEYS, sigma=0.02)
    return noisy.select(*KEYS, r6("temperature"), r6("humidity"))


_KEY_SQL = "(series * 100000 + date_diff('day', DATE '2024-01-01', date) * 24 + hour)"
_HASH_SQL = "((({key} + {seed}) % 2147483647) * 2654435761) % 2147483647"


def _row_key():
    days = F.datediff("date", F.lit("2024-01-01").cast("date")).cast("long")
    return F.col("series") * 100000 + days * 24 + F.col("hour")


def _h(seed: int) -> str:
    return _HASH_SQL.format(key=_KEY_SQL, seed=seed)


def _train(spark, folder):
    rows = split_at_date(hourly_events(spark, folder), "date", SPLIT_DATE).where("split = 'train'")
    return rows.select(*KEYS, "date", "hour", "demand", "visibility")


@query("i08_mixup_pairs", hourly_sql() + f""",
t AS (SELECT series, ts, date, hour, demand, visibility, {_h(1)} AS h1, {_h(2)} AS h2, {_h(3)} AS h3
      FROM hourly WHERE date < DATE '{SPLIT_DATE}'),
n AS (SELECT *, row_number() OVER (ORDER BY h1, series, ts) AS rn, count(*) OVER () AS n FROM t),
p AS (SELECT a.*, h2 / 2147483647.0e0 < 0.5 AS mixed, h3 % n + 1 AS partner FROM n a)
SELECT p.series, p.ts, CAST(p.mixed AS INTEGER) AS mixed,
       CASE WHEN mixed THEN 0.25e0 * p.demand + 0.75e0 * o.demand ELSE CAST(p.demand AS DOUBLE) END AS demand,
       {s6('CASE WHEN mixed THEN 0.25e0 * p.visibility + 0.75e0 * o.visibility ELSE p.visibility END', 'visibility')}
FROM p JOIN n o ON o.rn = p.partner""")
def i08(spark, folder):
    key = _row_key()
    mixed = augment.mixup_pairs(
        _train(spark, folder), ["visibility"], "demand", KEYS, order=arithmetic_hash(key, 1), bits=31,
        chance=arithmetic_hash(key, 2) / F.lit(2147483647.0), partner=arithmetic_hash(key, 3), weight=F.lit(0.25))
    return mixed.select(*KEYS, "mixed", "demand", r6("visibility"))


@query("i08_mixup_beta")
def i08_beta(spark, folder):
    mixed = augment.mixup_pairs(_train(spark, folder), ["visibility"], "demand", KEYS)
    return mixed.select(*KEYS, "mixed", r6("demand"), r6("visibility"))


@query("i09_mixup_batches", hourly_sql() + f""",
t AS (SELECT series, ts, date, hour, demand, visibility, {_h(1)} AS h1, {_h(2)} AS h2
      FROM hourly WHERE date < DATE '{SPLIT_DATE}'),
n AS (SELECT *, row_number() OVER (ORDER BY h1, series, ts) - 1 AS rn, count(*) OVER () AS n FROM t),
b AS (SELECT *, rn // 64 AS batch, rn % 64 AS place FROM n WHERE (rn // 64 + 1) * 64 <= n),
d AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY h2, series, ts) - 1 AS drawn FROM b)
SELECT a.series, a.ts, a.batch, 0.25e0 * a.demand + 0.75e0 * o.demand AS demand,
       {s6('0.25e0 * a.visibility + 0.75e0 * o.visibility', 'visibility')}
FROM d a JOIN d o ON a.batch = o.batch AND a.place = o.drawn""")
def i09(spark, folder):
    key = _row_key()
    mixed = augment.mixup_batches(
        _train(spark, folder), ["visibility"], "demand", KEYS, 64, order=arithmetic_hash(key, 1),
        shuffle=arithmetic_hash(key, 2), bits=31, weight=F.lit(0.25))
    return mixed.select(*KEYS, "batch", "demand", r6("visibility"))


@query("i11_batch_scoring")
def i11(spark, folder):
    rows = _vectors(spark, folder)
    model = trees.fit_trees(rows.where("split = 'train'"), "target", SMALL)
    return _scored(model, rows).withColumn("predicted", r6("predicted"))


@query("b11_model_sink")
def b11(spark, folder):
    rows = _vectors(spark, folder)
    model = trees.fit_trees(rows.where("split = 'train'"), "target", SMALL)
    loaded = results.load_trees(tables.save_model(model, scratch_path(spark, "model")))
    return metrics.evaluate(_scored(loaded, rows), by=["split"])


@query("a05_reload")
def a05(spark, folder):
    """Reloaded scaler and model against the ones in memory, row by row."""
    table = model_table(hourly_events(spark, folder), HOURLY, SPLIT_DATE)
    plain = write_and_read(table.select(*KEYS, "split", F.col("target").cast("double").alias("target"), *INPUTS), "plain")
    stats = scaling.fit_scaler(plain.where("split = 'train'"), INPUTS)
    stored = results.read_scaler(spark, tables.write_scaler(stats, scratch_path(spark, "scaler")))
    rows = trees.assemble(scaling.transform(plain, stored, INPUTS), INPUTS)
    model = trees.fit_trees(rows.where("split = 'train'"), "target", SMALL)
    loaded = results.load_trees(tables.save_model(model, scratch_path(spark, "model")))
    both = loaded.transform(trees.score(model, rows, "in_memory"))
    return both.select(*KEYS, "split", r6("in_memory"), r6("predicted", "reloaded"))
