"""Quality rules: robust multivariate outliers, by DataFrame functions only.

Statistics of each whole text are transformed to a vector and rounded to whole
thousandths. For each group of language and source the minimum covariance
determinant (MCD) estimate is found: the mean and covariance of the ``share`` of rows
with the smallest determinant. From two deterministic starts (mean and covariance of
all rows; middle values with a diagonal scale) concentration steps are taken, and of
both the smaller determinant is kept. Rows whose Mahalanobis distance exceeds the
cutoff are rejected.

A step is one aggregate: rows are summed up by group and by bin of their distance
(``BINS`` to a doubling), and running sums over the bins give mean and covariance of
the nearest ones, in whole bins. Sums are of integers, so the result doesn't hang on
the order of rows or on tasks that ran twice, and a hot group is summed up before the
shuffle. The covariance gets ``FLOORS`` squared on its diagonal, as a statistic that
is constant in a group would make it singular.

Groups of fewer than ``min_group`` rows that pass the base rules are judged as one
group; if this is smaller still, nothing in it is rejected. Null languages and
sources are values of their own. A null or empty text has no words and fails the
base rules. Rows are judged each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.session import write_and_read

BLANKS = " \t\n\x0b\x0c\r"
BINS = 16
UNIT = 1000
STATISTICS = ("size", "word_length", "symbols", "dup_lines", "repeats")
#: In transformed units; differences below these are never outlying.
FLOORS = (0.25, 0.05, 0.2, 0.6, 0.1)
DIMS = range(len(STATISTICS))
PAIRS = [(j, k) for j in DIMS for k in range(j + 1)]


@dataclass(frozen=True)
class Settings:
    share: float = 0.75
    tail: float = 1e-10
    steps: int = 5
    min_group: int = 60
    min_words: int = 50
    max_repeat_percent: int = 50


def chi2_below(x: float, dof: int) -> float:
    """Distribution function of chi-square, by its series."""
    if x <= 0:
        return 0.0
    half, s = x / 2, dof / 2
    term = total = 1 / s
    k = 0
    while term > total * 1e-17:
        k += 1
        term *= half / (s + k)
        total += term
    return min(1.0, total * math.exp(s * math.log(half) - half - math.lgamma(s)))


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_below(middle, dof) < p else (low, middle)
    return high


def base_statistics(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
                    group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``doc_id``, the groups and the base statistics of each row."""
    groups = [F.col(f"`{c}`").cast("string").alias(f"group_{i}") for i, c in enumerate(group_cols)]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *groups, text.alias("text"))
    inner = F.btrim("text", F.lit(BLANKS))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+", -1))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.select(
        "doc_id", *[f"group_{i}" for i in range(len(group_cols))], words.alias("words"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )
    n = F.size("words")
    grams = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    )
    df = df.withColumn("grams", grams)
    df = df.withColumn("grams", F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))

    def same(x: Column, k: Column) -> Column:
        return F.coalesce(F.get("grams", k)["h"] == x["h"], F.lit(False))

    places = F.transform(F.filter("grams", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])
    df = df.withColumn("places", F.sort_array(places)).drop("grams")
    # a window covers three words, less those that the next one covers too
    covered = F.aggregate(
        F.transform("places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    return df.select(
        "doc_id", *[f"group_{i}" for i in range(len(group_cols))], n.cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < settings.min_words) | (100 * F.col("n_repeat_words") > settings.max_repeat_percent * F.col("n_words")),
    )


def _vector() -> list[Column]:
    """The transformed statistics in whole thousandths, as ``z0, z1, ...``."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    values = (
        F.log(words), F.log(chars / words), F.log1p(100 * F.col("n_symbols") / chars),
        F.log1p("n_dup_lines"), F.sqrt(F.col("n_repeat_words") / words),
    )
    return [F.round(v * UNIT).cast("long").alias(f"z{k}") for k, v in enumerate(values)]


def _moments(n: Column, sums: list[Column], products: dict) -> list[Column]:
    """Mean and covariance with floors, in units of z."""
    n = n.cast("double")
    means = [s.cast("double") / n for s in sums]
    out = [m.alias(f"m{k}") for k, m in enumerate(means)]
    for j, k in PAIRS:
        # decimals keep the difference exact before it becomes a double
        centred = (products[j, k] * n.cast("decimal(18,0)") - sums[j] * sums[k]).cast("double") / (n * n)
        out.append((centred + (FLOORS[j] * UNIT) ** 2 if j == k else centred).alias(f"c{j}{k}"))
    return out


def _factored(rows: DataFrame) -> DataFrame:
    """Adds the Cholesky factor ``l<j><k>`` of the covariance and ``logdet``."""
    for j in DIMS:
        for k in range(j + 1):
            rest = F.col(f"c{j}{k}")
            for i in range(k):
                rest = rest - F.col(f"l{j}{i}") * F.col(f"l{k}{i}")
            rows = rows.withColumn(f"l{j}{k}", F.sqrt(rest) if j == k else rest / F.col(f"l{k}{k}"))
    return rows.withColumn("logdet", sum((F.log(F.col(f"l{k}{k}")) for k in DIMS), F.lit(0.0)))


def _distance() -> Column:
    """Squared Mahalanobis distance of z from m by forward substitution."""
    y: list[Column] = []
    for j in DIMS:
        rest = F.col(f"z{j}") - F.col(f"m{j}")
        for k in range(j):
            rest = rest - F.col(f"l{j}{k}") * y[k]
        y.append(rest / F.col(f"l{j}{j}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


PARAMETERS = ["cell", *[f"m{k}" for k in DIMS], *[f"l{j}{k}" for j, k in PAIRS], "logdet"]


def _sums(by: list[str], rows: DataFrame) -> DataFrame:
    big = lambda c: F.sum(c.cast("decimal(18,0)"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[big(F.col(f"z{k}")).alias(f"s{k}") for k in DIMS],
        *[big(F.col(f"z{j}") * F.col(f"z{k}")).alias(f"p{j}{k}") for j, k in PAIRS],
    )


def _estimates(rows: DataFrame, settings: Settings) -> DataFrame:
    """Parameters of each cell, from rows ``cell, z0, ...``."""
    columns = lambda: (F.col("n"), [F.col(f"s{k}") for k in DIMS], {(j, k): F.col(f"p{j}{k}") for j, k in PAIRS})
    whole = _sums(["cell"], rows)
    classical = _factored(whole.select("cell", F.lit(0).alias("start"), *_moments(*columns())))
    # middle values, from counts of each value: exact, and as many rows as there are values
    counts = rows.select("cell", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"z{k}").alias("z")) for k in DIMS])).alias("_v"))
    counts = counts.groupBy("cell", "_v.k", "_v.z").agg(F.count(F.lit(1)).alias("c"))
    over = Window.partitionBy("cell", "k")
    ranked = counts.withColumns({"upto": F.sum("c").over(over.orderBy("z")), "n": F.sum("c").over(over)})
    quarter = lambda q: F.min(F.when(F.col("upto") >= F.col("n") * q, F.col("z")))
    middle = ranked.groupBy("cell", "k").agg(quarter(0.5).alias("m"), ((quarter(0.75) - quarter(0.25)) * 0.7413).alias("d"))
    middle = middle.groupBy("cell").agg(
        *[F.max(F.when(F.col("k") == k, F.col("m"))).cast("double").alias(f"m{k}") for k in DIMS],
        *[F.max(F.when(F.col("k") == k, F.col("d"))).alias(f"d{k}") for k in DIMS],
    ).select("cell", F.lit(1).alias("start"), *[f"m{k}" for k in DIMS], *[
        (F.col(f"d{j}") * F.col(f"d{j}") + (FLOORS[j] * UNIT) ** 2 if j == k else F.lit(0.0)).alias(f"c{j}{k}") for j, k in PAIRS
    ])
    kept = ["start", *PARAMETERS]
    now = write_and_read(classical.select(*kept).unionByName(_factored(middle).select(*kept)), "quality-start")
    for _ in range(settings.steps):
        binned = rows.join(now, "cell").withColumn("bin", F.floor(F.log2(1 + _distance()) * BINS))
        bins = _sums(["cell", "start", "bin"], binned)
        running = Window.partitionBy("cell", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        names = ["n", *[f"s{k}" for k in DIMS], *[f"p{j}{k}" for j, k in PAIRS]]
        sums = bins.select("cell", "start", F.sum("n").over(Window.partitionBy("cell", "start")).alias("total"),
                           *[F.sum(c).over(running).alias(c) for c in names])
        enough = sums.where(F.col("n") >= F.ceil(F.col("total") * settings.share))
        nearest = enough.groupBy("cell", "start").agg(F.min_by(F.struct(*names), "n").alias("_s")).select("cell", "start", "_s.*")
        now = write_and_read(_factored(nearest.select("cell", "start", *_moments(*columns()))).select(*kept), "quality-step")
    return now.groupBy("cell").agg(F.min_by(F.struct(*PARAMETERS[1:]), F.struct("logdet", "start")).alias("_b")).select("cell", "_b.*")


def judge(
    docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
    group_cols: tuple[str, ...] = ("lang", "source"),
) -> DataFrame:
    """``doc_id``, base statistics, ``base_failed``, ``distance`` (squared, null where none is judged) and ``kept`` of each row."""
    groups = [f"group_{i}" for i in range(len(group_cols))]
    stats = write_and_read(base_statistics(docs, settings, id_col, text_col, group_cols).select("*", *_vector()), "quality-statistics")
    sound = stats.where("NOT base_failed")
    sizes = sound.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= settings.min_group)
    # one text per group; nulls apart from every value, and small groups in the empty one
    name = F.to_json(F.struct(*groups))
    large = write_and_read(sizes.select(name.alias("cell")), "quality-groups").withColumn("_large", F.lit(True))
    celled = stats.withColumn("cell", name).join(large, "cell", "left").withColumn(
        "cell", F.when(F.col("_large"), F.col("cell")).otherwise(F.lit(""))
    ).drop("_large")
    values = [f"z{k}" for k in DIMS]
    pooled = celled.where("NOT base_failed").select("cell", *values)
    cells = pooled.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= settings.min_group).select("cell")
    judged = pooled.join(write_and_read(cells, "quality-cells"), "cell", "left_semi")
    best = write_and_read(_estimates(judged, settings), "quality-estimates")
    dof = len(STATISTICS)
    nearest = chi2_quantile(settings.share, dof)
    wider = settings.share / chi2_below(nearest, dof + 2)  # of a normal sample, the covariance of its nearest share is so much too small
    cutoff = chi2_quantile(1 - settings.tail, dof)
    out = celled.join(best, "cell", "left").withColumn("distance", _distance() / wider)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"),
    )
