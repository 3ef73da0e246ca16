"""Whitening against exact sums and a plain eigendecomposition."""

import numpy as np
import pytest

from tidegrid.llm import whitening
from tidegrid.llm.queries import QUERIES
from tidegrid.llm.spectrum import Spectrum

ROWS = "vec_id long, embedding array<float>, label int, v string, n long, part long, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 5, 6, 7) for i, v in rows], ROWS)


def whole(rows):
    keep = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    return [i for i, _ in keep], np.floor(1024 * np.array([v for _, v in keep], dtype=np.float32).astype(float)) + 100_000


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 6)) * [3, 2.5, 1, 0.6, 0.4, 0.2]
    out = [(k, v.tolist()) for k, v in enumerate(base)]
    out += [(100 + k, base[0].tolist()) for k in range(40)]  # a third of the rows is one vector
    out += [(None, base[1].tolist()), (3, base[2].tolist()), (3, base[2].tolist())]
    out += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5)]
    out += [(204, [1.0, 2.0]), (205, [])]
    return out


@pytest.mark.parametrize("fold", [1, 7, 512])
def test_components_are_those_of_the_covariance(spark, rows, fold):
    table = frame(spark, rows).repartition(11)
    model = whitening.fit(table, components=6, fold=fold)
    ids, x = whole([r for r in rows if r[1] is not None and len(r[1]) == 6])
    assert model.n == len(x)
    assert list(model.sums) == [int(s) for s in x.sum(0)]
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    np.testing.assert_allclose(model.variances, values[::-1], rtol=1e-12)
    np.testing.assert_allclose(np.abs((axes[:, ::-1] * model.components).sum(0)), 1, atol=1e-12)
    got = whitening.whiten(table, model).toPandas()
    assert len(got) == 6 * len(x)
    np.testing.assert_allclose(got["explained"].unique().sum(), 1)
    plain = (x - x.mean(0)) @ model.components / np.sqrt(model.variances)
    want = sorted((-1 if i is None else i, k + 1, y) for i, row in zip(ids, plain) for k, y in enumerate(row))
    have = sorted(zip(got.vec_id.fillna(-1).astype(int), got.component, got.whitened))
    assert [w[:2] for w in want] == [h[:2] for h in have]
    np.testing.assert_allclose([h[2] for h in have], [w[2] for w in want], atol=1e-10)
    n, sums = len(x), [int(s) for s in x.sum(0)]
    exact = {sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x}
    assert set(got.deviation) == exact
    assert whitening.identity_error(table, model) < 1e-12


def test_rows_one_by_one_and_spectra_of_parts():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 12)) * 100) @ np.diag([1.0] * 8 + [0, 0, 1e-3, 1e3])
    one, two, blocks = Spectrum(12), Spectrum(12), Spectrum(12)
    for row in x[:110]:
        one.add(row)
    for row in x[110:]:
        two.add(row)
    one.merge(two)
    for at in range(0, 300, 40):
        blocks.add_block(x[at : at + 40])
    scatter = (x - x.mean(0)).T @ (x - x.mean(0))
    for s in (one, blocks):
        assert s.n == 300
        np.testing.assert_allclose(s.mean, x.mean(0), atol=1e-10)
        np.testing.assert_allclose(s.vectors @ np.diag(s.values) @ s.vectors.T, scatter, atol=1e-12 * scatter.max() * 12)
        np.testing.assert_allclose(s.vectors.T @ s.vectors, np.eye(12), atol=1e-12)


def test_close_and_equal_eigenvalues_are_deflated():
    s = Spectrum(5)
    for row in [*np.eye(5), *(-np.eye(5)), *np.eye(5), *(-np.eye(5)), *([np.zeros(5)] * 9)]:
        s.add(row)
    np.testing.assert_allclose(s.values, 4, rtol=1e-12)
    np.testing.assert_allclose(s.vectors.T @ s.vectors, np.eye(5), atol=1e-12)


def test_too_few_directions_and_large_entries(spark):
    table = frame(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(9)])
    model = whitening.fit(table)
    got = whitening.whiten(table, model).toPandas()
    assert got[got.component == 1].whitened.notna().all() and got[got.component > 1].whitened.isna().all()
    assert got[got.component > 1].explained.max() < 1e-12
    same = frame(spark, [(k, [1.5, 2.5]) for k in range(4)])
    model = whitening.fit(same)
    assert whitening.identity_error(same, model) is None
    got = whitening.whiten(same, model).toPandas()
    assert got.whitened.isna().all() and set(got.deviation) == {0} and set(got.explained) == {0.0}
    huge = frame(spark, [(1, [1e30, 1.0]), (2, [-3e38, 2.0]), (3, [0.5, 4.0])])
    got = whitening.whiten(huge, whitening.fit(huge)).toPandas()
    assert len(got) == 6 and got.deviation.isna().sum() > 0 and np.isfinite(got.whitened).any()


def test_sums_beyond_a_long_are_exact(spark):
    rows = [(k, [3e38, -1.0]) for k in range(5000)]
    model = whitening.fit(frame(spark, rows).repartition(2))
    assert model.sums == (5000 * (2**52 + 100_000), 5000 * (100_000 - 1024))


def test_nothing_to_whiten(spark):
    for table in (frame(spark, []), frame(spark, [(1, None), (2, [])])):
        assert whitening.fit(table) is None
        assert whitening.whiten(table, None).count() == 0


def test_query(spark, folder):
    got = QUERIES["op13_whitening"](spark, folder).toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    ids, x = whole(rows)
    assert len(got) == 8 * len(x) and set(got.n) == {len(x)} and got.identity_error.max() < 1e-10
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    for k in range(8):
        have = got[got.component == k + 1].sort_values("vec_id").whitened.to_numpy()
        want = ((x - x.mean(0)) @ axes[:, -1 - k] / np.sqrt(values[-1 - k]))[np.argsort(ids, kind="stable")]
        np.testing.assert_allclose(have * np.sign(have[0] * want[0]), want, atol=1e-8)
    n, sums = len(x), [int(s) for s in x.sum(0)]
    exact = sum(sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x)
    assert int(got[got.component == 1].deviation.sum()) == exact
