"""Quality rules, language identification and decontamination."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import decontamination, language_id, quality_rules

BLANK = r"[^\x20\x09-\x0D]+"


def base(text):
    words = re.findall(BLANK, text or "")
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    seen = collections.Counter(grams)
    covered = {p for k, g in enumerate(grams) if seen[g] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(BLANK, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(odd, odd_pairs, by_id):
    got = quality_rules.base_statistics(odd).drop("group_0", "group_1").collect()
    want = []
    for i, t in odd_pairs:
        n, *rest, repeats = base(t)
        want.append((i, n, *rest, repeats, n < 50 or 100 * repeats > 50 * n))
    assert by_id(got) == by_id(want)


def vector(n, chars, symbols, lines, repeats):
    n, chars = max(n, 1), max(chars, 1)
    values = (math.log(n), math.log(chars / n), math.log1p(100 * symbols / chars), math.log1p(lines), math.sqrt(repeats / n))
    return [math.floor(v * 1000 + 0.5) for v in values]


def estimate(z, settings):
    """The same steps with numpy: two starts, steps in whole bins, the smaller determinant."""
    floors = np.diag([(f * 1000) ** 2 for f in quality_rules.FLOORS])
    middle = lambda q: np.sort(z, 0)[math.ceil(len(z) * q) - 1]
    scale = (middle(0.75) - middle(0.25)) * 0.7413
    best = []
    for m, c in ((z.mean(0), np.cov(z.T, bias=True) + floors), (middle(0.5), np.diag(scale**2) + floors)):
        for _ in range(settings.steps):
            d = np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(c), z - m)
            bins = np.floor(np.log2(1 + d) * quality_rules.BINS)
            near = z[bins <= np.sort(bins)[math.ceil(len(z) * settings.share) - 1]]
            m, c = near.mean(0), np.cov(near.T, bias=True) + floors
        best.append((np.linalg.slogdet(c)[1], m, c))
    return min(best, key=lambda x: x[0])[1:]


@pytest.fixture(scope="module")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_judgement_equals_numpy(documents):
    settings = quality_rules.Settings(min_group=20)
    rows = documents.select("doc_id", "text", "lang", "source").collect()
    stats = {r.doc_id: base(r.text) for r in rows}
    failed = {i: s[0] < 50 or 100 * s[4] > 50 * s[0] for i, s in stats.items()}
    sizes = collections.Counter((r.lang, r.source) for r in rows if not failed[r.doc_id])
    cell = {r.doc_id: (r.lang, r.source) if sizes[r.lang, r.source] >= 20 else None for r in rows}
    dof = len(quality_rules.FLOORS)
    wider = 0.75 / quality_rules.chi2_below(quality_rules.chi2_quantile(0.75, dof), dof + 2)
    want = {}
    for c in set(cell.values()):
        own = [i for i in cell if cell[i] == c and not failed[i]]
        z = np.array([vector(*stats[i]) for i in own], dtype=float)
        m, s = estimate(z, settings)
        for i in (i for i in cell if cell[i] == c):
            d = vector(*stats[i]) - m
            want[i] = d @ np.linalg.inv(s) @ d / wider
    got = {r.doc_id: r for r in quality_rules.judge(documents, settings).collect()}
    assert len({c for c in cell.values()}) >= 1
    for i, r in got.items():
        assert r.distance == pytest.approx(want[i], rel=1e-6)
        assert r.kept == (not failed[i] and want[i] <= quality_rules.chi2_quantile(1 - settings.tail, dof))


def test_groups_of_their_own_and_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.judge(docs).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(r.kept for r in rows if r.quality == 0) <= 0.05 * sum(r.quality == 0 for r in rows)


def test_odd_and_empty_tables(odd, odd_pairs, none):
    got = quality_rules.judge(odd)
    assert got.count() == len(odd_pairs) and quality_rules.judge(none).count() == 0
    # too few sound rows for an estimate: nothing is rejected beyond the base rules
    assert all(r.kept == (not r.base_failed) and r.distance is None for r in got.collect())


def test_no_python_runs(odd):
    assert "Python" not in quality_rules.base_statistics(odd)._jdf.queryExecution().executedPlan().toString()


def test_chi_square():
    assert quality_rules.chi2_quantile(0.95, 1) == pytest.approx(3.841458821, abs=1e-6)
    assert quality_rules.chi2_quantile(0.75, 5) == pytest.approx(6.62567976, abs=1e-6)


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    rows = docs.collect()
    train = spark.createDataFrame([r for r in rows if not held(r.doc_id)], docs.schema)
    small = language_id.Settings(per_label=150, rounds=20)
    model = language_id.fit(train, small)
    again = language_id.fit(train.repartition(7), small)
    assert (model.kernel == again.kernel).all() and (model.table == again.table).all()
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    test = [r for r in rows if held(r.doc_id)]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in test]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_slopes_are_the_derivatives():
    rng = np.random.default_rng(0)
    settings = language_id.Settings(window=12, filters=2, rounds=0, windows_per_row=1)
    texts = [bytes(rng.integers(97, 105, 12).astype(np.uint8)) for _ in range(6)]
    model = language_id.train(texts, list("aabbcc"), settings)
    for name in ("table", "kernel", "bias", "weight", "offset"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    x, y = np.concatenate([language_id.cut_windows(t, 12) for t in texts]), np.array([0, 0, 1, 1, 2, 2])
    even = np.ones(3, np.float32)
    mask = (model.kernel != 0).astype(np.float64)

    def loss():
        scores = model.pooled(x) @ model.weight + model.offset
        return -np.mean(scores[np.arange(6), y] - np.log(np.exp(scores).sum(1)))

    slopes = language_id._slopes(model, x, y, even, mask)
    for name, slope in slopes.items():
        value = getattr(model, name)
        for place in [tuple(p) for p in np.argwhere(np.abs(slope) > 1e-4)[:5]]:
            kept = value[place]
            value[place] = kept + 1e-6
            up = loss()
            value[place] = kept - 1e-6
            down = loss()
            value[place] = kept
            assert slope[place] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-7)


@pytest.mark.parametrize("per_row", [1, 2, 3, 5])
def test_windows_cut_by_spark_are_those_of_train(spark, per_row):
    settings = language_id.Settings(window=16, windows_per_row=per_row)
    texts = ["", "a", "é" * 8, "b" * 17, *["".join(chr(97 + (k * k + n) % 26) for k in range(n)) for n in range(30, 400, 13)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").orderBy("k")
    got = rows.select(language_id.spread_windows(F.col("text"), settings).alias("w")).collect()
    for text, row in zip(texts, got):
        windows = language_id.cut_windows(text.encode(), 16)
        take = np.unique(np.linspace(0, len(windows) - 1, per_row).round().astype(int))
        assert np.array_equal(np.concatenate([language_id.cut_windows(bytes(w), 16) for w in row.w]), windows[take])


def test_language_of_odd_tables(odd, odd_pairs, none, by_id):
    small = language_id.Settings(per_label=20, rounds=2)
    model = language_id.fit(odd, small)
    got = language_id.predict(odd, model).collect()
    assert len(got) == len(odd_pairs)
    silent = {i for i, t in odd_pairs if not re.search(r"[^\W\d_]", t or "")}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == silent and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert language_id.fit(none) is None and language_id.predict(none, model).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}
    with_letters = sum(bool(re.search(r"[^\W\d_]", t or "")) for _, t in odd_pairs)
    assert language_id.accepted(odd, None).count() == with_letters
    assert language_id.accepted(odd, model, 0.0).columns == odd.columns


def test_whole_text_is_read():
    """Words of another language at the far end change the outcome."""
    settings = language_id.Settings(rounds=15, per_label=60)
    model = language_id.train([b"aaa bbb aab " * 20] * 40 + [b"xyz zyx yyx " * 20] * 40, ["a"] * 40 + ["x"] * 40, settings)
    a, ax = language_id._means(model, [b"aaa bbb aab " * 100, b"aaa bbb aab " * 100 + b"xyz zyx yyx " * 900])
    assert a[0] > 0.9 and ax[1] > 0.8


QUESTION = "A train with Alice travels 60 km in 2 hours and then Alice walks 5 km more to reach the old town by noon."
ITEMS = [(7, QUESTION), (8, "short one"), (20, "three short words"), (9, None), (10, ""), (11, "never seen words stand here in this very text of ours"),
         (12, "3 4 5 6 7 8 9 10 11 12 13 14 15 16"), (None, "another plain item that has enough words to be found at all")]


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_contamination(spark, by_id, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", limit)
    changed = QUESTION.replace("Alice", "Bob").replace("60", "75").replace(" 2 ", " 3 ").replace("5 km", "9 miles")
    docs = [
        (1, "Intro words. " + QUESTION + " And more."), (2, changed), (3, changed.replace("Bob walks", "Carl walks")),
        (4, None), (5, ""), (None, changed.upper().replace("BOB", "Bob")), (6, QUESTION.replace("60 km", "60km")),
        (13, "What is short here? one"), (14, "short one."), (15, "A train with Alice travels 60 km elsewhere entirely, far from it all."),
        (16, "20 21 22 23 24 25 26 27 28 29 30 31 32 33 34 35"), (17, "x another plain item that has enough words to be found at all"),
        (19, QUESTION.title()), (20, "So: three SHORT words."), (21, QUESTION.replace("Alice", "Ann", 1)),
        (22, QUESTION.replace("60", "4").replace(" 2 ", " 4 ").replace("5 km", "9 km")), (23, re.sub("[.,]", "", QUESTION).upper()),
        (2, changed), (18, "the same words with Alice in 7 hours but nothing else of the question at all, as clean text has"),
    ]
    rows = spark.createDataFrame([(*r, 1, 2, "s") for r in docs], "doc_id long, text string, at int, h int, slots string")
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, h int")
    got = decontamination.contaminations(rows, items).collect()
    found = {(r.doc_id, r.item_id): r for r in got}
    assert len(got) == len(found)
    assert set(found) == {(1, 7), (2, 7), (3, 7), (6, 7), (17, None), (None, 7), (19, 7), (20, 20), (21, 7), (22, 7), (23, 7)}
    assert found[19, 7].share == found[23, 7].share == 1 and found[3, 7].share < found[2, 7].share
    assert found[1, 7].share == 1 and found[1, 7].changed == 0 and found[2, 7].changed == found[2, 7].n_slots - 1 > 3
    assert decontamination.contaminations(rows.where("false"), items).count() == 0
    assert decontamination.contaminations(rows, items.where("false")).count() == 0


def test_contamination_of_real_rows(spark):
    """Verbatim items are found in whole texts, and nothing else."""
    folder = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminations(docs, items).collect()}
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    texts = {r.doc_id: f" {plain(r.text)} " for r in docs.collect()}
    want = {(i, r.item_id) for r in items.collect() for i, t in texts.items() if f" {plain(r.text)} " in t}
    assert want and want <= got
    for i, k in got - want:  # the rest hold most of the item
        words = plain(next(r.text for r in items.collect() if r.item_id == k)).split()
        runs = [" ".join(words[j : j + 6]) for j in range(len(words) - 5)]
        assert sum(r in texts[i] for r in runs) >= 0.5 * len(runs)


def test_template_kinds():
    tokens = decontamination.Tokens()
    template = decontamination.Template("Then Bob ran 5km, paid $7.50 (20%) to Ann-Marie.\nNext two days -- he\tleft 3rd".encode(), tokens)
    L, N, A, U = decontamination.LITERAL, decontamination.NUMBER, decontamination.NAME, decontamination.UNIT
    assert template.kinds.tolist() == [L, A, L, N, U, L, N, N, U, L, A, L, N, U, L, L, L]
    assert template.slots(0, 17) == ["2bob", "15", "3km", "17.50", "120", "3%", "2ann-marie", "1two", "3days"]
