"""SimHash and substring dedup against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidegrid.llm import simhash, substring_dedup

BLANK = r"[^\x20\x09-\x0D]+"


def low(i):
    return -(1 << 63) if i is None else i


def fingerprint(text):
    words = re.findall(BLANK.encode(), (text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), seed=42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, near):
    up = list(range(len(values)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if near(values[a], values[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(values))]


def test_near_duplicates(odd, odd_pairs, by_id):
    got = simhash.near_duplicates(odd)
    prints = [fingerprint(t) for _, t in odd_pairs]
    rows = list(zip((low(i) for i, _ in odd_pairs), prints))
    root = roots(rows, lambda a, b: a[0] == b[0] or bin(a[1] ^ b[1]).count("1") <= 2)
    least = {r: min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in root}
    out = lambda i: None if i == low(None) else i
    want = [(i, f"{f:016x}", out(least[r])) for (i, _), f, r in zip(odd_pairs, prints, root)]
    assert by_id(got.collect()) == by_id(want)


def clusters(n, seed=1):
    """Fingerprints in clusters: a dense one, chains and lone ones, with negative numbers."""
    rng = random.Random(seed)
    out = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(n // 12):
            if rng.random() < 0.5:
                center ^= 1 << rng.randrange(64)
            out.add(center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    out |= {rng.getrandbits(64) for _ in range(n // 3)} | {0, (1 << 64) - 1, 1 << 63}
    return sorted(x - (1 << 64) if x >> 63 else x for x in out)


@pytest.mark.parametrize("max_bits", [1, 2, 3])
def test_links_find_all_components(spark, max_bits, monkeypatch):
    for group in (100_000, 3):
        monkeypatch.setattr(simhash, "MAX_GROUP", group)
        monkeypatch.setattr(simhash, "SLICE", 50 if group == 3 else 200_000)
        found = clusters(240, max_bits)
        edges = simhash.links(spark.createDataFrame([(x,) for x in found], "fp long"), max_bits)
        got = {r.node: r.root for r in simhash.components(edges).collect()}
        mask = (1 << 64) - 1
        root = roots(found, lambda a, b: bin((a ^ b) & mask).count("1") <= max_bits)
        assert [got.get(x, x) for x in found] == [found[r] for r in root]


def test_one_link_per_fingerprint_and_group(spark):
    """A dense group gives no pairs, but as many rows as it has fingerprints."""
    rows = spark.range(1 << 9).withColumn("fp", F.col("id"))
    assert simhash.links(rows.select("fp")).count() <= 6 * (1 << 9)


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(k, 0) for k in range(61)}


def brute_windows(pairs, window):
    words = [re.findall(BLANK, t or "") for _, t in pairs]
    first = {}
    for (i, _), w in zip(pairs, words):
        for k in range(len(w) - window + 1):
            gram = tuple(w[k : k + window])
            first[gram] = min(first.get(gram, low(i)), low(i))
    out = []
    for (i, _), w in zip(pairs, words):
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < low(i) for j in range(window)}
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return out


@pytest.mark.parametrize("window,anchor", [(50, 8), (12, 4), (3, 3)])
def test_substrings(odd, odd_pairs, by_id, window, anchor):
    rows = substring_dedup.dedup_substrings(odd, window, anchor).collect()
    want = brute_windows(odd_pairs, window)
    assert by_id(r[:4] for r in rows) == by_id(want) and sum(w[3] for w in want) > 100
    for r in rows:
        assert all(f.length >= window and low(f.ref_doc) < low(r.doc_id) for f in r.factors)
        spans = [(f.start, f.start + f.length) for f in r.factors]
        assert len({k for a, b in spans for k in range(a, b)}) == r.n_removed


def test_many_rows_of_one_id(spark):
    """Null ids and one id with thousands of different texts, each parsed for itself."""
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(70)) for _ in range(40)]
    rows = []
    for k in range(6_000):
        text = base[rng.randrange(40)].split()
        rows.append((rng.choice([None, None, 5, k]), " ".join(text[rng.randrange(15) :]) + f" end {k % 900}"))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup.dedup_substrings(table).collect()
    want = brute_windows(rows, 50)
    assert sorted(map(repr, ((r.doc_id, r.text, r.n_words, r.n_removed) for r in got))) == sorted(map(repr, want))


def test_copies_of_one_id_list_blocks_and_spans_once(spark, monkeypatch):
    """However many rows have one id and text, each gets the lists of one: work grows with the rows, not their square."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10_000)}" for _ in range(160)]
    rows = [(1, " ".join(["a", *base[:100]]))] + [(2, " ".join([*base[:90], *"bcde"]))] * 30 + [(None, " ".join([*base[:70], "f"]))] * 20
    listed = {}

    def spy(name, column):
        real = getattr(substring_dedup, name)

        def wrapped(table, *args):
            listed[column] = [len(r[0]) - len(set(r[0])) for r in table.select(column).where(f"{column} IS NOT NULL").collect()]
            return real(table, *args)

        monkeypatch.setattr(substring_dedup, name, wrapped)

    spy("_requested_windows", "places")
    spy("_parse", "spans")
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup.dedup_substrings(table).collect()
    assert sorted(map(repr, ((r.doc_id, r.text, r.n_words, r.n_removed) for r in got))) == sorted(map(repr, brute_windows(rows, 50)))
    assert len(listed["places"]) >= 20 and len(listed["spans"]) == 31 and not any(listed["places"] + listed["spans"])


def test_factor_reference_holds_the_words(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10_000)}" for _ in range(400)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, "x y " + " ".join(base[100:300]) + " z")], "doc_id long, text string")
    rows = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs).collect()}
    assert [tuple(f) for f in rows[2].factors] == [(2, 200, 1, 100)] and rows[2].text == "x y z" and rows[1].n_removed == 0


def test_empty(none):
    assert simhash.near_duplicates(none).count() == 0
    assert substring_dedup.dedup_substrings(none).count() == 0


def test_window_minimum():
    x = np.random.default_rng(0).integers(0, 1000, 200).astype(np.uint64)
    for width in (1, 2, 3, 41, 43):
        assert (substring_dedup._window_minimum(x, width) == [x[k : k + width].min() for k in range(200 - width + 1)]).all()
