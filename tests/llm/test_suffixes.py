"""Suffix dedup against a plain dictionary of windows, and its sort against plain grouping."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tidegrid.llm import multikey, suffix_dedup
from tidegrid.llm.queries import QUERIES

LOWEST = -(1 << 63)


def brute(rows, window):
    """Rows of one id are texts of their own, of which neither is earlier; equal rows are one."""
    texts = {(LOWEST if i is None else i, (t or "").encode()) for i, t in rows}
    smallest, own = {}, defaultdict(dict)
    for doc, text in texts:
        for p in range(len(text) - window + 1):
            gram = text[p : p + window]
            smallest[gram] = min(smallest.get(gram, doc), doc)
            own[doc, text].setdefault(gram, p)
    out = []
    for i, t in rows:
        doc, text = LOWEST if i is None else i, (t or "").encode()
        gone = [False] * len(text)
        for p in range(len(text) - window + 1):
            gram = text[p : p + window]
            if smallest[gram] < doc or own[doc, text][gram] < p:
                gone[p : p + window] = [True] * window
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(text), sum(gone), spans, kept))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("window, lead, bucket", [(100, 24, 1 << 20), (100, 24, 300), (30, 7, 1_000), (12, 12, 50)])
def test_odd_rows(spark, odd, odd_pairs, window, lead, bucket):
    got = result(suffix_dedup.dedup_bytes(odd, window=window, lead=lead, bucket_bytes=bucket))
    assert got == brute(odd_pairs, window)


def copies():
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefg é\n") for _ in range(230))
    rows = []
    for k in range(120):
        noise = "".join(rng.choice("hijklmno ") for _ in range(rng.randint(0, 150)))
        rows.append((k, noise + passage[rng.randint(0, 60) : rng.randint(150, 230)] + noise[::-1]))
    rows += [(500 + k, rows[0][1]) for k in range(150)]
    rows += [(None, rows[k % 3][1] + str(k)) for k in range(20)] + [(7, passage + str(k)) for k in range(5)]
    rows += [(900, "ab" * 3_000), (901, "ba" * 50), (902, "x" * 1_000 + "y"), (3, "ab" * 80)] * 2
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bucket", [400, 1 << 20])
def test_a_passage_and_a_text_that_fill_the_table(spark, bucket):
    rows = copies()
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(suffix_dedup.dedup_bytes(table, bucket_bytes=bucket)) == brute(rows, 100)


def test_many_rows_of_null_and_one_id(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcd ") for _ in range(140)) for _ in range(9)]
    rows = [(rng.choice([None, None, 4, k]), base[rng.randint(0, 8)][rng.randint(0, 9) :] + str(rng.randint(0, 30))) for k in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(suffix_dedup.dedup_bytes(table, bucket_bytes=5_000)) == brute(rows, 100)


def test_nothing(spark, none):
    assert suffix_dedup.dedup_bytes(none).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.dedup_bytes(none, window=10, lead=11)


def test_query(spark, folder):
    got = QUERIES["op12_suffix_dedup"](spark, folder).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in brute(rows, 100)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("length", [1, 3, 8, 13, 16, 100])
def test_equal_groups(length):
    rng = random.Random(length)
    data = bytes(rng.choice(b"ab\xff\x00") for _ in range(2_000)) + b"abcabc" * 150
    starts = [rng.randrange(len(data) - length + 1) for _ in range(1_500)]
    items, groups = multikey.equal_groups(np.frombuffer(data, np.uint8), np.array(starts), length)
    plain, got = defaultdict(list), defaultdict(list)
    for k, s in enumerate(starts):
        plain[data[s : s + length]].append(k)
    for k, g in zip(items.tolist(), groups.tolist()):
        got[g].append(k)
    assert sorted(map(sorted, got.values())) == sorted(v for v in plain.values() if len(v) > 1)
    assert np.array_equal(groups, np.sort(groups))
    assert len(multikey.equal_groups(np.zeros(0, np.uint8), np.zeros(0, np.int64), length)[0]) == 0


def test_packed_texts_are_shuffled_once(odd, capsys):
    done = suffix_dedup.dedup_bytes(odd, 20, 5)
    done.explain()
    plan = capsys.readouterr().out.splitlines()
    packed = [k for k, line in enumerate(plan) if "hashpartitioning(doc_id" in line and "REPARTITION_BY_COL" in line]
    filters = [" ".join(plan[k + 1].split("Filter")[1:]) for k in packed if "Filter" in plan[k + 1]]
    # both joins need the same rows below the exchange, or it cannot be one
    assert len(packed) == len(filters) == 2
