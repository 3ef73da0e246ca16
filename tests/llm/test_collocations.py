"""Collocations against plain counting, with containers that burst and tries that spill."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidegrid.llm import collocations, phrase_trie
from tidegrid.llm.queries import _op11_sql

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, covered, limit):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for p in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[p : p + k])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = Counter()
        for phrase, a in candidates.items():
            for m in range(2, len(phrase)):
                for p in range(len(phrase) - m + 1):
                    around[phrase[p : p + m]] = max(around[phrase[p : p + m]], a)
        for phrase, a in candidates.items():
            if around[phrase] and 100 * around[phrase] >= covered * a:
                continue
            score, _, l, r = min((2_000_000 * a // (f[phrase[:k]] + f[phrase[k:]]), k, f[phrase[:k]], f[phrase[k:]])
                                 for k in range(1, len(phrase)))
            found.append((-score, -a, " ".join(phrase).encode(), a, l, r, score))
        for rank, (_, _, phrase, a, l, r, score) in enumerate(sorted(found)[:limit], 1):
            out.append((lang, rank, phrase.decode(), a, l, r, total[lang], score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least, limit, options", [
    (2, 10_000, {}),
    (2, 25, {"max_paths": 300, "max_words": 1_000}),
    (3, 10_000, {"max_paths": 50, "max_words": 40, "part_bytes": 2_000}),
])
def test_odd_rows(spark, odd, odd_pairs, monkeypatch, least, limit, options):
    got = rows_of(collocations.collocations(odd, min_count=least, limit=limit, **options))
    rows = [([None, "en", "fr"][k % 3], text) for k, (_, text) in enumerate(odd_pairs)]
    assert got == brute(rows, least, 80, limit)
    assert len(got) > 30


def test_pieces_and_overlaps(spark):
    text = "a a a a. B\tb\x0bb B! ä ä ä ä; x\x1cy x\x1cy\rend"
    rows = [("en", text)] * 3 + [(None, text), ("", text.upper())]
    got = rows_of(collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), min_count=1))
    assert got == brute(rows, 1, 80, 2000)
    assert {r[0] for r in got} == {"en", "und", ""}


def test_nothing(spark, none):
    assert collocations.collocations(none).count() == 0
    empty = spark.createDataFrame([("en", None), (None, ""), ("fr", " .,\t")], "lang string, text string")
    assert collocations.collocations(empty, min_count=1).count() == 0


def test_long_text_and_a_hot_pair(spark):
    long = " ".join(f"of the w{k % 977} v{k % 31}" for k in range(60_000))
    rows = [("en", long), ("en", "of the. " * 5_000)]
    got = rows_of(collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), max_paths=20_000))
    assert got == brute(rows, 30, 80, 2000)


def test_containers_burst_and_runs_merge(monkeypatch):
    monkeypatch.setattr(phrase_trie, "BURST", 3)
    all_bits = phrase_trie.Filter(8, b"\xff" * 64)
    trie, plain = phrase_trie.PhraseTrie(b"\xff", 7, all_bits), Counter()
    merged: dict[int, phrase_trie.Merger] = {}
    for step in range(6):
        words = [b"w%d" % ((k * k + step) % 11) for k in range(200)] + [b"\xff"]
        trie.add(words, len(words))
        for k in range(1, 5):
            plain.update(tuple(words[p : p + k]) for p in range(201 - k))
        assert trie.burst and trie.count_paths() == sum(map(trie._size, range(1, len(trie.tops))))
        for part, run in trie.spill(20 * step + 1, 5):
            merged.setdefault(part, phrase_trie.Merger(limit=10)).add(run)
    for part, run in trie.spill_all(5):
        merged.setdefault(part, phrase_trie.Merger(limit=10)).add(run)
    total, seen = 0, Counter()
    for merger in merged.values():
        phrases, sizes, counts = merger.frequent(1)
        total += sum(c for c, n in zip(counts.tolist(), sizes.tolist()) if n == 1)
        assert [len(p.split()) for p in phrases] == sizes.tolist()
        for phrase, count in zip(phrases, counts.tolist()):
            assert phrase not in seen  # each sequence is counted in one part
            seen[phrase] = count
    assert total == 1_200
    assert seen == Counter({b" ".join(p).decode(): c for p, c in plain.items()})


def test_counters_never_fall_below_counts():
    seen = phrase_trie.Seen(10)
    words = [b"w%d" % (k * k % 97) for k in range(4_000)]
    hashes = np.array([phrase_trie.word_hash(w, 3) for w in words], np.uint64)
    hashes[::50] = 0
    for at in range(0, len(words), 999):
        seen.add(hashes[at : at + 1_000], 999)
    pairs = phrase_trie.pair_hashes(hashes)[(hashes[:-1] > 0) & (hashes[1:] > 0)]
    for least in (1, 20, 60):
        bits = np.packbits(seen.tables >= least, axis=1).tobytes()
        known = phrase_trie.Filter(10, bits)
        assert all(known.word(h) for h, n in Counter(hashes[hashes > 0].tolist()).items() if n >= least)
        found = np.array([h for h, n in Counter(pairs.tolist()).items() if n >= least], np.uint64)
        assert known.pair(found).all()
    assert not all(known.word(h) for h in set(hashes.tolist()))
    assert int(seen.tables[0].sum()) == int((hashes > 0).sum()) and int(seen.tables[1].sum()) == len(pairs)


def test_sql_of_the_query(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(con.execute(_op11_sql(4, 150)).fetchall())
    got = rows_of(collocations.collocations(documents, min_count=4, limit=150))
    assert got == want and len(got) > 200
