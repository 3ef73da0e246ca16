"""Cuckoo filters and line dedup against brute force."""

import numpy as np
import pytest

from tidegrid.llm.cuckoo import CuckooFilter
from tidegrid.llm.line_dedup import BLANKS, LineIndex, dedup_lines
from tidegrid.session import scratch_path


def keys(n, seed):
    pairs = np.random.default_rng(seed).integers(-(2**63), 2**63 - 1, (n, 2))
    return pairs[:, 0].copy(), pairs[:, 1].copy()


@pytest.mark.parametrize("expected", [0, 100, 20_000])
def test_cuckoo_filter(expected):
    held, a, b, c = CuckooFilter(expected), keys(9_000, 1), keys(9_000, 2), keys(20_000, 3)
    for k in range(0, 9_000, 1_500):
        held.add(a[0][k : k + 1_500], a[1][k : k + 1_500])
    held.add(*b)
    held = CuckooFilter.from_bytes(held.to_bytes())
    assert held.contains(*a).all() and held.contains(*b).all() and held.contains(*c).mean() < 0.02
    held.remove(*a)
    assert held.contains(*b).all() and held.contains(*a).mean() < 0.02
    held.remove(*b)
    assert all((layer == 0).all() for layer in held.layers) and held.held == [0] * len(held.layers)


def test_filter_that_began_small():
    """A few keys, then many: few layers, few false positives; then one key at a time."""
    held, few, many, others = CuckooFilter(), keys(10, 1), keys(100_000, 2), keys(50_000, 3)
    held.add(*few)
    held.add(*many)
    assert len(held.layers) <= 4 and held.contains(*few).all() and held.contains(*many).all()
    assert held.contains(*others).mean() < 0.002
    single, one = CuckooFilter(), keys(3_000, 4)
    for k in range(3_000):
        single.add(one[0][k : k + 1], one[1][k : k + 1])
    assert len(single.layers) <= 14 and single.contains(*one).all()


def test_removal_across_layers_of_different_size():
    """Many keys of few marks and buckets, so that layers hold marks that other keys could have left."""
    rng = np.random.default_rng(5)
    pool = rng.permutation(1 << 16)
    k1, k2 = (pool % 512).astype(np.int64) << 20, ((pool // 512).astype(np.int64) + 1) << 48
    held, live = CuckooFilter(), np.zeros(len(pool), dtype=bool)
    for turn in range(30):
        idle, busy = np.flatnonzero(~live), np.flatnonzero(live)
        new = rng.choice(idle, int(rng.integers(1, 1500)), replace=False)
        held.add(k1[new], k2[new])
        live[new] = True
        old = rng.choice(busy, len(busy) // 3, replace=False)
        held.remove(k1[old], k2[old])
        live[old] = False
        assert held.contains(k1[live], k2[live]).all()
        assert sum(held.held) == live.sum()


def key(line):
    stripped = line.strip(BLANKS)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in stripped) if len(stripped) >= 10 else None


def low(i):
    return -(1 << 63) if i is None else i


def brute(pairs, index=None):
    """(id, kept text, lines, dropped) of each row, for the documents of ``index``."""
    holders = {}
    for i, text in pairs if index is None else index:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(low(i))
    out = []
    for i, text in pairs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == low(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_dedup(spark, odd, odd_pairs, by_id):
    got = dedup_lines(odd, scratch_path(spark, "t"), carry=("lang", "k1"))
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped", "carried"]
    assert by_id(got.drop("carried").collect()) == by_id(brute(odd_pairs))
    assert sum(r[3] for r in brute(odd_pairs)) > 10


def test_insert_delete_and_insert_again(spark, odd, odd_pairs, by_id):
    index = LineIndex.create(spark, scratch_path(spark, "t"), 100)
    part = odd.where("doc_id < 112 OR doc_id IS NULL")
    index.insert(part)
    index.insert(odd.where("doc_id >= 112"))
    before = by_id(index.counts().drop("shard").collect())
    index.delete(spark.createDataFrame([(i,) for i in (None, 5, 100, 112, 120, 140, 999)], "doc_id long"))
    left = [(i, t) for i, t in odd_pairs if i not in (None, 5, 100, 112, 120, 140)]
    rest = odd.where("doc_id NOT IN (5, 100, 112, 120, 140)")
    assert by_id(index.dedup(rest).collect()) == by_id(brute(left))
    index = LineIndex.open(spark, index.path)
    index.insert(odd.where("doc_id IS NULL OR doc_id IN (5, 100, 112, 120, 140)"))
    assert by_id(index.counts().drop("shard").collect()) == before
    assert by_id(index.dedup(odd).collect()) == by_id(brute(odd_pairs))


@pytest.mark.parametrize("dies", ["counts", "filters", "mark"])
def test_changes_that_die_half_way_can_be_repeated(spark, odd, odd_pairs, by_id, monkeypatch, dies):
    index = LineIndex.create(spark, scratch_path(spark, "t"), 100)
    index.insert(odd.where("doc_id < 112 OR doc_id IS NULL"))
    before = by_id(index.counts().collect())
    write, mark = LineIndex._write, LineIndex._mark

    def broken_write(self, gen, **tables):
        if dies in tables:
            raise OSError("lost")
        write(self, gen, **tables)

    def broken_mark(self, gen):
        raise OSError("lost")

    def dying(change):
        with monkeypatch.context() as patch:
            patch.setattr(LineIndex, "_mark" if dies == "mark" else "_write", broken_mark if dies == "mark" else broken_write)
            with pytest.raises(OSError):
                change()

    dying(lambda: index.insert(odd.where("doc_id >= 112")))
    assert by_id(index.counts().collect()) == before
    # another change than the one that died takes its place
    dying(lambda: index.delete(odd.where("doc_id = 5").select("doc_id")))
    assert by_id(index.counts().collect()) == before
    index.insert(odd.where("doc_id >= 112"))
    assert by_id(index.dedup(odd).collect()) == by_id(brute(odd_pairs))


def test_an_id_inserted_again_is_one_document(spark, by_id):
    index = LineIndex.create(spark, scratch_path(spark, "t"), 10)
    rows = [(1, "one shared line here\nonly in the first"), (1, "one shared line here"), (2, "another line of two")]
    for row in rows:
        index.insert(spark.createDataFrame([row], "doc_id long, text string"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(index.dedup(docs).collect()) == by_id(brute(rows))
    index.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert [r.refs for r in index.counts().collect()] == [1]


def test_filters_follow_the_exact_table(spark, odd):
    index = LineIndex.create(spark, scratch_path(spark, "t"), 100)
    index.insert(odd)
    index.delete(odd.where("doc_id > 15 OR doc_id IS NULL").select("doc_id"))
    counts = index.counts().collect()
    held = {(r.shard, r.name): CuckooFilter.from_bytes(bytes(r.filter)) for r in index._filters().collect()}
    assert sum(sum(f.held) for (_, n), f in held.items() if n == "seen") == len(counts) > 0
    for r in counts:
        one = np.array([r.k1]), np.array([r.k2])
        assert held[r.shard, "seen"].contains(*one)[0]
        assert held[r.shard, "repeated"].contains(*one)[0] or r.first == r.last


def test_empty(spark, none):
    assert dedup_lines(none, scratch_path(spark, "t")).count() == 0
