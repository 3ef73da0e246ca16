"""SimHash near-dedup by a binary trie self-join.

A fingerprint has a bit for each of the 64 bits that more than half of a text's
shingle hashes have. Equal fingerprints are one from the start. To find all pairs
within ``max_bits`` differing bits, the 64 bits are cut into ``max_bits + 2``
segments; within the budget, two segments at least agree. So for each pair of
segments the fingerprints are dealt out by the bits of these two, and each such
group is a trie over the remaining bits. The trie is joined with itself: pairs of
nodes go down together, a pair that parts at a bit adds one to its differences,
and is pruned when these exceed the budget. All tries of a task are walked level
by level at once, in slices of bounded size.

A task emits no pairs but, by union-find over them, one link from each fingerprint
to the smallest that it reaches in its group: as many rows as fingerprints, with
the same components. A group larger than ``MAX_GROUP`` is dealt out once more: by
pairs of the next eight bits within the budget, so no task holds all of it.

Links meet in connected components by alternating large and small stars on Spark;
each round is a written table. ``component_id`` is the smallest id reachable.

A null or empty text has fingerprint zero and is linked like any other. Rows of one
id are one document to the components. A null id is the lowest id; a component whose
smallest it is has a null ``component_id``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import encoded, id_out, ids_and_texts, map_texts
from tidegrid.session import write_and_read

#: Fingerprints of one group that a task walks at once; larger groups are dealt out by their next bits.
MAX_GROUP = 100_000
#: Node pairs that are followed down at the same time.
SLICE = 200_000
#: Shingles hashed before their bits are summed.
CHUNK = 65_536
NEXT_BITS = 8


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """Of a whole text in UTF-8."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        cuts = zip(starts[at : at + CHUNK], stops[at : at + CHUNK])
        hashes = np.array([digest(joined[a:b], seed) for a, b in cuts], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    set_bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` (null as the lowest long) and ``fp``, the fingerprint as a signed long, for each row."""

    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [fingerprint(text, shingle, seed) for text in encoded(batch, "text")]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

        return step

    return map_texts(ids_and_texts(docs, id_col, text_col), build, "doc_id long, fp long")


# the trie self-join inside a task


class Tries:
    """Sorted distinct keys (unsigned) of several groups; each group is a binary trie over ``depth`` bits."""

    def __init__(self, keys: np.ndarray, bounds: np.ndarray, depth: int, budget: int):
        self.keys, self.bounds, self.depth, self.budget = keys, bounds, depth, budget

    def _split(self, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
        """Where the keys of a node, [low, high), turn to 1 at ``bit``; they agree in all bits above."""
        ones = self._ones[bit]
        return high - (ones[high] - ones[low])

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of all pairs of different keys of a group that differ in few enough bits."""
        self._ones = {
            bit: np.r_[0, np.cumsum((self.keys >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)] for bit in range(self.depth)
        }
        low, high = self.bounds[:-1], self.bounds[1:]
        wide = high - low > 1
        low, high = low[wide], high[wide]
        stack = [(self.depth - 1, low, high, low, high, np.zeros(len(low), dtype=np.int8))]
        while stack:
            bit, a, b, c, d, diff = stack.pop()
            if len(a) > SLICE:
                half = len(a) // 2
                stack.append((bit, a[half:], b[half:], c[half:], d[half:], diff[half:]))
                a, b, c, d, diff = a[:half], b[:half], c[:half], d[:half], diff[:half]
                stack.append((bit, a, b, c, d, diff))
                continue
            if bit < 0:
                other = a != c
                yield a[other], c[other]
                continue
            m, n = self._split(a, b, bit), self._split(c, d, bit)
            same = a == c
            parts = [
                (a, m, c, n, diff), (m, b, n, d, diff), (a, m, n, d, diff + 1),
                tuple(x[~same] for x in (m, b, c, n, diff + 1)),
            ]
            a, b, c, d, diff = (np.concatenate(x) for x in zip(*parts))
            # a pair of a node with itself needs two keys, every other one key on both sides
            alive = (b > a) & (d > c) & (diff <= self.budget) & ((a != c) | (b - a > 1))
            if alive.any():
                stack.append((bit - 1, a[alive], b[alive], c[alive], d[alive], diff[alive]))


class Unions:
    """Union-find over numbers; the root is the smallest."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
            np.minimum.at(self.up, a, b)

    def roots(self, x: np.ndarray) -> np.ndarray:
        up = self.up[x]
        while True:
            further = self.up[up]
            if (further == up).all():
                return up
            up = further


def _links(keys: np.ndarray, fps: np.ndarray, groups: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by group and key: links from fingerprints to the first one they reach."""
    bounds = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True])
    unions = Unions(len(keys))
    for a, b in Tries(keys, bounds, depth, budget).pairs():
        unions.join(a, b)
    root = unions.roots(np.arange(len(keys)))
    moved = root != np.arange(len(keys))
    return fps[moved], fps[root[moved]]


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the ``max_bits + 2`` segments of 64 bits."""
    n = max_bits + 2
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _bits(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def _rotations(max_bits: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    return list(combinations(segments(max_bits), 2))


def _order(max_bits: int) -> list[list[int]]:
    """For each rotation the bits that its tries go over, from the root."""
    out = []
    for chosen in _rotations(max_bits):
        taken = {b for start, width in chosen for b in range(start, start + width)}
        out.append([b for b in range(63, -1, -1) if b not in taken])
    return out


def _trie_keys(fps: np.ndarray, order: list[int]) -> np.ndarray:
    """The bits of ``order`` from high to low, packed into the low end of a key."""
    fps = fps.view(np.uint64)
    keys = np.zeros(len(fps), dtype=np.uint64)
    for bit in order:
        keys = (keys << np.uint64(1)) | ((fps >> np.uint64(bit)) & np.uint64(1))
    return keys


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """``a`` and ``b`` of links that hold the fingerprints (column ``fp``, distinct) together."""
    if not 0 <= max_bits <= 14:
        raise ValueError("max_bits must be from 0 to 14")
    if max_bits == 0:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    orders = _order(max_bits)
    rotated = [
        F.struct(F.lit(r).alias("turn"), _group_key(chosen).alias("key")) for r, chosen in enumerate(_rotations(max_bits))
    ]
    dealt = distinct.select("fp", F.explode(F.array(*rotated)).alias("_r")).select("fp", "_r.turn", "_r.key")
    sizes = dealt.groupBy("turn", "key").agg(F.count(F.lit(1)).alias("_n")).where(f"_n > {MAX_GROUP}")
    marked = dealt.join(sizes, ["turn", "key"], "left")
    # a large group once more: each fingerprint to all pairs of nodes, eight bits down, that the budget allows
    near = [m for m in range(1 << NEXT_BITS) if bin(m).count("1") <= max_bits]
    own = F.element_at(F.array(*[_node(order) for order in orders]), F.col("turn") + 1)
    pairs = F.transform(
        F.array(*map(F.lit, near)),
        lambda m: F.least(own, own.bitwiseXOR(m.cast("long"))) * F.lit(1 << NEXT_BITS) + F.greatest(own, own.bitwiseXOR(m.cast("long"))) + 1,
    )
    nodes = F.when(F.col("_n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)
    rows = marked.select("turn", "key", F.explode(nodes).alias("node"), "fp")
    grouped = rows.repartition("turn", "key", "node").sortWithinPartitions("turn", "key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of groups that may go on, turn, key, node, fp

        def walk(rows: np.ndarray):
            for turn in np.unique(rows[:, 0]).tolist():
                own = rows[rows[:, 0] == turn]
                fps = own[:, 3].copy()
                change = np.r_[False, (own[1:, :3] != own[:-1, :3]).any(1)]
                groups, keys = np.cumsum(change), _trie_keys(fps, orders[turn])
                order = np.lexsort((keys, groups))
                a, b = _links(keys[order], fps[order], groups[order], len(orders[turn]), max_bits)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(c).to_numpy() for c in ("turn", "key", "node", "fp")], 1).astype(np.int64))
            if sum(map(len, held)) < SLICE:
                continue
            rows = np.concatenate(held)
            last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(1))
            whole = last[-1] + 1 if len(last) else 0
            if whole:
                yield from walk(rows[:whole])
            held = [rows[whole:]]
        if held:
            yield from walk(np.concatenate(held))

    return grouped.mapInArrow(run, "a long, b long")


def _group_key(chosen) -> Column:
    (one, width), (two, other) = chosen
    return F.shiftleft(_bits(F.col("fp"), one, width), other) + _bits(F.col("fp"), two, other)


def _node(order: list[int]) -> Column:
    """The first bits that a trie goes over, as a number."""
    number = F.lit(0).cast("long")
    for bit in order[:NEXT_BITS]:
        number = number * 2 + _bits(F.col("fp"), bit, 1)
    return number


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node`` and ``root``, its smallest reachable node, for each node of ``edges`` (a, b).

    Large star: neighbours above a node go to its smallest neighbour. Small star: a
    node and those below go to the smallest below. Rounds are repeated until the
    edges are those of the round before; their number grows with the logarithm.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    edges = write_and_read(edges, label)
    seen = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("_m").alias("b")), F.struct(F.col("a"), F.col("_m").alias("b"))
        )).alias("_e")).select("_e.a", "_e.b").where("a != b").distinct()
        edges = write_and_read(small, label)
        # as many edges with the same sum of hashes: nothing has moved
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    root = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return root.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(
    docs: DataFrame, shingle: int = 3, max_bits: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` of each row."""
    prints = write_and_read(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("_first"))
    # an id with several rows may have several fingerprints; its rows are one document
    lead = prints.groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("_top")).where("b != _top")
    same_id = prints.join(lead, "doc_id").select(F.col("fp").alias("a"), "b")
    found = components(links(first.select("fp"), max_bits).union(same_id), "components")
    grouped = first.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "_first", F.coalesce("root", "fp").alias("root")
    )
    smallest = grouped.groupBy("root").agg(F.min("_first").alias("component_id"))
    per_fp = grouped.join(smallest, "root").select("fp", "component_id")
    rows = prints.join(per_fp, "fp")
    return rows.select(
        id_out(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), id_out("component_id")
    )
