"""Substring dedup by parsing documents relative to an index of reference blocks.

The smallest reference is a window of ``window`` words. Each window has an anchor,
the smallest hash of its runs of ``anchor`` words, and windows next to each other
with one anchor are a block. Blocks hang on content alone: where two documents share
a passage, they have the same blocks inside it and blocks with the same anchors at
its ends. The index holds each block once, with the smallest document that has it.

A document is parsed by its blocks in turn. A block that a smaller document has is
copied whole; consecutive copies go on as one factor as long as they follow each
other in their reference, which makes the parse greedy. At the boundaries of
factors lie blocks of which the index has the anchor but other content. There each
window is compared with those of all blocks of that anchor, so a factor is extended
to the last window that any smaller document has. All words under a factor (which is
a window long at least) are duplicates; the rest are literals.

Comparisons are by 64-bit hashes within one anchor, for single windows by 128 bits.
An anchor that many documents share is pre-aggregated before the shuffle, and joins
on such keys are between plain exchanges, of which adaptive execution splits large
partitions. Texts are shuffled once, packed, by id.

A null or empty text has no words. A null id is the lowest id. Rows of one id are
parsed each for itself, and only documents with smaller ids count as references.
Rows of one id and text share their blocks and spans, which are listed once for all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import Recent, encoded, id_out, ids_and_texts, map_texts
from tidegrid.session import write_and_read

#: Longest run of windows in one block (texts that repeat themselves have long runs of one anchor).
MAX_RUN = 64
CACHED_WORDS = 200_000
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_RUN_BITS = 8


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """Word hashes and hashes of word ranges; powers of the bases grow with the longest text."""

    def __init__(self):
        self.known = Recent(xxhash.xxh3_64_intdigest, CACHED_WORDS)
        self.powers = {base: np.ones(1, np.uint64) for base in (_ONE, _TWO, _inverse(_ONE), _inverse(_TWO))}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))

    def _power(self, base: np.uint64, n: int) -> np.ndarray:
        if len(self.powers[base]) < n:
            steps = np.full(max(n, 2 * len(self.powers[base])), base, np.uint64)
            steps[0] = 1
            self.powers[base] = np.multiply.accumulate(steps)
        return self.powers[base][:n]

    def sums(self, hashes: np.ndarray, base: np.uint64) -> np.ndarray:
        out = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self._power(base, len(hashes)), out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, base: np.uint64, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """A hash of the words [start, stop) that hangs on them alone."""
        back = self._power(_inverse(base), len(sums))
        return _mixed((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64))


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def blocks_of(hashes: np.ndarray, words: Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """``anchor``, ``content``, ``start`` and number of windows of each block of a text."""
    n = len(hashes)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    grams = np.zeros(n - anchor + 1, np.uint64)
    for k in range(anchor):
        grams = grams * _TWO + hashes[k : n - anchor + 1 + k]
    lowest = _window_minimum(_mixed(grams), window - anchor + 1)
    first = np.flatnonzero(np.r_[True, lowest[1:] != lowest[:-1]])
    lengths = np.diff(np.r_[first, len(lowest)])
    if lengths.max() > MAX_RUN:
        cuts = [np.arange(a, a + m, MAX_RUN) for a, m in zip(first.tolist(), lengths.tolist())]
        first = np.concatenate(cuts)
        lengths = np.diff(np.r_[first, len(lowest)])
    content = words.ranges(words.sums(hashes, _ONE), _ONE, first, first + lengths + window - 1)
    return lowest[first].view(np.int64), content.view(np.int64), first, lengths


def text_key(text: bytes) -> int:
    """With the id it tells rows apart, also of one id."""
    return xxhash.xxh64_intdigest(text, 42) - (1 << 63)


def blocks(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """``anchor, content, doc_id, key, place`` of every block; ``place`` is its start and number of windows."""

    def build():
        words = Words()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, counts, keys = [], [], []
            for text in encoded(batch, "text"):
                anchors, content, start, n = blocks_of(words.hashes(text.split()), words, window, anchor)
                found.append((anchors, content, start << _RUN_BITS | n))
                counts.append(len(anchors))
                keys.append(text_key(text))
            ids, keys = (np.repeat(x, counts) for x in (batch.column("doc_id").to_numpy(), np.array(keys, np.int64)))
            anchors, content, place = (np.concatenate(x) for x in zip(*found))
            columns = [pa.array(x, pa.int64()) for x in (anchors, content, ids, keys, place)]
            return pa.RecordBatch.from_arrays(columns, ["anchor", "content", "doc_id", "key", "place"])

        return step

    return map_texts(docs, build, "anchor long, content long, doc_id long, key long, place long")


def pack(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` and the compressed ``text``, which halves what a shuffle moves."""

    def build():
        packer = zstandard.ZstdCompressor(level=3)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = encoded(batch, "text")
            keys = [text_key(t) for t in texts]
            packed = [packer.compress(t) for t in texts]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "key", "text"]
            )

        return step

    return map_texts(rows, build, "doc_id long, key long, text binary")


def unpacked_texts(batch: pa.RecordBatch) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x) for x in batch.column("text").to_pylist()]


def _requested_windows(rows: DataFrame, window: int) -> DataFrame:
    """``h1, h2, doc_id, key, start`` of the windows of the blocks that each row (doc_id, key, text) lists."""

    def build():
        words = Words()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out, counts = [], []
            for text, places in zip(unpacked_texts(batch), batch.column("places")):
                hashes = words.hashes(text.split())
                places = places.values.to_numpy()
                start, n = places >> _RUN_BITS, places & ((1 << _RUN_BITS) - 1)
                at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
                one, two = words.sums(hashes, _ONE), words.sums(_mixed(hashes), _TWO)
                out.append((
                    words.ranges(one, _ONE, at, at + window).view(np.int64), words.ranges(two, _TWO, at, at + window).view(np.int64), at,
                ))
                counts.append(len(at))
            h1, h2, at = (np.concatenate(x) for x in zip(*out))
            ids, keys = (np.repeat(batch.column(c).to_numpy(), counts) for c in ("doc_id", "key"))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, ids, keys, at)], ["h1", "h2", "doc_id", "key", "start"])

        return step

    return map_texts(rows, build, "h1 long, h2 long, doc_id long, key long, start long")


def dedup_substrings(
    docs: DataFrame, window: int = 50, anchor: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``text`` (kept words joined by a space), ``n_words``, ``n_removed`` and ``factors`` of each row.

    A factor has ``start`` and ``length`` in words and its reference: ``ref_doc`` and ``ref_start``
    (-1 if the factor has no whole block, as the place of single windows is not kept).
    """
    if not 1 <= anchor <= window:
        raise ValueError("an anchor is a part of a window")
    rows = ids_and_texts(docs, id_col, text_col)
    index = write_and_read(blocks(rows, window, anchor), "blocks")
    # anchors in two documents at least; the others are of no further interest
    shared = index.groupBy("anchor").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"))
    shared = write_and_read(shared.where("_low != _high").select("anchor"), "shared-anchors")
    parts = write_and_read(index.join(shared, "anchor"), "shared-blocks")

    mixed = parts.groupBy("anchor").agg((F.min("content") != F.max("content")).alias("mixed"))
    first = parts.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "place")).alias("ref")).join(mixed, "anchor")
    first = write_and_read(first, "first-blocks")
    held = parts.join(first, ["anchor", "content"])
    held = write_and_read(held.select(
        "doc_id", "key", "place", "mixed", F.col("ref.doc_id").alias("ref_doc"), F.shiftright("ref.place", _RUN_BITS).alias("ref_start"),
    ), "held-blocks")
    copied = held.where("ref_doc < doc_id").select("doc_id", "key", "place", "ref_doc", "ref_start")
    # sets, here and below: with lists, n rows of one id and text would get n lists each
    wanted = held.where("ref_doc = doc_id AND mixed").groupBy("doc_id", "key").agg(F.collect_set("place").alias("places"))
    # one exchange of the packed texts, used by all joins below
    texts = pack(rows).repartition("doc_id", "key")
    windows = _requested_windows(texts.join(wanted, ["doc_id", "key"]), window)
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("ref_doc"), F.max("doc_id").alias("_high"))
    # by expressions of the keys the few rows left get an exchange of their own: so both
    # sides of the join are plain exchanges, whose large partitions adaptive execution splits
    flipped = [F.bitwise_not(h).alias(g) for h, g in (("h1", "g1"), ("h2", "g2"))]
    least = least.where("ref_doc != _high").select(*flipped, "ref_doc")
    extended = windows.withColumns({"g1": F.bitwise_not("h1"), "g2": F.bitwise_not("h2")}).join(least, ["g1", "g2"])
    extended = extended.where("ref_doc < doc_id").select(
        "doc_id", "key", F.shiftleft("start", _RUN_BITS).bitwiseOR(F.lit(1)).alias("place"), "ref_doc",
        F.lit(-1).cast("long").alias("ref_start"),
    )
    spans = copied.union(extended).groupBy("doc_id", "key").agg(
        F.sort_array(F.collect_set(F.struct("place", "ref_doc", "ref_start"))).alias("spans")
    )
    parsed = _parse(texts.join(spans, ["doc_id", "key"], "left"), window)
    return parsed.select(id_out(), "text", "n_words", "n_removed", "factors")


FACTOR = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ref_doc", pa.int64()), ("ref_start", pa.int64())])


def _factors(spans: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Sorted spans (place, reference, its start) as factors that go on as long as their reference does."""
    out: list[list[int]] = []
    for place, ref, at in spans.tolist():
        start, n = place >> _RUN_BITS, place & ((1 << _RUN_BITS) - 1)
        last = out[-1] if out else None
        follows = last and ref == last[2] and start <= last[0] + last[1] - window + 1
        if follows and (at < 0 or last[3] < 0 or start - last[0] == at - last[3]):
            last[3] = at - (start - last[0]) if last[3] < 0 <= at else last[3]
            last[1] = max(last[1], start + n + window - 1 - last[0])
        else:
            out.append([start, n + window - 1, ref, at])
    return [tuple(x) for x in out]


def _parse(rows: DataFrame, window: int) -> DataFrame:
    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept, n_words, n_removed, factors = [], [], [], []
            for text, spans in zip(unpacked_texts(batch), batch.column("spans")):
                words = text.split()
                n_words.append(len(words))
                if not spans.is_valid:
                    own, gone = [], 0
                else:
                    fields = spans.values.flatten()
                    own = _factors(np.stack([f.to_numpy() for f in fields], 1), window)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [f[0] for f in own], 1)
                    np.add.at(edge, [f[0] + f[1] for f in own], -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    gone = len(words) - int(stay.sum())
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                kept.append(b" ".join(words).decode())
                n_removed.append(gone)
                factors.append([dict(zip(("start", "length", "ref_doc", "ref_start"), f)) for f in own])
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()), pa.array(factors, pa.list_(FACTOR)),
                ],
                ["doc_id", "text", "n_words", "n_removed", "factors"],
            )

        return step

    schema = (
        "doc_id long, text string, n_words long, n_removed long, "
        "factors array<struct<start:long,length:long,ref_doc:long,ref_start:long>>"
    )
    return map_texts(rows, build, schema)
