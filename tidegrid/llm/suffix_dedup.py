"""Removing byte strings that stand earlier in the corpus, by sorted suffixes.

Every window of ``window`` bytes has a lead, the ``lead`` bytes in it with the smallest
hash; windows next to each other with one lead are a block. Equal windows have equal
leads, so the suffixes of a text that matter are those that start at a lead, and only
where the lead's bytes stand in two places.

1. Suffixes are dealt out by a hash of their lead and sorted. A suffix whose lead stands
   elsewhere goes on; all others hold no repeat. Leads that a batch of rows holds twice are
   known to go on, so but one of them are dealt out at random and no lead makes a large
   partition.
2. The blocks around the suffixes left are cut out of the texts, range-partitioned by the
   lead's bytes, with sampled splitters, and sorted. A task takes them in buckets of
   whole leads. In a bucket equal blocks are one; the windows of different blocks are
   suffixes again and sorted by multikey quicksort on characters of eight bytes, which
   stops where a segment has one suffix left. Segments that come to the window's end are
   equal windows, of which all but the earliest are repeats.
3. A lead that fills a bucket or lies at the edge of a partition may go on in the next. Its
   windows that nothing in their own bucket repeats are compared across these boundaries:
   by a digest of 128 bits, the earliest of all buckets against each.

So a frequent lead, or a text that fills a third of the table, is dealt out over as many
buckets as it needs, and what crosses boundaries is one block per different content and
bucket. Spans go back to their texts, which are shuffled once, packed.

A null or empty text has no bytes. A null id is the lowest id. Rows of one id are texts
of their own: a row is known by its id and 64 bits of its text's hash, neither of two
such rows is earlier, and equal rows get the same result. Bytes kept may break a
character, so they are binary. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import encoded, id_out, ids_and_texts, map_texts
from tidegrid.llm.multikey import equal_groups

#: Windows in a block at most; texts that repeat themselves have long runs of one lead.
MAX_RUN = 200
#: Bytes of blocks that are sorted at the same time.
BUCKET = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE_BITS = 8


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` bytes in turn, put together from runs of one, two, four and so on."""
    n = len(data) - size + 1
    out, done = np.zeros(n, np.uint64), 0
    runs, width = data.astype(np.uint64) + np.uint64(1), 1
    while True:
        factor = np.uint64(pow(int(_BASE), width, 1 << 64))
        if size & width:
            out = out * factor + runs[done : done + n]
            done += width
        if done == size:
            return _mixed(out)
        runs = runs[:-width] * factor + runs[width:]
        width *= 2


def _sliding(best: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The least or greatest of each ``width`` values in turn, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = best(values[:-step], values[step:])
        done += step
    return values


def _repeats_inside(grams: np.ndarray, lowest: np.ndarray, reach: int) -> np.ndarray:
    """Hashes that are the lowest of their windows at two places of one run."""
    edge = np.zeros(reach, np.uint64)
    places = np.flatnonzero(grams == _sliding(np.maximum, np.concatenate([edge, lowest, edge]), reach + 1))
    found = grams[places]
    return found[1:][(found[1:] == found[:-1]) & (np.diff(places) <= reach + 1)]


def blocks_of(text: bytes, window: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lead hash, start and number of windows of each block, and whether its lead may be in it twice."""
    data = np.frombuffer(text, np.uint8)
    if len(data) < window:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none.astype(bool)
    grams = gram_hashes(data, lead)
    lowest = _sliding(np.minimum, grams, window - lead + 1)
    first = np.flatnonzero(np.r_[True, lowest[1:] != lowest[:-1]])
    lengths = np.diff(np.r_[first, len(lowest)])
    if lengths.max() > MAX_RUN:
        cuts = [np.arange(a, a + m, MAX_RUN) for a, m in zip(first.tolist(), lengths.tolist())]
        first = np.concatenate(cuts)
        lengths = np.diff(np.r_[first, len(lowest)])
    found = lowest[first]
    inside = _repeats_inside(grams, lowest, window - lead)
    return found, first, lengths, np.isin(found, inside) if len(inside) else np.zeros(len(found), bool)


def text_key(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _suffixes(rows: DataFrame, window: int, lead: int) -> DataFrame:
    """``lead, doc_id, key, place`` of every block; ``place`` is its start and number of windows, negative where it goes on for sure.

    Leads are 48 bits of the hash: two that clash only let a suffix go on for nothing.
    """

    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            leads, places, keys, counts, twice = [], [], [], [], []
            for text in encoded(batch, "text"):
                found, start, n, inside = blocks_of(text, window, lead)
                leads.append(found)
                places.append(start << _PLACE_BITS | n)
                twice.append(inside)
                keys.append(text_key(text))
                counts.append(len(found))
            ids, keys = (np.repeat(x, counts) for x in (batch.column("doc_id").to_numpy(), np.array(keys, np.int64)))
            leads, places = np.concatenate(leads), np.concatenate(places)
            _, first, place, times = np.unique(leads, return_index=True, return_inverse=True, return_counts=True)
            known = (times[place] > 1) | np.concatenate(twice)
            rest = known.copy()
            rest[first] = False
            leads[rest] = _mixed(keys[rest].view(np.uint64) + places[rest].astype(np.uint64))
            leads = (leads >> np.uint64(16)).astype(np.int64)
            columns = [leads, ids, keys, np.where(known, ~places, places)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["lead", "doc_id", "key", "place"])

        return step

    return map_texts(rows, build, "lead long, doc_id long, key long, place long")


def _repeated(suffixes: DataFrame) -> DataFrame:
    """Of partitions sorted by lead the suffixes whose lead stands elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept(rows: pa.RecordBatch, keep: np.ndarray) -> pa.RecordBatch:
            place = rows.column("place").to_numpy()
            keep = pa.array(keep | (place < 0))
            columns = [rows.column("doc_id"), rows.column("key"), pa.array(np.where(place < 0, ~place, place))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "place"]).filter(keep)

        last, edge = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            leads = batch.column("lead").to_numpy()
            same = np.r_[edge, leads[1:] == leads[:-1]]
            # the last row waits for the next batch, with the answer of the row before it
            yield kept(batch.slice(0, len(leads) - 1), same[:-1] | same[1:])
            last, edge = batch.slice(len(leads) - 1), bool(same[-1])
        if last is not None:
            yield kept(last, np.array([edge]))

    return suffixes.mapInArrow(run, "doc_id long, key long, place long")


def pack(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``key``, compressed ``text`` (half of what a shuffle would move) and the number of equal rows in a row."""

    def build():
        packer = zstandard.ZstdCompressor(level=5)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            copies: dict[tuple[int, int], int] = {}
            packed = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), encoded(batch, "text")):
                row = (doc, text_key(text))
                if row not in copies:
                    packed.append(packer.compress(text))
                copies[row] = copies.get(row, 0) + 1
            docs, keys = (pa.array([row[k] for row in copies], pa.int64()) for k in (0, 1))
            columns = [docs, keys, pa.array(packed, pa.binary()), pa.array(list(copies.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "text", "copies"])

        return step

    return map_texts(rows, build, "doc_id long, key long, text binary, copies long")


def _unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return (unpack(x.as_py()) for x in batch.column("text"))


def _cut_blocks(rows: DataFrame, window: int, lead: int) -> DataFrame:
    """``doc_id, key, start``, ``block`` and where its lead is in it, of the places that each text lists."""

    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            leads, starts, blocks, counts = [], [], [], []
            for text, places in zip(_unpacked(batch), batch.column("places")):
                grams = gram_hashes(np.frombuffer(text, np.uint8), lead)
                places = np.sort(places.values.to_numpy())
                for place in places.tolist():
                    start, n = place >> _PLACE_BITS, place & ((1 << _PLACE_BITS) - 1)
                    at = start + int(grams[start : start + window - lead + 1].argmin())
                    leads.append(at - start)
                    blocks.append(text[start : start + n + window - 1])
                starts.append(places >> _PLACE_BITS)
                counts.append(len(places))
            ids, keys = (np.repeat(batch.column(c).to_numpy(), counts) for c in ("doc_id", "key"))
            starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(leads, pa.int32()), pa.array(ids), pa.array(keys), pa.array(starts), pa.array(blocks, pa.binary())],
                ["lead_at", "doc_id", "key", "start", "block"],
            )

        return step

    return map_texts(rows, build, "lead_at int, doc_id long, key long, start long, block binary")


def _places(block: bytes, lead: bytes) -> np.ndarray:
    found, at = [], block.find(lead)
    while at >= 0:
        found.append(at)
        at = block.find(lead, at + 1)
    return np.array(found)


class Bucket:
    """Blocks of some leads, whose repeated windows are looked for together.

    ``spans`` are the repeats found here as (id, key, start, number of windows); ``open``
    the windows of the first blocks of leads that go on elsewhere, as (digest, id, key, start).
    """

    def __init__(self, window: int):
        self.window = window
        self.rows: list[tuple[bytes, int, int, int, bytes]] = []
        self.size = 0

    def add(self, row: tuple[bytes, int, int, int, bytes]) -> None:
        self.rows.append(row)
        self.size += len(row[4])

    def solve(self, going_on: set[bytes]) -> tuple[list[tuple], list[tuple]]:
        window, spans = self.window, []
        firsts: dict[bytes, list[tuple[bytes, int, int, int, bytes]]] = {}
        last = None
        for row in sorted(self.rows, key=lambda r: r[1:4]):
            _, doc, key, start, block = row
            if row[1:4] == last:
                continue  # of an equal row
            last = row[1:4]
            others = firsts.setdefault(block, [])
            # the first of its content, or a row of the same id, of which neither is earlier
            if not others or (others[0][1] == doc and all(o[2] != key for o in others)):
                others.append(row)
            else:
                spans.append((doc, key, start, len(block) - window + 1))
        contents = Counter(rows[0][0] for rows in firsts.values() for _ in rows)
        places = {block: _places(block, rows[0][0]) for block, rows in firsts.items()}
        # windows of a lead's only block equal none, unless the lead is in it twice
        blocks = [
            row for block, rows in firsts.items() for row in rows
            if contents[row[0]] > 1 or len(places[block]) > 1 or row[0] in going_on
        ]
        if not blocks:
            return spans, []
        counts = np.array([len(r[4]) - window + 1 for r in blocks])
        ends = np.cumsum([len(r[4]) for r in blocks])
        data = np.frombuffer(b"".join(r[4] for r in blocks), np.uint8)
        owner = np.repeat(np.arange(len(blocks)), counts)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(ends - [len(r[4]) for r in blocks], counts) + within
        # equal windows have their lead in the same place
        leads = {lead: k for k, lead in enumerate(dict.fromkeys(r[0] for r in blocks))}
        lead_at = np.concatenate([p[np.searchsorted(p, np.arange(n))] - np.arange(n) if len(p) > 1 else p[0] - np.arange(n)
                                  for p, n in zip((places[r[4]] for r in blocks), counts.tolist())])
        apart = np.repeat([leads[r[0]] for r in blocks], counts) * window + lead_at
        order, group = equal_groups(data, at, window, apart)
        docs, keys, starts = (np.array([r[k] for r in blocks], np.int64) for k in (1, 2, 3))
        own, place = owner[order], starts[owner[order]] + within[order]
        later = np.zeros(len(owner), bool)
        if len(order):
            new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            sizes = np.diff(np.r_[new, len(group)])
            lowest = np.repeat(np.minimum.reduceat(docs[own], new), sizes)
            later[order] = docs[own] > lowest
            # inside one row the earliest start stays
            by_row = np.lexsort((place, keys[own], docs[own], group))
            g, d, k = group[by_row], docs[own][by_row], keys[own][by_row]
            again = np.r_[False, (g[1:] == g[:-1]) & (d[1:] == d[:-1]) & (k[1:] == k[:-1])]
            later[order[by_row]] |= again
        edges = np.flatnonzero(np.diff(np.r_[False, later, False].astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            while a < b:
                row = blocks[owner[a]]
                stop = min(b, int(a + counts[owner[a]] - within[a]))
                spans.append((row[1], row[2], row[3] + int(within[a]), stop - a))
                a = stop
        waits = np.array([r[0] in going_on for r in blocks], bool) if going_on else np.zeros(len(blocks), bool)
        left = []
        for i in np.flatnonzero(waits[owner] & ~later).tolist():
            row, k = blocks[owner[i]], int(within[i])
            digest = xxhash.xxh3_128_intdigest(row[4][k : k + window])
            left.append(((digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63), row[1], row[2], row[3] + k))
        return spans, left


FOUND = "k1 long, k2 long, doc_id long, key long, place long"


def _solved(blocks: DataFrame, window: int, lead: int, bucket_bytes: int) -> DataFrame:
    """Of sorted partitions the spans, under their row's id and key, and windows that wait (negative), under their digest.

    ``place`` is the start and the number of windows.
    """

    def out(bucket: Bucket, going_on: set[bytes]) -> pa.RecordBatch:
        spans, left = bucket.solve(going_on)
        rows = [(doc, key, doc, key, start << _PLACE_BITS | n) for doc, key, start, n in spans]
        rows += [(*w[:4], ~(w[4] << _PLACE_BITS | 1)) for w in left]
        columns = list(zip(*rows)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["k1", "k2", "doc_id", "key", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, going_on, last = Bucket(window), set(), None
        for batch in batches:
            for at, *place, block in zip(*(c.to_pylist() for c in batch.columns)):
                row = (block[at : at + lead], *place, block)
                if last is None:
                    going_on.add(row[0])  # the first lead may have begun in another partition
                # a row of the table stays whole, so that its own repeats meet in one bucket
                elif bucket.size >= bucket_bytes and row[:3] != last[:3]:
                    if row[0] == last[0]:
                        going_on.add(row[0])
                    yield out(bucket, going_on)
                    bucket, going_on = Bucket(window), {row[0]} if row[0] == last[0] else set()
                bucket.add(row)
                last = row
        if last is not None:
            going_on.add(last[0])
            yield out(bucket, going_on)

    return blocks.mapInArrow(run, FOUND)


def dedup_bytes(
    docs: DataFrame, window: int = 100, lead: int = 24, bucket_bytes: int = BUCKET, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``kept`` (binary), ``n_bytes``, ``n_removed`` and ``spans`` (start, length) of each row.

    A byte goes where a string of ``window`` bytes covers it that also starts earlier: in a
    document with a smaller id, or earlier in the same one.
    """
    if not 1 <= lead <= window:
        raise ValueError("a lead is a part of a window")
    rows = ids_and_texts(docs, id_col, text_col)
    left = _repeated(_suffixes(rows, window, lead).repartition("lead").sortWithinPartitions("lead"))
    wanted = left.groupBy("doc_id", "key").agg(F.collect_set("place").alias("places"))
    # one exchange of the packed texts for both joins: neither key is ever null, but an inner join puts
    # this filter before its own exchange, which would then not be the one of the outer join
    texts = pack(rows).where("doc_id IS NOT NULL AND key IS NOT NULL").repartition("doc_id", "key")
    cut = _cut_blocks(texts.join(wanted, ["doc_id", "key"]), window, lead)
    # the lead's bytes are part of the block and not carried beside it
    order = [F.expr(f"substring(block, lead_at + 1, {int(lead)})"), F.col("doc_id"), F.col("key")]
    blocks = cut.repartitionByRange(*order).sortWithinPartitions(*order, "start")
    found = _solved(blocks, window, lead, bucket_bytes)
    # spans are alone under their row, windows meet those of other buckets under their digest
    lowest = F.min("doc_id").over(Window.partitionBy("k1", "k2"))
    found = found.withColumn("_lowest", lowest).where("place >= 0 OR doc_id > _lowest")
    place = F.when(F.col("place") < 0, F.bitwise_not("place")).otherwise(F.col("place"))
    spans = found.groupBy("doc_id", "key").agg(F.collect_list(place).alias("found"))
    done = _kept(texts.join(spans, ["doc_id", "key"], "left"), window)
    return done.select(id_out(), "kept", "n_bytes", "n_removed", "spans")


SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])


def _kept(rows: DataFrame, window: int) -> DataFrame:
    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept, sizes, removed, spans = [], [], [], []
            for text, found in zip(_unpacked(batch), batch.column("found")):
                sizes.append(len(text))
                own: list[tuple[int, int]] = []
                if found.is_valid:
                    place = found.values.to_numpy()
                    start, n = place >> _PLACE_BITS, place & ((1 << _PLACE_BITS) - 1)
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n + window - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    turns = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    own = list(zip(turns[::2].tolist(), (turns[1::2] - turns[::2]).tolist()))
                    text = np.frombuffer(text, np.uint8)[~gone].tobytes()
                kept.append(text)
                removed.append(sum(k for _, k in own))
                spans.append([{"start": a, "length": k} for a, k in own])
            columns = [pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())]
            columns = [batch.column("doc_id"), *columns, pa.array(spans, pa.list_(SPAN))]
            done = pa.RecordBatch.from_arrays(columns, ["doc_id", "kept", "n_bytes", "n_removed", "spans"])
            copies = batch.column("copies").to_numpy()
            return done if (copies == 1).all() else done.take(pa.array(np.repeat(np.arange(len(copies)), copies)))

        return step

    return map_texts(rows, build, "doc_id long, kept binary, n_bytes long, n_removed long, spans array<struct<start:long,length:long>>")
