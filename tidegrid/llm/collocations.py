"""Phrases whose words occur together more often than their parts do.

A first pass counts words and neighbours by hash in tables of a fixed size and keeps a bit
for each slot that reached ``min_count``: a sequence that is found so often has no word or
pair without such a bit. (Where a corpus is so large that all bits are set, nothing is
saved and nothing lost.) Tasks then count word sequences in burstable tries
(``phrase_trie``), bounded in size: what is beyond goes out as sorted runs of whole
subtrees, each to the part that its leading words hash to. A part merges its runs and knows
the whole counts of its sequences, of which those found ``min_count`` times or more go on. Scores, the screen by longer candidates and
ranks are joins and aggregates on that table.

Everything is per language; a null language is ``und``. A null text is empty. Repeated rows
count each, ids play no part. Words are kept as they are beside A-Z, of any length. An empty
table gives no rows. Equal scores rank by count, then by the phrase's bytes, so ranks are
unique. Counts are longs; products of counts are decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import ROWS, Recent, encoded, strings
from tidegrid.llm.phrase_trie import Filter, Merger, PhraseTrie, Seen, word_hash
from tidegrid.session import write_and_read

#: What parts pieces becomes a byte that no UTF-8 text has; tabs become spaces.
STOP = b"\xff"
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_SEPARATORS + b"\t", STOP * len(_SEPARATORS) + b" ")
#: Paths and words that the tries of a task hold at most, give or take one step.
MAX_PATHS, MAX_WORDS = 700_000, 400_000
#: Words that are added to a trie at the same time.
STEP = 100_000
#: Slots of the first pass, as powers of two: least, most (8 MB of bits each for words and pairs), and bytes of text for a slot.
LEAST_SLOTS, MOST_SLOTS, SLOT_BYTES = 16, 26, 64
#: Slots that are added up at the same time.
SLICE = 1 << 16
#: Bytes of runs that leave a task at the same time.
CHUNK = 1 << 20
#: Partial ranks per language before the last one.
SALTS = 256
SEEN = "slice int, lang string, n long, seen binary"
RUN = "part int, lang string, run binary"
COUNTED = "lang string, phrase string, words int, f long"


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words of a text with ``STOP`` between its pieces."""
    return text.lower().translate(_TABLE).replace(STOP, b" " + STOP + b" ").split()


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def _texts(batch: pa.RecordBatch) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Words by language of some rows at a time, ``STOP`` after each text."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        waiting: dict[str, list[bytes]] = {}
        for lang, text in zip(strings(part, "lang"), encoded(part, "text")):
            words = waiting.setdefault(lang, [])
            words += words_of(text)
            words.append(STOP)
            if len(words) >= STEP:
                yield [(lang, waiting.pop(lang))]
        yield list(waiting.items())


def _seen(rows: DataFrame, log2: int) -> DataFrame:
    """Counters of each task, slice by slice, and its number of words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, totals, hashes = Seen(log2), {}, {}
        for batch in batches:
            for lang, words in (x for some in _texts(batch) for x in some):
                if lang not in hashes:
                    seed = _seed(lang)
                    hashes[lang] = Recent(lambda w, seed=seed: 0 if w == STOP else word_hash(w, seed), 100_000)
                totals[lang] = totals.get(lang, 0) + len(words) - words.count(STOP)
                found = np.fromiter(map(hashes[lang].__getitem__, words), np.uint64, len(words))
                for at in range(0, len(words), Seen.STEP):
                    seen.add(found[at : at + Seen.STEP + 1], Seen.STEP)
        slots = seen.tables.reshape(-1, min(SLICE, 1 << log2))
        pack = zstandard.ZstdCompressor(level=1).compress
        for k, part in enumerate(slots):
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": [k], "lang": [None], "n": [None], "seen": [pack(part.tobytes())]}, schema)
        for lang, n in totals.items():
            yield pa.RecordBatch.from_pydict({"slice": [None], "lang": [lang], "n": [n], "seen": [None]}, schema)

    schema = pa.schema([("slice", pa.int32()), ("lang", pa.string()), ("n", pa.int64()), ("seen", pa.binary())])
    return rows.mapInArrow(run, SEEN)


def _bits(seen: DataFrame, least: int) -> DataFrame:
    """``slice, seen``: a bit for each slot whose sum over all tasks is ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, here, total = zstandard.ZstdDecompressor().decompress, None, None

        def done() -> pa.RecordBatch:
            columns = [pa.array([here], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["slice", "seen"])

        for batch in batches:
            for k, data in zip(batch.column("slice").to_pylist(), batch.column("seen")):
                counts = np.frombuffer(unpack(data.as_py()), np.uint16).astype(np.uint32)
                if k != here:
                    if here is not None:
                        yield done()
                    here, total = k, counts
                else:
                    total = np.minimum(total + counts, least)
        if here is not None:
            yield done()

    dealt = seen.where("seen IS NOT NULL").select("slice", "seen").repartition("slice").sortWithinPartitions("slice")
    return dealt.mapInArrow(run, "slice int, seen binary")


def _filter(rows: DataFrame, log2: int, least: int) -> tuple[bytes, DataFrame]:
    """The bits of all slots, of a fixed number, and the number of words of each language."""
    seen = write_and_read(_seen(rows, log2), "phrase-slots")
    size = min(SLICE, 1 << log2)
    bits = bytearray(2 * (1 << log2) // 8)
    for row in _bits(seen, min(least, Seen.FULL)).toLocalIterator():
        bits[row.slice * size // 8 : (row.slice + 1) * size // 8] = row.seen
    totals = seen.where("seen IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    return bytes(bits), totals


def _runs(rows: DataFrame, log2: int, bits: bytes, parts: int, max_paths: int, max_words: int) -> DataFrame:
    def out(lang: str, runs: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for run in runs:
            held.append(run)
            size += len(run[1])
            if size > CHUNK:
                yield _batch(lang, held)
                held, size = [], 0
        if held:
            yield _batch(lang, held)

    def room(tries: dict[str, PhraseTrie]) -> Iterator[pa.RecordBatch]:
        if sum(len(t.ids) for t in tries.values()) > max_words:
            for lang in list(tries):
                yield from out(lang, tries.pop(lang).spill_all(parts))
        elif sum(t.paths for t in tries.values()) > max_paths:
            total = sum(t.count_paths() for t in tries.values())
            least = max_paths // 2
            while total > max_paths:
                lang, trie = max(tries.items(), key=lambda t: (t[1].paths, t[0]))
                total -= trie.paths
                yield from out(lang, trie.spill(total + trie.paths - least, parts))
                total += trie.paths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, PhraseTrie] = {}
        known = Filter(log2, bits)
        for batch in batches:
            for lang, words in (x for some in _texts(batch) for x in some):
                for at in range(0, len(words), STEP):
                    if lang not in tries:
                        tries[lang] = PhraseTrie(STOP, _seed(lang), known)
                    # three words of context, so that no path is cut
                    tries[lang].add(words[at : at + STEP + 3], STEP)
                    yield from room(tries)
        for lang, trie in tries.items():
            yield from out(lang, trie.spill_all(parts))

    return rows.mapInArrow(run, RUN)


def _batch(lang: str, runs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([p for p, _ in runs], pa.int32()), pa.array([lang] * len(runs)), pa.array([r for _, r in runs], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["part", "lang", "run"])


def _merged(runs: DataFrame, min_count: int) -> DataFrame:
    def counted(lang: str, merger: Merger) -> Iterator[pa.RecordBatch]:
        phrases, words, counts = merger.frequent(min_count)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(words, pa.int32()), pa.array(counts)],
            ["lang", "phrase", "words", "f"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, merger = None, Merger()
        for batch in batches:
            for at in range(batch.num_rows):
                key = (batch.column("part")[at].as_py(), batch.column("lang")[at].as_py())
                if key != here:
                    if here is not None:
                        yield from counted(here[1], merger)
                    here, merger = key, Merger()
                merger.add(batch.column("run")[at].as_py())
        if here is not None:
            yield from counted(here[1], merger)

    return runs.mapInArrow(run, COUNTED)


def count_phrases(
    docs: DataFrame,
    min_count: int = 30,
    part_bytes: int = 8 << 20,
    max_paths: int = MAX_PATHS,
    max_words: int = MAX_WORDS,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``lang, phrase, words, f`` of all phrases of 1 to 4 words found ``min_count`` times; phrase null, words 0: all words."""
    if min_count < 1:
        raise ValueError("counts start at 1")
    rows = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).collect()[0][0] or 0
    log2 = min(max((size // SLOT_BYTES).bit_length(), LEAST_SLOTS), MOST_SLOTS)
    bits, totals = _filter(rows, log2, min_count)
    runs = _runs(rows, log2, bits, 1 + size // part_bytes, max_paths, max_words)
    dealt = runs.repartition("part").sortWithinPartitions("part", "lang")
    words = totals.select("lang", F.lit(None).cast("string"), F.lit(0), "n")
    return write_and_read(_merged(dealt, min_count).union(words), "phrase-counts")


def collocations(
    docs: DataFrame,
    min_count: int = 30,
    covered: int = 80,
    limit: int = 2000,
    text_col: str = "text",
    lang_col: str = "lang",
    **counting,
) -> DataFrame:
    """The first ``limit`` candidates of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``covered`` is the percentage of a phrase's occurrences from which a longer candidate around it takes its place.
    """
    counts = count_phrases(docs, min_count, text_col=text_col, lang_col=lang_col, **counting)
    known = counts.where("words > 0")
    candidates = known.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    totals = counts.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))

    def joined(start, length):
        return F.array_join(F.slice(F.split("phrase", " "), start, length), " ")

    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"_first": joined(1, F.col("k")), "_rest": joined(F.col("k") + 1, F.col("words") - F.col("k"))})
    first = known.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("l"))
    rest = known.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r"))
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000) div CAST(l + r AS DECIMAL(20, 0))")
    cuts = cuts.join(first, ["lang", "_first"]).join(rest, ["lang", "_rest"]).withColumn("score", score)
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = candidates.where("words > 2").withColumn("_length", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    longer = longer.withColumn("_start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("_length") + 1)))
    inside = longer.select("lang", joined(F.col("_start"), F.col("_length")).alias("phrase"), "a")
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("_around"))
    taken = F.expr(f"CAST(_around AS DECIMAL(20, 0)) * 100 >= CAST(a AS DECIMAL(20, 0)) * {int(covered)}")
    left = scored.join(inside, ["lang", "phrase"], "left").where(~F.coalesce(taken, F.lit(False)))
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # ranks inside shares of a language first, so that no task orders all its candidates
    left = left.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    left = left.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order)))
    left = left.where(F.col("_place") <= limit)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    left = left.where(F.col("rank") <= limit)
    return left.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
