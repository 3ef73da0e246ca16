"""Line dedup with cuckoo filters over exact reference counts.

A line's key is the line without ASCII blanks at both ends, A-Z in lower case. Keys
of at least ``min_chars`` code points count, by a 128-bit hash. The index keeps, each
change as one more generation of Parquet tables below ``path``:

* ``postings``: a row per key and document with the number of lines,
* ``counts``: the exact reference table, for each key touched its number of lines and
  its smallest and largest document; the latest row of a key holds,
* ``filters``: per shard of keys one cuckoo filter of the keys with references
  (``seen``) and one of those in two documents at least (``repeated``),
* ``deleted``: documents taken out,
* ``done``: a mark for each generation, written when its other tables are whole.

Only marked generations are read. A change that dies half way leaves the index as it
was; the next change, or the same one again, writes over what it left. One change
at a time: two writers of one index would take the same generation.

Inserting asks ``seen`` first: keys it doesn't know are new, only the others are
looked up in the exact table. Dedup asks ``repeated`` first: lines it doesn't know
stay, only the others meet the exact table. Deleting takes the postings of the
documents back, counts their keys anew and removes keys from the filters, so an
index after insert and delete answers as if the documents had never been there.

A filter is met by streaming: filter rows and key rows of a shard lie in one sorted
partition, filter first, so a task holds the filters of one shard. Lines are dealt
out by shard and a salt, so a line that a third of all documents share is spread.

A null or empty text is one empty line; a null id is one document, before all
others. Rows of the same id are one document: a key in these rows only is not
repeated, and each row loses the lines that its document loses.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegrid.llm.common import id_in, id_out, ids_and_texts, map_texts, strings
from tidegrid.llm.cuckoo import CuckooFilter

BLANKS = " \t\n\x0b\x0c\r"
KEY = ["shard", "k1", "k2"]
POSTINGS = "k1 long, k2 long, doc_id long, refs long"
COUNTS = "shard int, k1 long, k2 long, refs long, first long, last long"
FILTERS = "shard int, name string, filter binary"
#: Documents a shard is meant for; more only make its filter longer.
DOCUMENTS_PER_SHARD = 10_000
#: Ways in which the lines of one shard are dealt out.
SALTS = 16


def line_key(line: str, min_chars: int) -> bytes | None:
    """128-bit hash of the key, None for keys that don't count."""
    key = line.strip(BLANKS)
    if len(key) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.encode().lower())


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def postings(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each key and document (twice where an id has several rows)."""

    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, refs, lengths = [], [], []
            for text in strings(batch, "text"):
                own: dict[bytes, int] = {}
                for line in text.split("\n"):
                    key = line_key(line, min_chars)
                    if key is not None:
                        own[key] = own.get(key, 0) + 1
                keys += own
                refs += own.values()
                lengths.append(len(own))
            k1, k2 = _hashes(keys)
            ids = np.repeat(batch.column("doc_id").to_numpy(), lengths)
            return pa.RecordBatch.from_arrays(
                [pa.array(k1), pa.array(k2), pa.array(ids, pa.int64()), pa.array(refs, pa.int64())], ["k1", "k2", "doc_id", "refs"]
            )

        return step

    return map_texts(docs, build, POSTINGS)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True])
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


@dataclass(frozen=True)
class LineIndex:
    """An index below ``path``. ``shards`` is fixed when it is made."""

    spark: SparkSession
    path: str
    shards: int
    min_chars: int = 10

    @classmethod
    def create(cls, spark: SparkSession, path: str, expected_documents: int, min_chars: int = 10) -> LineIndex:
        shards = max(16, -(-expected_documents // DOCUMENTS_PER_SHARD))
        made = cls(spark, path, shards, min_chars)
        text = json.dumps({"shards": shards, "min_chars": min_chars})
        spark.range(1, numPartitions=1).select(F.lit(text).alias("value")).write.text(f"{path}/settings")
        made._write(0, postings=[], counts=[], filters=[], deleted=[])
        made._mark(0)
        return made

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineIndex:
        return cls(spark, path, **json.loads(spark.read.text(f"{path}/settings").first()[0]))

    # the tables

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, gen int").option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def _write(self, gen: int, **tables: DataFrame | list) -> None:
        schemas = {"postings": POSTINGS, "counts": COUNTS, "filters": FILTERS, "deleted": "doc_id long"}
        for name, rows in tables.items():
            rows = self.spark.createDataFrame([], schemas[name]) if isinstance(rows, list) else rows
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/gen={gen}")

    def _mark(self, gen: int) -> None:
        """The generation is whole; from here on it is read."""
        self.spark.range(gen, gen + 1, numPartitions=1).write.mode("overwrite").parquet(f"{self.path}/done/number={gen}")

    def _last(self) -> int:
        """The number of the last whole generation."""
        return self.spark.read.schema("id long").parquet(f"{self.path}/done").agg(F.max("id")).first()[0]

    def _whole(self, name: str, schema: str) -> DataFrame:
        return self._read(name, schema).where(F.col("gen") <= self._last())

    def _filters(self) -> DataFrame:
        return self._read("filters", FILTERS).where(F.col("gen") == self._last()).drop("gen")

    def counts(self) -> DataFrame:
        """The exact reference table: ``shard, k1, k2, refs, first, last``; keys without references are not in it."""
        rows = self._whole("counts", COUNTS)
        newest = F.max(F.struct("gen", "refs", "first", "last")).alias("_n")
        held = rows.groupBy(*KEY).agg(newest).select(*KEY, "_n.refs", "_n.first", "_n.last")
        return held.where("refs > 0")

    def live_postings(self) -> DataFrame:
        gone = self._whole("deleted", "doc_id long").groupBy("doc_id").agg(F.max("gen").alias("_gone"))
        kept = self._whole("postings", POSTINGS).join(gone, "doc_id", "left")
        return kept.where("_gone IS NULL OR gen > _gone").drop("_gone", "gen")

    def _sharded(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("shard", F.pmod(F.xxhash64("k1"), F.lit(self.shards)).cast("int"))

    # filters and keys of a shard, met in one pass

    def _stream(self, rows: DataFrame, columns: list[str], salts: int, visit, schema: str) -> DataFrame:
        """``visit(filters, shard, columns)`` for pieces of each shard's keys, then with None at its end."""
        every = [F.lit(s) for s in range(salts)]
        first = self._filters().select(
            "shard", F.explode(F.array(*every)).alias("salt"), F.lit(0).alias("kind"),
            *[F.lit(None).cast("long").alias(c) for c in columns], "name", "filter",
        )
        empty = self.spark.range(self.shards).select(
            F.col("id").cast("int").alias("shard"), F.explode(F.array(*every)).alias("salt"), F.lit(0).alias("kind"),
            *[F.lit(None).cast("long").alias(c) for c in columns],
            F.lit("").alias("name"), F.lit(None).cast("binary").alias("filter"),
        )
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int") if salts > 1 else F.lit(0)
        keys = rows.select(
            "shard", salt.alias("salt"), F.lit(1).alias("kind"), *[F.col(c).cast("long").alias(c) for c in columns],
            F.lit("").alias("name"), F.lit(None).cast("binary").alias("filter"),
        )
        both = first.unionByName(empty).unionByName(keys)
        dealt = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, filters = None, {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                place = np.stack([batch.column(c).to_numpy() for c in ("shard", "salt", "kind")], 1)
                runs = np.ravel_multi_index((place[:, 0], place[:, 1], place[:, 2]), (place[:, 0].max() + 1, salts, 2))
                for a, b in _runs(runs):
                    shard, salt, kind = place[a].tolist()
                    if (shard, salt) != at:
                        if at is not None:
                            yield from visit(filters, at[0], None)
                        at, filters = (shard, salt), {"seen": CuckooFilter(), "repeated": CuckooFilter()}
                    if kind == 0:
                        for i in range(a, b):
                            name = batch.column("name")[i].as_py()
                            if name:
                                filters[name] = CuckooFilter.from_bytes(batch.column("filter")[i].as_py())
                    else:
                        yield from visit(filters, shard, {c: batch.column(c)[a:b].to_numpy().copy() for c in columns})
            if at is not None:
                yield from visit(filters, at[0], None)

        return dealt.mapInArrow(run, schema)

    def _maybe(self, rows: DataFrame, name: str, columns: list[str], salts: int) -> DataFrame:
        """The rows whose key the filter ``name`` may hold."""
        def visit(filters, shard, keys):
            if keys is None:
                return
            hit = filters[name].contains(keys["k1"], keys["k2"])
            if hit.any():
                kept = [pa.array(keys[c][hit]) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hit.sum(), shard, np.int32)), *kept], ["shard", *columns])

        return self._stream(rows, columns, salts, visit, "shard int, " + ", ".join(f"{c} long" for c in columns))

    def _changed_filters(self, changes: DataFrame) -> DataFrame:
        """New filters; ``seen`` and ``repeated`` of a change are 1 to add, -1 to remove, 0 to leave."""
        columns = ["k1", "k2", "seen", "repeated"]
        names = ("seen", "repeated")

        def visit(filters, shard, keys):
            if keys is None:
                blobs = [filters[n].to_bytes() for n in names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * 2, pa.int32()), pa.array(names), pa.array(blobs, pa.binary())], ["shard", "name", "filter"]
                )
                return
            for n in names:
                add, drop = keys[n] > 0, keys[n] < 0
                filters[n].add(keys["k1"][add], keys["k2"][add])
                filters[n].remove(keys["k1"][drop], keys["k2"][drop])

        return self._stream(changes, columns, 1, visit, FILTERS)

    # operations

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add documents. Rows of an id that is in already add their lines to that document; deletion takes all of them."""
        gen = self._last() + 1
        self._write(gen, postings=postings(ids_and_texts(docs, id_col, text_col), self.min_chars), deleted=[])
        own = self._read("postings", POSTINGS).where(F.col("gen") == gen)
        added = self._sharded(own).groupBy(*KEY).agg(
            F.sum("refs").alias("refs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")
        )
        if gen > 1:
            maybe = self._maybe(added, "seen", ["k1", "k2"], 1)
            known = self.counts().join(maybe, KEY, "left_semi")
            old = known.select(*KEY, F.col("refs").alias("_refs"), F.col("first").alias("_first"), F.col("last").alias("_last"))
            added = added.join(old, KEY, "left")
        else:
            added = added.selectExpr("*", "CAST(NULL AS LONG) _refs", "CAST(NULL AS LONG) _first", "CAST(NULL AS LONG) _last")
        total = added.select(
            *KEY, (F.col("refs") + F.coalesce("_refs", F.lit(0))).alias("refs"),
            F.least("first", "_first").alias("first"), F.greatest("last", "_last").alias("last"),
            F.col("_refs").isNull().alias("_new"), F.coalesce(F.col("_first") != F.col("_last"), F.lit(False)).alias("_was"),
        )
        self._store(gen, total.select(
            "*", F.col("_new").cast("int").alias("seen"),
            ((F.col("first") != F.col("last")) & ~F.col("_was")).cast("int").alias("repeated"),
        ))

    def _store(self, gen: int, totals: DataFrame) -> None:
        """Counts with what changes in the filters; written once, read for the filters. Then the generation is marked."""
        self._write(gen, counts=totals.select(*KEY, "refs", "first", "last", "seen", "repeated"))
        changes = self._read("counts", COUNTS + ", seen int, repeated int").where(
            f"gen = {gen} AND (seen != 0 OR repeated != 0)"
        )
        self._write(gen, filters=self._changed_filters(changes))
        self._mark(gen)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Take documents out again."""
        gen = self._last() + 1
        ids = ids.select(id_in(id_col)).distinct()
        live = self._sharded(self.live_postings())
        touched = live.join(ids, "doc_id", "left_semi").select(*KEY).distinct()
        left = live.join(ids, "doc_id", "left_anti").join(touched, KEY, "left_semi").groupBy(*KEY).agg(
            F.sum("refs").alias("refs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")
        )
        old = self.counts().select(*KEY, (F.col("first") != F.col("last")).alias("_was")).join(touched, KEY, "left_semi")
        both = old.join(left, KEY, "left").select(
            *KEY, F.coalesce("refs", F.lit(0)).alias("refs"), "first", "last",
            (-F.col("refs").isNull().cast("int")).alias("seen"),
            (-(F.col("_was") & F.coalesce(F.col("first") == F.col("last"), F.lit(True))).cast("int")).alias("repeated"),
        )
        self._write(gen, deleted=ids, postings=[])
        self._store(gen, both)

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
        """``doc_id``, ``text`` without repeated lines, ``n_lines`` and ``n_dropped`` of indexed documents.

        Columns named by ``carry`` come along in the struct ``carried``.
        """
        rows = docs.select(
            id_in(id_col), F.col(f"`{text_col}`").cast("string").alias("text"),
            F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(0).alias("none")]).alias("carried"),
        )
        lines = self._sharded(postings(rows.select("doc_id", "text"), self.min_chars))
        hits = self._maybe(lines, "repeated", ["k1", "k2", "doc_id"], SALTS)
        # a line of a third of all documents has as many hits: they are spread by salt, the few repeated keys copied
        repeated = self.counts().where("first != last").select(*KEY, "first")
        repeated = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        drops = hits.join(repeated, [*KEY, "salt"]).where("doc_id != first").groupBy("doc_id").agg(
            F.collect_list("k1").alias("k1s"), F.collect_list("k2").alias("k2s")
        )
        kept = self._apply(rows.join(drops, "doc_id", "left"))
        return kept.select(id_out(), "text", "n_lines", "n_dropped", *["carried"] * bool(carry))

    def _apply(self, rows: DataFrame) -> DataFrame:
        min_chars = self.min_chars

        def build():
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                kept, n, dropped = [], [], []
                pairs = zip(strings(batch, "text"), batch.column("k1s"), batch.column("k2s"))
                for text, k1, k2 in pairs:
                    text_lines = text.split("\n")
                    n.append(len(text_lines))
                    if k1.is_valid:
                        both = np.stack([k1.values.to_numpy(), k2.values.to_numpy()], 1).astype("<i8")
                        gone = {row.tobytes() for row in both}
                        stay = [x for x in text_lines if line_key(x, min_chars) not in gone]
                        text, dropped_here = "\n".join(stay), len(text_lines) - len(stay)
                    else:
                        dropped_here = 0
                    kept.append(text)
                    dropped.append(dropped_here)
                return pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(n, pa.int64()),
                        pa.array(dropped, pa.int64()), batch.column("carried"),
                    ],
                    ["doc_id", "text", "n_lines", "n_dropped", "carried"],
                )

            return step

        schema = StructType.fromDDL("doc_id long, text string, n_lines long, n_dropped long").add(rows.schema["carried"])
        return map_texts(rows, build, schema)


def dedup_lines(docs: DataFrame, path: str, min_chars: int = 10, batches: int = 2, carry: Sequence[str] = ()) -> DataFrame:
    """Insert all documents into a new index, in batches as they would come in, and dedup them."""
    spark = docs.sparkSession
    index = LineIndex.create(spark, path, docs.count(), min_chars)
    for number in range(batches):
        index.insert(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == number))
    return index.dedup(docs, carry=carry)
