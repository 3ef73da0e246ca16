"""Token ids in Parquet list columns, laid out for selective reads.

Documents are dealt out by ranges of ``doc_id`` and sorted, so file, row group and
page hold a short range of ids. Ids are a list column with a dictionary (a token
recurs), numbers of documents are delta-encoded (format version 2 without
dictionary). Row groups and pages have set sizes, and page indexes are written, so
a read of few documents or of the counts alone touches few pages.

``part`` is the number of the file and ``local_start`` the offset inside it; the
offset of a whole part is the sum of the parts before, taken from the counts.

A null text is an empty one, and an empty text has the end id only. Null ids come
first. Repeated rows are stored each, in an order of their own among equal ids.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.llm.bpe import byte_characters
from tidegrid.llm.common import ROWS, Recent, id_out, ids_and_texts, lists, strings

#: Words that a Python worker remembers, and as many from before; of time only.
CACHED_WORDS = 400_000
#: Punctuation that is cut off a word, and letters whose small form hangs on what is around them.
MARKS = ".,!?;:%&*#$|()\"-"
ODD_CASE = "\u03a3\u0130"
#: Marks after a small Latin-1 letter, up to the end of the word.
END_MARKS = re.compile(rf"[{re.escape(MARKS)}](?<=[a-zß-öø-ÿ].)[{re.escape(MARKS)}]*(?!\S)")
#: How the names of special tokens begin, which are found before case is lowered.
SPECIAL = "<|"
#: Characters that Python counts as blanks and the tokenizer does not.
SEPARATORS = tuple(map(chr, range(0x1C, 0x20)))
#: Up to so many files their offsets (a row of two numbers each) are broadcast.
BROADCAST_FILES = 500_000
SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"


class WordIds:
    """Packed ids of texts from the library, word by word; words are remembered, within bounds.

    The tokenizer drops blanks and never joins what they part, so the ids of a text
    are those of its words in turn. It also lowers case and never joins a letter to
    punctuation, so a word of letters and the marks after it are remembered apart. In texts
    of Latin-1, where each letter has one small form, both are done before words are looked up.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize
        self.words = Recent(self._word, CACHED_WORDS)
        self.marks = Recent(self._part, 10_000)
        self.stand_ins = {b: c for c, b in byte_characters().items()}

    def _part(self, part: str) -> bytes:
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def _stem(self, stem: str) -> bytes:
        """Of a lower-case word of letters: one piece, so only the library's BPE itself is asked."""
        if not stem.isascii():
            stem = stem.encode().decode("latin-1").translate(self.stand_ins)
        return array("I", [t.id for t in self.tokenize(stem)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and word.islower():
            return self._stem(word)
        stem = word.rstrip(MARKS)
        if not stem.isalpha() or ODD_CASE[0] in stem or ODD_CASE[1] in stem:
            return self._part(word)
        low = stem.lower()
        # some letters are taken apart by the normaliser into a letter and a mark, which ends a piece
        if not low.isascii() and (not low.isalpha() or not unicodedata.is_normalized("NFC", low)):
            return self._part(word)
        ids = self._stem(low) if low == word else self.words[low]
        return ids + self.marks[word[len(stem) :]] if len(stem) < len(word) else ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in SEPARATORS):
            return self._part(text)
        if _latin(text) and SPECIAL not in text:
            text = END_MARKS.sub(r" \g<0>", text.lower())
        return b"".join(map(self.words.__getitem__, text.split()))


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def word_ids(tokenizer_path: str) -> WordIds:
    """One for all tasks of a Python worker, as what it remembers holds for all."""
    return WordIds(tokenizer_path)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 1,
    partitions: int | None = None,
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 2_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode whole texts and write them in ascending ``doc_id``; a task holds one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, at = word_ids(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            packed = [words.encode(text) + end for text in strings(batch, "text")]
            counts = np.array([len(p) // 4 for p in packed], dtype=np.int64)
            starts = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            flat = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(counts), part, dtype=np.int32)), batch.column("doc_id"),
                    pa.array(starts), pa.array(counts), lists(flat, counts, pa.int32()),
                ],
                ["part", "doc_id", "local_start", "n_tokens", "ids"],
            )
        pa.default_memory_pool().release_unused()

    rows = ids_and_texts(docs, id_col, text_col)
    # the hash parts rows of one id (null ids, say) that no single task should get
    order = ["doc_id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    tokens = ranged.sortWithinPartitions(*order).mapInArrow(run, SCHEMA)
    writer = tokens.write.option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd")
    writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
    writer = writer.option("parquet.page.row.count.limit", page_rows)
    for column in ("part", "doc_id", "local_start", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.option("parquet.enable.dictionary#ids.list.element", "true").parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """``doc_id``, ``start`` over all files, ``n_tokens`` and, if asked for, ``ids``.

    Filters on ``doc_id`` reach the files. One number per file is summed up, from the
    counts alone; as many rows as there are files.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("_size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    start = (F.col("local_start") + F.col("_base")).alias("start")
    small = F.broadcast(bases) if len(files.inputFiles()) <= BROADCAST_FILES else bases
    return files.join(small, "part").select(id_out(), start, "n_tokens", *["ids"] * ids)
