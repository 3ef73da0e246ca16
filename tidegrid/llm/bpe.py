"""BPE encoding and decoding with contiguous rank arrays.

A text is cut into pieces by the pattern of byte-level BPE. A piece of at most
``SHORT`` bytes is an array of parts with, beside it, the array of the ranks of
adjacent parts. The lowest rank is found by a scan, its boundary is deleted and
the two ranks next to it are looked up anew, until no pair has a rank. A longer
piece takes the same merges from a heap, as scans would cost the square of its
length. Ids are kept packed: little-endian unsigned 32-bit integers.

Nulls are empty texts; an empty text has no ids. Repeated rows are encoded each
for itself, other columns are not read, an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import Recent, encoded, id_out, ids_and_texts, map_texts, strings

SHORT = 128
#: Words that a Python worker remembers, a third more pieces, and as many from before; of time only.
CACHED_WORDS = 60_000
NO_RANK = 1 << 60

# Fixed values of byte-level BPE: the piece pattern and the printable stand-ins of bytes.
PIECE = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]

#: A word with the blanks before it. No piece goes over from a non-blank to a blank.
WORD = regex.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_BLANK = regex.compile(r"[\p{White_Space}--[ \n]]", regex.V1)


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files, and its byte."""
    spare = (b for b in range(256) if b not in set(PRINTABLE))
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(spare)}


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        to_byte = byte_characters()
        ids = data["model"]["vocab"]
        size = 1 + max([*ids.values(), *(t["id"] for t in data["added_tokens"])])
        self.bytes_of = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token)
        self.first = [0] * 256
        for character, b in to_byte.items():
            self.first[b] = ids[character]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(ids[a] << 32 | ids[b], rank)
            self.merged.append(ids[a + b])
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.piece = regex.compile(PIECE)

    def text(self, packed: bytes) -> str:
        """The text of packed ids. Bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        ids = np.frombuffer(packed, dtype="<u4")
        ids = ids[ids < len(self.bytes_of)].tolist()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        parts = [self.first[b] for b in piece]
        return self._merge_array(parts) if len(parts) <= SHORT else self._merge_heap(parts)

    def _merge_array(self, parts: list[int]) -> list[int]:
        rank = self.ranks.get
        adjacent = [rank(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while adjacent:
            lowest = min(adjacent)
            if lowest == NO_RANK:
                break
            i = adjacent.index(lowest)
            parts[i] = self.merged[lowest]
            del parts[i + 1], adjacent[i]
            if i < len(adjacent):
                adjacent[i] = rank(parts[i] << 32 | parts[i + 1], NO_RANK)
            if i:
                adjacent[i - 1] = rank(parts[i - 1] << 32 | parts[i], NO_RANK)
        return parts

    def _merge_heap(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if parts[i] >= 0 else n
            if j >= n or rank(parts[i] << 32 | parts[j]) != r:
                continue  # one of the two parts has been merged meanwhile
            parts[i], parts[j] = self.merged[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := rank(parts[left] << 32 | parts[right])) is not None:
                    heapq.heappush(heap, (r, left))
        return [p for p in parts if p >= 0]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Packed ids of texts; words and their pieces are remembered, within bounds."""

    def __init__(self, vocab: Vocabulary, remembered: int = CACHED_WORDS):
        self.vocab = vocab
        self.words = Recent(self._word, remembered)
        self.pieces = Recent(self._piece, remembered * 4 // 3)

    def _piece(self, piece: str) -> bytes:
        return np.array(self.vocab.merge(piece.encode()), dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.vocab.piece.findall(word)))

    def plain(self, text: str) -> bytes:
        if OTHER_BLANK.search(text):
            return self._word(text)
        return b"".join(map(self.words.__getitem__, WORD.findall(text)))

    def encode(self, text: str) -> bytes:
        if not self.vocab.special or not self.vocab.special.search(text):
            return self.plain(text)
        added = self.vocab.added
        parts = self.vocab.special.split(text)
        return b"".join(np.array([added[p]], dtype="<u4").tobytes() if p in added else self.plain(p) for p in parts)


@lru_cache(maxsize=2)
def encoder(path: str, remembered: int = CACHED_WORDS) -> Encoder:
    """One for all tasks of a Python worker, as what it remembers holds for all."""
    return Encoder(vocabulary(path), remembered)


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids``, the packed ids of each whole text. Row by row, no shuffle."""

    def build():
        words = encoder(vocabulary_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = [words.encode(text) for text in strings(batch, "text")]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "ids"])

        return step

    rows = ids_and_texts(docs, id_col, text_col)
    return map_texts(rows, build, "doc_id long, ids binary").select(id_out(), "ids")


def decode(tokens: DataFrame, vocabulary_path: str) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``. Bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""

    def build():
        vocab = vocabulary(vocabulary_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = pa.array(map(vocab.text, encoded(batch, "ids")), pa.string())
            return pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

        return step

    return map_texts(tokens.select("doc_id", "ids"), build, "doc_id long, ids binary, decoded string")


def encode_and_decode(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", remembered: int = CACHED_WORDS
) -> DataFrame:
    """``decode`` of ``encode`` in one Python step: ids pass to Spark once, and a task holds one vocabulary.

    ``remembered`` words take about 400 bytes each in a Python worker and save time, where memory is left.
    """

    def build():
        words = encoder(vocabulary_path, remembered)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = [words.encode(text) for text in strings(batch, "text")]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(packed, pa.binary()), pa.array(map(words.vocab.text, packed), pa.string())],
                ["doc_id", "ids", "decoded"],
            )

        return step

    rows = ids_and_texts(docs, id_col, text_col)
    return map_texts(rows, build, "doc_id long, ids binary, decoded string").select(id_out(), "ids", "decoded")


def token_count() -> Column:
    return F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens")


def ids_array(column: str = "ids") -> Column:
    """Packed ids as an array of ints, by expressions only."""
    digits = F.hex(F.col(column))
    n = F.floor(F.octet_length(column) / 4).cast("int")
    at = lambda i: F.concat(*[F.substring(digits, i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)])
    filled = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(at(i), 16, 10).cast("int"))
    return F.when(n > 0, filled).otherwise(F.array().cast("array<int>"))
