"""Benchmark decontamination by template canonicalisation.

Tokens of a text become template tokens: numbers, names and units are replaced by
typed placeholders, anything else is its lower-case form without the punctuation
around it. Windows of template tokens are hashed and joined with those of the
benchmark. A match gives an alignment
(document position minus item position), and its slots must be consistent: along one
alignment a number or unit of the item stands for one value of the document, the most
frequent one, and names stand for each other one to one. Windows that hold another value
do not count, unless all their slots equal the item's. So a question whose numbers and
names have been changed is found, and a text that only has the same shape is not.
A document is contaminated by an item if windows of its alignments make up at least
``min_share`` of the item's windows.

Beside each template window stands the literal one, of the same words in lower case. It
needs no slots and counts whatever the case and the punctuation around the words are, and
in items of too few literal tokens for a template.

* number: digits with ``. , : /`` between them, or a word for a number;
* unit: a word of ``UNITS`` after a number, or joined to one, or ``%``;
* name: a capital letter with small ones after it, not at the start of a sentence
  (the start of the text or of a line, or after ``. ! ? :``).

Templates without ``min_literal`` literal tokens aren't used. An item shorter than a
window is one window of its own length; an item of fewer than ``min_words`` words is
never found, as its words stand everywhere. If the benchmark has at most ``BROADCAST_WINDOWS`` windows, their hashes are
sent to the tasks, which then emit matching windows only; a larger benchmark is
joined by a shuffle, with the same result.

Null and empty texts have no windows. Null ids of documents are the lowest id inside
and null in the result; rows of one id are one document. Null item ids are one item.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import encoded, id_in, id_out, ids_and_texts, map_texts
from tidegrid.session import write_and_read

BROADCAST_WINDOWS = 2_000_000
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
CACHED_TOKENS = 300_000

UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs oz ton tons tonnes ml l litre litres "
    "liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months "
    "year years km/h mph m/s kmh dollar dollars euro euros cent cents pound pounds usd eur degree degrees percent".split()
)
NUMBER_WORDS = frozenset(
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
)
#: A line break as a token, by a byte that no UTF-8 text has.
_LINE = b"\xff"
_BREAK = b" " + _LINE + b" "
_PLAIN_BUT_SPECIAL = frozenset(w.encode() for w in UNITS | NUMBER_WORDS)
AROUND = r"[\p{P}\p{S}]+"
CORE = regex.compile(rf"^{AROUND}|{AROUND}$")
NUMERAL = regex.compile(r"[+-]?\d+(?:[.,:/]\d+)*")
NAMED = regex.compile(r"\p{Lu}\p{Ll}+(?:[-'’]\p{L}+)*")
_MARKS = ".,;:!?\"'()-"
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Tells windows of words from windows of templates.
_LITERAL_WINDOW = np.uint64(1 << 32)


class Token(NamedTuple):
    """What a raw token is."""

    core: str  # without the marks around
    hash: int  # of the template token, if literal
    kind: int = LITERAL
    parts: int = 1  # 0 for marks only, 2 for a number with its unit
    named: bool = False  # a name, if inside a sentence
    unit: bool = False  # a unit, if after a number
    ends: bool = False  # a sentence starts after it
    glued: str = ""  # the unit that is joined to a number


def plain_word(token: bytes) -> bytes | None:
    """Small letters with a comma or a stop after them, as most tokens are: without the mark. None for all others."""
    word = token[:-1] if token[-1] in b",." else token
    if word.isalpha():
        return word if word.islower() and word not in _PLAIN_BUT_SPECIAL else None
    if word.isascii():
        return None
    text = word.decode()
    return word if text.isalpha() and text == text.lower() else None


def token_of(token: bytes) -> Token:
    text = token.decode()
    ends = text == "\n" or text.rstrip("\"')]”’").endswith((".", "!", "?", ":"))
    core = text.strip(_MARKS)
    lower = core.lower()
    # letters with common marks around: no pattern has to be asked
    if core.isalpha() and lower not in NUMBER_WORDS and (core == lower or core[0].isupper() and core[1:].islower()):
        named = core != lower and (core.isascii() or bool(NAMED.fullmatch(core)))
        return Token(core, xxhash.xxh3_64_intdigest(lower.encode()), named=named, unit=lower in UNITS, ends=ends)
    core, kind, parts, glued = CORE.sub("", text), LITERAL, 1, ""
    lower = core.lower()
    numeral = NUMERAL.match(core)
    rest = core[numeral.end() :] if numeral else ""
    if not core or core == "\n":
        parts = 0
    elif numeral and (not rest or rest.lower() in UNITS) or lower in NUMBER_WORDS:
        kind = NUMBER
        if rest or text.rstrip(".,;:!?)").endswith("%"):
            parts, glued = 2, rest or "%"
            core = core[: numeral.end()] if numeral else core
    value = xxhash.xxh3_64_intdigest(lower.encode())
    return Token(core, value, kind, parts, bool(NAMED.fullmatch(core)), lower in UNITS, ends, glued)


class _Numbers(dict):
    """Numbers raw tokens as they come and keeps the hashes of new ones, what the special ones are, and which are plain and end a sentence."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []
        self.special: list[tuple[int, Token]] = []
        self.ends: list[int] = []

    def __missing__(self, token: bytes) -> int:
        self[token] = found = len(self)
        word = plain_word(token) if token != _LINE else None
        if word is None:
            self.special.append((found, token_of(b"\n" if token == _LINE else token)))
            self.hashes.append(self.special[-1][1].hash)
        else:
            self.hashes.append(xxhash.xxh3_64_intdigest(word))
            if token.endswith(b"."):
                self.ends.append(found)
        return found


class Tokens:
    """What each raw token is, by number; filled as tokens come up and emptied when full."""

    COLUMNS = (("hash", np.uint64), ("kind", np.int8), ("parts", np.int64), ("named", bool), ("unit", bool), ("ends", bool))

    def __init__(self):
        for name, kind in self.COLUMNS:
            setattr(self, name, np.zeros(CACHED_TOKENS, kind))
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.known = 0
        self.cores: dict[int, str] = {}
        self.glued: dict[int, str] = {}

    def of(self, tokens: list[bytes]) -> np.ndarray:
        """Numbers of the tokens of one text; they hold until the next call."""
        if self.known + len(tokens) > len(self.hash):
            self.clear()
            if len(tokens) > len(self.hash):
                for name, _ in self.COLUMNS:
                    setattr(self, name, np.resize(getattr(self, name), len(tokens)))
        number = self.number
        found = np.fromiter(map(number.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        if number.hashes:
            new = slice(self.known, len(number))
            self.hash[new], self.kind[new], self.parts[new] = number.hashes, LITERAL, 1
            self.named[new] = self.unit[new] = self.ends[new] = False
            self.ends[number.ends] = True
            for k, token in number.special:
                for name, _ in self.COLUMNS[1:]:
                    getattr(self, name)[k] = getattr(token, name)
                self.cores[k] = token.core
                if token.glued:
                    self.glued[k] = token.glued
            self.known = len(number)
            number.hashes, number.special, number.ends = [], [], []
        return found


@lru_cache(maxsize=1)
def _tokens() -> Tokens:
    """One for all tasks of a Python worker."""
    return Tokens()


class Template:
    """Template tokens of one text: hash and kind of each, and where its value is."""

    def __init__(self, text: bytes, tokens: Tokens):
        index = tokens.of(text.replace(b"\n", _BREAK).split())
        self.tokens = tokens
        if not len(index):
            self.hashes, self.kinds, self.index = np.zeros(0, np.uint64), np.zeros(0, np.int8), index
            self.words = self.hashes
            return
        start = np.ones(len(index), bool)
        start[1:] = tokens.ends[index[:-1]]
        kind = tokens.kind[index]
        kind[tokens.named[index] & ~start & (kind == LITERAL)] = NAME
        parts = tokens.parts[index]
        kept = parts > 0
        kind, index, parts = kind[kept], index[kept], parts[kept]
        after_number = np.zeros(len(kind), bool)
        after_number[1:] = (kind[:-1] == NUMBER) & (parts[:-1] == 1)
        kind[tokens.unit[index] & after_number] = UNIT
        self.index = np.repeat(index, parts)
        self.kinds = np.repeat(kind, parts)
        ends = np.cumsum(parts) - 1
        self.second = np.zeros(len(self.index), bool)
        self.second[ends[parts == 2]] = True
        self.kinds[self.second] = UNIT
        placeholders = np.array([0, 1, 2, 3], dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        self.words = tokens.hash[self.index]
        self.words[self.second] ^= placeholders[UNIT]
        self.hashes = np.where(self.kinds == LITERAL, tokens.hash[self.index], placeholders[self.kinds])

    def windows(self, width: int, min_literal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and hash of the windows, and whether it is one of words: these all, templates with enough literal tokens."""
        n = len(self.hashes) - width + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        template, words = np.full(n, width, np.uint64), np.full(n, _LITERAL_WINDOW + np.uint64(width), np.uint64)
        for out, hashes in ((template, self.hashes), (words, self.words)):
            for k in range(width):
                out *= _BASE
                out += hashes[k : k + n]
                out ^= out >> np.uint64(29)
        sums = np.r_[0, np.cumsum(self.kinds == LITERAL)]
        at = np.flatnonzero(sums[width:] - sums[:-width] >= min_literal)
        every = np.arange(n)
        literal = np.repeat([False, True], [len(at), n])
        return np.r_[at, every], np.r_[template[at], words], literal

    def slots(self, at: int, width: int) -> list[str]:
        """The values under the placeholders of a window, each after its kind."""
        out = []
        for i in (at + np.flatnonzero(self.kinds[at : at + width] != LITERAL)).tolist():
            own = int(self.index[i])
            value = self.tokens.glued[own] if self.second[i] else self.tokens.cores[own]
            out.append(f"{self.kinds[i]}{value.lower()}")
        return out


WINDOWS = "h long, at long, slots array<string>"


def _matches(width: int, wanted: np.ndarray | None):
    """Which of some hashes are wanted: a bit table first, then a search."""
    if wanted is None:
        return lambda h: np.ones(len(h), bool)
    bits = np.zeros(1 << 20, bool)
    bits[(wanted >> np.uint64(44)).astype(np.int64)] = True

    def of(h: np.ndarray) -> np.ndarray:
        hit = bits[(h >> np.uint64(44)).astype(np.int64)]
        some = np.flatnonzero(hit)
        place = np.minimum(np.searchsorted(wanted, h[some]), max(0, len(wanted) - 1))
        hit[some] = wanted[place] == h[some] if len(wanted) else False
        return hit

    return of


def template_windows(
    rows: DataFrame, width: int, min_literal: int, wanted=None, whole: bool = False, widths=None, min_words: int = 1
) -> DataFrame:
    """``doc_id`` and the windows of each text; with ``whole`` a shorter text is one window of its length.

    The slots of a window of words are null.

    ``widths`` are the window lengths to use (else ``width``), ``wanted`` a broadcast of the sorted hashes to keep.
    """

    def build():
        tokens, keep = _tokens(), _matches(width, wanted.value if wanted else None)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, hashes, starts, slots = [], [], [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), encoded(batch, "text")):
                template = Template(text, tokens)
                own = [min(width, len(template.hashes))] if whole else widths or [width]
                for length in own:
                    if length < min_words:
                        continue
                    at, h, literal = template.windows(length, min_literal)
                    hit = keep(h)
                    at, h, literal = at[hit], h[hit], literal[hit]
                    ids += [i] * len(at)
                    hashes.append(h)
                    starts.append(at)
                    slots += [None if words else template.slots(a, length) for a, words in zip(at.tolist(), literal.tolist())]
            h = np.concatenate([np.zeros(0, np.uint64), *hashes]).view(np.int64)
            at = np.concatenate([np.zeros(0, np.int64), *starts])
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(h), pa.array(at), pa.array(slots, pa.list_(pa.string()))],
                ["doc_id", "h", "at", "slots"],
            )

        return step

    return map_texts(rows, build, f"doc_id long, {WINDOWS}")


def _consistent(lines: DataFrame) -> DataFrame:
    """Of each alignment (at most one match for each of its item's windows) the windows that count and their pairs."""

    def chosen(windows: list[dict]) -> set[tuple[str, str]]:
        seen = Counter((a, b) for w in windows if w["own"] is not None for a, b in set(zip(w["item"], w["own"])))
        best, taken = {}, {}
        # the most frequent value first, equal ones before others
        for (a, b), _ in sorted(seen.items(), key=lambda x: (-x[1], x[0][0] != x[0][1], x[0])):
            name = a[0] == str(NAME)
            if a not in best and not (name and b in taken):
                best[a] = b
                if name:
                    taken[b] = a
        return set(best.items())

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        places, pairs = [], []
        for windows in batch.column("windows").to_pylist():
            good = chosen(windows)
            kept = [w for w in windows if w["own"] is None or w["own"] == w["item"] or set(zip(w["item"], w["own"])) <= good]
            places.append(sorted({w["item_at"] for w in kept}))
            own = {p for w in kept if w["own"] is not None for p in zip(w["item"], w["own"])}
            pairs.append([{"item": a, "own": b} for a, b in sorted(own)])
        pair = pa.struct([("item", pa.string()), ("own", pa.string())])
        columns = [*(batch.column(c) for c in ("doc_id", "item_id")), pa.array(places, pa.list_(pa.int64())), pa.array(pairs, pa.list_(pair))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "places", "pairs"])

    schema = "doc_id long, item_id long, places array<long>, pairs array<struct<item:string,own:string>>"
    return map_texts(lines, lambda: step, schema)


def contaminations(
    docs: DataFrame, benchmark: DataFrame, window: int = 8, min_literal: int = 4, min_share: float = 0.5, min_words: int = 3,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """A row for each contaminated document and item.

    ``doc_id, item_id, n_windows`` (matched), ``item_windows, share, n_slots`` and ``changed``, the slots with another value.
    """
    spark = docs.sparkSession
    items = benchmark.select(id_in(item_col), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    own = write_and_read(template_windows(items, window, min_literal, whole=True, min_words=min_words), "benchmark-windows")
    asked = own.select(F.col("doc_id").alias("item_id"), "h", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    widths = [w for w in _widths(items, window) if w >= min_words] or [window]
    count = own.count()
    wanted = None
    if count <= BROADCAST_WINDOWS:
        hashes = own.select("h").distinct().toArrow().column("h").to_numpy().astype(np.int64).view(np.uint64)
        wanted = spark.sparkContext.broadcast(np.sort(hashes))
    found = template_windows(ids_and_texts(docs, id_col, text_col), window, min_literal, wanted, widths=widths)
    small = F.broadcast(asked) if count <= BROADCAST_WINDOWS // 20 else asked
    hits = found.join(small, "h").where(F.size("slots").eqNullSafe(F.size("item_slots")))
    lines = hits.groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("_offset")).agg(
        F.sort_array(F.collect_set(F.struct("item_at", F.col("item_slots").alias("item"), F.col("slots").alias("own")))).alias("windows")
    )
    per_pair = _consistent(lines).groupBy("doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_windows"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    totals = asked.groupBy("item_id").agg(F.countDistinct("item_at").alias("item_windows"))
    share = F.col("n_windows") / F.col("item_windows")
    return per_pair.join(totals, "item_id").where(share >= min_share).select(
        id_out(), id_out("item_id"), "n_windows", "item_windows", share.alias("share"),
        F.size("pairs").cast("long").alias("n_slots"),
        F.size(F.filter("pairs", lambda p: p["item"] != p["own"])).cast("long").alias("changed"),
    )


def _widths(items: DataFrame, window: int) -> list[int]:
    """The window lengths that items have: ``window``, and those of shorter items."""
    def build():
        tokens = _tokens()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = {min(window, len(Template(t, tokens).hashes)) for t in encoded(batch, "text")}
            return pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], ["width"])

        return step

    rows = map_texts(items, build, "width long").distinct().collect()
    return sorted(r.width for r in rows if r.width) or [window]
