"""Counting word sequences in a burstable trie, with sorted runs for what is spilled.

A trie holds paths of up to four word ids. Below the root there is one subtree per first
word: at first a hash container from the packed rest of a path to its count, and once
that has grown beyond ``BURST`` entries a node with one container per second word. Only
paths from each word on are inserted (the longest of them); shorter sequences are
prefixes and are summed up when a subtree is spilled.

A spill takes whole subtrees, the largest first. Their sequences are dealt out by the
hash of their words: single words by the first, pairs by two and longer ones by three
words, so each sequence is counted in one part and no frequent word makes a large one.
What goes to a part is a run: sequences in the byte order of their words, as columns of
positions in the run's own sorted word list, and counts.

``Seen`` counts hashes of words and of neighbours in tables of a fixed size. A slot's sum
is never below the count of a word or pair in it, so where it is too small no sequence
that is asked for can hold the word or the pair: paths end there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard

BITS = 21
MASK = (1 << BITS) - 1
#: Entries of a container beyond which it is burst.
BURST = 4_096
_MIX = np.uint64(0x9E3779B97F4A7C15)
_COLUMNS = 5


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    """Of the hashes of words in turn, those of each word and the next."""
    return _mixed(hashes[:-1] * _MIX + hashes[1:])


class Seen:
    """Counters of words and of neighbouring words by hash, each of ``1 << log2`` slots."""

    #: Counts are held in 16 bits and stop at ``FULL``, so that ``STEP`` more have room.
    FULL, STEP = 30_000, 30_000

    def __init__(self, log2: int):
        self.shift = np.uint64(64 - log2)
        self.tables = np.zeros((2, 1 << log2), np.uint16)

    def add(self, hashes: np.ndarray, own: int) -> None:
        """Hashes of words in turn, 0 between pieces; at most ``STEP`` words of their own and the next one."""
        real = hashes > 0
        for table, found in zip(self.tables, (hashes[:own][real[:own]], pair_hashes(hashes)[real[:-1] & real[1:]])):
            slots = (found >> self.shift).astype(np.int64)
            np.add.at(table, slots, np.uint16(1))
            table[slots] = np.minimum(table[slots], self.FULL)


class Filter:
    """Bits of the slots of ``Seen`` that reached a count."""

    def __init__(self, log2: int, bits: bytes):
        self.shift = 64 - log2
        self.words, self.pairs = np.frombuffer(bits, np.uint8).reshape(2, -1)

    def word(self, found: int) -> bool:
        slot = found >> self.shift
        return bool(self.words[slot >> 3] >> (7 - (slot & 7)) & 1)

    def pair(self, found: np.ndarray) -> np.ndarray:
        slots = (found >> np.uint64(self.shift)).astype(np.int64)
        return self.pairs[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1


def word_hash(word: bytes, seed: int) -> int:
    """Never 0, which stands between pieces."""
    return xxhash.xxh3_64_intdigest(word, seed) or 1


class _Ids(dict):
    """Numbers words from 1 as they come; 0 for a word that is too rare, which is not kept."""

    def __init__(self, stop: bytes, seed: int, known: Filter):
        super().__init__({stop: 0})
        self.seed, self.known, self.hashes = seed, known, [0]

    def __missing__(self, word: bytes) -> int:
        found = word_hash(word, self.seed)
        if not self.known.word(found):
            return 0
        self[word] = len(self)
        self.hashes.append(found)
        return self[word]


class PhraseTrie:
    """Paths of one language in one task; ``stop`` stands between pieces of text.

    ``paths`` is a bound of their number, and exact after ``count_paths``.
    """

    def __init__(self, stop: bytes, seed: int, known: Filter):
        self.stop, self.seed, self.known = stop, seed, known
        self.clear()

    def clear(self) -> None:
        self.ids = _Ids(self.stop, self.seed, self.known)
        self.hashes = np.zeros(1, np.uint64)
        self.tops: list[dict] = [{}]
        self.burst: set[int] = set()
        self.paths = 0

    def add(self, words: list[bytes], own: int) -> None:
        """The paths of the first ``own`` words; what follows them is context."""
        first = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        new = len(self.ids) - len(self.tops)
        if new:
            self.tops += [{} for _ in range(new)]
            self.hashes = np.concatenate([self.hashes, np.array(self.ids.hashes[-new:], np.uint64)])
        ahead = np.zeros((3, len(first) + 2), np.int64)
        ahead[0, : len(first) - 1] = first[1:] * ((first[:-1] > 0) & (self.known.pair(pair_hashes(self.hashes[first])) > 0))
        ahead[1, :-1] = ahead[0, 1:] * (ahead[0, :-1] > 0)
        ahead[2, :-2] = ahead[0, 2:] * (ahead[1, :-2] > 0)
        rest = (ahead[0] << 2 * BITS) | (ahead[1] << BITS) | ahead[2]
        real = np.flatnonzero(first[:own] > 0)
        self.paths += len(real)
        self._insert(first[real].tolist(), rest[real].tolist())

    def _insert(self, first: list[int], rest: list[int]) -> None:
        tops, burst = self.tops, self.burst
        for word, path in zip(first, rest):
            box = tops[word]
            if word in burst:
                second, path = path >> 2 * BITS, path & (MASK << BITS | MASK)
                box = box.get(second)
                if box is None:
                    box = tops[word][second] = {}
            box[path] = box.get(path, 0) + 1
        for word in set(first):
            if word not in burst and len(tops[word]) > BURST:
                self._burst(word)

    def _burst(self, word: int) -> None:
        node: dict[int, dict[int, int]] = {}
        for path, count in self.tops[word].items():
            node.setdefault(path >> 2 * BITS, {})[path & (MASK << BITS | MASK)] = count
        self.tops[word] = node
        self.burst.add(word)

    def _size(self, word: int) -> int:
        box = self.tops[word]
        return sum(map(len, box.values())) if word in self.burst else len(box)

    def count_paths(self) -> int:
        self.paths = sum(map(self._size, range(1, len(self.tops))))
        return self.paths

    def _entries(self, word: int) -> Iterator[tuple[dict, int]]:
        box = self.tops[word]
        if word in self.burst:
            for second, inner in box.items():
                yield inner, second << 2 * BITS
        else:
            yield box, 0

    def spill(self, least: int, parts: int) -> Iterator[tuple[int, bytes]]:
        """Runs (part, bytes) of the largest subtrees with ``least`` paths or more together; these are emptied."""
        sizes = {w: self._size(w) for w in range(1, len(self.tops)) if self.tops[w]}
        chosen, total = [], 0
        for word in sorted(sizes, key=lambda w: (-sizes[w], w)):
            if total >= least:
                break
            chosen.append(word)
            total += sizes[word]
        if not chosen:
            return
        rest, count = np.empty(total, np.int64), np.empty(total, np.int64)
        at = 0
        for word in chosen:
            for box, high in self._entries(word):
                n = len(box)
                rest[at : at + n] = np.fromiter(box, np.int64, n) | high
                count[at : at + n] = np.fromiter(box.values(), np.int64, n)
                at += n
            self.tops[word] = {}
            self.burst.discard(word)
        first = np.repeat(np.array(chosen, np.int64), [sizes[w] for w in chosen])
        self.count_paths()
        paths = np.stack([first, rest >> 2 * BITS, (rest >> BITS) & MASK, rest & MASK], 1)
        yield from self._runs(paths, count, parts)

    def spill_all(self, parts: int) -> Iterator[tuple[int, bytes]]:
        """Runs of everything; the words are forgotten too."""
        yield from self.spill(1 << 62, parts)
        self.clear()

    def _runs(self, paths: np.ndarray, count: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
        used = np.unique(paths)
        used = used[used > 0]
        known = list(self.ids)
        words = [known[i] for i in used.tolist()]
        order = sorted(range(len(words)), key=words.__getitem__)
        words = [words[i] for i in order]
        place = np.zeros(int(used[-1]) + 1, np.int64)
        place[used[np.array(order)]] = np.arange(1, len(words) + 1)
        hashes = np.append(np.uint64(0), self.hashes[used[np.array(order)]])
        paths, count = _summed(place[paths], count)
        ones, n_ones = _prefixes(paths, count, 1)
        twos, n_twos = _prefixes(paths[paths[:, 1] > 0], count[paths[:, 1] > 0], 2)
        long = paths[:, 2] > 0
        rows = np.concatenate([ones, twos, paths[long]])
        counts = np.concatenate([n_ones, n_twos, count[long]])
        # single words by the first, pairs by two, longer ones by three words
        route = hashes[rows[:, 0]]
        for k in (1, 2):
            route = np.where(rows[:, k] > 0, _mixed(route * _MIX + hashes[rows[:, k]]), route)
        part = (_mixed(route) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((rows[:, 2] << 32 | rows[:, 3], rows[:, 0] << 32 | rows[:, 1], part))
        part, rows, counts = part[order], rows[order], counts[order]
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        words = np.array([b"", *words], dtype=object)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield int(part[a]), write_run(words, rows[a:b], counts[a:b])


def _summed(paths: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted paths without repeats, and the sums of their counts."""
    if not len(paths):
        return paths, count
    order = np.lexsort((paths[:, 2] << 32 | paths[:, 3], paths[:, 0] << 32 | paths[:, 1]))
    paths, count = paths[order], count[order]
    new = np.flatnonzero(np.r_[True, (paths[1:] != paths[:-1]).any(1)])
    return paths[new], np.add.reduceat(count, new)


def _prefixes(paths: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted paths the prefixes of ``k`` words with the sums of their counts."""
    if not len(paths):
        return paths, count
    new = np.flatnonzero(np.r_[True, (paths[1:, :k] != paths[:-1, :k]).any(1)])
    heads = paths[new].copy()
    heads[:, k:] = 0
    return heads, np.add.reduceat(count, new)


def write_run(words: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted rows of positions in ``words`` (its first entry is none), as bytes with a word list of their own."""
    used, local = np.unique(rows, return_inverse=True)
    local = local.reshape(rows.shape).astype("<u4")
    if len(used) and used[0] > 0:
        local += 1
    text = b"\n".join(words[used[used > 0]].tolist())
    columns = [np.diff(local[:, 0].astype(np.int64), prepend=0).astype("<u4"), *local[:, 1:].T, counts.astype("<u8")]
    # bytes of one weight side by side, as most of the higher ones are zero
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    head = np.array([len(rows), len(text)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + text + planes)


def read_run(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Word list, rows of positions in it (from 1; 0: none) and counts."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, size = (int(x) for x in np.frombuffer(raw[:16], "<u8"))
    words = raw[16 : 16 + size].split(b"\n") if size else []
    planes = np.frombuffer(raw, np.uint8, offset=16 + size)
    rows = np.empty((n, 4), np.int64)
    for k in range(_COLUMNS - 1):
        column = np.ascontiguousarray(planes[4 * n * k : 4 * n * (k + 1)].reshape(4, n).T).view("<u4").ravel()
        rows[:, k] = np.cumsum(column.astype(np.int64)) if k == 0 else column
    counts = np.ascontiguousarray(planes[16 * n :].reshape(8, n).T).view("<u8").ravel().astype(np.int64)
    return words, rows, counts


class Merger:
    """Sorted runs of one part and language, merged in rounds of at most ``limit`` rows."""

    def __init__(self, limit: int = 2_000_000):
        self.limit, self.pending, self.runs = limit, 0, []
        self.words: list[bytes] = []
        self.rows, self.counts = np.empty((0, 4), np.int64), np.empty(0, np.int64)

    def add(self, data: bytes) -> None:
        run = read_run(data)
        self.runs.append(run)
        self.pending += len(run[1])
        if self.pending > max(self.limit, len(self.rows)):
            self.merge()

    def merge(self) -> None:
        runs = [(self.words, self.rows, self.counts), *self.runs]
        words = sorted(set().union(*(r[0] for r in runs)))
        place = {w: i for i, w in enumerate(words, 1)}
        rows = []
        for own, part, _ in runs:
            to = np.zeros(len(own) + 1, np.int64)
            to[1:] = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
            rows.append(to[part])
        self.words = words
        self.rows, self.counts = _summed(np.concatenate(rows), np.concatenate([r[2] for r in runs]))
        self.runs, self.pending = [], 0

    def frequent(self, least: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Phrases found ``least`` times or more, their numbers of words and counts."""
        self.merge()
        rows, counts = self.rows, self.counts
        short = rows[:, 2] == 0
        three, n_three = _prefixes(rows[~short], counts[~short], 3)
        four = rows[:, 3] > 0
        rows = np.concatenate([rows[short], three, rows[four]])
        counts = np.concatenate([counts[short], n_three, counts[four]])
        rows, counts = rows[counts >= least], counts[counts >= least]
        words = [b"", *self.words]
        phrases = [b" ".join(words[i] for i in row if i).decode() for row in rows.tolist()]
        return phrases, (rows > 0).sum(1), counts
