"""Multikey quicksort of equally long byte strings, all segments at a time, in numpy.

A character is eight bytes. A segment of strings that agree in all characters before is
parted by a pivot into smaller, equal and larger; the equal part goes on with the next
character, the others with the same one. A part of one string is in its place.
"""

from __future__ import annotations

import numpy as np

CHARACTER = 8


def characters(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number of the same order; zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(CHARACTER, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(CHARACTER):
        out <<= np.uint64(8)
        out |= padded[k : k + len(data)]
    return out


def equal_groups(data: np.ndarray, starts: np.ndarray, length: int, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``starts`` of strings that equal another one, sorted, and the group of each.

    Strings are ``data[start : start + length]``. Those that equal no other are left out.
    ``apart`` gives small numbers, of which different ones are known to mean different strings.
    """
    values = characters(data)
    # the last character ends with the string, over bytes seen before where the length is no multiple
    offsets = [min(k, max(length - CHARACTER, 0)) for k in range(0, length, CHARACTER)]
    cover = np.uint64(0xFFFFFFFFFFFFFFFF)
    if length < CHARACTER:
        cover <<= np.uint64(8 * (CHARACTER - length))
    apart = np.zeros(len(starts), np.int64) if apart is None else apart
    shared = np.bincount(apart) > 1
    item = np.flatnonzero(shared[apart])
    segment = (np.cumsum(shared) - 1)[apart[item]]
    order = np.argsort(segment, kind="stable")
    item, segment = item[order], segment[order]
    depth = np.zeros(int(shared.sum()), np.int64)  # characters known to be equal, for each segment
    offsets = np.array([*offsets, 0])
    done_items, done_groups, done = [], [], 0
    while len(item):
        sizes = np.bincount(segment, minlength=len(depth))
        begin = np.cumsum(sizes) - sizes
        own = values[starts[item] + offsets[depth][segment]] & cover
        # median of three
        three = np.sort(np.stack([own[begin], own[begin + sizes // 2], own[begin + sizes - 1]]), axis=0)
        pivot = three[1][segment]
        part = 3 * segment + (own >= pivot) + (own > pivot)
        order = np.argsort(part, kind="stable")
        item, part = item[order], part[order]
        sizes = np.bincount(part, minlength=3 * len(depth))
        deeper = np.repeat(depth, 3)
        deeper[1::3] += 1
        whole = (deeper >= len(offsets) - 1) & (sizes > 1)
        alive = (sizes > 1) & ~whole
        finished = whole[part]
        if finished.any():
            number = np.cumsum(whole) - 1
            done_items.append(item[finished])
            done_groups.append(number[part[finished]] + done)
            done += int(whole.sum())
        stay = alive[part]
        number = np.cumsum(alive) - 1
        item, segment, depth = item[stay], number[part[stay]], deeper[alive]
    if not done_items:
        none = np.zeros(0, np.int64)
        return none, none
    return np.concatenate(done_items), np.concatenate(done_groups)
