"""Suffix array of a block of bytes by two-stage sorting, and the adjacent common prefixes."""

from __future__ import annotations

import numpy as np


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor (the last one is not)."""
    n = len(data)
    differs = np.append(data[1:] != data[:-1], True)
    # the first place from i on whose byte differs from the next one decides for i
    deciding = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    rising = np.append(data[1:] > data[:-1], False)
    return rising[deciding]


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    n, out = len(data), np.zeros(len(data), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j:j + n]
    return out


def sorted_directly(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` by the ``depth`` bytes that follow them; ties in text order."""
    n = len(words)
    order, group = places.copy(), np.zeros(len(places), np.int64)
    unsettled = np.arange(len(places))
    for skip in range(0, depth, 8):
        if not len(unsettled):
            break
        at = order[unsettled] + skip
        word = np.where(at < n, words[np.minimum(at, n - 1)], 0)
        held = np.clip(n - at, 0, 8)  # a text that ends comes before one that goes on with zero bytes
        by = np.lexsort((held, word, group[unsettled]))
        order[unsettled] = order[unsettled][by]
        word, held, of = word[by], held[by], group[unsettled]  # groups are runs of places and stay where they are
        new = np.concatenate([[True], (word[1:] != word[:-1]) | (held[1:] != held[:-1]) | (of[1:] != of[:-1])])
        group[unsettled] = unsettled[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        many = np.bincount(np.cumsum(new) - 1)
        unsettled = unsettled[np.repeat(many > 1, many)]
    return order


def suffix_array(data: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """Places of all suffixes, sorted by their first ``depth`` bytes at least.

    Stage one sorts directly the suffixes that are smaller than their successors. Stage two induces the rest: a
    suffix that is greater than its successor follows from the successor's place, so each bucket (suffixes by
    first byte), scanned in order once it is complete, yields the others in their buckets' order. Within a
    bucket, suffixes that repeat its byte are induced in rounds.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    words = words_at(data) if words is None else words
    rising = smaller_than_next(data)
    direct = sorted_directly(words, np.flatnonzero(rising), depth)
    of_byte = np.searchsorted(data[direct], np.arange(257)) if len(direct) else np.zeros(257, int)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[-1]].append(np.array([n - 1]))
    out = []
    for byte in range(256):
        scanned = waiting[byte]
        turn = np.concatenate(scanned) if scanned else np.empty(0, np.int64)
        done = [turn]
        while len(turn):
            before = turn[turn > 0] - 1
            turn = before[(data[before] == byte) & ~rising[before]]
            done.append(turn)
        done.append(direct[of_byte[byte]:of_byte[byte + 1]])
        bucket = np.concatenate(done)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(data[before] > byte) & ~rising[before]]
        if len(before):
            by = np.argsort(data[before], kind="stable")
            before = before[by]
            values, first = np.unique(data[before], return_index=True)
            for value, part in zip(values, np.split(before, first[1:])):
                waiting[value].append(part)
        waiting[byte] = []
    return np.concatenate(out)


def common_prefixes(words: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each pair of suffixes, up to ``depth``."""
    n, length = len(words), np.zeros(len(left), np.int64)
    going = np.arange(len(left))
    for skip in range(0, depth, 8):
        a, b = left[going] + skip, right[going] + skip
        inside = (a < n) & (b < n)
        going, a, b = going[inside], a[inside], b[inside]
        differ = words[a] ^ words[b]
        bits = np.zeros(len(differ), np.int64)  # leading equal bytes
        for j in range(8):
            bits += (differ >> np.uint64(56 - 8 * j)) == 0
        length[going] = np.minimum(skip + bits, np.minimum(depth, n - np.maximum(left[going], right[going])))
        going = going[bits == 8]
    return length
