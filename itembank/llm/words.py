"""Words and shingles of Arrow text columns as 64-bit hashes, computed on the columns' bytes with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text and rows that are worked on at once; longer single texts are hashed window by window.
GROUP_BYTES, GROUP_ROWS, WINDOW = 2 << 20, 1024, 1 << 19
_ODD = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits each depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _byte_values() -> np.ndarray:
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


_VALUES = _byte_values()
#: The same with capitals as they are.
CASED = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def row_groups(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of each group of rows of a text column; null texts are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(at, at[row] + GROUP_BYTES, "right")) - 1
        stop = max(row + 1, min(stop, row + GROUP_ROWS, len(column)))
        yield row, data[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words end at ASCII white space and at the end of their text."""
    return runs(~_SPACE[data], at)


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of places that are inside words."""
    if not len(inside):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    first = np.zeros(len(inside) + 1, dtype=bool)
    first[at] = True
    before = np.concatenate(([False], inside[:-1])) & ~first[:-1]
    after = np.concatenate((inside[1:], [False])) & ~first[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _VALUES) -> np.ndarray:
    """A 64-bit hash of each word, by default with A-Z as a-z: differences of prefix sums of a polynomial in the values of its letters."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + WINDOW, "right")))
        hi = ends[j - 1]
        up, down = _power_tables(max(WINDOW, int(hi - lo)) + 1)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(values[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def letter_places(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The place of each byte in its word, from 1; for bytes between words, counted on from the word before."""
    at = np.arange(len(data), dtype=np.int64)
    first = np.zeros(len(data), dtype=np.int64)
    first[starts] = starts
    return (at - np.maximum.accumulate(first) + 1).astype(np.uint64)


def spread_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word with A-Z as a-z: the sum of a mix of each letter with its place, mixed with the length.

    A letter's part depends on its place in no simple way, so that no pattern of repeated letters cancels out, as it can in a polynomial. Seeds give
    independent hashes.
    """
    values = mix64(_VALUES + np.uint64(seed)) if seed else _VALUES
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + WINDOW, "right")))
        part = data[lo : ends[j - 1]]
        mixed = letter_places(part, starts[i:j] - lo)
        mixed *= np.uint64(_ODD)
        mixed += values[part]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(mixed, out=sums[1:])
        out[i:j] = mix64(sums[ends[i:j] - lo] - sums[starts[i:j] - lo] + (ends[i:j] - starts[i:j]).astype(np.uint64))
        i = j
    return out


class Seen:
    """A number for each 64-bit hash: an open-addressed table that is asked for whole arrays."""

    def __init__(self, bits: int = 16) -> None:
        self.n, self.keys, self.numbers = 0, np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, -1, dtype=np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Their numbers; -1 for those that are new."""
        mask = len(self.keys) - 1
        place, out, todo = (hashes & np.uint64(mask)).astype(np.int64), np.full(len(hashes), -1, dtype=np.int64), np.arange(len(hashes))
        while len(todo):
            number, key = self.numbers[place], self.keys[place]
            hit = (number >= 0) & (key == hashes[todo])
            out[todo[hit]] = number[hit]
            on = (number >= 0) & ~hit
            todo, place = todo[on], (place[on] + 1) & mask
        return out

    def add(self, hashes: np.ndarray, first: int) -> None:
        """Numbers from first on for distinct hashes that are new."""
        while 2 * (self.n + len(hashes)) > len(self.keys):
            old = self.numbers >= 0
            keys, numbers = self.keys[old], self.numbers[old]
            self.keys, self.numbers = np.zeros(2 * len(self.keys), dtype=np.uint64), np.full(2 * len(self.keys), -1, dtype=np.int64)
            self._put(keys, numbers)
        self._put(hashes, np.arange(first, first + len(hashes)))
        self.n += len(hashes)

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        mask = len(self.keys) - 1
        place, todo = (keys & np.uint64(mask)).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = np.flatnonzero(self.numbers[place] < 0)
            at, first = np.unique(place[free], return_index=True)
            won = free[first]
            self.keys[at], self.numbers[at] = keys[todo[won]], numbers[todo[won]]
            on = np.ones(len(todo), dtype=bool)
            on[won] = False
            todo, place = todo[on], (place[on] + 1) & mask


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text, ascending, and the offsets of the texts in them; seeds give independent hashes.

    A text of fewer than k words has its whole sequence of words as one shingle; one without words has none.
    """
    starts, ends, row = word_bounds(data, at)
    words, n = spread_hashes(data, starts, ends, seed), len(at) - 1
    count = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    to = np.concatenate(([0], np.cumsum(made)))
    text = np.repeat(np.arange(n), made)
    start = first[text] + (np.arange(to[-1]) - to[text])
    shingles = np.zeros(to[-1], dtype=np.uint64)
    for i in range(k):
        there = start + i < first[text + 1]
        w = np.where(there, words[np.minimum(start + i, max(len(words) - 1, 0))], np.uint64(0)) if len(words) else shingles
        shingles = mix64(shingles * np.uint64(_ODD) + w + np.uint64(i + 1))
    for t in np.flatnonzero(made > 1):
        shingles[to[t] : to[t + 1]].sort()
    new = np.ones(len(shingles), dtype=bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (text[1:] != text[:-1])
    return shingles[new], np.concatenate(([0], np.cumsum(np.bincount(text[new], minlength=n))))
