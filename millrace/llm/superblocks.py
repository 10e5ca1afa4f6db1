"""Cuts a text into blocks such that equal strings of a given length meet in one group, aligned.

A text is a sequence of symbols: its bytes, or its words (each a 64-bit hash). Each start of a
string of ``length`` symbols is owned by the smallest k-gram (by a mixed rolling hash) inside the
string, the leftmost of equal ones. That choice depends on the string alone, so equal strings have
the same k-gram at the same relative place. Consecutive starts with the same k-gram form a run; a
run's block holds the symbols of all its strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

GRAM = 128
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POSITION_BITS = 24
#: Texts are handled in stretches of so many symbols, which overlap by a string, so that a place fits its bits.
STRETCH = 1 << 20


@dataclass(frozen=True)
class Symbols:
    """A text as symbols; symbol i covers the bytes from starts[i] to ends[i] (with bytes as symbols: byte i)."""

    values: np.ndarray
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def bounds(self, first: int, last: int) -> tuple[int, int]:
        """Bytes of the symbols from ``first`` to before ``last``."""
        return (first, last) if self.starts is None else (int(self.starts[first]), int(self.ends[last - 1]))


def as_bytes(raw: bytes) -> Symbols:
    return Symbols(np.frombuffer(raw, np.uint8))


_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False


def as_words(raw: bytes) -> Symbols:
    """Words ``[^\\x20\\x09-\\x0D]+``, hashed as polynomials over their bytes."""
    data = np.frombuffer(raw, np.uint8)
    inside = _IN_WORD[data]
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    turns = np.concatenate([np.zeros(int(len(data) > 0 and inside[0]), np.int64), turns, np.full(int(len(data) > 0 and inside[-1]), len(data))])
    starts, ends = turns[0::2], turns[1::2]
    powers, inverse = _powers()
    hashes = np.zeros(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # words of one stretch, or one word that is longer
        origin = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, origin + len(powers), side="right")))
        part = data[origin : ends[last - 1]].astype(np.uint64) + np.uint64(1)
        part *= powers[: len(part)] if len(part) <= len(powers) else np.resize(powers, len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        a = starts[first:last] - origin
        hashes[first:last] = (sums[ends[first:last] - origin] - sums[a]) * inverse[a]
        first = last
    return Symbols(_mixed(hashes), starts, ends)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, as far as a stretch reaches."""
    out = []
    for base in (_ODD, _INVERSE):
        x = np.full(STRETCH + (1 << 16), base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-gram: polynomial over symbols by prefix sums modulo 2^64, then mixed."""
    n = len(data)
    powers, inverse = _powers()
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    return _mixed((sums[k:] - sums[:-k]) * inverse[: n - k + 1])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values: block-wise prefix and suffix minima."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[:n], prefix[width - 1 : width - 1 + n])


def runs(data: np.ndarray, length: int, k: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first start, number of starts, place of the k-gram) of each run of a text's symbols."""
    keys, starts, counts, places = [], [], [], []
    step = STRETCH
    for at in range(0, max(0, len(data) - length + 1), step):
        part = data[at : at + step + length - 1]
        h = gram_hashes(part, k)
        packed = (h & ~np.uint64((1 << _POSITION_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
        owner = (sliding_min(packed, length - k + 1) & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        place = owner[first]
        keys.append(h[place].view(np.int64))
        starts.append(first + at)
        counts.append(np.diff(np.append(first, len(owner))))
        places.append(place + at)
    if not keys:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in (keys, starts, counts, places))


def joined_runs(values: np.ndarray, bounds: np.ndarray, length: int, k: int = GRAM) -> tuple[np.ndarray, ...]:
    """The same for several texts that lie one after the other in ``values``, text i from bounds[i] to bounds[i + 1]: (text, key, first
    start, number of starts, place), with starts and places counted in ``values``."""
    if len(bounds) == 2:
        found = runs(values, length, k)
        return np.zeros(len(found[0]), np.int64), *found
    none = np.zeros(0, np.int64)
    windows = len(values) - length + 1
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(text[:windows] == text[length - 1 :]) if windows > 0 else none
    if not len(at):
        return none, none, none, none, none
    h = gram_hashes(values, k)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    owner = (sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - k + 1)[at] & low).astype(np.int64)
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)))
    start, place = at[first], owner[first]
    return text[start], h[place].view(np.int64), start, np.diff(np.append(first, len(at))), place


def text_groups(raws: list[bytes], most: int = 1 << 16) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of at most ``most`` bytes together, or one longer text, with the index of the first: arrays of texts one by one would
    be too short to be worth their calls."""
    first, size = 0, 0
    for i, raw in enumerate(raws):
        if i > first and size + len(raw) > most:
            yield first, raws[first:i]
            first, size = i, 0
        size += len(raw)
    if raws:
        yield first, raws[first:]


def joined(raws: list[bytes], split: Callable[[bytes], Symbols]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols one after the other, and their bounds. A blank between texts keeps words apart; as bytes it isn't there."""
    gap = b"" if split is as_bytes else b" "
    found = split(gap.join(raws))
    offsets = np.cumsum([0, *(len(r) + len(gap) for r in raws)])
    return found.values, offsets if found.starts is None else np.append(np.searchsorted(found.starts, offsets[:-1]), len(found.values))
