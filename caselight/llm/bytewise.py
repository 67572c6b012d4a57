"""Vectorised helpers on UTF-8 bytes: slices of Arrow columns, words and their hashes."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once inside a task; one longer text is handled alone.
SLICE_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _scramble(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def scramble(x: np.ndarray, seed: int = 0) -> np.ndarray:
    return _scramble(x + np.uint64(_ODD * (seed + 1) & _MASK))


class PrefixHash:
    """Polynomial hashes of any span of a byte buffer from one running sum, modulo 2^64.

    The base is odd, so its powers have inverses and a span's hash does not depend on where
    the span lies. Each byte counts as a fixed random 64-bit number.
    """

    def __init__(self, seed: int) -> None:
        self.seed = seed
        self.letters = scramble(np.arange(256, dtype=np.uint64), seed)
        self.base = int(scramble(np.array([seed], np.uint64), 77)[0]) | 1
        self.inverse_base = pow(self.base, -1, 1 << 64)
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def __reduce__(self):
        # A task gets the one instance of its process, not a copy of the tables.
        return prefix_hash, (self.seed,)

    def _grow(self, n: int) -> None:
        if len(self.powers) > n:
            return
        n = max(n + 1, SLICE_BYTES + 1)
        for name, base in (("powers", self.base), ("inverses", self.inverse_base)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            setattr(self, name, np.multiply.accumulate(factors))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.powers[: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash per span; its length takes part."""
        raw = (sums[end] - sums[start]) * self.inverses[start]
        return scramble(raw ^ (end - start).astype(np.uint64) * np.uint64(_ODD))


@functools.cache
def prefix_hash(seed: int) -> PrefixHash:
    _MADE.append(made := PrefixHash(seed))
    return made


_MADE: list[PrefixHash] = []


def forget_tables() -> None:
    """Let go of all tables of powers in this process; they grow again when they are needed."""
    for made in _MADE:
        made.powers = made.inverses = np.ones(1, np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string column as one byte array, and their bounds; null is empty."""
    filled = pc.fill_null(column, "")
    if not pa.types.is_large_string(filled.type):
        filled = filled.cast(pa.large_string())
    bounds = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset :][: len(filled) + 1]
    data = filled.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) of runs of rows of at most ``most`` bytes.

    A text longer than that is a run of its own.
    """
    data, bounds = text_bytes(column)
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of ``inside``; none crosses a bound."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(inside) + 1, bool)
    before[0], before[1:] = False, inside
    after = np.empty(len(inside) + 1, bool)
    after[:-1], after[-1] = inside, False
    edge = before != after
    cuts = bounds[1:-1]
    cuts = cuts[before[cuts] & after[cuts]]
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    if len(cuts):
        cuts = np.unique(cuts)
        starts, ends = np.sort(np.r_[starts, cuts]), np.sort(np.r_[ends, cuts])
    return starts.astype(np.int64), ends.astype(np.int64)


def owners(positions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Row of each byte position; empty rows own none."""
    return np.searchsorted(bounds, positions, "right") - 1
