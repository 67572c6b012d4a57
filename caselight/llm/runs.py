"""Operator 12: runs of periodic words (maximal repetitions) in each text, and texts without the repeats.

Method: multi-scale minimizers. A run of period q repeats every block of its words q words later.
At scale w, blocks of w / 4 words are hashed, and a block is a minimizer if its hash is the least of
some w / 2 neighbouring blocks. Windows q words apart inside a run hold the same blocks, so their
minimizers lie q words apart, too: pairs of equal minimizers at a distance from w to 2 w seed the
periods of that scale, and each seed is extended both ways as far as the words agree. Scales double
from ``FIRST_SCALE``; shorter periods are found by comparing the words with those q words later.

Blocks that are periodic themselves (by a period up to half their length) are no minimizers: they
lie in runs that an earlier scale has found, and would pair with all their neighbours. A run of
which every block of its first period is periodic consists of two shorter runs of one period that
touch; such neighbours seed the periods at which they agree. With this every run is found, and a
block has at most 16 partners at a scale, whatever the text.

Seeds are extended by binary search over hashes of stretches (two 31-bit primes); two different
stretches of equal hash are possible in principle.

Texts are independent: there is no shuffle, and one text is held by one task. Time and memory grow
with its length (times the number of scales).

Defined cases: null and empty texts and texts without words have no runs and an empty collapsed text;
repeated rows give repeated results; a null id stays null; an empty table gives no rows; other columns
are ignored by ``find_runs`` and ``report`` and kept by ``collapse``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH = 12
#: Shorter periods are found by direct comparison; a block of the first scale has a quarter of it.
FIRST_SCALE = 48
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_PRIMES = (2_147_483_647, 2_147_483_629)
_BASES = (1_000_003, 1_299_709)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text or "")


def numbered(words: list[str]) -> np.ndarray:
    """The words as numbers, equal ones alike."""
    known: dict[str, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


class _Hashes:
    """Hashes of any stretch of a sequence, by prefix sums modulo two primes."""

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        self.n, self.powers, self.sums = n, [], []
        for prime, base in zip(_PRIMES, _BASES):
            power = np.ones(n + 1, np.int64)
            have = 1
            while have <= n:  # powers of the base, doubling what is known
                more = min(have, n + 1 - have)
                power[have : have + more] = power[:more] * (power[have - 1] * base % prime) % prime
                have += more
            letters = _mixed(ids) % np.uint64(prime)
            terms = letters.astype(np.int64) * power[:n] % prime
            self.powers.append(power)
            self.sums.append(np.concatenate([[0], np.cumsum(terms)]) % prime)

    def equal(self, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of that length at x and at y (x <= y) are equal."""
        same = np.ones(len(x), bool)
        for prime, power, sums in zip(_PRIMES, self.powers, self.sums):
            left = (sums[x + length] - sums[x]) % prime * power[y - x] % prime
            same &= left == (sums[y + length] - sums[y]) % prime
        return same

    def blocks(self, length: int) -> np.ndarray:
        """One 64-bit number for each stretch of that length, equal for equal stretches."""
        parts = []
        for prime, power, sums in zip(_PRIMES, self.powers, self.sums):
            raw = (sums[length:] - sums[: self.n + 1 - length]) % prime
            parts.append(raw * power[self.n - np.arange(len(raw))] % prime)
        return _mixed(parts[0] << 32 | parts[1]) >> np.uint64(1)


def _mixed(values: np.ndarray) -> np.ndarray:
    z = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _slid(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every window of that width."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = pick(values[:-step], values[step:])
        have += step
    return values


def _by_lag(ids: np.ndarray, lag: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the stretches of period ``lag``."""
    same = ids[lag:] == ids[:-lag]
    need = max(lag, least - lag)
    if np.count_nonzero(same) < need:
        return
    breaks = np.concatenate([[-1], np.flatnonzero(~same), [len(same)]])
    for i in np.flatnonzero(np.diff(breaks) > need):
        yield int(breaks[i]) + 1, int(breaks[i + 1] - breaks[i]) - 1 + lag


def _extended(hashes: _Hashes, at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the stretch around each position where words agree with those ``lag`` later."""
    n = hashes.n
    low, high = np.zeros(len(at), np.int64), n - at - lag
    while (low < high).any():  # how far they agree from the position on
        half = (low + high + 1) // 2
        agree = hashes.equal(at, at + lag, half)
        low, high = np.where(agree, half, low), np.where(agree, high, half - 1)
    end = at + low
    low, high = np.zeros(len(at), np.int64), at.copy()
    while (low < high).any():  # and before it
        half = (low + high + 1) // 2
        agree = hashes.equal(at - half, at - half + lag, half)
        low, high = np.where(agree, half, low), np.where(agree, high, half - 1)
    return at - low, end


def _minimizer_seeds(hashes: _Hashes, scale: int, found: dict) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of equal minimizers, the distances from ``scale`` to twice that."""
    block, width = scale // 4, scale // 2
    values = hashes.blocks(block)
    inside = np.zeros(len(values) + 1, np.int64)
    for (start, length), period in found.items():
        if 2 * period <= block <= length:
            inside[start] += 1
            inside[start + length - block + 1] -= 1
    values[np.cumsum(inside[:-1]) > 0] = _NONE
    least = _slid(values, width, np.minimum)
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero((_slid(around, width, np.maximum) == values) & (values != _NONE))
    order = chosen[np.argsort(values[chosen], kind="stable")]
    value = values[order]
    at, lag, step = [], [], 1
    while step < len(order):
        near = (value[step:] == value[:-step]) & (order[step:] - order[:-step] < 2 * scale)
        if not near.any():
            break
        far = near & (order[step:] - order[:-step] >= scale)
        at.append(order[:-step][far])
        lag.append((order[step:] - order[:-step])[far])
        step += 1
    nothing = np.zeros(0, np.int64)
    return np.concatenate([nothing, *at]), np.concatenate([nothing, *lag])


def _touching_seeds(hashes: _Hashes, scale: int, found: dict) -> tuple[np.ndarray, np.ndarray]:
    """Periods of this scale at which two runs of one shorter period that touch agree."""
    by_period: dict[int, list[tuple[int, int]]] = {}
    for (start, length), period in found.items():
        if 8 * period <= scale <= length:
            by_period.setdefault(period, []).append((start, start + length))
    at, lag = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for period, stretches in by_period.items():
        stretches.sort()
        for (start1, end1), (start2, end2) in zip(stretches, stretches[1:]):
            if start2 > end1:
                continue
            turn = start1 + np.arange(period)
            alike = np.flatnonzero(hashes.equal(turn, np.full(period, start2), np.full(period, period)))
            if not len(alike):
                continue
            shift = start2 - int(turn[alike[0]])
            lags = np.arange(scale + (shift - scale) % period, 2 * scale, period)
            first = np.maximum(start1, start2 - lags)
            agree = np.minimum(end1, end2 - lags) > first
            at.append(first[agree])
            lag.append(lags[agree])
    return np.concatenate(at), np.concatenate(lag)


def runs_of(ids: np.ndarray, least: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period.

    A run is a stretch with smallest period q and at least max(least, 2 q) words that no
    neighbouring word extends.
    """
    n = len(ids)
    if n < least:
        return []
    found: dict[tuple[int, int], int] = {}  # the smallest period is met first
    for lag in range(1, min(FIRST_SCALE, n // 2 + 1)):
        for stretch in _by_lag(ids, lag, least):
            found.setdefault(stretch, lag)
    scale, hashes = FIRST_SCALE, None
    while 2 * scale <= n:
        hashes = hashes or _Hashes(ids)
        seeds = [_minimizer_seeds(hashes, scale, found), _touching_seeds(hashes, scale, found)]
        at, lag = (np.concatenate(parts) for parts in zip(*seeds))
        if len(at):
            start, end = _extended(hashes, at, lag)
            long = (end - start >= lag) & (end - start + lag >= least)
            kept = np.unique(np.stack([lag[long], start[long], end[long]], axis=1), axis=0)
            for period, first, last in kept.tolist():
                found.setdefault((first, last - first + period), period)
        scale *= 2
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words are left when every run keeps its first period only."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return np.cumsum(gone[:-1]) == 0


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one in ten ids, which original word stands at each place once its end is made periodic."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + np.arange(n - a) % p
    return place


def _rows(batch: pa.RecordBatch, change: bool) -> Iterator[tuple]:
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
        words = words_of(text.as_py())
        ids = numbered(words)
        place = planted(doc_id, len(words)) if change else None
        if place is not None:
            ids = ids[place]
            words = [words[i] for i in place]
        yield doc_id, words, runs_of(ids)


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id and start, length and period (in words) of each run of each text."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *run) for d, _, runs in _rows(batch, False) for run in runs]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "period"]
            )

    return _narrow(docs).mapInArrow(found, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """The given columns, ``text`` with one space between its words and each run cut to its first period.

    A null text stays null.
    """

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                kept = kept_words(len(words), runs_of(numbered(words)))
                texts.append(" ".join(w for w, k in zip(words, kept) if k) if text.is_valid else None)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))

    rows = docs.withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(collapsed, rows.schema)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, words, runs in _rows(batch, True):
            start = length = period = power = None
            if runs:
                start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]))
                power = 1000 * length // period
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            kept = kept_words(len(words), runs)
            left = " ".join(w for w, k in zip(words, kept) if k)
            digests = [hashlib.sha256(t.encode()).hexdigest() for t in (listed, left)]
            rows.append((doc_id, len(words), len(runs), start, length, period, power, *digests))
        columns = list(zip(*rows)) or [[]] * 9
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _COLUMNS)


_COLUMNS = [
    "doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
]


def report(docs: DataFrame) -> DataFrame:
    """One row per document over its words, of which one document in ten has its end made periodic:
    number of runs, the longest one, and digests of all runs and of the collapsed text."""
    layout = ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in _COLUMNS)
    return _narrow(docs).mapInArrow(_digest, layout)
