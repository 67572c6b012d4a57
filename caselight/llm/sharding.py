"""Operator 11: documents dealt to shards of nearly equal bytes, by sampled splitters.

Method: the records are put in the order of a key and cut into many ranges. A sample of keys is
drawn, each row with a chance in proportion to its weight (its share of all bytes plus its share of
all rows), and quantiles of the sample become the splitters. All rows of each range are then counted.
Ranges that came out overfull are sampled again, within themselves, and subdivided, until none is
overfull. Last, neighbouring ranges are joined to shards, cut where the exact running sum of bytes is
nearest to equal parts.

The key is the hash of the text, then the id, then a number of the row, so equal texts stand side by
side. The first splitters fall between texts only: equal texts share a range unless they alone
overfill it, and only then are they split by id. A shard, too, ends between different texts where
such a place lies within ``LEEWAY`` of the equal share. Keys of two rows always differ, so a group of
copies, or of rows equal in everything, can be split as finely as any other.

Chances come from hashes of the keys: the same table gives the same shards. The driver holds the
sample (about ``RANGES * PER_RANGE`` keys) and one entry per range, whatever the number of rows. Rows
are numbered within their range; a range holds few rows because rows count in the weight, not only bytes.

Law: ``bytes``. A shard's bytes differ from the equal share by at most ``LEEWAY`` of it, or by what one range holds
(twice its equal share at most, unless a single document is larger).

Defined cases: null texts have size 1, as empty ones, and the checksum of no bytes; rows without id
come after those with one; fewer rows than shards leave shards empty; an empty table gives no rows;
other columns stay, but one named as a column made here (``size``, ``text_crc32``, ``law``, ``shard``, ``slot``,
``grown_shard``) is replaced by it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselight.llm.shared import checkpointed

SHARDS = 8
RANGES = 4096
#: Sampled keys for each range.
PER_RANGE = 8
#: A range is overfull with more than this many equal shares, its largest row left out.
OVERFULL = 2.0
#: How far from the equal share, as a part of a shard, a cut may move to stand between different texts.
LEEWAY = 0.01
MADE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
_LAST = (1 << 63) - 1

Key = tuple[int, int, int]


@dataclass(frozen=True)
class Ranges:
    """Ranges of keys; a range holds the keys up to its upper key and above the one before."""

    upper: tuple[Key, ...]

    def of(self, h: np.ndarray, d: np.ndarray, s: np.ndarray) -> np.ndarray:
        """The number of the range of each key."""
        first = np.array([k[0] for k in self.upper], np.int64)
        found = np.searchsorted(first, h, "left")
        within = np.flatnonzero((found < len(first)) & (first[np.minimum(found, len(first) - 1)] == h)) if len(first) else []
        for i in within:  # keys whose text is that of a splitter
            found[i] = bisect_left(self.upper, (int(h[i]), int(d[i]), int(s[i])))
        return found


def _keyed(docs: DataFrame, kept: list[str]) -> DataFrame:
    """The kept columns as x0, x1 and so on with size, checksum and key, written once: the numbers in
    the keys must not change."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return checkpointed(
        docs.select(
            *[F.col(f"`{n}`").alias(f"x{i}") for i, n in enumerate(kept)],
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"),
            F.monotonically_increasing_id().alias("s"),
        )
    )


def _weight(total: int, rows: int) -> Column:
    return F.col("size") / F.lit(float(total)) + F.lit(1.0 / rows)


def _drawn(rows: DataFrame, chance: Column, seed: int) -> DataFrame:
    even = (F.xxhash64("h", "d", "s", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) + 0.5) / F.lit(2.0**53)
    return rows.filter(even < chance)


def _quantiles(sample: list[tuple[Key, float]], parts: int) -> list[Key]:
    """Keys that cut the weighted sample into that many parts of about equal weight."""
    keys = sorted(sample)
    reached = np.cumsum([w for _, w in keys])
    at = np.searchsorted(reached, reached[-1] * np.arange(1, parts) / parts) if keys else []
    return [keys[min(int(i), len(keys) - 1)][0] for i in at]


def _placed(rows: DataFrame, ranges: Ranges) -> DataFrame:
    """The rows with the number of their range."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, d, s = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "d", "s"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ranges.of(h, d, s), pa.int32())], [*batch.schema.names, "range"]
            )

    return rows.mapInArrow(place, T.StructType([*rows.schema.fields, T.StructField("range", T.IntegerType())]))


@dataclass(frozen=True)
class Plan:
    ranges: Ranges
    shard: list[int]
    #: Rows of the same shard in earlier ranges.
    before: list[int]


def _counted(rows: DataFrame, ranges: Ranges, total: int, n: int) -> dict[int, tuple[int, int, float, float]]:
    """Rows, bytes, weight and largest weight of each range that has rows."""
    weight = _weight(total, n)
    counts = (
        _placed(rows.select("size", "h", "d", "s"), ranges)
        .groupBy("range")
        .agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum(weight).alias("w"), F.max(weight).alias("most"))
    )
    return {r["range"]: (r["n"], r["size"], r["w"], r["most"]) for r in counts.collect()}


def plan(rows: DataFrame, shards: int = SHARDS, parts: int = RANGES, per_range: int = PER_RANGE) -> Plan:
    """Ranges, none of them overfull, and the shard of each."""
    all_rows = rows.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    n, total = all_rows["n"], all_rows["size"]
    if n == 0:
        return Plan(Ranges(()), [0], [0])
    share = 2.0 / parts  # weights add up to 2
    chance = _weight(total, n) * F.lit(per_range / share)
    drawn = _drawn(rows, chance, 0).select("h", F.greatest(chance, F.lit(1.0)).alias("w")).collect()
    # Splitters between texts: the range ends with the last row of the sampled text.
    sample = [((r["h"], _LAST, _LAST), r["w"]) for r in drawn]
    upper = sorted(set(_quantiles(sample, parts)))
    seed = 0
    while True:
        ranges = Ranges(tuple(upper))
        counts = _counted(rows, ranges, total, n)
        overfull = {i: w for i, (k, _, w, most) in counts.items() if k > 1 and w - most > OVERFULL * share}
        if not overfull:
            break
        seed += 1
        upper = sorted({*upper, *_subdivided(rows, ranges, overfull, chance, share, per_range, seed)})
    cuts = _cuts(upper, counts, total, shards)
    shard = [bisect_left(cuts, i) for i in range(len(upper) + 1)]
    before, running = [], [0] * (shards + 1)
    for i, at in enumerate(shard):
        before.append(running[at])
        running[at] += counts.get(i, (0,))[0]
    return Plan(ranges, shard, before)


def _subdivided(rows, ranges, overfull, chance, share, per_range, seed) -> list[Key]:
    """New splitters inside the overfull ranges, from samples of whole keys there."""
    inside = _placed(rows.select("size", "h", "d", "s"), ranges).filter(F.col("range").isin(list(overfull)))
    drawn = _drawn(inside, chance, seed).select("range", "h", "d", "s", F.greatest(chance, F.lit(1.0)).alias("w"))
    samples: dict[int, list[tuple[Key, float]]] = {}
    for r in drawn.collect():
        samples.setdefault(r["range"], []).append(((r["h"], r["d"], r["s"]), r["w"]))
    found = []
    for i, sample in samples.items():
        found += _quantiles(sample, int(overfull[i] / share) + 1)
    return found


def _cuts(upper: list[Key], counts: dict, total: int, shards: int) -> list[int]:
    """The last range of each shard but the last one."""
    reached = np.cumsum([counts.get(i, (0, 0))[1] for i in range(len(upper) + 1)])
    between = np.array([k[1:] == (_LAST, _LAST) for k in upper] + [True])
    cuts: list[int] = []
    for part in range(1, shards):
        away = np.abs(reached - total * part / shards)
        fair = between & (away <= total / shards * LEEWAY / 2)
        cuts.append(int(np.argmin(np.where(fair, away, np.inf) if fair.any() else away)))
    return cuts


def _sharded(docs: DataFrame, kept: list[str], shards: int, parts: int) -> DataFrame:
    rows = _keyed(docs, kept)
    made = plan(rows, shards, parts)
    table = rows.sparkSession.createDataFrame(
        [(i, s, b) for i, (s, b) in enumerate(zip(made.shard, made.before))],
        "range int, shard int, before long",
    )
    # One entry per range: its size does not depend on the rows.
    placed = _placed(rows, made.ranges).join(F.broadcast(table), "range")
    within = F.row_number().over(Window.partitionBy("range").orderBy("h", "d", "s"))
    return placed.select(
        *[F.col(f"x{i}").alias(n) for i, n in enumerate(kept)],
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + within - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, parts: int = RANGES) -> DataFrame:
    """The given columns, and each row's size, checksum, law, shard and place in the shard."""
    return _sharded(docs, [n for n in docs.columns if n not in MADE], shards, parts)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, parts: int = RANGES) -> None:
    """The sharded rows as Parquet, one folder per shard, in the order of their places in each file."""
    rows = shard_documents(docs, shards, parts)
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, checksum, law, shard and slot of each document, and no grown shard."""
    return _sharded(docs, ["doc_id"], shards, RANGES)
