"""Operator 1: long byte strings that occur again, in one text or in several.

Method: prefix-free parsing. A rolling hash of a few bytes picks trigger places: the place with the
smallest hash in every stretch of ``length`` bytes. They cut texts into overlapping phrases, each
made of all stretches with one trigger, so equal stretches always lie at equal places of phrases
with equal triggers. The dictionary of distinct phrases, each with its first place in corpus order
(the parse), is far smaller than a repetitive corpus:

1. A phrase that is not the first of its kind repeats as a whole. Most repeats end here.
2. Different phrases with one trigger may share some stretches. The suffixes of these dictionary
   phrases, cut at ``length`` bytes, are sorted into a suffix array per trigger; as the phrases come
   in corpus order, the first of each run of equal suffixes is the first occurrence, and the others
   repeat it.

Phrases whose trigger occurs nowhere else need no comparison and leave after the first shuffle.
Copies within a batch are counted as repeats where they are read, so a text in a third of all
documents costs one set of phrases per batch. A trigger's phrases pass a task in order and
in bounded portions; of a portion only fingerprints of its stretches are remembered.

Corpus order is by ``doc_id``, then by place. Strings are judged on the input.

Defined cases: null or empty text has no bytes; texts shorter than ``length`` have no repeats; rows
without id come last, and rows equal in id are ordered by a hash of their text; rows equal in
both count as one document, whose result each of them gets; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselight.llm.bytewise import owners, prefix_hash, scramble, text_slices
from caselight.llm.shared import checkpointed, identified

LENGTH = 100
#: Bytes that the rolling hash sees.
TRIGGER = 24
#: Suffixes sorted at once inside a task.
SUFFIXES = 200_000
_HASH = prefix_hash(11)


def _least_in_each(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest key of every window of so many."""
    done = 1
    while 2 * done <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    return np.minimum(keys[: len(keys) - (width - done)], keys[width - done :])


def _phrases(data: np.ndarray, bounds: np.ndarray, length: int):
    """Start, number of stretches, trigger and fingerprint of each phrase."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    sums = _HASH.sums(data)
    at = np.arange(len(data) - TRIGGER + 1)
    hashes = _HASH.spans(sums, at, at + TRIGGER)
    low = np.uint64(int(len(data)).bit_length())
    keys = (hashes >> low << low) | at.astype(np.uint64)
    trigger = (_least_in_each(keys, length - TRIGGER + 1) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    # Stretches lie within one text.
    long_enough = np.diff(bounds) >= length
    edges = np.zeros(len(data) + 2, np.int32)
    np.add.at(edges, bounds[:-1][long_enough], 1)
    np.add.at(edges, bounds[1:][long_enough] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(edges[: len(trigger)]) > 0)
    if not len(start):
        return none, none, none.view(np.uint64), none.view(np.uint64)
    own = trigger[start]
    new = np.flatnonzero(np.r_[True, (start[1:] != start[:-1] + 1) | (own[1:] != own[:-1])])
    first, count = start[new], np.diff(np.r_[new, len(start)])
    return first, count, scramble(hashes[own[new]], 9), _HASH.spans(sums, first, first + count - 1 + length)


def _parse(length: int):
    """Batches of (d, tie, text) to one row per phrase."""

    def run(batches):
        for batch in batches:
            parts = []
            for begin, _, data, bounds in text_slices(batch.column(2)):
                first, count, trigger, phrase = _phrases(data, bounds, length)
                row = owners(first, bounds)
                parts.append((row + begin, first - bounds[row], count, trigger, phrase))
            if not parts:
                continue
            row, first, count, trigger, phrase = (np.concatenate(x) for x in zip(*parts, strict=True))
            d, tie = (np.asarray(batch.column(i))[row] for i in (0, 1))
            # Of equal phrases in this batch all but the first are repeats for certain.
            order = np.argsort(phrase, kind="stable")
            equal = np.flatnonzero(phrase[order[1:]] == phrase[order[:-1]])
            many = order[np.unique(np.concatenate([equal, equal + 1]))] if len(equal) else order[:0]
            many = many[np.lexsort((first[many], tie[many], d[many], phrase[many]))]
            repeats = many[1:][phrase[many[1:]] == phrase[many[:-1]]]
            sure = np.zeros(len(row), bool)
            sure[repeats] = True
            # They need no partner any more; a name of their own spreads them over the tasks.
            alone = scramble(phrase[repeats] + first[repeats].astype(np.uint64), 10) ^ d[repeats].view(np.uint64)
            trigger[repeats] = scramble(alone, 12)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(trigger.view(np.int64)), pa.array(phrase.view(np.int64)), pa.array(d), pa.array(tie),
                    pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(sure),
                ],
                ["trigger", "phrase", "d", "tie", "first", "count", "sure"],
            )

    return run


def _contents(length: int):
    """Texts with lists of phrases to the phrases' bytes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = {k: [] for k in ("trigger", "d", "tie", "first", "bytes")}
                for d, tie, text, wanted in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    data = (text or "").encode()
                    for w in wanted:
                        begin = w["first"]
                        row = (w["trigger"], d, tie, begin, data[begin : begin + w["count"] - 1 + length])
                        for k, v in zip(out, row, strict=True):
                            out[k].append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return run


def _repeating_suffixes(trigger: np.ndarray, phrases: list[bytes], length: int, earlier: np.ndarray):
    """(phrase, offset) of suffixes that occurred before, and fingerprints of the last trigger's.

    ``earlier`` holds fingerprints of the stretches that the first phrase's trigger had before.
    """
    data = np.frombuffer(b"".join(phrases), np.uint8)
    size = np.array([len(p) for p in phrases])
    count = size - length + 1
    owner = np.repeat(np.arange(len(phrases)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(np.cumsum(size) - size, count) + offset
    rows = np.empty((len(start), 8 + length), np.uint8)
    rows[:, :8] = trigger.view(np.uint8).reshape(-1, 8)[owner]
    rows[:, 8:] = np.lib.stride_tricks.sliding_window_view(data, length)[start]
    keys = rows.view(np.dtype((np.void, 8 + length))).ravel()
    # The suffix array of this portion of the dictionary; equal suffixes stay in corpus order.
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(order), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    sums = _HASH.sums(data)
    marks = _HASH.spans(sums, start, start + length)
    if len(earlier):
        begun = trigger[owner] == trigger[0]
        again |= begun & np.isin(marks, earlier)
    last = np.unique(marks[trigger[owner] == trigger[-1]])
    return owner[again], offset[again], last


def _compare(length: int):
    """Phrases by trigger, in corpus order, to the stretches that occurred before."""

    def portions(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(row)
                size += len(row[4]) - length + 1
                if size >= SUFFIXES:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def run(batches):
        open_, seen = None, np.zeros(0, np.uint64)
        for rows in portions(batches):
            trigger = np.array([r[0] for r in rows], np.int64)
            before = seen if trigger[0] == open_ else seen[:0]
            owner, offset, last = _repeating_suffixes(trigger, [r[4] for r in rows], length, before)
            seen = np.union1d(before, last) if trigger[-1] == trigger[0] else last
            open_ = trigger[-1]
            # Neighbouring stretches become one row.
            new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(owner) else offset
            count = np.diff(np.r_[new, len(owner)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][1] for i in owner[new]], pa.int64()),
                    pa.array([rows[i][2] for i in owner[new]], pa.int64()),
                    pa.array([rows[i][3] + int(o) for i, o in zip(owner[new], offset[new], strict=True)], pa.int32()),
                    pa.array(count, pa.int32()),
                ],
                ["d", "tie", "first", "count"],
            )

    return run


def _repeats(rows: DataFrame, length: int) -> DataFrame:
    """d, tie, first, count: runs of stretches that occurred before."""
    parsed = rows.mapInArrow(
        _parse(length), "trigger long, phrase long, d long, tie long, first int, count int, sure boolean"
    )
    one_phrase = Window.partitionBy("trigger", "phrase").orderBy("d", "tie", "first")
    one_trigger = Window.partitionBy("trigger")
    found = (
        parsed.repartition("trigger")
        .withColumn("again", F.col("sure") | (F.row_number().over(one_phrase) > 1))
        .withColumn("open", F.min("phrase").over(one_trigger) != F.max("phrase").over(one_trigger))
        .filter("again OR open")
        .select("trigger", "d", "tie", "first", "count", "again")
    )
    found = checkpointed(found)
    wanted = (
        found.filter("NOT again")
        .groupBy("d", "tie")
        .agg(F.collect_list(F.struct("first", "count", "trigger")).alias("wanted"))
    )
    compared = (
        rows.join(wanted, ["d", "tie"])
        .select("d", "tie", "text", "wanted")
        .mapInArrow(_contents(length), "trigger long, d long, tie long, first int, bytes binary")
        .repartition("trigger")
        .sortWithinPartitions("trigger", "d", "tie", "first")
        .mapInArrow(_compare(length), "d long, tie long, first int, count int")
    )
    return found.filter("again").select("d", "tie", "first", "count").union(compared)


def _cut(length: int):
    """Texts with their runs of repeating stretches to spans and the bytes that are left."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = {k: [] for k in ("doc_id", "n_bytes", "starts", "ends", "kept")}
                for d, tie, text, runs in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    data = np.frombuffer((text or "").encode(), np.uint8)
                    edges = np.zeros(len(data) + 1, np.int32)
                    for r in runs or ():
                        edges[r["first"]] += 1
                        edges[r["first"] + r["count"] - 1 + length] -= 1
                    gone = np.cumsum(edges)[:-1] > 0
                    turns = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                    row = (None if tie & 1 else d, len(data), turns[0::2], turns[1::2], data[~gone].tobytes())
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, starts and ends of the removed spans, and ``kept``, the bytes left."""
    rows = identified(docs.select("doc_id", "text"))
    # Rows equal in both are parsed as one, else the second would remove the text from both.
    unique = rows.groupBy("d", "tie").count().filter("count > 1").isEmpty()
    gone = _repeats(rows if unique else rows.dropDuplicates(["d", "tie"]), length).groupBy("d", "tie").agg(F.collect_list(F.struct("first", "count")).alias("runs"))
    return (
        rows.join(gone, ["d", "tie"], "left")
        .select("d", "tie", "text", "runs")
        .mapInArrow(_cut(length), "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")
    )


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the bytes that are left."""
    return remove_repeats(docs, length).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
