"""Operator 4: lines that repeat, exactly or nearly, within and across documents.

Method: a segment-partition edit join. A line is cut into one segment more than edits are allowed,
so a line within that many edits holds one of the segments unchanged, and near its old place. Each
line offers its segments under keys made of its length, the segment's number and content, and asks
for the substrings that a longer or equally long line must have at the places where the segment
can have moved to. Lines that meet under a key are compared by a banded bit-parallel edit
distance, which stops at the first earlier line that is near enough.

A line of at least ``least_bytes`` bytes is dropped if an earlier line (of a smaller doc_id, or above in
the same document) is at most ``edits`` bytes away from it. Lines are judged on the input, not on
what is left. Edits count bytes of UTF-8; shorter lines are never dropped.

With ``least_bytes`` None, as the query has it, there is no such floor: a line that is not blank is
dropped if it is equal to an earlier one, whatever its length, or if both have more characters than
``edits``, the fewest that the segments allow, and are at most ``edits`` characters apart.

Keys and hashes of all lines are made and shuffled once, texts are shuffled once; the few lines that
meet under a key are kept in the checkpoint folder. Equal lines in a slice of about 1 MB are settled
there, so a line in a third of all documents costs a row per slice under its hash. Lines under one
key share length and a segment; a key's lines are compared in the order of their occurrence. Where
many different lines share a key, as machine-written ones do, they are dealt by a hash into blocks
of about ``BLOCK`` lines, and every pair of blocks is compared by a task of its own, all pairs of lines
at once in arrays. No pair is left out, so the work on such a key grows with the square of its lines.

Defined cases: null text stays null and has no lines, an empty one has one empty line; rows equal
in id and text count as one document; rows without id come last, ordered by a hash of their text;
an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselight.llm.bytewise import prefix_hash, scramble, text_slices
from caselight.llm.shared import checkpointed, identified, lean

EDITS = 2
LEAST_BYTES = 24
#: Different lines of one key that a task holds on either side; lines from which arrays are used; pairs at once.
BLOCK, MANY, PAIRS_AT_ONCE = 1024, 24, 1 << 17
_HASH, _OTHER = prefix_hash(41), prefix_hash(42)


def _lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and number within the row of every line."""
    breaks = np.flatnonzero(data == 10)
    row_of_break = np.searchsorted(bounds, breaks, "right") - 1
    start = np.concatenate([bounds[:-1], breaks + 1])
    end = np.concatenate([breaks, bounds[1:]])
    row = np.concatenate([np.arange(len(bounds) - 1), row_of_break])
    start, row = start[(order := np.lexsort((start, row)))], row[order]
    end = end[np.lexsort((end, np.concatenate([row_of_break, np.arange(len(bounds) - 1)])))]
    return start, end, row, np.arange(len(start)) - np.searchsorted(row, row)


def _segments(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and length of each segment; the last ones take the bytes left over."""
    parts = edits + 1
    small, longer = length // parts, length % parts
    out, at = [], np.zeros_like(length)
    for i in range(parts):
        size = small + (i >= parts - longer)
        out.append((at, size))
        at = at + size
    return out


def _keys(sums: np.ndarray, start: np.ndarray, end: np.ndarray, edits: int, places: np.ndarray | None = None):
    """(line, key) of everything that a line offers or asks for; ``places`` are the bytes where characters begin."""
    length, lines, keys = end - start, [], []
    for shorter in range(edits + 1):
        other = length - shorter
        for i, (at, size) in enumerate(_segments(other, edits)):
            low = np.maximum(-i, shorter - (edits - i))
            high = np.minimum(i, shorter + (edits - i))
            for move in range(int(low), int(high) + 1):
                begin = at + move
                fits = (begin >= 0) & (begin + size <= length) & (size > 0)
                first = start[fits] + begin[fits]
                last = first + size[fits]
                if places is not None:
                    first, last = places[first], places[last]
                found = _HASH.spans(sums, first, last)
                lines.append(np.flatnonzero(fits))
                keys.append(scramble(found ^ scramble(other[fits].astype(np.uint64), 40 + i), 4))
                # With nothing moved and no byte less these are the line's own segments: it offers them.
    return np.concatenate(lines), np.concatenate(keys)


def _blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _each_slice(batches, least: int | None):
    for batch in batches:
        for first, last, data, bounds in text_slices(batch.column(2)):
            start, end, row, number = _lines(data, bounds)
            if least is None:
                long_enough = end > start
                indented = np.flatnonzero(long_enough)
                indented = indented[_blank(data[start[indented]])]
                if len(indented):
                    solid = np.r_[0, np.cumsum(~_blank(data))]
                    long_enough[indented] = solid[end[indented]] > solid[start[indented]]
            else:
                long_enough = end - start >= least
            start, end, row, number = (x[long_enough] for x in (start, end, row, number))
            yield batch, first, last, data, start, end, row, number


def _again(h1: np.ndarray, h2: np.ndarray, d: np.ndarray, tie: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Which lines repeat one that stands at an earlier place among those given."""
    again = np.zeros(len(h1), bool)
    order = np.argsort(h1)
    equal = np.flatnonzero(h1[order[1:]] == h1[order[:-1]])
    some = np.unique(np.r_[order[equal], order[equal + 1]])
    some = some[np.lexsort((number[some], tie[some], d[some], h2[some], h1[some]))]
    new = np.ones(len(some), bool)
    new[1:] = (h1[some[1:]] != h1[some[:-1]]) | (h2[some[1:]] != h2[some[:-1]])
    first = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
    # Rows equal in id and text are one document: their lines stand at one place.
    again[some] = (d[some] != d[first]) | (tie[some] != tie[first]) | (number[some] != number[first])
    return again


def _occurrences(docs: DataFrame, least: int | None) -> DataFrame:
    """at, h2, d, tie, number of every line that is long enough, or not blank.

    ``at`` is the line's hash h1, and h2 a second one. Of equal lines in a slice only the first has
    them; the others are surely dropped, and have no h2 and some number of their own as ``at``.
    """

    def run(batches):
        for batch, first, _, data, start, end, row, number in _each_slice(batches, least):
            d, tie = (np.asarray(batch.column(i))[row + first] for i in (0, 1))
            h1 = _HASH.spans(_HASH.sums(data), start, end)
            h2 = (_OTHER.spans(_OTHER.sums(data), start, end) >> np.uint64(33)).astype(np.int32)
            again = _again(h1, h2, d, tie, number)
            at = np.where(again, scramble(h1 + np.arange(len(h1), dtype=np.uint64), 5), h1)
            columns = [pa.array(at.view(np.int64)), pa.array(h2, mask=again), pa.array(d), pa.array(tie), pa.array(number, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["at", "h2", "d", "tie", "number"])

    return docs.mapInArrow(lean(__name__, run), "at long, h2 int, d long, tie long, number int")


def _meetings(docs: DataFrame, least: int | None, edits: int) -> DataFrame:
    """(key, h1, blocks): lines under keys where different lines meet, and into how many blocks they go."""

    def run(batches):
        for _, _, _, data, start, end, _, _ in _each_slice(batches, least):
            sums = _HASH.sums(data)
            names = _HASH.spans(sums, start, end)
            names, once = np.unique(names, return_index=True)
            start, end, places = start[once], end[once], None
            if least is None:
                places = np.flatnonzero(np.append((data & 0xC0) != 0x80, True))
                start, end = np.searchsorted(places, start), np.searchsorted(places, end)
                long_enough = end - start > edits
                names, start, end = (x[long_enough] for x in (names, start, end))
            line, key = _keys(sums, start, end, edits, places)
            key >>= np.uint64(16)  # keys only say which lines to compare; 48 bits tell enough of them apart
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(names[line].view(np.int64))], ["key", "h1"]
            )

    rows = docs.mapInArrow(lean(__name__, run), "key long, h1 long")
    one_key = Window.partitionBy("key")
    meets = F.min("h1").over(one_key) != F.max("h1").over(one_key)
    different = rows.withColumn("meets", meets).filter("meets").select("key", "h1").distinct()
    blocks = F.ceil(F.count("*").over(one_key) / F.lit(BLOCK)).cast("int")
    return different.withColumn("blocks", blocks)


def _block_pairs(meetings: DataFrame) -> DataFrame:
    """(key, pair, lower, h1): each line once for every pair of blocks that its own is in.

    ``lower`` tells the lines of the pair's lower block; a block paired with itself has only these.
    """
    own = F.pmod(F.xxhash64("h1"), F.col("blocks")).cast("long")
    dealt = meetings.select("key", "h1", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pair = F.shiftleft(F.least("own", "other"), 32) + F.greatest("own", "other")
    return dealt.select("key", pair.alias("pair"), (F.col("own") <= F.col("other")).alias("lower"), "h1")


def _number(a: bytes | str) -> tuple[int, int]:
    """The string as one number, and the bytes of it that each sign takes."""
    if isinstance(a, bytes):
        return int.from_bytes(a), 1
    return int.from_bytes(a.encode("utf-32-be")), 4


def _equal_signs(a: bytes | str, b: bytes | str) -> int:
    """How many signs two strings of one length have in common before they differ."""
    (x, width), (y, _) = _number(a), _number(b)
    return len(a) - -(-(x ^ y).bit_length() // (8 * width))


def within(a: bytes | str, b: bytes | str, edits: int) -> bool:
    """Whether one string becomes the other by at most so many edits of bytes, or of characters.

    State d holds, as bits, the diagonals of the band on which the strings so far match with d
    edits; one step per byte moves all diagonals at once.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    if isinstance(a, str) and a.isascii() and b.isascii():
        a, b = a.encode(), b.encode()
    n = min(len(a), len(b))
    head = _equal_signs(a[:n], b[:n])
    if head == n:
        return True
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    tail = _equal_signs(a[::-1][:n], b[::-1][:n])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if max(len(a), len(b)) <= edits:
        return True
    places: dict[int, int] = {}
    for i, sign in enumerate(a[:edits]):
        places[sign] = places.get(sign, 0) | 1 << (i + edits)
    band = (1 << (2 * edits + 1)) - 1
    # Bit e of a state is the diagonal e - edits: that many bytes of a beyond those of b.
    states = [(1 << (edits + d + 1)) - (1 << edits) for d in range(edits + 1)]
    for j, sign in enumerate(b):
        if j + edits < len(a):  # the one sign of a that comes into the band
            places[a[j + edits]] = places.get(a[j + edits], 0) | 1 << (j + 2 * edits)
        same = places.get(sign, 0) >> j & band
        old = states
        states = [old[0] & same]
        for d in range(1, edits + 1):
            new = old[d] & same | old[d - 1] | old[d - 1] >> 1
            states.append((new | states[d - 1] << 1) & band)
        if not states[-1]:
            return False
    return bool(states[-1] >> (len(a) - len(b) + edits) & 1)


def _next_row(row: np.ndarray, step: int, sign: np.ndarray, signs: list[np.ndarray], edits: int) -> np.ndarray:
    """The band's next row: ``sign`` of one string against ``signs`` of the other on each diagonal."""
    new, beyond = np.empty_like(row), np.uint8(edits + 1)
    for d in range(2 * edits + 1):
        j = step + 1 + d - edits
        if j <= 0:
            new[d] = step + 1 if j == 0 else beyond
            continue
        best = row[d] + (signs[d] != sign)
        if d < 2 * edits:
            np.minimum(best, row[d + 1] + np.uint8(1), out=best)
        if d:
            np.minimum(best, new[d - 1] + np.uint8(1), out=best)
        np.minimum(best, beyond, out=new[d])
    return new


def _near_pairs(texts: tuple[np.ndarray, ...], one: np.ndarray, two: np.ndarray, wanted: np.ndarray, edits: int):
    """The wanted pairs of ``one`` and ``two`` that are within so many edits, as two arrays.

    The band of the edit table goes on by one row a step, first for all of one set against all of
    the other, then, once most pairs are too far apart, for each pair that is left. Signs read
    beyond a string's end only reach cells beyond it.
    """
    flat, start, length = texts
    bands = range(-edits, edits + 1)
    wanted = wanted & (np.abs(length[one][:, None] - length[two]) <= edits)
    row = np.full((2 * edits + 1, *wanted.shape), edits + 1, np.uint8)
    row[edits:] = np.arange(edits + 1, dtype=np.uint8)[:, None, None]
    row[:, ~wanted] = edits + 1
    step, shortest = 0, int(length[one].min())
    while step < shortest and (step % 4 or 16 * np.count_nonzero(row.min(axis=0) <= edits) > wanted.size):
        at = np.minimum(start[two] + step, len(flat) - edits - 1)
        row = _next_row(row, step, flat[start[one] + step][:, None], [flat[at + d] for d in bands], edits)
        step += 1
    one_left, two_left = np.nonzero(wanted & (row.min(axis=0) <= edits))
    row, one, two = row[:, one_left, two_left], one[one_left], two[two_left]
    found = []
    while len(one):
        done = np.flatnonzero(length[one] == step)
        near = done[row[length[two[done]] - step + edits, done] <= edits]
        found.append((one[near], two[near]))
        alive = np.flatnonzero((length[one] > step) & (row.min(axis=0) <= edits))
        one, two, row = one[alive], two[alive], row[:, alive]
        at = start[two] + step
        row = _next_row(row, step, flat[start[one] + step], [flat[at + d] for d in bands], edits)
        step += 1
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


def _near_many(lines: list, lower: np.ndarray, edits: int) -> np.ndarray:
    """Numbers of the lines with an earlier one near, in one block or, where there are two, across them."""
    if all(isinstance(x, str) and x.isascii() for x in lines):
        lines = [x.encode() for x in lines]
    coded = [np.frombuffer(x, np.uint8) if isinstance(x, bytes) else np.frombuffer(x.encode("utf-32-le"), "<u4") for x in lines]
    length = np.array([len(x) for x in coded])
    texts = np.concatenate([*coded, np.zeros(2 * edits + 1, coded[0].dtype)]), np.cumsum(length) - length, length
    found, numbers = np.zeros(len(lines), bool), np.arange(len(lines))
    across = not lower.all()
    ones, twos = (np.flatnonzero(lower), np.flatnonzero(~lower)) if across else (numbers, numbers)
    step = max(1, PAIRS_AT_ONCE // max(1, len(ones)))
    for at in range(0, len(twos), step):
        two = twos[at : at + step]
        one = ones if across else ones[: at + step]
        wanted = np.full((len(one), len(two)), True) if across else one[:, None] < two
        if len(one):
            found[np.maximum(*_near_pairs(texts, one, two, wanted, edits))] = True
    return np.flatnonzero(found)


def _verify(edits: int, characters: bool):
    """Rows (key, pair, lower, d, tie, number, line) by key, pair and order to the places of lines with an earlier one near."""

    def near_ones(lower: np.ndarray, lines: list) -> list | np.ndarray:
        if characters:
            lines = [x.decode() for x in lines]
        if len(lines) >= MANY:
            return _near_many(lines, lower, edits)
        across = not lower.all()
        return [
            i
            for i, line in enumerate(lines)
            if any(within(lines[e], line, edits) for e in range(i) if not across or lower[e] != lower[i])
        ]

    def near_places(rows: pa.Table, cuts: np.ndarray) -> list[pa.RecordBatch]:
        lower, lines = np.asarray(rows["lower"]), rows["line"].to_pylist()
        near = [a + i for a, b in zip(cuts[:-1], cuts[1:], strict=True) for i in near_ones(lower[a:b], lines[a:b])]
        return rows.select(["d", "tie", "number"]).take(pa.array(near, pa.int64())).combine_chunks().to_batches()

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            key, pair = np.asarray(rows["key"]), np.asarray(rows["pair"])
            cuts = np.r_[0, 1 + np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))]
            yield from near_places(rows, cuts)
            held = rows.slice(cuts[-1])
        if held is not None:
            yield from near_places(held, np.array([0, len(held)]))

    return run


def _pick(batches):
    """Texts with lists of (number, h1) to the lines themselves."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            out = {k: [] for k in ("h1", "d", "tie", "number", "line")}
            for d, tie, text, wanted in zip(*[c.to_pylist() for c in part.columns], strict=True):
                lines = (text or "").encode().split(b"\n")
                for w in wanted:
                    for k, v in zip(out, (w["h1"], d, tie, w["number"], lines[w["number"]]), strict=True):
                        out[k].append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))


def _repeated(rows: DataFrame, edits: int, least_bytes: int | None) -> DataFrame:
    """d, tie and ``dropped``, the numbers of the lines to drop, of documents that have any."""
    rows = rows.select("d", "tie", "text")
    # Both uses need these rows and columns, no fewer, so Spark makes and shuffles them once.
    lines = _occurrences(rows, least_bytes).filter("at IS NOT NULL AND d IS NOT NULL AND tie IS NOT NULL").repartition("at")
    order = Window.partitionBy("at", "h2").orderBy("d", "tie", "number")
    repeats = lines.withColumn("place", F.rank().over(order)).filter("place > 1 OR h2 IS NULL")

    meetings = checkpointed(_meetings(rows, least_bytes, edits))
    meeting = lines.join(meetings.select(F.col("h1").alias("at")).distinct(), "at")
    first = F.min(F.struct("d", "tie", "number")).alias("first")
    wanted = meeting.groupBy("at", "h2").agg(first).select(F.col("at").alias("h1"), "first.*")
    wanted = wanted.groupBy("d", "tie").agg(F.collect_list(F.struct("h1", "number")).alias("wanted"))
    texts = rows.join(wanted, ["d", "tie"]).select("d", "tie", "text", "wanted").mapInArrow(
        lean(__name__, _pick), "h1 long, d long, tie long, number int, line binary"
    ).repartition("h1").dropDuplicates(["h1", "d", "tie", "number"])
    near = (
        _block_pairs(meetings).join(texts, "h1")
        .repartition("key", "pair")
        .sortWithinPartitions("key", "pair", "d", "tie", "number")
        .select("key", "pair", "lower", "d", "tie", "number", "line")
        .mapInArrow(lean(__name__, _verify(edits, least_bytes is None)), "d long, tie long, number int")
    )
    gone = repeats.select("d", "tie", "number").unionByName(near)
    return gone.groupBy("d", "tie").agg(F.collect_set("number").alias("dropped"))


def drop_repeated_lines(docs: DataFrame, edits: int = EDITS, least_bytes: int | None = LEAST_BYTES) -> DataFrame:
    """The given columns, ``text`` without its repeated lines, and n_lines and n_dropped."""
    rows = identified(docs)
    both = rows.join(_repeated(rows, edits, least_bytes), ["d", "tie"], "left")
    line = F.split("text", "\n", -1)
    kept = F.filter(line, lambda _, i: ~F.array_contains("dropped", i))
    shorter = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    doc_id = F.when(F.col("tie").bitwiseAND(F.lit(1)) == 0, F.col("d"))
    others = iter(range(len(docs.columns)))
    return both.select(
        *[
            (doc_id if n == "doc_id" else shorter if n == "text" else F.col(f"x{next(others)}")).alias(n)
            for n in docs.columns
        ],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(line)).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def report(docs: DataFrame, edits: int = EDITS, least_bytes: int | None = LEAST_BYTES) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the text that is left."""
    kept = drop_repeated_lines(docs.select("doc_id", "text"), edits, least_bytes)
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )
