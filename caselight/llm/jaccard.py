"""Operator 6: documents whose sets of word n-grams are nearly equal, and the groups they form.

Method: rare-first prefix filtering. The n-grams of a set are put into one order for all sets, rare
ones first; two sets that are similar enough must share one of their first few. Sets that meet at
such an n-gram must pass the length filter, the positional filter and a suffix filter before their
texts are compared, once per pair. The suffix filter is a lower bound of the sets' difference: n-grams
fall by their hash into classes, one for every one or two n-grams of the set, and of each class
one bit tells whether its number is odd. Two sets differ by at least one n-gram for each class in which their bits
differ. Of two sets with different numbers of classes the larger one's classes are folded.

Sets that are equal are one node from the start, so copies cost nothing. Links matter only for
the groups they form, so a large group of near copies is not compared pair by pair: at each n-gram a
node notes the earliest node that it can match; first it is compared with the one it notes most
often, and the groups of these links are formed; a round of one partner in another group at each n-gram
joins most of them; then all remaining pairs that lie in different groups are compared. No link
between groups is lost.

The order's counts come from all documents. They are kept in a table of fixed size, in which
n-grams may share a place: that can make the order less sharp, never the result wrong.

Defined cases: null or empty text, or one of white space only, has no n-grams and is linked with
nothing; with fewer words than n the whole sequence is the one n-gram; rows with equal ids stay
rows; a row without id belongs to its group, whose id is the smallest there is, and has none if
the group has none; an empty table gives no rows; other columns are kept by ``groups``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from caselight.llm.bytewise import lower_ascii, owners, prefix_hash, runs, scramble, text_slices
from caselight.llm.shared import checkpointed, identified, lean

WORDS = 3
#: Similarity in hundredths.
LEAST = 90
#: Places of the count table, each four bytes.
PLACES = 1 << 18
#: Fewest classes of the suffix filter, a power of two; larger sets have as many as they need.
CLASSES = 256
#: Bits of the table that tells most texts without a candidate apart before they are shuffled.
BITS = 1 << 26
#: Rounds in which every node is compared with one partner of another group at each n-gram.
ROUNDS = 1
#: Rows of n-gram groups that a task takes at once (a larger group is taken whole), and pairs that it compares at once.
ROWS = 1 << 16
PAIRS = 1 << 18
#: Most files for each core of a checkpoint of a round.
FILES = 2
_HASH = prefix_hash(6)


def _ngrams(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all n-grams, with repeats, by row."""
    low = lower_ascii(data)
    start, end = runs(~((low == 32) | ((low >= 9) & (low <= 13))), bounds)
    hashes, row = _HASH.spans(_HASH.sums(low), start, end), owners(start, bounds)
    n = np.bincount(row, minlength=len(bounds) - 1)
    first = np.cumsum(n) - n
    # An n-gram starts at each word with enough after it, or at the first word of a short text.
    after = n[row] - (np.arange(len(row)) - first[row])
    begins = np.flatnonzero((after >= words) | (after == n[row]))
    out = np.zeros(len(begins), np.uint64)
    for i in range(words):
        there = after[begins] > i
        at = np.minimum(begins + i, max(len(hashes) - 1, 0))
        out = scramble(out ^ np.where(there, hashes[at], np.uint64(i)), i) if len(begins) else out
    return row[begins], out


def _sets(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams, by row and hash."""
    row, gram = _ngrams(data, bounds, words)
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return row[new], gram[new]


def _nodes(row: np.ndarray, gram: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A name for each row's set and its size; equal sets have equal names."""
    size = np.bincount(row, minlength=rows)
    total = np.zeros(rows, np.uint64)
    np.add.at(total, row, scramble(gram, 7))
    return scramble(total + size.astype(np.uint64), 8).view(np.int64), size


def _odd_classes(row: np.ndarray, gram: np.ndarray, size: np.ndarray) -> list[bytes]:
    """One bit for each class of each row's set: whether it has an odd number of n-grams.

    A set has ``CLASSES`` classes, or the least power of two with one class for each two n-grams.
    """
    exponent = np.ceil(np.log2(np.maximum(size, 1) / 2)).clip(min=0).astype(np.int64)
    n = np.maximum(CLASSES, np.left_shift(1, exponent))
    ends = np.cumsum(n)
    kind = (scramble(gram, 9) & (n[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount((ends - n)[row] + kind, minlength=int(ends[-1]) if len(ends) else 0) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little")
    return [packed[e // 8 - k // 8 : e // 8].tobytes() for e, k in zip(ends.tolist(), n.tolist())]


def _named_sets(docs: DataFrame, words: int) -> DataFrame:
    """d, tie, node, size of each document; no node for an empty set."""

    def run(batches):
        for batch in batches:
            for first, last, data, bounds in text_slices(batch.column(2)):
                node, size = _nodes(*_sets(data, bounds, words), last - first)
                own = [batch.column(i).slice(first, last - first) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(node, mask=size == 0), pa.array(size, pa.int64())], ["d", "tie", "node", "size"]
                )

    return docs.mapInArrow(lean(__name__, run), "d long, tie long, node long, size long")


def _counts(docs: DataFrame, words: int) -> np.ndarray:
    """How often n-grams of each place of the table occur in all documents."""

    def run(batches):
        total = np.zeros(PLACES, np.int64)
        for batch in batches:
            for _, _, data, bounds in text_slices(batch.column(2)):
                _, gram = _ngrams(data, bounds, words)
                total += np.bincount((gram % np.uint64(PLACES)).astype(np.int64), minlength=PLACES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(64)), pa.array([x.tobytes() for x in np.split(total, 64)])], ["part", "counts"]
        )

    def add(frame):
        counts = np.sum([np.frombuffer(x, np.int64) for x in frame["counts"]], axis=0)
        return frame.head(1).assign(counts=[counts.tobytes()])

    # Each task sends the whole table in parts: a size that does not depend on the data.
    parts = docs.mapInArrow(lean(__name__, run), "part long, counts binary").groupBy("part").applyInPandas(add, "part long, counts binary")
    table = np.zeros((64, PLACES // 64), np.int64)
    for r in parts.collect():
        table[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(table.ravel(), (1 << 32) - 1).astype(np.uint32)


def _prefixes(docs: DataFrame, words: int, least: int, counts: np.ndarray) -> DataFrame:
    """gram, node, size, place: the first n-grams of each set in the common order."""
    table = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        often = table.value
        for batch in batches:
            for first, last, data, bounds in text_slices(batch.column(2)):
                row, gram = _sets(data, bounds, words)
                node, size = _nodes(row, gram, last - first)
                _, once = np.unique(node, return_index=True)
                chosen = np.zeros(last - first, bool)
                chosen[once] = size[once] > 0
                row, gram = row[chosen[row]], gram[chosen[row]]
                order = np.lexsort((gram, often[(gram % np.uint64(PLACES)).astype(np.int64)], row))
                row, gram = row[order], gram[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                early = place < (size - -(-least * size // 100) + 1)[row]
                row, gram, place = row[early], gram[early], place[early]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((gram >> np.uint64(16)).view(np.int64)), pa.array(node[row]), pa.array(size[row], pa.int32()),
                        pa.array(place, pa.int32()),
                    ],
                    ["gram", "node", "size", "place"],
                )

    return docs.mapInArrow(lean(__name__, run), "gram long, node long, size int, place int")


def _classes(docs: DataFrame, words: int) -> DataFrame:
    """node, classes: the bits of each different set's classes, once."""

    def run(batches):
        for batch in batches:
            for first, last, data, bounds in text_slices(batch.column(2)):
                row, gram = _sets(data, bounds, words)
                node, size = _nodes(row, gram, last - first)
                bits = _odd_classes(row, gram, size)
                _, once = np.unique(node, return_index=True)
                at = pa.array(once[size[once] > 0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node).take(at), pa.array(bits, pa.binary()).take(at)], ["node", "classes"]
                )

    return docs.mapInArrow(lean(__name__, run), "node long, classes binary").groupBy("node").agg(F.first("classes").alias("classes"))


def _bit_table(nodes: DataFrame) -> np.ndarray:
    """One bit of a table of fixed size set for each node."""

    def run(batches):
        bits = np.zeros(BITS // 8, np.uint8)
        for batch in batches:
            place = (np.asarray(batch.column(0)).view(np.uint64) % np.uint64(BITS)).astype(np.int64)
            np.bitwise_or.at(bits, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
        for i, part in enumerate(np.split(bits, 64)):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([zlib.compress(part, 1)])], ["part", "bits"])

    def join(frame):
        parts = [np.frombuffer(zlib.decompress(x), np.uint8) for x in frame["bits"]]
        return frame.head(1).assign(bits=[np.bitwise_or.reduce(parts).tobytes()])

    joined = nodes.mapInArrow(lean(__name__, run), "part long, bits binary").groupBy("part").applyInPandas(join, "part long, bits binary")
    table = np.zeros((64, BITS // 512), np.uint8)
    for r in joined.collect():
        table[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return table.ravel()


class _Classes:
    """Bits of the suffix filter of several sets, at each number of classes that a pair may need."""

    def __init__(self, bits: pa.Array) -> None:
        offsets = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1]
        data = np.frombuffer(bits.buffers()[2] or b"", np.uint8)
        self.words = np.diff(offsets).astype(np.int64) // 8
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for words in np.unique(self.words).tolist():
            # Sets with as many classes, and those with more, folded.
            rows = np.flatnonzero(self.words >= words)
            folded = np.zeros((len(rows), words), np.uint64)
            for many in np.unique(self.words[rows]).tolist():
                those = np.flatnonzero(self.words[rows] == many)
                parts = data[offsets[rows[those]][:, None] + np.arange(8 * many)].view(np.uint64)
                folded[those] = np.bitwise_xor.reduce(parts.reshape(len(those), many // words, words), axis=1)
            place = np.full(len(bits), -1, np.int64)
            place[rows] = np.arange(len(rows))
            self.at[words] = place, folded

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many n-grams the sets of each pair of positions differ by, at least."""
        fewer = np.minimum(self.words[a], self.words[b])
        out = np.zeros(len(a), np.int64)
        for words, (place, folded) in self.at.items():
            here = np.flatnonzero(fewer == words)
            for some in np.array_split(here, max(1, len(here) * words >> 20)):
                odd = folded[place[a[some]]] ^ folded[place[b[some]]]
                out[some] = np.bitwise_count(odd).sum(axis=1, dtype=np.int64)
        return out


def _whole_groups(batches):
    """Tables of whole groups of rows with an equal first column, many small groups at once."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            key = np.asarray(batch.column(0))
            cut = int(np.searchsorted(key, key[-1]))
            # The last group may go on in the next batch; all of this batch may belong to it.
            if cut == 0 and held[0].column(0)[0].as_py() == key[-1]:
                continue
            if cut:
                yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
                held = [batch.slice(cut)]
            else:
                whole = pa.Table.from_batches(held)
                keys = np.asarray(whole.column(0))
                cut = int(np.searchsorted(keys, keys[-1]))
                yield whole.slice(0, cut)
                held = whole.slice(cut).combine_chunks().to_batches()
            rows = sum(b.num_rows for b in held)
    if held:
        yield pa.Table.from_batches(held)


class _Meetings:
    """Rows (gram, node, size, place, classes), sorted by gram and size, and their pairs in equal groups."""

    def __init__(self, rows: pa.Table, least: int) -> None:
        self.least = least
        self.node = np.asarray(rows["node"])
        self.size, self.place = (np.asarray(rows[c]).astype(np.int64) for c in ("size", "place"))
        self.classes = _Classes(rows["classes"].combine_chunks())
        gram = np.asarray(rows["gram"])
        first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        self.number = np.arange(len(gram)) - np.repeat(first, np.diff(np.r_[first, len(gram)]))

    def pairs(self, part: np.ndarray | None = None):
        """Positions (later, earlier) of pairs that pass all filters, each at most once.

        A step takes each row with the one so many rows before it; earlier rows of a group are smaller, so a row
        is done with once one of them is too small. With parts, only pairs of different ones.
        """
        a, step = np.arange(len(self.node)), 1
        while True:
            a = a[self.number[a] >= step]
            a = a[100 * self.size[a - step] >= self.least * self.size[a]]
            if not len(a):
                return
            for some in np.array_split(a, max(1, len(a) // PAIRS)):
                if part is not None:
                    some = some[part[some] != part[some - step]]
                some = some[self._fits(some, some - step)]
                yield some, some - step
            step += 1

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size, place = self.size, self.place
        both = size[a] + size[b]
        needed = -(-self.least * both // (100 + self.least))
        good = np.minimum(size[a] - place[a], size[b] - place[b]) >= needed
        left = np.flatnonzero(good)
        good[left] = self.classes.apart(a[left], b[left]) <= both[left] - 2 * needed[left]
        return good


_ENTRY = "gram long, node long, size int, place int, classes binary"


def _with_partner(least: int):
    """Rows of a group that can match another one, each with the earliest that it can match."""

    def run(batches):
        for rows in _whole_groups(batches):
            met = _Meetings(rows, least)
            partner = np.full(rows.num_rows, -1, np.int64)
            wanted = np.zeros(rows.num_rows, bool)
            for later, earlier in met.pairs():
                partner[later] = earlier
                wanted[later] = wanted[earlier] = True
            at = np.flatnonzero(wanted)
            names = pa.array(met.node[np.maximum(partner[at], 0)], mask=partner[at] < 0)
            yield from rows.take(at).append_column("partner", names).combine_chunks().to_batches()

    return run


def _across(least: int, turn: int | None):
    """Pairs of a group's rows that can match and belong to different components.

    With a turn only one pair of each row: the first in an order that changes with the turn.
    """

    def run(batches):
        for rows in _whole_groups(batches):
            met, part = _Meetings(rows, least), np.asarray(rows["part"])
            node = met.node

            def order(a, b):
                return scramble((node[a] ^ node[b]).view(np.uint64), 20 + turn)

            if turn is not None:
                best = np.full(len(node), np.uint64((1 << 64) - 1))
                for a, b in met.pairs(part):  # in one step no row stands twice on a side
                    best[a] = np.minimum(best[a], order(a, b))
                    best[b] = np.minimum(best[b], order(a, b))
            for a, b in met.pairs(part):
                if turn is not None:
                    first = (order(a, b) == best[a]) | (order(a, b) == best[b])
                    a, b = a[first], b[first]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["x", "y"])

    return run


def _compared(pairs: DataFrame, texts: DataFrame, words: int, least: int) -> DataFrame:
    """The pairs whose sets are similar enough."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                (one, other) = (
                    [g for s in text_slices(part.column(c)) for g in _split(*_sets(s[2], s[3], words), s[1] - s[0])] for c in (2, 3)
                )
                same = []
                for p, q in zip(one, other, strict=True):
                    shared = len(np.intersect1d(p, q, assume_unique=True))
                    same.append(100 * shared >= least * (len(p) + len(q) - shared))
                yield part.filter(pa.array(same, pa.bool_())).select([0, 1])

    first, second = (texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in ("x", "y"))
    # Texts are never broadcast: nothing bounds them.
    both = pairs.join(first.hint("merge"), "x").join(second.hint("merge"), "y")
    return both.select("x", "y", "text_x", "text_y").mapInArrow(lean(__name__, run), "x long, y long")


def _split(row: np.ndarray, gram: np.ndarray, rows: int) -> list[np.ndarray]:
    return np.split(gram, np.searchsorted(row, np.arange(1, rows)))


def _narrow(df: DataFrame) -> DataFrame:
    """A checkpoint of a narrow table of one step, in a few files for each core.

    Each file takes an executor calls to the file system, however few rows it has, and rounds leave many such tables.
    """
    return checkpointed(df.coalesce(FILES * df.sparkSession.sparkContext.defaultParallelism))


def components(links: DataFrame) -> DataFrame:
    """node, part: the smallest node that is reachable, for every node that has a link.

    Each round takes the smallest label among a node's own and its neighbours', and then that
    label's label, so the number of rounds grows with the logarithm of the longest path.
    """
    one, other = links.select("x", "y"), links.select(F.col("y").alias("x"), F.col("x").alias("y"))
    loops = one.union(other).select("x", F.col("x").alias("y"))
    both = _narrow(one.union(other).union(loops).distinct())
    labels = _narrow(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("part")))
    while True:
        own = F.max(F.when(F.col("x") == F.col("y"), F.col("part")))
        lower = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("part").alias("mid"), own.alias("old"))
        jump = labels.select(F.col("node").alias("mid"), F.col("part").alias("jump"))
        new = _narrow(lower.join(jump, "mid").select("x", "jump", "old"))
        labels = new.select(F.col("x").alias("node"), F.col("jump").alias("part"))
        if new.filter("jump <> old").isEmpty():
            return labels


def _grouped(rows: DataFrame, words: int, least: int) -> DataFrame:
    """d, tie, node, size and part of each row of (d, tie, text); neither node nor part for an empty set."""
    sets = checkpointed(_named_sets(rows, words))
    entries = _prefixes(rows, words, least, _counts(rows, words))
    one_gram = Window.partitionBy("gram")
    meeting = entries.withColumn("meets", F.min("node").over(one_gram) != F.max("node").over(one_gram)).filter("meets")
    # Only rows that meet get their set's classes; a set that several batches have sent counts once.
    meeting = meeting.select("gram", "node", "size", "place").dropDuplicates(["gram", "node"])
    candidates = checkpointed(
        meeting.join(_classes(rows, words).hint("merge"), "node")
        .select("gram", "node", "size", "place", "classes")
        .repartition("gram")
        .sortWithinPartitions("gram", "size", "node")
        .mapInArrow(lean(__name__, _with_partner(least)), _ENTRY + ", partner long")
    )
    wanted = candidates.select("node").distinct()
    # Bits of fixed number keep most of the other texts from being shuffled; the join does the rest.
    bits = rows.sparkSession.sparkContext.broadcast(_bit_table(wanted))

    def name(batches):
        for batch in batches:
            for first, last, data, bounds in text_slices(batch.column(2)):
                node, size = _nodes(*_sets(data, bounds, words), last - first)
                place = (node.view(np.uint64) % np.uint64(BITS)).astype(np.int64)
                at = pa.array(np.flatnonzero((size > 0) & (bits.value[place >> 3] >> (place & 7) & 1 > 0)))
                yield pa.RecordBatch.from_arrays([pa.array(node).take(at), batch.column(2).slice(first, last - first).take(at)], ["node", "text"])

    texts = rows.mapInArrow(lean(__name__, name), "node long, text string").join(wanted, "node", "left_semi")
    one_node = Window.partitionBy("node").orderBy("text")
    texts = checkpointed(texts.withColumn("n", F.row_number().over(one_node)).filter("n = 1").drop("n"))

    # First each node with the one partner that it meets most often.
    one_node = Window.partitionBy("node").orderBy(F.col("n").desc(), "partner")
    met = candidates.filter("partner IS NOT NULL").groupBy("node", "partner").agg(F.count("*").alias("n"))
    closest = met.withColumn("rank", F.row_number().over(one_node)).filter("rank = 1")
    pair = (F.least("node", "partner").alias("x"), F.greatest("node", "partner").alias("y"))
    first = checkpointed(_compared(closest.select(*pair).distinct(), texts, words, least))
    links, tried = first, None
    for turn in (*range(ROUNDS), None):
        parts = components(links)
        placed = candidates.drop("partner").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
        split = placed.withColumn("meets", F.min("part").over(one_gram) != F.max("part").over(one_gram)).filter("meets")
        rest = (
            split.select("gram", "node", "size", "place", "classes", "part")
            .repartition("gram")
            .sortWithinPartitions("gram", "size", "node")
            .mapInArrow(lean(__name__, _across(least, turn)), "x long, y long")
            .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
            .distinct()
        )
        rest = checkpointed(rest if tried is None else rest.join(tried, ["x", "y"], "left_anti"))
        tried = rest if tried is None else tried.union(rest)
        links = links.union(checkpointed(_compared(rest, texts, words, least)))
    parts = components(links)

    return sets.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))


def groups(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id of the document's group."""
    named = _grouped(identified(docs.select("doc_id", "text")), words, least)
    named = named.withColumn("doc_id", F.when(F.col("tie").bitwiseAND(F.lit(1)) == 0, F.col("d")))
    smallest = named.filter("part IS NOT NULL").groupBy("part").agg(F.min("doc_id").alias("smallest"))
    return named.join(smallest, "part", "left").select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"),
    )


def one_of_each_group(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """The given columns of the first document, by id, of each group; those without n-grams all stay.

    Rows equal in id and text count as one document.
    """
    rows = identified(docs)
    named = _grouped(rows.select("d", "tie", "text"), words, least)
    first = named.filter("part IS NOT NULL").groupBy("part").agg(F.min(F.struct("d", "tie")).alias("first")).select("first.*")
    stay = first.union(named.filter("part IS NULL").select("d", "tie")).distinct()
    kept = rows.join(stay, ["d", "tie"]).dropDuplicates(["d", "tie"])
    doc_id = F.when(F.col("tie").bitwiseAND(F.lit(1)) == 0, F.col("d"))
    others = iter(range(len(docs.columns)))
    return kept.select(
        *[
            doc_id.alias(n) if n == "doc_id" else F.col("text") if n == "text" else F.col(f"x{next(others)}").alias(n)
            for n in docs.columns
        ]
    )
