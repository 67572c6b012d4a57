"""Operator 3: document fingerprints that follow edits.

Method: a homomorphic multiset hash. Each paragraph (line) of a text is hashed to a wide vector of
32-bit numbers; a text's fingerprint is the sum of its paragraphs' vectors modulo 2^32. So the
order of paragraphs does not matter, and a paragraph is inserted or deleted by adding or
subtracting its vector, without the rest of the text. A number of the second part keeps its sign
up to 2^31 word pairs in one place, more than a text of 2 GB can hold.

A vector has two parts. The first is the paragraph's digest, stretched: equal sums mean equal
multisets of paragraphs. The second counts the paragraph's neighbouring word pairs with random
signs in random places: as sums keep inner products, the cosine of two texts' second parts
estimates the share of word pairs that they have in common, which is their likeness.

Defined cases: a null or empty text has the zero fingerprint; two zero fingerprints, as any two
equal ones, have likeness 1; a zero and another have 0. Blank paragraphs count for nothing.
Documents of equal ``doc_id`` are ordered by a hash of their texts, those without id come last.
A single document is its own next one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselight.llm.bytewise import owners, prefix_hash, runs, scramble, text_slices

#: 32-bit numbers of the two parts.
DIGEST_LANES, PAIR_LANES = 32, 192
ROWS_AT_ONCE = 256
_HASH = prefix_hash(3)


def _digest_part(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), DIGEST_LANES), np.uint32)
    for i, text in enumerate(texts):
        digests = [hashlib.shake_128(p).digest(4 * DIGEST_LANES) for p in text.split(b"\n") if p]
        if digests:
            vectors = np.frombuffer(b"".join(digests), "<u4").reshape(-1, DIGEST_LANES)
            out[i] = vectors.sum(axis=0, dtype=np.uint32)
    return out


def _pair_part(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), PAIR_LANES), np.uint32)
    for first, last, data, bounds in text_slices(pa.array(texts, pa.binary()).cast(pa.string())):
        space = (data == 32) | ((data >= 9) & (data <= 13))
        start, end = runs(~space, bounds)
        if not len(start):
            continue
        words = _HASH.spans(_HASH.sums(data), start, end)
        row = owners(start, bounds)
        line = np.cumsum(data == 10)[start]
        together = (row[1:] == row[:-1]) & (line[1:] == line[:-1])
        pairs = words.copy()
        pairs[:-1][together] += np.uint64(3) * words[1:][together]
        pairs = scramble(pairs, 5)
        lane = (pairs % np.uint64(PAIR_LANES)).astype(np.int64)
        sign = (pairs >> np.uint64(63)).astype(np.int64) * 2 - 1
        counts = np.bincount(row * PAIR_LANES + lane, sign, (last - first) * PAIR_LANES)
        out[first:last] = counts.astype(np.int64).astype(np.uint32).reshape(-1, PAIR_LANES)
    return out


def vectors(texts: list[bytes]) -> np.ndarray:
    """One row of 32-bit numbers per UTF-8 text."""
    return np.hstack([_digest_part(texts), _pair_part(texts)])


def written(rows: np.ndarray) -> list[str]:
    return [base64.b64encode(r.astype("<u4").tobytes()).decode() for r in rows]


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def inserted(fingerprint: str, paragraphs: str) -> str:
    """The fingerprint after further paragraphs were put anywhere into the text."""
    return written((read(fingerprint) + vectors([paragraphs.encode()])[0])[None])[0]


def deleted(fingerprint: str, paragraphs: str) -> str:
    """The fingerprint after these paragraphs were taken out of the text."""
    return written((read(fingerprint) - vectors([paragraphs.encode()])[0])[None])[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of rows; exactly 1 for equal ones."""
    x, y = (m[:, DIGEST_LANES:].view(np.int32).astype(np.float64) for m in map(np.ascontiguousarray, (a, b)))
    size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cosine = np.divide((x * y).sum(axis=1), size, out=np.zeros(len(x)), where=size > 0)
    return np.where((a == b).all(axis=1), 1.0, np.clip(cosine, 0.0, 1.0))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each document."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                made = written(vectors([(x or "").encode() for x in part.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def merged(prints: DataFrame, *keys: str) -> DataFrame:
    """The fingerprint of all texts of a group together, from their fingerprints alone.

    A sum, so every task adds up its own rows before the shuffle.
    """
    schema = prints.select(*keys, "fingerprint").schema

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([read(x) for x in frame["fingerprint"]], axis=0, dtype=np.uint32)
        return frame[list(keys)].head(1).assign(fingerprint=written(total[None]))

    def within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, group in frame.groupby(list(keys), dropna=False, sort=False):
                yield add(group)

    partial = prints.select(*keys, "fingerprint").mapInPandas(within, schema)
    return partial.groupBy(*keys).applyInPandas(add, schema)


def in_order(docs: DataFrame) -> DataFrame:
    """Documents by descending id, each stretch of the order in one partition with its successor.

    Returns stretch, copy, doc_id, text, sorted within partitions. Stretches are cut at quantiles of
    the ids (those without id: at hashes of the texts). The first document of each stretch also
    stands, marked as a copy, at the end of the stretch before it, that of the first stretch at
    the end of the last. Texts are shuffled once, and a document's place follows from its values
    alone, so a task that is run again gets the same rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("tie", F.xxhash64("text"))
    stretches = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / stretches for i in range(1, stretches)]
    cuts = sorted(set(rows.approxQuantile("doc_id", shares, 0.25 / stretches)))
    above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.col("doc_id"))) if cuts else F.lit(0)
    by_hash = F.lit(len(cuts) + 1) + F.floor((F.col("tie") / 2.0**63 + 1) * (stretches / 2)).cast("int")
    rows = rows.withColumn("stretch", F.when(F.col("doc_id").isNull(), by_hash).otherwise(above))
    order = [F.col("doc_id").desc_nulls_last(), "tie", "text"]
    first = Window.partitionBy("stretch").orderBy(*order)
    heads = rows.withColumn("n", F.row_number().over(first)).filter("n = 1")
    # One row per stretch: their number is set by the session, not by the data.
    whole = Window.orderBy("stretch")
    before = F.coalesce(
        F.lag("stretch").over(whole),
        F.max("stretch").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    )
    copies = heads.select("doc_id", "text", "tie", before.alias("stretch"), F.lit(1).alias("copy"))
    both = rows.withColumn("copy", F.lit(0)).unionByName(copies)
    return (
        both.repartition("stretch")
        .sortWithinPartitions("stretch", "copy", *order)
        .select("stretch", "copy", "doc_id", "text")
    )


def _compare(batches):
    """Rows in order to one result row for each that is not a copy."""
    held: tuple | None = None  # the last row and its vector, whose successor comes next
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            rows = list(zip(*[c.to_pylist() for c in part.columns], strict=True))
            made = vectors([r[3].encode() for r in rows])
            if held is not None:
                rows, made = [held[0], *rows], np.vstack([held[1], made])
            held = rows[-1], made[-1]
            here = [i for i in range(len(rows) - 1) if not rows[i][1]]
            if here:
                yield _results(rows, made, here)
    # The last row of a partition is always a copy.


def _results(rows: list[tuple], made: np.ndarray, here: list[int]) -> pa.RecordBatch:
    edited = []
    for i in here:
        text, following = rows[i][3], rows[i + 1][3]
        half = len(text) // 2
        edited.append((text[: len(text) - half] + following[:half]).encode())
    own, changed, after = made[here], vectors(edited), made[[i + 1 for i in here]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][2] for i in here], pa.int64()),
            pa.array([len(rows[i][3]) for i in here], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
            pa.array(written(own), pa.string()),
            pa.array(written(changed), pa.string()),
            pa.array(likeness(own, changed), pa.float64()),
            pa.array(likeness(own, after), pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of the text with its last half taken from the next
    document in descending order of ids, and the likeness to both."""
    return in_order(docs).mapInArrow(
        _compare,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double",
    )
