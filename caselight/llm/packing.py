"""Operator 8: fill fixed-length training sequences with token pieces.

Method: first-fit decreasing with a tournament tree over the free room of the open sequences,
run independently in randomised groups of documents.

Every document is tokenised once. Its ids, with the end mark, are cut at multiples of the
capacity. Whole pieces fill a sequence each; the last, shorter piece of each document is placed by
first-fit decreasing among the pieces of its group. A group is chosen by a hash of the row, so
groups hold about ``group_documents`` rows whatever the sources are, and no step needs an order of
the whole corpus. Of rows equal in id and text the first that a task meets goes where the hash says;
the task deals the others out by its number and theirs, so copies fill no group on their own. Equal
rows give equal pieces, so a task that runs again deals out the same ones, whatever their order.

Defined cases: a null or empty text has no ids but the end mark; rows with null or repeated
``doc_id`` are packed like any other; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.shared import forgets, lean

CAPACITY = 2048
END_ID = 1
GROUP_DOCUMENTS = 4096
#: Entries of a task's memory of words already tokenised, for each of its two generations.
WORD_MEMORY = 500_000
#: Longer words are not remembered.
LONGEST_KEPT = 64


class WordTokenizer:
    """Ids of whole texts for a lower-casing tokenizer that never joins across white space.

    White space separates words for good in such a tokenizer, so the ids of a text are those of
    its words in order. Words repeat: each is tokenised once as long as the task's bounded memory
    of two generations holds it. ASCII letters are lowered first, as the tokenizer would do.
    """

    _LETTERS_THEN_SIGNS = re.compile(rb"([a-z\x80-\xff]+)([!-/:-@\[-`{-~]*)")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special_bytes = [x.encode() for x in self.special]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        # The printable stand-in of each byte: itself, or the next free sign from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.stand_in = [chr(b) for b in range(256)]
        for i, b in enumerate(others):
            self.stand_in[b] = chr(256 + i)

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _new(self, word: bytes) -> bytes:
        match = self._LETTERS_THEN_SIGNS.fullmatch(word)
        if match is None:
            return self._plain(word.decode())
        letters, signs = match.groups()
        if signs:
            return self._word(letters) + self._word(signs)
        text = word.decode()
        if not text.isascii():
            if "\u03a3" in text or not text.isalpha() or not unicodedata.is_normalized("NFC", text):
                return self._plain(text)
            text = text.lower()
            if not text.isalpha():
                return self._plain(word.decode())
            text = "".join(map(self.stand_in.__getitem__, text.encode()))
        tokens = self.model.tokenize(text)
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def _word(self, word: bytes) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                ids = self._new(word)
            if len(word) <= LONGEST_KEPT:
                self.known[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Unsigned little-endian 32-bit ids."""
        if any(s in text for s in self.special):
            return self._plain(text)
        data = text.encode().lower()
        if any(s in data for s in self.special_bytes):
            return self._plain(text)
        words = data.split()
        ids = list(map(self.known.get, words))
        at = -1
        while True:
            try:
                at = ids.index(None, at + 1)
            except ValueError:
                break
            ids[at] = self._word(words[at])
        if len(self.known) > WORD_MEMORY:
            self.older, self.known = self.known, {}
        return b"".join(ids)


@functools.cache
def _tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, so that later tasks find the words of earlier ones, until another operator's task comes."""
    return WordTokenizer(path)


forgets(_tokenizer.cache_clear)


def _dealt(mark: int, copy: int, task: int, groups: int) -> int:
    """Group of a row with this hash, met ``copy`` times before in the task."""
    if not copy:
        return mark % groups
    spread = hashlib.blake2b(struct.pack("<3q", mark, task, copy), digest_size=8).digest()
    return int.from_bytes(spread, "little") % groups


def _pieces_of(path: str, capacity: int, end_id: int, keep_ids: bool, groups: int):
    """Arrow batches of (doc_id, text, mark) to one row per piece."""
    last = np.array([end_id], "<u4").tobytes()

    def convert(batches):
        tokens, met, task = _tokenizer(path), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = {k: [] for k in ("row", "start", "length", "doc_tokens", "load")}
                lots = []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = tokens.ids(text or "") + last
                    n = len(ids) // 4
                    mark = part.column(2)[i].as_py()
                    lots.append(_dealt(mark, met[mark], task, groups))
                    met[mark] += 1
                    for start in range(0, n, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        rows["row"].append(i)
                        rows["start"].append(start)
                        rows["length"].append(len(piece) // 4)
                        rows["doc_tokens"].append(n)
                        rows["load"].append(piece if keep_ids else zlib.crc32(piece))
                take = pa.array(rows["row"], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(take),
                        pa.array(rows["start"], pa.int64()),
                        pa.array(rows["length"], pa.int64()),
                        pa.array(rows["doc_tokens"], pa.int64()),
                        pa.array(rows["load"], pa.binary() if keep_ids else pa.int64()),
                        pa.array(lots, pa.int64()).take(take),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "load", "lot"],
                )

    return convert


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, put in order into the first bin with room.

    The tree's leaves hold the free room of the bins, all open from the start; each inner node
    holds the larger of its two, so the leftmost bin with room is found in one descent.
    """
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for n in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < n:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - room[node])
        room[node] -= n
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def _place(capacity: int):
    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(
            ["length", "doc_id", "start", "load"], ascending=[False, True, True, True], kind="stable"
        )
        bins, offsets = first_fit(group["length"].tolist(), capacity)
        lot = int(group["lot"].iloc[0])
        group["sequence_id"] = [(lot << 32) + b for b in bins]
        group["offset"] = offsets
        return group.drop(columns="lot")

    return place


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    group_documents: int = GROUP_DOCUMENTS,
    seed: int = 0,
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ``ids``.

    ``ids`` is binary, unsigned little-endian 32-bit. Without ``keep_ids`` the ids are reduced
    in the tokenising task to ``ids_crc32`` and never shuffled.
    """
    groups = max(1, -(-docs.count() // group_documents))
    mark = F.xxhash64("doc_id", "text", F.lit(seed))
    load = "binary" if keep_ids else "long"
    head = "doc_id long, start long, length long, doc_tokens long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), mark.alias("mark"))
    pieces = rows.mapInArrow(
        lean(__name__, _pieces_of(tokenizer_path, capacity, end_id, keep_ids, groups)), f"{head}, load {load}, lot long"
    )
    packed = pieces.groupBy("lot").applyInPandas(
        _place(capacity), f"{head}, load {load}, sequence_id long, offset long"
    )
    return packed.withColumnRenamed("load", "ids" if keep_ids else "ids_crc32")


def materialise(pieces: DataFrame) -> DataFrame:
    """One row per sequence with its ids in order; at most ``capacity`` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
