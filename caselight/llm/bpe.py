"""Operator 7: byte-level BPE encoding and decoding with constant memory.

Method: a bounded-lookahead streaming transducer. From the merge list alone follows how many
bytes beyond a token can still change it; a token is emitted once that many bytes after it, or
the end of its piece, have been seen. Text goes in by chunks and ids come out by portions:
``Stream`` holds the part of a chunk that the splitting rule has not settled and, of a piece that
is longer than a chunk, one window of bytes. Decoding is a state machine from token bytes to text,
and the digests of a round trip are updated portion by portion, so beside the row itself, as Spark
hands it over, memory does not grow with the text. (``encode`` returns all ids of a row, of course.)

Pieces are what the vocabulary's splitting rule gives: contractions, words, numbers, signs and
white space, each with the blank before it. A blank between two other signs always begins a
piece, so a chunk is cut there. What the transducer emitted for a short piece, and for a short
stretch between two such blanks, is remembered in tables of bounded size.

Defined cases: null or empty text has no ids and decodes to the empty text; special marks that
occur in a text become their single id; rows with null or repeated ``doc_id`` stay rows.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.bytewise import text_bytes

#: Entries of a worker's memory of stretches and of pieces, for each of its two generations;
#: longer ones are not kept.
STRETCHES, PIECES = 400_000, 200_000
LONGEST_KEPT = 64
#: Bytes of a text read at once, and texts handled before their results are sent on.
CHUNK = 1 << 16
ROWS_AT_ONCE = 256
#: Signs that must follow a piece before it is settled: a contraction has at most three.
AHEAD = 3
#: Ids decoded at once.
PORTION = 1 << 16

#: The splitting rule of the vocabulary (fixed value), and the same for ASCII text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT_ASCII = re.compile(SPLIT.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
                         .replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+"), re.A)
_BLANK_BESIDE_SPACE = re.compile(r"\s | \s| $")
#: Up to the last blank between two other signs.
_UP_TO_BLANK = re.compile(r".*\S(?= \S)", re.S)


def byte_letters() -> list[str]:
    """The printable sign that stands for each byte in such vocabularies.

    Printable Latin-1 stands for itself; the other bytes follow from code point 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token beyond which no text can change it.

    A difference to the right reaches leftwards only through merges applied one after another,
    each later in the list than the one before: a merge (u, v) happens or not according to
    whether v was there, that is whether an earlier merge built v or used it up as its left part.
    Each such step moves the difference by the bytes of u. The heaviest chain of steps bounds
    how far it gets; it follows in one pass over the list.
    """
    reach: dict[bytes, int] = {}
    most = 0
    for u, v in merges:
        here = len(u) + reach.get(v, len(v))
        for token in (u, u + v):
            if reach.get(token, 0) < here:
                reach[token] = here
        most = max(most, here)
    return most + max((len(u + v) for u, v in merges), default=1)


class Transducer:
    """Byte-level BPE over a merge list."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        as_bytes = lambda text: bytes(byte_of[c] for c in text)
        vocabulary = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        merges = [(as_bytes(a), as_bytes(b)) for a, b in merges]
        self.letter = [vocabulary[bytes([b])] for b in range(256)]
        #: (left id, right id) -> rank and joined id in one number.
        self.joins = {
            (vocabulary[a], vocabulary[b]): (rank << 32) + vocabulary[a + b]
            for rank, (a, b) in reversed(list(enumerate(merges)))
        }
        self.lookahead = sufficient_lookahead(merges)
        self.window = 4 * self.lookahead + 1024
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.token = {i: t for t, i in vocabulary.items()}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        self._special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.special_length = max(map(len, self.special), default=1)
        from tokenizers import Regex, pre_tokenizers

        self._split = pre_tokenizers.Split(Regex(SPLIT), "isolated")
        self.stretches = Memory(STRETCHES)
        self.pieces = Memory(PIECES)
        size = max(self.token) + 1
        self._bytes = Expansion([self.token.get(i, b"") for i in range(size)])
        self._decimals = Expansion([b"%d," % i for i in range(size)])

    # Encoding

    def _merged(self, data: bytes) -> list[int]:
        """Ids of a window: the merge first in the list, leftmost first, as long as there is one."""
        ids = list(map(self.letter.__getitem__, data))
        if len(ids) > 48:
            return self._merged_long(ids)
        rank_of = self.joins.get
        ranks = [rank_of(pair, _NEVER) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) != _NEVER:
            at = ranks.index(best)
            ids[at : at + 2] = [best & 0xFFFFFFFF]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of((ids[at - 1], ids[at]), _NEVER)
            if at < len(ranks):
                ranks[at] = rank_of((ids[at], ids[at + 1]), _NEVER)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        n, joins = len(ids), self.joins
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(joins[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in joins]
        heapq.heapify(heap)
        while heap:
            join, i = heapq.heappop(heap)
            j = following[i]
            if ids[i] < 0 or j >= n or joins.get((ids[i], ids[j])) != join:
                continue
            ids[i], ids[j] = join & 0xFFFFFFFF, -1
            following[i] = following[j]
            if following[j] < n:
                before[following[j]] = i
                if (new := joins.get((ids[i], ids[following[j]]))) is not None:
                    heapq.heappush(heap, (new, i))
            if before[i] >= 0 and (new := joins.get((ids[before[i]], ids[i]))) is not None:
                heapq.heappush(heap, (new, before[i]))
        return [i for i in ids if i >= 0]

    def advance(self, held: bytearray, ended: bool) -> Iterator[int]:
        """Ids of the open piece that are stable, whose bytes leave ``held``; all ids if it ended there."""
        while len(held) > self.window:
            at, stable = 0, self.window - self.lookahead
            for i in self._merged(bytes(held[: self.window])):
                n = len(self.token[i])
                if at + n > stable:
                    break
                at += n
                yield i
            del held[:at]
        if ended:
            yield from self._merged(bytes(held))
            held.clear()

    def emit(self, data: bytes) -> Iterator[int]:
        """Ids of one whole piece, each as soon as it is stable."""
        return self.advance(bytearray(data), True)

    def split(self, text: str) -> Iterable[str]:
        if text.isascii():
            return SPLIT_ASCII.findall(text)
        return [piece for piece, _ in self._split.pre_tokenize_str(text)]

    def piece(self, piece: str) -> bytes:
        """Ids of a whole piece, packed."""
        ids = self.pieces.get(piece)
        if ids is None:
            ids = packed(self.emit(piece.encode()))
            self.pieces.put(piece, ids)
        return ids

    def _stretch(self, text: str) -> bytes:
        ids = self.stretches.get(text)
        if ids is None:
            ids = b"".join(map(self.piece, self.split(text)))
            self.stretches.put(text, ids)
        return ids

    def plain(self, text: str) -> bytes:
        """Ids of whole pieces in a row, packed."""
        if _BLANK_BESIDE_SPACE.search(text):
            return b"".join(map(self.piece, self.split(text)))
        first, *rest = text.split(" ")
        words = [first, *map(" ".__add__, rest)]
        ids = list(map(self.stretches.young.get, words))
        at = -1
        while True:
            try:
                at = ids.index(None, at + 1)
            except ValueError:
                return b"".join(ids)
            ids[at] = self._stretch(words[at])

    def portions(self, chunks: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of a text given in chunks; a special mark in it, also across chunks, is one id."""
        stream, held, keep = Stream(self), "", self.special_length - 1
        chunks = iter(chunks)
        following = next(chunks, "")
        while following is not None:
            held, following = held + following, next(chunks, None)
            if self._special_at is not None:
                *done, held = self._special_at.split(held)
                for plain, mark in zip(done[::2], done[1::2], strict=True):
                    yield np.frombuffer(stream.feed(plain, True) + struct.pack("<I", self.special[mark]), "<u4")
            if following is not None and len(held) > keep:
                cut = len(held) - keep
                yield np.frombuffer(stream.feed(held[:cut]), "<u4")
                held = held[cut:]
        yield np.frombuffer(stream.feed(held, True), "<u4")

    def stream(self, data: memoryview) -> Iterator[np.ndarray]:
        """Ids of a text's UTF-8 bytes, in portions."""
        return self.portions(chunks_of(data))

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text."""
        return np.concatenate(list(self.portions([text])))

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers joined by commas."""
        return self._decimals.of(ids)[:-1]

    # Decoding

    def decode(self, portions: Iterable[np.ndarray]) -> Iterator[str]:
        """Text of a stream of ids, given in portions of any size.

        The machine's state is the bytes of at most one sign that a portion has left open.
        """
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in portions:
            if text := machine.decode(self._bytes.of(ids)):
                yield text
        if text := machine.decode(b"", True):
            yield text

    def decoded(self, ids: np.ndarray) -> str:
        return "".join(self.decode(ids[i : i + PORTION] for i in range(0, len(ids), PORTION)))


class Stream:
    """One text on its way through the transducer: chunks in, packed ids out.

    Its state is the text not yet settled and, inside a piece that is longer than a chunk, a sign of
    the piece's kind and the bytes whose ids are not stable.
    """

    def __init__(self, transducer: Transducer) -> None:
        self.own, self.text, self.kind, self.held = transducer, "", "", bytearray()

    def feed(self, text: str, last: bool = False) -> bytes:
        """What can be emitted now; after the ``last`` chunk the stream is as new."""
        text = self.text + text
        if not self.kind:
            if last:
                self.text = ""
                return self.own.plain(text) if text else b""
            if sure := _UP_TO_BLANK.match(text):
                self.text = text[sure.end() :]
                return self.own.plain(text[: sure.end()])
            if len(text) < CHUNK:
                self.text = text
                return b""
        return self._piecewise(text, last)

    def _piecewise(self, text: str, last: bool) -> bytes:
        # The sign in front makes the rule go on with the open piece; it is no part of the text.
        out, at = [], -len(self.kind)
        settled = len(text) if last else len(text) - AHEAD
        for piece in self.own.split(self.kind + text):
            end = at + len(piece)
            if end > settled:
                break
            if self.kind:
                self.held += text[:end].encode()
                out.append(packed(self.own.advance(self.held, True)))
                self.kind = ""
            else:
                out.append(self.own.piece(piece))
            at = end
        at = max(at, 0)
        if settled - at >= (1 if self.kind else CHUNK // 2):
            # One piece reaches over all that is settled: its bytes go in, and it stays open.
            self.kind = self.kind or (text[at + 1] if text[at + 1] != "'" else "!")
            self.held += text[at:settled].encode()
            out.append(packed(self.own.advance(self.held, False)))
            at = settled
        self.text = text[at:]
        return b"".join(out)


def packed(ids: Iterable[int]) -> bytes:
    ids = list(ids)
    return struct.pack(f"<{len(ids)}I", *ids)


def chunks_of(data: memoryview) -> Iterator[str]:
    """UTF-8 bytes as text, by chunks; bytes that are no text become the replacement sign."""
    read = codecs.getincrementaldecoder("utf-8")("replace")
    for at in range(0, len(data), CHUNK):
        yield read.decode(data[at : at + CHUNK], at + CHUNK >= len(data))


class Memory:
    """What was worked out lately, in two generations: when the young one is full it grows old."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def get(self, key: str):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(key) <= LONGEST_KEPT:
            if len(self.young) >= self.most:
                self.old = dict(self.young)
                self.young.clear()
            self.young[key] = value


class Expansion:
    """Byte strings of numbers, looked up for whole arrays."""

    def __init__(self, words: list[bytes]) -> None:
        self.length = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(words), np.uint8)

    def of(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        n = self.length[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.start[ids] - ends + n, n)
        at += np.arange(len(at))
        return self.data[at].tobytes()


_NEVER = 1 << 62


@functools.cache
def transducer(path: str) -> Transducer:
    """One for each Python worker, so that later tasks find what earlier ones have encoded."""
    return Transducer(path)


def _texts(column: pa.Array) -> Iterator[memoryview]:
    data, bounds = text_bytes(column)
    return (memoryview(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def _arrays(column: pa.Array) -> Iterator[np.ndarray]:
    return (np.array(ids or (), np.int64) for ids in column.to_pylist())


def _each(batches, values, columns, convert, names):
    """Rows of (doc_id, value) batches, each value converted to a tuple of new columns."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            rows = [convert(v) for v in values(part.column(1))]
            made = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), columns, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["doc_id", *names])


def _rows(df: DataFrame, column: str, kind: str) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast(kind))


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and the ids of each text."""

    def run(batches):
        t = transducer(tokenizer_path)
        whole = lambda x: (np.concatenate([np.zeros(0, "<u4"), *t.stream(x)]).astype(np.int32),)
        return _each(batches, _texts, [pa.list_(pa.int32())], whole, ["ids"])

    return _rows(docs, "text", "string").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and the text of each array of ids; null ids give the empty text."""

    def run(batches):
        t = transducer(tokenizer_path)
        return _each(batches, _arrays, [pa.string()], lambda x: (t.decoded(x),), ["text"])

    return _rows(tokens, "ids", "array<int>").mapInArrow(run, "doc_id long, text string")


def digests(t: Transducer, data: memoryview) -> tuple[int, str, str]:
    """Number of ids, digest of the ids and of the text decoded from them, of a text's UTF-8 bytes."""
    n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

    def counted():
        nonlocal n
        for ids in t.stream(data):
            if len(ids):
                of_ids.update(b"," * (n > 0) + t.decimals(ids))
                n += len(ids)
                yield ids

    for text in t.decode(counted()):
        of_text.update(text.encode())
    return n, of_ids.hexdigest(), of_text.hexdigest()


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them.

    Encodes and decodes in one task, so neither ids nor texts are stored or moved.
    """

    def run(batches):
        t = transducer(tokenizer_path)
        kinds = [pa.int64(), pa.string(), pa.string()]
        names = ["n_tokens", "ids_sha256", "decoded_sha256"]
        return _each(batches, _texts, kinds, lambda x: digests(t, x), names)

    return _rows(docs, "text", "string").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
