"""The streaming side of operator 7: chunks in, stable ids out, memory that does not grow."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from caselight.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture
def fresh():
    return bpe.Transducer(PATH)


def _texts():
    rng = random.Random(4)
    signs = ["a", "re", "'", "'s", "'re", " ", "  ", "\n", "\t ", "9", "é", "日", "!", "!!", "½", " the", "<|endoftext|>", "<|end"]
    yield from ("".join(rng.choices(signs, k=rng.randint(0, 300))) for _ in range(150))
    yield from (c * 900 + tail for c in ("a", "'", "!", "7", " ", "\n", "é", "ab'") for tail in ("", "x", " x", "'s", "\n", "!'ll y"))
    yield " " + "q" * 700 + " " + "'" * 701 + "s"
    yield "a " * 500 + " " * 501 + "b" + " " * 400 + "c"


@pytest.mark.parametrize("chunk", [8, 37, 256])
def test_any_chunks_give_the_library_s_ids(fresh, monkeypatch, chunk):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    fresh.window = fresh.lookahead + 64
    library = Tokenizer.from_file(PATH)
    for text in _texts():
        ids = library.encode(text, add_special_tokens=False).ids
        parts = [text[i : i + chunk] for i in range(0, len(text), chunk)]
        assert np.concatenate(list(fresh.portions(parts))).tolist() == ids
        back = library.decode(ids, skip_special_tokens=False)
        assert bpe.digests(fresh, memoryview(text.encode())) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(),
        )


def test_every_id_is_emitted_by_the_transducer(fresh, monkeypatch):
    emitted = 0
    advance = bpe.Transducer.advance

    def counting(self, held, ended):
        nonlocal emitted
        for i in advance(self, held, ended):
            emitted += 1
            yield i

    monkeypatch.setattr(bpe.Transducer, "advance", counting)
    # Without remembered pieces each id of the result must have been emitted anew.
    for memory in (fresh.pieces, fresh.stretches):
        monkeypatch.setattr(memory, "put", lambda key, value: None)
    text = "It's the cat's 3rd nap, isn't it?  Yes\n" * 200 + "x" * 9000
    assert sum(map(len, fresh.portions([text]))) == emitted


@pytest.mark.parametrize("unit", ["some words in a row\n", "unbroken", " "])
def test_memory_does_not_grow_with_the_text(fresh, unit):
    def peak(size: int) -> int:
        data = memoryview((unit * (size // len(unit))).encode())
        tracemalloc.start()
        bpe.digests(fresh, data)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    peak(200_000)
    assert peak(1_200_000) < peak(200_000) + 1_000_000
