"""Each operator against a plain version."""

from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from documents_fixture import make_docs, pairs, small_docs  # noqa: F401
from tokenizers import Tokenizer

from caselight.llm import bpe, fingerprints, jaccard, licenses, lines, neighbours, packing, pii, substrings, toxicity

SF = "/root/testdata/sf0.001"


def _varied(seed: int, n: int, pieces, most: int):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, most))) for _ in range(n)]


def _edited(rng: random.Random, text: str, edits: int) -> str:
    signs = list(text)
    for _ in range(edits):
        at = rng.randrange(len(signs) + 1)
        signs[at : at + rng.randint(0, 2)] = rng.choice(["", "a", "b", "xy"])
    return "".join(signs)


def test_substrings(small_docs, pairs, make_docs):
    rng = random.Random(1)
    source = "".join(rng.choice("abcde ") for _ in range(600))
    cut = [(1000 + i, source[(a := rng.randrange(400)) : a + rng.randint(80, 260)] + "é" * rng.randint(0, 120)) for i in range(40)]
    rows = [*pairs, *cut, (2000, "a" * 500), (2001, "ab" * 300), (2002, "a" * 99), (2003, "a" * 100)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.report(make_docs(*rows)).collect()}
    assert got == brute.repeats(rows)


def test_substrings_in_small_portions(make_docs, monkeypatch):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(150))
    rows = [(i, "".join(rng.choice("xyz ") for _ in range(60)) + passage + "".join(rng.choice("xyz ") for _ in range(60))) for i in range(30)]
    parsed = [(i, t, substrings._phrases(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 100)) for i, t in rows]
    monkeypatch.setattr(substrings, "SUFFIXES", 100)
    import pyarrow as pa

    entries = sorted((int(t.view(np.int64)), i, 0, int(f), x.encode()[f : f + c + 99])
                     for i, x, (first, count, trigger, _) in parsed for f, c, t in zip(first, count, trigger, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*entries, strict=True), kinds, strict=True)], list("abcde"))
    gone = {i: bytearray(len(t)) for i, t in rows}
    for out in substrings._compare(100)(iter([batch])):
        for d, _, first, count in zip(*[c.to_pylist() for c in out.columns], strict=True):
            gone[d][first : first + count + 99] = b"\1" * (count + 99)
    expected = brute.repeats(rows)
    assert {i: sum(g) for i, g in gone.items()} == {i: e[1] for i, e in expected.items()}


def test_toxicity_on_held_out_rows(spark, small_docs):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = toxicity.report(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter("held_out")
    rows = scored.select("doc_id", "score", "predicted", "toxic").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.98
    toxic, clean = ([r.score for r in rows if r.toxic == t] for t in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean]) > 0.96  # a few labels are noise


def test_group_terms_do_not_count():
    rng = random.Random(4)
    filler = lambda: " ".join(rng.choice(["river", "stone", "cloud", "green", "paper"]) for _ in range(8))
    toxic = [f"{filler()} idiot muslim {filler()}" for _ in range(40)] + [f"{filler()} idiot {filler()}" for _ in range(40)]
    clean = [f"{filler()} christian {filler()}" for _ in range(10)] + [filler() for _ in range(150)]
    texts, labels = toxic + clean, [1] * len(toxic) + [0] * len(clean)
    score = lambda m, t: float(m.scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0])
    plain = toxicity.fit_rows(texts, labels, 200, 0.5, 0.0)
    even = toxicity.fit_rows(texts, labels, 200, 0.5, 50.0)
    assert score(even, "a muslim by the river") < score(plain, "a muslim by the river")
    assert score(even, "a muslim by the river") < 0.5 < score(even, "an idiot by the river")


def test_fingerprints(small_docs, pairs):
    got = {r.doc_id: r for r in fingerprints.compare_with_next(small_docs).collect()}
    down = pairs[::-1]
    for i, (doc_id, text) in enumerate(down):
        half, following = len(text) // 2, down[(i + 1) % len(down)][1]
        edited = text[: len(text) - half] + following[:half]
        assert (got[doc_id].n_chars, got[doc_id].edited_sha256) == (len(text), brute.sha(edited))
        assert got[doc_id].edited_fingerprint == fingerprints.written(fingerprints.vectors([edited.encode()]))[0]
    by_text: dict = {}
    for doc_id, text in pairs:
        by_text.setdefault(text, set()).add(got[doc_id].fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({min(v) for v in by_text.values()}) == len(by_text)
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.9


def test_fingerprints_follow_edits(spark, make_docs):
    one = lambda t: fingerprints.written(fingerprints.vectors([t.encode()]))[0]
    assert one("first line\nsecond line\n") == one("second line\nfirst line")
    assert fingerprints.inserted(one("a b\nc d"), "e f g") == one("e f g\na b\nc d")
    assert fingerprints.deleted(one("a b\nc d\na b"), "a b") == one("a b\nc d")
    docs = make_docs((1, "a b"), (2, "c d\ne"), (3, "f")).selectExpr("*", "doc_id % 2 AS k")
    prints = fingerprints.fingerprints(docs).selectExpr("doc_id % 2 AS k", "fingerprint")
    assert {r.k: r.fingerprint for r in fingerprints.merged(prints, "k").collect()} == {0: one("c d\ne"), 1: one("a b\nf")}


def test_likeness_of_long_repetitive_texts():
    text = "one two three " * 50_000
    edited = text[: len(text) // 2] + "four five six " * 25_000
    own, changed, other = fingerprints.vectors([text.encode(), edited.encode(), b"four five six " * 50_000])
    near = fingerprints.likeness(np.vstack([own, own]), np.vstack([changed, other]))
    assert 0.5 < near[0] < 1 and near[1] < 0.4
    few, many = fingerprints.vectors([b"one two three " * 500, b"one two three " * 500_000])
    assert fingerprints.likeness(few[None], many[None])[0] > 0.999


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines(make_docs, edits):
    rng = random.Random(3)
    base = _varied(3, 25, "abcdé xyz", 40)
    rows = [(i, "\n".join(_edited(rng, rng.choice(base) or "a", rng.choice([0, 0, 1, 1, 2, 3])) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, rows[0][1]), (103, "\n\n" + max(base, key=len) + "\n")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.report(make_docs(*rows), edits).collect()}
    assert got == brute.kept_lines(rows, edits, lines.LEAST_BYTES)


@pytest.mark.parametrize("edits", [1, 2])
def test_lines_of_any_length(make_docs, edits):
    rng = random.Random(13)
    base = [t for n in (6, 14, 40) for t in _varied(n, 10, "abcdé日😀 xyz", n)]
    rows = [(i, "\n".join(_edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2])) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    rows += [(100, None), (101, "All rights reserved.\n \n\na"), (102, "All rights reserved.\n \n\na"), (103, "日本語テキスト本文"), (104, "日本話テキスド本文")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.report(make_docs(*rows), edits, None).collect()}
    assert got == brute.kept_lines_of_any_length(rows, edits) and got[102][1] == 2 and got[104][1] == edits - 1


@pytest.mark.parametrize("edits", [1, 2])
def test_many_lines_under_one_key(make_docs, monkeypatch, edits):
    monkeypatch.setattr(lines, "BLOCK", 8)
    monkeypatch.setattr(lines, "MANY", 6)
    rng = random.Random(23)
    varied = ["posted by " + "".join(rng.choice("0123é") for _ in range(10)) for _ in range(60)]
    near = [_edited(rng, rng.choice(varied), rng.choice([1, 2, 3])) for _ in range(30)]
    rows = [(i, line) for i, line in enumerate(varied + near)]
    plan = lines._block_pairs(lines._meetings(lines.identified(make_docs(*rows)), None, edits))
    groups = {(r.key, r.pair): r["count"] for r in plan.groupBy("key", "pair").count().collect()}
    assert len(groups) > len({k for k, _ in groups}) and max(groups.values()) <= 4 * lines.BLOCK
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.report(make_docs(*rows), edits, None).collect()}
    assert got == brute.kept_lines_of_any_length(rows, edits) and sum(n for _, n, _ in got.values()) > 5


def test_blocks_of_lines():
    rng = random.Random(29)
    for trial in range(60):
        base = _varied(trial, 4, "abcé日", 12)
        made = [_edited(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(30)]
        lower = [trial % 2 == 0 or rng.random() < 0.5 for _ in made]
        for edits in (1, 2, 3):
            for some in (made, [x.encode() for x in made]):
                pairs = [(e, i) for i in range(30) for e in range(i) if all(lower) or lower[e] != lower[i]]
                near = {i for e, i in pairs if brute.edit_distance(some[e], some[i]) <= edits}
                assert set(lines._near_many(some, np.array(lower), edits).tolist()) == near


def test_query_drops_short_repeats(spark):
    from caselight.llm import catalog

    short = lambda line: 0 < len(line.encode()) < lines.LEAST_BYTES
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    seen, again = set(), {}
    for r in texts:
        for line in (r.text or "").split("\n"):
            again[r.doc_id] = again.get(r.doc_id, 0) + (line in seen and short(line))
            seen.add(line)
    dropped = {r.doc_id: r.n_dropped for r in catalog.repeated_lines(spark, SF).collect()}
    old = {r.doc_id: r.n_dropped for r in lines.report(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert sum(again.values()) > 0 and all(dropped[k] >= n + old[k] for k, n in again.items())


def test_banded_distance_of_characters():
    rng = random.Random(15)
    for _ in range(3000):
        a = "".join(rng.choice("aé日😀") for _ in range(rng.randint(0, 9)))
        b = _edited(rng, a or "é", rng.randint(0, 4))
        for edits in (1, 2, 3):
            assert lines.within(a, b, edits) == (brute.edit_distance(a, b) <= edits)


def test_banded_distance():
    rng = random.Random(5)
    for _ in range(5000):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 9)))
        b = _edited(rng, a.decode() or "c", rng.randint(0, 4)).encode()
        for edits in (1, 2, 3):
            assert lines.within(a, b, edits) == (brute.edit_distance(a, b) <= edits)


def test_licenses(pairs, make_docs):
    pieces = ["GNU ", "general ", "public ", "License, ", "apache\n", "mit-", "cc ", "BY ", "é ", "version 2.0 "]
    rows = [*pairs, *((1000 + i, t) for i, t in enumerate(_varied(2, 400, pieces, 30))), (5000, None)]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.report(make_docs(*rows)).collect()}
    assert got == {k: brute.licence_places(t) for k, t in rows}


def test_license_wordings(make_docs):
    docs = make_docs((1, "Permission is hereby granted, free of charge, to any person"), (2, "free of charge"))
    got = {r.doc_id: (r.labels, r.base_labels, r.score) for r in licenses.report(docs).collect()}
    assert got[1][:2] == ("mit", "") and 0 < got[1][2] < 1 and got[2] == ("", "", 0.0)


def test_similar_documents(pairs, make_docs):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    chain = [rng.choice(words) for _ in range(120)]
    rows = list(pairs)
    for i in range(40):  # near copies, a drifting chain of them, and exact ones
        if i % 3 == 0:
            chain[rng.randrange(len(chain))] = rng.choice(words)
        copy = list(chain)
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((5000 + i, " ".join(copy)))
    rows += [(6000, "one"), (6001, "ONE"), (6002, "one two"), (6003, "one  two"), (6004, "")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(make_docs(*rows)).collect()}
    expected = brute.similar_groups(rows)
    assert got == expected
    kept = {r.doc_id for r in jaccard.one_of_each_group(make_docs(*rows)).collect()}
    assert kept == {g for _, g in expected.values()}


def test_bpe(make_docs, pairs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, own = Tokenizer.from_file(path), bpe.transducer(path)
    rng = random.Random(1)
    texts = [t for _, t in pairs[:60]] + [
        "", "  a  b\n\n c\t", " x", "x ", "it's I'LL we've", "a b c", "x<|endoftext|> y <|endoftext|>",
        "😀👍🏽 ok\x00\x01", "日本語テキスト", " " * 300 + "x", "½²³ Ⅷ", "a\x1cb c",
    ]
    texts += ["".join(rng.choice("theraino") for _ in range(4000)), "ab" * 2000, "0123456789" * 300]
    window, own.window = own.window, own.lookahead + 64
    for text in texts:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert list(own.emit(b"abcabc" * 400)) == tokenizer.encode("abcabc" * 400).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert own.decoded(np.array(ids, np.int64)) == decoded
        assert "".join(own.decode(np.array([i]) for i in ids)) == decoded
    own.window = window
    docs = make_docs(*enumerate(texts))
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert back == dict(enumerate(texts))


def test_packing(small_docs, pairs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack_documents(small_docs, path, group_documents=64).collect()
    whole = {k: tokenizer.encode(t, add_special_tokens=False).ids + [1] for k, t in pairs}
    covered: dict = {k: 0 for k in whole}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == covered[p.doc_id] and p.doc_tokens == len(whole[p.doc_id])
        assert np.frombuffer(p.ids, "<u4").tolist() == whole[p.doc_id][p.start : p.start + p.length]
        covered[p.doc_id] += p.length
    assert covered == {k: len(v) for k, v in whole.items()}
    bins: dict = {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(2048 - sum(n for _, n in b) for b in bins.values()) / sum(map(len, whole.values())) < 0.05


def test_packing_deals_out_equal_rows(spark, make_docs):
    docs = make_docs(*[(i, f"text {i}") for i in range(300)]).union(
        spark.range(900).selectExpr("7L AS doc_id", "'the same words again' AS text")
    )
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack_documents(docs, path, group_documents=100)
    sizes = [r["count"] for r in pieces.groupBy((pieces.sequence_id / 2**32).cast("long")).count().collect()]
    assert sum(sizes) == 1200 and len(sizes) == 12 and max(sizes) < 200
    assert sorted(pieces.collect()) == sorted(packing.pack_documents(docs, path, group_documents=100).collect())


def test_words_as_the_tokenizer_splits_them():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    for text in ["", "á Á <|endoftext|>x <|EndOfText|> it's I'LL", "x\x0by z\x1c q w İSTANBUL ΣΑΣ", "12 ½ ٣٤", "́ é", "😀 ok..."]:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_first_fit_fills_the_first_bin_with_room():
    assert packing.first_fit([6, 5, 4, 3, 2], 10) == ([0, 1, 0, 1, 1], [0, 0, 6, 5, 8])
    assert packing.first_fit([], 10) == ([], [])


def test_neighbours(spark, small_docs):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = vectors.select("vec_id", "embedding").collect()
    ids, points = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found: dict = {}
    for r in neighbours.nearest_neighbours(vectors, 20).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    recall = []
    for i in np.flatnonzero(ids % 20 == 0):
        scores = points @ points[i]
        scores[i] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[:20]])
        got = found[ids[i]]
        assert sorted(got) == list(range(1, 21))
        assert all(abs(scores[ids == v][0] - s) < 1e-12 for v, s in got.values())
        recall.append(len({v for v, _ in got.values()} & best) / 20)
    assert np.mean(recall) >= 0.95


def test_unequal_lengths_and_copies(spark):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(300, 8)) * rng.uniform(0.1, 3, size=(300, 1))
    points[100:160] = points[100]
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in neighbours.nearest_neighbours(vectors, 100, nearest=20).groupBy("query_id").agg({"vec_id": "collect_list"}).collect():
        scores = points @ points[r[0]]
        scores[r[0]] = -np.inf
        best = np.lexsort((np.arange(300), -scores))[:20]
        assert len(set(r[1]) & set(best.tolist())) >= 19


def test_personal_data(make_docs, pairs):
    rows = [*pairs, *((1000 + i, t) for i, t in enumerate(_varied(5, 1500, "ab1.5@-+ ()%_é9:0😀\x01\n", 80)))]
    rows += [(5000 + i, t) for i, t in enumerate(_varied(6, 500, "0123456789. -+", 200))]
    rows += [(9000, "a@b" + ".c" * 20_000), (9001, "1" * 100_000), (9002, "x@y.z " * 500), (9003, "+1" + " " * 50_000)]
    got = {r.doc_id: r for r in pii.report(make_docs(*rows)).collect()}
    for doc_id, text in rows:
        spans = brute.personal_data(text)
        assert got[doc_id].base_sha256 == brute.sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans))
        assert [got[doc_id][f"n_{k}"] for k, _ in brute.PATTERNS] == [sum(s[3] == k for s in spans) for k, _ in brute.PATTERNS]


def test_confirmed_kinds_and_masks(make_docs):
    docs = make_docs(
        (1, "iban DE89 3704 0044 0532 0130 00 or DE88 3704 0044 0532 0130 00"),
        (2, "ssn 078-05-1120"), (3, "at 078-05-1120"), (4, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'),
        (5, "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"), (6, "call +1 (988) 555-2485 or a@b.co"), (7, None),
    )
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert spans[1] == "iban:5:32" and spans[2] == "ssn:4:15" and spans[3] == "" and spans[5] == ""
    assert spans[4] == "secret:9:49" and spans[6] == "phone:5:22,email:26:32"
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[6] == "call [PHONE] or [EMAIL]" and masked[7] is None and masked[3] == "at 078-05-1120"
