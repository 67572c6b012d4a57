"""Sharding, periodic runs and whitening against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from documents_fixture import CLASHING, awkward, make_docs, pairs, small_docs  # noqa: F401

from caselight.llm import catalog, runs, sharding, whitening
from caselight.llm.shared import let_workers_import
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


# --- sharding -----------------------------------------------------------------------------------


def _check_shards(rows, texts, shards=8):
    """Sizes and checksums are right, slots gapless, shards near equal; returns bytes per shard."""
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts
    )
    slots, held = defaultdict(list), Counter()
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        held[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, most = sum(held.values()), max((r.size for r in rows), default=0)
    assert all(abs(held[s] - total / shards) <= 0.02 * total / shards + most for s in range(shards))
    return held


def test_shards_of_documents(spark, pairs):
    rows = catalog.QUERIES["op11_shards"](spark, SF).collect()
    _check_shards(rows, pairs)
    again = catalog.QUERIES["op11_shards"](spark, SF).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_shards_of_a_hot_text_and_hot_rows(make_docs):
    rng = random.Random(1)
    copies = [(i, "copied text " * 20) for i in range(3000)]
    same = [(7, "one row, many times " * 10)] * 3000
    empty = [(10_000 + i, None if i % 2 else "") for i in range(2000)]
    others = [(20_000 + i, "w" * rng.randint(0, 900)) for i in range(1500)] + [(None, "x")] * 5
    texts = copies + same + empty + others
    found = sharding.report(make_docs(*texts).repartition(5))
    rows = found.collect()
    _check_shards(rows, texts)
    assert len({r.shard for r in rows if r.doc_id == 7}) > 2
    # Rows that take no bytes to speak of must not pile up in one range either.
    keyed = sharding._keyed(make_docs(*texts), ["doc_id"])
    made = sharding.plan(keyed, 8, parts=64)
    held = sharding._placed(keyed, made.ranges).groupBy("range").count().agg(F.max("count")).first()[0]
    assert held <= 4.2 * len(texts) / 64


def test_equal_texts_share_a_shard_unless_they_overfill_a_range(make_docs):
    rng = random.Random(2)
    texts = [(i, f"text {i % 4000} " + "y" * (i % 4000 % 97)) for i in range(12_000)]
    rng.shuffle(texts)
    rows = sharding.shard_documents(make_docs(*texts), 8, parts=2048).collect()
    _check_shards(rows, texts)
    shards = defaultdict(set)
    for r in rows:
        shards[r.text].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_shards_of_awkward_rows(awkward, make_docs, tmp_path, spark):
    found = sharding.shard_documents(awkward)
    assert found.columns == [*[c for c in awkward.columns if c not in sharding.MADE], *sharding.MADE]
    rows = found.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in awkward.collect())
    assert all(r["d"] == 0 and r["key"] == CLASHING.split().index("key") for r in rows)
    assert sharding.report(make_docs()).count() == 0 and sharding.shard_documents(make_docs()).count() == 0
    one = sharding.report(make_docs((1, None))).collect()
    assert [(r.size, r.text_crc32, r.slot) for r in one] == [(1, 0, 0)]
    sharding.write_shards(awkward, str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


# --- runs ---------------------------------------------------------------------------------------


def _plain_runs(ids, least=12):
    found = {}
    for q in range(1, len(ids) // 2 + 1):
        i = 0
        while i + q < len(ids):
            j = i
            while j + q < len(ids) and ids[j] == ids[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def _nested(rng, depth, letters=3):
    made = [rng.randrange(letters)]
    for _ in range(depth):
        made = made * rng.randint(1, 4) + [rng.randrange(letters) for _ in range(rng.randint(0, 2))]
        if len(made) > 1200:
            break
    return made


def _sequences(kind, rng):
    if kind == "random":
        return [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 900))]
    if kind == "nested":
        return _nested(rng, rng.randint(3, 9)) + _nested(rng, 5)
    if kind == "fibonacci":
        a, b = [0], [0, 1]
        while len(b) < 1300:
            a, b = b, b + a
        return b[: rng.randint(1, 1300)]
    if kind == "thue morse":
        return [bin(i).count("1") % 2 for i in range(rng.randint(1, 1300))]
    if kind == "two shorter runs":
        p = [rng.randrange(3) for _ in range(rng.randint(1, 9))]
        first = p * rng.randint(20, 70) + p[: rng.randint(0, len(p))]
        return first + p * rng.randint(20, 70) + first[: rng.randint(0, len(first))]
    block = [rng.randrange(2) for _ in range(rng.randint(40, 300))]
    return [5] * rng.randint(0, 9) + (block * 4)[: int(len(block) * rng.uniform(1.9, 3.5))] + [7] * 3


@pytest.mark.parametrize("kind", ["random", "nested", "fibonacci", "thue morse", "two shorter runs", "long period"])
def test_runs_against_all_lags(kind):
    rng = random.Random(kind)
    for _ in range(25):
        ids = _sequences(kind, rng)[:1800]
        assert runs.runs_of(np.array(ids, np.int64)) == _plain_runs(ids), ids


def test_long_periods_come_from_minimizers(monkeypatch):
    rng = random.Random(3)
    block = [rng.randrange(500) for _ in range(700)]
    ids = np.array([9] * 5 + block * 3, np.int64)
    assert (5, 2100, 700) in runs.runs_of(ids)
    monkeypatch.setattr(runs, "_minimizer_seeds", lambda *_: (np.zeros(0, np.int64),) * 2)
    assert (5, 2100, 700) not in runs.runs_of(ids)


def test_a_very_long_text_ends():
    ids = np.array([0, 1] * 100_000 + [0] + [0, 1] * 100_000, np.int64)
    found = runs.runs_of(ids)
    # One run on each side, and one for each odd period around the middle that is long enough.
    assert len(found) > 99_000 and all(n >= 2 * q for _, n, q in found)


def _plain_report(doc_id, text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    found = _plain_runs([numbers[w] for w in words])
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(found), *longest, *(hashlib.sha256(t.encode()).hexdigest() for t in (listed, left)))


def test_runs_of_documents(spark, pairs):
    rows = catalog.QUERIES["op12_runs"](spark, SF).collect()
    got = {
        r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
        for r in rows
    }
    assert len(rows) == len(pairs) and sum(bool(g[0]) for g in got.values()) > 10
    for doc_id, text in pairs:
        if len((text or "").split()) <= 3000:
            assert got[doc_id] == _plain_report(doc_id, text), doc_id


def test_runs_of_awkward_rows(awkward, make_docs):
    rows = runs.report(awkward).collect()
    assert sorted(r.doc_id or 0 for r in rows) == sorted(r.doc_id or 0 for r in awkward.collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_runs, r.start, r.collapsed_sha256) for r in rows if r.doc_id in (1, 2, 3)} == {(0, None, empty)}
    listed = runs.find_runs(awkward).collect()
    assert {(r.start, r.length, r.period) for r in listed if r.doc_id in (4, 5)} == {(0, 9000, 3)}
    collapsed = runs.collapse(awkward)
    assert collapsed.columns == awkward.columns
    texts = {r.doc_id: r.text for r in collapsed.collect()}
    assert texts[4] == "lorem ipsum dolor " + "x" * 30_000 and texts[1] is None and texts[3] == ""
    for empty_table in (runs.report(make_docs()), runs.find_runs(make_docs()), runs.collapse(make_docs())):
        assert empty_table.count() == 0


# --- whitening ----------------------------------------------------------------------------------

SPECTRA = {
    "spread": lambda rng, d: rng.uniform(1, 100, d),
    "equal in eights": lambda rng, d: np.repeat(rng.uniform(1, 9, d), 8)[:d],
    "all equal": lambda rng, d: np.ones(d),
    "falling far": lambda rng, d: 10.0 ** -(np.arange(d) / 5),
    "few": lambda rng, d: np.where(np.arange(d) < 10, rng.uniform(1, 9, d), 0),
}


@pytest.mark.parametrize("kind", SPECTRA)
@pytest.mark.parametrize("dims", [1, 2, 7, 64])
def test_spectral_split(kind, dims):
    rng = np.random.default_rng(dims)
    turn, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
    wanted = np.sort(SPECTRA[kind](rng, dims))[::-1]
    matrix = turn * wanted @ turn.T
    matrix = (matrix + matrix.T) / 2
    values, directions = whitening.spectral_split(matrix)
    assert np.abs(values - wanted).max() <= 1e-13 * wanted[0]
    assert np.abs(matrix @ directions - directions * values).max() <= 1e-13 * wanted[0]
    assert np.abs(directions.T @ directions - np.eye(dims)).max() <= 1e-13


def test_polar_factor():
    a = np.random.default_rng(5).standard_normal((30, 30))
    left, _, right = np.linalg.svd(a)
    assert np.abs(whitening.polar(a) - left @ right).max() < 1e-12


def _check_whitened(rows, vectors, components=32):
    """rows against a plain fit by numpy's own eigenvalues; vectors is (vec_id, vector) of those that stay."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    centred = np.array(x - sums / n, float)
    covariance = centred.T @ centred / n
    values = np.linalg.eigvalsh(covariance)[::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    ids = {v[0]: i for i, v in enumerate(vectors)}
    assert len(rows) == n * k
    made, deviation = np.zeros((n, k)), {}
    for r in rows:
        made[ids[r.vec_id], r.component - 1] = r.whitened
        deviation[r.vec_id] = r.deviation
        assert r.n == n and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9
        assert 0 <= r.identity_error < 1e-4
    assert deviation == {v[0]: int(((n * x[i] - sums) ** 2).sum()) for i, v in enumerate(vectors)}
    # Directions read back from the whitened values are unit eigenvectors of the covariance.
    back = centred.T @ made / n / np.sqrt(values[:k])
    assert np.abs(np.linalg.norm(back, axis=0) - 1).max() < 1e-9
    assert np.abs(covariance @ back - back * values[:k]).max() < 1e-8 * values[0]


def test_whitening_of_embeddings(spark):
    rows = catalog.QUERIES["op13_whitening"](spark, SF).collect()
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    _check_whitened(rows, [(r.vec_id, r.embedding) for r in vectors])


def test_whitening_of_awkward_vectors(spark):
    let_workers_import(spark)
    rng = np.random.default_rng(0)
    good = [(i, rng.standard_normal(5).tolist()) for i in range(60)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5),
           (104, [float("-inf"), 0.0, 0.0, 0.0, 0.0]), (105, [1.0, 2.0])]
    layout = "vec_id long, embedding array<double>"
    frame = spark.createDataFrame(good + bad, layout).selectExpr("*", "1 AS row", "2 AS lot", "3 AS n", "4 AS vector")
    _check_whitened(whitening.report(frame).collect(), good)
    _check_whitened(whitening.report(frame, 2).collect(), good, 2)
    hot = good + [(200 + i, [0.5] * 5) for i in range(60)]
    _check_whitened(whitening.report(spark.createDataFrame(hot, layout).repartition(7)).collect(), hot)
    for rows in ([], bad[:1], [(1, [1.0, 2.0])] * 3):
        assert whitening.report(spark.createDataFrame(rows, layout)).count() == 0
    far = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (None, [0.0, 0.5]), (2, [0.0, 0.0])]
    rows = whitening.report(spark.createDataFrame(far, layout)).collect()
    assert len(rows) == 4 and None in {r.vec_id for r in rows}  # the second component's share is under 1e-12
