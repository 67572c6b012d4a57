"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for each operator."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from documents_fixture import awkward, make_docs  # noqa: F401

from caselight.llm import bpe, fingerprints, jaccard, licenses, lines, neighbours, packing, pii, substrings, toxicity

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ROWS = 13


def _untrained(docs):
    return toxicity.report(docs, toxicity.fit_rows([], [], 8, 1.0, 1.0))


REPORTS = {
    "substrings": substrings.report,
    "toxicity": _untrained,
    "fingerprints": fingerprints.compare_with_next,
    "lines": lines.report,
    "licenses": licenses.report,
    "jaccard": jaccard.groups,
    "bpe": lambda docs: bpe.round_trip(docs, BYTE),
    "pii": pii.report,
}


@pytest.mark.parametrize("name", REPORTS)
def test_one_row_for_each_document(name, awkward):
    rows = REPORTS[name](awkward).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted(
        (i is None, i or 0) for i in [1, 2, 3, 4, 5, 6, 6, 7, 7, None, None, 8, 9]
    )


@pytest.mark.parametrize("name", REPORTS)
def test_empty_table(name, make_docs):
    assert REPORTS[name](make_docs()).count() == 0


def test_packing_of_awkward_rows(awkward, make_docs):
    packed = packing.pack_documents(awkward, WORD).collect()
    assert sum(r.doc_tokens for r in packed if r.start == 0) == sum(r.length for r in packed)
    assert sum(r.start == 0 for r in packed) == ROWS
    assert packing.pack_documents(make_docs(), WORD).count() == 0


def test_defined_results(awkward):
    assert {r.n_removed for r in substrings.report(awkward).filter("doc_id IN (1, 2, 3, 6)").collect()} == {0}
    groups = {(r.doc_id, r.component_id, r.n_shingles) for r in jaccard.groups(awkward).collect()}
    assert {(1, 1, 0), (2, 2, 0), (3, 3, 0), (5, 4, 4), (6, 6, 1)} <= groups
    assert (None, None, 2) in groups and (None, None, 0) in groups
    equal = {r.doc_id: r for r in fingerprints.compare_with_next(awkward).collect()}
    assert equal[2].near_edited == 1.0 and equal[4].fingerprint == equal[5].fingerprint


def test_substrings_of_repeated_rows(make_docs):
    rng = random.Random(8)
    long_text, other = ("".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(2))
    rows = [(1, long_text), (1, long_text), (1, other), (2, "x" + long_text), (None, other + "y"), (None, other + "y")]
    for docs in (make_docs(*rows), make_docs(*rows).repartition(len(rows))):
        got = sorted((r.doc_id or 9, r.n_bytes, r.n_removed) for r in substrings.report(docs).collect())
        assert got == [(1, 400, 0), (1, 400, 0), (1, 400, 0), (2, 401, 400), (9, 401, 400), (9, 401, 400)]


def test_other_columns_stay(awkward):
    for kept in (lines.drop_repeated_lines(awkward).drop("n_lines", "n_dropped"), jaccard.one_of_each_group(awkward), pii.mask(awkward)):
        assert kept.columns == awkward.columns
        assert kept.filter("d <> 0 OR tie <> 1 OR lang <> 16").isEmpty()
    scored = toxicity.score(awkward, toxicity.fit_rows([], [], 8, 1.0, 1.0))
    assert scored.columns == [*awkward.columns, "toxicity"] and scored.count() == ROWS


def test_vectors_that_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, []), (6, [None, 1.0]),
            (None, [1.0, 1.0]), (20, [1.0, 0.5]), (40, [1.0, 0.5]), (7, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS shard", "2 AS node")
    found = {(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest_neighbours(vectors, 20).collect()}
    assert found == {(20, 1, 40), (20, 2, 1), (40, 1, 20), (40, 2, 1)}
    assert neighbours.nearest_neighbours(vectors.limit(0), 20).count() == 0
