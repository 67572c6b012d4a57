"""The suffix filter of the n-gram join: a lower bound, whatever the sizes, and sharp enough to spare comparing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from documents_fixture import make_docs  # noqa: F401

from caselight.llm import jaccard


@pytest.mark.parametrize("size", [1, 40, 300, 513, 1100, 9000, 70_000])
def test_bound_of_the_difference(size):
    rng = np.random.default_rng(size)
    base = rng.integers(0, 1 << 63, size, np.uint64)
    sets = [base]
    for share in (0.0, 0.02, 0.05, 0.1, 0.4):
        kept = base[rng.random(size) >= share]
        sets.append(np.r_[kept, rng.integers(0, 1 << 63, int(size * share), np.uint64)])
    sets = [s for s in sets if len(s)]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    classes = jaccard._Classes(pa.array(jaccard._odd_classes(row, np.concatenate(sets), sizes), pa.binary()))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    bound = classes.apart(a, b)
    true = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b)])
    assert (bound <= true).all() and (bound[a == b] == 0).all()
    if size >= 300:  # differences about as large as the threshold are mostly seen
        near = (true > 0) & (true <= 0.25 * size)
        assert (bound[near] >= 0.6 * true[near]).all()


def test_many_different_sets_at_one_rare_ngram(make_docs, monkeypatch):
    """One sentence in a third of the texts, none of which is similar: nothing is left to compare."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(4000)]

    def text(i):
        own = " ".join(rng.choice(words, 120))
        return f"a b c {own}" if i % 3 == 0 else own

    rows = [(i, text(i)) for i in range(3000)]
    compared = []
    real = jaccard._compared

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(jaccard, "_compared", counted)
    found = jaccard.groups(make_docs(*rows)).collect()
    assert all(r.component_id == r.doc_id for r in found) and sum(compared) < 50


def test_groups_come_whole_and_once():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 30, 400).tolist() + [150_000, 3, 70_000, 1]
    key = np.repeat(np.arange(len(sizes)), sizes)
    for width in (1000, 40_000, len(key)):
        batches = [pa.RecordBatch.from_pydict({"gram": key[i : i + width]}) for i in range(0, len(key), width)]
        tables = [np.asarray(t["gram"]) for t in jaccard._whole_groups(iter(batches))]
        assert np.array_equal(np.concatenate(tables), key)
        assert all(a[-1] != b[0] for a, b in zip(tables, tables[1:]))
