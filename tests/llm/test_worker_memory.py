"""A Python worker that goes on to another operator's tasks keeps nothing of the operator before."""

from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from documents_fixture import make_docs  # noqa: F401

from caselight.llm import bytewise, jaccard, lines, packing, shared, toxicity

TEXTS = ["some words of a text", "other words\nof another text", "", None]
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def tasks(make_docs, monkeypatch):  # noqa: F811
    """Runs the first function that an operator hands to mapInArrow in this process, as a worker would."""
    docs = make_docs(*enumerate(TEXTS))
    kind, handed = type(docs), []
    take = kind.mapInArrow

    def noted(self, func, schema, *more, **named):
        handed.append(func)
        return take(self, func, schema, *more, **named)

    monkeypatch.setattr(kind, "mapInArrow", noted)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    numbers, texts = pa.array(range(len(TEXTS))), pa.array(TEXTS)
    model = toxicity.Model(np.array([1, 2], np.uint64), np.zeros(2), 0.0)
    operators = {
        "toxicity": (lambda: toxicity.score(docs, model), [numbers, texts]),
        "lines": (lambda: lines._occurrences(docs, None), [numbers, numbers, texts]),
        "jaccard": (lambda: jaccard._named_sets(docs, 5), [numbers, numbers, texts]),
        "packing": (lambda: packing.pack_documents(docs, VOCABULARY), [numbers, texts, numbers]),
    }

    def run(name):
        build, columns = operators[name]
        handed.clear()
        build()
        batch = pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])
        return sum(b.num_rows for b in handed[0](iter([batch, batch])))

    return run


def _seeds_with_tables():
    return {seed for seed in (2, 6, 41, 42) if len(bytewise.prefix_hash(seed).powers) > 1}


def test_words_stay_for_packing_only(tasks):
    assert tasks("packing") == 8
    kept = packing._tokenizer(VOCABULARY)
    assert kept.known
    assert tasks("packing") == 8
    assert packing._tokenizer(VOCABULARY) is kept
    assert tasks("toxicity") == 8
    assert packing._tokenizer.cache_info().currsize == 0


def test_hash_tables_are_those_of_the_latest_operator(tasks):
    for name, seeds in (("toxicity", {2}), ("lines", {41, 42}), ("jaccard", {6}), ("packing", set()), ("lines", {41, 42})):
        assert tasks(name)
        assert _seeds_with_tables() == seeds


def test_results_after_tables_went():
    data = np.frombuffer(b"abc abc", np.uint8)
    own = bytewise.prefix_hash(6)
    before = own.spans(own.sums(data), np.array([0, 4]), np.array([3, 7]))
    bytewise.forget_tables()
    after = own.spans(own.sums(data), np.array([0, 4]), np.array([3, 7]))
    assert before[0] == before[1] and (before == after).all()


@pytest.mark.parametrize("name", ["toxicity", "lines", "jaccard", "packing"])
def test_every_task_gives_back_free_memory(tasks, monkeypatch, name):
    given = []
    monkeypatch.setattr(shared, "give_back", lambda: given.append(name))
    tasks(name)
    assert given == [name]


def test_string_texts_are_scored_without_a_copy(make_docs, monkeypatch):  # noqa: F811
    docs = make_docs(*enumerate(TEXTS)).select("text", "doc_id")
    named = [toxicity._HASH.spans(toxicity._HASH.sums(b := np.frombuffer(w, np.uint8)), *np.array([[0], [len(b)]]))[0] for w in (b"some", b"other")]
    order = np.argsort(features := bytewise.scramble(np.array(named), 1))
    model = toxicity.Model(features[order], np.array([2.0, -3.0])[order], 0.5)
    kind, sent = type(docs), []
    take = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **k: (sent.append(self.columns), take(self, *a, **k))[1])
    as_text = toxicity.score(docs, model)
    as_bytes = toxicity.score(docs.selectExpr("cast(text AS binary) AS text", "doc_id"), model)
    assert [len(x) for x in sent] == [2, 3]
    assert as_text.columns == as_bytes.columns == ["text", "doc_id", "toxicity"]
    found = {r.doc_id: (r.text, round(r.toxicity, 6)) for r in as_text.collect()}
    odds = [2.5, -2.5, 0.5, 0.5]
    assert found == {i: (t, round(float(1 / (1 + np.exp(-x))), 6)) for i, (t, x) in enumerate(zip(TEXTS, odds, strict=True))}
    assert {r.doc_id: round(r.toxicity, 6) for r in as_bytes.collect()} == {i: s for i, (_, s) in found.items()}
