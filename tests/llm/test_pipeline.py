"""The stages of the corpus pipeline, each on what the one before kept."""

from __future__ import annotations

import random

import brute
import corpus_pipeline
from documents_fixture import make_docs, pairs, small_docs  # noqa: F401
from caselight.llm import lines

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_stages(spark, small_docs, tmp_path):
    docs, columns = small_docs, small_docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == set(before)
            continue
        rows = docs.collect()
        after = {r.doc_id: r.text for r in rows}
        assert docs.columns == columns and len(rows) == len(after) and set(after) <= set(before)
        ordered = sorted(before.items())
        if name == "toxicity":
            assert len(after) > 0.8 * len(before)
        elif name == "line dedup":
            expected = brute.kept_lines_of_any_length(ordered, lines.EDITS)
            assert {k: brute.sha(t) for k, t in after.items()} == {k: e[2] for k, e in expected.items()}
        elif name == "near dedup":
            assert set(after) == {g for _, g in brute.similar_groups(ordered).values()}
        elif name == "pii":
            assert set(after) == set(before)
            assert not any(brute.personal_data(t) for t in after.values())
        if name != "toxicity":
            assert all(r.n_chars == len(r.text) for r in rows)


def test_near_dedup_takes_five_words_and_four_fifths(spark, make_docs, pairs):
    rng = random.Random(9)
    rows = list(pairs)
    for i in range(12):  # copies with a passage added: five-word similarity from 0.76 to 0.9
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        added = [f"v{rng.randrange(5000)}" for _ in range(18 + 4 * i)]
        at = rng.randrange(200)
        rows += [(7000 + i, " ".join(words)), (8000 + i, " ".join(words[:at] + added + words[at:]))]
    expected = {g for _, g in brute.similar_groups(rows, 80, 5).values()}
    at_op6 = {g for _, g in brute.similar_groups(rows).values()}
    assert len({k for k in at_op6 - expected if k >= 8000}) > 5 and any(k >= 8000 for k in expected)
    kept = corpus_pipeline.keep_one_of_each_group(spark, make_docs(*rows), SF)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == expected


def test_nothing_is_dropped_where_nothing_was_learnt(spark, small_docs, tmp_path):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    everything = small_docs.count()
    cases = {"empty": labels.limit(0), "toxic": labels.filter("toxic = 1"), "clean": labels.filter("toxic = 0"),
             "others": labels.selectExpr("doc_id + 1000000 AS doc_id", "quality", "toxic")}
    for name, some in cases.items():
        some.write.parquet(str(tmp_path / name / "labels.parquet"))
        assert corpus_pipeline.drop_toxic(spark, small_docs, str(tmp_path / name)).count() == everything


def test_each_stage_is_computed_once(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)

    def counting(spark, docs, sf_dir):
        def run(batches):
            for batch in batches:
                calls.add(batch.num_rows)
                yield batch

        return docs.mapInArrow(run, docs.schema)

    twice = lambda spark, docs, sf_dir: docs.union(docs)
    monkeypatch.setattr(corpus_pipeline, "STAGES", (("a", counting), ("b", twice), ("c", twice)))
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(corpus_pipeline.run(spark, SF).collect()) == 4 * n and calls.value == n


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_nothing_else_imports_the_package():
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    for path in [*root.glob("caselight/**/*.py"), root / "bench.py"]:
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()
