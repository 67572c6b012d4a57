"""Operator 9 beyond small shards: ties at the last rank, repeated ids, recall up to the shards' bound."""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest
from documents_fixture import make_docs  # noqa: F401

from caselight.llm import neighbours

SF = "/root/testdata/sf0.1"


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def _found(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    return {q: [v[i] for i in sorted(v)] for q, v in out.items()}


def test_ties_at_the_last_rank_go_to_smaller_ids(spark, make_docs):
    # Sixty different vectors have the same product with the query, ten have a larger one.
    rows = [(0, [1.0, 0.0, 0.0])]
    rows += [(1000 - i, [1.0, float(i), -float(i * i % 7)]) for i in range(1, 61)]
    rows += [(2000 + i, [2.0 + i, 0.0, 1.0]) for i in range(10)]
    got = _found(neighbours.nearest_neighbours(_vectors(spark, rows), 5000))[0]
    assert got == [(2009 - i, 11.0 - i) for i in range(10)] + [(940 + i, 1.0) for i in range(10)]


def test_repeated_ids_and_own_rows(spark, make_docs):
    rows = [(0, [1.0, 1.0]), (0, [2.0, 0.5]), (1, [1.0, 1.0]), (1, [3.0, 3.0]), (2, None), (3, [0.0, 0.0])]
    got = _found(neighbours.nearest_neighbours(_vectors(spark, rows), 10))
    assert {v for v, _ in got[0]} == {1}


def test_few_shards_answer_many_queries_in_one_stream(spark, make_docs):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(1500, 16))
    df = _vectors(spark, [(i, p.tolist()) for i, p in enumerate(points)])
    index = neighbours.build_index(df, least_shards=2)
    got = _found(neighbours.search_index(index, neighbours._taking_part(df, "vec_id", "embedding")))
    scores = points @ points.T
    np.fill_diagonal(scores, -np.inf)
    best = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len({v for v, _ in got[i]} & set(best[i].tolist())) / 20 for i in range(1500)]) >= 0.97


@pytest.mark.parametrize("rows", [5_000, neighbours.SHARD_ROWS])
def test_recall_in_one_shard(rows):
    """Real vectors and jittered copies of them, up to the largest shard."""
    rng = np.random.default_rng(rows)
    real = np.array(pq.read_table(f"{SF}/embeddings.parquet").column("embedding").to_pylist(), float)
    points = real[rng.integers(0, len(real), rows)] + rng.normal(scale=0.3 * real.std(), size=(rows, real.shape[1]))
    graph = neighbours.Graph(neighbours._same_length(points))
    asked = points[rng.integers(0, rows, 200)]
    near, _ = graph.search(np.c_[asked, np.zeros(len(asked))].astype(np.float32), neighbours.SEARCH_BEAM)
    scores = asked @ points.T
    exact = np.where(near < 0, -np.inf, np.take_along_axis(scores, np.maximum(near, 0), 1))
    least = np.sort(scores, axis=1)[:, -20]
    assert np.mean((exact >= least[:, None]).sum(axis=1).clip(max=20) / 20) >= 0.9
