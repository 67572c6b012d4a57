"""Operator 9: approximate nearest neighbours by largest inner product.

Method: robust-pruned directed graphs. The distinct vectors are dealt by a hash into shards of
bounded size. In each shard a graph is grown: a greedy search from the most central vector
proposes neighbours for the next vectors, relaxed distance pruning keeps a few that lie in
different directions, and edges back are added and pruned likewise. Every query is answered by a
beam search in each shard; the shards' best are merged.

Inner products become distances by one more coordinate that gives all vectors of a shard the same
length (queries have 0 there). Reported scores are inner products of the original vectors in double
precision.

Equal vectors are one node; it lists the smallest ids of its copies, as many as can be among the
nearest, so copies of one vector cost nothing. A task reads a shard's nodes and then the queries
put to it as one sorted stream: it holds one graph and one batch of queries at a time, whatever
the number of queries, and no node is sent twice.

Recall depends on the beams, the degree and on how many candidates pruning looks at; these and the
shards' size and least number are parameters. Among the nodes a search has found nothing is cut
before ties are broken by id.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers, and rows
without id, take no part; vectors of another length are never neighbours; rows with the query's
id are not its neighbours; fewer candidates than asked for are all returned; ties go to the
smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselight.llm.shared import checkpointed

NEAREST = 20
#: Rows that a shard holds at most on average, and shards made even of small tables, so that tasks share the work.
SHARD_ROWS = 50_000
LEAST_SHARDS = 12
DEGREE = 32
#: Nearest candidates of a node among which pruning chooses its edges.
PRUNED_FROM = 128
BUILD_BEAM = 64
SEARCH_BEAM = 100
#: A neighbour is dropped if a kept one is nearer to it by this factor (of squared distances).
RELAXED = 1.2
_BATCH = 256


class Graph:
    """A directed graph over the rows of a matrix, for greedy search by squared distance."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relaxed: float = RELAXED,
                 pruned_from: int = PRUNED_FROM, seed: int = 0) -> None:
        self.points = points
        self.norms = (points * points).sum(axis=1)
        self.degree, self.beam, self.relaxed, self.pruned_from = degree, beam, relaxed, pruned_from
        self.edges = np.full((len(points), degree + degree // 2), -1, np.int32)
        self.used = np.zeros(len(points), np.int64)
        self.entry = int(np.argmin(self._to(points.mean(axis=0)[None], np.arange(len(points))[None])[0]))
        order = np.random.default_rng(seed).permutation(len(points))
        order = np.r_[self.entry, order[order != self.entry]]
        done = 1
        while done < len(order):
            some = order[done : done + min(_BATCH, done)]
            self._insert(some)
            done += len(some)

    @classmethod
    def of(cls, nodes: pd.DataFrame) -> Graph:
        """The graph of a shard's stored nodes, in order."""
        graph = cls.__new__(cls)
        graph.points = _same_length(_matrix(nodes["vector"]))
        graph.norms = (graph.points * graph.points).sum(axis=1)
        graph.entry = int(np.flatnonzero(nodes["entry"].to_numpy())[0])
        graph.edges = np.full((len(nodes), max(1, nodes["edges"].map(len).max())), -1, np.int32)
        for i, e in enumerate(nodes["edges"]):
            graph.edges[i, : len(e)] = e
        return graph

    def _to(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distance of each query to its row of points (-1: infinite)."""
        products = np.einsum("qd,qkd->qk", queries, self.points[ids])
        out = self.norms[ids] - 2 * products + (queries * queries).sum(axis=1)[:, None]
        out[ids < 0] = np.inf
        return out

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the nearest found, nearest first, and of all nodes visited on the way (-1: none)."""
        n, at_once = len(queries), 4
        ids = np.full((n, beam), -1, np.int64)
        far = np.full((n, beam), np.inf, np.float32)
        opened = np.ones((n, beam), bool)
        ids[:, 0], opened[:, 0] = self.entry, False
        far[:, 0] = self._to(queries, ids[:, :1])[:, 0]
        seen = np.zeros((n, len(self.points) + 1), bool)  # the last column stands for -1
        seen[:, [self.entry, -1]] = True
        rows, path = np.arange(n)[:, None], [ids[:, :1].copy()]
        while True:
            # The nearest of each beam that are not opened yet.
            turn = np.argsort(opened, axis=1, kind="stable")[:, :at_once]
            fresh = ~np.take_along_axis(opened, turn, 1)
            if not fresh.any():
                return ids, np.hstack(path)
            now = np.where(fresh, np.take_along_axis(ids, turn, 1), -1)
            np.put_along_axis(opened, turn, True, 1)
            path.append(now)
            near = np.where(now[:, :, None] < 0, -1, self.edges[now]).reshape(n, -1)
            near[seen[rows, near]] = -1
            near = np.sort(near, axis=1)[:, ::-1]
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            widest = int((near >= 0).sum(axis=1).max())
            if not widest:
                continue
            near = -np.sort(-near, axis=1)[:, :widest]
            seen[rows, near] = True
            distance = self._to(queries, near)
            ids, far = np.hstack([ids, near]), np.hstack([far, distance])
            opened = np.hstack([opened, near < 0])
            best = np.argsort(far, axis=1, kind="stable")[:, :beam]
            ids, far, opened = (np.take_along_axis(m, best, 1) for m in (ids, far, opened))

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Of each node's candidates, the nearest that no kept one stands in front of."""
        candidates = np.where(candidates == nodes[:, None], -1, candidates)
        candidates = -np.sort(-candidates, axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        distance = self._to(self.points[nodes], candidates)
        order = np.argsort(distance, axis=1, kind="stable")[:, : self.pruned_from]
        candidates, distance = np.take_along_axis(candidates, order, 1), np.take_along_axis(distance, order, 1)
        vectors = self.points[candidates]
        norms = self.norms[candidates]
        between = norms[:, :, None] + norms[:, None, :] - 2 * vectors @ vectors.transpose(0, 2, 1)
        open_, rows = candidates >= 0, np.arange(len(nodes))
        kept = np.full((len(nodes), self.degree), -1, np.int32)
        for i in range(self.degree):
            if not open_.any():
                break
            first = np.argmax(open_, axis=1)
            some = open_[rows, first]
            kept[:, i] = np.where(some, candidates[rows, first], -1)
            hidden = self.relaxed * between[rows, first] <= distance
            open_ &= ~(hidden & some[:, None])
            open_[rows, first] = False
        return kept

    def _set(self, nodes: np.ndarray, kept: np.ndarray) -> None:
        self.edges[nodes] = -1
        self.edges[nodes, : self.degree] = kept
        self.used[nodes] = (kept >= 0).sum(axis=1)

    def _insert(self, nodes: np.ndarray) -> None:
        _, path = self.search(self.points[nodes], self.beam)
        kept = self._prune(nodes, np.hstack([path, self.edges[nodes]]))
        self._set(nodes, kept)
        # Edges back, grouped by the node that gets them.
        source = np.repeat(nodes, self.degree)[kept.ravel() >= 0]
        target = kept.ravel()[kept.ravel() >= 0].astype(np.int64)
        known = (self.edges[target] == source[:, None]).any(axis=1)
        source, target = source[~known], target[~known]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        own, first, count = np.unique(target, return_index=True, return_counts=True)
        fits = self.used[own] + count <= self.edges.shape[1]
        slot = self.used[target] + np.arange(len(target)) - np.repeat(first, count)
        direct = np.repeat(fits, count)
        self.edges[target[direct], slot[direct]] = source[direct]
        self.used[own[fits]] += count[fits]
        full = np.flatnonzero(~fits)
        for at in range(0, len(full), _BATCH):
            some = full[at : at + _BATCH]
            wide = np.full((len(some), int(count[some].max())), -1, np.int64)
            for i, g in enumerate(some):
                wide[i, : count[g]] = source[first[g] : first[g] + count[g]]
            self._set(own[some], self._prune(own[some], np.hstack([self.edges[own[some]], wide])))


def _taking_part(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    x = F.col(column).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    zero = F.forall(x, lambda c: c == 0)  # of an empty vector, too
    rows = vectors.filter(F.col(id_column).isNotNull() & F.col(column).isNotNull() & sound & ~zero)
    # Adding 0 makes -0 and 0 the same number.
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda c: c + 0.0).alias("vector"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _same_length(points: np.ndarray) -> np.ndarray:
    squares = (points * points).sum(axis=1)
    return np.c_[points, np.sqrt(np.maximum(squares.max() - squares, 0))].astype(np.float32)


def build_index(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding",
                nearest: int = NEAREST, shard_rows: int = SHARD_ROWS, least_shards: int = LEAST_SHARDS,
                degree: int = DEGREE, beam: int = BUILD_BEAM, relaxed: float = RELAXED,
                pruned_from: int = PRUNED_FROM) -> DataFrame:
    """One row per distinct vector: shard, node, vector, ids (the smallest of its rows), edges."""
    rows = _taking_part(vectors, id_column, column)
    copies = Window.partitionBy("vector").orderBy("vec_id")
    distinct = (
        rows.withColumn("copy", F.row_number().over(copies))
        .filter(F.col("copy") <= nearest + 1)
        .groupBy("vector")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )
    shards = max(least_shards, -(-vectors.count() // shard_rows))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards))).withColumn("size", F.size("vector"))

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(first=[x[0] for x in frame["ids"]]).sort_values("first", ignore_index=True)
        graph = Graph(_same_length(_matrix(frame["vector"])), degree, beam, relaxed, pruned_from)
        frame["node"] = np.arange(len(frame)) if len(frame) else []
        frame["entry"] = frame["node"] == graph.entry
        frame["edges"] = [e[e >= 0] for e in graph.edges]
        return frame[["shard", "size", "node", "entry", "vector", "ids", "edges"]]

    return dealt.groupBy("shard", "size").applyInPandas(
        grow,
        "shard long, size int, node long, entry boolean, vector array<double>, ids array<long>, edges array<int>",
    )


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products summed in order of the dimensions, so that a score depends on its two vectors alone."""
    total = np.zeros(vectors.shape[:2])
    for d in range(vectors.shape[2]):
        total += queries[:, d, None] * vectors[:, :, d]
    return total


class _Shard:
    """A shard's graph and its nodes' vectors and ids, for one batch of queries after another."""

    def __init__(self, nodes: pd.DataFrame) -> None:
        self.graph, self.vectors = Graph.of(nodes), _matrix(nodes["vector"])
        self.ids = [x.tolist() for x in nodes["ids"]]

    def nearest(self, own: np.ndarray, wanted: np.ndarray, nearest: int, beam: int) -> list[tuple]:
        """(query id, vector id, score) of each query's nearest, ties to the smaller id."""
        near, _ = self.graph.search(np.c_[wanted, np.zeros(len(wanted))].astype(np.float32), beam)
        exact = np.where(near < 0, -np.inf, _products(wanted, self.vectors[near]))
        # One more than asked for, since the query itself may be among them, and all that tie with the last.
        cut = min(nearest + 1, exact.shape[1])
        least = -np.partition(-exact, cut - 1, axis=1)[:, cut - 1]
        found = []
        for i, query in enumerate(own.tolist()):
            some = np.flatnonzero((near[i] >= 0) & (exact[i] >= least[i]))
            mine = [(query, v, exact[i, b]) for b in some for v in self.ids[near[i, b]] if v != query]
            found += sorted(mine, key=lambda m: (-m[2], m[1]))[:nearest]
        return found


def search_index(index: DataFrame, queries: DataFrame, nearest: int = NEAREST, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score of each query (vec_id, vector) searched in every shard."""
    nodes = index.select("shard", "size", F.lit(0).alias("side"), F.col("node").alias("at"), "vector", "entry", "ids", "edges")
    shards = index.select((F.col("shard") + 0).alias("shard"), (F.col("size") + 0).alias("size")).distinct()
    asked = (
        queries.withColumn("size", F.size("vector")).join(shards, "size")
        .select("shard", "size", F.lit(1).alias("side"), F.col("vec_id").alias("at"), "vector")
    )

    def look(frames):
        held, waiting, shard = None, [], None
        for frame in frames:
            for key, part in frame.groupby(["shard", "size", "side"], sort=True):
                if key[:2] != held:
                    held, waiting, shard = key[:2], [], None
                if key[2] == 0:
                    waiting.append(part)
                    continue
                if shard is None:
                    shard, waiting = _Shard(pd.concat(waiting, ignore_index=True)), []
                for at in range(0, len(part), _BATCH):
                    some = part.iloc[at : at + _BATCH]
                    found = shard.nearest(some["at"].to_numpy(), _matrix(some["vector"]), nearest, beam)
                    if found:
                        yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    parts = (
        nodes.unionByName(asked, allowMissingColumns=True)
        .repartition("shard", "size")
        .sortWithinPartitions("shard", "size", "side", "at")
        .mapInPandas(look, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = parts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, each: int, id_column: str = "vec_id", column: str = "embedding",
                       nearest: int = NEAREST, beam: int = SEARCH_BEAM) -> DataFrame:
    """The nearest of every row whose id is divisible by ``each``, among all other rows."""
    index = checkpointed(build_index(vectors, id_column, column, nearest))
    queries = _taking_part(vectors, id_column, column).filter(F.col("vec_id") % each == 0)
    return search_index(index, queries, nearest, beam)
