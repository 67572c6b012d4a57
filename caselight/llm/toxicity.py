"""Operator 2: toxicity of texts, indifferent to which group a sentence names.

Method: a counterfactually regularised logistic classifier. A text's features are the words and
word beginnings that occur in it. In labelled texts that name a group, the group's term is
swapped for others of its kind; the fit minimises the logistic loss plus a penalty on the squared
difference between a text's score and its swapped twins' scores, so that mentions of a group as
such do not count, whatever the labels of the texts that happen to name it.

The fit uses at most ``sample`` labelled rows, chosen by a hash of their ids, and keeps at most
``features`` features; both bounds are parameters. Everything else reads all documents. Only the
text is an input of a score.

Defined cases: null or empty text scores as the model's prior alone; labels without id or class
are ignored, of several for a document the larger counts; of several texts for a labelled id the
first in text order is learnt from; without any labelled row every score is 0.5 and predicted 1;
a document without id counts as held out; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselight.llm.bytewise import lower_ascii, owners, prefix_hash, runs, scramble, text_slices
from caselight.llm.shared import give_back, lean, take_over

SAMPLE = 8192
FEATURES = 512
#: Labelled texts whose features are held at once.
PORTION = 256
RIDGE = 0.5
COUNTERFACTUAL = 10.0
#: Lengths in bytes of the word beginnings that are features.
BEGINNINGS = (4, 5, 6)
#: Terms for groups of people that are swapped for one another within a row.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "jewish", "muslim", "hindu", "buddhist", "atheist"),
    ("christians", "jews", "muslims", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "american", "mexican", "chinese"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "juden", "muslime", "hindus"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "juifs", "musulmans", "hindous"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("cristianos", "judíos", "musulmanes", "hindúes"),
)

_HASH = prefix_hash(2)
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_TERM = {t: row for row in IDENTITY_TERMS for t in row}
_ANY_TERM = re.compile(r"(?<!\w)(" + "|".join(sorted(_TERM, key=len, reverse=True)) + r")(?!\w)", re.I)


def _features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all words and word beginnings, with repeats."""
    low = lower_ascii(data)
    start, end = runs(_IN_WORD[low], bounds)
    sums, row = _HASH.sums(low), owners(start, bounds)
    rows, found = [row], [scramble(_HASH.spans(sums, start, end), 1)]
    for n in BEGINNINGS:
        longer = end - start > n
        rows.append(row[longer])
        found.append(scramble(_HASH.spans(sums, start[longer], start[longer] + n), n))
    return np.concatenate(rows), np.concatenate(found)


def _feature_sets(texts: list[str]) -> list[np.ndarray]:
    """The distinct features of each text."""
    out: list[np.ndarray] = []
    for first, last, data, bounds in text_slices(pa.array(texts, pa.string())):
        row, feature = _features(data, bounds)
        order = np.lexsort((feature, row))
        row, feature = row[order], feature[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
        row, feature = row[new], feature[new]
        out += np.split(feature, np.searchsorted(row, np.arange(1, last - first)))
    return out


def swapped(text: str, turn: int) -> str | None:
    """The text with each group term replaced by the one ``turn`` places on, None without any."""

    def other(match: re.Match) -> str:
        row = _TERM[match[0].lower()]
        return row[(row.index(match[0].lower()) + turn) % len(row)]

    new, n = _ANY_TERM.subn(other, text)
    return new if n else None


@dataclass(frozen=True)
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float
    #: Whether the labelled rows held both classes, so that there was something to learn.
    learnt: bool = True

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        logit = np.full(n, self.bias)
        if len(self.features):
            row, feature = _features(data, bounds)
            maybe = np.zeros(1 << 16, bool)
            maybe[(self.features & np.uint64(0xFFFF)).astype(np.int64)] = True
            near = maybe[(feature & np.uint64(0xFFFF)).astype(np.int64)]
            row, feature = row[near], feature[near]
            at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
            same = self.features[at] == feature
            pairs = np.unique(row[same] * len(self.features) + at[same])
            logit += np.bincount(pairs // len(self.features), self.weights[pairs % len(self.features)], n)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _portions(texts: list[str]):
    """Texts a few at a time, with the number of the first one: their features are many times as large as they."""
    for at in range(0, len(texts), PORTION):
        yield at, texts[at : at + PORTION]


def _telling(texts: list[str], label: np.ndarray, most: int) -> np.ndarray:
    """The features whose frequency differs most between the classes, in standard deviations."""
    names, seen, toxic = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for at, some in _portions(texts):
        sets = _feature_sets(some)
        own = np.repeat(label[at : at + len(some)], [len(s) for s in sets])
        names, where = np.unique(np.concatenate([names, *sets]), return_inverse=True)
        seen = np.bincount(where, np.r_[seen, np.ones(len(own))], len(names))
        toxic = np.bincount(where, np.r_[toxic, own], len(names))
    share = label.mean()
    differs = (toxic - seen * share) / np.sqrt(seen * share * (1 - share) + 1e-9)
    kept = np.flatnonzero((seen >= 3) & (np.abs(differs) > 3))
    kept = kept[np.argsort(-np.abs(differs[kept]), kind="stable")[:most]]
    return np.sort(names[kept])


def _twins_apart(texts: list[str], x: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The rows' features less those of their twins with other group terms."""
    parts = [np.zeros((0, x.shape[1]))]
    for at, some in _portions(texts):
        twins = [(at + i, t) for i, text in enumerate(some) for turn in (1, 2) if (t := swapped(text, turn)) is not None]
        if twins:
            parts.append(x[[i for i, _ in twins]] - _matrix(_feature_sets([t for _, t in twins]), features))
    return np.concatenate(parts)


def _matrix(sets: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(features) + 1), np.float64)
    out[:, -1] = 1
    for i, s in enumerate(sets):
        at = np.minimum(np.searchsorted(features, s), max(len(features) - 1, 0))
        if len(features):
            out[i, at[features[at] == s]] = 1
    return out


def fit_rows(texts: list[str], labels: list[int], most: int, ridge: float, counterfactual: float) -> Model:
    """Newton steps on the regularised loss; the bounded sample is held in one task."""
    label = np.array(labels, float)
    if not len(label) or label.min() == label.max():
        bias = 0.0 if not len(label) else float(label[0] * 8 - 4)
        return Model(np.zeros(0, np.uint64), np.zeros(0), bias, learnt=False)
    features = _telling(texts, label, most)
    x = np.concatenate([_matrix(_feature_sets(some), features) for _, some in _portions(texts)])
    apart = _twins_apart(texts, x, features)
    penalty = np.diag(np.r_[np.full(len(features), ridge), 1e-6])
    if len(apart):
        penalty += counterfactual * apart.T @ apart
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (p - label) + penalty @ w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Model(features, w[:-1], float(w[-1]))


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text modulo 5; 0 without id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES,
        ridge: float = RIDGE, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Learn from at most ``sample`` rows of ``labels`` outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = (
        known.dropna()
        .filter(fold(F.col("doc_id")) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    # At most ``sample`` pairs of numbers are broadcast.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        take_over(__name__)
        frame = frame.sort_values("doc_id")
        model = fit_rows(frame["text"].fillna("").tolist(), frame["toxic"].clip(0, 1).tolist(), features, ridge, counterfactual)
        give_back()
        return pd.DataFrame(
            {"feature": np.r_[model.features.view(np.int64), 0], "weight": np.r_[model.weights, model.bias],
             "bias": [False] * len(model.features) + [True], "learnt": model.learnt}
        )

    learnt = rows.groupBy().applyInPandas(learn, "feature long, weight double, bias boolean, learnt boolean").collect()
    weights = sorted((r for r in learnt if not r["bias"]), key=lambda r: r["feature"] % (1 << 64))
    return Model(
        np.array([r["feature"] for r in weights], np.int64).view(np.uint64),
        np.array([r["weight"] for r in weights]),
        next((r["weight"] for r in learnt if r["bias"]), 0.0),
        any(r["learnt"] for r in learnt),
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The given columns and ``toxicity``, 0 to 1."""

    def run(batches):
        for batch in batches:
            text = batch.column(at)
            parts = [model.scores(data, bounds) for _, _, data, bounds in text_slices(text)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            columns = [*batch.columns[: len(names)], pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = T.StructType([*plain.schema.fields, T.StructField(f"c{len(names)}", T.DoubleType())])
    at = names.index("text")
    if plain.dtypes[at][1] != "string":  # else the texts go to the task once
        plain, at = plain.select("*", F.col(f"c{at}").cast("string").alias("scored")), len(names)
    return plain.mapInArrow(lean(__name__, run), schema).toDF(*names, "toxicity")


def report(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
