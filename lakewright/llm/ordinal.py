"""Cumulative-link (proportional odds) ordinal regression on hashed text features.

P(grade <= k) = sigmoid(threshold_k - eta), eta = the document's features times one weight vector that all
ordered thresholds share. Features are hashed strings of tokens; two readings of a document:

* `share`: eta sums the weights of all its tokens and divides by their number (what is the text made of?);
* `presence`: eta sums the weights of the distinct features that occur (does it occur at all?).

Fitting takes at most FIT_ROWS rated documents, those of the lowest hash of their key, reads their
whole texts on the executors and brings hashed counts to the driver. Scoring reads whole texts where they
are, with no shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.llm.common import Recent

#: The bound of the sample that a model is fitted on, the feature space, and how many features get a weight.
FIT_ROWS, BUCKETS, MOST_FEATURES, LEAST_DOCS = 4000, 1 << 18, 600, 5
PENALTY, STEPS = 1e-3, 600
#: The bucket of a token that repeats the one before it.
REPEAT = zlib.crc32(b"repeat") % BUCKETS

_EDGES = re.compile(r"^\W+|[\W_]+$")
_TAIL = re.compile(r"[\W_]+$")


def core(token: str) -> str:
    """The token in lower case, without signs around it."""
    return _EDGES.sub("", token.lower())


def style_features(token: str) -> list[str]:
    """How a token looks: its case, its closing signs, whether it is a sign alone, and its word."""
    letters = [c for c in token if c.isalpha()]
    if not letters:
        shape = "digits" if any(c.isdigit() for c in token) else "signs"
    elif len(letters) > 1 and token.upper() == token:
        shape = "upper"
    else:
        shape = "plain"
    tail = _TAIL.search(token)
    return [f"shape:{shape}", f"tail:{tail[0][:4] if tail else ''}", f"word:{core(token)}"]


def word_features(token: str) -> list[str]:
    """The word and its beginnings, so that inflected forms share weight."""
    word = core(token)
    return [f"word:{word}", *(f"begin{n}:{word[:n]}" for n in (4, 5, 6) if len(word) > n)] if word else []


#: A rated document: its grade, its features in order, and their values.
Row = tuple[int, np.ndarray, np.ndarray]

FEATURES = {"share": style_features, "presence": word_features}


def hashed(token: str, reading: str) -> list[int]:
    return [zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in FEATURES[reading](token)]


class Model:
    def __init__(self, reading: str, thresholds: np.ndarray, weights: dict[int, float]):
        self.reading, self.thresholds, self.weights = reading, thresholds, weights
        self.look = Recent(self._shares if reading == "share" else self._hits)

    def eta(self, text: str) -> float:
        tokens = text.split()
        if not tokens or not self.weights:
            return 0.0
        if self.reading == "share":
            repeated = sum(map(eq, tokens, tokens[1:])) * self.weights.get(REPEAT, 0.0)
            return (sum(self.look(tokens)) + repeated) / len(tokens)
        hits = {i for found in set(self.look(list(set(tokens)))) for i in found}
        return sum(self.weights[i] for i in sorted(hits))

    def _shares(self, tokens: list[str]) -> list[float]:
        return [sum(self.weights.get(i, 0.0) for i in hashed(token, "share")) for token in tokens]

    def _hits(self, tokens: list[str]) -> list[tuple[int, ...]]:
        return [tuple(i for i in hashed(token, "presence") if i in self.weights) for token in tokens]

    def tails(self, text: str) -> list[float]:
        """P(grade >= 1), P(grade >= 2), ..."""
        if not len(self.thresholds):
            return []
        return (1 / (1 + np.exp(np.clip(self.thresholds - self.eta(text), -60, 60)))).tolist()


def count_features(text: str, reading: str) -> dict[int, float]:
    tokens = text.split()
    counts: Counter[int] = Counter()
    for token, n in Counter(tokens).items():
        for i in hashed(token, reading):
            counts[i] = counts[i] + n if reading == "share" else 1
    if reading == "share":
        if repeats := sum(map(eq, tokens, tokens[1:])):
            counts[REPEAT] += repeats
        return {i: n / len(tokens) for i, n in counts.items()}
    return dict(counts)


def rated_sample(docs: DataFrame, ratings: DataFrame, rating: Column, *, key: str, text: str, reading: str) -> list[Row]:
    """(rating, feature ids, values) of at most FIT_ROWS rated documents. The ids are picked first, from the ratings alone, and
    that bounded list is broadcast, so no text is shuffled."""
    picked = (
        ratings.where(F.col(key).isNotNull() & rating.isNotNull())
        .groupBy(key)
        .agg(F.max(rating.cast("int")).alias("_rating_"))
        .orderBy(F.xxhash64(F.col(key).cast("string")), key)
        .limit(FIT_ROWS)
    )
    chosen = docs.sparkSession.createDataFrame([(r[0], r[1]) for r in picked.collect()], f"_key_ {ratings.schema[key].dataType.simpleString()}, _rating_ int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [count_features(x, reading) for x in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array([list(x) for x in rows], pa.list_(pa.int32())), pa.array([list(x.values()) for x in rows], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["rating", "ids", "values"])

    joined = docs.select(F.col(key).alias("_key_"), F.col(text).alias("_text_")).join(F.broadcast(chosen), "_key_").where("_text_ IS NOT NULL")
    found = joined.select("_rating_", "_text_").mapInArrow(run, "rating int, ids array<int>, values array<float>")
    rows = []
    for r in found.toLocalIterator():
        ids, values = np.array(r.ids, np.int32), np.array(r["values"], np.float32)
        order = np.argsort(ids)
        rows.append((r.rating, ids[order], values[order]))
    return sorted(rows, key=lambda row: (row[0], row[1].tobytes(), row[2].tobytes()))


def select_features(rows: list[Row]) -> list[int]:
    """Features of at least LEAST_DOCS documents that move with the grade most (by the z of their correlation)."""
    grades = np.array([row[0] for row in rows], float)
    centred, n, scale = grades - grades.mean(), len(rows), max(grades.std(), 1e-9)
    docs, first, second, cross = (np.zeros(BUCKETS) for _ in range(4))
    for c, (_, ids, values) in zip(centred, rows, strict=True):
        docs[ids] += 1
        first[ids] += values
        second[ids] += values.astype(float) ** 2
        cross[ids] += c * values
    spread = second / n - (first / n) ** 2
    usable = np.flatnonzero((docs >= LEAST_DOCS) & (spread > 1e-12))
    strength = np.abs(cross[usable] / n) / (np.sqrt(spread[usable]) * scale) * n**0.5
    kept = [(-z, i) for z, i in zip(strength.tolist(), usable.tolist(), strict=True) if z >= 4]
    return [i for _, i in sorted(kept)[:MOST_FEATURES]]


def fit(rows: list[Row], reading: str, grades: int) -> Model:
    """Adam on the penalised likelihood over standardised columns; a model without thresholds if only one grade occurs."""
    if len({row[0] for row in rows}) < 2:
        return Model(reading, np.zeros(0), {})
    chosen = select_features(rows)
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen)), np.float64)
    for at, (_, ids, values) in enumerate(rows):
        places = column[ids]
        x[at, places[places >= 0]] = values[places >= 0]
    scale = np.maximum(x.std(0), 1e-9)
    x /= scale
    y = np.array([row[0] for row in rows])
    levels = grades - 1
    below = np.clip([(y <= k).mean() for k in range(levels)], 1e-3, 1 - 1e-3)
    start = np.log(below / (1 - below))
    params = np.concatenate([np.zeros(len(chosen)), [start[0]], np.log(np.maximum(np.diff(start), 1e-3))])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        gradient = _gradient(params, x, y, levels)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        params -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = params[: len(chosen)] / scale
    return Model(reading, _thresholds(params[len(chosen) :]), {i: float(w) for i, w in zip(chosen, weights, strict=True)})


def _thresholds(raw: np.ndarray) -> np.ndarray:
    return np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])


def _gradient(params: np.ndarray, x: np.ndarray, y: np.ndarray, levels: int) -> np.ndarray:
    """Of the mean negative log likelihood plus the penalty."""
    width = x.shape[1]
    thresholds = _thresholds(params[width:])
    eta = x @ params[:width]
    below = 1 / (1 + np.exp(np.clip(eta[:, None] - thresholds[None, :], -60, 60)))
    padded = np.concatenate([np.zeros((len(y), 1)), below, np.ones((len(y), 1))], axis=1)
    rows = np.arange(len(y))
    upper, lower = padded[rows, y + 1], padded[rows, y]
    mass = np.maximum(upper - lower, 1e-12)
    by_eta = 1 - upper - lower  # of the negative log likelihood
    slope = padded * (1 - padded)
    by_threshold = np.zeros(levels)
    for k in range(levels):
        by_threshold[k] = -(slope[y == k, k + 1] / mass[y == k]).sum() + (slope[y == k + 1, k + 1] / mass[y == k + 1]).sum()
    raw = params[width:]
    by_raw = np.concatenate([[by_threshold.sum()], [by_threshold[k:].sum() * np.exp(raw[k]) for k in range(1, levels)]])
    return np.concatenate([x.T @ by_eta / len(y) + PENALTY * params[:width], by_raw / len(y)])


def score(docs: DataFrame, model: Model, *, text: str, keep: list[Column]) -> DataFrame:
    """The columns of `keep`, then expected (sum of the tails) and tails (array, empty without a model)."""
    kept = docs.select(*keep, F.col(text).alias("_text_"))
    shared = docs.sparkSession.sparkContext.broadcast((model.reading, model.thresholds, model.weights))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("expected", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(*shared.value)
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            tails = [scorer.tails(x or "") for x in batch.column(batch.num_columns - 1).to_pylist()]
            arrays = [*batch.columns[:-1], pa.array([float(sum(t)) for t in tails], pa.float64()), pa.array([[float(p) for p in t] for t in tails], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "expected", "tails"])

    return kept.mapInArrow(run, schema)
