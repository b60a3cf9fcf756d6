"""Quality scores by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled text train a small network under the non-negative unbiased risk
    pi * E_p[l(f)] + max(0, E_u[l(-f)] - pi * E_p[l(-f)])
with the logistic loss l. The prior pi of positives is estimated from a first model that tells positives from unlabelled text: the
smallest ratio of unlabelled to positive shares above any score. Three networks are fitted, each without a third of the sample; the
values of the third it has not seen give the prior, and the cut of least estimated error, which becomes a score of 0.7. Labels of 0 are
never used.

Only the fit looks at a sample: at most SAMPLE positives and SAMPLE unlabelled documents, those of the smallest hashes, all from
rows whose crc32(doc_id as text) mod 4 is not 2. Every document is scored from its whole text: counts of characters, words,
repeats. Label, language, source and id are no inputs. Nulls are empty texts and have a score too; without any positive
every score is 0.5. Rows without ``doc_id`` are scored, not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallybook.llm.words import groups, utf8, words_of

SAMPLE = 10_000
"""Bound of the sample that the fit gathers on the driver (positives, and as many unlabelled documents)."""
THRESHOLD = 0.7
HIDDEN = 16
STEPS = 120
FOLDS = 3
FOLD, HELD_OUT = 4, 2
_CLASSES = np.zeros((256, 9))
for _k, _codes in enumerate((range(65, 91), range(97, 123), range(48, 58), (32,), (10,), (44, 46), (33, 63), (35, 36, 37, 38, 42, 43, 60, 62, 64, 94, 95, 96, 124, 126), range(128, 256))):
    _CLASSES[list(_codes), _k] = 1
_PLAIN_END = np.zeros(256, bool)
_PLAIN_END[[*range(48, 58), *range(65, 91), *range(97, 123), *(ord(c) for c in ".,;:?!\"')"), *range(128, 256)]] = True
FEATURES = _CLASSES.shape[1] + 11


def _share(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values within each range of bounds."""
    before = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return before[bounds[1:]] - before[bounds[:-1]]


def features(column: pa.Array) -> np.ndarray:
    """One row of numbers per text."""
    data, offsets = utf8(column)
    out = [np.zeros((0, FEATURES))]
    for i, j in groups(offsets):
        words = words_of(data, offsets[i : j + 1])
        size = np.maximum(np.diff(offsets[i : j + 1]), 1).astype(float)
        counts = np.stack([np.bincount(data[offsets[k] : offsets[k + 1]], minlength=256) for k in range(i, j)]) @ _CLASSES
        n = np.diff(words.bounds).astype(float)
        m = np.maximum(n, 1)
        length = (words.end - words.start).astype(float)
        first = words.data[words.start] if len(words.start) else np.zeros(0, np.uint8)
        last = words.data[words.end - 1] if len(words.start) else np.zeros(0, np.uint8)
        same = np.zeros(len(words.hashes))
        same[1:] = words.hashes[1:] == words.hashes[:-1]
        distinct, most = np.zeros(j - i), np.zeros(j - i)
        for k, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:])):
            if b > a:
                _, times = np.unique(words.hashes[a:b], return_counts=True)
                distinct[k], most[k] = len(times), times.max()
        mean = _share(length, words.bounds) / m
        extra = [
            np.log1p(n), distinct / m, np.log1p(distinct), most / m, _share(same, words.bounds) / m, mean,
            np.sqrt(np.maximum(_share(length**2, words.bounds) / m - mean**2, 0)), _share(length <= 3, words.bounds) / m,
            _share(~_PLAIN_END[last], words.bounds) / m, _share(~_PLAIN_END[first] & (length == 1), words.bounds) / m, (n == 0).astype(float),
        ]
        out.append(np.concatenate([counts / size[:, None], np.stack(extra, axis=1)], axis=1))
    return np.concatenate(out)


class Network:
    """One hidden layer; standardised, clipped inputs."""

    def __init__(self, x: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.parts = [rng.normal(0, 0.3, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parts]
        self.steps = 0

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def value(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.parts[0] + self.parts[1])
        return h @ self.parts[2] + self.parts[3][0], h

    def step(self, z: np.ndarray, h: np.ndarray, slope: np.ndarray, rate: float = 0.02, decay: float = 1e-2) -> None:
        """One Adam step; slope is the derivative of the risk by each output."""
        inner = np.outer(slope, self.parts[2]) * (1 - h**2)
        gradients = [z.T @ inner + decay * self.parts[0], inner.sum(axis=0), h.T @ slope + decay * self.parts[2], slope.sum(keepdims=True)]
        self.steps += 1
        for p, g, (m, v) in zip(self.parts, gradients, self.moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)


def sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in unlabelled text: smallest ratio of the shares above a score that a tenth of the positives passes."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.9, 45))
    above = lambda s: 1 - np.searchsorted(np.sort(s), cuts, "left") / len(s)
    share = above(positive)
    spread = np.sqrt(share * (1 - share) / len(positive)) + np.sqrt(share * (1 - share) / len(unlabelled))
    return float(np.clip(((above(unlabelled) + spread) / share).min(), 0.02, 0.98))


class Model:
    """Mean of networks, moved so that a score of THRESHOLD is the cut of least estimated error."""

    def __init__(self, networks: list[Network], cut: float):
        self.networks, self.cut = networks, cut

    def score(self, x: np.ndarray) -> np.ndarray:
        value = np.mean([n.value(n.inputs(x))[0] for n in self.networks], axis=0)
        return sigmoid(value - self.cut + np.log(THRESHOLD / (1 - THRESHOLD)))


def descend(model: Network, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> None:
    """STEPS down the non-negative risk; without a prior, positives are told from unlabelled text."""
    n, m = len(positive), len(unlabelled)
    z = model.inputs(np.concatenate([positive, unlabelled]))
    for _ in range(STEPS):
        f, h = model.value(z)
        p, u = sigmoid(f[:n]), sigmoid(f[n:])
        if prior is None:
            slope = np.concatenate([(p - 1) / n, u / m])
        else:
            slope = np.concatenate([-prior * p / n, u / m])
            if np.logaddexp(0, f[n:]).mean() < prior * np.logaddexp(0, f[:n]).mean():
                slope = -slope  # lift the part of the risk that fell below zero
            else:
                slope[:n] += prior * (p - 1) / n
        model.step(z, h, slope)


def least_error_cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The value whose estimated error prior * missed + (accepted unlabelled - prior * accepted positives) is smallest."""
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.3, 301)))
    accepted = lambda s: 1 - np.searchsorted(np.sort(s), cuts) / len(s)
    return float(cuts[np.argmax(2 * prior * accepted(positive) - accepted(unlabelled))])


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0) -> tuple[Model, float]:
    """The model and the estimated prior. Prior and cut come from values of rows that a network has not seen."""
    rng = np.random.default_rng(seed)
    folds = FOLDS if min(len(positive), len(unlabelled)) >= 10 * FOLDS else 1
    of_p, of_u = rng.integers(0, folds, len(positive)), rng.integers(0, folds, len(unlabelled))

    def crossed(prior: float | None) -> tuple[list[Network], np.ndarray, np.ndarray]:
        networks, p_values, u_values = [], np.zeros(len(positive)), np.zeros(len(unlabelled))
        for k in range(folds):
            p, u = (positive, unlabelled) if folds == 1 else (positive[of_p != k], unlabelled[of_u != k])
            model = Network(np.concatenate([p, u]), k + (0 if prior is None else folds))
            descend(model, p, u, prior)
            networks.append(model)
            p_values[of_p == k] = model.value(model.inputs(positive[of_p == k]))[0]
            u_values[of_u == k] = model.value(model.inputs(unlabelled[of_u == k]))[0]
        return networks, p_values, u_values

    prior = class_prior(*crossed(None)[1:])
    networks, p_values, u_values = crossed(prior)
    return Model(networks, least_error_cut(p_values, u_values, prior)), prior


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """Fit on the bounded sample; None without positives or documents."""
    learnable = lambda c: F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(FOLD)) != HELD_OUT, F.lit(False))
    ids = lambda df, c, role: df.where(learnable(F.col(c))).select(F.col(c).cast("long").alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(sample).withColumn("role", F.lit(role))
    chosen = ids(labels.where(F.col(label_col) == 1), "doc_id", 1).union(ids(docs, id_col, 0))  # 2 * sample ids at most
    met = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(rows), pa.list_(pa.float64()))], names=["role", "x"])

    found = met.select("role", "text").mapInArrow(measure, "role int, x array<double>").toPandas()
    if not len(found):
        return None
    x, role = np.stack(found["x"].to_numpy()), found["role"].to_numpy()
    order = np.lexsort((*x.T, role))  # the same fit whatever the order of arrival
    x, role = x[order], role[order]
    if not (role == 1).any() or not (role == 0).any():
        return None
    return fit(x[role == 1], x[role == 0])[0]


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows of docs with their score as a last column."""
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])
    place = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                value = np.full(batch.num_rows, 0.5)
            else:
                value = model.score(features(batch.column(place)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(score, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs."""
    model = train(docs, labels, id_col, text_col, label_col)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLD)) == HELD_OUT, F.lit(False))
    return scored(plain, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
