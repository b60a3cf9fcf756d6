"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

1. A text is lower-cased; every run of characters that are no letters becomes one edge sign. Its subwords are the runs of one
   to four signs without an edge inside; each is hashed to one of BUCKETS rows of an embedding table.
2. A text's embedding is the mean over its subwords, the whole text's; a linear layer and a softmax give probabilities.
3. Table and layer are trained together by stochastic gradient descent in numpy on a bounded sample of labelled texts: at most
   SAMPLE rows, spread over the MOST_LANGUAGES most frequent languages. A sampled text reaches the driver as counts by bucket.
4. A fifth of the sample is kept aside to calibrate (all of it serves where that leaves a language without a text). The logits are scaled by a factor that grows with the logarithm of the
   text's length, fitted to least log loss; the score is then the probability of the predicted language. ``accepted`` says that
   it reaches the least threshold above which at most ALLOWED_ERROR of the texts kept aside are wrong.

Null texts and texts without a letter are ``und`` with score 0, not accepted. Rows are judged one by one, so repeated rows, null
and repeated ids give a row each. Without a labelled text everything is ``und``. Only texts and labels of the learnable rows
are read in training; a prediction reads the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.words import mix

BUCKETS = 1 << 14
DIMENSIONS = 16
LONGEST = 4
SAMPLE = 2000
MOST_LANGUAGES = 200
EPOCHS, BATCH, RATE = 4, 32, 2.0
ALLOWED_ERROR = 0.005
FOLD, HELD_OUT = 4, 2
UNKNOWN = "und"
PIECE = 1 << 18
"""Longer texts are counted in pieces of this many characters that overlap by LONGEST - 1, so memory stays bounded."""
_SEEDS = np.random.default_rng(11).integers(1, 2**63, LONGEST + 1, dtype=np.uint64)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def subword_counts(text: str) -> tuple[np.ndarray, int]:
    """Occurrences by bucket, and the number of letters."""
    total, seen = np.zeros(BUCKETS, np.int64), 0
    text = text.lower()
    for at in range(0, max(len(text), 1), PIECE):
        overlap = LONGEST - 1 if at else 0
        codes = np.frombuffer(text[at - overlap : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = letters()[codes]
        seen += int(inside[overlap:].sum())
        if at == 0:
            codes, inside = np.concatenate([[0], codes]), np.concatenate([[False], inside])
            overlap = 0
        if at + PIECE >= len(text):
            codes, inside = np.append(codes, 0), np.append(inside, False)
        kept = inside.copy()
        kept[1:] |= inside[:-1] | (np.arange(1, len(inside)) < overlap)
        kept[:1] = True
        signs = np.where(inside, codes, 0)[kept].astype(np.uint64)
        letter = inside[kept]
        skipped = int(kept[:overlap].sum())
        hashed = np.zeros(len(signs), np.uint64)
        for size in range(1, LONGEST + 1):
            n = len(signs) - size + 1
            if n <= 0:
                break
            hashed = hashed[:n] * np.uint64(0x9E3779B97F4A7C15) + mix(signs[size - 1 : size - 1 + n] + np.uint64(1))
            whole = letter[:n].copy() if size == 1 else np.ones(n, bool)
            for k in range(1, size - 1):
                whole &= letter[k : k + n]
            if size == 2:
                whole &= letter[:n] | letter[1 : 1 + n]
            whole[: max(skipped - size + 1, 0)] = False  # counted with the piece before
            total += np.bincount((mix(hashed[whole] + _SEEDS[size]) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    return total, seen


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    scale: tuple[float, float] = (0.0, 0.0)
    threshold: float = 0.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        mean = counts @ self.table / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return mean @ self.layer + self.bias

    def probabilities(self, logits: np.ndarray, n: np.ndarray) -> np.ndarray:
        return softmax(logits * np.exp(self.scale[0] + self.scale[1] * np.log1p(n))[:, None])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Rows:
    """Sparse count rows: buckets, counts and the bounds of each row."""

    def __init__(self, buckets: list[np.ndarray], counts: list[np.ndarray]):
        self.buckets, self.counts = buckets, counts

    def __len__(self) -> int:
        return len(self.buckets)

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for i, r in enumerate(rows):
            out[i, self.buckets[r]] = self.counts[r]
        return out


def descend(rows: Rows, target: np.ndarray, languages: list[str], chosen: np.ndarray, seed: int = 0) -> Model:
    """Stochastic gradient descent on the log loss, with a rate that falls to zero; languages count equally."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    layer += rng.normal(0, 0.1, layer.shape).astype(np.float32)
    weight = 1 / np.maximum(np.bincount(target[chosen], minlength=len(languages)), 1)
    weight = weight / weight[target[chosen]].mean()
    steps = max(EPOCHS * -(-len(chosen) // BATCH), 1)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(chosen)
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            used = np.unique(np.concatenate([rows.buckets[r] for r in part]))
            counts = np.zeros((len(part), len(used)), np.float32)
            for k, r in enumerate(part):
                counts[k, np.searchsorted(used, rows.buckets[r])] = rows.counts[r]
            counts /= np.maximum(counts.sum(axis=1, keepdims=True), 1)
            hidden = counts @ table[used]
            slope = softmax(hidden @ layer + bias)
            slope[np.arange(len(part)), target[part]] -= 1
            slope *= weight[target[part]][:, None] / len(part)
            rate = RATE * (1 - step / steps)
            inner = slope @ layer.T
            layer -= rate * (hidden.T @ slope)
            bias -= rate * slope.sum(axis=0)
            table[used] -= rate * 20 * (counts.T @ inner)  # rows of the table get the mean's small share of a step
            step += 1
    return Model(languages, table, layer, bias)


def calibrate(model: Model, logits: np.ndarray, n: np.ndarray, target: np.ndarray) -> None:
    """Scale of least log loss, then the least threshold whose accepted texts are wrong in at most ALLOWED_ERROR."""
    def loss(scale: tuple[float, float]) -> float:
        model.scale = scale
        p = model.probabilities(logits, n)[np.arange(len(target)), target]
        return float(-np.log(np.maximum(p, 1e-12)).mean() + 1e-4 * (scale[0] ** 2 + scale[1] ** 2))

    model.scale = min(((a, b) for a in np.linspace(-2, 4, 25) for b in np.linspace(0, 1, 11)), key=loss)
    p = model.probabilities(logits, n)
    score, right = p.max(axis=1), p.argmax(axis=1) == target
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= ALLOWED_ERROR)
    model.threshold = float(score[order[fine[-1]]]) if len(fine) else 1.0


def fit(rows: Rows, labels: list[str], n: np.ndarray, seed: int = 0) -> Model | None:
    languages = sorted(set(labels))
    if not languages:
        return None
    target = np.array([languages.index(x) for x in labels])
    aside = np.random.default_rng(seed).random(len(target)) < 0.2
    if aside.all() or not aside.any() or len(set(target[~aside])) < len(languages):
        aside = np.zeros(len(target), bool)  # too few rows to keep some aside
    model = descend(rows, target, languages, np.flatnonzero(~aside), seed)
    kept = np.flatnonzero(aside) if aside.any() else np.arange(len(target))
    logits = np.concatenate([model.logits(rows.dense(kept[i : i + 256])) for i in range(0, len(kept), 256)])
    calibrate(model, logits, n[kept], target[kept])
    return model


def held_out(id_column: Column) -> Column:
    """Rows that training does not see: crc32 of the id as text leaves HELD_OUT modulo FOLD; rows without id are not learned from either."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(FOLD)) == HELD_OUT


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buckets, counts, sizes = [], [], []
        for text in batch.column(1).to_pylist():
            found, n = subword_counts(text)
            used = np.flatnonzero(found)
            buckets.append(used.astype(np.int16).tobytes())
            counts.append(found[used].astype(np.float32).tobytes())
            sizes.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(buckets, pa.binary()), pa.array(counts, pa.binary()), pa.array(sizes, pa.int64())], names=["lang", "buckets", "counts", "n"]
        )


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` labelled rows, chosen by a hash of their ids, about equally many of each language."""
    learnable = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = learnable.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return None
    wanted = max(sample // len(sizes), 1)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, 1.2 * wanted / r.n))])
    chance = F.pmod(F.xxhash64("id", "lang"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = rows.where(chance < share[F.col("lang")]).orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(sample)
    found = picked.select("lang", "text").mapInArrow(measure, "lang string, buckets binary, counts binary, n long").toArrow().to_pylist()
    found.sort(key=lambda r: (r["lang"], r["n"], r["buckets"], r["counts"]))  # the same fit whatever the order of arrival
    sparse = Rows([np.frombuffer(r["buckets"], np.int16).astype(np.int64) for r in found], [np.frombuffer(r["counts"], np.float32) for r in found])
    return fit(sparse, [r["lang"] for r in found], np.array([r["n"] for r in found], np.float64))


def predicted(docs: DataFrame, model: Model | None, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) per row."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = None if model is None else model.table @ model.layer  # a bucket's share of the logits
        for batch in batches:
            names, scores = [], []
            for text in batch.column(1):
                text = text.as_py()
                counts, n = subword_counts(text) if text and model is not None else (None, 0)
                if not n:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                logits = (counts @ folded / max(counts.sum(), 1) + model.bias)[None, :]
                p = model.probabilities(logits, np.array([n], np.float64))[0]
                names.append(model.languages[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    threshold = 1.0 if model is None else model.threshold
    return plain.mapInArrow(predict, "doc_id long, lang_pred string, score double").withColumn(
        "accepted", (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= threshold)
    )


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) per row of docs; see the module text."""
    found = predicted(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
