"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score(x) = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is taken in linear time as
half of sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cataloom.llm.words import U64, slices, word_hashes

BITS, RANK = 16, 8
_CLASSES = ("letters", "capitals", "digits", "marks", "symbols", "breaks", "wide")
_CLASS = np.full(256, 4, np.uint8)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 3
_CLASS[[9, 10, 11, 12, 13]] = 5
_CLASS[128:] = 6
_CLASS[32] = 7
STATISTICS = len(_CLASSES) + 6


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of rows: feature numbers and values of all texts in a row, and where each text's begin.

    A text's hashed words weigh count / words * sqrt(distinct words), capped in no way; the statistics have the numbers after
    2**BITS: shares of the byte classes, log sizes, words per line, bytes per word and the share of distinct words and lines.
    """
    for _, _, data, at in slices(texts):
        words, where = word_hashes(data, at)
        ids = (words >> U64(64 - BITS)).astype(np.int64)
        kinds = _CLASS[data]
        numbers, values, begins = [], [], [0]
        for i in range(len(at) - 1):
            own, count = np.unique(ids[where[i] : where[i + 1]], return_counts=True)
            n_words, n_bytes = int(where[i + 1] - where[i]), int(at[i + 1] - at[i])
            shares = np.bincount(kinds[at[i] : at[i + 1]], minlength=8)[: len(_CLASSES)] / max(n_bytes, 1)
            lines = data[at[i] : at[i + 1]].tobytes().split(b"\n")
            rest = [np.log1p(n_bytes) / 10, np.log1p(n_words) / 10, n_bytes / max(n_words, 1) / 10, n_words / len(lines) / 100, len(own) / max(n_words, 1), len(set(lines)) / len(lines)]
            numbers += [own, np.arange(1 << BITS, (1 << BITS) + STATISTICS)]
            values += [count / max(n_words, 1) * np.sqrt(len(own)), np.concatenate((np.sqrt(shares), rest))]
            begins.append(begins[-1] + len(own) + STATISTICS)
        yield np.concatenate(numbers), np.concatenate(values), np.array(begins)


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, number: np.ndarray, value: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of some texts and their factor sums."""
        weighted = self.factors[number] * value[:, None]
        sums = np.add.reduceat(weighted, begins[:-1])
        squares = np.add.reduceat((weighted * weighted).sum(1), begins[:-1])
        return self.bias + np.add.reduceat(self.linear[number] * value, begins[:-1]) + 0.5 * ((sums * sums).sum(1) - squares), sums


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _train(parts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.1, ridge: float = 1e-4) -> FactorisationMachine:
    """Adagrad on the logistic loss."""
    draw = np.random.default_rng(11)
    size = (1 << BITS) + STATISTICS
    base = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = FactorisationMachine(float(np.log(base / (1 - base))), np.zeros(size), draw.normal(0, 0.01, (size, RANK)))
    seen_linear, seen_factors, seen_bias = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    for _ in range(epochs if len(set(y)) > 1 else 0):
        order = draw.permutation(len(parts))
        for k in range(0, len(order), batch):
            chosen = order[k : k + batch]
            number, value = (np.concatenate([parts[i][j] for i in chosen]) for j in (0, 1))
            lengths = np.array([len(parts[i][0]) for i in chosen])
            begins = np.concatenate(([0], np.cumsum(lengths)))
            margin, sums = model.margins(number, value, begins)
            error = (_sigmoid(margin) - y[chosen]) / len(chosen)
            each = np.repeat(error, lengths) * value
            touched, place = np.unique(number, return_inverse=True)
            by_linear = np.bincount(place, each, len(touched)) + ridge * model.linear[touched] / len(chosen)
            slope = each[:, None] * (np.repeat(sums, lengths, axis=0) - model.factors[number] * value[:, None])
            by_factor = np.stack([np.bincount(place, slope[:, f], len(touched)) for f in range(RANK)], 1) + ridge * model.factors[touched] / len(chosen)
            seen_linear[touched] += by_linear**2
            seen_factors[touched] += by_factor**2
            seen_bias += error.sum() ** 2
            model.linear[touched] -= rate * by_linear / np.sqrt(seen_linear[touched])
            model.factors[touched] -= rate / 2 * by_factor / np.sqrt(seen_factors[touched])
            model.bias -= rate * error.sum() / np.sqrt(seen_bias)
    return model


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, epochs: int = 8) -> FactorisationMachine:
    """Fits on at most ``max_rows`` labelled rows, drawn by a hash of doc_id.

    ``labels`` needs doc_id and quality (1: good); rows that lack either are passed over.  Without labels the model is flat.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")  # bounded by max_rows
    held = []
    for row in rows.toLocalIterator():
        number, value, _ = next(features(pa.array([row.text], pa.string())))
        held.append((row.doc_id, number, value, float(row.quality == 1)))
    held.sort(key=lambda r: r[0])
    return _train([(r[1], r[2]) for r in held], np.array([r[3] for r in held]), epochs)


def scored(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) and predicted (1 if score >= ``threshold``), one row per input row.

    ``docs`` needs doc_id and text; other columns are left out.  Null texts count as empty; empty texts are scored by their
    statistics alone.
    """
    slim = FactorisationMachine(model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [slim.margins(*part)[0] for part in features(batch.column(1))]
            scores = _sigmoid(np.concatenate(margins)) if margins else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double, predicted int")
