"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed 3- to 5-grams of its distinct lower-cased words, with word ends marked; a feature's
value is the number of distinct words that hold it, times the log ratio of its counts in toxic and other training texts.
A logistic regression over the features with a telling ratio is trained on a bounded sample of labelled rows; scores
cover every row and the whole of its text. As the score is a sum over distinct words, a word is scored once and kept.

Defined results: a null or empty text has no feature and gets the score of the intercept alone; without training rows
of both labels every score is 0; a null id is not held out and never trained on; rows that repeat an id are scored
each; an empty table gives no rows. Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, labelled_sample, ship

DIM = 1 << 18
GRAMS = (3, 4, 5)
#: Most labelled rows that are trained on.
SAMPLE = 8192
SAMPLE_PARTS = 16
SEED = 11
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
LEAST_RATIO, LEAST_TEXTS = 1.0, 4
#: Scored words a worker keeps.
KEPT_WORDS = 400_000


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of every n-gram of <word>."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    marks = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    owners, features = [], []
    for n in GRAMS:
        size = len(marks) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint64)
        for k in range(n):
            h = (h ^ marks[k : k + size]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        inside = owner[:size] == owner[n - 1 :]
        owners.append(owner[:size][inside])
        features.append(((h[inside] >> np.uint64(7)) % np.uint64(DIM)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(features)


def _distinct_words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class that hold each feature."""
    counts, texts = np.zeros((2, DIM), np.int32), np.zeros(2, np.int64)
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            _, found = word_grams(sorted(_distinct_words(text)))
            counts[int(label > 0)][np.unique(found)] += 1
            texts[int(label > 0)] += 1
    if texts.sum():
        yield pa.record_batch({"counts": pa.array([counts.tobytes()], pa.binary()), "texts": pa.array([texts.tobytes()], pa.binary())})


def _sparse_rows(place: np.ndarray):
    """Each text's selected features and their values; place: a feature's number among the selected, or -1."""

    def run(batches):
        for batch in batches:
            at, value = [], []
            for text in batch.column(0).to_pylist():
                _, found = word_grams(sorted(_distinct_words(text)))
                found, n = np.unique(place[found], return_counts=True)
                at.append(found[found >= 0].astype(np.int32))
                value.append(n[found >= 0].astype(np.float32))
            yield pa.record_batch({"label": batch.column(1), "at": pa.array(at, pa.list_(pa.int32())), "value": pa.array(value, pa.list_(pa.float32()))})

    return run


def fit_logistic(row: np.ndarray, at: np.ndarray, value: np.ndarray, label: np.ndarray, width: int, penalty: float = 1e-4, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and intercept by full-batch Adam over sparse rows."""
    weights, bias = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    balance = np.where(label > 0, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9)) ** 0.5
    for step in range(1, steps + 1):
        z = np.bincount(row, weights[at] * value, len(label)) + bias
        slope = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / len(label)
        gradient = np.append(np.bincount(at, slope[row] * value, width) + penalty * weights, slope.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, seed: int = SEED) -> tuple[np.ndarray, float] | None:
    """(weight of each feature, intercept), or None without rows of both labels."""
    ship(documents.sparkSession)
    rows = labelled_sample(documents, labels, label, sample, seed, fold_of(F.col("doc_id"), FOLDS) != HELD_OUT, ["text"]).repartition(SAMPLE_PARTS)
    sums = rows.mapInArrow(_class_counts, "counts binary, texts binary").toArrow()  # a row for each of SAMPLE_PARTS parts at most
    counts, texts = np.zeros((2, DIM)), np.zeros(2)
    for part, n in zip(sums["counts"], sums["texts"], strict=True):
        counts += np.frombuffer(part.as_py(), np.int32).reshape(2, DIM)
        texts += np.frombuffer(n.as_py(), np.int64)
    if not texts.all():
        return None
    smooth = counts + 0.5
    ratio = np.log(smooth[1] / (texts[1] + 1)) - np.log(smooth[0] / (texts[0] + 1))
    chosen = np.flatnonzero((np.abs(ratio) >= LEAST_RATIO) & (counts.sum(0) >= LEAST_TEXTS))
    place = np.full(DIM, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    found = rows.mapInArrow(_sparse_rows(place), "label int, at array<int>, value array<float>").toArrow().combine_chunks()  # bounded by the sample
    at, value = found["at"].combine_chunks(), found["value"].combine_chunks()
    lengths = np.diff(at.offsets.to_numpy())
    row = np.repeat(np.arange(len(lengths)), lengths)
    at, value = at.flatten().to_numpy(), value.flatten().to_numpy()
    order = np.lexsort((value, at, row))
    weights, bias = fit_logistic(row[order], at[order], value[order] * ratio[chosen][at[order]], (found["label"].to_numpy() > 0).astype(float), len(chosen))
    table = np.zeros(DIM, np.float32)
    table[chosen] = weights * ratio[chosen]
    return table, bias


def _scores(model):
    def run(batches):
        table, bias = model.value
        known: dict[str, float] = {}
        for batch in batches:
            scores = np.empty(len(batch))
            column = batch.column(1)
            for low in range(0, len(batch), 256):
                texts = [_distinct_words(x) for x in column.slice(low, 256).to_pylist()]
                if len(known) > KEPT_WORDS:
                    known.clear()
                fresh = list(set().union(*texts).difference(known))
                for at in range(0, len(fresh), 1 << 14):
                    part = fresh[at : at + (1 << 14)]
                    owner, found = word_grams(part)
                    known.update(zip(part, np.bincount(owner, table[found], len(part)).tolist(), strict=True))
                scores[low : low + 256] = [sum(sorted(map(known.__getitem__, x))) for x in texts]
            scores = 1 / (1 + np.exp(-np.clip(scores + bias, -50, 50)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "__score"])

    return run


def score_toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; and the columns in ``keep``, under their own names."""
    keep = keep or []
    rows = documents.select("doc_id", "text", *[F.col(c).alias(f"__keep_{c}") for c in keep])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    model = train(documents, labels, sample=sample)
    if model is None:
        scored = rows.withColumn("__score", F.lit(0.0))
    else:
        scored = rows.mapInArrow(_scores(documents.sparkSession.sparkContext.broadcast(model)), f"{fields}, __score double")
    return scored.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= threshold).cast("int").alias("predicted"),
        *[F.col(f"__keep_{c}").alias(f"kept_{c}" if c in ("doc_id", "held_out", "score", "predicted") else c) for c in keep],
    )
