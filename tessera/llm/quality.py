"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), the pairs by the sum-of-squares identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), so a text is scored in linear time.
Hashed words enter as damped frequencies of unit length; statistics of the text's structure (case, digits, marks, lines,
repetition) and the recorded length are standardised by the training sample. The machine is trained with numpy on a
bounded sample of labelled rows and scores every row and the whole of its text.

Defined results: a null or empty text has zero features but for its statistics; a null recorded length counts as 0;
without training rows of both labels every score is 0; a null id is not held out and never trained on; rows that repeat
an id are scored each; an empty table gives no rows. Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import fold_of, labelled_sample, ship

HASHED = 4096
FACTORS = 8
SAMPLE = 8192
SEED = 23
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.5

_KINDS = np.zeros(256, np.int64)
for _kind, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t\r\x0b\x0c", b"\n", b".,;:?", b"!", b"|", b"#$%&*@^~+=_<>\\/", b"\"'()[]{}-`", range(128, 256))):
    for _b in _bytes:
        _KINDS[_b] = _kind + 1
KINDS = 12
#: Rows that have their dense features in memory at once.
ROWS = 512
STATISTICS = KINDS + 9


def features(data: np.ndarray, offsets: np.ndarray, recorded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed words, statistics) of a chunk of texts, a row each."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    words = tx.split(data, offsets)
    hashes, owner, counts = words.hashes(), words.owner(), words.counts()
    slots = (hashes >> np.uint64(11)) % np.uint64(HASHED)
    hashed = np.log1p(np.bincount(owner * HASHED + slots.astype(np.int64), minlength=n * HASHED).reshape(n, HASHED).astype(np.float32))
    used = (hashed > 0).sum(1)
    hashed /= np.maximum(np.sqrt((hashed**2).sum(1)), 1e-6)[:, None]
    kinds = np.bincount(np.repeat(np.arange(n), sizes) * KINDS + _KINDS[data], minlength=n * KINDS).reshape(n, KINDS)
    stats = np.zeros((n, STATISTICS), np.float32)
    stats[:, :KINDS] = kinds / np.maximum(sizes, 1)[:, None]
    lengths = words.ends - words.starts
    total = np.bincount(owner, lengths, n)
    per_word = np.maximum(counts, 1)
    # How many words repeat an earlier word pair, in texts of any length: distinct pairs over pairs.
    pairs = np.zeros(len(hashes), np.uint64)
    pairs[1:] = tx.mix(hashes[1:] + tx.mix(hashes[:-1]))
    key = pairs ^ tx.mix(owner.astype(np.uint64))
    _, one = np.unique(key, return_index=True)
    distinct = np.bincount(owner[one], minlength=n)
    pieces = [
        np.log1p(counts),
        np.log1p(sizes),
        total / per_word,
        np.bincount(owner, lengths.astype(float) ** 2, n) / per_word / 10 - (total / per_word) ** 2 / 10,
        used / np.minimum(per_word, HASHED),
        distinct / per_word,
        np.log1p(counts / np.maximum(kinds[:, 5], 1)),
        np.log1p(np.maximum(recorded, 0)),
        np.log1p(np.abs(recorded - sizes)),
    ]
    for i, piece in enumerate(pieces):
        stats[:, KINDS + i] = piece
    return hashed, stats


def _each(batch: pa.RecordBatch, text: int, recorded: int):
    lengths = batch.column(recorded).fill_null(0).to_numpy(zero_copy_only=False).astype(float)
    for low, high, data, offsets in tx.chunks(batch.column(text), 1 << 20):
        for a in range(0, high - low, ROWS):
            b = min(a + ROWS, high - low)
            yield low + a, low + b, *features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lengths[low + a : low + b])


def _sample_rows(batches):
    for batch in batches:
        for low, high, hashed, stats in _each(batch, 0, 1):
            at = [np.flatnonzero(x).astype(np.int16) for x in hashed]
            value = [x[i] for x, i in zip(hashed, at, strict=True)]
            yield pa.record_batch({"label": batch.column(2).slice(low, high - low), "at": pa.array(at, pa.list_(pa.int16())), "value": pa.array(value, pa.list_(pa.float32())), "stats": pa.array(list(stats), pa.list_(pa.float32()))})


def predict(x: np.ndarray, model: dict) -> np.ndarray:
    """The machine's sum for dense rows, by the sum-of-squares identity."""
    summed = x @ model["v"]
    return model["w0"] + x @ model["w"] + 0.5 * ((summed**2).sum(1) - (x**2) @ (model["v"] ** 2).sum(1))


def fit(x_of, n: int, label: np.ndarray, width: int, seed: int, epochs: int = 12, batch: int = 128, factors: int = FACTORS, penalty: float = 2e-5) -> dict:
    """Minibatch Adam on the logistic loss; x_of(rows) gives dense rows."""
    rng = np.random.default_rng(seed)
    model = {"w0": np.zeros(1, np.float32), "w": np.zeros(width, np.float32), "v": (rng.standard_normal((width, factors)) * 0.02).astype(np.float32)}
    m, v = ({k: np.zeros_like(x) for k, x in model.items()} for _ in range(2))
    share = np.clip(label.mean(), 0.02, 0.98)
    balance = np.where(label > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) ** 0.5
    step = 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(n)
        for low in range(0, n, batch):
            rows = order[low : low + batch]
            x = x_of(rows)
            summed = x @ model["v"]
            z = predict(x, model)
            slope = balance[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]) / len(rows)
            slope = slope.astype(np.float32)
            gradient = {
                "w0": slope.sum(keepdims=True),
                "w": slope @ x + penalty * model["w"],
                "v": x.T @ (slope[:, None] * summed) - (slope @ x**2)[:, None] * model["v"] + penalty * model["v"],
            }
            step += 1
            for k, g in gradient.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                model[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, seed: int = SEED) -> dict | None:
    """The machine with the means and scales of its statistics, or None without rows of both labels."""
    ship(documents.sparkSession)
    rows = labelled_sample(documents, labels, label, sample, seed, fold_of(F.col("doc_id"), FOLDS) != HELD_OUT, ["text", "n_chars"])
    found = rows.mapInArrow(_sample_rows, "label int, at array<smallint>, value array<float>, stats array<float>").toArrow().combine_chunks()  # bounded by the sample
    if not len(found) or len(set(found["label"].to_pylist())) < 2:
        return None
    at, value, stats = (found[k].combine_chunks() for k in ("at", "value", "stats"))
    starts, at, value = at.offsets.to_numpy(), at.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy()
    stats = stats.flatten().to_numpy().reshape(-1, STATISTICS).astype(np.float32)
    label_of = (found["label"].to_numpy() > 0).astype(np.float32)
    first = np.lexsort((label_of, *stats.T[::-1]))  # an order of the rows themselves: reruns agree
    starts, ends, stats, label_of = starts[:-1][first], starts[1:][first], stats[first], label_of[first]
    mean, scale = stats.mean(0), np.maximum(stats.std(0), 1e-3)

    def x_of(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), HASHED + STATISTICS), np.float32)
        for i, r in enumerate(rows):
            x[i, at[starts[r] : ends[r]]] = value[starts[r] : ends[r]]
        x[:, HASHED:] = np.clip((stats[rows] - mean) / scale, -4, 4)
        return x

    return fit(x_of, len(label_of), label_of, HASHED + STATISTICS, seed) | {"mean": mean, "scale": scale}


def _scores(model):
    def run(batches):
        machine = model.value
        for batch in batches:
            scores = np.empty(len(batch))
            for low, high, hashed, stats in _each(batch, 1, 2):
                x = np.concatenate([hashed, np.clip((stats - machine["mean"]) / machine["scale"], -4, 4)], 1)
                scores[low:high] = 1 / (1 + np.exp(-np.clip(predict(x, machine).astype(float), -50, 50)))
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(scores, pa.float64())})

    return run


def score_quality(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(documents, labels, sample=sample)
    rows = documents.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"))
    if model is None:
        scored = rows.select("doc_id", F.lit(0.0).alias("score"))
    else:
        scored = rows.mapInArrow(_scores(documents.sparkSession.sparkContext.broadcast(model)), "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
