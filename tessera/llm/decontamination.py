"""Benchmark decontamination by latent semantic retrieval.

Benchmark texts are cut into passages; the passages' TF-IDF matrix, with document frequencies of the whole corpus, goes
through a distributed randomised SVD that keeps half as many directions as there are passages: the latent space. Every
window of every document is folded into that space, and windows near a passage become candidates. A projection keeps
only a part of a passage, more or less by passage, so nearness is the cosine of window and passage as seen in the space,
over the share of the passage's length that the space keeps: a window that is the passage has 1. A candidate is decided
on words: the longest common subsequence of the benchmark text and the document's stretch around the window covers nearly
all of the text, or a good part of it together with the text's answer, its last sentence - so paraphrases that keep the
answer are found too. A benchmark text of fewer than ``LEAST_WORDS`` words is found where its words stand one after the other.

The benchmark is the stated query set: it is taken in blocks of passages, each with a space of its own, so a larger
benchmark means more blocks, not a poorer space. Documents are read once for the frequencies and once for each
``BLOCKS_AT_ONCE`` blocks; no document leaves its partition.

Words are runs of ASCII letters, digits and non-ASCII characters of the text in lower case. Defined results: null and empty texts
on either side match nothing, nor do texts without words; benchmark rows that repeat an id or a text are items of their own; rows that repeat a document id are searched each; empty tables give
no matches, and then no document goes. Columns besides doc_id and text pass through ``remove_contaminated`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .common import ship

FREQUENCY_SLOTS = 1 << 17
#: Words of a benchmark passage, of a document's window, and between windows.
PASSAGE, WINDOW, STEP = 64, 48, 16
#: Passages of a block; its latent space has a dimension for every two of them.
BLOCK, PASSAGES_A_DIMENSION = 512, 2
BLOCKS_AT_ONCE = 8
POWER_ROUNDS = 2
#: Least nearness of a candidate, and least share of a window's squared weights that the benchmark's words have.
LEAST_NEARNESS, LEAST_SHARE = 0.25, 0.2
LEAST_WORDS = 5
#: Share of a text's words in the longest common subsequence: enough alone; enough with the answer; and of the answer.
SURE, LIKELY, ANSWER = 0.8, 0.5, 0.9
SEED = 5


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray
    answer: np.ndarray


@dataclass
class Block:
    vocabulary: np.ndarray
    weights: np.ndarray
    basis: np.ndarray
    passages: np.ndarray  # in the space, over what it keeps of each
    owners: np.ndarray


def _lex(data: np.ndarray, offsets: np.ndarray) -> tuple[tx.Words, np.ndarray]:
    words = tx.split(data, offsets, tx.ALNUM)
    return words, words.hashes()


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(13)) % np.uint64(FREQUENCY_SLOTS)


def _document_counts(batches):
    """Documents of this part that hold a word of each slot; slot -1 counts the documents."""
    counts, documents = np.zeros(FREQUENCY_SLOTS, np.int64), 0
    for batch in batches:
        for low, high, data, offsets in tx.chunks(pc.utf8_lower(batch.column(0))):
            words, hashes = _lex(data, offsets)
            pairs = np.sort(words.owner() * FREQUENCY_SLOTS + _slots(hashes).astype(np.int64))
            first = np.ones(len(pairs), bool)
            first[1:] = pairs[1:] != pairs[:-1]
            counts += np.bincount(pairs[first] % FREQUENCY_SLOTS, minlength=FREQUENCY_SLOTS)
            documents += high - low
    slots = np.flatnonzero(counts)
    yield pa.record_batch({"slot": np.append(slots, -1).astype(np.int32), "n": np.append(counts[slots], documents)})


def inverse_frequencies(documents: DataFrame) -> np.ndarray:
    """log(documents / documents with the word) by slot, over all documents; at most FREQUENCY_SLOTS numbers."""
    rows = documents.select("text").mapInArrow(_document_counts, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slots, n = rows["slot"].to_numpy(), rows["n"].to_numpy()
    counts = np.zeros(FREQUENCY_SLOTS)
    counts[slots[slots >= 0]] = n[slots >= 0]
    total = n[slots < 0].sum()
    return np.log((1.0 + total) / (1.0 + counts)).astype(np.float32) + np.float32(0.01)


def read_items(rows: list) -> list[Item]:
    """Items of benchmark rows (item_id, text) that have words."""
    items = []
    for item_id, text in rows:
        data, offsets = tx.raw(pc.utf8_lower(pa.array([text], pa.string())))
        words, hashes = _lex(data, offsets)
        if not len(hashes):
            continue
        stops = np.flatnonzero(np.isin(data, np.frombuffer(b".!?\n", np.uint8)))
        begins = words.starts
        inner = [s for s in stops if begins[0] < s < begins[-1]]
        answer = hashes[np.searchsorted(begins, inner[-1]) :] if inner else hashes[-max(1, len(hashes) // 4) :]
        items.append(Item(item_id, hashes, answer))
    return items


def _passages(items: list[Item]) -> list[tuple[int, np.ndarray]]:
    found = []
    for i, item in enumerate(items):
        if len(item.words) < LEAST_WORDS:
            continue
        for at in range(0, max(1, len(item.words) - PASSAGE // 2), PASSAGE // 2):
            found.append((i, item.words[at : at + PASSAGE]))
    return found


def _sketch(directions):
    """Each part's A^T (A X) for its passages' rows of A: one product for each number of the result."""

    def run(batches):
        x = directions.value
        total = np.zeros_like(x)
        for batch in batches:
            for at, value in zip(batch.column(0), batch.column(1), strict=True):
                at, value = at.values.to_numpy(), value.values.to_numpy()
                total[at] += value[:, None] * (value @ x[at])
        yield pa.record_batch({"g": pa.array([total.tobytes()], pa.binary())})

    return run


def latent_basis(spark: SparkSession, rows: list[tuple[np.ndarray, np.ndarray]], width: int, rank: int, seed: int = SEED, parts: int = 2) -> np.ndarray:
    """(width, k): leading right singular directions of the matrix with these sparse rows, by a randomised SVD.

    The passes over the matrix, A^T (A X), run on the executors; the driver keeps matrices of a block's vocabulary by
    its rank only, and orthonormalises between passes.
    """
    rank = min(rank, len(rows), width)
    table = pa.table({"at": pa.array([r[0] for r in rows], pa.list_(pa.int32())), "value": pa.array([r[1].astype(float) for r in rows], pa.list_(pa.float64()))})
    frame = spark.createDataFrame(table).repartition(parts)
    x, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, min(width, rank + 8))))
    for _ in range(POWER_ROUNDS + 1):
        sketched = frame.mapInArrow(_sketch(spark.sparkContext.broadcast(x)), "g binary").toArrow()["g"]
        gram = sum(np.frombuffer(g.as_py(), float).reshape(x.shape) for g in sketched)
        inner = x.T @ gram
        x, _ = np.linalg.qr(gram)
    # Rotate to singular directions and leave out those without weight.
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    keep = np.argsort(values)[::-1][:rank]
    keep = keep[values[keep] > 1e-9 * max(values.max(), 1e-30)]
    sketched = frame.mapInArrow(_sketch(spark.sparkContext.broadcast(x)), "g binary").toArrow()["g"]
    values, vectors = np.linalg.eigh(x.T @ sum(np.frombuffer(g.as_py(), float).reshape(x.shape) for g in sketched))
    return (x @ vectors[:, ::-1][:, : len(keep)]).astype(np.float32)


def build_blocks(spark: SparkSession, items: list[Item], idf: np.ndarray) -> list[Block]:
    passages, blocks, high = _passages(items), [], 0
    while high < len(passages):
        low, high = high, min(high + BLOCK, len(passages))
        while high < len(passages) and passages[high][0] == passages[high - 1][0]:  # an item stays within a block
            high += 1
        part = passages[low:high]
        vocabulary = np.unique(np.concatenate([p for _, p in part]))
        weights = idf[_slots(vocabulary)]
        rows = []
        for _, words in part:
            at, n = np.unique(np.searchsorted(vocabulary, words), return_counts=True)
            value = n * weights[at]
            rows.append((at.astype(np.int32), value / max(float(np.linalg.norm(value)), 1e-9)))
        basis = latent_basis(spark, rows, len(vocabulary), -(-len(rows) // PASSAGES_A_DIMENSION))
        folded = np.stack([value.astype(np.float32) @ basis[at] for at, value in rows])
        kept = np.square(folded).sum(1, keepdims=True)
        blocks.append(Block(vocabulary, weights, basis, folded / np.maximum(kept, 1e-3), np.array([i for i, _ in part])))
    return blocks


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    masks: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        masks[word] = masks.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for word in b.tolist():
        if mask := masks.get(word):
            both = row & mask
            row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def decide(item: Item, stretch: np.ndarray) -> tuple[float, bool, bool]:
    """(share of the text in the stretch, answer there, contaminated)."""
    share = common_subsequence(item.words, stretch) / len(item.words)
    answer = common_subsequence(item.answer, stretch) >= ANSWER * len(item.answer) if share >= LIKELY else False
    return share, answer, share >= SURE or (share >= LIKELY and answer)


def matches(data: np.ndarray, offsets: np.ndarray, items: list[Item], blocks: list[Block], idf: np.ndarray, short: bool = True) -> dict[tuple[int, int], tuple[float, float, bool]]:
    """(row, item): (best cosine, share, answer) of contaminated pairs of a chunk of texts."""
    words, hashes = _lex(data, offsets)
    if not len(hashes):
        return {}
    weights = idf[_slots(hashes)]
    mass = np.append(0.0, np.cumsum(weights.astype(float) ** 2))
    counts = words.counts()
    windows = np.where(counts > 0, np.maximum(1, -(-(counts - WINDOW) // STEP) + 1), 0)
    owner = np.repeat(np.arange(len(counts)), windows)
    place = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    start = words.first[owner] + place * STEP
    end = np.minimum(start + WINDOW, words.first[owner + 1])
    near: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    for block in blocks:
        bits = np.zeros(1 << 20, bool)
        bits[block.vocabulary & np.uint64((1 << 20) - 1)] = True
        hit = np.flatnonzero(bits[hashes & np.uint64((1 << 20) - 1)])
        at = np.minimum(np.searchsorted(block.vocabulary, hashes[hit]), len(block.vocabulary) - 1)
        sure = block.vocabulary[at] == hashes[hit]
        hit, at = hit[sure], at[sure]
        held = np.append(0.0, np.cumsum(weights[hit].astype(float) ** 2))
        low, high = np.searchsorted(hit, start), np.searchsorted(hit, end)
        total = mass[end] - mass[start]
        able = np.flatnonzero((held[high] - held[low] >= LEAST_SHARE * total) & (high > low))
        for part in np.array_split(able, max(1, len(able) // 512)):
            if not len(part):
                continue
            size = high[part] - low[part]
            flat = np.repeat(low[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            rows = weights[hit[flat], None] * block.basis[at[flat]]
            folded = np.add.reduceat(rows, np.cumsum(size) - size, 0)
            # The squared weights of all places are at most the window's squared length, which counts repeated words together.
            nearness = folded @ block.passages.T / np.sqrt(np.maximum(total[part], 1e-12))[:, None]
            for i in np.flatnonzero(nearness.max(1) >= LEAST_NEARNESS):
                w = part[i]
                _, first, n = np.unique(hashes[start[w] : end[w]], return_index=True, return_counts=True)
                own = nearness[i] * np.sqrt(total[w]) / np.linalg.norm(n * weights[start[w] : end[w]][first])
                for j in np.flatnonzero(own >= LEAST_NEARNESS):
                    near.setdefault((int(owner[w]), int(block.owners[j])), []).append((int(start[w]), int(end[w]), float(own[j])))
    found = {}
    for (row, number), spans in near.items():
        item = items[number]
        first, last = words.first[row], words.first[row + 1]
        reach = len(item.words) + STEP
        spans.sort()
        best, share, answer, low, high = 0.0, 0.0, False, None, None
        stretches = []
        for s, e, cosine in spans:
            best = max(best, cosine)
            s, e = max(first, s - reach), min(last, e + reach)
            if stretches and s <= stretches[-1][1]:
                stretches[-1][1] = max(stretches[-1][1], e)
            else:
                stretches.append([s, e])
        leaked = False
        for low, high in stretches:
            got, told, bad = decide(item, hashes[low:high])
            leaked |= bad
            share, answer = max(share, got), answer or told
        if leaked:
            found[row, number] = (best, share, answer)
    for number, item in enumerate(items):
        if short and len(item.words) < LEAST_WORDS:
            found |= {(row, number): (1.0, 1.0, True) for row in _verbatim(words, hashes, item.words)}
    return found


def _verbatim(words: tx.Words, hashes: np.ndarray, wanted: np.ndarray) -> list[int]:
    """Texts in which the wanted words stand one after the other."""
    last = len(hashes) - len(wanted) + 1
    at = np.flatnonzero(hashes[: max(0, last)] == wanted[0])
    for k in range(1, len(wanted)):
        at = at[hashes[at + k] == wanted[k]]
    rows = np.searchsorted(words.first, at, "right") - 1
    return np.unique(rows[at + len(wanted) <= words.first[rows + 1]]).tolist()


def _search(model, keep_clean: bool):
    def run(batches):
        items, blocks, idf, short = model.value
        for batch in batches:
            ids, texts = batch.schema.get_field_index("doc_id"), batch.schema.get_field_index("text")
            clean = np.ones(len(batch), bool)
            out = {"row": [], "item_id": [], "cosine": [], "share": [], "answer": []}
            for low, _, data, offsets in tx.chunks(pc.utf8_lower(batch.column(texts))):
                for (row, number), (cosine, share, answer) in sorted(matches(data, offsets, items, blocks, idf, short).items()):
                    clean[low + row] = False
                    for k, v in zip(out, (low + row, items[number].item_id, cosine, share, answer), strict=True):
                        out[k].append(v)
            if keep_clean:
                yield batch.filter(pa.array(clean))
            else:
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(ids).take(pa.array(out["row"], pa.int64())),
                        "item_id": pa.array(out["item_id"], pa.int64()),
                        "cosine": pa.array(out["cosine"], pa.float64()),
                        "lcs_share": pa.array(out["share"], pa.float64()),
                        "has_answer": pa.array(out["answer"], pa.bool_()),
                    }
                )

    return run


def _models(documents: DataFrame, benchmark: DataFrame):
    """The benchmark's items with their blocks, ``BLOCKS_AT_ONCE`` blocks at a time."""
    spark = documents.sparkSession
    ship(spark)
    items = read_items([(r["item_id"], r["text"]) for r in benchmark.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").collect()])  # the query set
    if not items:
        return
    idf = inverse_frequencies(documents)
    blocks = build_blocks(spark, items, idf)
    for low in range(0, max(1, len(blocks)), BLOCKS_AT_ONCE):
        yield spark.sparkContext.broadcast((items, blocks[low : low + BLOCKS_AT_ONCE], idf, low == 0))


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it contains: doc_id, item_id, cosine, lcs_share, has_answer."""
    schema = "doc_id bigint, item_id bigint, cosine double, lcs_share double, has_answer boolean"
    found = documents.sparkSession.createDataFrame([], schema)
    rows = documents.select("doc_id", "text")
    for i, model in enumerate(_models(documents, benchmark)):
        part = rows.mapInArrow(_search(model, False), schema)
        found = part if i == 0 else found.union(part)
    return found


def remove_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that contain a benchmark text; all columns as they were."""
    kept = documents
    for model in _models(documents, benchmark):
        kept = kept.mapInArrow(_search(model, True), documents.schema)
    return kept
