"""Media columns: chroma audio fingerprints, and recordings aligned by offset histograms and bit errors.

A recording (8-bit samples) becomes frames of a windowed spectrum, each folded into twelve pitch classes. Sixteen filters
over an integral image of the pitch-class frames compare the sums of two areas; each comparison is quantised to two
Gray-coded bits, and the thirty-two bits of a frame are one packed integer.

Recordings are aligned by landmarks: hashes of the steadier half of the bits of two packed integers some frames apart, of
which the least in every stretch is kept, so that a common stretch gives common landmarks. Common landmarks of a query and a recording vote for an
offset in a histogram, and the bit errors of all packed integers that overlap at the best offset decide.

Recordings with equal fingerprints are one class from the start; queries meet classes, never all copies. Defined
results: a recording of fewer than ``LEAST_OVERLAP`` packed integers cannot overlap enough to align and is a class and
group of its own or of its equals; a null or empty recording has no frames and belongs to the class of empty ones, which matches nothing; one
shorter than a frame is padded with silence; rows that repeat an id are recordings of their own; a null id is never a
query; an empty table gives no rows. Only the id and media columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import settle, ship
from .components import components

RATE, FRAME, HOP = 8000, 256, 64
LOWEST_HZ, HIGHEST_HZ = 55.0, 3520.0
FILTER_WIDTH = 8
#: Frames of a landmark's two integers, the bits of each that it holds, and how many landmarks in a row are thinned to one.
#: Of a filter's two bits only the first is held: whether one area outweighs the other changes less than by how much.
LANDMARK_FRAMES = (0, FILTER_WIDTH)
LANDMARK_BITS = 0xAAAAAAAA
STRETCH = 4
#: Most bit errors of many aligned integers, and the least number of them, of which none may have an error.
MOST_BIT_ERRORS = 0.2
LEAST_OVERLAP = 4
FILTER_BITS = 1 << 25
QUERY_MODULUS = 50
#: Recordings, and queries, of a landmark that meet in one block.
BLOCK = 1024

#: (kind, first pitch class, height, width) by rule: each of four comparisons at four sizes of area.
FILTERS = [(kind, (3 * size + 2 * kind) % (12 - height + 1), height, width) for kind in range(4) for size, (height, width) in enumerate(((2, 8), (4, 4), (6, 2), (8, 8)))]
#: Thresholds of the log ratio that part it into four. None is 0, which two silent areas give.
THRESHOLDS = (-0.25, 0.03, 0.3)
#: Added to both areas, so that what is nearly silent compares as equal.
FLOOR = 0.1


def pitch_classes(rate: int = RATE, frame: int = FRAME) -> np.ndarray:
    """(spectrum bin, 12): which pitch class a bin's frequency belongs to."""
    hz = np.fft.rfftfreq(frame, 1 / rate)
    fold = np.zeros((len(hz), 12), np.float32)
    used = np.flatnonzero((hz >= LOWEST_HZ) & (hz <= HIGHEST_HZ))
    fold[used, np.round(12 * np.log2(hz[used] / 440.0)).astype(int) % 12] = 1
    return fold


def frame_counts(sizes: np.ndarray, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    return np.where(sizes > 0, np.maximum(0, sizes - frame) // hop + 1, 0)


def chroma_frames(samples: np.ndarray, offsets: np.ndarray, rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> tuple[np.ndarray, np.ndarray]:
    """(frames of all recordings, 12) of unit sum, and where each recording's frames start."""
    sizes = np.diff(offsets)
    counts = frame_counts(sizes, frame, hop)
    first = np.append(0, np.cumsum(counts))
    out = np.zeros((first[-1], 12), np.float32)
    signal = np.append(samples.astype(np.float32) - 128, np.zeros(frame, np.float32))
    start = np.repeat(offsets[:-1], counts) + (np.arange(first[-1]) - np.repeat(first[:-1], counts)) * hop
    short = np.repeat(np.where(sizes < frame, sizes, frame), counts)
    window, fold = np.hanning(frame).astype(np.float32), pitch_classes(rate, frame)
    for low in range(0, len(start), 4096):
        at = start[low : low + 4096, None] + np.arange(frame)
        cut = signal[at]
        cut[np.arange(frame) >= short[low : low + 4096, None]] = 0
        spectrum = np.abs(np.fft.rfft(cut * window, axis=1)).astype(np.float32)
        out[low : low + 4096] = spectrum @ fold
    return out / np.maximum(out.sum(1, keepdims=True), 1e-6), first


def fingerprints(chroma: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed integers of all recordings, and where each one's start; a recording of few frames is padded with its last."""
    counts = np.diff(first)
    lengths = np.where(counts > 0, np.maximum(counts - FILTER_WIDTH + 1, 1), 0)
    starts = np.append(0, np.cumsum(lengths))
    image = np.zeros((len(chroma) + FILTER_WIDTH + 1, 13))
    padded = np.concatenate([chroma, np.repeat(chroma[-1:], FILTER_WIDTH, 0)]) if len(chroma) else np.zeros((FILTER_WIDTH, 12))
    image[1:, 1:] = padded.cumsum(0, dtype=np.float64).cumsum(1)
    at = np.repeat(first[:-1], lengths) + (np.arange(starts[-1]) - np.repeat(starts[:-1], lengths))
    # A recording shorter than the filters sees no other recording's frames: its areas end with its own last frame.
    last = np.repeat(first[1:], lengths)

    def area(left: int, right: int, low: int, high: int) -> np.ndarray:
        x, y = np.minimum(at + left, last), np.minimum(at + right, last)
        return image[y, high] - image[x, high] - image[y, low] + image[x, low]

    packed = np.zeros(len(at), np.uint32)
    for kind, pitch, height, width in FILTERS:
        top, middle_p, middle_t = pitch + height, pitch + height // 2, width // 2
        if kind == 0:  # lower against upper pitch classes
            a, b = area(0, width, pitch, middle_p), area(0, width, middle_p, top)
        elif kind == 1:  # earlier against later frames
            a, b = area(0, middle_t, pitch, top), area(middle_t, width, pitch, top)
        elif kind == 2:  # one diagonal against the other
            a = area(0, middle_t, pitch, middle_p) + area(middle_t, width, middle_p, top)
            b = area(0, middle_t, middle_p, top) + area(middle_t, width, pitch, middle_p)
        else:  # the middle frames against the outer ones
            a = area(width // 4, width - width // 4, pitch, top)
            b = area(0, width, pitch, top) - a
        ratio = np.log((FLOOR + np.maximum(a, 0)) / (FLOOR + np.maximum(b, 0)))
        part = np.searchsorted(THRESHOLDS, ratio).astype(np.uint32)
        packed = (packed << np.uint32(2)) | (part ^ (part >> np.uint32(1)))
    return packed, starts


def landmarks(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of one recording: of every ``STRETCH`` consecutive hashes the least is kept."""
    if not len(packed):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pairs = np.zeros(len(packed), np.uint64)
    for gap in LANDMARK_FRAMES:
        held = packed[np.minimum(np.arange(len(packed)) + gap, len(packed) - 1)] & np.uint32(LANDMARK_BITS)
        pairs = tx.mix(pairs + held.astype(np.uint64))
    if len(pairs) <= STRETCH:
        kept = np.array([int(np.argmin(pairs))])
    else:
        view = np.lib.stride_tricks.sliding_window_view(pairs, STRETCH)
        kept = np.unique(np.argmin(view, 1) + np.arange(len(view)))
    return pairs[kept], kept


def best_offset(query: np.ndarray, recording: np.ndarray) -> tuple[int, int] | None:
    """(offset, votes): the fullest bin of the histogram of differences of the places of common landmarks."""
    a, at_a = landmarks(query)
    b, at_b = landmarks(recording)
    votes: dict[int, int] = {}
    places: dict[int, list[int]] = {}
    for key, place in zip(a.tolist(), at_a.tolist(), strict=True):
        places.setdefault(key, []).append(place)
    for key, place in zip(b.tolist(), at_b.tolist(), strict=True):
        for other in places.get(key, ()):
            votes[place - other] = votes.get(place - other, 0) + 1
    return min(votes.items(), key=lambda x: (-x[1], abs(x[0]), x[0])) if votes else None


def bit_errors(query: np.ndarray, recording: np.ndarray, offset: int) -> tuple[int, float]:
    """(integers that overlap, share of their bits that differ) with the query moved by ``offset``."""
    low, high = max(0, -offset), min(len(query), len(recording) - offset)
    if high <= low:
        return 0, 1.0
    wrong = np.bitwise_count(query[low:high] ^ recording[low + offset : high + offset])
    return high - low, float(wrong.sum()) / (32 * (high - low))


def aligned_enough(overlap: int, errors: float) -> bool:
    """Whether integers that overlap, and their share of bit errors, decide for an alignment: the fewer, the nearer to equal."""
    return overlap >= LEAST_OVERLAP and errors <= MOST_BIT_ERRORS * (1 - LEAST_OVERLAP / overlap)


def _fingerprint_rows(rate: int, frame: int, hop: int):
    def run(batches):
        for batch in batches:
            rows, names = [], []
            column = batch.column(1)
            for _, _, data, offsets in tx.chunks(column.cast(pa.large_binary()).view(pa.large_string()) if pa.types.is_binary(column.type) else column, 1 << 20):
                packed, starts = fingerprints(*chroma_frames(data, offsets, rate, frame, hop))
                places = np.arange(len(packed)) - np.repeat(starts[:-1], np.diff(starts))
                hashed = np.append(np.uint64(0), np.cumsum(tx.mix(packed.astype(np.uint64) + tx.mix(places.astype(np.uint64))), dtype=np.uint64))
                names.append(tx.mix(hashed[starts[1:]] - hashed[starts[:-1]] + np.diff(starts).astype(np.uint64)).view(np.int64))
                rows += [packed[s:e].view(np.int32) for s, e in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.record_batch({"id": batch.column(0), "class": np.concatenate(names) if names else np.zeros(0, np.int64), "packed": pa.array(rows, pa.list_(pa.int32()))})

    return run


def fingerprint_column(frame: DataFrame, row_id: Column, media: Column, rate: int = RATE, size: int = FRAME, hop: int = HOP) -> DataFrame:
    """id, class (a 64-bit name of the fingerprint) and packed (an integer per frame) of each recording."""
    ship(frame.sparkSession)
    return frame.select(row_id.cast("long").alias("id"), media.alias("media")).mapInArrow(_fingerprint_rows(rate, size, hop), "id bigint, class bigint, packed array<int>")


def _landmark_rows(table):
    """Landmarks of each class; with a table, only those that some query may have."""

    def run(batches):
        bits = table.value if table is not None else None
        for batch in batches:
            names, keys, places = [], [], []
            column = batch.column(1)
            for i in range(len(batch)):
                key, place = landmarks(column[i].values.to_numpy().view(np.uint32))
                if bits is not None:
                    slot = (key % np.uint64(FILTER_BITS)).astype(np.int64)
                    may = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                    key, place = key[may], place[may]
                keys.append(key.view(np.int64))
                places.append(place)
                names.append(np.full(len(key), i))
            at = np.concatenate(names) if names else np.zeros(0, np.int64)
            yield pa.record_batch(
                {"class": batch.column(0).take(pa.array(at)), "key": np.concatenate(keys) if keys else np.zeros(0, np.int64), "place": (np.concatenate(places) if places else np.zeros(0, np.int64)).astype(np.int32)}
            )

    return run


def _alignments(batches):
    """Of pairs of recordings, those whose bits agree at the fullest bin of their whole offset histogram."""
    for batch in batches:
        kept, out = [], {"offset": [], "votes": [], "overlap": [], "bit_errors": []}
        for i, (q, r) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            query, recording = (x.values.to_numpy().view(np.uint32) for x in (q, r))
            best = best_offset(query, recording)
            overlap, wrong = bit_errors(query, recording, best[0]) if best else (0, 1.0)
            if aligned_enough(overlap, wrong):
                kept.append(i)
                for k, v in zip(out, (*best, overlap, wrong), strict=True):
                    out[k].append(v)
        at = pa.array(kept, pa.int64())
        yield pa.record_batch(
            {
                "query": batch.column(0).take(at),
                "class": batch.column(1).take(at),
                "offset": pa.array(out["offset"], pa.int32()),
                "votes": pa.array(out["votes"], pa.int64()),
                "overlap": pa.array(out["overlap"], pa.int64()),
                "bit_errors": pa.array(out["bit_errors"], pa.float64()),
            }
        )


def align_queries(prints: DataFrame, is_query: Column) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs): id, frames, class_id, group_id, members and is_query of each recording; aligned pairs of classes.

    A class has equal fingerprints and is named by the smallest id in it. A pair says that a query's class aligns with
    another class at an offset (frames), with its votes, the integers that overlap and their share of bit errors.

    Every query meets every recording that shares a landmark with it, inside a group of copies too: alignment is not
    transitive, so no pair follows from others. A landmark of many recordings is dealt in blocks of recordings and of
    queries, so that no task has more than ``BLOCK`` of each; the pairs of a large group of copies stay as many as they are.
    """
    spark = prints.sparkSession
    prints = settle(prints, "prints")
    named = settle(
        prints.groupBy("class").agg(F.min("id").alias("class_id"), F.coalesce(F.bool_or(is_query), F.lit(False)).alias("asks"), F.count(F.lit(1)).alias("members")), "classes"
    )
    sets = prints.where(F.size("packed") >= LEAST_OVERLAP).select("class", "packed").dropDuplicates(["class"])
    sets = settle(sets.join(named, "class").select("class", "packed", "asks"), "sets")
    asked = settle(sets.where("asks").select("class", "packed").mapInArrow(_landmark_rows(None), "class bigint, key bigint, place int").select("class", "key").distinct(), "asked")
    slots = asked.select(F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("s"))
    words = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("v")).toArrow()  # at most FILTER_BITS / 64 rows
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[words["w"].to_numpy()] = words["v"].to_numpy()
    may = spark.sparkContext.broadcast(table.view(np.uint8))
    marks = settle(sets.select("class", "packed").mapInArrow(_landmark_rows(may), "class bigint, key bigint, place int").select("class", "key").distinct(), "marks")

    def aligned(candidates: DataFrame) -> DataFrame:
        paired = candidates.join(sets.where("asks").select(F.col("class").alias("query"), F.col("packed").alias("q")), "query").join(sets.select("class", F.col("packed").alias("r")), "class")
        return settle(paired.select("query", "class", "q", "r").mapInArrow(_alignments, "query bigint, class bigint, offset int, votes bigint, overlap bigint, bit_errors double"), "pairs")

    # A landmark of one class has that query alone and makes no pair.
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sizes = marks.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").join(asked.groupBy("key").agg(F.count(F.lit(1)).alias("q")), "key")
    sizes = settle(sizes.select("key", parts("m").alias("m"), parts("q").alias("q")), "sizes")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    left = marks.join(sizes, "key").select("key", "class", of("class", "m").alias("part"), every("q").alias("block"))
    right = asked.join(sizes, "key").select("key", F.col("class").alias("query"), every("m").alias("part"), of("class", "q").alias("block"))
    pairs = aligned(left.join(right, ["key", "part", "block"]).where("query != class").select("query", "class").distinct())
    groups = settle(components(pairs.select(F.col("query").alias("a"), F.col("class").alias("b"))), "groups")
    named = named.join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    group_ids = settle(named.groupBy("root").agg(F.min("class_id").alias("group_id")), "group-ids")
    named = settle(named.join(group_ids, "root").select("class", "class_id", "group_id", "members"), "named")

    ids = named.select("class", "class_id")
    pairs = pairs.join(ids.withColumnRenamed("class_id", "query_class_id").withColumnRenamed("class", "query"), "query").join(ids, "class").drop("query", "class")
    classes = prints.select("id", F.size("packed").cast("long").alias("frames"), "class", F.coalesce(is_query, F.lit(False)).alias("is_query")).join(named, "class").drop("class")
    return classes, pairs
