"""LM scoring by masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

Tokens are words; the ``OWN_SYMBOLS`` most frequent words of the corpus are symbols of their own, all others share
``LEAVES`` hashed symbols. Symbols stand in classes by frequency, and a symbol's probability given ``SIDE`` symbols on
each side is that of its class times that within its class, each a softmax over the hidden layer
tanh(E[left, right] W1 + b1). A document's score is the sum over all its tokens of the log-probability of the true word:
its masked pseudo-log-likelihood. A word of a shared symbol has the symbol's probability times the word's share of the
symbol's tokens in the whole corpus, so the vocabulary is that of the corpus, whatever its size.

Word counts come from all documents and are kept in a table: ``TOLD`` words are sent to the workers, all others are
joined. The network is trained with numpy on every position of all documents, once: in each of ``ROUNDS`` rounds every
partition trains from the common weights on its share of the positions, and the partitions' weights are averaged by
windows seen; sums are taken on the executors, in two steps and in fixed point, so they do not depend on their order.
The weights depend on how the documents lie in partitions, as in any training by averaging; for one layout they are the same.

Defined results: a null or empty text has no tokens, log_prob 0 and a null mean; a text's first and last tokens see a
padding symbol; rows that repeat an id are scored each; an empty table gives no rows. Only ``doc_id`` and ``text`` are
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import drop_settled, settle, ship

#: Symbols are numbered class by class; the last class has those that words share.
CLASSES, LEAVES = 128, 128
SYMBOLS = CLASSES * LEAVES
OWN_SYMBOLS = SYMBOLS - LEAVES
SIDE = 2
EMBEDDING = 16
HIDDEN = 16
ROUNDS = 1
MINIBATCH = 16384
RATE = 0.2
SEED = 7
#: Parts of the weights that are averaged one by one, and groups of partitions whose sums are taken first.
SHARDS, FAN = 16, 64
_FIXED = float(1 << 24)
_BLOCK = 32768
#: Rows whose logits fit a core's cache.
_CACHED = 1024
#: Words of shared symbols whose counts the workers are sent; it decides where a count is looked up, not what is scored.
TOLD = 1 << 18
#: Distinct words that a worker holds while it counts.
MERGED = 1 << 19

Weights = dict[str, np.ndarray]


def start_weights(seed: int = SEED, shares: np.ndarray | None = None) -> Weights:
    """Random weights; with shares of the symbols, biases that give them."""
    rng = np.random.default_rng(seed)
    inputs = 2 * SIDE * EMBEDDING
    shares = np.full(SYMBOLS, 1 / SYMBOLS) if shares is None else shares
    leaves = shares.reshape(CLASSES, LEAVES)
    return {
        "e": (rng.standard_normal((SYMBOLS + 1, EMBEDDING)) * 0.3).astype(np.float32),
        "w1": (rng.standard_normal((inputs, HIDDEN)) / np.sqrt(inputs)).astype(np.float32),
        "b1": np.zeros(HIDDEN, np.float32),
        "c": (rng.standard_normal((HIDDEN, CLASSES)) * 0.05).astype(np.float32),
        "cb": np.log(leaves.sum(1)).astype(np.float32),
        "o": (rng.standard_normal((CLASSES, HIDDEN, LEAVES)) * 0.05).astype(np.float32),
        "ob": np.log(leaves / leaves.sum(1, keepdims=True)).astype(np.float32),
    }


def symbols_of(words: tx.Words, known: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A symbol for each word: its own, or one of the shared ones by its hash. known: sorted hashes."""
    hashes = words.hashes()
    found = (OWN_SYMBOLS + ((hashes >> np.uint64(17)) % np.uint64(LEAVES))).astype(np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        found = np.where(known[at] == hashes, number[at], found)
    return found


def contexts(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(token, 2 * SIDE) symbols around each token, padding beyond its own text."""
    n = len(symbols)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full((n, 2 * SIDE), SYMBOLS, np.int64)
    for column, shift in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        to, at = (slice(-shift, None), slice(None, shift)) if shift < 0 else (slice(None, -shift), slice(shift, None))
        if n > abs(shift):
            same = owner[to] == owner[at]
            out[to, column] = np.where(same, symbols[at], SYMBOLS)
    return out


def _exponentials(logits: np.ndarray, bias: np.ndarray, steep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of the logits, in place, which lack their bias: (a factor for each column, each row's sum of these products, its log).

    A bias is one factor for all rows, so it need not be added to every logit; the log is of the sum with all factors.
    """
    if steep:  # else exp cannot overflow
        logits += bias
        top = logits.max(1)
        logits -= top[:, None]
    np.exp(logits, out=logits)
    factor = np.ones_like(bias) if steep else np.exp(bias)
    total = logits @ factor
    return factor, total, np.log(total) + top if steep else np.log(total)


def _steep(weights: Weights) -> bool:
    """Whether some logit may be too large for exp, or for a quotient of two; the hidden layer is within -1 and 1."""
    return max(float((np.abs(weights[w]).sum(-2) + np.abs(weights[b])).max()) for w, b in (("c", "cb"), ("o", "ob"))) > 40


def _slopes(hidden: np.ndarray, true: np.ndarray, weight: np.ndarray, bias: np.ndarray, steep: bool, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient of the mean loss over n rows by the hidden layer, by the weight and by the bias of a softmax.

    The slopes are factors of rows times what ``logits`` then holds times factors of columns, which narrower arrays take.
    """
    logits = hidden @ weight
    column, total, _ = _exponentials(logits, bias, steep)
    logits[np.arange(len(true)), true] -= total / column[true]
    row = 1 / (total * np.float32(n))
    back = logits @ (weight * column).T
    back *= row[:, None]
    return back, ((hidden * row[:, None]).T @ logits) * column, (row @ logits) * column


def _by_class(classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(An order of the rows by class, (class, its first place, the place after its last) of each class that is there)."""
    order = np.argsort(classes.astype(np.uint8), kind="stable")  # by radix
    ends = np.cumsum(np.bincount(classes, minlength=CLASSES))
    return order, [(k, low, high) for k, (low, high) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if high > low]


def log_probabilities(context: np.ndarray, symbols: np.ndarray, weights: Weights) -> np.ndarray:
    """log P(symbol | context) of each token; the first layer is folded into one table per place."""
    tables = [weights["e"] @ weights["w1"][k * EMBEDDING : (k + 1) * EMBEDDING] for k in range(2 * SIDE)]
    tables[0] = tables[0] + weights["b1"]
    steep = _steep(weights)
    out = np.empty(len(symbols), np.float32)
    for low in range(0, len(symbols), _BLOCK):
        part, true = context[low : low + _BLOCK], symbols[low : low + _BLOCK]
        hidden = tables[0].take(part[:, 0], axis=0)  # much faster than an index array
        for k in range(1, 2 * SIDE):
            hidden += tables[k].take(part[:, k], axis=0)
        np.tanh(hidden, out=hidden)
        classes, leaves = np.divmod(true, LEAVES)
        told = np.empty(len(true), np.float32)
        for at in range(0, len(true), _CACHED):
            rows = slice(at, at + _CACHED)
            logits = hidden[rows] @ weights["c"]
            told[rows] = logits[np.arange(len(logits)), classes[rows]] + weights["cb"][classes[rows]]
            told[rows] -= _exponentials(logits, weights["cb"], steep)[2]
        order, spans = _by_class(classes)
        hidden, leaves, told = hidden.take(order, axis=0), leaves[order], told[order]
        for k, first, last in spans:
            for at in range(first, last, _CACHED):
                rows = slice(at, min(at + _CACHED, last))
                logits = hidden[rows] @ weights["o"][k]
                told[rows] += logits[np.arange(len(logits)), leaves[rows]] + weights["ob"][k][leaves[rows]]
                told[rows] -= _exponentials(logits, weights["ob"][k], steep)[2]
        out[low + order] = told
    return out


def train_windows(context: np.ndarray, symbols: np.ndarray, weights: Weights, moments: Weights, rate: float) -> None:
    """Adagrad over minibatches, in place."""

    def step(name, gradient, at=slice(None)):
        moment, weight = moments[name][at], weights[name][at]  # views
        moment += gradient * gradient
        weight -= rate * gradient / np.sqrt(moment)

    for low in range(0, len(symbols), MINIBATCH):
        part, true = context[low : low + MINIBATCH], symbols[low : low + MINIBATCH]
        n = len(true)
        x = weights["e"].take(part, axis=0).reshape(n, -1)
        hidden = np.tanh(x @ weights["w1"] + weights["b1"])
        classes, leaves = np.divmod(true, LEAVES)
        steep = _steep(weights)
        back, to_c, to_cb = np.empty_like(hidden), 0, 0
        for at in range(0, n, _CACHED):
            rows = slice(at, at + _CACHED)
            back[rows], of_c, of_cb = _slopes(hidden[rows], classes[rows], weights["c"], weights["cb"], steep, n)
            to_c, to_cb = to_c + of_c, to_cb + of_cb
        order, spans = _by_class(classes)
        sorted_hidden, sorted_leaves, within = hidden.take(order, axis=0), leaves[order], np.empty_like(hidden)
        for k, first, last in spans:
            to_o, to_ob = 0, 0
            for at in range(first, last, _CACHED):
                rows = slice(at, min(at + _CACHED, last))
                within[rows], of_o, of_ob = _slopes(sorted_hidden[rows], sorted_leaves[rows], weights["o"][k], weights["ob"][k], steep, n)
                to_o, to_ob = to_o + of_o, to_ob + of_ob
            step("o", to_o, k)
            step("ob", to_ob, k)
        back += within.take(np.argsort(order), axis=0)
        step("c", to_c)
        step("cb", to_cb)
        back *= 1 - hidden * hidden
        to_e = (back @ weights["w1"].T).reshape(-1, EMBEDDING)
        step("w1", x.T @ back)
        step("b1", back.sum(0))
        flat = part.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")  # by radix
        rows, at = np.unique(flat[order], return_index=True)
        gradient = np.add.reduceat(to_e.take(order, axis=0), at, 0)
        moment = moments["e"].take(rows, axis=0) + gradient * gradient
        moments["e"][rows] = moment
        weights["e"][rows] = weights["e"].take(rows, axis=0) - rate * gradient / np.sqrt(moment)


def _word_counts(batches):
    """(word, n) of this part, words that are far apart once for each time that ``MERGED`` of them are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        word, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(word)
        word, n = word[order], n[order]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
        return word[first], np.add.reduceat(n, first) if len(word) else n

    for batch in batches:
        for _, _, data, offsets in tx.chunks(batch.column(0)):
            held.append(np.unique(tx.split(data, offsets).hashes(), return_counts=True))
        if sum(len(word) for word, _ in held) > MERGED:
            held = [merged()]
            if len(held[0][0]) > MERGED // 2:
                yield pa.record_batch({"word": held[0][0].view(np.int64), "n": held[0][1].astype(np.int64)})
                held = []
    if held:
        word, n = merged()
        yield pa.record_batch({"word": word.view(np.int64), "n": n.astype(np.int64)})


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) of all documents; words are hashes."""
    return settle(documents.select("text").mapInArrow(_word_counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")


def common_words(counts: DataFrame, most: int = OWN_SYMBOLS) -> tuple[np.ndarray, np.ndarray, Column, dict[int, int]]:
    """The most frequent words; ties go to the smaller hash.

    (Their hashes by rank, share of each symbol, whether a row of the counts has a symbol of its own, tokens of each shared symbol.)
    """
    top = counts.orderBy(F.desc("n"), "word").limit(most).toArrow()  # bounded by the symbols
    words, n = (top[c].to_numpy() for c in ("word", "n"))
    own = F.lit(True)
    if len(words) == most:
        last, word = F.lit(int(n[-1])).cast("long"), F.lit(int(words[-1])).cast("long")
        own = (F.col("n") > last) | ((F.col("n") == last) & (F.col("word") <= word))
    rows = counts.where(~own).groupBy(_shared_symbol().alias("s")).agg(F.sum("n").alias("n")).collect()  # a row per shared symbol
    shares = np.ones(SYMBOLS)
    shares[: len(words)] += n
    for r in rows:
        shares[r["s"]] += r["n"]
    return words, shares / shares.sum(), own, {r["s"]: r["n"] for r in rows}


def _shared_symbol() -> Column:
    """The shared symbol of a word of the counts table; see ``symbols_of``."""
    # the top bits of (word >>> 17) modulo a power of two are its lowest
    return (F.shiftrightunsigned("word", 17).bitwiseAND(F.lit(LEAVES - 1)) + OWN_SYMBOLS).cast("int")


def count_words(documents: DataFrame, most: int = OWN_SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the most frequent words, share of each symbol), over all documents."""
    counts = word_counts(documents)
    words, shares, _, _ = common_words(counts, most)
    drop_settled(counts)
    return words, shares


def words_within(counts: DataFrame, own: Column, totals: dict[int, int]) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """log P(word | its shared symbol): sorted hashes and values of the ``TOLD`` most frequent, and a table (word, within) of all others."""
    total = F.element_at(F.array(*[F.lit(totals.get(s, 0)).cast("long") for s in range(OWN_SYMBOLS, SYMBOLS)]), F.col("s") - OWN_SYMBOLS + 1)
    shared = counts.where(~own).withColumn("s", _shared_symbol()).withColumn("within", F.log(F.col("n") / total))
    told = shared.orderBy(F.desc("n"), "word").limit(TOLD).select("word", "n", "within").toArrow()  # bounded by TOLD
    rest = None
    if len(told) == TOLD:
        n, word = told["n"][-1].as_py(), told["word"][-1].as_py()
        rest = shared.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > word))).select("word", "within")
    hashes = told["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], told["within"].to_numpy()[order], rest


def _known(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known = np.asarray(words, np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], order.astype(np.int64)


def _trained(start, turn: int, rounds: int = ROUNDS):
    def run(batches):
        words, weights = start.value
        known, number = _known(words)
        weights = {k: v.copy() for k, v in weights.items()}
        moments = {k: np.full_like(v, 1e-4) for k, v in weights.items()}
        windows, waiting = 0, []

        def flush():
            context, symbols = (np.concatenate(x) for x in zip(*waiting, strict=True))
            mixed = np.argsort(tx.mix(np.arange(len(symbols), dtype=np.uint64)))  # documents mixed
            train_windows(context.take(mixed, axis=0), symbols[mixed], weights, moments, RATE / (1 + turn))
            waiting.clear()
            return len(symbols)

        for batch in batches:
            for _, _, data, offsets in tx.chunks(batch.column(0)):
                lexed = tx.split(data, offsets)
                symbols = symbols_of(lexed, known, number)
                place = np.arange(len(symbols)) - np.repeat(lexed.first[:-1], lexed.counts())
                taken = np.flatnonzero(place % rounds == turn)
                if len(taken):
                    waiting.append((contexts(symbols, lexed.first).take(taken, axis=0), symbols[taken]))
                if sum(len(s) for _, s in waiting) >= 4 * MINIBATCH:
                    windows += flush()
        if waiting:
            windows += flush()
        if windows:
            share = -(-windows // 256)
            flat = np.concatenate([weights[k].ravel() for k in sorted(weights)])
            sums = np.round(np.clip(flat, -100, 100) * _FIXED).astype(np.int64) * share
            group = int(tx.mix(np.array([windows], np.uint64) ^ sums[:1].view(np.uint64))[0] % np.uint64(FAN))
            for shard, part in enumerate(np.array_split(sums, SHARDS)):
                yield pa.record_batch({"shard": [shard], "part": [group], "n": [share], "sums": pa.array([part.tobytes()], pa.binary())})

    return run


def _summed(batches):
    """One row for each (shard, part) of this partition: the sums of all its rows."""
    sums: dict[tuple[int, int], list] = {}
    for batch in batches:
        for shard, part, n, blob in zip(*(batch.column(k) for k in range(4)), strict=True):
            row = sums.setdefault((shard.as_py(), part.as_py()), [0, 0])
            row[0] += n.as_py()
            row[1] = row[1] + np.frombuffer(blob.as_py(), np.int64)
    for (shard, part), (n, total) in sums.items():
        yield pa.record_batch({"shard": [shard], "part": [part], "n": [n], "sums": pa.array([total.tobytes()], pa.binary())})


def train(documents: DataFrame, words: np.ndarray, shares: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> Weights:
    """Weights after ``rounds`` of training on every partition and averaging, from the symbols' shares on."""
    spark = documents.sparkSession
    weights, kind = start_weights(seed, shares), "shard long, part long, n long, sums binary"
    for turn in range(rounds):
        parts = documents.select("text").mapInArrow(_trained(spark.sparkContext.broadcast((words, weights)), turn, rounds), kind)
        sums = parts.repartition(SHARDS * 4, "shard", "part").mapInArrow(_summed, kind).withColumn("part", F.lit(0).cast("long"))
        rows = sums.repartition(SHARDS, "shard").mapInArrow(_summed, kind).orderBy("shard").collect()  # the weights: SHARDS rows
        if not rows:  # no text has a position of this round
            continue
        flat, at = np.concatenate([np.frombuffer(r["sums"], np.int64) for r in rows]) / rows[0]["n"] / _FIXED, 0
        for k in sorted(weights):
            weights[k] = flat[at : at + weights[k].size].reshape(weights[k].shape).astype(np.float32)
            at += weights[k].size
    return weights


def _scores(model):
    def run(batches):
        words, weights, told, within = model.value
        known, number = _known(words)
        for batch in batches:
            tokens, sums = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            left, n_left = [np.zeros(0, np.int64)], np.zeros(len(batch), np.int64)
            for low, high, data, offsets in tx.chunks(batch.column(1)):
                lexed = tx.split(data, offsets)
                symbols = symbols_of(lexed, known, number)
                found = log_probabilities(contexts(symbols, lexed.first), symbols, weights).astype(np.float64)
                shared = np.flatnonzero(symbols >= OWN_SYMBOLS)
                hashes = lexed.hashes()[shared]
                if len(hashes) and len(told):
                    at = np.minimum(np.searchsorted(told, hashes), len(told) - 1)
                    hit = told[at] == hashes
                    found[shared[hit]] += within[at[hit]]
                    left.append(hashes[~hit].view(np.int64))
                    n_left[low:high] = np.bincount(lexed.owner()[shared[~hit]], minlength=high - low)
                tokens[low:high] = lexed.counts()
                sums[low:high] = np.diff(np.append(0.0, np.cumsum(found))[lexed.first])
            rest = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_left)), pa.int32()), pa.array(np.concatenate(left)))
            yield pa.record_batch({"doc_id": batch.column(0), "n_tokens": tokens, "log_prob": sums, "rest": rest})

    return run


def score_documents(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_tokens, log_prob, mean_log_prob."""
    spark = documents.sparkSession
    ship(spark)
    counts = word_counts(documents)
    words, shares, own, totals = common_words(counts)
    weights = train(documents, words, shares)
    told, within, rest = words_within(counts, own, totals)
    model = spark.sparkContext.broadcast((words, weights, told, within))
    scored = documents.select("doc_id", "text").mapInArrow(_scores(model), "doc_id bigint, n_tokens bigint, log_prob double, rest array<bigint>")
    if rest is not None:
        scored = settle(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
        each = scored.select("row", F.explode("rest").alias("word")).join(rest, "word")
        more = each.groupBy("row").agg(F.sum(F.round(F.col("within") * _FIXED).cast("long")).alias("more"))
        scored = scored.drop("rest").join(more, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce(F.col("more") / _FIXED, F.lit(0.0)))
    scored = scored.select("doc_id", "n_tokens", "log_prob")
    return scored.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
