"""Masked pseudo-likelihood scores by a bidirectional window network in numpy.

Every word of a text is predicted from the words on both sides of it. The
vocabulary is the words that occur often enough in the whole corpus, so that it
grows with it; all other words fall into hashed buckets, and a word of a bucket
has its share of the bucket's occurrences as a further factor. The network sums
scaled embeddings of the context words, and its output is factored: a symbol is
three digits, each predicted after those before it, so that a window costs about
the cube root of the vocabulary.

Texts are coded as symbols once. For training, they are dealt to shards by a
hash of id and text, and sorted by it, so that a shard's batches depend on the
corpus alone, not on how its files or partitions lie. Each shard takes gradient
steps on all its windows from the same weights; a round's weights are the mean
over shards, weighted by their windows and summed by Spark in whole numbers. A
document's score is the sum of the conditional log-probabilities of all its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridefold.llm.scratch import Scratch, bounded_batches
from stridefold.llm.textkernel import Block, blocks

#: The network has side**3 symbols, BUCKETS of them for the words that are none themselves. Every word of FLOOR occurrences or more
#: is a symbol as far as MOST_SIDE allows (a symbol has two bytes), and of rarer ones the most frequent while there is room.
LEAST_SIDE, MOST_SIDE, BUCKETS, FLOOR = 10, 40, 256, 1000
#: At most so many words, the most frequent, have their counts broadcast (12 bytes each); the counts of the others are joined from the table.
KEEP = 1 << 20
WIDTH, OFFSETS = 24, (-2, -1, 1, 2)
BATCH, RATE, ROUNDS = 4096, 0.05, 1
#: Texts are cut into pieces of so many words, each with its neighbours. A shard has about SHARD words, or more: so many for
#: each weight that it sends back, and so many that there are no more than MOST_SHARDS.
PIECE, SHARD, FOR_EACH_WEIGHT, MOST_SHARDS = 8192, 1 << 20, 32, 1 << 15
#: Sums over rows are of whole numbers, which do not depend on their order: log-probabilities and weights times these.
UNIT, FINE = 1 << 24, 1 << 52
Weights = dict[str, np.ndarray]


def shapes(side: int) -> dict[str, tuple[int, ...]]:
    """Of a network of side**3 symbols."""
    return {
        "embedding": (side**3 + 1, WIDTH),  # the last row stands for what is beyond the text
        "scale": (len(OFFSETS), WIDTH),
        "hidden": (WIDTH,),
        "output": (WIDTH, 3 * side),  # for each digit
        "bias1": (side,),
        "bias2": (side, side),  # by the first digit
        "bias3": (side * side, side),  # by the first two
    }


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([x.ravel() for x in weights.values()]).astype(np.float32)


def shaped(values: np.ndarray, side: int) -> Weights:
    out, at = {}, 0
    for name, shape in shapes(side).items():
        n = int(np.prod(shape))
        out[name] = np.array(values[at : at + n], np.float32).reshape(shape)
        at += n
    return out


def initial(counts: np.ndarray, seed: int = 1) -> Weights:
    """Small random weights; the biases give the corpus's own frequencies."""
    rng, side = np.random.default_rng(seed), round(len(counts) ** (1 / 3))
    out = {k: (0.1 * rng.standard_normal(s)).astype(np.float32) for k, s in shapes(side).items()}
    out["scale"][:] = 1
    out["hidden"][:] = 0
    share = (counts + 1.0).reshape(side, side, side)
    by1, by2 = share.sum((1, 2)), share.sum(2)
    out["bias1"] = np.log(by1 / by1.sum()).astype(np.float32)
    out["bias2"] = np.log(by2 / by1[:, None]).astype(np.float32)
    out["bias3"] = np.log(share / by2[:, :, None]).astype(np.float32).reshape(side * side, side)
    return out


def contexts(symbols: np.ndarray, lo: int, hi: int, beyond: int) -> np.ndarray:
    """The symbols at each offset from each word of lo:hi; ``beyond`` outside the text."""
    reach = max(map(abs, OFFSETS))
    edge = np.full(reach, beyond, symbols.dtype)
    padded = np.concatenate([edge, symbols, edge])
    return np.stack([padded[lo + reach + o : hi + reach + o] for o in OFFSETS], 1)


def forward(w: Weights, context: np.ndarray, target: np.ndarray):
    """Hidden units, the exponentials of all digits' values and their sums, log-probabilities."""
    side = len(w["bias1"])
    h = np.repeat(w["hidden"][None], len(target), 0)
    for j in range(len(OFFSETS)):
        h += w["embedding"][context[:, j]] * w["scale"][j]
    np.tanh(h, out=h)
    two, third = target // side, target % side
    first, second = two // side, two % side
    out = h @ w["output"]
    out[:, :side] += w["bias1"]
    rows = np.arange(len(target))
    picked = out[rows, first] + out[rows, side + second] + out[rows, 2 * side + third] + w["bias2"][first, second] + w["bias3"][two, third]
    np.exp(np.minimum(out, 60, out=out), out=out)
    out[:, side : 2 * side] *= np.exp(w["bias2"])[first]
    out[:, 2 * side :] *= np.exp(w["bias3"])[two]
    one = np.ones(side, np.float32)  # products with ones: far faster than sums over the short axis
    sums = [out[:, d * side : (d + 1) * side] @ one for d in range(3)]
    return h, out, sums, picked - sum(map(np.log, sums))


def log_probs(w: Weights, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Batch by batch of one size (the last is filled up), so that a window's value does not depend on its place."""
    out = np.zeros(len(target))
    for at in range(0, len(target), BATCH):
        some, goal = context[at : at + BATCH], target[at : at + BATCH]
        lack = BATCH - len(goal)
        if lack:
            some, goal = np.concatenate([some, np.zeros((lack, len(OFFSETS)), some.dtype)]), np.concatenate([goal, np.zeros(lack, goal.dtype)])
        out[at : at + BATCH] = forward(w, some, goal)[-1][: BATCH - lack]
    return out


def _starts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def step(w: Weights, squares: Weights, context: np.ndarray, target: np.ndarray) -> None:
    """One Adagrad step on a batch of windows."""
    order = np.argsort(target, kind="stable")
    context, target = context[order], target[order]
    h, out, sums, _ = forward(w, context, target)
    side, rows, share = len(w["bias1"]), np.arange(len(target)), np.float32(1 / len(target))
    two = target // side
    first = two // side
    for d, digit in enumerate((first, two % side, target % side)):
        out[:, d * side : (d + 1) * side] *= (share / sums[d])[:, None]
        out[rows, d * side + digit] -= share
    dh = (out @ w["output"].T) * (1 - h * h)
    one = np.ones(len(target), np.float32)
    # gradients of the embeddings and digits that the batch has
    symbol = context.ravel()
    by = np.argsort(symbol, kind="stable")
    symbol = symbol[by]
    each, some1, some2 = _starts(symbol), _starts(first), _starts(two)
    gradients = {
        "embedding": (symbol[each], np.add.reduceat((dh[:, None, :] * w["scale"]).reshape(-1, WIDTH)[by], each, 0)),
        "scale": (slice(None), np.stack([one @ (dh * w["embedding"][context[:, j]]) for j in range(len(OFFSETS))])),
        "hidden": (slice(None), one @ dh),
        "output": (slice(None), h.T @ out),
        "bias1": (slice(None), one @ out[:, :side]),
        "bias2": (first[some1], np.add.reduceat(out[:, side : 2 * side], some1, 0)),
        "bias3": (two[some2], np.add.reduceat(out[:, 2 * side :], some2, 0)),
    }
    for name, (at, g) in gradients.items():
        sum_of = squares[name][at] + g * g
        squares[name][at] = sum_of
        w[name][at] -= RATE * g / np.sqrt(sum_of + np.float32(1e-8))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(0), True):
            words, n = np.unique(block.words(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])


@dataclass
class Counts:
    words: np.ndarray  # hashes of the words whose counts are held here, most frequent first (ties by hash)
    counts: np.ndarray
    vocabulary: int  # so many of them are symbols
    sizes: np.ndarray  # occurrences of each symbol
    rare: DataFrame | None  # word, n of all others

    @property
    def side(self) -> int:
        return round(len(self.sizes) ** (1 / 3))


def gather(texts: DataFrame, scratch: Scratch) -> Counts:
    """Counts of all words of the whole corpus; those of the most frequent words, KEEP at most, are held."""
    table = scratch.save(texts.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    level = F.floor(16 * F.log2(F.col("n").cast("double")))  # under 1,008 levels, whatever the counts
    levels = table.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("least")).toPandas().sort_values("level", ascending=False)
    held = levels["words"].cumsum() <= KEEP
    least = int(levels["least"][held].min()) if held.any() else 2**62
    top = table.where(F.col("n") >= least).toArrow()
    words, counts = (top.column(k).to_numpy() for k in ("word", "n"))
    order = np.lexsort((words, -counts))
    words, counts = words[order].view(np.uint64), counts[order]
    side = min(MOST_SIDE, max(LEAST_SIDE, math.ceil((int((counts >= FLOOR).sum()) + BUCKETS) ** (1 / 3))))
    start = side**3 - BUCKETS
    known = min(len(words), start)
    sizes = np.zeros(side**3)
    sizes[:known] = counts[:known]
    rest = table.groupBy(F.col("word").bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows at most
    sizes[start + rest["bucket"].to_numpy(np.int64)] += rest["n"].to_numpy(np.float64)
    np.subtract.at(sizes, start + (words[:known] % np.uint64(BUCKETS)).astype(np.int64), counts[:known].astype(np.float64))
    return Counts(words, counts, known, sizes, None if held.all() else table.where(F.col("n") < least))


class Coder:
    """Symbols of words, and what a word of a bucket adds to its bucket's log-probability."""

    def __init__(self, words: np.ndarray, log_counts: np.ndarray, known: int, log_sizes: np.ndarray, side: int):
        self.order = np.argsort(words)
        self.sorted, self.log_counts, self.known, self.log_sizes, self.beyond = words[self.order], log_counts, known, log_sizes, side**3

    def code(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's symbol and added term (without its log count where that is not held), and the places of those not held."""
        rank = np.full(len(hashes), -1)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            met = self.sorted[at] == hashes
            rank[met] = self.order[at[met]]
        term = np.zeros(len(hashes))
        outside = np.flatnonzero((rank < 0) | (rank >= self.known))
        bucket = (hashes[outside] % np.uint64(BUCKETS)).astype(np.int64)
        symbol = rank.copy()
        symbol[outside] = self.beyond - BUCKETS + bucket
        term[outside] -= self.log_sizes[bucket]
        counted = outside[rank[outside] >= 0]
        term[counted] += self.log_counts[rank[counted]]
        return symbol.astype(np.uint16), term, np.flatnonzero(rank < 0)


CODED = "key long, doc_id long, text_hash long, piece long, n long, before long, symbols binary, term long, rare array<long>"


def coded(rows: DataFrame, coder) -> DataFrame:
    """A row for each piece: its n words from place ``before`` on among ``symbols``, which hold its neighbours too."""
    reach = max(map(abs, OFFSETS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Coder(*coder.value)
        for batch in batches:
            for block in blocks(batch.column(3), True):
                hashes = block.words()
                symbols, terms, rare = of.code(hashes)
                pieces = np.maximum(1, -(-block.count // PIECE))
                doc = np.repeat(np.arange(block.docs), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                lo = block.first[doc] + PIECE * piece
                hi = np.minimum(lo + PIECE, block.first[doc + 1])
                left, right = np.maximum(lo - reach, block.first[doc]), np.minimum(hi + reach, block.first[doc + 1])
                sums = np.concatenate([[0], np.cumsum(np.rint(terms * UNIT).astype(np.int64))])
                cut = np.searchsorted(rare, np.append(lo, len(hashes))).astype(np.int32)
                own = pa.array(doc + block.lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).take(own) for i in range(3)),
                        pa.array(piece),
                        pa.array(hi - lo),
                        pa.array(lo - left),
                        pa.array([symbols[a:b].tobytes() for a, b in zip(left, right)], pa.binary()),
                        pa.array(sums[hi] - sums[lo]),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(hashes[rare].view(np.int64))),
                    ],
                    ["key", "doc_id", "text_hash", "piece", "n", "before", "symbols", "term", "rare"],
                )

    return rows.mapInArrow(run, CODED)


def windows_of(batch: pa.RecordBatch, beyond: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and targets of the pieces of a batch, end to end."""
    context, target = [np.zeros((0, len(OFFSETS)), np.uint16)], [np.zeros(0, np.uint16)]
    for raw, lo, n in zip(batch.column("symbols"), batch.column("before").to_pylist(), batch.column("n").to_pylist()):
        if n:
            symbols = np.frombuffer(raw.as_buffer(), np.uint16)
            context.append(contexts(symbols, lo, lo + n, beyond))
            target.append(symbols[lo : lo + n])
    return np.concatenate(context), np.concatenate(target)


def train(pieces: DataFrame, weights: Weights, words: int, rounds: int = ROUNDS) -> Weights:
    """``pieces`` are rows of ``coded``, with ``words`` words in all; the result does not depend on their order or partitions."""
    if not words:
        return weights
    spark, side = pieces.sparkSession, len(weights["bias1"])
    shards = -(-words // max(SHARD, FOR_EACH_WEIGHT * len(flat(weights)), words // MOST_SHARDS))
    place = F.xxhash64("doc_id", "text_hash", "piece")
    dealt = (
        pieces.select("n", "before", "symbols", place.alias("place")).where("n > 0")
        .repartitionById(shards, F.pmod("place", F.lit(shards)).cast("int"))
        .sortWithinPartitions("place", "n", "before", "symbols")
        .select("n", "before", "symbols")
    )
    for _ in range(rounds):
        start = spark.sparkContext.broadcast(flat(weights))  # about WIDTH + 1 floats a symbol, 4.5 MB at most

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            w = shaped(start.value, side)
            squares = {k: np.zeros_like(v) for k, v in w.items()}
            context, target = np.zeros((0, len(OFFSETS)), np.uint16), np.zeros(0, np.uint16)
            windows = 0
            for batch in batches:
                more, goals = windows_of(batch, side**3)
                context, target = np.concatenate([context, more]), np.concatenate([target, goals])
                whole = len(target) - len(target) % BATCH
                for at in range(0, whole, BATCH):
                    step(w, squares, context[at : at + BATCH], target[at : at + BATCH])
                context, target, windows = context[whole:], target[whole:], windows + whole
            if len(target):
                step(w, squares, context, target)
                windows += len(target)
            if windows:
                moved = np.rint((flat(w).astype(np.float64) - start.value) * (windows / words) * FINE).astype(np.int64)
                at = np.flatnonzero(moved)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(moved[at])], ["i", "total"])

        sums = dealt.mapInArrow(run, "i long, total long").groupBy("i").agg(F.sum("total").alias("total")).toPandas()  # a row for each weight at most
        values = flat(weights).astype(np.float64)
        values[sums["i"].to_numpy(np.int64)] += sums["total"].to_numpy(np.int64) / FINE
        weights = shaped(values, side)
        start.unpersist()
    return weights


def pseudo_likelihood(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per row: doc_id, n_words, log_prob (sum), mean_log_prob.

    Null texts and texts without words have 0 words, sum 0 and a null mean.
    Repeated rows score the same each; extra columns are ignored; an empty table
    gives no rows. Words are compared in lower case (A-Z). The scores are those
    of the rows as a whole: their order, files and partitions change nothing.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scratch = Scratch(spark, "lm")
    corpus = gather(rows.select("text"), scratch)
    side = corpus.side
    # one occurrence of each bucket is left to words that the corpus does not have
    coder = spark.sparkContext.broadcast((corpus.words, np.log(corpus.counts).astype(np.float32), corpus.vocabulary, np.log1p(corpus.sizes[-BUCKETS:]), side))
    keyed = rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    pieces = scratch.save(coded(keyed, coder), "pieces")
    weights = train(pieces, initial(corpus.sizes), int(corpus.sizes.sum()), rounds)
    model = spark.sparkContext.broadcast(flat(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shaped(model.value, side)
        for batch in batches:
            context, target = windows_of(batch, side**3)
            each = np.rint(log_probs(w, context, target) * UNIT).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(batch.column("n").to_numpy())])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), batch.column("n"), pa.array(np.diff(sums) + batch.column("term").to_numpy())], ["key", "doc_id", "n", "score"])

    scored = pieces.select("key", "doc_id", "n", "before", "symbols", "term").mapInArrow(run, "key long, doc_id long, n long, score long")
    if corpus.rare is not None:
        terms = pieces.select("key", F.explode("rare").alias("word")).join(corpus.rare, "word")
        terms = terms.groupBy("key").agg(F.sum(F.round(F.log(F.col("n").cast("double")) * UNIT).cast("long")).alias("score"))
        scored = scored.unionByName(terms.select("key", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n"), "score"))
    else:
        scratch.drop("counts")
    whole = scored.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_words"), (F.sum("score") / UNIT).alias("log_prob"))
    return whole.select("doc_id", "n_words", "log_prob", F.try_divide("log_prob", "n_words").alias("mean_log_prob"))
