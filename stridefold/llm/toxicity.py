"""Toxicity by multiple-instance learning.

Only documents are labelled; sentences are the instances. A sentence's score is
a logistic of summed weights of hashed word features (the word and its first
bytes), a document's is the noisy-or of its sentences' scores. Training takes
the gradient through the noisy-or, so the blame settles on the sentences that
explain the label, and those are then located.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridefold.llm.scratch import bounded_batches
from stridefold.llm.textkernel import Block, blocks, give_back, mix

#: Bounds of the labelled rows that the model is fitted on, and of the characters of all their texts together.
TOXIC_ROWS, CLEAN_ROWS, TRAIN_CHARS = 2000, 5000, 32_000_000
BITS, PREFIXES, LEAST_DOCS, LEAST_WORDS = 18, (3, 4, 5, 6), 4, 3
#: Features whose documents are toxic about as often as others (chi-square below this) have no weight: else rare ones learn each label's noise.
CHI_SQUARE = 7.0
EPOCHS, BATCH, RATE, DECAY, BIAS = 20, 256, 1.0, 1e-5, -8.0

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 39]] = False
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def features(block: Block) -> np.ndarray:
    """Hashed features of every word, a row each: the word, then its prefixes (0 where it is no longer)."""
    long = block.end - block.start
    out = np.zeros((len(long), 1 + len(PREFIXES)), np.int64)
    shift = np.uint64(64 - BITS)
    out[:, 0] = block.words() >> shift
    for j, n in enumerate(PREFIXES, 1):
        some = np.flatnonzero(long > n)
        out[some, j] = (block.hashes(block.start[some], block.start[some] + n) ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xC2B2AE3D27D4EB4F) >> shift
    return out


def distinct(block: Block, sent: np.ndarray) -> np.ndarray:
    """One position of each word of each sentence: repetition adds nothing to a score."""
    key = block.words() ^ mix(sent.astype(np.uint64))
    return np.sort(np.unique(key, return_index=True)[1])


def sentences(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Sentence number of every word (without gaps), and the document of every sentence.

    A run of fewer than LEAST_WORDS words goes on into the next one.
    """
    stops = np.concatenate([[0], np.cumsum(_STOP[block.data])])[block.start] if len(block.data) else np.zeros(0, np.int64)
    doc = block.doc_of_word()
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    short = np.diff(start) < LEAST_WORDS
    joined = start[1:][short & (doc[start[1:]] == doc[start[:-1]])]
    new[joined] = False
    return np.cumsum(new) - 1, doc[new]


def fit(texts: pa.Array, toxic: np.ndarray, seed: int = 0) -> Model:
    """Adagrad through the noisy-or; features in fewer than LEAST_DOCS documents, or that tell nothing of the labels, stay at 0.

    It runs on the driver, so a block's features are made twice rather than all
    held at once: first to count them, then for the words that have a used one.
    """
    model = Model(np.zeros(1 << BITS, np.float32), BIAS)
    seen, seen_toxic = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    bags, docs = [], 0
    for block in blocks(texts, True, _GAP):
        s, d = sentences(block)
        once = distinct(block, s)
        words, doc = features(block)[once], d[s[once]]
        for j in range(words.shape[1]):
            pairs = np.unique(doc << BITS | words[:, j])
            for counts, some in ((seen, pairs), (seen_toxic, pairs[toxic[docs + (pairs >> BITS)] == 1])):
                counts += np.bincount(some & ((1 << BITS) - 1), minlength=1 << BITS)
        bags.append((d + docs).astype(np.int32))
        docs += block.docs
    if not docs or not any(map(len, bags)) or not toxic.any():
        return model
    expected = np.maximum(seen, 1) * toxic.mean()
    told = (seen_toxic - expected) ** 2 >= CHI_SQUARE * expected * (1 - toxic.mean())
    used = (seen >= LEAST_DOCS) & told
    used[0] = False
    index = np.where(used, np.cumsum(used), 0).astype(np.int32)  # 0: unused
    compact, sent, base = [], [], 0
    for block, bag in zip(blocks(texts, True, _GAP), bags):
        s, _ = sentences(block)
        once = distinct(block, s)
        own = index[features(block)[once]]
        some = own.any(1)
        compact.append(own[some])
        sent.append((s[once][some] + base).astype(np.int32))
        base += len(bag)
    compact, sent, bags = np.concatenate(compact), np.concatenate(sent), np.concatenate(bags)
    first_sentence = np.searchsorted(bags, np.arange(docs + 1))
    first_word = np.searchsorted(sent, first_sentence)
    w, b = np.zeros(int(used.sum()) + 1), BIAS
    gw, gb = np.full(len(w), 1e-2), 1e-2
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(docs)
        for at in range(0, docs, BATCH):
            some = np.sort(order[at : at + BATCH])
            s, pick = (np.concatenate([np.arange(first[d], first[d + 1]) for d in some]) for first in (first_sentence, first_word))
            if not len(s):
                continue
            f = compact[pick]
            inverse = np.searchsorted(s, sent[pick])
            bag = np.searchsorted(some, bags[s])
            z = b + np.bincount(inverse, w[f].sum(1), len(s))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            clean = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-12)), len(some))
            whole = -np.expm1(clean)
            y = toxic[some]
            dz = np.where(y[bag] == 1, -(1 - whole[bag]) / np.maximum(whole[bag], 1e-9), 1.0) * p / len(some)
            g = np.bincount(f.ravel(), np.repeat(dz[inverse], f.shape[1]), len(w)) + DECAY * w
            g[0] = 0
            gw += g * g
            w -= RATE * g / np.sqrt(gw)
            db = dz.sum()
            gb += db * db
            b -= 0.05 * db / np.sqrt(gb)
    model.weights[used] = w[1:]
    model.bias = float(b)
    return model


def score_block(model: Model, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's score, each sentence's, and the sentence of every word."""
    sent, bag = sentences(block)
    once = distinct(block, sent)
    z = model.bias + np.bincount(sent[once], model.weights[features(block)[once]].sum(1), len(bag))
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return -np.expm1(np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-12)), block.docs)), p, sent


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most TOXIC_ROWS + CLEAN_ROWS labelled documents, the first by a hash of their id.

    Labels are used only where crc32 of the id, as text, is not 0 modulo 5; an id
    that is labelled both ways counts as toxic. Texts count whole, however long:
    of the chosen documents, toxic ones first, each is taken that still fits into
    TRAIN_CHARS characters. Where rows share an id, one text of them counts.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where("id is not null and toxic in (0, 1)")
        .where(F.crc32(F.col("id").cast("string")) % 5 != 0)
    )
    chosen = [known.where(F.col("toxic") == y).groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    chosen = F.broadcast(chosen[0].union(chosen[1]).groupBy("id").agg(F.max("toxic").alias("toxic")))  # 7,000 rows at most
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(chosen, "id")
    sizes = rows.select("id", "toxic", F.struct(F.xxhash64("text").alias("hash"), F.length("text").alias("n")).alias("x")).groupBy("id", "toxic").agg(F.min("x").alias("x"))
    sizes = sizes.select("id", "toxic", "x.*").toArrow().sort_by([("toxic", "descending"), ("hash", "ascending"), ("id", "ascending")])  # 7,000 rows at most
    room, fits = TRAIN_CHARS, []
    for n in sizes.column("n").to_pylist():
        fits.append(n <= room)
        room -= n * fits[-1]
    kept = sizes.filter(pa.array(fits, pa.bool_()))
    if not kept.num_rows:
        return fit(pa.array([], pa.string()), np.zeros(0, np.int64))
    wanted = F.broadcast(docs.sparkSession.createDataFrame(kept.select(["id", "hash"])))
    texts = rows.withColumn("hash", F.xxhash64("text")).join(wanted, ["id", "hash"]).groupBy("id").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).toArrow().sort_by("id")
    model = fit(texts.column("text").combine_chunks(), texts.column("toxic").to_numpy())
    del texts
    pa.default_memory_pool().release_unused()
    give_back()
    return model


def toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, score, offending (array of start, end and score).

    Starts and ends are byte offsets of sentences that score 0.5 or more. Null
    texts and texts without words score 0. Repeated rows get the same score
    each; extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2**BITS floats, whatever the input
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), True, _GAP):
                scores, p, sent = score_block(shared.value, block)
                found: list[list[dict]] = [[] for _ in range(block.docs)]
                for s in np.flatnonzero(p >= 0.5):
                    a, b = np.searchsorted(sent, s), np.searchsorted(sent, s, "right") - 1
                    d = int(np.searchsorted(block.first, a, "right")) - 1
                    found[d].append({"start": int(block.start[a] - block.at[d]), "end": int(block.end[b] - block.at[d]), "score": float(p[s])})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.lo, block.docs), pa.array(np.clip(scores, 0.0, 1.0)), pa.array(found, kind)],
                    ["doc_id", "score", "offending"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, offending array<struct<start: long, end: long, score: double>>")


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score below the threshold; nothing is joined or shuffled.

    Null texts and texts without words score 0 and stay; repeated rows fare alike;
    columns keep their names, whatever they are; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            scores = [score_block(shared.value, block)[0] for block in blocks(texts, True, _GAP)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < threshold))

    return docs.mapInArrow(run, docs.schema)
