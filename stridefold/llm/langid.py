"""Language identification with bit-sliced Bloom filters.

One table of words holds the Bloom filters of all languages side by side: bit l
of a slot belongs to language l. ANDing the slots of an n-gram's hashes returns
every language that (probably) contains it, in as many look-ups as for a single
filter. A document's per-language popcounts are corrected for the share of
false positives that each filter's fill makes likely; the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridefold.llm.scratch import bounded_batches
from stridefold.llm.textkernel import Block, blocks, mix

#: Expected rows that the filters are filled from: of each language, of all, of each at least, and the most characters of a text.
ROWS_PER_LANGUAGE, TRAIN_ROWS, LEAST_ROWS, TRAIN_CHARS = 1500, 12_000, 20, 20_000
GRAM, HASHES, LEAST_COUNT, SHARE = 4, 3, 3, 0.25
#: A table has 2**SLOT_BITS slots, or as few as keep all tables together under TABLE_BYTES (but 2**LEAST_BITS).
SLOT_BITS, LEAST_BITS, TABLE_BYTES = 20, 12, 1 << 27
_U = np.uint64
_GAP = np.ones(256, bool)
_GAP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Filters:
    languages: list[str]  # by number of training rows, then name
    slots: list[np.ndarray]  # for each 64 languages, a table of 2**bits masks
    false_rate: np.ndarray
    bits: int = SLOT_BITS


def grams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that begin at each byte of each word (cut at its end), and how many each document has."""
    long = block.end - block.start
    begin = np.repeat(block.start - np.cumsum(long) + long, long) + np.arange(int(long.sum()))
    end = np.minimum(begin + GRAM, np.repeat(block.end, long))
    head = np.repeat(block.start, long) == begin
    tail = np.repeat(block.end, long) == end
    value = block.hashes(begin, end) ^ (head * _U(0x632BE59BD9B4E019)) ^ (tail * _U(0x8CB92BA72F3D8DD7))
    total = np.concatenate([[0], np.cumsum(long)])
    return value, np.diff(total[block.first])


def places(value: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The slots of each n-gram, one hash after the other (double hashing)."""
    a, b = mix(value), mix(value ^ _U(0xA0761D6478BD642F)) | _U(1)
    for j in range(HASHES):
        yield ((a + _U(j) * b) >> _U(64 - bits)).astype(np.int64)


def fill(samples: dict[str, pa.Array]) -> Filters:
    """An n-gram enters the filters of the languages in which it is frequent enough."""
    names = sorted(samples, key=lambda k: (-len(samples[k]), k))
    keys, shares, counts = [], [], []
    for name in names:
        found = [grams(b)[0] for b in blocks(samples[name], True, _GAP)]
        found = np.concatenate(found) if found else np.zeros(0, _U)
        key, n = np.unique(found, return_counts=True)
        keys.append(key)
        counts.append(n)
        shares.append(n / max(len(found), 1))
    every = np.unique(np.concatenate(keys)) if keys else np.zeros(0, _U)
    most = np.zeros(len(every))
    for key, share in zip(keys, shares):
        at = np.searchsorted(every, key)
        most[at] = np.maximum(most[at], share)
    tables = -(-len(names) // 64)
    bits = next(b for b in range(SLOT_BITS, LEAST_BITS - 1, -1) if b == LEAST_BITS or tables << b + 3 <= TABLE_BYTES)
    slots = [np.zeros(1 << bits, _U) for _ in range(tables)]
    rate = np.zeros(len(names))
    for i, (key, n, share) in enumerate(zip(keys, counts, shares)):
        chosen = key[(n >= LEAST_COUNT) & (share >= SHARE * most[np.searchsorted(every, key)])]
        bit = _U(1) << _U(i % 64)
        for at in places(chosen, bits):
            slots[i // 64][at] |= bit
        rate[i] = np.count_nonzero(slots[i // 64] & bit) / (1 << bits)
    return Filters(names, slots, rate**HASHES, bits)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Filters:
    """Fill from about ROWS_PER_LANGUAGE rows a language, chosen by a hash of id and text.

    Every language that occurs is learned. Rows of all languages are about
    TRAIN_ROWS at most, or LEAST_ROWS of each where there are many; repeated rows
    count once. Only rows with a language and an id count, and only where crc32
    of the id, as text, is not 2 modulo 4. Of longer texts than TRAIN_CHARS
    characters, so many are read here, from a place that a hash of the id gives;
    prediction reads all.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("lang is not null and id is not null and text is not null").where(F.crc32(F.col("id").cast("string")) % 4 != 2)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    each = max(LEAST_ROWS, min(ROWS_PER_LANGUAGE, TRAIN_ROWS // max(1, sizes.count())))
    start = F.pmod(F.xxhash64("id"), F.greatest(F.length("text") - TRAIN_CHARS, F.lit(0)) + 1).cast("int") + 1
    chosen = (
        rows.join(F.broadcast(sizes), "lang")
        .withColumn("place", F.xxhash64("id", "text"))
        .where(F.pmod("place", F.lit(1 << 30)).cast("double") * F.col("n") < float(each * (1 << 30)))
        .select("lang", "place", F.substring("text", start, F.lit(TRAIN_CHARS)).alias("text"))
        .groupBy("lang", "place")
        .agg(F.min("text").alias("text"))
        .toArrow()
        .sort_by([("lang", "ascending"), ("place", "ascending")])
    )
    langs = np.array(chosen.column("lang").to_pylist(), object)
    texts = chosen.column("text").combine_chunks()
    return fill({str(name): texts.take(pa.array(np.flatnonzero(langs == name))) for name in set(langs.tolist())})


def hits(filters: Filters, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Corrected popcounts (documents by languages) and the number of n-grams."""
    value, n = grams(block)
    at = list(places(value, filters.bits))
    doc = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros((block.docs, len(filters.languages)))
    for k, slots in enumerate(filters.slots):
        mask = slots[at[0]]
        for more in at[1:]:
            mask &= slots[more]
        for i in range(64 * k, min(64 * k + 64, len(filters.languages))):
            bit = (mask >> _U(i % 64)) & _U(1)
            found = np.diff(np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])[doc])
            out[:, i] = (found - n * filters.false_rate[i]) / max(1 - filters.false_rate[i], 1e-9)
    return np.maximum(out, 0.0), n


def identify(docs: DataFrame, filters: Filters, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, lang_pred, score.

    ``und`` (score 0) where the text is null or has no letter, or nothing was
    learned. The score is the best language's share of the corrected counts;
    with no hit it is 0 and the language with most training rows is given, as it
    is in ties. Repeated rows get the same result each; extra columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(filters)  # TABLE_BYTES at most, up to 262,144 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for batch in batches:
            for block in blocks(batch.column(1), True, _GAP):
                plain = np.diff(np.concatenate([[0], np.cumsum((block.data >= 97) & (block.data <= 122))])[block.at]) > 0
                for d in np.flatnonzero(~plain & (block.count > 0)):
                    text = block.raw[block.at[d] : block.at[d + 1]].tobytes().decode("utf-8", "replace")
                    plain[d] = any(c.isalpha() for c in text)
                if learned.languages:
                    count, _ = hits(learned, block)
                    best, total = count.argmax(1), count.sum(1)
                    score = count[np.arange(block.docs), best] / np.where(total > 0, total, 1)
                    name = [learned.languages[b] if ok else "und" for b, ok in zip(best, plain)]
                else:
                    score, name = np.zeros(block.docs), ["und"] * block.docs
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.lo, block.docs), pa.array(name, pa.string()), pa.array(np.where(plain, score, 0.0))],
                    ["doc_id", "lang_pred", "score"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
