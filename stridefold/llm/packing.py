"""Cost-balanced packing of documents into sequences of a fixed capacity.

A document of n tokens costs ``LINEAR * n + QUADRATIC * n * n`` (attention within
the document). Each task packs its own stream in chunks of bounded tokens, so
nothing is shuffled and memory does not grow with the input. In a chunk, full
sequences are cut off long documents first; the remainders, by descending cost,
go to the lowest-cost sequence that has room for the whole of one. Where none
has, the piece is cut over the lowest-cost sequences that have any room. A chunk
of T tokens uses ceil(T / capacity) sequences, so its padding stays below one
sequence; a partition pads less than one sequence for each CHUNK_TOKENS tokens
and one for what is left, so partitions of far fewer tokens than that are better
coalesced first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridefold.llm.scratch import bounded_batches
from stridefold.llm.textkernel import buffers, cuts, give_back
from stridefold.llm.wordbpe import word_encoder

CAPACITY = 2048
CHUNK_TOKENS = 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def balance(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) and the number of sequences."""
    pieces: list[tuple[int, int, int, int, int]] = []
    whole = lengths // capacity
    used = 0
    for d in np.flatnonzero(whole):
        for k in range(int(whole[d])):
            pieces.append((int(d), k * capacity, capacity, used, 0))
            used += 1
    rest = lengths - whole * capacity
    order = np.argsort(-rest, kind="stable")
    order = order[: int(np.count_nonzero(rest))]
    count = -(-int(rest.sum()) // capacity)
    room, cost = np.full(count, capacity, np.int64), np.zeros(count)
    for d in order:
        start, left = int(whole[d]) * capacity, int(rest[d])
        while left:
            fits = np.where(room >= left, cost, np.inf)
            s = int(fits.argmin())
            if fits[s] == np.inf:
                s = int(np.where(room > 0, cost, np.inf).argmin())
            n = min(left, int(room[s]))
            pieces.append((int(d), start, n, used + s, capacity - int(room[s])))
            room[s] -= n
            cost[s] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return pieces, used + count


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    capacity: int = CAPACITY,
    chunk_tokens: int = CHUNK_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit integers. A null or empty text is
    its end id alone; repeated rows are packed once each; extra columns are
    ignored; an empty table gives no rows. Equal costs go to the earlier row and
    the earlier sequence. Sequence ids are the task's partition number times
    2**40 plus a running number: unique, with gaps between partitions.
    """
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        base = TaskContext.get().partitionId() << 40
        keys: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, held
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            pieces, count = balance(lengths, capacity)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[p[0]] for p in pieces], pa.int64()),
                    pa.array([p[1] for p in pieces], pa.int64()),
                    pa.array([p[2] for p in pieces], pa.int64()),
                    pa.array([ids[p[0]][4 * p[1] : 4 * (p[1] + p[2])] for p in pieces], pa.binary()),
                    pa.array(lengths[[p[0] for p in pieces]], pa.int64()),
                    pa.array([base + p[3] for p in pieces], pa.int64()),
                    pa.array([p[4] for p in pieces], pa.int64()),
                ],
                names,
            )
            base += count
            held = 0
            keys.clear()
            ids.clear()
            give_back()
            return out

        for batch in batches:
            data, at = buffers(batch.column(1))
            own = batch.column(0).to_pylist()
            for lo, hi in cuts(at):
                encoded = encoder.encode([data[at[i] : at[i + 1]].tobytes() for i in range(lo, hi)])
                for key, x in zip(own[lo:hi], encoded):
                    keys.append(key)
                    ids.append(x + end)
                    held += len(x) // 4 + 1
                    if held >= chunk_tokens:
                        yield flush()
        if ids:
            yield flush()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
