"""Byte-level BPE by replaying merges over a block of the corpus at once.

Each task gathers the distinct pieces of a block of texts that it has not met
before and replays the merges over all of them together: an inverted index
leads from a token pair's rank to the positions where the pair stands, ranks
are taken in order from a heap, and a merge touches only its two neighbours.
The ids equal those of merging each piece alone, lowest rank first, leftmost
among equals; a piece that is itself a token is that token.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridefold.llm.scratch import bounded_batches
from stridefold.llm.textkernel import buffers, cuts

KEEP = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.token = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        self.follow: list[dict[int, int]] = [{} for _ in range(max(ranks.values()) + 1)]  # of a token and the next, the rank
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.follow[a][b] = rank
        self.of_bytes = np.full((256, 256), -1)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.of_bytes[token[0], token[1]] = rank
        self.known: dict[str, bytes] = {}

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """The token ids of each piece, as little-endian unsigned 32-bit integers."""
        if not pieces:
            return []
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(piece) for piece in pieces])
        at = np.arange(len(raw))
        after = at + 1
        after[ends[ends > 0] - 1] = -1
        before = np.full(len(raw), -1)
        before[after[after >= 0]] = at[after >= 0]
        token, left, right = self.single[raw].tolist(), before.tolist(), after.tolist()
        # the index at first: positions of every pair of bytes, grouped by rank
        place = np.flatnonzero(after >= 0)
        rank = self.of_bytes[raw[place], raw[place + 1]]
        place, rank = place[rank >= 0], rank[rank >= 0]
        pair = np.full(len(raw), -1)
        pair[place] = rank
        standing = pair.tolist()  # rank of the pair that stands at a position now
        order = np.argsort(rank, kind="stable")
        place, rank = place[order].tolist(), rank[order]
        starts = np.flatnonzero(np.diff(rank, prepend=-1)) if len(rank) else np.zeros(0, np.int64)
        index = {r: place[i:j] for r, i, j in zip(rank[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(rank)])}
        heap = list(index)
        heapify(heap)
        follow = self.follow
        while heap:
            rank = heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            onward, rest = follow[rank], iter(places)
            for p in rest:
                if standing[p] != rank:
                    continue
                q = right[p]
                token[p] = rank
                token[q] = standing[q] = -1
                right[p] = after = right[q]
                new = -1
                if after >= 0:
                    left[after] = p
                    new = onward.get(token[after], -1)
                    if new >= 0:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heappush(heap, new)
                standing[p] = new
                before = left[p]
                older = -1
                if before >= 0:
                    older = standing[before] = follow[token[before]].get(rank, -1)
                    if older >= 0:
                        if older in index:
                            index[older].append(before)
                        else:
                            index[older] = [before]
                            heappush(heap, older)
                if 0 <= new < rank or 0 <= older < rank:  # a lower rank came up: it goes first
                    index.setdefault(rank, []).extend(rest)
                    heappush(heap, rank)
        tokens = np.array(token, np.int64)
        alive = tokens >= 0
        stops = (4 * np.concatenate([[0], np.cumsum(alive)])[ends]).tolist()
        out = tokens[alive].astype("<u4").tobytes()
        return [out[i:j] for i, j in zip([0, *stops], stops)]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.find(t) for t in texts]
        fresh = list(set().union(*split).difference(self.known)) if split else []
        if len(self.known) + len(fresh) > KEEP:
            self.known = {}
            fresh = list(set().union(*split))
        todo: list[tuple[str, bytes]] = []
        for piece in fresh:
            raw = piece.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is None:
                todo.append((piece, raw))
            else:
                self.known[piece] = rank.to_bytes(4, "little")
        self.known.update(zip((piece for piece, _ in todo), self.replay([raw for _, raw in todo])))
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def merge_replay(path: str, pattern: str) -> MergeReplay:
    """One per worker process and vocabulary."""
    return MergeReplay(read_ranks(path), pattern)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, ids (little-endian unsigned 32-bit), decoded (bytes).

    A null text counts as empty and has no ids. Repeated rows come back once
    each; extra columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = merge_replay(ranks_path, pattern)
        for batch in batches:
            data, at = buffers(batch.column(1))
            for lo, hi in cuts(at):
                ids = bpe.encode([data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace") for i in range(lo, hi)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())],
                    ["doc_id", "ids", "decoded"],
                )

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded binary")
