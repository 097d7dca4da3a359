"""Exact top-k inner products by ball-tree branch and bound, shard by shard.

Vectors are dealt to shards of bounded size, a partition each. A task builds its
shard's ball tree once and streams the queries past it: a node's bound for a
query is ``q . centre + |q| * radius``; each query goes to the child with the
larger bound first; subtrees whose bound is below a query's current kth score are
closed to it. Vectors are never copied; queries are, to every shard, in rounds:
one shard for each query, then some, then the rest. The kth scores of the rounds
so far are where the search of the next one starts.

Where components are too large for exact sums in doubles, the tree is searched
with rounded scores and a bound on their error until no further candidate can be
among the best, and those found are scored in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridefold.llm.scratch import Scratch

#: A shard has about SHARD_ROWS vectors, more where there would be over MANY shards, and at most MOST_ROWS or MOST_BYTES.
SHARD_ROWS, MANY, MOST_ROWS, MOST_BYTES = 8192, 64, 1 << 17, 1 << 26
BLOCK_ROWS, LEAF_ROWS, K = 2048, 128, 10
_LONG = 2**63


class BallTree:
    """``ids`` name the points in results and decide ties; ``place`` (the ids, if not given) tells rows apart."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS, place: np.ndarray | None = None):
        self.nodes: list[tuple[np.ndarray, float, int, int]] = []  # centre, radius, children or -1
        self.rows: dict[int, np.ndarray] = {}
        self.points, self.ids, self.leaf, self.place = points, ids, leaf, ids if place is None else place
        if len(points):
            self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        own = self.points[rows]
        centre = own.mean(0)
        away = np.sqrt(((own - centre) ** 2).sum(1))
        at = len(self.nodes)
        self.nodes.append((centre, float(away.max()), -1, -1))
        if len(rows) > self.leaf and away.max() > 0:
            a = own[away.argmax()]
            b = own[((own - a) ** 2).sum(1).argmax()]
            along = own @ (b - a)
            half = len(rows) // 2
            order = np.argpartition(along, half)
            left, right = self._build(rows[order[:half]]), self._build(rows[order[half:]])
            self.nodes[at] = (centre, float(away.max()), left, right)
        else:
            self.rows[at] = rows
        return at

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Scores and point numbers of the k best of each query, at least ``floor``; -inf where there are fewer.

        ``own`` are the queries' own places, ``slack`` bounds the error of a score
        against the product of the two vectors' lengths.
        """
        score = np.full((len(queries), k), -np.inf)
        found = np.full((len(queries), k), np.iinfo(np.int64).max)
        number = np.full((len(queries), k), -1)
        norm = np.sqrt((queries**2).sum(1))

        def bound(at: int, some: np.ndarray) -> np.ndarray:
            centre, radius, _, _ = self.nodes[at]
            upper = queries[some] @ centre + norm[some] * radius
            return upper + 1e-9 * np.abs(upper) + (1e-9 + slack) * norm[some] * (radius + np.sqrt((centre**2).sum())) + 1e-6

        def visit(at: int, some: np.ndarray, upper: np.ndarray) -> None:
            some = some[upper >= np.maximum(score[some, -1], floor[some])]
            if not len(some):
                return
            _, _, left, right = self.nodes[at]
            if left < 0:
                rows = self.rows[at]
                s = queries[some] @ self.points[rows].T
                s[own[some][:, None] == self.place[rows][None, :]] = -np.inf
                s[s < floor[some][:, None]] = -np.inf
                better = (s > -np.inf) & (s >= score[some, -1][:, None])
                hit = np.flatnonzero(better.any(1))
                if len(hit):
                    q = some[hit]
                    both = np.concatenate([score[q], s[hit]], 1)
                    names = np.concatenate([found[q], np.broadcast_to(self.ids[rows], (len(q), len(rows)))], 1)
                    numbers = np.concatenate([number[q], np.broadcast_to(rows, (len(q), len(rows)))], 1)
                    order = np.lexsort((names, -both), axis=-1)[:, :k]
                    score[q] = np.take_along_axis(both, order, 1)
                    found[q] = np.take_along_axis(names, order, 1)
                    number[q] = np.take_along_axis(numbers, order, 1)
                return
            l, r = bound(left, some), bound(right, some)
            first = l >= r
            if len(some) < 16:  # too few to part: the majority leads
                first[:] = 2 * np.count_nonzero(first) >= len(some)
            visit(left, some[first], l[first])
            visit(right, some, r)
            visit(left, some[~first], l[~first])

        if self.nodes and len(queries):
            every = np.arange(len(queries))
            visit(0, every, bound(0, every))
        return score, number


def exact_scores(queries: np.ndarray, points: np.ndarray) -> bool:
    """Whether inner products are exact in doubles."""
    most = lambda x: float(np.abs(x).max(initial=0.0))
    return most(queries) * most(points) * max(points.shape[1], 1) < 2**53


def _scaled(x: np.ndarray) -> np.ndarray:
    """Divided by a power of two, so that no product overflows."""
    most = float(np.abs(x).max(initial=0.0))
    return np.ldexp(x, -int(np.frexp(most)[1])) if most else x


def large_top(points: np.ndarray, ids: np.ndarray, place: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, id, score) of the k best, for components of any size; scores are cut to 64 bits.

    A rounded score is within ``error`` of the exact one, so a point can be among
    the k best only if its rounded score is not over twice that below the kth.
    """
    if not len(points):
        return
    near, ask = _scaled(points), _scaled(queries)
    tree = BallTree(near, ids, place=place)
    slack = 4 * (points.shape[1] + 2) * 2.0**-53
    error = slack * np.sqrt((ask**2).sum(1)) * np.sqrt((near**2).sum(1).max()) + 1e-300
    left, more = np.arange(len(ask)), 2 * k
    while len(left):
        score, number = tree.search(ask[left], own[left], min(more, len(points)), np.full(len(left), -np.inf), slack)
        kth = score[:, min(k, score.shape[1]) - 1]
        done = (more >= len(points)) | (score[:, -1] < kth - 2 * error[left])
        for i in np.flatnonzero(done):
            q = [int(x) for x in queries[left[i]]]
            exact = sorted((-sum(a * int(b) for a, b in zip(q, points[p])), int(ids[p])) for p in number[i][score[i] > -np.inf])
            yield from ((int(left[i]), v, min(max(-s, -_LONG), _LONG - 1)) for s, v in exact[:k])
        left, more = left[~done], 4 * more


FOUND = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _matrix(rows: pa.Table) -> np.ndarray:
    raw = rows.column("vec").to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if raw and raw[0] else np.zeros((len(raw), 0))


def _by_width(rows: pa.Table) -> dict[int, pa.Table]:
    width = np.array([len(x) for x in rows.column("vec").to_pylist()], np.int64)
    return {int(w): rows.take(pa.array(np.flatnonzero(width == w))) for w in np.unique(width)}


def _search(k: int):
    """Over one shard: its points come first, then the queries, in blocks."""

    def answers(shard: dict, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for width, asked in _by_width(rows).items():
            if width not in shard:
                continue
            points, ids, place, tree = shard[width]
            queries, own, names = _matrix(asked), asked.column("row").to_numpy(), asked.column("vec_id").to_numpy()
            if exact_scores(queries, points):
                if tree is None:
                    tree = shard[width][3] = BallTree(points, ids, place=place)
                score, number = tree.search(queries, own, k, asked.column("floor").to_numpy())
                i, j = np.nonzero(score > -np.inf)
                found, scores = ids[number[i, j]], score[i, j].astype(np.int64)
            else:
                hits = list(large_top(points, ids, place, queries, own, k))
                i, found, scores = (np.array([h[c] for h in hits], np.int64) for c in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own[i], names[i], found, scores)], schema=FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points: list[pa.RecordBatch] = []
        shard: dict[int, list] | None = None
        for batch in batches:
            asking = batch.column("asks").to_numpy(zero_copy_only=False)
            points.append(batch.filter(pa.array(~asking)))
            asked = batch.filter(pa.array(asking))
            if not asked.num_rows:
                continue
            if shard is None:
                shard = {w: [_matrix(p), p.column("vec_id").to_numpy(), p.column("row").to_numpy(), None] for w, p in _by_width(pa.Table.from_batches(points)).items()}
                points = []
            for at in range(0, asked.num_rows, BLOCK_ROWS):
                yield from answers(shard, pa.Table.from_batches([asked.slice(at, BLOCK_ROWS)]))

    return run


def _whole_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(1024 x) of every component, as packed doubles; rows that cannot take part go."""
    for batch in batches:
        ids, vectors = [], []
        for key, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
            if key is None or not vector.is_valid or vector.values.null_count:
                continue
            x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all():
                ids.append(key)
                vectors.append(np.floor(1024 * x).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], ["vec_id", "vec"])


def top_k(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_modulus: int = 100,
    k: int = K,
    shard_rows: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score, query_row) of the k best candidates of every query row.

    Queries are the rows whose id is divisible by ``query_modulus``; candidates
    are all rows of the same dimension but the query's own. Rows without an id,
    and vectors that are null or hold a null or non-finite component, take no
    part. Ties go to the smaller id. Repeated rows count as often as they occur:
    where several rows have a query's id, each is a query of its own, told apart
    by ``query_row`` (a number without meaning), and a candidate of the others.
    Extra columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    packed = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(_whole_numbers, "vec_id long, vec binary")
    rows = scratch.save(packed.withColumn("row", F.monotonically_increasing_id()), "rows")
    many, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("vec")), F.lit(0))).first()
    target = shard_rows or min(MOST_ROWS, max(SHARD_ROWS, many // MANY))
    shards = max(1, -(-many // target), -(-size // MOST_BYTES))
    points = rows.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "row", "vec_id", "vec", F.lit(0.0).alias("floor"))
    asks = scratch.save(rows.where(F.col("vec_id") % query_modulus == 0).withColumn("home", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards)).cast("int")), "asks")

    def searched(asks: DataFrame, name: str) -> DataFrame:
        """Of (shard, row, vec_id, vec, floor), the answers; only shards that are asked are dealt out."""
        both = points.unionByName(asks.select("shard", F.lit(True).alias("asks"), "row", "vec_id", "vec", "floor"))
        dealt = both.repartitionById(shards, "shard").sortWithinPartitions("asks", "row").drop("shard")
        return scratch.save(dealt.mapInArrow(_search(k), "row long, query_id long, vec_id long, score long"), name)

    # the shards of a round, counted from the query's own: 1, then about the square root of them, then the rest
    ends = sorted({1, min(shards, 1 + round(shards**0.5)) if shards > 16 else 1, shards})
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    best, begin = None, 0
    for turn, end in enumerate(ends):
        now = asks
        if best is None:
            now = now.withColumn("floor", F.lit(float("-inf")))
        else:
            floors = best.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
            now = now.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        now = now.withColumn("shard", F.explode(F.sequence(F.lit(begin), F.lit(end - 1)))).withColumn("shard", ((F.col("home") + F.col("shard")) % shards).cast("int"))
        found = searched(now, f"found-{turn}")
        best = found if best is None else best.unionByName(found)
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if end < shards:
            best = scratch.save(best.drop("rank"), f"best-{turn}")
        begin = end
    return best.select("query_id", "rank", "vec_id", "score", F.col("row").alias("query_row"))
