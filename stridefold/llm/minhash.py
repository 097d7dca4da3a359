"""Near-duplicate documents by one-permutation MinHash.

One hash of each shingle picks its bin and its value; empty bins are filled by
optimal densification (each tries a pseudo-random sequence of bins until it
meets one that was filled at first). Bands of consecutive bins give bucket
keys. Inside a bucket each document is a candidate only of the bucket's
smallest id (a star), so pairs stay below the number of band rows. Candidates
pass a lossless filter (the bits in which two odd sketches differ never exceed
the size of the symmetric difference) and are confirmed on the full sets.

A star can miss a link between two of its points, so after the stars are linked
up, buckets that still hold several components are searched across components
only, behind the same lossless filter; what passes is confirmed too. A bucket of
at most DIRECT rows is joined with itself, which bounds the pairs by DIRECT a
row. The documents of larger ones (say, all that share a long passage) meet by
their rarest shingles instead: two sets as similar as the threshold share one of
the first n - ceil(threshold * n) + 1 elements in any common order, and the order
is by frequency, rarest first, so what all of them share brings none together.
Documents with equal sets form a class first, and only a class's smallest id
takes part, so large groups of copies cost one row.
"""

from __future__ import annotations

import hashlib
import math
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridefold.llm.graph import components
from stridefold.llm.scratch import Scratch, bounded_batches
from stridefold.llm.textkernel import blocks, mix, shingle_sets

ROWS = 5
MISS = 1e-5
SKETCH_LONGS = 16
#: A list of ids (and roots) is broadcast up to so many rows (8 bytes a column); it is counted first.
BROADCAST_IDS = 500_000
#: Mixed buckets of up to so many rows are joined with themselves.
DIRECT = 64
#: Frequencies of shingles are kept in so many counters (a shared counter only makes the order coarser).
COUNTERS = 1 << 18
_U = np.uint64


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Fewest bands that lose a pair at the threshold with at most this probability."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def one_permutation(sets: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """Bin minima of each non-empty sorted set, densified; rows of empty sets stay 0."""
    docs = len(bounds) - 1
    value = np.zeros((docs, bins), _U)
    filled = np.zeros((docs, bins), bool)
    if not len(sets):
        return value
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    at = ((sets >> _U(32)) * _U(bins) >> _U(32)).astype(np.int64)
    lead = np.ones(len(sets), bool)
    lead[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    value[doc[lead], at[lead]] = sets[lead]
    filled[doc[lead], at[lead]] = True
    row, col = np.nonzero(~filled)
    some = np.diff(bounds)[row] > 0
    row, col = row[some], col[some]
    attempt = 0
    while len(row):
        donor = (mix(col.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(attempt)) >> _U(32)) * _U(bins) >> _U(32)
        donor = donor.astype(np.int64)
        met = filled[row, donor]
        value[row[met], col[met]] = value[row[met], donor[met]]
        row, col = row[~met], col[~met]
        attempt += 1
    return value


def band_keys(value: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.repeat(np.arange(1, bands + 1, dtype=_U)[None, :], len(value), 0)
    for r in range(rows):
        keys = mix(keys * _U(0xC2B2AE3D27D4EB4F) + value[:, r::rows])
    return keys


def odd_sketches(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parity of the elements that fall on each bit."""
    docs, bits = len(bounds) - 1, SKETCH_LONGS * 64
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    bit = (mix(sets ^ _U(0x5851F42D4C957F2D)) % _U(bits)).astype(np.int64)
    odd = (np.bincount(doc * bits + bit, minlength=docs * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(docs, bits), axis=1).view(np.int64)


def _lists(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1).view(np.int64)))


def _signatures(shingle: int, bands: int, rows: int, lower: bool, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), lower, seed=seed):
                sets, bounds = shingle_sets(block, shingle)
                digests = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:])]
                keys = band_keys(one_permutation(sets, bounds, bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.lo, block.docs),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array(digests, pa.binary()),
                        _lists(keys),
                        _lists(odd_sketches(sets, bounds)),
                    ],
                    ["id", "n", "digest", "keys", "sketch"],
                )

    return run


def _set_rows(shingle: int, lower: bool, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), lower, seed=seed):
                sets, bounds = shingle_sets(block, shingle)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.lo, block.docs), pa.array([sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
                    ["id", "members"],
                )

    return run


def _frequencies(shingle: int, lower: bool, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for block in blocks(batch.column(1), lower, seed=seed):
                sets, _ = shingle_sets(block, shingle)
                total += np.bincount((sets & _U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    return run


def _rarest(shingle: int, lower: bool, seed: int, percent: int, frequency):
    """The elements of each set of which two similar sets share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), lower, seed=seed):
                sets, bounds = shingle_sets(block, shingle)
                size = np.diff(bounds)
                doc = np.repeat(np.arange(block.docs), size)
                order = np.lexsort((sets, frequency.value[(sets & _U(COUNTERS - 1)).astype(np.int64)], doc))
                lead = size - (percent * size + 99) // 100 + 1
                own = order[np.arange(len(order)) - bounds[doc] < lead[doc]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[own] + block.lo)), pa.array(sets[own].view(np.int64))], ["id", "element"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = batch.column(0), batch.column(1)
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3))):
                a, b = (np.frombuffer(x.as_buffer(), _U) for x in (a, b))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(a) + len(b) - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([u.filter(mask), v.filter(mask)], ["u", "v"])

    return run


def _possible(a: str, b: str, percent: int):
    """False only where the similarity is surely below the threshold."""
    differ = sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH_LONGS)), F.lit(0))
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * differ <= (100 - percent) * (na + nb))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    lower: bool = True,
    rows: int = ROWS,
    bands: int | None = None,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_id, component_id, kept.

    Null or wordless texts have no shingles and stay alone. Rows without an id
    cannot be named in a link: they stay alone, kept, with a null component.
    Rows that share an id count as one document (linked if any of them is).
    Extra columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    bands = bands or bands_for(percent, rows)
    seed = secrets.randbits(64)  # of the shingles' hashes: no text can be made to collide
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.save(
        texts.mapInArrow(_signatures(shingle, bands, rows, lower, seed), "id long, n long, digest binary, keys array<long>, sketch array<long>"), "signed"
    )
    alive = (F.col("n") > 0) & F.col("id").isNotNull()
    classes = scratch.save(signed.where(alive).groupBy("digest").agg(F.min("id").alias("class_id")), "classes")
    reps = (
        signed.where(alive).join(classes, "digest").where(F.col("id") == F.col("class_id")).select("id", "n", "keys", "sketch")
    )
    reps = scratch.save(reps, "reps")
    sketches = reps.select("id", "n", "sketch")

    banded = reps.select("id", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
    shared = scratch.save(banded.join(shared, "key"), "shared")

    def chosen(ids: DataFrame) -> DataFrame:
        """The texts of these ids in few parts of like size: they may be few, or lie together, in many files."""
        return texts.join(ids, "id", "left_semi").hint("rebalance")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs that are links, by their full sets."""
        ids = scratch.save(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), f"{name}-ids")
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        sets = scratch.save(chosen(ids).mapInArrow(_set_rows(shingle, lower, seed), "id long, members binary"), f"{name}-sets")
        both = (
            pairs.join(sets.select(F.col("id").alias("u"), F.col("members").alias("a")), "u")
            .join(sets.select(F.col("id").alias("v"), F.col("members").alias("b")), "v")
            .select("u", "v", "a", "b")
        )
        links = scratch.save(both.mapInArrow(_confirm(percent), "u long, v long").distinct(), f"{name}-links")
        scratch.drop(f"{name}-sets", f"{name}-ids")
        return links

    stars = (
        shared.where("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct()
        .join(sketches.withColumnRenamed("id", "u").alias("a"), "u")
        .join(sketches.withColumnRenamed("id", "v").alias("b"), "v")
        .where(_possible("a", "b", percent))
        .select("u", "v")
    )
    stars = scratch.save(stars, "stars")
    links = confirmed(stars, "first")
    labels = components(links, scratch, "first-labels")

    labelled = shared.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    mixed = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), (F.count("*") <= DIRECT).alias("direct")).where("lo < hi").select("key", "direct")
    step = F.floor(F.ln(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    rest = scratch.save(labelled.join(mixed, "key"), "rest")

    def met(rows: DataFrame) -> DataFrame:
        """Pairs of rows of one key and of different components; the sizes of a link differ by less than one step."""
        rows = rows.join(sketches, "id").withColumn("step", step)
        near = rows.withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
        a, b = rows.alias("a"), near.alias("b")
        apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.step") == F.col("b.step")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.root") != F.col("b.root"))
        return a.join(b, apart & _possible("a", "b", percent)).select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))

    across = met(rest.where("direct").select("key", "id", "root"))
    large = scratch.save(rest.where("not direct").select("id", "root").distinct(), "large")
    many = large.count()
    if many:
        ids = F.broadcast(large.select("id")) if many <= BROADCAST_IDS else large.select("id")
        own = scratch.save(chosen(ids), "large-texts")
        counts = own.mapInArrow(_frequencies(shingle, lower, seed), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # COUNTERS rows at most
        frequency = np.zeros(COUNTERS, np.int64)
        frequency[counts["at"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
        leads = own.mapInArrow(_rarest(shingle, lower, seed, percent, spark.sparkContext.broadcast(frequency)), "id long, element long")
        leads = scratch.save(leads.distinct(), "leads")
        rooted = leads.join(F.broadcast(large) if many <= BROADCAST_IDS else large, "id").select(F.col("element").alias("key"), "id", "root")
        crossing = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")  # near copies that are linked already do not meet again
        rare = rooted.join(crossing, "key")
        across = across.union(met(scratch.save(rare, "rare")))
    across = across.distinct().join(stars, ["u", "v"], "left_anti")
    across = scratch.save(across, "across")
    more = confirmed(across, "second")
    if not more.isEmpty():
        labels = components(links.union(more), scratch, "second-labels")
    scratch.drop("reps", "shared", "rest", "large", "large-texts", "leads", "rare", "stars", "across")
    return (
        signed.select("id", "n", "digest")
        .join(classes, "digest", "left")
        .join(labels.withColumnRenamed("id", "class_id"), "class_id", "left")
        .select(
            F.col("id").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
            F.when(F.col("n") > 0, F.coalesce("root", "class_id")).otherwise(F.col("id")).alias("component_id"),
        )
        .withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows, with all their columns, but one row of each group of near duplicates in place of all.

    Rows count, not ids: of repeated rows, and of copies without an id, one stays;
    rows that share an id but not their text are told apart. The row that stays
    has the group's smallest id (null last), the first as written of those. Null
    texts and texts without words are in no group and stay; extra columns are
    kept, whatever their names; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "dropped")
    row = next(n for n in ("row", *(f"row{i}" for i in range(len(docs.columns)))) if n.lower() not in map(str.lower, docs.columns))
    rows = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows, id_col=row, text_col=text_col, **how).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    found = scratch.save(found, "found")
    several = scratch.save(found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component"), "several")  # written, so that a large group can be split in the join
    owned = found.join(several, "component").join(rows.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("id")), "row")
    owned = scratch.save(owned, "owned")
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    stays = owned.groupBy("component").agg(F.min(first)["row"].alias("row")).select("row")
    gone = scratch.save(owned.select("row").join(stays, "row", "left_anti"), "gone").withColumnRenamed("row", row)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    scratch.drop("found", "several", "owned")
    return rows.join(gone, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
