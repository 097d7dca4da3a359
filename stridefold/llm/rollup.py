"""Token totals kept up to date by signed deltas, with idempotent commits.

A store is a folder. ``entries/<batch>`` holds signed rows per document and
tokenizer version, ``deltas/<batch>`` their sums by source, language and version,
and ``commits/<batch>`` a marker that is created last and never replaced. Only
marked batches count, so a batch that failed half-way is simply run again, and
one that is sent twice changes nothing. One writer commits at a time.

Entries lie by version and by bucket, a hash of the document's id, and a batch
reads only the versions and buckets that it touches. After COMPACT batches, their
entries and deltas are summed into a ``state``, whose marker names the batches
that it covers: what a commit reads does not grow with the store's history, only
with the documents in its buckets. Totals are sums of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridefold.llm.scratch import Scratch, bounded_batches
from stridefold.llm.textkernel import Block, blocks
from stridefold.llm.wordbpe import word_encoder

KEY = ["doc_id", "copy", "version"]
GROUP = ["source", "lang", "version"]
ENTRY = "doc_id long, copy long, source string, lang string, docs long, tokens long, version string, bucket int"
DELTA = "source string, lang string, version string, docs long, tokens long"
BUCKETS, COMPACT = 32, 8


class TokenRollup:
    """Additive totals by source, language and tokenizer version.

    ``commit`` takes rows (doc_id, version, source, lang, n_tokens); a null
    ``n_tokens`` deletes the document's count under that version, any other
    value inserts or revises it (its source and language too). A column ``copy``
    (0 where absent) tells apart rows that share an id. Rows without an
    id or a version are ignored, null sources and languages are groups of their
    own. Where a batch has a key twice, the row with the largest (n_tokens,
    source, lang) holds, and a delete yields to any count. Extra columns are
    ignored; an empty batch commits and changes nothing.
    """

    def __init__(self, spark: SparkSession, store: Scratch, buckets: int = BUCKETS, compact: int = COMPACT):
        self.spark, self.store, self.buckets, self.compact = spark, store, buckets, compact

    def _names(self, kind: str) -> list[str]:
        fs, where = self.store._fs(self.store.path(kind))
        return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []

    def _mark(self, path: str, text: str = "") -> None:
        fs, where = self.store._fs(self.store.path(path))
        out = fs.create(where, False)
        out.write(bytearray(text.encode()))
        out.close()

    def _covered(self) -> tuple[str | None, set[str]]:
        """The last finished state, and the batches that it covers."""
        marks = self._names("states")
        if not marks:
            return None, set()
        lines = self.spark.read.text(self.store.path(f"states/{marks[-1]}"), wholetext=True).first()[0].split("\n")
        return marks[-1], set(lines)

    def _parts(self, kind: str) -> list[str]:
        state, covered = self._covered()
        return ([f"state/{state}/{kind}"] if state else []) + [f"{kind}/{b}" for b in self._names("commits") if b not in covered]

    def _read(self, kind: str, schema: str, touched: dict[str, list[int]] | None = None) -> DataFrame:
        """``touched``: only these buckets of these versions."""
        out = self.spark.createDataFrame([], schema)
        for part in self._parts(kind):
            rows = self.spark.read.schema(schema).parquet(self.store.path(part))
            if touched is not None:
                rows = rows.where(reduce(or_, ((F.col("version") == v) & F.col("bucket").isin(b) for v, b in touched.items()), F.lit(False)))
            out = out.unionByName(rows)
        return out

    def _save(self, entries: DataFrame, path: str) -> DataFrame:
        """Entries and their sums, a folder for each version and bucket."""
        entries.repartition("version", "bucket").write.mode("overwrite").partitionBy("version", "bucket").parquet(self.store.path(path))
        return self.spark.read.schema(ENTRY).parquet(self.store.path(path))

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """False if the batch was committed before."""
        if batch in self._names("commits"):
            return False
        copy = F.col("copy").cast("long") if "copy" in rows.columns else F.lit(0).cast("long")
        new = (
            rows.select(F.col("doc_id").cast("long").alias("doc_id"), copy.alias("copy"), F.col("version").cast("string").alias("version"), F.struct(F.col("n_tokens").cast("long").alias("n_tokens"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")).alias("x"))
            .where("doc_id is not null and version is not null and version <> ''")
            .groupBy(*KEY)
            .agg(F.max("x").alias("x"))
            .select(*KEY, "x.*", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(self.buckets)).cast("int").alias("bucket"))
        )
        new = self.store.save(new, f"staged/{batch}")
        touched = {r.version: r.buckets for r in new.groupBy("version").agg(F.collect_set("bucket").alias("buckets")).collect()}  # versions are few
        old = self._read("entries", ENTRY, touched).join(new.select(*KEY), KEY, "left_semi")
        undo = old.withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")})
        add = new.where("n_tokens is not null").select(*KEY, "bucket", "source", "lang", F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"))
        entries = self._save(self._net(undo.unionByName(add)), f"entries/{batch}")
        self.store.save(self._sums(entries), f"deltas/{batch}")
        self.store.drop(f"staged/{batch}")
        self._mark(f"commits/{batch}")
        if len(self._parts("entries")) > self.compact:
            self.compacted()
        return True

    def _net(self, entries: DataFrame) -> DataFrame:
        net = entries.groupBy(*KEY, "bucket", "source", "lang").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return net.where("docs <> 0 or tokens <> 0")

    def _sums(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def compacted(self) -> None:
        """Sum all committed entries and deltas into a new state; what it replaces goes after its marker is there."""
        state, covered = self._covered()
        name = f"{int(state or 0) + 1:012}"
        batches = self._names("commits")
        self._save(self._net(self._read("entries", ENTRY)), f"state/{name}/entries")
        self.store.save(self._sums(self._read("deltas", DELTA)).where("docs <> 0 or tokens <> 0"), f"state/{name}/deltas")
        self._mark(f"states/{name}", "\n".join(batches))
        self.store.drop(*([f"state/{state}"] if state else []), *(f"{kind}/{b}" for kind in ("entries", "deltas") for b in batches if b not in covered))

    def totals(self) -> DataFrame:
        sums = self._read("deltas", DELTA).groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")


_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _lettered(block: Block) -> np.ndarray:
    """Words with an ASCII letter or digit, or a byte beyond ASCII."""
    some = np.concatenate([[0], np.cumsum(_PLAIN[block.data])])
    return np.diff(np.concatenate([[0], np.cumsum(some[block.end] > some[block.start])])[block.first])


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, source, lang, n_words, n_lettered, n_bpe; a null text has none of any."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            for block in blocks(batch.column(3)):
                bpe = encoder.encode([block.raw[block.at[d] : block.at[d + 1]].tobytes() for d in range(block.docs)])
                own = [batch.column(i).slice(block.lo, block.docs) for i in range(3)]
                counts = [block.count, _lettered(block), np.array([len(x) // 4 for x in bpe], np.int64)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c.astype(np.int64)) for c in counts)], ["doc_id", "source", "lang", "n_words", "n_lettered", "n_bpe"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, n_words long, n_lettered long, n_bpe long")


def maintained(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Totals after four batches over all documents, one of them sent twice.

    Insert: whitespace words, as version words-1. Insert: ids of the tokenizer,
    as bpe-1. The first batch again, which changes nothing. Revise: words-1
    counts only words with a letter, a digit or a character beyond ASCII.
    Delete: documents without any word leave both versions. Every row counts:
    rows without an id, or with one that others have too, have an entry each.
    """
    spark = docs.sparkSession
    store = Scratch(spark, "rollup")
    counted = store.save(count_tokens(docs, tokenizer).withColumn("row", F.monotonically_increasing_id()), "counted")
    shared = counted.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"))
    own = counted.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "none": F.col("doc_id").isNull()}).join(shared.withColumn("several", F.lit(True)), ["id", "none"], "left")
    own = own.select(F.col("id").alias("doc_id"), F.when(F.col("several"), F.col("row") + 1).otherwise(0).alias("copy"), "source", "lang", "n_words", "n_lettered", "n_bpe")
    counted = store.save(own, "keyed")
    rollup = TokenRollup(spark, store)
    version = lambda name, column: counted.select("doc_id", "copy", F.lit(name).alias("version"), "source", "lang", F.col(column).alias("n_tokens"))
    rollup.commit("1-words", version("words-1", "n_words"))
    rollup.commit("2-bpe", version("bpe-1", "n_bpe"))
    rollup.commit("1-words", version("words-1", "n_words"))
    rollup.commit("3-revised", version("words-1", "n_lettered"))
    empty = counted.where("n_words = 0").select("doc_id", "copy", F.explode(F.array(F.lit("words-1"), F.lit("bpe-1"))).alias("version"), "source", "lang", F.lit(None).cast("long").alias("n_tokens"))
    rollup.commit("4-deleted", empty)
    store.drop("counted", "keyed")
    return rollup.totals()
