"""Quality rules as a short-circuit cascade.

Every rule rejects a document by a whole-number inequality over its counts. A
sample of rows gives each rule's cost (seconds) and selectivity (share that it
rejects of what the rules before it left); rules then run by rejection per
cost, each only over the survivors of those before. The order changes the cost,
never the verdict. Counts are computed when a rule first asks for them, over
the documents still alive.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridefold.llm.scratch import bounded_batches
from stridefold.llm.textkernel import Block, blocks

#: About so many rows, from all partitions, give the rules' costs and selectivities; texts over so many bytes are left out of that.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 1 << 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


class Texts:
    """Documents with counts that are computed once, on demand."""

    def __init__(self, block: Block, known: dict[str, np.ndarray] | None = None):
        self.block, self.known = block, known or {}

    def __len__(self) -> int:
        return self.block.docs

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.known:
            self.known[name] = COUNTS[name](self.block)
        return self.known[name]

    def take(self, rows: np.ndarray) -> Texts:
        if len(rows) == len(self):
            return self
        at = self.block.at
        data = np.concatenate([self.block.data[at[r] : at[r + 1]] for r in rows]) if len(rows) else self.block.data[:0]
        offsets = np.concatenate([[0], np.cumsum((at[1:] - at[:-1])[rows])]).astype(np.int64)
        return Texts(Block(data, offsets, 0, len(rows)), {k: v[rows] for k, v in self.known.items()})


def _per_doc(block: Block, flags: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[block.at])


def _word_chars(block: Block) -> np.ndarray:
    """Code points inside words."""
    word = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    ends = np.concatenate([[0], np.cumsum(word[block.end] - word[block.start])])
    return np.diff(ends[block.first])


def _lines(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of each line that holds a word."""
    own = np.arange(block.docs)
    breaks = np.flatnonzero(block.data == 10)
    of = np.searchsorted(block.at, breaks, "right") - 1
    start, starts_of = np.concatenate([block.at[:-1], breaks + 1]), np.concatenate([own, of])
    end, ends_of = np.concatenate([breaks, block.at[1:]]), np.concatenate([of, own])
    by_start, by_end = np.lexsort((start, starts_of)), np.lexsort((end, ends_of))
    doc, start, end = starts_of[by_start], start[by_start], end[by_end]
    worded = np.searchsorted(block.start, start) < np.searchsorted(block.start, end)
    return doc[worded], start[worded], end[worded]


def _dup_lines(block: Block) -> np.ndarray:
    doc, start, end = _lines(block)
    line, _ = block.identities(start, end)
    order = np.lexsort((line, doc))
    doc, line = doc[order], line[order]
    again = (doc[1:] == doc[:-1]) & (line[1:] == line[:-1])
    return np.bincount(doc[1:][again], minlength=block.docs)


def _repeat_words(block: Block, k: int = 3) -> np.ndarray:
    """Words inside windows of k words that the document holds twice or more."""
    word, kinds = block.identities(block.start, block.end)
    per_doc = np.maximum(block.count - k + 1, 0)
    doc = np.repeat(np.arange(block.docs), per_doc)
    first = block.first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    runs = word[first]
    for j in range(1, k):  # pairs of numbers, numbered anew before they could overflow
        if j > 1 and kinds ** (j + 1) >= 2**63:
            runs = np.unique(runs, return_inverse=True)[1]
        runs = runs * kinds + word[first + j]
    order = np.lexsort((runs, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (runs[order][1:] == runs[order][:-1])
    twice = np.zeros(len(runs), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = first[order[twice]]
    covered = np.zeros(len(block.start), bool)
    for j in range(k):
        covered[at + j] = True
    return np.diff(np.concatenate([[0], np.cumsum(covered)])[block.first])


COUNTS: dict[str, Callable[[Block], np.ndarray]] = {
    "n_words": lambda b: b.count,
    "word_chars": _word_chars,
    "n_symbols": lambda b: _per_doc(b, _SYMBOL[b.data]),
    "n_upper": lambda b: _per_doc(b, _UPPER[b.data]),
    "n_letters": lambda b: _per_doc(b, _LETTER[b.data]),
    "n_lines": lambda b: np.bincount(_lines(b)[0], minlength=b.docs),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts], np.ndarray]


#: The two base rules, then the others; all are exact inequalities in whole numbers.
BASE_RULES = (
    Rule("few_words", lambda t: t["n_words"] < 50),
    Rule("repeated_windows", lambda t: 100 * t["n_repeat_words"] > 50 * t["n_words"]),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda t: 100 * t["n_symbols"] > 30 * t["n_words"]),
    Rule("repeated_lines", lambda t: 100 * t["n_dup_lines"] > 40 * t["n_lines"]),
    Rule("shouting", lambda t: 100 * t["n_upper"] > 60 * t["n_letters"]),
    Rule("word_length", lambda t: (t["word_chars"] < 2 * t["n_words"]) | (t["word_chars"] > 25 * t["n_words"])),
)


def ranked(rules: Sequence[Rule], sample: pa.Array) -> list[Rule]:
    """Greedy order by rejection per second, each rule measured on what the chosen ones leave."""
    left, order = [Texts(b) for b in blocks(sample)], []
    rest = list(rules)
    while rest:
        best = None
        for rule in rest:
            fresh = [Texts(t.block) for t in left]
            began = time.perf_counter()
            masks = [rule.rejects(t) for t in fresh]
            cost = time.perf_counter() - began + 1e-9
            gain = sum(int(m.sum()) for m in masks) / cost
            if best is None or gain > best[0]:
                best = (gain, rule, masks)
        _, rule, masks = best
        order.append(rule)
        rest.remove(rule)
        left = [t.take(np.flatnonzero(~m)) for t, m in zip(left, masks)]
    return order


def sampled(texts: DataFrame, rows: int) -> pa.Array:
    """About so many of the texts (one column), from all partitions; the verdicts do not depend on which."""
    short = texts.where(F.coalesce(F.octet_length(texts.columns[0]), F.lit(0)) <= SAMPLE_BYTES)
    found = short.sample(min(1.0, rows / max(1, texts.count())), seed=1).toArrow()
    return found.column(0).combine_chunks()


def verdicts(texts: Texts, rules: Sequence[Rule]) -> np.ndarray:
    """True for documents that no rule rejects."""
    kept = np.zeros(len(texts), bool)
    alive = np.arange(len(texts))
    for rule in rules:
        if not len(alive):
            return kept
        passed = np.flatnonzero(~rule.rejects(texts))
        texts, alive = texts.take(passed), alive[passed]
    kept[alive] = True
    return kept


def quality(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: Sequence[Rule] = RULES,
    measured: Sequence[str] = (),
    base: Sequence[Rule] = (),
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per row: doc_id, the ``measured`` counts, base_failed, kept.

    Null and empty texts have zero counts (and so fail the word-count rule).
    Repeated rows get the same verdict each; extra columns are ignored; an empty
    table gives no rows. ``sample_rows`` is about how many rows the order is estimated on.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ranked(rules, sampled(rows.select("text"), sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                texts = Texts(block)
                counts = [pa.array(texts[name].astype(np.int64)) for name in measured]
                failed = np.zeros(len(texts), bool)
                for rule in base:
                    failed |= rule.rejects(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.lo, block.docs), *counts, pa.array(failed), pa.array(verdicts(texts, order) & ~failed)],
                    ["doc_id", *measured, "base_failed", "kept"],
                )

    return rows.mapInArrow(run, "doc_id long, " + "".join(f"{m} long, " for m in measured) + "base_failed boolean, kept boolean")


def drop_rejected(docs: DataFrame, *, text_col: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows, with all their columns, whose text no rule rejects; nothing is joined or shuffled.

    Null and empty texts have no words, and so are rejected by the default rules;
    repeated rows fare alike; columns keep their names, whatever they are; an
    empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    order = ranked(rules, sampled(docs.select(F.col(f"`{text_col}`").cast("string").alias("text")), sample_rows))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [verdicts(Texts(block), order) for block in blocks(batch.column(at).cast(pa.string()))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
