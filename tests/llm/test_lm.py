"""Masked pseudo-likelihood: the network, the shards, and document scores against a plain restatement."""

import math
import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stridefold.llm import lm, queries
from stridefold.llm.scratch import Scratch
from stridefold.llm.textkernel import blocks

SIDE = lm.LEAST_SIDE
SYMBOLS = SIDE**3


def plain_log_prob(w, context, target):
    """Three plain softmaxes, one for each digit."""
    side, target = len(w["bias1"]), int(target)
    h = np.tanh(w["hidden"] + sum(w["embedding"][s] * w["scale"][j] for j, s in enumerate(context)))
    out = (h @ w["output"]).reshape(3, side)
    a, b, c = target // side**2, target // side % side, target % side
    softmax = lambda x, i: x[i] - math.log(np.exp(x.astype(float)).sum())
    return softmax(out[0] + w["bias1"], a) + softmax(out[1] + w["bias2"][a], b) + softmax(out[2] + w["bias3"][side * a + b], c)


def plain_scores(docs, rounds=lm.ROUNDS):
    """doc_id -> (words, sum) by one window at a time, with the operator's own weights."""
    rows = docs.selectExpr("doc_id", "text")
    scratch = Scratch(docs.sparkSession, "t")
    corpus = lm.gather(rows.select("text"), scratch)
    coder = docs.sparkSession.sparkContext.broadcast((corpus.words, np.log(corpus.counts).astype(np.float32), corpus.vocabulary, np.log1p(corpus.sizes[-lm.BUCKETS :]), corpus.side))
    pieces = scratch.save(lm.coded(rows.select(F.lit(1).cast("long").alias("key"), "doc_id", F.xxhash64("text").alias("text_hash"), "text"), coder), "pieces")
    w = lm.train(pieces, lm.initial(corpus.sizes), int(corpus.sizes.sum()), rounds)
    kept = rows.collect()
    every = Counter(x for r in kept for x in brute.WORD.findall((r.text or "").translate(brute.UPPER)))
    hashes = dict(zip(every, next(blocks(pa.array([" ".join(every)]))).words())) if every else {}
    rank = {x: i for i, x in enumerate(corpus.words[: corpus.vocabulary].tolist())}
    symbol = {x: rank.get(int(h), SYMBOLS - lm.BUCKETS + int(h) % lm.BUCKETS) for x, h in hashes.items()}
    size = Counter()
    for x, n in every.items():
        if symbol[x] >= SYMBOLS - lm.BUCKETS:
            size[symbol[x]] += n
    out = {}
    for r in kept:
        words = brute.WORD.findall((r.text or "").translate(brute.UPPER))
        total = 0.0
        for i, x in enumerate(words):
            context = [symbol[words[i + o]] if 0 <= i + o < len(words) else SYMBOLS for o in lm.OFFSETS]
            total += plain_log_prob(w, context, symbol[x])
            if symbol[x] in size:
                total += math.log(every[x]) - math.log(size[symbol[x]] + 1)
        out[r.doc_id] = (len(words), total)
    return out


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_network_is_a_distribution():
    rng = np.random.default_rng(0)
    w = lm.initial(rng.integers(1, 100, SYMBOLS).astype(float))
    w["embedding"] = rng.normal(0, 1, w["embedding"].shape).astype(np.float32)
    context, target = rng.integers(0, SYMBOLS + 1, (6, len(lm.OFFSETS))).astype(np.uint16), rng.integers(0, SYMBOLS, 6).astype(np.uint16)
    for row, goal, value in zip(context, target, lm.log_probs(w, context, target)):
        assert value == pytest.approx(plain_log_prob(w, row, goal), abs=1e-4)
    every = lm.log_probs(w, np.repeat(context[:1], SYMBOLS, 0), np.arange(SYMBOLS).astype(np.uint16))
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-3)


def test_gradient():
    """Every weight's step follows the numeric gradient of the mean log-probability."""
    rng = np.random.default_rng(1)
    w = lm.initial(rng.integers(1, 50, SYMBOLS).astype(float))
    context, target = rng.integers(0, 50, (64, len(lm.OFFSETS))).astype(np.uint16), rng.integers(0, 50, 64).astype(np.uint16)
    stepped = {k: v.copy() for k, v in w.items()}
    squares = {k: np.zeros_like(v) for k, v in w.items()}
    lm.step(stepped, squares, context, target)
    for name in w:
        for at in np.argsort(-squares[name].ravel())[:3]:
            there = np.unravel_index(at, w[name].shape)
            values = []
            for d in (1e-2, -1e-2):
                moved = {k: v.astype(np.float64) for k, v in w.items()}
                moved[name][there] += d
                values.append(np.mean([plain_log_prob(moved, c, int(t)) for c, t in zip(context, target)]))
            slope = (values[0] - values[1]) / 2e-2
            assert math.sqrt(squares[name][there]) == pytest.approx(abs(slope), rel=0.05, abs=1e-6)
            assert (stepped[name][there] - w[name][there]) * slope > 0
    before = lm.log_probs(w, context, target).mean()
    for _ in range(60):
        lm.step(w, squares, context, target)
    assert lm.log_probs(w, context, target).mean() > before + 1


def test_scores_equal_a_plain_restatement(documents, odd):
    for frame, rounds in ((documents.limit(60).unionByName(odd.where("doc_id in (4, 5, 7, 8, 12, 15)").withColumn("doc_id", F.col("doc_id") + 10**6).select(documents.columns)), 2),):
        frame = frame.persist()
        expected = plain_scores(frame, rounds)
        got = by_id(lm.pseudo_likelihood(frame, rounds=rounds))
        assert {i: r.n_words for i, r in got.items()} == {i: n for i, (n, _) in expected.items()}
        assert all(r.log_prob == pytest.approx(expected[i][1], rel=1e-4, abs=1e-4) for i, r in got.items())


def test_partitions_change_nothing(documents, odd, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 2000)
    frame = documents.select("doc_id", "text").union(odd.select("doc_id", "text"))
    results = [sorted(map(str, lm.pseudo_likelihood(frame.repartition(n, "text")).collect())) for n in (1, 4, 7)]
    assert results[0] == results[1] == results[2] and len(results[0]) == frame.count()


def test_pieces_hold_every_window(spark, odd, monkeypatch):
    """Whatever the cut, the windows are those of the whole texts."""
    rows = odd.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.lit(0).cast("long").alias("text_hash"), "text").persist()
    corpus = lm.gather(rows.select("text"), Scratch(spark, "t"))
    coder = (corpus.words, np.log(corpus.counts), corpus.vocabulary, np.log1p(corpus.sizes[-lm.BUCKETS :]), corpus.side)
    shared = type("Shared", (), {"value": coder})
    found = []
    for piece in (8192, 7):
        monkeypatch.setattr(lm, "PIECE", piece)
        frame = type("Rows", (), {"mapInArrow": lambda self, f, schema: f})()
        batch = rows.toArrow().combine_chunks().to_batches()[0]
        out = pa.Table.from_batches(list(lm.coded(frame, shared)(iter([batch])))).combine_chunks().to_batches()[0]
        assert max(out.column("n").to_pylist()) <= piece
        found.append([x.tolist() for x in lm.windows_of(out, SYMBOLS)])
    assert found[0] == found[1] and len(found[0][1]) == corpus.sizes.sum()


def test_prefers_text_in_order(spark):
    """Both sides tell the word: a b c b a ... against the same words shuffled."""
    rng = random.Random(0)
    cycle = ["aa", "bb", "cc", "dd", "ee"]
    good = [" ".join(cycle[(s + i) % 5] for i in range(60)) for s in (rng.randrange(5) for _ in range(300))]
    bad = [" ".join(rng.sample(g.split(), 60)) for g in good[:50]]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    rows = by_id(lm.pseudo_likelihood(docs, rounds=8))
    assert np.mean([rows[i].mean_log_prob for i in range(50)]) > np.mean([rows[300 + i].mean_log_prob for i in range(50)]) + 0.5
    assert all(r.log_prob == pytest.approx(r.mean_log_prob * r.n_words) and r.n_words == 60 for r in rows.values())


def one_word_texts(spark):
    """Texts of one word each: word i of 3,000 occurs 1 + i % 7 times, some without an id."""
    rows = [(None if i % 5 == 0 else 10 * i + k, f"w{i}") for i in range(3000) for k in range(1 + i % 7)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_probabilities_of_all_words(spark, monkeypatch):
    """Over all words they are at most 1, and of words of one bucket the more frequent one is more probable."""
    docs = one_word_texts(spark)
    rows = lm.pseudo_likelihood(docs, rounds=0).collect()
    assert len(rows) == docs.count()
    own = {10 * i: 1 + i % 7 for i in range(3000) if i % 5}
    score = {r.doc_id: r.log_prob for r in rows if r.doc_id in own}
    assert 0.5 < sum(map(np.exp, score.values())) < 1
    by_count = [np.mean([score[d] for d in own if own[d] == n]) for n in range(1, 7)]
    assert by_count == sorted(by_count)
    monkeypatch.setattr(lm, "KEEP", 1000)  # the counts of the others are joined
    monkeypatch.setattr(lm, "FLOOR", 6)
    again = lm.pseudo_likelihood(docs, rounds=0).collect()
    assert len(again) == len(rows) and 0.5 < sum(np.exp(r.log_prob) for r in again if r.doc_id in own) < 1
    monkeypatch.setattr(lm, "KEEP", 10)  # none is held: all words are in buckets
    none = lm.pseudo_likelihood(docs).collect()
    assert len(none) == len(rows) and 0.5 < sum(np.exp(r.log_prob) for r in none if r.doc_id in own) < 1


def test_vocabulary_grows(spark, monkeypatch):
    monkeypatch.setattr(lm, "FLOOR", 3)
    found = lm.gather(one_word_texts(spark).select("text"), Scratch(spark, "t"))
    assert found.vocabulary >= sum(1 + i % 7 >= 3 for i in range(3000)) and found.sizes.sum() == sum(1 + i % 7 for i in range(3000))
    assert lm.pseudo_likelihood(one_word_texts(spark)).where("log_prob < 0").count() == found.sizes.sum()
    monkeypatch.setattr(lm, "MOST_SIDE", 11)
    assert lm.gather(one_word_texts(spark).select("text"), Scratch(spark, "t")).vocabulary == 11**3 - lm.BUCKETS


def test_trains_on_every_word(spark):
    """Records of four words: each of the four places is learned as a target."""
    docs = spark.createDataFrame([(i, "one two three four") for i in range(2000)], "doc_id long, text string")
    before = lm.pseudo_likelihood(docs, rounds=0).first().log_prob
    assert lm.pseudo_likelihood(docs, rounds=4).first().log_prob > before + 1


def test_odd_rows(odd, empty):
    rows = lm.pseudo_likelihood(odd).collect()
    assert len(rows) == odd.count() and all(r.log_prob == 0 and r.mean_log_prob is None for r in rows if r.doc_id in (4, 5, 6))
    assert all(r.log_prob < 0 for r in rows if r.n_words)
    assert lm.pseudo_likelihood(empty).count() == 0


def test_query(spark, small, documents):
    rows = queries.QUERIES["op7_lm_scoring"](spark, small).collect()
    words = {r.doc_id: len(brute.WORD.findall(r.text or "")) for r in documents.collect()}
    assert {r.doc_id: r.n_words for r in rows} == words and all(r.log_prob < 0 for r in rows if r.n_words)
