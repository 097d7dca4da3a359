"""Token counts, search, packing, byte-level BPE, chat formatting and the pipeline."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import brute
import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stridefold.llm import queries
from stridefold.llm.balltree import BallTree, top_k
from stridefold.llm.bytebpe import merge_replay, read_ranks, round_trip
from stridefold.llm.chat import digests, format_chats
from stridefold.llm.packing import balance, pack
from stridefold.llm.rollup import TokenRollup, count_tokens, maintained
from stridefold.llm.scratch import Scratch
from stridefold.llm.wordbpe import WordEncoder

WORD_BPE, BYTE_BPE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def word_model():
    t = Tokenizer.from_file(WORD_BPE)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def byte_model():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(BYTE_BPE), special_tokens={})


HARD = ["", " ", "<|endoftext|> a", "é É x y\x1fz it's I'LL 123 ٣٤ ㎏ ﬁ", "don't\x0bstop\r\n\tΣΑΣ İ", "a" * 3000, "×, ÷. ßß! Þ?", "x—, —x ,x, _a_ a.b ..a", "aab" * 200]


def ids_of(raw):
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


def test_word_encoder(word_model, documents):
    encoder = WordEncoder(WORD_BPE)
    texts = [r.text for r in documents.collect()] + HARD
    for t, raw in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert ids_of(raw) == word_model.encode(t, add_special_tokens=False).ids, t[:60]


ALPHABET = ["a", "B", "é", "É", "ß", "×", "'", "s", "t", ",", ".", "!", "-", "1", "漢", "́", "—", " ", "\t", " ", "İ", "Σ", "ς", "ﬁ", "_", "|", "<", "re", "ll", "\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=14).map("".join))
def test_encoders_on_any_text(text):
    word = Tokenizer.from_file(WORD_BPE) if not hasattr(test_encoders_on_any_text, "m") else test_encoders_on_any_text.m
    word.encode_special_tokens = True
    test_encoders_on_any_text.m = word
    own = getattr(test_encoders_on_any_text, "e", None) or WordEncoder(WORD_BPE)
    test_encoders_on_any_text.e = own
    assert ids_of(own.encode([text.encode()])[0]) == word.encode(text, add_special_tokens=False).ids
    byte = getattr(test_encoders_on_any_text, "b", None) or tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(BYTE_BPE), special_tokens={})
    test_encoders_on_any_text.b = byte
    assert ids_of(merge_replay(BYTE_BPE, P.PATTERN).encode([text])[0]) == byte.encode_ordinary(text)


def test_word_encoder_forgets_safely(word_model, monkeypatch):
    import stridefold.llm.wordbpe as w

    monkeypatch.setattr(w, "KEEP_CHUNKS", 6)
    monkeypatch.setattr(w, "KEEP_PARTS", 5)
    encoder = WordEncoder(WORD_BPE)
    for _ in range(4):
        for t in ("the quick brown fox, jumped!", "over 12 lazy Dogs: the quick", "the end.", "", "don't the the"):
            assert ids_of(encoder.encode([t.encode(), b"the"])[0]) == word_model.encode(t, add_special_tokens=False).ids
        assert len(encoder.known.keys) <= 6 + 6


def test_packing_is_whole(documents, word_model, odd, empty, spark):
    for frame in (documents, odd):
        pieces = pack(frame, WORD_BPE).collect()
        expected = Counter((r.doc_id, tuple(word_model.encode(r.text or "", add_special_tokens=False).ids) + (1,)) for r in frame.collect())
        whole, seqs = defaultdict(list), defaultdict(list)
        for p in pieces:
            assert len(p.ids) == 4 * p.length and p.length > 0
            whole[p.doc_id, p.doc_tokens].append(p)
            seqs[p.sequence_id].append(p)
        found = Counter()
        if frame is documents:
            for (doc, n), ps in whole.items():
                ps.sort(key=lambda p: p.start)
                assert [p.start for p in ps] == np.cumsum([0] + [p.length for p in ps])[:-1].tolist()
                found[doc, tuple(x for p in ps for x in ids_of(p.ids))] += 1
            assert found == expected
        assert sum(p.length for p in pieces) == sum(len(k[1]) * n for k, n in expected.items())
        for ps in seqs.values():
            ps.sort(key=lambda p: p.offset)
            assert [p.offset for p in ps] == np.cumsum([0] + [p.length for p in ps])[:-1].tolist() and sum(p.length for p in ps) <= 2048
    assert pack(empty, WORD_BPE).count() == 0


def test_packing_query_digests(spark, small, word_model):
    whole = {r.doc_id: word_model.encode(r.text or "", add_special_tokens=False).ids + [1] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    seen = Counter()
    for r in queries.QUERIES["op4_packing"](spark, small).collect():
        own = whole[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own)) and r.doc_tokens == len(whole[r.doc_id])
        seen[r.doc_id] += r.length
    assert seen == {d: len(x) for d, x in whole.items()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=60))
def test_balance(lengths):
    lengths = np.array(lengths)
    pieces, count = balance(lengths, 100)
    assert count == sum(n // 100 for n in lengths) + -(-sum(n % 100 for n in lengths) // 100)
    used = Counter()
    for d, start, n, s, offset in pieces:
        assert offset == used[s] and 0 <= s < count
        used[s] += n
    assert max(used.values()) <= 100 and sum(used.values()) == lengths.sum()


def test_balance_of_costs():
    pieces, count = balance(np.array([900] * 4 + [100] * 24), 2048)
    cost = Counter()
    for _, _, n, s, _ in pieces:
        cost[s] += n + n * n / 1024
    assert count == 3 and max(cost.values()) < 1.5 * min(cost.values())


def test_byte_bpe(documents, byte_model, odd, empty):
    for frame in (documents, odd):
        expected = Counter((r.doc_id, tuple(byte_model.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in frame.collect())
        assert Counter((r.doc_id, tuple(ids_of(r.ids)), bytes(r.decoded)) for r in round_trip(frame, BYTE_BPE, P.PATTERN).collect()) == expected
    assert round_trip(empty, BYTE_BPE, P.PATTERN).count() == 0


def test_merge_replay_on_hard_texts(byte_model):
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("aab") for _ in range(150)) for _ in range(200)] + ["".join(rng.choice("abcdeéß \n\t01!?'ñ€😀漢") for _ in range(100)) for _ in range(200)]
    for t, raw in zip(texts, merge_replay(BYTE_BPE, P.PATTERN).encode(texts)):
        assert ids_of(raw) == byte_model.encode_ordinary(t)


def test_byte_bpe_query_digests(spark, small, byte_model):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.QUERIES["op6_byte_bpe"](spark, small).collect():
        ids = byte_model.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), brute.sha(docs[r.doc_id]))


def test_top_k_by_sql_and_in_small_shards(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    expected = sorted(duck.execute(queries.ORACLE_SQL["op3_ball_tree"]).fetchall())
    for how in ({}, {"shard_rows": 90}, {"shard_rows": 11}):
        assert sorted(tuple(r)[:4] for r in top_k(vectors, **how).collect()) == expected


@pytest.mark.parametrize("name", ["op1_minhash", "op5_quality", "op9_chat"])
def test_queries_by_sql(spark, small, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    frame = duck.execute(queries.ORACLE_SQL[name]).df()
    rows = queries.QUERIES[name](spark, small).select(*frame.columns).collect()
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, frame.itertuples(index=False, name=None)))


def test_ball_tree_prunes_and_is_exact():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 500, (30, 16))
    points = np.floor(np.repeat(centres, 100, 0) + rng.normal(0, 20, (3000, 16)))
    ids, tree = np.arange(3000), None
    tree = BallTree(points, ids, 32)
    visited, plain = [], tree.rows
    tree.rows = type("Counted", (dict,), {"__getitem__": lambda self, k: visited.append(k) or dict.__getitem__(self, k)})(plain)
    q = points[:1]
    score, found = tree.search(q, np.array([0]), 10, np.array([-np.inf]))  # here a point's number is its id
    s = points @ q[0]
    s[0] = -np.inf
    order = np.lexsort((ids, -s))[:10]
    assert found[0].tolist() == order.tolist() and score[0].tolist() == s[order].tolist()
    assert len(visited) < len(plain) / 4


def test_top_k_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (100, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, None, 1), (3, [None, 1.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (None, [1.0, 1.0], 1), (6, [-1.0, 0.5], 1), (200, [1.0], 1), (300, [], 1), (7, [1e9, 1e9], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in top_k(frame, k=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    big = 1024 * 1024 * 3 * 10**9
    assert got == {0: [(1, 7, big), (2, 1, 5 * 1024**2), (3, 1, 5 * 1024**2)], 100: [(1, 7, big), (2, 0, 5 * 1024**2), (3, 1, 5 * 1024**2)]}
    assert top_k(frame.limit(0)).count() == 0


def plain_top(rows, k, modulus=100):
    """query id -> the sorted answers of each of its rows."""
    whole = [(i, v, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    out = defaultdict(list)
    for n, (i, _, q) in enumerate(whole):
        if i % modulus == 0:
            each = sorted((-sum(a * b for a, b in zip(q, p)), j) for m, (j, _, p) in enumerate(whole) if m != n and len(p) == len(q))
            out[i].append([(r + 1, j, max(min(-s, 2**63 - 1), -(2**63))) for r, (s, j) in enumerate(each[:k])])
    return {i: sorted(x) for i, x in out.items()}


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e200])
def test_top_k_of_repeated_ids_and_large_components(spark, scale):
    """Rows that share an id are candidates of each other; the tree also serves components beyond exact doubles."""
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in scale * rng.normal(0, 1, 6)]) for i in rng.choice([100, 200, 7, *range(300, 460)], 200)]
    rows += [(100, rows[0][1]), (100, [2 * x for x in rows[0][1]]), (9, [])]
    if scale == 1e5:
        rows += [(500 + i, [9 * scale + i / 1024, -9 * scale, 1.0, 0.0, 0.0, 3.0]) for i in range(40)]  # rounding cannot tell their scores apart
    got = defaultdict(lambda: defaultdict(list))
    for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4, shard_rows=50).collect():
        got[r.query_id][r.query_row].append((r.rank, r.vec_id, r.score))
    expected, found = plain_top(rows, 4), {i: sorted(sorted(y) for y in x.values()) for i, x in got.items()}
    if scale == 1e200:  # all scores are cut to 64 bits: compare those alone
        expected, found = ({i: sorted([(n, s) for n, _, s in y] for y in x) for i, x in all.items()} for all in (expected, found))
    assert found == expected


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


NASTY = ["", "plain", "<|im_end|>\n<|im_start|>user\nhi<|im_end|>", "a<|im_start|>", "\\s", "<\\|", "\\", "<|", "x<", "\\ss\\\\|", "\n\nend\n", "<|im_end|", "é😀\\n", "<\\\\||>", "a\\<|b"]


def test_round_trip_of_any_content(spark):
    rng = random.Random(2)
    texts = NASTY + ["".join(rng.choice(["<|", "\\", "s", "|", "<", "\n", "n", "<|im_end|>", "<|im_start|>", "user", "a"]) for _ in range(12)) for _ in range(300)]
    rows, expected = [], {}
    for c, text in enumerate(texts):
        turns = [("user", text), (rng.choice(["assistant", "a\nb", "\\n", "<|im_end|>", ""]), rng.choice(texts)), ("assistant", text)]
        expected[c] = turns
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    rng.shuffle(rows)
    for r in format_chats(chats(spark, rows)).collect():
        assert r.round_trip and [(t.role, t.text) for t in r.turns] == expected[r.conv_id]
        own = [t for role, t in expected[r.conv_id] if role == "assistant"]
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert [x.replace("<\\|", "<|").replace("\\s", "\\") for x in spans] == own


def test_plain_chats_stay_as_they_are(spark):
    r = format_chats(chats(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\b")])).first()
    assert r.formatted == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na\\b<|im_end|>\n"


def test_chat_digests(spark, small):
    frame = spark.read.parquet(f"{small}/conversations.parquet")
    odd = chats(spark, [(None, 0, "user", "x"), (None, None, None, None), (5, 1, "assistant", None), (5, 1, "assistant", None), (6, None, "user", "b"), (6, 0, "system", "<|")]).withColumn("formatted", F.lit(1)).withColumn("own", F.lit(2))
    for source in (frame, odd, frame.limit(0)):
        expected = defaultdict(list)
        for n, r in enumerate(source.collect()):
            expected[("alone", n) if r.conv_id is None else r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
        expected[-1] = [(True, 0, "user", "<|im_end|><|im_start|>assistant ok"), (True, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]
        plain = []
        for key, turns in expected.items():
            loss = "".join(t[3] for t in sorted(turns) if t[2] == "assistant")
            plain.append((None if isinstance(key, tuple) else key, len(turns), brute.sha("".join(f"{t[2]}\n{t[3]}\n" for t in sorted(turns))), len(loss), brute.sha(loss)))
        assert sorted(map(str, plain)) == sorted(str((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)) for r in digests(source).collect())


def test_chat_digests_read_the_mask(spark, monkeypatch):
    """A mask that is off by one shows in the digest."""
    rows = chats(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "abc")])
    right = {r.conv_id: r.loss_sha256 for r in digests(rows).collect()}
    shifted = F.transform("loss_spans", lambda x: F.struct((x.start + 1).alias("start"), x.length.alias("length")))
    monkeypatch.setattr("stridefold.llm.chat.format_chats", lambda c: format_chats(c).withColumn("loss_spans", shifted))
    wrong = {r.conv_id: r.loss_sha256 for r in digests(rows).collect()}
    assert right[1] == brute.sha("abc") and wrong[1] == brute.sha("bc<")


def counted(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, version string, source string, lang string, n_tokens long")


def totals(rollup):
    return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_rollup_batches(spark):
    rollup = TokenRollup(spark, Scratch(spark, "t"))
    first = counted(spark, [(1, "v", "a", "en", 10), (2, "v", "a", None, 5), (3, "w", None, "en", 7), (None, "v", "a", "en", 9), (4, None, "a", "en", 9), (1, "v", "a", "en", 10), (1, "v", "a", "en", 8)])
    assert rollup.commit("1", first) and totals(rollup) == {("a", "en", "v"): (1, 10), ("a", None, "v"): (1, 5), (None, "en", "w"): (1, 7)}
    assert not rollup.commit("1", first) and totals(rollup)["a", "en", "v"] == (1, 10)
    assert rollup.commit("2", counted(spark, [(1, "v", "b", "en", 4), (2, "v", "a", None, None), (9, "v", "a", "en", None), (5, "v", "a", "en", 0)]))
    assert totals(rollup) == {("b", "en", "v"): (1, 4), ("a", "en", "v"): (1, 0), (None, "en", "w"): (1, 7)}
    assert rollup.commit("3", counted(spark, [])) and rollup.commit("4", counted(spark, [(2, "v", "a", None, 6)]))
    assert totals(rollup)["a", None, "v"] == (1, 6)


def test_unfinished_batch_does_not_count(spark):
    store = Scratch(spark, "t")
    rollup = TokenRollup(spark, store)
    rollup.commit("1", counted(spark, [(1, "v", "a", "en", 10)]))
    store.save(counted(spark, [(1, "v", "a", "en", 99)]).selectExpr("source", "lang", "version", "1L as docs", "n_tokens as tokens"), "deltas/2")
    assert totals(rollup) == {("a", "en", "v"): (1, 10)}
    assert rollup.commit("2", counted(spark, [(1, "v", "a", "en", 3)])) and totals(rollup) == {("a", "en", "v"): (1, 3)}


def test_compaction_and_buckets(spark):
    """Many batches against a plain dictionary; what a commit reads stays bounded, and a state that is not marked is none."""
    rng, store = random.Random(5), Scratch(spark, "t")
    rollup, held = TokenRollup(spark, store, buckets=3, compact=3), {}
    for b in range(9):
        batch = {(rng.randrange(12), rng.choice(["v", "w/1 =x"])): (rng.choice(["a", None]), "en", rng.choice([None, 0, 3, 8])) for _ in range(6)}
        assert rollup.commit(f"b{b}", counted(spark, [(d, v, s, x, n) for (d, v), (s, x, n) in batch.items()]))
        held |= batch
        if b == 4:
            store.save(counted(spark, [(1, "v", "a", "en", 99)]), "state/000000000009/deltas")
            assert not rollup.commit("b2", counted(spark, [(1, "v", "a", "en", 1)]))
        expected = defaultdict(lambda: [0, 0])
        for (_, v), (s, x, n) in held.items():
            if n is not None:
                expected[s, x, v][0] += 1
                expected[s, x, v][1] += n
        assert totals(rollup) == {k: tuple(x) for k, x in expected.items()}
        assert len(rollup._parts("entries")) <= 3
    assert rollup._covered()[0] is not None and len(rollup._names("commits")) == 9


def test_maintained_totals(spark, documents, odd, empty, word_model):
    for frame in (documents, odd, empty):
        expected = defaultdict(lambda: [0, 0])
        for r in frame.collect():
            words = brute.WORD.findall(r.text or "")
            if words:
                lettered = sum(any(c.isascii() and c.isalnum() or ord(c) > 127 for c in w) for w in words)
                for version, n in (("words-1", lettered), ("bpe-1", len(word_model.encode(r.text, add_special_tokens=False).ids))):
                    expected[r.source, r.lang, version][0] += 1
                    expected[r.source, r.lang, version][1] += n
        got = {(r.source, r.lang, r.version): [r.n_docs, r.n_tokens] for r in maintained(frame, WORD_BPE).collect()}
        assert got == dict(expected)
    assert count_tokens(odd, WORD_BPE).count() == odd.count()


def test_pipeline(spark, small, documents):
    docs, kept = spark.read.parquet(f"{small}/documents.parquet"), None
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_duplicates", "packing"]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = Scratch(spark, "t").save(stage(spark, docs, small), name)
        assert docs.columns == documents.columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] > 0
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    expected = brute.components({r.doc_id: r.text for r in docs.collect()}, 5, 80)
    assert all(i == c for i, (_, c) in expected.items())
    pieces = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == kept


def test_pipeline_of_odd_rows(spark, odd, empty, small):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = Scratch(spark, "t").save(stage(spark, docs, small), "x")
        docs.count()


