"""Different texts stay different, whatever their hashes: long words and lines, and hashes that collide on purpose."""

import brute
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stridefold.llm import wordbpe
from stridefold.llm.minhash import near_duplicates
from stridefold.llm.packing import pack
from stridefold.llm.quality import BASE_RULES, quality
from stridefold.llm.rollup import count_tokens
from stridefold.llm.textkernel import Block, blocks, equal_ranges

WORD_BPE = P.path("word_bpe_49k.json")
SWAP = str.maketrans("ab", "ba")


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(SWAP)
    return word


PAIRS = [(thue_morse(n), thue_morse(n).translate(SWAP)) for n in (64, 256, 257, 1024, 2048, 4096)]
TEXTS = [t for pair in PAIRS for t in pair] + [f"{a}\n{b}\n{a}\n" for a, b in PAIRS] + [f"x {a} y x {b} y x {a} y" for a, b in PAIRS]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "'s' as source", "'l' as lang").persist()


@pytest.fixture(scope="module")
def model():
    t = Tokenizer.from_file(WORD_BPE)
    return [t.encode(x, add_special_tokens=False).ids for x in TEXTS]


def test_links_and_counts(texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(texts, shingle=3, percent=85).collect()}
    assert got == brute.components(dict(enumerate(TEXTS)), 3, 85)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in quality(texts, measured=names, base=BASE_RULES).collect():
        assert tuple(r[n] for n in names) == brute.counts(TEXTS[r.doc_id])


def test_ids_and_counts_of_tokens(texts, model):
    assert {r.doc_id: r.n_bpe for r in count_tokens(texts, WORD_BPE).collect()} == {i: len(x) for i, x in enumerate(model)}
    ids = {i: [None] * (len(x) + 1) for i, x in enumerate(model)}
    for p in pack(texts, WORD_BPE).collect():
        ids[p.doc_id][p.start : p.start + p.length] = np.frombuffer(p.ids, "<u4").tolist()
    assert ids == {i: [*x, 1] for i, x in enumerate(model)}


def test_colliding_hashes(monkeypatch, model):
    """With five bits of a hash every block has collisions: ids, word numbers and counts stay right."""
    whole = Block.hashes
    monkeypatch.setattr(Block, "hashes", lambda self, start, end: whole(self, start, end) & np.uint64(31))
    monkeypatch.setattr(wordbpe, "KEEP_CHUNKS", 20)
    encoder = wordbpe.WordEncoder(WORD_BPE)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in TEXTS])] == model
    words = [f"w{i % 300}" for i in range(1000)]
    (block,) = blocks(pa.array([" ".join(words)]))
    number, count = block.identities(block.start, block.end)
    assert count == 300 and len(set(zip(words, number.tolist()))) == 300
    from stridefold.llm.quality import COUNTS

    text = "\n".join(words[:400]) + "\nw1 w2 w3\nw1 w2 w3"
    (block,) = blocks(pa.array([text]))
    assert tuple(int(COUNTS[n](block)[0]) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute.counts(text)


def test_equal_ranges_and_seeds():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 2, 5000, dtype=np.uint8)
    a, b, n = rng.integers(0, 4000, 3000), rng.integers(0, 4000, 3000), rng.choice([0, 1, 3, 7, 8, 9, 12, 300], 3000)
    raw = data.tobytes()
    assert equal_ranges(data, a, data, b, n).tolist() == [raw[x : x + k] == raw[y : y + k] for x, y, k in zip(a, b, n)]
    assert equal_ranges(data, a, data, a, n).all()
    first, second = (next(blocks(pa.array(["one two " + "x" * 600]), seed=s)).words() for s in (1, 2**64 - 1))
    assert not (first == second).any()
