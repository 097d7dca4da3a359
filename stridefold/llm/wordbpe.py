"""Token ids of whole texts by a tokenizer file whose words never cross white space.

The tokenizer drops white space before it merges, so a text's ids are the ids
of its white-space-separated chunks end to end. A chunk of letters and a tail
of punctuation is in turn the ids of the two, in lower case. Each worker keeps
the bytes and ids of chunks it has met in arrays sorted by the chunk's 64-bit
hash (bounded; the half used last stays), so a block of texts is looked up and
put together by numpy. A hash only finds the place: the bytes are compared, and
a chunk whose hash is another's, or that is too long to be kept, is encoded by
itself. New chunks are split into parts, and new parts go to the tokenizer in
one text, whose answer falls apart at the ids that end a word.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from operator import add

import numpy as np

from stridefold.llm.textkernel import LONG, Block, equal_ranges

KEEP_CHUNKS, KEEP_PARTS = 300_000, 100_000
#: A chunk's letters (ASCII and U+00C0 to U+00FF) and its tail of ASCII punctuation, or a chunk of another make.
#: Nothing after such letters can join with them; an apostrophe is left out, as it can begin a contraction.
_PARTS = re.compile(rb"^((?:[a-z]+|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*+)([!-&(-/:-@\[-`{-~]*+)$|^([^\n]+)$", re.MULTILINE)


def _visible() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte (the space stays, as a separator)."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)} | {32: " "}


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + sizes[i] - 1, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Pool:
    """Byte or id strings end to end, in an array that grows."""

    def __init__(self, kind: str):
        self.data, self.filled = np.zeros(1 << 16, kind), 0
        self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)  # strings of at most LONG bytes, a bounded number of them

    def insert(self, at: np.ndarray, strings: list[bytes]) -> None:
        more = np.frombuffer(b"".join(strings), self.data.dtype)
        sizes = np.array([len(x) for x in strings], np.int64) // self.data.itemsize
        if self.filled + len(more) > len(self.data):
            self.data = np.concatenate([self.data[: self.filled], np.zeros(self.filled + len(more), self.data.dtype)])
        self.data[self.filled : self.filled + len(more)] = more
        self.start, self.size = np.insert(self.start, at, self.filled + np.cumsum(sizes) - sizes), np.insert(self.size, at, sizes)
        self.filled += len(more)

    def keep(self, kept: np.ndarray) -> None:
        self.data = self.data[_ragged(self.start[kept], self.size[kept])]
        self.size, self.filled = self.size[kept], len(self.data)
        self.start = (np.cumsum(self.size) - self.size).astype(np.int32)


class Known:
    """Chunks and their ids, in the order of the chunks' hashes."""

    def __init__(self) -> None:
        self.keys, self.used, self.turn = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0
        self.text, self.ids = Pool("u1"), Pool("<u4")

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the sorted hashes are or belong, and which are there."""
        at = np.searchsorted(self.keys, wanted)
        there = np.zeros(len(wanted), bool)
        inside = at < len(self.keys)
        there[inside] = self.keys[at[inside]] == wanted[inside]
        return at, there

    def insert(self, at: np.ndarray, keys: np.ndarray, chunks: list[bytes], ids: list[bytes]) -> None:
        self.keys, self.used = np.insert(self.keys, at, keys), np.insert(self.used, at, self.turn)
        self.text.insert(at, chunks)
        self.ids.insert(at, ids)

    def trim(self, most: int) -> None:
        """Keep the half that was used last, if there are too many."""
        if len(self.keys) <= most:
            return
        kept = self.used > np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
        self.keys, self.used = self.keys[kept], self.used[kept]
        self.text.keep(kept)
        self.ids.keep(kept)


class WordEncoder:
    """bytes of texts -> bytes of their ids (little-endian, unsigned, 32 bits each)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # control strings inside a text are ordinary text
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words = Tokenizer(self.model.model)  # its merges alone, for words that need no normalising or splitting
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.visible = _visible()
        self.known, self.seed = Known(), int.from_bytes(os.urandom(8))
        self.parts: dict[bytes, bytes] = {}

    def _each(self, words: list[bytes]) -> list[bytes]:
        done = self.model.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in done]

    def _together(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are one word each to the tokenizer."""
        text = b" ".join(words).decode().lower().encode().decode("latin-1").translate(self.visible)
        ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return self._each(words)
        raw, cuts = ids.tobytes(), (4 * cuts).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)]

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of chunks not met before."""
        cores, tails, others = zip(*_PARTS.findall(b"\n".join(chunks).lower()))
        if len(self.parts) > KEEP_PARTS:
            self.parts = {}
        self.parts[b""] = b""
        fresh = list(set(cores).union(tails).difference(self.parts))
        if fresh:
            self.parts.update(zip(fresh, self._together(fresh)))
        part = self.parts.__getitem__
        ids = list(map(add, map(part, cores), map(part, tails)))
        other = [i for i, o in enumerate(others) if o]
        for i, x in zip(other, self._each([chunks[i] for i in other]) if other else ()):
            ids[i] = x
        for x in fresh:
            if len(x) > LONG:  # not kept, as their number alone would not bound the table
                del self.parts[x]
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        raw = b"".join(texts)
        offsets = np.cumsum([0, *map(len, texts)])
        block = Block(np.frombuffer(raw, np.uint8), offsets, 0, len(texts), seed=self.seed)
        keys, first, chunk = np.unique(block.words(), return_index=True, return_inverse=True)
        long = block.end - block.start
        known = self.known
        known.trim(KEEP_CHUNKS)
        known.turn += 1
        at, there = known.find(keys)
        fresh = np.flatnonzero(~there & (long[first] <= LONG))
        if len(fresh):
            new = [raw[a:b] for a, b in zip(block.start[first[fresh]].tolist(), block.end[first[fresh]].tolist())]
            known.insert(at[fresh], keys[fresh], new, self._learn(new))
            at, there = known.find(keys)
        known.used[at[there]] = known.turn
        place, met = at[chunk], there[chunk]
        place[~met] = 0
        met[met] = known.text.size[place[met]] == long[met]
        met[met] = equal_ranges(block.data, block.start[met], known.text.data, known.text.start[place[met]], long[met])
        pool, start, size = known.ids.data, np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        start[met], size[met] = known.ids.start[place[met]], known.ids.size[place[met]]
        alone = np.flatnonzero(~met)
        if len(alone):
            spans = [raw[a:b] for a, b in zip(block.start[alone].tolist(), block.end[alone].tolist())]
            own = {x: i for i, x in enumerate(dict.fromkeys(spans))}
            ids = self._learn(list(own))
            ends = np.cumsum([len(x) // 4 for x in ids])
            which = np.array([own[x] for x in spans])
            size[alone] = np.diff(ends, prepend=0)[which]
            start[alone] = known.ids.filled + ends[which] - size[alone]
            pool = np.concatenate([pool[: known.ids.filled], np.frombuffer(b"".join(ids), "<u4")])
        ids = pool[_ragged(start, size)].tobytes()
        cuts = (4 * np.concatenate([[0], np.cumsum(size)])[block.first]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    """One per worker process and file."""
    return WordEncoder(path)
