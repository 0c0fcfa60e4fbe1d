"""Encoding with the vocabulary of a public byte-level tokenizer, and decoding.

Text is split by the tokenizer's pattern; each piece is encoded by a backtracking encoder. An
Aho-Corasick automaton gives the longest token that matches at a place. A token may follow another
only if the pair is compatible: if merging their bytes from scratch would give the two again, which a
table of the merges tells. Where it is not, the encoder falls back to the next shorter token, or, if
there is none, gives up the token before; places that were given up are not entered again. So the
time is linear in the piece, and the result is exactly that of the merges in order of rank.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.frames import pick

# The pattern of the byte-level vocabularies, as public_tokenizers states it, and
# the place of the vocabulary files (a parameter everywhere).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Pieces whose ids a worker remembers, and the longest such piece in characters.
REMEMBER, SHORT = 400_000, 48


def read_ranks(path: str = VOCABULARY) -> list[bytes]:
    """The tokens of a .tiktoken file in order of rank. Ranks must be 0, 1, 2, ..."""
    pairs = []
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                pairs.append((int(rank), base64.b64decode(token)))
    pairs.sort()
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks are not 0 to {len(pairs) - 1}")
    return [t for _, t in pairs]


#: Later than any merge.
NEVER = 1 << 62


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str = PATTERN):
        self.pattern = regex.compile(pattern)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.length = self.size.tolist()
        self.widest = max(self.length)
        #: Decoding: the bytes of all tokens in a row, and where each begins.
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.offset = np.r_[0, np.cumsum(self.size)]
        self.rank = {t: i for i, t in enumerate(tokens)}
        if len(self.rank) != len(tokens) or any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("a vocabulary needs distinct tokens and all single bytes")
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        #: The next shorter token with which a token begins, or -1.
        self.shorter = [next((self.rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.rank), -1) for t in tokens]
        #: The tokens that end, and that begin, a token while it is put together, in order of their merges.
        self.rights: list[tuple[int, ...]] = []
        self.lefts: list[tuple[int, ...]] = []
        self.merge: dict[tuple[int, int], int] = {}
        for i, t in enumerate(tokens):
            left = self.shorter[i]
            while left >= 0:
                right = self.rank.get(t[self.length[left] :], -1)
                if 0 <= right < i and left < i and self._fit(left, right):
                    break
                left = self.shorter[left]
            if left >= 0:
                self.merge[left, right] = i
                self.rights.append((*self.rights[right], i))
                self.lefts.append((*self.lefts[left], i))
            else:
                self.rights.append((i,))
                self.lefts.append((i,))
        self.known: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _fit(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of a and b together gives a, b.

        Merges happen in order of their ids. While a and b grow, the tokens at their border are those
        on the right spine of a and the left spine of b, each from its own merge until the merge of
        the next. Both spines are walked in that order; where a merge across the border comes
        before the next merge on either side, it happens. Of equal merges the left one comes first.
        """
        left, right = self.rights[a], self.lefts[b]
        i = j = 0
        while True:
            next_left = left[i + 1] if i + 1 < len(left) else NEVER
            next_right = right[j + 1] if j + 1 < len(right) else NEVER
            m = self.merge.get((left[i], right[j]))
            if m is not None and m < next_left and m <= next_right:
                return False
            if next_left == next_right == NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def _compatible(self, a: int, b: int) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            ok = self.pairs[a, b] = self._fit(a, b)
        return ok

    def _longest(self, s: str, at: int) -> int:
        return next(self.automaton.iter_long(s[at : at + self.widest]))[1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        s, end = piece.decode("latin-1"), len(piece)
        closed = bytearray(end + 1)
        out: list[int] = []
        at, token = 0, self._longest(s, 0)
        while at < end:
            stop = at + self.length[token]
            if not closed[stop] and (not out or self._compatible(out[-1], token)):
                out.append(token)
                at = stop
                token = self._longest(s, at) if at < end else -1
                continue
            token = self.shorter[token]
            while token < 0:
                # nothing fits behind the last token: close this place and shorten that token
                closed[at] = 1
                token = out.pop()
                at -= self.length[token]
                token = self.shorter[token]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text; those of the empty text are []. No special tokens: their spellings are
        ordinary text."""
        out: list[int] = []
        known = self.known
        for piece in self.pattern.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode("utf-8"))
                if len(piece) <= SHORT:
                    if len(known) >= REMEMBER:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def decode_bytes(self, ids) -> bytes:
        """The bytes of ids. Raises ValueError for ids that are not in the vocabulary."""
        i = np.asarray(ids, np.int64)
        if len(i) == 0:
            return b""
        if i.min() < 0 or i.max() >= len(self.size):
            raise ValueError(f"unknown token id {int(i.min() if i.min() < 0 else i.max())}")
        n = self.size[i]
        start = np.repeat(self.offset[i] - np.r_[0, np.cumsum(n)[:-1]], n)
        return self.blob[start + np.arange(int(n.sum()))].tobytes()

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _codec(tokens: tuple[bytes, ...], pattern: str) -> Codec:
    return Codec(list(tokens), pattern)


class Shared:
    """A codec for the tasks: the vocabulary is read once, where the query is built, and sent to the
    executors (under 1 MB for the public vocabularies, at most MOST bytes), so that they need no
    file; each worker process builds the tables once."""

    MOST = 64_000_000

    def __init__(self, spark, path: str = VOCABULARY, pattern: str = PATTERN):
        tokens = tuple(read_ranks(path))
        if sum(map(len, tokens)) > self.MOST:
            raise ValueError(f"{path} is larger than {self.MOST} bytes")
        self.tokens, self.pattern = spark.sparkContext.broadcast(tokens), pattern

    def get(self) -> Codec:
        return _codec(self.tokens.value, self.pattern)


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The token ids of each text: ``key, ids`` (array of int), without special tokens.

    Null and empty texts have the ids []. Rows come out one for one, repeats included; other
    columns are ignored. Nothing is shuffled; a text of any length is encoded whole, in linear time.
    """
    shared = Shared(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.get()
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.encode(t) if t else [] for t in texts], pa.list_(pa.int32()))], names=["_k", "ids"])

    d = pick(documents, key, text).toDF("_k", "_t")
    return d.mapInArrow(run, f"_k {d.schema['_k'].dataType.simpleString()}, ids array<int>").withColumnRenamed("_k", key)


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The number of tokens of each text: ``key, n_tokens``; 0 for null and empty texts."""
    shared = Shared(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.get()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.count(t) if t else 0 for t in b.column(1).to_pylist()], pa.int64())], names=["_k", "n_tokens"])

    d = pick(documents, key, text).toDF("_k", "_t")
    return d.mapInArrow(run, f"_k {d.schema['_k'].dataType.simpleString()}, n_tokens long").withColumnRenamed("_k", key)


def decoded(encodings: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """The text of each array of ids: ``key, text``; null for null. An id outside the vocabulary
    fails the task with ValueError."""
    shared = Shared(encodings.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.get()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if i is None else codec.decode(i) for i in b.column(1).to_pylist()], pa.string())], names=["_k", "text"])

    d = pick(encodings, key, ids).toDF("_k", "_i").withColumn("_i", F.col("_i").cast("array<int>"))
    return d.mapInArrow(run, f"_k {d.schema['_k'].dataType.simpleString()}, text string").withColumnRenamed("_k", key)
