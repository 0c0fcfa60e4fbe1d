"""Byte-pair merges: learning them from counted chunks, encoding, decoding."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterable, Sequence
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.config import SPLIT_PATTERN
from eventloom.frames import cut

#: Distinct chunks that the driver can learn from; a corpus with more is refused.
MOST_CHUNKS = 5_000_000

Pair = tuple[int, int]


def chunks(text: str | Column, pattern: str = SPLIT_PATTERN) -> Column:
    """The chunks that a pattern matches in a text, in order; what lies between is dropped. The
    flag makes \\s, \\w and case folding those of Unicode, as in the pattern's own dialect."""
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def chunk_counts(texts: DataFrame, text: str = "text", pattern: str = SPLIT_PATTERN) -> DataFrame:
    """``chunk, n``: how often each chunk occurs in all texts."""
    c = texts.select(F.explode(chunks(text, pattern)).alias("chunk"))
    return c.groupBy("chunk").agg(F.count("*").alias("n"))


def pair_counts(counts: DataFrame) -> DataFrame:
    """``left, right, n``: how often two bytes stand side by side in counted chunks."""
    hexes = F.hex(F.encode("chunk", "UTF-8"))
    b = F.transform(F.sequence(F.lit(0), (F.length(hexes) / 2 - 1).cast("int")), lambda i: F.conv(F.substring(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    b = counts.filter(F.length(hexes) >= 4).select("n", b.alias("b"))
    p = b.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.size("b") - 2), lambda i: F.struct(F.get("b", i).alias("left"), F.get("b", i + 1).alias("right")))).alias("p"))
    return p.groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


class _Words:
    """Distinct words as lists of token ids, with the counts of their neighbouring pairs."""

    def __init__(self, words: Iterable[tuple[bytes, int]]):
        self.ids = []
        self.weight = []
        self.count: Counter[Pair] = Counter()
        self.where: dict[Pair, set[int]] = defaultdict(set)
        for word, n in words:
            i = len(self.ids)
            self.ids.append(list(word))
            self.weight.append(n)
            for pair in zip(word, word[1:]):
                self.count[pair] += n
                self.where[pair].add(i)

    def merge(self, pair: Pair, new: int) -> set[Pair]:
        """Replaces a pair from left to right in all words; the pairs whose counts grew."""
        grown: set[Pair] = set()
        for i in self.where.pop(pair, ()):
            ids, n = self.ids[i], self.weight[i]
            out: list[int] = []
            j = 0
            while j < len(ids):
                if ids[j : j + 2] == [*pair]:
                    out.append(new)
                    j += 2
                else:
                    out.append(ids[j])
                    j += 1
            if len(out) == len(ids):
                continue
            was, now = Counter(zip(ids, ids[1:])), Counter(zip(out, out[1:]))
            for p in was.keys() | now.keys():
                if change := now[p] - was[p]:
                    self.count[p] += change * n
                    if change > 0:
                        grown.add(p)
                        self.where[p].add(i)
            self.ids[i] = out
        self.count.pop(pair, None)
        return grown


def learn_merges(words: Iterable[tuple[bytes, int]], vocab_size: int) -> list[Pair]:
    """Merges in order; the k-th makes token 256 + k. The most frequent pair goes first, of equally
    frequent ones the smallest. Stops at ``vocab_size`` tokens (at least 256, else ValueError) or
    when no pair is left."""
    if vocab_size < 256:
        raise ValueError("a vocabulary has at least the 256 bytes")
    state = _Words(words)
    heap = [(-n, p) for p, n in state.count.items() if n > 0]
    heapq.heapify(heap)
    merges: list[Pair] = []
    while heap and len(merges) < vocab_size - 256:
        n, pair = heapq.heappop(heap)
        true = state.count.get(pair, 0)
        if true <= 0:
            continue
        if true != -n:
            heapq.heappush(heap, (-true, pair))
            continue
        merges.append(pair)
        for p in state.merge(pair, 255 + len(merges)):
            heapq.heappush(heap, (-state.count[p], p))
    return merges


def token_bytes(merges: Sequence[Pair]) -> list[bytes]:
    """The bytes of all tokens, in order of id."""
    out = [bytes([b]) for b in range(256)]
    for a, b in merges:
        out.append(out[a] + out[b])
    return out


def train_merges(texts: DataFrame, vocab_size: int, text: str = "text", pattern: str = SPLIT_PATTERN, most_chunks: int = MOST_CHUNKS, sample: float | None = None, seed: int = 0) -> list[Pair]:
    """Merges of a corpus. Chunks are counted where the texts lie; the counted distinct chunks come
    to the driver, where merges are learned one after the other; ValueError for more than
    ``most_chunks``, since merges learned from a part could differ. Null texts count nothing."""
    t = texts.select(F.col(text).alias("t")).filter("t is not null")
    if sample is not None:
        t = t.sample(fraction=sample, seed=seed)
    c = cut(chunk_counts(t, "t", pattern))
    if (n := c.count()) > most_chunks:
        raise ValueError(f"{n} distinct chunks are more than the {most_chunks} that merges can be learned from")
    rows = c.orderBy(F.desc("n"), "chunk").toLocalIterator()
    return learn_merges(((r["chunk"].encode("utf-8"), r["n"]) for r in rows), vocab_size)


def train_from_texts(texts: Iterable[str], vocab_size: int, pattern: str = SPLIT_PATTERN) -> list[Pair]:
    """Merges of texts that come one after the other, without a session; only the counts of their
    distinct chunks are held. Null texts count nothing."""
    split, counts = regex.compile(pattern), Counter()
    for t in texts:
        counts.update(split.findall(t or ""))
    return learn_merges(((c.encode("utf-8"), n) for c, n in sorted(counts.items())), vocab_size)


def ranks(spark: SparkSession, merges: Sequence[Pair]) -> DataFrame:
    """``token_id, bytes``: the bytes of all tokens, the 256 single ones first."""
    return spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(token_bytes(merges))], "token_id long, bytes binary")


class Merger:
    """Encodes chunks with learned merges: always the earliest learned pair, from the left."""

    def __init__(self, merges: Sequence[Pair], pattern: str = SPLIT_PATTERN):
        self.rank = {tuple(p): 256 + k for k, p in enumerate(merges)}
        self.bytes = token_bytes([tuple(p) for p in merges])
        self.pattern = regex.compile(pattern)
        self.chunk = lru_cache(maxsize=200_000)(self._chunk)

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Pairs wait in a heap by rank and place; tokens are a linked list. A merge touches its two
        neighbours only, so n bytes take some n log n steps."""
        ids: list[int] = list(chunk.encode("utf-8"))
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            new, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            # a pair that has changed since it was put in is passed over
            if j >= n or rank.get((ids[i], ids[j])) != new:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((new, ids[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank.get((ids[h], new))) is not None:
                heapq.heappush(heap, (r, h))
        return tuple(x for x in ids if x >= 0)

    @property
    def vocab_size(self) -> int:
        return len(self.bytes)

    def mergeable_ranks(self) -> dict[bytes, int]:
        """The id of each token's bytes, in order of id."""
        return {b: i for i, b in enumerate(self.bytes)}

    def encode(self, text: str) -> list[int]:
        return [i for c in self.pattern.findall(text) for i in self.chunk(c)]

    def decode(self, ids: Iterable[int]) -> str:
        """ValueError for unknown ids, UnicodeDecodeError for bytes that are no UTF-8."""
        out = []
        for i in ids:
            if not 0 <= i < len(self.bytes):
                raise ValueError(f"unknown token id {i}")
            out.append(self.bytes[i])
        return b"".join(out).decode("utf-8")


@lru_cache(maxsize=8)
def _merger(merges: tuple[Pair, ...], pattern: str) -> Merger:
    return Merger(merges, pattern)


def encoder(merges: Sequence[Pair], pattern: str = SPLIT_PATTERN):
    """A column function text -> array of ids. Chunks that repeat are encoded once per worker."""
    fixed = tuple(tuple(p) for p in merges)

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        m = _merger(fixed, pattern)
        return texts.map(lambda t: None if t is None else m.encode(t))

    return encode


def decode_bytes(pieces: Column) -> Column:
    """The text of an array of token bytes, decoded once as a whole."""
    return F.decode(F.unhex(F.array_join(F.transform(pieces, lambda b: F.hex(b)), "")), "UTF-8")
