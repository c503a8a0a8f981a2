"""Byte-level text helpers that run inside Arrow batches, shared by the operators.

A slice of texts is one byte array with a separator after each text. Words get 64-bit hashes
eight bytes at a time, in two independent lanes where 128 bits decide; grams of words are
hashed by joining the hashes of two shorter grams, which doubles their length each time.
Grams of bytes, whose hits are always verified, use prefix sums of a polynomial hash.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Text bytes handled at once; a longer single text is its own slice.
SLICE_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: Longer words are hashed by xxh3_128, shorter ones eight bytes at a time.
BLOCK_WORD = 128
#: Odd multipliers of the two lanes.
LANES = (U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93))
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x20\x09-\x0D]+.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give back what earlier groups of a reused Python worker have left in its allocators."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c_0, c_1, ..., as functions of batches don't take every name."""
    return df.select(*(named(c).alias(f"c_{i}") for i, c in enumerate(df.columns)))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under its own names, so other columns cannot clash."""
    return df.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))


def power(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        have = np.empty(size, dtype=U64)
        have[0] = 1
        have[1:] = U64(base)
        have = np.cumprod(have, dtype=U64)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that equal hashes stay equal and all bits depend on all bits."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def byte_grams(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each position on: quick, but texts can be made that collide, so hits must be verified."""
    m = len(data) + 1 - n
    if m <= 0:
        return np.empty(0, dtype=U64)
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * power(len(data)), out=sums[1:])
    return mix((sums[n:] - sums[:m]) * power(len(sums), _INVERSE)[:m])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end).

    Up to BLOCK_WORD bytes each step is a bijection of what it reads, so spans of one length
    of at most eight bytes never collide; two lanes together are 128 bits. Longer spans take
    their half of xxh3_128.
    """
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    odd = LANES[lane]
    h = mix(size.astype(U64) * odd + U64(lane))
    at = np.flatnonzero((size > 0) & (size <= BLOCK_WORD))
    whole = len(at) == len(size)
    done = 0
    while len(at):
        part = blocks[(starts if whole else starts[at]) + done]
        left = (size if whole else size[at]) - done
        part = part & (~U64(0) >> (U64(64) - U64(8) * np.minimum(left, 8).astype(U64)))
        if whole:
            h = mix(h ^ part * odd)
        else:
            h[at] = mix(h[at] ^ part * odd)
        done += 8
        more = left > 8
        at, whole = at[more], False
    for i in np.flatnonzero(size > BLOCK_WORD).tolist():
        both = xxhash.xxh3_128_intdigest(data[starts[i] : ends[i]].tobytes())
        h[i] = U64(both >> 64 if lane else both & 0xFFFFFFFFFFFFFFFF)
    return h


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span has the bytes of the span numbered ``other``."""
    size = ends - starts
    same = size == size[other]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    at = np.flatnonzero(same & (size > 0) & (size <= BLOCK_WORD))
    done = 0
    while len(at):
        used = ~U64(0) >> (U64(64) - U64(8) * np.minimum(size[at] - done, 8).astype(U64))
        same[at] &= (blocks[starts[at] + done] ^ blocks[starts[other[at]] + done]) & used == 0
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(same & (size > BLOCK_WORD)).tolist():
        j = other[i]
        same[i] = i == j or np.array_equal(data[starts[i] : ends[i]], data[starts[j] : ends[j]])
    return same


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct span and every one's number among them; equal numbers mean equal bytes.

    Spans of one hash and other bytes than the first of it stay by themselves, so a span may
    be listed twice, but never for another.
    """
    _, first, rank = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    alone = np.flatnonzero(~same_spans(data, starts, ends, first[rank])) if len(rank) else rank
    rank[alone] = len(first) + np.arange(len(alone))
    return np.concatenate([first, alone]), rank


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two grams by theirs; neither place nor order cancels out."""
    return mix(mix(left ^ LANES[0]) + right * LANES[1])


def every_gram(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on, by doubling: a gram is two shorter ones that may overlap."""
    have = 1
    while have < n:
        step = min(have, n - have)
        if len(hashes) <= step:
            return np.empty(0, dtype=U64)
        hashes = joined(hashes[: len(hashes) - step], hashes[step:])
        have += step
    return hashes


def as_bytes(column) -> list[bytes]:
    """Values of a string column as UTF-8 bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES):
    """Ranges [lo, hi) of texts of about ``limit`` bytes, at least one text each."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


class Words:
    """Words of a few texts: byte spans, hashes, and which text each word belongs to."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray, lower: bool):
        self.raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        self.data = LOWER[self.raw] if lower else self.raw
        inside = np.zeros(len(self.data) + 2, dtype=np.int8)
        inside[1:-1] = is_word[self.data]
        change = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.text_starts = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.starts, self.text_starts)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def hashes(self, lane: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, lane)

    def word_bytes(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def covered(n: int, starts: np.ndarray, length) -> np.ndarray:
    """Which of n places lie in some [start, start + length)."""
    depth = np.zeros(n + 1, dtype=np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, np.minimum(starts + length, n), -1)
    return np.cumsum(depth[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
