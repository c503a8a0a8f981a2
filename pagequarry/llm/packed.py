"""Keyed exchanges of 64-bit values as packed arrays.

Texts are dealt to chunks of bounded size by a hash of id and text. For every key that its
texts contain, a chunk sends one entry (repeats inside the chunk are merged first, so a very
frequent key costs each chunk one entry and no task more), packed by bucket into binary
rows. Buckets are ranges of the key's top bits, so they are even, and hold a bounded number
of bytes each. A bucket answers each chunk in the order in which it asked, so answers carry
no keys. Nothing depends on the order in which rows arrive: a lost task is simply run again.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm.common import U64, as_bytes, release

MESSAGES = "bucket long, chunk long, body binary"
ANSWERS = "level long, bucket long, chunk long, body binary"


#: Input from which on chunks and buckets grow with its square root.
STEADY_BYTES = 64 << 30


def task_bytes(spark: SparkSession) -> int:
    """Memory of an executor for each of its cores, as it is configured."""
    conf = spark.sparkContext.getConf()
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get("spark.executor.memory", "1g"))
    return int(size) // max(1, int(conf.get("spark.executor.cores", "1")))


def growth(spark: SparkSession, least: int, total: int) -> float:
    """How many times larger chunks of ``least`` bytes, and buckets, should be for ``total`` bytes of input.

    Messages are as many as chunks times buckets, so both grow to keep messages filled, as
    far as a task's memory allows: a chunk needs about 24 times its bytes.
    """
    return max(1.0, min(math.sqrt(total / STEADY_BYTES), task_bytes(spark) / 24 / least))


def text_bytes(keyed: DataFrame) -> int:
    return keyed.agg(F.sum(F.octet_length("text") + 24)).first()[0] or 0


def dealt(keyed: DataFrame, chunk_bytes: int, size: int | None = None) -> tuple[DataFrame, int]:
    """``keyed`` with its chunk, and the number of chunks for texts of ``chunk_bytes`` each on average."""
    n = max(1, math.ceil((text_bytes(keyed) if size is None else size) / chunk_bytes))
    return keyed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))), n


def bucket_count(entries: float, per_bucket: int = 1 << 20) -> int:
    """A power of two, so that buckets are ranges of the keys' top bits."""
    return 1 << max(4, math.ceil(math.log2(max(1.0, entries / per_bucket))))


def own_order(chunk: pa.Table) -> list[int]:
    """A chunk's rows in an order of their own, by id and text, whatever order they came in; null ids last."""
    ids, texts = chunk.column("doc_id").to_pylist(), as_bytes(chunk.column("text"))
    return sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))


def in_order(chunk: pa.Table) -> tuple[int, list, list[bytes]]:
    """Chunk number, ids and texts in the chunk's own order."""
    ids, texts, order = chunk.column("doc_id").to_pylist(), as_bytes(chunk.column("text")), own_order(chunk)
    return chunk.column("chunk")[0].as_py(), [ids[i] for i in order], [texts[i] for i in order]


def pack(*arrays: np.ndarray) -> bytes:
    """Equally long arrays as compressed bytes."""
    return zlib.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def unpack(body: bytes, *kinds) -> list[np.ndarray]:
    raw = zlib.decompress(body)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n = len(raw) // sum(sizes)
    out, at = [], 0
    for k, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, dtype=k, count=n, offset=at))
        at += n * size
    return out


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on as compressed planes of bytes, only as many as the largest number needs."""
    heads, planes = [], []
    for a in arrays:
        a = np.ascontiguousarray(a, dtype="<u8")
        width = -(-int(a.max(initial=0)).bit_length() // 8)
        heads.append(struct.pack("<IB", len(a), width))
        planes += [np.ascontiguousarray(plane).tobytes() for plane in a.view(np.uint8).reshape(-1, 8).T[:width]]
    raw = b"".join([bytes([len(arrays)]), *heads, *planes])
    return struct.pack("<I", len(raw)) + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def expand(body: bytes) -> list[np.ndarray]:
    """The arrays that squeeze() was given, as 64-bit whole numbers without a sign."""
    raw = pa.Codec("zstd").decompress(body[4:], decompressed_size=struct.unpack("<I", body[:4])[0], asbytes=True)
    heads = [struct.unpack_from("<IB", raw, 1 + 5 * i) for i in range(raw[0])]
    out, at = [], 1 + 5 * raw[0]
    for n, width in heads:
        wide = np.zeros((n, 8), dtype=np.uint8)
        for i, plane in enumerate(np.frombuffer(raw, np.uint8, count=n * width, offset=at).reshape(width, n)):
            wide[:, i] = plane
        out.append(wide.view("<u8").reshape(n))
        at += n * width
    return out


def by_bucket(keys: np.ndarray, buckets: int):
    """(bucket, lo, hi) of sorted keys."""
    bits = buckets.bit_length() - 1
    at = (keys >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cut = np.flatnonzero(np.diff(at)) + 1
    bounds = np.concatenate([[0], cut, [len(at)]])
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        if hi > lo:
            yield int(at[lo]), int(lo), int(hi)


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table(
        {
            "bucket": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([r[1] for r in rows], pa.int64()),
            "body": pa.array([r[2] for r in rows], pa.binary())
        }
    )


def received(bucket: pa.Table) -> list[tuple[int, bytes]]:
    """(chunk, body) of a bucket's or a chunk's messages, in the order of their senders."""
    return sorted(zip(bucket.column("chunk").to_pylist(), bucket.column("body").to_pylist(), strict=True))


def told(bucket: pa.Table, level: int, got: list[tuple[int, bytes]], bodies: list[bytes]) -> pa.Table:
    number = bucket.column("bucket")[0].as_py()
    return pa.table(
        {
            "level": pa.array([level] * len(got), pa.int64()), "bucket": pa.array([number] * len(got), pa.int64()),
            "chunk": pa.array([c for c, _ in got], pa.int64()), "body": pa.array(bodies, pa.binary())
        }
    )


def pack_keys(keys: np.ndarray, several: np.ndarray) -> bytes:
    """48 bits of each key and one bit of flag; a bucket is known by the bits above."""
    return len(keys).to_bytes(4, "little") + np.ascontiguousarray(
        keys.view(np.uint8).reshape(-1, 8)[:, :6]
    ).tobytes() + np.packbits(several).tobytes()


def unpack_keys(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(body[:4], "little")
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(body, np.uint8, count=6 * n, offset=4).reshape(n, 6)
    return wide.view(U64).reshape(n), np.unpackbits(np.frombuffer(body, np.uint8, offset=4 + 6 * n), count=n).astype(bool)


def answer_keys(level: int):
    """A bit for each key that was asked: in several documents, as chunks share no document."""

    def run(bucket: pa.Table) -> pa.Table:
        release()
        got = received(bucket)
        parts = [unpack_keys(body) for _, body in got]
        distinct, rank, count = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True, return_counts=True)
        several = np.zeros(len(distinct), dtype=bool)
        several[rank[np.concatenate([p[1] for p in parts])]] = True
        yes = ((count > 1) | several)[rank]
        bounds = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        return told(bucket, level, got, [np.packbits(yes[lo:hi]).tobytes() for lo, hi in zip(bounds, bounds[1:], strict=False)])

    return run


def split_levels(replies: pa.Table | None) -> dict[int, list[tuple[int, bytes]]]:
    """A chunk's answers by level: (bucket, body)."""
    out: dict[int, list[tuple[int, bytes]]] = {}
    if replies is not None:
        for level, bucket, body in zip(
            replies.column("level").to_pylist(), replies.column("bucket").to_pylist(), replies.column("body").to_pylist(),
            strict=True
        ):
            out.setdefault(level, []).append((bucket, body))
    return out
