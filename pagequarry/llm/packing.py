"""Operator 5, packing into fixed windows by Karmarkar-Karp multiway differencing.

Each document is cut into full windows and a remainder, and the remainder into equal pieces
of at most a quarter of a window, so that windows hold several pieces and can be made even.
``GROUP`` such pieces at a time are dealt to the least number of windows that could hold them:
differencing keeps partial partitions in a heap by imbalance and merges the two worst, the
fullest part of one with the emptiest of the other, which leaves windows of nearly equal
length. If the fullest still exceeds the capacity, the number of windows rises and the group
is dealt again. A task packs its own documents as it reads them: no shuffle, and no more in
memory than one group.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import as_bytes, release, slices, table

CAPACITY = 2048
GROUP = 2048
#: Bytes of text that are tokenized at once.
ENCODE_BYTES = 2 << 20
END_ID = 1

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], parts: int) -> list[list[int]]:
    """Indexes of ``sizes`` in ``parts`` parts of nearly equal sums.

    A partial partition is its nonzero parts, smallest first, as (sum, members); the parts
    that are missing are empty. Members are nested pairs, flattened at the end.
    """
    heap = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [(size, i)]))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = a + b if len(a) + len(b) <= parts else _opposed(a, b, parts)
        merged.sort(key=_sum)
        low = merged[0][0] if len(merged) == parts else 0
        heapq.heappush(heap, (low - merged[-1][0], tie, merged))
        tie += 1
    found: list[list[int]] = []
    for _, tree in heap[0][2] if heap else []:
        found.append(_members(tree))
    return found


def _opposed(a: list, b: list, parts: int) -> list:
    """a's parts from the emptiest up against b's from the fullest down, missing parts counting as empty."""
    up = [None] * (parts - len(a)) + a
    down = b[::-1] + [None] * (parts - len(b))
    return [y if x is None else x if y is None else (x[0] + y[0], (x[1], y[1])) for x, y in zip(up, down, strict=True)]


def _sum(part: tuple) -> int:
    return part[0]


def _members(tree) -> list[int]:
    out, stack = [], [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(x)
        else:
            out.append(x)
    return sorted(out)


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """``sizes`` in as few near-equal windows as differencing fits within ``capacity``."""
    parts = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, parts)
        if max((sum(sizes[i] for i in w) for w in found), default=0) <= capacity:
            return found
        parts += 1


class Packer:
    """Rows of pieces; remainders wait until there are ``group`` of them."""

    def __init__(self, capacity: int, group: int, first_sequence: int):
        self.capacity, self.group, self.next = capacity, group, first_sequence
        self.rows: list[tuple] = []
        self.waiting: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        """``ids`` are a document's, with its end."""
        total = len(ids)
        whole = total - total % self.capacity
        cuts = list(range(0, whole, self.capacity))
        if rest := total - whole:
            n = -(-rest // max(1, self.capacity // 4))
            cuts += [whole + rest * i // n for i in range(n)]
        for start, end in zip(cuts, [*cuts[1:], total], strict=True):
            piece = ids[start:end]
            row = (doc_id, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), total, piece)
            if len(piece) == self.capacity:
                self.place(row, 0)
                self.next += 1
            else:
                self.waiting.append(row)
        if len(self.waiting) >= self.group:
            self.flush()

    def place(self, row: tuple, offset: int) -> None:
        self.rows.append((*row[:5], self.next, offset, row[5]))

    def flush(self) -> None:
        for window in windows([row[2] for row in self.waiting], self.capacity) if self.waiting else []:
            offset = 0
            for i in window:
                self.place(self.waiting[i], offset)
                offset += self.waiting[i][2]
            self.next += 1
        self.waiting = []

    def take(self, with_ids: bool) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        arrays = [pa.array([r[i] for r in self.rows], pa.int64()) for i in range(7)]
        if with_ids:
            arrays.append(pa.array([r[7] for r in self.rows], pa.list_(pa.int64())))
            names.append("ids")
        self.rows = []
        return pa.RecordBatch.from_arrays(arrays, names=names)


def pack_documents(
    documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, group: int = GROUP, id_col: str = "doc_id",
    text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``capacity`` tokens.

    A document's ids are the tokenizer's, without special tokens, and then 1. Returns one
    row per piece: doc_id, start (ids of the document before it), length, ids_crc32 (of the
    ids as little-endian 32-bit words), doc_tokens, sequence_id, offset in the sequence, and
    with ``with_ids`` the ids. Null and empty texts are the one end id. Ids that are null or
    repeat are kept as they are; each row is a document of its own. Sequences are whole
    within one task, numbered by task and order. An empty table gives no rows. ``tokenizer``
    is a file of a public word-level BPE tokenizer; the driver reads it and broadcasts its
    few MB. A text is tokenized in slices of whole texts, so memory is bounded by a slice or
    the longest text. Other columns are not read.
    """
    with open(tokenizer, encoding="utf-8") as file:
        spec = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        from pagequarry.llm.wordbpe import WordBpe

        release()
        packer, bpe = Packer(capacity, group, TaskContext.get().partitionId() << 36), None
        for batch in batches:
            bpe = bpe or WordBpe(spec.value)
            ids, texts = batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))
            for lo, hi in slices(texts, ENCODE_BYTES):
                found, at = bpe.encode(texts[lo:hi])
                for d in range(hi - lo):
                    packer.add(ids[lo + d], np.append(found[at[d] : at[d + 1]], np.uint32(END_ID)))
                yield packer.take(with_ids)
        packer.flush()
        yield packer.take(with_ids)

    source = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(run, SCHEMA + (", ids array<long>" if with_ids else ""))


def tokenizer_path() -> str:
    """The public word-level BPE vocabulary that the box offers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens; see pack_documents()."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
