"""Operator 1, benchmark decontamination by a broadcast hash set of normalised n-grams.

The benchmark's n-grams are gathered once, on the executors, and counted. As long as they fit
the checked size they are broadcast as sorted hashes with their words, and documents are
scanned where they lie, without a shuffle: hashes of all word windows are looked up in a bitmap
and then in the hashes, and each hit is verified on the words themselves. A larger benchmark
is broadcast as a bitmap of fixed size alone; the few windows that pass it are joined with the
n-grams by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm.common import U64, Words, as_bytes, covered, every_gram, keyed, numbered, release, runs, slices, table
from pagequarry.session import settle

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True
#: N-grams, and bytes of their words and items, that are broadcast at most.
BROADCAST_GRAMS, BROADCAST_BYTES = 500_000, 64 << 20
#: Bits of the bitmap that is broadcast beyond that (8 MB), and parts into which a frequent n-gram's windows are dealt.
BITMAP_BITS, SALTS = 26, 16

GRAMS = "gram binary, size int, item string"
FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:long,end:long>>, clean_text string"
SCHEMA = f"doc_id long, {FOUND}"
CANDIDATES = "array<struct<at:int,size:int,gram:binary>>"


def grams_of(benchmark: DataFrame, n: int, item_col: str, item_text_col: str) -> DataFrame:
    """(gram, size, items): the distinct windows of all items, words joined by a space, with the sorted ids of the items that hold them.

    A window has n words, or all of an item that has fewer but not none.
    """

    def run(batches):
        for batch in batches:
            release()
            grams, sizes, items = [], [], []
            for item, text in zip(batch.column("item").to_pylist(), as_bytes(batch.column("text")), strict=True):
                words = Words([text], WORD_BYTES, lower=True)
                listed = [words.word_bytes(i) for i in range(len(words.starts))]
                size = min(n, len(listed))
                own = {b" ".join(listed[i : i + size]) for i in range(len(listed) - size + 1)} if listed else ()
                grams += own
                sizes += [size] * len(own)
                items += [item] * len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams, pa.binary()), pa.array(sizes, pa.int32()), pa.array(items, pa.string())],
                names=["gram", "size", "item"]
            )

    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    return items.mapInArrow(run, GRAMS).groupBy("gram", "size").agg(F.sort_array(F.collect_set("item")).alias("items"))


@dataclass
class GramIndex:
    """Windows by their number of words: a bitmap and sorted hashes to find them, the words to verify them, and their items."""

    texts: bytes
    ends: np.ndarray
    items: list[str]
    item_ends: np.ndarray
    item_numbers: np.ndarray
    #: By size: sorted hashes and the windows' numbers.
    by_size: dict[int, tuple[np.ndarray, np.ndarray]]
    bitmaps: dict[int, np.ndarray] = field(default_factory=dict)

    BITS = 22

    @classmethod
    def of(cls, grams: pa.Table) -> GramIndex:
        texts, sizes = grams.column("gram").to_pylist(), grams.column("size").to_numpy()
        listed = grams.column("items").to_pylist()
        names = sorted({i for own in listed for i in own})
        number = {name: k for k, name in enumerate(names)}
        by_size = {}
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            own = [texts[i] for i in at.tolist()]
            hashes = []
            for lo, hi in slices(own):
                words = Words(own[lo:hi], WORD_BYTES, lower=False)
                hashes.append(every_gram(words.hashes(), size)[words.first[:-1]])
            hashes = np.concatenate(hashes)
            by = np.argsort(hashes, kind="stable")
            by_size[size] = hashes[by], at[by]
        ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
        item_ends = np.cumsum([len(own) for own in listed]).astype(np.int64)
        return cls(b"".join(texts), ends, names, item_ends, np.array([number[i] for own in listed for i in own], dtype=np.int32), by_size)

    def bitmap(self, size: int) -> np.ndarray:
        """Made where it is used, and not sent."""
        if size not in self.bitmaps:
            self.bitmaps[size] = np.zeros(1 << self.BITS, dtype=bool)
            self.bitmaps[size][self.by_size[size][0] >> U64(64 - self.BITS)] = True
        return self.bitmaps[size]

    def items_of(self, gram: int) -> list[str]:
        lo = self.item_ends[gram - 1] if gram else 0
        return [self.items[i] for i in self.item_numbers[lo : self.item_ends[gram]].tolist()]

    def hits(self, words: Words):
        """(first word, number of words, items) of each verified occurrence of a window inside one text."""
        own = words.hashes()
        for size, (hashes, numbers) in self.by_size.items():
            found = every_gram(own, size)
            at = np.flatnonzero(self.bitmap(size)[found >> U64(64 - self.BITS)])
            at = at[words.doc[at] == words.doc[at + size - 1]]
            first, last = np.searchsorted(hashes, found[at], "left"), np.searchsorted(hashes, found[at], "right")
            for k in np.flatnonzero(last > first).tolist():
                i = int(at[k])
                gram = b" ".join(words.word_bytes(j) for j in range(i, i + size))
                for number in numbers[first[k] : last[k]].tolist():
                    if self.texts[
                        self.ends[number] - len(gram) : self.ends[number]
                    ] == gram and self.ends[number] - (self.ends[number - 1] if number else 0) == len(gram):
                        yield i, size, self.items_of(number)


class Sieve:
    """A bitmap of the hashes of all windows, for benchmarks beyond the broadcast size: what passes may be a hit."""

    def __init__(self, bits: np.ndarray, sizes: list[int]):
        self.bits, self.sizes = bits, sizes

    def candidates(self, words: Words):
        """(first word, number of words, the words) of each window that may be one of the benchmark's."""
        own = words.hashes()
        for size in self.sizes:
            found = every_gram(own, size) >> U64(64 - BITMAP_BITS)
            at = np.flatnonzero(self.bits[(found >> U64(3)).astype(np.int64)] >> (found & U64(7)).astype(np.uint8) & 1)
            for i in at[words.doc[at] == words.doc[at + size - 1]].tolist():
                yield i, size, b" ".join(words.word_bytes(j) for j in range(i, i + size))


def sieve_of(grams: DataFrame) -> Sieve:
    """Bits are set on the executors; the driver joins a bounded number of bitmaps, one after another."""

    def run(batches):
        bits = np.zeros(1 << BITMAP_BITS - 3, dtype=np.uint8)
        for batch in batches:
            for size, own in by_size(batch):
                for lo, hi in slices(own):
                    words = Words(own[lo:hi], WORD_BYTES, lower=False)
                    found = every_gram(words.hashes(), size)[words.first[:-1]] >> U64(64 - BITMAP_BITS)
                    np.bitwise_or.at(bits, (found >> U64(3)).astype(np.int64), np.uint8(1) << (found & U64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([pa.compress(bits.tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["bits"])

    def by_size(batch):
        sizes, texts = np.asarray(batch.column("size")), batch.column("gram").to_pylist()
        for size in np.unique(sizes).tolist():
            yield size, [texts[i] for i in np.flatnonzero(sizes == size).tolist()]

    bits = np.zeros(1 << BITMAP_BITS - 3, dtype=np.uint8)
    for row in grams.select("gram", "size").coalesce(64).mapInArrow(run, "bits binary").toLocalIterator():
        bits |= np.frombuffer(pa.decompress(bytes(row[0]), len(bits), codec="zstd", asbytes=True), np.uint8)
    return Sieve(bits, sorted(r[0] for r in grams.select("size").distinct().collect()))


def scan(hits: Callable, texts: list[bytes]):
    """(n_words, items, hit byte spans, hit words) of each text; ``hits`` finds windows among words."""
    for lo, hi in slices(texts):
        words = Words(texts[lo:hi], WORD_BYTES, lower=True)
        hit = list(hits(words)) if len(words.starts) else []
        by_doc: dict[int, list] = {}
        for i, size, items in hit:
            by_doc.setdefault(int(words.doc[i]), []).append((i, size, items))
        for d in range(hi - lo):
            yield summed(words, d, by_doc.get(d, []))


def summed(words: Words, d: int, hit: list[tuple]) -> tuple[int, set, list[tuple[int, int]], int]:
    """What the hits of text ``d`` add up to; they start at words of the whole slice."""
    if not hit:
        return int(words.counts[d]), set(), [], 0
    first, last = words.first[d], words.first[d + 1]
    starts, sizes = np.array([h[0] for h in hit], dtype=np.int64) - first, np.array([h[1] for h in hit], dtype=np.int64)
    mask = covered(int(last - first), starts, sizes)
    begin, end = words.starts[first:last] - words.text_starts[d], words.ends[first:last] - words.text_starts[d]
    spans = [(int(begin[s]), int(end[e - 1])) for s, e in zip(*runs(mask), strict=True)]
    return int(words.counts[d]), {i for h in hit for i in h[2] if i is not None}, spans, int(mask.sum())


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def columns(texts: list[bytes], valid: list[bool], found) -> list[pa.Array]:
    """The columns of FOUND."""
    out: list[list] = [[] for _ in range(8)]
    for text, ok, (n_words, ids, spans, n_hit) in zip(texts, valid, found, strict=True):
        listed = sorted(ids)
        clean = without(text, spans).decode() if ok else None
        row = (
            n_words, n_hit, len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), n_hit > 0, listed,
            [{"start": s, "end": e} for s, e in spans], clean
        )
        for column, value in zip(out, row, strict=True):
            column.append(value)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), spans_type, pa.string())
    return [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]


NAMES = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans", "clean_text"]


def index_or_grams(benchmark: DataFrame, n: int, item_col: str, item_text_col: str, limits: tuple[int, int]):
    """The windows as a broadcast index, or as a written table where they exceed the limits."""
    grams = settle(grams_of(benchmark, n, item_col, item_text_col), "benchmark-grams")
    size = F.octet_length("gram") + F.coalesce(F.aggregate("items", F.lit(0), lambda total, i: total + F.octet_length(i) + 4), F.lit(0))
    count, total = grams.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if count <= limits[0] and total <= limits[1]:
        return benchmark.sparkSession.sparkContext.broadcast(GramIndex.of(grams.toArrow())), None
    return None, grams


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", limits: tuple[int, int] = (BROADCAST_GRAMS, BROADCAST_BYTES),
) -> DataFrame:
    """Which words of each document lie in an occurrence of a benchmark window.

    A window is n consecutive words of an item, or the whole item if it has fewer but not
    none. Returns one row per input row: doc_id, n_words, n_hit, n_items, items_sha256 (of
    the distinct item ids, sorted as strings and comma-joined), contaminated, items, spans
    (byte ranges of the hit runs) and clean_text (the text without them). Null text or item
    text has no words; an item whose id is null marks words but is not counted; items may
    repeat, also under one id; without items nothing is hit, and without documents there are
    no rows; other columns are not read. Texts are scanned a slice at a time and whole, so
    memory is bounded by a slice or the longest text. ``limits`` are the n-grams and bytes up
    to which the benchmark is broadcast.
    """
    index, grams = index_or_grams(benchmark, n, item_col, item_text_col, limits)
    source = keyed(documents, id_col, text_col)
    if index is None:
        return joined_hits(source, grams)

    def batches(rows):
        for batch in rows:
            release()
            texts = as_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns(texts, batch.column("text").is_valid().to_pylist(), scan(index.value.hits, texts))],
                names=["doc_id", *NAMES]
            )

    return source.mapInArrow(batches, SCHEMA)


def with_candidates(rows: DataFrame, grams: DataFrame, text_col: str) -> DataFrame:
    """``rows`` written with a number of their own and the windows that pass the sieve, as columns o1_row and o1_windows."""
    sieve = rows.sparkSession.sparkContext.broadcast(sieve_of(grams))
    kind = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("gram", pa.binary())]))

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            release()
            found: list[list] = []
            texts = as_bytes(batch.column(text_col))
            for lo, hi in slices(texts):
                words = Words(texts[lo:hi], WORD_BYTES, lower=True)
                own: list[list] = [[] for _ in range(hi - lo)]
                for i, size, gram in sieve.value.candidates(words) if len(words.starts) else ():
                    own[words.doc[i]].append({"at": int(i - words.first[words.doc[i]]), "size": size, "gram": gram})
                found += own
            arrays = [*batch.columns, pa.array(range(row, row + len(texts)), pa.int64()), pa.array(found, kind)]
            row += len(texts)
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "o1_row", "o1_windows"])

    own = T.StructType.fromDDL(f"o1_row long, o1_windows {CANDIDATES}")
    return settle(rows.mapInArrow(run, T.StructType([*rows.schema.fields, *own.fields])), "benchmark-candidates")


def verified(scanned: DataFrame, grams: DataFrame) -> DataFrame:
    """(o1_row, at, size, items) of the windows that are the benchmark's; a frequent one is dealt to several tasks."""
    asked = scanned.select("o1_row", F.explode("o1_windows").alias("w")).select(
        "o1_row", "w.at", "w.size", "w.gram", F.pmod("o1_row", F.lit(SALTS)).alias("salt")
    )
    return asked.join(
        grams.drop("size").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["gram", "salt"]
    ).select("o1_row", "at", "size", "items")


def joined_hits(source: DataFrame, grams: DataFrame) -> DataFrame:
    """decontaminate() of a benchmark that is not broadcast."""
    scanned = with_candidates(source, grams, "text")
    found = verified(scanned, grams).groupBy("o1_row").agg(F.collect_list(F.struct("at", "size", "items")).alias("hits"))

    def batches(rows):
        for batch in rows:
            release()
            texts = as_bytes(batch.column("text"))
            hits = [h or [] for h in batch.column("hits").to_pylist()]
            each = []
            for text, own in zip(texts, hits, strict=True):
                words = Words([text], WORD_BYTES, lower=True)
                each.append(summed(words, 0, [(h["at"], h["size"], h["items"]) for h in own]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns(texts, batch.column("text").is_valid().to_pylist(), each)],
                names=["doc_id", *NAMES]
            )

    return scanned.drop("o1_windows").join(found, "o1_row", "left").select("doc_id", "text", "hits").mapInArrow(batches, SCHEMA)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Windows of ten words of the benchmark in all documents; see decontaminate()."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def drop_contaminated(
    documents: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", limits: tuple[int, int] = (BROADCAST_GRAMS, BROADCAST_BYTES)
) -> DataFrame:
    """``documents`` without the rows that hold a benchmark window, all columns and their names kept.

    Null, empty and blank texts hold none and stay. Rows that repeat are judged each. Without
    items all rows stay; an empty table stays empty. Up to the limits it is one pass without
    a shuffle; see decontaminate() for what lies beyond.
    """
    index, grams = index_or_grams(benchmark, n, item_col, item_text_col, limits)
    if index is None:
        scanned = with_candidates(numbered(documents), grams, f"c_{documents.columns.index(text_col)}")
        kept = scanned.join(verified(scanned, grams).select("o1_row").distinct(), "o1_row", "left_anti")
        return kept.select(*(F.col(f"c_{i}").alias(c) for i, c in enumerate(documents.columns)))

    def keep(rows):
        for batch in rows:
            release()
            clean = [not n_hit for *_, n_hit in scan(index.value.hits, as_bytes(batch.column(place)))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    inner, place = numbered(documents), f"c_{documents.columns.index(text_col)}"
    return inner.mapInArrow(keep, inner.schema).toDF(*documents.columns)


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM items, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM grams),
windows AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM words, sizes, unnest(generate_series(1, len(w) - n + 1)) AS t(i) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, h.n AS n, item_id FROM windows h JOIN grams g ON h.n = g.n AND h.gram = g.gram),
hit_words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(generate_series(0, n - 1)) AS t(k) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed FROM hits GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
