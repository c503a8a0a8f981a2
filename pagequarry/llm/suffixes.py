"""Operator 7, repeated byte strings by a sampled-splitter suffix sort.

Each window of ``window`` bytes selects one 24-byte gram inside it, the least by hash, so
equal windows select equal grams at equal places and about one suffix in fourteen stands for
its neighbours. A first exchange asks of each selected gram whether another document has it;
only suffixes that survive are sorted. Those are range-partitioned by their leading bytes at
splitters taken from a sample of what survives, which grows with the number of buckets. Where one gram is so
frequent that several splitters fall on it, splitters read on beyond the gram, and its windows
are dealt by all of their bytes. Each bucket sorts by multikey quicksort and finds
each string's least document. A splitter never parts equal strings: what is compared across
boundaries is only the splitters themselves.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm.common import U64, as_bytes, byte_grams, covered, distinct_spans, keyed, named, release, runs, slices, table
from pagequarry.llm.packed import ANSWERS, MESSAGES, answer_keys, bucket_count, by_bucket, dealt, growth, in_order, messages, own_order, pack_keys, received, split_levels, text_bytes, told
from pagequarry.llm.repeats import NO_DOC, least_at, null_ids
from pagequarry.session import settle

#: Bytes of the grams that stand for windows.
GRAM = 24
#: Bytes of text in a chunk, and for each bucket of the suffix sort, and keys of a bucket of the first exchange; all grow with very large inputs.
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 2 << 20
BUCKET_KEYS = 1 << 18
#: Windows that are sorted at once.
SORT_WINDOWS = 1 << 17
#: Buckets at most (beyond, each takes more bytes), sampled records for each, and chunks to sample at least and records of each.
MOST_BUCKETS, SAMPLE_EACH = 1 << 16, 16
SAMPLE_CHUNKS, SAMPLE_OF_CHUNK, LEAST_SAMPLE = 64, 500, 32_000

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, clean_text string"


class Suffixes:
    """The selected suffixes of some texts: gram hash, and the range of windows each stands for."""

    def __init__(self, texts: list[bytes], window: int):
        self.window, self.gram = window, min(GRAM, window)
        keys, lows, highs, places, base = [], [], [], [], 0
        self.starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        self.data = b"".join(texts)
        whole = np.frombuffer(self.data, dtype=np.uint8)
        for lo, hi in slices(texts):
            base, top = self.starts[lo], self.starts[hi]
            part = whole[base:top]
            valid = np.ones(max(0, len(part) - window + 1), dtype=bool)
            for d in range(lo, hi):
                valid[max(self.starts[d] - base, self.starts[d + 1] - base - window + 1) : self.starts[d + 1] - base] = False
            at = np.flatnonzero(valid)
            if not len(at):
                continue
            every = byte_grams(part, self.gram)
            place = least_at(every, window - self.gram + 1)[at]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
            last = np.concatenate([cut[1:] - 1, [len(at) - 1]])
            keys.append(every[place[cut]])
            lows.append(at[cut] + base)
            highs.append(at[last] + base)
            places.append(place[cut] + base)
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        self.keys, self.low, self.high, self.place = join(keys, U64), join(lows, np.int64), join(highs, np.int64), join(places, np.int64)
        self.doc = np.searchsorted(self.starts, self.low, "right") - 1


class Chunk:
    def __init__(self, chunk: pa.Table, window: int):
        self.number, self.ids, self.texts = in_order(chunk)
        self.s = Suffixes(self.texts, window)
        self.order = np.array([NO_DOC if i is None else i for i in self.ids], dtype=np.int64)
        self.distinct, first, self.rank = np.unique(self.s.keys, return_index=True, return_inverse=True)
        docs = self.order[self.s.doc] if len(self.s.doc) else np.empty(0, np.int64)
        differs = np.zeros(len(self.distinct), dtype=bool)
        differs[self.rank[docs != docs[first][self.rank]]] = True
        self.several = differs
        self.docs = docs

    def surviving(self, replies: list[tuple[int, bytes]], buckets: int) -> np.ndarray:
        """Places in the list of suffixes whose gram is in several documents."""
        repeated = np.zeros(len(self.distinct), dtype=bool)
        found = dict(replies)
        for bucket, lo, hi in by_bucket(self.distinct, buckets):
            repeated[lo:hi] = np.unpackbits(np.frombuffer(found[bucket], np.uint8), count=hi - lo).astype(bool)
        return np.flatnonzero(repeated[self.rank])

    def records(self, alive: np.ndarray, splitters: list[bytes]) -> Records:
        """What the surviving suffixes send: the distinct texts of their windows, or, where splitters part the windows of a gram, the distinct runs of them that go to one bucket."""
        data, s = np.frombuffer(self.s.data, dtype=np.uint8), self.s
        low, stop, place = s.low[alive], s.high[alive] + s.window, s.place[alive]
        # suffixes are in the order of their documents, so a text's first one has its least document
        first, text = distinct_spans(data, low, stop)
        start, size, at, doc = low[first], (stop - low)[first], (place - low)[first], self.docs[alive][first]
        count = size - s.window + 1
        grams = [self.s.data[p : p + s.gram] for p in place[first].tolist()]
        bucket = np.array([bisect_right(splitters, g) for g in grams], dtype=np.int64)
        parted = np.array([b < len(splitters) and splitters[b].startswith(g) for b, g in zip(bucket.tolist(), grams, strict=True)], dtype=bool)
        entry = np.cumsum(~parted) - 1
        whole = np.flatnonzero(~parted)
        columns = [x[whole] for x in (bucket, start, size, at, doc)]
        asks = np.repeat(entry, count)
        bit = np.arange(len(asks)) - np.repeat(np.cumsum(count) - count, count)
        single: dict[tuple[bytes, int], int] = {}
        more: list[tuple] = []
        question = np.cumsum(count) - count
        # the least document first, so that a window's record has that
        for r in sorted(np.flatnonzero(parted).tolist(), key=doc.__getitem__):
            begin, place, n, asked = int(start[r]), int(at[r]), int(count[r]), int(question[r])
            to = [bisect_right(splitters, window_key(self.s.data[begin + j : begin + j + s.window], place - j, s.gram)) for j in range(n)]
            # neighbours that go to one bucket are one record
            lo = 0
            for hi in range(1, n + 1):
                if hi == n or to[hi] != to[lo]:
                    span, own = self.s.data[begin + lo : begin + hi - 1 + s.window], place - lo
                    e = single.get((span, own))
                    if e is None:
                        e = single[span, own] = len(whole) + len(more)
                        more.append((to[lo], begin + lo, len(span), own, doc[r]))
                    asks[asked + lo : asked + hi], bit[asked + lo : asked + hi] = e, np.arange(hi - lo)
                    lo = hi
        if more:
            columns = [np.concatenate([c, x]) for c, x in zip(columns, np.array(more, dtype=np.int64).T, strict=True)]
        return Records(*columns, text, count, question, asks, bit)


@dataclass
class Records:
    """What is sent (bucket, start, size, place of the gram and document of each), and what each suffix asks."""

    bucket: np.ndarray
    start: np.ndarray
    size: np.ndarray
    place: np.ndarray
    doc: np.ndarray
    #: Each suffix's text; and of each text its number of windows, their first question, and for each question the record and its bit there.
    text: np.ndarray
    count: np.ndarray
    question: np.ndarray
    asks: np.ndarray
    bit: np.ndarray

    def __post_init__(self):
        self.by = np.argsort(self.bucket, kind="stable")

    def messages(self, data: bytes, number: int) -> list[tuple[int, int, bytes]]:
        rows = []
        for bucket, lo, hi in zip(*runs_of(self.bucket[self.by]), strict=True):
            own = self.by[lo:hi]
            start, size = self.start[own], self.size[own]
            texts = b"".join([data[a:b] for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)])
            heads = size.astype(np.uint16).tobytes() + self.place[own].astype(np.uint8).tobytes() + self.doc[own].tobytes()
            rows.append((bucket, number, len(own).to_bytes(4, "little") + heads + texts))
        return rows

    def gone(self, replies: dict[int, bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffix, window) of each window that a smaller document than the suffix's has."""
        masks = np.empty(len(self.bucket), dtype=np.uint32)
        masks[self.by] = np.concatenate(
            [np.empty(0, np.uint32), *(np.frombuffer(replies[b], np.uint32) for b, _, _ in zip(*runs_of(self.bucket[self.by]), strict=True))]
        )
        elsewhere = (masks[self.asks] >> self.bit.astype(np.uint32) & np.uint32(1)).astype(bool)
        size = self.count[self.text]
        suffix = np.repeat(np.arange(len(self.text)), size)
        j = np.arange(len(suffix)) - np.repeat(np.cumsum(size) - size, size)
        question = self.question[self.text][suffix] + j
        hit = elsewhere[question] | (docs[suffix] > self.doc[self.asks[question]])
        return suffix[hit], j[hit]


def window_key(window: bytes, place: int, gram: int) -> bytes:
    """A window's bytes as it is sorted: its gram, the place of that, what follows and what precedes it."""
    return b"".join([window[place : place + gram], bytes([place]), window[place + gram :], window[:place]])


def ask_grams(window: int, buckets: int):
    def run(chunk: pa.Table) -> pa.Table:
        release()
        c = Chunk(chunk, window)
        # bits below a bucket's are what is sent: the top 16 are the bucket's and may be cut off
        return messages([(b, c.number, pack_keys(c.distinct[lo:hi], c.several[lo:hi])) for b, lo, hi in by_bucket(c.distinct, buckets)])

    return run


def ask_suffixes(window: int, buckets: int, splitters):
    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        release()
        if not chunk.num_rows:
            return messages([])
        c = Chunk(chunk, window)
        alive = c.surviving(split_levels(replies).get(0, []), buckets)
        return messages(c.records(alive, splitters.value).messages(c.s.data, c.number))

    return run


def multikey_sort(data: bytes, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings of ``width`` bytes at the places ``at``, and which of them, so sorted, differ from the one before.

    Multikey quicksort with eight bytes as a character: every unfinished group is parted in
    three by a pivot, and only what equals the pivot goes on to the next eight bytes. All
    groups of a round are parted together.
    """
    padded = np.frombuffer(data + bytes(8), dtype=np.uint8)
    words = np.ndarray((len(data) + 1,), dtype=">u8", buffer=padded, strides=(1,))
    offsets = np.array([*range(0, width - 7, 8), *([max(0, width - 8)] if width % 8 or width < 8 else [])])
    order, head = np.arange(len(at)), np.zeros(len(at), dtype=bool)
    head[:1] = True
    start, size, depth = np.zeros(1, np.int64), np.array([len(at)]), np.zeros(1, np.int64)
    if len(at) < 2:
        return order, head
    while len(start):
        first = np.cumsum(size) - size
        group = np.repeat(np.arange(len(start)), size)
        place = np.arange(len(group)) - first[group] + start[group]
        own = order[place]
        key = words[at[own] + offsets[depth[group]]].astype(U64)
        if width < 8:
            key >>= U64(8 * (8 - width))
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[group]
        low, equal = key < pivot, key == pivot
        below, same = np.cumsum(low), np.cumsum(equal)
        n_low = below[first + size - 1] - below[first] + low[first]
        n_equal = same[first + size - 1] - same[first] + equal[first]
        before_low, before_equal = (below[first] - low[first])[group], (same[first] - equal[first])[group]
        inside = np.arange(len(group)) - first[group]
        to_low, to_equal = below - 1 - before_low, n_low[group] + same - 1 - before_equal
        to_high = n_equal[group] + n_low[group] + inside - (below - before_low) - (same - before_equal)
        order[start[group] + np.where(low, to_low, np.where(equal, to_equal, to_high))] = own
        after = n_low + n_equal
        head[(start + n_low)[n_equal > 0]] = True
        head[(start + after)[after < size]] = True
        deeper = (n_equal > 1) & (depth + 1 < len(offsets))
        parts = [
            (start, n_low, depth, n_low > 1), (start + n_low, n_equal, depth + 1, deeper),
            (start + after, size - after, depth, size - after > 1)
        ]
        start, size, depth = (np.concatenate([p[i][p[3]] for p in parts]) for i in range(3))
    return order, head


def multikey_groups(data: bytes, at: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the strings of ``width`` bytes at the places ``at``, in their order, equal for equal ones."""
    order, head = multikey_sort(data, at, width)
    group = np.empty(len(at), dtype=np.int64)
    group[order] = np.cumsum(head) - 1
    return group


def read_records(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Sizes, places of the gram, documents and texts of a message's records."""
    n = int.from_bytes(body[:4], "little")
    return np.frombuffer(body, np.uint16, count=n, offset=4), np.frombuffer(
        body, np.uint8, count=n, offset=4 + 2 * n
    ), np.frombuffer(body, np.int64, count=n, offset=4 + 3 * n), body[4 + 11 * n :]


def earlier_windows(data: bytes, start: np.ndarray, size: np.ndarray, least: np.ndarray, window: int) -> np.ndarray:
    """Of each text's windows, those that another of the texts has with a smaller document: 32-bit masks."""
    count = size - window + 1
    owner = np.repeat(np.arange(len(start)), count)
    j = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    group = multikey_groups(data, np.repeat(start, count) + j, window)
    first = np.full(len(group), NO_DOC, dtype=np.int64)
    np.minimum.at(first, group, least[owner])
    gone = least[owner] > first[group]
    masks = np.zeros(len(start), dtype=np.uint32)
    np.bitwise_or.at(masks, owner[gone], np.uint32(1) << j[gone].astype(np.uint32))
    return masks


def answer_suffixes(window: int, gram: int):
    """Of each record's windows, those that a smaller document than the record's has: 32-bit masks.

    Records of one text are one suffix with the least of their documents. Distinct suffixes
    are sorted by their gram; only where suffixes with equal grams differ further out are
    their windows sorted, a bounded number of windows at a time.
    """

    def run(bucket: pa.Table) -> pa.Table:
        release()
        got = received(bucket)
        parts = [read_records(body) for _, body in got]
        size, place, docs = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(3))
        data = b"".join(p[3] for p in parts)
        counts = [len(p[0]) for p in parts]
        del parts
        start = np.cumsum(size) - size
        first, which = distinct_spans(np.frombuffer(data, dtype=np.uint8), start, start + size)
        least = np.full(len(first), NO_DOC, dtype=np.int64)
        np.minimum.at(least, which, docs)
        start_of, size_of = start[first], size[first]
        masks = np.zeros(len(first), dtype=np.uint32)
        order, head = multikey_sort(data, start_of + place[first], gram)
        # suffixes whose gram others have too, in as many sorts as their windows need; a gram's are never parted
        run_start = np.flatnonzero(head)
        length = np.diff(np.append(run_start, len(order)))
        several = np.repeat(length > 1, length)
        held, windows = order[several], np.cumsum((size_of - window + 1)[order[several]])
        leads = head[several]
        at = np.flatnonzero(leads)
        batch = (windows[at] // SORT_WINDOWS)[np.cumsum(leads) - 1] if len(at) else np.empty(0, np.int64)
        for _, lo, hi in zip(*runs_of(batch), strict=True):
            own = held[lo:hi]
            masks[own] = earlier_windows(data, start_of[own], size_of[own], least[own], window)
        every = ((np.int64(1) << (size_of - window + 1)) - 1).astype(np.uint32)
        out = np.where(docs > least[which], every[which], masks[which])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return told(bucket, 1, got, [out[lo:hi].tobytes() for lo, hi in zip(bounds, bounds[1:], strict=False)])

    return run


def runs_of(values: np.ndarray) -> tuple[list, list, list]:
    """Value, start and end of each run of equal values."""
    edge = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]]) if len(values) else np.zeros(1, np.int64)
    return values[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist()


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without spans, each drawn in to whole UTF-8 characters."""
    out, at = [], 0
    for s, e in spans:
        while s < e and s < len(text) and text[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def finish(window: int, buckets: int, splitters, carried: list[str]):
    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        release()
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "clean_text")}
        if chunk.num_rows:
            nulls = null_ids(chunk)
            c = Chunk(chunk, window)
            found = split_levels(replies)
            alive = c.surviving(found.get(0, []), buckets)
            suffix, j = c.records(alive, splitters.value).gone(dict(found.get(1, [])), c.docs[alive])
            mask = covered(int(c.s.starts[-1]), c.s.low[alive][suffix] + j, window)
            for d, text in enumerate(c.texts):
                own = mask[c.s.starts[d] : c.s.starts[d + 1]]
                spans = [(int(s), int(e)) for s, e in zip(*runs(own), strict=True)]
                kept = np.frombuffer(text, np.uint8)[~own].tobytes() if spans else text
                out["doc_id"].append(c.ids[d])
                out["n_bytes"].append(len(text))
                out["n_removed"].append(len(text) - len(kept))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["clean_text"].append(None if (c.ids[d], text) in nulls else whole_characters(text, spans).decode())
        table = pa.table({k: pa.array(v, {"kept_sha256": pa.string(), "clean_text": pa.string()}.get(k, pa.int64())) for k, v in out.items()})
        if carried:
            rows = chunk.take(pa.array(own_order(chunk) if chunk.num_rows else [], pa.int64()))
            for c in carried:
                table = table.append_column(c, rows.column(c))
        return table

    return run


def sample_records(window: int, buckets: int, wanted: int):
    """About ``wanted`` of the records that a chunk will send, evenly among them, as they are sorted, and how many records each stands for."""

    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        release()
        keys: list[bytes] = []
        weight = 0.0
        if chunk.num_rows:
            c = Chunk(chunk, window)
            records = c.records(c.surviving(split_levels(replies).get(0, []), buckets), [])
            own = np.arange(0, len(records.start), max(1, len(records.start) // wanted))
            weight = len(records.start) / max(1, len(own))
            # any of a record's windows, as they are sorted by different places
            count = records.size[own] - window + 1
            at = (own * 2654435761 >> 7) % count
            for start, place in zip((records.start[own] + at).tolist(), (records.place[own] - at).tolist(), strict=True):
                keys.append(window_key(c.s.data[start : start + window], place, c.s.gram))
        return pa.table({"key": pa.array(keys, pa.binary()), "weight": pa.array([weight] * len(keys), pa.float64())})

    return run


def sampled_keys(chunks: DataFrame, n: int, repeated: DataFrame, window: int, buckets: int, wanted: int) -> list[tuple[bytes, float]]:
    """About ``wanted`` sorted records of all that is sent, each with how many it stands for, from as many chunks as that takes."""
    some = min(n, max(SAMPLE_CHUNKS, wanted // SAMPLE_OF_CHUNK))
    mine = F.col("chunk") % max(1, n // some) == 0
    sampled = chunks.where(mine).groupBy("chunk").cogroup(repeated.where(mine).groupBy("chunk")).applyInArrow(
        sample_records(window, buckets, -(-wanted // some)), "key binary, weight double"
    )
    return sorted((bytes(r[0]), r[1]) for r in sampled.toLocalIterator())


def chosen_splitters(keys: list[tuple[bytes, float]], buckets: int, gram: int) -> list[bytes]:
    """Strings that cut sorted keys into parts of equal weight: the gram alone, and beyond it only where several cuts fall on one gram."""
    out: list[bytes] = []
    upto = np.cumsum([w for _, w in keys])
    for i in range(1, buckets):
        key = keys[min(len(keys) - 1, int(np.searchsorted(upto, upto[-1] * i / buckets, "right")))][0]
        out.append(key if out and out[-1][:gram] == key[:gram] else key[:gram])
    return sorted(set(out))


def remove_repeated_bytes(
    documents: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int | None = None,
    bucket_bytes: int | None = None, carry: list[str] | None = None
) -> DataFrame:
    """Bytes covered by a ``window``-byte string that also starts in a document with a smaller id.

    Returns one row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 and clean_text: the text without those runs, each drawn in where it
    would cut a character in two. Null text counts as empty and stays null. Matches never
    cross documents; overlaps count; strings are judged on the input. Equal ids don't remove
    each other's bytes; a null id counts as larger than any id. An empty table gives no rows.
    Other columns are not read.
    Windows of at most 55 bytes are supported (32 windows a suffix). Memory is bounded by a
    chunk or the longest text. The columns named in ``carry`` come along as c_0, c_1, ...
    """
    if window - min(GRAM, window) + 1 > 32:
        raise ValueError("a window is at most 55 bytes")
    source = keyed(documents, id_col, text_col)
    total = text_bytes(source)
    scale = growth(documents.sparkSession, CHUNK_BYTES, total)
    carried = [f"c_{i}" for i in range(len(carry or []))]
    whole = documents.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
        *(named(c).alias(k) for c, k in zip(carry or [], carried, strict=True))
    )
    chunks, n = dealt(whole, chunk_bytes or int(CHUNK_BYTES * scale), total)
    buckets = bucket_count(total / 14, int(BUCKET_KEYS * scale))
    parts = min(MOST_BUCKETS, max(1, total // (bucket_bytes or int(BUCKET_BYTES * scale))))
    grouped = chunks.groupBy("chunk")
    repeated = settle(
        grouped.applyInArrow(ask_grams(window, buckets), MESSAGES).groupBy("bucket").applyInArrow(answer_keys(0), ANSWERS),
        "suffix-grams"
    )
    keys = sampled_keys(chunks, n, repeated, window, buckets, max(LEAST_SAMPLE, SAMPLE_EACH * parts))
    splitters = source.sparkSession.sparkContext.broadcast(chosen_splitters(keys, parts, min(GRAM, window)) if keys else [])
    asked = grouped.cogroup(repeated.groupBy("chunk")).applyInArrow(ask_suffixes(window, buckets, splitters), MESSAGES)
    sorted_out = asked.groupBy("bucket").applyInArrow(answer_suffixes(window, min(GRAM, window)), ANSWERS)
    return grouped.cogroup(repeated.unionByName(sorted_out).groupBy("chunk")).applyInArrow(
        finish(window, buckets, splitters, carried),
        T.StructType([*T.StructType.fromDDL(RESULT).fields, *(whole.schema[k] for k in carried)])
    )


def op7_suffixes(spark, sf_dir: str) -> DataFrame:
    """What strings of 50 bytes remove from all documents; see remove_repeated_bytes()."""
    found = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cut_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with their texts without repeated bytes; n_chars follows; rows whose text nothing is left of go.

    All columns and their names are kept. Null texts stay null and stay; rows that repeat in
    id and text are cut alike; an empty table stays empty.
    """
    names = documents.columns
    found = remove_repeated_bytes(documents, carry=names)
    kept = found.where("n_removed = 0 OR trim(clean_text) <> ''")
    new = {
        "text": F.col("clean_text"),
        "n_chars": F.when(F.col("n_removed") > 0, F.length("clean_text").cast("long")).otherwise(F.col(f"c_{names.index('n_chars')}"))
    } if "n_chars" in names else {"text": F.col("clean_text")}
    return kept.select(*(new.get(c, F.col(f"c_{i}")).alias(c) for i, c in enumerate(names)))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT doc_id, 1000 * k AS base, substr(h, 2000 * k + 1, 2098) AS p FROM d, unnest(generate_series(0, (length(h) // 2 - 50) // 1000)) AS t(k) WHERE length(h) >= 100),
w AS (SELECT doc_id, base + j AS i, md5_number(substr(p, 2 * j - 1, 100)) AS g FROM parts, unnest(generate_series(1, length(p) // 2 - 49)) AS t(j)),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
s AS (SELECT w.doc_id, i, lag(i) OVER (PARTITION BY w.doc_id ORDER BY i) AS before FROM w JOIN f ON w.g = f.g AND w.doc_id > first),
r AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
spans AS (SELECT doc_id, run, min(i) AS lo, max(i) + 49 AS hi FROM r GROUP BY ALL),
cut AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS from_hi FROM spans),
kept AS (
  SELECT c.doc_id, sum(hi - lo + 1) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * from_hi + 1, 2 * (lo - 1 - from_hi)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS k
  FROM cut c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
