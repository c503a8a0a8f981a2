"""Operator 6, repeated passages of words by level-wise doubling.

Only windows that are repeated at one length are looked at at about twice that length. Of
the 50-word windows, a first level looks at 13-word grams, a second at 26-word grams, each
thinned to the grams that some 50-word window selects (its least by hash, so equal windows
select equal grams), and the last level at the 50-word windows themselves. A level sends
each distinct gram of a chunk once, packed, and learns which ones other documents hold; what
holds no repeated gram drops out, and the levels end early when no candidate survives.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagequarry.llm.common import NONSPACE, U64, Words, covered, every_gram, joined, keyed, release, runs, slices, table
from pagequarry.llm.packed import ANSWERS, MESSAGES, answer_keys, bucket_count, by_bucket, dealt, growth, in_order, messages, pack, pack_keys, received, split_levels, text_bytes, told, unpack

#: Bytes of text in a chunk, and keys that a bucket holds at most on average; both grow with very large inputs.
CHUNK_BYTES = 4 << 20
BUCKET_KEYS = 1 << 18
NO_DOC = np.iinfo(np.int64).max

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, clean_text string"


def least_at(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes the place of the least, the leftmost among equals: the same wherever the run stands."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, place = hashes, np.arange(len(hashes))
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        place = np.where(right < left, place[step:], place[: len(place) - step])
        best = np.minimum(left, right)
        have += step
    return place[:n]


class Corpus:
    """The words of a chunk's texts one after another, and hashes of their grams in two lanes of 64 bits.

    A level's grams are two of the level before, so that their length doubles.
    """

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids, self.texts = ids, texts
        parts, counts, bounds = [], [], []
        for lo, hi in slices(texts):
            words = Words(texts[lo:hi], NONSPACE, lower=False)
            parts.append((words.hashes(), words.hashes(1)))
            counts.append(words.counts)
            bounds.append((words.starts - words.text_starts[words.doc], words.ends - words.text_starts[words.doc]))
        self.lanes = [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else [np.empty(0, U64)] * 2
        self.n = len(self.lanes[0])
        self.made: dict[tuple[int, int], np.ndarray] = {}
        self.counts = np.concatenate(counts) if counts else np.empty(0, np.int64)
        self.starts = np.concatenate([b[0] for b in bounds]) if bounds else np.empty(0, np.int64)
        self.ends = np.concatenate([b[1] for b in bounds]) if bounds else np.empty(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.order = np.array([NO_DOC if i is None else i for i in ids], dtype=np.int64)

    def windows(self, size: int) -> np.ndarray:
        """Places whose ``size`` words lie in one text."""
        n = self.n - size + 1
        if n <= 0:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])

    def every(self, size: int, lane: int = 0) -> np.ndarray:
        """Hashes of the ``size`` words from each place on, whatever texts they are of."""
        if (size, lane) not in self.made:
            half = max((s for s, of in self.made if of == lane and s < size <= 2 * s), default=0)
            short = self.made[half, lane] if half else None
            self.made[size, lane] = joined(
                short[: len(short) - (size - half)], short[size - half :]
            ) if half and len(short) > size - half else every_gram(self.lanes[lane], size)
        return self.made[size, lane]


def selected(corpus: Corpus, windows: np.ndarray, window: int, size: int) -> np.ndarray:
    """For each window the place of the gram of ``size`` words that it selects."""
    best = least_at(corpus.every(size), window - size + 1)
    return best[windows]


def group_heads(keys: list[np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places by keys then document order, and whether each starts a new key."""
    by = np.lexsort((order, *reversed(keys)))
    new = np.ones(len(by), dtype=bool)
    if len(by):
        new[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)
    return by, new


class Levels:
    """What a chunk asks and decides at each level; every step is computed afresh from the texts and the answers so far."""

    def __init__(self, window: int, sizes: list[int], buckets: list[int]):
        self.window, self.sizes, self.buckets = window, sizes, buckets

    def ask(self, corpus: Corpus, at: np.ndarray, size: int):
        """Distinct grams at the places ``at``: sorted keys, and for each place its key's rank, its least document, and whether two documents hold it."""
        keys = [corpus.every(size)[at]] + ([corpus.every(size, 1)[at]] if size == self.window else [])
        order = corpus.order[corpus.doc[at]]
        by, new = group_heads(keys, order)
        rank = np.empty(len(at), dtype=np.int64)
        rank[by] = np.cumsum(new) - 1
        heads = by[new]
        least = order[heads]
        most = np.maximum.reduceat(order[by], np.flatnonzero(new)) if len(by) else least
        return [k[heads] for k in keys], rank, least, most > least

    def state(self, corpus: Corpus, replies: dict[int, list[tuple[int, bytes]]], upto: int):
        """Windows still candidates at level ``upto``, and that level's places."""
        windows = corpus.windows(self.window)
        for level in range(upto + 1):
            size = self.sizes[level]
            place = selected(corpus, windows, self.window, size) if size < self.window else windows
            at = np.unique(place)
            if level == upto:
                return windows, at
            keys, rank, _, _ = self.ask(corpus, at, size)
            repeated = self.flags(keys, replies.get(level, []), level)
            alive = np.zeros(corpus.n + 1, dtype=bool)
            alive[at[repeated[rank]]] = True
            windows = windows[alive[place]]
        raise AssertionError

    def flags(self, keys: list[np.ndarray], replies: list[tuple[int, bytes]], level: int) -> np.ndarray:
        out = np.zeros(len(keys[0]), dtype=bool)
        found = dict(replies)
        for bucket, lo, hi in by_bucket(keys[0], self.buckets[level]):
            out[lo:hi] = np.unpackbits(np.frombuffer(found[bucket], np.uint8), count=hi - lo).astype(bool)
        return out


def asker(levels: Levels, level: int):
    """Cogrouped chunk and earlier answers to this level's packed questions."""
    size = levels.sizes[level]

    def run(chunk: pa.Table, replies: pa.Table | None) -> pa.Table:
        release()
        if not chunk.num_rows:
            return messages([])
        number, ids, texts = in_order(chunk)
        corpus = Corpus(ids, texts)
        _, at = levels.state(corpus, split_levels(replies), level)
        keys, _, least, several = levels.ask(corpus, at, size)
        if size < levels.window:
            return messages([(b, number, pack_keys(keys[0][lo:hi], several[lo:hi])) for b, lo, hi in by_bucket(keys[0], levels.buckets[level])])
        return messages([(b, number, pack(*(k[lo:hi] for k in keys), least[lo:hi])) for b, lo, hi in by_bucket(keys[0], levels.buckets[level])])

    return run


def alone(ask):
    """``ask`` for a chunk that has no answers yet."""

    def run(chunk: pa.Table) -> pa.Table:
        return ask(chunk, None)

    return run


def answer_windows(level: int):
    """For each window that was asked, whether a smaller document than the chunk's least holds it."""

    def run(bucket: pa.Table) -> pa.Table:
        release()
        got = received(bucket)
        parts = [unpack(body, U64, U64, np.int64) for _, body in got]
        first, second, least = (np.concatenate([p[i] for p in parts]) for i in range(3))
        by, new = group_heads([first, second], least)
        flags = np.empty(len(by), dtype=bool)
        flags[by] = least[by] > least[by][np.flatnonzero(new)][np.cumsum(new) - 1]
        bounds = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        return told(bucket, level, got, [np.packbits(flags[lo:hi]).tobytes() for lo, hi in zip(bounds, bounds[1:], strict=False)])

    return run


def finisher(levels: Levels):
    last = len(levels.sizes) - 1

    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        release()
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "clean_text": []}
        if chunk.num_rows:
            _, ids, texts = in_order(chunk)
            nulls = null_ids(chunk)
            corpus = Corpus(ids, texts)
            found = split_levels(replies)
            windows, _ = levels.state(corpus, found, last)
            keys, rank, least, _ = levels.ask(corpus, windows, levels.window)
            elsewhere = levels.flags(keys, found.get(last, []), last)
            gone = windows[elsewhere[rank] | (corpus.order[corpus.doc[windows]] > least[rank])]
            mask = covered(corpus.n, gone, levels.window)
            for d, text in enumerate(texts):
                lo, hi = corpus.first[d], corpus.first[d + 1]
                kept = [text[s:e] for s, e in zip(corpus.starts[lo:hi][~mask[lo:hi]], corpus.ends[lo:hi][~mask[lo:hi]], strict=True)]
                out["doc_id"].append(ids[d])
                out["n_words"].append(int(hi - lo))
                out["n_removed"].append(int(mask[lo:hi].sum()))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
                null = (ids[d], text) in nulls
                if out["n_removed"][-1]:
                    cut, at = [], 0
                    for s, e in zip(*runs(mask[lo:hi]), strict=True):
                        cut.append(text[at : corpus.starts[lo + s]])
                        at = corpus.ends[lo + e - 1]
                    text = b"".join([*cut, text[at:]])
                out["clean_text"].append(None if null else text.decode())
        return pa.table({k: pa.array(v, {"kept_sha256": pa.string(), "clean_text": pa.string()}.get(k, pa.int64())) for k, v in out.items()})

    return run


def null_ids(chunk: pa.Table) -> set:
    """(id, b"") of rows whose text is null."""
    return {(i, b"") for i, ok in zip(chunk.column("doc_id").to_pylist(), chunk.column("text").is_valid().to_pylist(), strict=True) if not ok}


def level_sizes(window: int) -> list[int]:
    """Lengths that double up to ``window``: 13, 26 and 50 for 50."""
    quarter = -(-window // 4)
    return [*(s for s in (quarter, 2 * quarter) if s < window), window]


def remove_repeats(
    documents: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int | None = None
) -> DataFrame:
    """Words covered by a window of ``window`` words that also starts in a document with a smaller id.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. Returns one row per input row: doc_id, n_words,
    n_removed, kept_sha256 (kept words joined by one space) and clean_text (the text without
    the removed runs). Null text has no words and stays null. Ids may repeat: equal ids don't
    remove each other's words. A null id counts as larger than any id. Windows are judged on
    the input. An empty table gives no rows. Other columns are not read. A chunk holds whole
    texts, so memory is bounded by the chunk size or the longest text.
    """
    source = keyed(documents, id_col, text_col)
    total = text_bytes(source)
    scale = growth(documents.sparkSession, CHUNK_BYTES, total)
    chunks, n = dealt(source, chunk_bytes or int(CHUNK_BYTES * scale), total)
    sizes = level_sizes(window)
    # about one gram in ten words is asked before the last level; there it may be every word
    levels = Levels(window, sizes, [bucket_count(total / 6 / (1 if size == window else 10), int(BUCKET_KEYS * scale)) for size in sizes])
    grouped = chunks.groupBy("chunk")
    replies = None
    for level in range(len(sizes)):
        ask = asker(levels, level)
        asked = grouped.applyInArrow(alone(ask), MESSAGES) if replies is None else grouped.cogroup(replies.groupBy("chunk")).applyInArrow(ask, MESSAGES)
        answer = answer_windows(level) if sizes[level] == window else answer_keys(level)
        answered = asked.groupBy("bucket").applyInArrow(answer, ANSWERS)
        replies = answered if replies is None else replies.unionByName(answered)
    return grouped.cogroup(replies.groupBy("chunk")).applyInArrow(finisher(levels), RESULT)


def op6_repeats(spark, sf_dir: str) -> DataFrame:
    """What windows of 50 words remove from all documents; see remove_repeats()."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS gram FROM words, unnest(generate_series(1, len(w) - 49)) AS t(i) WHERE len(w) >= 50),
firsts AS (SELECT gram, min(doc_id) AS d FROM windows GROUP BY gram HAVING min(doc_id) < max(doc_id)),
starts AS (SELECT windows.doc_id, i FROM windows JOIN firsts ON windows.gram = firsts.gram AND windows.doc_id > d),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM starts, unnest(generate_series(0, 49)) AS t(k)),
flat AS (SELECT doc_id, j, w[j] AS word FROM words, unnest(generate_series(1, len(w))) AS t(j)),
kept AS (
  SELECT flat.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY flat.j) FILTER (gone.j IS NULL) AS text, count(gone.j) AS n_removed
  FROM flat LEFT JOIN gone ON flat.doc_id = gone.doc_id AND flat.j = gone.j GROUP BY flat.doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
