"""Operator 13, periodic runs of words by the runs theorem.

A run is a stretch that keeps a period and can't be extended. By the runs theorem each run
has a Lyndon root that is the longest Lyndon word at its place, in the words' order or in the
reverse of it. So two words tell where a root may begin and end: its place and the next
smaller value of the inverse suffix array, for each of the two orders. A root is extended to
both sides by the longest common prefixes of suffixes and of reversed prefixes, each the
minimum of a range of an LCP array, found by a sparse table.

A task works on the texts that it reads; nothing is shuffled. Of a run of ``max(6, 4 * q)``
words and more any three consecutive words occur three times in it, so stretches where that
does not hold are left out before suffixes are sorted, again and again until nothing changes.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagequarry.llm.common import NONSPACE, U64, Words, as_bytes, joined, keyed, mix, release, runs, slices, table

#: A run's least number of words, and of periods.
LEAST, PERIODS = 6, 4
#: Text bytes whose suffixes are sorted together; a longer text is by itself.
TOGETHER = 1 << 20

RESULT = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string, clean_text string"
)


def suffix_ranks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse, by doubling the length that is compared. Values are from 0 on; an end is smaller than any value."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = (rank + 1) * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.ones(n, dtype=np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all():
            return order, rank
        step *= 2


def common_prefixes(x: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """At each place of the suffix array the length that its suffix shares with the one before; in linear time."""
    values, places, before = x.tolist(), rank.tolist(), order.tolist()
    n, shared, out = len(values), 0, [0] * len(values)
    for i in range(n):
        r = places[i]
        if r:
            j = before[r - 1]
            top = n - max(i, j)
            while shared < top and values[i + shared] == values[j + shared]:
                shared += 1
            out[r] = shared
            if shared:
                shared -= 1
        else:
            shared = 0
    return np.array(out, dtype=np.int64)


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low..high] for each query, by a sparse table of which one row at a time is held."""
    size = high - low + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.zeros(len(low), dtype=np.int64)
    row, width = values, 1
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            row = np.minimum(row[: len(row) - width], row[width:])
            width *= 2
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(row[low[at]], row[high[at] - width + 1])
    return out


class Extensions:
    """How far the suffixes at two places agree."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        self.order, self.rank = suffix_ranks(x)
        self.shared = common_prefixes(x, self.order, self.rank)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places i < j; an end, which is place n, agrees with nothing."""
        out = np.zeros(len(i), dtype=np.int64)
        inside = np.flatnonzero((i < self.n) & (j < self.n))
        a, b = self.rank[i[inside]], self.rank[j[inside]]
        out[inside] = range_minima(self.shared, np.minimum(a, b) + 1, np.maximum(a, b))
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one whose rank is smaller, n if there is none: where the longest Lyndon word of that place ends."""
    values, n = rank.tolist(), len(rank)
    out, waiting = [n] * n, []
    for i in range(n):
        v = values[i]
        while waiting and values[waiting[-1]] > v:
            out[waiting.pop()] = i
        waiting.append(i)
    return np.array(out, dtype=np.int64)


def find_runs(x: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), sorted, of all runs of ``max(LEAST, PERIODS * period)`` values and more.

    ``x`` are numbers from 0 on; negative ones part stretches and each occurs once.
    ``longest`` has for each place the length of its stretch, which bounds the periods there.
    """
    n = len(x)
    forward = Extensions(x)
    backward = Extensions(x[::-1].copy())
    # in the other order words are reversed, while ends and what parts stretches stay smaller than any word
    other = suffix_ranks(np.where(x < 0, x, x.max(initial=0) - x))[1]
    found = []
    for rank in (forward.rank, other):
        end = next_smaller(rank)
        i = np.flatnonzero((x >= 0) & ((end - np.arange(n)) * PERIODS <= longest))
        j = end[i]
        right = forward.of(i, j)
        left = np.zeros(len(i), dtype=np.int64)
        inner = np.flatnonzero(i > 0)
        left[inner] = backward.of(n - i[inner], n - j[inner]) if len(inner) else 0
        found.append(np.stack([i - left, j - i + left + right, j - i], axis=1))
    rows = np.concatenate(found)
    rows = rows[rows[:, 1] >= np.maximum(LEAST, PERIODS * rows[:, 2])]
    return np.unique(rows, axis=0)


def stretches(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that may hold runs: any three consecutive words occur three times in their stretch.

    Equal hashes of different words only make a stretch longer than it has to be.
    """
    if len(hashes) < LEAST:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = joined(hashes[:-1], hashes[1:])
    triples = joined(pairs[:-1], pairs[1:])
    at = np.flatnonzero(doc[:-2] == doc[2:])
    owner = doc[at].astype(U64)
    while True:
        _, which, count = np.unique(mix(triples[at] ^ mix(owner * U64(0x9E3779B97F4A7C15) + U64(1))), return_inverse=True, return_counts=True)
        at = at[count[which] >= 3] if len(at) else at
        # places in a row are one stretch; texts are parted by two places that were never taken
        edge = np.concatenate([[0], np.flatnonzero(np.diff(at) != 1) + 1, [len(at)]]) if len(at) else np.zeros(1, np.int64)
        size = np.diff(edge)
        wide = np.repeat(size >= LEAST - 2, size)
        if len(which) == len(at) and wide.all():
            return (at[edge[:-1]], at[edge[1:] - 1] + 3) if len(at) else (at, at)
        owner = np.repeat(np.arange(len(size)), size)[wide].astype(U64)
        at = at[wide]


def runs_of_texts(order: list[np.ndarray], words: list[list[bytes]], hashes: np.ndarray) -> list[np.ndarray]:
    """For each text its runs as rows (start, length, period). ``order`` has the place of the word that stands at each place, ``hashes`` are of all texts' words as they stand."""
    sizes = np.array([len(o) for o in order], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(order)), sizes)
    low, high = stretches(hashes, doc)
    out = [np.empty((0, 3), np.int64)] * len(order)
    if not len(low):
        return out
    number: dict[bytes, int] = {}
    parts, longest, at = [], [], []
    for k, (lo, hi) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        d = int(doc[lo])
        own = words[d]
        parts.append(np.array([*(number.setdefault(own[i], len(number)) for i in order[d][lo - first[d] : hi - first[d]].tolist()), -1 - k], dtype=np.int64))
        longest.append(np.full(hi - lo + 1, hi - lo, dtype=np.int64))
        at.append(np.arange(lo, hi + 1))
    rows = find_runs(np.concatenate(parts), np.concatenate(longest))
    place = np.concatenate(at)
    if len(rows):
        start = place[rows[:, 0]]
        owner = doc[start]
        for d in np.unique(owner).tolist():
            own = rows[owner == d].copy()
            own[:, 0] = start[owner == d] - first[d]
            out[d] = own
    return out


def drilled(doc_id: int | None, n: int) -> np.ndarray:
    """The place of the word that stands at each of n places: one id in ten repeats what follows some place, as its crc32 says."""
    at = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


def told(doc_id, order: np.ndarray, words: list[bytes], found: np.ndarray, text: bytes | None) -> tuple:
    """A result row; the longest run, of equal ones the one that starts first, then that of the smallest period."""
    n = len(order)
    gone = np.zeros(n + 1, dtype=np.int64)
    if len(found):
        np.add.at(gone, found[:, 0] + found[:, 2], 1)
        np.add.at(gone, found[:, 0] + found[:, 1], -1)
    keep = order[np.cumsum(gone[:-1]) == 0]
    collapsed = b" ".join([words[i] for i in keep.tolist()] if len(keep) < n or len(found) else map(words.__getitem__, order.tolist()))
    best: list = [None] * 4
    if len(found):
        start, length, period = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist()
        best = [start, length, period, 1000 * length // period]
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found.tolist())
    return (
        doc_id, n, len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest(),
        None if text is None else collapsed.decode()
    )


def scanner(repeat_some: bool):
    kinds = [pa.int64()] * 7 + [pa.string()] * 3
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches):
        for batch in batches:
            release()
            ids, valid = batch.column("doc_id").to_pylist(), batch.column("text").is_valid().to_pylist()
            texts = as_bytes(batch.column("text"))
            for lo, hi in slices(texts, TOGETHER):
                spans = Words(texts[lo:hi], NONSPACE, lower=False)
                hashes = spans.hashes()
                words = [t.split() for t in texts[lo:hi]]
                order = [drilled(i if repeat_some else None, len(w)) for i, w in zip(ids[lo:hi], words, strict=True)]
                moved = hashes[np.concatenate([o + f for o, f in zip(order, spans.first[:-1].tolist(), strict=True)])]
                found = runs_of_texts(order, words, moved)
                rows = [
                    told(ids[lo + d], order[d], words[d], found[d], texts[lo + d] if valid[lo + d] else None) for d in range(hi - lo)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def periodic_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat_some: bool = False) -> DataFrame:
    """The periodic runs of each text's words, and the text with each run cut down to its first period.

    Words are [^\\x20\\x09-\\x0D]+. A run has ``max(6, 4 * period)`` words and more, keeps its
    smallest period, and is extended by no neighbour. One row per input row: doc_id, n_words,
    n_runs, the longest run's start, length, period and exponent_milli (null without one),
    runs_sha256 (of every run's line), collapsed_sha256 and clean_text (the words that stay,
    joined by one space; null for a null text, which has no words). With ``repeat_some`` texts
    whose id calls for it repeat a part of themselves first. A null id never calls for it; rows
    that repeat are rows of their own; an empty table gives no rows. Other columns are not
    read. A text is handled whole by one task, so memory is bounded by the longest one.
    """
    return keyed(documents, id_col, text_col).mapInArrow(scanner(repeat_some), RESULT)


def op13_runs(spark, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, of which some repeat a part of themselves; see periodic_runs()."""
    return periodic_runs(table(spark, sf_dir, "documents"), repeat_some=True).drop("n_words", "clean_text")


# crc32 bit by bit; equal words at a distance of q in a row are a stretch that keeps the period q
ORACLE_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS v,
    xor(4294967295, list_reduce([4294967295::BIGINT] || [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')],
      lambda s, b: list_reduce([xor(s, b)] || [0::BIGINT FOR k IN range(8)], lambda t, z: xor(t >> 1, 3988292384 * (t & 1))))) AS h
  FROM documents),
sized AS (SELECT r, doc_id, v, len(v) AS n, h, h // 10 AS g FROM texts),
parts AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM sized),
periods AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM parts),
flat AS (
  SELECT r, i, CASE WHEN h % 10 = 0 AND i >= a THEN v[1 + a + (i - a) % p] ELSE v[1 + i] END AS word, n
  FROM periods, unnest(range(0, n)) AS t(i)),
same AS (SELECT x.r AS r, x.i AS i, y.i - x.i AS q FROM flat x JOIN flat y ON x.r = y.r AND x.word = y.word AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
chains AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS c FROM same),
kept AS (SELECT r, min(i) AS start, count(*) + q AS length, q FROM chains GROUP BY r, q, c HAVING count(*) + q >= greatest(6, 4 * q)),
found AS (SELECT r, start, length, min(q) AS period FROM kept GROUP BY r, start, length),
told AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
    min(struct_pack(l := -length, s := start, p := period)) AS best
  FROM found GROUP BY r),
gone AS (SELECT DISTINCT r, j FROM found, unnest(range(start + period, start + length)) AS t(j)),
stay AS (SELECT flat.r AS r, string_agg(word, ' ' ORDER BY flat.i) AS text FROM flat ANTI JOIN gone ON flat.r = gone.r AND flat.i = gone.j GROUP BY flat.r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, (-best.l)::BIGINT AS length, best.p::BIGINT AS period,
  (1000 * -best.l // best.p)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(stay.text, '')) AS collapsed_sha256
FROM texts LEFT JOIN told USING (r) LEFT JOIN stay USING (r)
"""
