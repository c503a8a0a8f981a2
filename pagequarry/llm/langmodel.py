"""Operator 10, language-model scoring by a weighted backoff automaton.

Smoothed n-grams are the model. A state stands for a context of up to ``order`` - 1 words, an
arc for an n-gram that training texts hold, weighted with its interpolated absolute-discounting
probability, and a failure arc leads from a context to the next shorter one, weighted with the
mass that the discounts left over. A text is walked once from left to right, carrying the state.

Nothing of the model is broadcast. Words of a chunk of texts ask, in packed exchanges, for the
corpus-wide counts of their own words; then for those of pairs, of triples and so on, each only
where both shorter n-grams are frequent enough that it can be kept; and for the sums over each
context's kept arcs. The answers are the part of the automaton that the chunk's texts can reach.
N-grams are keyed exactly: words by 128-bit hashes, longer ones by the number that the bucket of
their first words gave those, and their last word's. Counts cover every training text and grow
with the corpus.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import LANES, NONSPACE, U64, Words, as_bytes, keyed, mix, release, slices, table
from pagequarry.llm.packed import bucket_count, expand, growth, squeeze
from pagequarry.session import discard, settle

#: Texts of a chunk, in bytes, and keys that a bucket holds on average; both grow with very large inputs.
CHUNK_BYTES = 4 << 20
BUCKET_KEYS = 1 << 21
#: Words of an n-gram at most, and for each length the training count from which it is kept.
ORDER, LEAST = 4, (1, 1, 2, 2)
#: Tokens that a lane of the walk covers.
LANE = 128
#: Stand for the end of a text: words hash elsewhere but for one chance in 2**128.
END = (U64(0x5E4D0000000000E5), U64(0xB3610000000000B5))
#: Number of the word before a text's first; other words are numbered from 2 on.
BEGIN = 1

CHUNKS = "chunk long, tokens long, body binary, words binary"
ASKED = "level long, bucket long, chunk long, body binary"
ANSWERED = f"{ASKED}, total long, kinds long, ones long, twos long, width long"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out_rows(ids: list, folds: int, fold: int) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % folds == fold for i in ids], dtype=bool)


# ---- chunks ------------------------------------------------------------------------------


def order_of(values: np.ndarray) -> np.ndarray:
    """The places of whole numbers from 0 on in rising order; where a number and its place fit into 64 bits, both are sorted as one number."""
    bits = len(values).bit_length()
    if int(values.max(initial=0)).bit_length() + bits > 64:
        return np.argsort(values)
    both = values.astype(U64) << U64(bits) | np.arange(len(values), dtype=U64)
    both.sort()
    return (both & U64((1 << bits) - 1)).astype(np.int64)


def distinct_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each whole number's place among the distinct ones, and these in rising order."""
    by = order_of(values)
    rising = values[by]
    new = np.ones(len(by), dtype=bool)
    new[1:] = rising[1:] != rising[:-1]
    rank = np.empty(len(by), dtype=np.int64)
    rank[by] = np.cumsum(new) - 1
    return rank, rising[new]


def by_lanes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Order by both; a second sort only where equal numbers of the first lane have several of the second."""
    by = np.argsort(first)
    if ((first[by][1:] == first[by][:-1]) & (second[by][1:] != second[by][:-1])).any():
        by = np.lexsort((second, first))
    return by


def distinct_words(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 128-bit hashes in two lanes, a place of each distinct one and every one's number among them."""
    by = by_lanes(first, second)
    new = np.ones(len(by), dtype=bool)
    new[1:] = (first[by][1:] != first[by][:-1]) | (second[by][1:] != second[by][:-1])
    rank = np.empty(len(by), dtype=np.int64)
    rank[by] = np.cumsum(new) - 1
    return by[new], rank


def encode_chunk(ids: list, texts: list[bytes], folds: int, fold: int) -> tuple[int, bytes, bytes]:
    """How many tokens a chunk has; its ids, lengths and tokens; and its words' sorted hashes with their training counts.

    Tokens are numbers of the chunk's own words by falling frequency; the body also has the
    order of these numbers by hash.
    """
    lanes, counts = ([], []), []
    for lo, hi in slices(texts):
        words = Words(texts[lo:hi], NONSPACE, lower=True)
        for lane, own in enumerate(lanes):
            own.append(words.hashes(lane))
        counts.append(words.counts)
    lengths = np.concatenate(counts) + 1
    inner = np.ones(int(lengths.sum()), dtype=bool)
    inner[np.cumsum(lengths) - 1] = False
    hashes = []
    for lane, own in enumerate(lanes):
        tokens = np.full(len(inner), END[lane], dtype=U64)
        tokens[inner] = np.concatenate(own)
        hashes.append(tokens)
    first, rank = distinct_words(*hashes)
    trains = np.repeat(~held_out_rows(ids, folds, fold), lengths)
    counts = np.bincount(rank, minlength=len(first))
    falling = order_of(counts.max(initial=0) - counts)
    number = np.empty(len(first), dtype=np.int64)
    number[falling] = np.arange(len(first))
    known = np.array([0 if i is None else i for i in ids], dtype=np.int64).view(U64)
    unnamed = np.array([i is None for i in ids], dtype=np.int64)
    words = squeeze(*(h[first] for h in hashes), np.bincount(rank[trains], minlength=len(first)))
    return len(rank), squeeze(known, unnamed, lengths, number[rank], number), words


def cut(chunk_bytes: int, folds: int, fold: int):
    """Rows to chunks; a chunk's number is its task's and its place there, and is kept once it is written."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            release()
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                if texts and size + len(text) > chunk_bytes:
                    out.append(encode_chunk(ids, texts, folds, fold))
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text) + 24
            yield chunk_rows(number, out)
            number += len(out)
        if texts:
            yield chunk_rows(number, [encode_chunk(ids, texts, folds, fold)])

    return run


def chunk_rows(number: int, made: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    numbers, columns = range(number, number + len(made)), zip(CHUNKS.split(", ")[1:], (pa.int64(), pa.binary(), pa.binary()), strict=True)
    arrays = [pa.array([m[i] for m in made], kind) for i, (_, kind) in enumerate(columns)]
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *arrays], names=[c.split()[0] for c in CHUNKS.split(", ")])


# ---- questions and answers ---------------------------------------------------------------


@dataclass
class Model:
    """What every chunk knows of the whole: the split, the size of each level's exchange, and the totals so far."""

    folds: int
    fold: int
    least: tuple[int, ...]
    buckets: list[int]
    total: int = 0
    distinct: int = 0
    #: Numbers that a bucket of a level may give, and the discount, by level.
    stride: dict[int, int] = field(default_factory=dict)
    discount: dict[int, float] = field(default_factory=dict)

    @property
    def order(self) -> int:
        return len(self.least)

    def need(self, k: int) -> int:
        """Count that an n-gram of k words needs to be kept, and with it the shorter ones inside."""
        return self.least[k - 1]


def context_level(k: int) -> int:
    """Number of the exchange of the contexts of n-grams of k words; k itself is that of the n-grams."""
    return 100 + k


def in_buckets(bucket: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Order by bucket, then by the keys; one sort where all fits into 63 bits."""
    bits = [int(k.max(initial=0)).bit_length() for k in (bucket, *keys)]
    if sum(bits) <= 63:
        whole = bucket.astype(np.int64)
        for k, b in zip(keys, bits[1:], strict=True):
            whole = whole << b | k.astype(np.int64)
        return order_of(whole)
    return np.lexsort((*reversed(keys), bucket))


def cuts(bucket: np.ndarray):
    """(bucket, lo, hi) of sorted buckets."""
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi > lo:
            yield int(bucket[lo]), lo, hi


def top_bits(hashes: np.ndarray, buckets: int) -> np.ndarray:
    bits = buckets.bit_length() - 1
    return (hashes >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of rising numbers, the first from 0."""
    return np.diff(values, prepend=values.dtype.type(0))


def asked(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table(
        {name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(zip(("level", "bucket", "chunk", "body"), kinds, strict=True))}
    )


def ask_words(buckets: int):
    """A chunk's words to messages."""

    def run(batches):
        for batch in batches:
            release()
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("words").to_pylist(), strict=True):
                first, second, counts = expand(body)
                bucket = top_bits(first, buckets)
                rows = [(1, b, chunk, squeeze(first[lo:hi], second[lo:hi], counts[lo:hi])) for b, lo, hi in cuts(bucket)]
                yield from asked(rows).to_batches()

    return run


def added(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Whole sums of ``values`` by place, whatever their size."""
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, place, values)
    return out


class Gathered:
    """A bucket's messages as one list of keys: equal ones found, and a way to answer each message in its own order."""

    def __init__(self, bucket: pa.Table, n_keys: int, rising: bool):
        self.level, self.bucket = bucket.column("level")[0].as_py(), bucket.column("bucket")[0].as_py()
        got = sorted(zip(bucket.column("chunk").to_pylist(), bucket.column("body").to_pylist(), strict=True))
        self.chunks = [c for c, _ in got]
        parts = [expand(body) for _, body in got]
        if rising:
            parts = [[np.cumsum(p[0]), *p[1:]] for p in parts]
        self.bounds = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        self.keys, self.values = columns[:n_keys], [v.astype(np.int64) for v in columns[n_keys:]]
        del parts, columns
        by = by_lanes(*self.keys) if self.level == 1 else in_buckets(np.zeros(len(self.keys[0]), np.int64), *self.keys)
        new = np.ones(len(by), dtype=bool)
        new[1:] = False
        for k in self.keys:
            new[1:] |= k[by][1:] != k[by][:-1]
        self.rank = np.empty(len(by), dtype=np.int64)
        self.rank[by] = np.cumsum(new) - 1
        self.heads = by[new]
        self.n = len(self.heads)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Whole sums by distinct key."""
        return np.rint(
            np.bincount(self.rank, weights=values, minlength=self.n)
        ).astype(np.int64) if values.sum() < 2**52 else added(self.rank, values, self.n)

    def told(self, arrays: list[np.ndarray], stats: tuple[int, ...] = (0, 0, 0, 0, 0), number: np.ndarray | None = None) -> pa.Table:
        """``arrays`` hold one answer for each key that was sent; so does ``number``, of which those that aren't 0 rise with the keys, and their steps are sent."""
        n = len(self.chunks)
        bodies = []
        for lo, hi in zip(self.bounds[:-1], self.bounds[1:], strict=True):
            rising = [] if number is None else [steps(number[lo:hi][number[lo:hi] > 0])]
            bodies.append(squeeze(*(a[lo:hi] for a in arrays), *rising))
        columns = {"level": [self.level] * n, "bucket": [self.bucket] * n, "chunk": self.chunks}
        out = {k: pa.array(v, pa.int64()) for k, v in columns.items()} | {"body": pa.array(bodies, pa.binary())}
        for name, x in zip(("total", "kinds", "ones", "twos", "width"), stats, strict=True):
            out[name] = pa.array([x] + [0] * (n - 1), pa.int64())
        return pa.table(out)


def answer(model: Model):
    """Counts and numbers of the words or n-grams that a bucket is asked for; of n-grams also what each context's kept arcs add up to there, for the buckets of contexts."""

    def run(bucket: pa.Table) -> pa.Table:
        release()
        level = bucket.column("level")[0].as_py()
        g = Gathered(bucket, 2, rising=level > 1)
        count = g.sums(g.values[0])
        stats = int(count.sum()), int((count > 0).sum()), int((count == 1).sum()), int((count == 2).sum())
        if level == 1:
            return g.told([count[g.rank]], (*stats, g.n + 1), g.rank + 1)
        # only n-grams that longer ones may start with need a number
        numbered = count >= model.need(level + 1) if level < model.order else np.zeros(g.n, dtype=bool)
        number = np.cumsum(numbered) * numbered
        told = g.told([count[g.rank]], (*stats, int(number.max(initial=0)) + 1), number[g.rank])
        kept = count >= model.need(level)
        context = g.keys[0][g.heads[kept]]
        # distinct n-grams are in the order of their contexts
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.empty(0, np.int64)
        name, mass, arcs = context[first], np.add.reduceat(count[kept], first) if len(first) else first, np.diff(np.append(first, len(context)))
        to = top_bits(mix(name), model.buckets[level - 2])
        by = in_buckets(to, name)
        # the sender is told from chunks by its sign
        sent = [
            (context_level(level), b, -1 - g.bucket, squeeze(steps(name[by[lo:hi]]), arcs[by[lo:hi]], mass[by[lo:hi]])) for b, lo,
            hi in cuts(to[by])
        ]
        extra = asked(sent)
        for column in ANSWERED.split(", ")[4:]:
            extra = extra.append_column(column.split()[0], pa.array([0] * len(sent), pa.int64()))
        return pa.concat_tables([told, extra])

    return run


def answer_contexts(bucket: pa.Table) -> pa.Table:
    """How many kept arcs each context has, and what their counts add up to: chunks ask, buckets of n-grams bring their parts."""
    release()
    g = Gathered(bucket, 1, rising=True)
    n = int(np.searchsorted(g.chunks, 0))
    out = g.told([g.sums(v)[g.rank] for v in g.values])
    return out.slice(n)


class Chunk:
    """A chunk's tokens and what its answers say of them so far; every step is computed afresh from those."""

    def __init__(self, chunk: pa.Table, replies: pa.Table, model: Model):
        self.model, self.number = model, chunk.column("chunk")[0].as_py()
        known, unnamed, lengths, tokens, by_hash = expand(chunk.column("body")[0].as_py())
        self.ids = [None if u else i for i, u in zip(known.view(np.int64).tolist(), unnamed.tolist(), strict=True)]
        self.lengths, self.tokens, self.n_words = lengths.astype(np.int64), tokens.astype(np.int64), len(by_hash)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.doc = np.repeat(np.arange(len(self.ids)), self.lengths)
        self.held_out = held_out_rows(self.ids, model.folds, model.fold)
        self.trains = ~self.held_out[self.doc]
        self.replies: dict[int, dict[int, bytes]] = {}
        for level, bucket, body in zip(*(replies.column(c).to_pylist() for c in ("level", "bucket", "body")), strict=True):
            self.replies.setdefault(level, {})[bucket] = body
        self.grams: dict[int, Grams] = {}
        self.read_words(by_hash.astype(np.int64))

    def answers(self, level: int, bucket: np.ndarray, n: int) -> list[np.ndarray]:
        """``n`` arrays of answers in the order of the sorted ``bucket`` of each key."""
        out = [np.zeros(len(bucket), dtype=np.int64) for _ in range(n)]
        for b, lo, hi in cuts(bucket):
            for column, part in zip(out, expand(self.replies[level][b]), strict=True):
                column[lo:hi] = part.astype(np.int64)
        return out

    def read_words(self, by_hash: np.ndarray) -> None:
        """Counts and numbers of the chunk's words; the last one is what stands before a text."""
        self.count, self.name = np.zeros(self.n_words + 1, dtype=np.int64), np.full(self.n_words + 1, BEGIN, dtype=np.int64)
        # the answers of rising buckets are in the order of the words' hashes
        lo = 0
        for bucket, body in sorted(self.replies[1].items()):
            count, rising = expand(body)
            own = by_hash[lo : lo + len(count)]
            self.count[own], self.name[own] = count, 2 + bucket * self.model.stride[1] + np.cumsum(rising).astype(np.int64)
            lo += len(count)
        # names rise with hashes, so the order of the words' names is known
        self.place = np.zeros(self.n_words + 1, dtype=np.int64)
        self.place[by_hash] = np.arange(1, self.n_words + 1)
        self.by_place = np.append(self.n_words, by_hash)
        # as many texts begin as end
        self.count[-1] = self.count[self.tokens[-1]]
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.starts] = self.n_words

    def level(self, k: int) -> Grams:
        """The chunk's n-grams of k words that may be kept."""
        if k not in self.grams:
            self.grams[k] = Grams(self, k)
        return self.grams[k]

    def known(self, k: int) -> Grams:
        """The same, once they are answered."""
        g = self.level(k)
        if g.count is None:
            g.read(self.replies.get(k, {}))
        return g

    def ask_grams(self, k: int) -> list[tuple[int, int, int, bytes]]:
        g = self.level(k)
        counts = np.bincount(g.at[self.trains & (g.at >= 0)], minlength=g.n)
        first, last, counts = g.first_name[g.by], g.last_name[g.by], counts[g.by]
        return [(k, b, self.number, squeeze(steps(first[lo:hi]), last[lo:hi], counts[lo:hi])) for b, lo, hi in cuts(g.bucket)]

    def ask_contexts(self, k: int) -> list[tuple[int, int, int, bytes]]:
        """For each context in which the chunk reads a word after k - 1 others."""
        g = self.level(k)
        by, bucket = g.contexts()
        name, none = g.context_name[by], np.zeros(len(by), np.int64)
        return [(context_level(k), b, self.number, squeeze(steps(name[lo:hi]), none[lo:hi], none[lo:hi])) for b, lo, hi in cuts(bucket)]


class Grams:
    """Distinct n-grams of k words of a chunk: first k - 1 words (``first``, an n-gram of the level below), last word, last k - 1 words (``rest``)."""

    def __init__(self, chunk: Chunk, k: int):
        # nothing here refers back to the chunk, so that both are freed as soon as they are done with
        self.model, self.k, self.count = chunk.model, k, None
        need = chunk.model.need(k)
        if k == 2:
            first, rest, count, name = chunk.before, chunk.tokens, chunk.count, chunk.name
        else:
            below = chunk.known(k - 1)
            rest, count, name = below.at, below.count, below.name
            first = np.empty_like(rest)
            first[1:] = rest[:-1]
            first[chunk.starts] = -1
        usable = np.append(count >= need, False)
        read = usable[first]
        there = np.flatnonzero(read & usable[rest])
        if k == 2:
            # in the order of the names, so that only buckets are left to sort by
            rank, codes = distinct_numbers(chunk.place[first[there]] * (chunk.n_words + 1) + chunk.place[chunk.tokens[there]])
            self.first, self.word = (chunk.by_place[x] for x in np.divmod(codes, chunk.n_words + 1))
        else:
            rank, codes = distinct_numbers(first[there] * chunk.n_words + chunk.tokens[there])
            self.first, self.word = np.divmod(codes, chunk.n_words)
        self.n = len(codes)
        self.at = np.full(len(chunk.tokens), -1, dtype=np.int64)
        self.at[there] = rank
        self.rest = np.zeros(self.n, dtype=np.int64)
        self.rest[rank] = rest[there]
        self.first_name, self.last_name = name[self.first].astype(U64), chunk.name[self.word].astype(U64)
        # every context that a token is read in, also where no n-gram can be kept
        self.seen = np.zeros(len(usable), dtype=bool)
        self.seen[first[read]] = True
        self.names = name
        bucket = top_bits(mix(self.first_name * LANES[0] ^ mix(self.last_name)), chunk.model.buckets[k - 1])
        if k == 2:
            self.by = np.argsort(bucket.astype(np.uint16) if chunk.model.buckets[1] <= 1 << 16 else bucket, kind="stable")
        else:
            self.by = in_buckets(bucket, self.first_name, chunk.place[self.word])
        self.bucket = bucket[self.by]
        self.below_count = count

    def read(self, replies: dict[int, bytes]) -> None:
        """Takes the answers: counts, and so which n-grams are kept, and the numbers of those that longer ones may start with."""
        self.count, self.name = np.zeros(self.n, dtype=np.int64), np.zeros(self.n, dtype=np.int64)
        for bucket, lo, hi in cuts(self.bucket):
            count, rising = expand(replies[bucket])
            own = self.by[lo:hi]
            self.count[own] = count
            if self.k < self.model.order:
                numbered = own[count >= U64(self.model.need(self.k + 1))]
                self.name[numbered] = bucket * self.model.stride[self.k] + np.cumsum(rising).astype(np.int64)
        self.kept = self.count >= self.model.need(self.k)

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """The contexts' order by bucket and name, and the sorted buckets; ``context`` and ``of`` are there from then on."""
        self.context = np.flatnonzero(self.seen)
        self.context_name, self.of = self.names[self.context].astype(U64), (np.cumsum(self.seen) - 1)[self.first]
        bucket = top_bits(mix(self.context_name), self.model.buckets[self.k - 2])
        by = in_buckets(bucket, self.context_name)
        return by, bucket[by]


# ---- the automaton -----------------------------------------------------------------------


class Automaton:
    """The part of the backoff automaton that a chunk's texts can reach; weights are log10 probabilities.

    State 0 has no context; then come the words (the last one is a text's beginning) and the
    kept n-grams of each length. An arc is found by its state and word in a hash table with
    linear probing, whose slots hold what it costs and where it leads; ``failure`` leads to the
    next shorter context and costs ``penalty``. State 0 has an arc for every word.
    """

    def __init__(self, chunk: Chunk):
        model, self.n_words = chunk.model, chunk.n_words
        order = model.order
        levels = [chunk.known(k) for k in range(2, order + 1)]
        offset = [0, 1, chunk.n_words + 2]
        for g in levels[:-1]:
            offset.append(offset[-1] + g.n)
        n_states = offset[-1] if order > 1 else 1
        self.failure, self.penalty = np.zeros(n_states, dtype=np.int64), np.zeros(n_states)
        probability = (chunk.count[:-1] + 1) / (model.total + model.distinct + 1)
        self.root = np.log10(probability)
        self.after_root = np.where(chunk.count[:-1] > 0, 1 + np.arange(chunk.n_words), 0) if order > 1 else np.zeros(chunk.n_words, dtype=np.int64)
        self.begin = 1 + chunk.n_words if order > 1 and chunk.count[-1] > 0 else 0
        keys, weights, targets = [], [], []
        for g in levels:
            k = g.k
            discount = model.discount[k]
            by, bucket = g.contexts()
            arcs, mass = np.zeros(len(by)), np.zeros(len(by))
            arcs[by], mass[by] = chunk.answers(context_level(k), bucket, 2)
            size = g.below_count[g.context]
            left = 1 - (mass - discount * arcs) / size
            self.penalty[offset[k - 1] + g.context] = np.log10(left)
            probability = (g.count - discount) / size[g.of] + left[g.of] * probability[g.rest]
            kept = np.flatnonzero(g.kept)
            keys.append((offset[k - 1] + g.first[kept]) * chunk.n_words + g.word[kept])
            weights.append(np.log10(probability[kept]))
            shorter = offset[k - 1] + g.rest
            if k < order:
                self.failure[offset[k] + np.arange(g.n)] = shorter
                targets.append(offset[k] + kept)
            else:
                targets.append(shorter[kept])
        key, weight, target = (np.concatenate([*x, np.empty(0)]) for x in (keys, weights, targets))
        # in the order of their first slots, arcs take the next free slot one after another
        self.bits = max(4, int(2 * len(key)).bit_length())
        slot = self.slot(key.astype(np.int64))
        by = order_of(slot)
        at = np.arange(len(by)) + np.maximum.accumulate(slot[by] - np.arange(len(by))) if len(by) else slot
        size = (1 << self.bits) + len(key) + 1
        self.key = np.full(size, -1, dtype=np.int64)
        self.weight, self.target = np.zeros(size), np.zeros(size, dtype=np.int64)
        self.key[at], self.weight[at], self.target[at] = key[by], weight[by], target[by]

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(U64) * LANES[0] >> U64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The slot of each arc, or of none: a free one."""
        at = self.slot(key)
        held = self.key[at]
        todo = np.flatnonzero((held != key) & (held != -1))
        while len(todo):
            at[todo] += 1
            held = self.key[at[todo]]
            todo = todo[(held != key[todo]) & (held != -1)]
        return at

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What reading ``word`` costs in each state, and the states after it: failure arcs until an arc fits."""
        cost, after = np.zeros(len(state)), np.empty(len(state), dtype=np.int64)
        todo = np.arange(len(state))
        while len(todo):
            own, read = state[todo], word[todo]
            want = own * self.n_words + read
            at = self.find(want)
            fits, at_root = self.key[at] == want, own == 0
            hit = np.flatnonzero(fits)
            cost[todo[hit]] += self.weight[at[hit]]
            after[todo[hit]] = self.target[at[hit]]
            base = np.flatnonzero(at_root)
            cost[todo[base]] += self.root[read[base]]
            after[todo[base]] = self.after_root[read[base]]
            miss = np.flatnonzero(~fits & ~at_root)
            todo = todo[miss]
            cost[todo] += self.penalty[own[miss]]
            state[todo] = self.failure[own[miss]]
        return cost, after

    def walk(self, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, order: int) -> np.ndarray:
        """Each token's log10 probability, from left to right with the state carried.

        Many texts are walked side by side, long ones in lanes of LANE tokens: a lane that
        starts inside a text first reads the ``order`` - 1 tokens before it, after which its
        state is that of the whole text, as no context is longer.
        """
        out = np.zeros(len(tokens))
        n_lanes = -(-lengths // LANE)
        text = np.repeat(np.arange(len(lengths)), n_lanes)
        inside = LANE * (np.arange(len(text)) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes))
        warm = np.where(inside > 0, order - 1, 0)
        at = starts[text] + inside - warm
        size = np.minimum(LANE, lengths[text] - inside) + warm
        by = np.argsort(-size, kind="stable")
        at, size, warm = at[by], size[by], warm[by]
        state = np.where(warm > 0, 0, self.begin)
        for t in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -t, side="left"))
            cost, state[:live] = self.step(state[:live], tokens[at[:live] + t])
            counts = np.flatnonzero(t >= warm[:live])
            out[at[counts] + t] = cost[counts]
        return out


# ---- the operator ------------------------------------------------------------------------


def score_texts(
    documents: DataFrame, folds: int = 7, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
    least: tuple[int, ...] = LEAST, chunk_bytes: int | None = None, with_tokens: bool = False
) -> DataFrame:
    """Log10 probabilities of whole texts under a backoff n-gram model and an add-one unigram model.

    Tokens: lower-cased words [^\\x20\\x09-\\x0D]+, then one end. Learns from rows whose
    crc32(doc_id) mod ``folds`` is not ``fold`` (rows without an id are learned from) and
    scores all. N-grams of up to ``order`` words are kept from the training counts ``least``
    on (one for each length, not falling; rarer ones only count as what is left over).
    Returns one row per input row: doc_id, held_out, n_tokens, n_known (tokens with a
    training count), train_tokens, base_score (sum of log10((c+1)/(N+V+1))) and score (the
    automaton's); with ``with_tokens`` also token_scores, each token's part of the score.
    Null and blank texts are one end token. Rows and ids may repeat, and each row counts. An
    empty table gives no rows. Without training rows the only class known is the unknown
    token, so both scores are log10(1). Other columns are not read. A text is held whole by
    one task, so memory is bounded by a chunk or the longest text.
    """
    least = tuple(least)[:order]
    if len(least) < order or list(least) != sorted(least) or least[0] != 1:
        raise ValueError("least has a count for each length, 1 for words, and does not fall")
    source = keyed(documents, id_col, text_col)
    # the plan's estimate: it decides no result
    scale = growth(documents.sparkSession, CHUNK_BYTES, int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    made = settle(source.mapInArrow(cut(chunk_bytes or int(CHUNK_BYTES * scale), folds, fold), CHUNKS), "lm-made")
    tokens = made.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    model = Model(folds, fold, least, [bucket_count(tokens / (6 if k == 0 else 1.5), int(BUCKET_KEYS * min(scale, 4))) for k in range(order)])

    def question(k: int):
        """Of n-grams of k words and of their contexts."""

        def ask(chunk: pa.Table, answers: pa.Table) -> pa.Table:
            release()
            if not chunk.num_rows:
                return asked([])
            c = Chunk(chunk, answers, model)
            return asked([*c.ask_grams(k), *c.ask_contexts(k)])

        return ask

    def answered(sent: DataFrame) -> DataFrame:
        return settle(sent.groupBy("level", "bucket").applyInArrow(answer(model), ANSWERED), "lm-answers")

    def totals(found: DataFrame, level: int) -> list[int]:
        whole = found.where(F.col("level") == level).agg(
            *(F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "kinds", "ones", "twos")), F.coalesce(F.max("width"), F.lit(1))
        )
        return list(whole.first())

    found = answered(made.select("chunk", "words").mapInArrow(ask_words(model.buckets[0]), ASKED))
    model.total, model.distinct, _, _, model.stride[1] = totals(found, 1)
    replies = found.select("level", "bucket", "chunk", "body")
    chunks = settle(made.select("chunk", "body"), "lm-chunks")
    discard(made)
    grouped = chunks.groupBy("chunk")
    for k in range(2, order + 1):
        sent = settle(grouped.cogroup(replies.groupBy("chunk")).applyInArrow(question(k), ASKED), "lm-asked")
        found = answered(sent.where(F.col("level") == k))
        _, _, ones, twos, model.stride[k] = totals(found, k)
        model.discount[k] = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
        plain = found.select("level", "bucket", "chunk", "body")
        of_contexts = sent.where(F.col("level") == context_level(k)).unionByName(plain.where(F.col("level") == context_level(k)))
        contexts = settle(of_contexts.groupBy("level", "bucket").applyInArrow(answer_contexts, ANSWERED), "lm-contexts")
        discard(sent)
        replies = replies.unionByName(plain.where(F.col("level") == k)).unionByName(contexts.select("level", "bucket", "chunk", "body"))

    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        names = [f.split()[0] for f in RESULT.split(", ")]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if with_tokens:
            names, kinds = [*names, "token_scores"], [*kinds, pa.list_(pa.float64())]
        if not chunk.num_rows:
            return pa.table({f: pa.array([], k) for f, k in zip(names, kinds, strict=True)})
        c = Chunk(chunk, answers, model)
        automaton = Automaton(c)
        each = automaton.walk(c.tokens, c.starts, c.lengths, order)
        docs = len(c.ids)
        by_doc = lambda x: np.bincount(c.doc, weights=x, minlength=docs)
        columns = [
            c.ids, c.held_out, c.lengths, by_doc(c.count[c.tokens] > 0).astype(np.int64), [model.total] * docs,
            by_doc(automaton.root[c.tokens]), by_doc(each)
        ]
        if with_tokens:
            columns.append([x.tolist() for x in np.split(each, c.starts[1:])])
        return pa.table({f: pa.array(x, k) for f, x, k in zip(names, columns, kinds, strict=True)})

    return grouped.cogroup(replies.groupBy("chunk")).applyInArrow(score, RESULT + (", token_scores array<double>" if with_tokens else ""))


def op10_langmodel(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, by the contract's split; see score_texts()."""
    return score_texts(table(spark, sf_dir, "documents"))
