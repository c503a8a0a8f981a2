"""A public word-level BPE tokenizer at corpus speed.

The tokenizer's own library is the authority and encodes every word that is out of the
ordinary. Ordinary words (printable ASCII without apostrophes or angle brackets, and the
letters of Latin-1) are each encoded once a batch, all together: the merges of thousands of
pre-tokens of one length are found by array operations, one merge a round and pre-token, in
the order of the merge table. White space ends every pre-token of this tokenizer, so a text's
ids are those of its words in order.
"""

from __future__ import annotations

import json

import numpy as np

from pagequarry.llm.common import U64, Words, distinct_spans

#: Only these end a word here; other white space sends a word to the library.
SPLIT = np.ones(256, dtype=bool)
SPLIT[[0x20, 0x09, 0x0A, 0x0D]] = False
LONGEST = 24
_NONE = np.int32(2**31 - 1)

LETTER, DIGIT, OTHER = 1, 2, 3
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[0x21:0x7F] = OTHER
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = LETTER
_CLASS[0x30:0x3A] = DIGIT
_CLASS[ord("'")] = _CLASS[ord("<")] = 0


class WordBpe:
    """``spec`` is the text of the tokenizer's file."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        spec = json.loads(self.library.to_str())
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.end = spec["model"]["end_of_word_suffix"]
        # a byte's symbol, inside a pre-token and at its end, by the library's own byte-level alphabet
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(visible)]
        char = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.inner = np.array([vocab[char[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab[char[b] + self.end] for b in range(256)], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([*(vocab[a + b] for a, b in pairs), 0], dtype=np.int32)
        self._table(left << 20 | right)

    def _table(self, keys: np.ndarray) -> None:
        """Open addressing with linear probing: merge rank by pair."""
        self.bits = 18
        slots = np.full(1 << self.bits, -1, dtype=np.int64)
        ranks = np.full(1 << self.bits, _NONE, dtype=np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        probes = 0
        while len(todo):
            free = slots[at[todo]] == -1
            first = np.zeros(len(todo), dtype=bool)
            first[np.unique(at[todo], return_index=True)[1]] = True
            put = todo[free & first]
            slots[at[put]], ranks[at[put]] = keys[put], put
            todo = todo[~(free & first)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            probes += 1
        self.slots, self.ranks, self.probes = slots, ranks, probes

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(U64) * U64(0x9E3779B97F4A7C15) >> U64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right
        at = self._slot(keys)
        out = np.full(keys.shape, _NONE, dtype=np.int32)
        held = self.slots[at]
        hit = held == keys
        out[hit] = self.ranks[at[hit]]
        todo = np.flatnonzero((~hit & (held != -1)).ravel())
        flat_keys, flat_at, flat_out = keys.ravel(), at.ravel(), out.ravel()
        while len(todo):
            flat_at[todo] = (flat_at[todo] + 1) & ((1 << self.bits) - 1)
            held = self.slots[flat_at[todo]]
            hit = held == flat_keys[todo]
            flat_out[todo[hit]] = self.ranks[flat_at[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        return flat_out.reshape(keys.shape)

    def merge(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of one length merged: symbols (left-aligned) and how many remain of each row."""
        n, width = symbols.shape
        out, length = symbols.copy(), np.full(n, width)
        if width == 1:
            return out, length
        rows = np.arange(n)
        work = symbols
        ranks = self.rank(work[:, :-1], work[:, 1:])
        columns = np.arange(width)
        while True:
            best = ranks.argmin(axis=1)
            at = np.arange(len(rows))
            least = ranks[at, best]
            going = least != _NONE
            if not going.all():
                done = ~going
                out[rows[done], : work.shape[1]] = work[done]
                length[rows[done]] = work.shape[1]
                rows, work, ranks, best, least = rows[going], work[going], ranks[going], best[going], least[going]
                at = np.arange(len(rows))
            if not len(rows):
                return out, length
            w = work.shape[1] - 1
            after = columns[None, :w] > best[:, None]
            merged = np.where(after, work[:, 1:], work[:, :-1])
            merged[at, best] = self.made[least]
            if w == 1:
                out[rows, 0] = merged[:, 0]
                length[rows] = 1
                return out, length
            ranks = np.where(columns[None, : w - 1] >= best[:, None], ranks[:, 1:], ranks[:, :-1])
            work = merged
            before = np.flatnonzero(best > 0)
            ranks[before, best[before] - 1] = self.rank(work[before, best[before] - 1], work[before, best[before]])
            behind = np.flatnonzero(best < w - 1)
            ranks[behind, best[behind]] = self.rank(work[behind, best[behind]], work[behind, best[behind] + 1])

    def encode_words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, one after another, and where each word's begin (one more at the end)."""
        size = ends - starts
        first = np.concatenate([[0], np.cumsum(size)])
        word = np.repeat(np.arange(len(size)), size)
        data = raw[np.arange(first[-1]) - first[word] + starts[word]]
        # letters of Latin-1 are C3 80..BF but for the signs C3 97 and C3 B7; upper case there is 80..9E
        lead = data == 0xC3
        tail = np.concatenate([[False], lead[:-1]]) & (np.concatenate([[-1], word[:-1]]) == word)
        kind = _CLASS[data]
        kind[lead] = LETTER
        kind[tail & (data >= 0x80) & (data < 0xC0) & (data != 0x97) & (data != 0xB7)] = LETTER
        paired = np.concatenate([tail[1:], [False]])
        kind[lead & ~paired] = 0
        upper = (data >= 0x41) & (data < 0x5B) | tail & (data >= 0x80) & (data <= 0x9E)
        data = data + np.where(upper, 0x20, 0).astype(np.uint8)
        odd = np.zeros(len(size), dtype=bool)
        odd[word[kind == 0]] = True
        start = np.ones(len(data), dtype=bool)
        start[1:] = (kind[1:] != kind[:-1]) | (word[1:] != word[:-1]) | (kind[1:] == DIGIT)
        begin = np.flatnonzero(start)
        length = np.diff(np.concatenate([begin, [len(data)]]))
        odd[word[begin[length > LONGEST]]] = True
        fine = ~odd[word[begin]]
        begin, length = begin[fine], length[fine]
        symbols = self.inner[data]
        stop = begin + length - 1
        symbols[stop] = self.last[data[stop]]
        counts = np.zeros(len(begin), dtype=np.int64)
        merged: list[tuple[np.ndarray, np.ndarray]] = []
        for width in np.unique(length):
            rows = np.flatnonzero(length == width)
            got, kept = self.merge(symbols[begin[rows][:, None] + np.arange(width)[None, :]])
            counts[rows] = kept
            merged.append((rows, got))
        owner = word[begin]
        per_word = np.bincount(owner, weights=counts, minlength=len(size)).astype(np.int64)
        strange = np.flatnonzero(odd)
        if len(strange):
            texts = [raw[s:e].tobytes().decode() for s, e in zip(starts[strange], ends[strange], strict=True)]
            by_library = [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
            per_word[strange] = [len(x) for x in by_library]
        at = np.concatenate([[0], np.cumsum(per_word)])
        ids = np.empty(at[-1], dtype=np.uint32)
        place = np.cumsum(counts) - counts
        new_word = np.ones(len(owner), dtype=bool)
        new_word[1:] = owner[1:] != owner[:-1]
        base = place[np.flatnonzero(new_word)][np.cumsum(new_word) - 1] if len(owner) else place
        place = at[owner] + place - base
        for rows, got in merged:
            kept = counts[rows]
            inside = np.arange(got.shape[1])[None, :] < kept[:, None]
            ids[(place[rows][:, None] + np.arange(got.shape[1])[None, :])[inside]] = got[inside]
        for i, x in zip(strange.tolist(), by_library if len(strange) else [], strict=True):
            ids[at[i] : at[i + 1]] = x
        return ids, at

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and where each text's begin (one more at the end)."""
        words = Words(texts, SPLIT, lower=False)
        if not len(words.starts):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        # a word is only taken for another if its bytes are the same
        first, rank = distinct_spans(words.raw, words.starts, words.ends)
        ids, at = self.encode_words(words.raw, words.starts[first], words.ends[first])
        count = np.diff(at)[rank]
        end = np.cumsum(count)
        which = np.repeat(at[:-1][rank] - (end - count), count)
        return ids[which + np.arange(len(which))], np.concatenate([[0], end])[words.first]
